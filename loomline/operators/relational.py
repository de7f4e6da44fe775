"""Joins with contracts, ordered deduplication, top-k, unions with priority, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ContractError(ValueError):
    """A table breaks what the operator relies on."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of the names that the table has."""
    for name in names:
        if name in df.columns:
            return name
    raise ContractError(f"none of the columns {', '.join(names)}")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    again = df.groupBy(*keys).count().where("count > 1").take(1)
    if again:
        raise ContractError(f"{', '.join(keys)} is not unique: {again[0]}")
    return df


def require_empty(df: DataFrame, what: str) -> None:
    rows = df.take(1)
    if rows:
        raise ContractError(f"{what}: {rows[0]}")


def join_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", both: bool = False) -> DataFrame:
    """A join whose right keys, and with both the left ones too, must be unique."""
    require_unique(right, keys)
    if both:
        require_unique(left, keys)
    return left.join(right, keys, how)


def attach_sides(pairs: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of a dimension for both sides of a pair, with suffix _a and _b; every side must be found."""
    out = pairs
    for s in ("a", "b"):
        side = dimension.select(F.col(key).alias(f"{key}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns], F.lit(True).alias(f"_found_{s}"))
        out = out.join(side, f"{key}_{s}", "left")
    require_empty(out.where(F.col("_found_a").isNull() | F.col("_found_b").isNull()), "a pair has an unknown side")
    return out.drop("_found_a", "_found_b")


def without_either(pairs: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows neither of whose sides is excluded."""
    for s in ("a", "b"):
        pairs = pairs.join(excluded.select(F.col(key).alias(f"{key}_{s}")), f"{key}_{s}", "left_anti")
    return pairs


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per keys: the first in the order."""
    return top_by(df, keys, order, 1)


def top_by(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows per keys in the order, with their rank if it has a name."""
    name = rank or "_k"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def diverse_top(df: DataFrame, group: str, order: list[Column | str], k: int, rank: str = "position") -> DataFrame:
    """k rows in the order, the first of every group before any second one."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order)) > 1
    chosen = df.withColumn("_again", first).orderBy("_again", *order).limit(k)
    return chosen.withColumn(rank, F.row_number().over(Window.orderBy("_again", *order))).drop("_again")


def by_priority(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several tables, those of an earlier one first where keys repeat."""
    out = None
    for i, df in enumerate(tables):
        df = df.withColumn("_priority", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    own = Window.partitionBy(*keys).orderBy("_priority")
    return out.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k", "_priority")


def replace_changed(stable: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """stable with the rows of changed in place of its own; a changed row without label is dropped."""
    kept = stable.join(changed.select(key), key, "left_anti")
    return kept.unionByName(changed.where(F.col("label").isNotNull()), allowMissingColumns=True)


def until_share(counts: DataFrame, keys: list[str], n: str, share: float, least: int, most: int, tie: str) -> DataFrame:
    """Per keys the largest rows up to the one at which their cumulative share reaches `share`, between least and most rows."""
    own = Window.partitionBy(*keys).orderBy(F.desc(n), tie)
    total = F.sum(n).over(Window.partitionBy(*keys))
    running = F.sum(n).over(own.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("rank", F.row_number().over(own)).withColumn("cumulative_share", F.round(F.coalesce(F.try_divide(running, total), F.lit(0.0)), 9))
    before = F.coalesce(F.lag("cumulative_share").over(own), F.lit(0.0))
    chosen = ranked.withColumn("_before", before).withColumn("_total", total)
    reached = (F.col("_total") > 0) & (F.col("_before") < share) & (F.col("rank") <= most)
    return chosen.where(reached | (F.col("rank") <= least)).drop("_before", "_total")


def pivot_counts(df: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of the given values as columns, 0 where there are none."""
    return df.groupBy(*rows).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, values)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
