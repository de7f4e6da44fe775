"""What the operators of this subpackage share: the shared folder, tables written there,
skew-safe joins, size-checked broadcasts and ordered buckets."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a size-checked broadcast may have; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: A key with more than 1/HEAVY_SHARE of all rows is joined by broadcast: there are at most HEAVY_SHARE such keys.
HEAVY_SHARE = 1000

_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts fits in a Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def release() -> None:
    """Gives memory that this process holds but does not use back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy(run: Callable[[Iterator], Iterator], drop: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """run, a function over a task's batches; at its end drop is called and memory goes back, for workers live on beside later stages."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            drop()
            release()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, a temporary one, in local mode only."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = _own_dirs.get(sc.applicationId)
    if own is None:
        own = _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomline-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended; the folder stays
            return


def stored(df: DataFrame, name: str, rows: int | None = None, per_file: int = 500_000) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and lost executors cost nothing.

    rows: at most how many there are, where that is known; then no more files than that many rows want.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df if rows is None else df.coalesce(rows // per_file + 1)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts right if it has at most limit rows, else leaves the join to a shuffle. right should be stored or cheap, for it is counted."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= limit else right, on, how)


def join_by_frequency(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, of which each row has another key and, in weight, how many rows of left have it.

    Keys with more than 1/HEAVY_SHARE of total are at most HEAVY_SHARE rows of right; they are broadcast, the
    others shuffle, so that no task gets more than that share through one key. how: inner or left.
    """
    cut = max(1000, total // HEAVY_SHARE)
    heavy = right.where(F.col(weight) > cut)
    light = right.where(F.col(weight) <= cut)
    if not heavy.take(1):
        return left.join(right, key, how)
    hot = left.join(F.broadcast(heavy), key, "inner")
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return hot.unionByName(rest)


def join_skewed(left: DataFrame, right: DataFrame, key: str, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """left joined to right, of which each row has another key: by broadcast up to limit rows of right, else by frequency.

    Beyond the limit the keys of left are counted first, in a pass of its own that tasks add up before they shuffle.
    right should be stored or cheap.
    """
    if (right.count() if rows is None else rows) <= limit:
        return left.join(F.broadcast(right), key)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n_left"))
    known = stored(right.join(counts, key), "key-frequencies")
    total = known.agg(F.coalesce(F.sum("__n_left"), F.lit(0))).first()[0]
    return join_by_frequency(left, known, key, "__n_left", total).drop("__n_left")


def join_salted(left: DataFrame, right: DataFrame, key: str, beside: str, cut: int = 2000) -> DataFrame:
    """left joined to right, of which each row has another key and may be wide; no task gets many more than cut rows of left for one key.

    A key that more rows of left have is split by a hash of the column beside, and its row of right goes to each part.
    left should be stored or cheap.
    """
    hot = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / cut).cast("int").alias("__parts")).where("__parts > 1")
    hot = stored(hot, "hot-keys")
    if not hot.take(1):
        return left.join(right, key)
    parts = F.coalesce("__parts", F.lit(1))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    split = left.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(beside), parts).cast("int")).drop("__parts")
    copies = right.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return split.join(copies, [key, "__part"]).drop("__part")


def order_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n values of the column, rising, the least first, that cut its rows into about equal ranges. Only that column is read."""
    if n <= 1:
        row = df.agg(F.min(column)).first()
        return [] if row[0] is None else [row[0]]
    shares = [i / n for i in range(1, n)]
    low, cuts = df.agg(F.min(column), F.percentile_approx(column, F.array(*map(F.lit, shares)), 100_000)).first()
    return [] if low is None else sorted({low, *(cuts or [])})


def bucket_of(column: Column, bounds: list[int]) -> Column:
    """Index of the range of order_bounds that holds the value, 0 for NULL; two searches over the root of their number."""
    if len(bounds) < 2:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda b: b <= column))
    if len(bounds) <= 64:
        return F.coalesce(F.greatest(below(F.array(*map(F.lit, bounds))) - 1, F.lit(0)), F.lit(0))
    firsts = F.array(*[F.lit(b) for b in bounds[::step]])
    parts = F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)])
    coarse = F.greatest(below(firsts) - 1, F.lit(0))
    return F.coalesce(F.greatest(coarse * step + below(F.get(parts, coarse)) - 1, F.lit(0)), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def docs_of(df: DataFrame) -> DataFrame:
    """doc_id and text alone, a NULL text as the empty one; other columns, whatever their names, are not read."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the doc_id as text, modulo mod; a NULL id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def local_path(uri: str) -> str:
    """The local path of a file: URI, for tools and tests that look at single files."""
    return unquote(urlparse(uri).path) if uri.startswith("file:") else uri
