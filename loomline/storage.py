"""Tables written to the shared folder to end a lineage, and joins that broadcast only what is small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 2_000_000
#: Rows that a task of a spread table has, about.
TASK_ROWS = 1_000_000
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a temporary folder."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomline-"))


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts right if it has at most limit rows; beyond that the join shuffles. right should be cheap to count."""
    return left.join(F.broadcast(right) if right.count() <= limit else right, on, how)


def spread(df: DataFrame, column: str, rows: int = TASK_ROWS) -> DataFrame:
    """df with all rows of a value of column in one task, and as many tasks as its rows want. df should be cheap to count."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), column)
