"""Session defaults, table access and the few helpers that touch the cluster itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def builder(app: str = "millrace", master: str | None = None) -> SparkSession.Builder:
    """A session builder with the settings the operators are written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }.items():
        b = b.config(key, value)
    return b


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Unset, a temporary folder is made where master and executors are one
    machine, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as a compressed columnar table and read again: for wide rows that several passes read.

    ``codec`` takes the place of the session's codec where space counts more than time.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, keys: list[str], rows: int, share: float = 0.005, floor: int = 50_000) -> DataFrame:
    """Keys that hold at least ``max(floor, share * rows)`` of the rows of ``df``.

    ``rows`` is a lower bound of the row count, so at most ``1 / share`` keys
    come out (for ``df`` of ``rows`` rows): a broadcast of them is bounded.
    """
    least = max(floor, int(share * rows))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: str, how: str = "left", salts: int = 32
) -> DataFrame:
    """Sort-merge join in which the hot keys of ``left`` are spread over ``salts`` tasks.

    ``right`` holds one row per key; only its hot rows are replicated. ``spread``
    names the column of ``left`` whose hash picks the salt. Null keys match nothing.
    """
    flag = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    left = left.join(flag, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    right = right.join(flag, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0))))
    )
    return left.drop("_hot").hint("merge").join(right.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
