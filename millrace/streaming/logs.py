"""Streams: append-only logs upserted by key, event-time windows, orphan events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def upsert_last(stream: DataFrame, target: str, key: str, order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the last row per key in the table at ``target``: a batch rewrites only the buckets of keys it touches.

    Each batch writes its merged buckets as a new epoch beside the old ones; the
    table is the newest epoch of every bucket (``last_epoch``). A repeated batch
    gives the same table, so a restart loses and doubles nothing. Of each
    bucket the epoch before the newest is kept, older ones are removed.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        newest = _newest(spark, target, epoch)
        if newest is not None:
            known = {r["bucket"]: r["epoch"] for r in newest.collect() if r["bucket"] in touched}
            old = _table(spark, target, newest).filter(F.col("bucket").isin(*touched)).drop("epoch")
            rows = old.select(*rows.columns).unionByName(rows)
        w = Window.partitionBy(key).orderBy(F.col(order).desc())
        rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/epoch={epoch}")
        if newest is not None:
            _prune(spark, target, known)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """(bucket, epoch): the newest epoch of every bucket, of those before ``before``; one row per bucket."""
    if not _exists(spark, target):
        return None
    df = spark.read.parquet(target)
    return (df if before is None else df.filter(F.col("epoch") < before)).groupBy("bucket").agg(F.max("epoch").alias("epoch"))


def _table(spark: SparkSession, target: str, newest: DataFrame) -> DataFrame:
    return spark.read.parquet(target).join(F.broadcast(newest), ["bucket", "epoch"])


def _prune(spark: SparkSession, target: str, kept: dict[int, int]) -> None:
    """Removes the epochs of each bucket before the kept one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("epoch="):
            for bucket, epoch in kept.items():
                if int(name[6:]) < epoch:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), f"bucket={bucket}"), True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def last_epoch(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the last finished batch."""
    return _table(spark, target, _newest(spark, target)).drop("epoch", "bucket")


def windowed_counts(stream: DataFrame, ts: str, by: list[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time windows with a watermark: (start, end, by..., n, total). Works on a stream and on a table alike."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select("window.start", "window.end", *by, "n", "total")
    )


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): sessions that end after ``gap`` without an event."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")
