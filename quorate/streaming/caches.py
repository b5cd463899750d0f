"""Streams: the answer cache as an upsert, resumable scoring, and event-time windows as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import delete_path, scratch_path
from ..sources.jsonl import CACHE


def run_once(frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over what is there, into a table of the shared folder, and returns that table."""
    spark = frame.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-marks")
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a table: a folder, or one file by its name in its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The finished versions of a table, ascending: those with a success mark."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{target}/v*/_SUCCESS")
    found = at.getFileSystem(conf).globStatus(at)
    return sorted(int(x.getPath().getParent().getName()[1:]) for x in found or [])


def upsert_cache(lines: DataFrame, target: str) -> str:
    """Streams raw cache lines (ord, line) into a Parquet table: for each key the last good line by ord wins. Returns its path.

    Each batch joins the version before it and is written as a version of its own number, so
    a batch that runs again, after a restart too, gives the same table; older versions go
    once a newer one is finished.
    """
    spark = lines.sparkSession
    rows = lines.where(F.trim("line") != "").select("ord", F.from_json("line", CACHE).alias("r"))
    good = rows.where("r.key is not null and r.answer.distributions is not null").select(F.col("r.key").alias("key"), F.col("r.answer").alias("answer"), "ord")

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in _versions(spark, target) if v < number]
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/v{before[-1]}")) if before else batch
        both.groupBy("key").agg(F.max_by("answer", "ord").alias("answer"), F.max("ord").alias("ord")).write.mode("overwrite").parquet(f"{target}/v{number}")
        for v in before[:-1]:
            delete_path(spark, f"{target}/v{v}")

    good.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/marks").trigger(availableNow=True).start().awaitTermination()
    if not _versions(spark, target):
        spark.createDataFrame([], good.schema).write.parquet(f"{target}/v0")
    return f"{target}/v{_versions(spark, target)[-1]}"


def cache_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The upserted cache of the raw cache table at path."""
    return spark.read.parquet(upsert_cache(stream_of(spark, path, schema).select("ord", "line"), scratch_path(spark, "cache")))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums of events in tumbling windows; late ones beyond the watermark are dropped in a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions of each user, closed by a gap."""
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
