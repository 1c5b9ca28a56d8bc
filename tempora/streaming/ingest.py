"""Live statuses: ingest into an index, a raw archive, broadcast. Every sink leaves what a batch over its input leaves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempora.operators import index
from tempora.sources import tables


def read_json(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw statuses as they arrive in a folder."""
    return spark.readStream.schema(tables.STATUS_JSON).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, one folder or file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if path.endswith("*") else f"{path}*")


def _once(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archive(raw: DataFrame, out: str, checkpoint: str, time: str = "ts", warning: str = "event_type = 'error'") -> StreamingQuery:
    """Messages as gzipped JSON lines by kind and UTC hour."""
    rows = raw.select(F.date_format(time, "yyyy-MM-dd-HH").alias("hour"), F.when(F.expr(warning), F.lit("warnings")).otherwise(F.lit("statuses")).alias("kind"), F.to_json(F.struct("*")).alias("value"))
    return _once(rows.writeStream.format("text").option("compression", "gzip").partitionBy("kind", "hour").option("path", out), checkpoint)


def into_index(statuses: DataFrame, path: str, checkpoint: str, analyze: Callable = index.word_tokens) -> StreamingQuery:
    """Appends postings batch by batch; a batch that runs again replaces its own files, so each status counts once."""

    def add(batch: DataFrame, number: int) -> None:
        index.postings(batch, analyze).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _once(statuses.writeStream.foreachBatch(add), checkpoint)


def poll(statuses: DataFrame, out: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Asks for new statuses again and again; the checkpoint knows the last that was seen. Runs until it is stopped."""
    return statuses.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def broadcast(statuses: DataFrame, send: Callable[[int, DataFrame], None], checkpoint: str, geo_only: bool = False) -> StreamingQuery:
    """Sends each batch as JSON with its number; with geo_only those that have a place, with the id as text too."""
    rows = statuses.where("geo is not null").withColumn("id_str", F.col("id").cast("string")) if geo_only else statuses
    return _once(rows.select(F.to_json(F.struct("*")).alias("value")).writeStream.foreachBatch(lambda batch, number: send(number, batch)), checkpoint)


def dedup(statuses: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id once within the time that a repeat can be late; without a limit the state would grow for ever."""
    return statuses.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])


def counts(statuses: DataFrame, by: str, width: str = "1 hour", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Statuses by time window and kind."""
    timed = statuses.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def _paths(spark: SparkSession) -> tuple[str, str]:
    return index.shared_path(spark, "stream"), index.shared_path(spark, "offsets")


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, marks = _paths(spark)
    events = read_table(spark, f"{sf_dir}/events.parquet").select("event_id", tables.seconds("ts").alias("epoch"), "user_id", "event_type")
    _once(events.writeStream.format("parquet").option("path", out), marks).awaitTermination()
    return spark.read.parquet(out)


def archive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, marks = _paths(spark)
    archive(read_table(spark, f"{sf_dir}/events.parquet"), out, marks).awaitTermination()
    return spark.read.schema("value string, kind string, hour string").text(out).groupBy("hour", "kind").agg(F.count("*").alias("n"))


def index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, marks = _paths(spark)
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("screen_name"), "text")
    into_index(docs, out, marks).awaitTermination()
    return index.term_stats(spark.read.parquet(out))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, marks = _paths(spark)
    found = counts(read_table(spark, f"{sf_dir}/events.parquet"), "event_type", "1 day")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.unix_timestamp("window.start").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    _once(found.writeStream.outputMode("update").foreachBatch(keep), marks).awaitTermination()
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))
