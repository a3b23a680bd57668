"""Structured Streaming forms of the staged queue; each is defined by equality with its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import fresh_path


def as_queue_events(events: DataFrame) -> DataFrame:
    """The event log read as queue operations: errors remove, rare signups clear a stage, all else adds."""
    op = F.when(F.col("event_type") == "error", "remove").when((F.col("event_type") == "signup") & (F.col("value") > 99), "clear").otherwise("add")
    stage = F.concat(F.lit("stage"), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string"))
    return events.select("ts", "event_id", stage.alias("stage"), F.col("user_id").alias("item"), op.alias("op"))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream with a zoned event time, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if not name.endswith(".parquet") else name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def state(events: DataFrame) -> DataFrame:
    """The last event of each item and the number of its events, as a streaming aggregate."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(window_start, event_type, n): tumbling counts that close once the watermark has passed."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run over all that is available and return the result table."""
    path = fresh_path(spark, "stream")
    if mode == "append":
        out = f"{path}-out"
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    kept = f"{path}-out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(kept)  # complete mode: each batch is the whole table

    stream.writeStream.outputMode("complete").option("checkpointLocation", path).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(kept)


def run_state_stream(spark: SparkSession, path: str) -> DataFrame:
    return run_to_end(spark, state(event_stream(spark, path)), "complete")


def stage_moves(events: DataFrame, order: dict[str, int], item: str, stage: Column) -> DataFrame:
    """The furthest stage of each item."""
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return events.groupBy(item).agg(F.max_by(stage, rank[stage]).alias("stage"))
