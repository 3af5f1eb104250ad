"""Incremental runs with Structured Streaming: events arrive as files, state is kept across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen(spark: SparkSession, path: str, schema, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """A stream of one event of each key, whichever comes first; in a micro-batch that is any of them. The watermark bounds the
    remembered keys: a key that is seen again later than ``delay`` comes a second time."""
    stream = spark.readStream.schema(schema).parquet(path)
    stream = stream.withColumn(time, stream[time].cast("timestamp"))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process what has arrived since the last run and stop; a rerun resumes from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_state(state: DataFrame, batch: DataFrame, recipient: str, keys: str, limit: int = 2000) -> DataFrame:
    """Remembered keys per recipient after a batch: old ones first, then new ones in order, the last ``limit`` kept.

    Keys are rows until each recipient's are bounded, so no more than ``limit`` of them are gathered.
    """
    old = state.select(recipient, F.posexplode("keys").alias("_at", "_key"))
    new = batch.select(recipient, F.col(keys).alias("_key")).distinct().select(recipient, F.lit(None).cast("int").alias("_at"), "_key")
    first = old.unionByName(new).groupBy(recipient, "_key").agg(F.min("_at").alias("_at"))
    latest = Window.partitionBy(recipient).orderBy(F.col("_at").desc_nulls_first(), F.col("_key").desc())
    kept = first.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= limit)
    return kept.groupBy(recipient).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_rank")).alias("r"), "_key"))), lambda x: x["_key"]).alias("keys"))
