"""Arrivals against a library: a stream of new items is asked batch by batch, and the library grows by what is new. Beyond the batch engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kinsift.operators.exact import content_hash


def arrivals(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    """Files of Parquet that come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ingest(stream: DataFrame, library: str, answers: str, checkpoint: str, id_col: str, content_col: str) -> StreamingQuery:
    """Each batch's items are answered repeat or new against the library, and the new ones are added to it.

    Of equal items in a batch the smallest id is new. A batch that is run again after a failure finds its
    own rows by their batch number and gives the same answers.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        items = df.select(F.col(id_col).alias("item"), content_hash(F.col(content_col)).alias("hash"))
        held = spark.read.schema("item bigint, hash string, batch bigint").parquet(library).filter(F.col("batch") < number)
        first = items.groupBy("hash").agg(F.min("item").alias("head"))
        known = held.groupBy("hash").agg(F.min("item").alias("holder"))
        met = items.join(first, "hash").join(known, "hash", "left")
        said = met.select("item", "hash", F.when(F.col("holder").isNull() & (F.col("item") == F.col("head")), "new").otherwise("repeat").alias("verdict"), F.coalesce("holder", "head").alias("of"), F.lit(number).alias("batch"))
        said.write.mode("overwrite").parquet(f"{answers}/batch={number}")
        new = spark.read.parquet(f"{answers}/batch={number}").filter("verdict = 'new'").select("item", "hash", F.lit(number).cast("bigint").alias("batch"))
        new.write.mode("overwrite").parquet(f"{library}/part={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of event types in tumbling windows of event time, with late data up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
