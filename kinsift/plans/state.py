"""What is kept between runs: analyses by content, the files they were read from, whole results by fingerprint."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT = 1
GRACE_DAYS = 30


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what insert-or-replace leaves."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def known_files(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files with the hash kept for them, if path, length and time are still the same; the others have none and need a read."""
    return files.join(kept.select("path", "length", "modified", "hash"), ["path", "length", "modified"], "left")


def cached(wanted: DataFrame, analyses: DataFrame, version: str, work: int) -> DataFrame:
    """Kept analyses of wanted hashes; analyses is partitioned by version and work, so others are not read."""
    return analyses.filter((F.col("version") == version) & (F.col("work") == work)).join(wanted.select("hash").distinct(), "hash", "left_semi")


def write_analyses(analyses: DataFrame, path: str) -> None:
    analyses.write.mode("append").partitionBy("version", "work").parquet(path)


def settle_files(kept: DataFrame, seen: DataFrame, today: int, grace: int = GRACE_DAYS, complete: bool = True) -> DataFrame:
    """Kept files after a run: those not seen are marked gone as of today and dropped after the grace; a walk that was not complete marks none."""
    met = kept.join(seen.select("path", F.lit(True).alias("_seen")), "path", "left")
    gone = F.when(F.col("_seen"), None).when(F.lit(complete), F.coalesce("gone", F.lit(today))).otherwise(F.col("gone"))
    return met.withColumn("gone", gone).drop("_seen").filter(F.col("gone").isNull() | (F.lit(today) - F.col("gone") <= grace))


def prune_analyses(analyses: DataFrame, files: DataFrame, version: str, today: int, grace: int = GRACE_DAYS) -> DataFrame:
    """Analyses that a file still needs, of this version or used within the grace."""
    needed = analyses.join(files.select("hash").distinct(), "hash", "left_semi")
    return needed.filter((F.col("version") == version) | (F.col("used") > today - grace))


def compact(analyses: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Rewrites analyses into few files, beside the old ones."""
    analyses.repartition("version", "work").write.option("maxRecordsPerFile", rows_per_file).partitionBy("version", "work").parquet(path)


def keep_result(path: str, tables: dict[str, DataFrame], head: dict) -> None:
    """Saves a finished run: its tables, then its head, without which it does not count."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"format": FORMAT} | head),)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def kept_result(spark: SparkSession, path: str, names: tuple[str, ...]) -> tuple[dict[str, DataFrame], dict]:
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    if head["format"] != FORMAT:
        raise ValueError(f"kept by format {head['format']}, this is {FORMAT}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, head


def with_colour(analyses: DataFrame, measured: DataFrame) -> DataFrame:
    """Analyses with a colour that was measured late (hash, colour) in every record of that content that has none yet."""
    late = measured.groupBy("hash").agg(F.first("colour", ignorenulls=True).alias("_late"))
    met = analyses.join(late, "hash", "left")
    return met.select(*[F.coalesce("colour", "_late").alias("colour") if c == "colour" else F.col(c) for c in analyses.columns])
