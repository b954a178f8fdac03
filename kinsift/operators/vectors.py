"""Vectors as words: nearest centres, several probes, neighbours within a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, v: t + v)


def probes(vectors: DataFrame, centres: DataFrame, most: int = 3, ratio: float = 1.3, digits: int = 6) -> DataFrame:
    """(item, word, d2, path): up to `most` centres within ratio times the nearest one's squared distance, nearest first.

    vectors and centres are (item, v) and (word, v); the centres are a vocabulary, collected in one row
    that goes to each task, so that a vector's words are found where it lies, without a join on it.
    """
    book = centres.agg(F.sort_array(F.collect_list(F.struct("word", "v"))).alias("book"))
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *centres.schema.fields]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if words is None:
                words = batch.column("book")[0].values
                if words is None or not len(words):
                    return
                marks = np.array(words.field("v").to_pylist(), np.float64)
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                part = part.filter(pa.array([v is not None and len(v) == marks.shape[1] and None not in v for v in part.column("v").to_pylist()], pa.bool_()))
                if not part.num_rows:
                    continue
                v = np.array(part.column("v").to_pylist(), np.float64)
                d2 = np.zeros((len(v), len(marks)))
                # number by number, so that sums round as they do row by row
                for j in range(marks.shape[1]):
                    step = v[:, j, None] - marks[None, :, j]
                    d2 += step * step
                # the nearest with a margin: which of them count is said on rounded distances
                bar = np.partition(d2, min(most, len(marks)) - 1, axis=1)[:, min(most, len(marks)) - 1]
                row, column = np.nonzero(d2 <= bar[:, None] + 10.0**-digits)
                near = pa.StructArray.from_arrays([pa.array(d2[row, column]), words.field("word").take(pa.array(column))], ["d2", "word"])
                cuts = np.searchsorted(row, np.arange(len(v) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.ListArray.from_arrays(pa.array(cuts), near)], ["item", "near"])

    # the vocabulary goes along with the first row of each partition's batches only
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = vectors.select("item", "v").withColumn("_first", first).join(F.broadcast(book)).select("item", "v", F.when(F.col("_first"), F.col("book")).alias("book"))
    near = rows.mapInArrow(run, f"item {kinds['item']}, near array<struct<d2: double, word: {kinds['word']}>>")
    rounded = F.transform("near", lambda c: F.struct(F.round(c["d2"], digits).alias("d2"), c["word"].alias("word")))
    rows = near.select("item", F.slice(F.array_sort(rounded), 1, most).alias("near")).select("item", F.filter("near", lambda c: c["d2"] <= F.col("near")[0]["d2"] * ratio).alias("near"))
    return rows.select("item", F.posexplode("near").alias("path", "c")).select("item", F.col("c.word").alias("word"), F.col("c.d2").alias("d2"), "path")


def nearest_in_word(vectors: DataFrame, words: DataFrame, digits: int = 6) -> DataFrame:
    """(item, word, nearest, d2): the nearest other item of the same word; no ratio test."""
    placed = vectors.join(words.select("item", "word"), "item")
    other = placed.select(F.col("item").alias("other"), F.col("v").alias("w"), "word")
    pairs = placed.join(other, "word").filter("item <> other").select("word", "item", "other", F.round(squared_distance(F.col("v"), F.col("w")), digits).alias("d2"))
    best = pairs.groupBy("item", "word").agg(F.min(F.struct("d2", "other")).alias("best"))
    return best.select("item", "word", F.col("best.other").alias("nearest"), F.col("best.d2").alias("d2"))


def band_matches(left: DataFrame, right: DataFrame, tolerance: float, digits: int = 6) -> DataFrame:
    """(a, b, d2): for each point of left (a, x, y) the nearest of right (b, x, y) within the tolerance.

    Points meet by the cells of a grid as wide as the tolerance: a point is sent to the nine cells around
    it, so the join is by equality.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("bigint")
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    l = left.select("a", F.col("x").alias("xa"), F.col("y").alias("ya"), cell("x").alias("cx"), cell("y").alias("cy"))  # noqa: E741
    r = right.select("b", F.col("x").alias("xb"), F.col("y").alias("yb"), F.explode(F.transform(around, lambda i: cell("x") + i)).alias("cx"), cell("y").alias("_cy"))
    r = r.select("b", "xb", "yb", "cx", F.explode(F.transform(around, lambda i: F.col("_cy") + i)).alias("cy"))
    d2 = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))
    met = l.join(r, ["cx", "cy"]).withColumn("d2", F.round(d2, digits)).filter(d2 <= tolerance * tolerance)
    best = met.groupBy("a").agg(F.min(F.struct("d2", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"), F.col("best.d2").alias("d2"))
