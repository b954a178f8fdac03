"""Pictures read by Spark's image source, as working planes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.operators.kernels import planes
from kinsift.sources.headers import header_facts
from kinsift.sources.listing import EXTENSIONS, accepts, excluded, hidden, list_files, matches_glob, set_aside, sniff

def walked_files(spark: SparkSession, roots: list[str], options) -> DataFrame:
    """(path, length) of the files that a walk of the roots asks: of the wanted extensions, in no folder that is hidden, set aside or excluded; a root itself is never passed over."""
    if options.hidden:
        raise ValueError("Spark's file sources pass over names that begin with a dot: hidden folders can't be asked here")
    files = list_files(spark, roots, recursive=True).select(plain_path(F.col("path")).alias("path"), "length")
    below = F.col("path")
    for root in sorted((re.sub("^file:/+", "/", r).rstrip("/") for r in roots), key=len):
        below = F.when(F.col("path").startswith(root + "/"), F.expr(f"substring(path, {len(root) + 2})")).otherwise(below)
    keep = accepts(F.col("path"), options.extensions or EXTENSIONS) & ~set_aside(below)
    if not options.recursive:
        keep = keep & ~below.contains("/")
    keep = keep & ~hidden(below)
    for pattern in options.exclude:
        # a name is excluded wherever it is met, a path from a root on
        keep = keep & ~(matches_glob(below, pattern) | excluded(F.col("path"), (pattern,)))
    return files.filter(keep)


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


PLANES = "path string, width int, height int, w int, h int, px binary, thumb binary, tw int, th int, grid array<double>, detail array<double>, colour double, state string"


def read_planes(spark: SparkSession, paths: list[str], work: int = planes.WORKING) -> DataFrame:
    """A row a file: its size, working plane, thumbnail, measures and state: whole, or failed where the image source can't decode it."""
    files = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(paths).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if r.width <= 0:
                    rows.append((r.origin, *[None] * 11, "failed"))
                    continue
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                pixels = pixels[..., 0] if r.nChannels == 1 else np.concatenate([pixels[..., 2::-1], pixels[..., 3:]], axis=2)
                grey = planes.grey(pixels)
                plane = planes.fit(grey, work)
                thumb = planes.thumbnail(plane)
                colour = planes.colourfulness(pixels[..., :3] if pixels.ndim == 3 else pixels)
                rows.append((r.origin, r.width, r.height, plane.shape[1], plane.shape[0], np.rint(plane).astype(np.uint8).tobytes(), thumb.tobytes(), thumb.shape[1], thumb.shape[0], planes.cell_means(grey).ravel().tolist(), planes.detail(grey).tolist(), colour, "whole"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLANES.split(", ")])

    return files.mapInPandas(run, PLANES)


def states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, format, state and the facts) from the bytes: formats without a decoder here are refused, and still take part in exact sets."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    told = header_facts(files.withColumn("format", sniff(F.col("content"))), "path")
    state = F.when(F.col("format").isNull(), "not an image").when(F.col("format").isin("jxl", "heif", "webp", "qoi", "exr", "farbfeld", "tga"), "refused").when(F.col("damaged"), "damaged").otherwise("whole")
    return told.withColumn("state", state)
