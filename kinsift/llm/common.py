"""What the operators share: the cluster's shared folder, cut lineage, joins that mind hot keys, Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, StringType, StructType

from kinsift.plans.lineage import materialize, shared_dir, shared_path  # noqa: F401

#: Tables that hold more than this are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 32 << 20
#: What a row of a broadcast table needs beside its values.
ROW_BYTES = 48


def value_bytes(column: Column, kind: DataType) -> Column:
    """About how many bytes a value holds."""
    if isinstance(kind, StructType):
        return sum((value_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        inner = F.aggregate(column, F.lit(0), lambda t, x: t + value_bytes(x, kind.elementType).cast("int"))
        return F.coalesce(inner, F.lit(0)) + 16
    return F.lit(16 if isinstance(kind, DecimalType) else 8)


def held_bytes(df: DataFrame) -> int:
    """About how many bytes a table needs as a broadcast; it should be materialized, as it is read."""
    row = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def sized_join(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """Joins with a broadcast of the right side only if its measured size allows; beyond that by a shuffle.

    The right side should be materialized: it is measured.
    """
    return left.join(F.broadcast(right) if held_bytes(right) <= BROADCAST_BYTES else right, on, how)


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join of rows with groups, a table of one row a key that knows the number of rows of each key.

    Keys with more than total / parts rows are fewer than parts, so they are broadcast: their rows
    stay where they are. All other keys are small enough for a shuffle. Groups' columns should be narrow: what is
    broadcast is parts rows of them.
    """
    limit = max(1, total // parts)
    columns = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.filter(F.col(weight) > limit).select(key, F.struct(*columns).alias("_hot")))
    rest = groups.filter(F.col(weight) <= limit).select(F.col(key).alias("_cold_key"), F.struct(*columns).alias("_cold"))
    joined = rows.join(hot, key, "left").withColumn(
        # rows of hot keys, and rows without a key, must not meet in one task of the second join
        "_probe", F.when(F.col("_hot").isNull(), F.col(key))
    )
    joined = joined.join(rest, joined["_probe"] == rest["_cold_key"], "left")
    picked = [F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in columns]
    return joined.select(*[F.col(c) for c in rows.columns], *picked)


def unique_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the needed columns, in that order; extra columns, whatever their names, play no part."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[df[c] for c in needed])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, UTF-8 bytes, row offsets), of max_bytes at most unless one text alone is longer.

    Null texts have length 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    _, offsets_buffer, data_buffer = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def small_batches(df: DataFrame) -> None:
    """Has texts go to Python in batches of a few megabytes, whatever the number of rows: very long texts meet in no batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    with contextlib.suppress(Exception):  # a setting of newer versions
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def give_back() -> None:
    """Hands freed memory back to the system: a worker that waits for its next task should hold none of the last one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def blank_run(column: Column) -> Column:
    """Each run of blanks becomes one space; a lone space is not touched, so most texts are only scanned."""
    return F.regexp_replace(column, r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")
