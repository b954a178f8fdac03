"""Exact dedup by a Golomb-coded fingerprint exchange.

1. The fingerprints of all texts are written once; read again, many of the texts' partitions are one of
   theirs. Each sends its distinct 64-bit fingerprints, sorted and Golomb-Rice coded, to the owners of the
   fingerprint ranges, of which there are as many as the rows need.
2. Owners answer each message with a bitmap: which of its fingerprints another message has too.
3. Only the suspects' texts are shuffled, grouped by their bytes; partial aggregation sends a text
   once from a partition, however many copies that partition has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import blank_run, free_name, join_by_hot_key, materialize, sized_join, unique_columns

RANGE_BITS = 64
OWNER_FINGERPRINTS = 4_000_000


def normalised(text: Column) -> Column:
    return blank_run(F.coalesce(text, F.lit("")))


def golomb_encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Of sorted unsigned integers: (count, remainder bits, unary quotients, packed remainders) of their gaps."""
    n = len(values)
    if not n:
        return 0, 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = max(1.0, float(values[-1]) / n)
    k = max(0, int(np.log2(mean * 0.69 + 1)))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = gaps & np.uint64((1 << k) - 1)
    bits = np.empty((n, k), np.uint8)
    for j in range(k):
        bits[:, j] = (rest >> np.uint64(k - 1 - j)) & np.uint64(1)
    return n, k, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, packed: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    gaps = quotients << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * k).reshape(n, k)
        for j in range(k):
            gaps |= bits[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def _owner_starts(owners: int) -> np.ndarray:
    return np.array([(j << RANGE_BITS) // owners for j in range(owners)], dtype=np.uint64)


def _send(owners: int):
    """Rows with their place in a message, then the messages themselves, from one partition."""
    starts = _owner_starts(owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        fps = table.column("fp").to_numpy().view(np.uint64)
        values, place, times = np.unique(fps, return_inverse=True, return_counts=True)
        owner = np.searchsorted(starts, values, side="right") - 1
        first = np.searchsorted(owner, np.arange(owners))
        last = np.searchsorted(owner, np.arange(owners), side="right")
        n = table.num_rows
        rows = {
            "kind": pa.array(["row"] * n), "id": table.column("id"), "sha": table.column("sha"), "sender": pa.array(np.full(n, sender, np.int32)),
            "owner": pa.array(owner[place].astype(np.int32)), "place": pa.array((place - first[owner[place]]).astype(np.int32)),
            "here": pa.array(times[place].astype(np.int64)), "row_no": pa.array(np.arange(n, dtype=np.int64)),
            "n": pa.nulls(n, pa.int32()), "k": pa.nulls(n, pa.int32()), "unary": pa.nulls(n, pa.binary()), "packed": pa.nulls(n, pa.binary()),
        }
        yield from pa.table(rows).to_batches(max_chunksize=20_000)
        sent = [(j, golomb_encode(values[first[j] : last[j]] - starts[j])) for j in range(owners) if last[j] > first[j]]
        m = len(sent)
        ids = table.schema.field("id").type
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(["message"] * m), "id": pa.nulls(m, ids), "sha": pa.nulls(m, pa.string()), "sender": pa.array([sender] * m, pa.int32()),
            "owner": pa.array([j for j, _ in sent], pa.int32()), "place": pa.nulls(m, pa.int32()), "here": pa.nulls(m, pa.int64()), "row_no": pa.nulls(m, pa.int64()),
            "n": pa.array([x[0] for _, x in sent], pa.int32()), "k": pa.array([x[1] for _, x in sent], pa.int32()),
            "unary": pa.array([x[2] for _, x in sent], pa.binary()), "packed": pa.array([x[3] for _, x in sent], pa.binary()),
        })

    return send


def _answer(messages: pa.Table) -> pa.Table:
    """Of one owner: for each message the bitmap of fingerprints that another message has too."""
    lists = [golomb_decode(m["n"], m["k"], m["unary"], m["packed"]) for m in messages.select(["n", "k", "unary", "packed"]).to_pylist()]
    merged = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
    bitmaps = []
    for values in lists:
        at = np.searchsorted(twice, values)
        bitmaps.append(np.packbits(twice[np.minimum(at, len(twice) - 1)] == values if len(twice) else np.zeros(len(values), bool)).tobytes())
    return pa.table({"sender": messages.column("sender"), "owner": messages.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of blanks became one space. Null texts count
    as empty, and all empty texts are one group. Of equal texts the row with the smallest id stays; a
    null id is above all others; of rows repeated with that id, one stays. Extra columns play no part;
    an empty table gives an empty result.
    """
    source = unique_columns(docs, [id_col, text_col]).select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    id_type = source.schema["id"].dataType.simpleString()
    hashes = materialize(source.select("id", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("fp")), "hashes")
    total = hashes.count()
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_FINGERPRINTS))
    schema = f"kind string, id {id_type}, sha string, sender int, owner int, place int, here bigint, row_no bigint, n int, k int, unary binary, packed binary"
    exchange = materialize(hashes.mapInArrow(_send(owners), schema), "exchange", "kind")
    rows = exchange.filter("kind = 'row'").select("id", "sha", "sender", "owner", "place", "here", "row_no")
    messages = exchange.filter("kind = 'message'").select("sender", "owner", "n", "k", "unary", "packed")
    bitmaps = messages.groupBy("owner").applyInArrow(_answer, "sender int, owner int, bitmap binary")
    bit = F.expr("shiftright(cast(conv(hex(substring(bitmap, (place div 8) + 1, 1)), 16, 10) as int), 7 - place % 8) & 1")
    marked = rows.join(bitmaps, ["sender", "owner"], "left").select("id", "sha", "sender", "row_no", ((F.col("here") > 1) | (F.coalesce(bit, F.lit(0)) == 1)).alias("suspect"))
    marked = materialize(marked, "marked")
    suspects = marked.filter("suspect")
    # texts of suspects, found again by id; a null id finds its text by null-safe equality
    wanted = materialize(suspects.select(F.col("id").alias("_id")).distinct(), "wanted")
    texts = sized_join(source, wanted, source["id"].eqNullSafe(F.col("_id")), "left_semi")
    groups = texts.groupBy(F.sha2("norm", 256).alias("sha"), "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("norm")
    groups = materialize(groups, "groups")
    found = materialize(join_by_hot_key(suspects, groups, "sha", "group_size", max(1, total)), "found")
    # the row that stays, among rows that repeat the smallest id
    first = found.filter(F.col("id").eqNullSafe(F.col("keep_id")))
    stays = materialize(first.groupBy("sha").agg(F.min(F.struct("sender", "row_no")).alias("stay"), F.count(F.lit(1)).alias("rows")), "stays")
    first = join_by_hot_key(first, stays, "sha", "rows", max(1, total)).withColumn("kept", F.struct("sender", "row_no") == F.col("stay"))
    named = ["id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    found = first.select(*named).unionByName(found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False)).select(*named))
    alone = marked.filter("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return found.unionByName(alone).withColumnRenamed("id", id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id and a text one stays. Cases as exact_duplicates says."""
    result = materialize(exact_duplicates(docs, id_col, text_col), "dedup")
    gone = materialize(result.filter("not kept").select(F.col(id_col).alias("_id")).distinct(), "gone")
    # ids with a row that stays beside one that goes
    both = result.filter("kept").join(gone, result[id_col].eqNullSafe(gone["_id"]), "left_semi")
    again = materialize(both.select(F.col(id_col).alias("_id")).distinct(), "again")
    rest = sized_join(docs, gone, docs[id_col].eqNullSafe(gone["_id"]), "left_anti")
    if not again.limit(1).count():
        return rest
    # only the rows of such ids are told apart by their texts
    repeated = sized_join(docs, again, docs[id_col].eqNullSafe(again["_id"]), "left_semi")
    key = F.sha2(normalised(F.col(text_col)), 256)
    sha = free_name(docs, "_sha")
    repeated = repeated.withColumn(sha, key).dropDuplicates([id_col, sha])
    stay = result.filter("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_stay"))
    repeated = repeated.join(stay, repeated[id_col].eqNullSafe(stay["_id"]) & (repeated[sha] == stay["_stay"]), "left_semi").drop(sha)
    return rest.unionByName(repeated)
