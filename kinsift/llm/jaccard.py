"""N-gram Jaccard join with adaptive multi-match prefixes.

1. Documents with the same shingle set are one class; classes, not copies, are joined.
2. Each partition deals its classes to flushes of bounded size. A flush sends its shingles, sorted and
   delta-coded, to the owners of their ranges; owners count in how many classes a shingle is and answer each
   flush with those in two or more. What is frequent already within a flush it doesn't send: that counts as
   the most frequent of all, everywhere, so no owner holds all classes of a common shingle. A class whose
   shared shingles are too few for any link drops out here.
3. A class's shared shingles are ordered from rare to frequent. Level l's prefix is as long as it must be for
   two linked classes to share l shingles of it. Each class takes the level that its estimated candidates,
   the frequencies of its prefix shingles, ask for.
4. Seeds: classes with equal smallest, largest or smallest rehashed shingle meet in blocks of bounded size,
   each with its group's most central class, and are compared exactly; what is linked there is one
   component. This only spares work in the join.
5. The join: classes of different components meet at each prefix shingle that they share, if their sizes and
   the shingle's places leave room for a link. A pair is counted at the lower of the two levels, becomes a
   candidate with as many shared prefix shingles as that level says, and is then compared exactly. Lists of
   frequent prefix shingles are split into salted blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import free_name, give_back, join_by_hot_key, materialize, sized_join, small_batches, unique_columns
from kinsift.llm.shingles import batch_sets, mixed, name_bytes, set_name
from kinsift.operators.components import connected_components

OWNER_SHINGLES = 1_500_000
FLUSH_SHINGLES = 1_000_000
#: Classes of a flush with a shingle from which on it is frequent.
FREQUENT = 64
#: The rank of frequent shingles; all others have lower ones.
MOST = 255
#: Hashes have so many bits more than the number of all shingles: a pair of classes with 1,000 shingles each
#: is then miscounted with odds of one in 16 times that number, at most.
SPARE_BITS = 24
#: Seeds are compared, and lists of the join met, in blocks of at most so many classes, and shingles.
BLOCK_CLASSES = 2048
BLOCK_SHINGLES = 1_500_000
LIST_CLASSES = 4096
LEVELS = (1, 2, 4, 8)


def least_overlap(n, percent: int):
    """Shingles that a set of n must share with another for a similarity of percent."""
    return -(-n * percent // 100)


def _sizes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), name_bytes(set_name(s))) for s in batch_sets(batch.column(1), words)]
            n, names = ([x[i] for x in sets] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary())], ["id", "n", "class"])
        give_back()

    return run


def _planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit integers, the lowest of all first: the high ones of small numbers are runs of zeros."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


#: A flush's tokens for an owner with the places of their classes; or, with names and sizes, what a flush keeps for itself: its frequent tokens.
MESSAGE = "owner int, flush bigint, tokens binary, refs binary, frequent binary, names binary, sizes binary, sent int"
_MESSAGE_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int32()]
_MESSAGE_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]


def _refs(values: np.ndarray, n: int) -> bytes:
    return values.astype(np.uint16 if n <= 65536 else np.uint32).tobytes()


def _from_refs(data: bytes, tokens: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * tokens else np.uint32)


def _flush(names: list[tuple[int, int]], sets: list[np.ndarray], bits: int, starts: np.ndarray, number: int) -> pa.RecordBatch:
    sizes, names = np.array([len(s) for s in sets], np.int32), np.array(names, np.uint64).reshape(-1, 2)
    # named by its number and by what it holds: a rerun that deals rows otherwise makes other flushes
    held = mixed(names[:, 0] ^ mixed(names[:, 1])).sum(dtype=np.uint64)
    flush = int(mixed(np.array([held], np.uint64) + np.uint64(number) * np.uint64(0x9E3779B97F4A7C15))[0].view(np.int64))
    tokens, refs = np.concatenate(sets) >> np.uint64(64 - bits), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
    order = np.argsort(tokens)
    tokens, refs = tokens[order], refs[order]
    edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    times = np.diff(np.append(edge, len(tokens)))
    often, frequent = np.repeat(times >= FREQUENT, times), tokens[edge[times >= FREQUENT]]
    own_tokens, own_refs = tokens[often], refs[often]
    tokens, refs = tokens[~often], refs[~often]
    cuts, hot = (np.append(np.searchsorted(x, starts), len(x)).tolist() for x in (tokens, frequent))
    rows = []
    for j, start in enumerate(starts):
        part, own = tokens[cuts[j] : cuts[j + 1]], refs[cuts[j] : cuts[j + 1]]
        if len(part) or hot[j] < hot[j + 1]:
            rows.append((j, flush, _planes(np.diff(part, prepend=start)), _refs(own, len(sets)), frequent[hot[j] : hot[j + 1]].tobytes(), None, None, None))
    rows.append((flush % len(starts), flush, _planes(own_tokens), _refs(own_refs, len(sets)), None, names.tobytes(), sizes.tobytes(), len(rows)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MESSAGE_TYPES, strict=True)], _MESSAGE_NAMES)


def _send(words: int, owners: int, bits: int):
    starts = np.array([(j << bits) // owners for j in range(owners)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names, sets, held = [], [], 0
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for s in batch_sets(batch.column(0), words):
                if not len(s) or (name := set_name(s)) in seen:  # a partition sends a class once
                    continue
                seen.add(name)
                names.append(name)
                sets.append(s)
                held += len(s)
                if held >= FLUSH_SHINGLES:
                    yield _flush(names, sets, bits, starts, number)
                    names, sets, held, number = [], [], 0, number + 1
        if sets:
            yield _flush(names, sets, bits, starts, number)
        del names, sets
        give_back()

    return run


#: An owner's answer to a flush: its tokens in two classes or more with their ranks; or what the flush keeps, passed on.
SHARED = "flush bigint, tokens binary, refs binary, ranks binary, names binary, sizes binary, sent int"
_SHARED_TYPES = [pa.int64(), *[pa.binary()] * 5, pa.int32()]


def _ranks(df: np.ndarray) -> np.ndarray:
    """Numbers of classes as bytes that rise with them, below MOST."""
    return np.where(df < 128, df, np.minimum(MOST - 1, 128 + 4 * np.log2(np.maximum(df, 128) / 128))).astype(np.uint8)


def _count(messages: pa.Table) -> pa.Table:
    """Of one owner: the answers to all its messages."""
    out, tokens, refs, frequent, flushes = [], [np.zeros(0, np.uint64)], [], [np.zeros(0, np.uint64)], []
    for i in range(len(messages)):
        m = {name: messages.column(name)[i].as_py() for name in _MESSAGE_NAMES}
        own = _from_planes(m["tokens"])
        if m["names"] is not None:
            out.append((m["flush"], m["tokens"], m["refs"], np.full(len(own), MOST, np.uint8).tobytes(), m["names"], m["sizes"], m["sent"]))
            continue
        tokens.append(np.cumsum(own, dtype=np.uint64))
        refs.append(_from_refs(m["refs"], len(own)))
        frequent.append(np.frombuffer(m["frequent"], np.uint64))
        flushes.append(m["flush"])
    cuts = np.cumsum([len(x) for x in tokens])
    token = np.concatenate(tokens)
    del tokens
    order = np.argsort(token)
    in_order = token[order]
    edge = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]])) if len(token) else np.zeros(0, np.int64)
    times = np.diff(np.append(edge, len(token)))
    ranks = _ranks(times)
    ranks[np.isin(in_order[edge], np.unique(np.concatenate(frequent)))] = MOST
    rank = np.empty(len(token), np.uint8)
    rank[order] = np.repeat(ranks, times)
    del order, in_order
    for flush, own, a, b in zip(flushes, refs, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        shared = rank[a:b] > 1
        out.append((flush, _planes(token[a:b][shared]), own[shared].tobytes(), rank[a:b][shared].tobytes(), None, None, None))
    answer = pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SHARED_TYPES, strict=True)], names=[x.split()[0] for x in SHARED.split(", ")])
    del token, rank, out, refs
    give_back()
    return answer


#: low, high, other: the smallest and largest token, and the smallest after another hash; central: how frequent the tokens are.
SUSPECT = "class binary, n int, m int, tokens binary, prefix int, level int, low bigint, high bigint, other bigint, central float"


def level_of(cost: int, need: int) -> int:
    """The level of a class that has to expect so many candidates at level 1."""
    level = 1
    for step in LEVELS[1:]:
        if cost > 4 * step * step and step <= need:
            level = step
    return level


def _suspects(percent: int):
    def run(parts: pa.Table) -> pa.Table:
        """Of one flush: the classes that can have a link, with their shared tokens from rare to frequent."""
        rows = parts.to_pylist()
        kept = [r for r in rows if r["names"] is not None]
        if len(kept) != 1 or kept[0]["sent"] != len(rows) - 1:
            raise RuntimeError("a flush's answers are not complete: the documents were not the same when they were read again")
        names, sizes = np.frombuffer(kept[0]["names"], np.uint64).reshape(-1, 2), np.frombuffer(kept[0]["sizes"], np.int32)
        lists = [_from_planes(r["tokens"]) for r in rows]
        token, rank = np.concatenate(lists), np.concatenate([np.frombuffer(r["ranks"], np.uint8) for r in rows])
        ref = np.concatenate([_from_refs(r["refs"], len(x)).astype(np.uint32) for r, x in zip(rows, lists, strict=True)])
        del rows, lists
        need = least_overlap(sizes.astype(np.int64), percent)
        able = np.bincount(ref, minlength=len(sizes)) >= need
        use = able[ref]
        token, rank, ref = token[use], rank[use], ref[use]
        order = np.lexsort((token, rank, ref))
        token, rank, ref = token[order], rank[order], ref[order]
        cuts = np.searchsorted(ref, np.arange(len(sizes) + 1)).tolist()
        out: list[list] = [[] for _ in SUSPECT.split(", ")]
        for i in np.flatnonzero(able & (sizes > 0)).tolist():
            own, ranks = token[cuts[i] : cuts[i + 1]], rank[cuts[i] : cuts[i + 1]].astype(np.int64)
            # tokens of no other class come first in the order and need not be sent
            prefix = len(own) - int(need[i]) + 1
            keys = (int(np.array(x, np.uint64).view(np.int64)) for x in (own.min(), own.max(), (own * np.uint64(0x9E3779B97F4A7C15)).min()))
            row = (name_bytes((int(names[i, 0]), int(names[i, 1]))), int(sizes[i]), len(own), own.tobytes(), prefix, level_of(int((ranks[:prefix] - 1).sum()), int(need[i])), *keys, float(ranks.mean()))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "float": pa.float32()}
        return pa.table([pa.array(c, types[x.split()[1]]) for c, x in zip(out, SUSPECT.split(", "), strict=True)], names=[x.split()[0] for x in SUSPECT.split(", ")])

    return run


class _Flat:
    """Lists of small integers, one after another."""

    def __init__(self, lists: list[np.ndarray]):
        lengths = np.array([len(x) for x in lists])
        self.values, self.ends = np.concatenate([*lists, np.zeros(1, np.int64)]), np.cumsum(lengths)
        self.starts, self.empty = self.ends - lengths, lengths == 0

    def of(self, i: int) -> np.ndarray:
        return self.values[self.starts[i] : self.ends[i]]

    def counts(self, marks: np.ndarray) -> np.ndarray:
        """For each list the number of its members that are marked."""
        # the closing zero is a list of its own, which is left out again
        sums = np.add.reduceat(marks[self.values], np.append(self.starts, len(self.values) - 1), dtype=np.int64)[:-1]
        sums[self.empty] = 0
        return sums


def link_block(n: np.ndarray, tokens: list[np.ndarray], percent: int) -> np.ndarray:
    """The components of a block of classes, each named by the place of its first one; pairs already connected are not compared."""
    root = np.arange(len(n))
    if len(n) == 2:
        both = len(np.intersect1d(tokens[0], tokens[1], assume_unique=True))
        root[1] = 0 if 100 * both >= percent * (n[0] + n[1] - both) else 1
        return root
    _, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    cuts = np.cumsum([0, *(len(t) for t in tokens)])
    whole, marks = _Flat([ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]), np.zeros(int(ids.max()) + 1, np.uint8)
    later = np.arange(len(n))
    for i in range(len(n)):
        may = (later > i) & (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if not may.any():
            continue
        marks[whole.of(i)] = 1
        if may.sum() * 8 > len(n):
            both = whole.counts(marks)
        else:
            both = np.zeros(len(n), np.int64)
            for j in np.flatnonzero(may):
                both[j] = marks[whole.of(j)].sum(dtype=np.int64)
        marks[whole.of(i)] = 0
        linked = may & (100 * both >= percent * (n + n[i] - both))
        if linked.any():
            met = np.unique(root[np.append(np.flatnonzero(linked), i)])
            root[np.isin(root, met)] = met[0]
    return root


def _seed_links(percent: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.lexsort((part.column("no").to_numpy(), part.column("key").to_numpy(), part.column("side").to_numpy()))))
        side, key, no = (part.column(c).to_numpy() for c in ("side", "key", "no"))
        n = part.column("n").to_numpy().astype(np.int64)
        tokens = [np.frombuffer(t, np.uint64) for t in part.column("tokens").to_pylist()]
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1]), [True]]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                root = link_block(n[a:b], tokens[a:b], percent)
                linked = np.flatnonzero(root != np.arange(b - a))
                left.append(no[a:b][root[linked]])
                right.append(no[a:b][linked])
        return pa.table({"a": pa.array(np.concatenate(left)), "b": pa.array(np.concatenate(right))})

    return run


def _seeds(suspects: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes that meet at a seed key, as stars."""
    least = int(suspects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("key")) for i, c in enumerate(("low", "high", "other"))))).alias("k")
    sizes = suspects.select(keys, "no", "n", "central").groupBy("k.side", "k.key").agg(
        F.count(F.lit(1)).alias("members"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("pieces"), F.max(F.struct("central", "no"))["no"].alias("hub")
    )
    groups = materialize(sizes.filter("members > 1").select("side", "key", "pieces", "hub"), "seed_sizes")
    large = materialize(groups.filter("pieces > 1"), "large_seeds")
    rows = suspects.select("no", "n", "tokens", keys).select("no", "n", "tokens", "k.side", "k.key")
    met = sized_join(rows, large, ["side", "key"], "left")
    # small groups share tasks; of a large one each block is a task
    task = F.when(F.col("pieces").isNull(), F.pmod(F.hash("key"), F.lit(4 * least)).cast("bigint")).otherwise(F.col("key")).alias("task")
    block = F.when(F.col("pieces").isNull(), -1).otherwise(F.pmod(F.xxhash64("no", "side"), F.col("pieces"))).cast("int").alias("block")
    dealt = met.select(task, block, "side", "key", "no", "n", "tokens")
    # a large group's most central class is in each of its blocks
    hubs = sized_join(suspects.select("no", "n", "tokens"), large.withColumnRenamed("hub", "no"), "no", "inner")
    hubs = hubs.select(F.col("key").alias("task"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("block"), "side", "key", "no", "n", "tokens")
    return dealt.unionByName(hubs).groupBy("task", "block").applyInArrow(_seed_links(percent), "a bigint, b bigint").distinct()


ENTRY = "token bigint, no bigint, n int, m int, component bigint, level int, place int"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix tokens of classes at their levels, with their places in the order."""
    for batch in batches:
        lists = [np.frombuffer(t, np.int64) for t in batch.column("tokens").to_pylist()]
        if not lists:
            continue
        lengths = np.array([len(x) for x in lists])
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        columns = [pa.array(np.repeat(batch.column(c).to_numpy(), lengths)) for c in ("no", "n", "m", "component", "level")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), *columns, pa.array(place.astype(np.int32))], [x.split()[0] for x in ENTRY.split(", ")])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("tokens_a", "tokens_b", "n_a", "n_b")), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                linked.append(100 * both >= percent * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def candidate_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes of different components that share as many prefix tokens as the lower of their levels says.

    The tokens that two classes share come before their first meeting, at it, or after it in both: where that
    leaves too few for a link of their sizes the meeting doesn't count. A list is split into blocks of
    LIST_CLASSES: one side is dealt to them, the other is sent to each.
    """
    lists = entries.groupBy("token").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("held")).filter("first < last")
    lists = materialize(lists.select("token", "held"), "lists")
    met = materialize(join_by_hot_key(entries, lists, "token", "held", max(1, entries.count())).filter("held is not null"), "met")
    blocks = F.ceil(F.col("held") / LIST_CLASSES).cast("int")
    columns = [x.split()[0] for x in ENTRY.split(", ")][1:]
    left = met.select("token", F.pmod(F.xxhash64("no"), blocks).cast("int").alias("block"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = met.select("token", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *(F.col(c).alias(f"{c}_b") for c in columns))
    # what a link of two sizes has to share is mostly more than what either size asks for, and shortens both prefixes
    shared = F.floor(((F.col("n_a") + F.col("n_b")).cast("bigint") * percent + 99 + percent) / (100 + percent)).cast("int")
    pairs = left.join(right, ["token", "block"]).filter("no_a < no_b and component_a <> component_b")
    pairs = pairs.filter(F.least("place_a", "place_b") + F.least(F.col("m_a") - F.col("place_a"), F.col("m_b") - F.col("place_b")) >= shared)
    pairs = pairs.withColumn("level", F.least("level_a", "level_b")).filter((F.col("place_a") < F.col("m_a") - shared + F.col("level")) & (F.col("place_b") < F.col("m_b") - shared + F.col("level")))
    counted = pairs.groupBy(F.col("no_a").alias("a"), F.col("no_b").alias("b"), "level").agg(F.count(F.lit(1)).alias("shared"))
    return counted.filter("shared >= level").select("a", "b")


def _links(suspects: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all classes with a link: the seeds' links, and those of the join."""
    seeds = materialize(_seeds(suspects, percent), "seeds")
    known = materialize(connected_components(seeds).withColumnRenamed("node", "no"), "seeded")
    head = F.expr("substring(tokens, 1, 8 * (prefix + level - 1))").alias("tokens")
    labelled = suspects.select("no", "n", "m", head, "prefix", "level").join(known, "no", "left").withColumn("component", F.coalesce("component", "no"))
    entries = materialize(labelled.mapInArrow(_entries, ENTRY), "entries")
    pairs = materialize(candidate_pairs(entries, percent), "candidates")
    sides = [suspects.select(F.col("no").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}")) for s in "ab"]
    found = materialize(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_verify(percent), "a bigint, b bigint"), "links")
    if not found.limit(1).count():
        return known
    return connected_components(known.select(F.col("component").alias("a"), F.col("no").alias("b")).unionByName(found)).withColumnRenamed("node", "no")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct shingles of
    `words` words, A-Z lowered. A text of fewer words has one shingle, its whole sequence; a null, empty or
    blank text has none and links with nothing. Rows that repeat a text link with each other. Null ids are
    above all others. Extra columns play no part; an empty table gives no rows. Sets are told apart by
    128-bit names, the shingles of a pair by hashes of SPARE_BITS more bits than all shingles need, 64 at most.
    """
    return _components(docs, id_col, text_col, words, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row a document: id, n, component_id, class, keeper (the class of the component's row with the smallest id); no class without words."""
    small_batches(docs)
    source = unique_columns(docs, [id_col, text_col]).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    narrow = materialize(source.mapInArrow(_sizes(words), f"id {id_type}, n bigint, class binary"), "sizes")
    total, shingles = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = max(least, -(-shingles // OWNER_SHINGLES))
    bits = min(64, max(1, shingles).bit_length() + SPARE_BITS)
    classes = materialize(narrow.filter("n > 0").groupBy("class").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")), "classes")
    # copies of a class need not be sent; those with the same id or none are, which does no harm
    copies = join_by_hot_key(narrow.filter("n > 0 and id is not null"), classes.filter("members > 1"), "class", "members", max(1, total)).filter("id <> first").select(F.col("id").alias("copy"))
    sent = sized_join(source, materialize(copies, "copies"), F.col("id") == F.col("copy"), "left_anti").select("text")
    shared = sent.mapInArrow(_send(words, owners, bits), MESSAGE).groupBy("owner").applyInArrow(_count, SHARED)
    suspects = shared.groupBy("flush").applyInArrow(_suspects(percent), SUSPECT)
    suspects = materialize(suspects.withColumn("no", F.monotonically_increasing_id()), "suspects")
    roots = materialize(_links(suspects, percent).join(suspects.select("no", "class"), "no").select("class", "component").distinct(), "roots")
    joined = roots.join(classes, "class")
    least_row = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "class"))
    smallest = joined.groupBy("component").agg(least_row.alias("s")).select("component", F.col("s.first").alias("smallest"), F.col("s.class").alias("keeper"))
    joined = materialize(sized_join(joined.select("class", "component"), materialize(smallest, "smallest"), "component", "inner").select("class", "smallest", "keeper"), "linked")
    classes = sized_join(classes, joined, "class", "left").select("class", "members", F.coalesce("smallest", "first").alias("component_id"), F.coalesce("keeper", "class").alias("keeper"))
    worded = narrow.filter("n > 0")
    found = join_by_hot_key(worded, materialize(classes, "named"), "class", "members", max(1, total)).select("id", "n", "component_id", "class", "keeper")
    wordless = narrow.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("class"), F.lit(None).cast("binary").alias("keeper"))
    return found.unionByName(wordless)


def _with_class(docs: DataFrame, text_col: str, words: int, name: str) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [name_bytes(set_name(s)) if len(s) else None for s in batch_sets(batch.column(names.index(text_col)), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.binary())], [*names, name])
        give_back()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{types}, {name} binary")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, a row with its smallest id, with all its columns; all documents without words stay."""
    result = materialize(_components(docs, id_col, text_col, words, percent), "near").select(F.col("id").alias("_id"), "class", "component_id", "keeper")
    kept = F.col("class").isNull() | ((F.col("class") == F.col("keeper")) & F.col("_id").eqNullSafe(F.col("component_id")))
    # ids of several rows, null among them: their rows are told apart by their classes
    ids = result.groupBy("_id").agg((F.count(F.lit(1)) > 1).alias("again"), F.max(~kept).alias("goes")).filter("again or goes")
    ids = materialize(ids, "gone")
    rest = sized_join(docs, ids, docs[id_col].eqNullSafe(ids["_id"]), "left_anti")
    again = materialize(ids.filter("again").select("_id"), "again")
    if not again.limit(1).count():
        return rest
    name = free_name(docs, "_class")
    repeated = materialize(_with_class(sized_join(docs, again, docs[id_col].eqNullSafe(again["_id"]), "left_semi"), text_col, words, name), "repeated")
    stay = materialize(result.filter(kept & F.col("class").isNotNull()).join(again.withColumnRenamed("_id", "_a"), F.col("_id").eqNullSafe(F.col("_a")), "left_semi").select("_id", "class").distinct(), "stay")
    worded = repeated.filter(F.col(name).isNotNull()).dropDuplicates([id_col, name])
    worded = sized_join(worded, stay, worded[id_col].eqNullSafe(stay["_id"]) & (worded[name] == stay["class"]), "left_semi")
    return rest.unionByName(worded.unionByName(repeated.filter(F.col(name).isNull())).drop(name))
