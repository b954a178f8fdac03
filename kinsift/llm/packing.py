"""Vector bin packing of examples into token sequences.

Each example has three demands: tokens, segments (one a piece) and loss-bearing tokens. A sequence has a
limit on each. Sequences are filled one at a time: of the pool's examples that fit, the one whose demands
have the largest dot product with what the sequence has left goes in, and the pool is filled up again; when
none fits and cutting is allowed, the piece that fills the sequence is cut off the largest example.

Every partition packs its own examples in one pass, from a pool of bounded size, so documents are not
shuffled and the number of sequences that can't be filled is one a partition at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinsift.llm.common import give_back, small_batches, unique_columns
from kinsift.llm.tokens import byte_bpe


@dataclass(frozen=True)
class Limits:
    """Of a sequence; the defaults for segments and loss never bind, as a piece has a token and a token one loss at most."""

    tokens: int = 2048
    segments: int = 2048
    loss: int = 2048


@dataclass
class Piece:
    """A run of an example's tokens; loss_before[i] counts its loss-bearing tokens before token i."""

    example: int
    start: int
    length: int
    loss_before: np.ndarray

    @property
    def loss(self) -> int:
        return int(self.loss_before[self.start + self.length] - self.loss_before[self.start])

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.example, self.start, length, self.loss_before), Piece(self.example, self.start + length, self.length - length, self.loss_before)


class Pool:
    """Pieces that wait for a sequence, with their demands as rows of an array."""

    def __init__(self) -> None:
        self.pieces: list[Piece] = []
        self.demands = np.zeros((64, 3))

    def add(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == len(self.demands):
            self.demands = np.concatenate([self.demands, np.zeros_like(self.demands)])
        self.demands[n] = piece.length, 1, piece.loss
        self.pieces.append(piece)

    def take(self, i: int) -> Piece:
        piece, last = self.pieces[i], len(self.pieces) - 1
        self.pieces[i], self.demands[i] = self.pieces[last], self.demands[last]
        self.pieces.pop()
        return piece


def fill_sequence(pool: Pool, limits: Limits, cutting: bool, refill: Callable[[], None] = lambda: None) -> list[Piece]:
    """The pieces of the next sequence; at least one, if the pool has any and each fits an empty sequence."""
    most = np.array([limits.tokens, limits.segments, limits.loss], float)
    left, filled = most.copy(), []
    while pool.pieces and left[0] > 0 and left[1] > 0:
        demands = pool.demands[: len(pool.pieces)]
        fits = (demands <= left).all(axis=1)
        if fits.any():
            score = np.where(fits, (demands / most) @ (left / most), -1.0)
            piece = pool.take(int(score.argmax()))
        elif cutting:
            piece = pool.take(int(demands[:, 0].argmax()))
            low = int(np.searchsorted(piece.loss_before, piece.loss_before[piece.start] + left[2], side="right")) - 1 - piece.start
            length = min(int(left[0]), low, piece.length)
            if length <= 0:
                pool.add(piece)
                break
            piece, rest = piece.cut(length)
            pool.add(rest)
        else:
            break
        filled.append(piece)
        left -= (piece.length, 1, piece.loss)
        refill()
    return filled


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Cuts what would be one padded sequence into sequences whose lengths are powers of two, which need no padding."""
    total, runs, pieces = sum(p.length for p in pieces), [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        if not room:
            continue
        runs.append([])
        while room:
            piece = pieces.pop()
            if piece.length > room:
                piece, rest = piece.cut(room)
                pieces.append(rest)
            runs[-1].append(piece)
            room -= piece.length
    return runs


Example = tuple[object, np.ndarray, np.ndarray]


def pack_stream(examples: Iterator[Example], limits: Limits, cutting: bool, pool_size: int, first_id: int) -> Iterator[dict]:
    """Rows of pieces for a stream of (key, ids, loss mask)."""
    pool, held, waiting, number, ended = Pool(), {}, {}, 0, False
    sequence, ready = first_id, []

    def put(filled: list[Piece]) -> None:
        nonlocal sequence
        offset = 0
        for p in filled:
            key, ids = held[p.example]
            part = ids[p.start : p.start + p.length]
            ready.append({"key": key, "start": p.start, "length": p.length, "ids_crc32": zlib.crc32(part.astype("<u4").tobytes()), "doc_tokens": len(ids), "loss_tokens": p.loss, "sequence_id": sequence, "offset": offset})
            offset += p.length
            waiting[p.example] -= p.length
            if not waiting[p.example]:
                del held[p.example], waiting[p.example]
        sequence += 1

    def refill() -> None:
        """Fills the pool; what an example has over whole sequences goes into the pool, those are full at once."""
        nonlocal number, ended
        while len(pool.pieces) < pool_size and not ended:
            key, ids, mask = next(examples, (None, None, None))
            if ids is None:
                ended = True
                return
            if not len(ids):
                continue
            if not cutting and (len(ids) > limits.tokens or mask.sum() > limits.loss):
                raise ValueError(f"example {key} has {len(ids)} tokens and can't be cut")
            held[number], waiting[number] = (key, ids), len(ids)
            whole = Piece(number, 0, len(ids), np.concatenate([[0], np.cumsum(mask)]))
            while cutting and whole.length >= limits.tokens:
                head, rest = whole.cut(limits.tokens)
                if head.loss > limits.loss:
                    break
                put([head])
                whole = rest
            if whole.length:
                pool.add(whole)
            number += 1

    refill()
    while pool.pieces:
        filled = fill_sequence(pool, limits, cutting, refill)
        if not pool.pieces and cutting and sum(p.length for p in filled) < limits.tokens:
            for run in powers_of_two(filled):
                put(run)
        else:
            put(filled)
        yield from ready
        ready.clear()
        refill()
    yield from ready


#: Examples that wait for a sequence.
POOL = 512
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"


def _packed(df: DataFrame, keys: list[str], examples: Callable[[Iterator[pa.RecordBatch]], Iterator[Example]], limits: Limits, cutting: bool, pool_size: int) -> DataFrame:
    """Packs the examples that a partition's batches make, each with a tuple of keys. A row a piece comes back.

    sequence_id is unique over the table: the partition's number in the high bits, a counter in the low
    40. A lost task's rerun reads the same partition in the same order and packs it alike.
    """
    types = [to_arrow_type(df.schema[k].dataType) for k in keys]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []

        def batch() -> pa.RecordBatch:
            arrays = [pa.array([r["key"][i] for r in ready], t) for i, t in enumerate(types)] + [pa.array([r[n] for r in ready], pa.int64()) for n in names]
            return pa.RecordBatch.from_arrays(arrays, [*keys, *names])

        for row in pack_stream(examples(batches), limits, cutting, pool_size, TaskContext.get().partitionId() << 40):
            ready.append(row)
            if len(ready) == 5000:
                yield batch()
                ready = []
        yield batch()
        give_back()

    small_batches(df)
    return df.mapInArrow(run, ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), PIECES]))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for first in range(0, batch.num_rows, 100):
            yield batch.slice(first, 100).to_pylist()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), end_id: int = 1, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset.

    A document is its ids and end_id; of its tokens all but the first bear loss. A null or empty text is
    end_id alone. Rows that repeat an id are packed as documents of their own. Documents are cut freely, so
    every sequence is full but for one a partition, which is cut into powers of two; long documents fill
    whole sequences. Extra columns play no part; an empty table gives no rows.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        for rows in _small(batches):
            for row in rows:
                ids = np.append(byte_bpe(paths).ids(row[text_col]), np.uint32(end_id))
                mask = np.ones(len(ids), np.int64)
                mask[0] = 0
                yield (row[id_col],), ids, mask

    return _packed(unique_columns(docs, [id_col, text_col]), [id_col], examples, limits, True, POOL)


def pack_conversations(turns: DataFrame, limits: Limits = Limits(), learn_from: str = "assistant", end_id: int = 1, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Packs instruction data (conv_id, turn, role, text): a row a piece, conv_id, first_turn, then as pack_documents.

    A conversation is one example, cut only where it breaks a sequence's limits by itself or where a partition
    ends; first_turn is the turn in which the example begins, start and doc_tokens are the example's own. Turns are
    in the order of turn, then role and text; null roles and texts count as empty, null ids are one conversation,
    rows that repeat a turn are turns of their own. Only the learn_from role's tokens bear loss. Extra columns play
    no part; an empty table gives no rows. Rows are dealt by ranges of all columns, so a very long conversation
    takes many tasks, and a task holds no more of it than two sequences have.
    """
    rows = unique_columns(turns, ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    order = ["conv_id", "turn", "role", "text"]
    # repeated rows are the same in all columns: a number tells them apart, so that ranges can divide them
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order).drop("row").withColumn("first_turn", F.col("turn"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        key, ids, mask, turns_of = None, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, object)

        def cut() -> int:
            """Tokens of the next example."""
            before = np.concatenate([[0], np.cumsum(mask)])
            return max(1, min(int(np.searchsorted(before, limits.loss, side="right")) - 1, limits.tokens, len(ids)))

        for rows in _small(batches):
            for row in rows:
                if key is not None and key != (row["conv_id"],):
                    while len(ids):
                        n = cut()
                        yield (*key, turns_of[0]), ids[:n], mask[:n]
                        ids, mask, turns_of = ids[n:], mask[n:], turns_of[n:]
                key = (row["conv_id"],)
                part = np.append(byte_bpe(paths).ids(row["role"] + "\n" + row["text"]), np.uint32(end_id))
                ids, mask = np.concatenate([ids, part]), np.concatenate([mask, np.full(len(part), int(row["role"] == learn_from), np.int64)])
                turns_of = np.concatenate([turns_of, np.full(len(part), row["turn"], object)])
                while len(ids) > limits.tokens or mask.sum() > limits.loss:
                    n = cut()
                    yield (*key, turns_of[0]), ids[:n], mask[:n]
                    ids, mask, turns_of = ids[n:], mask[n:], turns_of[n:]
        while len(ids):
            n = cut()
            yield (*key, turns_of[0]), ids[:n], mask[:n]
            ids, mask, turns_of = ids[n:], mask[n:], turns_of[n:]

    return _packed(dealt, ["conv_id", "first_turn"], examples, limits, False, POOL)
