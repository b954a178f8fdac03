"""Token counts of sections and fields by offset-mapped attribution.

A document is encoded once and whole. The byte lengths of its tokens give their character spans, and the
spans are interval-joined to the spans of its sections, both in order, by binary search. A token that meets
more than one section is allocated whole, by a rule: to the section with most of its characters (of equal
parts the earlier), to the first or to the last that it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import small_batches, unique_columns
from kinsift.llm.tokens import ByteBpe, byte_bpe

RULES = ("most", "first", "last")
OUTSIDE = -1

Spans = tuple[np.ndarray, np.ndarray]


def token_spans(encoder: ByteBpe, text: str) -> Spans:
    """First and past-the-last character of each token; a token of a part of a character spans the whole character."""
    lengths = encoder.byte_lengths[encoder.ids(text)]
    ends = np.cumsum(lengths)
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return ends - lengths, ends
    character = np.cumsum((raw & 0xC0) != 0x80)
    return character[ends - lengths] - 1, character[ends - 1]


def allocate(tokens: Spans, sections: Spans, rule: str = "most") -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens of each section, those of them that cross a boundary, tokens outside all sections); sections are in order and don't overlap."""
    if rule not in RULES:
        raise ValueError(f"rule is {rule}; it can be {RULES}")
    (first, last), (starts, ends) = tokens, sections
    counts, crossing = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    low, high = np.searchsorted(ends, first, side="right"), np.searchsorted(starts, last, side="left")
    met = high - low
    counts += np.bincount(low[met == 1], minlength=len(starts))
    for t in np.flatnonzero(met > 1):
        own = np.arange(low[t], high[t])
        parts = np.minimum(ends[own], last[t]) - np.maximum(starts[own], first[t])
        own = own[parts > 0]
        if not len(own):
            continue
        to = own[0] if rule == "first" else own[-1] if rule == "last" else own[parts[parts > 0].argmax()]
        counts[to] += 1
        crossing[to] += len(own) > 1
    return counts, crossing, int(len(first) - counts.sum())


def line_sections(text: str) -> Spans:
    """Lines, each with its line end."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    ends = np.append(ends, len(text)) if not len(ends) or ends[-1] < len(text) else ends
    return np.append(0, ends[:-1]), ends


def sentence_sections(text: str) -> Spans:
    """Sentences with the blanks after them: they end with blanks that follow . ! or ? or hold a line end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], blank, [False]])))
    first, last = edges[::2], edges[1::2]
    before = points[np.maximum(first - 1, 0)]
    lines = np.concatenate([[0], np.cumsum(points == 10)])
    ends = last[np.isin(before, [ord(c) for c in ".!?"]) | (lines[last] > lines[first])]
    ends = np.append(ends, len(text)) if not len(ends) or ends[-1] < len(text) else ends
    return np.append(0, ends[:-1]), ends


COUNTS = "section int, start bigint, finish bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"


def count_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], Spans] = line_sections, rule: str = "most", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """A row a section: id, section (0, 1, ...), start and finish (characters), n_tokens, n_crossing, doc_tokens.

    The counts of a document's rows sum up to doc_tokens: tokens outside all sections are counted in a row
    of section -1 with null start and finish. A null or empty text is one empty section. Rows that repeat an
    id are documents of their own. Extra columns play no part; an empty table gives no rows.
    """
    small_batches(docs)
    rows = unique_columns(docs, [id_col, text_col]).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(paths)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                repeats, columns = [], [[] for _ in range(6)]
                for text in part.column(1).to_pylist():
                    if not text:
                        values = [np.zeros(1, np.int64)] * 6
                    else:
                        starts, ends = sections(text)
                        spans = token_spans(encoder, text)
                        counts, crossing, outside = allocate(spans, (starts, ends), rule)
                        values = [np.arange(len(starts)), starts, ends, counts, crossing, np.full(len(starts), len(spans[0]))]
                        if outside:
                            values = [np.append(v, x) for v, x in zip(values, (OUTSIDE, OUTSIDE, OUTSIDE, outside, 0, len(spans[0])), strict=True)]
                    repeats.append(len(values[0]))
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
                arrays = [np.concatenate(c) for c in columns]
                gone = arrays[0] == OUTSIDE
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), repeats)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(arrays[0].astype(np.int32)), *(pa.array(a.astype(np.int64), mask=gone) for a in arrays[1:3]), *(pa.array(a.astype(np.int64)) for a in arrays[3:])],
                    ["id", "section", "start", "finish", "n_tokens", "n_crossing", "doc_tokens"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, {COUNTS}").withColumnRenamed("id", id_col)


def count_fields(df: DataFrame, id_col: str, fields: list[str], separator: str = "\n", rule: str = "most", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """A row a field and row of df: as count_sections, of the fields joined by the separator and encoded as one text.

    A null field is empty. The section is the field's number; the separators' own tokens are outside.
    """
    text = F.concat_ws(separator, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    ends = F.array(*[F.length(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    # the lengths go before the text, so that the function that cuts it into sections finds them there
    joined = df.select(F.col(id_col).alias("id"), F.concat(F.concat_ws(",", F.transform(ends, lambda n: n.cast("string"))), F.lit("\x00"), text).alias("text"))
    gap = len(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(paths)
        for batch in batches:
            for row in batch.to_pylist():
                lengths, _, text = row["text"].partition("\x00")
                sizes = np.array([int(n) for n in lengths.split(",")])
                starts = np.cumsum(sizes + gap) - sizes - gap
                spans = token_spans(encoder, text) if text else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                # an empty field has no characters, so nothing can meet it
                counts, crossing, outside = allocate(spans, (starts, starts + sizes), rule)
                rows = [*zip(range(len(sizes)), starts.tolist(), (starts + sizes).tolist(), counts.tolist(), crossing.tolist(), strict=True)]
                rows += [(OUTSIDE, None, None, outside, 0)] if outside else []
                columns = [pa.array([row["id"]] * len(rows), batch.schema.field("id").type), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)), pa.array([len(spans[0])] * len(rows), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "section", "start", "finish", "n_tokens", "n_crossing", "doc_tokens"])

    id_type = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {id_type}, {COUNTS}").withColumnRenamed("id", id_col)
