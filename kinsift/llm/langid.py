"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps, in each of its slots, one bit a language: bit l of a slot says that
language l's filter has that slot set. Looking an n-gram up reads a few slots and ands them, which answers
for all languages at once. A document's bits are counted for each language, corrected for the share of
lookups that a filter of that fill answers wrongly, and the language with the largest count is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.llm.common import give_back, materialize, small_batches, text_slices, unique_columns

UNDETERMINED = "und"
GRAMS = (3, 5)
LANGUAGES_A_WORD = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)

#: Bytes as they are hashed: ASCII letters and all bytes of longer characters as they are, the rest a blank.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    bits: int
    hashes: int
    slots: tuple[np.ndarray, ...]
    wrong: tuple[float, ...]


def gram_hashes(text: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-byte windows of an array of bytes."""
    size = len(text) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    codes = np.zeros(size, np.uint64)
    for j in range(n):
        codes <<= np.uint64(8)
        codes |= text[j : j + size]
    codes += np.uint64(n) << np.uint64(56)
    codes *= _MIX
    codes ^= codes >> np.uint64(29)
    codes *= _SPREAD
    return codes


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, each between two blanks, and the new offsets."""
    lengths = np.diff(offsets)
    out = np.full(len(data) + 2 * len(lengths), 32, np.uint8)
    starts = offsets[:-1] + 2 * np.arange(len(lengths))
    out[np.arange(len(data)) + np.repeat(1 + 2 * np.arange(len(lengths)), lengths)] = _LETTERS[data]
    return out, np.append(starts, len(out))


def _slots_of(hashes: np.ndarray, bits: int, count: int) -> Iterator[np.ndarray]:
    for j in range(count):
        yield (hashes >> np.uint64(64 - bits - j * ((64 - bits) // max(1, count)))) & np.uint64((1 << bits) - 1)


def build_filters(grams: dict[str, np.ndarray], hashes: int = 3, slots_a_gram: int = 16) -> Filters:
    languages = tuple(sorted(grams))
    most = max([1, *(len(g) for g in grams.values())])
    bits = max(10, int(np.ceil(np.log2(most * slots_a_gram))))
    words = -(-len(languages) // LANGUAGES_A_WORD)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = [np.zeros(1 << bits, kind) for _ in range(max(1, words))]
    wrong = []
    for i, language in enumerate(languages):
        table, bit = slots[i // LANGUAGES_A_WORD], kind(1 << (i % LANGUAGES_A_WORD))
        for at in _slots_of(grams[language], bits, hashes):
            table[np.unique(at)] |= bit
        wrong.append(float(((table & bit) != 0).mean()) ** hashes)
    return Filters(languages, bits, hashes, tuple(slots), tuple(wrong))


#: Windows of a text that are looked up at a time.
LOOKED_UP = 1 << 18


def _masks(filters: Filters, hashes: np.ndarray) -> Iterator[np.ndarray]:
    """For each word of languages the bits of those that have the n-grams."""
    slots = [s.astype(np.int64) for s in _slots_of(hashes, filters.bits, filters.hashes)]
    for table in filters.slots:
        mask = table[slots[0]]
        for s in slots[1:]:
            mask &= table[s]
        yield mask


def _languages_of(filters: Filters, word: int) -> range:
    return range(word * LANGUAGES_A_WORD, min(len(filters.languages), (word + 1) * LANGUAGES_A_WORD))


def score_texts(filters: Filters, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Corrected counts, a row a text and a column a language. One long text is looked up in pieces, which gives the same."""
    text, at = padded(data, offsets)
    n_texts = len(at) - 1
    hits, looked = np.zeros((n_texts, len(filters.languages))), np.zeros(n_texts)
    for n in GRAMS:
        looked += np.maximum(0, np.diff(at) - n + 1)
        if n_texts == 1:
            for first in range(0, len(text) - n + 1, LOOKED_UP):
                for w, mask in enumerate(_masks(filters, gram_hashes(text[first : first + LOOKED_UP + n - 1], n))):
                    for i in _languages_of(filters, w):
                        hits[0, i] += int(((mask >> mask.dtype.type(i % LANGUAGES_A_WORD)) & mask.dtype.type(1)).sum(dtype=np.int64))
            continue
        hashes = gram_hashes(text, n)
        if not len(hashes):
            continue
        over = (at[1:, None] - np.arange(1, n)).ravel()  # windows that reach into the next text
        over = over[(over >= 0) & (over < len(hashes))]
        starts = np.minimum(at[:-1], len(hashes) - 1)
        for w, mask in enumerate(_masks(filters, hashes)):
            mask[over] = 0
            for i in _languages_of(filters, w):
                bit = (mask >> mask.dtype.type(i % LANGUAGES_A_WORD)) & mask.dtype.type(1)
                hits[:, i] += np.add.reduceat(bit, starts, dtype=np.int64)
    wrong = np.array(filters.wrong)
    return np.maximum(0.0, (hits - looked[:, None] * wrong) / np.maximum(1e-9, 1 - wrong))


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _text_grams(text: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one padded text, of a long one piece by piece."""
    found = np.zeros(0, np.uint64)
    for n in GRAMS:
        for first in range(0, max(1, len(text) - n + 1), LOOKED_UP):
            found = np.union1d(found, gram_hashes(text[first : first + LOOKED_UP + n - 1], n))
    return found


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of the sample: (language, n-gram, texts that have it)."""
    seen: dict[str, list[np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for language, lists in seen.items():
            grams, counts = np.unique(np.concatenate(lists), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "texts"])
        seen.clear()

    held = 0
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for first, data, offsets in text_slices(pc.utf8_lower(batch.column("text")), 512 << 10):
            text, at = padded(data, offsets)
            for i in range(len(at) - 1):
                grams = _text_grams(text[at[i] : at[i + 1]])
                seen.setdefault(languages[first + i], []).append(grams)
                held += len(grams)
                if held > 4_000_000:
                    yield from flush()
                    held = 0
    yield from flush()
    give_back()


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """(id, lang) of the `sample` rows of each language with the smallest hashes of their ids.

    Each language's rows are first thinned to about 4 * sample by a bar for the hash, so none is ranked whole.
    """
    narrow = labelled.select("id", "lang", F.xxhash64("id").alias("draw"))
    counts = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # one row a language
    low = narrow.join(F.broadcast(counts), "lang").filter((F.col("n") <= 4 * sample) | (F.col("draw") / F.lit(2.0**64) + F.lit(0.5) <= F.lit(4.0 * sample) / F.col("n")))
    order = Window.partitionBy("lang").orderBy("draw", "id")
    return low.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample).select("id", "lang").distinct()


def fit_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 500, least: float = 0.01, share: float = 0.2) -> Filters:
    """Fits on the whole texts of at most `sample` labelled ids a language, those with the smallest hashes.

    Rows without a language or text do not count. A language's filter gets the n-grams in at least `least` of its
    texts, if that is at least `share` of the largest such part over all languages: borrowed passages don't make an
    n-gram another language's own. They are counted in Spark; what reaches the driver are the filters' n-grams, of a
    language 1 / least times those of its average text at most.
    """
    labelled = unique_columns(docs, [id_col, text_col, lang_col]).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.filter("lang is not null and text is not null")
    ids = materialize(_sampled(labelled, sample), "sample")
    # at most `sample` ids a language
    chosen = labelled.join(F.broadcast(ids), ["id", "lang"], "left_semi").select("lang", "text")
    counted = chosen.mapInArrow(_gram_counts, "lang string, gram bigint, texts bigint").groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    texts = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("of"))
    rates = counted.join(F.broadcast(texts), "lang").withColumn("rate", F.col("texts") / F.col("of")).select("lang", "gram", "rate")
    tops = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("own"))
    kept = tops.select("gram", "top", F.explode("own").alias("o")).filter((F.col("o.rate") >= least) & (F.col("o.rate") >= F.lit(share) * F.col("top")))
    table = kept.select(F.col("o.lang").alias("lang"), "gram").unionByName(texts.select("lang", F.lit(None).cast("bigint").alias("gram"))).toArrow().combine_chunks()
    languages = np.array(table.column("lang").to_pylist(), object)
    grams = table.column("gram")
    # a language of which no n-gram is kept has an empty filter
    return build_filters({str(x): grams.filter(pa.array(languages == x)).drop_null().to_numpy().view(np.uint64) for x in sorted(set(languages))})


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, and lang_pred and score under the names given (taking the place of columns of these names).

    lang_pred is UNDETERMINED with score 0 where the text is null or has no letter, or no language was
    learned; else a learned language, of equal counts the first by name. score is the language's part of
    all languages' corrected counts, 0 if there are none. Whole texts are read; only they decide.
    """
    small_batches(docs)
    rest = docs.select(*[docs[c] for c in docs.columns if c not in names])
    columns = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(columns.index(text_col))
            column = pc.fill_null(column, "")
            letters = pc.match_substring_regex(column, r"\pL").to_numpy(zero_copy_only=False)
            best, score = np.full(len(column), -1), np.zeros(len(column))
            if filters.languages:
                for first, data, offsets in text_slices(pc.utf8_lower(column), 256 << 10):
                    counts = score_texts(filters, data, offsets)
                    top, total = counts.argmax(axis=1), counts.sum(axis=1)
                    best[first : first + len(top)] = top
                    score[first : first + len(top)] = np.where(total > 0, counts.max(axis=1) / np.maximum(total, 1e-12), 0.0)
            known = letters & (best >= 0)
            said = np.array([*filters.languages, UNDETERMINED], object)[np.where(known, best, -1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0))], [*columns, *names])
        give_back()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{types}, `{names[0]}` string, `{names[1]}` double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """id, held_out, lang_pred, score: learned from the rows that are not held out, predicted for all."""
    filters = fit_filters(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col, **options)
    said = identify(unique_columns(docs, [id_col, text_col]), filters, text_col)
    return said.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
