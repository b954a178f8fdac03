"""Token ids, attribution and packing against the library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinsift.llm.packing import Limits, pack_conversations, pack_documents, pack_stream
from kinsift.llm.token_counts import allocate, count_fields, count_sections, line_sections, sentence_sections, token_spans
from kinsift.llm.tokens import byte_bpe

DOCS = "doc_id long, text string"
TEXTS = ["", "Plain text, it's 12 words.", "two  spaces\n\n\nand\ttabs ", "é ñ ß Ünïcode", "日本語 текст ελληνικά 🙂🙂", "<|endoftext|> is text", " ", "\x1c\x85 x", "a" * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice("ab 1.,'\n\té 語\x1d²½ǅ") for _ in range(200))


@pytest.mark.parametrize("text", TEXTS + [noise(i) for i in range(20)])
def test_ids_are_the_librarys(library, text):
    assert byte_bpe().ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS[1:] + [noise(i) for i in range(5)])
def test_spans_are_the_librarys(library, text):
    first, last = token_spans(byte_bpe(), text)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == library.encode(text, add_special_tokens=False).offsets


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_allocation_equals_brute_force(rule):
    r = random.Random(rule)
    for _ in range(50):
        cuts = sorted(r.sample(range(1, 40), 8))
        tokens = (np.array([0, *cuts]), np.array([*cuts, 40]))
        ends = sorted(r.sample(range(1, 40), 5)) + [40]
        starts = [0, *ends[:-1]]
        counts, crossing, outside = allocate(tokens, (np.array(starts), np.array(ends)), rule)
        want, crossed = [0] * len(starts), [0] * len(starts)
        for a, b in zip(*tokens, strict=True):
            parts = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
            met = [i for i, p in enumerate(parts) if p]
            to = met[0] if rule == "first" else met[-1] if rule == "last" else max(met, key=lambda i: (parts[i], -i))
            want[to] += 1
            crossed[to] += len(met) > 1
        assert (counts.tolist(), crossing.tolist(), outside) == (want, crossed, 0)


def test_sections_cover_the_text():
    for text in ["a", "a\n", "a. b? c", "a.\n\n b\n", "\n\n", "x" * 5]:
        for cut in (line_sections, sentence_sections):
            starts, ends = cut(text)
            assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] == ends[:-1]).all() and (ends > starts).all()


def test_counts_sum_up(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "One. Two\nthree.  Four"])] + [(0, "again")]
    for sections in (line_sections, sentence_sections):
        found = count_sections(spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", section int"), sections=sections).toPandas()
        assert (found.groupby("doc_id").n_tokens.sum() == found.groupby(["doc_id", "doc_tokens"]).first().groupby("doc_id").size() * 0 + found.drop_duplicates(["doc_id", "doc_tokens"]).groupby("doc_id").doc_tokens.sum()).all()
    assert count_sections(spark.createDataFrame([], DOCS)).count() == 0
    fields = count_fields(spark.createDataFrame([(1, "ab", None, "x y")], "id long, a string, b string, c string"), "id", ["a", "b", "c"]).toPandas()
    assert fields.n_tokens.sum() == fields.doc_tokens[0] and fields.section.tolist() == [0, 1, 2, -1]


def check_pieces(rows, ids_of):
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        per_sequence[r["sequence_id"]].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(per_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_documents_are_packed_whole(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], DOCS))
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert check_pieces([r.asDict() for r in pack_documents(docs).collect()], ids) == 0
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("cutting", [True, False])
def test_limits_hold(cutting):
    r = np.random.default_rng(0)
    limits = Limits(100, 4, 60)
    examples = [(i, np.arange(n, dtype=np.uint32), (r.random(n) < 0.5).astype(np.int64)) for i, n in enumerate(r.integers(1, 90, 200))]
    rows = list(pack_stream(iter(examples), limits, cutting, 50, 0))
    sums = defaultdict(lambda: np.zeros(3, int))
    for row in rows:
        sums[row["sequence_id"]] += (row["length"], 1, row["loss_tokens"])
    assert (np.max(list(sums.values()), axis=0) <= (100, 4, 60)).all()
    assert sum(row["length"] for row in rows) == sum(len(e[1]) for e in examples)
    filled = sum(s[0] for s in sums.values()) / len(sums)
    assert filled > (85 if not cutting else 95)


def test_conversations_learn_from_one_role(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    found = pack_conversations(turns, Limits(512, 8, 256)).toPandas()
    sums = found.groupby("sequence_id").agg(n=("length", "sum"), s=("length", "size"), o=("loss_tokens", "sum"))
    assert sums.n.max() <= 512 and sums.s.max() <= 8 and sums.o.max() <= 256
    assert set(found.conv_id) == {r[0] for r in turns.select("conv_id").distinct().collect()}


def test_many_tiny_documents_leave_little_padding(spark, library):
    """Repeated and null ids and clashing columns too."""
    rows = [(i if i % 50 else None, "ab cd"[: 1 + i % 5], i) for i in range(20_000)]
    found = pack_documents(spark.createDataFrame(rows, DOCS + ", sequence_id int").repartition(4)).toPandas()
    sums = found.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and sums[sums & (sums - 1) != 0].rsub(2048).sum() < 0.02 * 2048 * len(sums)
    assert found.length.sum() == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    named = pack_documents(spark.createDataFrame([(2.5, "a"), (2.5, None)], "doc_id double, text string"))
    assert [r["doc_id"] for r in named.collect()] == [2.5, 2.5]


def test_long_texts_and_conversations(spark, library):
    text = "word after word, " * 40_000
    want = [*library.encode(text, add_special_tokens=False).ids, 1]
    pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pack_documents(spark.createDataFrame([(1, text)], DOCS)).collect())
    assert [s for s, _, _ in pieces] == list(np.cumsum([0, *(n for _, n, _ in pieces)])[:-1]) and sum(n for _, n, _ in pieces) == len(want)
    assert all(c == zlib.crc32(np.array(want[s : s + n], "<u4").tobytes()) for s, n, c in pieces)
    counts = count_sections(spark.createDataFrame([(1, text)], DOCS)).collect()
    assert [r["n_tokens"] for r in counts] == [len(want) - 1]


def test_conversations_are_whole_examples(spark, library):
    """Against brute force: each example is a run of its conversation's tokens, all runs make it up; one conversation is very long."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c} " * (1 + c % 7)) for c in range(40) for t in range(1 + c % 5)]
    rows += [(99, t // 3, "assistant", "the same words again and again") for t in range(900)] + [(None, 0, None, None), (3, None, "user", "no turn")]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, first_turn int")
    limits = Limits(200, 5, 90)
    found = pack_conversations(turns, limits).toPandas()
    sums = found.groupby("sequence_id").agg(n=("length", "sum"), s=("length", "size"), o=("loss_tokens", "sum"))
    assert sums.n.max() <= 200 and sums.s.max() <= 5 and sums.o.max() <= 90
    tokens, loss = defaultdict(int), defaultdict(int)
    for c, _, role, text in rows:
        n = len(library.encode((role or "") + "\n" + (text or ""), add_special_tokens=False).ids) + 1
        tokens[c] += n
        loss[c] += n * (role == "assistant")
    got = found.fillna({"conv_id": -1}).groupby("conv_id").agg(n=("length", "sum"), o=("loss_tokens", "sum"), k=("length", "size"))
    assert {c: (int(r.n), int(r.o)) for c, r in got.iterrows()} == {-1 if c is None else c: (tokens[c], loss[c]) for c in tokens}
    whole = [c for c in tokens if c is not None and tokens[c] <= 200 and loss[c] <= 90]
    assert (got.k[whole] == 1).mean() > 0.9  # cut only where a partition ends
    assert pack_conversations(turns.limit(0)).count() == 0
