"""Exact dedup and the Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinsift.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, golomb_decode, golomb_encode
from kinsift.llm.jaccard import drop_near_duplicates, jaccard_components, level_of, link_block
from kinsift.llm.shingles import batch_sets, set_name, shingle_sets

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    values = np.array(sorted(set(values)), np.uint64)
    assert (golomb_decode(*golomb_encode(values)) == values).all()


def test_exact_duplicates_defined_cases(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, " a b"), (None, "a b"), (4, None), (5, ""), (6, "x"), (7, "x" * 100_000), (8, "x" * 100_000), (6, "x"), (6, "y")]
    found = exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    keep = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in found}
    assert sorted({v for k, v in keep.items() if k[0] in (1, 3, None)}) == [(1, 3)]
    assert {v for k, v in keep.items() if k[0] in (4, 5)} == {(4, 2)} and {v for k, v in keep.items() if k[0] in (7, 8)} == {(7, 2)}
    assert sum(r["kept"] for r in found) == len(keep.values()) - 4  # one a group: of 10 keys, 4 go
    stay = drop_exact_duplicates(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", sha int"))
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 2, 4, 6, 6, 7] and stay.columns == ["doc_id", "text", "sha"]


def test_exact_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=25))
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            words = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, 3)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary).upper() if r.random() < 0.3 else r.choice(vocabulary)
            text = "  ".join(words)
        else:
            text = " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 5, 30, 80])))
            text += "\n" + passage if r.random() < 0.4 else ""
        rows.append((i, text))
    return [*rows, (n, None), (n + 1, "  ")]


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = jaccard_components(spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS + ", class string").repartition(3))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_large_cluster_is_dealt_in_blocks(spark, monkeypatch):
    from kinsift.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 7)
    rows = corpus(9, 40)
    base = " ".join(f"b{i}" for i in range(60)).split()
    for i in range(30):  # a chain: each text is near the next, the ends are not
        base[2 * i % 60] = f"n{i}"
        rows.append((1000 + i, " ".join(base)))
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, DOCS)).collect())) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_block_kernel_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 500, 40)
    sets = [np.unique(np.where(r.random(40) < 0.06, r.integers(0, 500, 40), base)) for _ in range(80)]
    tokens = [r.permutation(s).astype(np.uint64) for s in sets]
    n = np.array([len(s) for s in sets])
    found = link_block(n, tokens, 80)
    root = list(range(80))

    def find(i):
        return i if root[i] == i else find(root[i])

    want = list(range(80))
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [find(i) for i in range(80)]
    assert found.tolist() == want


@pytest.mark.parametrize(("seeds", "frequent"), [(False, 64), (False, 2), (True, 3)])
def test_join_alone_equals_brute_force(spark, monkeypatch, seeds, frequent):
    """Without seeds all links come from the multi-match prefixes; low bars send tokens straight and split lists."""
    from kinsift.llm import jaccard

    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LIST_CLASSES", 5)
    if not seeds:
        monkeypatch.setattr(jaccard, "_seeds", lambda suspects, percent: suspects.selectExpr("no as a", "no as b").limit(0))
    rows = corpus(21, 90)
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5)).collect())) == brute(rows)


def test_levels_rise_with_cost():
    assert [level_of(c, 100) for c in (0, 16, 17, 65, 257)] == [1, 1, 2, 4, 8] and level_of(10**9, 3) == 2


def test_long_texts_are_read_in_pieces():
    import pyarrow as pa

    text = " ".join(f"Word{i % 977}" for i in range(3000)) + "\n" + "x" * 5000 + " end of it all"
    whole, pieces = (next(batch_sets(pa.array([text]), max_bytes=m)) for m in (1 << 20, 700))
    assert (whole == pieces).all() and len(whole) > 900


def test_shingles_are_of_words_not_of_places():
    data = "A b  C d e f".encode()
    first = next(shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    data = "\n a B c D e   f ".encode()
    second = next(shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    assert len(first) == 2 and set_name(first) == set_name(second)


def test_near_duplicates_leave_one_a_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, "another text"), (4, None)]
    assert sorted(r["doc_id"] for r in drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == [1, 3, 4]
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(1, text), (None, text + " more"), (None, "a clean text"), (None, other), (None, other + " more"), (7, "one id"), (7, "two texts"), (7, text + " end"), (8, "same words here"), (8, "same  words here"), (9, None), (9, "")]
    found = drop_near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", class int"))
    stay = sorted((str(r["doc_id"]), " ".join((r["text"] or "").split())) for r in found.collect())
    assert found.columns == ["doc_id", "text", "class"] and len(stay) == 8
    assert [x for x in stay if not x[1].startswith(other)] == sorted([("1", text), ("None", "a clean text"), ("7", "one id"), ("7", "two texts"), ("8", "same words here"), ("9", ""), ("9", "")])
