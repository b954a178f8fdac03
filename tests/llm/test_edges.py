"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinsift.llm import queries
from kinsift.llm.html_text import extract_pages
from kinsift.llm.jaccard import jaccard_components
from kinsift.llm.langid import identify_languages
from kinsift.llm.token_counts import count_sections, sentence_sections
from tests.llm.test_dedup_and_joins import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sentences_by_hand(spark):
    """Sections end after blanks that follow a point, or hold a line end; each token goes whole to the section with most of its characters."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = ["One. Two!  Three?\tno end", "a\nb \n c.d e.", "x" * 50, ". . .", "é. ü\n\nß", "ends. ", " \n starts", "tie.\n\nnext"]
    df = spark.createDataFrame([(i % 3, t, 1) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, section int")
    found = Counter((r["doc_id"], r["section"], r["start"], r["finish"], r["n_tokens"], r["n_crossing"], r["doc_tokens"]) for r in count_sections(df, sections=sentence_sections).collect())
    want = Counter({(None, 0, 0, 0, 0, 0, 0): 1})
    for i, t in enumerate(texts):
        ends = [m.end() for m in re.finditer(r"(?<=[.!?])[ \t-\r]+|[ \t-\r]*\n[ \t-\r]*", t)]
        ends = sorted({*ends, len(t)})
        spans = library.encode(t, add_special_tokens=False).offsets
        counts, crossing = Counter(), Counter()
        for a, b in spans:
            parts = [max(0, min(b, e) - max(a, s)) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            to = max(range(len(parts)), key=lambda k: (parts[k], -k))
            counts[to] += 1
            crossing[to] += sum(p > 0 for p in parts) > 1
        want.update((i % 3, k, s, e, counts[k], crossing[k], len(spans)) for k, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)))
    assert found == want


def test_links_with_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 5000}x{i // 7}" for i in range(120_000))
    near = long.replace("w17x", "v17x")
    rows = [(None, "a b c d e f"), (3, "A B C  d e f"), (None, None), (5, long), (4, near), (None, long + " more"), (6, "a b c d e f")]
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_components(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, class int")).collect())
    sizes = [len(shingles(t)) for _, t in rows]
    assert found == sorted([("None", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("5", sizes[3], "4"), ("4", sizes[4], "4"), ("None", sizes[5], "4"), ("6", 2, "3")])


def test_languages_of_ties_and_repeats(spark):
    """Two languages learn the same texts: equal counts go to the first by name. Repeated ids are judged alike."""
    rows = [(i, "the same words in both", lang, None, 1) for i in range(40) for lang in ("bb", "aa")] + [(7, "the same words in both", None, None, 1)] * 2 + [(900, "words " * 60_000, None, None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(3))
    found = identify_languages(df).collect()
    assert len(found) == len(rows) and {r["lang_pred"] for r in found} == {"aa"} and all(0 < r["score"] <= 1 for r in found)


def test_votes_that_tie_and_repeated_pages(spark):
    page = lambda c, t: f"<body><div class={c}><p>{t}</p></div></body>"
    rows = [(1, "http://h/1", page("b", "first text here")), (1, "http://h/1", page("b", "first text here")), (2, "http://h/2", page("a", "second text")), (3, "http://h/3", page("a", "third text")), (4, "http://h/4", "<p>" + "long " * 300_000), (5, "mailto:x", None)]
    found = Counter((r["page_id"], r["text"]) for r in extract_pages(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")).collect())
    assert found == Counter([(1, "first text here")] * 2 + [(2, "second text"), (3, "third text"), (4, ("long " * 300_000).strip()), (5, "")])


def test_pipeline_stages_take_anything(spark):
    empty = spark.createDataFrame([], DOCS)
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 200_000, "en", "s", 1), (3, "plain words of a text", "en", None, 1), (3, "plain words of a text", "en", None, 1), (3, "Other words, of the same number", None, "t", 1), (None, "no number here", "en", "s", 1)]
    names = ("score", "lang_pred", "_copies", "_class", "_sha", "_key", "_mix", "id", "size", "row", "sha", "owner")
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in odd], DOCS + "".join(f", `{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        kept = stage(spark, wide, "")
        rows = kept.collect()
        if name != "packing":
            assert kept.columns == wide.columns, name
            assert all([r[n] for n in names] == list(range(len(names))) for r in rows), name
    texts = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.exact_dedup(spark, wide, "").collect())
    assert texts == Counter({(d, t): 1 for d, t, *_ in odd if (d, t) != (None, None)} | {(1, ""): 1})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_say_what_they_do(name):
    assert queries.QUERIES[name].__doc__


def test_a_pipeline_run_leaves_little_behind(spark, sf, tmp_path, monkeypatch):
    from kinsift.plans import lineage

    monkeypatch.setattr(lineage, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = {n.name.rsplit("-", 1)[0] for n in (tmp_path / "kinsift").iterdir()}
    assert left == {"language_id", "exact_dedup", "ngram_jaccard", "mixing"}
