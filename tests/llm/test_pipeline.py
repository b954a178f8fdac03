"""The pipeline's stages on a small corpus with planted cases."""

import corpus_pipeline
import pytest


def test_stages(spark, tmp_path):
    letters = "abcdefghijklmnopqrstuvwxyzabcdef"
    rows = [(i, " ".join(f"the{letters[i]} of{letters[k]}{letters[i]} and" for k in range(26)), "en", f"s{i % 3}", 0) for i in range(24)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1] + " end", "en", "s1", 0), (102, "12345 !!", "en", "s1", 0), (103, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    kept = docs
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        if name != "packing":
            assert kept.columns == docs.columns
        ids.append({r[0] for r in kept.select("doc_id").collect()})
    everything = {r[0] for r in rows}
    assert ids[0] == everything - {102, 103} and ids[1] == ids[0] - {100} and ids[2] == ids[1] - {101}
    assert ids[3] <= ids[2] and ids[4] == ids[3]


def test_run(spark, sf):
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("name", ["STAGES", "run", "ORACLE_SQL"])
def test_contract(name):
    assert hasattr(corpus_pipeline, name)
