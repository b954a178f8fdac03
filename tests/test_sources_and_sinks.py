import os

import pytest
from pyspark.sql import functions as F

from kinsift.plans import state
from kinsift.plans.engine import Options, ask_library, scan_texts
from kinsift.sinks import report
from kinsift.sources import listing


@pytest.mark.parametrize(
    ("pattern", "path", "meets"),
    [("*.jpg", "a/b.jpg", True), ("*.jpg", "a/b.jpgx", False), ("a/**/c", "a/x/y/c", True), ("a/**/c", "a/c", True), ("a/*/c", "a/x/y/c", False), ("[!a]?", "x/b1", True), ("[!a]?", "a1", False), ("[a-c]*", "q/bee", True)],
)
def test_globs(spark, pattern, path, meets):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(listing.matches_glob(F.col("path"), pattern)).first()[0] is meets


def test_listing_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "sub" / "b.jpg").write_bytes(b"text")
    os.symlink(tmp_path / "a.png", tmp_path / "link.png")
    assert listing.list_files(spark, [str(tmp_path)]).count() == 3
    rows = listing.local_listing([str(tmp_path)])
    files = spark.createDataFrame([{k: r[k] for k in ("path", "side", "dev", "ino", "is_link", "depth")} for r in rows])
    assert {os.path.basename(r["path"]) for r in listing.identity_dedup(files, ["dev", "ino"]).collect()} == {"a.png", "b.jpg"}
    (tmp_path / "list").write_text("x\r\n\ny\n")
    assert [r["path"] for r in listing.read_path_list(spark, str(tmp_path / "list")).collect()] == ["x", "y"]


def test_csv_field_and_json(spark):
    assert report.csv_field('a;"b') == '"a;""b"' and report.csv_field("plain") == "plain"
    rows = spark.createDataFrame([("x", True), ("y", False)], "path string, mirrored boolean")
    fields = [report.Field("path", F.col("path")), report.Field("mirrored", F.col("mirrored"), sparse=True)]
    assert "".join(report.csv_lines(rows, fields, ["path"])) == "path;mirrored\r\nx;true\r\ny;false\r\n"
    assert list(report.json_rows(rows, fields, ["path"])) == ['{"path": "x", "mirrored": true}', '{"path": "y"}']


def test_whole_file_and_path_list(spark, tmp_path):
    out = tmp_path / "r.txt"
    report.whole_file(str(out), iter(["a", "b"]))
    assert out.read_text() == "ab" and os.listdir(tmp_path) == ["r.txt"]
    broken = spark.createDataFrame([("a\nb",)], "path string")
    with pytest.raises(ValueError):
        list(report.path_list(broken, "path"))
    assert list(report.path_list(broken, "path", True)) == ["a\nb\0"]


def test_outputs_are_planned(tmp_path):
    report.plan_outputs({"report": str(tmp_path / "r.csv"), "dump": None})
    for bad in ({"a": "-", "b": "-"}, {"a": str(tmp_path / "x.png")}, {"a": "/nowhere/x.csv"}):
        with pytest.raises(ValueError):
            report.plan_outputs(bad)


def test_gone_files_are_kept_for_a_while(spark):
    kept = spark.createDataFrame([("a", None), ("b", None), ("c", 60), ("d", 95)], "path string, gone int")
    seen = spark.createDataFrame([("a",), ("d",)], "path string")
    assert {r["path"]: r["gone"] for r in state.settle_files(kept, seen, 100).collect()} == {"a": None, "b": 100, "d": None}


def test_results_are_kept(spark, tmp_path):
    t = spark.createDataFrame([(1,)], "item long")
    state.keep_result(str(tmp_path / "r"), {"t": t}, {"files": 1})
    tables, head = state.kept_result(spark, str(tmp_path / "r"), ("t",))
    assert tables["t"].count() == 1 and head == {"format": state.FORMAT, "files": 1}


def test_options_are_checked():
    for bad in ({"min_frame_overlap": 2}, {"candidates": 0}, {"suggest": "x"}, {"verdicts": ("new",)}, {"detail": 700}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_scan_and_library(spark):
    base = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " eleven"), (4, "quite another text of words"), (5, None), (6, "")], "doc_id long, text string")
    found = scan_texts(docs)
    groups = {(r["representative"], r["member"]) for r in found["groups"].collect()}
    assert {m for h, m in groups if h == 3} == {1, 2, 3}
    library = docs.filter("doc_id in (1, 4)").select(F.col("doc_id").alias("item"), "text")
    scanned = spark.createDataFrame([(10, base), (11, "nothing of it")], "item long, text string")
    assert {r["item"]: r["verdict"] for r in ask_library(scanned, library).collect()} == {10: "repeat", 11: "new"}


def test_claims_of_tools(spark, tmp_path):
    import json

    from kinsift.operators import evaluate

    files = {
        "pairs": {"tool": "p", "pairs": [{"a": "y", "b": "x"}, {"a": "x", "b": "y"}], "groups": [["x", "y", "z"]], "identical": [{"files": [{"path": "u"}, {"path": "v"}, {"path": "w"}]}]},
        "groups": {"tool": "g", "groups": [["b", "a", "c"], {"files": [{"path": "d"}, {"path": "e"}]}]}, "none": {"tool": "n", "groups": []}, "metrics": [1, 2],
    }
    for name, said in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(said))
    found = sorted((r["tool"], r["a"], r["b"]) for r in evaluate.load_claims(spark, [str(tmp_path)]).collect())
    assert found == [("g", "a", "b"), ("g", "a", "c"), ("g", "b", "c"), ("g", "d", "e"), ("p", "u", "v"), ("p", "u", "w"), ("p", "v", "w"), ("p", "x", "y")]


def test_late_colours_and_empty_libraries(spark):
    from kinsift.plans import state
    from kinsift.sources import listing

    analyses = spark.createDataFrame([("h", "1", None), ("h", "2", None), ("i", "1", 2.0), ("j", "1", None)], "hash string, version string, colour double")
    found = state.with_colour(analyses, spark.createDataFrame([("h", 7.0), ("i", 9.0), ("h", None)], "hash string, colour double"))
    assert sorted((r["hash"], r["colour"]) for r in found.collect() if r["colour"]) == [("h", 7.0), ("h", 7.0), ("i", 2.0)] and found.columns == analyses.columns
    roots = spark.createDataFrame([("a", False, False, True), ("b", True, True, True), ("c", True, False, False), ("d", True, False, True), ("e", True, False, True)], "root string, exists boolean, scanned boolean, recursive boolean")
    files = spark.createDataFrame([("d/x.txt", "d", False), ("e/x.jpg", "e", True)], "path string, root string, wanted boolean")
    said = {r["root"]: r["reason"] for r in listing.why_no_library(roots, files).collect()}
    assert set(said) == set("abcd") and said["a"] == "it is not there" and "directly" in said["c"]
