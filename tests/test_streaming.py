"""Streams of several batches: repeats of earlier ones, a batch run again, and events that come late."""

import datetime as dt

from pyspark.sql import functions as F

from kinsift.streaming.ingest import arrivals, ingest, windowed_counts


def test_repeats_of_earlier_batches(spark, tmp_path):
    inbox, library = str(tmp_path / "inbox"), str(tmp_path / "library")
    spark.createDataFrame([(0, "held", -1)], "item long, hash string, batch long").write.parquet(library)
    lots = [[(1, "a"), (2, "b"), (3, "a")], [(4, "a"), (5, "c")], [(6, "c"), (7, None), (8, None), (9, "b")]]
    for lot in lots:
        spark.createDataFrame(lot, "id long, text string").coalesce(1).write.mode("append").parquet(inbox)
    schema = spark.read.parquet(inbox).schema

    def run():
        query = ingest(arrivals(spark, inbox, schema, 1), library, str(tmp_path / "answers"), str(tmp_path / "checkpoint"), "id", "text")
        query.awaitTermination()
        return len([p for p in query.recentProgress if p["numInputRows"]]), {r["item"]: (r["verdict"], r["of"]) for r in spark.read.parquet(str(tmp_path / "answers")).collect()}

    batches, said = run()
    want = {1: ("new", 1), 2: ("new", 2), 3: ("repeat", 1), 4: ("repeat", 1), 5: ("new", 5), 6: ("repeat", 5), 9: ("repeat", 2)}
    assert batches == 3 and {k: said[k] for k in want} == want
    # started again with nothing to come, and with one lot more
    assert run() == (0, said)
    spark.createDataFrame([(10, "c"), (11, "d")], "id long, text string").coalesce(1).write.mode("append").parquet(inbox)
    batches, said = run()
    assert batches == 1 and (said[10], said[11]) == (("repeat", 5), ("new", 11))


def test_late_events_up_to_the_watermark(spark, tmp_path):
    inbox, at = str(tmp_path / "events"), lambda minute: dt.datetime(2026, 1, 1, 10) + dt.timedelta(minutes=minute)
    # the second lot's first event comes late, but within ten minutes of the latest; the last lot's one is too late for its window
    lots = [[(at(5), "view"), (at(58), "view")], [(at(52), "view"), (at(70), "click")], [(at(200), "view")], [(at(40), "view"), (at(330), "view")]]
    for lot in lots:
        spark.createDataFrame(lot, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(inbox)
    query = windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r["start"], r["event_type"]): r["n"] for r in spark.table("counted").select(F.col("window.start").alias("start"), "event_type", "n").collect()}
    assert found[at(0), "view"] == 3 and found[at(60), "click"] == 1 and found[at(180), "view"] == 1


def test_reports_by_name(spark, tmp_path):
    import csv
    import json

    from kinsift.sinks.report import write_report

    both = "width int, height int, size_bytes long, relation string, aligned_points int, frame_overlap double, pixel_correlation double, mirrored boolean, inverted boolean, damaged boolean"
    groups = spark.createDataFrame([(0, "a", "a", "KEEP", "a;b.jpg", None, 10, 20, 2048, None, None, None, None, None, None, False), (0, "a", "b", "DELETE", "c.jpg", "a", 5, 5, 9, "claim", 12, 0.98765, 0.9, True, False, True)], f"group_no int, representative string, item string, action string, path string, kept_copy string, {both}")
    library = spark.createDataFrame([("new", "n.jpg", None, None, None, 0, 1, 1, 1, None, None, None, None, None, None, False), ("repeat", "r.jpg", "l.jpg", "lib", "l.jpg", 2, 1, 1, 1, "identical", None, None, None, False, False, False)], f"verdict string, path string, match string, match_in string, kept string, library_matches long, {both}")
    name = lambda n: str(tmp_path / n)
    assert [write_report(name(f"g.{x}"), "groups", groups) for x in ("csv", "json", "txt")] == ["csv", "json", "text"]
    rows = list(csv.DictReader(open(name("g.csv"), newline=""), delimiter=";"))
    assert [r["path"] for r in rows] == ["a;b.jpg", "c.jpg"] and rows[1]["frame_overlap"] == "0.988" and rows[0]["size"] == "2.0KB" and "kept_copy" not in rows[0]
    said = json.load(open(name("g.json")))
    assert said["groups"][1]["mirrored"] is True and "inverted" not in said["groups"][1] and said["groups"][1]["kept_copy"] == "a"
    assert open(name("g.txt")).read().startswith("group_1\n  KEEP a;b.jpg (10x20, 2.0KB)\n  DELETE c.jpg")
    write_report(name("l.json"), "library", library, {"tool": "x"}, groups.select(F.lit("a").alias("a"), F.lit("b").alias("b"), "aligned_points", "frame_overlap", "pixel_correlation", "mirrored", "inverted").limit(1))
    said = json.load(open(name("l.json")))
    assert said["tool"] == "x" and [f["path"] for f in said["files"]] == ["n.jpg", "r.jpg"] and len(said["pairs"]) == 1
    write_report(name("l"), "library", library)
    assert open(name("l")).read() == "repeat\n  r.jpg (1x1, 1B): l.jpg in lib, identical\n\nnew\n  n.jpg (1x1, 1B)\n"
