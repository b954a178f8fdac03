"""Pictures written here as PNG, read by Spark, described and verified."""

import struct
import zlib

import numpy as np
import pytest

from kinsift.operators import pictures, retrieval
from kinsift.operators.kernels import planes
from kinsift.plans.engine import Options
from kinsift.plans.pictures import scan_pictures
from kinsift.sources import images


def png(a):
    h, w = a.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in np.clip(np.rint(a), 0, 255).astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def drawn(seed):
    r = np.random.default_rng(seed)
    a = np.zeros((110, 130))
    for _ in range(60):
        y, x, h, w = r.integers(0, 110), r.integers(0, 130), r.integers(4, 30), r.integers(4, 30)
        a[y : y + h, x : x + w] = r.integers(0, 255)
    return planes.blur(a, 0.8)


def test_families(spark, tmp_path):
    one, two = drawn(1), drawn(2)
    for name, a in (("one", one), ("crop", one[10:, 15:]), ("turn", np.rot90(one)), ("two", two)):
        (tmp_path / f"{name}.png").write_bytes(png(a))
    (tmp_path / "broken.png").write_bytes(png(one)[:200])
    (tmp_path / "text.jpg").write_bytes(b"text")
    read = images.read_planes(spark, [str(tmp_path)]).cache()
    assert {r["path"].rsplit("/")[-1]: r["state"] for r in read.collect()} == {"one.png": "whole", "crop.png": "whole", "turn.png": "whole", "two.png": "whole", "broken.png": "failed", "text.jpg": "failed"}
    told = {r["path"].rsplit("/")[-1]: r["state"] for r in images.states(spark, [str(tmp_path)]).collect()}
    assert told["broken.png"] == "damaged" and told["text.jpg"] == "not an image" and told["one.png"] == "whole"
    described = pictures.describe(read, 200).cache()
    worded = pictures.with_words(described, pictures.fit_vocabulary(described, 500)).cache()
    tf = retrieval.term_counts(pictures.picture_postings(worded))
    best = retrieval.top(retrieval.containment(retrieval.weigh(tf, retrieval.document_frequency(tf)), tf), 2)
    pairs = best.selectExpr("least(q, d) as a", "greatest(q, d) as b").distinct()
    name = lambda p: p.rsplit("/")[-1][:-4]
    found = {frozenset((name(r["a"]), name(r["b"]))): r for r in pictures.verify(pairs, worded, read).collect()}
    assert {frozenset(("one", "crop")), frozenset(("one", "turn"))} <= set(found) and not any("two" in g for g in found)
    assert all(r["blk"] >= 0.65 and r["centred"] and r["n_in"] >= 8 for r in found.values())
    assert not found[frozenset(("one", "turn"))]["framed"] and abs(abs(found[frozenset(("one", "turn"))]["rot"]) - 90) < 2


def test_a_whole_run(spark, tmp_path):
    """Families with copies, crops, reductions and turns; a file cut off, one of no format, one alone."""
    for i in range(3):
        one = drawn(20 + i)
        large = planes.resize_area(np.kron(one, np.ones((2, 2))), 220, 260)
        for name, a in (("a", large), ("b-copy", large), ("c-crop", large[20:200, 25:240]), ("d-half", planes.resize_area(large, 110, 130)), ("e-turn", np.rot90(large))):
            (tmp_path / f"{i}{name}.png").write_bytes(png(a))
    (tmp_path / "alone.png").write_bytes(png(drawn(40)))
    (tmp_path / "cut.png").write_bytes(png(drawn(41))[:-30])
    (tmp_path / "text.jpg").write_bytes(b"some text that is no picture")
    found = scan_pictures(spark, [str(tmp_path)])
    name = lambda p: p.rsplit("/")[-1]
    states = {name(r["path"]): r["state"] for r in found["files"].collect()}
    assert states["text.jpg"] == "not an image" and states["cut.png"] in ("damaged", "failed") and states["0a.png"] == "whole"
    actions = {name(r["item"]): (r["action"], r["kept"] and name(r["kept"])) for r in found["actions"].collect()}
    for i in range(3):
        assert {actions[f"{i}{x}.png"][0] for x in ("a", "b-copy")} == {"KEEP", "DELETE"}
        # a part of the picture, and the picture smaller, go for a file that shows it all and stays
        for x in ("c-crop", "d-half"):
            action, kept = actions[f"{i}{x}.png"]
            assert action == "DELETE" and kept[0] == str(i) and actions[kept][0] == "KEEP"
        # a turned copy is of one frame and size: two lossless files that nothing decides between, unless a fit says less
        assert actions[f"{i}e-turn.png"][0] in ("REVIEW", "KEEP")
    assert "alone.png" not in actions
    groups = {}
    for r in found["groups"].collect():
        groups.setdefault(name(r["representative"]), set()).add(name(r["member"])[0])
    assert all(len(families) == 1 for families in groups.values()) and {min(x) for x in groups.values()} == {"0", "1", "2"}


def test_rules_by_option(spark, tmp_path):
    one = drawn(3)
    for name, a in (("one", one), ("crop", one[10:, 12:])):
        (tmp_path / f"{name}.png").write_bytes(png(a))
    found = scan_pictures(spark, [str(tmp_path)], Options(suggest="representative"))
    assert sorted(r["action"] for r in found["actions"].collect()) == ["DELETE", "KEEP"]


def test_what_a_walk_passes_over(spark, tmp_path):
    root = tmp_path / ".kept" / "photos"
    for name in ("a.jpg", "b.PNG", "no_extension", "sub/c.jpeg", ".hidden/d.jpg", "@eaDir/e.jpg", "sub/thumbnails/f.jpg", "old/g.jpg", "h.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(png(drawn(1)[:20, :20]))
    listed = lambda **o: sorted(r["path"].rsplit("photos/")[1] for r in images.walked_files(spark, [str(root)], Options(**o)).collect())
    assert listed() == ["a.jpg", "b.PNG", "old/g.jpg", "sub/c.jpeg", "sub/thumbnails/f.jpg"]
    assert listed(recursive=False) == ["a.jpg", "b.PNG"]
    with pytest.raises(ValueError):
        listed(hidden=True)
    assert listed(exclude=("old", "*.PNG")) == ["a.jpg", "sub/c.jpeg", "sub/thumbnails/f.jpg"] and listed(extensions=("txt",)) == ["h.txt"]
    assert images.walked_files(spark, [str(root / "@eaDir")], Options()).count() == 1


def test_the_second_look(spark, tmp_path):
    """A mirror image and a negative are found when asked as such; one is a copy to the rule, the other settles nothing."""
    one, two = planes.resize_area(np.kron(drawn(60), np.ones((2, 2))), 220, 260), planes.resize_area(np.kron(drawn(61), np.ones((2, 2))), 220, 260)
    for name, a in (("a", one), ("a-mirror", one[:, ::-1][:, 20:]), ("b", two), ("b-negative", 255 - two)):
        (tmp_path / f"{name}.png").write_bytes(png(a))
    name = lambda p: p.rsplit("/")[-1][:-4]
    found = scan_pictures(spark, [str(tmp_path)])
    claims = {frozenset((name(r["a"]), name(r["b"]))): r for r in found["claims"].collect()}
    assert set(claims) == {frozenset(("a", "a-mirror")), frozenset(("b", "b-negative"))}
    mirrored = claims[frozenset(("a", "a-mirror"))]
    assert mirrored["m0"] * mirrored["m4"] - mirrored["m1"] * mirrored["m3"] < 0 and not mirrored["inverted"] and claims[frozenset(("b", "b-negative"))]["inverted"]
    actions = {name(r["item"]): r["action"] for r in found["actions"].collect()}
    assert actions == {"a": "KEEP", "a-mirror": "DELETE", "b": "KEEP", "b-negative": "KEEP"}
    assert scan_pictures(spark, [str(tmp_path)], Options(mirrored_inverted=False))["claims"].count() == 0
