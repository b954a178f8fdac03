"""Main texts of pages of several templates, and copies of drawn images."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.llm.html_text import best_path, extract_pages, main_text, read_page
from kinsift.llm import media
from kinsift.llm.media import consensus, describe, descriptor_matches, find_copies, vector_planes

PAGES = "page_id long, url string, html string"


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub("<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_articles_of_the_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    found = extract_pages(pages).collect()
    assert {r["page_id"]: r["text"] for r in found} == want and all(r["n_chars"] == len(r["text"]) for r in found)


OTHER = """<html><body class="page"><header><h1>Site</h1></header><div id="cookie-notice">Cookies!</div><nav><a href=/>Home</a></nav>
<div class="wrap"><div class="post-12 body"><h2>T&eacute;tle &amp; more</h2><p>First  paragraph <b>bold</b> text that is long enough,
with lines.<p>Second &#8364; paragraph<br>goes on<ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script><form>q</form></div>
<div class="sidebar">Side text</div><div class="comments"><p>A reader's comment that is quite long, longer than most of the text that there is.</p></div></div>
<footer>&copy; x</footer></body></html>"""


def test_another_template():
    assert best_path(read_page(OTHER))[0] == "html/body.page/div.wrap/div.body.post-N"
    assert main_text(OTHER, None) == "Tétle & more\nFirst paragraph bold text that is long enough, with lines.\nSecond € paragraph goes on\none\ntwo"


def test_broken_markup_does_no_harm():
    for page in ["", "<", "<p", "<!-- open", "<script>x", "</div></p>text", "<p>a<div>b</p>c", "<b><i>x</b>y", "a < b && c > d", "<p>" * 500 + "x", "<a b='c", "<p =x/ / y>t", "<!", "<?x", "</", "<p a==b>t"]:
        assert isinstance(main_text(page, None), str) and isinstance(main_text(page, "p"), str)
    assert main_text("a < b && c > d") == "a < b && c > d" and main_text("<p =x/ / y>t") == "t"


def test_broken_pages_take_time_in_proportion():
    text = "<p>" + "word " * 50 + "</p>"
    for piece in ("<a href=x ", "<a title=\"x ", "<div>", "<b>", "<b><div></div>", "</x>", "<div class=ad>", "<!-- ", "<script ", "<ul><li>", "< "):
        page = text + piece * (2_000_000 // len(piece))
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 20, piece
    assert read_page(text + "<div>" * 100_000).texts == [("word " * 50).strip()]


def test_names_alone_drop_no_article():
    text = "words of the article that go on for some time. " * 6
    for opening, closing in (
        ("<div class='content with-sidebar'>", "</div>"), ("<div class='share-article'>", "</div>"), ("<div class='post has-comments'>", "</div>"), ("<div class='header-ad story'>", "</div>"),
        ("<div data-id='comment'>", "</div>"), ("<form id=aspnetForm><article>", "</article></form>"), ("<div class=widget>", "</div>"), ("<div role=main class=x>", "</div>"),
    ):
        page = f"<html><body><nav><a href=/>Home</a></nav>{opening}<p>{text}</p>{closing}<div class=sidebar>Side</div><div id=comments>A reader says no.</div></body></html>"
        assert main_text(page) == text.strip(), opening
    titled = f"<article><header><h1>Title</h1></header><p>{text}</p><footer>by x</footer></article>"
    assert main_text(titled) == f"Title\n{text.strip()}"
    assert main_text(f"<div class=story><p>{text}</p></div><div class=comments><p>{text * 3}</p></div>") == text.strip()


def test_templates_of_a_host(spark):
    """Two templates on one host, five hosts of one each; a notice without a telling name is on all pages."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    notice = "this notice is on every page of the host and rather long, so that it counts for something " * 2
    inner = [f"<{t}><p>{{}}</p></{t.split()[0]}>" for t in ("article", "main", "div class=story", "section id=x", "td")]
    rows = [(100 * h + i, f"http://h{h}/{i}", f"<body><div class=top>{notice}</div>{inner[h].format(text(100 * h + i))}</body>") for h in range(5) for i in range(6)]
    rows += [(900 + i, f"http://two/{i}", f"<body>{inner[i % 2 + 1].format(text(900 + i))}<div class=q>{i}</div></body>") for i in range(9)]
    found = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {i: text(i) for i, _, _ in rows}


def test_hosts_vote(spark):
    good = "<body><div class='ad-1'>buy</div><div class='story'><p>" + "words of the story, " * 20 + "</p></div><div class='more'>{}</div></body>"
    rows = [(i, f"http://h/{i}", good.format("x")) for i in range(5)] + [(9, "http://h/9", good.format("links that are longer than the story here, " * 20)), (10, "http://h/10", None), (11, None, "<p>alone</p>"), (12, "http://h/12", "<p>other page</p>")]
    found = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame([(*r, "p") for r in rows], PAGES + ", path string")).collect()}
    assert all(found[i].startswith("words of the story") and "links" not in found[i] for i in (0, 4, 9))
    assert found[10] == "" and found[11] == "alone" and found[12] == "other page"
    assert extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def picture(r, n=150):
    a = np.zeros((n, n))
    for _ in range(60):
        y, x, h, w = r.integers(0, n, 4)
        a[y : y + h // 4 + 4, x : x + w // 4 + 4] = r.integers(0, 255)
    return a


def packed(a):
    return {"h": a.shape[0], "w": a.shape[1], "px": np.clip(a, 0, 255).astype(np.uint8).tobytes()}


def test_crops_turns_and_edits_are_found(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(4):
        p = picture(r)
        rows += [(50 * i, packed(p)), (50 * i + 1, packed(p[15:135, 20:140])), (50 * i + 2, packed(np.rot90(p))), (50 * i + 3, packed(p * 0.7 + 30 + r.normal(0, 2, p.shape)))]
    rows += [(900, None), (901, {"h": 2, "w": 2, "px": b"abcd"}), (902, packed(np.zeros((64, 64)))), (None, packed(picture(r)))]
    df = spark.createDataFrame([(*x, 0) for x in rows], "id long, image struct<h:int,w:int,px:binary>, links int")
    found = {x["id"]: [q["query_id"] for q in x["links"]] for x in find_copies(df, F.col("id") % 50 == 0, "id", "image").collect()}
    assert set(found) == {x[0] for x in rows if x[0] is not None}
    for i in range(4):
        assert found[50 * i] == [] and all(found[50 * i + j] == [50 * i] for j in (1, 2, 3))
    assert found[900] == found[901] == found[902] == []


def test_vectors_defined_cases(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(40, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100 + i, (x + r.normal(0, 0.02, 64)).tolist()) for i, x in enumerate(v)] + [(200 + i, v[0].tolist()) for i in range(30)] + [(20, v[1].tolist()), (300, [1.0] * 3), (301, None), (301, None), (302, [float("nan")] * 64), (None, v[2].tolist())]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, links int")
    found = find_copies(df, (F.col("vec_id") < 40) | (F.col("vec_id") == 205), "vec_id", "embedding", vector_planes).collect()
    assert len(found) == len(rows) - 1
    links = {(x["vec_id"], x["class_id"]): [q["query_id"] for q in x["links"]] for x in found}
    assert sum(i in links[100 + i, 100 + i] for i in range(40)) >= 38
    assert all(0 in links[200 + i, 0] for i in range(30)) and 0 not in links[0, 0]
    assert 1 in links[20, 1] and links[300, 300] == links[301, 301] == links[302, 302] == []
    assert find_copies(df.limit(0), F.lit(True), "vec_id", "embedding", vector_planes).count() == 0


def test_consensus_finds_the_turn():
    r = np.random.default_rng(0)
    a = describe(picture(r)[None].astype(np.float32))
    n, scale, turn = consensus(a, a)
    assert n > 20 and abs(scale - 1) < 1e-6 and min(turn, 360 - turn) < 1e-3


@pytest.mark.parametrize("width", [None, 28])
def test_recall_of_the_tables(spark, monkeypatch, width):
    """Copies found through the tables, of those found by comparing every descriptor with every other one; wide keys are those of a large table."""
    if width:
        monkeypatch.setattr(media, "key_width", lambda corners: width)
    r = np.random.default_rng(6)
    v = r.normal(size=(150, 64))
    noise = np.repeat([0.02, 0.05, 0.1], 50)[:, None]
    stack = np.concatenate([v, v + noise * r.normal(size=v.shape)])
    import pyarrow as pa

    (features,) = [media.Features.joined(list(media._features_of(pa.array(stack.tolist()), vector_planes)))]
    words = features.parts.view(np.uint64)
    want = set()
    for q in range(150):
        mine, theirs = np.flatnonzero(features.row == q), np.flatnonzero(features.row >= 150)
        apart = np.bitwise_count(words[mine][:, None] ^ words[theirs][None]).sum(axis=2, dtype=np.int64)
        for i in range(150, 300):
            own = features.row[theirs] == i
            d = apart[:, own]
            if not d.size:
                continue
            a, b = np.nonzero((d == d.min(axis=0)) & (d <= 40))
            if len(a) >= 8 and consensus(features.take(mine[a]), features.take(theirs[own][b]))[0] >= 8:
                want.add((q, i))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(stack)], "vec_id long, embedding array<double>")
    got = {(q["query_id"], x["vec_id"]) for x in find_copies(df, F.col("vec_id") < 150, "vec_id", "embedding", vector_planes).collect() for q in x["links"] if x["vec_id"] >= 150}
    assert len(want) > 100 and len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)


def test_matches_are_within_the_radius(spark):
    r = np.random.default_rng(7)
    bits = r.integers(0, 2, (60, 256), np.uint8)
    near = bits.copy()
    for i, b in enumerate(near):
        b[r.permutation(256)[:i]] ^= 1
    rows = [(c * 100 + i, c == 0, 0, 0.0, 0.0, 1.0, 0.0, *np.packbits(b).view(np.int64).tolist()) for c, side in enumerate((bits, near)) for i, b in enumerate(side)]
    corners = spark.createDataFrame(rows, "cls long, asked boolean, corner int, x float, y float, scale float, angle float, p0 long, p1 long, p2 long, p3 long")
    found = {(x["q"], x["i"]): x["apart"] for x in descriptor_matches(corners, 40).collect()}
    assert all(d <= 40 and (d == i % 100 if q == i % 100 and i >= 100 else True) for (q, i), d in found.items())
    assert sum((i, 100 + i) in found for i in range(41)) >= 38 and not any((i, 100 + i) in found for i in range(41, 60))


def test_rows_of_matches_dont_grow_with_the_asked_copies(spark):
    """Near copies of one picture: matches are lists, not rows, and no match is lost."""
    r = np.random.default_rng(12)
    bits = r.integers(0, 2, (4, 256), np.uint8)
    rows = []
    for c in range(60):
        for k, b in enumerate(bits):
            own = b.copy()
            own[r.permutation(256)[:3]] ^= 1
            rows.append((c, c < 40, None if c >= 40 else 7 * c, k, float(k), 1.0, 1.0, 0.0, *np.packbits(own).view(np.int64).tolist()))
    corners = spark.createDataFrame(rows, "cls long, asked boolean, asked_id long, corner int, x float, y float, scale float, angle float, p0 long, p1 long, p2 long, p3 long")
    packed = media.packed_matches(corners, 40).collect()
    assert len(packed) < 60 * 40 * 4 / 2, len(packed)
    lists = {}
    for x in packed:
        for m in x["met"]:
            assert m["asked_id"] == 7 * m["q"] and m["x"] == m["cq"] and m["ix"] == m["ci"]
            lists.setdefault((m["i"], m["ci"], m["q"], m["cq"]), []).append(m["apart"])
    words = np.array([x[8:] for x in rows], np.int64).view(np.uint64).reshape(60, 4, 4)
    want = {(i, k, q, k): int(np.bitwise_count(words[i, k] ^ words[q, k]).sum()) for i in range(60) for q in range(40) for k in range(4)}
    assert {k: v[0] for k, v in lists.items()} == want and all(len(v) == 1 for v in lists.values())
    assert {(x["i"], x["ci"], x["q"], x["cq"]): x["apart"] for x in descriptor_matches(corners, 40).collect()} == want


def test_keys_of_many_descriptors_are_split(spark, monkeypatch):
    r = np.random.default_rng(13)
    v = r.normal(size=64)
    df = spark.createDataFrame([(i, (v + r.normal(0, 0.02, 64)).tolist()) for i in range(40)], "vec_id long, embedding array<double>")

    def links():
        return {(x["vec_id"], x["n_links"], tuple(q["query_id"] for q in x["links"])) for x in find_copies(df, F.col("vec_id") < 20, "vec_id", "embedding", vector_planes).collect()}

    want = links()
    for name, value in (("KEY_ROWS", 5), ("PART_ROWS", 500), ("ASKED_BLOCK", 4), ("BUNDLE", 4), ("PAIRS", 50), ("TABLES_AT_ONCE", 3)):
        monkeypatch.setattr(media, name, value)
    assert links() == want and sum(n for _, n, _ in want) > 400


def test_small_crops_and_strong_resizes_of_large_images(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(1):
        p = sum(np.kron(r.normal(0, 12, (320 // k, 320 // k)), np.ones((k, k))) for k in (2, 4, 8, 16, 32)) * 1.2 + 128
        rows += [(50 * i, packed(p)), (50 * i + 1, packed(p[130:210, 150:230])), (50 * i + 2, packed(p.reshape(80, 4, 80, 4).mean(axis=(1, 3))))]
    df = spark.createDataFrame(rows, "id long, image struct<h:int,w:int,px:binary>")
    found = {x["id"]: [q["query_id"] for q in x["links"]] for x in find_copies(df, F.col("id") % 50 == 0, "id", "image").collect()}
    for i in range(1):
        assert found[50 * i] == [] and all(found[50 * i + j] == [50 * i] for j in (1, 2))


def test_no_part_of_the_article_is_dropped():
    lead, text = "lead " * 80, "text " * 120
    split = f"<body><div class=story><div class=lead>{lead}</div><div class=text>{text}</div></div><div class=more>x</div></body>"
    assert main_text(split, None) == f"{lead.strip()}\n{text.strip()}"
    for page in (f"<body><div class='content has-sidebar'><p>{text}</p><div class=sidebar>side</div></div></body>", f"<body><article class='post no-comments'><p>{text}</p></article></body>"):
        assert main_text(page, None) == text.strip()
