"""Mixing against a brute-force version of the same rule, language ID by held-out accuracy, secrets and archives by brute force."""

import hashlib
import re
import time
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinsift.llm.langid import build_filters, fit_filters, gram_hashes, identify_languages, score_texts
from kinsift.llm.mixing import length_weight, mixed_documents, pareto_mix
from kinsift.llm.secrets import ALPHABETS, _battery, cuts, find_secrets
from kinsift.llm.warc import archive_and_resolve, parse_warc, read_warc, warc_records, write_warc

DOCS = "doc_id long, text string, source string"


def water(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in names}
        capped |= over


@pytest.mark.parametrize("weight", [None, length_weight])
def test_mix(spark, sf, weight):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = pareto_mix(docs, weight=weight).toPandas()
    sizes = found.groupby("source")["size"].sum().to_dict()
    targets = water(sizes)
    assert len(found) == docs.count() and (found.source_size == found.source.map(sizes)).all()
    assert np.allclose(found.target, found.source.map(targets)) and (found.taken <= 3 * found["size"]).all()
    taken = found.groupby("source").taken.sum()
    largest = found.groupby("source")["size"].max()
    for s in taken.index:
        assert abs(taken[s] - targets[s]) <= max(1, 0.02 * targets[s], largest[s] / 2)
    again = pareto_mix(docs.repartition(5), weight=weight).toPandas()
    assert dict(zip(found.doc_id, found.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mix_defined_cases(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "x"), (None, "q q q", "x"), (4, "", ""), (5, "w " * 50, "y"), (6, "k", "z")]
    df = spark.createDataFrame(rows, DOCS)
    found = pareto_mix(df).toPandas()
    assert len(found) == len(rows) and (found.taken <= 3 * found["size"]).all()
    sizes = {None: 4, "x": 3, "": 0, "y": 50, "z": 1}
    for r in found.itertuples():
        assert r.target == pytest.approx(water(sizes)[r.source])
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and sum(len(r["text"].split()) for r in mixed.collect()) == found.taken.sum()
    assert pareto_mix(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_share_their_copies(spark):
    rows = [(None, f"w{i} x", "s") for i in range(40)] + [(9, f"y{i} z", "t") for i in range(7)] + [(5, "w " * 61, "u")]
    df = spark.createDataFrame(rows, DOCS)
    taken = pareto_mix(df).groupBy("source").agg({"copies": "sum"}).collect()
    mixed = Counter(r["source"] for r in mixed_documents(df).collect())
    assert {s: n for s, n in taken if n} == dict(mixed) and any(n % k for (s, n), k in ((x, {"s": 40, "t": 7, "u": 1}[x[0]]) for x in taken))


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "word " * 10, "s", 4.0 if i < 200 else 1.0) for i in range(1000)] + [(5000, "word " * 10000, "t", 1.0)]
    found = pareto_mix(spark.createDataFrame(rows, DOCS + ", w double"), weight="w").toPandas()
    light, heavy = found[(found.source == "s") & (found.doc_id >= 200)], found[found.doc_id < 200]
    assert heavy.copies.mean() > 1.5 * light.copies.mean()


def test_draw_equals_plain_pareto_sampling(spark):
    """Sources of equal sizes, so the words to take are a number of documents: those with the smallest odds over inclusion odds."""
    r = np.random.default_rng(11)
    rows = [(i, "word " * 10, "ab"[i % 3 == 0], float(w)) for i, w in enumerate(r.choice([0, 1, 2, 5, 40], 600))]
    found = pareto_mix(spark.createDataFrame(rows, DOCS + ", w double"), weight="w", seed=7).toPandas().set_index("doc_id")
    sizes = {s: 10 * sum(x[2] == s for x in rows) for s in "ab"}
    for s, target in water(sizes).items():
        own = [(i, w) for i, _, source, w in rows if source == s]
        capped = set()
        while True:
            free = [(i, w) for i, w in own if i not in capped]
            level = (target - 30 * len(capped)) / (10 * sum(w for _, w in free))
            over = {i for i, w in free if level * w > 3}
            if not over:
                break
            capped |= over
        expected = {i: 3.0 if i in capped else level * w for i, w in own}
        ranks = []
        for i, e in expected.items():
            if chance := round(e, 12) - int(round(e, 12)):
                u = (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranks.append((u / (1 - u) / (chance / (1 - chance)), i))
        more = {i for _, i in sorted(ranks)[: int((target - 10 * sum(int(round(e, 12)) for e in expected.values()) + 5) // 10)]}
        assert {i: int(round(e, 12)) + (i in more) for i, e in expected.items()} == found.copies[[i for i, _ in own]].to_dict()


def test_mix_minds_no_names(spark):
    rows = [(i, "one two three", "s", 1, 2, 3, 4, 5) for i in range(5)] * 2 + [(8, "long " * 30000, "t", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, DOCS + ", _copies int, _key int, row int, _mix int, size int")
    mixed = mixed_documents(df, weight=length_weight)
    assert mixed.columns == df.columns and mixed.count() >= 10


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    own = found[found.held_out]
    assert len(found) == 1000 and (own.lang == own.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()


def test_languages_defined_cases(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "123 !", "en"), (4, "hello there world", "en"), (5, "bonjour tout le monde", "fr"), (7, "日本", None), (7, "x" * 200_000, None)]
    found = identify_languages(spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, lang string, lang_pred string")).toPandas()
    assert len(found) == len(rows) and set(found[found.doc_id.isin([1, 2, 3])].lang_pred) == {"und"}
    assert set(found[found.doc_id.isin([4, 5, 7])].lang_pred) <= {"en", "fr"}
    assert identify_languages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_filters_answer_for_all_languages():
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(70)]
    many = {f"l{i:03}": gram_hashes(np.frombuffer(f" letters of {n * 4} ".encode(), np.uint8), 5) for i, n in enumerate(names)}
    filters = build_filters(many)
    text = np.frombuffer(f"letters of {names[66] * 4}".encode(), np.uint8)
    counts = score_texts(filters, text, np.array([0, len(text)]))
    assert filters.languages[int(counts[0].argmax())] == "l066"


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def said(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def test_secrets_equal_brute_force(spark, sf):
    odd = ["secret: token: abcdefgh", "api_key='x' APIKEY=\"Zz/+9=._-1\" password:short", "AKIAAKIA" + "A1" * 12 + " AKIAX", "é" * 5 + "deadbeef" * 4, "token==abcdef", "passwd = \n abcdef", "SECRET" + " " * 9 + "=" + " " * 9 + "abcdef", "tokenſ: abcdefg", "0123456789abcdef01234567" * 3, "", None]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    found = {r["doc_id"]: r for r in find_secrets(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for doc, text in rows:
        spans = base_spans(text or "")
        count = Counter(k for _, k, _ in spans)
        r = found[doc]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (count[0], count[1], count[2])
        assert r["base_sha256"] == hashlib.sha256(said(spans).encode()).hexdigest()
        assert said([s for s in spans]) == ",".join(s for s in r["spans"].split(",") if s and not s.startswith("random"))
    assert find_secrets(docs.limit(0)).count() == 0


def test_random_strings_are_added_and_words_are_not(spark):
    r = np.random.default_rng(5)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    rows = [(i, "key " + "".join(r.choice(letters, 40))) for i in range(60)] + [(100 + i, "path " + "/usr/local/share/applications/of/things"[: 30 + i % 8]) for i in range(60)]
    found = {x["doc_id"]: "random" in x["spans"] for x in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] for i in range(60)) >= 50 and sum(found[100 + i] for i in range(60)) <= 6


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u", "a\r\n\r\nWARC/1.1\r\n"), (2, None, "a\r\n\r\nWARC/1.1\r\n"), (3, "u\nv", None), (4, "x", ""), (5, "y", "é"), (6, "z", "é"), (7, "w", "long " * 50_000), (None, "n", "é")]
    found = {r["page_id"]: r for r in archive_and_resolve(spark.createDataFrame(rows, PAGES)).collect()}
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    for i, _, h in rows:
        payload = (h or "").encode()
        head = max(x for x in groups[payload] if x is not None)
        r = found[i]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == head else ("revisit", head))
    path = str(tmp_path / "w")
    write_warc(warc_records(spark.createDataFrame(rows, PAGES), min_bytes=1), path, ((400, 2), (None, 1)))
    back = read_warc(spark, path).collect()
    assert sorted(r["page_id"] or "" for r in back) == sorted(str(i or "") for i, _, _ in rows)
    assert {bytes(r["payload"]) for r in back if r["record_type"] == "response"} == set(groups)
    with pytest.raises(ValueError):
        list(parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))
    assert archive_and_resolve(spark.createDataFrame([], PAGES)).count() == 0


def test_language_scores_equal_brute_force():
    """Counts by looking each n-gram of each text up in each language's set of slots, and the correction by its formula."""
    r = np.random.default_rng(2)
    texts = {"a": "die katze und der hund", "b": "the cat and the dog are here", "c": "le chat et le chien"}
    filters = build_filters({k: np.unique(np.concatenate([gram_hashes(np.frombuffer(f" {t} ".encode(), np.uint8), n) for n in (3, 5)])) for k, t in texts.items()})
    many = ["the hund", "", "x", "le cat and le dog", "katze " * 30, "".join(r.choice(list("abcdehilnt "), 300))]
    data = [t.encode() for t in many]
    scored = score_texts(filters, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for t, got in zip(many, scored, strict=True):
        body = np.frombuffer(f" {t} ".encode(), np.uint8)
        for i, wrong in enumerate(filters.wrong):
            hits = looked = 0
            for n in (3, 5):
                for h in gram_hashes(body, n).tolist():
                    looked += 1
                    slots = [(h >> (64 - filters.bits - j * ((64 - filters.bits) // 3))) & ((1 << filters.bits) - 1) for j in range(3)]
                    hits += all(filters.slots[0][s] >> i & 1 for s in slots)
            assert got[i] == pytest.approx(max(0.0, (hits - looked * wrong) / (1 - wrong)))


def test_long_texts_are_scored_in_pieces(monkeypatch):
    from kinsift.llm import langid

    filters = build_filters({"a": gram_hashes(np.frombuffer(b" some letters of a ", np.uint8), 3), "b": gram_hashes(np.frombuffer(b" others in b ", np.uint8), 5)})
    data = np.frombuffer(b"some others of a letter in b and others " * 50, np.uint8)
    whole = score_texts(filters, data, np.array([0, len(data)]))
    monkeypatch.setattr(langid, "LOOKED_UP", 37)
    assert (score_texts(filters, data, np.array([0, len(data)])) == whole).all() and whole.sum() > 0


def test_fit_equals_counting_by_hand(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("ab cd", "x"), ("ab zz", "x"), ("cd cd", "y"), ("qq", "y"), (None, "x"), ("ab", None), ("", "z")])]
    filters = fit_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least=0.5, share=0.9)
    grams = lambda t: {h for n in (3, 5) for h in gram_hashes(np.frombuffer(f" {t} ".encode(), np.uint8), n).tolist()}
    rates = {"x": Counter(), "y": Counter(), "z": Counter()}
    texts = Counter(lang for _, t, lang in rows if t is not None and lang)
    for _, t, lang in rows:
        if t is not None and lang:
            rates[lang].update(grams(t))
    want = {lang: np.array(sorted(g for g, n in c.items() if n / texts[lang] >= 0.5 and n / texts[lang] >= 0.9 * max(rates[k][g] / texts[k] for k in rates)), np.uint64) for lang, c in rates.items()}
    made = build_filters(want)
    assert made.languages == filters.languages and all((a == b).all() for a, b in zip(made.slots, filters.slots, strict=True))


def test_archives_with_clashing_names_and_repeated_ids(spark):
    rows = [(7, "u", "one payload " * 9, 1), (7, "u", "one payload " * 9, 1), (7, "v", "one payload " * 9, 1), (3, "w", "one payload " * 9, 1), (2, None, "x" * 300_000, 1)]
    found = archive_and_resolve(spark.createDataFrame(rows, PAGES + ", digest int")).toPandas()
    assert len(found) == 5 and sorted(found[found.record_type == "revisit"].page_id) == [3] and set(found.refers_to.dropna()) == {7}


def test_secrets_of_repeated_rows_long_texts_and_clashing_names(spark):
    """A text with very many matches takes time in proportion; repeated ids are documents of their own."""
    text = "é token=abcdef0123 and deadbeefdeadbeefdeadbeef; " * 8000
    rows = [(1, text, "x", 1), (1, "token=abcdef0123", "x", 1), (1, "token=abcdef0123", "x", 1), (None, "secret: zzzzzzz", "x", 1)]
    began = time.time()
    found = find_secrets(spark.createDataFrame(rows, "doc_id long, text string, base string, found int")).collect()
    assert time.time() - began < 60 and len(found) == 4
    assert sorted((r["n_assign"], r["n_hex"]) for r in found) == [(1, 0)] * 3 + [(8000, 8000)]
    long = max(found, key=lambda r: r["n_hex"])
    assert long["base_sha256"] == hashlib.sha256(said(base_spans(text)).encode()).hexdigest()


SYMBOLS = {"decimal": "0-9", "hex": "0-9a-f", "HEX": "0-9A-F", "lower": "a-z", "upper": "A-Z", "base32": "A-Z2-7", "base62": "A-Za-z0-9", "base64": "A-Za-z0-9+/", "base64url": "A-Za-z0-9_-", "mixed": "A-Za-z0-9+/_-"}


def battery_by_hand(value):
    """(class, p) from the tests' textbook formulas."""
    name = next(k for k, cls in SYMBOLS.items() if re.fullmatch(f"[{cls}]+", value))
    alphabet = ALPHABETS[name]
    x, k, n = np.array([alphabet.index(c) for c in value], float), len(alphabet), len(value)
    counts = np.bincount(x.astype(int), minlength=k)
    chi = ((counts - n / k) ** 2 / (n / k)).sum()
    uniform = (chi - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    high = 2 * x >= k
    runs, ones = 1 + (high[1:] != high[:-1]).sum(), high.sum()
    mu = 2 * ones * (n - ones) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    z_runs = (runs - mu) / np.sqrt(var) if var > 0 else 40.0
    d = x - x.mean()
    serial = ((d[1:] * d[:-1]).sum() / (d * d).sum() if (d * d).sum() else 1.0) + 1 / n
    tail = lambda z: min(1.0, max(1e-12, 1 / (1 + np.exp(np.clip(1.5976 * z + 0.07056 * z**3, -700, 700)))))
    p = [tail(uniform), min(1.0, 2 * tail(abs(z_runs))), min(1.0, 2 * tail(abs(serial) * np.sqrt(n)))]
    half = -np.log(p).sum()
    return f"{name}/{int(np.log2(n))}", np.exp(-half) * (1 + half + half * half / 2)


def test_battery_equals_textbook_formulas(spark):
    r = np.random.default_rng(8)
    values = ["".join(r.choice(list(ALPHABETS[k]), n)) for k in ALPHABETS for n in (20, 33, 90)] + ["a" * 24, "0123456789" * 4, "abababababababababababab", "usr-local-share-of-things", "AAAAAAAAAAAAAAAAAAAAAAAAZ"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string").selectExpr("id", "array(named_struct('start', 3, 'finish', 3 + char_length(value), 'value', value)) as c")
    found = {x["id"]: x["b"][0] for x in rows.selectExpr("id", f"{_battery('c')} as b").collect()}
    for i, v in enumerate(values):
        name, p = battery_by_hand(v)
        assert found[i]["class_name"] == name and found[i]["p"] == pytest.approx(p, rel=1e-6, abs=1e-12), v
        assert (found[i]["start"], found[i]["finish"]) == (3, 3 + len(v))


def test_cuts_equal_the_rule_by_hand(spark):
    r = np.random.default_rng(9)
    p = {"hex/5": np.concatenate([r.random(300), r.random(700) * 0.02]), "lower/4": r.random(40) * 0.05, "base62/5": r.random(500)}
    rows = [([{"class_name": k, "p": float(x)} for x in v],) for k, v in p.items()]
    least = cuts(spark.createDataFrame(rows, "candidates array<struct<class_name:string,p:double>>"), 0.1)
    want = {}
    for k, v in p.items():
        bins = np.minimum((v * 100).astype(int), 99)
        random = 2 * (bins >= 50).sum()
        for b in range(1, 100):
            above = (bins >= b).sum()
            if above and 1 - random * (1 - b / 100) / above <= 0.1:
                want[k] = b / 100
                break
    assert least == want and 0 < want["hex/5"] < 0.2
