"""The registered queries: an operator each over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions import geometry as geo
from kinsift.functions import scalars as sc
from kinsift.operators import containment, decide, evaluate, exact, graph, retrieval, vectors, verdicts
from kinsift.operators.components import connected_components
from kinsift.plans.lineage import materialize
from kinsift.sources import headers, listing
from kinsift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS = r"unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def joined(array: str | Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


# ---- exact copies


def hashed_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", exact.content_hash(F.col("text")).alias("hash"))


@query("SELECT sha256(text) AS hash, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_sets(spark, d):
    return exact.exact_sets(hashed_documents(spark, d).select("doc_id", "hash"), "doc_id").select("hash", "n", joined("members").alias("members"))


@query("SELECT doc_id, strlen(text) AS length, count(*) OVER (PARTITION BY strlen(text)) AS n_length FROM documents QUALIFY n_length > 1")
def length_prefilter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))
    return exact.shared_lengths(docs, F.col("bytes")).select("doc_id", "length", "n_length")


@query("""
    WITH h AS (SELECT doc_id, strlen(text) AS n, hex(encode(text)) AS x FROM documents),
    s AS (SELECT doc_id, n, substr(x, 1, 128) AS p, substr(x, 2 * greatest(0, (n - 64) // 2) + 1, 128) AS q, substr(x, 2 * greatest(0, n - 64) + 1, 128) AS r FROM h)
    SELECT doc_id, count(*) OVER (PARTITION BY n, p, q, r) AS n_sample FROM s QUALIFY n_sample > 1
""")
def sample_prefilter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    close = exact.shared_lengths(docs, F.octet_length("text"))
    return exact.shared_samples(close, exact.content_sample(F.col("text"), 64)).select("doc_id", "n_sample")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS head FROM documents")
def byte_heads(spark, d):
    docs = hashed_documents(spark, d).select("doc_id", "hash")
    return exact.heads(docs, "doc_id", F.col("hash")).select("doc_id", "head")


@query("SELECT h AS a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS h FROM documents) WHERE h <> doc_id")
def identical_pairs(spark, d):
    return exact.identical_pairs(byte_heads(spark, d), "doc_id", "head")


@query("SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id")
def identical_set_pairs(spark, d):
    return exact.all_identical_pairs(exact.exact_sets(hashed_documents(spark, d).select("doc_id", "hash"), "doc_id"))


NORMAL = r"lower(regexp_replace(trim(text), '[\x20\x09-\x0D]+', ' ', 'g'))"


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {NORMAL}) AS head FROM documents")
def analysis_heads(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    key = exact.content_hash(F.lower(F.regexp_replace(F.trim("text"), r"[\x20\x09-\x0D]+", " ")))
    return exact.heads(docs, "doc_id", key).select("doc_id", "head")


@query("""
    WITH h AS (SELECT doc_id, n_chars, min(doc_id) OVER (PARTITION BY text) AS head FROM documents),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b FROM h x JOIN h y ON x.n_chars = y.n_chars AND x.doc_id < y.doc_id AND x.head = x.doc_id AND y.head = y.doc_id)
    SELECT least(x.doc_id, y.doc_id) AS a, greatest(x.doc_id, y.doc_id) AS b, x.doc_id > y.doc_id AS flipped
    FROM c JOIN h x ON x.head = c.a JOIN h y ON y.head = c.b WHERE x.doc_id <> y.doc_id
""")
def expand_claims(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", exact.content_hash(F.col("text")).alias("hash"))
    classes = exact.heads(docs, "doc_id", F.col("hash")).select("doc_id", "n_chars", "head")
    own = classes.filter("head = doc_id")
    claims = own.select(F.col("doc_id").alias("a"), "n_chars").join(own.select(F.col("doc_id").alias("b"), "n_chars"), "n_chars").filter("a < b").select("a", "b")
    return exact.expand_claims(claims, classes, "doc_id", "head", [])


@query("SELECT min_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order, l_suppkey AS a, l_partkey AS b, count(*) AS stated FROM lineitem GROUP BY l_suppkey, l_partkey")
def first_stated(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 10_000_000).alias("b"), "l_shipdate", "l_orderkey", "l_linenumber")
    stated = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("stated"))
    first = exact.first_stated(rows, "a", "b", ["l_shipdate", "l_orderkey", "l_linenumber"]).select("a", "b", F.col("l_orderkey").alias("first_order"))
    return first.join(stated, ["a", "b"]).select("first_order", "a", (F.col("b") - 10_000_000).alias("b"), "stated")


@query("""
    SELECT l_partkey AS item, l_linenumber % 4 AS standing, l_quantity AS n_in, l_orderkey AS step FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 4 DESC, l_quantity DESC, l_orderkey, l_linenumber) = 1
""")
def best_merge(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_linenumber") % 4).alias("standing"), F.col("l_quantity").alias("n_in"), F.col("l_orderkey").alias("step"), F.struct("l_orderkey", "l_linenumber").alias("order"))
    return exact.best_of(rows, ["item"], order="order").drop("order")


@query("SELECT c_custkey, rank() OVER (ORDER BY c_mktsegment) - 1 AS name_rank FROM customer")
def name_rank(spark, d):
    return exact.name_ranks(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "name_rank")


@query()
def colour_heads(spark, d):
    parts = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 100).alias("colour"))
    return exact.colour_heads(parts, "p_brand", "p_partkey", "colour")


# ---- retrieval

TF = f"""
    tf AS (SELECT item, word, count(*) AS tf FROM (SELECT doc_id AS item, {WORDS} AS word FROM documents) GROUP BY ALL),
    idf AS (SELECT word, count(*) AS df, ln((SELECT count(DISTINCT item) FROM tf) / count(*)) AS idf FROM tf GROUP BY word),
    qtf AS (SELECT item, word, count(*) AS tf FROM (SELECT item_id AS item, {WORDS} AS word FROM benchmark) GROUP BY ALL)
"""
SELF = TF + """,
    mass AS (SELECT item, sum(tf * idf * idf) AS mass FROM tf JOIN idf USING (word) GROUP BY item),
    scored AS (SELECT q.item AS q, d.item AS d, round(sum(least(q.tf, d.tf) * idf * idf) / any_value(m.mass), 6) AS score
        FROM tf q JOIN idf USING (word) JOIN tf d USING (word) JOIN mass m ON m.item = q.item
        WHERE q.item <> d.item AND idf > 0 GROUP BY 1, 2)
"""
ASKED = TF + """,
    mass AS (SELECT item, sum(tf * idf * idf) AS mass FROM qtf JOIN idf USING (word) GROUP BY item),
    dmass AS (SELECT item, sum(tf * idf * idf) AS mass FROM tf JOIN idf USING (word) GROUP BY item),
    raw AS (SELECT -1 - q.item AS q, d.item AS d, sum(least(q.tf, d.tf) * idf * idf) / any_value(m.mass) AS score
        FROM qtf q JOIN idf USING (word) JOIN tf d USING (word) JOIN mass m ON m.item = q.item WHERE idf > 0 GROUP BY 1, 2),
    ranked AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rn FROM (SELECT q, d, round(score, 6) AS score FROM raw))
"""


class Corpus:
    """Term tables of the documents, and of the benchmark's passages as items -1, -2, ...; each is computed once."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.postings = retrieval.text_postings(table(spark, d, "documents"), "doc_id")
        self.tf = materialize(retrieval.term_counts(self.postings), "tf")
        self.frequency = materialize(retrieval.document_frequency(self.tf), "df")
        self.weighted = retrieval.weigh(self.tf, self.frequency)

    def asking(self, words: Column | None = None) -> DataFrame:
        passages = table(self.spark, self.d, "benchmark").select((-1 - F.col("item_id")).alias("item_id"), "text")
        postings = retrieval.text_postings(passages, "item_id")
        if words is not None:
            postings = postings.withColumn("word", words)
        return retrieval.weigh(retrieval.term_counts(postings), self.frequency)

    def asked_postings(self) -> DataFrame:
        passages = table(self.spark, self.d, "benchmark").select((-1 - F.col("item_id")).alias("item_id"), "text")
        return retrieval.text_postings(passages, "item_id")


@query(f"SELECT item, word, count(*) AS tf FROM (SELECT item_id AS item, {WORDS} AS word FROM benchmark) GROUP BY ALL")
def term_runs(spark, d):
    return retrieval.term_counts(retrieval.text_postings(table(spark, d, "benchmark"), "item_id"))


@query(f"WITH {TF} SELECT word, df, round(idf, 6) AS idf FROM idf")
def document_frequency(spark, d):
    return Corpus(spark, d).frequency.select("word", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {TF} SELECT item, round(sum(tf * idf * idf), 4) AS mass FROM tf JOIN idf USING (word) GROUP BY item")
def idf_mass(spark, d):
    return retrieval.idf_mass(Corpus(spark, d).weighted).select("item", F.round("mass", 4).alias("mass"))


@query(f"WITH {ASKED} SELECT q, d, score, rn FROM ranked WHERE rn <= 5")
def containment_topk(spark, d):
    c = Corpus(spark, d)
    return retrieval.top(retrieval.containment(c.asking(), c.tf), 5)


@query(f"WITH {ASKED} SELECT q, d, score, rn FROM ranked WHERE rn BETWEEN 6 AND 10")
def ranking_page(spark, d):
    c = Corpus(spark, d)
    return retrieval.page(retrieval.rank(retrieval.containment(c.asking(), c.tf)), 5, 5)


def document_containment(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents of which one has half or more of the other's mass, between the heads of classes, and the classes."""
    return containment.text_containment(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", 0.5)


@query(f"WITH {SELF} SELECT q, d, score FROM scored WHERE score >= 0.5")
def containment_pairs(spark, d):
    return containment.spelt_out(*document_containment(spark, d)).select("q", "d", F.round("score", 6).alias("score"))


@query(f"""WITH {ASKED}, two AS (SELECT q, d, round(greatest(score, score * m.mass / dm.mass), 6) AS score FROM raw JOIN mass m ON m.item = -1 - q JOIN dmass dm ON dm.item = d)
    SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rn FROM two QUALIFY rn <= 5""")
def both_ways_topk(spark, d):
    c = Corpus(spark, d)
    asking = c.asking()
    both = retrieval.both_ways(retrieval.containment(asking, c.tf), retrieval.idf_mass(asking), retrieval.idf_mass(c.weighted))
    return retrieval.top(both, 5)


@query(f"""WITH {TF}, v AS (SELECT item, word, 'plain' AS variant, tf FROM qtf UNION ALL SELECT item, reverse(word), 'turned', sum(tf) FROM qtf GROUP BY ALL),
    mass AS (SELECT item, variant, sum(tf * idf * idf) AS mass FROM v JOIN idf USING (word) GROUP BY ALL),
    s AS (SELECT -1 - v.item AS q, d.item AS d, v.variant, round(sum(least(v.tf, d.tf) * idf * idf) / any_value(m.mass), 6) AS score
        FROM v JOIN idf USING (word) JOIN tf d USING (word) JOIN mass m ON m.item = v.item AND m.variant = v.variant WHERE idf > 0 GROUP BY ALL),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q, d ORDER BY score DESC, variant) = 1)
    SELECT q, d, variant, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rn FROM b QUALIFY rn <= 5""")
def variant_merge_topk(spark, d):
    c = Corpus(spark, d)
    found = None
    for variant, words in (("plain", None), ("turned", F.reverse("word"))):
        scored = retrieval.containment(c.asking(words), c.tf).select("q", "d", F.round("score", 6).alias("score"), F.lit(variant).alias("variant"))
        found = scored if found is None else found.unionByName(scored)
    return retrieval.top(retrieval.best_variant(found), 5).select("q", "d", "variant", "score", "rn")


PEAKS = ASKED + f""",
    dpos AS (SELECT doc_id AS item, word, min(position) AS position FROM (SELECT doc_id, {WORDS} AS word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) - 1 AS position FROM documents) GROUP BY ALL),
    qpos AS (SELECT -1 - item_id AS item, word, min(position) AS position FROM (SELECT item_id, {WORDS} AS word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) - 1 AS position FROM benchmark) GROUP BY ALL),
    bins AS (SELECT r.q, r.d, floor((p.position - o.position) / 8) AS bin, count(DISTINCT o.position) AS n
        FROM ranked r JOIN qpos o ON o.item = r.q JOIN dpos p ON p.item = r.d AND p.word = o.word WHERE r.rn <= 50 GROUP BY ALL),
    peaks AS (SELECT q, d, max(n) AS peak FROM bins GROUP BY ALL)
"""


def _peaks(c: Corpus) -> tuple[DataFrame, DataFrame]:
    ranked = materialize(retrieval.rank(retrieval.containment(c.asking(), c.tf)).filter("rn <= 50"), "ranked")
    bins = [F.floor((F.col("position_d") - F.col("position_q")) / 8)]
    return ranked, retrieval.peaks(ranked, retrieval.best_positions(c.asked_postings()), retrieval.best_positions(c.postings), bins)


@query(f"WITH {PEAKS} SELECT q, d, peak FROM peaks")
def geometric_peak(spark, d):
    return _peaks(Corpus(spark, d))[1]


@query(f"""WITH {PEAKS}, w AS (SELECT r.q, r.d, r.score, r.rn, p.peak FROM ranked r JOIN peaks p USING (q, d)),
    z AS (SELECT q, max(peak) AS null_peak FROM w WHERE rn <= 1 GROUP BY q)
    SELECT w.q, w.d, w.score, w.rn, w.peak FROM w LEFT JOIN z USING (q) WHERE rn > 1 AND peak >= 3 AND peak > coalesce(null_peak, 0)""")
def deeper_candidates(spark, d):
    ranked, peak = _peaks(Corpus(spark, d))
    return retrieval.deeper(ranked, peak, 1, 50)


@query("""
    WITH tf AS (SELECT n_nationkey AS item, unnest(['nation', 'region' || n_regionkey]) AS word FROM nation),
    idf AS (SELECT word, ln(25.0 / count(*)) AS idf FROM tf GROUP BY word),
    m AS (SELECT item, sum(idf * idf) AS mass FROM tf JOIN idf USING (word) GROUP BY item)
    SELECT q.item AS q, d.item AS d, round(sum(idf * idf) / any_value(mass), 6) AS score FROM tf q JOIN idf USING (word) JOIN tf d USING (word) JOIN m ON m.item = q.item WHERE q.item <> d.item GROUP BY 1, 2
""")
def touched_candidates(spark, d):
    words = F.array(F.lit("nation"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")))
    tf = retrieval.term_counts(table(spark, d, "nation").select(F.col("n_nationkey").alias("item"), F.explode(words).alias("word")))
    weighted = retrieval.weigh(tf, retrieval.document_frequency(tf))
    return retrieval.containment(weighted, tf, keep_zero=True).select("q", "d", F.round("score", 6).alias("score"))


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, greatest(1, ceil(count(*) OVER (PARTITION BY label) / 10)) AS step FROM embeddings) WHERE i % step = 0")
def stride_sample(spark, d):
    return retrieval.stride_sample(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 10)


@query("""
    WITH RECURSIVE e AS (SELECT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem), n AS (SELECT a AS f, b AS t FROM e UNION SELECT b, a FROM e)
    SELECT DISTINCT t AS item FROM n WHERE f IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND t >= 1000000 AND t NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
""")
def reached_library(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (1_000_000 + F.col("l_partkey")).alias("b"))
    asked = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("item"))
    library = table(spark, d, "part").select((1_000_000 + F.col("p_partkey")).alias("item"))
    return retrieval.reached(edges, asked, library)


@query("""SELECT x.o_orderkey AS q, y.o_orderkey AS d FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey
    WHERE NOT (x.o_orderpriority = y.o_orderpriority)""")
def undecided_candidates(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    pairs = o.select("o_custkey", F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("p")).join(o.select("o_custkey", F.col("o_orderkey").alias("d"), F.col("o_orderpriority").alias("r")), "o_custkey").filter("q < d")
    decided = pairs.filter("p = r").select(F.col("d").alias("a"), F.col("q").alias("b"))
    return retrieval.undecided(pairs.select("q", "d"), decided)


# ---- vectors

D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
PROBES = f"""near AS (SELECT v.vec_id AS item, c.vec_id AS word, round({D2.format('v.embedding', 'c.embedding')}, 6) AS d2 FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % (SELECT ceil(sqrt(count(*)))::BIGINT FROM embeddings) = 0) c),
    placed AS (SELECT item, word, d2, row_number() OVER (PARTITION BY item ORDER BY d2, word) - 1 AS path, min(d2) OVER (PARTITION BY item) AS least FROM near),
    probes AS (SELECT item, word, d2, path FROM placed WHERE path < 3 AND d2 <= least * 1.3)"""


def _probes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    items = e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    # the vocabulary: every n-th vector of n * n, so words and the items of a word both grow as the root of all
    step = math.ceil(math.sqrt(max(1, e.count())))
    return items, vectors.probes(items, items.filter(F.col("item") % step == 0).select(F.col("item").alias("word"), "v"))


@query(f"WITH {PROBES} SELECT item, word, d2 FROM probes WHERE path = 0")
def vector_quantise(spark, d):
    return _probes(spark, d)[1].filter("path = 0").select("item", "word", "d2")


@query(f"WITH {PROBES} SELECT item, word, d2, path FROM probes")
def vector_multiprobe(spark, d):
    return _probes(spark, d)[1]


@query(f"""WITH {PROBES}, idf AS (SELECT word, ln((SELECT count(DISTINCT item) FROM probes) / count(*)) AS idf FROM probes GROUP BY word),
    m AS (SELECT item, sum(idf * idf) AS mass FROM probes JOIN idf USING (word) GROUP BY item),
    s AS (SELECT q.item AS q, d.item AS d, round(sum(idf * idf) / any_value(mass), 6) AS score FROM probes q JOIN idf USING (word) JOIN probes d USING (word) JOIN m ON m.item = q.item WHERE q.item <> d.item AND idf > 0 GROUP BY 1, 2)
    SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rn FROM s QUALIFY rn <= 3""")
def vector_postings_topk(spark, d):
    tf = materialize(_probes(spark, d)[1].select("item", "word", F.lit(1).cast("bigint").alias("tf")), "probes")
    weighted = retrieval.weigh(tf, retrieval.document_frequency(tf))
    return retrieval.top_of_sets(weighted, 3)


@query(f"""WITH {PROBES}, w AS (SELECT p.item, p.word, e.embedding FROM probes p JOIN embeddings e ON e.vec_id = p.item WHERE path = 0),
    x AS (SELECT a.item, a.word, b.item AS nearest, round({D2.format('a.embedding', 'b.embedding')}, 6) AS d2 FROM w a JOIN w b ON a.word = b.word AND a.item <> b.item)
    SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY item, word ORDER BY d2, nearest) = 1""")
def nearest_in_word(spark, d):
    items, probes = _probes(spark, d)
    return vectors.nearest_in_word(items, probes.filter("path = 0"))


@query("""WITH l AS (SELECT s_suppkey AS a, s_acctbal / 10 AS x, (s_suppkey % 97)::DOUBLE AS y FROM supplier), r AS (SELECT c_custkey AS b, c_acctbal / 10 AS x, (c_custkey % 89)::DOUBLE AS y FROM customer),
    m AS (SELECT a, b, round((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y), 6) AS d2 FROM l, r WHERE (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) <= 144)
    SELECT a, b, d2 FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2, b) = 1""")
def guided_band_match(spark, d):
    left = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_suppkey") % 97).cast("double").alias("y"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("b"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 89).cast("double").alias("y"))
    return vectors.band_matches(left, right, 12.0)


# ---- geometry

MAPS = """m AS (SELECT p_partkey, 0.5 + (p_partkey % 7) / 4.0 AS m0, (p_partkey % 5 - 2) / 8.0 AS m1, (p_partkey % 31)::DOUBLE AS m2,
    (p_partkey % 3 - 1) / 4.0 AS m3, 0.75 + (p_partkey % 11) / 8.0 AS m4, (p_partkey % 17)::DOUBLE AS m5,
    (100 + p_size)::DOUBLE AS aw, 80.0::DOUBLE AS ah, 120.0::DOUBLE AS bw, (60 + p_size)::DOUBLE AS bh FROM part)"""


def maps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", (0.5 + (k % 7) / 4.0).alias("m0"), ((k % 5 - 2) / 8.0).alias("m1"), (k % 31).cast("double").alias("m2"), ((k % 3 - 1) / 4.0).alias("m3"), (0.75 + (k % 11) / 8.0).alias("m4"),
        (k % 17).cast("double").alias("m5"), (100 + size).alias("aw"), F.lit(80.0).alias("ah"), F.lit(120.0).alias("bw"), (60 + size).alias("bh"),
    )


@query(f"""WITH {MAPS}, t AS (SELECT *, m0 * m4 - m1 * m3 AS det FROM m)
    SELECT p_partkey, round(det, 6) AS det, round(sqrt(abs(det)), 6) AS scale, det < 0 AS mirrored, round(m4 / det, 6) AS i0, round((m1 * m5 - m4 * m2) / det, 6) + 0.0 AS i2,
    round(m0 * m0 + m1 * m3, 6) AS c0, round(m0 * m2 + m1 * m5 + m2, 6) AS c2, round(m3 * m2 + m4 * m5 + m5, 6) AS c5 FROM t""")
def affine_algebra(spark, d):
    m = geo.affine()
    back, twice = geo.inverse(m), geo.compose(m, m)
    r = lambda c: F.round(c, 6) + 0.0
    return maps(spark, d).select("p_partkey", r(geo.determinant(m)).alias("det"), r(geo.linear_scale(m)).alias("scale"), geo.mirrored(m).alias("mirrored"), r(back[0]).alias("i0"), r(back[2]).alias("i2"), r(twice[0]).alias("c0"), r(twice[2]).alias("c2"), r(twice[5]).alias("c5"))


@query(f"""WITH {MAPS}, t AS (SELECT p_partkey, m0 * m0 + m1 * m1 + m3 * m3 + m4 * m4 AS s, m0 * m4 - m1 * m3 AS det FROM m), u AS (SELECT *, sqrt(greatest(0, s * s - 4 * det * det)) AS r FROM t)
    SELECT p_partkey, round(sqrt(greatest(0, (s - r) / 2)), 6) AS least, round(sqrt((s + r) / 2), 6) AS most FROM u""")
def axis_scales(spark, d):
    least, most = geo.axis_scales(geo.affine())
    return maps(spark, d).select("p_partkey", F.round(least, 6).alias("least"), F.round(most, 6).alias("most"))


@query(f"""WITH {MAPS}, g AS (SELECT i % 16 AS gx, i // 16 AS gy FROM range(256) t(i)),
    p AS (SELECT p_partkey, m0 * (gx + 0.5) / 16 * aw + m1 * (gy + 0.5) / 16 * ah + m2 AS u, m3 * (gx + 0.5) / 16 * aw + m4 * (gy + 0.5) / 16 * ah + m5 AS v, bw, bh FROM m, g)
    SELECT p_partkey, round(sum(CASE WHEN u >= 0 AND u < bw AND v >= 0 AND v < bh THEN 1 ELSE 0 END) / 256.0, 2) AS ov_a FROM p GROUP BY 1""")
def frame_overlap(spark, d):
    share, _ = geo.overlap(geo.affine(), F.col("aw"), F.col("ah"), F.col("bw"), F.col("bh"))
    return maps(spark, d).select("p_partkey", F.round(share, 2).alias("ov_a"))


@query(f"""WITH {MAPS}, c AS (SELECT p_partkey, unnest([[0, 0], [1, 0], [0, 1], [1, 1]]) AS k, * EXCLUDE (p_partkey) FROM m)
    SELECT p_partkey, bool_and(sqrt((m0 * k[1] * aw + m1 * k[2] * ah + m2 - k[1] * bw) ** 2 + (m3 * k[1] * aw + m4 * k[2] * ah + m5 - k[2] * bh) ** 2) <= 40) AS meets,
    round(max(greatest(0, -(m0 * k[1] * aw + m1 * k[2] * ah + m2) / bw, (m0 * k[1] * aw + m1 * k[2] * ah + m2 - bw) / bw, -(m3 * k[1] * aw + m4 * k[2] * ah + m5) / bh, (m3 * k[1] * aw + m4 * k[2] * ah + m5 - bh) / bh)), 6) AS out_by
    FROM c GROUP BY 1""")
def frame_on_frame(spark, d):
    m, sides = geo.affine(), (F.col("aw"), F.col("ah"), F.col("bw"), F.col("bh"))
    return maps(spark, d).select("p_partkey", geo.frame_on_frame(m, *sides, F.lit(40.0)).alias("meets"), F.round(geo.overshoot(m, *sides), 6).alias("out_by"))


@query(f"WITH {MAPS} SELECT p_partkey, round(m0 * aw / bw, 4) AS f0, round(m1 * ah / bw, 4) AS f1, round(m2 / bw, 4) AS f2, round(m3 * aw / bh, 4) AS f3, round(m4 * ah / bh, 4) AS f4, round(m5 / bh, 4) AS f5 FROM m")
def fraction_place(spark, d):
    place = geo.fraction_place(geo.affine(), F.col("aw"), F.col("ah"), F.col("bw"), F.col("bh"))
    return maps(spark, d).select("p_partkey", *[p.alias(f"f{i}") for i, p in enumerate(place)])


@query("""
    WITH s AS (SELECT l_suppkey, count(*)::DOUBLE AS n, sum(l_quantity) AS sx, sum(l_discount * 100) AS sy, sum(l_extendedprice) AS su, sum(l_quantity * l_quantity) AS qq, sum(l_quantity * l_discount * 100) AS qd,
        sum(l_discount * 100 * l_discount * 100) AS dd, sum(l_quantity * l_extendedprice) AS qu, sum(l_discount * 100 * l_extendedprice) AS du FROM lineitem GROUP BY 1),
    t AS (SELECT *, qq - sx * sx / n AS xx, qd - sx * sy / n AS xy, dd - sy * sy / n AS yy, qu - sx * su / n AS xu, du - sy * su / n AS yu FROM s)
    SELECT l_suppkey, round((xu * yy - yu * xy) / (xx * yy - xy * xy), 2) AS per_quantity, round((yu * xx - xu * xy) / (xx * yy - xy * xy), 2) AS per_discount FROM t
""")
def least_squares_affine(spark, d):
    a, b, _ = geo.least_squares(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(a, 2).alias("per_quantity"), F.round(b, 2).alias("per_discount"))


@query("SELECT l_orderkey, l_linenumber, (floor((((l_quantity * 17.3) % 360 + 360) % 360) / 22.5))::INT AS angle_bin, floor(log2(l_quantity) * 4 + 64)::INT AS scale_bin FROM lineitem")
def shape_bins(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geo.angle_bin(F.col("l_quantity") * 17.3).alias("angle_bin"), geo.scale_bin(F.col("l_quantity")).alias("scale_bin"))


# ---- verdicts

CLAIMS = """v AS (SELECT l_orderkey, l_linenumber, (l_quantity % 12)::INT AS n_in, 0.5 + l_tax * 6 AS ov_a, 0.4 + l_discount * 5 AS ov_b, 0.5 + l_discount * 5 AS blk, 0.7 + l_tax * 4 AS blk_min,
    l_returnflag <> 'R' AS centred, l_linestatus = 'O' AS framed, 0.25 + l_linenumber AS k FROM lineitem)"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    k = 0.25 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") % 12).cast("int").alias("n_in"), (0.5 + F.col("l_tax") * 6).alias("ov_a"), (0.4 + F.col("l_discount") * 5).alias("ov_b"), (0.5 + F.col("l_discount") * 5).alias("blk"),
        (0.7 + F.col("l_tax") * 4).alias("blk_min"), (F.col("l_returnflag") != "R").alias("centred"), (F.col("l_linestatus") == "O").alias("framed"),
        (4 * k).alias("m0"), F.lit(0.0).alias("m1"), F.lit(3.0).alias("m2"), F.lit(0.0).alias("m3"), k.alias("m4"), F.lit(1.0).alias("m5"),
    )


FRAMED = "(4 * k <= 16 AND k >= 0.0625 AND greatest(ov_a, ov_b) >= 0.85)"


@query(f"""WITH {CLAIMS} SELECT l_orderkey, l_linenumber, CASE WHEN NOT {FRAMED} OR NOT (n_in >= 5 OR (framed AND n_in >= 3 AND blk_min >= 0.9)) THEN 0
    WHEN n_in >= 5 AND centred AND blk >= 0.65 AND blk_min >= 0.9 THEN 3 WHEN centred AND blk >= 0.65 THEN 2 WHEN blk >= 0.65 - 0.1 THEN 1 ELSE 0 END AS standing FROM v""")
def standing_ladder(spark, d):
    return claims(spark, d).select("l_orderkey", "l_linenumber", verdicts.standing().alias("standing"))


@query(f"WITH {CLAIMS} SELECT l_orderkey, l_linenumber FROM v WHERE {FRAMED} AND blk >= 0.65")
def composed_filter(spark, d):
    return claims(spark, d).filter(verdicts.composed()).select("l_orderkey", "l_linenumber")


@query("""
    WITH m AS (SELECT l_suppkey, l_linenumber, count(*)::DOUBLE AS n, sum(l_quantity) AS sa, sum(l_extendedprice / 1000) AS sb, sum(l_quantity ** 2) AS aa, sum((l_extendedprice / 1000) ** 2) AS bb, sum(l_quantity * l_extendedprice / 1000) AS ab FROM lineitem GROUP BY ALL),
    s AS (SELECT *, aa / n - sa / n * sa / n AS va, bb / n - sb / n * sb / n AS vb, ab / n - sa / n * sb / n AS c FROM m),
    r AS (SELECT l_suppkey, CASE WHEN va < 16 AND vb < 16 THEN NULL WHEN va < 16 OR vb < 16 THEN 2 * abs(c) / (va + vb) ELSE abs(c) / sqrt(va * vb) END AS r FROM s)
    SELECT l_suppkey, round(coalesce(avg(r), 0), 6) AS blk, count(r) AS blk_n, round(coalesce(min(r), 0), 6) AS blk_min FROM r GROUP BY l_suppkey
""")
def block_correlation(spark, d):
    samples = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    return verdicts.block_correlation(samples, ["l_suppkey"], "l_linenumber").select("l_suppkey", F.round("blk", 6).alias("blk"), "blk_n", F.round("blk_min", 6).alias("blk_min"))


@query(f"""WITH {MAPS} SELECT p_partkey AS b, p_partkey + 1 AS a, round(m4 / (m0 * m4 - m1 * m3), 6) AS m0, round(-m1 / (m0 * m4 - m1 * m3), 6) + 0.0 AS m1, ah AS ov_a, aw AS ov_b, round(1 / bh, 6) AS lo, round(1 / bw, 6) AS hi, round(1 / sqrt(abs(m0 * m4 - m1 * m3)), 6) AS scale FROM m WHERE abs(m0 * m4 - m1 * m3) >= 1e-12""")
def reversed_verdicts(spark, d):
    rows = maps(spark, d).select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), *[f"m{i}" for i in range(6)], F.col("aw").alias("ov_a"), F.col("ah").alias("ov_b"), F.col("bw").alias("lo"), F.col("bh").alias("hi"), F.lit(0.0).alias("scale"))
    return verdicts.reversed_verdict(rows).select("a", "b", F.round("m0", 6).alias("m0"), (F.round("m1", 6) + 0.0).alias("m1"), "ov_a", "ov_b", *(F.round(c, 6).alias(c) for c in ("lo", "hi", "scale")))


@query(f"""WITH {CLAIMS} SELECT l_orderkey, l_linenumber, {FRAMED} AND (n_in >= 5 OR (framed AND n_in >= 3)) AS gate, NOT (l_linenumber % 3 = 0 AND l_linenumber % 2 = 0) AS speaks, l_linenumber % 3 <> 0 AS asks FROM v""")
def pixel_gate(spark, d):
    n = F.col("l_linenumber")
    side = lambda k: F.when(n % k == 0, "library").otherwise("scan")
    return claims(spark, d).select("l_orderkey", n, verdicts.gate().alias("gate"), verdicts.speaks(side(3), side(2)).alias("speaks"), verdicts.asks_first(side(3)).alias("asks"))


@query("SELECT s_suppkey AS n, s_suppkey AS n_in, 1.0 AS m0, 0.0 AS m1, 1.0 AS ov_b, 1.0 AS blk_min, true AS centred, s_suppkey >= 5 AS counts FROM supplier")
def perfect_verdicts(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"))
    said = rows.withColumns(verdicts.perfect(F.col("n"))).withColumns({"blk": F.lit(1.0)})
    return said.select("n", "n_in", "m0", "m1", "ov_b", "blk_min", "centred", ((verdicts.standing() == verdicts.CLEAN) & verdicts.gate()).alias("counts"))


MATCHES = "m AS (SELECT l_suppkey, l_quantity AS x, l_discount * 40 AS y, l_linenumber <= 4 AS inlier, 1 + l_tax * 10 AS sigma_a, 1 + l_discount * 20 AS sigma_b, 1.25 AS scale FROM lineitem)"


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_suppkey", "l_returnflag", F.col("l_quantity").alias("x_a"), (F.col("l_discount") * 40).alias("y_a"), (F.col("l_linenumber") <= 4).alias("inlier"),
        (1 + F.col("l_tax") * 10).alias("sigma_a"), (1 + F.col("l_discount") * 20).alias("sigma_b"), F.lit(1.25).alias("scale"),
    )


@query(f"WITH {MATCHES} SELECT l_suppkey, count(DISTINCT (floor(x * 2)::INT, floor(y * 2)::INT)) FILTER (inlier) AS n_in FROM m GROUP BY 1")
def distinct_inliers(spark, d):
    return verdicts.distinct_points(_matches(spark, d), ["l_suppkey"])


@query(f"WITH {MATCHES}, o AS (SELECT l_suppkey, list(log2(sigma_b / (sigma_a * scale)) ORDER BY log2(sigma_b / (sigma_a * scale))) FILTER (inlier) AS l FROM m GROUP BY 1) SELECT l_suppkey, round(l[len(l) // 2 + 1], 6) AS size_offset FROM o")
def median_size_offset(spark, d):
    return verdicts.size_offset(_matches(spark, d), ["l_suppkey"]).withColumn("size_offset", F.round("size_offset", 6))


@query("""
    WITH k AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'b' ELSE 'a' END AS side, l_quantity AS x, l_discount * 40 AS y, l_linestatus = 'O' AS inside, l_linenumber >= 6 AS inlier FROM lineitem),
    c AS (SELECT l_suppkey, side, avg(x) AS mx, avg(y) AS my FROM k WHERE inside GROUP BY ALL), b AS (SELECT l_suppkey, side, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM k WHERE inlier GROUP BY ALL)
    SELECT l_suppkey, bool_or(coalesce(mx BETWEEN x0 AND x1 AND my BETWEEN y0 AND y1, false)) AS centred FROM b LEFT JOIN c USING (l_suppkey, side) GROUP BY 1
""")
def centred_evidence(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_suppkey", F.when(F.col("l_returnflag") == "R", "b").otherwise("a").alias("side"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 40).alias("y"), (F.col("l_linestatus") == "O").alias("inside"), (F.col("l_linenumber") >= 6).alias("inlier")
    )
    return verdicts.encloses_centre(rows, rows.filter("inlier"), ["l_suppkey"])


@query("""
    WITH p AS (SELECT p_partkey, 1 + p_size / 10.0::DOUBLE AS d1, 2 + p_size / 8.0::DOUBLE AS d2, 3 + p_size / 6.0::DOUBLE AS d4, 5 + p_size / 5.0::DOUBLE AS d8, 0.25 * (1 + p_partkey % 60) AS far, 1 + (p_partkey % 7) / 2.0::DOUBLE AS times, 4 + (p_partkey % 9)::DOUBLE AS g1 FROM part),
    q AS (SELECT *, least(8.0, 8 / times) AS e FROM p),
    at_ AS (SELECT *, CASE WHEN far < 1 THEN d1 * far WHEN far < 2 THEN d1 * pow(d2 / d1, log2(far)) WHEN far < 4 THEN d2 * pow(d4 / d2, log2(far) - 1) WHEN far < 8 THEN d4 * pow(d8 / d4, log2(far) - 2) ELSE d8 END AS there,
        CASE WHEN e < 2 THEN d1 * pow(d2 / d1, log2(e)) WHEN e < 4 THEN d2 * pow(d4 / d2, log2(e) - 1) WHEN e < 8 THEN d4 * pow(d8 / d4, log2(e) - 2) ELSE d8 END AS shared FROM q)
    SELECT p_partkey, round((log2(d2 / d1) + log2(d4 / d2)) / 2, 6) AS soft, round(there, 6) AS there, round(log2(g1 * times / (d1 * (d8 / shared))), 6) AS extra FROM at_
""")
def detail_measures(spark, d):
    n, k = F.col("p_size").cast("double"), F.col("p_partkey")
    own = (1 + n / 10, 2 + n / 8, 3 + n / 6, 5 + n / 5)
    other = ((4 + k % 9).cast("double"), *own[1:])
    return table(spark, d, "part").select("p_partkey", F.round(sc.softness(own[0], own[1], own[1], own[2]), 6).alias("soft"), F.round(sc.at_distance(own, 0.25 * (1 + k % 60)), 6).alias("there"), F.round(sc.extra_detail(own, other, 1 + (k % 7) / 2.0), 6).alias("extra"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'identical' WHEN l_linenumber = 2 THEN 'same pixels' ELSE
    CASE WHEN l_linenumber = 3 THEN '' ELSE printf('%d points, ', l_quantity::BIGINT) END || printf('overlap %.3f, correlation %.3f', l_discount, l_tax) || CASE WHEN l_returnflag = 'R' THEN ', mirrored' ELSE '' END || CASE WHEN l_linestatus = 'O' THEN ', inverted' ELSE '' END END AS said FROM lineitem""")
def evidence_text(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "identical").when(F.col("l_linenumber") == 2, "same pixels").otherwise("claim").alias("relation"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("aligned_points"), F.col("l_discount").alias("frame_overlap"), F.col("l_tax").alias("pixel_correlation"),
        (F.col("l_returnflag") == "R").alias("mirrored"), (F.col("l_linestatus") == "O").alias("inverted"),
    )
    return rows.select("l_orderkey", "l_linenumber", verdicts.evidence_text().alias("said"))


# ---- graph

PAIRS = SELF + ", pairs AS (SELECT DISTINCT least(q, d) AS a, greatest(q, d) AS b FROM scored WHERE score >= 0.5)"


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, score) of documents of which one has half or more of the other's mass."""
    found = containment.spelt_out(*document_containment(spark, d))
    return materialize(found.groupBy(F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b")).agg(F.max("score").alias("score"), F.min("score").alias("other")), "pairs")


COMPONENTS = "WITH RECURSIVE " + PAIRS + """, sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach(node, other) AS (SELECT a, a FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.other)"""


@query(f"{COMPONENTS} SELECT node, min(other) AS component FROM reach GROUP BY node")
def clusters(spark, d):
    found, same = document_containment(spark, d)
    # a class hangs together by its head
    own = same.filter("item <> head").select(F.col("head").alias("a"), F.col("item").alias("b"))
    return connected_components(found.select(F.col("q").alias("a"), F.col("d").alias("b")).union(own))


@query(f"""{COMPONENTS}, fam AS (SELECT node, min(other) AS family FROM reach GROUP BY node), deg AS (SELECT a AS node, count(*) AS n FROM sym GROUP BY a)
    SELECT node AS item FROM deg WHERE n < 2 UNION SELECT min_by(node, (-n, node)) FROM deg JOIN fam USING (node) GROUP BY family""")
def anchor_degree_reps(spark, d):
    return graph.re_askers(document_pairs(spark, d).select("a", "b"))


@query()
def groups(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.col("n_chars").alias("rank"))
    return graph.groups(document_pairs(spark, d), docs)


@query()
def group_membership(spark, d):
    return graph.membership(groups(spark, d)).select("member", joined("groups").alias("groups"))


@query()
def bridges(spark, d):
    return graph.demote_bridges(document_pairs(spark, d).withColumn("clean", F.col("score") >= 0.8))


@query()
def shared_parts(spark, d):
    pairs = document_pairs(spark, d).select("a", "b", (F.col("score") >= 0.8).alias("clean"), F.col("score").alias("ov_a"), F.coalesce("other", F.lit(0.0)).alias("ov_b"))
    return graph.demote_shared_parts(pairs)


@query()
def admission(spark, d):
    pairs = document_pairs(spark, d).select("a", "b", (F.col("score") >= 0.8).alias("clean"), (F.col("score") * 100).cast("int").alias("n_in"), F.col("score").alias("blk"))
    return graph.admission(pairs)


@query("""WITH s AS (SELECT n_regionkey AS representative, count(*) AS size, list(n_name ORDER BY n_name) AS members FROM nation GROUP BY 1)
    SELECT row_number() OVER (ORDER BY size DESC, members, representative)::INT AS group_no, representative, size, array_to_string(members, ',') AS members FROM s""")
def group_order(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("representative"), F.col("n_name").alias("member"))
    return graph.group_order(rows).select("group_no", "representative", "size", joined("members").alias("members"))


@query("""WITH c AS (SELECT c_nationkey AS cluster, count(*) AS cost FROM customer GROUP BY 1)
    SELECT cluster, cost, (sum(cost) OVER w)::BIGINT AS running, sum(cost) OVER w <= (SELECT count(*) / 2 FROM customer) AS "full" FROM c WINDOW w AS (ORDER BY cost, cluster ROWS UNBOUNDED PRECEDING)""")
def propagation_budget(spark, d):
    customers = table(spark, d, "customer")
    costs = customers.groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count(F.lit(1)).alias("cost"))
    return graph.propagation_budget(costs, customers.count() / 2)


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS item, o_orderkey // 2 AS keeper, o_orderstatus = 'F' AS gone FROM orders),
    w(item, at_) AS (SELECT item, keeper FROM o WHERE gone UNION ALL SELECT w.item, o.keeper FROM w JOIN o ON o.item = w.at_ AND o.gone AND w.at_ <> o.keeper)
    SELECT w.item, w.at_ AS kept FROM w LEFT JOIN o ON o.item = w.at_ AND o.gone WHERE o.item IS NULL""")
def keeper_chain(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.floor(F.col("o_orderkey") / 2).alias("keeper"), F.when(F.col("o_orderstatus") == "F", "DELETE").otherwise("KEEP").alias("action"))
    return graph.keeper_chain(orders).filter("kept is not null")


@query("SELECT item, count(*) AS degree FROM (SELECT l_suppkey AS item FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 1000000 + l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY 1")
def anchor_degrees(spark, d):
    return graph.degrees(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (1_000_000 + F.col("l_partkey")).alias("b")).distinct())


# ---- decisions


@query("""WITH b AS (SELECT l_partkey AS item, max(l_linenumber = 7) AS rep, max(CASE WHEN l_linenumber <> 7 THEN l_discount * 10 END) AS best FROM lineitem GROUP BY 1)
    SELECT item, CASE WHEN rep THEN 'KEEP' WHEN best >= 0.65 + 5.0::DOUBLE / 7 * (1 - 0.65) THEN 'DELETE' WHEN best >= 0.65 THEN 'KEEP' ELSE 'REVIEW' END AS action FROM b""")
def group_rule_actions(spark, d):
    seats = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_linenumber") == 7).alias("representative"), (F.col("l_discount") * 10).alias("correlation"))
    return decide.by_group(seats, 0.65)


FACTS = """f AS (SELECT l_orderkey, l_linenumber, l_linenumber = 7 AS pinned, CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'keep' ELSE 'open' END AS state, CASE WHEN l_quantity > 40 THEN 'held' WHEN l_quantity > 20 THEN 'softer' END AS refused,
    l_tax > 0.07 AS undecided, l_tax < 0.01 AS shrunk, l_discount > 0.08 AS deletes, l_linestatus = 'O' AS clean, 0.85 + l_discount AS best FROM lineitem)"""
ACTION = """CASE WHEN pinned THEN 'KEEP' WHEN state = 'delete' THEN 'DELETE' WHEN NOT deletes AND (undecided OR shrunk) THEN 'REVIEW'
    WHEN NOT (state = 'keep' OR coalesce(refused, '') = 'held') OR (NOT deletes AND NOT clean) THEN CASE WHEN best < 0.9 THEN 'KEEP' ELSE 'REVIEW' END ELSE 'KEEP' END"""


@query(f"""WITH {FACTS}, a AS (SELECT *, {ACTION} AS action FROM f)
    SELECT l_orderkey, l_linenumber, action, CASE WHEN action = 'DELETE' THEN 0 WHEN action = 'KEEP' AND (pinned OR deletes OR clean) THEN 4 WHEN action = 'KEEP' THEN 1 WHEN state = 'keep' THEN 3 ELSE 2 END AS head FROM a""")
def action_ladder(spark, d):
    f = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") == 7).alias("pinned"), F.when(F.col("l_returnflag") == "R", "delete").when(F.col("l_returnflag") == "A", "keep").otherwise("open").alias("state"),
        F.when(F.col("l_quantity") > 40, "held").when(F.col("l_quantity") > 20, "softer").alias("refused"), (F.col("l_tax") > 0.07).alias("undecided"), (F.col("l_tax") < 0.01).alias("shrunk"),
        (F.col("l_discount") > 0.08).alias("deletes"), (F.col("l_linestatus") == "O").alias("clean"), (0.85 + F.col("l_discount")).alias("best"),
    )
    return f.withColumn("action", decide.action()).select("l_orderkey", "l_linenumber", "action", decide.head_rank().alias("head"))


LAPSED = """latest AS (SELECT user_id AS item, max(epoch_us(ts)) AS touched, count(*) AS n FROM events GROUP BY 1), began AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS t FROM events),
    lapsed AS (SELECT c_custkey AS item, CASE WHEN l.item IS NULL THEN 'gone' WHEN touched >= (SELECT t FROM began) AND n > 12 THEN 'changed' END AS lapse FROM customer LEFT JOIN latest l ON l.item = c_custkey)"""


def _lapsed(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    ends = events.agg(F.min("t"), F.max("t")).first()
    began = (ends[0] + ends[1]) // 2
    now = events.groupBy("item").agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("n")).select("item", F.lit(0).alias("length"), F.when(F.col("n") > 12, F.col("t")).otherwise(0).alias("touched"))
    then = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.lit(0).alias("length"), F.lit(began).alias("began"))
    return decide.lapses(then, now)


@query(f"WITH {LAPSED} SELECT item, lapse FROM lapsed WHERE lapse IS NOT NULL")
def lapsed_files(spark, d):
    return _lapsed(spark, d)


@query(f"""WITH {LAPSED}, a AS (SELECT c_custkey AS item, CASE WHEN c_custkey % 3 = 0 THEN 'DELETE' ELSE 'KEEP' END AS action, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 2 END AS kept FROM customer),
    g AS (SELECT item FROM lapsed WHERE lapse IS NOT NULL)
    SELECT item, CASE WHEN f THEN 'REVIEW' ELSE action END AS action, CASE WHEN NOT f THEN kept END AS kept FROM (SELECT *, action = 'DELETE' AND (item IN (FROM g) OR coalesce(kept IN (FROM g), false)) AS f FROM a)""")
def revoke_lapsed(spark, d):
    k = F.col("c_custkey")
    actions = table(spark, d, "customer").select(k.alias("item"), F.when(k % 3 == 0, "DELETE").otherwise("KEEP").alias("action"), F.when(k % 3 == 0, F.floor(k / 2)).alias("kept"))
    return decide.revoke(actions, _lapsed(spark, d))


LIBRARY = ASKED + """, best AS (SELECT q, d, score, rn, score >= 0.95 AS clean FROM ranked WHERE rn <= 5), hold AS (SELECT q, min(d) AS holder FROM best WHERE score >= 0.999 GROUP BY q),
    top AS (SELECT q, count(*) AS n, min_by(d, (NOT clean, -score, d)) AS d, min_by(clean, (NOT clean, -score, d)) AS clean, min_by(score, (NOT clean, -score, d)) AS score FROM best GROUP BY q),
    said AS (SELECT -1 - item_id AS item, CASE WHEN holder IS NOT NULL THEN 'repeat' WHEN clean THEN 'better' WHEN score >= 0.9 THEN 'review' ELSE 'new' END AS verdict, holder, d, coalesce(n, 0) AS library_matches
        FROM benchmark LEFT JOIN hold ON hold.q = -1 - item_id LEFT JOIN top ON top.q = -1 - item_id)"""


@query(f"WITH {LIBRARY} SELECT item, verdict, CASE WHEN holder IS NOT NULL THEN holder WHEN verdict <> 'new' THEN d END AS found, library_matches FROM said")
def library_verdicts(spark, d):
    matches = materialize(containment_topk(spark, d), "matches")
    holders = matches.filter("score >= 0.999").groupBy(F.col("q").alias("item")).agg(F.min("d").alias("holder"))
    rows = matches.select(F.col("q").alias("item"), F.col("d").alias("other"), F.col("score").alias("correlation"), (F.col("score") >= 0.95).alias("clean"), F.lit(False).alias("mirrored"), F.lit(False).alias("inverted"))
    return decide.library_verdicts(table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("item")), holders, rows)


@query(f"WITH {LIBRARY} SELECT verdict, count(*) AS n FROM said GROUP BY 1")
def verdict_tally(spark, d):
    return decide.tally(library_verdicts(spark, d))


@query(f"WITH {LIBRARY} SELECT verdict, 'passage/' || (-1 - item) AS path, CASE verdict WHEN 'repeat' THEN 1 ELSE 4 END AS place FROM said WHERE verdict IN ('repeat', 'new')")
def verdict_paths(spark, d):
    paths = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("item"), F.concat(F.lit("passage/"), F.col("item_id").cast("string")).alias("path"))
    return decide.verdict_paths(library_verdicts(spark, d), paths, ("repeat", "new"))


# ---- sources

PATHS = "p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


@query(f"WITH {PATHS} SELECT page_id FROM p WHERE NOT regexp_matches(path, '(^|/)[^/]*\\.example\\.(com|net)[^/]*(/|$)')")
def exclude_glob(spark, d):
    return paths(spark, d).filter(~listing.excluded(F.col("path"), patterns=("*.example.com*", "*.example.net*"))).select("page_id")


@query(f"WITH {PATHS} SELECT page_id FROM p WHERE split_part(path, '/', 1) NOT IN (SELECT split_part(path, '/', 1) FROM p WHERE page_id < 5)")
def exclude_prefixes(spark, d):
    found = paths(spark, d)
    # what is excluded are the hosts of five named pages
    prefixes = found.filter("page_id < 5").select(F.split("path", "/")[0].alias("prefix")).distinct()
    return listing.exclude_under(found, prefixes).select("page_id")


@query("SELECT s_suppkey FROM (SELECT s_suppkey, 'a/' || s_name || '.' || (['JPG', 'png', 'txt', 'Jpeg', 'gz'])[s_suppkey % 5 + 1] AS path FROM supplier) WHERE regexp_matches(path, '(?i)\\.(jpg|jpeg|png)$')")
def extension_filter(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("JPG", "png", "txt", "Jpeg", "gz"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    found = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("a/"), "s_name", F.lit("."), names).alias("path"))
    return found.filter(listing.accepts(F.col("path"), ("jpg", ".jpeg", "PNG"))).select("s_suppkey")


#: Folders and whether their files are passed over, as a drive and a network share carry them; those of an ordinary name are folders like any.
ON_A_DRIVE = (
    ("x", False), (".git", False), ("Trash", False), ("thumbnails", False), ("trash-talk", False), (".Trash-1000", True), (".Trash", True), ("$RECYCLE.BIN", True), (".Trashes", True), (".thumbnails", True),
    ("#recycle", True), ("@eaDir", True), ("#snapshot", True), ("@Recycle", True), ("@__thumb", True), ("@Recently-Snapshot", True), ("lost+found", True), ("RECYCLER", True), (".zfs", False), ("recycled", False),
)
FOLDERS = f"f AS (SELECT c_custkey, c_custkey % {len(ON_A_DRIVE)} AS k, ([{', '.join(repr(n) for n, _ in ON_A_DRIVE)}])[c_custkey % {len(ON_A_DRIVE)} + 1] || '/' || c_name AS path FROM customer)"


def _folders(spark: SparkSession, d: str) -> DataFrame:
    folder = F.element_at(F.array(*(F.lit(n) for n, _ in ON_A_DRIVE)), (F.col("c_custkey") % len(ON_A_DRIVE) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("/", folder, "c_name").alias("path"))


@query(f"WITH {FOLDERS} SELECT c_custkey FROM f WHERE path NOT LIKE '.%'")
def hidden_filter(spark, d):
    return _folders(spark, d).filter(~listing.hidden(F.col("path"))).select("c_custkey")


@query(f"WITH {FOLDERS} SELECT c_custkey FROM f WHERE k IN ({', '.join(str(i) for i, (_, aside) in enumerate(ON_A_DRIVE) if not aside)})")
def set_aside_filter(spark, d):
    return _folders(spark, d).filter(~listing.set_aside(F.col("path"))).select("c_custkey")


@query(f"""WITH {PATHS} SELECT page_id FROM p QUALIFY row_number() OVER (PARTITION BY split_part(path, '/', 1), page_id % 40 ORDER BY length(path) DESC, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END, page_id % 7 = 0, path, page_id) = 1""")
def identity_dedup(spark, d):
    files = paths(spark, d).select("page_id", F.split("path", "/")[0].alias("dev"), (F.col("page_id") % 40).alias("ino"), F.length("path").alias("depth"), F.when(F.col("page_id") % 3 == 0, "library").otherwise("scan").alias("side"), (F.col("page_id") % 7 == 0).alias("is_link"), F.struct("path", "page_id").alias("path"))
    return listing.identity_dedup(files, ["dev", "ino"]).select("page_id")


#: Heads of files, and the format that each tells: text that begins like a picture, and heads too short to say, are none.
HEADS = (
    ("FFD8FFE000104A4649460001", "jpeg"), ("89504E470D0A1A0A0000000D", "png"), ("474946383961010001000000", "gif"), ("424D00000000000000000000000028000000", "bmp"), ("424D572073657276696365207265636F7264", None),
    ("52494646000000005745425000", "webp"), ("0000001C6674797061766966", "heif"), ("000000186674797069736F6D000000006865696331323334", "heif"), ("000000146674797069736F6D000000006865696331323334", "heif"), ("000000106674797069736F6D000000006865696331323334", None),
    ("50360A2320630A3120312031", "pnm"), ("5033206E6F746573206F6620", None), ("50370A57494454482031320A", "pnm"), ("50370A576964746820313220", None), ("000001000100101000000100", "ico"), ("000001000000101000000100", None),
    ("68656C6C6F20776F726C64202E", None), ("FFD8FF", None), ("", None),
)


@query(f"SELECT p_partkey, ([{', '.join('NULL' if f is None else repr(f) for _, f in HEADS)}])[p_partkey % {len(HEADS)} + 1] AS format FROM part")
def sniff_format(spark, d):
    content = F.unhex(F.element_at(F.array(*(F.lit(h) for h, _ in HEADS)), (F.col("p_partkey") % len(HEADS) + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", listing.sniff(content).alias("format"))


#: Heads of small files, and what they say: (hex, format, width, height, turned, damaged, several, lossless, deep).
PNG_OPEN, PNG_END = "89504E470D0A1A0A0000000D49484452", "0000000049454E4400000000"
FILES = (
    (PNG_OPEN + "00000040" + "00000020" + "080200000000000000" + PNG_END[:-8] + "AE426082", "png", 64, 32, False, False, False, True, False),
    (PNG_OPEN + "00000040" + "00000020" + "100300000000000000" + "000010", "png", 64, 32, False, True, False, False, True),
    ("FFD8FFC0000B0C00100020010111" + "00FFDA000200FFD9", "jpeg", 32, 16, False, False, False, False, True),
    ("FFD8FFE1001E457869660000" + "4D4D002A00000008" + "0001" + "0112000300000001" + "00060000" + "FFC0000B080010002001011100" + "FFDA0002AA", "jpeg", 16, 32, True, True, False, False, False),
    ("FFD8FFC0000B0800100020010111" + "00FFDA000200FFD9FFD8FF", "jpeg", 32, 16, False, False, True, False, False),
    ("474946383961" + "01000100000000" + "2C00000000010001000002" + "024C0100" + "2C00000000010001000002" + "024C01003B", "gif", None, None, False, False, True, False, False),
    ("5249464600000000574542505650384C00000000", "webp", None, None, False, False, False, True, False),
    ("50360A322032203635353335", "pnm", None, None, False, False, False, True, True),
    ("68656C6C6F20776F726C64", None, None, None, None, None, None, None, None),
)


def _said(column: int, kind: str) -> str:
    return f"(CAST([{', '.join('NULL' if f[column] is None else repr(f[column]) for f in FILES)}] AS {kind}[]))[p_partkey % {len(FILES)} + 1]"


@query(f"""SELECT p_partkey, {_said(1, "VARCHAR")} AS format, {_said(2, "INT")} AS width, {_said(3, "INT")} AS height, {_said(4, "BOOLEAN")} AS turned, {_said(5, "BOOLEAN")} AS damaged, {_said(6, "BOOLEAN")} AS several,
    {_said(7, "BOOLEAN")} AS lossless, {_said(8, "BOOLEAN")} AS deep FROM part""")
def header_facts(spark, d):
    content = F.unhex(F.element_at(F.array(*(F.lit(f[0]) for f in FILES)), (F.col("p_partkey") % len(FILES) + 1).cast("int")))
    files = table(spark, d, "part").select("p_partkey", content.alias("content")).withColumn("format", listing.sniff(F.col("content")))
    return headers.header_facts(files, "p_partkey").select("p_partkey", "format", "width", "height", "turned", "damaged", "several", "lossless", "deep")


@query("""WITH f AS (SELECT page_id, CASE WHEN length(html) < 2000 THEN 'empty' WHEN page_id % 4 = 0 THEN 'not an image' WHEN page_id % 4 = 1 THEN 'other file' END AS category, url FROM pages), g AS (SELECT category, url, row_number() OVER (PARTITION BY category ORDER BY url, page_id) AS n FROM f WHERE category IS NOT NULL)
    SELECT category, CASE WHEN category = 'other file' THEN 'skip' ELSE 'problem' END AS weight, count(*) AS n, string_agg(CASE WHEN n <= 10 THEN url END, '|' ORDER BY n) AS samples FROM g GROUP BY 1""")
def problem_tally(spark, d):
    pages = table(spark, d, "pages").withColumn("category", F.when(F.length("html") < 2000, "empty").when(F.col("page_id") % 4 == 0, "not an image").when(F.col("page_id") % 4 == 1, "other file")).filter("category is not null")
    found = pages.select("category", F.when(F.col("category") == "other file", "skip").otherwise("problem").alias("weight"), F.col("url").alias("path"))
    return listing.tally_problems(found)


# ---- scalars and reports


@query("""SELECT doc_id, CASE WHEN n_chars * 900 >= 1073741824 THEN printf('%.1fGB', round_even(n_chars * 900 / 1073741824.0::DOUBLE, 1)) WHEN n_chars * 900 >= 1048576 THEN printf('%.1fMB', round_even(n_chars * 900 / 1048576.0::DOUBLE, 1)) WHEN n_chars * 900 >= 1024 THEN printf('%.1fKB', round_even(n_chars * 900 / 1024.0::DOUBLE, 1)) ELSE n_chars * 900 || 'B' END AS size,
    'group_' || (doc_id + 1) AS label, CASE WHEN n_chars >= 86400 THEN (n_chars // 86400) || CASE WHEN n_chars // 86400 = 1 THEN ' day ago' ELSE ' days ago' END WHEN n_chars >= 3600 THEN (n_chars // 3600) || CASE WHEN n_chars // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
    WHEN n_chars >= 60 THEN (n_chars // 60) || CASE WHEN n_chars // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END ELSE 'just now' END AS ago FROM documents""")
def format_size(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", sc.format_size(n * 900).alias("size"), sc.group_name(F.col("doc_id")).alias("label"), sc.ago(n).alias("ago"))


@query("""WITH p AS (SELECT p_partkey, p_size, p_size * 40 AS w, (p_partkey % 50 + 1) * 30 AS h FROM part), a AS (SELECT *, greatest(1, sqrt(0.75::DOUBLE * greatest(w, h) / least(w, h))) AS f FROM p)
    SELECT p_partkey, round(f, 6) AS factor, greatest(1, round(w * least(1, 512 * f / greatest(w, h))))::INT AS ww, greatest(1, round(h * least(1, 512 * f / greatest(w, h))))::INT AS wh, greatest(1, greatest(w, h) // 1024)::INT AS box,
    round((299 * (p_partkey % 256) + 587 * (p_size % 256) + 114 * 7) / 1000.0::DOUBLE, 6) AS luma, CASE WHEN p_partkey % 9 BETWEEN 5 AND 8 THEN h ELSE w END AS shown FROM a""")
def picture_sizes(spark, d):
    w, h = (F.col("p_size") * 40).cast("bigint"), (F.col("p_partkey") % 50 + 1) * 30
    ww, wh = sc.working_size(w, h, 512)
    return table(spark, d, "part").select("p_partkey", F.round(sc.area_factor(w, h), 6).alias("factor"), ww.alias("ww"), wh.alias("wh"), sc.box_factor(F.greatest(w, h), 512).alias("box"), F.round(sc.luma(F.col("p_partkey") % 256, F.col("p_size") % 256, F.lit(7)), 6).alias("luma"), sc.shown_size(w, h, F.col("p_partkey") % 9)[0].alias("shown"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k')::VARCHAR AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


# ---- evaluation

RECTS = """r AS (SELECT l_orderkey, l_linenumber, (l_quantity % 5) / 10 AS x0, l_tax AS y0, (l_quantity % 5) / 10 + 0.4 + l_discount * 2 AS x1, l_tax + 0.5 + l_discount AS y1, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS scramble, 0.5 + l_quantity / 100 AS coverage FROM lineitem),
    q AS (SELECT a.l_orderkey, a.l_linenumber AS la, b.l_linenumber AS lb, a.scramble IS DISTINCT FROM b.scramble AS s, least(a.coverage, b.coverage) / greatest(a.coverage, b.coverage) AS c,
        greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
    t AS (SELECT l_orderkey, la, lb, CASE WHEN s OR i <= 0 THEN 'DIFFERENT' WHEN i / (aa + ab - i) >= 0.95 THEN CASE WHEN c < 0.9 THEN 'CROP' ELSE 'SAME' END WHEN greatest(i / aa, i / ab) >= 0.95 THEN 'CROP' ELSE 'PARTIAL' END AS relation, CASE WHEN s THEN 0 ELSE i / (aa + ab - i) END AS iou FROM q)"""


def _relations(spark: SparkSession, d: str) -> DataFrame:
    x0, y0 = (F.col("l_quantity") % 5) / 10, F.col("l_tax")
    r = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", x0.alias("x0"), y0.alias("y0"), (x0 + 0.4 + F.col("l_discount") * 2).alias("x1"), (y0 + 0.5 + F.col("l_discount")).alias("y1"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("scramble"), (0.5 + F.col("l_quantity") / 100).alias("coverage"),
    )
    a, b = (r.select("l_orderkey", *[F.col(c).alias(f"{c}_{s}") for c in r.columns if c != "l_orderkey"]) for s in "ab")
    met = a.join(b, "l_orderkey").filter("l_linenumber_a < l_linenumber_b")
    told = evaluate.relations(met, tuple(f"{c}_a" for c in ("x0", "y0", "x1", "y1")), tuple(f"{c}_b" for c in ("x0", "y0", "x1", "y1")), ("scramble_a", "scramble_b"), ("coverage_a", "coverage_b"))
    return told.select("l_orderkey", F.col("l_linenumber_a").alias("la"), F.col("l_linenumber_b").alias("lb"), "relation", "iou")


@query(f"WITH {RECTS} SELECT l_orderkey, la, lb, relation, round(iou, 6) AS iou FROM t")
def pair_relation_truth(spark, d):
    return _relations(spark, d).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {RECTS}, p AS (SELECT l_orderkey * 10 + la AS a, l_orderkey * 10 + lb AS b, bool_or(iou >= 0.6) AS f, bool_or(relation IN ('SAME', 'CROP')) AS t, bool_or(relation = 'PARTIAL') AS s FROM t GROUP BY ALL),
    c AS (SELECT count(*) FILTER (f AND NOT s AND t) AS tp, count(*) FILTER (f AND NOT s AND NOT t) AS fp, count(*) FILTER (t AND NOT (f AND NOT s)) AS fn FROM p)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def score_f1(spark, d):
    t = materialize(_relations(spark, d).select((F.col("l_orderkey") * 10 + F.col("la")).alias("a"), (F.col("l_orderkey") * 10 + F.col("lb")).alias("b"), "relation", "iou"), "relations")
    scored = evaluate.score(t.filter("iou >= 0.6"), t.filter("relation in ('SAME', 'CROP')"), t.filter("relation = 'PARTIAL'"))
    return scored.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT n_name, ((row_number() OVER (ORDER BY n_name) - 1) % 2)::INT AS alternate, (strpos('0123456789abcdef', substr(sha256(n_name), 8, 1)) - 1)::INT % 2 AS hashed FROM nation")
def halves(spark, d):
    return evaluate.halves(table(spark, d, "nation"), "n_name")


@query("""WITH a AS (SELECT o_orderkey AS item, o_orderstatus = 'F' AS gone FROM orders), h AS (SELECT x.o_orderkey AS keeper, y.o_orderkey AS item FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND x.o_totalprice >= y.o_totalprice)
    SELECT item FROM a WHERE gone AND item NOT IN (SELECT h.item FROM h JOIN a k ON k.item = h.keeper WHERE NOT k.gone)""")
def keep_losses(spark, d):
    o = table(spark, d, "orders")
    actions = o.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", "DELETE").otherwise("KEEP").alias("action"))
    k = o.select("o_custkey", F.col("o_orderkey").alias("keeper"), F.col("o_totalprice").alias("p"))
    holds = k.join(o.select("o_custkey", F.col("o_orderkey").alias("item"), "o_totalprice"), "o_custkey").filter("keeper <> item and p >= o_totalprice").select("keeper", "item")
    return evaluate.keep_losses(actions, holds)


@query("""SELECT p_brand AS truth, count(*) FILTER (p_size % 4 = 0) AS repeat, count(*) FILTER (p_size % 4 = 1) AS better, count(*) FILTER (p_size % 4 = 2) AS review, count(*) FILTER (p_size % 4 = 3) AS new FROM part GROUP BY 1""")
def library_score(spark, d):
    verdict = F.element_at(F.array(*map(F.lit, decide.VERDICTS)), (F.col("p_size") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("item"), verdict.alias("verdict"), F.col("p_brand").alias("truth"))
    return evaluate.library_score(rows.select("item", "verdict"), rows.select("item", "truth"))


# ---- streams


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, d):
    """The batch form of the streaming count: the same plan runs on a stream."""
    from kinsift.streaming.ingest import windowed_counts

    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return windowed_counts(events).select(F.unix_micros("window.start").alias("start"), "event_type", "n")


@query("SELECT doc_id AS item, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'new' ELSE 'repeat' END AS verdict, min(doc_id) OVER (PARTITION BY text) AS of FROM documents")
def incremental_ingest(spark, d):
    from kinsift.plans.lineage import shared_path
    from kinsift.streaming.ingest import arrivals, ingest

    base = shared_path(spark, "ingest")
    library = f"{base}/library"
    spark.createDataFrame([], "item bigint, hash string, batch bigint").write.parquet(library)
    docs = table(spark, d, "documents").select("doc_id", "text")
    # the documents come in four lots of rising ids, a lot a batch, so most repeats are of an earlier batch
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    lot = F.least(F.lit(3), F.floor((F.col("doc_id") - low) * 4 / max(1, high - low)))
    for i in range(4):
        docs.filter(lot == i).coalesce(1).write.mode("append").parquet(f"{base}/inbox")
    done = ingest(arrivals(spark, f"{base}/inbox", docs.schema, 1), library, f"{base}/answers", f"{base}/checkpoint", "doc_id", "text")
    done.awaitTermination()
    return spark.read.parquet(f"{base}/answers").select("item", "verdict", "of")


# ---- excludes, truth and what has lapsed


@query("""WITH n AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN '/data/' || s_suppkey WHEN 1 THEN '*.' || s_suppkey WHEN 2 THEN '/gone/' || s_suppkey ELSE '/data/[' || s_suppkey || ']' END AS name, s_suppkey AS k FROM supplier)
    SELECT name, CASE WHEN k % 4 = 0 OR (k % 4 = 3 AND k % 8 = 3) THEN 'path' WHEN k % 4 IN (1, 3) THEN 'pattern' ELSE 'missing' END AS kind, CASE WHEN k % 4 = 0 OR (k % 4 = 3 AND k % 8 = 3) THEN '/real' || name ELSE name END AS means FROM n""")
def resolved_excludes(spark, d):
    k = F.col("s_suppkey")
    text = k.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("/data/"), text)).when(k % 4 == 1, F.concat(F.lit("*."), text)).when(k % 4 == 2, F.concat(F.lit("/gone/"), text)).otherwise(F.concat(F.lit("/data/["), text, F.lit("]")))
    named = table(spark, d, "supplier").select(k, name.alias("name"))
    there = named.filter((k % 4 == 0) | (k % 8 == 3)).select(F.col("name").alias("path"), F.concat(F.lit("/real"), "name").alias("canonical"))
    return listing.resolve_excludes(named.select("name"), there)


@query("""WITH e AS (SELECT DISTINCT unnest([split_part(p, '/', 1), split_part(p, '/', 1) || '/' || split_part(p, '/', 2), p]) AS prefix FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)),
    r AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS root FROM pages WHERE page_id < 5) SELECT prefix FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE root = prefix OR starts_with(root, prefix || '/'))""")
def sparing_excludes(spark, d):
    found = paths(spark, d)
    parts = F.split("path", "/")
    # a path without a slash has an empty second part
    prefixes = found.select(F.explode(F.array(parts[0], F.concat(parts[0], F.lit("/"), F.coalesce(F.get(parts, 1), F.lit(""))), F.col("path"))).alias("prefix")).distinct()
    return listing.sparing(prefixes, found.filter("page_id < 5").select(F.col("path").alias("root")))


TRUTH = """p AS (SELECT l_orderkey * 10 + l_linenumber AS a, l_orderkey * 10 AS b, CASE WHEN l_linenumber <= 4 THEN 'ORIGINAL' ELSE 'v' || (l_suppkey % 5) END AS va, 'v' || (l_partkey % 6) AS vb,
    (['SAME', 'CROP', 'PARTIAL', 'DIFFERENT'])[l_partkey % 4 + 1] AS relation, CASE WHEN l_suppkey % 3 = 0 THEN 'turn,crop' WHEN l_suppkey % 3 = 1 THEN 'none' END AS geometry, l_tax > 0.02 AS found FROM lineitem),
    t AS (SELECT *, CASE WHEN relation = 'PARTIAL' OR coalesce(list_contains(string_split(geometry, ','), 'turn'), false) OR va = 'v3' OR vb = 'v3' THEN 'skipped' WHEN relation IN ('SAME', 'CROP') THEN 'positive' ELSE 'negative' END AS counts FROM p)"""


def _truth(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("l_orderkey") * 10, F.col("l_suppkey")
    pairs = table(spark, d, "lineitem").select(
        (n + F.col("l_linenumber")).alias("a"), n.alias("b"), F.when(F.col("l_linenumber") <= 4, "ORIGINAL").otherwise(F.concat(F.lit("v"), (s % 5).cast("string"))).alias("variant_a"), F.concat(F.lit("v"), (F.col("l_partkey") % 6).cast("string")).alias("variant_b"),
        F.element_at(F.array(*map(F.lit, ("SAME", "CROP", "PARTIAL", "DIFFERENT"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("relation"), F.when(s % 3 == 0, "turn,crop").when(s % 3 == 1, "none").alias("geometry"), (F.col("l_tax") > 0.02).alias("found"),
    )
    return evaluate.truth_sets(pairs, ("turn",), ("v3",))


@query(f"WITH {TRUTH} SELECT a, b, counts FROM t")
def truth_sets(spark, d):
    return _truth(spark, d).select("a", "b", "counts")


@query(f"WITH {TRUTH} SELECT vb AS transform, count(f.a) AS hits, count(*) AS pairs FROM t LEFT JOIN (SELECT DISTINCT a, b FROM t WHERE found) f ON f.a = t.a AND f.b = t.b WHERE counts = 'positive' AND va = 'ORIGINAL' GROUP BY 1")
def transform_hits(spark, d):
    truth = _truth(spark, d)
    return evaluate.transform_hits(truth.filter("found").select("a", "b"), truth)


@query(f"""WITH {LAPSED}, g AS (SELECT l_orderkey AS "group", l_suppkey AS item, l_linenumber = 1 AS rep, l_discount * 10 AS c FROM lineitem), x AS (SELECT item, lapse FROM lapsed WHERE lapse IS NOT NULL),
    kept AS (SELECT * FROM g WHERE "group" NOT IN (SELECT "group" FROM g WHERE rep AND item IN (SELECT item FROM x)) AND item NOT IN (SELECT item FROM x WHERE lapse = 'gone')),
    b AS (SELECT item, max(rep) AS rep, max(CASE WHEN NOT rep THEN c END) AS best FROM kept GROUP BY 1)
    SELECT item, CASE WHEN rep THEN 'KEEP' WHEN best >= 0.65 + 5.0::DOUBLE / 7 * (1 - 0.65) THEN 'DELETE' WHEN best >= 0.65 THEN 'KEEP' ELSE 'REVIEW' END AS action FROM b""")
def actions_now(spark, d):
    seats = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_suppkey").alias("item"), (F.col("l_linenumber") == 1).alias("representative"), (F.col("l_discount") * 10).alias("correlation"))
    return decide.actions_now(seats, _lapsed(spark, d), 0.65)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR (p_size % 5 = 0 AND p_size % 2 = 0) THEN 'twin' WHEN p_size % 7 = 0 THEN NULL WHEN p_size / 20.0 <= 1.5 THEN 'twin' ELSE 'apart' END AS alike, p_size % 4 <> 0 AND p_size > 10 AS settles FROM part""")
def colour_twins(spark, d):
    n = F.col("p_size")
    coding = F.when(n % 2 == 0, "c")
    said = exact.alike_in_colour(F.lit(1.0), F.when(n % 3 == 0, 1.0).otherwise(2.0), coding, F.when(n % 5 == 0, "c"), F.when(n % 7 != 0, n / 20.0))
    return table(spark, d, "part").select("p_partkey", said.alias("alike"), exact.settles_sameness(n % 4 == 0, n - 10).alias("settles"))


# ---- pictures


def _drawn(seed: int, height: int = 192, width: int = 256):
    """A picture of rectangles with a little noise, the same for the same seed."""
    import numpy as np

    from kinsift.operators.kernels import planes

    r = np.random.default_rng(seed)
    a = np.full((height, width), 90.0)
    for _ in range(90):
        y, x, h, w = r.integers(0, height), r.integers(0, width), r.integers(4, 45), r.integers(4, 45)
        a[y : y + h, x : x + w] = r.integers(0, 255)
    return planes.blur(a, 0.7) + r.normal(0, 1, a.shape)


def _png(plane) -> bytes:
    import struct
    import zlib

    import numpy as np

    h, w = plane.shape
    rows = b"".join(b"\x00" + row.tobytes() for row in np.clip(np.rint(plane), 0, 255).astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def drawn_pictures(spark: SparkSession, d: str) -> str:
    """Writes a family of PNG files for each nation, to the shared folder, by Spark: a picture, a copy, a part of it, and it at half its size."""
    from kinsift.operators.kernels import planes
    from kinsift.plans.lineage import shared_path

    def draw(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for key in batch["n_nationkey"]:
                one = _drawn(int(key))
                for name, plane in (("1", one), ("2", one), ("3", one[12:180, 16:240]), ("4", planes.resize_area(one, 96, 128))):
                    rows.append((int(key), name, _png(plane)))
            yield pd.DataFrame(rows, columns=["n_nationkey", "variant", "value"])

    folder = shared_path(spark, "drawn")
    # a folder a picture; the text writer puts bytes out as they are, and a byte after them, past the picture's end
    drawn = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").repartition(25).mapInPandas(draw, "n_nationkey int, variant string, value binary")
    drawn.withColumn("value", F.col("value").cast("string")).write.option("lineSep", "\0").partitionBy("n_nationkey", "variant").text(folder)
    return folder


@query("""SELECT n_nationkey, variant, CASE variant WHEN '1' THEN 'KEEP' ELSE 'DELETE' END AS action, CASE WHEN variant <> '1' THEN '1' END AS kept, 'whole' AS state
    FROM nation, (SELECT unnest(['1', '2', '3', '4']) AS variant)""")
def picture_scan(spark, d):
    """Of a picture, its copy, a part and a reduction the picture stays, and each other goes for it."""
    from kinsift.plans.engine import Options
    from kinsift.plans.pictures import scan_pictures

    found = scan_pictures(spark, [drawn_pictures(spark, d)], Options(extensions=("txt",), candidates=8))
    part = lambda column, name: F.regexp_extract(column, f"{name}=([0-9]+)", 1)
    rows = found["files"].select(F.col("path").alias("item"), "state").join(found["actions"], "item", "left")
    return rows.select(part("item", "n_nationkey").cast("int").alias("n_nationkey"), part("item", "variant").alias("variant"), "action", F.when(F.col("kept").isNotNull(), part("kept", "variant")).alias("kept"), "state")
