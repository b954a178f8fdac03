"""Secret scans with a battery of randomness tests, in DataFrame functions alone.

Three patterns give the base spans. Beside them every long run of encoding characters is a candidate: its
encoding is inferred, and three tests ask whether its symbols are drawn evenly and independently from that
encoding's alphabet: chi-squared uniformity, runs about the middle of the alphabet, and serial correlation.
Fisher's method combines their p-values. Random strings have evenly spread p-values and natural ones small
ones, so in each class of encoding and length the share of random strings follows from the upper half of
its p-values, and the cut is the least one at which no more than a part `rate` of what is kept is expected
not to be random. Positions are code points: the text's pieces between matches give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import materialize, unique_columns

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are taken whole, so a shorter one never hides a longer
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
# Encodings and their alphabets.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
BINS = 100


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, kind: int, value_group: int = 0) -> str:
    """SQL of an array of (start, kind, finish, value) of all matches, or an empty one without looking further."""
    p = _sql(pattern)
    each = f"arrays_zip(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {value_group}))"
    each = f"transform({each}, m -> named_struct('before', char_length(m['0']), 'long', char_length(m['1']), 'value', m['2']))"
    empty = "cast(array() as array<struct<start:int,kind:int,finish:int,value:string>>)"
    # sums of doubling reach: as many steps as the number of matches has bits, each a pass over them
    step = "CASE WHEN size(a) > i THEN zip_with(a, concat(array_repeat(0, i), slice(a, 1, size(a) - i)), (x, y) -> x + y) ELSE a END"
    ends = f"aggregate(transform(sequence(0, cast(ceil(log2(size(e))) as int)), b -> shiftleft(1, b)), transform(e, m -> m.before + m.long), (a, i) -> {step})"
    found = f"zip_with(e, {ends}, (m, p) -> named_struct('start', p - m.long, 'kind', {kind}, 'finish', p, 'value', m.value))"
    return f"CASE WHEN {text} RLIKE {p} THEN element_at(transform(array({each}), e -> {found}), 1) ELSE {empty} END"


def _with(array: str, name: str, **fields: str) -> str:
    """SQL of an array of structs of the fields, which are made from the structs of another array, called name."""
    return f"transform({array}, {name} -> named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())}))"


def _tail(z: str) -> str:
    """Upper tail of the normal distribution, by the logistic curve that is nearest to it."""
    return f"greatest(1e-12D, least(1D, 1D / (1D + exp(least(700D, greatest(-700D, 1.5976D * ({z}) + 0.07056D * power({z}, 3)))))))"


def _battery(candidates: str) -> str:
    """SQL of an array of (start, finish, encoding, n, p) for candidates (start, finish, value)."""
    encoding = "CASE " + " ".join(
        f"WHEN c.value RLIKE '^[{cls}]+$' THEN '{name}'"
        for name, cls in (("decimal", "0-9"), ("hex", "0-9a-f"), ("HEX", "0-9A-F"), ("lower", "a-z"), ("upper", "A-Z"), ("base32", "A-Z2-7"), ("base62", "A-Za-z0-9"), ("base64", "A-Za-z0-9+/"), ("base64url", "A-Za-z0-9_-"))
    ) + " ELSE 'mixed' END"
    alphabet = "CASE s.encoding " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALPHABETS.items()) + " END"
    a = _with(candidates, "c", start="c.start", finish="c.finish", value="c.value", encoding=encoding)
    a = _with(a, "s", start="s.start", finish="s.finish", encoding="s.encoding", k=f"char_length({alphabet})", x=f"transform(regexp_extract_all(s.value, '.', 0), ch -> locate(ch, {alphabet}) - 1)")
    a = _with(
        a, "s", start="s.start", finish="s.finish", encoding="s.encoding", k="cast(s.k as double)", x="s.x", n="cast(size(s.x) as double)",
        squares="aggregate(transform(array_distinct(s.x), v -> size(filter(s.x, y -> y = v))), 0D, (t, c) -> t + cast(c as double) * c)",
        mean="aggregate(s.x, 0D, (t, v) -> t + v) / size(s.x)",
        high="cast(size(filter(s.x, v -> 2 * v >= s.k)) as double)",
        runs="1D + size(filter(zip_with(slice(s.x, 1, size(s.x) - 1), slice(s.x, 2, size(s.x) - 1), (u, v) -> (2 * u >= s.k) <> (2 * v >= s.k)), y -> y))",
    )
    a = _with(
        a, "s", start="s.start", finish="s.finish", encoding="s.encoding", n="s.n",
        uniform="(s.k / s.n * s.squares - s.n - (s.k - 1)) / sqrt(2 * (s.k - 1) * (s.n - 1) / s.n)",
        mu="2 * s.high * (s.n - s.high) / s.n + 1", runs="s.runs",
        serial="coalesce(try_divide(aggregate(zip_with(slice(s.x, 1, size(s.x) - 1), slice(s.x, 2, size(s.x) - 1), (u, v) -> (u - s.mean) * (v - s.mean)), 0D, (t, v) -> t + v), aggregate(s.x, 0D, (t, v) -> t + (v - s.mean) * (v - s.mean))), 1D) + 1 / s.n",
    )
    a = _with(
        a, "s", start="s.start", finish="s.finish", encoding="s.encoding", n="s.n", p1=_tail("s.uniform"),
        p2=f"least(1D, 2 * {_tail('abs(coalesce(try_divide(s.runs - s.mu, sqrt(greatest(0D, (s.mu - 1) * (s.mu - 2) / (s.n - 1)))), 40D))')})",
        p3=f"least(1D, 2 * {_tail('abs(s.serial) * sqrt(s.n)')})",
    )
    half = "(-(ln(s.p1) + ln(s.p2) + ln(s.p3)))"
    return _with(a, "s", start="s.start", finish="s.finish", class_name="concat(s.encoding, '/', cast(floor(log2(s.n)) as string))", p=f"exp(-{half}) * (1 + {half} + {half} * {half} / 2)")


def cuts(found: DataFrame, rate: float) -> dict[str, float]:
    """The least p-value kept, of each class of encoding and length that keeps any.

    The table of counts has BINS rows a class at most, and a class is an encoding and a power of two.
    """
    binned = found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.class_name").alias("class_name"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    counts: dict[str, list[int]] = {}
    for name, b, n in binned.collect():
        counts.setdefault(name, [0] * BINS)[b] = n
    kept: dict[str, float] = {}
    for name, n in counts.items():
        random = 2 * sum(n[BINS // 2 :])
        for b in range(1, BINS):
            above = sum(n[b:])
            if above and 1 - random * (1 - b / BINS) / above <= rate:
                kept[name] = b / BINS
                break
    return kept


def _said(spans: str) -> Column:
    names = "CASE s.kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}, ':', s.start, ':', s.finish)), ',')")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1) -> DataFrame:
    """One row a document: id, n_assign, n_access, n_hex, base_sha256, spans, and found (array of start, kind, finish, value).

    Null texts are empty; a text without spans has an empty `spans`. Added spans are of kind random, and
    never overlap base spans. Rows that repeat an id are documents of their own. Extra columns play no part;
    an empty table gives no rows. `rate` is the part of added spans that may be expected to be false.
    """
    rows = unique_columns(docs, [id_col, text_col]).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = rows.select(
        "id", "text",
        F.expr(f"filter({_spans('text', ASSIGN, 0, 2)}, s -> char_length(s.value) >= {LEAST_ASSIGNED})").alias("assign"),
        F.expr(_spans("text", ACCESS, 1)).alias("access"), F.expr(_spans("text", HEX, 2)).alias("hex"),
    ).withColumn("base", F.expr("array_sort(concat(assign, access, hex))"))
    apart = "filter(runs, c -> NOT exists(base, b -> b.start < c.finish AND c.start < b.finish))"
    runs = base.withColumn("runs", F.expr(_spans("text", CANDIDATE, 3))).withColumn("runs", F.expr(apart))
    found = runs.select(
        "id", F.size("assign").cast("bigint").alias("n_assign"), F.size("access").cast("bigint").alias("n_access"), F.size("hex").cast("bigint").alias("n_hex"), "base", "runs",
        F.expr(f"CASE WHEN size(runs) > 0 THEN {_battery('runs')} ELSE cast(array() as array<struct<start:int,finish:int,class_name:string,p:double>>) END").alias("candidates"),
    )
    found = materialize(found, "spans")
    least = cuts(found, rate)
    table = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair]) if least else F.expr("cast(map() as map<string,double>)")
    found = found.withColumn("least", table)
    added = "transform(filter(arrays_zip(runs, candidates), r -> coalesce(r.candidates.p >= least[r.candidates.class_name], false)), r -> r.runs)"
    found = found.withColumn("found", F.expr(f"array_sort(concat(base, {added}))"))
    return found.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(_said("base"), 256).alias("base_sha256"), _said("found").alias("spans"), "found")
