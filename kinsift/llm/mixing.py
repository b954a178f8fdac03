"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies, in proportion to its weight up to a cap; what the cap cuts
off goes to the source's other documents. Its whole part is allocated for certain; the rest is an inclusion
probability, and documents are ranked by their random odds divided by the odds of that probability. Each
source takes its ranking from the top until its words are used up; where a long document stops it early it
goes on with those below that still fit, and at the end takes at most one more, the one whose size comes
nearest to what is left.

Sources can be large, so a ranking is never one task's work: rows are dealt by ranges of
(source, rank), each range is summed, and the ranges' sums give every row its running total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.llm.common import free_name, join_by_hot_key, materialize, sized_join, unique_columns

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (1, 2, 3)


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(source, source_size) -> also target: shares of all words by weight, none above cap times the source's size.

    Sources by code point, null last, weigh as the cycle says, over and over. With sources in the order
    of size over weight, those before some place stop at their cap and all others share the rest by weight.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    # one row a source: these windows see as many rows as there are sources
    table = sizes.withColumn("_n", F.row_number().over(in_order) - 1)
    table = table.withColumn("_weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("_n") % len(cycle) + 1).cast("int")).cast("double"))
    table = table.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    table = table.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_used", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    table = table.withColumn("_level", (F.sum("source_size").over(everything) - F.col("_capped")) / (F.sum("_weight").over(everything) - F.col("_used")))
    level = F.min_by(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level")), F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_n")))).over(everything)
    return table.withColumn("_share", level).select("source", "source_size", F.least("_cap", F.col("_weight") * F.coalesce("_share", F.lit(0.0))).alias("target"))


def length_weight(size: Column) -> Column:
    """The registered mixes' weight of a document: 1 for none of its words, one more each time that they double."""
    return F.floor(F.log2(size + 1)) + 1


def expected_copies(classes: DataFrame, cap: float) -> DataFrame:
    """(source_key, weight, words, target) to (source_key, weight, expected): least(cap, level * weight) with the level that gives each source its target.

    A source has few classes: weights count with two significant digits. From the heaviest class on, those
    before some place stop at the cap and all others share the rest by weight.
    """
    own = Window.partitionBy("source_key")
    heavier = own.orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    table = classes.withColumn("_capped", F.coalesce(F.sum("words").over(heavier), F.lit(0)))
    table = table.withColumn("_open", F.sum(F.col("words") * F.col("weight")).over(own) - F.coalesce(F.sum(F.col("words") * F.col("weight")).over(heavier), F.lit(0.0)))
    table = table.withColumn("_level", F.when(F.col("_open") > 0, (F.col("target") - F.lit(cap) * F.col("_capped")) / F.col("_open")))
    fits = F.col("_level") * F.col("weight") <= F.lit(cap) * (1 + 1e-12)
    table = table.withColumn("_found", F.max_by(F.when(fits, F.col("_level")), F.when(fits, F.col("weight"))).over(own))
    # without a level that fits, all documents of some weight stop at the cap
    expected = F.when(F.col("weight") > 0, F.least(F.lit(cap), F.coalesce(F.col("_found") * F.col("weight"), F.lit(cap)))).otherwise(0.0)
    return table.select("source_key", "weight", F.greatest(F.lit(0.0), expected).alias("expected"))


#: Of a ranking; a draw differs from document to document, the rest tells rows apart that repeat an id.
ORDER = ["rank", "draw", "size", "row"]


def _running_sums(pool: DataFrame, left: DataFrame) -> DataFrame:
    """Of each row: the words of its source down to it in the ranking, and the words its source has left to take."""
    pool = pool.repartitionByRange("source_key", *ORDER).withColumn("part", F.spark_partition_id())
    pool = materialize(pool, "ranked")
    parts = pool.groupBy("source_key", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and source that meet
    parts = parts.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(left, "source_key").select("source_key", "part", "ahead", "left")
    running = F.sum("size").over(Window.partitionBy("source_key", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    joined = sized_join(pool, materialize(parts, "parts"), ["source_key", "part"], "inner")
    return materialize(joined.withColumn("running", F.col("ahead") + running).drop("ahead", "part"), "running")


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Callable[[Column], Column] | str | None = None, cap: float = 3.0, cycle: tuple[int, ...] = CYCLE, seed: int = 0, tolerance: float = 0.005
) -> DataFrame:
    """One row a document: id, source, size (words), source_size, target, copies, taken (words).

    Null and empty texts have size 0 and are taken 0 times their words. Null sources are one source, the
    last. `weight` is a column's name or a function of the size: a document's expected copies are in proportion
    to it within its source, cap at most; it counts with two significant digits, null as 1 and less than 0 as 0.
    The draw depends on seed and id alone, so reruns agree; rows that repeat an id draw alike and rank by
    their size. Extra columns play no part; an empty table gives no rows.
    """
    given = F.lit(1.0) if weight is None else F.col("given") if isinstance(weight, str) else weight(F.col("size"))
    given = F.greatest(F.coalesce(given.cast("double"), F.lit(1.0)), F.lit(0.0))
    power = F.pow(F.lit(10.0), F.floor(F.log10(given)) - 1)
    rows = unique_columns(docs, list(dict.fromkeys([id_col, text_col, source_col, *([weight] if isinstance(weight, str) else [])]))).select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint").alias("draw"),
        *([F.col(weight).alias("given")] if isinstance(weight, str) else []),
    )
    rows = rows.select("id", "source", "size", "draw", F.when(given > 0, F.round(given / power) * power).otherwise(0.0).alias("weight"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))), "sizes")
    classes = materialize(rows.groupBy("source", "source_key", "weight").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "classes")
    sums = materialize(classes.groupBy("source", "source_key").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), "sources")
    targets = source_targets(sums.select("source", "source_size"), cap, cycle)
    keyed = materialize(targets.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source").join(sums.select("source_key", "n"), "source_key"), "targets")
    total = rows.count()
    copies = materialize(expected_copies(classes.select("source_key", "weight", "words").join(keyed.select("source_key", "target"), "source_key"), float(cap)), "weights")
    rows = join_by_hot_key(rows, keyed, "source_key", "n", total).drop("n")
    rows = sized_join(rows, copies, ["source_key", "weight"], "inner")
    rows = rows.withColumn("expected", F.round("expected", 12)).withColumn("whole", F.floor("expected")).withColumn("chance", F.col("expected") - F.col("whole"))
    rows = materialize(rows, "expected")
    left = rows.groupBy("source_key").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"), F.first("target").alias("target"))
    left = materialize(left, "left")
    u = (F.col("draw") + F.lit(0.5)) / F.lit(float(1 << 52))
    pool = rows.filter("chance > 0 and size > 0").select("row", "source_key", "size", "draw", ((u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))).alias("rank"))
    chosen = None
    inside = F.col("running") <= F.col("left")
    while True:
        ranked = _running_sums(pool, left)
        reached = ranked.groupBy("source_key").agg(F.max(F.when(inside, F.col("running"))).alias("_reached"))
        gaps = left.join(reached, "source_key").select("source_key", "target", (F.col("left") - F.coalesce("_reached", F.lit(0))).alias("gap"))
        outside = sized_join(ranked.filter(~inside).drop("left", "running"), materialize(gaps, "gaps"), "source_key", "inner")
        # a long document stopped this source well below its target: go on down the ranking past it
        go_on = (F.col("gap") > tolerance * F.col("target")) & (F.col("size") <= F.col("gap"))
        flags = outside.groupBy("source_key").agg(F.max(go_on).alias("go_on"))
        outside = materialize(sized_join(outside, materialize(flags, "flags"), "source_key", "inner"), "outside")
        miss = F.abs(F.col("size") - F.col("gap"))
        last = outside.filter(~F.col("go_on") & (miss < F.col("gap"))).groupBy("source_key").agg(F.min(F.struct(miss.alias("miss"), *ORDER)).alias("pick"))
        taken = ranked.filter(inside).select("row").union(last.select("pick.row"))
        chosen = taken if chosen is None else chosen.union(taken)
        pool = outside.filter(F.col("go_on") & (F.col("size") <= F.col("gap"))).select("row", "source_key", "size", "draw", "rank")
        if not pool.limit(1).count():
            break
        left = outside.filter("go_on").groupBy("source_key").agg(F.first("gap").alias("left"), F.first("target").alias("target"))
    picked = rows.join(chosen.withColumn("more", F.lit(1)), "row", "left")
    copies = F.col("whole") + F.coalesce("more", F.lit(0))
    return picked.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns, each repeated as often as the mix takes it.

    Documents without words go. Rows that repeat an id, a source and a size share their copies evenly; of what
    is left over, the first rows by text get one each.
    """
    taken = pareto_mix(docs, id_col, text_col, source_col, **options)
    taken = taken.filter("size > 0").groupBy(F.col(id_col).alias("id"), "source", "size")
    taken = taken.agg(F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("rows")).filter("sum > 0")
    taken = materialize(taken.select(F.struct("id", "source", "size").alias("k"), F.expr("cast(sum div rows as int)").alias("copies"), F.expr("cast(sum % rows as int)").alias("over")), "copies")
    key, mix, copy, twin = (free_name(docs, f"_{x}") for x in ("key", "mix", "copy", "twin"))
    own = [f"`{c}`" for c in docs.columns]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    on = [F.col(f"{key}.{x}").eqNullSafe(F.col(f"{mix}.k.{x}")) for x in ("id", "source", "size")]
    on = on[0] & on[1] & on[2]
    repeat = lambda df: df.filter(F.col(f"{mix}.copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{mix}.copies")))).select(*own)
    even, uneven = (taken.filter(x).select(F.struct("*").alias(mix)) for x in ("over = 0", "over > 0"))
    found = repeat(sized_join(keyed, even, on, "inner"))
    if not uneven.limit(1).count():
        return found
    # the first rows by text of those that repeat an id, a source and a size get one copy more
    dealt = sized_join(keyed, uneven, on, "inner").withColumn(twin, F.row_number().over(Window.partitionBy(key).orderBy(F.col(text_col))))
    more = F.col(mix).withField("copies", F.col(f"{mix}.copies") + (F.col(twin) <= F.col(f"{mix}.over")).cast("int"))
    return found.union(repeat(dealt.withColumn(mix, more)))
