"""Verdicts on pairs: bars and standings, turning a verdict round, evidence, block correlation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions.geometry import affine, axis_scales, inverse, linear_scale

# Standings in order, so that >= compares them.
REJECTED, CORROBORATING, ANCHOR, CLEAN = range(4)


@dataclass(frozen=True)
class Bars:
    """The default bars."""

    points: int = 5
    points_floor: int = 3
    overlap: float = 0.85
    correlation: float = 0.65
    clean_block: float = 0.9
    corroborating: float = 0.1
    scale: float = 16.0


def frames(bars: Bars = Bars()) -> Column:
    """Whether a pair's map keeps to the scale bound in every direction and one frame lies in the other to the bar."""
    least, most = axis_scales(affine())
    return (least >= 1 / bars.scale) & (most <= bars.scale) & (F.greatest("ov_a", "ov_b") >= bars.overlap)


def standing(bars: Bars = Bars()) -> Column:
    """Columns of a verdict -> its standing. A whole-frame match may be an anchor with fewer points, never clean."""
    points = F.col("n_in") >= bars.points
    steady = F.col("blk_min") >= bars.clean_block
    whole = F.col("framed") & (F.col("n_in") >= bars.points_floor) & steady
    agrees = F.col("blk") >= bars.correlation
    return (
        F.when(~frames(bars) | ~(points | whole), REJECTED)
        .when(points & F.col("centred") & agrees & steady, CLEAN)
        .when(F.col("centred") & agrees, ANCHOR)
        .when(F.col("blk") >= bars.correlation - bars.corroborating, CORROBORATING)
        .otherwise(REJECTED)
    )


def gate(bars: Bars = Bars()) -> Column:
    """What a pair needs before its pixels are worth reading: frames, and points, fewer for a whole frame on a whole frame."""
    return frames(bars) & ((F.col("n_in") >= bars.points) | (F.col("framed") & (F.col("n_in") >= bars.points_floor)))


def speaks(a_side: Column, b_side: Column) -> Column:
    """Whether a pair is asked about at all: one of two library files is not."""
    return ~((a_side == "library") & (b_side == "library"))


def asks_first(side: Column) -> Column:
    """The scanned ask before the library does."""
    return side != "library"


def perfect(n: Column) -> dict[str, Column]:
    """The verdict on two files of one working plane, without a look: the identity, with all n keypoints aligned and every block agreeing."""
    ones = {c: F.lit(1.0) for c in ("m0", "m4", "ov_a", "ov_b", "scale", "blk", "blk_min", "ncc")}
    return ones | {c: F.lit(0.0) for c in ("m1", "m2", "m3", "m5", "rot")} | {"n_in": n, "n_match": n, "blk_n": F.lit(1), "centred": F.lit(True), "framed": F.lit(True)}


def distinct_points(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and n_in: places of a, to half a pixel, that the matches (x_a, y_a, inlier) have; a place with several angles counts once."""
    half = lambda c: (F.col(c) * 2).cast("int")
    return matches.groupBy(*keys).agg(F.countDistinct(F.when(F.col("inlier"), F.struct(half("x_a").alias("x"), half("y_a").alias("y")))).alias("n_in"))


def size_offset(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and size_offset: the upper median, in octaves, of how much larger b's inlying keypoints are than a's carried by the map; 0 without any."""
    off = F.when(F.col("inlier"), F.log2(F.col("sigma_b") / (F.greatest("sigma_a", F.lit(1e-6)) * F.greatest("scale", F.lit(1e-12)))))
    return matches.withColumn("_off", off).groupBy(*keys).agg(F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _off DESC)"), F.lit(0.0)).alias("size_offset"))


def encloses_centre(keypoints: DataFrame, inliers: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and centred: whether, in a's frame or in b's, the inliers' box holds the mean of the keypoints that the map puts into the other frame.

    keypoints is keys, side (a or b), x, y and inside; inliers is keys, side, x and y.
    """
    means = keypoints.filter("inside").groupBy(*keys, "side").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    boxes = inliers.groupBy(*keys, "side").agg(*(f(c).alias(f"{name}_{c}") for c in ("x", "y") for f, name in ((F.min, "low"), (F.max, "high"))))
    holds = F.col("mx").between(F.col("low_x"), F.col("high_x")) & F.col("my").between(F.col("low_y"), F.col("high_y"))
    return boxes.join(means, [*keys, "side"], "left").groupBy(*keys).agg(F.max(F.coalesce(holds, F.lit(False))).alias("centred"))


def composed(bars: Bars = Bars()) -> Column:
    """Whether a pair put together from two others stands: its frames and its pixels have to."""
    return frames(bars) & (F.col("blk") >= bars.correlation)


def reversed_verdict(verdicts: DataFrame) -> DataFrame:
    """Verdicts read from the other end; those whose map has no inverse go."""
    back = inverse(affine())
    changed = {f"m{i}": c for i, c in enumerate(back)}
    changed |= {"a": F.col("b"), "b": F.col("a"), "ov_a": F.col("ov_b"), "ov_b": F.col("ov_a"), "lo": 1 / F.col("hi"), "hi": 1 / F.col("lo"), "scale": linear_scale(back), "rot": F.degrees(F.atan2(back[3], back[0]))}
    columns = [changed.get(c, F.col(c)).alias(c) for c in verdicts.columns]
    return verdicts.select(*columns).filter("m0 is not null")


def fit_points() -> Column:
    return F.when(F.col("n_in") > 0, F.col("n_in")).otherwise(F.col("composed_points"))


def agreement() -> Column:
    return F.when(F.col("relation").isin("identical", "same pixels"), 1.0).otherwise(F.col("pixel_correlation"))


def evidence_text() -> Column:
    """What a report says of a pair."""
    flags = F.concat(F.when(F.col("mirrored"), ", mirrored").otherwise(""), F.when(F.col("inverted"), ", inverted").otherwise(""))
    points = F.when(F.col("aligned_points").isNotNull(), F.format_string("%d points, ", F.col("aligned_points").cast("bigint"))).otherwise("")
    measured = F.concat(points, F.format_string("overlap %.3f, correlation %.3f", F.col("frame_overlap").cast("double"), F.col("pixel_correlation").cast("double")), flags)
    return F.when(F.col("relation") == "identical", "identical").when(F.col("relation") == "same pixels", "same pixels").otherwise(measured)


def block_correlation(samples: DataFrame, keys: list[str], block: str, flat: float = 16.0) -> DataFrame:
    """Samples (keys, block, a, b) -> blk, blk_n, blk_min and ncc by keys.

    Of a block: both sides flat, it abstains; one flat, 2 |cov| / (var a + var b); else |r|. ncc is |r| of all samples.
    """
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = F.count(F.lit(1)).cast("double")
    moments = samples.groupBy(*keys, block).agg(n.alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))

    def spread(x: str, y: str, xy: str) -> Column:
        return F.col(xy) / F.col("n") - F.col(x) / F.col("n") * F.col(y) / F.col("n")

    va, vb, cov = spread("sa", "sa", "aa"), spread("sb", "sb", "bb"), spread("sa", "sb", "ab")
    flat_a, flat_b = va < flat, vb < flat
    r = F.when(flat_a & flat_b, None).when(flat_a | flat_b, 2 * F.abs(cov) / (va + vb)).otherwise(F.abs(cov) / F.sqrt(va * vb))
    blocks = moments.withColumn("r", r)
    # the blocks' moments add up to those of all samples
    sums = {c: F.sum(c) for c in ("n", "sa", "sb", "aa", "bb", "ab")}
    whole = blocks.groupBy(*keys).agg(F.avg("r").alias("blk"), F.count("r").alias("blk_n"), F.min("r").alias("blk_min"), *[s.alias(c) for c, s in sums.items()])
    ncc = F.when((va > 0) & (vb > 0), F.abs(cov) / F.sqrt(F.when(va > 0, va) * F.when(vb > 0, vb)))
    return whole.select(*keys, F.coalesce("blk", F.lit(0.0)).alias("blk"), "blk_n", F.coalesce("blk_min", F.lit(0.0)).alias("blk_min"), F.coalesce(ncc, F.lit(0.0)).alias("ncc"))
