"""Pictures end to end: features, words, and verdicts on candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.functions.geometry import affine, compose, mirror
from kinsift.operators import keep
from kinsift.operators.kernels import features
from kinsift.operators.verdicts import Bars, gate
from kinsift.plans.lineage import materialize

KEYPOINTS = "x array<float>, y array<float>, sigma array<float>, angle array<float>, descriptor binary"
FEATURES = f"item string, w int, h int, n int, {KEYPOINTS}"
#: What the points alone say of a pair.
FIT = "a string, b string, n_match int, n_in int, m0 double, m1 double, m2 double, m3 double, m4 double, m5 double, ov_a double, ov_b double, scale double, rot double, centred boolean, framed boolean, size_offset double"
PIXELS = "blk double, blk_n int, blk_min double, ncc double"
# Fixed value: octaves by which the matched keypoints' sizes may be off the map's scale.
SIZE_AGREEMENT = 1.0


def describe(planes: DataFrame, most: int = features.FEATURES) -> DataFrame:
    """Features of whole planes (path, w, h, px); the planes themselves stay where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                k = features.extract(np.frombuffer(r.px, np.uint8).reshape(r.h, r.w).astype(float), most)
                rows.append((r.path, r.w, r.h, len(k.x), *(getattr(k, c).tolist() for c in ("x", "y", "sigma", "angle")), k.descriptor.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return planes.filter("state = 'whole'").select("path", "w", "h", "px").mapInPandas(run, FEATURES)


def fit_vocabulary(described: DataFrame, sample: int | None = None, seed: int = 0) -> features.Vocabulary:
    """A tree fitted on at most about `sample` descriptors (by default as many as the number of all asks for, 1,280,000 at most), an even part of every picture's."""
    total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    depth, branching, asked = features.tree_shape(max(3, total))
    step = max(1, total // max(1, sample or asked))

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item": batch["item"], "d": [np.frombuffer(d, np.uint8).reshape(-1, 128)[::step].tobytes() for d in batch["descriptor"]]})

    # in the order of names, so that the tree is the same however the pictures were dealt
    parts = described.select("item", "descriptor").mapInPandas(every, "item string, d binary").toPandas().sort_values("item")["d"]
    data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 128).astype(np.float32)
    return features.grow(data, depth, branching, seed)


def with_words(described: DataFrame, vocabulary: features.Vocabulary) -> DataFrame:
    """Features with the words of each keypoint, nearest first."""
    held = described.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["words"] = [features.quantise(held.value, np.frombuffer(d, np.uint8).reshape(-1, 128)) for d in batch["descriptor"]]
            yield batch

    return described.mapInPandas(run, f"{FEATURES}, words array<array<bigint>>")


#: Ways to see a picture again: its features change, and what takes the seen plane back to its own.
SEEN = ("mirror", "negative")


def seen_as(described: DataFrame, way: str) -> DataFrame:
    """Features of the pictures as their mirror images or negatives would have them; nothing is decoded again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                k = features.Keypoints(*(np.array(getattr(r, c), np.float32) for c in ("x", "y", "sigma", "angle")), np.frombuffer(r.descriptor, np.uint8).reshape(-1, 128))
                k = features.mirrored(k, r.w) if way == "mirror" else features.inverted(k)
                rows.append((r.item, r.w, r.h, r.n, *(getattr(k, c).tolist() for c in ("x", "y", "sigma", "angle")), k.descriptor.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return described.select(*[c.split()[0] for c in FEATURES.split(", ")]).mapInPandas(run, FEATURES)


def seen_back(fit: DataFrame, way: str, described: DataFrame) -> DataFrame:
    """FIT of pairs whose first picture was seen that way, as maps of its own plane."""
    if way != "mirror":
        return fit
    met = fit.join(described.select(F.col("item").alias("a"), F.col("w").alias("_w")), "a")
    total = compose(affine(), mirror(F.col("_w").cast("double")))
    changed = {f"m{i}": c for i, c in enumerate(total)} | {"rot": F.degrees(F.atan2(total[3], total[0])), "framed": F.lit(False)}
    return met.select(*[changed.get(c, F.col(c)).alias(c) for c in fit.columns])


def picture_postings(worded: DataFrame) -> DataFrame:
    """(item, word, position, path): the words of every keypoint, for the same retrieval as words of texts."""
    rows = worded.select("item", F.posexplode("words").alias("position", "own"))
    return rows.select("item", "position", F.posexplode("own").alias("path", "word")).select("item", "word", "position", "path")


def _keypoints(r, side: str) -> features.Keypoints:
    get = lambda c: getattr(r, f"{side}_{c}")
    return features.Keypoints(*(np.array(get(c), np.float32) for c in ("x", "y", "sigma", "angle")), np.frombuffer(get("descriptor"), np.uint8).reshape(-1, 128))


def _inside_share(m: np.ndarray, a: tuple[int, int], b: tuple[int, int], probes: int = 16) -> float:
    x, y = np.meshgrid((np.arange(probes) + 0.5) / probes * a[0], (np.arange(probes) + 0.5) / probes * a[1])
    at = np.column_stack([x.ravel(), y.ravel()]) @ m[:, :2].T + m[:, 2]
    return float(((at >= 0) & (at < b)).all(axis=1).mean())


def fit_pair(a: features.Keypoints, b: features.Keypoints, pairs: np.ndarray, size_a: tuple[int, int], size_b: tuple[int, int]) -> tuple | None:
    """What FIT has of a pair after its names, from keypoints that share a word; sizes are (width, height). Refitted to guided matches, twice at most."""
    matches, frame = features.correspond(a, b, pairs), size_b[::-1]
    if len(matches) < 2:
        return None
    found = features.best_transform(a, b, matches, frame)
    if found is None:
        return None
    m, mask = found
    own = matches[mask]
    for _ in range(2):
        more = features.guided(a, b, m, frame)
        if len(more) <= len(own):
            break
        own = more
        better = features.fit_affine(np.column_stack([a.x, a.y])[own[:, 0]].astype(float), np.column_stack([b.x, b.y])[own[:, 1]].astype(float))
        if better is None:
            break
        m = better
    # the map is fitted last to the matches that lie nearest to it: guided ones may be off by the whole tolerance
    pa, pb = np.column_stack([a.x, a.y])[own[:, 0]].astype(float), np.column_stack([b.x, b.y])[own[:, 1]].astype(float)
    for _ in range(3):
        off = np.hypot(*(pa @ m[:, :2].T + m[:, 2] - pb).T)
        near = off <= max(1.0, 2 * float(np.median(off)))
        better = features.fit_affine(pa[near], pb[near]) if near.sum() >= 6 else None
        if better is None:
            break
        m = better
    back = keep.inverse(m)
    linear, tolerance = m[:, :2], max(3.0, 0.015 * np.hypot(*size_b))
    corners = np.array([(0, 0), (1, 0), (0, 1), (1, 1)])
    met = np.hypot(*((corners * size_a) @ linear.T + m[:, 2] - corners * size_b).T) <= tolerance
    offset = features.size_offset(a, b, m, own)
    return (
        len(matches), features.distinct_points(a, own), *m.ravel().tolist(), _inside_share(m, size_a, size_b), _inside_share(back, size_b, size_a) if back is not None else 0.0,
        float(np.sqrt(abs(np.linalg.det(linear)))), float(np.degrees(np.arctan2(m[1, 0], m[0, 0]))),
        features.encloses_centre(a, b, m, own, size_a[::-1], frame) and abs(offset) <= SIZE_AGREEMENT, bool(met.all()), offset,
    )


def fits(pairs: DataFrame, asking: DataFrame, worded: DataFrame) -> DataFrame:
    """FIT of each pair (a, b) whose keypoints in common words determine a map; a's features are those of asking."""
    a = asking.select(*[F.col(c).alias("a" if c == "item" else f"a_{c}") for c in asking.columns])
    b = worded.select(*[F.col(c).alias("b" if c == "item" else f"b_{c}") for c in worded.columns])
    met = pairs.select("a", "b").join(a, "a").join(b, "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                found = fit_pair(_keypoints(r, "a"), _keypoints(r, "b"), features.shared_words(r.a_words, r.b_words), (r.a_w, r.a_h), (r.b_w, r.b_h))
                if found is not None:
                    rows.append((r.a, r.b, *found))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")])

    return met.mapInPandas(run, FIT)


def verify(pairs: DataFrame, worded: DataFrame, planes: DataFrame, bars: Bars = Bars()) -> DataFrame:
    """FIT and PIXELS of the pairs that pass the gate: only those meet their planes (path, w, h, px)."""
    return read_pixels(fits(pairs, worded, worded), planes, bars)


def read_pixels(fit: DataFrame, planes: DataFrame, bars: Bars = Bars()) -> DataFrame:
    near = materialize(fit.filter(gate(bars)), "gated")
    a = planes.select(F.col("path").alias("a"), F.col("w").alias("a_w"), F.col("h").alias("a_h"), F.col("px").alias("a_px"))
    b = planes.select(F.col("path").alias("b"), F.col("w").alias("b_w"), F.col("h").alias("b_h"), F.col("px").alias("b_px"))
    met = near.join(a, "a").join(b, "b")
    names = [c.split()[0] for c in f"{FIT}, {PIXELS}".split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples():
                both = [np.frombuffer(p, np.uint8).reshape(h, w) for p, h, w in ((r.a_px, r.a_h, r.a_w), (r.b_px, r.b_h, r.b_w))]
                found.append(features.pixel_check(*both, np.array([r.m0, r.m1, r.m2, r.m3, r.m4, r.m5]).reshape(2, 3)))
            for i, name in enumerate(c.split()[0] for c in PIXELS.split(", ")):
                batch[name] = [f[i] for f in found]
            yield batch[names]

    return met.mapInPandas(run, f"{FIT}, {PIXELS}")
