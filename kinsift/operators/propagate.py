"""Claims carried through a cluster: poses from its best-connected file, and pairs put together from two others."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.operators.components import connected_components
from kinsift.operators.graph import propagation_budget
from kinsift.plans.lineage import materialize

MAP = [f"m{i}" for i in range(6)]


def _matrix(row: tuple) -> np.ndarray:
    return np.array([[row[0], row[1], row[2]], [row[3], row[4], row[5]], [0, 0, 1]], float)


def poses(edges: list[tuple]) -> dict:
    """Of edges (a, b, n_in, matrix a -> b): each file's map onto the root, which is the file with most edges, the lowest on ties.

    Breadth first, the best-supported edges of a file first.
    """
    around = defaultdict(list)
    for a, b, n, m in edges:
        around[a].append((-n, b, np.linalg.inv(m)))
        around[b].append((-n, a, m))
    root = min(around, key=lambda v: (-len(around[v]), v))
    found, todo = {root: np.eye(3)}, deque([root])
    while todo:
        at = todo.popleft()
        for _, other, onto in sorted(around[at], key=lambda e: e[:2]):
            if other not in found:
                found[other] = found[at] @ onto
                todo.append(other)
    return found


def composed_pairs(edges: DataFrame, budget: float | None = None) -> DataFrame:
    """(a, b, m0..m5) of pairs of a cluster that no edge states, with the map through the cluster's root.

    edges is (a, b, n_in, m0..m5), a's frame onto b's. A cluster costs its number of unstated pairs; clusters
    in order of cost are done in full while their sum keeps to the budget, later ones only for pairs with
    their root, so rows never grow beyond the budget and the number of files.
    """
    kind = edges.schema["a"].dataType.simpleString()
    labels = connected_components(edges.select("a", "b"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(edges.select("a", "b", "n_in", *MAP).join(labels, F.col("a") == F.col("node")).drop("node"), "placed")
    stated = placed.groupBy("component").agg(F.count(F.lit(1)).alias("stated"))
    costs = sizes.join(stated, "component").select(F.col("component").alias("cluster"), (F.col("n") * (F.col("n") - 1) / 2 - F.col("stated")).alias("cost"))
    limit = float(edges.count()) if budget is None else budget
    full = materialize(propagation_budget(costs, limit).select(F.col("cluster").alias("component"), "full"), "budget")

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.a, r.b, r.n_in, _matrix([getattr(r, m) for m in MAP])) for r in part.itertuples()]
        known = {frozenset(r[:2]) for r in rows}
        found = poses(rows)
        root = next(iter(found))
        files = sorted(found)
        pairs = [(x, y) for i, x in enumerate(files) for y in files[i + 1 :]] if part["full"].iloc[0] else [(min(root, f), max(root, f)) for f in files if f != root]
        out = [(x, y, *(np.linalg.inv(found[y]) @ found[x])[:2].ravel()) for x, y in pairs if frozenset((x, y)) not in known]
        return pd.DataFrame(out, columns=["a", "b", *MAP])

    return placed.join(full, "component").groupBy("component").applyInPandas(settle, f"a {kind}, b {kind}, " + ", ".join(f"{m} double" for m in MAP))


def propagate(edges: DataFrame, check, rounds: int = 8) -> DataFrame:
    """Rounds of composed pairs put to check(pairs) -> edges that stand; what stands is an edge of the next round. Ends when nothing new stands."""
    known = materialize(edges.withColumn("how", F.lit("direct")), "claims")
    tried = None
    for _ in range(rounds):
        asked = composed_pairs(known)
        if tried is not None:
            asked = asked.join(tried, ["a", "b"], "left_anti")
        asked = materialize(asked, "asked")
        stands = materialize(check(asked).withColumn("how", F.lit("propagated")), "stands")
        if not stands.limit(1).count():
            break
        known = materialize(known.unionByName(stands), "claims")
        now = asked.select("a", "b")
        tried = now if tried is None else tried.union(now)
    return known


def corroborated(claims: DataFrame, weaker: DataFrame) -> DataFrame:
    """Weaker verdicts both of whose ends are in one cluster of claims, not yet claimed; they add pairs, never clusters."""
    labels = materialize(connected_components(claims.select("a", "b")), "labels")
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    within = weaker.join(a, "a").join(b, "b").filter("_ca = _cb").drop("_ca", "_cb")
    return within.join(claims.select("a", "b"), ["a", "b"], "left_anti")
