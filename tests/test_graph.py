"""Graph rules on hand-built edges, in any order of the edges."""

import random

import pytest
from pyspark.sql import functions as F

from kinsift.operators import graph
from kinsift.operators.components import connected_components
from kinsift.plans import running

TWO_FAMILIES = [(1, 2), (2, 3), (1, 3), (3, 10), (10, 11), (11, 12), (10, 12), (20, 21)]


def shuffled(edges, seed):
    edges = list(edges)
    random.Random(seed).shuffle(edges)
    return edges


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    df = spark.createDataFrame(shuffled(TWO_FAMILIES + [(5, 5)], seed), "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 12: 1, 20: 20, 21: 20, 5: 5}


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = [(i, i + 1) for i in range(60)]
    assert {r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bridge_between_two_families_is_found():
    assert graph.cut_edges(TWO_FAMILIES) == {(3, 10): 3, (20, 21): 1}


def test_bridge_demotion(spark):
    df = spark.createDataFrame([(a, b, True) for a, b in TWO_FAMILIES], "a long, b long, clean boolean")
    kept = {(r["a"], r["b"]): r["clean"] for r in graph.demote_bridges(df).collect()}
    assert [e for e, c in kept.items() if not c] == [(3, 10)]


def test_election_prefers_reach_then_rank_then_order():
    star = [(1, 2), (1, 3), (1, 4), (4, 5)]
    assert graph.elect(star, {}) == [(1, [1, 2, 3, 4]), (4, [1, 4, 5])]
    assert graph.elect([(1, 2)], {2: 5}) == [(2, [1, 2])]
    assert graph.elect([(1, 2)], {}) == [(1, [1, 2])]


@pytest.mark.parametrize("seed", range(5))
def test_election_covers_all_and_members_are_neighbours(seed):
    r = random.Random(seed)
    edges = [tuple(r.sample(range(20), 2)) for _ in range(30)]
    around = graph.Neighbours(edges)
    groups = graph.elect(edges, {})
    assert {m for _, ms in groups for m in ms} == set(around)
    assert all(m == head or m in around[head] for head, ms in groups for m in ms)
    assert graph.elect(shuffled(edges, seed), {}) == groups


def test_weak_edges_join_a_fragment_but_not_two_families():
    family = [(1, 2, True, 9, 0.9), (2, 3, True, 9, 0.9), (1, 3, True, 9, 0.9)]
    other = [(10, 11, True, 9, 0.9), (11, 12, True, 9, 0.9), (10, 12, True, 9, 0.9)]
    lone = [(3, 4, False, 5, 0.7)]
    cluster, weak = graph.admit_edges(family + lone)
    assert weak == {(3, 4)} and len(set(cluster.values())) == 1
    crossed = [(1, 10, False, 8, 0.8), (2, 11, False, 8, 0.8), (3, 12, False, 8, 0.8)]
    cluster, weak = graph.admit_edges(family + other + crossed)
    assert weak == set() and cluster[1] != cluster[10]
    one_for_all = [(1, 10, False, 8, 0.8), (1, 11, False, 8, 0.8), (1, 12, False, 8, 0.8), *[(k, 10, False, 7, 0.7) for k in (2, 3)]]
    assert graph.admit_edges(family + other + one_for_all)[1] == {e[:2] for e in one_for_all}


def test_shared_part_keeps_its_larger_home(spark):
    two_way = [(1, 2, True, 0.9, 0.9), (2, 3, True, 0.9, 0.9), (10, 11, True, 0.9, 0.9)]
    part = [(1, 50, True, 0.2, 0.9), (2, 50, True, 0.2, 0.9), (10, 50, True, 0.2, 0.9)]
    df = spark.createDataFrame(two_way + part, "a long, b long, clean boolean, ov_a double, ov_b double")
    assert {(r["a"], r["b"]) for r in graph.demote_shared_parts(df).collect() if not r["clean"]} == {(10, 50)}


def test_keeper_chain_ends_where_a_file_stays_and_loops_end_nowhere(spark):
    rows = [(1, "DELETE", 2), (2, "DELETE", 3), (3, "KEEP", None), (7, "DELETE", 8), (8, "DELETE", 7), (9, "DELETE", None)]
    found = {r["item"]: r["kept"] for r in graph.keeper_chain(spark.createDataFrame(rows, "item long, action string, keeper long")).collect()}
    assert found == {1: 3, 2: 3, 7: None, 8: None, 9: None}


@pytest.mark.parametrize("seed", range(12))
def test_election_equals_counting_every_time(seed):
    r = random.Random(seed)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(50)]
    better = {i: r.randrange(4) for i in range(30)}
    around = graph.Neighbours(pairs)
    waiting, want = set(around), []
    while waiting:
        stands_for = {v: len(near & waiting) + (v in waiting) for v, near in around.items()}
        head = min(around, key=lambda v: (-stands_for[v], -better[v], v))
        want.append((head, sorted(around[head] | {head})))
        waiting -= around[head] | {head}
    assert graph.elect(pairs, better) == want


def test_running_sums_over_ranges(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(50), r.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, size long, value long").repartition(7)
    found = {x["id"]: (x["up_to"], x["n"]) for x in running.numbered(running.running_sum(df, [running.Down(F.col("size")), F.col("id")], F.col("value"), "up_to"), [F.col("id")], "n").collect()}
    total, want = 0, {}
    for i, _, value in sorted(rows, key=lambda x: (-x[1], x[0])):
        total += value
        want[i] = total
    assert found == {i: (want[i], i + 1) for i in range(3000)}
    assert running.numbered(df.limit(0), [F.col("id")], "n").count() == 0
