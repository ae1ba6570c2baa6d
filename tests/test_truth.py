import itertools
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalar as S
from gaugeworks.operators import search as Q
from gaugeworks.operators import truth as T

COMPONENT = "board string, cid string, ctype string, value double, package string, classes array<array<int>>"
TERMINAL = "board string, cid string, idx int, tid string"
INCIDENCE = "board string, tid string, nid string"
OBSERVED = "board string, cid string, value_visible boolean, hidden array<string>, identity string, partition array<array<int>>"


def board(spark, parts, nets, observed):
    """parts: cid -> (type, value, package, classes, number of terminals); nets: nid -> terminals."""
    component = spark.createDataFrame([("b", k, t, v, p, cl) for k, (t, v, p, cl, _) in parts.items()], COMPONENT)
    terminal = spark.createDataFrame([("b", k, i, f"{k}.{i}") for k, x in parts.items() for i in range(x[4])], TERMINAL)
    incidence = spark.createDataFrame([("b", t, n) for n, ts in nets.items() for t in ts], INCIDENCE)
    return component, terminal, incidence, spark.createDataFrame([("b", *o) for o in observed], OBSERVED)


def test_scorable_graph(spark):
    parts = {
        "R1": ("resistor", 10.0, None, None, 2), "U1": ("ic", 5.0, None, [[0], [1, 2], [3]], 4), "J1": ("connector", None, "CONN-SMD_4P", None, 6), "J2": ("connector", None, "HDR_6P-X", None, 6), "X1": ("ic", 1.0, None, None, 3),
    }
    nets = {"n1": ["R1.0", "U1.0", "J1.0", "J1.4"], "n2": ["R1.1", "J1.1", "J1.5"], "n3": ["J2.0", "J2.1", "J2.2", "J2.3", "J2.4", "J2.5"], "n4": ["U1.1", "U1.3", "X1.0", "X1.2"]}
    observed = [("R1", True, [], "all", None), ("U1", False, ["U1.1"], "partition", [[0, 2], [1]]), ("J1", False, [], "all", None)]
    out = T.scorable(*board(spark, parts, nets, observed))
    comp = {r.cid: r for r in out["component"].collect()}
    assert (comp["R1"].value, comp["R1"].classes, comp["R1"].widened) == (10.0, [[0, 1]], False)
    # U1 loses its second terminal: classes [[0], [1], [2]], then 0 and 2 can't be told apart
    assert (comp["U1"].value, comp["U1"].source_value, comp["U1"].classes, comp["U1"].widened) == (None, 5.0, [[0, 2], [1]], True)
    assert comp["J1"].folded == ["J1.4", "J1.5"] and comp["J1"].classes == [[0], [1], [2], [3]]
    assert comp["J2"].folded is None and comp["J2"].classes == [[0, 1, 2, 3, 4, 5]]  # six pads declared, nothing to fold; no observation
    assert comp["X1"].classes == [[0, 1, 2]] and comp["X1"].value is None
    assert sorted((r.cid, r.idx, r.tid) for r in out["terminal"].where("cid = 'U1'").collect()) == [("U1", 0, "U1.0"), ("U1", 1, "U1.2"), ("U1", 2, "U1.3")]
    assert {r.tid for r in out["incidence"].collect()} == {t for ts in nets.values() for t in ts} - {"U1.1", "J1.4", "J1.5"}


def test_partitions_and_default_classes(spark):
    assert T.merged_partitions([[0, 1], [2], [3]], [[1, 2], [0], [3]], 4) == [[0, 1, 2], [3]]
    assert T.merged_partitions([], [], 3) == [[0], [1], [2]]
    rows = [("resistor", 2, None), ("resistor", 3, None), ("led", 2, []), ("ic", 2, [[0, 1]]), ("ic", 0, None)]
    got = spark.createDataFrame(rows, "t string, n int, c array<array<int>>").select(S.default_classes(F.col("t"), F.col("n"), F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == [[[0, 1]], [[0], [1], [2]], [[0], [1]], [[0, 1]], []]


def test_spatial_faults(spark):
    graph = spark.createDataFrame([("b", "s1", "top"), ("x", "s0", None)], "board string, schema string, frame string")
    component = spark.createDataFrame([("b", "c1", "ic", 0.5, 1.0), ("b", "c2", "ic", 1.1, 0.0), ("b", "c3", "ic", None, 0.0), ("b", "c4", "ic", float("nan"), 0.1), ("b", "c5", "ic", 1.0 + 1e-10, 0.0)], "board string, cid string, ctype string, x double, y double")
    terminal = spark.createDataFrame([("b", "c1", 0, "t1"), ("b", "c1", 1, "t2"), ("b", "c2", 0, "t3"), ("b", "c2", 1, "t4")], TERMINAL)
    place = spark.createDataFrame([("b", "t1", "c1", 0.5, -0.5), ("b", "t2", "c2", 0.0, 0.0), ("b", "t3", "c2", 0.7, 0.0), ("b", "t3", "c2", 0.1, 0.0), ("b", "t9", "c1", 0.0, 0.0)], "board string, tid string, parent string, x double, y double")
    got = sorted((r.board, r.rule, r.id) for r in T.spatial_faults(graph, component, terminal, place, "s1", "top").collect())
    assert got == [
        ("b", "centre", "c2"), ("b", "centre", "c3"), ("b", "centre", "c4"), ("b", "parent", "t2"), ("b", "place repeated", "t3"), ("b", "place without terminal", "t9"), ("b", "relative position", "t3"), ("b", "terminal without place", "t4"),
        ("x", "frame", None), ("x", "schema", "s0"),
    ]
    assert T.clamped(component.where("cid = 'c5'"), 0, 1).collect()[0].x == 1.0


def test_ranks_and_order_of_search(spark):
    pairs = spark.createDataFrame([("b", p, g) for p in "abcd" for g in "wxyz"], "board string, p string, g string")
    assert sorted(r.p + r.g for r in T.rank_pruned(pairs, "board", 0).collect()) == ["aw", "bx", "cy", "dz"]
    assert T.rank_pruned(pairs, "board", 1).count() == 10
    some = pairs.where("g <> 'w' or p = 'a'").where("g <> 'z' or p = 'b'")
    terminal = spark.createDataFrame([("b", "z", 0, "1"), ("b", "z", 1, "2"), ("b", "x", 0, "3")], TERMINAL)
    assert [r.g for r in T.most_constrained(some, terminal).orderBy("place").collect()] == ["z", "w", "x", "y"]


def plain_graph(rng, n):
    parts = {f"c{k}": Q.Part(f"c{k}", rng.choice(["resistor", "ic", "led"]), [f"c{k}.{i}" for i in range(rng.randrange(1, 4))], rng.choice([None, 1.0, 2.0])) for k in range(n)}
    nets = {t: f"n{rng.randrange(3)}" for p in parts.values() for t in p.terminals if rng.random() < 0.9}
    return Q.Board(parts, nets)


def exhaustive(pred, true):
    """The largest weight over all component maps, net maps and terminal orders."""
    best = 0.0
    names = list(true.parts)
    for k in range(min(len(pred.parts), len(names)) + 1):
        for ps in itertools.permutations(pred.parts, k):
            for gs in itertools.combinations(names, k):
                scores = [Q.part_score(pred.parts[p], true.parts[g]) for p, g in zip(ps, gs)]
                if None in scores:
                    continue
                orders = []
                for p, g in zip(ps, gs):
                    n, own = len(pred.parts[p].terminals), []
                    groups = true.parts[g].groups()
                    for picks in itertools.product(*[itertools.permutations(x) for x in groups]):
                        o = [None] * n
                        for here, there in zip(groups, picks):
                            for a, b in zip(here, there):
                                if a < n:
                                    o[a] = b
                        own.append(o)
                    orders.append(own)
                for choice in itertools.product(*orders):
                    pairs = {}
                    for p, g, o in zip(ps, gs, choice):
                        for t, place in zip(pred.parts[p].terminals, o):
                            a = pred.net_of.get(t)
                            b = None if place is None else true.net_of.get(true.parts[g].terminals[place])
                            if a and b:
                                pairs[a, b] = pairs.get((a, b), 0) + 1
                    left, right = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
                    wide = right + [None] * len(left)
                    hit = max((sum(pairs.get((a, b), 0) for a, b in zip(left, pick)) for pick in itertools.permutations(wide, len(left))), default=0)
                    best = max(best, sum(scores) + hit)
    return best


def test_common_subgraph_against_exhaustive_search():
    rng = random.Random(3)
    whole = 0
    for _ in range(12):
        pred, true = plain_graph(rng, 3), plain_graph(rng, 3)
        got = Q.common_subgraph(pred, true)
        want = exhaustive(pred, true)
        assert got.exact and got.weight <= want + 1e-9
        whole += abs(got.weight - want) < 1e-9  # the alternation is a local search
    assert whole >= 10
    same = plain_graph(rng, 5)
    assert Q.common_subgraph(same, same).score == pytest.approx(1.0) or any(p.value == 0 for p in same.parts.values())
    assert Q.common_subgraph(Q.Board({}, {}), same).score == 0 and not Q.common_subgraph(same, same, nodes=3).exact


def test_common_subgraph_over_tables(spark):
    parts = {"R1": ("resistor", 10.0, None, None, 2), "U1": ("ic", None, None, None, 3)}
    nets = {"n1": ["R1.0", "U1.0"], "n2": ["R1.1", "U1.1"], "n3": ["U1.2"]}
    c, t, i, _ = board(spark, parts, nets, [("R1", True, [], "all", None)])
    true = {"component": c, "terminal": t, "incidence": i}
    # the same graph under other names, the resistor the other way round
    renamed = {"component": c.withColumn("cid", F.concat(F.lit("z"), "cid")), "terminal": t.select("board", F.concat(F.lit("z"), "cid").alias("cid"), F.when(F.col("cid") == "R1", 1 - F.col("idx")).otherwise(F.col("idx")).cast("int").alias("idx"), "tid"), "incidence": i.withColumn("nid", F.concat(F.lit("m"), "nid"))}
    r = Q.soft_common_subgraph(renamed, true).collect()[0]
    assert (r.score, r.weight, r.incidences, r.exact) == (1.0, 7.0, 5, True)
    none = {k: v.where("false") for k, v in true.items()}
    assert [(x.board, x.score) for x in Q.soft_common_subgraph(none, true).collect()] == [("b", 0.0)]
