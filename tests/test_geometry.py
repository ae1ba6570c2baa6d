import itertools
import tracemalloc

import numpy as np
import pytest

from gaugeworks.operators import geometry as G
from gaugeworks.operators import kernels
from gaugeworks.plans.geometry_queries import CORNERS, FACES, box_meshes

BOX, TRI = np.array(CORNERS, float), np.array(FACES)


def cube(edge, at=(0, 0, 0)):
    return np.array([(x, y, z) for x in range(edge) for y in range(edge) for z in range(edge)]) + np.array(at)


def cells(spark, shape, array, **more):
    names = ["shape", *more, "ix", "iy", "iz"]
    return spark.createDataFrame([(shape, *more.values(), *map(int, r)) for r in array], names)


def test_rotations_are_24_proper_and_begin_with_the_identity():
    r = kernels.rotations()
    assert len(r) == 24 == len({m.tobytes() for m in r}) and np.array_equal(r[0], np.eye(3)) and all(round(np.linalg.det(m)) == 1 for m in r)


def test_fill_closes_hollows_and_leaves_open_ones():
    solid = kernels.as_set(cube(5))
    hollow = np.array(sorted(solid - kernels.as_set(cube(3, (1, 1, 1)))))
    assert kernels.as_set(kernels.fill(hollow)) == solid
    holed = np.array([c for c in hollow.tolist() if tuple(c) != (0, 2, 2)])
    assert kernels.as_set(kernels.fill(holed)) == kernels.as_set(holed)


def test_surface_cells_do_not_depend_on_chunks():
    whole = kernels.surface_cells(BOX * 3.1, TRI, 0.4)
    assert np.array_equal(whole, kernels.surface_cells(BOX * 3.1, TRI, 0.4, most=7))
    assert len(kernels.fill(whole)) == 9**3


def test_halved_surfaces_hold_each_point_once(monkeypatch):
    """A grid instead of 4^k triangles: nothing is sorted that is many times the points; cells are those of single splits."""
    vertices, most = BOX * [4.7, 0.93, 1.0], []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: most.append(len(x)) or unique(x, *a, **k))
    got = kernels.surface_cells(vertices, TRI, 0.5)
    assert max(most) < 10_000
    assert np.array_equal(got, kernels.surface_cells(vertices, TRI, 0.5, most=3))


def test_best_iou_undoes_a_rotation_but_not_a_mirror():
    rng = np.random.default_rng(2)
    shape = np.unique(rng.integers(0, 6, (40, 3)), axis=0)
    for r in kernels.rotations()[[0, 5, 17]]:
        assert kernels.best_iou(shape, kernels.turned(shape, r))[0] == 1.0
    assert kernels.best_iou(shape, kernels.turned(shape, np.diag([-1, 1, 1])))[0] < 1.0
    assert kernels.best_iou(shape, np.zeros((0, 3), int)) == (0.0, 0)


def test_mesh_facts_euler_and_weld(spark):
    v = spark.createDataFrame([("b", k, *(2.0 * c for c in p)) for k, p in enumerate(CORNERS)], "shape string, vid int, x double, y double, z double")
    t = spark.createDataFrame([("b", k, *f) for k, f in enumerate(FACES)], "shape string, tid int, a int, b int, c int")
    r = G.mesh_facts(v, t).collect()[0]
    assert r.area == pytest.approx(24) and abs(r.volume) == pytest.approx(8) and r.triangles == 12
    e = G.edge_facts(t).collect()[0]
    assert (e.vertices, e.edges, e.faces, e.euler, e.closed) == (8, 18, 12, 2, True)
    twin = v.union(v.selectExpr("shape", "vid + 100", "x + 1e-9", "y", "z"))
    loose = t.selectExpr("shape", "tid", "a", "b + 100 as b", "c")
    vw, tw = G.weld(twin, loose, 1e-6)
    assert vw.count() == 8 and G.edge_facts(tw).collect()[0].closed
    b = G.betti(v, t).collect()[0]
    assert (b.b0 + b.b2, b.b1, b.closed) == (1, 0, True)
    gate = G.solid_gate(G.mesh_facts(v, t.selectExpr("shape", "tid", "a", "c as b", "b as c"))).collect()[0]
    assert gate.reason == ("no solid of positive volume" if r.volume > 0 else None)


def test_voxel_overlap_rotation_and_dilation(spark):
    a, b = cells(spark, "s", cube(3)), cells(spark, "s", cube(3, (1, 0, 0)))
    assert G.voxel_iou(a, b, ["shape"]).collect()[0].iou == 18 / 36
    bar = cells(spark, "s", np.array([(x, 0, 0) for x in range(-3, 4)]))
    tall = cells(spark, "s", np.array([(0, 0, z) for z in range(-3, 4)]))
    assert G.best_rotation(bar, tall, G.rotation_table(spark), "shape").collect()[0].iou == 1.0
    assert G.best_rotation(bar, bar, G.rotation_table(spark), "shape").collect()[0].rot == 0
    assert G.dilated(cells(spark, "s", np.array([(0, 0, 0)]))).count() == 7
    assert G.surface_similarity(a, b, "shape").collect()[0].similarity == 1.0


def test_leave_one_out_gain(spark):
    true = cells(spark, "s", np.concatenate([cube(2), cube(2, (4, 0, 0))]))
    right = cells(spark, "s", cube(2), kind=1).union(cells(spark, "s", cube(2, (4, 0, 0)), kind=2)).union(cells(spark, "s", cube(2, (9, 9, 9)), kind=3))
    got = {r.kind: r for r in G.loo_gain(right, true, "shape", "kind").collect()}
    assert got[1].full == pytest.approx(16 / 24) and got[1].base == pytest.approx(8 / 24) and got[1].gain == pytest.approx(0.5) and got[3].gain is None  # nothing was missing without it
    filled = {r.kind: r.gain for r in G.loo_gain_filled(right, true, "shape", "kind").collect()}
    assert filled[1] == pytest.approx(0.5) and (filled[3] is None or filled[3] != filled[3])


def test_kabsch_and_outliers():
    rng = np.random.default_rng(3)
    a = rng.random((12, 3))
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    b = a @ turn.T + [1, 2, 3]
    r, shift, left = kernels.kabsch(a, b)
    assert np.allclose(r, turn) and np.allclose(shift, [1, 2, 3]) and left < 1e-9
    b[:3] += 5
    r, inside = kernels.robust_fit(a, b)
    assert np.allclose(r, turn) and inside.sum() == 9


def test_triples_are_chosen_without_a_list_of_all():
    """400 points have ten million triples; the chosen ones are those of the list."""
    for n in (3, 7, 12):
        assert [kernels.triple_at(k, n) for k in range(n * (n - 1) * (n - 2) // 6)] == list(itertools.combinations(range(n), 3))
    a = np.random.default_rng(3).random((400, 3))
    b = a + [1, 2, 3]
    b[:100] += 5
    tracemalloc.start()
    r, inside = kernels.robust_fit(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(r, np.eye(3)) and inside.sum() == 300 and peak < 5e6


def test_sampling_is_seeded_and_on_the_surface():
    p = kernels.sample_surface(BOX, TRI, 500)
    assert np.array_equal(p, kernels.sample_surface(BOX, TRI, 500)) and np.isclose(np.minimum(np.abs(p), np.abs(1 - p)).min(1), 0).all()
    q = np.random.default_rng(4).random((50, 3))
    want = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2)).min(1)
    assert np.allclose(kernels.nearest_distance(q, p, block=7), want)


def test_near_centroids(spark):
    rng = np.random.default_rng(5)
    rows = [("g", k, *map(float, p)) for k, p in enumerate(rng.random((60, 3)))]
    df = spark.createDataFrame(rows, "board string, id long, x double, y double, z double")
    got = {(r.a, r.b) for r in G.centroid_pairs(df, "board", 0.2).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and np.linalg.norm(np.subtract(a[2:], b[2:])) <= 0.2}


def test_vertices_are_never_broadcast(spark):
    """The size that is told of generated vertices is that of the few rows they come from."""
    v, t = box_meshes(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in G.mesh_facts(v, t)._jdf.queryExecution().executedPlan().toString()


def test_edges_are_dealt_out_before_they_are_counted(spark):
    """A count in the task that reads the triangles would hold nearly all of their edges."""
    tri = spark.createDataFrame([("s", k, *map(int, x)) for k, x in enumerate(TRI)], "shape string, tid int, a int, b int, c int")
    plan = G.edge_facts(tri)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("partial_count") < plan.index("REPARTITION_BY_NUM")


def test_shapes_are_streamed_whole_over_any_batches(spark):
    """Shapes of many sizes in batches of 7 rows, one without triangles; no call of its own for each shape."""
    rng = np.random.default_rng(2)
    size = {f"s{k}": int(n) for k, n in enumerate(rng.integers(3, 30, 20))}
    v = spark.createDataFrame([(s, k, float(k), 1.0, 2.0) for s, n in size.items() for k in range(n)], "shape string, vid int, x double, y double, z double")
    t = spark.createDataFrame([(s, k, k, k + 1, k + 2) for s, n in size.items() if s != "s7" for k in range(n - 2)], "shape string, tid int, a int, b int, c int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = G.per_mesh(v, t, lambda p, f: (len(p), len(f), bool((p[f[:, 1], 0] == np.arange(1, len(f) + 1)).all())), "n int, m int, ok boolean")
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in got.collect()} == {(s, n, n - 2, True) for s, n in size.items() if s != "s7"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parts_need_no_step_for_each_triangle(monkeypatch):
    """Parts of triangle soups and of a long, shuffled strip, as union-find gives them."""
    rng = np.random.default_rng(8)
    soups = [rng.integers(0, 40, (int(n), 3)) for n in rng.integers(1, 40, 50)]
    strip = np.arange(5000)[:, None] + np.arange(3)
    for t in (*soups, rng.permutation(5002)[strip]):
        names, places = np.unique(t, return_inverse=True)
        forest = kernels.UnionFind(len(names))
        for a, b, c in places.reshape(-1, 3).tolist():
            forest.union(a, b)
            forest.union(b, c)
        want = forest.labels()[places.reshape(-1, 3)[:, 0]]
        with monkeypatch.context() as m:
            m.delattr(kernels, "UnionFind")
            assert np.array_equal(kernels.mesh_parts(t), want)
