import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalar as S
from gaugeworks.functions import text as X
from gaugeworks.operators import assembly as A
from gaugeworks.operators import layout as L

EYE = [float(k % 5 == 0) for k in range(16)]


def cells(spark, rows):
    return spark.createDataFrame([(c, k, *map(int, x)) for c, k, xs in rows for x in xs], "case string, kind string, ix int, iy int, iz int")


def cube(n, at=(0, 0, 0)):
    return [(x + at[0], y + at[1], z + at[2]) for x in range(n) for y in range(n) for z in range(n)]


def test_placement(spark):
    inst = spark.createDataFrame([("c", "p_i1", "p", EYE), ("c", "p_i2", "p", [float(v) for v in (0, -1, 0, 5, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])], "case string, instance_id string, part_id string, transform array<double>")
    part = spark.createDataFrame([("p", 1.0, 2.0, 3.0)], "part_id string, x double, y double, z double")
    assert {r.instance_id: (r.x, r.y, r.z) for r in A.placed(inst, part).collect()} == {"p_i1": (1, 2, 3), "p_i2": (3, 1, 3)}


def test_part_scores(spark):
    gates = spark.createDataFrame([("a", None), ("b", "no solid"), ("c", None)], "shape string, reason string")
    overlap = spark.createDataFrame([("a", 0.75, 0.5), ("c", 1.0, 0.5)], "shape string, iou double, floor double")
    topology = spark.createDataFrame([("a", 1, 1, 0, 1, 0, 0)], "shape string, tb0 int, tb1 int, tb2 int, pb0 int, pb1 int, pb2 int")
    got = {r["shape"]: (r.score, r.coverage) for r in A.part_scores(overlap, topology, gates).collect()}
    assert got["a"] == pytest.approx((0.8 * 0.5 + 0.2 * 0.25, 1.0)) and got["b"] == (0.0, 1.0) and got["c"] == pytest.approx((1.0, 0.8))


def test_attribution_and_headline(spark):
    true = cells(spark, [("c", "a", cube(2)), ("c", "b", cube(2, (4, 0, 0)))])
    perfect = A.attribution(true, true.drop("kind"), A.true_shares(true)).collect()[0]
    assert (perfect.gain, perfect.types) == (1.0, 2)
    half = cells(spark, [("c", "a", cube(2))])
    r = A.attribution(half, true.drop("kind"), A.true_shares(true)).collect()[0]
    assert r.gain == pytest.approx((0.5 + 0) / 2)
    rows = spark.createDataFrame([("c", 0.5, True), ("c", 2.0, True), ("c", 0.0, False), ("d", 1.0, False)], "case string, score double, scope boolean")
    means = A.scoped_mean(rows, "case", "score", F.col("scope"))
    assert {r["case"]: (r["mean"], r.reason) for r in means.collect()} == {"c": (0.75, None), "d": (None, "no type in scope")}
    assert {r["case"]: r.score for r in A.headline(means, A.attribution(true, true.drop("kind"), A.true_shares(true))).collect()} == {"c": 0.75, "d": None}


def test_instance_hits(spark):
    make = lambda rows: cells(spark, rows).withColumnRenamed("kind", "instance")
    true = make([("c", "g1", cube(3)), ("c", "g2", cube(3, (9, 0, 0)))])
    pred = make([("c", "p1", cube(3, (9, 0, 0))), ("c", "p2", cube(3, (1, 0, 0))), ("c", "p3", cube(1, (50, 0, 0)))])
    r = A.instance_hits(pred, true).collect()[0]
    assert (r.hits, r.recall) == (2, 1.0) and r.precision == pytest.approx(2 / 3) and r.f1 == pytest.approx(0.8)


def test_spectrum_and_anisotropy_do_not_change_under_a_turn(spark):
    rng = np.random.default_rng(6)
    pts = rng.random((20, 3)) * [1, 0.4, 0.1]
    turn = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    make = lambda p: spark.createDataFrame([("c", k, k % 3, *map(float, x)) for k, x in enumerate(p)], "case string, id long, kind int, x double, y double, z double")
    a, b = make(pts), make(pts @ turn.T)
    assert A.distance_spectrum(b, a, 2.0).collect()[0].spectrum == pytest.approx(1.0)
    assert A.distance_spectrum(make(pts * [1, 1, 0]), a, 2.0).collect()[0].spectrum < 1
    s, t = (A.anisotropy(x, "case").collect()[0].shares for x in (a, b))
    want = np.sort(np.linalg.eigvalsh(np.cov(pts.T)))[::-1]
    assert s == pytest.approx((want / want.sum()).tolist()) and t == pytest.approx(s)


def test_entities_by_name_or_by_invariants(spark):
    true = spark.createDataFrame([("c", "p", 1.0, 6.0, 2), ("c", "q", 8.0, 24.0, 1), ("d", "p", 1.0, 6.0, 1)], "case string, part_id string, volume double, area double, quantity int")
    pred = spark.createDataFrame([("c", "s1", "Solid", 1.001, 6.0), ("c", "s2", "x", 8.0, 24.1), ("c", "s3", "x", 1.0, 6.0), ("c", "s4", "x", 50.0, 1.0), ("d", "s1", "p_i3", 99.0, 99.0)], "case string, solid string, name string, volume double, area double")
    assert {(r["case"], r.solid): r.part_id for r in A.entity_match(pred, true).collect()} == {("c", "s1"): "p", ("c", "s2"): "q", ("c", "s3"): "p", ("d", "s1"): "p"}


def test_parts_list(spark):
    rows = [("s", 10, 0, 30, 8, "ITEM"), ("s", 14, 20, 18, 26, "1"), ("s", 60, 20, 64, 26, "12"), ("s", 100, 20, 160, 26, "part_01.step"), ("s", 14, 40, 18, 46, "2"), ("s", 100, 41, 160, 47, "part_07.step"), ("t", 50, 5, 54, 9, "3"), ("t", 80, 5, 84, 9, "4"), ("t", 100, 5, 150, 9, "part_02.step"), ("t", 100, 50, 150, 54, "part_03.step")]
    df = spark.createDataFrame([(s, *map(float, b), t) for s, *b, t in rows], "sheet string, x0 double, y0 double, x1 double, y1 double, text string")
    assert {(r.sheet, r.item, r.part_id) for r in L.parts_list(df).collect()} == {("s", "1", "part_01"), ("s", "2", "part_07"), ("t", "4", "part_02")}


def test_tiles(spark):
    x = lambda w, h, m: spark.range(1).select(L.tile_grid(F.lit(float(w)), F.lit(float(h)), F.lit(m).cast("double")).alias("g")).collect()[0].g
    assert tuple(x(200, 200, None)) == (1, 1) and tuple(x(600, 300, 2.5)) == (1, 2) and tuple(x(800, 500, 2.5)) == (2, 3) and tuple(x(100_000, 100_000, 1.0)) == (5, 5)
    sheets = spark.createDataFrame([("s", 100.0, 50.0, 1, 2), ("t", 9.0, 9.0, 1, 1)], "sheet string, width double, height double, rows int, cols int")
    got = [(r.sheet, r.row, r.col, r.x0, r.x1, r.y0, r.y1) for r in L.tiles(sheets).orderBy("col").collect()]
    assert got == [("s", 1, 1, 0.0, 55.0, 0.0, 50.0), ("s", 1, 2, 45.0, 100.0, 0.0, 50.0)]


def test_reading_area_and_pixels(spark):
    grey = np.full((60, 40), 255)
    grey[2] = grey[:, 3] = 0
    grey[20:25, 15:30] = 0
    grey[59, 5:9] = 0
    df = spark.createDataFrame([("s", y, x, int(grey[y, x])) for y in range(60) for x in range(40)], "sheet string, y int, x int, grey int")
    r = L.reading_area(df).collect()[0]
    assert (r.x0, r.x1, r.y0, r.y1) == (15, 30, 20, 25)
    img = lambda part: spark.createDataFrame([("i", y, x, *(part if 2 <= x < 6 else (250, 250, 250))) for y in range(4) for x in range(8)], "image string, y int, x int, r int, g int, b int")
    assert L.pixel_agreement(img((200, 100, 100)), img((200, 100, 100))).collect()[0].agreement == 1.0
    assert L.pixel_agreement(img((200, 100, 100)), img((100, 100, 100))).collect()[0].agreement == 0.0
    assert L.pixel_agreement(img((250, 250, 250)), img((250, 250, 250))).collect()[0].agreement == 1.0


def test_small_lookups(spark):
    files = spark.createDataFrame([("r1", "pred.json"), ("r1", "final.step"), ("r2", "notes")], "run string, path string")
    assert {r.run: r.answer for r in L.first_in_priority(files, "run", {"submission": 0, "final.step": 1, "pred.json": 2}).collect()} == {"r1": "final.step"}
    ev = spark.createDataFrame([("a", 0, "he", None), ("a", 1, "llo", "x"), ("a", 2, None, None), ("a", 3, "!", "y")], "k string, seq int, text string, kind string")
    r = L.folded_deltas(ev, ["k"], "seq", "text", ["kind"]).collect()[0]
    assert (r.text, r.kind) == ("hello!", "y")
    inst = spark.createDataFrame([("c", "b"), ("c", "a"), ("d", "b"), ("d", "a")], "case string, part_id string")
    bom = spark.createDataFrame([("c", 0, "b"), ("c", 1, "a"), ("d", 0, "b")], "case string, pos int, part_id string")
    assert {r["case"]: r.parts for r in L.in_bom_order(inst, bom, "case").collect()} == {"c": ["b", "a"], "d": ["a", "b"]}
    cases = spark.createDataFrame([("t/x/c1", None), ("t/x/c2", "named"), ("u/c3", None)], "case string, env string")
    declared = spark.createDataFrame([("t", "up"), ("n", "named")], "folder string, env string")
    assert {r["case"]: r.task for r in L.task_of_case(cases, declared).collect()} == {"t/x/c1": "up", "t/x/c2": "named", "u/c3": None}


def plain_middle(text, most):
    """Both ends of at most half the bytes each, whole characters only."""
    text = text.strip()
    raw = text.encode()
    if len(raw) <= most:
        return text
    head = max(k for k in range(len(text) + 1) if len(text[:k].encode()) <= most // 2)
    tail = min(k for k in range(len(text) + 1) if len(text[k:].encode()) <= most // 2)
    gone = len(text[head:tail].encode())
    return text[:head] + f"\n[... output limited to {most} bytes; {gone} interior bytes omitted ...]\n" + text[tail:]


def test_bytes_and_escapes(spark):
    texts = ["é" * 9000, "a" + "é" * 90, "北京" * 60, "👩‍👩‍👧x" * 40, "  ok \n", "", " \t", "x" * 101, "x" * 100, "ab👩" * 33]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k int, t string")
    got = {r.k: (r.a, r.b) for r in df.select("k", X.limited_middle(F.col("t"), 100).alias("a"), X.limited_middle(F.col("t"), 11).alias("b")).collect()}
    assert got.pop(99) == (None, None)
    assert got == {k: (plain_middle(t, 100), plain_middle(t, 11)) for k, t in enumerate(texts)}
    assert X.decode_escapes(r"a\X2\00E94E2D\X0\b\X\E9") == "aé中bé"
    assert X.malformed(b'{"a": "' + b"[" * 500 + b'"}') is None and X.malformed(b"[" * 100) == "too deep" and X.malformed(b"[]", 1) == "too large" and X.malformed(b" " * (2 << 20)) is None


def test_class_of_solids(spark):
    one, two = (1234.56, 10.0, 6, [0.1666667, 0.2, 0.0]), (5.0, 1e-9, 12, [1.0, 2.0, 3.0])
    rows = ['[1235.0, 10.0, 6, [0.1667, 0.2, 0.0]]', '[5.0, 1e-09, 12, [1.0, 2.0, 3.0]]']
    want = "g-" + hashlib.sha256("|".join(rows).encode()).hexdigest()[:12]
    assert X.geometry_class([one, two]) == X.geometry_class([two, one]) == X.geometry_class([two, (1234.6, 10.0, 6, [0.16667, 0.2, 0])]) == want
    assert X.geometry_class([one]) != want
    df = spark.createDataFrame([([one, two],), (None,)], "s array<struct<volume double, area double, faces int, moments array<double>>>")
    assert [r.c for r in df.select(X.class_of_solids("s").alias("c")).collect()] == [want, None]


def test_formats(spark):
    df = spark.createDataFrame([(1, 60, 500_000, 1234567), (2, None, 500_000, 0), (3, 30, None, 5), (4, None, 0, 5)], "n int, rounds int, budget long, spent long")
    got = [tuple(r) for r in df.select(X.limits_text(F.col("rounds"), F.col("budget")), X.round_status(F.col("n"), F.col("rounds"), F.col("spent"), F.col("budget"))).collect()]
    assert got[0] == ("at most 60 rounds and 500,000 output tokens, your thinking included -- the episode ends at whichever runs out first", "Round 1/60 · output tokens 1,234,567 / 500,000")
    assert got[1] == ("at most 500,000 output tokens, your thinking included -- the episode ends when they are spent", "Round 2 · output tokens 0 / 500,000")
    assert got[2:] == [("30 rounds", "Round 3/30"), ("None rounds", "Round 4")]
    row = spark.createDataFrame([(["p1", "q"], "drawings/p1.pdf", "part_012", 0.12345)], "ids array<string>, path string, part string, score double")
    assert [*row.select(X.sheet_names(F.col("ids")), X.png_path(F.col("path")), X.digits_of(F.col("part")), X.score_text(F.col("score"))).collect()[0]] == [["parts/p1_alone.png", "parts/p1_in_assembly.png", "parts/q_alone.png", "parts/q_in_assembly.png"], "drawings/p1.png", "012", "0.1235"]


def test_rounding_times_and_nested_counts(spark):
    rows = [(0.00005, 0.0), (0.00015, 0.0002), (0.00025, 0.0002), (-0.00015, -0.0002), (1.23456, 1.2346), (None, None)]
    df = spark.createDataFrame(rows, "x double, want double")
    assert all(r.got == r.want for r in df.withColumn("got", S.half_even(F.col("x"))).collect())
    times = spark.createDataFrame([("2026-01-02T03:04:05Z", "2026-01-02T03:04:06.26Z", 1.3), ("2026-01-02T03:04:05+01:00", "2026-01-02T03:04:05Z", 3600.0), (None, "2026-01-02T03:04:05Z", None), ("x", "2026-01-02T03:04:05Z", None)], "a string, b string, want double")
    assert all(r.got == r.want for r in times.withColumn("got", S.seconds_between(F.col("a"), F.col("b"))).collect())
    docs = spark.createDataFrame([('{"a": {"n": 5}}', 5), ('{"a": {"n": true}, "b": 7}', 7), ('{"a": 3}', None), ('{"b": 1.5}', None)], "d string, want long")
    assert all(r.got == r.want for r in docs.withColumn("got", S.nested_count(F.try_parse_json("d"), "$.a.n", "$.b")).collect())
    assert [r.x for r in spark.createDataFrame([("b",), (None,), ("a",)], "x string").orderBy(S.nulls_as(F.col("x"), "None")).collect()] == [None, "a", "b"]


def test_distance_spectrum_takes_far_pairs(spark):
    make = lambda far: spark.createDataFrame([(1, 0, "p", 0.0, 0.0, 0.0), (1, 1, "p", 1.0, 0.0, 0.0), (1, 2, "q", far, 0.0, 0.0)], "case long, id long, kind string, x double, y double, z double")
    got = A.distance_spectrum(make(200.0), make(100.0)).collect()[0].spectrum
    assert got == pytest.approx((1 + 100 / 200 + 99 / 199) / 3)
