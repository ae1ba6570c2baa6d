"""Voxels, points and meshes on embeddings and generated boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalar as S
from gaugeworks.operators import assembly as A
from gaugeworks.operators import geometry as G
from gaugeworks.operators import kernels
from gaugeworks.operators import layout as L
from gaugeworks.operators import meshes as M
from gaugeworks.plans.adapters import POINTS, VOXELS, points, pred_cells, table, true_cells, voxels

c = F.col
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {VOXELS}, h AS (SELECT shape, count(*) AS hit FROM va JOIN vb USING (shape, ix, iy, iz) GROUP BY 1), a AS (SELECT shape, count(*) AS na FROM va GROUP BY 1), b AS (SELECT shape, count(*) AS nb FROM vb GROUP BY 1)
SELECT shape, na, nb, coalesce(hit, 0) AS hit, round(coalesce(hit, 0) / (na + nb - coalesce(hit, 0)), 6) AS iou FROM a JOIN b USING (shape) LEFT JOIN h USING (shape)""")
def voxel_iou(spark, d):
    v = voxels(spark, d)
    return G.voxel_iou(true_cells(v), pred_cells(v), ["shape"]).select("shape", "na", "nb", "hit", F.round("iou", 6).alias("iou"))


_ROT = ", ".join("(" + ", ".join(map(str, [k, *m.ravel().tolist()])) + ")" for k, m in enumerate(kernels.rotations()))
_NAMES = ", ".join(f"m{r}{k}" for r in (1, 2, 3) for k in (1, 2, 3))


@query(f"""WITH {VOXELS}, rot(rot, {_NAMES}) AS (VALUES {_ROT}),
t AS (SELECT shape, rot, m11 * ix + m12 * iy + m13 * iz AS ix, m21 * ix + m22 * iy + m23 * iz AS iy, m31 * ix + m32 * iy + m33 * iz AS iz FROM vb, rot),
h AS (SELECT shape, rot, count(*) AS hit FROM t JOIN va USING (shape, ix, iy, iz) GROUP BY ALL), a AS (SELECT shape, count(*) AS na FROM va GROUP BY 1), b AS (SELECT shape, count(*) AS nb FROM vb GROUP BY 1),
s AS (SELECT shape, rot, hit / (na + nb - hit) AS iou FROM h JOIN a USING (shape) JOIN b USING (shape))
SELECT shape, round(max(iou), 6) AS iou, arg_max(rot, (iou, -rot))::INT AS rot FROM s GROUP BY 1""")
def voxel_iou24(spark, d):
    v = voxels(spark, d)
    return G.best_rotation(true_cells(v), pred_cells(v), G.rotation_table(spark), "shape").select("shape", F.round("iou", 6).alias("iou"), "rot")


_STEPS = "(VALUES (0,0,0), (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) s(i, j, k)"


@query(f"""WITH {VOXELS}, da AS (SELECT DISTINCT shape, ix + i AS ix, iy + j AS iy, iz + k AS iz FROM va, {_STEPS}), db AS (SELECT DISTINCT shape, ix + i AS ix, iy + j AS iy, iz + k AS iz FROM vb, {_STEPS}),
ha AS (SELECT shape, count(*) AS n FROM va SEMI JOIN db USING (shape, ix, iy, iz) GROUP BY 1), hb AS (SELECT shape, count(*) AS n FROM vb SEMI JOIN da USING (shape, ix, iy, iz) GROUP BY 1),
a AS (SELECT shape, count(*) AS na FROM va GROUP BY 1), b AS (SELECT shape, count(*) AS nb FROM vb GROUP BY 1)
SELECT shape, round((coalesce(ha.n, 0) / na + coalesce(hb.n, 0) / nb) / 2, 6) AS similarity FROM a JOIN b USING (shape) LEFT JOIN ha USING (shape) LEFT JOIN hb USING (shape)""")
def dilate_and_surface_sim(spark, d):
    v = voxels(spark, d)
    return G.surface_similarity(true_cells(v), pred_cells(v), "shape").withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {VOXELS}, l AS (SELECT shape, max(ix) - min(ix) + 1 AS x, max(iy) - min(iy) + 1 AS y, max(iz) - min(iz) + 1 AS z, count(*) AS n FROM va GROUP BY 1) SELECT shape, n AS cells, x * y * z AS box, round(n / (x * y * z), 6) AS floor FROM l""")
def primitive_box_floor(spark, d):
    """Overlap of each shape with the box of its cells: the cells all lie in it."""
    edge = lambda n: F.max(n) - F.min(n) + 1
    rows = true_cells(voxels(spark, d)).groupBy("shape").agg(F.count("*").alias("cells"), (edge("ix") * edge("iy") * edge("iz")).alias("box"))
    return rows.withColumn("floor", F.round(c("cells") / c("box"), 6))


@query(f"""WITH {POINTS} SELECT a.board, a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM points a JOIN points b ON a.board = b.board AND a.id < b.id
AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.1""")
def contact_pairs(spark, d):
    return G.centroid_pairs(points(spark, d), "board", 0.1).select("board", "a", "b", F.round("distance", 6).alias("distance"))


@query(f"""WITH {VOXELS}, s AS (SELECT shape, kind, ix * ix + iy * iy + iz * iz AS t, jx * jx + jy * jy + jz * jz AS p FROM lat), a AS (SELECT shape, kind, t, row_number() OVER (PARTITION BY shape, kind ORDER BY t) AS i FROM s), b AS (SELECT shape, kind, p, row_number() OVER (PARTITION BY shape, kind ORDER BY p) AS i FROM s)
SELECT shape, kind, count(*) AS n, round(avg(CASE WHEN greatest(t, p) = 0 THEN 1.0 ELSE least(t, p) / greatest(t, p) END), 6) AS spectrum FROM a FULL JOIN b USING (shape, kind, i) GROUP BY ALL""")
def distance_spectrum(spark, d):
    """The i-th smallest squared distance from the origin against the i-th of the other side."""
    square = lambda p: c(f"{p}x") * c(f"{p}x") + c(f"{p}y") * c(f"{p}y") + c(f"{p}z") * c(f"{p}z")
    rows = voxels(spark, d).select("shape", "kind", square("i").alias("t"), square("j").alias("p"))
    nth = lambda n: rows.select("shape", "kind", n).withColumn("i", F.row_number().over(Window.partitionBy("shape", "kind").orderBy(n)))
    both = nth("t").join(nth("p"), ["shape", "kind", "i"], "full_outer")
    return both.groupBy("shape", "kind").agg(F.count("*").alias("n"), F.round(F.avg(S.magnitude_ratio(c("t"), c("p"))), 6).alias("spectrum"))


@query(f"""WITH {VOXELS}, d AS (SELECT a.shape, a.ix, a.iy, a.iz, min((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2 + (a.iz - b.iz) ** 2) AS m FROM va a JOIN vb b USING (shape) GROUP BY ALL), e AS (SELECT b.shape, b.ix, b.iy, b.iz, min((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2 + (a.iz - b.iz) ** 2) AS m FROM va a JOIN vb b USING (shape) GROUP BY ALL),
p AS (SELECT shape, avg((m <= 2)::INT) AS r FROM d GROUP BY 1), q AS (SELECT shape, avg((m <= 2)::INT) AS s FROM e GROUP BY 1) SELECT shape, round(CASE WHEN r + s > 0 THEN 2 * r * s / (r + s) ELSE 0 END, 6) AS f1 FROM p JOIN q USING (shape)""")
def surface_f1(spark, d):
    """Points with a neighbour on the other side within the square root of 2 cells: neighbours by equi join on offsets."""
    v = voxels(spark, d)
    a, b = true_cells(v), pred_cells(v)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if abs(i) + abs(j) + abs(k) <= 2]))
    near = lambda x: x.select("shape", "ix", "iy", "iz", steps.alias("s")).select("shape", (c("ix") + c("s.i")).alias("ix"), (c("iy") + c("s.j")).alias("iy"), (c("iz") + c("s.k")).alias("iz")).distinct()
    share = lambda x, y, n: x.join(near(y).withColumn("hit", F.lit(1)), ["shape", "ix", "iy", "iz"], "left").groupBy("shape").agg(F.avg(F.coalesce("hit", F.lit(0))).alias(n))
    r, s = c("r"), c("s")
    return share(a, b, "r").join(share(b, a, "s"), "shape").select("shape", F.round(F.when(r + s > 0, 2 * r * s / (r + s)).otherwise(0.0), 6).alias("f1"))


@query("SELECT dense_rank() OVER (ORDER BY first)::INT - 1 AS type_id, n, first FROM (SELECT round(p_retailprice, 0) AS r, p_size, p_type, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY ALL)")
def fingerprint_types(spark, d):
    """Dense type ids in first-seen order. The order is global: ids are ranks within ranges plus the types of the ranges before."""
    types = table(spark, d, "part").groupBy(F.round("p_retailprice", 0).alias("r"), "p_size", "p_type").agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))
    rows = types.repartitionByRange("first").withColumn("part_", F.spark_partition_id())
    before = rows.groupBy("part_").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - c("k"))
    rank = F.row_number().over(Window.partitionBy("part_").orderBy("first"))
    return rows.withColumn("rank", rank).join(F.broadcast(before), "part_").select((c("rank") + c("before") - 1).cast("int").alias("type_id"), "n", "first")


@query(f"""WITH {VOXELS}, p AS (SELECT DISTINCT shape, kind, jx AS ix, jy AS iy, jz AS iz FROM lat), cov AS (SELECT shape, ix, iy, iz, count(*) AS k, min(kind) AS lone FROM p GROUP BY ALL),
m AS (SELECT cov.*, va.shape IS NOT NULL AS t FROM cov LEFT JOIN va USING (shape, ix, iy, iz)), f AS (SELECT shape, count(*) AS np, count(*) FILTER (t) AS hit FROM m GROUP BY 1), nt AS (SELECT shape, count(*) AS nt FROM va GROUP BY 1),
al AS (SELECT shape, lone AS kind, count(*) AS gone, count(*) FILTER (t) AS gone_hit FROM m WHERE k = 1 GROUP BY ALL),
r AS (SELECT x.shape, x.kind, hit / (np + nt - hit) AS "full", (hit - coalesce(gone_hit, 0)) / (np - coalesce(gone, 0) + nt - hit + coalesce(gone_hit, 0)) AS base FROM (SELECT DISTINCT shape, kind FROM p) x JOIN f USING (shape) JOIN nt USING (shape) LEFT JOIN al USING (shape, kind))
SELECT shape, kind, round("full", 6) AS "full", round(base, 6) AS base, round(CASE WHEN base < 1 - 1e-6 THEN least(1.0, greatest(0.0, ("full" - base) / (1 - base))) END, 6) AS gain FROM r""")
def loo_gain(spark, d):
    v = voxels(spark, d)
    pred = v.select("shape", "kind", c("jx").alias("ix"), c("jy").alias("iy"), c("jz").alias("iz")).distinct()
    return G.loo_gain(pred, true_cells(v), "shape", "kind").withColumns({n: F.round(n, 6) for n in ("full", "base", "gain")})


@query(None)
def loo_gain_filled(spark, d):
    v = voxels(spark, d)
    pred = v.select("shape", "kind", c("jx").alias("ix"), c("jy").alias("iy"), c("jz").alias("iz")).distinct()
    return G.loo_gain_filled(pred, true_cells(v), "shape", "kind")


@query(None)
def kabsch_fit(spark, d):
    """A turned and shifted copy of each board's points fitted back; the rotation error and inliers."""
    angle = 0.7
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values("id")[["x", "y", "z"]].to_numpy()
        b = a @ turn.T + [1, 2, 3]
        b[:: 7] += 0.5
        r, inside = kernels.robust_fit(a, b)
        return pd.DataFrame([(key[0], float(np.abs(r - turn).max()), int(inside.sum()), len(a))], columns=["board", "error", "inliers", "points"])

    return points(spark, d).groupBy("board").applyInPandas(fit, "board string, error double, inliers int, points int")


CORNERS = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def box_meshes(spark, d):
    """A box for each part: edges by its size and price. Parts are dealt out first, as each gives 20 rows."""
    p = G.spread(table(spark, d, "part").select(c("p_partkey").cast("string").alias("shape"), (c("p_size") / 10.0).alias("w"), (c("p_retailprice") / 1000.0).alias("h")), "shape")
    corners = F.array(*[F.struct(F.lit(k).alias("vid"), F.lit(float(x)).alias("i"), F.lit(float(y)).alias("j"), F.lit(float(z)).alias("k")) for k, (x, y, z) in enumerate(CORNERS)])
    faces = F.array(*[F.struct(F.lit(k).alias("tid"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(e).alias("c")) for k, (a, b, e) in enumerate(FACES)])
    vertex = p.select("shape", "w", "h", F.explode(corners).alias("v")).select("shape", "v.vid", (c("v.i") * c("w")).alias("x"), (c("v.j") * c("h")).alias("y"), c("v.k").alias("z"))
    return vertex, p.select("shape", F.explode(faces).alias("t")).select("shape", "t.tid", "t.a", "t.b", "t.c")


@query("SELECT p_partkey::VARCHAR AS shape, round(2 * (p_size / 10.0 * p_retailprice / 1000.0 + p_size / 10.0 + p_retailprice / 1000.0), 6) AS area, round(p_size / 10.0 * p_retailprice / 1000.0, 6) AS volume, 12::BIGINT AS triangles FROM part")
def mesh_area_volume(spark, d):
    facts = G.mesh_facts(*box_meshes(spark, d))
    return facts.select("shape", F.round(F.col("area"), 6).alias("area"), F.round(F.abs("volume"), 6).alias("volume"), "triangles")


@query("SELECT p_partkey::VARCHAR AS shape, 8::BIGINT AS vertices, 18::BIGINT AS edges, 12::BIGINT AS faces, 2::BIGINT AS euler, true AS closed FROM part")
def mesh_euler(spark, d):
    return G.edge_facts(box_meshes(spark, d)[1]).select("shape", "vertices", "edges", "faces", "euler", "closed")


def ring_mesh(n: int = 8) -> tuple[list, list]:
    """Vertices and outward triangles of a ring with a square section: one tunnel."""
    turn = [2 * np.pi * k / n for k in range(n)]
    v = [(r * float(np.cos(t)), r * float(np.sin(t)), z) for r, z in ((2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 0.0)) for t in turn]
    corner = lambda p, k: p % 4 * n + k % n
    t = [f for p in range(4) for k in range(n) for f in ((corner(p, k), corner(p, k + 1), corner(p + 1, k + 1)), (corner(p, k), corner(p + 1, k + 1), corner(p + 1, k)))]
    return v, t


def hollow_mesh() -> tuple[list, list]:
    """A box with a box-shaped void."""
    inner = [tuple(0.25 + 0.5 * x for x in p) for p in CORNERS]
    return [*CORNERS, *inner], [*FACES, *[(a + 8, c_ + 8, b + 8) for a, b, c_ in FACES]]


@query("SELECT p_partkey::VARCHAR AS shape, 1::INT AS b0, (p_partkey % 3 = 2)::INT AS b1, (p_partkey % 3 = 1)::INT AS b2, true AS closed FROM part")
def betti_mesh(spark, d):
    """A third of the parts each as boxes, hollow boxes and rings."""
    shapes = [(list(CORNERS), list(FACES)), hollow_mesh(), ring_mesh()]
    kind = c("p_partkey") % 3
    p = G.spread(table(spark, d, "part").select(c("p_partkey").cast("string").alias("shape"), kind.alias("k")), "shape")
    vertex = spark.createDataFrame([(k, i, *map(float, x)) for k, (v, _) in enumerate(shapes) for i, x in enumerate(v)], "k long, vid int, x double, y double, z double")
    tri = spark.createDataFrame([(k, i, *x) for k, (_, t) in enumerate(shapes) for i, x in enumerate(t)], "k long, tid int, a int, b int, c int")
    return G.betti(p.join(F.broadcast(vertex), "k").drop("k"), p.join(F.broadcast(tri), "k").drop("k"))


_BOX = "(SELECT p_partkey, p_size / 10.0 AS w, p_retailprice / 1000.0 AS h, 1.0 AS e FROM part)"


@query(f"""WITH m AS (SELECT *, power(w * h * e, 5.0 / 3) AS s, w * h * e / 12 AS k FROM {_BOX}),
n AS (SELECT p_partkey, w, h, e, list_sort([k * (h * h + e * e) / s, k * (w * w + e * e) / s, k * (w * w + h * h) / s]) AS m FROM m)
SELECT p_partkey::VARCHAR AS shape, round(w * h * e, 6) AS volume, round(round(m[1], 6), 4) AS m1, round(round(m[2], 6), 4) AS m2, round(round(m[3], 6), 4) AS m3, round(w / 2, 6) AS x, round(sqrt(w * w + h * h + e * e) / 2, 6) AS gyration FROM n""")
def mesh_measures(spark, d):
    """Moments of six digits may lie halfway between two of four: as in SQL, the double product decides, not the decimal digits."""
    got = M.measure(*box_meshes(spark, d))
    moments = [(F.round(F.get("moments", F.lit(k)) * 1e4) / 1e4).alias(f"m{k + 1}") for k in range(3)]
    return got.select("shape", F.round("volume", 6).alias("volume"), *moments, F.round(F.get("centroid", F.lit(0)), 6).alias("x"), F.round("gyration", 6).alias("gyration"))


@query("SELECT p_partkey::VARCHAR AS shape, 'vertices' AS level FROM part WHERE p_partkey % 2 = 0")
def mesh_identity(spark, d):
    """Half of the boxes turned about an axis and moved, the others larger by a tenth."""
    vertex, tri = box_meshes(spark, d)
    even = c("shape").cast("long") % 2 == 0
    moved = vertex.select("shape", "vid", *[F.when(even, a + 7).otherwise(b * 1.1).alias(n) for n, a, b in (("x", -c("y"), c("x")), ("y", c("x"), c("y")), ("z", c("z"), c("z")))])
    return M.identical((vertex, tri), (moved, tri)).select("shape", "level")


@query(f"WITH {POINTS}, b AS (SELECT board, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points GROUP BY 1) SELECT board, id, round((x - (x0 + x1) / 2) / greatest(x1 - x0, y1 - y0, z1 - z0), 6) AS x, round((y - (y0 + y1) / 2) / greatest(x1 - x0, y1 - y0, z1 - z0), 6) AS y, round((z - (z0 + z1) / 2) / greatest(x1 - x0, y1 - y0, z1 - z0), 6) AS z FROM points JOIN b USING (board)")
def unit_points(spark, d):
    p = points(spark, d).select(c("board").alias("shape"), "id", "x", "y", "z")
    return G.normalised(p).select(c("shape").alias("board"), "id", *[F.round(n, 6).alias(n) for n in "xyz"])


@query("SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 THEN (p_retailprice % 100) / 100 ELSE 0.8 * (p_retailprice % 100) / 100 + 0.2 * (p_size / 50.0) END, 6) AS part, round((0.15 * (p_size / 50.0) + 0.3 * ((p_retailprice % 100) / 100)) / 0.45 * 0.5, 6) AS rubric FROM part")
def fused_scores(spark, d):
    iou, size = (c("p_retailprice") % 100) / 100, c("p_size") / 50.0
    none = F.lit(None).cast("double")
    part = G.part_score(iou, F.when(c("p_size") % 4 != 0, size))
    return table(spark, d, "part").select("p_partkey", F.round(part, 6).alias("part"), F.round(G.rubric_score(size, none, iou, none, F.lit(0.5)), 6).alias("rubric"))


@query(None)
def part_voxel_scores(spark, d):
    """Best-rotation overlap of solid boxes with slightly smaller ones."""
    vertex, tri = box_meshes(spark, d)
    some = vertex.where("x >= 0")
    v = lambda scale: some.groupBy("shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", (c("x") * scale).alias("x"), (c("y") * scale).alias("y"), (c("z") * scale).alias("z")))), lambda s: F.array(s["x"], s["y"], s["z"])).alias("vertices"))
    t = tri.groupBy("shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("tid", "a", "b", "c"))), lambda s: F.array(s["a"], s["b"], s["c"])).alias("triangles"))
    return G.type_scores(v(0.9).join(t.hint("merge"), "shape"), v(1.0).join(t.hint("merge"), "shape"), 0.5)


@query(f"""WITH {VOXELS}, n AS (SELECT shape, count(*) AS n FROM va GROUP BY 1), k AS (SELECT shape, kind, count(*) AS k FROM (SELECT DISTINCT shape, kind, ix, iy, iz FROM lat) GROUP BY ALL) SELECT shape AS "case", kind, round(k / n, 6) AS share FROM k JOIN n USING (shape)""")
def type_shares(spark, d):
    true = voxels(spark, d).select(c("shape").alias("case"), "kind", "ix", "iy", "iz")
    return A.true_shares(true).withColumn("share", F.round("share", 6))


@query(None)
def assembly_attribution(spark, d):
    """Mean leave-one-out gain of each case, instance hits beside it."""
    v = voxels(spark, d).withColumnRenamed("shape", "case")
    pred = v.select("case", "kind", c("jx").alias("ix"), c("jy").alias("iy"), c("jz").alias("iz")).distinct()
    true = v.select("case", "kind", "ix", "iy", "iz").distinct()
    gain = A.attribution(pred, true.drop("kind").distinct(), A.true_shares(true))
    return gain.join(A.instance_hits(pred.withColumnRenamed("kind", "instance"), true.withColumnRenamed("kind", "instance")), "case")


@query(None)
def anisotropy(spark, d):
    return A.anisotropy(points(spark, d), "board").select("board", *[F.round(F.get("shares", F.lit(i)), 6).alias(f"s{i}") for i in range(3)])


@query("""SELECT p_partkey, CASE WHEN 0.7 * 2.5 * 2048 / greatest(w, h) >= 10 THEN 1 WHEN 0.7 * 2.5 * 2048 / greatest(w / 2 * 1.1, h) >= 10 THEN 1 WHEN 0.7 * 2.5 * 2048 / greatest(w, h / 2 * 1.1) >= 10 THEN 2 WHEN 0.7 * 2.5 * 2048 / greatest(w / 2 * 1.1, h / 2 * 1.1) >= 10 THEN 2 ELSE 0 END AS rows
FROM (SELECT p_partkey, p_size * 12.0 AS w, p_retailprice / 4 AS h FROM part)""")
def tile_grids(spark, d):
    """Grids up to 2 x 2 by their rows; larger ones as 0."""
    p = table(spark, d, "part").select("p_partkey", L.tile_grid(c("p_size") * 12.0, c("p_retailprice") / 4, F.lit(None).cast("double")).alias("g"))
    return p.select("p_partkey", F.when((c("g.rows") <= 2) & (c("g.cols") <= 2), c("g.rows")).otherwise(0).alias("rows"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def stream_deltas(spark, d):
    return L.folded_deltas(table(spark, d, "conversations"), ["conv_id"], "turn", "text", ["role"])
