"""Meshes, voxel sets and point sets as tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gaugeworks.functions import fixed
from gaugeworks.operators import kernels


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a number of partitions that isn't lowered by their size: for rows that are small beside what is made
    of them in the same task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def mesh_facts(vertex: DataFrame, tri: DataFrame) -> DataFrame:
    """shape, area, volume, triangles. vertex(shape, vid, x, y, z), tri(shape, tid, a, b, c).

    Vertices are never broadcast: the size that is told of generated rows is that of the rows they come from."""
    rows = tri
    for k in "abc":
        rows = rows.join(vertex.select("shape", F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]).hint("merge"), ["shape", k])
    u, v = ([F.col(f"{k}{c}") - F.col(f"a{c}") for c in "xyz"] for k in "bc")
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    n = cross(u, v)
    a, b, c = ([F.col(f"{k}{x}") for x in "xyz"] for k in "abc")
    bc = cross(b, c)
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    signed = (a[0] * bc[0] + a[1] * bc[1] + a[2] * bc[2]) / 6
    return rows.groupBy("shape").agg(F.sum(area).alias("area"), F.sum(signed).alias("volume"), F.count("*").alias("triangles"))


def solid_gate(facts: DataFrame, most: int = 4_000_000) -> DataFrame:
    """Why a shape scores 0, null if it may be scored."""
    bad = F.col("volume").isNull() | F.isnan("volume") | (F.col("volume") <= 0)
    return facts.withColumn("reason", F.when(bad, "no solid of positive volume").when(F.col("triangles") > most, "too many triangles"))


def box(points: DataFrame, group: str = "shape") -> DataFrame:
    """Bounds, middle and longest edge (1 if none) of each group's points."""
    agg = points.groupBy(group).agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    edges = [F.col(f"{c}_max") - F.col(f"{c}_min") for c in "xyz"]
    longest = F.greatest(*edges)
    return agg.withColumn("longest", F.when(longest > 0, longest).otherwise(1.0))


def normalised(points: DataFrame, group: str = "shape") -> DataFrame:
    """Points in a cube of edge 1 about the origin."""
    b = box(points, group)
    rows = points.join(b, group)
    return rows.select(*[c for c in points.columns if c not in "xyz"], *[((F.col(c) - (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2) / F.col("longest")).alias(c) for c in "xyz"])


def off_origin(points: DataFrame, share: float = 0.01, group: str = "shape") -> DataFrame:
    """Shapes whose box middle is further from the origin than a share of the diagonal."""
    b = box(points, group)
    middle = sum(((F.col(f"{c}_min") + F.col(f"{c}_max")) / 2) ** 2 for c in "yz") + ((F.col("x_min") + F.col("x_max")) / 2) ** 2
    diagonal = sum((F.col(f"{c}_max") - F.col(f"{c}_min")) ** 2 for c in "yz") + (F.col("x_max") - F.col("x_min")) ** 2
    return b.where(F.sqrt(middle) > share * F.sqrt(diagonal)).select(group)


def weld(vertex: DataFrame, tri: DataFrame, pitch: float) -> tuple[DataFrame, DataFrame]:
    """Vertices that round to one lattice point are the one with the smallest number; triangles that collapse go."""
    spot = [F.rint(F.col(c) / pitch) for c in "xyz"]
    first = vertex.withColumn("to", F.min("vid").over(Window.partitionBy("shape", *spot)))
    out = tri
    for k in "abc":
        out = out.join(first.select("shape", F.col("vid").alias(k), F.col("to").alias(f"__{k}")), ["shape", k]).drop(k).withColumnRenamed(f"__{k}", k)
    kept = out.where("a <> b and b <> c and c <> a").select(*tri.columns)
    return first.where("vid = to").drop("to"), kept


def edge_facts(tri: DataFrame) -> DataFrame:
    """shape, V, E, F, euler, closed (every edge has two faces) of welded meshes. Each triangle gives its edges and its vertices,
    dealt out before they are counted: most occur too seldom for a count beforehand."""
    pairs = [F.struct(F.lit(True).alias("edge"), F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]
    corners = [F.struct(F.lit(False).alias("edge"), F.col(p).alias("p"), F.col(p).alias("q")) for p in "abc"]
    rows = spread(tri.select("shape", "a", "b", "c"), "shape").select("shape", F.inline(F.array(*pairs, *corners)))
    edge, n = F.col("edge"), F.col("n")
    found = rows.groupBy("shape", "edge", "p", "q").agg(F.count("*").alias("n")).groupBy("shape").agg(
        F.count_if(~edge & F.col("p").isNotNull()).alias("vertices"), F.count_if(edge).alias("edges"), F.bool_and(~edge | (n == 2)).alias("closed"), (F.sum(F.when(edge, n)) / 3).cast("long").alias("faces")
    )
    return found.withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def whole_shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in order of shape, cut anew so that no shape is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        shape = batch.column("shape")
        at = max(pc.index(shape, shape[-1]).as_py(), 0)  # where the last shape begins
        if not at and held and held[-1].column("shape")[-1].as_py() == shape[-1].as_py():
            held.append(batch)
            continue
        if held or at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def over_meshes(sides: list[tuple[DataFrame, DataFrame]], kernel, schema: str) -> DataFrame:
    """kernel(vertices, triangles of each side in turn) of each shape that all sides hold, whose result (a tuple, or None for
    nothing) follows the shape. Rows of a task are sorted and streamed, many shapes in a batch; one shape is held at a time."""
    rows = None
    for side, (vertex, tri) in enumerate(sides):
        kinds = vertex.schema["vid"].dataType, tri.schema["tid"].dataType, tri.schema["a"].dataType
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        shape = F.col("shape").cast("string").alias("shape")
        v = vertex.select(shape, F.lit(2 * side).alias("part"), "vid", none(kinds[1], "tid"), *[F.col(x).cast("double").alias(x) for x in "xyz"], *[none(kinds[2], x) for x in "abc"])
        t = tri.select(shape, F.lit(2 * side + 1).alias("part"), none(kinds[0], "vid"), "tid", *[none("double", x) for x in "xyz"], "a", "b", "c")
        rows = v.unionByName(t) if rows is None else rows.unionByName(v).unionByName(t)
    fields = T.StructType.fromDDL(f"shape string, {schema}")
    arrow, parts = to_arrow_schema(fields), 2 * len(sides)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_shapes(batches):
            names = table.column("shape").combine_chunks().dictionary_encode()
            number = lambda x: table.column(x).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
            own, part, vid = names.indices.fill_null(-1).to_numpy(zero_copy_only=False), number("part"), number("vid")
            points = np.stack([table.column(x).to_numpy() for x in "xyz"], axis=1)
            corners = np.stack([number(x) for x in "abc"], axis=1)
            cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(part) != 0)) + 1
            begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(own)]])
            first = np.flatnonzero(np.concatenate([[True], np.diff(own[begin]) != 0]))
            out = []
            for at, after in zip(first.tolist(), [*first[1:].tolist(), len(begin)], strict=True):
                if after - at < parts:
                    continue
                args = []
                for k in range(at, after, 2):
                    v, t = slice(begin[k], end[k]), slice(begin[k + 1], end[k + 1])
                    args += [points[v], np.searchsorted(vid[v], corners[t])]
                got = kernel(*args)
                if got is not None:
                    code = own[begin[at]]
                    out.append((None if code < 0 else names.dictionary[int(code)].as_py(), *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return spread(rows, "shape").sortWithinPartitions("shape", "part", "vid", "tid").mapInArrow(run, fields)


def per_mesh(vertex: DataFrame, tri: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(vertices, triangles) of each shape, whose result (a tuple, or None for nothing) follows the shape."""
    return over_meshes([(vertex, tri)], kernel, schema)


def betti(vertex: DataFrame, tri: DataFrame) -> DataFrame:
    """shape, b0, b1, b2, closed of welded meshes; shapes of dust alone have no row."""
    return per_mesh(vertex, tri, kernels.betti, "b0 int, b1 int, b2 int, closed boolean")


def rotation_table(spark: SparkSession) -> DataFrame:
    """rot, m11 .. m33 of the 24 rotations, the identity as 0."""
    names = [f"m{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)]
    return spark.createDataFrame([(k, *m.ravel().tolist()) for k, m in enumerate(kernels.rotations())], ", ".join(["rot int", *[f"{n} int" for n in names]]))


def voxel_iou(a: DataFrame, b: DataFrame, on: list[str], cells: tuple[str, ...] = ("ix", "iy", "iz")) -> DataFrame:
    """Overlap of the cells of both tables for each key `on`."""
    hit = a.join(b, [*on, *cells]).groupBy(*on).agg(F.count("*").alias("hit"))
    na, nb = (df.groupBy(*on).agg(F.count("*").alias(n)) for df, n in ((a, "na"), (b, "nb")))
    both = na.join(nb, on, "full_outer").join(hit, on, "left").na.fill(0)
    return both.withColumn("iou", F.when(F.col("na") + F.col("nb") > 0, F.col("hit") / (F.col("na") + F.col("nb") - F.col("hit"))).otherwise(0.0))


def rotated(cells: DataFrame, rotations: DataFrame) -> DataFrame:
    """Cells about the origin under each of 24 rotations (a small constant table)."""
    turn = lambda r: sum((F.col(f"m{r}{k}") * F.col(c) for k, c in ((2, "iy"), (3, "iz"))), F.col(f"m{r}1") * F.col("ix"))
    keep = [c for c in cells.columns if c not in ("ix", "iy", "iz")]
    return cells.crossJoin(F.broadcast(rotations)).select(*keep, "rot", *[turn(r).alias(n) for r, n in ((1, "ix"), (2, "iy"), (3, "iz"))])


def best_rotation(a: DataFrame, b: DataFrame, rotations: DataFrame, on: str) -> DataFrame:
    """Best overlap over 24 rotations of b's cells for each key; the first rotation of equal ones."""
    turned = rotated(b, rotations)
    hit = turned.join(a, [on, "ix", "iy", "iz"]).groupBy(on, "rot").agg(F.count("*").alias("hit"))
    na, nb = (df.groupBy(on).agg(F.count("*").alias(n)) for df, n in ((a, "na"), (b, "nb")))
    scored = hit.join(na, on).join(nb, on).withColumn("iou", F.col("hit") / (F.col("na") + F.col("nb") - F.col("hit")))
    return scored.groupBy(on).agg(F.max("iou").alias("iou"), F.max_by("rot", F.struct("iou", -F.col("rot"))).alias("rot"))


def dilated(cells: DataFrame) -> DataFrame:
    """Cells and their face neighbours."""
    steps = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    keep = [c for c in cells.columns if c not in ("ix", "iy", "iz")]
    move = F.explode(F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy"), (F.col("iz") + k).alias("iz")) for i, j, k in steps]))
    return cells.select(*keep, move.alias("s")).select(*keep, "s.ix", "s.iy", "s.iz").distinct()


def surface_similarity(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Mean share of each side's cells that touch the other side, to within a cell."""
    share = lambda x, y, n: x.join(dilated(y), [on, "ix", "iy", "iz"], "left_semi").groupBy(on).agg(F.count("*").alias(n))
    n = lambda x, name: x.groupBy(on).agg(F.count("*").alias(name))
    rows = n(a, "na").join(n(b, "nb"), on).join(share(a, b, "ha"), on, "left").join(share(b, a, "hb"), on, "left").na.fill(0)
    return rows.select(on, ((F.col("ha") / F.col("na") + F.col("hb") / F.col("nb")) / 2).alias("similarity"))


def loo_gain(pred: DataFrame, true: DataFrame, group: str, kind: str) -> DataFrame:
    """What each type adds: overlap with all cells less overlap without the type's, over what was missing.

    A cell outlives a type's removal iff another type covers it, so all removals are counted at once."""
    cell = ["ix", "iy", "iz"]
    cover = pred.groupBy(group, *cell).agg(F.count_distinct(kind).alias("k"), F.min(kind).alias("only"))
    t = true.select(group, *cell).distinct().withColumn("t", F.lit(1))
    marked = cover.join(t, [group, *cell], "left")
    full = marked.groupBy(group).agg(F.count("*").alias("np"), F.count("t").alias("hit"))
    alone = marked.where("k = 1").groupBy(group, F.col("only").alias(kind)).agg(F.count("*").alias("gone"), F.count("t").alias("gone_hit"))
    nt = t.groupBy(group).agg(F.count("*").alias("nt"))
    kinds = pred.select(group, kind).distinct()
    rows = kinds.join(full, group).join(nt, group).join(alone, [group, kind], "left").na.fill(0)
    ratio = lambda hit, n: F.when(n + F.col("nt") - hit > 0, hit / (n + F.col("nt") - hit)).otherwise(0.0)
    rows = rows.withColumn("full", ratio(F.col("hit"), F.col("np"))).withColumn("base", ratio(F.col("hit") - F.col("gone_hit"), F.col("np") - F.col("gone")))
    gain = F.when(F.col("base") < 1 - fixed.FULL_BASE, F.least(F.greatest((F.col("full") - F.col("base")) / (1 - F.col("base")), F.lit(0.0)), F.lit(1.0)))
    return rows.select(group, kind, "full", "base", gain.alias("gain"))


def loo_gain_filled(pred: DataFrame, true: DataFrame, group: str, kind: str) -> DataFrame:
    """The same with solid interiors: filling isn't additive, so each (group, left-out type) is filled by a kernel, in parallel.

    pred(group, kind, cells), true(group, cells)."""
    cell = ["ix", "iy", "iz"]
    kinds = dict(pred.dtypes)
    t = true.groupBy(group).agg(F.collect_set(F.struct(*cell)).alias("true_cells"))
    p = pred.groupBy(group).agg(F.collect_list(F.struct(kind, *cell)).alias("cells"), F.array_sort(F.collect_set(kind)).alias("types"))
    jobs = p.join(t, group).select(group, "cells", "true_cells", F.explode("types").alias(kind))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                row = r._asdict()
                cells = np.array([[c["ix"], c["iy"], c["iz"]] for c in row["cells"]], int)
                of = np.array([c[kind] for c in row["cells"]], object)
                want = kernels.as_set(kernels.fill(np.array([[c["ix"], c["iy"], c["iz"]] for c in row["true_cells"]], int)))
                full = kernels.iou(kernels.as_set(kernels.fill(np.unique(cells, axis=0))), want)
                left = cells[of != row[kind]]
                base = kernels.iou(kernels.as_set(kernels.fill(np.unique(left, axis=0))) if len(left) else set(), want)
                gain = None if base >= 1 - fixed.FULL_BASE else min(1.0, max(0.0, (full - base) / (1 - base)))
                out.append((row[group], row[kind], full, base, gain))
            yield pd.DataFrame(out, columns=[group, kind, "full", "base", "gain"])

    return jobs.repartition(group, kind).mapInPandas(run, f"{group} {kinds[group]}, {kind} {kinds[kind]}, full double, base double, gain double")


def centroid_pairs(points: DataFrame, group: str, most: float) -> DataFrame:
    """Unordered pairs of a group's points (id, x, y, z) at most `most` apart, by grid cells."""
    cell = lambda c: F.floor(F.col(c) / most)
    a = points.select(group, F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    b = points.select(group, F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"], steps.alias("s"))
    b = b.select(group, "b", "bx", "by", "bz", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), (F.col("cz") + F.col("s.k")).alias("cz"))
    gap = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2)
    return a.join(b, [group, "cx", "cy", "cz"]).where("a < b").select(group, "a", "b", gap.alias("distance")).where(F.col("distance") <= most)


def fused(terms: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted mean over the terms that are there, and the share of weight that they have."""
    ok = [F.when(v.isNotNull() & ~F.isnan(v), F.lit(w)).otherwise(0.0) for v, w in terms]
    total = sum(ok[1:], ok[0])
    value = [F.when(k > 0, v * k).otherwise(0.0) for (v, _), k in zip(terms, ok, strict=True)]
    return F.when(total > 0, sum(value[1:], value[0]) / total), total / sum(w for _, w in terms)


def part_score(iou: Column, topology: Column) -> Column:
    return fused([(iou, fixed.IOU_WEIGHT), (topology, fixed.TOPOLOGY_WEIGHT)])[0]


def rubric_score(bom: Column, orient: Column, fit: Column, layout: Column, part: Column) -> Column:
    """The rubric's weighted items over those there, times the part factor."""
    return fused([(bom, fixed.BOM_WEIGHT), (orient, fixed.ORIENT_WEIGHT), (fit, fixed.FIT_WEIGHT), (layout, fixed.LAYOUT_WEIGHT)])[0] * part


def type_scores(pred: DataFrame, true: DataFrame, pitch: float) -> DataFrame:
    """shape, iou of the best of 24 rotations of filled voxels of paired meshes, one kernel call for each shape.

    pred, true: shape, vertices (array of x, y, z), triangles (array of a, b, c)."""
    both = pred.select("shape", F.col("vertices").alias("pv"), F.col("triangles").alias("pt")).join(true.select("shape", F.col("vertices").alias("tv"), F.col("triangles").alias("tt")).hint("merge"), "shape")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                cells = [kernels.fill(kernels.surface_cells(np.array(v.tolist(), float), np.array(t.tolist(), int), pitch)) for v, t in ((r.pv, r.pt), (r.tv, r.tt))]
                score, rot = kernels.best_iou(cells[1], cells[0])
                out.append((r.shape, score, rot))
            yield pd.DataFrame(out, columns=["shape", "iou", "rot"])

    return spread(both, "shape").mapInPandas(run, "shape string, iou double, rot int")
