"""Scores of parts and whole assemblies, from voxel tables and matchings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import fixed
from gaugeworks.functions.scalar import betti_product, gain_over, magnitude_ratio
from gaugeworks.operators import geometry as G
from gaugeworks.operators import kernels

c = F.col


def placed(instances: DataFrame, parts: DataFrame) -> DataFrame:
    """Points of all instances: instances (case, instance_id, part_id, transform of 16) joined with part points (part_id, x, y, z).
    Spark broadcasts the part table while it is small, else it shuffles."""
    at = lambda i: F.get(c("transform"), F.lit(i))
    rows = instances.join(parts, "part_id")
    turned = [at(4 * r) * c("x") + at(4 * r + 1) * c("y") + at(4 * r + 2) * c("z") + at(4 * r + 3) for r in range(3)]
    return rows.select("case", "instance_id", "part_id", *[t.alias(n) for t, n in zip(turned, "xyz", strict=True)])


def part_scores(overlap: DataFrame, topology: DataFrame, gates: DataFrame) -> DataFrame:
    """Score of each shape: a gate's reason makes it 0; the overlap counts above its trivial floor, topology as a product.

    overlap: shape, iou, floor; topology: shape and b0, b1, b2 of both sides (tb.., pb..); gates: shape, reason (null: passed)."""
    rows = gates.join(overlap, "shape", "left").join(topology, "shape", "left")
    iou = gain_over(c("iou"), c("floor"))
    same = betti_product(*[(c(f"tb{k}"), c(f"pb{k}")) for k in range(3)])
    score, share = G.fused([(iou, fixed.IOU_WEIGHT), (same, fixed.TOPOLOGY_WEIGHT)])
    return rows.select("shape", F.when(c("reason").isNotNull(), 0.0).otherwise(score).alias("score"), F.when(c("reason").isNotNull(), 1.0).otherwise(share).alias("coverage"), "reason")


def attribution(pred: DataFrame, true: DataFrame, shares: DataFrame, filled: bool = False) -> DataFrame:
    """Mean leave-one-type-out gain of each case over the types that can be measured: those with a share of the true volume
    and a base that leaves something to gain. pred: case, kind, cells; true: case, cells; shares: case, kind, share."""
    gains = (G.loo_gain_filled if filled else G.loo_gain)(pred, true, "case", "kind")
    rows = shares.join(gains, ["case", "kind"], "left")
    # a type that the answer lacks adds nothing
    missing = c("full").isNull()
    gain = F.when(missing, 0.0).otherwise(c("gain"))
    measured = (c("share") >= fixed.LEAST_SHARE) & (missing | (c("base") < 1 - fixed.FULL_BASE))
    return rows.groupBy("case").agg(F.avg(F.when(measured, gain)).alias("gain"), F.count_if(measured).alias("types"))


def true_shares(true: DataFrame) -> DataFrame:
    """case, kind, share of the case's distinct cells that the type covers. true: case, kind, cells."""
    total = true.select("case", "ix", "iy", "iz").distinct().groupBy("case").agg(F.count("*").alias("n"))
    own = true.select("case", "kind", "ix", "iy", "iz").distinct().groupBy("case", "kind").agg(F.count("*").alias("k"))
    return own.join(total, "case").select("case", "kind", (c("k") / c("n")).alias("share"))


def scoped_mean(rows: DataFrame, group: str, score: str, in_scope: Column) -> DataFrame:
    """Mean over rows in scope; null and a reason if there is none."""
    agg = rows.groupBy(group).agg(F.avg(F.when(in_scope, F.least(F.greatest(c(score), F.lit(0.0)), F.lit(1.0)))).alias("mean"), F.count_if(in_scope).alias("scoped"))
    return agg.withColumn("reason", F.when(c("scoped") == 0, "no type in scope"))


def headline(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """Mean part score times the attribution score; null if either is."""
    return parts.join(whole, "case", "full_outer").select("case", (c("mean") * c("gain")).alias("score"), "mean", "gain", "reason")


def instance_hits(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Assignment of instances by overlap: case, hits, precision, recall, f1, with a hit at half overlap.

    pred, true: case, instance, cells. Overlaps come from an equi join on cells, so only instances that touch are compared."""
    cell = ["ix", "iy", "iz"]
    a = pred.select("case", c("instance").alias("p"), *cell)
    b = true.select("case", c("instance").alias("g"), *cell)
    n = lambda df, k, name: df.groupBy("case", k).agg(F.count("*").alias(name))
    hit = a.join(b, ["case", *cell]).groupBy("case", "p", "g").agg(F.count("*").alias("hit"))
    pairs = hit.join(n(a, "p", "np"), ["case", "p"]).join(n(b, "g", "ng"), ["case", "g"]).withColumn("weight", c("hit") / (c("np") + c("ng") - c("hit")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        p, rows = np.unique(pdf["p"], return_inverse=True)
        g, columns = np.unique(pdf["g"], return_inverse=True)
        w = np.zeros((len(p), len(g)))
        w[rows, columns] = pdf["weight"]
        got = kernels.heaviest_matching(w)
        good = sum(w[i, j] >= fixed.HIT_IOU for i, j in enumerate(got) if j >= 0)
        return pd.DataFrame([(pdf["case"].iloc[0], int(good))], columns=["case", "hits"])

    hits = pairs.select("case", "p", "g", "weight").groupBy("case").applyInPandas(solve, f"case {dict(pred.dtypes)['case']}, hits long")
    counts = lambda df, k, name: df.groupBy("case").agg(F.count_distinct(k).alias(name))
    rows = counts(b, "g", "ng").join(counts(a, "p", "np"), "case", "full_outer").join(hits, "case", "left").na.fill(0)
    precision, recall = F.when(c("np") > 0, c("hits") / c("np")).otherwise(0.0), F.when(c("ng") > 0, c("hits") / c("ng")).otherwise(0.0)
    rows = rows.withColumn("precision", precision).withColumn("recall", recall)
    return rows.select("case", "hits", "precision", "recall", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0).alias("f1"))


def distance_spectrum(pred: DataFrame, true: DataFrame, most: float | None = None) -> DataFrame:
    """Agreement of sorted centroid distances by unordered pair of types, missing ones counting 0: of all pairs of a case, or
    of those within `most`. Points: case, id, kind, x, y, z."""
    from pyspark.sql import Window

    def all_pairs(points: DataFrame) -> DataFrame:
        side = lambda n: points.select("case", c("id").alias(n), *[c(k).alias(n + k) for k in "xyz"])
        square = lambda k: (c(f"a{k}") - c(f"b{k}")) * (c(f"a{k}") - c(f"b{k}"))
        return side("a").join(side("b"), "case").where("a < b").select("case", "a", "b", F.sqrt(square("x") + square("y") + square("z")).alias("distance"))

    def sorted_gaps(points: DataFrame, name: str) -> DataFrame:
        near = G.centroid_pairs(points, "case", most) if most is not None else all_pairs(points)
        kind = points.select("case", "id", "kind")
        rows = near.join(kind.select("case", c("id").alias("a"), c("kind").alias("ka")), ["case", "a"]).join(kind.select("case", c("id").alias("b"), c("kind").alias("kb")), ["case", "b"])
        rows = rows.select("case", F.least("ka", "kb").alias("k1"), F.greatest("ka", "kb").alias("k2"), c("distance").alias(name))
        return rows.withColumn("i", F.row_number().over(Window.partitionBy("case", "k1", "k2").orderBy(name)))

    both = sorted_gaps(true, "t").join(sorted_gaps(pred, "p"), ["case", "k1", "k2", "i"], "full_outer")
    return both.groupBy("case").agg(F.avg(F.coalesce(magnitude_ratio(c("t"), c("p")), F.lit(0.0))).alias("spectrum"))


def anisotropy(points: DataFrame, group: str) -> DataFrame:
    """Shares of the three eigenvalues of the points' covariance, descending: turning, moving and scaling don't change them.

    The moments are plain aggregates; one 3 x 3 problem is left for each group."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    agg = points.groupBy(group).agg(*[F.covar_samp("xyz"[i], "xyz"[j]).alias(f"c{i}{j}") for i, j in pairs])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shares(m: pd.DataFrame) -> pd.Series:
        out = []
        for row in m.fillna(0.0).itertuples(index=False):
            a = np.zeros((3, 3))
            for v, (i, j) in zip(row, pairs, strict=True):
                a[i, j] = a[j, i] = v
            w = np.sort(np.clip(np.linalg.eigvalsh(a), 0, None))[::-1]
            out.append((w / w.sum()).tolist() if w.sum() > 1e-30 else [1.0, 0.0, 0.0])
        return pd.Series(out)

    return agg.select(group, shares(F.struct(*[f"c{i}{j}" for i, j in pairs])).alias("shares"))


def entity_match(pred: DataFrame, true: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Solids matched with part types: by name if any name of the case resolves, else by invariants.

    pred: case, solid, name, volume, area; true: case, part_id, volume, area, quantity. By invariants: least total relative
    difference, then what is left joins its nearest type within the tolerance."""
    named = pred.withColumn("__id", F.regexp_extract("name", r"^(.+?)(?:_i\d+)?$", 1)).join(true.select("case", c("part_id").alias("__id"), c("part_id")), ["case", "__id"]).select("case", "solid", "part_id")
    rest = pred.join(named.select("case").distinct(), "case", "left_anti")
    both = rest.groupBy("case").cogroup(true.groupBy("case"))

    def solve(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(t):
            slots = t.loc[t.index.repeat(t["quantity"])].reset_index(drop=True)
            gap = lambda x: np.maximum(*[np.abs(p[k].to_numpy()[:, None] - x[k].to_numpy()) / np.maximum(np.abs(x[k].to_numpy()), 1e-12) for k in ("volume", "area")])
            d, every = gap(slots), gap(t)
            got = kernels.assignment(d)
            for k, j in enumerate(got):
                if j >= 0 and d[k, j] <= tolerance:
                    out.append((p["case"].iloc[k], p["solid"].iloc[k], slots["part_id"].iloc[j]))
                elif every[k].min() <= tolerance:
                    out.append((p["case"].iloc[k], p["solid"].iloc[k], t["part_id"].iloc[int(every[k].argmin())]))
        return pd.DataFrame(out, columns=["case", "solid", "part_id"])

    kinds = dict(pred.dtypes) | {"part_id": dict(true.dtypes)["part_id"]}
    return named.unionByName(both.applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in ("case", "solid", "part_id"))))
