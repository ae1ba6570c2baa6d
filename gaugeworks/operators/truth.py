"""The graph that a score may ask for: what an observer can't see is hidden, merged or nulled; and checks of spatial tables.

Tables as in `graphs`: component(board, cid, ctype, value, package, classes array<array<int>>), terminal(board, cid, idx, tid),
incidence(board, tid, nid). observed(board, cid, value_visible, hidden array<string>, identity string, partition
array<array<int>>): identity is `all` (every terminal can be told apart), `partition` (as the partition says) or `none`, which is
also what a component without a row gets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import fixed
from gaugeworks.functions.scalar import default_classes
from gaugeworks.operators.kernels import UnionFind


def declared_pins(package):
    """The number of pins that a footprint's name states (a Column), null if it states none."""
    stated = F.nullif(F.regexp_extract(package, fixed.PIN_COUNT, 1), F.lit("")).cast("int")
    known = F.create_map(*[F.lit(x) for kv in fixed.PACKAGE_PINS.items() for x in kv])
    return F.coalesce(stated, F.element_at(known, F.substring_index(package, "_", 1)))


def mechanical_pads(component: DataFrame, terminal: DataFrame, incidence: DataFrame) -> DataFrame:
    """board, tid of pads that are no pins: of a component with more terminals than its footprint states, those on the nets of an
    earlier one; all of the component's, or none if fewer than stated would be left."""
    nets = incidence.groupBy("board", "tid").agg(F.array_sort(F.collect_list("nid")).alias("nets"))
    rows = terminal.join(component.select("board", "cid", declared_pins(F.col("package")).alias("pins")).where("pins is not null"), ["board", "cid"])
    rows = rows.join(nets, ["board", "tid"], "left")
    whole = Window.partitionBy("board", "cid")
    nth = F.row_number().over(Window.partitionBy("board", "cid", "nets").orderBy("idx"))
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("later", F.col("nets").isNotNull() & (nth > 1))
    rows = rows.withColumn("kept", F.count_if(~F.col("later")).over(whole))
    return rows.where((F.col("n") > F.col("pins")) & F.col("later") & (F.col("kept") >= F.col("pins"))).select("board", "tid")


def merged_partitions(a: list[list[int]], b: list[list[int]], n: int) -> list[list[int]]:
    """The finest partition of 0 .. n - 1 that is as coarse as both, classes by their smallest member."""
    joined = UnionFind(n)
    for group in (*a, *b):
        for x in group[1:]:
            joined.union(group[0], x)
    classes: dict[int, list[int]] = {}
    for x in range(n):
        classes.setdefault(joined.find(x), []).append(x)
    return sorted(classes.values())


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def coarser(classes: pd.Series, partition: pd.Series, n: pd.Series) -> pd.Series:
    both = zip(classes, partition, n, strict=True)
    return pd.Series([merged_partitions([list(g) for g in a], [list(g) for g in b], int(k)) for a, b, k in both])


def scorable(component: DataFrame, terminal: DataFrame, incidence: DataFrame, observed: DataFrame) -> dict[str, DataFrame]:
    """component (value null where it can't be seen; classes as coarse as the observation; widened, folded), terminal (renumbered)
    and incidence without what is hidden. Null tables of observations hide every value and every identity."""
    pads = mechanical_pads(component, terminal, incidence).withColumn("folded", F.lit(True))
    hidden = observed.select("board", F.explode("hidden").alias("tid")).withColumn("folded", F.lit(False))
    gone = hidden.unionByName(pads).groupBy("board", "tid").agg(F.max("folded").alias("folded"))
    marked = terminal.join(gone, ["board", "tid"], "left")
    place = F.row_number().over(Window.partitionBy("board", "cid").orderBy("idx")) - 1
    left = marked.where("folded is null").withColumn("place", place).select("board", "cid", F.col("place").alias("idx"), F.col("idx").alias("was"), "tid")
    moved = left.groupBy("board", "cid").agg(F.map_from_entries(F.collect_list(F.struct("was", "idx"))).alias("moved"), F.count("*").cast("int").alias("n"))
    folded = marked.where("folded").groupBy("board", "cid").agg(F.array_sort(F.collect_list("tid")).alias("folded"))
    rows = component.join(moved, ["board", "cid"], "left").join(folded, ["board", "cid"], "left").join(observed.select("board", "cid", "value_visible", "identity", "partition"), ["board", "cid"], "left")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    renumbered = F.transform("classes", lambda g: F.array_sort(F.filter(F.transform(g, lambda i: F.element_at("moved", i)), lambda x: x.isNotNull())))
    declared = F.when(F.col("moved").isNotNull(), F.filter(renumbered, lambda g: F.size(g) > 0))
    rows = rows.withColumn("own", default_classes(F.col("ctype"), F.col("n"), declared))
    everything = F.when(F.col("n") > 0, F.array(F.sequence(F.lit(0), F.col("n") - 1))).otherwise(F.array().cast("array<array<int>>"))
    seen = F.when(F.col("identity") == "partition", F.coalesce("partition", everything)).otherwise(everything)
    rows = rows.withColumn("seen", F.when(F.coalesce(F.col("identity") == "all", F.lit(False)), F.col("own")).otherwise(coarser(F.col("own"), seen, F.col("n"))))
    value = F.when(F.coalesce("value_visible", F.lit(False)), F.col("value"))
    out = rows.select(*[c for c in component.columns if c not in ("value", "classes")], value.alias("value"), F.col("value").alias("source_value"), F.col("seen").alias("classes"), (F.col("seen") != F.col("own")).alias("widened"), "folded")
    return {"component": out, "terminal": left.select("board", "cid", "idx", "tid"), "incidence": incidence.join(gone, ["board", "tid"], "left_anti")}


def spatial_faults(graph: DataFrame, component: DataFrame, terminal: DataFrame, place: DataFrame, schema: str, frame: str) -> DataFrame:
    """board, rule, id of faults of spatial tables: graph(board, schema, frame), component with x, y in [0, 1], place(board, tid,
    parent, x, y) in [-0.5, 0.5] for each terminal exactly once. EDGE_SLACK beyond the bounds is allowed."""

    def outside(lo: float, hi: float):
        bad = lambda c: F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(lo - fixed.EDGE_SLACK, hi + fixed.EDGE_SLACK)
        return bad("x") | bad("y")

    fault = lambda df, rule, key: df.select("board", F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))
    owner = terminal.groupBy("board", "tid").agg(F.min("cid").alias("cid"))
    both = owner.join(place.withColumn("placed", F.lit(True)), ["board", "tid"], "full_outer")
    several = place.groupBy("board", "tid").agg(F.count("*").alias("n")).where("n > 1")
    found = [
        fault(graph.where(~F.col("schema").eqNullSafe(schema)), "schema", "schema"),
        fault(graph.where(~F.col("frame").eqNullSafe(frame)), "frame", "frame"),
        fault(component.where(outside(0, 1)), "centre", "cid"),
        fault(place.where(outside(-0.5, 0.5)), "relative position", "tid"),
        fault(both.where("placed is null"), "terminal without place", "tid"),
        fault(both.where("cid is null"), "place without terminal", "tid"),
        fault(both.where("cid is not null and placed and not (parent <=> cid)"), "parent", "tid"),
        fault(several, "place repeated", "tid"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clamped(points: DataFrame, lo: float, hi: float) -> DataFrame:
    """x and y brought back to their bounds from within the slack."""
    return points.withColumns({c: F.greatest(F.lit(lo).cast("double"), F.least(F.lit(hi).cast("double"), F.col(c))) for c in ("x", "y")})


def rank_pruned(pairs: DataFrame, group: str, most: int) -> DataFrame:
    """Candidate pairs (group, p, g) whose ranks among their sides (by id) differ by at most `most`."""
    out = pairs
    for side in ("p", "g"):
        ranks = pairs.select(group, side).distinct().withColumn(f"__{side}", F.row_number().over(Window.partitionBy(group).orderBy(side)))
        out = out.join(ranks, [group, side])
    return out.where(F.abs(F.col("__p") - F.col("__g")) <= most).select(*pairs.columns)


def most_constrained(pairs: DataFrame, terminal: DataFrame, group: str = "board") -> DataFrame:
    """board, g and place: true components in the order of a search, fewest candidates first, then most terminals, then id."""
    candidates = pairs.groupBy(group, "g").agg(F.count("*").alias("candidates"))
    pins = terminal.groupBy(group, F.col("cid").alias("g")).agg(F.count("*").alias("pins"))
    order = Window.partitionBy(group).orderBy("candidates", F.col("pins").desc(), "g")
    return candidates.join(pins, [group, "g"], "left").na.fill(0, ["pins"]).select(group, "g", F.row_number().over(order).alias("place"))
