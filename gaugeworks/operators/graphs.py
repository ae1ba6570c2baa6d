"""Terminal-net graphs: validation, spatial correspondence, channel scores, net faults.

Tables, for any number of boards at once: component(board, cid, ctype, value, x, y), terminal(board, cid, idx, tid, x, y),
net(board, nid, name), incidence(board, tid, nid). Matching runs a kernel for each board; all else is relational.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import fixed
from gaugeworks.functions.scalar import rail_class, type_compatible
from gaugeworks.operators.geometry import spread
from gaugeworks.operators.kernels import heaviest_pairs


def validate(component: DataFrame, terminal: DataFrame, net: DataFrame, incidence: DataFrame) -> DataFrame:
    """board, rule, id of structural faults."""

    def twice(df: DataFrame, key: str, rule: str) -> DataFrame:
        return dealt(df.select("board", key), key).groupBy("board", key).count().where("count > 1").select("board", F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))

    def lost(a: DataFrame, b: DataFrame, key: str, rule: str) -> DataFrame:
        both = a.select("board", key, F.lit(True).alias("own")).unionByName(b.select("board", key, F.lit(False).alias("own")))
        alone = dealt(both, key).groupBy("board", key).agg((F.bool_and("own") | (F.bool_or("own") & (F.col("board").isNull() | F.col(key).isNull()))).alias("alone")).where("alone")
        return alone.select("board", F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))

    # rows are dealt out before they are counted: most keys occur once or twice, so that counts beforehand would only hold them
    dealt = lambda df, key: spread(df, "board", key)
    several = dealt(incidence.select("board", "tid", "nid"), "tid").groupBy("board", "tid").agg(F.min("nid").alias("low"), F.max("nid").alias("high")).where("low <> high")
    return (
        twice(component, "cid", "component repeated")
        .unionByName(twice(terminal, "tid", "terminal repeated"))
        .unionByName(twice(net, "nid", "net repeated"))
        .unionByName(lost(component, terminal, "cid", "component without terminals"))
        .unionByName(lost(terminal, component, "cid", "terminal without component"))
        .unionByName(lost(incidence, terminal, "tid", "incidence without terminal"))
        .unionByName(lost(incidence, net, "nid", "incidence without net"))
        .unionByName(several.select("board", F.lit("terminal on several nets").alias("rule"), F.col("tid").cast("string").alias("id")))
    )


def near_pairs(left: DataFrame, right: DataFrame, radius: float, group: str = "board") -> DataFrame:
    """Pairs of points (group, id, x, y) of both tables within radius, by an equi join on grid cells.

    Each right point stands in its cell and the 8 around it, so no distance is computed but between neighbours."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = left.select(group, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.select(group, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("ux"), cell("y").alias("uy"), F.explode(steps).alias("s"))
    b = b.select(group, "b", "bx", "by", (F.col("ux") + F.col("s.i")).alias("cx"), (F.col("uy") + F.col("s.j")).alias("cy"))
    gap = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return a.join(b, [group, "cx", "cy"]).select(group, "a", "b", gap.alias("distance")).where(F.col("distance") <= radius)


def duplicates(points: DataFrame, radius: float = fixed.DUPLICATE_DISTANCE, group: str = "board") -> DataFrame:
    """Points that another point of the group is at most radius away from."""
    return near_pairs(points, points, radius, group).where("a <> b").select(group, F.col("a").alias("id")).distinct()


def nearest(points: DataFrame, radius: float, group: str = "board") -> DataFrame:
    """group, id, away: the distance of each point to the nearest other one of its group, infinite if it is alone. Within the radius
    by grid cells; only points that find none there are held against all of their group."""
    met = near_pairs(points, points, radius, group).where("a <> b").groupBy(group, F.col("a").alias("id")).agg(F.min("distance").alias("away"))
    left = points.select(group, "id", "x", "y").join(met, [group, "id"], "left_anti")
    other = points.select(group, F.col("id").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"))
    far = left.join(other, group, "left").withColumn("distance", F.when(F.col("b") != F.col("id"), F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2)))
    far = far.groupBy(group, "id").agg(F.coalesce(F.min("distance"), F.lit(float("inf"))).alias("away"))
    return met.unionByName(far)


def class_faults(component: DataFrame, terminal: DataFrame) -> DataFrame:
    """board, rule, id of components whose declared classes of terminals don't hold each place exactly once."""
    n = terminal.groupBy("board", "cid").agg(F.count("*").cast("int").alias("n"))
    rows = component.where(F.size("classes") > 0).join(n, ["board", "cid"], "left").na.fill(0, ["n"])
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    bad = F.array_sort(F.flatten("classes")) != places
    return rows.where(bad).select("board", F.lit("classes don't partition the terminals").alias("rule"), F.col("cid").cast("string").alias("id"))


def rival_tolerance(points: DataFrame, kind: str | None, tolerance: float, cap: float, group: str = "board") -> DataFrame:
    """Half the way to each point's nearest rival (of its kind), between tolerance and cap."""
    keyed = points.withColumn(group, F.struct(group, kind)) if kind else points
    rivals = near_pairs(keyed, keyed, 2 * cap, group).where("a <> b").groupBy(group, "a").agg(F.min("distance").alias("rival"))
    out = keyed.join(rivals.withColumnRenamed("a", "id"), [group, "id"], "left")
    out = out.withColumn("tolerance", F.when(F.col("rival").isNull(), cap).otherwise(F.greatest(F.lit(tolerance), F.least(F.lit(cap), F.col("rival") / 2))))
    return out.withColumn(group, F.col(f"{group}.{group}")) if kind else out


def candidates(pred: DataFrame, true: DataFrame, tolerance: float = fixed.COMPONENT_TOLERANCE, cap: float = fixed.COMPONENT_CAP) -> DataFrame:
    """Pairs (board, p, g, distance, weight) that may match: compatible types, the true point nearly the nearest of any type,
    nearer than its tolerance. Points: board, id, ctype, x, y. Predicted points that stand on each other are out."""
    alive = pred.join(duplicates(pred), ["board", "id"], "left_anti")
    tol = rival_tolerance(true, "ctype", tolerance, cap).select("board", F.col("id").alias("b"), "tolerance", F.col("ctype").alias("gtype"))
    close = near_pairs(alive, true, cap)
    nearest = Window.partitionBy("board", "a")
    close = close.withColumn("nearest", F.min("distance").over(nearest))
    pairs = close.join(tol, ["board", "b"]).join(alive.select("board", F.col("id").alias("a"), F.col("ctype").alias("ptype")), ["board", "a"])
    ok = (F.col("distance") <= F.col("nearest") + fixed.NEAREST_MARGIN) & (F.col("distance") < F.col("tolerance")) & type_compatible(F.col("gtype"), F.col("ptype"))
    return pairs.where(ok).select("board", F.col("a").alias("p"), F.col("b").alias("g"), "distance", (F.col("tolerance") - F.col("distance")).alias("weight"))


def solved(pairs: pd.DataFrame) -> pd.DataFrame:
    """The rows of one group's candidate pairs (p, g, weight) that are in its heaviest matching."""
    pairs = pairs.sort_values(["p", "g"])
    rows, columns = (np.unique(pairs[side], return_inverse=True)[1] for side in "pg")
    return pairs[heaviest_pairs(rows, columns, pairs["weight"].to_numpy())]


def match(edges: DataFrame, group: str | list[str] = "board") -> DataFrame:
    """Heaviest matching of candidate pairs (group, p, g, weight) of each group."""
    groups = [group] if isinstance(group, str) else group
    kinds = dict(edges.dtypes)
    fields = [*groups, "p", "g", "weight"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return solved(pdf)[fields]

    return edges.select(*fields).groupBy(*groups).applyInPandas(solve, ", ".join(f"{f} {kinds[f]}" for f in fields))


def match_many(edges: DataFrame, groups: list[str]) -> DataFrame:
    """The same for many small groups: those of a first key are solved in one call."""
    kinds = dict(edges.dtypes)
    fields = [*groups, "p", "g", "weight"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for _, own in pdf.groupby(groups, sort=False):
            kept.append(solved(own))
        return pd.concat(kept)[fields]

    return edges.select(*fields).groupBy(groups[0], F.pmod(F.xxhash64(*groups[1:]), F.lit(16))).applyInPandas(lambda pdf: solve(pdf), ", ".join(f"{f} {kinds[f]}" for f in fields))


def overlaps(pairs: DataFrame, pred: DataFrame, true: DataFrame) -> DataFrame:
    """How many matched terminals (board, p, g) each predicted and true net share. pred, true: incidences."""
    left = pred.select("board", F.col("tid").alias("p"), F.col("nid").alias("pnet"))
    right = true.select("board", F.col("tid").alias("g"), F.col("nid").alias("gnet"))
    return pairs.join(left, ["board", "p"]).join(right, ["board", "g"]).groupBy("board", "pnet", "gnet").agg(F.count("*").alias("n"))


def shared_nets(paired: DataFrame) -> DataFrame:
    """The same from terminals that are already paired: board, pnet, gnet of each."""
    return paired.groupBy("board", "pnet", "gnet").agg(F.count("*").alias("n"))


def jaccard(matched: DataFrame, pred: DataFrame, true: DataFrame, name: str) -> DataFrame:
    """Matched over all of both sides, for each board (counts of three tables)."""
    a, b, m = (df.groupBy("board").agg(F.count("*").alias(n)) for df, n in ((pred, "np"), (true, "ng"), (matched, "nm")))
    both = b.join(a, "board", "full_outer").join(m, "board", "left").na.fill(0)
    below = F.col("np") + F.col("ng") - F.col("nm")
    return both.select("board", F.when(below > 0, F.col("nm") / below).otherwise(0.0).alias(name))


def arity_ratio(pairs: DataFrame, pred: DataFrame, true: DataFrame) -> DataFrame:
    """Mean smaller over larger number of terminals of matched components (board, p, g); 0 without a pair."""
    n = lambda df, key, out: df.groupBy("board", F.col("cid").alias(key)).agg(F.count("*").alias(out))
    both = pairs.join(n(pred, "p", "a"), ["board", "p"], "left").join(n(true, "g", "b"), ["board", "g"], "left").na.fill(0, ["a", "b"])
    ratio = F.when(F.greatest("a", "b") == 0, 1.0).otherwise(F.least("a", "b") / F.greatest("a", "b"))
    return both.groupBy("board").agg(F.avg(ratio).alias("terminal"))


def fault_rates(shared: DataFrame, identified: DataFrame) -> DataFrame:
    """short_rate and open_rate of each board: identified terminals that would have to move. identified: board, nid, degree."""

    def moved(by: str, name: str) -> DataFrame:
        per = shared.groupBy("board", by).agg(F.sum("n").alias("s"), F.max("n").alias("m"), F.count("*").alias("k"))
        return per.groupBy("board").agg(F.sum(F.when(F.col("k") > 1, F.col("s") - F.col("m")).otherwise(0)).alias(name))

    total = identified.groupBy("board").agg(F.sum("degree").alias("total"))
    out = total.join(moved("pnet", "shorts"), "board", "left").join(moved("gnet", "opens"), "board", "left").na.fill(0, ["shorts", "opens"])
    below = F.greatest(F.col("total"), F.lit(1))
    return out.select("board", (F.col("shorts") / below).alias("short_rate"), (F.col("opens") / below).alias("open_rate"))


def fatal_faults(shared: DataFrame, identified: DataFrame, names: DataFrame) -> DataFrame:
    """board, fault, net, share of rails that were mostly fused into another net, or asserted in pieces.

    names: board, nid, name of true nets. The dominant net of a merge is the largest; of equal ones the first by id."""
    rails = names.select("board", F.col("nid").alias("gnet"), rail_class(F.col("name")).alias("rail"))
    degree = identified.select("board", F.col("nid").alias("gnet"), "degree")
    known = shared.join(rails, ["board", "gnet"], "left").join(degree, ["board", "gnet"], "left").withColumn("part", F.col("n") / F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1)))
    w = Window.partitionBy("board", "pnet")
    first = F.row_number().over(w.orderBy(F.col("n").desc(), "gnet")) == 1
    merge = known.withColumn("dominant", first).withColumn("rails", F.count("rail").over(w)).withColumn("supplies", F.count_if(F.col("rail") == "supply").over(w))
    shorts = merge.where((F.col("rails") >= 2) & (F.col("supplies") > 0) & F.col("rail").isNotNull() & ~F.col("dominant") & (F.col("part") >= fixed.FATAL_SHARE))
    pieces = known.where("rail is not null").groupBy("board", "gnet").agg((1 - F.max("part")).alias("outside"), F.count("*").alias("pieces"))
    opens = pieces.where((F.col("outside") >= fixed.FATAL_SHARE) & (F.col("pieces") >= fixed.OPEN_PIECES) & (F.col("outside") >= fixed.OPEN_SHARE))
    return shorts.select("board", F.lit("short").alias("fault"), F.col("gnet").alias("net"), F.col("part").alias("share")).unionByName(opens.select("board", F.lit("open").alias("fault"), F.col("gnet").alias("net"), F.col("outside").alias("share")))


def board_scores(component: DataFrame, terminal: DataFrame, net: DataFrame, rates: DataFrame, fatal: DataFrame) -> DataFrame:
    """Product of the channels; 0 with a fatal rail fault."""
    bad = fatal.groupBy("board").agg(F.count("*").alias("faults"))
    rows = component.join(terminal, "board", "left").join(net, "board", "left").join(rates, "board", "left").join(bad, "board", "left")
    rows = rows.na.fill(0.0, ["component", "terminal", "net", "short_rate", "open_rate"]).na.fill(0, ["faults"])
    short, open_ = (F.greatest(F.lit(0.0), 1 - k * F.col(c)) for k, c in ((fixed.K_SHORT, "short_rate"), (fixed.K_OPEN, "open_rate")))
    score = F.when(F.col("faults") > 0, 0.0).otherwise(F.col("component") * F.col("terminal") * F.col("net") * short * open_)
    return rows.select("board", *[F.round(c, 6).alias(n) for c, n in ((F.col("component"), "component"), (F.col("terminal"), "terminal"), (F.col("net"), "net"), (short, "short"), (open_, "open"), (score, "score"))])


def score_position(pred: dict[str, DataFrame], true: dict[str, DataFrame]) -> DataFrame:
    """Scores of boards by spatial correspondence. pred and true: component, terminal, net and incidence tables."""
    points = lambda g: g["component"].select("board", F.col("cid").alias("id"), "ctype", "x", "y")
    # matchings feed several channels: kept, so that kernels run once (a lost executor's part is computed again)
    phi = match(candidates(points(pred), points(true))).persist(StorageLevel.MEMORY_AND_DISK)
    # terminals meet only those of their component's partner, each pair a group of its own
    pins = lambda g, key: g["terminal"].select("board", F.col("cid").alias(key), F.col("tid").alias("id"), "x", "y")
    pair = F.struct("board", "p", "g").alias("board")
    left = pins(pred, "p").join(phi.select("board", "p", "g"), ["board", "p"]).select(pair, "id", "x", "y")
    right = pins(true, "g").join(phi.select("board", "p", "g"), ["board", "g"]).select(pair, "id", "x", "y")
    tol = rival_tolerance(right, None, fixed.TERMINAL_TOLERANCE, fixed.TERMINAL_CAP).select("board", F.col("id").alias("b"), "tolerance")
    edges = near_pairs(left, right, fixed.TERMINAL_CAP).join(tol, ["board", "b"]).where("distance < tolerance")
    edges = edges.select(F.col("board.board").alias("board"), F.col("board.p").cast("string").alias("part"), F.col("a").alias("p"), F.col("b").alias("g"), (F.col("tolerance") - F.col("distance")).alias("weight"))
    sigma = match_many(edges, ["board", "part"]).select("board", "p", "g").persist(StorageLevel.MEMORY_AND_DISK)
    shared = overlaps(sigma, pred["incidence"], true["incidence"])
    psi = match(shared.select("board", F.col("pnet").alias("p"), F.col("gnet").alias("g"), F.col("n").cast("double").alias("weight")))
    hits = psi.groupBy("board").agg(F.sum("weight").alias("hit"))
    identified = true["incidence"].join(sigma.select("board", F.col("g").alias("tid")), ["board", "tid"], "left_semi").groupBy("board", "nid").agg(F.count("*").alias("degree"))
    counts = lambda df, name: df.groupBy("board").agg(F.count("*").alias(name))
    nets = counts(true["incidence"], "ng").join(counts(pred["incidence"], "np"), "board", "full_outer").join(hits, "board", "left").na.fill(0, ["ng", "np"]).na.fill(0.0, ["hit"])
    below = F.col("ng") + F.col("np") - F.col("hit")
    nets = nets.select("board", F.when(below > 0, F.col("hit") / below).otherwise(0.0).alias("net"))
    return board_scores(jaccard(phi, pred["component"], true["component"], "component"), arity_ratio(phi, pred["terminal"], true["terminal"]), nets, fault_rates(shared, identified), fatal_faults(shared, identified, true["net"]))


def fold_pads(terminal: DataFrame, incidence: DataFrame, folded: DataFrame) -> DataFrame:
    """Terminals of components marked folded: the first of each net stays, unconnected ones all stay."""
    rows = terminal.join(incidence, ["board", "tid"], "left").join(folded.select("board", "cid", F.lit(True).alias("__f")), ["board", "cid"], "left")
    nth = F.row_number().over(Window.partitionBy("board", "cid", "nid").orderBy("idx"))
    return rows.withColumn("__n", nth).where("__f is null or nid is null or __n = 1").select(*terminal.columns)


def twin_classes(component: DataFrame, terminal: DataFrame, incidence: DataFrame) -> DataFrame:
    """Components of a board that are interchangeable: equal type, value, number of terminals and histogram of nets. twin: the first of them."""
    nets = terminal.join(incidence, ["board", "tid"], "left").groupBy("board", "cid", "nid").agg(F.count("*").alias("n"))
    hist = nets.groupBy("board", "cid").agg(F.array_sort(F.collect_list(F.struct("nid", "n"))).alias("nets"))
    rows = component.join(hist, ["board", "cid"], "left")
    return rows.withColumn("twin", F.min("cid").over(Window.partitionBy("board", "ctype", "value", "nets"))).select("board", "cid", "twin")


def loss(incidence: DataFrame, phi: DataFrame, owner: DataFrame, sigma: DataFrame, psi: DataFrame, pred: DataFrame) -> DataFrame:
    """Each true incidence: recovered, lost_to_component (its component has no partner) or lost_to_assignment."""
    rows = incidence.join(owner.select("board", "tid", "cid"), ["board", "tid"])
    rows = rows.join(phi.select("board", F.col("g").alias("cid"), F.lit(True).alias("has")), ["board", "cid"], "left")
    rows = rows.join(sigma.select("board", F.col("g").alias("tid"), F.col("p").alias("pt")), ["board", "tid"], "left")
    rows = rows.join(pred.select("board", F.col("tid").alias("pt"), F.col("nid").alias("pnet")), ["board", "pt"], "left")
    rows = rows.join(psi.select("board", F.col("p").alias("pnet"), F.col("g").alias("to")), ["board", "pnet"], "left")
    state = F.when(F.col("has").isNull(), "lost_to_component").when(F.col("to") == F.col("nid"), "recovered").otherwise("lost_to_assignment")
    return rows.select("board", "tid", "nid", state.alias("state"))


def tables(spark, graphs: Iterable[tuple[str, dict]]) -> dict[str, DataFrame]:
    """The four tables of graph documents (board, document)."""
    c, t, n, i = [], [], [], []
    for board, g in graphs:
        place = {x["id"]: x["relative_position"] for x in g.get("terminals", [])}
        for comp in g["components"]:
            x, y = comp.get("center") or (None, None)
            c.append((board, comp["id"], comp["type"], comp.get("value"), x, y))
            for k, tid in enumerate(comp["terminals"]):
                px, py = place.get(tid, (None, None))
                t.append((board, comp["id"], k, tid, px, py))
        n += [(board, net["id"], (net.get("meta") or {}).get("name") or net["id"]) for net in g["nets"]]
        i += [(board, tid, nid) for tid, nid in g["incidences"]]
    make = spark.createDataFrame
    return {
        "component": make(c, "board string, cid string, ctype string, value double, x double, y double"),
        "terminal": make(t, "board string, cid string, idx int, tid string, x double, y double"),
        "net": make(n, "board string, nid string, name string"),
        "incidence": make(i, "board string, tid string, nid string"),
    }
