"""Terminal-net graphs on lineitem and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import fixed
from gaugeworks.functions import scalar as S
from gaugeworks.operators import graphs as G
from gaugeworks.operators import truth as T
from gaugeworks.operators.geometry import spread
from gaugeworks.plans.adapters import BOARDS, POINTS, RAIL_CLASSES, RAIL_NAMES, boards, points, sides, table

c = F.col
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CASES = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(RAIL_NAMES))
_CLASSES = " ".join(f"WHEN {k} THEN {repr(n) if n else 'NULL'}" for k, n in enumerate(RAIL_CLASSES))
NAMES = f"names AS (SELECT s_suppkey AS gnet, CASE s_suppkey % {len(RAIL_NAMES)} {_CASES} END AS name, CASE s_suppkey % {len(RAIL_NAMES)} {_CLASSES} END AS rail FROM supplier)"


def rail_names(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in RAIL_NAMES]), (c("s_suppkey") % len(RAIL_NAMES) + 1).cast("int"))
    return table(spark, d, "supplier").select(c("s_suppkey").alias("nid"), name.alias("name"))


@query(f"WITH {NAMES} SELECT gnet AS nid, name, rail FROM names")
def rail_class(spark, d):
    return rail_names(spark, d).withColumn("rail", S.rail_class(c("name")))


TYPES = "CASE p_size % 5 WHEN 0 THEN 'fuse' WHEN 1 THEN 'resistor' WHEN 2 THEN 'buzzer' WHEN 3 THEN 'ferrite_bead' ELSE 'capacitor_polarized' END"


@query(f"""WITH t AS (SELECT DISTINCT {TYPES} AS ctype, p_type FROM part), a AS (SELECT DISTINCT ctype FROM t)
SELECT x.ctype AS true_type, y.ctype AS pred_type, count(*) AS n FROM a x JOIN t y ON CASE x.ctype WHEN 'fuse' THEN y.ctype IN ('fuse', 'ferrite_bead', 'resistor') WHEN 'buzzer' THEN true
WHEN 'ferrite_bead' THEN y.ctype IN ('ferrite_bead', 'inductor') WHEN 'capacitor_polarized' THEN y.ctype IN ('capacitor', 'capacitor_polarized') ELSE x.ctype = y.ctype END GROUP BY ALL""")
def type_compatible_pairs(spark, d):
    k = c("p_size") % 5
    kind = F.when(k == 0, "fuse").when(k == 1, "resistor").when(k == 2, "buzzer").when(k == 3, "ferrite_bead").otherwise("capacitor_polarized")
    t = table(spark, d, "part").select(kind.alias("pred_type"), "p_type").distinct()
    a = t.select(c("pred_type").alias("true_type")).distinct()  # one row for each type
    return F.broadcast(a).join(t, S.type_compatible(c("true_type"), c("pred_type"))).groupBy("true_type", "pred_type").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey AS board, l_linenumber AS tid, l_partkey AS cid, l_suppkey AS nid FROM lineitem)
SELECT board, 'terminal repeated' AS rule, tid::VARCHAR AS id FROM t GROUP BY board, tid HAVING count(*) > 1
UNION ALL SELECT board, 'terminal on several nets', tid::VARCHAR FROM t GROUP BY board, tid HAVING count(DISTINCT nid) > 1
UNION ALL SELECT DISTINCT board, 'incidence without net', nid::VARCHAR FROM t WHERE nid NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def graph_validate(spark, d):
    t = table(spark, d, "lineitem").select(c("l_orderkey").alias("board"), c("l_linenumber").alias("tid"), c("l_partkey").alias("cid"), c("l_suppkey").alias("nid"))
    component = spread(t.select("board", "cid"), "board", "cid").distinct()
    used = spread(t.select("board", "nid"), "board", "nid").distinct()
    net = used.join(table(spark, d, "supplier").where("s_acctbal > 0").select(c("s_suppkey").alias("nid")), "nid").select("board", "nid")
    return G.validate(component, t.select("board", "cid", "tid"), net, t.select("board", "tid", "nid"))


@query(f"""WITH {BOARDS}, m AS (SELECT board, sum(best) AS hit FROM (SELECT board, pnet, max(n) AS best FROM shared GROUP BY ALL) GROUP BY 1), n AS (SELECT board, count(*) AS n FROM inc GROUP BY 1)
SELECT board, round(hit / (2.0 * n - hit), 6) AS net FROM m JOIN n USING (board)""")
def channels_ct_n(spark, d):
    """Incidence channel with each predicted net counted at its largest true share (an upper bound of the assignment)."""
    paired = boards(spark, d)
    true, pred = sides(paired)
    best = G.shared_nets(paired).groupBy("board", "pnet").agg(F.max("n").alias("n"))
    hits = best.select("board", F.explode(F.sequence(F.lit(1), c("n").cast("int"))).alias("one"))
    return G.jaccard(hits, pred, true, "net").withColumn("net", F.round("net", 6))


@query(f"""WITH {BOARDS}, p AS (SELECT board, pnet, sum(n) AS s, max(n) AS m, count(*) AS k FROM shared GROUP BY ALL), g AS (SELECT board, gnet, sum(n) AS s, max(n) AS m, count(*) AS k FROM shared GROUP BY ALL),
t AS (SELECT board, sum(degree) AS total FROM degree GROUP BY 1), a AS (SELECT board, sum(CASE WHEN k > 1 THEN s - m ELSE 0 END) AS x FROM p GROUP BY 1), b AS (SELECT board, sum(CASE WHEN k > 1 THEN s - m ELSE 0 END) AS x FROM g GROUP BY 1)
SELECT board, round(a.x / total, 6) AS short_rate, round(b.x / total, 6) AS open_rate FROM t JOIN a USING (board) JOIN b USING (board)""")
def partition_faults(spark, d):
    shared = G.shared_nets(boards(spark, d))
    degree = shared.groupBy("board", c("gnet").alias("nid")).agg(F.sum("n").alias("degree"))
    return G.fault_rates(shared, degree).select("board", F.round("short_rate", 6).alias("short_rate"), F.round("open_rate", 6).alias("open_rate"))


@query(f"""WITH {BOARDS}, {NAMES}, k AS (SELECT s.*, rail, n / degree AS part, row_number() OVER (PARTITION BY board, pnet ORDER BY n DESC, gnet) AS place, count(rail) OVER (PARTITION BY board, pnet) AS rails,
 count(*) FILTER (rail = 'supply') OVER (PARTITION BY board, pnet) AS supplies FROM shared s JOIN degree USING (board, gnet) LEFT JOIN names USING (gnet)),
o AS (SELECT board, gnet, 1 - max(part) AS outside, count(*) AS pieces FROM k WHERE rail IS NOT NULL GROUP BY ALL)
SELECT board, 'short' AS fault, gnet AS net, round(part, 6) AS share FROM k WHERE rails >= 2 AND supplies > 0 AND rail IS NOT NULL AND place > 1 AND part >= {fixed.FATAL_SHARE}
UNION ALL SELECT board, 'open', gnet, round(outside, 6) FROM o WHERE outside >= {fixed.FATAL_SHARE} AND pieces >= {fixed.OPEN_PIECES} AND outside >= {fixed.OPEN_SHARE}""")
def fatal_rail_faults(spark, d):
    shared = G.shared_nets(boards(spark, d))
    degree = shared.groupBy("board", c("gnet").alias("nid")).agg(F.sum("n").alias("degree"))
    names = degree.select("board", "nid").join(rail_names(spark, d), "nid")
    return G.fatal_faults(shared, degree, names).withColumn("share", F.round("share", 6))


@query(f"WITH {POINTS} SELECT DISTINCT a.board, a.id FROM points a JOIN points b ON a.board = b.board AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.01")
def duplicate_points(spark, d):
    return G.duplicates(points(spark, d), 0.01)


@query(f"""WITH {POINTS}, n AS (SELECT a.board, a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS away FROM points a JOIN points b ON a.board = b.board AND a.id <> b.id GROUP BY ALL)
SELECT board, id, CASE WHEN away IS NULL THEN -1 ELSE round(away, 6) END AS away FROM points LEFT JOIN n USING (board, id)""")
def nearest_neighbour(spark, d):
    """-1 for a point that is alone on its board."""
    away = c("away")
    return G.nearest(points(spark, d), 0.1).select("board", "id", F.when(away == float("inf"), -1.0).otherwise(F.round(away, 6)).alias("away"))


def moved(spark, d):
    p = points(spark, d)
    return p.withColumns({"x": c("x") + F.when(c("id") % 2 == 0, 0.004).otherwise(-0.002), "y": c("y") + 0.001})


GATES = f"""{POINTS}, pred AS (SELECT board, id, ctype, x + CASE WHEN id % 2 = 0 THEN 0.004 ELSE -0.002 END AS x, y + 0.001 AS y FROM points),
dup AS (SELECT DISTINCT a.board, a.id FROM pred a JOIN pred b ON a.board = b.board AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.0005),
alive AS (SELECT * FROM pred ANTI JOIN dup USING (board, id)),
riv AS (SELECT a.board, a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS r FROM points a JOIN points b ON a.board = b.board AND a.ctype = b.ctype AND a.id <> b.id GROUP BY ALL),
tol AS (SELECT p.board, p.id, p.ctype, p.x, p.y, CASE WHEN r IS NULL THEN 0.02 ELSE greatest(0.005, least(0.02, r / 2)) END AS tol FROM points p LEFT JOIN riv USING (board, id)),
dist AS (SELECT a.board, a.id AS p, t.id AS g, a.ctype AS pt, t.ctype AS gt, t.tol, sqrt((a.x - t.x) * (a.x - t.x) + (a.y - t.y) * (a.y - t.y)) AS d FROM alive a JOIN tol t ON a.board = t.board),
near AS (SELECT *, min(d) OVER (PARTITION BY board, p) AS nearest FROM dist)"""


@query(f"WITH {GATES} SELECT board, p, g, round(d, 6) AS distance FROM near WHERE d <= nearest + 0.005 AND d < tol AND CASE gt WHEN 'fuse' THEN pt IN ('fuse', 'ferrite_bead', 'resistor') ELSE gt = pt END")
def gated_candidates(spark, d):
    return G.candidates(moved(spark, d), points(spark, d)).select("board", "p", "g", F.round("distance", 6).alias("distance"))


@query(None)
def position_match(spark, d):
    return G.match(G.candidates(moved(spark, d), points(spark, d)))


def embedded_boards(spark, d, pred: bool):
    """Components at embeddings, two terminals each; nets by another coordinate."""
    p = (moved if pred else points)(spark, d)
    component = p.select("board", c("id").cast("string").alias("cid"), "ctype", F.lit(None).cast("double").alias("value"), "x", "y")
    pins = p.select("board", c("id").cast("string").alias("cid"), "x", "z", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    terminal = pins.select("board", "cid", "idx", F.concat_ws(".", "cid", "idx").alias("tid"), (c("idx") * 0.4 - 0.2).cast("double").alias("x"), F.lit(0.0).alias("y"))
    net = F.concat(F.lit("n"), (F.floor(c("z") * 20) + c("idx")).cast("string"))
    incidence = pins.select("board", F.concat_ws(".", "cid", "idx").alias("tid"), net.alias("nid"))
    nets = incidence.select("board", "nid").distinct().withColumn("name", c("nid"))
    return {"component": component, "terminal": terminal, "net": nets, "incidence": incidence}


@query(None)
def ecad_v2(spark, d):
    return G.score_position(embedded_boards(spark, d, True), embedded_boards(spark, d, False))


@query("""WITH n AS (SELECT l_orderkey AS board, l_partkey AS cid, l_suppkey AS nid, count(*) AS n FROM lineitem GROUP BY ALL), h AS (SELECT board, cid, list_sort(list({'nid': nid, 'n': n})) AS nets FROM n GROUP BY ALL)
SELECT board, cid, min(cid) OVER (PARTITION BY board, nets) AS twin FROM h""")
def twin_components(spark, d):
    pins = table(spark, d, "lineitem").select(c("l_orderkey").alias("board"), c("l_partkey").alias("cid"), F.monotonically_increasing_id().alias("tid"), c("l_suppkey").alias("nid"))
    component = pins.select("board", "cid").distinct().withColumns({"ctype": F.lit("ic"), "value": F.lit(None).cast("double")})
    return G.twin_classes(component, pins.select("board", "cid", "tid"), pins.select("board", "tid", "nid"))


PAIRS = "pairs AS (SELECT DISTINCT l_orderkey % 50 AS board, l_partkey AS p, l_suppkey AS g FROM lineitem)"


def line_pairs(spark, d):
    return table(spark, d, "lineitem").select((c("l_orderkey") % 50).alias("board"), c("l_partkey").alias("p"), c("l_suppkey").alias("g")).distinct()


@query(f"""WITH {PAIRS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY board ORDER BY p) AS x, dense_rank() OVER (PARTITION BY board ORDER BY g) AS y FROM pairs)
SELECT board, p, g FROM r WHERE abs(x - y) <= 20""")
def rank_pruned(spark, d):
    return T.rank_pruned(line_pairs(spark, d), "board", 20)


@query(f"""WITH {PAIRS}, n AS (SELECT board, g, count(*) AS n FROM pairs GROUP BY ALL), t AS (SELECT l_orderkey % 50 AS board, l_suppkey AS g, count(*) AS pins FROM lineitem GROUP BY ALL)
SELECT board, g, row_number() OVER (PARTITION BY board ORDER BY n, pins DESC, g)::INT AS place FROM n JOIN t USING (board, g)""")
def most_constrained(spark, d):
    pins = table(spark, d, "lineitem").select((c("l_orderkey") % 50).alias("board"), c("l_suppkey").alias("cid"))
    return T.most_constrained(line_pairs(spark, d), pins)


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '0' WHEN p_size % 3 = 1 AND p_size % 7 = 2 THEN '0,1' ELSE array_to_string(range(p_size % 7), '|') END AS classes FROM part""")
def default_classes(spark, d):
    kind = F.when(c("p_size") % 3 == 1, "resistor").otherwise("ic")
    classes = S.default_classes(kind, c("p_size") % 7, F.when(c("p_size") % 7 == 0, F.array(F.array(F.lit(0)))))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(classes, lambda g: F.array_join(g, ",")), "|").alias("classes"))


@query(f"""WITH {POINTS}, b AS (SELECT DISTINCT board FROM points), bad AS (SELECT *, NOT (x BETWEEN -1e-9 AND 1 + 1e-9 AND y BETWEEN -1e-9 AND 1 + 1e-9) AS o, NOT (x BETWEEN -0.500000001 AND 0.500000001 AND z BETWEEN -0.500000001 AND 0.500000001) AS r FROM points)
SELECT board, 'schema' AS rule, board AS id FROM b WHERE board <> '1' UNION ALL SELECT board, 'centre', id::VARCHAR FROM bad WHERE o UNION ALL SELECT board, 'relative position', id::VARCHAR FROM bad WHERE r AND id % 5 <> 0
UNION ALL SELECT board, 'terminal without place', id::VARCHAR FROM points WHERE id % 5 = 0 UNION ALL SELECT board, 'parent', id::VARCHAR FROM points WHERE id % 5 <> 0 AND id % 4 = 0""")
def spatial_faults(spark, d):
    p = points(spark, d)
    graph = p.select("board").distinct().select("board", F.when(c("board") == "1", "s").otherwise(c("board")).alias("schema"), F.lit("f").alias("frame"))
    component = p.select("board", c("id").alias("cid"), "x", "y")
    place = p.where("id % 5 <> 0").select("board", c("id").alias("tid"), (c("id") + F.when(c("id") % 4 == 0, 1).otherwise(0)).alias("parent"), "x", c("z").alias("y"))
    return T.spatial_faults(graph, component, p.select("board", c("id").alias("cid"), F.lit(0).alias("idx"), c("id").alias("tid")), place, "s", "f")
