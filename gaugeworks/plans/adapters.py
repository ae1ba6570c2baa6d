"""The driver's tables seen as the inputs of each operator family; SQL twins of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records from events."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    error = F.when(c("k") % 4 == 0, "RateLimit 429").when(c("k") % 4 == 1, "CallOverBudget: 5").when(c("k") % 4 == 2, "timeout").otherwise("KeyError")
    return e.select(
        "event_id",
        "ts",
        "k",
        c("value").alias("seconds"),
        F.concat(F.lit("m"), c("k") % 3).alias("model"),
        F.when(c("k") % 2 == 0, "low").otherwise("high").alias("effort"),
        F.concat(F.lit("data/task"), c("user_id") % 6 + 1, F.lit("/case"), c("user_id")).alias("case"),
        F.concat(F.lit("case"), c("user_id")).alias("case_id"),
        (c("event_id") % 3).alias("rep"),
        F.when(c("event_type") == "error", error).alias("error"),
        F.when(c("k") % 17 == 0, "no input").alias("skipped"),
        (c("event_type") != "signup").alias("has_score"),
        F.when((c("event_type") != "signup") & ~((c("event_type") == "click") & (c("k") % 5 == 0)), F.least(F.lit(1.0), c("value") / 200)).alias("score"),
        F.when(c("k") % 11 == 0, "invalid_prediction").otherwise("ok").alias("status"),
        F.when(c("k") % 13 == 0, "legacy").otherwise("position").alias("correspondence_mode"),
        F.when(c("k") % 10 == 0, "MemoryBudget hit").otherwise("empty answer").alias("score_error"),
    )


RECORDS = r"""
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
records AS (
  SELECT event_id, ts, k, value, 'm' || (k % 3) AS model, CASE WHEN k % 2 = 0 THEN 'low' ELSE 'high' END AS effort,
    'T' || (user_id % 6 + 1) AS task, 'case' || user_id AS case_id, event_id % 3 AS rep,
    CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'RateLimit 429' WHEN 1 THEN 'CallOverBudget: 5' WHEN 2 THEN 'timeout' ELSE 'KeyError' END END AS error,
    CASE WHEN k % 17 = 0 THEN 'no input' END AS skipped, event_type <> 'signup' AS has_score,
    CASE WHEN event_type <> 'signup' AND NOT (event_type = 'click' AND k % 5 = 0) THEN least(1.0, value / 200) END AS score,
    CASE WHEN k % 11 = 0 THEN 'invalid_prediction' ELSE 'ok' END AS status,
    CASE WHEN k % 13 = 0 THEN 'legacy' ELSE 'position' END AS mode,
    CASE WHEN k % 10 = 0 THEN 'MemoryBudget hit' ELSE 'empty answer' END AS score_error
  FROM ev),
resolved AS (
  SELECT *, CASE
      WHEN skipped IS NOT NULL THEN 'pending' WHEN error LIKE '%CallOverBudget%' THEN 'no_submission' WHEN error IS NOT NULL THEN 'pending'
      WHEN NOT has_score THEN 'no_submission' WHEN task = 'T6' AND status = 'invalid_prediction' THEN 'no_submission'
      WHEN task = 'T6' AND mode <> 'position' THEN 'pending' WHEN task = 'T6' AND (status <> 'ok' OR score IS NULL) THEN 'pending'
      WHEN score IS NOT NULL THEN 'scored' WHEN score_error LIKE '%MemoryBudget%' THEN 'pending' ELSE 'no_submission' END AS state
  FROM records),
valued AS (SELECT *, CASE state WHEN 'scored' THEN score WHEN 'no_submission' THEN 0.0 END AS val FROM resolved),
reps AS (SELECT model, effort, task, case_id, rep, bool_or(state <> 'pending') AS done, sum(val) AS total, count(val) AS n FROM valued GROUP BY ALL),
cases AS (SELECT model, effort, task, case_id, bool_and(done) AS resolved, sum(total) / sum(n) AS value, count(*) AS reps FROM reps GROUP BY ALL)"""


def points(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """board, id, ctype, x, y, z from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        c("label").cast("string").alias("board"),
        c("vec_id").alias("id"),
        F.when(c("vec_id") % 3 == 0, "fuse").when(c("vec_id") % 3 == 1, "resistor").otherwise("capacitor").alias("ctype"),
        *[(F.get("embedding", F.lit(i)).cast("double") * scale).alias(n) for i, n in enumerate("xyz")],
    )


POINTS = """
points AS (
  SELECT label::VARCHAR AS board, vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'fuse' WHEN 1 THEN 'resistor' ELSE 'capacitor' END AS ctype,
    embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shape, kind, cells: the first three coordinates on a lattice; and the next three as the predicted side."""
    e = table(spark, sf_dir, "embeddings")
    lattice = lambda i: F.rint(F.get("embedding", F.lit(i)).cast("double") * 16).cast("long")
    return e.select(c("label").cast("string").alias("shape"), (c("vec_id") % 4).alias("kind"), *[lattice(i).alias(n) for i, n in enumerate(("ix", "iy", "iz"))], *[lattice(i).alias(n) for i, n in ((0, "jx"), (1, "jy"), (3, "jz"))])


VOXELS = """
lat AS (SELECT label::VARCHAR AS shape, vec_id % 4 AS kind,
    round_even(embedding[1]::DOUBLE * 16, 0)::BIGINT AS ix, round_even(embedding[2]::DOUBLE * 16, 0)::BIGINT AS iy, round_even(embedding[3]::DOUBLE * 16, 0)::BIGINT AS iz,
    round_even(embedding[1]::DOUBLE * 16, 0)::BIGINT AS jx, round_even(embedding[2]::DOUBLE * 16, 0)::BIGINT AS jy, round_even(embedding[4]::DOUBLE * 16, 0)::BIGINT AS jz FROM embeddings),
va AS (SELECT DISTINCT shape, ix, iy, iz FROM lat),
vb AS (SELECT DISTINCT shape, jx AS ix, jy AS iy, jz AS iz FROM lat)"""


def true_cells(v: DataFrame) -> DataFrame:
    return v.select("shape", "ix", "iy", "iz").distinct()


def pred_cells(v: DataFrame) -> DataFrame:
    return v.select("shape", c("jx").alias("ix"), c("jy").alias("iy"), c("jz").alias("iz")).distinct()


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """board, tid, gnet, pnet: terminals of a true and a predicted graph on lineitem, with their nets; boards by order."""
    rows = table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") % 50).alias("board"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_extendedprice").cast("long")).alias("tid"),
        c("l_suppkey").alias("gnet"),
        (c("l_partkey") % 97).alias("pnet"),
    )
    rows = rows.groupBy("board", "tid").agg(F.min("gnet").alias("gnet"), F.min("pnet").alias("pnet"))
    return rows


def sides(paired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The incidences of both graphs."""
    return paired.select("board", "tid", c("gnet").alias("nid")), paired.select("board", "tid", c("pnet").alias("nid"))


BOARDS = """
rows_ AS (SELECT l_orderkey % 50 AS board, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS tid, l_suppkey AS gnet, l_partkey % 97 AS pnet FROM lineitem),
inc AS (SELECT board, tid, min(gnet) AS gnet, min(pnet) AS pnet FROM rows_ GROUP BY ALL),
shared AS (SELECT board, pnet, gnet, count(*) AS n FROM inc GROUP BY ALL),
degree AS (SELECT board, gnet, count(*) AS degree FROM inc GROUP BY ALL)"""

RAIL_NAMES = ["GND", "VCC", "+3V3", "SIG_1", "VIN_SEL", "GND_D", "V-", "AVDD_2", "12V", "0V"]
RAIL_CLASSES = ["ground", "supply", "supply", None, None, "ground", "ground", "supply", "supply", "ground"]
