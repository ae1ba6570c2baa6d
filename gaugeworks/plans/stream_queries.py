"""Usage, admission and event-time queries on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.plans.adapters import table
from gaugeworks.streaming import meter as M

c = F.col
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type IN ('purchase', 'click')) AS used, bool_or(event_type IN ('purchase', 'click')) AS found, count(*) AS events FROM events GROUP BY 1""")
def usage_fold(spark, d):
    return M.folded_usage(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", c("event_type").isin("purchase", "click"))


@query("""WITH e AS (SELECT user_id, ts AS edge, 1 AS step FROM events UNION ALL SELECT user_id, ts + (floor(value * 60) * INTERVAL 1 SECOND), -1 FROM events),
r AS (SELECT user_id, sum(step) OVER (PARTITION BY user_id ORDER BY edge, step ROWS UNBOUNDED PRECEDING) AS now FROM e) SELECT user_id, max(now)::BIGINT AS max_in_flight FROM r GROUP BY 1""")
def max_in_flight(spark, d):
    spans = table(spark, d, "events").select("user_id", "ts", (c("ts") + F.make_dt_interval(secs=F.floor(c("value") * 60))).alias("until"))
    return M.max_in_flight(spans, "user_id", "ts", "until")


@query("""WITH b AS (SELECT user_id AS trial, event_id AS seq, floor(value)::BIGINT AS tokens, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - floor(value)::BIGINT AS before FROM events)
SELECT trial, seq, before < 1500 AS admitted, sum(CASE WHEN before < 1500 THEN tokens ELSE 0 END) OVER (PARTITION BY trial ORDER BY seq ROWS UNBOUNDED PRECEDING)::DOUBLE AS spent FROM b""")
def budget_admission(spark, d):
    rows = table(spark, d, "events").select(c("user_id").alias("trial"), c("event_id").alias("seq"), F.floor("value").cast("double").alias("tokens"))
    return M.admission_batch(rows, 1500)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, d):
    return M.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type").withColumn("total", F.round("total", 4)).withColumn("start", c("start").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    return M.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id").withColumn("start", c("start").cast("timestamp_ntz"))


@query("SELECT user_id, least(greatest(floor((count(*) - 3 - 0.5 * count(DISTINCT event_type)) / 2.5), 1), 12)::INT AS scorers FROM events GROUP BY 1")
def elastic_scorers(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(M.allowed_scorers(F.count("*"), F.count_distinct("event_type"), 1, 12).alias("scorers"))
