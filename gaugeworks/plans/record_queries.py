"""Score records, costs, order-dependent and resume queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalar as S
from gaugeworks.functions import text as X
from gaugeworks.operators import records as R
from gaugeworks.operators import rules as RU
from gaugeworks.plans.adapters import RECORDS, records, table
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


def cases(spark, d):
    return R.case_results(R.resolve(records(spark, d)))


def r6(name: str):
    return F.round(c(name), 6).alias(name)


@query(f"WITH {RECORDS} SELECT model, effort, CASE WHEN bool_and(resolved) THEN round(avg(value), 6) END AS mean, count(*) AS cases, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS pending FROM cases GROUP BY ALL")
def core_headline(spark, d):
    return R.headline(cases(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {RECORDS} SELECT model, effort, task, round(avg(CASE WHEN resolved THEN value END), 6) AS mean, count(*) FILTER (resolved) AS resolved, count(*) AS cases, grouping(task)::INT AS overall FROM cases GROUP BY GROUPING SETS ((model, effort, task), (model, effort))")
def core_per_task(spark, d):
    return R.per_task(cases(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {RECORDS}, t AS (SELECT model, effort, task, avg(value) AS m FROM cases WHERE value IS NOT NULL GROUP BY ALL) SELECT model, effort, round(avg(m), 6) AS mean, count(*) AS tasks FROM t GROUP BY ALL")
def mean_of_task_means(spark, d):
    return R.mean_of_task_means(cases(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {RECORDS} SELECT state, task, count(*) AS n, round(sum(val), 4) AS total FROM valued GROUP BY ALL")
def record_states(spark, d):
    return R.resolve(records(spark, d)).groupBy("state", "task").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {RECORDS}, want AS (SELECT 'T' || (c_custkey % 6 + 1) AS task, 'case' || c_custkey AS case_id FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
lines AS (SELECT DISTINCT model, effort FROM cases)
SELECT coalesce(w.model, s.model) AS model, coalesce(w.effort, s.effort) AS effort, coalesce(w.task, s.task) AS task, coalesce(w.case_id, s.case_id) AS case_id,
  coalesce(s.resolved, false) AS resolved, s.case_id IS NULL AS no_record
FROM (SELECT * FROM lines, want) w FULL JOIN cases s USING (model, effort, task, case_id)""")
def expected_vs_seen(spark, d):
    want = table(spark, d, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select(F.concat(F.lit("T"), c("c_custkey") % 6 + 1).alias("task"), F.concat(F.lit("case"), c("c_custkey")).alias("case_id"))
    return R.with_expected(cases(spark, d), want).select("model", "effort", "task", "case_id", "resolved", (F.coalesce("why", F.lit("")) == "no record").alias("no_record"))


@query("""WITH w AS (SELECT c_custkey AS "case" FROM customer), p AS (SELECT user_id AS "case", bool_and(event_type <> 'error') AS final, bool_or(event_type = 'error') AS rescore FROM events GROUP BY 1),
k AS (SELECT p."case" FROM p SEMI JOIN w USING ("case") WHERE final), r AS (SELECT p."case" FROM p SEMI JOIN w USING ("case") WHERE rescore AND NOT final)
SELECT 'kept' AS part, "case" FROM k UNION ALL SELECT 'rescore', "case" FROM r UNION ALL SELECT 'todo', "case" FROM w WHERE "case" NOT IN (SELECT * FROM k UNION ALL SELECT * FROM r)
UNION ALL SELECT 'others', "case" FROM p WHERE "case" NOT IN (SELECT "case" FROM w)""")
def resume_split(spark, d):
    wanted = table(spark, d, "customer").select(c("c_custkey").alias("case"))
    failed = c("event_type") == "error"
    previous = table(spark, d, "events").groupBy(c("user_id").alias("case")).agg(F.bool_and(~failed).alias("final"), F.bool_or(failed).alias("rescore"))
    parts = [df.select(F.lit(name).alias("part"), "case") for name, df in R.resume_split(wanted, previous).items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""WITH {RECORDS}, x AS (SELECT model, effort, task, case_id, row_number() OVER (PARTITION BY model, effort ORDER BY task, case_id) AS place, count(*) OVER (PARTITION BY model, effort) AS total FROM cases WHERE NOT resolved)
SELECT model, effort, task, case_id, place::INT AS place, greatest(total - 20, 0) AS more FROM x WHERE place <= 20""")
def pending_top20(spark, d):
    return R.top_pending(cases(spark, d)).select("model", "effort", "task", "case_id", "place", "more")


PRICES = [("A", 2.0, 0.5, 8.0, 50000.0, 4.0, 1.0, 12.0), ("N", 1.0, 0.25, 4.0, None, None, None, None), ("_note", 9.0, 9.0, 9.0, None, None, None, None)]


def priced_calls(spark, d):
    prices = spark.createDataFrame(PRICES, "model string, input double, cached double, output double, long_over double, long_input double, long_cached double, long_output double")
    model = F.when(c("l_partkey") % 2 == 0, c("l_returnflag")).otherwise(F.concat("l_returnflag", F.lit("-20240101")))
    calls = table(spark, d, "lineitem").select("l_orderkey", model.alias("model"), c("l_extendedprice").alias("size"), c("l_quantity").alias("kept"), (c("l_tax") * c("l_extendedprice")).alias("out"))
    priced = R.price_joined(calls, prices)
    return priced.select("l_orderkey", "model", c("size").alias("input"), c("kept").alias("cached"), c("out").alias("output"), "price")


CALLS = """calls AS (SELECT l_orderkey, l_returnflag AS base, l_extendedprice AS inp, l_quantity AS cached, l_tax * l_extendedprice AS out FROM lineitem),
usd AS (SELECT *, CASE base WHEN 'A' THEN (greatest(0, inp - cached) * (CASE WHEN inp > 50000 THEN 4.0 ELSE 2.0 END) + cached * (CASE WHEN inp > 50000 THEN 1.0 ELSE 0.5 END) + out * (CASE WHEN inp > 50000 THEN 12.0 ELSE 8.0 END)) / 1e6
  WHEN 'N' THEN (greatest(0, inp - cached) * 1.0 + cached * 0.25 + out * 4.0) / 1e6 END AS usd FROM calls)"""


@query(f"WITH {CALLS} SELECT l_orderkey, round(sum(usd) + 1e-9, 6) AS usd, count(*) AS calls FROM usd GROUP BY 1")
def tiered_cost(spark, d):
    return R.record_usd(priced_calls(spark, d), ("l_orderkey",)).withColumn("usd", F.round(c("usd") + 1e-9, 6))


@query(f"""WITH {CALLS}, s AS (SELECT o_orderpriority, sum(usd) AS usd FROM usd JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), n AS (SELECT o_orderpriority, count(*) AS cases FROM orders GROUP BY 1)
SELECT o_orderpriority, round(usd / cases, 6) AS usd_per_case, cases FROM s JOIN n USING (o_orderpriority)""")
def cost_over_cases(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    spent = R.record_usd(priced_calls(spark, d), ("l_orderkey",)).join(orders, c("l_orderkey") == c("o_orderkey")).groupBy("o_orderpriority").agg(F.sum("usd").alias("usd"))
    return spent.join(orders.groupBy("o_orderpriority").agg(F.count("*").alias("cases")), "o_orderpriority").select("o_orderpriority", F.round(c("usd") / c("cases"), 6).alias("usd_per_case"), "cases")


@query("SELECT event_type, round(median(value), 6) AS seconds FROM events WHERE value <> 0 GROUP BY 1")
def median_seconds(spark, d):
    return table(spark, d, "events").where("value <> 0").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("seconds"))


@query(f"""WITH {RECORDS} SELECT model, effort, array_to_string(list_sort(list(DISTINCT status)), ',') AS status, array_to_string(list_sort(list(DISTINCT skipped) FILTER (skipped IS NOT NULL)), ',') AS skipped,
  bool_or(status IS NULL) AS status_missing, bool_or(skipped IS NULL) AS skipped_missing FROM records GROUP BY ALL""")
def distinct_settings(spark, d):
    s = R.distinct_settings(records(spark, d), ["status", "skipped"])
    return s.select("model", "effort", F.array_join("status_values", ",").alias("status"), F.array_join("skipped_values", ",").alias("skipped"), "status_missing", "skipped_missing")


@query(f"WITH {RECORDS} SELECT CASE WHEN k % 9 = 0 THEN '2.0' ELSE '2.' || (k % 4) END AS version, count(*) AS n FROM records GROUP BY 1")
def version_histogram(spark, d):
    stamped = F.when(c("k") % 9 != 0, F.concat(F.lit("2."), c("k") % 4))
    return records(spark, d).groupBy(F.coalesce(stamped, F.lit("2.0")).alias("version")).agg(F.count("*").alias("n"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT - 1 AS pass_index FROM events")
def pass_index(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.row_number().over(w) - 1).alias("pass_index"))


@query("""WITH t AS (SELECT event_type AS model, user_id AS "case", value / 500 AS score, event_id, ts, value > 20 AS ok FROM events),
n AS (SELECT *, CASE WHEN ok THEN sum(ok::INT) OVER (PARTITION BY model, "case" ORDER BY ts, event_id) END AS nth FROM t),
g AS (SELECT model, "case", count(*) AS trials, sum(ok::INT) AS scored, sum(CASE WHEN nth <= 3 THEN score END) AS total, bool_and("case" % 10 <> 0) AS reportable FROM n GROUP BY ALL),
v AS (SELECT *, CASE WHEN scored >= 3 OR trials >= 6 THEN coalesce(total, 0) / 3 END AS value FROM g)
SELECT model, count(*) AS cases, count(value) AS done, CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS mean,
  CASE WHEN NOT bool_and(reportable) THEN 'NOT REPORTABLE' WHEN count(value) < count(*) THEN 'INCOMPLETE' WHEN count(*) < 100 THEN 'SUBSET' ELSE 'CORE' END AS label FROM v GROUP BY model""")
def first_n_passes(spark, d):
    e = table(spark, d, "events")
    trials = e.select(F.lit("a").alias("agent"), c("event_type").alias("model"), F.lit("e").alias("effort"), c("user_id").alias("case"), F.when(c("value") > 20, c("value") / 500).alias("score"), c("ts").alias("started_at"), c("event_id").alias("trial"), (c("user_id") % 10 != 0).alias("reportable"))
    return R.labelled_lines(R.first_passes(trials, 3)).select("model", "cases", "done", F.round("mean", 6).alias("mean"), "label")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events WHERE event_type NOT IN ('view', 'signup') GROUP BY 1")
def last_qualifying_request(spark, d):
    return table(spark, d, "events").where(~c("event_type").isin("view", "signup")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("""WITH r AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, min(place)::INT AS first, max(place)::INT AS last, count(*) AS length FROM r WHERE failed GROUP BY user_id, island""")
def failure_streaks(spark, d):
    return R.failure_streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], c("event_type") == "error").drop("island")


LINES = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def line_window():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"""WITH s AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey {LINES} ROWS UNBOUNDED PRECEDING) - l_quantity AS spent FROM lineitem)
SELECT l_orderkey, count(*) FILTER (spent < 60) AS admitted, round(sum(l_quantity) FILTER (spent < 60), 2) AS tokens, count(*) AS calls FROM s GROUP BY 1""")
def budget_between_calls(spark, d):
    spent = F.sum("l_quantity").over(line_window().rowsBetween(Window.unboundedPreceding, 0)) - c("l_quantity")
    rows = table(spark, d, "lineitem").withColumn("spent", spent)
    ok = c("spent") < 60
    return rows.groupBy("l_orderkey").agg(F.count_if(ok).alias("admitted"), F.round(F.sum(F.when(ok, c("l_quantity"))), 2).alias("tokens"), F.count("*").alias("calls"))


@query(f"""WITH s AS (SELECT *, floor((sum(l_quantity) OVER (PARTITION BY l_orderkey {LINES} ROWS UNBOUNDED PRECEDING) - l_quantity) / 50)::BIGINT AS bucket FROM lineitem)
SELECT l_orderkey, bucket, count(*) AS n, round(sum(l_quantity), 2) AS total FROM s GROUP BY ALL""")
def running_bucket(spark, d):
    before = F.sum("l_quantity").over(line_window().rowsBetween(Window.unboundedPreceding, 0)) - c("l_quantity")
    rows = table(spark, d, "lineitem").withColumn("bucket", F.floor(before / 50))
    return rows.groupBy("l_orderkey", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("""WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, l_suppkey)::INT AS ordinal FROM f""")
def first_seen_types(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("pos"))
    return first.select("l_orderkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("pos", "l_suppkey")).alias("ordinal"))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) % 5 AS shard FROM part")
def shard_k_of_n(spark, d):
    """Row k, k + n, ... of the sorted list, without one global sort task: ranks within ranges plus counts of the ranges before."""
    rows = table(spark, d, "part").select("p_partkey").repartitionByRange("p_partkey").withColumn("part_", F.spark_partition_id())
    counts = rows.groupBy("part_").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - c("n"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("part_").orderBy("p_partkey"))
    return rows.withColumn("rank", rank).join(F.broadcast(before), "part_").select("p_partkey", ((c("rank") + c("before") - 1) % 5).alias("shard"))


@query("""SELECT user_id, count(*) AS n, round(stddev_samp(value), 6) AS spread, round(quantile_cont(value, 0.999), 6) AS p999, max(value) AS most FROM events GROUP BY 1""")
def percentile_999(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.stddev_samp("value"), 6).alias("spread"), F.round(F.percentile("value", F.lit(0.999)), 6).alias("p999"), F.max("value").alias("most"))


@query("""WITH a AS (SELECT user_id AS k, max(value) AS v FROM events WHERE event_type <> 'purchase' GROUP BY 1), b AS (SELECT user_id AS k, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT k AS "case", v, 'new' AS origin FROM b UNION ALL SELECT k, v, 'kept' FROM a WHERE k NOT IN (SELECT k FROM b)""")
def result_upsert(spark, d):
    bought = c("event_type") == "purchase"
    best = lambda rows, name: table(spark, d, "events").where(rows).groupBy(c("user_id").alias("case")).agg(F.max("value").alias("v")).withColumn("origin", F.lit(name))
    return R.upsert(best(~bought, "kept"), best(bought, "new"))


@query("""SELECT user_id, round_even(avg(value), 4) AS mean, row_number() OVER (ORDER BY count(*) DESC, user_id)::INT AS place FROM events GROUP BY 1""")
def rounded_means(spark, d):
    """Means to four digits, ties to even; places by the number of events."""
    rows = table(spark, d, "events").groupBy("user_id").agg(S.half_even(F.avg("value")).alias("mean"), F.count("*").alias("n"))
    before = rows.alias("a").select("user_id", "mean", F.row_number().over(Window.orderBy(c("n").desc(), "user_id")).alias("place"))  # a row for each user
    return before


@query("""SELECT event_id, round(floor(value * 10)::BIGINT / 10.0 + 0.03, 1) AS seconds FROM events""")
def iso_seconds(spark, d):
    end = c("ts").cast("timestamp") + F.make_dt_interval(secs=(F.floor(c("value") * 10) / 10 + 0.03).cast("decimal(18,6)"))
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, d, "events").select("event_id", S.seconds_between(iso(c("ts").cast("timestamp")), iso(end)).alias("seconds"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size || ' rounds' WHEN p_size % 3 = 1 THEN 'at most ' || format('{:,}', p_size * 12345) || ' output tokens, your thinking included -- the episode ends when they are spent'
  ELSE 'at most ' || p_size || ' rounds and ' || format('{:,}', p_size * 12345) || ' output tokens, your thinking included -- the episode ends at whichever runs out first' END AS limits,
  'Round ' || (p_partkey % 9) || CASE WHEN p_size % 3 = 1 THEN '' ELSE '/' || p_size END || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' · output tokens ' || format('{:,}', p_partkey * 77) || ' / ' || format('{:,}', p_size * 12345) END AS status,
  'parts/p' || p_partkey || '_alone.png parts/p' || p_partkey || '_in_assembly.png' AS sheets FROM part""")
def text_formats(spark, d):
    rounds, budget = F.when(c("p_size") % 3 != 1, c("p_size")), F.when(c("p_size") % 3 != 0, c("p_size") * 12345)
    sheets = F.array_join(X.sheet_names(F.array(F.concat(F.lit("p"), c("p_partkey").cast("string")))), " ")
    return table(spark, d, "part").select("p_partkey", X.limits_text(rounds, budget).alias("limits"), X.round_status(c("p_partkey") % 9, rounds, c("p_partkey") * 77, budget).alias("status"), sheets.alias("sheets"))


@query("""WITH c AS (SELECT *, lag(floor(value * 20)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT event_id, n > 1 AND 10000 - coalesce(before, 0) < 8000 AS needed FROM c""")
def summary_triggers(spark, d):
    calls = table(spark, d, "events").select("event_id", "user_id", F.floor(c("value") * 20).alias("input_tokens"), F.lit(10_000).cast("long").alias("context_tokens"))
    return M.needs_summary(calls, ["user_id"], "event_id").select("event_id", "needed")


@query("""WITH r AS (SELECT event_id % 200 AS trial, arg_max((value * 4)::INT, event_id) FILTER (event_type <> 'view') AS status FROM events GROUP BY 1),
t AS (SELECT c_custkey AS trial, c_custkey % 11 <> 0 AS has_result, c_custkey % 7 <> 0 AS collected, c_custkey % 5 <> 0 AS has_meter, c_nationkey = 3 AS no_answer, c_acctbal < 0 AS failed, c_custkey % 2 = 0 AS boom FROM customer),
s AS (SELECT t.*, CASE WHEN NOT has_result OR NOT collected OR failed THEN 'pending' WHEN no_answer THEN 'no_submission' ELSE 'scored' END AS v, CASE WHEN status = 429 OR status >= 500 THEN status END AS ps FROM t LEFT JOIN r ON t.trial = r.trial)
SELECT trial, CASE WHEN has_result AND NOT has_meter AND v <> 'pending' THEN 'pending' WHEN has_meter AND boom AND ps IS NOT NULL THEN 'pending' ELSE v END AS status, has_result AND has_meter AS reportable FROM s""")
def trial_status(spark, d):
    k = c("c_custkey")
    pins = F.create_map(F.lit("v"), F.lit("1"))
    trials = table(spark, d, "customer").select(
        k.alias("trial"), (k % 11 != 0).alias("has_result"), (k % 7 != 0).alias("collected"), F.lit(True).alias("has_reward"), (c("c_acctbal") / 1e4).cast("double").alias("reward"), F.when(c("c_acctbal") < 0, "failed").alias("reward_error"),
        (c("c_nationkey") == 3).alias("no_answer"), (k % 5 != 0).alias("has_meter"), F.lit(500_000.0).alias("budget"), F.lit(False).alias("budget_hit"), F.lit(0).alias("usage_unread"), F.lit(True).alias("upstreams_ok"),
        F.when(k % 2 == 0, "Boom").alias("exception"), pins.alias("pins"), pins.alias("standard_pins"),
    )
    requests = table(spark, d, "events").select((c("event_id") % 200).alias("trial"), c("event_id").alias("line"), F.round(c("value") * 4).cast("int").alias("status"), (c("event_type") == "view").alias("refused"), F.lit(False).alias("blocked"), F.lit(False).alias("websocket"))
    return RU.trial_states(trials, requests).select("trial", "status", "reportable")
