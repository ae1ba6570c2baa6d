"""Run records to headline lines: resolution, repetitions, completeness, cost, labels, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import fixed
from gaugeworks.functions.scalar import task_of

SCORED, NOTHING, PENDING = "scored", "no_submission", "pending"


def resolution(
    task: Column, pending_score: Column, skipped: Column, error: Column, has_score: Column, unscored: Column, score: Column, status: Column, mode: Column, score_error: Column
) -> Column:
    """state, value and why of a record, by ordered rules. A machine's failure is pending, never 0."""
    out = lambda state, value, why: F.struct(F.lit(state).alias("state"), value.cast("double").alias("value"), why.alias("why"))
    none, zero = F.lit(None), F.lit(0.0)
    failed = F.coalesce(error, F.lit(""))
    reason = F.coalesce(F.when(score_error != "", score_error), F.when(status != "", status), F.lit(""))
    graph = task == "T6"
    return (
        F.when(F.coalesce(pending_score, F.lit(False)), out(PENDING, none, F.lit("episode finished, not scored yet")))
        .when(F.coalesce(skipped, F.lit("")) != "", out(PENDING, none, F.concat(F.lit("skipped: "), F.substring(skipped, 1, 80))))
        .when(failed.contains(fixed.OVER_BUDGET_ERROR), out(NOTHING, zero, F.lit("call over budget")))
        .when(failed != "", out(PENDING, none, F.substring(failed, 1, 100)))
        .when(~has_score & F.coalesce(unscored, F.lit(False)), out(PENDING, none, F.lit("not scored yet")))
        .when(~has_score, out(NOTHING, zero, F.lit("no submission")))
        .when(graph & (F.coalesce(status, F.lit("")) == "invalid_prediction"), out(NOTHING, zero, F.lit("invalid_prediction")))
        .when(graph & (F.coalesce(mode, F.lit("")) != "position"), out(PENDING, none, F.lit("T6 not in position mode")))
        .when(graph & ((F.coalesce(status, F.lit("ok")) != "ok") | score.isNull()), out(PENDING, none, F.concat(F.lit("T6 "), F.coalesce(status, F.lit("None")))))
        .when(score.isNotNull(), out(SCORED, score, F.lit("")))
        .when(reason.rlike(fixed.PENDING_ERROR), out(PENDING, none, F.concat(F.lit("scorer: "), F.substring(reason, 1, 90))))
        .otherwise(out(NOTHING, zero, F.concat(F.lit("nothing scorable: "), F.substring(reason, 1, 80))))
    )


def resolve(records: DataFrame) -> DataFrame:
    """records (case, error, score, ...) with task, state, value and why."""
    c = F.col
    absent = lambda name, kind: c(name) if name in records.columns else F.lit(None).cast(kind)
    rows = records.withColumn("task", task_of(c("case")))
    has = absent("has_score", "boolean") if "has_score" in records.columns else c("score").isNotNull() | absent("status", "string").isNotNull()
    r = resolution(
        c("task"), absent("pending_score", "boolean"), absent("skipped", "string"), absent("error", "string"), has, absent("unscored", "boolean"),
        c("score"), absent("status", "string"), absent("correspondence_mode", "string"), absent("score_error", "string"),
    )
    return rows.withColumn("r", r).select(*rows.columns, "r.state", "r.value", "r.why")


def case_results(resolved: DataFrame, keys: tuple[str, ...] = ("model", "effort")) -> DataFrame:
    """A case is resolved if each of its repetitions has a record that is; its value is the mean over all resolved
    records, so a record that is there twice weighs twice."""
    done = F.col("state") != PENDING
    reps = resolved.groupBy(*keys, "task", "case_id", "rep").agg(
        F.bool_or(done).alias("done"),
        F.sum(F.when(done, F.col("value"))).alias("total"),
        F.count_if(done).alias("n"),
        F.count_if(F.col("state") == SCORED).alias("n_scored"),
        F.min(F.when(~done, F.col("why"))).alias("why"),
    )
    return reps.groupBy(*keys, "task", "case_id").agg(
        F.bool_and("done").alias("resolved"),
        (F.sum("total") / F.sum("n")).alias("value"),
        F.sum("n_scored").alias("n_scored"),
        F.count("*").alias("reps"),
        F.min("why").alias("why"),
    )


def with_expected(cases: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("model", "effort")) -> DataFrame:
    """Adds, for every line, the expected cases (task, case_id) that it has no record of: pending, 'no record'.
    lines x expected is the result's own size: one row for each case of each line."""
    lines = cases.select(*keys).distinct()
    wanted = lines.join(expected.select("task", "case_id").distinct(), how="cross")
    joined = wanted.join(cases, [*keys, "task", "case_id"], "full_outer")
    return joined.withColumn("why", F.when(F.col("resolved").isNull(), "no record").otherwise(F.col("why"))).withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def headline(cases: DataFrame, keys: tuple[str, ...] = ("model", "effort")) -> DataFrame:
    """A line: mean over cases if all are resolved, else null."""
    return cases.groupBy(*keys).agg(
        F.when(F.bool_and("resolved"), F.avg("value")).alias("mean"),
        F.count("*").alias("cases"),
        F.count_if("resolved").alias("resolved"),
        F.count_if(~F.col("resolved")).alias("pending"),
    )


def per_task(cases: DataFrame, keys: tuple[str, ...] = ("model", "effort")) -> DataFrame:
    """Means of resolved cases for each task and over all (task null), by grouping sets."""
    sets = [[F.col(k) for k in keys] + [F.col("task")], [F.col(k) for k in keys]]
    return cases.groupingSets(sets, *keys, "task").agg(
        F.avg(F.when(F.col("resolved"), F.col("value"))).alias("mean"), F.count_if("resolved").alias("resolved"), F.count("*").alias("cases"), F.grouping("task").cast("int").alias("overall")
    )


def mean_of_task_means(cases: DataFrame, keys: tuple[str, ...] = ("model", "effort")) -> DataFrame:
    """Unweighted mean over the tasks that have a score."""
    tasks = cases.where("value is not null").groupBy(*keys, "task").agg(F.avg("value").alias("mean"))
    return tasks.groupBy(*keys).agg(F.avg("mean").alias("mean"), F.count("*").alias("tasks"))


def call_usd(size: Column, cached: Column, output: Column, price: Column) -> Column:
    """A request's cost: over the long-context threshold its rates hold for the whole request. price: struct."""
    long = price["long_over"].isNotNull() & (size > price["long_over"])
    rate = lambda name: F.when(long, price[f"long_{name}"]).otherwise(price[name])
    return (F.greatest(F.lit(0.0), size - cached) * rate("input") + cached * rate("cached") + output * rate("output")) / 1e6


def price_joined(df: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """df with the price (struct, null if none) of the exact model id, else of the id without a -YYYYMMDD ending."""
    listed = prices.where(~F.col("model").startswith("_"))
    fields = [F.col(c) for c in listed.columns if c != "model"]
    one = listed.select(F.col("model").alias("__exact"), F.struct(*fields).alias("__p1"))
    two = listed.select(F.col("model").alias("__base"), F.struct(*fields).alias("__p2"))
    base = F.when(F.col(model).rlike(r"^.+-\d{8}$"), F.regexp_replace(F.col(model), r"-\d{8}$", ""))
    out = df.join(one, F.col(model) == F.col("__exact"), "left").join(two, base == F.col("__base"), "left")
    return out.withColumn("price", F.coalesce("__p1", "__p2")).drop("__exact", "__p1", "__base", "__p2")


def record_usd(calls: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cost of each record from its priced calls (keys, input, cached, output, price)."""
    return calls.groupBy(*keys).agg(F.sum(call_usd(F.col("input"), F.col("cached"), F.col("output"), F.col("price"))).alias("usd"), F.count("*").alias("calls"))


def first_passes(trials: DataFrame, want: int, keys: tuple[str, ...] = ("agent", "model", "effort")) -> DataFrame:
    """Case value: mean of the first `want` scores by start; after 2 * want trials missing ones count 0, before it is pending."""
    w = Window.partitionBy(*keys, "case").orderBy("started_at", "trial")
    scores = trials.withColumn("nth", F.when(F.col("score").isNotNull(), F.sum(F.when(F.col("score").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    got = scores.groupBy(*keys, "case").agg(
        F.count("*").alias("trials"), F.count("score").alias("scored"), F.sum(F.when(F.col("nth") <= want, F.col("score"))).alias("total"), F.bool_and(F.coalesce("reportable", F.lit(False))).alias("reportable")
    )
    forced = F.col("trials") >= 2 * want
    return got.withColumn("value", F.when((F.col("scored") >= want) | forced, F.coalesce("total", F.lit(0.0)) / want)).withColumn("forced", forced & (F.col("scored") < want))


def labelled_lines(cases: DataFrame, core: int = fixed.CORE_CASES, keys: tuple[str, ...] = ("agent", "model", "effort")) -> DataFrame:
    """Lines over case values with a label; the mean is null while a case is pending."""
    agg = cases.groupBy(*keys).agg(F.count("*").alias("cases"), F.count("value").alias("done"), F.avg("value").alias("mean"), F.bool_and("reportable").alias("reportable"))
    whole = F.col("done") == F.col("cases")
    label = F.when(~F.col("reportable"), "NOT REPORTABLE").when(~whole, "INCOMPLETE").when(F.col("cases") < core, "SUBSET").otherwise("CORE")
    return agg.withColumn("mean", F.when(whole, F.col("mean"))).withColumn("label", label)


def resume_split(wanted: DataFrame, previous: DataFrame) -> dict[str, DataFrame]:
    """What a resumed run keeps, scores again, runs and carries over. previous: case, final, rescore (booleans)."""
    final, again = previous.where("final"), previous.where("rescore and not final")
    kept = final.join(wanted, "case", "left_semi")
    rescore = again.join(wanted, "case", "left_semi")
    return {
        "kept": kept,
        "rescore": rescore,
        "todo": wanted.join(kept.select("case").union(rescore.select("case")), "case", "left_anti"),
        "others": previous.join(wanted, "case", "left_anti"),
    }


def upsert(previous: DataFrame, new: DataFrame, key: str = "case") -> DataFrame:
    """Rows of new, and those of previous whose key new doesn't have."""
    return previous.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def top_pending(cases: DataFrame, n: int = 20, keys: tuple[str, ...] = ("model", "effort")) -> DataFrame:
    """The first n pending cases of each line, and how many more there are."""
    w = Window.partitionBy(*keys)
    rows = cases.where(~F.col("resolved")).withColumn("place", F.row_number().over(w.orderBy("task", "case_id"))).withColumn("total", F.count("*").over(w))
    return rows.where(F.col("place") <= n).withColumn("more", F.greatest(F.col("total") - n, F.lit(0))).drop("total")


def distinct_settings(records: DataFrame, columns: list[str], keys: tuple[str, ...] = ("model", "effort")) -> DataFrame:
    """Sorted distinct values of each column, and whether it is ever null."""
    out = []
    for c in columns:
        out += [F.array_sort(F.collect_set(c)).alias(f"{c}_values"), F.bool_or(F.col(c).isNull()).alias(f"{c}_missing")]
    return records.groupBy(*keys).agg(*out)


def failure_streaks(log: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Runs of failures in a row: key, island, first and last place, length."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumn("place", F.row_number().over(w)).withColumn("failed", failed)
    rows = rows.withColumn("island", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("failed").groupBy(key, "island").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("length"))


def answer_check(stored: DataFrame, found: DataFrame) -> DataFrame:
    """verified, mismatch, missing (no answer on disk) or unverified (no digest stored) for each stored key."""
    rows = stored.withColumnRenamed("digest", "__stored").join(found.withColumnRenamed("digest", "__found"), "key", "left")
    state = F.when(F.col("__found").isNull(), "missing").when(F.col("__stored").isNull(), "unverified").when(F.col("__stored") == F.col("__found"), "verified").otherwise("mismatch")
    return rows.select("key", state.alias("state"))
