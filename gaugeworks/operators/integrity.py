"""Manifests, digests, policy rules, placement and submission checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalar import rigid_reason


def manifest_diff(listed: DataFrame, found: DataFrame) -> DataFrame:
    """path and state (same, missing, unlisted, changed) of two tables (path, digest)."""
    both = listed.select("path", F.col("digest").alias("a")).join(found.select("path", F.col("digest").alias("b")), "path", "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return both.select("path", state.alias("state"))


def merged_snapshots(snapshots: DataFrame) -> DataFrame:
    """One digest for each path of several manifests (source_order, path, digest): the first wins; conflict tells of others."""
    return snapshots.groupBy("path").agg(F.min_by("digest", "source_order").alias("digest"), (F.min("digest") != F.max("digest")).alias("conflict"))


def under_prefix(paths: DataFrame, prefixes: DataFrame, depth: int) -> DataFrame:
    """Paths below each directory of `depth` parts: an equi join on the leading parts instead of a range join."""
    head = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    return paths.withColumn("prefix", head).join(prefixes.select("prefix"), "prefix")


def rule(df: DataFrame, name: str, level: str, key: str, failed: Column, message: Column) -> DataFrame:
    """Rows (key, level, rule, message) of a rule that failed."""
    return df.where(failed).select(F.col(key).cast("string").alias("key"), F.lit(level).alias("level"), F.lit(name).alias("rule"), message.alias("message"))


def all_rules(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def report(found: DataFrame) -> DataFrame:
    """Errors and warnings of each key, in order."""
    pick = lambda level: F.array_sort(F.collect_list(F.when(F.col("level") == level, F.concat_ws(": ", "rule", "message"))))
    return found.groupBy("key").agg(pick("error").alias("errors"), pick("warning").alias("warnings"))


def policy_violations(files: DataFrame, policy: DataFrame) -> DataFrame:
    """files (case, task, path), policy (task, required array, allowed array of patterns): missing required and not allowed files."""
    present = files.groupBy("case", "task").agg(F.collect_set("path").alias("paths"))
    rules = present.join(policy, "task")
    missing = rules.select("case", F.lit("required file missing").alias("rule"), F.explode(F.array_except("required", "paths")).alias("path"))
    extra = rules.select("case", F.lit("file not allowed").alias("rule"), F.explode(F.filter("paths", lambda p: ~F.exists("allowed", lambda a: F.regexp_like(p, F.concat(F.lit("^("), a, F.lit(")$")))))).alias("path"))
    return missing.unionByName(extra)


def doubled_layer(lines: DataFrame, key: str, least: int = 8, share: float = 0.9) -> DataFrame:
    """Whether a text's lines (key, line) nearly all occur at least twice."""
    per_line = lines.where(F.trim("line") != "").groupBy(key, "line").agg(F.count("*").alias("n"))
    agg = per_line.groupBy(key).agg(F.sum("n").alias("lines"), F.count("*").alias("different"), F.count_if(F.col("n") >= 2).alias("twice"))
    return agg.withColumn("doubled", (F.col("lines") >= least) & (F.col("twice") >= share * F.col("different")))


def symbol_count(text: Column, symbol: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))) / len(symbol)).cast("long")


def canonical_ids(instances: DataFrame, group: str, owner: str, given: str, order: list[str]) -> DataFrame:
    """Instance ids: a well-formed, unused '<owner>_i<k>' stays, others become '<owner>_i<place>'.

    place counts the owner's rows in order. A given id is used if an earlier row has it."""
    w = Window.partitionBy(group, owner).orderBy(*order)
    rows = instances.withColumn("place", F.row_number().over(w))
    same = Window.partitionBy(group, given).orderBy(*order)
    rows = rows.withColumn("earlier", F.row_number().over(same) - 1)
    good = F.col(given).isNotNull() & F.regexp_like(F.col(given), F.concat(F.lit("^"), F.col(owner).cast("string"), F.lit("_i[0-9]+$"))) & (F.col("earlier") == 0)
    return rows.withColumn("instance_id", F.when(good, F.col(given)).otherwise(F.concat(F.col(owner).cast("string"), F.lit("_i"), F.col("place")))).drop("earlier")


def transform_failures(instances: DataFrame, key: str, matrix: str) -> DataFrame:
    """Instances whose 16-number transform isn't rigid, with the reason."""
    reason = F.when(F.size(matrix) != 16, "not 4x4").otherwise(rigid_reason([F.get(F.col(matrix), F.lit(i)) for i in range(16)]))
    return instances.select(F.col(key), reason.alias("reason")).where("reason is not null")


def identity_difference(left: DataFrame, right: DataFrame, key: str, numbers: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Largest relative difference of numbers of equal keys, and whether both are the same."""
    both = left.join(right.select(F.col(key), *[F.col(n).alias(f"__{n}") for n in numbers]), key)
    gaps = [F.abs(F.col(n) - F.col(f"__{n}")) / F.greatest(F.abs(F.col(n)), F.abs(F.col(f"__{n}")), F.lit(1e-12)) for n in numbers]
    worst = gaps[0] if len(gaps) == 1 else F.greatest(*gaps)
    return both.select(key, worst.alias("difference"), (worst <= tolerance).alias("same"))


def bag_within(left: DataFrame, right: DataFrame, group: str, value: str, tolerance: float = 1e-4) -> DataFrame:
    """Whether two bags of numbers of each group agree, i-th smallest with i-th smallest, within tolerance * max(1, expected)."""
    w = Window.partitionBy(group).orderBy(value)
    a = left.select(group, value).withColumn("i", F.row_number().over(w))
    b = right.select(group, F.col(value).alias("__b")).withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy("__b")))
    both = a.join(b, [group, "i"], "full_outer")
    ok = F.coalesce(F.abs(F.col(value) - F.col("__b")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(value))), F.lit(False))
    return both.groupBy(group).agg(F.count(value).alias("n"), F.count("__b").alias("m"), F.bool_and(ok).alias("equal"))


def multiset_f1(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """F1 of two multisets of each group: both empty 1, one empty 0."""
    a, b = (df.groupBy(group, item).agg(F.count("*").alias(n)) for df, n in ((left, "a"), (right, "b")))
    both = a.join(b, [group, item], "full_outer").na.fill(0, ["a", "b"])
    agg = both.groupBy(group).agg(F.sum(F.least("a", "b")).alias("hit"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    return agg.withColumn("f1", F.when(F.col("n") + F.col("m") == 0, 1.0).otherwise(2 * F.col("hit") / (F.col("n") + F.col("m"))))


def identity_leaks(spark_rows: DataFrame, key: str, json_column: str, forbidden_keys: list[str], forbidden_text: str) -> DataFrame:
    """Forbidden keys and texts anywhere in a JSON document, with their paths.

    Trees are walked level by level with a recursive query over variants: every node (object entry or array item) is a
    row, so a deep or wide document is not held by one call. LIMIT ALL: recursion isn't held to Spark's million rows."""
    spark = spark_rows.sparkSession
    spark_rows.select(F.col(key).cast("string").alias("k"), F.try_parse_json(F.col(json_column)).alias("v")).createOrReplaceTempView("__json_roots")
    keys = ", ".join(f"'{k}'" for k in forbidden_keys)
    pattern = forbidden_text.replace("\\", "\\\\").replace("'", "\\'")
    return spark.sql(f"""
      WITH RECURSIVE nodes(k, path, name, v, depth) AS (
        SELECT k, '$', CAST(NULL AS STRING), v, 0 FROM __json_roots WHERE v IS NOT NULL
        UNION ALL
        SELECT n.k, concat(n.path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END), e.key, e.value, n.depth + 1
        FROM nodes n, LATERAL variant_explode(n.v) e WHERE n.depth < 60)
      SELECT k AS key, path, CASE WHEN name IN ({keys}) THEN 'key' ELSE 'text' END AS kind FROM (SELECT * FROM nodes LIMIT ALL)
      WHERE name IN ({keys}) OR (schema_of_variant(v) = 'STRING' AND regexp_like(CAST(v AS STRING), '{pattern}'))
    """)
