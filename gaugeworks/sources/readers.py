"""Readers of run documents, manifests, placements, tasks, prices, trials; and the sinks that go with them.

Documents whose shape varies (a list or an object, a key that is absent or null) are read as variants and projected after.
"""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import fixed


def documents(spark: SparkSession, paths: str | list[str], name: str = "*.json") -> DataFrame:
    """path and document (variant) of whole JSON files; files that don't parse are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(paths)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("document")).where("document is not null")


def field(document: str | Column, path: str, kind: str) -> Column:
    return F.try_variant_get(document, path, kind)


def exploded(df: DataFrame, document: str, *paths: str) -> DataFrame:
    """A row for each item of the first of these arrays that is there: columns of df, pos and item (variant)."""
    arrays = [F.try_variant_get(F.col(document), p, "array<variant>") for p in paths]
    return df.select("*", F.posexplode(F.coalesce(*arrays)).alias("pos", "item"))


def run_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each record of run documents. Model, effort, version, rounds and token_budget fall back on the header where
    the record's are missing, empty or 0; rep only where the record has no such key (an explicit null stays)."""
    rows = exploded(documents(spark, paths), "document", "$.cases")
    text = lambda k: F.coalesce(F.nullif(field("item", f"$.{k}", "string"), F.lit("")), F.nullif(field("document", f"$.{k}", "string"), F.lit("")))
    number = lambda k: F.coalesce(F.nullif(field("item", f"$.{k}", "bigint"), F.lit(0)), F.nullif(field("document", f"$.{k}", "bigint"), F.lit(0)))
    has = lambda k: F.array_contains(F.json_object_keys(F.to_json("item")), k)
    item = lambda k, kind: field("item", f"$.{k}", kind)
    return rows.select(
        "path",
        item("case", "string").alias("case"),
        F.coalesce(item("case_id", "string"), F.element_at(F.split(item("case", "string"), "/"), -1)).alias("case_id"),
        text("model").alias("model"),
        text("effort").alias("effort"),
        F.coalesce(text("harness_version"), F.lit(fixed.UNSTAMPED_VERSION)).alias("version"),
        number("rounds").alias("rounds"),
        number("token_budget").alias("token_budget"),
        F.when(has("rep"), item("rep", "bigint")).otherwise(field("document", "$.rep", "bigint")).alias("rep"),
        item("error", "string").alias("error"),
        item("skipped", "string").alias("skipped"),
        item("pending_score", "boolean").alias("pending_score"),
        item("unscored", "boolean").alias("unscored"),
        item("seconds", "double").alias("seconds"),
        item("score.score", "double").alias("score"),
        item("score.status", "string").alias("status"),
        item("score.correspondence_mode", "string").alias("correspondence_mode"),
        item("score.error", "string").alias("score_error"),
        (has("score") & F.coalesce(F.schema_of_variant(F.try_variant_get("item", "$.score", "variant")) != "VOID", F.lit(False))).alias("has_score"),
        F.try_variant_get("item", "$.tokens.per_call", "array<struct<input:bigint,cached:bigint,output:bigint>>").alias("per_call"),
        item("step", "string").alias("step"),
        has("error").alias("error_key"),
        has("skipped").alias("skipped_key"),
        "item",
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; lines that don't parse are skipped."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """Lines sorted by these columns, null as an empty string."""
    df.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]).write.mode("overwrite").json(path)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), digest and size of every file below root; nothing is filtered out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace("path", F.lit(rf"^.*\Q{base}\E/"), F.lit(""))
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("digest"), "length")


def discovered_cases(spark: SparkSession, root: str) -> DataFrame:
    """case (directory) of every case.json; only if there is none, of every gt/gt.step."""
    new = listing(spark, root).where(F.col("path").rlike(r"(^|/)case\.json$")).select(F.regexp_replace("path", r"/?case\.json$", "").alias("case"))
    old = listing(spark, root).where(F.col("path").rlike(r"(^|/)gt/gt\.step$")).select(F.regexp_replace("path", r"/?gt/gt\.step$", "").alias("case"))
    return (old if new.isEmpty() else new).distinct()


def checksum_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path and digest of lines '<hex>  <path>'."""
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(1)).alias("path"), F.get(parts, F.lit(0)).alias("digest"))


def snapshot_manifest(spark: SparkSession, path: str, order: int) -> DataFrame:
    """source_order, path, digest of a document with a map of files."""
    files = field("document", "$.files", "map<string,string>")
    return documents(spark, path).select(F.lit(order).alias("source_order"), F.explode(files).alias("path", "digest"))


def bom(spark: SparkSession, paths: str | list[str], name: str = "bom.json") -> DataFrame:
    """case file, pos, part_id, quantity (1 if absent), source, file."""
    rows = exploded(documents(spark, paths, name), "document", "$.items")
    return rows.select("path", "pos", field("item", "$.part_id", "string").alias("part_id"), F.coalesce(field("item", "$.quantity", "int"), F.lit(1)).alias("quantity"), field("item", "$.source", "string").alias("source"), field("item", "$.file", "string").alias("file"))


def instances(spark: SparkSession, paths: str | list[str], name: str = "instances.json") -> DataFrame:
    """path, pos, instance_id, part_id, transform (16 numbers): a list or {"instances": list}; T or transform; 4x4, 3x4 or flat."""
    rows = exploded(documents(spark, paths, name), "document", "$.instances", "$")
    nested = F.coalesce(*[F.try_variant_get("item", f"$.{k}", "array<array<double>>") for k in ("T", "transform")])
    flat = F.coalesce(F.flatten(nested), *[F.try_variant_get("item", f"$.{k}", "array<double>") for k in ("T", "transform")])
    full = F.when(F.size(flat) == 12, F.concat(flat, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))).otherwise(flat)
    return rows.select("path", "pos", field("item", "$.instance_id", "string").alias("instance_id"), field("item", "$.part_id", "string").alias("part_id"), full.alias("transform"))


def part_files(parts: DataFrame, files: DataFrame) -> DataFrame:
    """parts (case, part_id) with the file that holds them: gt/parts first, then input/step_files; null if neither."""
    at = lambda folder, n: files.select("case", F.regexp_extract("path", rf"^{folder}/(.+)\.step$", 1).alias("part_id"), F.col("path").alias(n)).where("part_id <> ''")
    return parts.join(at("gt/parts", "__a"), ["case", "part_id"], "left").join(at("input/step_files", "__b"), ["case", "part_id"], "left").withColumn("file", F.coalesce("__a", "__b")).drop("__a", "__b")


def tasks(spark: SparkSession, paths: str | list[str], name: str = "task.toml") -> DataFrame:
    """path, key, value of every declared setting of TOML files, nested keys joined by dots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(paths).select("path", "content")

    def parse(batches):
        def walk(prefix, value):
            if isinstance(value, dict):
                for k, v in value.items():
                    yield from walk(f"{prefix}.{k}" if prefix else k, v)
            else:
                yield prefix, str(value)

        for pdf in batches:
            rows = [(r.path, k, v) for r in pdf.itertuples() for k, v in walk("", tomllib.loads(bytes(r.content).decode()))]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return files.mapInPandas(parse, "path string, key string, value string")


def prices(spark: SparkSession, path: str) -> DataFrame:
    """model, rates and long-context rates; keys that begin with _ are notes."""
    kind = "map<string,struct<input:double,cached:double,output:double,long_context:struct<over_input_tokens:double,input:double,cached:double,output:double>>>"
    table = documents(spark, path).select(F.explode(F.try_variant_get("document", "$", "map<string,variant>")).alias("model", "v")).where(~F.col("model").startswith("_"))
    p = F.try_variant_get("v", "$", kind.split("<string,", 1)[1][:-1])
    return table.select("model", p["input"].alias("input"), p["cached"].alias("cached"), p["output"].alias("output"), p["long_context"]["over_input_tokens"].alias("long_over"), *[p["long_context"][k].alias(f"long_{k}") for k in ("input", "cached", "output")])


def tool_calls(spark: SparkSession, paths: str | list[str], name: str = "trajectory.json") -> DataFrame:
    """path and the number of tool calls in a trajectory and all nested ones, at any depth."""
    documents(spark, paths, name).createOrReplaceTempView("__trajectories")
    return spark.sql("""
      WITH RECURSIVE t(path, doc) AS (
        SELECT path, document FROM __trajectories
        UNION ALL
        SELECT t.path, s FROM t, LATERAL explode(try_variant_get(t.doc, '$.subagent_trajectories', 'array<variant>')) AS x(s))
      SELECT path, coalesce(sum(aggregate(try_variant_get(doc, '$.steps', 'array<variant>'), 0L,
        (n, s) -> n + coalesce(size(try_variant_get(s, '$.tool_calls', 'array<variant>')), 0))), 0) AS tool_calls FROM t GROUP BY path""")


def trials(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each trial from a table for each kind of file (all with `trial`); a trial without a result is pending."""
    out = parts["listing"]
    for name in ("result", "reward", "detail", "artifacts", "usage", "requests", "trajectory"):
        if name in parts:
            out = out.join(parts[name], "trial", "left")
    return out


def write_results(new: DataFrame, previous: DataFrame | None, path: str, key: str = "case") -> None:
    """Results in component order of their case path; rows of a previous file stay where the new ones lack the key."""
    from gaugeworks.operators.records import upsert

    rows = new if previous is None else upsert(previous, new, key)
    rows.orderBy(F.split(F.col(key), "/")).write.mode("overwrite").json(path)


def shard(df: DataFrame, order: str, k: int, n: int) -> DataFrame:
    """Rows k, k + n, ... of the sorted table: places within ranges plus counts of the ranges before."""
    from pyspark.sql import Window

    rows = df.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    before = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return rows.withColumn("__place", place).join(F.broadcast(before), "__part").where((F.col("__place") + F.col("__before")) % n == k).select(*df.columns)
