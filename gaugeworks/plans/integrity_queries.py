"""Manifests, digests, policy and text rules, placements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalar as S
from gaugeworks.operators import integrity as I
from gaugeworks.operators import records as R
from gaugeworks.plans.adapters import table

c = F.col
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def digest(col):
    return F.sha2(F.encode(col, "utf-8"), 256)


def manifests(spark, d):
    """What a manifest lists, and what is found: without one source, with one language altered and one more file."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", c("doc_id").cast("string")).alias("path"), "text", "lang", "source")
    listed = docs.where("source <> 'src3'").select("path", digest(c("text")).alias("digest"))
    text = F.when(c("lang") == "de", F.concat("text", F.lit("!"))).otherwise(c("text"))
    found = docs.where("source <> 'src5'").select("path", digest(text).alias("digest"))
    return listed, found


MANIFESTS = """docs AS (SELECT concat_ws('/', lang, source, doc_id) AS path, text, lang, source FROM documents),
listed AS (SELECT path, sha256(text) AS digest FROM docs WHERE source <> 'src3'),
found AS (SELECT path, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS digest FROM docs WHERE source <> 'src5')"""


@query(f"""WITH {MANIFESTS} SELECT path, CASE WHEN f.digest IS NULL THEN 'missing' WHEN l.digest IS NULL THEN 'unlisted' WHEN l.digest <> f.digest THEN 'changed' ELSE 'same' END AS state FROM listed l FULL JOIN found f USING (path)""")
def manifest_diff(spark, d):
    return I.manifest_diff(*manifests(spark, d))


@query("""SELECT source, sha256(string_agg(path || chr(0) || h || chr(0), '' ORDER BY path)) AS tree, count(*) AS files
FROM (SELECT source, lpad(doc_id::VARCHAR, 10, '0') AS path, sha256(text) AS h FROM documents) GROUP BY source""")
def tree_digest(spark, d):
    rows = table(spark, d, "documents").select("source", F.struct(F.lpad(c("doc_id").cast("string"), 10, "0").alias("path"), digest(c("text")).alias("digest")).alias("e"))
    return rows.groupBy("source").agg(F.collect_list("e").alias("e"), F.count("*").alias("files")).select("source", S.tree_digest(c("e")).alias("tree"), "files")


@query(f"""WITH {MANIFESTS}, s AS (SELECT path, CASE WHEN path LIKE 'fr/%' THEN NULL ELSE digest END AS digest FROM listed)
SELECT s.path AS key, CASE WHEN f.digest IS NULL THEN 'missing' WHEN s.digest IS NULL THEN 'unverified' WHEN s.digest = f.digest THEN 'verified' ELSE 'mismatch' END AS state FROM s LEFT JOIN found f USING (path)""")
def artifact_check(spark, d):
    listed, found = manifests(spark, d)
    stored = listed.select(c("path").alias("key"), F.when(~c("path").startswith("fr/"), c("digest")).alias("digest"))
    return R.answer_check(stored, found.withColumnRenamed("path", "key"))


@query(f"""WITH {MANIFESTS}, u AS (SELECT 1 AS o, * FROM listed UNION ALL SELECT 2, * FROM found)
SELECT path, arg_min(digest, o) AS digest, min(digest) <> max(digest) AS conflict FROM u GROUP BY path""")
def snapshot_conflicts(spark, d):
    listed, found = manifests(spark, d)
    return I.merged_snapshots(listed.withColumn("source_order", F.lit(1)).unionByName(found.withColumn("source_order", F.lit(2))))


@query("""SELECT p.page_id, p.url, q.prefix FROM pages p JOIN (SELECT DISTINCT array_to_string(string_split(url, '/')[1:3], '/') AS prefix FROM pages WHERE url LIKE 'https:%') q
ON array_to_string(string_split(p.url, '/')[1:3], '/') = q.prefix""")
def prefix_range(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    prefixes = pages.where(c("url").startswith("https:")).select(F.array_join(F.slice(F.split("url", "/"), 1, 3), "/").alias("prefix")).distinct()
    return I.under_prefix(pages.withColumnRenamed("url", "path"), prefixes, 3).select("page_id", c("path").alias("url"), "prefix")


MAIL, PHONE = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}", r"\+?[0-9][0-9 ()-]{8,}[0-9]"


@query(rf"""WITH f AS (SELECT 'document' AS kind, doc_id::VARCHAR AS key, regexp_matches(text, '{MAIL}') AS mail, regexp_matches(text, '{PHONE}') AS phone FROM documents
UNION ALL SELECT 'page', page_id::VARCHAR, regexp_matches(html, '{MAIL}'), regexp_matches(html, '{PHONE}') FROM pages)
SELECT kind, key, 'mail' AS rule FROM f WHERE mail UNION ALL SELECT kind, key, 'phone' FROM f WHERE phone""")
def identity_leaks(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), c("doc_id").cast("string").alias("key"), "text")
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), c("page_id").cast("string").alias("key"), c("html").alias("text"))
    rules = F.filter(F.array(F.when(c("text").rlike(MAIL), "mail"), F.when(c("text").rlike(PHONE), "phone")), lambda r: r.isNotNull())
    return docs.unionByName(pages).select("kind", "key", F.explode(rules).alias("rule"))


@query("""SELECT doc_id, regexp_matches(text, '[\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}]') AS cjk, (length(text) - length(replace(text, '!', '')))::BIGINT AS marks,
((length(text) - length(replace(text, 'é', ''))))::BIGINT AS accents, ((length(text) - length(replace(text, '***', ''))) // 3)::BIGINT AS stars FROM documents""")
def cjk_and_symbols(spark, d):
    t = c("text")
    return table(spark, d, "documents").select(
        "doc_id", t.rlike(r"[一-鿿　-〿＀-￯]").alias("cjk"), I.symbol_count(t, "!").alias("marks"), I.symbol_count(t, "é").alias("accents"), I.symbol_count(t, "***").alias("stars")
    )


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT doc_id, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS lines, count(*) AS different, count(*) FILTER (n >= 2) AS twice, sum(n) >= 8 AND count(*) FILTER (n >= 2) >= 0.9 * count(*) AS doubled FROM g GROUP BY 1""")
def doubled_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return I.doubled_layer(lines, "doc_id")


@query(r"""SELECT conv_id, turn, length(text) - length(replace(text, '.', '')) AS stops, regexp_extract_all(text, '([A-Za-z]+)\.', 1)[-1] AS last_word FROM conversations""")
def fence_blocks(spark, d):
    last = F.try_element_at(F.regexp_extract_all("text", F.lit(r"([A-Za-z]+)\."), F.lit(1)), F.lit(-1))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("long").alias("stops"), last.alias("last_word"))


@query("""SELECT l_orderkey % 1000 AS product, p_type, count(*) AS placed, sum(l_quantity)::BIGINT AS asked, sum(l_quantity) = count(*) AS consistent, count(*) FILTER (p_partkey IS NULL) AS unknown
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def bom_quantities(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"), "left")
    return rows.groupBy((c("l_orderkey") % 1000).alias("product"), "p_type").agg(
        F.count("*").alias("placed"), F.sum("l_quantity").cast("long").alias("asked"), (F.sum("l_quantity") == F.count("*")).alias("consistent"), F.count_if(c("p_partkey").isNull()).alias("unknown")
    )


@query("""WITH a AS (SELECT l_returnflag AS g, l_partkey AS i, count(*) AS a FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_returnflag AS g, l_partkey AS i, count(*) AS b FROM lineitem WHERE l_linestatus <> 'F' GROUP BY ALL),
j AS (SELECT g, i, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (g, i))
SELECT g AS l_returnflag, sum(least(a, b))::BIGINT AS hit, sum(a)::BIGINT AS n, sum(b)::BIGINT AS m, round(2.0 * sum(least(a, b)) / (sum(a) + sum(b)), 6) AS f1 FROM j GROUP BY 1""")
def multiset_f1(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_linestatus")
    return I.multiset_f1(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus <> 'F'"), "l_returnflag", "l_partkey").withColumn("f1", F.round("f1", 6))


@query("""WITH a AS (SELECT l_suppkey AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i FROM lineitem WHERE l_linestatus = 'F'),
b AS (SELECT l_suppkey AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i FROM lineitem WHERE l_linestatus <> 'F')
SELECT coalesce(a.g, b.g) AS l_suppkey, count(a.v) AS n, count(b.v) AS m, bool_and(coalesce(abs(a.v - b.v) <= 0.5 * greatest(1, abs(a.v)), false)) AS equal FROM a FULL JOIN b ON a.g = b.g AND a.i = b.i GROUP BY 1""")
def bag_tolerance(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_linestatus")
    return I.bag_within(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus <> 'F'"), "l_suppkey", "l_extendedprice", 0.5)


@query("""WITH l AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey || '_i' || l_linenumber ELSE 'bad name' END AS given FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS place, row_number() OVER (PARTITION BY l_orderkey, given ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS nth FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN regexp_matches(given, '^' || l_suppkey || '_i[0-9]+$') AND nth = 1 THEN given ELSE l_suppkey || '_i' || place END AS instance_id FROM r""")
def canonical_instance_id(spark, d):
    given = F.when(c("l_linenumber") % 2 == 0, F.concat(c("l_suppkey"), F.lit("_i"), c("l_linenumber"))).otherwise("bad name")
    rows = table(spark, d, "lineitem").withColumn("given", given)
    out = I.canonical_ids(rows, "l_orderkey", "l_suppkey", "given", ["l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "instance_id")


@query("""WITH m AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN [0.0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1] WHEN vec_id % 3 = 1 THEN [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1]
ELSE [embedding[1]::DOUBLE, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1] END AS t FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN 'not a rotation' ELSE 'not orthonormal' END AS reason FROM m WHERE vec_id % 3 = 1 OR (vec_id % 3 = 2 AND abs(t[1] * t[1] - 1) > 1e-6)""")
def rigid_check(spark, d):
    e = table(spark, d, "embeddings")
    row = lambda *x: F.array(*[v if hasattr(v, "cast") else F.lit(float(v)) for v in x])
    m = (
        F.when(c("vec_id") % 3 == 0, row(0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1))
        .when(c("vec_id") % 3 == 1, row(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1))
        .otherwise(row(F.get("embedding", F.lit(0)).cast("double"), 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1))
    )
    return I.transform_failures(e.select("vec_id", m.alias("m")), "vec_id", "m")


@query("""WITH a AS (SELECT p_partkey, p_retailprice AS v, p_size::DOUBLE AS s FROM part), b AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 1.001 ELSE p_retailprice END AS v, p_size::DOUBLE AS s FROM part)
SELECT a.p_partkey, abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-12) <= 1e-6 AND a.s = b.s AS same FROM a JOIN b USING (p_partkey)""")
def supplied_identity(spark, d):
    part = table(spark, d, "part").select("p_partkey", c("p_retailprice").alias("v"), c("p_size").cast("double").alias("s"))
    other = part.withColumn("v", F.when(c("s") > 25, c("v") * 1.001).otherwise(c("v")))
    return I.identity_difference(part, other, "p_partkey", ["v", "s"]).select("p_partkey", "same")


@query("""WITH f AS (SELECT o_custkey AS "case", o_orderpriority AS path FROM orders), p AS (SELECT "case", list(DISTINCT path) AS paths FROM f GROUP BY 1)
SELECT "case", 'required file missing' AS rule, unnest(list_filter(['1-URGENT', '5-LOW'], lambda x: NOT list_contains(paths, x))) AS path FROM p
UNION ALL SELECT DISTINCT "case", 'file not allowed', path FROM f WHERE NOT regexp_full_match(path, '[1-3]-.*') AND NOT regexp_full_match(path, '5-LOW')""")
def input_policy(spark, d):
    files = table(spark, d, "orders").select(c("o_custkey").alias("case"), F.lit("T1").alias("task"), c("o_orderpriority").alias("path"))
    policy = spark.createDataFrame([("T1", ["1-URGENT", "5-LOW"], ["[1-3]-.*", "5-LOW"])], "task string, required array<string>, allowed array<string>")
    return I.policy_violations(files, policy)


@query("""SELECT doc_id AS key, list_contains(['src1', 'src2'], source) AS has_source, CASE WHEN n_chars < 200 THEN 'short' END AS warning FROM documents WHERE n_chars < 200 OR list_contains(['src1', 'src2'], source)""")
def case_rules(spark, d):
    docs = table(spark, d, "documents")
    found = I.all_rules(I.rule(docs, "source", "error", "doc_id", c("source").isin("src1", "src2"), c("source")), I.rule(docs, "length", "warning", "doc_id", c("n_chars") < 200, c("n_chars").cast("string")))
    rep = I.report(found)
    return rep.select(c("key").cast("long").alias("key"), (F.size("errors") > 0).alias("has_source"), F.when(F.size("warnings") > 0, "short").alias("warning"))


@query("""SELECT doc_id, ('0x' || substr(sha256(concat_ws('/', source, doc_id)), 1, 8))::BIGINT AS seed, list_aggregate(string_split(source, '/')[-3:], 'string_agg', '_') || '_' || substr(sha1(source), 1, 8) AS key FROM documents""")
def seeds_and_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", S.seed_of(c("source"), c("doc_id").cast("string")).alias("seed"), S.case_key(c("source")).alias("key"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 50) * 60.0 + 3 WHEN 1 THEN 0.25 WHEN 2 THEN (o_orderkey % 90)::DOUBLE ELSE NULL END AS seconds FROM orders""")
def durations(spark, d):
    k = c("o_orderkey")
    text = F.when(k % 4 == 0, F.concat((k % 50).cast("string"), F.lit("m3s"))).when(k % 4 == 1, F.lit("250ms")).when(k % 4 == 2, (k % 90).cast("string")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", S.duration_seconds(text).alias("seconds"))


@query("""SELECT p_partkey, round(p_retailprice / pow(10, floor(log10(p_retailprice)) - 3), 0) * pow(10, floor(log10(p_retailprice)) - 3) AS four, round_even(p_retailprice / 16, 0)::BIGINT AS cell,
greatest(0.0, 1 - abs(log10(p_size / 10.0))) AS decades, greatest(0.0, 1 - abs(p_size - 10.0) / 10) AS relative, least(1.0, greatest(0.0, (p_size / 50.0 - 0.5) / 0.5)) AS gain FROM part WHERE p_size > 0""")
def scalar_scores(spark, d):
    p, s = c("p_retailprice"), c("p_size").cast("double")
    return table(spark, d, "part").where("p_size > 0").select(
        "p_partkey", S.significant(p, 4).alias("four"), S.lattice(p, 16).alias("cell"), S.decade_similarity(s, F.lit(10.0)).alias("decades"), S.relative_score(s, F.lit(10.0)).alias("relative"), S.gain_over(s / 50, F.lit(0.5)).alias("gain")
    ).withColumns({n: F.round(n, 6) for n in ("four", "decades", "relative", "gain")})


ORACLES["scalar_scores"] = ORACLES["scalar_scores"].replace("AS four", "AS four_").replace("SELECT p_partkey,", "SELECT p_partkey, round(four_, 6) AS four, cell, round(decades_, 6) AS decades, round(relative_, 6) AS relative, round(gain_, 6) AS gain FROM (SELECT p_partkey,").replace("AS decades,", "AS decades_,", 2).replace("AS decades_, round(relative_", "AS decades, round(relative_").replace("AS relative, least", "AS relative_, least").replace("AS gain FROM part WHERE p_size > 0", "AS gain_ FROM part WHERE p_size > 0)")


@query(None)
def trajectory_leaks(spark, d):
    """Nested documents made of conversations; forbidden keys and texts with their paths."""
    turns = table(spark, d, "conversations")
    docs = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("steps"))).alias("doc"))
    return I.identity_leaks(docs, "conv_id", "doc", ["role"], "[?]")
