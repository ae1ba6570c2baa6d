"""Checks of cases, submissions and task declarations: one query for each rule, their rows united.

Rules of cases give (key, level, rule, message) as `integrity.rule` does; those of submissions (submission, code, scope, id).
Tables that a check isn't given leave its rules out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import fixed
from gaugeworks.functions.scalar import rigid_reason
from gaugeworks.operators.integrity import doubled_layer, rule, symbol_count

c = F.col
#: Fixed values of cases: kinds by task, the true file of each kind, forms of ids, symbols with their codes in drawings.
KINDS = {"t1": "part", "t2": "assembly", "t3": "part", "t4": "assembly", "t5": "assembly", "t6": "ecad"}
TRUE_FILES = {"part": "gt/gt.step", "assembly": "gt/gt.step", "ecad": "gt/gt_graph.json"}
PART_ID, INSTANCE_ID = r"^[a-z][a-z0-9_]*$", r"^(.+)_i\d+$"
CJK = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
SYMBOLS = {"plusminus": "±", "degree": "°", "diameter": "Ø", "plusminus_code": "%%p", "degree_code": "%%d", "diameter_code": "%%c"}
CJK_FONTS = r"(?i)simsun|simhei|fangsong|kaiti|hysw|stsong|stfangsong|stkaiti|stxihei|pingfang|notosanscjk|notoserifcjk|sourcehan|msgothic|msmincho|meiryo|yugothic|malgun|microsoftyahei|yahei|dengxian|nsimsun|songti|heiti"
STEP_FILE = r"(?i)\.(step|stp)$"


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def _each(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def task_prefix(env: Column) -> Column:
    """t1 .. t6, null if an environment's name begins otherwise."""
    return F.nullif(F.regexp_extract(env, r"^(t[1-6])(?:_|$)", 1), F.lit(""))


def case_identity(case: DataFrame) -> DataFrame:
    """case(case, id, directory, env, kind): names and kinds that disagree."""
    rows = case.withColumn("__t", task_prefix(c("env")))
    want = _lookup(KINDS, c("__t"))
    return _each(
        rule(rows, "id", "error", "case", ~c("id").eqNullSafe(c("directory")), F.format_string("%s is not its directory's name", "id")),
        rule(rows, "env", "error", "case", c("__t").isNull(), F.format_string("%s is no task", "env")),
        rule(rows, "kind", "error", "case", c("__t").isNotNull() & ~c("kind").eqNullSafe(want), F.format_string("kind %s where the task has %s", "kind", want)),
    )


def case_files(listed: DataFrame, found: DataFrame, case: DataFrame) -> DataFrame:
    """listed(case, section, path, digest) against found(case, section, path, digest, is_link, utf8, text): missing, changed,
    unlisted and linked files, texts that aren't English or UTF-8, an absent true file, and inputs equal to a true file."""
    both = listed.select("case", "section", "path", c("digest").alias("a")).join(found.where("section in ('input', 'gt')").select("case", "section", "path", c("digest").alias("b")), ["case", "section", "path"], "full_outer")
    true = case.select("case", _lookup(TRUE_FILES, c("kind")).alias("path")).where("path is not null")
    leaked = listed.where("section = 'input'").join(listed.where("section = 'gt'").select("case", "digest").distinct(), ["case", "digest"], "left_semi")
    texts = found.where(c("path").rlike(r"\.(json|md|txt)$"))
    steps = found.where(c("path").rlike(STEP_FILE))
    return _each(
        rule(both, "file missing", "error", "case", c("b").isNull(), c("path")),
        rule(both, "file not listed", "error", "case", c("a").isNull(), c("path")),
        rule(both, "hash mismatch", "error", "case", c("a") != c("b"), c("path")),
        rule(found, "symlink", "error", "case", c("is_link"), c("path")),
        rule(texts, "not UTF-8", "error", "case", ~c("utf8"), c("path")),
        rule(texts, "non-English text", "error", "case", c("utf8") & c("text").rlike(CJK), c("path")),
        rule(steps, "CJK in a STEP name", "error", "case", c("text").rlike(CJK), c("path")),
        rule(true.join(found, ["case", "path"], "left_anti"), "true file missing", "error", "case", F.lit(True), c("path")),
        rule(leaked, "input equals a true file", "error", "case", F.lit(True), c("path")),
    )


def case_sheets(case: DataFrame, part: DataFrame, listed: DataFrame) -> DataFrame:
    """Sheets of the part types of t4 cases: both kinds for each type (a warning for synthetic cases), none for another type."""
    t4 = case.where(task_prefix(c("env")) == "t4").select("case", "synthetic")
    kinds = F.explode(F.array(*[F.lit(k) for k in fixed.SHEET_KINDS]))
    want = part.join(t4, "case").select("case", "synthetic", "part_id", kinds.alias("kind"))
    want = want.withColumn("path", F.format_string(f"input/{fixed.SHEET_FOLDER}/%s_%s.png", "part_id", "kind"))
    missing = want.join(listed.select("case", "path"), ["case", "path"], "left_anti")
    pattern = rf"^input/{fixed.SHEET_FOLDER}/([a-z][a-z0-9_]*)_(?:{'|'.join(fixed.SHEET_KINDS)})\.png$"
    sheets = listed.join(t4, "case").where(c("path").rlike(pattern)).withColumn("part_id", F.regexp_extract("path", pattern, 1))
    stale = sheets.join(part.select("case", "part_id"), ["case", "part_id"], "left_anti")
    soft = F.coalesce("synthetic", F.lit(False))
    return _each(
        rule(missing, "sheet missing", "error", "case", ~soft, c("path")),
        rule(missing, "sheet missing", "warning", "case", soft, c("path")),
        rule(stale, "sheet of no part type", "error", "case", F.lit(True), c("path")),
    )


def case_drawings(case: DataFrame, drawing: DataFrame, report: DataFrame) -> DataFrame:
    """drawing(case, path, text, fonts array, meta map): text, fonts and metadata of drawings; those drawn as outlines need a passed
    report(case, status, digest), or for copies of a case (dev, pinned: 64 digits) its pinned digest."""
    rows = drawing.join(case.select("case", "env", "synthetic", "dev", "pinned"), "case").join(report.select("case", "status", "digest"), "case", "left")
    outline = F.trim("text") == ""
    admitted = c("dev") & (F.length("pinned") == 64)
    bare = outline & c("status").isNull() & ~F.coalesce(admitted, F.lit(False))
    soft = F.coalesce("synthetic", F.lit(False))
    named = F.array_intersect(F.map_keys("meta"), F.array(*[F.lit(k) for k in ("author", "creator", "producer", "title", "subject", "keywords")]))
    some = case.where(task_prefix(c("env")).isin("t1", "t2", "t5") & ~F.coalesce("synthetic", F.lit(False))).join(drawing, "case", "left_anti")
    lines = drawing.where(F.trim("text") != "").select(F.struct("case", "path").alias("id"), F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    doubled = doubled_layer(lines, "id").where("doubled").select("id.case", "id.path")
    return _each(
        rule(rows, "CJK font", "error", "case", F.exists("fonts", lambda f: f.rlike(CJK_FONTS)), c("path")),
        rule(rows, "CJK in a drawing", "error", "case", c("text").rlike(CJK), c("path")),
        rule(rows, "CJK in metadata", "error", "case", F.exists(F.map_values("meta"), lambda v: v.rlike(CJK)), c("path")),
        rule(rows, "metadata", "warning", "case", F.size(named) > 0, F.concat_ws(" ", "path", F.array_sort(named))),
        rule(rows, "outline text without a report", "error", "case", bare & ~soft, c("path")),
        rule(rows, "outline text without a report", "warning", "case", bare & soft, c("path")),
        rule(rows, "report not passed", "error", "case", outline & c("status").isNotNull() & (F.lower("status") != "pass"), c("path")),
        rule(report.join(case.select("case", "pinned"), "case"), "report digest", "error", "case", ~c("pinned").eqNullSafe(c("digest")), F.coalesce("digest", F.lit("none"))),
        rule(some, "no drawing", "error", "case", F.lit(True), c("env")),
        rule(doubled, "doubled text", "warning", "case", F.lit(True), c("path")),
    )


def case_symbols(drawing: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(case, path, symbol, n, gain_note): fewer symbols than declared are an error, more need a note. A symbol's glyph and
    its code are counted apart."""
    texts = drawing.where(F.trim("text") != "").select("case", "path", "text")
    counts = F.create_map(*[x for glyph in SYMBOLS.values() for x in (F.lit(glyph), symbol_count(c("text"), glyph))])
    glyph = F.coalesce(_lookup(SYMBOLS, c("symbol")), c("symbol"))
    rows = expected.join(texts, ["case", "path"]).withColumn("__has", F.coalesce(F.element_at(counts, glyph), F.lit(0)))
    what = F.format_string("%s: %s %d, expected %d", "path", "symbol", "__has", c("n").cast("long"))
    return _each(
        rule(rows, "symbols lost", "error", "case", c("__has") < c("n"), what),
        rule(rows, "symbols gained", "error", "case", (c("__has") > c("n")) & (F.coalesce("gain_note", F.lit("")) == ""), what),
        rule(rows, "symbols gained", "warning", "case", (c("__has") > c("n")) & (F.coalesce("gain_note", F.lit("")) != ""), what),
    )


def case_parts_list(case: DataFrame, parts_list: DataFrame, part: DataFrame) -> DataFrame:
    """parts_list(case, mapping, note, items map of item to part, sheet map as read off the drawing, tokens array of the drawing's
    words, null if it has none) of t2 and t5 cases that aren't synthetic."""
    asked = case.where(task_prefix(c("env")).isin("t2", "t5") & ~F.coalesce("synthetic", F.lit(False))).select("case")
    ids = part.groupBy("case").agg(F.array_sort(F.collect_set("part_id")).alias("ids"))
    rows = asked.join(parts_list, "case", "left").join(ids, "case", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    declared, numbered = c("mapping") == "declared", c("mapping") == "item_number"
    values = F.map_values("items")
    twice = F.array_distinct(F.filter(values, lambda v: F.size(F.filter(values, lambda w: w == v)) > 1))
    absent = F.array_except("ids", values)
    wrong = F.map_keys(F.map_filter("items", lambda k, v: F.element_at("sheet", k) != v))
    unread = F.array_except(F.map_keys("items"), F.map_keys("sheet"))

    def forms(pid: Column) -> Column:
        number = F.regexp_replace(pid, r"\D", "")
        bare = F.coalesce(F.nullif(F.regexp_replace(number, "^0+", ""), F.lit("")), F.lit("0"))
        return F.array(pid, F.upper(pid), number, bare, F.concat(F.lit("PART-"), number), F.concat(F.lit("part-"), number))

    unnumbered = F.filter("ids", lambda p: ~F.arrays_overlap(forms(p), "tokens"))
    joined = lambda a: F.concat_ws(" ", F.array_sort(a))
    some = F.size("items") > 0
    return _each(
        rule(rows, "parts list mapping", "error", "case", ~F.coalesce(c("mapping").isin("item_number", "declared", "none"), F.lit(False)), F.coalesce("mapping", F.lit("none given"))),
        rule(rows, "parts list empty", "error", "case", declared & ~F.coalesce(some, F.lit(False)), F.lit("no items")),
        rule(rows, "several items for a part", "error", "case", declared & some & (F.size(twice) > 0), joined(twice)),
        rule(rows, "part without item", "error", "case", declared & some & (F.size(absent) > 0), joined(absent)),
        rule(rows, "sheet disagrees", "error", "case", declared & some & c("sheet").isNotNull() & (F.size(wrong) > 0), joined(wrong)),
        rule(rows, "items unread", "warning", "case", declared & some & c("sheet").isNotNull() & (F.size(unread) > 0), joined(unread)),
        rule(rows, "parts list note", "error", "case", (c("mapping") == "none") & (F.coalesce("note", F.lit("")) == ""), F.lit("no note")),
        rule(rows, "drawing without text", "error", "case", numbered & c("tokens").isNull(), F.lit("no words")),
        rule(rows, "item number missing", "error", "case", numbered & c("tokens").isNotNull() & (F.size(unnumbered) > 0), joined(unnumbered)),
    )


def case_instances(case: DataFrame, part: DataFrame, instance: DataFrame, bom: DataFrame, files: DataFrame) -> DataFrame:
    """instance(case, pos, instance_id, part_id, transform) of assemblies: ids, transforms, part files(case, part_id) and quantities
    of the manifest's parts and the bill of materials."""
    own = instance.join(case.where("kind = 'assembly'").select("case"), "case", "left_semi")
    counts = own.groupBy("case", "part_id").agg(F.count("*").cast("int").alias("n"))
    at = [F.get(c("transform"), F.lit(i)) for i in range(16)]
    reason = F.when(F.coalesce(F.size("transform"), F.lit(0)) != 16, "not 4x4").otherwise(rigid_reason(at))
    ids = own.groupBy("case", "instance_id").agg(F.count("*").alias("n"))

    def quantities(name: str, side: DataFrame, only: DataFrame | None = None) -> DataFrame:
        found = counts if only is None else counts.join(only, "case", "left_semi")
        both = side.join(case.where("kind = 'assembly'").select("case"), "case", "left_semi").groupBy("case", "part_id").agg(F.max("quantity").alias("quantity")).join(found, ["case", "part_id"], "full_outer")
        return rule(both, name, "error", "case", ~c("quantity").eqNullSafe(c("n")), F.format_string("%s: %s listed, %s placed", "part_id", F.coalesce(c("quantity").cast("string"), F.lit("none")), F.coalesce(c("n").cast("string"), F.lit("none"))))

    return _each(
        rule(ids, "instance repeated", "error", "case", c("n") > 1, F.coalesce("instance_id", F.lit("none"))),
        rule(own, "bad part id", "error", "case", ~F.coalesce(c("part_id").rlike(PART_ID), F.lit(False)), F.coalesce("part_id", F.lit("none"))),
        rule(own, "bad instance id", "error", "case", ~(F.regexp_extract(F.coalesce("instance_id", F.lit("")), INSTANCE_ID, 1) == F.coalesce("part_id", F.lit(""))), F.coalesce("instance_id", F.lit("none"))),
        rule(own, "not a rigid transform", "error", "case", reason.isNotNull(), F.concat_ws(": ", "instance_id", reason)),
        rule(own.select("case", "part_id").distinct().join(files.select("case", "part_id"), ["case", "part_id"], "left_anti"), "no part file", "error", "case", F.lit(True), F.coalesce("part_id", F.lit("none"))),
        quantities("quantities", part),
        quantities("bill of materials", bom, bom.select("case").distinct()),
    )


def case_solids(solid: DataFrame) -> DataFrame:
    """solid(case, side, volume, area) of the true assembly (`gt`) and of parts times instances (`parts`): equal in number, and the
    i-th by volume, then area, equal to 1e-4."""
    side = lambda s: solid.where(c("side") == s).select("case", F.struct(F.round("volume", 3).alias("volume"), F.round("area", 3).alias("area")).alias("x"))
    w = Window.partitionBy("case").orderBy("x")
    a, b = (side(s).withColumn("i", F.row_number().over(w)).withColumnRenamed("x", n) for s, n in (("gt", "g"), ("parts", "p")))
    both = a.join(b, ["case", "i"], "full_outer")
    gap = lambda f: F.abs(c(f"g.{f}") - c(f"p.{f}")) > 1e-4 * F.greatest(F.lit(1.0), F.abs(c(f"p.{f}")))
    sums = both.groupBy("case").agg(F.count("g").alias("n"), F.count("p").alias("m"), F.coalesce(F.bool_or(gap("volume") | gap("area")), F.lit(False)).alias("other"))
    return _each(
        rule(sums, "number of solids", "error", "case", c("n") != c("m"), F.format_string("%d against %d", "n", "m")),
        rule(sums, "solids differ", "error", "case", (c("n") == c("m")) & c("other"), F.lit("a solid has no counterpart")),
    )


def check_cases(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of every rule whose tables are given; the tables' names are the arguments' names of the checks above."""
    checks = [
        (case_identity, ("case",)), (case_files, ("listed", "found", "case")), (case_sheets, ("case", "part", "listed")), (case_drawings, ("case", "drawing", "report")),
        (case_symbols, ("drawing", "expected")), (case_parts_list, ("case", "parts_list", "part")), (case_instances, ("case", "part", "instance", "bom", "files")), (case_solids, ("solid",)),
    ]
    return _each(*[check(*(tables[n] for n in names)) for check, names in checks if all(n in tables for n in names)])


# Submissions.


def submission_files(files: DataFrame) -> DataFrame:
    """files(submission, path, regular) of submissions: root (the folder of parts and assembly; null if there is none), part_id, path,
    nth (place by name among the files of that part; the first counts) of each STEP file right below its parts folder."""
    regular = files.where("regular")
    here = regular.where(c("path").rlike(r"^(submission/)?(parts/[^/]+|assembly/instances\.json)$")).withColumn("root", F.when(c("path").startswith("submission/"), "submission/").otherwise(""))
    roots = here.groupBy("submission").agg(F.min("root").alias("root"))
    rows = files.select("submission").distinct().join(roots, "submission", "left")
    parts = regular.join(roots, "submission").where(c("path").startswith(F.concat(c("root"), F.lit("parts/")))).withColumn("name", F.substring_index("path", "/", -1))
    parts = parts.where(c("path") == F.concat(c("root"), F.lit("parts/"), c("name"))).where(c("name").rlike(STEP_FILE)).withColumn("part_id", F.regexp_replace("name", STEP_FILE, ""))
    nth = F.row_number().over(Window.partitionBy("submission", "part_id").orderBy("name"))
    parts = parts.select("submission", "part_id", "path", nth.alias("nth"))
    return rows.join(parts, "submission", "left")


def submission_failures(files: DataFrame, readable: DataFrame, document: DataFrame, instance: DataFrame, bom: DataFrame, supplied: DataFrame) -> DataFrame:
    """submission, code, scope, id of everything wrong with submissions.

    readable(submission, part_id, readable) of part files that were opened; document(submission, readable) where an instance list
    exists; instance(submission, pos, is_object, instance_id, part_id, transform); bom(submission, part_id), where a case lists its
    parts; supplied(submission, part_id, same): whether a supplied part is the supplied file. An instance fails for the first
    reason that holds."""
    layout = submission_files(files)
    parts = layout.where("nth = 1").select("submission", "part_id")
    fail = lambda df, code, scope, key: df.select("submission", F.lit(code).alias("code"), F.lit(scope).alias("scope"), (key if isinstance(key, Column) else F.lit(key)).cast("string").alias("id"))
    has = layout.groupBy("submission").agg(F.max("root").alias("root"), F.count("part_id").alias("parts"))
    rooted = has.where("root is not null")
    well = c("part_id").rlike(PART_ID)
    good = parts.where(well)
    usable = good.join(readable.where("not readable").select("submission", "part_id"), ["submission", "part_id"], "left_anti")
    listed = bom.select("submission", "part_id").distinct()
    with_list = listed.select("submission").distinct().join(rooted.select("submission"), "submission", "left_semi")
    placed = instance.join(document.where("readable").select("submission"), "submission", "left_semi")
    rows = placed.join(good.withColumn("__file", F.lit(True)), ["submission", "part_id"], "left").join(usable.withColumn("__usable", F.lit(True)), ["submission", "part_id"], "left")
    at = [F.get(c("transform"), F.lit(i)) for i in range(16)]
    bad = F.when(F.coalesce(F.size("transform"), F.lit(-1)) != 16, "not 4x4").otherwise(rigid_reason(at))
    code = (
        F.when(~c("is_object"), "bad_instance")
        .when(~F.coalesce(well, F.lit(False)), "bad_part_id")
        .when(c("__file").isNull(), "missing_part_file")
        .when(c("__usable").isNull(), "unusable_part_file")
        .when(bad.isNotNull(), "bad_transform")
    )
    where = F.format_string("instances.json[%d]", c("pos"))
    label = F.when(c("is_object"), F.coalesce(F.nullif(c("instance_id"), F.lit("")), F.nullif(c("part_id"), F.lit("")), where)).otherwise(where)
    judged = rows.withColumn("__code", code).withColumn("__label", label)
    sound = judged.where("__code is null").select("submission", "part_id").distinct()
    readable_list = document.where("readable").select("submission").join(rooted.select("submission"), "submission", "left_semi")
    return _each(
        fail(has.where("root is null"), "no_submission", "submission", ""),
        fail(rooted.where("parts = 0"), "no_parts_dir", "submission", ""),
        fail(parts.where(~well), "bad_part_file_name", "type", c("part_id")),
        fail(good.join(with_list, "submission", "left_semi").join(listed, ["submission", "part_id"], "left_anti"), "extra_part_type", "type", c("part_id")),
        fail(listed.join(with_list, "submission", "left_semi").join(good, ["submission", "part_id"], "left_anti"), "missing_part_type", "type", c("part_id")),
        fail(good.join(readable.where("not readable"), ["submission", "part_id"], "left_semi"), "unreadable_part", "type", c("part_id")),
        fail(rooted.join(document, "submission", "left_anti"), "no_instances", "submission", ""),
        fail(document.where("not readable"), "instances_unreadable", "submission", ""),
        judged.where("__code is not null").select("submission", c("__code").alias("code"), F.lit("instance").alias("scope"), c("__label").alias("id")),
        fail(usable.join(readable_list, "submission", "left_semi").join(sound, ["submission", "part_id"], "left_anti"), "part_never_placed", "type", c("part_id")),
        fail(readable_list.join(sound, "submission", "left_anti"), "no_placed_instances", "submission", ""),
        fail(supplied.where("not same").join(good, ["submission", "part_id"], "left_semi"), "not_the_supplied_part", "type", c("part_id")),
    )


# Task declarations.


def task_table(settings: DataFrame) -> DataFrame:
    """One row for each declaration (path) of settings(path, key, value): the 19 fields, defaults where they are left out; lists are
    arrays. A field without default that is left out is null."""
    lists = ("inputs", "inject", "band_exclude_families", "band_exclude_cases")
    wide = settings.groupBy("path").pivot("key", list(fixed.TASK_KEYS.values())).agg(F.first("value"))
    out = [c("path")]
    for name, key in fixed.TASK_KEYS.items():
        given = F.coalesce(c(f"`{key}`"), F.lit(fixed.TASK_DEFAULTS[name]))
        as_list = F.from_json(F.replace(given, F.lit("'"), F.lit('"')), "array<string>")
        out.append((as_list if name in lists else given).alias(name))
    return wide.select(*out)


def declaration_faults(tasks: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Faults (key: the task's id) of task declarations: values that a field can't have, fields that contradict each other, and
    excluded names (families or paths of cases) that cases(id, family, case) doesn't hold."""
    found = []
    for name, allowed in fixed.TASK_VALUES.items():
        found.append(rule(tasks, name, "error", "id", ~F.coalesce(c(name).isin(allowed), F.lit(False)), F.coalesce(c(name), F.lit("none"))))
    excluded = (F.size("band_exclude_families") > 0) | (F.size("band_exclude_cases") > 0)
    found += [
        rule(tasks, "reason of exclusion", "error", "id", excluded & (F.coalesce("band_exclude_reason", F.lit("")) == ""), F.lit("no reason")),
        rule(tasks, "aligned pose", "error", "id", (c("pose_mode") == "iou24_aligned") & (c("orientation") != "free"), F.lit("needs a free orientation")),
        rule(tasks, "modelled types", "error", "id", (c("avg_part_types") == "modelled") & (c("given") == "all_parts_step"), F.lit("every part is supplied")),
        rule(tasks, "size", "error", "id", (c("kind") == "assembly") & (c("given") == "nothing_3d") & (c("scale") == "fixed"), F.lit("nothing fixes the size")),
        rule(tasks, "oracle", "error", "id", F.coalesce("oracle", F.lit("")) == "", F.lit("none")),
        rule(tasks, "entry", "error", "id", ~F.coalesce(c("verify_entry").rlike(r"^[\w.]+:\w+$"), F.lit(False)), F.coalesce("verify_entry", F.lit("none"))),
    ]
    if cases is not None:
        for column, held, name in (("band_exclude_families", "family", "excluded family"), ("band_exclude_cases", "case", "excluded case")):
            names = tasks.select("id", F.explode(column).alias(held))
            found.append(rule(names.join(cases.select("id", held).distinct(), ["id", held], "left_anti"), name, "error", "id", F.lit(True), c(held)))
    return _each(*found)


def without_excluded(cases: DataFrame, tasks: DataFrame) -> DataFrame:
    """cases(id, family, case) that count in means: neither their family nor they are excluded."""
    gone = lambda column, held: tasks.select("id", F.explode(column).alias(held)).distinct()
    return cases.join(gone("band_exclude_families", "family"), ["id", "family"], "left_anti").join(gone("band_exclude_cases", "case"), ["id", "case"], "left_anti")


def declared(tasks: DataFrame, wanted: DataFrame, field: str) -> DataFrame:
    """wanted(id) with a declared value; a task that isn't declared is an error."""
    rows = wanted.join(tasks.select("id", c(field), F.lit(True).alias("__known")), "id", "left")
    value = F.when(c("__known"), c(field)).otherwise(F.raise_error(F.format_string("task %s is not declared", "id")))
    return rows.withColumn(field, value).drop("__known")


# Trials.


def provider_errors(requests: DataFrame) -> DataFrame:
    """trial, provider_status: of requests(trial, line, status, refused, blocked, websocket), the status of each trial's last forwarded
    one where it is 429 or 500 and above."""
    sent = requests.where(~(F.coalesce("refused", F.lit(False)) | F.coalesce("blocked", F.lit(False)) | F.coalesce("websocket", F.lit(False))))
    last = sent.groupBy("trial").agg(F.max_by("status", "line").alias("provider_status"))
    return last.where((c("provider_status") == 429) | (c("provider_status") >= 500))


def trial_states(trials: DataFrame, requests: DataFrame, budget: float = fixed.STANDARD_BUDGET) -> DataFrame:
    """trials(trial, has_result, collected, has_reward, reward, reward_error, no_answer, has_meter, budget, budget_hit, usage_unread,
    upstreams_ok, exception, pins, standard_pins) with status, score, why and reportable."""
    rows = trials.join(provider_errors(requests), "trial", "left")
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    verdict = F.when(~yes("has_result") | ~yes("collected") | ~yes("has_reward"), "pending").when(F.coalesce("reward_error", F.lit("")) != "", "pending").when(yes("no_answer"), "no_submission").otherwise("scored")
    rows = rows.withColumn("__v", verdict)
    no_meter = yes("has_result") & ~yes("has_meter") & (c("__v") != "pending")
    ended = yes("has_meter") & (F.coalesce("exception", F.lit("")) != "") & (c("exception") != "AgentTimeoutError") & ~yes("budget_hit") & c("provider_status").isNotNull()
    status = F.when(no_meter | ended, "pending").otherwise(c("__v"))
    why = (
        F.when(~yes("has_result"), "no result")
        .when(no_meter, "no meter record")
        .when(ended, F.format_string("ended on a provider error (%d)", c("provider_status")))
        .when(~yes("collected"), "work not collected")
    )
    pinned = F.forall(F.map_entries("standard_pins"), lambda e: F.element_at("pins", e["key"]).eqNullSafe(e["value"]))
    reportable = yes("has_result") & yes("has_meter") & (c("budget") == budget) & yes("upstreams_ok") & (F.coalesce("usage_unread", F.lit(0)) == 0) & F.coalesce(pinned, F.lit(False))
    out = rows.withColumn("status", status).withColumn("why", why).withColumn("reportable", F.coalesce(reportable, F.lit(False)))
    return out.withColumn("score", F.when(c("status") == "scored", c("reward")).when(c("status") == "no_submission", 0.0)).drop("__v")
