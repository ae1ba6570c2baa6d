import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import fixed
from gaugeworks.operators import rules as R

IDENTITY = [float(k % 5 == 0) for k in range(16)]
MIRROR = [-1.0, *IDENTITY[1:]]


def told(df):
    return sorted((r.key, r.level, r.rule, r.message) for r in df.collect())


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


CASE = "case string, id string, directory string, env string, kind string, synthetic boolean, dev boolean, pinned string"


@pytest.fixture(scope="module")
def case(spark):
    return table(
        spark, CASE, ("a", "a", "a", "t2_x", "assembly", False, False, None), ("b", "b", "c", "t1_x", "assembly", False, False, None), ("d", "d", "d", "x1", "part", False, False, None),
        ("e", "e", "e", "t4_y", "assembly", True, False, None), ("f", "f", "f", "t4_y", "assembly", False, False, None), ("g", "g", "g", "t1", "part", False, True, "9" * 64),
    )


def test_case_identity(spark, case):
    assert told(R.case_identity(case)) == [
        ("b", "error", "id", "b is not its directory's name"), ("b", "error", "kind", "kind assembly where the task has part"), ("d", "error", "env", "x1 is no task"),
    ]


def test_case_files(spark, case):
    listed = table(spark, "case string, section string, path string, digest string", ("a", "input", "input/x", "1"), ("a", "input", "input/y", "2"), ("a", "gt", "gt/gt.step", "2"), ("a", "gt", "gt/gone", "4"))
    found = table(
        spark, "case string, section string, path string, digest string, is_link boolean, utf8 boolean, text string",
        ("a", "input", "input/x", "1", False, True, None), ("a", "input", "input/y", "3", False, True, None), ("a", "gt", "gt/gt.step", "2", False, True, "BREP('圆')"), ("a", "input", "input/new", "5", True, True, None),
        ("a", "other", "notes.md", "6", False, True, "中"), ("a", "other", "bad.txt", "7", False, False, None), ("a", "other", "fine.md", "8", False, True, "é"),
    )
    own = case.where("case = 'a'")
    assert [(r, m) for _, _, r, m in told(R.case_files(listed, found, own))] == [
        ("CJK in a STEP name", "gt/gt.step"), ("file missing", "gt/gone"), ("file not listed", "input/new"), ("hash mismatch", "input/y"), ("input equals a true file", "input/y"),
        ("non-English text", "notes.md"), ("not UTF-8", "bad.txt"), ("symlink", "input/new"),
    ]
    assert [(r, m) for _, _, r, m in told(R.case_files(listed.where("false"), found.where("false"), own))] == [("true file missing", "gt/gt.step")]


def test_case_sheets(spark, case):
    part = table(spark, "case string, part_id string, quantity int", ("e", "p1", 1), ("f", "p1", 1))
    listed = table(spark, "case string, section string, path string, digest string", ("f", "input", "input/parts/p1_alone.png", ""), ("f", "input", "input/parts/p2_alone.png", ""), ("e", "input", "input/parts/p1_alone.png", ""))
    assert told(R.case_sheets(case, part, listed)) == [
        ("e", "warning", "sheet missing", "input/parts/p1_in_assembly.png"), ("f", "error", "sheet missing", "input/parts/p1_in_assembly.png"), ("f", "error", "sheet of no part type", "input/parts/p2_alone.png"),
    ]


def test_case_drawings_and_symbols(spark, case):
    lines = "\n".join([f"line {k}" for k in range(6)] * 2)
    drawing = table(
        spark, "case string, path string, text string, fonts array<string>, meta map<string,string>",
        ("a", "d1", lines, ["SimSun"], {"author": "x"}), ("a", "d2", "±± 图", [], {"format": "零"}), ("g", "d3", " ", [], {}), ("b", "d4", "", [], {}),
    )
    report = table(spark, "case string, status string, digest string", ("a", "pass", "1"))
    got = [(k, level, r) for k, level, r, _ in told(R.case_drawings(case, drawing, report))]
    assert got == [
        ("a", "error", "CJK font"), ("a", "error", "CJK in a drawing"), ("a", "error", "CJK in metadata"), ("a", "error", "report digest"), ("a", "warning", "doubled text"), ("a", "warning", "metadata"),
        ("b", "error", "outline text without a report"),
    ]
    assert [(k, r) for k, _, r, _ in told(R.case_drawings(case, drawing.where("case <> 'b'"), report)) if r == "no drawing"] == [("b", "no drawing")]
    failed = report.select("case", F.lit("fail").alias("status"), "digest").union(table(spark, "case string, status string, digest string", ("b", "FAIL", "2")))
    assert ("b", "error", "report not passed", "d4") in told(R.case_drawings(case, drawing, failed))
    expected = table(spark, "case string, path string, symbol string, n int, gain_note string", ("a", "d2", "plusminus", 3, None), ("a", "d2", "±", 1, "restored"), ("a", "d2", "degree_code", 0, None), ("a", "d2", "plusminus", 1, None))
    assert [(level, r) for _, level, r, _ in told(R.case_symbols(drawing, expected))] == [("error", "symbols gained"), ("error", "symbols lost"), ("warning", "symbols gained")]


def test_case_parts_list(spark, case):
    part = table(spark, "case string, part_id string, quantity int", ("a", "part_01", 1), ("a", "part_02", 2))
    kind = "case string, mapping string, note string, items map<string,string>, sheet map<string,string>, tokens array<string>"

    def rules(*row):
        return [r[2:] for r in told(R.case_parts_list(case.where("case = 'a'"), table(spark, kind, *([row] if row else [])), part))]

    assert rules() == [("parts list mapping", "none given")]
    assert rules("a", "declared", None, {}, None, None) == [("parts list empty", "no items")]
    assert rules("a", "declared", None, {"1": "part_01", "2": "part_01"}, {"1": "part_02"}, None) == [("part without item", "part_02"), ("several items for a part", "part_01"), ("sheet disagrees", "1"), ("items unread", "2")]
    assert rules("a", "declared", None, {"1": "part_01", "2": "part_02"}, {"1": "part_01", "2": "part_02"}, None) == []
    assert rules("a", "none", None, None, None, None) == [("parts list note", "no note")]
    assert rules("a", "item_number", None, None, None, None) == [("drawing without text", "no words")]
    assert rules("a", "item_number", None, None, None, ["1", "PART-02"]) == [] and rules("a", "item_number", None, None, None, ["1"]) == [("item number missing", "part_02")]


def test_case_instances_and_solids(spark, case):
    part = table(spark, "case string, part_id string, quantity int", ("a", "p", 2), ("a", "q", 1))
    instance = table(
        spark, "case string, pos int, instance_id string, part_id string, transform array<double>",
        ("a", 0, "p_i1", "p", IDENTITY), ("a", 1, "p_i1", "p", MIRROR), ("a", 2, "q_1", "q", IDENTITY[:9]), ("a", 3, "R_i1", "R", IDENTITY), ("d", 0, "x", "X", None),
    )
    bom = table(spark, "case string, part_id string, quantity int", ("a", "p", 1), ("a", "q", 1), ("a", "R", 1))
    files = table(spark, "case string, part_id string", ("a", "p"), ("a", "q"))
    got = [r[2:] for r in told(R.case_instances(case, part, instance, bom, files))]
    assert {r for r, _ in got} == {"instance repeated", "bad part id", "bad instance id", "not a rigid transform", "no part file", "quantities", "bill of materials"}
    assert ("bad instance id", "q_1") in got and ("bill of materials", "p: 1 listed, 2 placed") in got and ("quantities", "R: none listed, 1 placed") in got and ("no part file", "R") in got
    assert sum(r == "not a rigid transform" for r, _ in got) == 2
    solid = table(spark, "case string, side string, volume double, area double", ("a", "gt", 10.0, 5.0), ("a", "parts", 10.0004, 5.0), ("b", "gt", 10.0, 5.0), ("b", "parts", 11.0, 5.0), ("c", "gt", 1.0, 1.0))
    assert [r[:3] for r in told(R.case_solids(solid))] == [("b", "error", "solids differ"), ("c", "error", "number of solids")]
    both = R.check_cases({"case": case, "part": part, "instance": instance, "bom": bom, "files": files, "solid": solid})
    assert both.count() == R.case_identity(case).count() + len(got) + 2


def test_submission_failures(spark):
    files = table(
        spark, "submission string, path string, regular boolean",
        ("ok", "submission/parts/a.step", True), ("ok", "submission/parts/a.STP", True), ("ok", "submission/assembly/instances.json", True),
        ("s", "parts/a.step", True), ("s", "parts/b.stp", True), ("s", "parts/Bad.step", True), ("s", "parts/extra.step", True), ("s", "parts/link.step", False), ("s", "parts/deep/c.step", True), ("s", "assembly/instances.json", True),
        ("none", "answer.step", True), ("no_parts", "assembly/instances.json", True), ("no_list", "parts/a.step", True),
    )
    readable = table(spark, "submission string, part_id string, readable boolean", ("s", "b", False), ("s", "a", True))
    document = table(spark, "submission string, readable boolean", ("ok", True), ("s", True), ("no_parts", False))
    instance = table(
        spark, "submission string, pos int, is_object boolean, instance_id string, part_id string, transform array<double>",
        ("ok", 0, True, "a_i1", "a", IDENTITY), ("s", 0, False, None, None, None), ("s", 1, True, None, "Z", IDENTITY), ("s", 2, True, "c_i1", "c", IDENTITY), ("s", 3, True, "b_i1", "b", IDENTITY), ("s", 4, True, "a_i1", "a", MIRROR), ("s", 5, True, None, "a", None),
    )
    bom = table(spark, "submission string, part_id string", ("s", "a"), ("s", "b"), ("s", "c"))
    supplied = table(spark, "submission string, part_id string, same boolean", ("s", "a", False), ("ok", "a", True))
    got = sorted((r.submission, r.code, r.scope, r.id) for r in R.submission_failures(files, readable, document, instance, bom, supplied).collect())
    assert got == [
        ("no_list", "no_instances", "submission", ""),
        ("no_parts", "instances_unreadable", "submission", ""),
        ("no_parts", "no_parts_dir", "submission", ""),
        ("none", "no_submission", "submission", ""),
        ("s", "bad_instance", "instance", "instances.json[0]"),
        ("s", "bad_part_file_name", "type", "Bad"),
        ("s", "bad_part_id", "instance", "Z"),
        ("s", "bad_transform", "instance", "a"),
        ("s", "bad_transform", "instance", "a_i1"),
        ("s", "extra_part_type", "type", "extra"),
        ("s", "missing_part_file", "instance", "c_i1"),
        ("s", "missing_part_type", "type", "c"),
        ("s", "no_placed_instances", "submission", ""),
        ("s", "not_the_supplied_part", "type", "a"),
        ("s", "part_never_placed", "type", "a"),
        ("s", "part_never_placed", "type", "extra"),
        ("s", "unreadable_part", "type", "b"),
        ("s", "unusable_part_file", "instance", "b_i1"),
    ]
    assert {(r.submission, r.root) for r in R.submission_files(files).select("submission", "root").distinct().collect()} == {("ok", "submission/"), ("s", ""), ("none", None), ("no_parts", ""), ("no_list", "")}


def test_task_declarations(spark):
    good = {"task.id": "t", "task.kind": "assembly", "task.submission": "x", "task.given": "nothing_3d", "verify.entry": "a.b:score", "verify.orientation": "free", "data.source_repo": "drawings", "data.split": "open", "verify.oracle": "o", "verify.scale": "free", "task.inputs": "['a', 'b']"}
    wrong = good | {"task.id": "u", "verify.scale": "fixed", "verify.metric": "mine", "verify.band_exclude_families": "['f', 'g']", "verify.pose_mode": "iou24_aligned", "verify.orientation": "pinned", "verify.oracle": "", "verify.entry": "nowhere"}
    settings = table(spark, "path string, key string, value string", *[(p, k, v) for p, d in (("1", good), ("2", wrong)) for k, v in d.items()])
    tasks = R.task_table(settings)
    one = tasks.where("id = 't'").collect()[0]
    assert len(tasks.columns) == 1 + 19 and (one.inputs, one.inject, one.renderer, one.metric, one.pose_mode, one.avg_part_types) == (["a", "b"], [], "none", "legacy", "expert-fit", "all")
    cases = table(spark, "id string, family string, case string", ("u", "f", "f/1"), ("u", "h", "h/1"), ("t", "f", "f/1"))
    got = [(k, r, m) for k, _, r, m in told(R.declaration_faults(tasks, cases))]
    assert got == [
        ("u", "aligned pose", "needs a free orientation"), ("u", "entry", "nowhere"), ("u", "excluded family", "g"), ("u", "metric", "mine"), ("u", "oracle", "none"), ("u", "reason of exclusion", "no reason"), ("u", "size", "nothing fixes the size"),
    ]
    assert sorted((r.id, r.case) for r in R.without_excluded(cases, tasks).collect()) == [("t", "f/1"), ("u", "h/1")]
    assert R.declared(tasks, tasks.select("id"), "scale").where("id = 'u'").collect()[0].scale == "fixed"
    with pytest.raises(Exception, match="not declared"):
        R.declared(tasks, table(spark, "id string", ("v",)), "scale").collect()
    assert set(fixed.TASK_DEFAULTS) == set(fixed.TASK_KEYS) and len(fixed.TASK_KEYS) == 19


def test_trial_states(spark):
    schema = "trial string, has_result boolean, collected boolean, has_reward boolean, reward double, reward_error string, no_answer boolean, has_meter boolean, budget double, budget_hit boolean, usage_unread int, upstreams_ok boolean, exception string, pins map<string,string>, standard_pins map<string,string>"
    pins = {"version": "1"}

    def trial(name, **other):
        row = {"has_result": True, "collected": True, "has_reward": True, "reward": 0.5, "reward_error": None, "no_answer": False, "has_meter": True, "budget": 500_000.0, "budget_hit": False, "usage_unread": 0, "upstreams_ok": True, "exception": None, "pins": pins, "standard_pins": pins} | other
        return (name, *row.values())

    trials = table(
        spark, schema, trial("fine"), trial("none", has_result=None, collected=None, has_reward=None, has_meter=None), trial("lost", collected=False), trial("failed", reward_error="x"), trial("silent", no_answer=True, reward=None),
        trial("unmetered", has_meter=False), trial("provider", exception="Boom"), trial("timeout", exception="AgentTimeoutError"), trial("pinned", pins={"version": "2"}), trial("budget", budget=1.0), trial("unread", usage_unread=2), trial("hit", exception="Boom", budget_hit=True),
    )
    requests = table(
        spark, "trial string, line int, status int, refused boolean, blocked boolean, websocket boolean",
        ("provider", 1, 200, None, None, None), ("provider", 2, 529, None, None, None), ("provider", 3, 400, True, None, None), ("timeout", 1, 500, None, None, None), ("hit", 1, 429, None, None, None), ("fine", 1, 200, None, None, None),
    )
    got = {r.trial: (r.status, r.score, r.reportable) for r in R.trial_states(trials, requests).collect()}
    assert got == {
        "fine": ("scored", 0.5, True), "none": ("pending", None, False), "lost": ("pending", None, True), "failed": ("pending", None, True), "silent": ("no_submission", 0.0, True), "unmetered": ("pending", None, False),
        "provider": ("pending", None, True), "timeout": ("scored", 0.5, True), "pinned": ("scored", 0.5, False), "budget": ("scored", 0.5, False), "unread": ("scored", 0.5, False), "hit": ("scored", 0.5, True),
    }
