import hashlib
import json

import pytest

from gaugeworks.operators import integrity as I
from gaugeworks.sources import readers as R


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_run_documents_fall_back_on_the_header(spark, tmp_path):
    cases = [
        {"case": "d/task1/c1", "score": {"score": 0.5}, "rep": None, "tokens": {"per_call": [{"input": 5, "cached": 1, "output": 2}]}},
        {"case": "d/task1/c2", "model": "", "effort": "high", "rounds": 0, "score": None},
        {"case": "d/task1/c3", "rep": 2, "error": None, "score": {"error": "x"}},
        {"case": "d/task1/c4", "skipped": "s"},
    ]
    write(tmp_path / "r.json", {"model": "m", "effort": "low", "rounds": 30, "rep": 7, "cases": cases})
    write(tmp_path / "broken.json", "{")
    got = {r["case_id"]: r for r in R.run_records(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    assert (got["c1"].model, got["c1"].effort, got["c1"].rep, got["c1"].score, got["c1"].version) == ("m", "low", None, 0.5, "2.0")
    assert got["c1"].per_call[0].output == 2
    assert (got["c2"].model, got["c2"].effort, got["c2"].rounds, got["c2"].rep, got["c2"].has_score) == ("m", "high", 30, 7, False)
    assert (got["c3"].rep, got["c3"].score, got["c3"].score_error, got["c3"].has_score, got["c3"].error_key) == (2, None, "x", True, True)
    assert (got["c4"].skipped, got["c4"].has_score, got["c4"].error_key) == ("s", False, False)


def test_placements_of_all_shapes(spark, tmp_path):
    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    write(tmp_path / "a/instances.json", [{"part_id": "p", "instance_id": "p_i1", "T": eye}])
    write(tmp_path / "b/instances.json", {"instances": [{"part_id": "q", "transform": [x for r in eye[:3] for x in r]}, {"part_id": "q", "transform": [1.0]}]})
    rows = sorted((r.part_id, r.pos, r.transform) for r in R.instances(spark, str(tmp_path)).collect())
    flat = [float(x) for r in eye for x in r]
    assert rows == [("p", 0, flat), ("q", 0, flat), ("q", 1, [1.0])]
    write(tmp_path / "c/bom.json", {"items": [{"part_id": "p", "quantity": 2, "source": "drawing"}, {"part_id": "q"}]})
    assert [(r.part_id, r.quantity, r.source) for r in R.bom(spark, str(tmp_path)).orderBy("pos").collect()] == [("p", 2, "drawing"), ("q", 1, None)]


def test_listing_manifest_and_cases(spark, tmp_path):
    write(tmp_path / "t/c1/case.json", "{}")
    write(tmp_path / "t/c1/input/a.txt", "hello")
    write(tmp_path / "t/c2/case.json", "{ }")
    digest = hashlib.sha256(b"hello").hexdigest()
    write(tmp_path / "MANIFEST.sha256", f"{digest}  c1/input/a.txt\n{'0' * 64}  c1/case.json\n{'1' * 64}  gone\n")
    found = R.listing(spark, str(tmp_path / "t"))
    assert {r.path: r.length for r in found.collect()} == {"c1/case.json": 2, "c1/input/a.txt": 5, "c2/case.json": 3}
    diff = {r.path: r.state for r in I.manifest_diff(R.checksum_manifest(spark, str(tmp_path / "MANIFEST.sha256")), found).collect()}
    assert diff == {"c1/input/a.txt": "same", "c1/case.json": "changed", "c2/case.json": "unlisted", "gone": "missing"}
    assert sorted(r.case for r in R.discovered_cases(spark, str(tmp_path / "t")).collect()) == ["c1", "c2"]


def test_tasks_prices_lines_and_trajectories(spark, tmp_path):
    write(tmp_path / "env/task.toml", 'name = "x"\n[verify]\nentry = "m:f"\n')
    assert {(r.key, r.value) for r in R.tasks(spark, str(tmp_path)).collect()} == {("name", "x"), ("verify.entry", "m:f")}
    write(tmp_path / "prices.json", {"_note": "n", "m": {"input": 1.0, "cached": 0.5, "output": 2.0, "long_context": {"over_input_tokens": 9, "input": 3.0, "cached": 1.0, "output": 4.0}}, "n": {"input": 1, "cached": 1, "output": 1}})
    got = {r.model: (r.input, r.long_over, r.long_output) for r in R.prices(spark, str(tmp_path / "prices.json")).collect()}
    assert got == {"m": (1.0, 9.0, 4.0), "n": (1.0, None, None)}
    write(tmp_path / "l/requests.jsonl", '{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in R.json_lines(spark, str(tmp_path / "l"), "a int").collect()) == [1, 2]
    step = {"tool_calls": [1, 2]}
    write(tmp_path / "x/trajectory.json", {"steps": [step, {}], "subagent_trajectories": [{"steps": [step], "subagent_trajectories": [{"steps": [step]}]}]})
    assert R.tool_calls(spark, str(tmp_path / "x")).collect()[0].tool_calls == 6


def test_results_and_shards(spark, tmp_path):
    new = spark.createDataFrame([("b/2", 1.0), ("a/10", 2.0)], "case string, score double")
    old = spark.createDataFrame([("a/10", 0.0), ("a/1", 3.0)], "case string, score double")
    R.write_results(new, old, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {r["case"]: r.score for r in back.collect()} == {"a/1": 3.0, "a/10": 2.0, "b/2": 1.0}
    df = spark.range(23).withColumnRenamed("id", "k")
    parts = [sorted(r.k for r in R.shard(df, "k", k, 5).collect()) for k in range(5)]
    assert parts == [list(range(k, 23, 5)) for k in range(5)]


def test_part_files(spark):
    parts = spark.createDataFrame([("c", "p"), ("c", "q"), ("c", "r")], "case string, part_id string")
    files = spark.createDataFrame([("c", "gt/parts/p.step"), ("c", "input/step_files/p.step"), ("c", "input/step_files/q.step")], "case string, path string")
    assert {r.part_id: r.file for r in R.part_files(parts, files).collect()} == {"p": "gt/parts/p.step", "q": "input/step_files/q.step", "r": None}


@pytest.mark.parametrize("rows", [[("a", 2), ("b", 1)]])
def test_sorted_lines(spark, tmp_path, rows):
    R.write_json_lines(spark.createDataFrame(rows, "k string, v int"), str(tmp_path / "o"), "k")
    assert spark.read.json(str(tmp_path / "o")).count() == len(rows)
