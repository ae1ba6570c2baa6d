import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalar as S
from gaugeworks.operators import integrity as I


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    ("name", "want"),
    [("GND", "ground"), ("gnd ", "ground"), ("VCC", "supply"), ("+3V3", "supply"), ("-12V", "supply"), ("1V8", "supply"), ("VIN_SEL", None), ("PWR_EN", None), ("GND_D", "ground"), ("3V3_A", "supply"),
     ("VCC+5V", "supply"), ("0V", "ground"), ("", None), (None, None), ("5VDET", None), ("GNDSW", None), ("V+", "supply"), ("A_1", None), ("AGND/DGND", "ground"), ("GND_VCC", "supply")],
)
def test_rail_class(spark, name, want):
    assert one(spark, S.rail_class(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(("path", "want"), [("a/task3/case1", "T3"), ("t6_x/case", "T6"), ("x/y", "?"), ("task2/t6_x", "T2"), ("taskx/t6_y", "T6"), ("data/task12/c", "T12")])
def test_task_of(spark, path, want):
    assert one(spark, S.task_of(F.lit(path))) == want


@pytest.mark.parametrize(("text", "want"), [("1m3s", 63.0), ("250ms", 0.25), ("7", 7.0), ("2h", 7200.0), ("soon", None), ("1.5s", 1.5)])
def test_durations(spark, text, want):
    assert one(spark, S.duration_seconds(F.lit(text))) == want


def test_values(spark):
    x = lambda v: F.lit(v).cast("double")
    assert one(spark, S.gain_over(x(0.75), x(0.5))) == 0.5 and one(spark, S.gain_over(x(1.0), x(1.0))) == 1.0
    assert one(spark, S.magnitude_ratio(x(0.0), x(0.0))) == 1.0 and one(spark, S.magnitude_ratio(x(-2.0), x(4.0))) == 0.5
    assert abs(one(spark, S.decade_similarity(x(2.0), x(1.0))) - (1 - math.log10(2))) < 1e-12
    assert one(spark, S.decade_similarity(x(None), x(1.0))) == 0.0 and one(spark, S.decade_similarity(x(5.0), x(None))) == 1.0 and one(spark, S.decade_similarity(x(0.0), x(0.0))) == 1.0
    assert one(spark, S.relative_score(x(1.5), x(1.0))) == 0.5 and one(spark, S.relative_score(x(0.0), x(0.0))) == 1.0
    assert one(spark, S.lattice(x(2.5), 1.0)) == 2 and one(spark, S.significant(x(1415249.9999), 6)) == 1415250.0
    assert one(spark, S.betti_product((F.lit(1), F.lit(1)), (F.lit(0), F.lit(1)))) == 0.25
    assert one(spark, S.token_estimate(F.lit("x" * 9), F.array(F.lit("y" * 5), F.lit("z" * 4)), F.lit(1))) == 2 + 1 + 1 + 4800
    assert one(spark, S.last_fence(F.lit("```python\na\n```\n```python\nb\n```"), "python")) == "b\n"
    assert one(spark, S.is_secret_name(F.lit("my_api_key"))) and not one(spark, S.is_secret_name(F.lit("PATH")))


def test_digests_equal_hashlib(spark):
    import hashlib

    entries = [("b/x", "1" * 64), ("a", "2" * 64)]
    col = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(h).alias("digest")) for p, h in entries])
    want = hashlib.sha256("".join(f"{p}\0{h}\0" for p, h in sorted(entries)).encode()).hexdigest()
    assert one(spark, S.tree_digest(col)) == want
    assert one(spark, S.seed_of(F.lit("env"), F.lit("case1"))) == int.from_bytes(hashlib.sha256(b"env/case1").digest()[:4], "big")


@pytest.mark.parametrize(
    ("pred", "true", "want"),
    [("resistor", "fuse", True), ("fuse", "resistor", False), ("x", "buzzer", True), ("inductor", "ferrite_bead", True), ("ferrite_bead", "inductor", False), ("capacitor_polarized", "capacitor", False), ("led", "led", True)],
)
def test_type_compatible(spark, pred, true, want):
    assert one(spark, S.type_compatible(F.lit(true), F.lit(pred))) is want


def test_rigid_reason(spark):
    def reason(m):
        return one(spark, S.rigid_reason([F.lit(float(v)) for v in np.asarray(m, float).ravel()]))

    eye = np.eye(4)
    turn = eye.copy()
    turn[:2, :2] = [[0, -1], [1, 0]]
    mirror = np.diag([1, 1, -1, 1])
    assert reason(eye) is None and reason(turn) is None
    assert reason(mirror) == "not a rotation" and reason(np.diag([2, 1, 1, 1])) == "not orthonormal" and reason(np.diag([1, 1, 1, 2])) == "bottom row"
    assert reason([[math.inf] * 4] * 4) == "not finite"


def test_leaks_are_found_at_any_depth(spark):
    rows = [(1, '{"a": {"secret": [1, {"b": "mail x@y.zz"}]}}'), (2, "not json"), (3, '[{"c": "fine"}]')]
    got = {(r.key, r.path, r.kind) for r in I.identity_leaks(spark.createDataFrame(rows, "id long, doc string"), "id", "doc", ["secret"], "@").collect()}
    assert got == {("1", "$.a.secret", "key"), ("1", "$.a.secret[1].b", "text")}


def test_canonical_ids_and_policy(spark):
    rows = [(1, 1, "p", "p_i7"), (1, 2, "p", "p_i7"), (1, 3, "p", "bad"), (1, 4, "q", None)]
    got = [r.instance_id for r in I.canonical_ids(spark.createDataFrame(rows, "g int, pos int, part string, given string"), "g", "part", "given", ["pos"]).orderBy("pos").collect()]
    assert got == ["p_i7", "p_i2", "p_i3", "q_i1"]
    files = spark.createDataFrame([("c", "T1", "input/a.pdf"), ("c", "T1", "input/x.png")], "case string, task string, path string")
    policy = spark.createDataFrame([("T1", ["input/a.pdf", "input/b.json"], [r"input/.*\.pdf"])], "task string, required array<string>, allowed array<string>")
    assert {(r.rule, r.path) for r in I.policy_violations(files, policy).collect()} == {("required file missing", "input/b.json"), ("file not allowed", "input/x.png")}


def test_leaks_of_more_nodes_than_the_row_limit(spark):
    rows = spark.createDataFrame([(k, '{"a": [{"secret": 1}, "x@y"]}') for k in range(50)], "id long, doc string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert I.identity_leaks(rows, "id", "doc", ["secret"], "@").count() == 100
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
