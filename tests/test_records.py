import pytest

from gaugeworks.operators import records as R
from gaugeworks.plans.record_queries import PRICES

SCHEMA = "model string, effort string, case string, case_id string, rep long, score double, error string, skipped string, pending_score boolean, unscored boolean, status string, correspondence_mode string, score_error string, has_score boolean"


def rec(case="task1/c1", score=None, rep=None, **more):
    base = {"model": "m", "effort": "e", "case": case, "case_id": case.split("/")[-1], "rep": rep, "score": score, "has_score": score is not None, "error": None, "skipped": None, "pending_score": None, "unscored": None, "status": None, "correspondence_mode": None, "score_error": None}
    return {**base, **more}


def frame(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (rec(score=0.5), ("scored", 0.5)),
        (rec(), ("no_submission", 0.0)),
        (rec(unscored=True), ("pending", None)),
        (rec(score=0.5, pending_score=True), ("pending", None)),
        (rec(score=0.5, skipped="why"), ("pending", None)),
        (rec(error="CallOverBudget: x"), ("no_submission", 0.0)),
        (rec(error="APIError", score=0.4), ("pending", None)),
        (rec(has_score=True, score_error="MemoryBudgetExceeded"), ("pending", None)),
        (rec(has_score=True, score_error="HTTP 503"), ("pending", None)),
        (rec(has_score=True, score_error="empty step"), ("no_submission", 0.0)),
        (rec("task6/c1", 0.9, correspondence_mode="position", status="ok"), ("scored", 0.9)),
        (rec("task6/c1", 0.9, correspondence_mode="legacy"), ("pending", None)),
        (rec("task6/c1", has_score=True, status="invalid_prediction"), ("no_submission", 0.0)),
        (rec("task6/c1", has_score=True, correspondence_mode="position", status="evaluator_error"), ("pending", None)),
    ],
)
def test_resolution(spark, row, want):
    r = R.resolve(frame(spark, [row])).collect()[0]
    assert (r.state, r.value) == want


def test_case_means_reps_and_completeness(spark):
    def line(rows):
        return R.headline(R.case_results(R.resolve(frame(spark, rows)))).collect()[0]

    assert line([rec(score=0.5), rec(score=0.7)]).mean == pytest.approx(0.6)
    three = [rec(score=0.9, rep=1), rec(score=0.3, rep=2), rec(error="timeout", rep=3)]
    assert (line(three).mean, line(three).pending) == (None, 1)
    assert line([*three, rec(score=0.6, rep=3)]).mean == pytest.approx(0.6)
    assert line([rec(score=1.0), rec("task1/c2")]).mean == 0.5


def test_expected_cases_without_record_are_pending(spark):
    cases = R.case_results(R.resolve(frame(spark, [rec(score=0.5)])))
    want = spark.createDataFrame([("T1", "c1"), ("T2", "c9")], "task string, case_id string")
    rows = {(r.task, r.case_id): (r.resolved, r.why) for r in R.with_expected(cases, want).collect()}
    assert rows == {("T1", "c1"): (True, None), ("T2", "c9"): (False, "no record")}


def test_tiers_and_dated_models(spark):
    prices = spark.createDataFrame(PRICES, "model string, input double, cached double, output double, long_over double, long_input double, long_cached double, long_output double")
    calls = spark.createDataFrame([(1, "A", 50000.0, 0.0, 0.0), (2, "A", 50001.0, 0.0, 0.0), (3, "A-20240101", 1e6, 1e6, 1e6), (4, "_note", 1.0, 1.0, 1.0), (5, "A-2024", 1.0, 1.0, 1.0)], "id int, model string, input double, cached double, output double")
    got = {r.id: r.usd for r in R.record_usd(R.price_joined(calls, prices), ("id",)).collect()}
    assert got[1] == pytest.approx(0.1) and got[2] == pytest.approx(50001 * 4 / 1e6) and got[3] == pytest.approx(13.0) and got[4] is None and got[5] is None


def test_first_passes_force_zero_after_twice_the_passes(spark):
    rows = [("a", "m", "e", "c1", s, k, k, True) for k, s in enumerate([0.5, None, 0.7, 0.9, 1.0])] + [("a", "m", "e", "c2", 0.3 if k == 0 else None, k, k, True) for k in range(6)] + [("a", "m", "e", "c3", None, 0, 0, True)]
    df = spark.createDataFrame(rows, "agent string, model string, effort string, case string, score double, started_at int, trial int, reportable boolean")
    got = {r.case: r.value for r in R.first_passes(df, 3).collect()}
    assert got["c1"] == pytest.approx(0.7) and got["c2"] == pytest.approx(0.1) and got["c3"] is None
    label = R.labelled_lines(R.first_passes(df, 3)).collect()[0]
    assert (label.label, label["mean"]) == ("INCOMPLETE", None)


def test_resume_and_answers(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "case string")
    previous = spark.createDataFrame([("a", True, False), ("b", False, True), ("z", True, False)], "case string, final boolean, rescore boolean")
    assert {k: sorted(r["case"] for r in v.collect()) for k, v in R.resume_split(wanted, previous).items()} == {"kept": ["a"], "rescore": ["b"], "todo": ["c"], "others": ["z"]}
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "key string, digest string")
    found = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "key string, digest string")
    assert {r.key: r.state for r in R.answer_check(stored, found).collect()} == {"a": "verified", "b": "mismatch", "c": "unverified", "d": "missing"}
