import random
import zlib

import numpy as np
import pyarrow as pa

from gaugeworks.llm import quality
from tests.llm.helpers import documents, prose, rows_of


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows_of(quality.op8_quality(spark, folder))}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [i for i in labels if got[i]["held_out"]]
    right = sum(got[i]["predicted"] == labels[i] for i in held) / len(held)
    good = [got[i]["predicted"] for i in held if labels[i]]
    assert right >= 0.95 and sum(good) / len(good) >= 0.97


def test_held_out_labels_do_not_matter(spark):
    rng = random.Random(31)
    rows = [(k, " ".join(prose(rng, 50)) if k % 2 else "!!! ### " * 20) for k in range(120)]
    docs = documents(spark, rows)
    plain = [(k, float(k % 2)) for k, _ in rows]
    lies = [(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in plain]
    scores = [{r["doc_id"]: r["score"] for r in rows_of(quality.classify(docs, spark.createDataFrame(x, "doc_id long, label double")))} for x in (plain, lies)]
    assert scores[0] == scores[1]
    assert all((s >= 0.3) == (k % 2 == 1) for k, s in scores[0].items())


def test_nulls_repeats_no_labels_and_empty(spark):
    rows = [(None, None), (1, None), (1, ""), (2, "a b"), (2, "a b"), (3, "x" * 200_000)]
    none = spark.createDataFrame([], "doc_id long, label double")
    df = documents(spark, rows).selectExpr("*", "1 as x", "2 as fold", "0.5D as score")
    got = rows_of(quality.classify(df, none))
    assert len(got) == 6 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    some = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, None), (3, 1.0), (None, 1.0)], "doc_id long, label double")
    assert all(0 <= r["score"] <= 1 for r in rows_of(quality.classify(df, some)))
    assert quality.classify(documents(spark, []), some).count() == 0


def test_statistics_against_plain_python():
    texts = ["One two, two THREE!\nOne two, two THREE!\n| # 42", "", "a", "é é É"]
    got = dict(zip(quality.STATISTICS, quality.statistics(pa.array(texts, pa.large_string())).T))
    assert got["log_words"].tolist() == np.log1p([9, 0, 1, 3]).tolist()
    assert got["repeated_lines"][0] == 1 - 2 / 3 and got["distinct_words"][0] == 4 / 9 and got["top_word"][0] == 4 / 9
    assert got["same_as_last"].tolist() == [2 / 9, 0, 0, 2 / 3] and got["shouts"][0] == 2 / 9
    assert got["upper"][0] == 12 / 28


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(33)
    counts, at = rng.integers(0, 5, 200).astype(float), np.linspace(0, 1, 200)
    sums = counts * (rng.random(200) < at)
    xs, ys = quality.isotonic(counts, sums, at)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert abs((np.interp(at, xs, ys) * counts).sum() - sums.sum()) < 1e-6


def test_normal_equations_equal_plain_ridge(spark):
    rng = np.random.default_rng(34)
    z, y = np.hstack([rng.standard_normal((50, quality.FEATURES)), np.ones((50, 1))]), rng.random(50)
    full = np.hstack([z, y[:, None]])
    normal = full.T @ full
    normal[-1, -1] = 50
    w = quality.solve(normal, 0.1)
    penalty = np.full(z.shape[1], 0.1 * 50 / quality.FEATURES)
    penalty[-1] = 1e-9
    assert np.allclose(z.T @ (z @ w - y) + penalty * w, 0, atol=1e-8)


def test_features_approximate_the_gaussian_kernel():
    """Products of features against exp(-|x - y|^2 / 2 w^2), w the width in units of the root of the number of statistics."""
    rng = np.random.default_rng(80)
    x = rng.standard_normal((60, quality.K))
    model = quality.Model(np.zeros(quality.K), np.ones(quality.K))
    z = model.features(x)[:, :-1]
    width = quality.WIDTH * np.sqrt(quality.K)
    want = np.exp(-((x[:, None] - x) ** 2).sum(2) / (2 * width**2))
    gap = np.abs(z @ z.T - want)
    assert gap.mean() < 0.05 and gap.max() < 0.25
    assert np.corrcoef((z @ z.T).ravel(), want.ravel())[0, 1] > 0.9
