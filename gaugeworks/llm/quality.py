"""Document quality: random Fourier features, ridge by summed normal equations, isotonic calibration.

1. Statistics of each whole text (STATISTICS), and their means and deviations over all documents.
2. Random Fourier features of the standardised statistics approximate a Gaussian kernel.
3. Each partition sums its normal equations, by fold; sums of sums go up a tree, so the driver gets few
   matrices of fixed size. All labelled rows whose fold isn't held out are used; nothing is sampled.
4. The ridge strength with the least error on left-out folds is taken, scores of left-out folds are
   calibrated by isotonic regression over a fixed grid of scores, and the final weights use all folds.

Folds are crc32(doc_id as text) mod 5; fold 0 is never learnt from. Labels, lang, source and doc_id are
no inputs of a score.

Cases: null and empty texts have statistics of 0 and are scored; a null doc_id is in fold 0 and has no
label; rows that repeat a doc_id are scored each, and their labels count each; a doc_id with several
labels has their mean; null labels are left out; without any label to learn from every score is 0.5;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.words import U, buffers, pieces, run_bounds, run_hashes, texts_of, words
from gaugeworks.llm.workspace import Workspace, tidy

FOLDS = 5
#: Random Fourier features, and the kernel's width in units of the square root of the number of statistics.
FEATURES, WIDTH = 320, 0.7
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
GRID = 4000
#: Scores from here on count as good.
THRESHOLD = 0.3
#: Partial sums that are added at once, and at most as many reach the driver; rows that one of them is made from.
FAN_IN, ROWS_A_SUM = 8, 20_000
STATISTICS = (
    "log_words", "log_lines", "upper", "digits", "spaces", "ends", "shouts", "bars", "marks", "other_signs", "non_ascii", "word_length", "word_deviation",
    "long_words", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "repeated_lines", "words_a_line", "signs_a_word",
)
K = len(STATISTICS)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _repeats(key: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different keys, and occurrences of the most frequent one, for each of n texts."""
    mixed = np.sort((text.astype(U) << U(40)) | (key >> U(24)))
    new = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]])) if len(mixed) else np.zeros(0, np.int64)
    of = (mixed[new] >> U(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(new, len(mixed))))
    return np.bincount(of, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """An array of len(texts) rows of the K statistics."""
    n = len(texts)
    data, offsets = buffers(texts)
    out = np.zeros((n, K))
    if not len(data):
        return out
    hashes, starts, ends, at = words(texts)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    count = np.diff(at).astype(float)
    some = np.maximum(count, 1)
    text = np.repeat(np.arange(n), np.diff(at))
    letters = _per_text(((data | 32) >= 97) & ((data | 32) <= 122), offsets)
    signs = (data > 32) & (data < 127) & ~(((data | 32) >= 97) & ((data | 32) <= 122)) & ~((data >= 48) & (data <= 57))
    line = data != 10
    line_from, line_to = run_bounds(line, offsets)
    line_text = np.searchsorted(offsets, line_from, "right") - 1
    lines = np.maximum(np.bincount(line_text, minlength=n), 1).astype(float)
    different_lines, _ = _repeats(run_hashes(data, line_from, line_to), line_text, n)
    length = (ends - starts).astype(float)
    mean = np.bincount(text, length, n) / some
    different, most = _repeats(hashes, text, n)
    inner = np.flatnonzero(text[1:] == text[:-1])
    with np.errstate(over="ignore"):
        pairs = hashes[inner] * U(0x9E3779B97F4A7C15) + hashes[inner + 1]
    pair_count = np.maximum(np.bincount(text[inner], minlength=n), 1)
    columns = {
        "log_words": np.log1p(count),
        "log_lines": np.log1p(lines),
        "upper": _per_text((data >= 65) & (data <= 90), offsets) / np.maximum(letters, 1),
        "digits": _per_text((data >= 48) & (data <= 57), offsets) / size,
        "spaces": _per_text(data <= 32, offsets) / size,
        "ends": _per_text(data == 46, offsets) / some,
        "shouts": _per_text(data == 33, offsets) / some,
        "bars": _per_text(data == 124, offsets) / some,
        "marks": _per_text(np.isin(data, (35, 36, 37, 38, 42)), offsets) / some,
        "other_signs": _per_text(signs, offsets) / size,
        "non_ascii": _per_text(data >= 128, offsets) / size,
        "word_length": mean,
        "word_deviation": np.sqrt(np.maximum(np.bincount(text, length**2, n) / some - mean**2, 0)),
        "long_words": np.bincount(text, length > 20, n) / some,
        "distinct_words": different / some,
        "top_word": most / some,
        "same_as_last": np.bincount(text[inner], hashes[inner] == hashes[inner + 1], n) / some,
        "distinct_pairs": _repeats(pairs, text[inner], n)[0] / pair_count,
        "repeated_lines": 1 - different_lines / lines,
        "words_a_line": np.log1p(count / lines),
        "signs_a_word": np.log1p(_per_text(signs, offsets) / some),
    }
    for k, name in enumerate(STATISTICS):
        out[:, k] = columns[name]
    return out


@tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        rows = [statistics(some) for _, some in pieces(texts)]
        table = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, K), np.float32)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array([r.tobytes() for r in table], pa.binary())})


def matrix(column: pa.Array, width: int = K) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(float)


def tree_sum(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the arrays (column `sums`: float64 bytes) under each `key`, a small fixed set. Few rows reach the driver."""

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[key] = total.get(key, 0) + np.frombuffer(raw)
        if total:
            yield pa.RecordBatch.from_pydict({"key": list(total), "sums": [v.tobytes() for v in total.values()]})

    schema = "key long, sums binary"
    n = parts.rdd.getNumPartitions()
    while n > FAN_IN:
        n = math.ceil(n / FAN_IN)
        parts = parts.repartition(n).mapInArrow(add, schema)
    total: dict[int, np.ndarray] = {}
    for r in parts.collect():
        total[r["key"]] = total.get(r["key"], 0) + np.frombuffer(r["sums"])
    return total


def _partial(of):
    """A mapInArrow function that yields a partition's sums; of: batch -> {key: array}."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, v in of(batch).items():
                total[key] = total.get(key, 0) + v
        if total:
            yield pa.RecordBatch.from_pydict({"key": list(total), "sums": [np.ascontiguousarray(v, float).tobytes() for v in total.values()]})

    return run


class Model:
    """Standardisation, random features, weights and calibration; small, of fixed size."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 8):
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        rng = np.random.default_rng(seed)
        self.w = rng.standard_normal((K, FEATURES)) / (WIDTH * math.sqrt(K))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([math.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(x), 0.5)
        return np.interp(self.features(x) @ self.weights, *self.knots)


def solve(normal: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights of summed normal equations (rows: features; last column: products with the label). The constant isn't shrunk."""
    a, y = normal[:-1, :-1], normal[:-1, -1]
    penalty = np.full(len(a), ridge * max(normal[-1, -1], 1) / FEATURES)
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), y)


def isotonic(counts: np.ndarray, sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; counts and label sums by place on the grid. Knots of the fitted step function, joined by lines."""
    used = np.flatnonzero(counts)
    blocks: list[list[float]] = []
    for k in used:
        blocks.append([sums[k], counts[k], at[k], at[k]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = hi
    xs, ys = [], []
    for s, c, lo, hi in blocks:
        xs += [lo, hi + 1e-9]
        ys += [s / c] * 2
    return np.array(xs), np.array(ys)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(FOLDS)), F.lit(0)).cast("int")


def measure(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id and the statistics (32-bit floats) of each document, written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.keep(rows.mapInArrow(_measure, "doc_id long, x binary"), "statistics")


def fit(measured: DataFrame, labels: DataFrame, work: Workspace) -> Model:
    """Learn from labels (doc_id, label) outside fold 0."""

    def moments(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = matrix(batch.column("x"))
        return {0: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])}

    got = tree_sum(measured.select("x").mapInArrow(_partial(moments), "key long, sums binary")).get(0, np.zeros(1 + 2 * K))
    n, mean = max(got[0], 1), got[1 : K + 1] / max(got[0], 1)
    model = Model(mean, np.sqrt(np.maximum(got[K + 1 :] / n - mean**2, 0)))
    known = labels.where(F.col("label").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.avg("label").alias("label"))
    rows = measured.join(known, "doc_id").select("x", "label", fold(F.col("doc_id")).alias("fold"))
    rows = work.keep(rows, "learnt-from")
    rows = rows.coalesce(max(1, math.ceil(rows.count() / ROWS_A_SUM)))

    def normal(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        z, y, of = model.features(matrix(batch.column("x"))), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        full = np.hstack([z, y[:, None]])
        out = {}
        for k in np.unique(of):
            m = full[of == k].T @ full[of == k]
            m[-1, -1] = (of == k).sum()
            out[int(k)] = np.append(m.ravel(), (y[of == k] ** 2).sum())
        return out

    sums = tree_sum(rows.mapInArrow(_partial(normal), "key long, sums binary"))
    if not sums:
        return model
    square = FEATURES + 2
    folds = {k: (v[:-1].reshape(square, square), v[-1]) for k, v in sums.items()}
    total = sum(v for v, _ in folds.values())
    best = None
    for ridge in RIDGES:
        left_out, error = {}, 0.0
        for k, (own, squares) in folds.items():
            w = solve(total - own if len(folds) > 1 else total, ridge)
            left_out[k] = w
            error += squares - 2 * w @ own[:-1, -1] + w @ own[:-1, :-1] @ w
        if best is None or error < best[0]:
            best = (error, ridge, left_out)
    _, ridge, left_out = best
    model.weights = solve(total, ridge)
    at = np.linspace(-1, 2, GRID + 1)

    def calibration(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        z, y, of = model.features(matrix(batch.column("x"))), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        raw = np.zeros(len(y))
        for k, w in left_out.items():
            raw[of == k] = z[of == k] @ w
        place = np.clip(np.rint((raw + 1) / 3 * GRID), 0, GRID).astype(int)
        return {0: np.concatenate([np.bincount(place, minlength=GRID + 1), np.bincount(place, y, GRID + 1)])}

    got = tree_sum(rows.mapInArrow(_partial(calibration), "key long, sums binary"))[0]
    model.knots = isotonic(got[: GRID + 1], got[GRID + 1 :], at)
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(matrix(batch.column("x"))), pa.float64())})

    return measured.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. labels: doc_id, label (1: good)."""
    work = Workspace(docs.sparkSession, "quality")
    measured = measure(docs, work)
    scored = score(measured, fit(measured, labels, work))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for quality."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality_labels(spark, sf_dir))
