import numpy as np

from gaugeworks.llm import neighbours
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for n, (i, v) in enumerate(ok):
        if i % every == 0:
            s = (x * v).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum()))
            order = [m for m in np.lexsort((ids, -s)) if ids[m] != i][:k]
            out[i] = [(int(ids[m]), float(s[m])) for m in order]
    return out


def collect(df):
    got: dict = {}
    for r in sorted(rows_of(df), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    got = collect(neighbours.op5_nearest_neighbours(spark, folder))
    want = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))
    for q in want:
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in got[q] if i in exact) and len(got[q]) == 5


def test_ties_odd_vectors_and_small_tables(spark):
    rng = np.random.default_rng(41)
    same = rng.standard_normal(8).astype(float).tolist()
    rows = [(k, same) for k in range(40, 60)] + [(100, rng.standard_normal(8).tolist()), (0, [1.0] * 8), (150, [0.0] * 8), (200, None), (250, [1.0, None] + [1.0] * 6), (300, [float("nan")] * 8), (350, [float("inf")] + [0.0] * 7), (None, same), (7, [1.0, 2.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", score int, rank int")
    got = collect(neighbours.nearest(df, lambda v: v % 50 == 0))
    want = brute([r for r in rows if r[0] not in (7, 8)])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[50]] == [40, 41, 42, 43, 44]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0]), (1, [0.0, 1.0])], SCHEMA)
    assert {q: [i for i, _ in v] for q, v in collect(neighbours.nearest(few, lambda v: v % 50 == 0)).items()} == {0: [50, 1], 50: [0, 1]}
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), lambda v: v % 50 == 0).count() == 0


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(42)
    codes = rng.integers(0, 256, (300, neighbours.BITS // 8), dtype=np.uint8)
    codes[100:200] = codes[0]
    for k in range(100, 200):
        for b in rng.choice(neighbours.BITS, k % 40, replace=False):
            codes[k, b // 8] ^= 1 << (b % 8)
    index = neighbours.MultiIndex(codes)
    away = np.bitwise_count(codes ^ codes[0]).sum(1)
    for radius in (0, 3, 7, 8, 20, 39, 64, neighbours.BITS):
        assert np.flatnonzero(index.within(codes[:1], radius)[0]).tolist() == np.flatnonzero(away <= radius).tolist()


def test_extreme_magnitudes_take_part(spark):
    rng = np.random.default_rng(43)
    rows = [(k, (rng.standard_normal(8) * scale).tolist()) for k, scale in zip(range(40, 70), [1e200, 1e-200, 1.0, 1e-310, 1e300] * 6)]
    got = collect(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0))
    plain = [(i, v / np.abs(v).max()) for i, v in ((i, np.array(v)) for i, v in rows)]
    score = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    x = dict(plain)
    want = sorted(((score(x[50], v), i) for i, v in plain if i != 50), reverse=True)[:5]
    assert [i for i, _ in got[50]] == [i for _, i in want] and all(abs(s - w) < 1e-12 for (_, s), (w, _) in zip(got[50], want, strict=True))


def test_blocks_and_tiles_of_any_size_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(44)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(300)] + [(7, rng.standard_normal(6).tolist())] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows[:300] + rows[300:301])
    for least, tile in ((1, 1), (64, 100), (4096, 1 << 20)):
        monkeypatch.setattr(neighbours, "LEAST_ROWS", least)
        monkeypatch.setattr(neighbours, "TILE", tile)
        got = collect(neighbours.nearest(df, lambda v: v % 50 == 0))
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
        assert all(len(v) == 5 and len({i for i, _ in v}) == 5 for v in got.values())
