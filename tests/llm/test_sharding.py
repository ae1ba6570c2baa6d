import zlib

from gaugeworks.llm import sharding
from tests.llm.helpers import documents, rows_of


def test_balanced_contiguous_and_gapless(spark, sf):
    rows = rows_of(sharding.op3_sharding(spark, sf))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"}
    rows.sort(key=lambda r: r["doc_id"])
    sizes = [0] * 24
    slots: dict[int, list[int]] = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    assert all(s == list(range(len(s))) for s in slots.values())
    share = sum(sizes) / 24
    assert max(abs(s - share) for s in sizes) <= max(r["size"] for r in rows)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, None), (1, "a"), (1, "a"), (None, "b"), (None, None), (2, ""), (3, "x" * 100_000)]
    df = documents(spark, rows).selectExpr("*", "1 as part", "2 as shard", "3 as slot")
    got = rows_of(sharding.assign(df, 3))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign(documents(spark, [])).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = documents(spark, [(k, "t" * k) for k in range(50)])
    sharding.write_shards(df, f"file://{tmp_path}/s", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


def test_written_shards_keep_nulls_and_repeats(spark, tmp_path):
    rows = [(None, "n"), (None, "n"), (3, "a"), (3, "a"), (3, "b"), (4, None)]
    placed = sharding.write_shards(documents(spark, rows).selectExpr("*", "'x' as slot", "7 as other"), f"file://{tmp_path}/s", 2)
    back = rows_of(spark.read.parquet(f"file://{tmp_path}/s"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=key) == sorted(rows, key=key) and {r["other"] for r in back} == {7}
    assert sorted((r["shard"], r["slot"], r["text_crc32"]) for r in back) == sorted((r["shard"], r["slot"], r["text_crc32"]) for r in rows_of(placed))


def test_shards_against_plain_sums(spark, sf):
    """The shard of every row, computed anew from the sorted rows."""
    docs = sorted((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    total, before, want = sum(s for _, s, _ in docs), 0, {}
    for doc_id, size, _ in docs:
        want[doc_id] = min(23, (2 * before + size) * 24 // (2 * total))
        before += size
    assert {r["doc_id"]: r["shard"] for r in rows_of(sharding.op3_sharding(spark, sf))} == want
