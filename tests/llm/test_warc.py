import base64
import hashlib
import re

from pyspark.sql import functions as F

from gaugeworks.llm import warc
from tests.llm.helpers import rows_of

SCHEMA = "page_id long, url string, html string"
ROWS = [(5, "http://a/\r\nb", "same"), (2, "http://b/", "same"), (9, None, None), (8, "http://c/", ""), (3, "u", "ünï"), (None, "n", "same"), (2, "http://b/", "same"), (11, "x", "y" * 300_000)]


def test_against_brute_force(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows_of(warc.op2_warc(spark, str(tmp_path))))
    want = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        first = min(p for p, _, h in ROWS if (h or "") == (html or "") and p is not None)
        own = page == first
        want.append((page or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first))
    assert got == sorted(want, key=lambda r: r[:4])


def test_records_are_exact_and_payloads_stored_once(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame(ROWS, SCHEMA).withColumn("sha256", F.lit("clash")), f"file://{tmp_path}/w")
    assert archive.payloads.count() == len({h or "" for _, _, h in ROWS})
    parsed = [(parse(bytes(r["record"])), bytes(r["payload"])) for r in rows_of(warc.restore(archive))]
    ids = [fields["WARC-Record-ID"] for (fields, _), _ in parsed]
    assert len(set(ids)) == len(ROWS)
    for (fields, block), payload in parsed:
        assert block == (b"" if fields["WARC-Type"] == "revisit" else payload)
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["WARC-Type"] == "revisit":
            assert fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To"] in ids
    whole = b"".join(bytes(r["record"]) for r in rows_of(warc.restore(archive)))
    count = 0
    while whole:
        (_, block), size = parse(whole, more=True)
        whole, count = whole[size:], count + 1
    assert count == len(ROWS)


def parse(raw: bytes, more: bool = False):
    """Fields and block of the WARC 1.1 record at the beginning, by the letter of the format; more: records may follow, tell the size."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    assert end
    version, *lines = head.decode("utf-8").split("\r\n")
    assert version == "WARC/1.1"
    fields = {}
    for line in lines:
        name, colon, value = line.partition(": ")
        assert colon and re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) and name not in fields
        fields[name] = value
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
    assert re.fullmatch(r"<[a-z]+:[^<>\s]+>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
    length = int(fields["Content-Length"])
    block = rest[:length]
    assert len(block) == length and rest[length : length + 4] == b"\r\n\r\n" and (more or len(rest) == length + 4)
    assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    return ((fields, block), len(head) + 4 + length + 4) if more else (fields, block)


def test_page_ids_at_both_ends_and_small_payloads(spark, tmp_path):
    ends = [(2**63 - 1, "u", "a"), (-(2**63), "u", "a"), (None, "u", "a"), (None, "u", "b"), (0, "u", "long one"), (1, "u", "long one")]
    df = spark.createDataFrame(ends, SCHEMA)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r["page_id"] is None, r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in rows_of(warc.op2_warc(spark, str(tmp_path))))
    low = -(2**63)
    assert got == [((False, low), "response", None), ((False, 0), "response", None), ((False, 1), "revisit", 0), ((False, 2**63 - 1), "revisit", low), ((True, 0), "response", None), ((True, 0), "revisit", low)]
    restored = warc.restore(warc.write_archive(df, f"file://{tmp_path}/small", least_bytes=2))
    kinds = sorted((bytes(r["payload"]), parse(bytes(r["record"]))[0]["WARC-Type"]) for r in rows_of(restored))
    assert kinds == [(b"a", "response")] * 3 + [(b"b", "response")] + [(b"long one", "response"), (b"long one", "revisit")]


def test_hot_payload_is_salted_and_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_COPY", 3)
    df = spark.range(20).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("hot").alias("html"))
    restored = warc.restore(warc.write_archive(df, f"file://{tmp_path}/h"))
    assert restored.count() == 20 and restored.where("decode(payload, 'utf-8') = 'hot'").count() == 20
    assert warc.restore(warc.write_archive(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")).count() == 0
