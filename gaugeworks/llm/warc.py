"""A content-addressed WARC archive as two tables.

`payloads` holds each different payload once, under its SHA-256 and as a zstandard frame of its own;
`records` holds every record's exact header bytes and the digest of its payload. A record is its header,
an empty line, its block and two line ends; joining the tables gives every record back, byte for byte. The digest is verified twice:
on writing, payloads under one SHA-256 must agree in length and SHA-1; on reading, both digests of the
stored bytes are computed again.

Of records with equal payloads the one with the smallest page_id is the response; the others are revisit
records, whose block is empty (its digest and length are the block's, the payload digest is the payload's) and whose
header names the response. Rows that repeat that page_id with the same payload are responses too. With
`least_bytes`, smaller payloads are all responses.

A record's id is `urn:page:`, the page_id (or none) and the row's number in the input, so that no two records share
one. The capture time is not in the input: WARC-Date is a parameter, the same for all records.

A popular payload may be a third of all records: a task compresses it once, it is stored once, and read back over as
many salted copies as its number of records asks for.

Cases: a null html is an empty payload; a null url is an empty target; rows with null page_id are
records of their own, after all others in the order; any 64-bit page_id is kept; an empty table gives an empty archive;
line ends in a url are percent-encoded, as a header line can't hold them; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.workspace import Workspace, tidy

#: Records that share a salted copy of their payload when read back.
RECORDS_PER_COPY = 1000
#: Digests of payloads that a task remembers to have compressed.
REMEMBERED = 200_000
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC-Date of records whose capture time is unknown.
UNDATED = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    records: DataFrame
    payloads: DataFrame


@tidy
def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload of a partition as a zstandard frame, the first time that it comes."""
    zstd, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        digests, fresh = batch.column("sha256").to_pylist(), []
        for k, digest in enumerate(digests):
            if digest not in seen:
                seen.add(digest)
                fresh.append(k)
        if len(seen) > REMEMBERED:
            seen.clear()
        payloads = batch.column("payload")
        yield pa.RecordBatch.from_pydict({"sha256": pa.array([digests[k] for k in fresh], pa.string()), "frame": pa.array([zstd.compress(payloads[k].as_buffer()) for k in fresh], pa.binary())})


@F.pandas_udf(T.BinaryType())
def unpacked(frame: pd.Series) -> pd.Series:
    zstd = zstandard.ZstdDecompressor()
    return frame.map(zstd.decompress)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 8 groups of 20, each 5 hexadecimal or 4 base-32 digits."""
    hexa = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uri(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))


def header(record: Column, date: str) -> Column:
    """The exact header, as text, of a record: a struct of page, row, url, kind, first (page and row), sha1, sha256, length."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    revisit = record["kind"] == "revisit"
    block_sha256 = F.when(revisit, F.sha2(F.encode(F.lit(""), "utf-8"), 256)).otherwise(record["sha256"])
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", record["kind"]),
        line("WARC-Record-ID", record_uri(record["page"], record["row"])),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace(F.replace(record["url"], F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), record["sha1"])),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), block_sha256)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_uri(record["first"]["page"], record["first"]["row"])))).otherwise(""),
        F.lit(f"Content-Type: text/html; charset=utf-8{EOL}"),
        line("Content-Length", F.when(revisit, "0").otherwise(record["length"].cast("string"))),
    )


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = UNDATED) -> Archive:
    """Write the two tables below folder."""
    spark = pages.sparkSession
    work = Workspace(spark, "warc-scratch")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    light = rows.select("page", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("length"), F.monotonically_increasing_id().alias("row"))
    light = work.keep(light, "light")
    known = light.groupBy("sha256").agg(
        F.min(F.struct(F.col("page").isNull().alias("unnamed"), "page", "row")).alias("first"), F.count("*").alias("holders"), F.min("sha1").alias("sha1_"), F.max("sha1").alias("sha1_max"), F.min("length").alias("length_"), F.max("length").alias("length_max")
    )
    agree = (F.col("sha1_") == F.col("sha1_max")) & (F.col("length_") == F.col("length_max"))
    # written, so that the planner can split the records of a payload that very many share
    known = work.keep(known.select("sha256", F.when(agree, F.col("first")).otherwise(F.raise_error(F.lit("two payloads under one SHA-256"))).alias("first"), "holders"), "known")
    own = (F.col("page") == F.col("first.page")) | (F.col("row") == F.col("first.row")) | (F.col("length") < least_bytes)
    records = light.join(known, "sha256").withColumn("kind", F.when(own, "response").otherwise("revisit"))
    record = F.struct("page", "row", "url", "kind", "first", "sha1", "sha256", "length")
    records.select(F.encode(header(record, date), "utf-8").alias("header"), "sha256", "holders", F.xxhash64("row").alias("spread")).write.mode("overwrite").parquet(f"{folder}/records")
    once = rows.select("sha256", "payload").mapInArrow(_frames, "sha256 string, frame binary").dropDuplicates(["sha256"])  # equal bytes, as just verified
    once.join(known.select("sha256", "holders"), "sha256").write.mode("overwrite").parquet(f"{folder}/payloads")
    work.remove()
    return read_archive(spark, folder)


def read_archive(spark: SparkSession, folder: str) -> Archive:
    return Archive(
        spark.read.schema("header binary, sha256 string, holders long, spread long").parquet(f"{folder}/records"),
        spark.read.schema("sha256 string, frame binary, holders long").parquet(f"{folder}/payloads"),
    )


def restore(archive: Archive) -> DataFrame:
    """Every record: header (text), payload (verified bytes) and record (the exact WARC bytes)."""
    copies = F.ceil(F.col("holders") / RECORDS_PER_COPY)
    payloads = archive.payloads.select("sha256", "frame", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"))
    records = archive.records.select("header", "sha256", F.pmod("spread", copies).alias("salt"))
    joined = records.join(payloads, ["sha256", "salt"]).select("header", "sha256", unpacked("frame").alias("payload"))
    right = F.sha2("payload", 256) == F.col("sha256")
    joined = joined.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest"))))
    text = F.decode("header", "utf-8")
    block = F.when(field(text, "WARC-Type") == "revisit", F.encode(F.lit(""), "utf-8")).otherwise(F.col("payload"))
    ends = F.encode(F.lit(EOL), "utf-8")
    return joined.select(text.alias("header"), "payload", F.concat("header", ends, block, ends, ends).alias("record"))


def field(header_text: Column, name: str) -> Column:
    """The value of a header field, null if absent."""
    value = F.regexp_extract(header_text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def page_of(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^<urn:page:(-?\d+):\d+>$", 1).try_cast("long")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = Workspace(spark, "warc").root
    restored = restore(write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder))
    return restored.select(
        page_of(field(F.col("header"), "WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field(F.col("header"), "WARC-Type").alias("record_type"),
        page_of(field(F.col("header"), "WARC-Refers-To")).alias("refers_to"),
    )


_GROUP = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
SELECT p.page_id, strlen(p.payload)::BIGINT AS payload_bytes, {_GROUP} AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM p JOIN f USING (payload)
"""
