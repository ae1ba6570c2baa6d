"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are dealt to ranges of the order and sorted within; each range's totals (one small row for each
partition) give the sums before it, so a row's global prefix sum is a running sum within its range plus
a constant. A row goes to the shard in whose equal share of all bytes its middle byte lies, so every
shard is a stretch of the order and differs from the share by less than the largest row.

Only keys and sizes are shuffled, never texts. A third of all rows under one doc_id still spreads over
ranges, as size, checksum and a hash of the text break ties.

Cases: a null text has no bytes (its size is the overhead alone, its checksum that of no bytes); null
doc_ids come first; equal rows keep places next to each other, in any order; an empty table gives no
rows; with fewer rows than shards some shards stay empty; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.workspace import Workspace

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 8


PLACED = ("size", "text_crc32", "shard", "slot")


def sized(docs: DataFrame, overhead: int = ROW_OVERHEAD, whole: bool = False) -> DataFrame:
    """doc_id, size and text_crc32 of each row, with a tie-break; whole: and the row itself, as a struct."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("tie"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * whole),
    )


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = ROW_OVERHEAD, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (the row's place in its shard, from 0); whole: and row."""
    work = Workspace(docs.sparkSession, "sharding")
    order = ["doc_id", "size", "text_crc32", "tie"]
    dealt = sized(docs, overhead, whole).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = work.keep(dealt, "ranges")  # the deal is fixed before its totals are taken
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before, bytes_, rows = [], 0, 0
    for t in sorted(totals.collect()):  # one row for each partition
        before.append((t["part"], bytes_, rows))
        bytes_, rows = bytes_ + t["bytes"], rows + t["rows"]
    offsets = docs.sparkSession.createDataFrame(before, "part int, bytes_before long, rows_before long")
    in_part = Window.partitionBy("part").orderBy(*order)
    running = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # twice the bytes before the row's middle, in shares of the total: whole numbers up to 2 * shards * total
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(running)) - F.col("size")
    placed = dealt.join(F.broadcast(offsets), "part").select(
        "part",
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2 * max(bytes_, 1)))).cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(in_part) - 1).alias("place"),
        *(["row"] * whole),
    )
    placed = work.keep(placed, "placed")
    work.drop("ranges")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), *(["row"] * whole))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Write whole rows below folder/shard=k in slot order; return the assignment. A row is carried through the deal, so
    null and repeated doc_ids are kept as they are. Columns of docs that are named as the assignment's own are left out."""
    placed = assign(docs, shards, whole=True)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in PLACED]
    rows = placed.select(*own, *PLACED)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(folder)
    return placed.drop("row")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `bytes`."""
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
