"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Fit, on a bounded sample (SAMPLE rows, by a hash of vec_id): principal directions of the normalised vectors and, for
each ROTATION_BITS bits of code, a rotation learnt by iterative quantisation (each sign step followed by the orthogonal
Procrustes solution). A code is the signs of the rotated vector, BITS bits.

Index: rows lie in blocks of at most BLOCK_ROWS or so, each row in one; a block splits its codes into SUBSTRINGS
substrings, each with its own table from value to rows. Rows move once. Queries go to every block, as any block may
hold a code within the radius, and stream past it a batch at a time, so memory is bounded by a block.

Search radius: the true neighbours, among all rows, of CALIBRATION sampled queries are found by brute force once; the
radius is the smallest that holds COVERED of them. By the pigeonhole principle a code within radius r = m a + b of the
query agrees to within a bits in one of the first b + 1 of the m substrings or to within a - 1 bits in one of the
others: those buckets are probed (by flipping bits, or by going through the values present where these are fewer), so every
code within the radius is found, none is missed. What is within the radius is ranked by the exact cosine in double
precision, and a block returns k rows for a query at most. Queries with fewer than k rows within the radius are
searched again without one.

Cosines: a vector is scaled by the power of two of its largest component first, which is exact, so no square over- or
underflows that matters.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows with a null vec_id; a query's own row (and rows that repeat its vec_id) is no candidate; repeated candidates with
one vec_id count once; ties go to the smaller vec_id; with fewer candidates than k, all are returned; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.words import U
from gaugeworks.llm.workspace import Workspace, tidy

NEIGHBOURS, EVERY = 5, 50
SAMPLE, CALIBRATION, COVERED = 20_000, 256, 0.98
#: Bytes of vectors in the sample at most: long vectors give fewer rows.
SAMPLE_BYTES = 1 << 26
BITS, ROTATION_BITS, SUBSTRING_BITS = 128, 64, 16
SUBSTRINGS = BITS // SUBSTRING_BITS
ITERATIONS = 30
#: Rows of a block of the index; fewer where that keeps all tasks busy, but LEAST_ROWS.
BLOCK_ROWS, LEAST_ROWS = 1 << 16, 1 << 11
#: Pairs of queries and rows that are looked at a time, and pairs whose cosines are.
TILE, PAIRS = 1 << 20, 1 << 14
#: Cosines that differ by less are compared in one fixed order of operations.
CLOSE = 1e-9


class Codes:
    """Learnt rotations; codes of vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = x.mean(0)
        x = x - self.mean
        _, directions = np.linalg.eigh(x.T @ x)
        width = min(ROTATION_BITS, x.shape[1])
        self.directions = directions[:, ::-1][:, :width]
        v = x @ self.directions
        rng = np.random.default_rng(seed)
        self.rotations = []
        for _ in range(-(-BITS // width)):
            r, _ = np.linalg.qr(rng.standard_normal((width, width)))
            for _ in range(ITERATIONS):
                left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (left @ right).T
            self.rotations.append(r)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of BITS / 8 bytes."""
        v = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.mean) @ self.directions
        bits = np.hstack([v @ r >= 0 for r in self.rotations])[:, :BITS]
        return np.packbits(bits, axis=1, bitorder="little")


def substring_radii(radius: int) -> list[int]:
    """How far each substring is probed; -1: not at all."""
    a, b = divmod(radius, SUBSTRINGS)
    return [min(a, SUBSTRING_BITS) if k <= b else a - 1 for k in range(SUBSTRINGS)]


class MultiIndex:
    """Tables from substring value to rows, of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(U)
        parts = np.ascontiguousarray(codes).view(np.uint16)
        self.tables = [np.unique(parts[:, k], return_inverse=True) for k in range(SUBSTRINGS)]

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """Bits between each of these codes and each row."""
        words = np.ascontiguousarray(codes).view(U)
        return sum(np.bitwise_count(words[:, k, None] ^ self.words[:, k]).astype(np.int16) for k in range(words.shape[1]))

    def within(self, codes: np.ndarray, radius: int) -> np.ndarray:
        """Which rows have a code at most `radius` bits away, for each of these codes."""
        parts = np.ascontiguousarray(codes).view(np.uint16)
        found = np.zeros((len(codes), len(self.words)), bool)
        for k, most in enumerate(substring_radii(radius)):
            if most >= 0:
                values, bucket = self.tables[k]
                found |= np.take(self.probe(values, parts[:, k], most), bucket, axis=1)
        return found & (self.distances(codes) <= radius)

    @staticmethod
    def probe(values: np.ndarray, parts: np.ndarray, most: int) -> np.ndarray:
        """Which of the values present are at most `most` bits from each query's substring."""
        if sum(math.comb(SUBSTRING_BITS, i) for i in range(most + 1)) * 4 >= len(values):
            return np.bitwise_count(parts[:, None] ^ values) <= most
        probes = parts[:, None] ^ flip_masks(most)
        at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
        query, hit = np.nonzero(values[at] == probes)
        near = np.zeros((len(parts), len(values)), bool)
        near[query, at[query, hit]] = True
        return near


_MASKS: dict[int, np.ndarray] = {}


def flip_masks(most: int) -> np.ndarray:
    """All substrings with at most `most` bits set."""
    if most not in _MASKS:
        _MASKS[most] = np.array([sum(1 << i for i in c) for n in range(most + 1) for c in itertools.combinations(range(SUBSTRING_BITS), n)], np.uint16)
    return _MASKS[most]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component is about 1."""
    _, exponent = np.frexp(np.abs(vectors).max(1))
    return np.ldexp(vectors, -exponent[:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in the same order of operations, so equal vectors have equal scores."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _parse(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """vec_ids and vectors (double, scaled) of the rows that take part."""
    for batch in batches:
        ids, vectors = batch.column("vec_id"), batch.column("embedding")
        ok = pc.and_(ids.is_valid(), vectors.is_valid())
        ids, vectors = ids.filter(ok), vectors.filter(ok)
        values = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, length)
        with np.errstate(invalid="ignore"):
            good = np.isfinite(values).all(1) & (values != 0).any(1)
        yield ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), scaled(values[good]) if good.any() else np.zeros((0, length))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of an array as a binary value."""
    raw = np.ascontiguousarray(rows)
    width = raw.itemsize * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * width), pa.py_buffer(raw)])


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    """Binary values of `width` items each, as the rows of an array."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(kind).reshape(-1, width)


def _encode(length: int, codes):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _parse(batches, length):
            if len(ids):
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "x": _binary(vectors), "code": _binary(codes.value.of(vectors))})

    return run


FOUND = "query_id long, vec_id long, score double, bits long"


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, repeated: bool) -> np.ndarray:
    """Which pairs are among their query's k best, a repeated vec_id counted once."""
    some = np.arange(len(query))
    if repeated:
        some = np.lexsort((-scores, ids, query))
        some = some[np.concatenate([[True], (query[some][1:] != query[some][:-1]) | (ids[some][1:] != ids[some][:-1])])]
    order = some[np.lexsort((ids[some], -scores[some], query[some]))]
    fresh = np.flatnonzero(np.concatenate([[True], query[order][1:] != query[order][:-1]]))
    rank = np.arange(len(order)) - np.repeat(fresh, np.diff(np.append(fresh, len(order))))
    return order[rank < k]


def _search(length: int, radius: int, k: int):
    """Sorted by block, rows (kind 0) before queries (kind 1): the k nearest rows of the block (within the radius, if it is not
    negative) for each query. The block's rows are held, its queries stream by."""

    def search(ids, x, index: MultiIndex, query_ids, query_x, query_code) -> Iterator[pa.RecordBatch]:
        tile, repeated = max(1, TILE // len(ids)), len(np.unique(ids)) < len(ids)
        unit = lambda v: v / np.sqrt((v * v).sum(1, keepdims=True))
        unit_x = unit(x)
        for at in range(0, len(query_ids), tile):
            some = slice(at, at + tile)
            hit = index.within(query_code[some], radius) if radius >= 0 else np.ones((len(query_ids[some]), len(ids)), bool)
            hit &= ids != query_ids[some][:, None]
            if not repeated and len(ids) > k:
                # a matrix product tells which can be among the k best, to more digits than its rounding
                about = np.where(hit, unit(query_x[some]) @ unit_x.T, -2.0)
                hit &= about >= np.partition(about, len(ids) - k, axis=1)[:, len(ids) - k, None] - CLOSE
            query, row = np.nonzero(hit)
            if not len(query):
                continue
            scores = np.concatenate([cosines(x[row[j : j + PAIRS]], query_x[some][query[j : j + PAIRS]]) for j in range(0, len(row), PAIRS)])
            best = best_of(query, ids[row], scores, k, repeated)
            query, row = query[best], row[best]
            bits = np.bitwise_count(index.words[row] ^ np.ascontiguousarray(query_code[some]).view(U)[query]).sum(1)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(query_ids[some][query]), "vec_id": pa.array(ids[row]), "score": pa.array(scores[best]), "bits": pa.array(bits.astype(np.int64))})

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("block", "kind", "id")] + [_rows(batch.column("x"), float, length), _rows(batch.column("code"), np.uint8, BITS // 8)]
            cut = np.flatnonzero(np.diff(columns[0] * 2 + columns[1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                own, kind, ids, x, code = (c[lo:hi] for c in columns)
                if own[0] != block:
                    block, held, index = own[0], [], None
                if kind[0] == 0:
                    held.append((ids, x, code))
                elif held:
                    if index is None:
                        all_ids, all_x, all_code = (np.concatenate(c) for c in zip(*held, strict=True))
                        index = MultiIndex(all_code)
                        held = [(all_ids, all_x, all_code)]
                    yield from search(all_ids, all_x, index, ids, x, code)

    return run


def _meet(index: DataFrame, queries: DataFrame, rows: int, length: int, radius: int, k: int) -> DataFrame:
    """Every query against every block of rows, then each query's k nearest of what the blocks found."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-rows // BLOCK_ROWS), min(tasks, -(-rows // LEAST_ROWS)), 1)
    own = index.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "x", "code")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "x", "code")
    dealt = own.unionByName(asked).repartition(max(blocks, tasks), "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(_search(length, radius, k), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("bits").alias("bits"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, is_query, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row where is_query (a Column of vec_id) holds."""
    spark, work = embeddings.sparkSession, Workspace(embeddings.sparkSession, "neighbours")
    out = "query_id long, rank int, vec_id long, score double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and size(embedding) > 0")
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.col("count").desc(), "length").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], out)
    length = lengths[0]["length"]
    rows = rows.where(F.size("embedding") == length)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * length)))).toArrow()
    sample = [v for _, v in _parse(taken.to_batches(), length)]
    sample = np.concatenate(sample) if sample else np.zeros((0, length))
    if not len(sample):
        return spark.createDataFrame([], out)
    codes = spark.sparkContext.broadcast(Codes(sample))  # matrices of fixed size
    index = work.keep(rows.mapInArrow(_encode(length, codes), "vec_id long, x binary, code binary"), "index")
    codes.destroy()
    total = index.count()
    as_queries = lambda df: df.select(F.col("vec_id").alias("query_id"), "x", "code").dropDuplicates(["query_id"])
    some = as_queries(index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION))
    away = [r["bits"] for r in _meet(index, some, total, length, -1, k).select("bits").collect()]  # k for each calibration query
    radius = int(np.quantile(away, COVERED, method="higher")) if away else BITS
    queries = work.keep(as_queries(index.where(is_query(F.col("vec_id")))), "queries")
    found = work.keep(_meet(index, queries, total, length, radius, k), "found")
    short = queries.join(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")
    short = work.keep(short, "short")
    if not short.isEmpty():
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(_meet(index, short, total, length, -1, k))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows by cosine of every embedding whose vec_id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % EVERY == 0)
