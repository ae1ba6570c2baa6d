"""Best-fit packing of documents into sequences, after Martello and Toth's reduction.

Only lengths matter to a packing, and there are at most `capacity` different lengths, so the bins are
solved over a histogram: the driver gets at most `capacity` rows whatever the number of documents. The
result is a short list of patterns (lengths that share a sequence) with multiplicities; each piece then
finds its place by its rank among the pieces of its length.

Reduction (exact, by dominance): take the longest remaining piece j. If nothing fits beside it, or only
one more piece can, or a partner fills the rest exactly, or at most two more can and one partner k is at
least as long as the best pair of others, then {j, best partner} dominates every feasible set with j
and is fixed, for as many copies at once as both lengths have. The first j that no case settles is set
aside, and the next shorter one is tried as the instance of the pieces not yet fixed. What remains goes
by best-fit decreasing.

Cases: a null text counts as empty and is the end id alone; a document over the capacity is cut into
pieces of exactly the capacity, the last may be shorter; an empty table gives no rows; rows with the
same doc_id (or a null one) are packed each on its own; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm import tokens
from gaugeworks.llm.words import pieces, texts_of
from gaugeworks.llm.workspace import Workspace, tidy

CAPACITY = 2048
#: lengths that share a sequence, and how many sequences are alike
Pattern = tuple[tuple[int, ...], int]


class Histogram:
    """Counts by length, with the lengths present kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.count = {w: n for w, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def largest_within(self, room: int, besides: int = 0) -> int:
        """The longest length of at most `room`, a piece of length `besides` left out; 0 if none."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0:
            if self.sizes[i] != besides or self.count[besides] > 1:
                return self.sizes[i]
            i -= 1
        return 0

    def smallest_two(self, besides: int) -> list[int]:
        """The two shortest pieces when one of length `besides` is left out."""
        found: list[int] = []
        for size in self.sizes:
            found += [size] * min(2, self.count[size] - (size == besides))
            if len(found) >= 2:
                break
        return found[:2]

    def best_pair(self, room: int, besides: int) -> int:
        """The largest sum of two pieces that fits in `room`, one piece of `besides` left out; 0 if none."""
        lo, hi, best = 0, len(self.sizes) - 1, 0
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            enough = self.count[a] - (a == besides) >= 1 + (lo == hi) and self.count[b] - (b == besides) >= 1 + (lo == hi)
            if not enough and lo == hi:
                break
            if self.count[b] - (b == besides) < 1:
                hi -= 1
            elif self.count[a] - (a == besides) < 1:
                lo += 1
            elif a + b > room:
                hi -= 1
            else:
                best = max(best, a + b)
                if lo == hi:
                    break
                twice = 2 * b if self.count[b] - (b == besides) >= 2 else 0
                best = max(best, twice if twice <= room else 0)
                twice = 2 * a if self.count[a] - (a == besides) >= 2 else 0
                best = max(best, twice if twice <= room else 0)
                lo += 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some optimal packing holds, and what they leave."""
    left, fixed = Histogram(counts), []
    at = capacity
    while left.sizes:
        i = bisect.bisect_right(left.sizes, at) - 1
        if i < 0:
            break
        j = left.sizes[i]
        room = capacity - j
        small = left.smallest_two(j)
        partner = left.largest_within(room, j)
        if not partner:
            fixed.append(((j,), left.count[j] if not small or small[0] > room else 1))
            left.take(j, fixed[-1][1])
            continue
        alone = len(small) < 2 or small[0] + small[1] > room  # at most one more piece fits
        settled = alone or partner == room
        if not settled:
            third = _smallest_three(left, j)
            if third is None or third > room:  # at most two more fit
                settled = partner >= left.best_pair(room, j)
        if settled:
            n = left.count[j] // 2 if partner == j else min(left.count[j], left.count[partner])
            fixed.append(((j, partner), n))
            left.take(j, n)
            left.take(partner, n)
        else:
            at = j - 1
    return fixed, left.count


def _smallest_three(left: Histogram, besides: int) -> int | None:
    """Total of the three shortest other pieces, None if there are fewer."""
    found: list[int] = []
    for size in left.sizes:
        found += [size] * min(3, left.count[size] - (size == besides))
        if len(found) >= 3:
            return sum(found[:3])
    return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal bins and equal pieces are handled together."""
    open_: dict[int, list[list]] = {}  # room -> [[pattern, multiplicity]]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append([pattern, n])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                whole, rest = divmod(n, each)
                put(capacity - each * size, (size,) * each, whole)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[i]
            pattern, bins = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // size
            whole = min(bins, n // each)
            put(room - each * size, pattern + (size,) * each, whole)
            n, bins = n - whole * each, bins - whole
            if bins and n and n < each:
                put(room - n * size, pattern + (size,) * n, 1)
                n, bins = 0, bins - 1
            put(room, pattern, bins)
    return [(pattern, n) for group in open_.values() for pattern, n in group]


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer sequences."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(s)] for s in sizes], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for k in [0, *sizes[sizes <= capacity // 2].tolist()]:
        big, mid = sizes > capacity - k, (sizes <= capacity - k) & (sizes > capacity // 2)
        low = (sizes >= k) & (sizes <= capacity // 2)
        spare = int((n[mid] * capacity).sum() - (n[mid] * sizes[mid]).sum())
        best = max(best, int(n[big].sum() + n[mid].sum()) + max(0, -(-(int((n[low] * sizes[low]).sum()) - spare) // capacity)))
    return best


def places(patterns: list[Pattern]) -> pd.DataFrame:
    """For each slot of each pattern: the ranks (among pieces of that length) that it takes, the number of its
    first sequence and its offset there."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            first = taken.get(size, 0)
            rows.append((size, first, first + n, sequence, offset))
            taken[size] = first + n
            offset += size
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "sequence", "offset"]).astype("int64")


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, some in pieces(texts_of(batch.column("text"))):
                ids, offsets = encoder.encode(some)
                ids = np.insert(ids, offsets[1:], np.uint32(end_id)).astype("<u4")
                sizes = np.diff(offsets) + 1
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(some)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                length = np.minimum(capacity, sizes[doc] - piece * capacity)
                ends = np.cumsum(length)
                raw = memoryview(ids.tobytes())
                spans = list(zip(((ends - length) * 4).tolist(), (ends * 4).tolist(), strict=True))
                columns = {
                    "doc_id": doc_ids.take(pa.array(doc + at)).cast(pa.int64()),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(piece * capacity, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return cut


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the ids
    themselves (little-endian, 32 bits). Sequences are numbered from 0."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    cut = rows.mapInArrow(_cut(tokenizer or tokens.default_path(), end_id, capacity, with_ids), schema)
    # the written table fixes an order: part of the shuffle, then position in it
    cut = work.keep(cut.withColumn("at", F.monotonically_increasing_id()), "pieces")
    part = F.shiftright("at", 33)
    by_part = cut.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("part")
    before = by_part.withColumn("before", F.sum("n").over(w) - F.col("n")).select("length", "part", "before")
    ranked = (
        cut.withColumn("part", part)
        .withColumn("rank", F.row_number().over(Window.partitionBy("part", "length").orderBy("at")))
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("before") - 1)
    )
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = places(solve(counts, capacity))
    first = {size: (g.rank_from.to_numpy(), g.sequence.to_numpy(), g.offset.to_numpy()) for size, g in slots.groupby("length")}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(length)), np.int64)
        for size, where in pd.Series(np.arange(len(length))).groupby(length.to_numpy()):
            starts, sequence, offset = first[size]
            r = rank.to_numpy()[where]
            k = np.searchsorted(starts, r, "right") - 1
            out[0, where], out[1, where] = sequence[k] + r - starts[k], offset[k]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)]
    return ranked.withColumn("place", place("length", "rank")).select(*kept, "place.sequence_id", "place.offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
