"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit check.

Items are classed by length: class (m, s) has windows of m words at every s-th word of a document, with m
from 3, 6, 12, 24 and s = m / 3, and takes the items of at least m + s - 1 words (fewer than the next class; the last
takes all longer ones, which hold several windows), so any place where an item stands whole holds a window. Every window of an item, at every word, is embedded
too, so a document's window meets the item's window that begins at the same word. Items of 1 and 2 words have classes
of their own (m = 1, 2 at every word), which are used if `shortest` asks for them: no edit is allowed there.

The CGK random walk maps word edit distance to Hamming distance: at step t it emits the word under the
cursor and moves on or stays by a random bit of (t, word). After an edit the two walks tend to fall in step
again. A walk of 3 m / 2 steps passes about 3 m / 4 words; past its window it goes on in the text or item, then in padding. An LSH key is a sample of SAMPLED coordinates of the embedding; REPETITIONS walks with independent bits
and samples reach the recall that `expected_recall` measures. Keys of items, and of half their coordinates, go into a Bloom
filter of fixed size that spares most windows the second half of the walk and the shuffle; the rest are joined on the key, and each candidate is aligned:
a hit is an item whose edit distance (in words) to some part of the document is at most MAX_EDITS of its length.

Equal items (the same words) are one item, under the smallest item_id. A popular item costs a few rows for
each document that holds it, never pairs of documents.

Cases: items of fewer than `shortest` words (3: shorter ones are no evidence) match nothing, nor do items without a word; null texts are empty; documents
with a null doc_id, items with a null item_id can't be named and take no part; rows that repeat a doc_id are
searched each and reported under it; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bloom
from gaugeworks.llm.words import U, mix, pieces, ranges, texts_of, words
from gaugeworks.llm.workspace import Workspace, tidy

MAX_EDITS = 0.2
REPETITIONS, SAMPLED = 20, 4
SMALLEST, WIDEST = 3, 24
SEED = 7
PAD = U(0x5DEECE66D)
#: Words of padding after each text: no walk is longer.
PADDING = 3 * WIDEST // 2


def window_class(n: int, shortest: int = SMALLEST) -> tuple[int, int] | None:
    """(m, s) of an item of n words."""
    if n < max(shortest, 1):
        return None
    m, found = SMALLEST, (n, 1) if n < SMALLEST else None
    while m <= WIDEST and n >= m + max(1, m // 3) - 1:
        found, m = (m, max(1, m // 3)), m * 2
    return found


def longest_item(m: int) -> float:
    """Most words of an item in class m."""
    return math.inf if m == WIDEST else m if m < SMALLEST else 2 * m + max(1, 2 * m // 3) - 2


def walk_plan(m: int, repetition: int) -> tuple[np.ndarray, list[int]]:
    """Odd multipliers of each step (their product's top bit, of 32, moves the cursor) and the sampled coordinates."""
    rng = np.random.default_rng([SEED, m, repetition])
    steps = max(SAMPLED, 3 * m // 2)
    # one coordinate from each of equal stretches: neighbouring ones often hold the same word
    sampled = [int(rng.integers(steps * k // SAMPLED, steps * (k + 1) // SAMPLED)) for k in range(SAMPLED)]
    return rng.integers(0, 2**31, sampled[-1] + 1, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), sampled


def padded(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with PADDING behind each, their low halves, and where each text begins."""
    begins = offsets[:-1] + PADDING * np.arange(len(offsets) - 1)
    out = np.full(len(hashes) + PADDING * (len(offsets) - 1), PAD)
    out[ranges(begins, np.diff(offsets))] = hashes
    return out, out.astype(np.uint32), begins


def walk(text: np.ndarray, halves: np.ndarray, starts: np.ndarray, m: int, repetition: int, known: bloom.Bloom | None = None, half: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows that begin at these places of padded texts, and their LSH keys. With known, those go on past half of
    their coordinates whose key so far may be known; half: keys of that half."""
    multipliers, sampled = walk_plan(m, repetition)
    at = starts.astype(np.int32) if len(text) < 1 << 31 else starts.copy()
    with np.errstate(over="ignore"):
        key, which = np.full(len(starts), mix(np.array([m * 1000 + repetition], U))[0]), np.arange(len(starts))
        for t, c in enumerate(multipliers):
            if t in sampled:
                key = mix(key * U(0x9E3779B97F4A7C15) + text[at])
            if t == sampled[SAMPLED // 2 - 1] and (half or known is not None):
                if half:
                    break
                which = np.flatnonzero(known.has(key))
                key, at = key[which], at[which]
            if t < sampled[-1]:
                word = halves[at]
                word *= c
                word >>= np.uint32(31)
                at += word.view(np.int32) if at.dtype == np.int32 else word
    return which, key


def keys_of(text: np.ndarray, halves: np.ndarray, starts: np.ndarray, m: int, repetition: int) -> np.ndarray:
    """The LSH key of each window."""
    return walk(text, halves, starts, m, repetition)[1]


def _item_keys(shortest: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item_ids = batch.column("item_id").cast(pa.int64())
            for at, some in pieces(texts_of(batch.column("text"))):
                hashes, _, _, offsets = words(some)
                text, halves, begins = padded(hashes, offsets)
                count = np.diff(offsets)
                classes = [window_class(int(n), shortest) for n in count]
                for m in sorted({c[0] for c in classes if c}):
                    own = np.flatnonzero([c is not None and c[0] == m for c in classes])
                    starts = ranges(np.zeros(len(own), np.int64), count[own] - m + 1)
                    item = np.repeat(own, count[own] - m + 1)
                    for r, half in itertools.product(range(REPETITIONS), (False, True)):
                        _, key = walk(text, halves, begins[item] + starts, m, r, half=half)
                        yield pa.RecordBatch.from_pydict({"half": pa.array(np.full(len(item), half)), "key": key.view(np.int64), "item_id": item_ids.take(pa.array(item + at)), "size": pa.array(np.full(len(item), m), pa.int32()), "start": pa.array(starts, pa.int32())})

    return run


@tidy
def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item_ids = batch.column("item_id").cast(pa.int64())
        for at, some in pieces(texts_of(batch.column("text"))):
            hashes, _, _, offsets = words(some)
            own = [hashes[offsets[k] : offsets[k + 1]].tobytes() for k in range(len(some))]
            yield pa.RecordBatch.from_pydict({"item_id": item_ids.slice(at, len(some)), "item": pa.array(own, pa.binary())})


def _windows(sizes: list[int], most: int, bits):
    """most: words of the longest item. Windows whose key may be an item's: doc_id, size, start, from (first word of context), context, keys."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.Bloom(bits.value)
        for batch in batches:
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for at, some in pieces(texts_of(batch.column("text"))):
                hashes, _, _, offsets = words(some)
                text, halves, begins = padded(hashes, offsets)
                count = np.diff(offsets)
                for m in sizes:
                    s = max(1, m // 3)
                    many = np.maximum(-(-(count - (m + 1) // 2 + 1) // s), 0)  # the last ones may be half outside
                    doc = np.repeat(np.arange(len(some)), many)
                    starts = ranges(np.zeros(len(many), np.int64), many) * s
                    places = begins[doc] + starts
                    starts += offsets[:-1][doc]
                    hit_at, hit_key = [], []
                    for r in range(REPETITIONS):
                        which, key = walk(text, halves, places, m, r, known)
                        hits = known.has(key)
                        hit_at.append(which[hits])
                        hit_key.append(key[hits])
                    where, got = np.concatenate(hit_at), np.concatenate(hit_key)
                    if not len(where):
                        continue
                    order = np.argsort(where, kind="stable")
                    where, got = where[order], got[order]
                    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                    window = where[first]
                    longest = int(min(longest_item(m), most))
                    slack = math.ceil(MAX_EDITS * longest) + 1
                    lo = np.maximum(starts[window] - (longest - m) - slack, offsets[:-1][doc[window]])
                    hi = np.minimum(starts[window] + longest + slack, offsets[1:][doc[window]])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": doc_ids.take(pa.array(doc[window] + at)),
                            "size": pa.array(np.full(len(window), m), pa.int32()),
                            "start": pa.array(starts[window] - offsets[:-1][doc[window]], pa.int64()),
                            "from": pa.array(lo - offsets[:-1][doc[window]], pa.int64()),
                            "context": pa.array([hashes[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()),
                            "keys": pa.ListArray.from_arrays(pa.array(np.append(first, len(where)), pa.int32()), pa.array(got.view(np.int64))),
                        }
                    )

    return run


def _stack(rows: list[np.ndarray], filler: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), U(filler))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def align(items: list[np.ndarray], contexts: list[np.ndarray], anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits that turn an item into some part of its context, and that part's end (the first best). anchored:
    the part begins with the context. All pairs go through one table, a row of it for each word of the items."""
    item, context = _stack(items, 1), _stack(contexts, 2)
    lengths, limits = np.array([len(x) for x in items]), np.array([len(x) for x in contexts])
    columns = np.arange(context.shape[1] + 1)
    row = np.tile(columns if anchored else np.zeros_like(columns), (len(items), 1)).astype(np.int32)
    final = np.zeros_like(row)
    final[lengths == 0] = row[lengths == 0]
    for i in range(item.shape[1]):
        cost = (context != item[:, i : i + 1]).astype(np.int32)
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + cost, out=new[:, 1:])
        row = np.minimum.accumulate(new - columns, axis=1) + columns
        done = lengths == i + 1
        final[done] = row[done]
    final = np.where(columns <= limits[:, None], final, np.iinfo(np.int32).max)
    end = final.argmin(1)
    return final[np.arange(len(items)), end], end


def missing(items: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    """How many words of each item its context doesn't hold: no alignment has fewer edits."""
    keys = []
    for rows in (items, contexts):
        which = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        with np.errstate(over="ignore"):
            keys.append((which, np.concatenate(rows) + which.astype(U) * U(0x9E3779B97F4A7C15)))
    return np.bincount(keys[0][0][~np.isin(keys[0][1], keys[1][1])], minlength=len(items))


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            items = [np.frombuffer(x.as_buffer(), U) for x in some.column("item")]
            contexts = [np.frombuffer(x.as_buffer(), U) for x in some.column("context")]
            likely = np.flatnonzero(missing(items, contexts) <= MAX_EDITS * np.array([len(x) for x in items]))
            if not len(likely):
                continue
            some, items, contexts = some.take(pa.array(likely)), [items[k] for k in likely], [contexts[k] for k in likely]
            edits, ends = align(items, contexts)
            ok = np.flatnonzero(edits <= MAX_EDITS * np.array([len(x) for x in items]))
            if not len(ok):
                continue
            _, back = align([items[k][::-1] for k in ok], [contexts[k][: ends[k]][::-1] for k in ok], anchored=True)
            first = some.column("from").to_numpy()[ok]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": some.column("doc_id").take(pa.array(ok)),
                    "item_id": some.column("item_id").take(pa.array(ok)),
                    "first_word": pa.array(first + ends[ok] - back, pa.int64()),
                    "end_word": pa.array(first + ends[ok], pa.int64()),
                    "edits": pa.array(edits[ok], pa.int64()),
                    "item_words": pa.array([len(items[k]) for k in ok], pa.int64()),
                }
            )


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SMALLEST) -> DataFrame:
    """doc_id, item_id, first_word, end_word, edits, item_words: the closest place of each item in each document that holds it."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "decontamination")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    own = work.keep(items.mapInArrow(_item_words, "item_id long, item binary").groupBy("item").agg(F.min("item_id").alias("item_id")), "items")
    keys = work.keep(items.join(own.select("item_id"), "item_id").dropDuplicates(["item_id"]).mapInArrow(_item_keys(shortest), "half boolean, key long, item_id long, size int, start int"), "keys")
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())  # one for each power of two of the lengths
    most = own.agg(F.max(F.length("item"))).first()[0] or 0
    bits = spark.sparkContext.broadcast(bloom.build(keys, "key").bits)  # 4 MB
    keys = keys.where("not half")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_windows(sizes, most // 8, bits), "doc_id long, size int, start long, from long, context binary, keys array<long>")
    found = work.keep(found, "windows")
    bits.destroy()
    hits = found.select("doc_id", "size", "start", F.explode("keys").alias("key")).join(keys.select("key", "item_id", F.col("start").alias("item_start")), "key")
    # one candidate for each place: windows of the same stretch say the same
    place = F.floor((F.col("start") - F.col("item_start")) / F.greatest(F.col("size"), F.lit(1)))
    places = hits.groupBy("doc_id", "item_id", "size", place.alias("place")).agg(F.min("start").alias("start"))
    candidates = places.join(found.drop("keys"), ["doc_id", "size", "start"]).select("doc_id", "item_id", "from", "context")
    checked = candidates.join(own, "item_id").mapInArrow(_verify, "doc_id long, item_id long, first_word long, end_word long, edits long, item_words long")
    best = checked.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word", "end_word", "item_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.first_word", "best.end_word", "best.edits", "best.item_words")


def expected_recall(items: list[np.ndarray], edits: float, trials: int = 20, seed: int = 0) -> float:
    """Share of randomly edited copies of the items, at random places of a text, that share a key with their item."""
    rng = np.random.default_rng(seed)
    found = total = 0
    for item in items:
        if not (c := window_class(len(item))):
            continue
        m, s = c
        starts = np.arange(len(item) - m + 1)
        text, halves, _ = padded(item, np.array([0, len(item)]))
        own = [set(keys_of(text, halves, starts, m, r).tolist()) for r in range(REPETITIONS)]
        for _ in range(trials):
            copy = item.tolist()
            for _ in range(int(edits * len(item))):
                at, kind = int(rng.integers(0, len(copy))), int(rng.integers(0, 3))
                fresh = int(rng.integers(1, 2**62))
                copy[at : at + (kind != 2)] = [fresh] if kind != 1 else []
            around = [rng.integers(1, 2**62, int(rng.integers(0, 3 * s + 1)) + 40) for _ in range(2)]
            text = np.concatenate([around[0], np.array(copy, np.int64), around[1]]).astype(U)
            places = np.arange(0, len(text), s)
            text, halves, _ = padded(text, np.array([0, len(text)]))
            found += any(not own[r].isdisjoint(keys_of(text, halves, places, m, r).tolist()) for r in range(REPETITIONS))
            total += 1
    return found / max(total, 1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched for all benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
