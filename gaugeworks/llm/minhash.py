"""Near duplicates by BagMinHash: weighted Jaccard similarity of word 5-shingle multisets.

Signature. A shingle that occurs w times covers the weights (0, w], discretised to whole numbers. Over the
weights runs a Poisson process of points (time, weight, component), hashed from the shingle and so the same
in every document; a document sees the points below its weight, and component i of its signature is the
earliest point seen there. Two documents agree in a component with probability sum(min) / sum(max) of their
counts. Weights are a hierarchy of intervals (0,1], (1,2], (2,4], (4,8] ..., each with a process of its own
at a rate of its length: intervals wholly below the count count in full, in the last one the points are thinned
by their place. Points come in order of time, and a document stops at a time by which all components are
filled (else it goes on twice as far), so most shingles cost one hash and no component-by-shingle table is made.

Candidates. 27 bands of 5 components: a pair at 0.8 shares a band with probability above 0.9999. Equal
texts are one class from the start. Within a bucket no pairs are emitted: all members are held against one
hub, and links join components. Buckets that still hold several components make up families; a family's
members lie by component in blocks of bounded size, and blocks that aren't of one and the same component
are compared as wholes, which yields only links. So every pair of different components that meets in a
bucket is verified, and a group of near copies costs no more than its members that didn't join it at once.

Verification is exact: multiset overlap of the texts' 64-bit shingle hashes, 0.8 or more.

Cases: a text of 1 to 4 words has one shingle, of all its words; texts without a word, null ones included,
are equal to each other only if their bytes are (null equals empty); a row with a null doc_id is a class of its
own; rows that repeat a doc_id share its class; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm import bloom
from gaugeworks.llm.components import components
from gaugeworks.llm.words import U, mix, pieces, ranges, shingles, texts_of, words
from gaugeworks.llm.workspace import Workspace, release, tidy

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 27, 5
#: Shingles and members of a block of a family; a longer document is a block of its own.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 19, 1 << 10
#: Pairs of members that one shingle may make before it goes through a matrix product.
FEW = 64
#: -log of the chance that a document must go on after its first stop
SURE = 3.0
SALT = [int(x) for x in mix(np.arange(1, 10, dtype=U) * U(0x9E3779B97F4A7C15))]


def multiset(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles with their counts, sorted within each text, and n + 1 offsets."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.append(new, len(h))), np.searchsorted(t[new], np.arange(n + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((x >> U(11)).astype(float) + 1) / 9007199254740992.0


def signatures(items: np.ndarray, counts: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash signatures (one row of `size` 64-bit values each) of weighted sets; 0 for an empty one."""
    n = len(offsets) - 1
    out = np.zeros((n, size), U)
    if not len(items):
        return out
    text = np.repeat(np.arange(n), np.diff(offsets))
    # the intervals that each shingle covers: number 0 is (0,1], number j is (2^(j-1), 2^j]
    levels = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 2))).astype(np.int64), 0) + 1
    row = np.repeat(np.arange(len(items)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    base = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.where(level > 0, np.maximum(base, 1), 1)
    whole = counts[row] >= base + length
    cover = counts[row] - base
    with np.errstate(over="ignore"):
        seed = mix(items[row] + level.astype(U) * U(SALT[0]))
    text, rate = text[row], length.astype(float) * size
    weight = np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets])
    partial = np.flatnonzero(~whole)
    todo = weight > 0
    times = np.full(n * size, np.inf)
    stop = np.where(todo, (math.log(size) + SURE) / np.maximum(weight, 1), 0.0)
    while todo.any():
        live = np.flatnonzero(todo[text])
        state, time, limit, step, base_slot = seed[live], np.zeros(len(live)), stop[text[live]], -1 / rate[live], text[live] * size
        some_partial = len(partial) > 0
        found_at, found_time, found_value = [], [], []
        while len(live):
            with np.errstate(over="ignore"):
                state = mix(state + U(SALT[1]))
                time = time + np.log(_uniform(state)) * step
                on = np.flatnonzero(time <= limit)
                if len(on) < len(live):
                    live, state, time, limit, step, base_slot = live[on], state[on], time[on], limit[on], step[on], base_slot[on]
                slot = base_slot + (((state * U(SALT[2])) >> U(32)) * U(size) >> U(32)).astype(np.int64)
                if some_partial:
                    seen = whole[live] | ((mix(state ^ U(SALT[3])) % length[live].astype(U)).astype(np.int64) < cover[live])
                    found_at.append(slot[seen])
                    found_time.append(time[seen])
                    found_value.append(state[seen])
                else:
                    found_at.append(slot)
                    found_time.append(time)
                    found_value.append(state)
        at, when, value = (np.concatenate(x) for x in (found_at, found_time, found_value))
        np.minimum.at(times, at, when)
        first = when == times[at]
        out.reshape(-1)[at[first]] = value[first]
        todo = todo & np.isinf(times.reshape(n, size)).any(1)
        stop = np.where(todo, stop * 2, stop)
        times[np.repeat(todo, size)] = np.inf
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band."""
    with np.errstate(over="ignore"):
        key = np.full((len(signature), bands), U(SALT[5]))
        for r in range(rows):
            key = mix(key * U(SALT[6]) + signature[:, r::rows][:, :bands])
        return key


def _sign(bands: int, rows: int):
    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = texts_of(batch.column("text")), batch.column("doc_id")
            for at, some in pieces(texts):
                hashes, _, _, offsets = words(some)
                items, counts, bounds = multiset(*shingles(hashes, offsets, SHINGLE))
                keys = band_keys(signatures(items, counts, bounds, bands * rows), bands, rows)
                sizes = np.diff(np.concatenate([[0], np.cumsum(counts)])[bounds])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": doc_ids.slice(at, len(some)).cast(pa.int64()),
                        "digest": pa.array([xxhash.xxh3_128_digest(t.as_buffer()) for t in some], pa.binary()),
                        "size": pa.array(sizes, pa.int64()),
                        "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                    }
                )

    return sign


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts."""
    a, b = (multiset(*shingles(h, o, SHINGLE)) for h, _, _, o in (words(left), words(right)))
    n = len(left)
    total = np.zeros(n)
    shared = np.zeros(n)
    for items, counts, bounds in (a, b):
        total += np.diff(np.concatenate([[0], np.cumsum(counts)])[bounds])
    item = np.concatenate([a[0], b[0]])
    count = np.concatenate([a[1], b[1]])
    text = np.concatenate([np.repeat(np.arange(n), np.diff(x[2])) for x in (a, b)])
    order = np.lexsort((item, text))
    item, count, text = item[order], count[order], text[order]
    both = np.flatnonzero((item[1:] == item[:-1]) & (text[1:] == text[:-1]))
    np.add.at(shared, text[both], np.minimum(count[both], count[both + 1]))
    return np.where(total > 0, shared / np.maximum(total - shared, 1), 0.0)


def _verify(similarity: float):
    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = texts_of(batch.column("text_a")), texts_of(batch.column("text_b"))
            for at, some in pieces(left):
                got = overlap(some, right.slice(at, len(some)))
                ok = np.flatnonzero(got >= similarity) + at
                yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(pa.array(ok)), "b": batch.column("b").take(pa.array(ok)), "similarity": pa.array(got[ok - at])})

    return verify


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id among all that links join), links (of the document's text to different texts
    that were verified; not all that exist) for every row."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "near-duplicates")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = work.keep(texts.mapInArrow(_sign(bands, rows), "doc_id long, digest binary, size long, keys array<long>"), "signed")
    classes = signed.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = work.keep(classes, "classes")
    # a doc_id may stand on rows with different texts: its classes are one
    same_id = signed.where("doc_id is not null").join(classes.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    wide = classes.where("size > 0").select("rep", "size", F.posexplode("keys").alias("band", "key"))
    bucket = F.xxhash64("band", "key")
    members = wide.select(bucket.alias("bucket"), "rep", "size")
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = work.keep(members.join(crowded, "bucket"), "members-0")
    # texts are shuffled only for representatives that share a bucket with another
    reps = bloom.keep_possible(texts, "doc_id", bloom.build(members, "rep"), work, "possible")
    # a doc_id that stands on several texts speaks for all of them
    reps = work.keep(reps.withColumn("digest", F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))).dropDuplicates(["doc_id", "digest"]), "texts")
    work.drop("possible")
    # 1. every member against its bucket's hub
    hubs = members.groupBy("bucket").agg(F.min(F.struct("rep", "size")).alias("hub"))
    stars = members.join(hubs, "bucket").where("rep <> hub.rep").select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.col("size").alias("n"), F.col("hub.size").alias("m")).distinct()
    stars = stars.where(F.least("n", "m") >= similarity * F.greatest("n", "m")).select("a", "b")
    left = stars.join(reps.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    full = left.join(reps.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    links = work.keep(full.mapInArrow(_verify(similarity), "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links-0")
    labels = components(links.select("a", "b").union(same_id), work, "components-0")
    # 2. buckets that still hold several components: each family of such buckets, block against block
    now = members.join(labels, members.rep == labels.node, "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
    open_ = now.groupBy("bucket").agg(F.min("rep").alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket", "hub")
    open_ = work.keep(now.join(open_, "bucket").select("rep", "label", "hub").distinct(), "open")
    if not open_.isEmpty():
        family = components(open_.select(F.col("rep").alias("a"), F.col("hub").alias("b")), work, "families")
        more = work.keep(_block_links(open_, family, reps, similarity, work), "links-1")
        links = links.union(more)
        if not more.isEmpty():
            labels = components(links.select("a", "b").union(same_id), work, "components-1")
    linked = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = signed.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest", "left")
    out = out.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
    out = out.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").join(linked, "rep", "left")
    return out.select("doc_id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@tidy
def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A multiset as a set: a shingle's k-th occurrence is an item of its own, so overlap is a plain count."""
    for batch in batches:
        reps, digests = batch.column("doc_id").cast(pa.int64()), batch.column("digest")
        for at, some in pieces(texts_of(batch.column("text"))):
            hashes, _, _, offsets = words(some)
            items, counts, bounds = multiset(*shingles(hashes, offsets, SHINGLE))
            nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            with np.errstate(over="ignore"):
                flat = mix(np.repeat(items, counts) + nth.astype(U) * U(SALT[7]))
            ends = np.concatenate([[0], np.cumsum(counts)])[bounds]
            yield pa.RecordBatch.from_pydict(
                {"rep": reps.slice(at, len(some)), "digest": digests.slice(at, len(some)), "size": pa.array(np.diff(ends), pa.int64()), "items": pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())}
            )


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """Size of the intersection of each set on the left with each on the right. An item that few pairs share adds to each of
    them; the items of many go through products of 0-1 matrices, some at a time."""
    n, m = len(left), len(right)
    a, b = (np.concatenate(x) if x else np.zeros(0, U) for x in (left, right))
    both = np.intersect1d(a, b)
    rows, bounds = [], []
    for sets, flat in ((left, a), (right, b)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(both, flat)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == flat[ok]
        order = np.argsort(at[ok], kind="stable")
        rows.append(row[ok][order])
        bounds.append(np.searchsorted(at[ok][order], np.arange(len(both) + 1)))
    counts = [np.diff(x) for x in bounds]
    out = np.zeros(n * m, np.float32)
    few = np.flatnonzero(counts[0] * counts[1] <= FEW)
    for some in np.array_split(few, max(1, len(few) * FEW // 4_000_000 + 1)):
        each = counts[1][some]
        x = ranges(bounds[0][:-1][some], counts[0][some])
        y = ranges(np.repeat(bounds[1][:-1][some], counts[0][some]), np.repeat(each, counts[0][some]))
        pair = np.repeat(rows[0][x], np.repeat(each, counts[0][some])) * m + rows[1][y]
        out += np.bincount(pair, minlength=n * m).astype(np.float32)
    out = out.reshape(n, m)
    many = np.flatnonzero(counts[0] * counts[1] > FEW)
    for first in range(0, len(many), columns):
        some, sides = many[first : first + columns], []
        for row, bound, count, size in zip(rows, bounds, counts, (n, m), strict=True):
            side = np.zeros((size, len(some)), np.float32)
            side[row[ranges(bound[:-1][some], count[some])], np.repeat(np.arange(len(some)), count[some])] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _compare_blocks(similarity: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, rep, label = (table[c].to_numpy() for c in ("side", "rep", "label"))
        sets = [np.frombuffer(x.as_buffer(), U) for x in table["items"].chunk(0)]
        size = np.array([len(x) for x in sets])
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        r = l if not len(r) else r  # a block against itself comes once
        shared = shared_counts([sets[k] for k in l], [sets[k] for k in r])
        union = size[l][:, None] + size[r][None, :] - shared
        hit = (shared >= similarity * union) & (label[l][:, None] != label[r][None, :]) & (union > 0)
        i, j = np.nonzero(hit)
        release()
        return pa.table({"a": pa.array(rep[l[i]], pa.int64()), "b": pa.array(rep[r[j]], pa.int64()), "similarity": pa.array((shared[i, j] / union[i, j]).astype(float))})

    return compare


def _block_links(open_: DataFrame, family: DataFrame, reps: DataFrame, similarity: float, work: Workspace) -> DataFrame:
    """All links between different components within families, exactly. Blocks hold a bounded number of shingles and members;
    members lie by component, and two blocks of one and the same component never meet. A family may hold most rows: its
    places are running sums within ranges of all members, plus the sums of the family's ranges before."""
    one = open_.select("rep", "label").distinct().join(family.select(F.col("node").alias("rep"), F.col("label").alias("family")), "rep")
    texts = one.join(reps.withColumnRenamed("doc_id", "rep"), "rep")
    sets = work.keep(texts.select(F.col("rep").alias("doc_id"), "digest", "text").mapInArrow(_expand, "rep long, digest string, size long, items binary"), "sets")
    order = ["family", "label", "rep", "digest"]
    dealt = sets.select("rep", "digest", "size").join(one, "rep").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = work.keep(dealt.withColumn("weight", F.col("size") + BLOCK_SHINGLES // BLOCK_MEMBERS), "dealt")
    sums = dealt.groupBy("family", "part").agg(F.sum("weight").alias("sum"))
    before = Window.partitionBy("family").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = work.keep(sums.select("family", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before")), "before")
    inside = Window.partitionBy("part", "family").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("before") + F.sum("weight").over(inside) - F.col("weight")
    placed = dealt.join(sums, ["family", "part"]).select("family", "label", "rep", "digest", F.floor(place / BLOCK_SHINGLES).alias("block"))
    placed = work.keep(placed, "placed")
    blocks = placed.groupBy("family", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    meet = blocks.alias("x").join(blocks.alias("y"), (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block")))
    meet = meet.where("not (x.low = x.high and y.low = y.high and x.low = y.low)").select(F.col("x.family").alias("family"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")), F.struct(F.lit(1).alias("side"), F.col("j").alias("block"))))
    asked = meet.select("family", "i", "j", F.explode(sides).alias("s")).select("family", "i", "j", "s.side", "s.block")
    given = placed.join(asked, ["family", "block"]).join(sets.select("rep", "digest", "items"), ["rep", "digest"])
    given = given.select("family", "i", "j", "side", "rep", "label", "items").groupBy("family", "i", "j")
    found = given.applyInArrow(_compare_blocks(similarity), "a long, b long, similarity double")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
