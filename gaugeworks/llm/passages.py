"""Fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

1. Seeds: the minimisers (of WINDOW k-mers of K words) of every document of at least MIN_WORDS words.
2. Join: every occurrence of a seed meets the seed's first occurrence, in its smallest doc_id. A seed that a
   third of all documents hold costs a row for each of them, never pairs among them. A meeting counts if the
   surroundings are alike too: a passage has AROUND words on one side of any of its seeds at least, so the pairs of
   words there, as a bitmap of 128 bits, must share ALIKE bits. An occurrence whose surroundings on one side are
   not alike meets, for that side, the first occurrence that agrees in the seed and in the smallest hash of the
   pairs there: so copies find each other although parts of them stand in other documents before.
   Where all seeds around are shared but their first holders differ, every stretch of MIN_WORDS words is a seed too: it
   meets the first document that holds the whole stretch, so whatever repeats word for word is found. Of the runs of
   such stretches, longest first, those stay that add K words or more to the document's others.
3. Chain, for each (document, earlier document), in a document's own task: seeds on a diagonal become runs; runs are chained in order in
   both documents with a cost for each word of gap, the best predecessor found in a Fenwick tree of prefix
   maxima. Chains break where a gap passes MAX_GAP words. Where seeds alone make a chain a passage, the document's
   chains inside it are left.
4. Align: the chain's words in both documents are fetched by blocks of BLOCK words with a margin on each side, but for
   stretches where seeds touch, which are known to be equal. Words are compared by 32 bits of their hashes. Runs are compared word by word, gaps by edit distance, and both ends are extended by alignment as long as
   the score grows. A passage has at least MIN_WORDS words, IDENTITY of them matched: the whole chain, or else the
   parts of it with the most matches that have. What adds fewer than K words to a document's longer passages isn't told.

The passage counts as a repeat in the later document; its first holder keeps it. Passages within one document
alone are no repeats. Words fold case and drop punctuation.

Cases: null texts are empty; rows with a null doc_id take no part and stay as they are; rows that repeat a doc_id
are one document to this operator: what they share with each other is left, spans hold for each of them only
if the texts are equal, so repeated doc_ids should differ in nothing; ties go to the smaller position; an empty
table gives no rows; extra columns pass through `remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import bloom
from gaugeworks.llm.words import U, mix, pieces, ranges, texts_of, window_hashes, words
from gaugeworks.llm.workspace import Workspace, tidy

#: With windows of no more than K places, seeds of an equal stretch touch or overlap.
K, WINDOW = 6, 5
MIN_WORDS, IDENTITY = 50, 0.8
MAX_GAP, GAP_COST = 32, 0.25
MARGIN, BLOCK = 64, 64
#: Differing words in a row that may stand just before the end of a passage.
EDGE = 3
#: Words on each side of a seed that are its surroundings, and bits that two occurrences share where these are alike.
AROUND, ALIKE = 22, 8
#: Words of a shared stretch beside its outermost seed at most.
EDGES = K + WINDOW - 2
#: Chains of whole stretches are numbered from here on.
WHOLE = 1 << 40
#: A chain needs this many words in seeds to be aligned.
SEEDED = K
MATCH, MISMATCH, GAP = 1, -2, -2
LARGEST = U(2**64 - 1)


def sampled(hashes: np.ndarray, offsets: np.ndarray, k: int, window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, text, word position and reach of the minimisers of all texts of at least `least` words. One that repeats at once
    (a word over and over) is one that reaches over the whole run; others reach over k words."""
    values = window_hashes(hashes, k)
    counts = np.diff(offsets)
    counts = np.where(counts >= max(least, k), counts - k + 1, 0)
    at = ranges(offsets[:-1], counts)
    v = values[at]
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(v):
        return np.zeros(0, U), text, np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.append(v, np.full(window, LARGEST))
    last = ends[text] - np.arange(len(v))  # k-mers from here to the text's end
    low = v.copy()
    for o in range(1, window):
        np.minimum(low, np.where(last > o, padded[o : o + len(v)], LARGEST), out=low)
    begins = (last >= window) | (np.arange(len(v)) == (ends - counts)[text])
    low = np.where(begins, low, U(0))
    chosen = np.zeros(len(v) + window, bool)
    for o in range(window):
        chosen[o : o + len(v)] |= (padded[o : o + len(v)] == low) & (last > o)
    chosen = chosen[: len(v)]
    fresh = np.concatenate([[True], (v[1:] != v[:-1]) | (text[1:] != text[:-1])])
    runs = np.flatnonzero(fresh)
    chosen = np.logical_or.reduceat(chosen, runs)  # of a run, its first k-mer stands for all
    found = runs[chosen]
    reach = k - 1 + np.diff(np.append(runs, len(v)))[chosen]
    return v[found], text[found], found - (ends - counts)[text[found]], reach


def minimisers(hashes: np.ndarray, offsets: np.ndarray, k: int = K, window: int = WINDOW, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """hash, text, word position and reach of the seeds of all texts of at least `least` words; and how many of them, in front,
    are plain ones, in order."""
    seed, text, pos, reach = sampled(hashes, offsets, k, window, least)
    plain = len(seed)
    # a run as long as a passage is a seed of its own kind too: its first occurrence is then as long
    long = np.flatnonzero(reach >= least)
    seed, text, pos, reach = np.concatenate([seed, mix(seed[long])]), np.append(text, text[long]), np.append(pos, pos[long]), np.append(reach, reach[long])
    # so is a seed's second, third ... occurrence in a text: periodic texts then meet in order, not all at the first period
    with np.errstate(over="ignore"):
        own = mix(seed + text.astype(U) * U(0xD1B54A32D192ED03))  # within a text, as seeds come in order
    order = np.argsort(own, kind="stable")
    same = np.concatenate([[False], own[order][1:] == own[order][:-1]])[: len(order)]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    again, nth = order[nth > 0], nth[nth > 0]
    with np.errstate(over="ignore"):
        seed = np.concatenate([seed, mix(seed[again] + nth.astype(U) * U(0x9E3779B97F4A7C15))])
    return seed, np.append(text, text[again]), np.append(pos, pos[again]), np.append(reach, reach[again]), plain


def unbarred(offsets: np.ndarray, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], shared: np.ndarray) -> np.ndarray:
    """For each word, whether another text may hold the MIN_WORDS words from there on: no plain seed (text, position, reach) inside
    is unshared. Only seeds that are chosen whatever stands around the stretch count against it."""
    text, pos, reach = (x[~shared] for x in seeds)
    count = np.maximum(np.diff(offsets) - MIN_WORDS + 1, 0)
    lo = np.maximum(pos + reach - (MIN_WORDS - WINDOW + 1), 0)
    hi = np.minimum(pos - (WINDOW - 1) + 1, count[text])
    ok = lo < hi
    barred = np.zeros(int(offsets[-1]) + 1, np.int64)
    np.add.at(barred, lo[ok] + offsets[text[ok]], 1)
    np.add.at(barred, hi[ok] + offsets[text[ok]], -1)
    begins = np.zeros(int(offsets[-1]), bool)
    begins[ranges(offsets[:-1], count)] = True
    return begins & (np.cumsum(barred)[:-1] == 0)


def over_window(values: np.ndarray, size: int, join) -> np.ndarray:
    """join (np.bitwise_or, np.minimum) over each `size` values in a row, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = join(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def surroundings(hashes: np.ndarray, offsets: np.ndarray, text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each seed a row of SIDES: the pairs of words before it and behind it, from its edge on, as bitmaps of two words each, and
    the smallest 32-bit hash of either side. All zeros on a side where the text has fewer than AROUND words."""
    out = np.zeros((len(text), len(SIDES)), U)
    if len(hashes) <= AROUND:
        return out
    with np.errstate(over="ignore"):
        pair = mix(hashes[:-1] * U(0x9E3779B97F4A7C15) + hashes[1:])
    bit = U(1) << ((pair >> U(57)) & U(63))
    high = pair >> U(63) == 1
    low, high = (over_window(np.where(x, bit, U(0)), AROUND, np.bitwise_or) for x in (~high, high))
    least = over_window(pair & U(0xFFFFFFFF), AROUND, np.minimum)
    at = offsets[:-1][text] + pos
    before = np.flatnonzero(pos >= AROUND)
    behind = np.flatnonzero(pos + K + AROUND <= np.diff(offsets)[text])
    for side, ok, where in ((0, before, at[before] - AROUND), (1, behind, at[behind] + K - 1)):
        out[ok, 2 * side], out[ok, 2 * side + 1] = low[where], high[where]
        out[ok, 4] |= least[where] << U(32 * (1 - side))
    return out


SIDES = ("before_0", "before_1", "behind_0", "behind_1", "mins")
SEED = "seed long, doc_id long, pos int, reach int, copied boolean, around array<long>"


@tidy
def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids = batch.column("doc_id").cast(pa.int64())
        for at, some in pieces(texts_of(batch.column("text"))):
            hashes, _, _, offsets = words(some)
            seed, text, *_ = minimisers(hashes, offsets)
            yield pa.RecordBatch.from_pydict({"seed": seed.view(np.int64), "doc_id": doc_ids.take(pa.array(text + at))})


def _shared(bits):
    """Seeds that several documents may hold. copied: whether a stretch that other texts may hold whole is around; surroundings
    only where a neighbour is not shared, as a chain of several seeds needs none (null: not told)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = bloom.Bloom(bits.value)
        for batch in batches:
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for at, some in pieces(texts_of(batch.column("text"))):
                hashes, _, _, offsets = words(some)
                seed, text, pos, reach, plain = minimisers(hashes, offsets)
                shared = several.has(seed)
                if not shared.any():
                    continue
                begins = unbarred(offsets, (text[:plain], pos[:plain], reach[:plain]), shared[:plain])
                free = np.concatenate([[0], np.cumsum(begins)])
                order = np.argsort(offsets[:-1][text] + pos, kind="stable")
                mark = shared[order]
                lone = np.zeros(len(order), bool)
                inner = text[order][1:] == text[order][:-1]
                lone[1:] |= inner & ~mark[:-1]
                lone[:-1] |= inner & ~mark[1:]
                order, lone = order[mark], lone[mark]
                seed, text, pos, reach = seed[order], text[order], pos[order], reach[order]
                begin = offsets[:-1][text]
                lo, hi = begin + np.maximum(pos + reach - MIN_WORDS, 0), begin + pos + 1
                copied = free[np.maximum(hi, lo)] > free[lo]
                columns = {"seed": seed.view(np.int64), "doc_id": doc_ids.take(pa.array(text + at)), "pos": pa.array(pos, pa.int32()), "reach": pa.array(reach, pa.int32()), "copied": pa.array(copied)}
                told = surroundings(hashes, offsets, text[lone], pos[lone])
                ends = pa.array(np.append(0, np.cumsum(lone)) * len(SIDES), pa.int32(), mask=np.append(~lone, False))
                yield pa.RecordBatch.from_pydict(columns | {"around": pa.ListArray.from_arrays(ends, pa.array(told.view(np.int64).ravel()))})

    return run


def whole_stretches(hashes: np.ndarray, offsets: np.ndarray, where: np.ndarray, doc_ids: pa.Array) -> dict:
    """The stretches of MIN_WORDS words that begin at these words, as seeds. In a run of one word, the first stands for all."""
    values, of = window_hashes(hashes, MIN_WORDS)[where], np.searchsorted(offsets, where, "right") - 1
    fresh = np.concatenate([[True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])])[: len(where)]
    values, of, where = values[fresh], of[fresh], where[fresh]
    return {"seed": values.view(np.int64), "doc_id": doc_ids.take(pa.array(of)), "pos": pa.array(where - offsets[:-1][of], pa.int32()), "reach": pa.array(np.full(len(of), MIN_WORDS), pa.int32())}


def seams(doc: np.ndarray, pos: np.ndarray, reach: np.ndarray, source: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Rows (doc, lo, hi) of where stretches begin (lo to hi - 1) that may stand whole in an earlier text although no chain tells:
    from copied seeds, those that go over to a seed of another first holder, or at another distance, and those that go beyond the
    outermost seed. Where a document is the first holder itself, later ones meet it."""
    order = np.lexsort((pos, doc))
    doc, pos, reach, source, away = (x[order] for x in (doc, pos, reach, source, away))
    same = (doc[1:] == doc[:-1]) & (pos[1:] <= pos[:-1] + reach[:-1] + WINDOW)  # else an unshared seed is between
    turn = same & ((source[1:] != source[:-1]) | (away[1:] != away[:-1]))
    last, first = np.append(~same, True), np.append(True, ~same)
    ends, begins = np.flatnonzero(last & (source != doc)), np.flatnonzero(first & (source != doc))
    turns = np.flatnonzero(turn)
    rows = [
        (doc[turns], pos[turns] + reach[turns] - MIN_WORDS + 1, np.maximum(pos[turns + 1], pos[turns] + 1)),
        (doc[ends], pos[ends] + reach[ends] - MIN_WORDS + 1, pos[ends] + 1),
        (doc[begins], pos[begins] + reach[begins] - MIN_WORDS, pos[begins]),
    ]
    doc, lo, hi = (np.concatenate(x) for x in zip(*rows, strict=True))
    lo = np.maximum(lo, 0)
    return np.stack([doc, lo, hi], axis=1)[lo < hi]


def _stretches(bits):
    """The stretches of MIN_WORDS words that begin in given places (pairs of lo and hi) and that another text may hold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = bloom.Bloom(bits.value)
        for batch in batches:
            doc_ids, places = batch.column("doc_id").cast(pa.int64()), batch.column("places")
            for at, some in pieces(texts_of(batch.column("text"))):
                hashes, _, _, offsets = words(some)
                seed, text, pos, reach = sampled(hashes, offsets, K, WINDOW, MIN_WORDS)
                begins = unbarred(offsets, (text, pos, reach), several.has(seed))
                asked = np.zeros(len(begins) + 1, np.int64)
                for k, own in enumerate(places.slice(at, len(some)).to_pylist()):
                    bounds = np.array(own, np.int64).reshape(-1, 2) + offsets[k]
                    np.add.at(asked, np.minimum(bounds[:, 0], offsets[k + 1]), 1)
                    np.add.at(asked, np.minimum(bounds[:, 1], offsets[k + 1]), -1)
                where = np.flatnonzero(begins & (np.cumsum(asked)[:-1] > 0))
                yield pa.RecordBatch.from_pydict(whole_stretches(hashes, offsets, where, doc_ids.slice(at, len(some))))

    return run


def told(of: str, side: str) -> Column:
    """One word of an occurrence's surroundings, 0 if they aren't told."""
    return F.coalesce(F.get(F.col(f"{of}.around"), F.lit(SIDES.index(side))), F.lit(0).cast("long"))


def shared_bits(side: str) -> Column:
    """Bits that the surroundings of two occurrences, own and first, share on one side (before, behind)."""
    return sum((F.bit_count(told("own", f"{side}_{k}").bitwiseAND(told("first", f"{side}_{k}"))) for k in (0, 1)), F.lit(0))


def alike_side(side: str) -> Column:
    """Whether they share enough: ALIKE, or half where there are few (words over and over)."""
    least = F.least(*(F.bit_count(told(x, f"{side}_0")) + F.bit_count(told(x, f"{side}_1")) for x in ("own", "first")))
    return (least > 0) & (shared_bits(side) >= F.least(F.lit(ALIKE), F.ceil(least / 2)))


class Fenwick:
    """Prefix maxima of (score, index) over ranks 0 .. n - 1."""

    def __init__(self, n: int):
        self.tree = [(-1e18, -1)] * (n + 1)

    def raise_to(self, rank: int, entry: tuple[float, int]) -> None:
        rank += 1
        while rank < len(self.tree):
            if entry > self.tree[rank]:
                self.tree[rank] = entry
            rank += rank & -rank

    def best(self, count: int) -> tuple[float, int]:
        """The best of ranks 0 .. count - 1."""
        found = (-1e18, -1)
        while count > 0:
            found = max(found, self.tree[count])
            count -= count & -count
        return found


def runs_of(a: np.ndarray, b: np.ndarray, reach: np.ndarray, pair: np.ndarray | None = None) -> np.ndarray:
    """Seeds (a, b, reach) merged along diagonals, for each pair of documents: rows of pair, a, b, length, words in seeds, in order
    of pairs. A run has no gap over MAX_GAP words."""
    pair = np.zeros(len(a), np.int64) if pair is None else pair
    order = np.lexsort((a, b - a, pair))
    a, b, reach, pair = a[order], b[order], reach[order], pair[order]
    since = np.concatenate([[0], (a[:-1] + reach[:-1]) - a[1:]])  # words that the seed before reaches beyond this start
    new = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(b - a) != 0) | (-since[1:] > MAX_GAP)])
    first = np.flatnonzero(new)
    ends = np.maximum.reduceat(a + reach, first)
    covered = np.where(new, reach, np.clip(reach - np.maximum(since, 0), 0, None))
    return np.stack([pair[first], a[first], b[first], ends - a[first], np.add.reduceat(covered, first)], axis=1)


def chains(runs: list[list[int]]) -> list[list[list[int]]]:
    """Chains of runs (a, b, length, words in seeds) that ascend in both documents, best first; each run is in one chain.

    Score of a chain: words in seeds, less GAP_COST for each word between runs in either document. With the
    cost linear in both positions, a run's best predecessor has the largest score plus GAP_COST * (end in a + end in b)
    among those that end before it in both: an event sweep over a, a Fenwick tree over b."""
    n = len(runs)
    begins = sorted(range(n), key=lambda i: (runs[i][0], runs[i][1]))
    ends = sorted(range(n), key=lambda i: runs[i][0] + runs[i][2])
    rank = {x: r for r, x in enumerate(sorted({r[1] + r[2] for r in runs}))}
    bounds = sorted(rank)
    tree, score, before = Fenwick(len(rank)), [0.0] * n, [-1] * n
    done = 0
    for i in begins:
        a, b, length, seeded = runs[i]
        while done < n and runs[ends[done]][0] + runs[ends[done]][2] <= a:
            j = ends[done]
            end_a, end_b = runs[j][0] + runs[j][2], runs[j][1] + runs[j][2]
            tree.raise_to(rank[end_b], (score[j] + GAP_COST * (end_a + end_b), j))
            done += 1
        held, j = tree.best(int(np.searchsorted(bounds, b, "right")))
        gain = held - GAP_COST * (a + b)
        score[i], before[i] = (seeded + gain, j) if j >= 0 and gain > 0 else (float(seeded), -1)
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: (-score[i], runs[i][0], runs[i][1])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = before[i]
        part: list[list[int]] = []
        for run in reversed(chain):
            if part and max(run[0] - part[-1][0] - part[-1][2], run[1] - part[-1][1] - part[-1][2]) > MAX_GAP:
                out.append(part)
                part = []
            part.append(run)
        if part:
            out.append(part)
    return [part for part in out if sum(r[3] for r in part) >= SEEDED]


MEETING = "doc_id long, source long, pos int, source_pos int, reach int"
MET = MEETING + ", copied boolean, ok boolean"


@tidy
def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches, sorted by doc_id, as runs on diagonals; a document's stretches may span batches."""
    names = [x.split()[0] for x in MEETING.split(", ")]

    def rows(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, source, a, b, reach = columns
        order = np.lexsort((a, b - a, source, doc))
        doc, source, a, b, reach = doc[order], source[order], a[order], b[order], reach[order]
        new = (np.diff(doc) != 0) | (np.diff(source) != 0) | (np.diff(b - a) != 0) | (a[1:] > a[:-1] + reach[:-1])
        first = np.flatnonzero(np.concatenate([[True], new]))
        length = np.maximum.reduceat(a + reach, first) - a[first]
        doc, source, a, b = doc[first], source[first], a[first], b[first]
        keep = np.ones(len(doc), bool)
        cut = np.flatnonzero(np.diff(doc)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
            if hi - lo > 1:
                low = a[lo:hi].min()
                held = np.zeros((a[lo:hi] + length[lo:hi]).max() - low, bool)
                for i in (lo + np.lexsort((a[lo:hi], source[lo:hi], -length[lo:hi]))).tolist():
                    own = held[a[i] - low : a[i] - low + length[i]]
                    keep[i] = len(own) - own.sum() >= K
                    own[:] |= keep[i]
        columns = [x[keep] for x in (doc, source, a, b, length)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 2 else pa.int32()) for k, x in enumerate(columns)], names)

    yield from by_document(batches, names, rows)


CHAIN = "doc_id long, source long, chain long, a_blocks array<int>, b_blocks array<int>, runs binary, solids binary, places array<int>"


def solids_of(a: np.ndarray, b: np.ndarray, reach: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Rows (pair, a, b, length) of the stretches that are equal for sure: seeds on a diagonal that touch or overlap; by pairs."""
    order = np.lexsort((a, b - a, pair))
    a, b, reach, pair = a[order], b[order], reach[order], pair[order]
    other = (np.diff(pair) != 0) | (np.diff(b - a) != 0)
    # the farthest end so far on a diagonal: a long seed may hold short ones
    line = np.concatenate([[0], np.cumsum(other)]) << 40
    ends = np.maximum.accumulate(a + reach + line) - line
    first = np.flatnonzero(np.concatenate([[True], other | (a[1:] > ends[:-1])]))
    return np.stack([pair[first], a[first], b[first], np.maximum.reduceat(ends, first) - a[first]], axis=1)


def outer(spans: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Which of a document's chains (first and end word) are to be aligned: not those inside one that is sure to be a passage."""
    keep = np.ones(len(spans), bool)
    held: list[tuple[int, int]] = []
    for i in np.lexsort((np.arange(len(spans)), spans[:, 0] - spans[:, 1], ~sure)).tolist():
        lo, hi = spans[i].tolist()
        if any(x <= lo and hi <= y for x, y in held):
            keep[i] = False
        elif sure[i]:
            held.append((lo, hi))
    return keep


def needed_blocks(lo: int, hi: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The blocks of words lo to hi - 1 that hold a word outside these stretches."""
    first, last = lo // BLOCK, (hi - 1) // BLOCK
    free = np.zeros((last - first + 1) * BLOCK + 1, np.int64)
    at = first * BLOCK
    inside = (starts < hi) & (starts + lengths > lo)
    np.add.at(free, np.maximum(starts[inside] - at, 0), 1)
    np.add.at(free, np.minimum((starts + lengths)[inside] - at, len(free) - 1), -1)
    out = np.cumsum(free)[:-1] == 0
    out[: lo - at] = out[hi - at :] = False
    return first + np.flatnonzero(out.reshape(-1, BLOCK).any(1))


@tidy
def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of meetings (MET) sorted by doc_id, source and pos. A chain of which seeds alone make up IDENTITY of MIN_WORDS words
    or more is a passage for sure, and chains of the document inside it add nothing. And for each document that has any, a row
    with the places (pairs of lo and hi) of its seams outside of those."""
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CHAIN.split(", ")])

    def rows(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, source, a, b, reach, copied, ok = columns
        marks = seams(*(x[copied > 0] for x in (doc, a, reach, source, b - a)))
        out, sure_spans = linked(*(x[ok > 0] for x in (doc, source, a, b, reach)))
        order = np.lexsort((marks[:, 1], marks[:, 0]))
        marks = marks[order]
        cut = np.flatnonzero(np.diff(marks[:, 0])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(marks)], strict=True):
            if hi > lo:
                own = marks[lo:hi]
                for x, y in sure_spans.get(int(own[0, 0]), []):
                    own = own[(own[:, 1] + EDGES < x) | (own[:, 2] - 1 + MIN_WORDS - EDGES > y)]
                if len(own):
                    out.append(dict.fromkeys(schema.names) | {"doc_id": int(own[0, 0]), "places": own[:, 1:].ravel()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    yield from by_document(batches, [x.split()[0] for x in MET.split(", ")], rows)


def linked(doc: np.ndarray, source: np.ndarray, a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> tuple[list[dict], dict[int, list[tuple[int, int]]]]:
    """The chains of whole documents, and of each document the spans of those that are passages for sure."""
    out: list[dict] = []
    spans_of: dict[int, list[tuple[int, int]]] = {}
    if len(doc):
        fresh = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(source) != 0)])
        pair, firsts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        runs, solids = runs_of(a, b, reach, pair), solids_of(a, b, reach, pair)
        at, solid_at = (np.searchsorted(x[:, 0], np.arange(len(firsts) + 1)) for x in (runs, solids))
        found: list[tuple[int, int, list]] = []  # pair, number, runs
        for p, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            own = runs[lo:hi, 1:].tolist()
            if len(own) == 1:
                if own[0][3] >= SEEDED:
                    found.append((p, 0, own))
            else:
                found += [(p, k, chain) for k, chain in enumerate(chains(own))]
        if not found:
            return out, spans_of
        spans = np.array([(c[0][0], c[-1][0] + c[-1][2], c[0][1], c[-1][1] + c[-1][2], sum(r[3] for r in c)) for _, _, c in found])
        words_a, words_b = spans[:, 1] - spans[:, 0], spans[:, 3] - spans[:, 2]
        sure = (np.minimum(words_a, words_b) >= MIN_WORDS) & (spans[:, 4] >= IDENTITY * np.maximum(words_a, words_b))
        docs = doc[firsts[[p for p, _, _ in found]]]
        keep = np.ones(len(found), bool)
        cut = np.flatnonzero(np.diff(docs)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(docs)], strict=True):
            if hi - lo > 1 and sure[lo:hi].any():
                keep[lo:hi] = outer(spans[lo:hi, :2], sure[lo:hi])
        for i in np.flatnonzero(keep).tolist():
            p, k, chain = found[i]
            if sure[i]:
                spans_of.setdefault(int(docs[i]), []).append((int(spans[i, 0]), int(spans[i, 1])))
            (x, y), (u, v) = chain[0][:2], (spans[i, 1], spans[i, 3])
            own = solids[solid_at[p] : solid_at[p + 1], 1:]
            if len(chain) > 1 or at[p + 1] - at[p] > 1:
                own = own[np.isin(own[:, 1] - own[:, 0], [r[1] - r[0] for r in chain]) & (own[:, 0] >= x) & (own[:, 0] + own[:, 2] <= u)]
            out.append(
                {
                    "doc_id": int(docs[i]), "source": int(source[firsts[p]]), "chain": k, "a_blocks": needed_blocks(max(0, x - MARGIN), int(u) + MARGIN, own[:, 0], own[:, 2]),
                    "b_blocks": needed_blocks(max(0, y - MARGIN), int(v) + MARGIN, own[:, 1], own[:, 2]), "runs": np.array([r[:3] for r in chain], np.int32).tobytes(), "solids": own.astype(np.int32).tobytes(), "places": None,
                }
            )
    return out, spans_of


def block_key(doc_ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(doc_ids.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + blocks.astype(U)).view(np.int64)


@tidy
def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"key": block_key(batch.column("holder").to_numpy(), batch.column("block").to_numpy())})


def _blocks(bits):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bloom.Bloom(bits.value)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy()
            for at, some in pieces(texts_of(batch.column("text"))):
                hashes, _, _, offsets = words(some)
                short = (hashes >> U(32)).astype(np.uint32)
                count = -(-np.diff(offsets) // BLOCK)
                text = np.repeat(np.arange(len(some)), count)
                block = ranges(np.zeros(len(count), np.int64), count)
                ok = wanted.has(block_key(ids[text + at], block))
                text, block = text[ok], block[ok]
                lo = offsets[:-1][text] + block * BLOCK
                hi = np.minimum(lo + BLOCK, offsets[1:][text])
                yield pa.RecordBatch.from_pydict(
                    {"holder": pa.array(ids[text + at]), "block": pa.array(block, pa.int32()), "payload": pa.array([short[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())}
                )

    return run


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far both sequences go on alike from their beginnings: words of a, words of b, matches, at the best score."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    exact = n if same.all() else int(same.argmin())
    a, b = a[exact:], b[exact:]
    # scores with matches in the low digits, so that the best score also tells its matches
    unit = 1 << 20
    columns = np.arange(len(b) + 1)
    row = columns * (GAP * unit)
    best, where = 0, (0, 0)
    for i in range(len(a)):
        new = row + GAP * unit
        gain = np.where(b == a[i], MATCH * unit + 1, MISMATCH * unit)
        np.maximum(new[1:], row[:-1] + gain, out=new[1:])
        row = np.maximum.accumulate(new - columns * (GAP * unit)) + columns * (GAP * unit)
        j = int(row.argmax())
        if row[j] > best + unit // 2:
            best, where = int(row[j]), (i + 1, j)
        elif row[j] < best - 12 * unit:  # no way back up within the margin
            break
    return exact + where[0], exact + where[1], exact + best % unit


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two stretches share in order (longest common subsequence); exact for short stretches."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (same := int((a == b).sum())) * 2 >= len(a):
        return same
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        new = row.copy()
        np.maximum(new[1:], row[:-1] + (b == x), out=new[1:])
        row = np.maximum.accumulate(new)
    return int(row[-1])


def exact_parts(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int) -> list[tuple[int, int, int, int, int]]:
    """Maximal equal stretches of two sequences of one length that begin at these words."""
    same = a == b
    if len(same) and same.all():
        return [(at_a, at_a + len(a), at_b, at_b + len(a), len(a))]
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))).reshape(-1, 2)
    return [(at_a + lo, at_a + hi, at_b + lo, at_b + hi, hi - lo) for lo, hi in bounds.tolist()]


def extension(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The parts by which both sequences go on alike from their beginnings."""
    more_a, more_b, hits = extend(a, b)
    if more_a == more_b and (parts := exact_parts(a[:more_a], b[:more_b], 0, 0)) and sum(p[4] for p in parts) >= hits:
        return parts
    n = min(more_a, more_b)
    same = a[:n] == b[:n]
    exact = n if same.all() else int(same.argmin())
    return [(0, exact, 0, exact, exact)] * (exact > 0) + [(exact, more_a, exact, more_b, hits - exact)] * (hits > exact)


def parts_of(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A chain and its surroundings in parts, in order: from and to in a, from and to in b, matched words; and the words
    that match between each part and the next."""
    (x, y, _), (u, v, n) = runs[0], runs[-1]
    parts = [(x - a1, x - a0, y - b1, y - b0, hits) for a0, a1, b0, b1, hits in reversed(extension(a[:x][::-1], b[:y][::-1]))]
    between, at_a, at_b = [0] * len(parts), x, y
    for x, y, length in runs:
        if between:
            between[-1] += matched(a[at_a:x], b[at_b:y])
        own = exact_parts(a[x : x + length], b[y : y + length], x, y)
        parts += own
        between += [0] * len(own)
        at_a, at_b = x + length, y + length
    u, v = u + n, v + n
    parts += [(u + a0, u + a1, v + b0, v + b1, hits) for a0, a1, b0, b1, hits in extension(a[u:], b[v:])]
    return np.array(parts, np.int64).reshape(-1, 5), np.array((between + [0] * len(parts))[: len(parts)], np.int64)


def alike(parts: np.ndarray, between: np.ndarray, shortest: bool = False) -> list[tuple[int, int, int, int, int]]:
    """The stretches of parts that have MIN_WORDS words, IDENTITY of them matched: the one with the most matches (or the
    fewest words), and the same again on both sides of it."""
    hits, gaps = np.append(0, np.cumsum(parts[:, 4])), np.append(0, np.cumsum(between))
    words_a, words_b, same = parts[-1, 1] - parts[0, 0], parts[-1, 3] - parts[0, 2], hits[-1] + gaps[len(parts) - 1]
    if not shortest and words_a >= MIN_WORDS and same >= IDENTITY * max(words_a, words_b):
        return [(int(parts[0, 0]), int(parts[-1, 1]), int(parts[0, 2]), int(parts[-1, 3]), int(same))]  # nothing has more matches
    out, todo = [], [(0, len(parts))]
    while todo:
        lo, hi = todo.pop()
        if hits[hi] - hits[lo] + gaps[hi] - gaps[lo] < IDENTITY * MIN_WORDS or parts[hi - 1, 1] - parts[lo, 0] < MIN_WORDS:
            continue
        best, found = 0, None
        for i in range(lo, hi):
            if hits[hi] - hits[i] + gaps[hi] - gaps[i] <= (0 if shortest else best):
                break
            same = hits[i + 1 : hi + 1] - hits[i] + gaps[i:hi] - gaps[i]
            words_a, words_b = parts[i:hi, 1] - parts[i, 0], parts[i:hi, 3] - parts[i, 2]
            ok = (words_a >= MIN_WORDS) & (same >= IDENTITY * np.maximum(words_a, words_b))
            score = np.where(ok, 1 / words_a if shortest else same, 0)
            if score.max() > best:
                j = int(score.argmax())
                best, found = score[j], (i, i + j, int(same[j]))
        if found:
            i, j, same = found
            out.append((int(parts[i, 0]), int(parts[j, 1]), int(parts[i, 2]), int(parts[j, 3]), same))
            todo += [(lo, i), (j + 1, hi)]
    return out


def hopeless(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> bool:
    """Whether a chain can't be part of a passage. Any passage has MIN_WORDS words in a row of which the other side holds two thirds
    (of 50 to 99 words with 80 % matched, whichever they are, some 50 in a row have 33). And a short chain goes on, on one of
    its sides, for half of the words that it lacks, of whose pairs it shares a quarter at the very least."""
    if sum(r[2] for r in runs) < 2 * MIN_WORDS // 3:
        held = set(b.tolist())
        count = np.cumsum([0, *[w in held for w in a.tolist()]])
        if (count[MIN_WORDS:] - count[:-MIN_WORDS]).max(initial=0) * 3 < 2 * MIN_WORDS - 1:
            return True
    (x, y, _), (u, v, n) = runs[0], runs[-1]
    u, v = u + n, v + n
    wide = (MIN_WORDS - max(u - x, v - y) + 1) // 2
    if wide < 3 * K:
        return False
    pairs = lambda z: set((z[:-1] * U(0x9E3779B97F4A7C15) + z[1:]).tolist())
    with np.errstate(over="ignore"):
        for left, right in ((a[max(0, x - wide) : x + 1], b[max(0, y - wide) : y + 1]), (a[u - 1 : u + wide], b[v - 1 : v + wide])):
            one, two = pairs(left), pairs(right)
            if len(one & two) * 4 >= min(len(one), len(two), wide) > 0:
                return False
    return True


def align(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The passages around a chain: from and to in a, from and to in b, matched words. The whole chain if it is alike enough,
    else parts of it. A chain that has too few words is looked at with equal words that stand beyond its ends, where an
    edit just before the end of a passage stopped the extension."""
    parts, between = parts_of(a, b, runs)
    if not len(parts) or (found := alike(parts, between)):
        return found if len(parts) else []
    (x, y), (u, v) = parts[0, [0, 2]].tolist(), parts[-1, [1, 3]].tolist()
    n, m = min(x, y, MIN_WORDS), min(len(a) - u, len(b) - v, MIN_WORDS)
    before, after = exact_parts(a[x - n : x], b[y - n : y], x - n, y - n), exact_parts(a[u : u + m], b[v : v + m], u, v)
    ends = np.array([x, *[p[0] for p in before[::-1]]]) - np.array([*[p[1] for p in before[::-1]], x - n])
    before = before[max(0, len(before) - int((ends > EDGE).argmax())) :] if (ends > EDGE).any() else before
    ends = np.array([*[p[0] for p in after], u + m]) - np.array([u, *[p[1] for p in after]])
    after = after[: int((ends > EDGE).argmax())] if (ends > EDGE).any() else after
    wider = np.concatenate([np.array(p, np.int64).reshape(-1, 5) for p in (before, parts, after)])
    return alike(wider, np.concatenate([np.zeros(len(before), np.int64), between, np.zeros(len(after), np.int64)]), shortest=True)[:1]


PASSAGE = "doc_id long, source long, first_word long, end_word long, source_first_word long, source_end_word long, matched long"


@tidy
def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages, sorted by doc_id, without those that add fewer than K words to the document's longer ones."""
    names = [x.split()[0] for x in PASSAGE.split(", ")]

    def rows(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, source, first, end = columns[:4]
        keep = np.ones(len(doc), bool)
        cut = np.flatnonzero(np.diff(doc)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
            if hi - lo > 1:
                low = first[lo:hi].min()
                held = np.zeros(end[lo:hi].max() - low, bool)
                for i in (lo + np.lexsort((first[lo:hi], source[lo:hi], first[lo:hi] - end[lo:hi]))).tolist():
                    own = held[first[i] - low : end[i] - low]
                    keep[i] = len(own) - own.sum() >= K
                    own[:] |= keep[i]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in columns], names)

    yield from by_document(batches, names, rows)


def by_document(batches: Iterator[pa.RecordBatch], names: list[str], rows) -> Iterator[pa.RecordBatch]:
    """rows(columns) of whole documents; the rows of a document, the first column, may span batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield from rows([x[:cut] for x in columns])
        held = [x[cut:] for x in columns]
    if held is not None and len(held[0]):
        yield from rows(held)


def laid_out(lo: int, end: int, blocks: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words lo to end - 1, or to the last fetched one behind, and which were fetched."""
    if blocks:
        last = max(blocks)
        end = max(end, last * BLOCK + len(blocks[last]) // 4)
    out, there = np.zeros(end - lo, U), np.zeros(end - lo, bool)
    for k, raw in blocks.items():
        own = np.frombuffer(raw, np.uint32)
        skip = max(0, lo - k * BLOCK)
        at = k * BLOCK + skip - lo
        n = max(0, min(len(own) - skip, len(out) - at))
        out[at : at + n], there[at : at + n] = own[skip : skip + n], True
    return out, there


@tidy
def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            sides: list[dict[int, bytes]] = [{}, {}]
            for part in r["parts"] or []:
                sides[part["side"]][part["block"]] = part["payload"]
            runs, solids = (np.frombuffer(r[c], np.int32).reshape(-1, 3).astype(np.int64) for c in ("runs", "solids"))
            lows = [max(0, int(runs[0, k]) - MARGIN) for k in (0, 1)]
            (a, has_a), (b, has_b) = (laid_out(lows[k], int(runs[-1, k] + runs[-1, 2]), sides[k]) for k in (0, 1))
            filler = 1 << 40
            for x, y, n in (solids - [*lows, 0]).tolist():  # equal, whether fetched or not
                u, v, only_b, none = a[x : x + n], b[y : y + n], ~has_a[x : x + n] & has_b[y : y + n], ~has_a[x : x + n] & ~has_b[y : y + n]
                u[only_b] = v[only_b]
                u[none] = filler + np.flatnonzero(none)
                v[~has_b[y : y + n]] = u[~has_b[y : y + n]]
                has_a[x : x + n] = has_b[y : y + n] = True
                filler += n
            a[~has_a], b[~has_b] = filler, filler + 1  # words that no block holds: none
            chain = [tuple(x) for x in (runs - [*lows, 0]).tolist()]
            if hopeless(a, b, chain):
                continue
            for a0, a1, b0, b1, hits in align(a, b, chain):
                out.append({"doc_id": r["doc_id"], "source": r["source"], "first_word": a0 + lows[0], "end_word": a1 + lows[0], "source_first_word": b0 + lows[1], "source_end_word": b1 + lows[1], "matched": hits})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(x.split()[0], pa.int64()) for x in PASSAGE.split(", ")]))


OWN = ("doc_id", "pos", "reach", "around")


def meetings(met: DataFrame, work: Workspace) -> DataFrame:
    """MET rows of occurrences (own) with the first (first) of their seed, itself included: ok for those in like or untold
    surroundings. And meetings of the others with an earlier one that is like them on the side where the first is not."""
    other = F.col("own.doc_id") != F.col("first.doc_id")
    sure = F.col("own.around").isNull() | F.col("first.around").isNull() | (F.least("own.reach", "first.reach") > K)  # a word over and over is its own surroundings
    slim = [F.col("own.doc_id"), F.col("first.doc_id").alias("source"), F.col("own.pos"), F.col("first.pos").alias("source_pos"), F.least("own.reach", "first.reach").alias("reach")]

    def unlike(side: str, shift: int) -> Column:
        held = told("own", f"{side}_0").bitwiseOR(told("own", f"{side}_1")) != 0
        least = F.shiftrightunsigned(told("own", "mins"), shift).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(~alike_side(side) & held, F.struct(F.xxhash64("seed", F.lit(side), least).alias("seed"), F.lit(side).alias("side"), shared_bits(side).alias("bits")))

    open_ = met.where(other & ~sure).select("own", F.explode(F.array_compact(F.array(unlike("before", 32), unlike("behind", 0)))).alias("open"))
    open_ = work.keep(open_.select("open.*", "own.*"), "open")
    again = open_.select("seed", "side", "bits", F.struct(*OWN).alias("own")).join(first_holders(open_, "seed", work, "first_alike"), "seed").where("own.doc_id <> first.doc_id")
    more = lambda side: (F.col("side") == side) & alike_side(side) & (shared_bits(side) >= F.col("bits") + ALIKE // 2)
    again = again.where(more("before") | more("behind")).select(*slim, F.lit(False).alias("copied"), F.lit(True).alias("ok")).distinct()
    ok = other & (sure | alike_side("before") | alike_side("behind"))
    return met.select(*slim, "copied", ok.alias("ok")).where("copied or ok").unionByName(again)


def first_holders(rows: DataFrame, key: str, work: Workspace, name: str) -> DataFrame:
    """The first occurrence under each key that several documents hold. A written side lets the planner split a key that very
    many documents hold."""
    first = rows.groupBy(key).agg(F.min(F.struct(*[c for c in OWN if c in rows.columns])).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last")
    return work.keep(first.select(key, "first"), name)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, source (an earlier document with the passage), first_word, end_word, the same in the source, matched words."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "passages")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = rows.mapInArrow(_seeds, "seed long, doc_id long").groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    bits = spark.sparkContext.broadcast(bloom.build(work.keep(held.where("first <> last").select("seed"), "several"), "seed").bits)
    shared = work.keep(rows.mapInArrow(_shared(bits), SEED), "shared")
    work.drop("several")
    work.sweep()  # else shuffles stay until the driver happens to collect its garbage
    met = shared.select("seed", "copied", F.struct(*OWN).alias("own")).join(first_holders(shared, "seed", work, "first"), "seed")
    met = work.keep(met, "met")
    work.drop("shared", "first")
    work.sweep()

    def chained(meetings: DataFrame, name: str) -> DataFrame:
        return work.keep(meetings.repartition("doc_id").sortWithinPartitions("doc_id", "source", "pos").mapInArrow(_chain, CHAIN), name)

    found = chained(meetings(met, work), "chains-0")
    work.drop("met", "open", "first_alike")
    work.sweep()
    # stretches that may stand whole in a document although its seeds have different first holders
    places = work.keep(found.where("places is not null").select("doc_id", "places"), "places")
    texts = bloom.keep_possible(rows, "doc_id", bloom.build(places, "doc_id"), work, "seamed")
    whole = texts.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_stretches(bits), "seed long, doc_id long, pos int, reach int")
    whole = work.keep(whole.distinct(), "whole")
    bits.destroy()
    longer = whole.join(first_holders(whole, "seed", work, "first_stretches"), "seed").where("doc_id <> first.doc_id")
    longer = longer.select("doc_id", F.col("first.doc_id").alias("source"), "pos", F.col("first.pos").alias("source_pos"), F.least("reach", "first.reach").alias("reach"))
    longer = longer.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_thin, MEETING)
    more = chained(longer.select("*", F.lit(False).alias("copied"), F.lit(True).alias("ok")), "chains-1")
    work.drop("places", "seamed", "whole", "first_stretches")
    work.sweep()
    found = found.where("places is null").unionByName(more.withColumn("chain", F.col("chain") + WHOLE)).drop("places")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(holder).alias("holder"), F.col(blocks).alias("blocks")) for k, (holder, blocks) in enumerate((("doc_id", "a_blocks"), ("source", "b_blocks")))])
    asked = found.select("doc_id", "source", "chain", F.explode(sides).alias("s")).select("doc_id", "source", "chain", "s.side", "s.holder", F.explode("s.blocks").alias("block"))
    keys = asked.select("holder", "block").distinct().mapInArrow(_block_keys, "key long")
    bits = spark.sparkContext.broadcast(bloom.build(keys, "key").bits)
    blocks = rows.mapInArrow(_blocks(bits), "holder long, block int, payload binary").dropDuplicates(["holder", "block"])
    blocks = work.keep(blocks, "blocks")  # written, so that a block that very many passages ask for can be split
    bits.destroy()
    work.sweep()
    given = asked.join(blocks, ["holder", "block"])
    parts = given.groupBy("doc_id", "source", "chain").agg(F.collect_list(F.struct("side", "block", "payload")).alias("parts"))
    whole = found.select("doc_id", "source", "chain", "runs", "solids").join(parts, ["doc_id", "source", "chain"], "left")
    aligned = work.keep(whole.select("doc_id", "source", "runs", "solids", "parts").mapInArrow(_align, PASSAGE), "aligned")
    work.drop("chains-0", "chains-1", "blocks")
    work.sweep()
    return aligned.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_told, PASSAGE)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words; what follows the last word of a span goes with it, up to the next word."""
    array = pa.array([text], pa.large_string())
    _, starts, _, _ = words(array)
    raw = text.encode()
    out, at = [], 0
    for first, end in sorted(spans):
        lo = int(starts[first]) if first < len(starts) else len(raw)
        hi = int(starts[end]) if end < len(starts) else len(raw)
        out.append(raw[at : max(at, lo)])
        at = max(at, hi)
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the repeated passages cut from their later holders; a document that holds nothing else goes.

    text changes (and n_chars, if there is one); other columns and untouched rows stay as they are."""
    spans = passages.groupBy("doc_id").agg(F.flatten(F.sort_array(F.collect_list(F.array("first_word", "end_word")))).alias("__spans")).withColumnRenamed("doc_id", "__doc")
    wide = docs.join(spans, docs.doc_id == F.col("__doc"), "left")

    @F.arrow_udf(T.StringType())
    def cut(text: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([None if t is None or s is None else cut_words(t, list(zip(s[::2], s[1::2], strict=True))) for t, s in zip(text.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    cutting = F.col("__spans").isNotNull() & F.col("text").isNotNull()
    left = wide.withColumn("text", F.when(cutting, cut(F.when(cutting, F.col("text")), F.when(cutting, F.col("__spans")))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(cutting, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.where(~(cutting & (F.col("text").rlike(r"[\p{L}\p{N}]") == F.lit(False)))).select(*docs.columns)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
