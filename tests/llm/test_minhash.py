import random
import re
from collections import Counter

import numpy as np

from gaugeworks.llm import minhash
from gaugeworks.llm.components import components
from gaugeworks.llm.workspace import Workspace
from tests.llm.helpers import documents, prose, rows_of


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    a, b = bag(a), bag(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute(rows):
    """doc_id -> smallest doc_id of its class, over all pairs."""
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if (a or "") == (b or "") or jaccard(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: find(i) for i, _ in rows}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    for _ in range(6):
        a = {int(x): int(rng.integers(1, 40)) for x in rng.integers(1, 2**62, 50)}
        b = {k: int(rng.integers(1, 40)) if k % 3 == 0 else n for k, n in a.items()}
        got = []
        for weights in (a, b):
            items = np.array(sorted(weights), np.uint64)
            got.append(minhash.signatures(items, np.array([weights[int(k)] for k in items]), np.array([0, len(items)]), 4096)[0])
        want = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in a)
        assert abs((got[0] == got[1]).mean() - want) < 0.035


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(3)
    items, counts = rng.integers(1, 2**62, 30).astype(np.uint64), rng.integers(1, 5, 30)
    alone = minhash.signatures(items[:10], counts[:10], np.array([0, 10]), 64)
    together = minhash.signatures(items, counts, np.array([0, 10, 10, 30]), 64)
    assert (alone[0] == together[0]).all() and not together[1].any() and together[2].all()


def test_classes_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for family in range(12):
        base = prose(rng, rng.randrange(60, 300))
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 1, 2, 4, 8])))))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "", "one", "one", "One!", "two words", "a a a a a a a a a a a a", "a a a a a a a a a a a a a", "...", "---", "x" * 50_000])]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in rows_of(minhash.near_duplicates(documents(spark, rows)))}
    assert got == brute(rows)


def test_chained_links_through_several_hubs(spark):
    """A drift of texts: neighbours are similar, ends are not; all are one class."""
    rng = random.Random(5)
    base = prose(rng, 200)
    rows = []
    for k in range(30):
        rows.append((k, " ".join(base)))
        base = edited(rng, base, 3)
    assert jaccard(rows[0][1], rows[-1][1]) < 0.8
    assert {r["class_id"] for r in rows_of(minhash.near_duplicates(documents(spark, rows)))} == {0} == set(brute(rows).values())


def test_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(4, "same text of six words here"), (2, "same text of six words here"), (None, "same text of six words here"), (2, "another text that also has six words"), (9, "another text that also has six words")]
    df = documents(spark, rows).selectExpr("*", "'x' as rep", "1 as size", "2 as label", "array(1) as keys")
    got = sorted((r["doc_id"] or -1, r["class_id"]) for r in rows_of(minhash.near_duplicates(df)))
    assert got == [(-1, None), (2, 2), (2, 2), (4, 2), (9, 2)]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["node"]: r["label"] for r in rows_of(components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")))}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_every_link_on_the_tables_is_in_one_class(spark):
    """All pairs of the documents at 0.8 or more, by an inverted index of whole texts, against the classes."""
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in rows_of(minhash.op6_near_duplicates(spark, folder))}
    bags = {i: bag(t) for i, t in texts.items()}
    holders = {}
    for i, b in bags.items():
        for s in b:
            holders.setdefault(s, []).append(i)
    shared = Counter()
    for s, ids in holders.items():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                shared[min(i, j), max(i, j)] += min(bags[i][s], bags[j][s])
    size = {i: sum(b.values()) for i, b in bags.items()}
    near = {p for p, n in shared.items() if n >= 0.8 * (size[p[0]] + size[p[1]] - n)}
    assert len(near) >= 50 and all(got[i] == got[j] for i, j in near)
    # and nothing else is joined but what such links and equal texts join
    label = {i: i for i in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    same = {}
    for i, t in texts.items():
        same.setdefault(t or "", []).append(i)
    for i, j in [*near, *[(v[0], w) for v in same.values() for w in v[1:]]]:
        a, b = sorted((find(i), find(j)))
        label[b] = a
    assert got == {i: find(i) for i in texts}


def test_shared_counts_against_sets():
    rng = np.random.default_rng(9)
    for universe in (20, 3000):
        left, right = ([np.unique(rng.integers(0, universe, int(rng.integers(0, 60)))).astype(np.uint64) for _ in range(n)] for n in (37, 53))
        got = minhash.shared_counts(left, right, 16)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
