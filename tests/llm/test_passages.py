import random

import numpy as np

from gaugeworks.llm import passages
from tests.llm.helpers import documents, prose, rows_of


def spans(df):
    return {(r["doc_id"], r["source"]): r for r in rows_of(df)}


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(11)
    passage = prose(rng, 60)
    fuzzy = list(passage)
    for k in range(5, 60, 12):
        fuzzy[k] = f"z{k}"
    del fuzzy[30]
    long_one = prose(rng, 700)
    rows = [
        (1, " ".join(prose(rng, 300) + passage + prose(rng, 200))),
        (2, " ".join(prose(rng, 120) + [w.upper() + "," for w in passage] + prose(rng, 90))),
        (3, " ".join(prose(rng, 40) + fuzzy + prose(rng, 300))),
        (4, " ".join(prose(rng, 400))),
        (5, " ".join(passage)),
        (6, " ".join(prose(rng, 60) + passage[:40] + prose(rng, 60))),
        (7, " ".join(long_one)),
        (8, " ".join(long_one)),
        (9, " ".join(prose(rng, 50) + long_one[100:600] + prose(rng, 50) + passage)),
        (10, " ".join(prose(rng, 30) * 12)),
    ]
    got = spans(passages.repeated_passages(documents(spark, rows)))
    assert {k for k in got} == {(2, 1), (3, 1), (5, 1), (8, 7), (9, 7), (9, 1)}
    assert (got[2, 1]["first_word"], got[2, 1]["end_word"], got[2, 1]["source_first_word"], got[2, 1]["matched"]) == (120, 180, 300, 60)
    assert (got[3, 1]["first_word"], got[3, 1]["end_word"]) == (40, 99) and got[3, 1]["matched"] == 54
    assert (got[8, 7]["first_word"], got[8, 7]["end_word"]) == (0, 700)
    assert (got[9, 7]["first_word"], got[9, 7]["end_word"], got[9, 7]["source_first_word"]) == (50, 550, 100)
    left = {r["doc_id"]: r for r in rows_of(passages.remove_repeats(documents(spark, rows), passages.repeated_passages(documents(spark, rows))))}
    assert set(left) == {1, 2, 3, 4, 6, 7, 9, 10}
    texts = dict(rows)
    assert all(left[k]["text"] == texts[k] for k in (1, 4, 6, 7, 10))
    assert left[2]["text"].split() == texts[2].split()[:120] + texts[2].split()[180:] and left[2]["n_chars"] == len(left[2]["text"])


def test_a_word_over_and_over_is_a_passage(spark):
    rng = random.Random(17)
    rows = [(k, " ".join([*prose(rng, 40), *["Thsh"] * n, *prose(rng, 40)])) for k, n in enumerate([20, 70, 90, 55, 49])]
    got = spans(passages.repeated_passages(documents(spark, rows)))
    assert {k: (r["first_word"], r["end_word"]) for k, r in got.items()} == {(2, 1): (40, 110), (3, 1): (40, 95)}


def test_periodic_texts_meet_in_order(spark):
    rng = random.Random(18)
    period = prose(rng, 12)
    rows = [(1, " ".join(period * 8)), (2, " ".join(period * 6)), (3, " ".join(period * 3))]
    got = spans(passages.repeated_passages(documents(spark, rows)))
    assert set(got) == {(2, 1)} and (got[2, 1]["first_word"], got[2, 1]["end_word"]) == (0, 72)


def test_hot_passage_is_linear(spark):
    rng = random.Random(12)
    passage = prose(rng, 80)
    rows = [(k, " ".join(prose(rng, 30) + passage + prose(rng, 30))) for k in range(60)]
    got = rows_of(passages.repeated_passages(documents(spark, rows)))
    assert sorted((r["doc_id"], r["source"]) for r in got) == [(k, 0) for k in range(1, 60)]


def test_nulls_repeats_clashes_and_empty(spark):
    rng = random.Random(13)
    text = " ".join(prose(rng, 80))
    rows = [(None, text), (3, text), (3, text), (4, None), (5, ""), (6, text + " tail"), (7, "é " * 100), (8, "w " * 5000)]
    df = documents(spark, rows).selectExpr("*", "'x' as seed", "1 as pos", "2 as spans")
    found = passages.repeated_passages(df)
    assert [(r["doc_id"], r["source"], r["first_word"], r["end_word"]) for r in rows_of(found)] == [(6, 3, 0, 80)]
    left = rows_of(passages.remove_repeats(df, found))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in left) == sorted((i or -1, "tail" if i == 6 else t or "") for i, t in rows)
    assert left[0].keys() == {*df.columns}
    assert passages.repeated_passages(documents(spark, [])).count() == 0


def test_chain_scores_against_quadratic_search(monkeypatch):
    """The first chain has the best score of all chains, where no gap breaks it; each run is in one chain."""
    monkeypatch.setattr(passages, "MAX_GAP", 10_000)
    monkeypatch.setattr(passages, "GAP_COST", 0.05)  # so that long chains pay
    rng = random.Random(14)
    lengths = []
    for _ in range(60):
        runs = [(rng.randrange(200), rng.randrange(200), n := rng.randrange(6, 20), n) for _ in range(rng.randrange(1, 25))]
        order = sorted(range(len(runs)), key=lambda i: runs[i][0])
        score = {}
        for i in order:
            a, b, _, n = runs[i]
            gains = [score[j] - passages.GAP_COST * (a - runs[j][0] - runs[j][2] + b - runs[j][1] - runs[j][2]) for j in score if runs[j][0] + runs[j][2] <= a and runs[j][1] + runs[j][2] <= b]
            score[i] = n + max([0.0, *gains])
        got = passages.chains(runs)
        first = sum(x[2] for x in got[0]) - passages.GAP_COST * sum(y[0] - x[0] - x[2] + y[1] - x[1] - x[2] for x, y in zip(got[0], got[0][1:]))
        assert abs(first - max(score.values())) < 1e-9
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for c in got for x, y in zip(c, c[1:]))
        assert sorted(r for c in got for r in c) == sorted(runs)
        lengths.append(len(got[0]))
    assert max(lengths) >= 4


def test_whole_repeats_against_brute_force(spark):
    """Every stretch of 50 words that an earlier document holds is reported but for fewer than K words, in texts that are made
    of each other's pieces."""
    rng = random.Random(31)
    pool = [prose(rng, rng.randrange(20, 90)) for _ in range(12)]
    texts = {}
    for k in range(40):
        text = []
        for _ in range(rng.randrange(1, 5)):
            piece = rng.choice(pool)
            lo = rng.randrange(len(piece) // 2)
            text += prose(rng, rng.randrange(0, 30)) + piece[lo : lo + rng.randrange(15, 90)]
        texts[k] = text
    got = {}
    for r in rows_of(passages.repeated_passages(documents(spark, [(k, " ".join(t)) for k, t in texts.items()]))):
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["end_word"]))
    seen, repeats = set(), 0
    for k, text in texts.items():
        own = [tuple(text[i : i + 50]) for i in range(len(text) - 49)]
        want = {w for i, s in enumerate(own) if s in seen for w in range(i, i + 50)}
        assert len(want - got.get(k, set())) < passages.K, (k, sorted(want - got.get(k, set())))
        repeats += bool(want)
        seen |= set(own)
    assert repeats >= 5


def test_edited_copies_in_fragments_find_each_other(spark):
    """Fuzzy copies of a passage whose parts stand, word for word, in different documents before."""
    rng, found = random.Random(32), 0
    rows = []
    for case in range(30):
        passage, at = prose(rng, 100), case * 10
        copy = list(passage)
        for k in rng.sample(range(1, 99), 12):
            copy[k] = f"z{case}x{k}"
        rows += [(at + k, " ".join(prose(rng, 30) + passage[25 * k : 25 * k + 25] + prose(rng, 30))) for k in range(4)]
        rows += [(at + 5, " ".join(prose(rng, 40) + passage + prose(rng, 40))), (at + 6, " ".join(prose(rng, 40) + copy + prose(rng, 40)))]
    got = {(r["doc_id"], r["source"]) for r in rows_of(passages.repeated_passages(documents(spark, rows)))}
    found = sum((c * 10 + 6, c * 10 + 5) in got for c in range(30))
    assert found >= 27 and all(d // 10 == s // 10 for d, s in got)


def test_fenwick_is_prefix_maximum():
    rng = random.Random(15)
    tree, held = passages.Fenwick(50), [(-1e18, -1)] * 50
    for k in range(300):
        r, entry = rng.randrange(50), (rng.random(), k)
        tree.raise_to(r, entry)
        held[r] = max(held[r], entry)
        n = rng.randrange(51)
        assert tree.best(n) == max([(-1e18, -1), *held[:n]])


def test_minimisers_guarantee_a_seed_in_each_window():
    rng = np.random.default_rng(16)
    hashes = rng.integers(0, 30, 400).astype(np.uint64)
    offsets = np.array([0, 3, 60, 60, 400])
    _, text, pos, reach, _ = passages.minimisers(hashes, offsets)
    assert (reach >= passages.K).all()
    assert set(text.tolist()) == {1, 3}
    for t, n in ((1, 57), (3, 340)):
        own = np.unique(pos[text == t])
        gaps = np.diff(np.concatenate([[-1], own, [n - passages.K + 1]]))
        assert gaps.max() <= passages.WINDOW + 1


def test_cut_words():
    assert passages.cut_words("Ab, cd! Ef (gh) ij.", [(1, 3)]) == "Ab, gh) ij."
    assert passages.cut_words("a b c", [(0, 3)]) == "" and passages.cut_words("a b c", [(0, 1), (0, 2)]) == "c"


def test_fragments_in_earlier_documents_hide_no_passage(spark):
    """What documents 3 and 4 share stands in fragments, that overlap or not, in documents before, between."""
    rng = random.Random(19)
    rows, want = [], set()
    for case, (n, cuts) in enumerate([(60, [(0, 30), (30, 60)]), (60, [(0, 45), (15, 60)]), (52, [(0, 49), (3, 52)]), (50, [(0, 40), (10, 50)]), (96, [(0, 48), (48, 96), (24, 72)])] * 4):
        passage, at = prose(rng, n), case * 10
        for k, (lo, hi) in enumerate(cuts):
            rows.append((at + k, " ".join(prose(rng, 30) + passage[lo:hi] + prose(rng, 30))))
        rows += [(at + k, " ".join(prose(rng, 40) + passage + prose(rng, 40))) for k in (5, 9)]
        rows += [(at + 6 + k, " ".join(prose(rng, 30) + passage[lo:hi] + prose(rng, 30))) for k, (lo, hi) in enumerate(cuts)]
        want.add((at + 9, at + 5, 40, 40 + n))
    got = {(r["doc_id"], r["source"], r["first_word"], r["end_word"]) for r in rows_of(passages.repeated_passages(documents(spark, rows)))}
    assert want == got


def test_a_fragment_across_a_differing_stretch_hides_no_passage(spark):
    rng = random.Random(20)
    rows, want = [], set()
    for case, (n, differ, more) in enumerate([(52, 20, 17), (55, 22, 12), (60, 25, 20), (60, 25, 10)] * 5):
        first, last = prose(rng, n), prose(rng, more)
        if case % 2:  # the fragment before the passage
            texts = [[*prose(rng, 30), *last, *prose(rng, differ), *first, *prose(rng, 30)] for _ in range(2)]
        else:
            texts = [[*prose(rng, 30), *first, *prose(rng, differ), *last, *prose(rng, 30)] for _ in range(2)]
        rows += [(2 * case + k, " ".join(t)) for k, t in enumerate(texts)]
        at = 30 + (more + differ) * (case % 2)
        want.add((2 * case + 1, 2 * case, at, at + n))
    got = {(r["doc_id"], r["source"], r["first_word"], r["end_word"]) for r in rows_of(passages.repeated_passages(documents(spark, rows)))}
    assert {(d, s) for d, s, _, _ in want} == {(d, s) for d, s, _, _ in got}
    assert all(any(g[:2] == w[:2] and g[2] <= w[2] and w[3] <= g[3] for g in got) for w in want)


def test_parts_of_a_failing_chain():
    a, b = np.arange(300, dtype=np.uint64), np.arange(300, dtype=np.uint64)
    b[60:90] += np.uint64(1000)
    b[160:200] += np.uint64(1000)
    assert sorted(passages.align(a, b, [(10, 10, 280)])) == [(0, 60, 0, 60, 60), (90, 300, 90, 300, 170)]
    assert passages.align(a, a, [(100, 100, 20)]) == [(0, 300, 0, 300, 300)]


def alike(around, k, j):
    """The test of surroundings that meetings apply, for two seeds."""
    for side in (passages.SIDES[:2], passages.SIDES[2:4]):
        a, b = (sum(int(around[x, passages.SIDES.index(c)]) << (64 * n) for n, c in enumerate(side)) for x in (k, j))
        least = min(a.bit_count(), b.bit_count())
        if least and (a & b).bit_count() >= min(passages.ALIKE, -(-least // 2)):
            return True
    return False


def recall(n, edits, kinds, trials=100):
    """Share of randomly edited copies of n words, their first and last word left, that are found; kinds of edits: 0 other
    word, 1 word gone, 2 word added."""
    rng = np.random.default_rng([24, n, int(100 * edits), len(kinds)])
    fresh = lambda k: rng.integers(1, 2**62, k).astype(np.uint64)
    found = 0
    for _ in range(trials):
        original = fresh(n)
        copy = original.tolist()
        for at in sorted((1 + rng.choice(n - 2, int(edits * n), replace=False)).tolist(), reverse=True):
            kind = kinds[int(rng.integers(len(kinds)))]
            copy[at : at + (kind != 2)] = fresh(1).tolist() if kind != 1 else []
        texts = [np.concatenate([fresh(80), np.array(x, np.uint64), fresh(90)]) for x in (original, copy)]
        seed, text, pos, reach, _ = passages.minimisers(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
        first = {h: k for k, h in reversed(list(enumerate(seed.tolist()))) if text[k] == 0}
        around = passages.surroundings(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), text, pos)
        met = [(pos[k], pos[first[h]], min(reach[k], reach[first[h]])) for k, h in enumerate(seed.tolist()) if text[k] == 1 and h in first and alike(around, k, first[h])]
        chains = passages.chains(passages.runs_of(*map(np.array, zip(*met)))[:, 1:].tolist()) if met else []
        found += any(not passages.hopeless(texts[1], texts[0], [r[:3] for r in chain]) and passages.align(texts[1], texts[0], [r[:3] for r in chain]) for chain in chains)
    return found / trials


def test_recall_of_edited_copies():
    for n, edits in ((50, 0.1), (50, 0.15), (50, 0.2), (60, 0.15), (60, 0.19), (100, 0.19)):
        assert recall(n, edits, [0]) >= 0.97
    for n, edits in ((60, 0.1), (100, 0.1), (100, 0.15)):
        assert recall(n, edits, [0, 1, 2]) >= 0.9, (n, edits, recall(n, edits, [0, 1, 2]))
