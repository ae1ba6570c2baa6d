import random

import numpy as np

from gaugeworks.llm import decontam
from tests.llm.helpers import documents, prose, rows_of


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def distance(item, text):
    """Fewest word edits from item to any part of text (plain table)."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_against_brute_force(spark):
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randrange(3, 70), 300)) for k in range(40)]
    docs = []
    for k in range(60):
        own = prose(rng, rng.randrange(0, 300), 300)
        if k % 3 == 0:
            copy = list(items[rng.randrange(40)][1])
            for _ in range(int(len(copy) * rng.choice([0, 0.05, 0.1]))):
                copy[rng.randrange(len(copy))] = "other"
            at = rng.randrange(len(own) + 1)
            own = own[:at] + [w.title() + "." for w in copy] + own[at:]
        docs.append((k, own))
    got = {(r["doc_id"], r["item_id"]): r for r in rows_of(decontam.contaminated(documents(spark, [(i, " ".join(t)) for i, t in docs]), bench(spark, [(i, " ".join(t)) for i, t in items])))}
    want = {}
    for i, text in docs:
        text = [w.lower().strip(".") for w in text]
        for j, item in items:
            if (d := distance(item, text)) <= decontam.MAX_EDITS * len(item):
                want[i, j] = d
    assert {k: r["edits"] for k, r in got.items()}.items() <= want.items()
    assert len(got) >= 0.97 * len(want) and len(want) >= 20
    by_id = dict(docs)
    for (i, j), r in got.items():
        part = [w.lower().strip(".") for w in by_id[i]][r["first_word"] : r["end_word"]]
        assert distance(part, dict(items)[j]) <= r["edits"] and r["item_words"] == len(dict(items)[j])


def test_recall_of_edited_copies():
    rng = np.random.default_rng(22)
    items = [rng.integers(1, 2**62, int(n)).astype(np.uint64) for n in rng.integers(15, 80, 30)]
    assert decontam.expected_recall(items, 0.0, 5) == 1.0
    assert decontam.expected_recall(items, 0.1, 10) >= 0.98
    assert decontam.expected_recall(items, decontam.MAX_EDITS, 10) >= 0.9


def test_every_whole_item_holds_a_window():
    for n in range(3, 400):
        m, s = decontam.window_class(n)
        assert m + s - 1 <= n <= decontam.longest_item(m)
    assert decontam.window_class(2) is None and decontam.window_class(2, 1) == (2, 1) and decontam.window_class(0, 0) is None


def test_short_items_if_asked_for(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three")]
    rows = [(1, "so Beta, gamma it is"), (2, "beta or gamma"), (3, "alpha"), (4, "one two three")]
    got = rows_of(decontam.contaminated(documents(spark, rows), bench(spark, items), shortest=1))
    assert sorted((r["doc_id"], r["item_id"], r["first_word"], r["edits"]) for r in got) == [(1, 2, 1, 0), (3, 1, 0, 0), (4, 3, 0, 0)]


def test_nulls_repeats_clashes_and_empty(spark):
    rng = random.Random(23)
    item = " ".join(prose(rng, 30))
    items = [(5, item), (3, item.upper()), (3, item), (None, item), (8, None), (9, ""), (10, "two words")]
    rows = [(1, "x " + item + " y"), (1, item), (None, item), (2, None), (4, ""), (6, "two words")]
    df = documents(spark, rows).selectExpr("*", "1 as key", "2 as start", "'c' as context")
    got = rows_of(decontam.contaminated(df, bench(spark, items)))
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(1, 3, 0)]
    assert decontam.contaminated(documents(spark, []), bench(spark, items)).count() == 0
    assert decontam.contaminated(df, bench(spark, [])).count() == 0


def test_recall_at_class_borders_and_of_long_items():
    rng = np.random.default_rng(25)
    for n, trials in ((7, 40), (8, 40), (14, 40), (15, 40), (31, 20), (63, 20), (127, 10), (255, 5), (511, 3)):
        items = [rng.integers(1, 2**62, n).astype(np.uint64) for _ in range(5)]
        assert decontam.expected_recall(items, decontam.MAX_EDITS, trials) >= 0.9, n


def test_long_edited_items_are_found(spark):
    rng = random.Random(26)
    items = [(k, prose(rng, n)) for k, n in enumerate([63, 70, 127, 255, 400])]
    rows = []
    for k, item in items:
        copy = list(item)
        for at in rng.sample(range(len(item)), int(0.19 * len(item))):
            copy[at] = "other"
        rows.append((k, " ".join(prose(rng, 90) + copy + prose(rng, 200))))
    got = rows_of(decontam.contaminated(documents(spark, rows), bench(spark, [(k, " ".join(item)) for k, item in items])))
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k, _ in items]
    assert all(abs(r["first_word"] - 90) <= 3 and r["edits"] <= 0.2 * r["item_words"] for r in got)
