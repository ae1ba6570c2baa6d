"""Each stage on what its predecessor kept, against plain Python on the smallest tables."""

import random

import numpy as np
import pytest

import corpus_pipeline
from gaugeworks.llm import tokens
from gaugeworks.llm.workspace import Workspace
from tests.llm.helpers import documents, prose, rows_of
from tests.llm.test_decontam import distance
from tests.llm.test_minhash import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases: good prose, junk, exact and near copies, shared passages, benchmark items."""
    rng = random.Random(51)
    root = tmp_path_factory.mktemp("planted")
    items = [(k, " ".join(prose(rng, 30))) for k in range(5)]
    passage = prose(rng, 70)
    rows = [(k, " ".join(prose(rng, 120)) + ".") for k in range(60)]
    rows += [(100 + k, " | ".join(prose(rng, 60)).upper() + " !!! ###") for k in range(30)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " tail"), (202, rows[3][1])]
    rows += [(210 + k, " ".join([*prose(rng, 100), *passage, *prose(rng, 100)])) for k in range(4)]
    rows += [(220 + k, " ".join([*prose(rng, 50), items[k][1], *prose(rng, 50)])) for k in range(3)]
    rows += [(None, "a row without a name " * 9), (230, None), (231, "")]
    documents(spark, rows).write.parquet(f"{root}/documents.parquet")
    labels = [(k, 0 if 100 <= k < 130 else 1, 0) for k, _ in rows if k is not None and k < 130]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), dict(rows), dict(items)


def test_stages_take_effect(spark, folder):
    root, texts, items = folder
    work = Workspace(spark, "test-pipeline")
    docs = spark.read.parquet(f"{root}/documents.parquet").selectExpr("*", "'kept' as label", "1 as rep")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, root), name)
        kept[name] = rows_of(docs)
        if name != "best_fit_packing":
            assert docs.columns == [*COLUMNS, "label", "rep"]
    ids = {name: sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) for name, rows in kept.items()}
    good = ids["quality_filter"]
    assert set(good) >= {k for k in texts if k is not None and k < 60} and not any(100 <= k < 130 for k in good)
    label = brute([(k, texts[k]) for k in good])
    assert ids["near_dedup"] == sorted(k for k in good if label[k] == k) and not {200, 201, 202} & set(ids["near_dedup"])
    cut = {r["doc_id"]: r["text"] for r in kept["substring_dedup"]}
    assert cut[210] == texts[210] and all(len(cut[k].split()) == 200 for k in (211, 212, 213))
    assert all(cut[k] == texts[k] for k in ids["near_dedup"] if k in cut and k not in (211, 212, 213))
    clean = [k for k in ids["substring_dedup"] if all(distance(t.split(), (cut[k] or "").lower().replace(".", "").split()) > 0.2 * 30 for t in items.values())]
    assert ids["decontamination"] == clean and not {220, 221, 222} & set(clean)
    encoder = tokens.encoder(tokens.default_path())
    want = sum(len(encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept["decontamination"])
    packed = kept["best_fit_packing"]
    assert sum(r["length"] for r in packed) == want and sorted({r["doc_id"] for r in packed if r["doc_id"] is not None}) == clean
    fill = np.bincount([r["sequence_id"] for r in packed], [r["length"] for r in packed])
    assert fill.max() <= 2048
    assert None in {r["doc_id"] for r in packed}


def test_run_and_empty_tables(spark, folder, tmp_path):
    root, *_ = folder
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
