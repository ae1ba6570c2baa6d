import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import packing, token_files, tokens
from tests.llm.helpers import documents, rows_of

HARD = ["", " ", "a<|endoftext|>b <|ENDOFTEXT|>", "It's O'Neil's 'tis don't!'s 12ab ÉÉ—x, ẹ́A  nb’s … K İ 北京，abc", "<|startoftext|>", "a|b|c <x>", "\x1ca\x85b\x00c", "ÀÉ×÷ß", "x" * 10_000, "naïve café!!", "👩‍👩‍👧 ok"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.default_path())


def library(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_library(encoder, spark, sf):
    texts = HARD + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    ids, offsets = encoder.encode(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library(encoder, text), text[:60]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abIÉéçß×'s|<>!., \n\t12́İΣς—…北 ")), max_size=25), max_size=4))
def test_encoder_equals_library_on_odd_texts(texts):
    encoder = tokens.encoder(tokens.default_path())
    ids, offsets = encoder.encode(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library(encoder, text)


def test_files_against_library(spark, tmp_path, encoder):
    rows = [(k * 3 % 101, t) for k, t in enumerate(HARD)] + [(500, None), (None, "nobody"), (-(2**63), "first"), (2**63 - 1, "last"), (0, "nought")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(rows_of(token_files.op9_token_files(spark, str(tmp_path))), key=lambda r: r["start"])
    # equal doc_ids stand in any order
    tell = {(r["doc_id"], r["ids_crc32"]): r["start"] for r in got}
    crc = lambda t: zlib.crc32(np.array([*library(encoder, t or ""), 1], "<u4").tobytes())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tell[r[0], crc(r[1])]))
    start = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = [*library(encoder, text or ""), 1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_only_asked_frames_are_read_and_damage_is_seen():
    rng = np.random.default_rng(0)
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out, 2, frame_bytes=4000)
    docs = {k: rng.integers(0, 40_000, int(rng.integers(0, 900))).astype(np.uint32) for k in range(60)}
    for k, ids in docs.items():
        writer.add(pa.array([k]), ids, np.array([0, len(ids)]))
    writer.finish()
    raw = out.getvalue()
    file = token_files.TokenFile(io.BytesIO(raw))
    assert len(file.table) > 5
    assert {int(file.doc_ids[r]): ids.tolist() for r, ids in file.read()} == {k: v.tolist() for k, v in docs.items()}
    read = []
    file.frame = lambda k, f=file.frame: (read.append(k), f(k))[1]
    assert [ids.tolist() for _, ids in file.read(np.array([40]))] == [docs[40].tolist()] and len(read) == 1
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(v.astype("<u2").tobytes() for v in docs.values())
    damaged = bytearray(raw)
    damaged[30] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.TokenFile(io.BytesIO(bytes(damaged))).read())


def test_wanted_documents_and_empty_table(spark, tmp_path):
    df = documents(spark, [(k, f"text {k}") for k in range(30)])
    manifest = token_files.write_token_files(df, f"file://{tmp_path}/t")
    got = rows_of(token_files.read_token_files(spark, manifest, wanted=[3, 17]))
    assert sorted(r["doc_id"] for r in got) == [3, 17] and all(r["ids"][-1] == 1 for r in got)
    empty = token_files.write_token_files(documents(spark, []), f"file://{tmp_path}/e")
    assert token_files.read_token_files(spark, empty).count() == 0


def brute_bins(sizes, capacity):
    """Fewest bins, by trying all placements."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in sorted(set(rooms)):
            if i >= sizes[k]:
                at = rooms.index(i)
                go(k + 1, rooms[:at] + [i - sizes[k]] + rooms[at + 1 :])
        go(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_is_exact_and_packing_valid():
    rng = random.Random(4)
    reduced = 0
    for _ in range(300):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 10))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduce_by_dominance(counts, 40)
        left = [s for s, n in rest.items() for _ in range(n)]
        bins = sum(n for _, n in fixed)
        reduced += bins
        assert sorted([s for p, n in fixed for _ in range(n) for s in p] + left) == sorted(sizes)
        assert all(sum(p) <= 40 for p, _ in fixed)
        best = brute_bins(sizes, 40)
        assert bins + (brute_bins(left, 40) if left else 0) == best
        patterns = packing.solve(counts, 40)
        assert sorted(s for p, n in patterns for _ in range(n) for s in p) == sorted(sizes)
        assert all(sum(p) <= 40 for p, _ in patterns) and packing.lower_bound(counts, 40) <= best <= sum(n for _, n in patterns) <= best + 1
    assert reduced > 300


def test_packing_of_documents(spark, encoder):
    rows = [(k, "word " * (k * 37 % 900)) for k in range(40)] + [(1, "again"), (None, "x"), (99, None), (98, "long " * 9000), (97, ""), (96, "")]
    df = documents(spark, rows).selectExpr("*", "'c' as piece", "1 as rank", "2 as part")
    got = rows_of(packing.pack(df, with_ids=True))
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for doc, text in rows:
        if doc == 1:
            continue
        ids = [*library(encoder, text or ""), 0]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == ids
        assert [r["start"] for r in own] == [2048 * k for k in range(len(own))]
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(documents(spark, [])).count() == 0
