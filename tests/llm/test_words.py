import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import words as w


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ_9 éÉßñ.,!'“”…  \n北—×")), max_size=30), max_size=5))
def test_words_are_runs_with_exact_places(texts):
    hashes, starts, ends, offsets = w.words(pa.array(texts, pa.large_string()))
    raw = "".join(texts).encode()
    known = {}
    for k, text in enumerate(texts):
        want = re.findall(r"[\w×]+", text.lower())
        own = slice(offsets[k], offsets[k + 1])
        assert [raw[a:b].decode().lower() for a, b in zip(starts[own], ends[own])] == want
        for word, h in zip(want, hashes[own].tolist()):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_shingles():
    texts = ["a b c d e f", "a b", "", "A, B", "b c d e f", "a b c d e"]
    hashes, _, _, offsets = w.words(pa.array(texts, pa.large_string()))
    got, at = w.shingles(hashes, offsets)
    own = [got[at[k] : at[k + 1]].tolist() for k in range(len(texts))]
    assert [len(x) for x in own] == [2, 1, 0, 1, 1, 1]
    assert own[1] == own[3] and own[0] == [own[5][0], own[4][0]]


def test_slices_and_very_long_words():
    texts = pa.array(["x", None, "y" * 9000, "", "z"], pa.string())
    whole = w.texts_of(texts)
    assert [s.to_pylist() for _, s in w.pieces(whole, 10)] == [["x", ""], ["y" * 9000], ["", "z"]]
    a, b = (w.words(pa.array([t], pa.large_string()))[0][0] for t in ("y" * 8999 + "z", "z" + "y" * 8999))
    assert a != b
    assert np.array_equal(w.words(whole.slice(2))[0], w.words(whole)[0][1:])
