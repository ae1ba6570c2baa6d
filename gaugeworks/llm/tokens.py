"""Token ids of whole texts by a public tokenizer file, each different word encoded once per worker.

The tokenizer drops white space and splits letters from digits and punctuation, so a text's ids are
the ids of its parts, one after the other. Parts are cut only where that is certain: at ASCII white
space, and between an ASCII or Latin-1 letter and an ASCII digit or punctuation mark other than the
apostrophe (which may begin a contraction) and, if "<|" occurs, the signs of special tokens. ASCII
and Latin-1 case is folded before look-up, as the tokenizer does itself, but not in parts with other
scripts or "<". `encode` returns exactly what the library returns for each whole text; tests compare.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from gaugeworks.llm.words import buffers, folded, ranges, run_bounds, run_hashes

U = np.uint64
#: Different parts that a worker remembers (about 30 bytes each); when full, all are forgotten and learnt anew.
REMEMBERED = 1_000_000
#: Words that go to the library at a time.
JOINED = 500
SPACE, LETTER, SIGN, OTHER = 0, 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[b for b in range(33, 127) if not chr(b).isalpha() and chr(b) != "'"]] = SIGN


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes columns of texts; keeps the ids of the parts it has met, in sorted arrays."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted keys, offsets, lengths; large levels first
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset in the pool (-1: unknown) and length of each key."""
        at, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, offsets, lengths in self.levels:
            open_ = np.flatnonzero(at < 0)
            i = np.searchsorted(known, keys[open_])
            i[i == len(known)] = 0
            hit = known[i] == keys[open_]
            at[open_[hit]], size[open_[hit]] = offsets[i[hit]], lengths[i[hit]]
        return at, size

    def _ids_of(self, parts: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each part. Parts of letters only (plain) are one word each: they go
        to the library many at a time, and the tokens that end a word part the result again."""
        ids, lengths = [], np.zeros(len(parts), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        letters = order[: int(plain.sum())].tolist()
        for i in range(0, len(letters), JOINED):
            some = letters[i : i + JOINED]
            got = np.array(self.tokenizer.encode_batch_fast([b" ".join([parts[k] for k in some]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[got]) + 1
            if len(ends) != len(some) or ends[-1] != len(got):
                raise ValueError("the tokenizer doesn't end words as this encoder expects")
            lengths[some] = np.diff(ends, prepend=0)
            ids.append(got)
        if len(others := order[len(letters) :].tolist()):
            for k, e in zip(others, self.tokenizer.encode_batch_fast([parts[k].decode() for k in others], add_special_tokens=False), strict=True):
                ids.append(got := np.array(e.ids, np.uint32))
                lengths[k] = len(got)
        flat = np.concatenate(ids)
        at = np.zeros(len(parts), np.int64)
        at[order] = np.cumsum(lengths[order]) - lengths[order]
        return flat[ranges(at, lengths)], lengths

    def _learn(self, keys: np.ndarray, parts: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode new parts (keys sorted) and remember them."""
        ids, lengths = self._ids_of(parts, plain)
        total = len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + total] = ids
        offsets = self.used + np.cumsum(lengths) - lengths
        self.used += total
        level = (keys, offsets, lengths.astype(np.int32))
        while self.levels and len(self.levels[-1][0]) < 4 * len(level[0]):
            level = tuple(np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True))
        order = np.argsort(level[0], kind="stable")
        self.levels.append(tuple(x[order] for x in level))
        return offsets, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and n + 1 offsets by text."""
        data, offsets = buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        kind, low = KIND[data], folded(data)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if len(special):
            kind[(data == 60) | (data == 62) | (data == 124)] = OTHER
        cut = np.zeros(len(data), bool)
        cut[1:] = (kind[1:] ^ kind[:-1]) == LETTER ^ SIGN
        cut[1:] &= (kind[1:] == LETTER) | (kind[1:] == SIGN)
        starts, ends = run_bounds(kind != SPACE, offsets, cut)
        raw = np.flatnonzero((data >= 0xC4) | (data == 60))
        if len(raw) and len(starts):
            runs = np.unique(np.searchsorted(starts, raw, "right") - 1)
            where = ranges(starts[runs], (ends - starts)[runs])
            low[where] = data[where]
        hashes = run_hashes(low, starts, ends)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if sum(len(x[0]) for x in self.levels) + len(keys) > max(REMEMBERED, len(keys)):
            self.forget()
        at, size = self._find(keys)
        if len(new := np.flatnonzero(at < 0)):
            held = low.tobytes()
            parts = [held[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            plain = kind[starts] == LETTER
            plain[np.searchsorted(starts, np.flatnonzero(kind == OTHER), "right") - 1] = False
            at[new], size[new] = self._learn(keys[new], parts, plain[first[new]])
        lengths = size[which]
        ids = self.pool[ranges(at[which], lengths)]
        ends_of = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends_of[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder: one for each tokenizer file, kept from task to task."""
    return Encoder(path)
