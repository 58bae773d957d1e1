"""Hashes of words and shingles, and orders made by one number, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from evispark.llm import hashing
from evispark.llm.hashing import shingle_runs, shingle_sets, word_hashes
from evispark.llm.line_index import COUNTERS, by_rarity

LETTERS = "aAbBzZ@[`{ \t\n\r\x0b\x0c\x00\x01\x7fß€0 "


def lowered(text):
    """The words of a text as bytes, A-Z lower-cased."""
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def some_texts(rng):
    lengths = [0, 1, 3, 9, 17, 40, 200]
    return [None if rng.random() < 0.1 else "".join(rng.choice(LETTERS) for _ in range(rng.choice(lengths))) for _ in range(rng.randrange(1, 12))]


def test_words_hash_alike_only_if_equal():
    rng = random.Random(3)
    known = {}
    for _ in range(300):
        texts = some_texts(rng) + ["", None, "x" * 5000 + " " + "x" * 4999, "a\0 a a\0\0"]
        skip = rng.randrange(2)
        hashes, bounds, starts = word_hashes(pa.array(texts, pa.string()).slice(skip))
        want = [lowered(t) for t in texts[skip:]]
        assert np.diff(bounds).tolist() == [len(w) for w in want]
        flat = [w for words in want for w in words]
        data = b"".join((t or "").encode() for t in texts[skip:]).lower()
        assert all(data[s : s + len(w)] == w for s, w in zip(starts.tolist(), flat, strict=True))
        for h, w in zip(hashes.tolist(), flat, strict=True):
            assert known.setdefault(h, w) == w
    assert len(set(known.values())) == len(known)
    assert len(word_hashes(pa.array([None, ""], pa.string()))[0]) == 0


def test_sets_of_shingles(monkeypatch):
    rng = random.Random(5)
    for coarse in (False, True):
        if coarse:  # hashes that mostly differ below the bits by which they are sorted first
            whole = hashing.mixed
            monkeypatch.setattr(hashing, "mixed", lambda x: whole(x) & np.uint64(0xF))
        for size in (1, 2, 5):
            texts = pa.array(some_texts(rng) + ["a b a b a b", "one two", None], pa.string())
            runs, item = shingle_runs(texts, size)
            sets, bounds = shingle_sets(texts, size)
            assert len(bounds) == len(texts) + 1
            for i in range(len(texts)):
                assert sets[bounds[i] : bounds[i + 1]].tolist() == sorted(set(runs[item == i].tolist()))
                n = len(lowered(texts[i].as_py()))
                assert (item == i).sum() == (max(1, n - size + 1) if n else 0)


def test_order_of_rarity():
    rng = random.Random(7)
    for many in (1, 9, 1 << 42):  # items too many for one number are sorted by their places
        item = np.sort(np.array([rng.randrange(many) for _ in range(60)], np.int64))
        rarity = np.array([rng.choice([0, 1, 2, COUNTERS - 1]) for _ in item], np.int64)
        places = range(len(item))
        assert by_rarity(item, rarity).tolist() == sorted(places, key=lambda k: (item[k], rarity[k], k))
    assert len(by_rarity(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
