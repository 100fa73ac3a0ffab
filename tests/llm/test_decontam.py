"""The set of benchmark windows: what it holds, and windows whose hashes are equal."""

from __future__ import annotations

import pickle
import random

import numpy as np

from loomline.llm import decontam
from loomline.llm.words import ALNUM_LOWER, Words


def test_what_is_held_is_bounded_by_the_text():
    rng = random.Random(1)
    usual = [(str(i), " ".join(f"word{rng.randrange(5000)}" for _ in range(60)).encode()) for i in range(3000)]
    letters = [(str(i), " ".join(rng.choice("abcdefghij") for _ in range(400)).encode()) for i in range(1000)]
    for items, most in ((usual, 5), (letters, 13)):
        size = sum(len(t) for _, t in items)
        made = decontam.WindowSet(items, 10)
        assert made.held() <= most * size + (1 << 18)
        assert len(pickle.dumps(made)) <= made.held() + 100_000


def test_scan_is_a_search_for_words():
    rng = random.Random(2)
    items = [(str(i % 40) if i % 7 else None, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7))).encode()) for i in range(60)]
    made = decontam.WindowSet(items, 4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))).encode() for _ in range(50)]
    words = Words(texts, ALNUM_LOWER)
    flags, found = made.scan(words)
    for d, t in enumerate(texts):
        own, marked, keys = t.split(), set(), set()
        for key, item in items:
            parts = item.split()
            n = min(4, len(parts))
            for i in range(len(parts) - n + 1 if n else 0):
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == parts[i : i + n]:
                        marked.update(range(j, j + n))
                        keys.add(key)
        assert set(np.flatnonzero(flags[words.first[d] : words.first[d + 1]]).tolist()) == marked
        assert found.get(d, set()) == keys - {None}


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    items = [("1", b"red fish"), ("2", b"blue bird"), ("3", b"red fish"), ("4", b"green frog"), ("5", b"blue bird")]
    monkeypatch.setattr(decontam, "rolling", lambda h, n: np.zeros(len(h), np.uint64))
    made = decontam.WindowSet(items, 2)
    found = made.scan(Words([b"a blue bird", b"the red fish", b"green frog", b"blue fish"], ALNUM_LOWER))[1]
    assert found == {0: {"2", "5"}, 1: {"1", "3"}, 2: {"4"}}
