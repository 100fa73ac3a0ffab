"""Packing against a packer of plain lists, and ids against the tokenizer."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from loomline.llm import packing

TIERS = (1024, 512, 256)


def tier_of(n: int) -> int:
    return next(t for t in reversed(TIERS) if t >= n)


def plain_packer(sizes: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The rules of the module, with one list that is searched from end to end."""
    windows = [(1024, [(d, at, 1024)]) for d, n in enumerate(sizes) for at in range(0, n - n % 1024, 1024)]
    rests = [(n % 1024, d, n - n % 1024) for d, n in enumerate(sizes) if n % 1024]

    def fill(size):
        window, gap = [], size
        while gap:
            fits = [r for r in rests if r[0] <= gap]
            rest = max(fits) if fits else min(rests)
            rests.remove(rest)
            n, d, start = rest
            if n > gap:
                rests.append((n - gap, d, start + gap))
                n = gap
            window.append((d, start, n))
            gap -= n
        windows.append((size, window))

    total = lambda: sum(r[0] for r in rests)
    for tier in TIERS:
        while total() >= tier and any(tier_of(r[0]) == tier for r in rests):
            fill(tier)
    power = 512
    while rests:
        while total() < power:
            power //= 2
        fill(power)
    return windows


@pytest.mark.parametrize("seed", range(12))
def test_windows_are_those_of_a_plain_packer(seed):
    rng = random.Random(seed)
    kinds = [(1, 256), (257, 512), (513, 1024), (1025, 5000)]
    sizes = [rng.randint(*rng.choice(kinds[: 1 + seed % 4] if seed < 8 else kinds)) for _ in range(rng.randint(0, 300))]
    assert packing.pack(sizes) == plain_packer(sizes)


def test_tiers_hold_their_own_documents():
    rng = random.Random(3)
    sizes = [rng.randint(1, 256) for _ in range(900)] + [rng.randint(257, 512) for _ in range(900)] + [rng.randint(513, 1023) for _ in range(900)] + [2048 + 700] * 5
    rng.shuffle(sizes)
    windows = packing.pack(sizes)
    assert sum(size for size, _ in windows) == sum(sizes) and sum(size < 256 for size, _ in windows) <= 8
    by = Counter(size for size, _ in windows)
    assert by[1024] > 900 and by[512] > 250  # each long rest starts a window of its tier; short ones fill gaps first
    firsts = [(size, window[0]) for size, window in windows if size in TIERS]
    assert all(tier_of(n) == size for size, (d, start, n) in firsts[:-10])
    long = [w for size, w in windows if size == 1024]
    assert any({tier_of(n) for _, _, n in w} >= {1024, 256} for w in long)  # gaps of long windows take rests of shorter tiers
    assert sum(len(w) > 1 and tier_of(w[0][2]) == 1024 for w in long) > 800


def test_steps_are_balanced():
    rng = random.Random(4)
    sizes = [rng.choice((1024, 512, 256, 64)) for _ in range(5000)]
    groups = packing.balance(sizes, 1 << 16)
    held = Counter()
    for size, g in zip(sizes, groups):
        held[g] += size
    assert max(held.values()) - min(held.values()) <= 1024 and len(held) == round(sum(sizes) / (1 << 16))


def test_ids_are_those_of_the_tokenizer(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = ["a", "b", "'", "s", "t", "re", " ", "  ", "\n", "\t", "1", "²", "!", "é", "中", "🙂", " ", "'ll", "_", "\x1c", "<|endoftext|>"]
    found = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))) for i in range(1500)] + [(5000, "a <|endoftext|> b"), (5001, "x" * 300_000), (5002, "".join(chr(0x4E00 + i % 20000) for i in range(100_000)))]
    docs = spark.createDataFrame(found, "doc_id bigint, text string")
    for plain in (False, True):
        encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        encoder.encode_special_tokens = plain
        want = {k: np.array([*encoder.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in found}
        assert (50256 in want[5000]) is not plain
        for r in packing.packed(docs, plain_specials=plain, block_tokens=20_000).collect():
            own = want[r["doc_id"]]
            assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


@pytest.mark.parametrize("bits", [5, 8, 21])
def test_ids_with_a_table_of_any_size(bits):
    """A table far smaller than the pieces of one text, long pieces, and a vocabulary that cuts in another way."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomline.llm.bpe import Encoder

    rng = random.Random(bits)
    word = lambda: "".join(rng.choice("abcdeé'1 \n中") for _ in range(rng.randint(1, 30)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(40)] + ["", "x" * 5000, " " * 300, "a <|endoftext|>b"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = Encoder(public_tokenizers.path(name), bits=bits)
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        for _ in range(2):
            assert [x.tolist() for x in own(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert own([]) == []


def test_pieces_of_equal_hash_are_told_apart(monkeypatch):
    import numpy as np
    import public_tokenizers

    from loomline.llm import bpe

    texts = ["one two three four five six seven", "eight nine ten"]
    want = [x.tolist() for x in bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"), bits=8)(texts)]
    monkeypatch.setattr(bpe, "mix", lambda x: np.zeros_like(x))
    assert [x.tolist() for x in bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"), bits=8)(texts)] == want
