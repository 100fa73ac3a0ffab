"""Language ID: code lengths against a plain model of dictionaries, and the bounds of the sample."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import langid

ORDER = 3


def normal(text: bytes) -> bytes:
    """Lower case, each run of ASCII that is no letter one space, no space at the ends."""
    return re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", text.lower() if text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in text)).strip(b" ")


def plain_model(sample: list[bytes], alphabet: list[int]):
    """-> p(symbol, context): prediction by partial matching with full exclusion, over the alphabet and one more symbol, None."""
    stream = list(b" " + b" ".join(normal(t) for t in sample) + b" ")
    seen: dict = defaultdict(Counter)
    for k in range(ORDER + 1):
        for i in range(k, len(stream)):
            seen[tuple(stream[i - k : i])][stream[i]] += 1
    symbols = [*alphabet, None]

    def p(x, context):
        if context is None:
            return 1 / len(symbols)
        shorter = context[1:] if context else None
        own = seen.get(context)
        if not own:
            return p(x, shorter)
        n, d = sum(own.values()), len(own)
        rest = sum(p(y, shorter) for y in symbols if y not in own)
        escape = d / (n + d) if rest > 0 else 0
        return own[x] / n * (1 - escape) if x in own else escape * p(x, shorter) / rest

    return p


def test_code_lengths_are_those_of_a_plain_model():
    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n)).encode()
    samples = {"a": [make("abcé", 30), make("ab", 20), b"X!1y"], "b": [make("abxyñ", 25)], "c": [b"zz"]}
    model = langid.Model(samples, ORDER)
    alphabet = sorted({b for ts in samples.values() for t in ts for b in normal(t)} | {32})
    texts = [make("abcéxyñz", 6), b"", None, b"qqq a", b"A  b", make("ab", 9), "é".encode(), b"1 2 3"]
    got, count = model.lengths(texts)
    for j, lang in enumerate("abc"):
        p = plain_model(samples[lang], alphabet)
        for i, t in enumerate(texts):
            own = [b if b in alphabet else None for b in normal(t or b"")]
            line, bits = [32, 32, 32, *own], 0.0
            if not own:  # a text without a letter: predicted() never asks for it
                continue
            for at in range(3, len(line)):
                context = tuple(-1 if b is None else b for b in line[at - 3 : at])
                bits -= math.log2(p(line[at], context))
            assert abs(got[i, j] - bits) < 1e-3 * max(1, bits), (lang, t)
            assert count[i] == len(own)


def test_probabilities_sum_to_one():
    model = langid.Model({"a": [b"abab abba cab"], "b": [b"xyz xxyz zzy \xc3\xa9"]})
    rng = np.random.default_rng(0)
    contexts = rng.integers(0, model.size**3, 500)
    contexts[:100] = model.trees[0].levels[3][2][rng.integers(0, len(model.trees[0].levels[3][2]), 100)]
    for tree in model.trees:
        for c in contexts.tolist():
            assert abs(np.exp2(-tree.bits(c * model.size + np.arange(model.size))).sum() - 1) < 1e-5


def test_sample_is_bounded_and_many_languages_are_told(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" text of letters")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 40).cast("string")).alias("lang"))
    model = langid.trained(docs, F.lit(True), all_bytes=40 * 200)
    assert len(model.langs) == 40 and model.held() <= 40 * 300 * 4 * 12 + 40 * 4096
    with pytest.raises(ValueError):
        langid.trained(docs, F.lit(True), most_langs=39)


def test_without_labels_nothing_is_lost(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "123", None), (3, None, None)], "doc_id bigint, text string, lang string")
    assert langid.trained(docs, F.lit(True)) is None
    assert [r["doc_id"] for r in langid.accepted(docs, None).collect()] == [1]
