"""Personal data: exact base spans, what the labelers see, and precision and recall of the added spans on planted ones."""

from __future__ import annotations

import random
import re

import pytest

from loomline.llm import pii

from .helpers import sentences


def plain_base(text: str) -> list[tuple[str, int, int]]:
    """The patterns as stated, by re alone."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    parts = ["a", "B", "9", "25", "4111", "1111", ".", "-", "+", " ", "@", "x.y", "(", ")", "10.0.0.1", "é", "%", "_", "300", "\n", "4111 1111 1111 1111", "+1 (415) 555-2671", "a.b@c-d.org"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [(pii.KINDS[k], s, e) for s, k, e in pii.base_spans(text)] == plain_base(text), text


def luhn_number(rng: random.Random, prefix: str, size: int) -> str:
    body = prefix + "".join(rng.choice("0123456789") for _ in range(size - 1 - len(prefix)))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def planted(seed: int, count: int) -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, true spans beyond the base patterns): documents with true and look-alike spans in prose."""
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    area = lambda: rng.choice("23456789") + n(2)
    true = [
        ("email", lambda: f"{word()}.{word()} (at) {word()} (dot) {rng.choice(['com', 'org', 'de', 'net'])}"), ("email", lambda: f"{word()}[at]{word()}[dot]{rng.choice(['com', 'fr', 'io'])}"),
        ("ip", lambda: ":".join(f"{rng.randrange(0x1000, 0xFFFF):x}" for _ in range(8))), ("ip", lambda: f"2001:db8:{rng.randrange(0x1000, 0xFFFF):x}::{rng.randrange(16, 0xFFFF):x}"), ("ip", lambda: f"{rng.randint(11, 199)}[.]{rng.randint(10, 255)}[.]{rng.randint(10, 255)}[.]{rng.randint(10, 255)}"),
        ("phone", lambda: f"({area()}) {area()}-{n(4)}"), ("phone", lambda: f"{area()}-{area()}-{n(4)}"), ("phone", lambda: f"0044 20 {rng.choice('3789') + n(3)} {n(4)}"),
        ("card", lambda: luhn_number(rng, "4", 13)),
    ]
    false = [
        lambda: f"look at {word()} dot {word()}er", lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", lambda: f"0{n(2)}-1{n(2)}-{n(4)}",
        lambda: next(x for x in iter(lambda: rng.choice("0123789") + n(15), None) if not pii.luhn(x)), lambda: next(x for x in iter(lambda: "9" + n(12), None) if not pii.luhn(x)),
    ]
    cues = {"email": ["contact", "mail"], "ip": ["host", "server"], "phone": ["call", "tel", "phone"], "card": ["card", "visa"]}
    out = []
    for i in range(count):
        parts, spans = [sentences(seed * count + i, 12)], []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.55:
                kind, make = rng.choice(true)
                own = make()
                if rng.random() < 0.5:
                    parts.append(rng.choice(cues[kind]))
                spans.append((kind, own))
            else:
                own = rng.choice(false)()
                if rng.random() < 0.4:
                    parts.append(rng.choice(["order", "serial", "version"]))
            parts += [own, sentences(seed * count + i + 7, rng.randint(3, 8))]
        if rng.random() < 0.6:
            parts.append(rng.choice([f"{word()}@{word()}.org", f"{rng.randint(11, 190)}.{rng.randint(1, 250)}.7.9", f"+1 ({area()}) {area()}-{n(4)}", luhn_number(rng, "51", 16)]))
        out.append((" ".join(parts) + " end", spans))
    return out


def test_added_spans_on_planted_documents(spark):
    docs = planted(3, 1500)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["base"], r["spans"]) for r in pii.found(df).collect()}
    right = added = true = 0
    by = {k: [0, 0] for k in pii.KINDS}
    for i, (text, spans) in enumerate(docs):
        base = [f"{k}:{s}:{e}" for k, s, e in plain_base(text)]
        assert got[i][0] == base and set(base) <= set(got[i][1])
        new = [(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in got[i][1] if x not in base)]
        hits = sum(x in spans for x in new)
        right, added, true = right + hits, added + len(new), true + len(spans)
        for k, own in spans:
            by[k][0] += (k, own) in new
            by[k][1] += 1
    assert right >= 0.95 * added and right >= 0.85 * true, (right, added, true, by)
    assert all(hit >= 0.6 * n for hit, n in by.values()), by


def test_spans_of_a_small_table(spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.org or call (415) 555-2671, card 4111 1111 1111 1111"), (3, "host 10.0.0.1 and +1 (415) 555-2671"), (None, "x@y.zz " * 3), (5, "1234567890123456 " * 2)]
    extra = spark.createDataFrame([(10 + i, t) for i, (t, _) in enumerate(planted(4, 600))], "doc_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pii.fitted(extra)
    got = sorted(((r["doc_id"], r["base"], r["spans"]) for r in pii.found(docs, classifier=model).collect()), key=repr)
    want = [
        (1, [], []), (2, [], []), (3, ["email:5:14", "card:44:63"], ["email:5:14", "phone:23:37", "card:44:63"]), (3, ["ip:5:13", "phone:18:35"], ["ip:5:13", "phone:18:35"]),
        (None, ["email:0:6", "email:7:13", "email:14:20"], ["email:0:6", "email:7:13", "email:14:20"]), (5, [], []),
    ]
    assert got == sorted(want, key=repr)
    assert pii.found(docs.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_reliabilities():
    import numpy as np

    rng = np.random.default_rng(1)
    truth, right = rng.random(20000) < 0.3, np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.85])
    seen = np.where(rng.random((20000, 6)) < right, truth[:, None], ~truth[:, None]).astype(int)
    seen[rng.random((20000, 6)) < 0.2] = -1
    patterns, counts = np.unique(seen, axis=0, return_counts=True)
    q, theta, share = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.02
    for c, v in ((0, 0), (1, 1)):
        assert abs(theta[c, :, v + 1] / (theta[c, :, 1] + theta[c, :, 2]) - right).max() < 0.03


@pytest.mark.parametrize("text", ["at " * 50_000, "1 " * 100_000, "(415) " * 40_000, ":" * 200_000, "a" * 200_000 + "@", "00 " * 60_000, "a.b at c.d at " * 10_000])
def test_time_is_in_proportion(text):
    import time

    began = time.time()
    pii.candidates(text, pii.base_spans(text))
    assert time.time() - began < 5
