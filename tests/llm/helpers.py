"""A small table with every odd case, and its plain Python form."""

from __future__ import annotations

import random

CLASHING = ["digest", "keep_id", "group_size", "kept", "bucket", "blob", "here", "n_words", "hits", "items", "lang_pred", "score", "bits", "letter", "gone", "hash", "size", "set", "node", "Text_"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)


def sentences(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}x" for _ in range(n))


def rows() -> list[tuple]:
    base, other = sentences(1, 120), sentences(2, 90)
    near = base.split()
    near[50] = "changed"
    found = [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (None, other), (5, base), (5, base), (6, "z" * 200_000), (7, sentences(3, 3000)), (8, " ".join(near)), (9, "one"), (10, "one"), (11, "ONE two"), (12, "12345 !!! 678"),
        (13, "début café " * 30), (14, sentences(4, 60) + " " + " ".join(base.split()[20:70])), (None, None), (-15, base.upper()), (16, "mail me at a.b@mail.example.com or +1 (171) 555-2028, 10.0.0.1 4111 1111 1111 1111"),
    ]
    return [(k, t, ("en", "fr", None)[i % 3], f"src{i % 2}" if i % 4 else None, None if t is None else len(t), *[f"c{i}"] * len(CLASHING)) for i, (k, t) in enumerate(found)]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain() -> list[tuple]:
    return [(r[0], r[1]) for r in rows()]


def as_list(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
