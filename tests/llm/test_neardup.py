"""Near duplicates: rows that share a key, recall near the threshold, and nodes that stay large."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import neardup

from .helpers import sentences


def changed(words: list[str], n: int, rng: random.Random) -> list[str]:
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.getrandbits(40)}"
    return out


def shingles(text: str, n: int) -> set:
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("by", ["operator", "stage"])
def test_rows_of_one_key_are_decided_by_their_own_texts(spark, by):
    base = sentences(21, 120, 9000)
    near = " ".join(changed(base.split(), 2, random.Random(1)))
    rows = [(1, base), (5, near), (5, sentences(22, 100, 9000)), (5, near), (6, None), (6, ""), (None, near), (7, sentences(23, 80, 9000)), (7, base), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("Mark", F.lit("m"))
    left = corpus_pipeline.near_copies(spark, docs, "") if by == "stage" else neardup.dedup(docs, n=5)
    assert left.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    assert kept == sorted([r for i, r in enumerate(rows) if i not in (1, 3, 8)], key=repr)


def near_pairs(rng: random.Random, count: int, boilerplate: list[str]) -> list[tuple[int, str]]:
    """Documents 2 i and 2 i + 1 are alike by 0.78 to 0.88 or so; all share the boilerplate."""
    docs = []
    for i in range(count):
        own = [f"w{rng.getrandbits(30)}" for _ in range(160 - len(boilerplate))]
        words = boilerplate + own
        other = boilerplate + changed(own, rng.randint(5, 9), rng)
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return docs


@pytest.mark.parametrize("shared,node_rows", [(0, 512), (75, 40)])
def test_recall_near_the_threshold(spark, shared, node_rows):
    """Two thousand documents. With boilerplate, all pairs of documents are alike by a third, and nodes are large at depth three."""
    rng = random.Random(shared)
    docs = near_pairs(rng, 1000, [f"b{i}" for i in range(shared)])
    of = {k: shingles(t, 2) for k, t in docs}
    alike = {i: len(of[2 * i] & of[2 * i + 1]) / len(of[2 * i] | of[2 * i + 1]) for i in range(1000)}
    done = neardup.clustered(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), n=2, node_rows=node_rows)
    component = {r["doc_id"]: r["component_id"] for r in done.collect()}
    near = [i for i, s in alike.items() if 0.8 <= s < 0.86]
    found = sum(component[2 * i] == component[2 * i + 1] for i in near)
    assert len(near) > 250 and found >= 0.99 * len(near), (found, len(near))
    assert all(component[2 * i + 1] == 2 * i + 1 and component[2 * i] == 2 * i for i, s in alike.items() if s < 0.8)


def test_nodes_branch_until_small_and_alike_ones_stay(spark):
    rng = random.Random(9)
    template = [f"t{i}" for i in range(100)]
    strangers = [(i, " ".join(changed(template, 30, rng))) for i in range(600)]  # alike by about a third
    base = [f"c{i}" for i in range(100)]
    copies = [(1000 + i, " ".join(changed(base, 1, rng))) for i in range(300)]
    docs = spark.createDataFrame(strangers + copies, "doc_id bigint, text string").repartition(4)
    join = neardup.Join(docs, "doc_id", "text", 2, 80, 10, 3, 24)
    sets = join.signed().groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("sign").alias("sign"))
    nodes = join.nodes(sets).join(sets.select("set", "rep"), "set").collect()
    large = [r for r in nodes if r["size"] > 24]
    assert large and sum(r["rep"] >= 1000 for r in large) > 0.95 * len(large)
    done = {r["doc_id"]: r["component_id"] for r in neardup.clustered(docs, n=2, node_rows=24).collect()}
    assert all(done[1000 + i] == 1000 for i in range(300)) and all(done[i] == i for i in range(600))
