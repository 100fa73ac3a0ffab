"""Sharding: overfull ranges, groups of equal texts, and what a pass sends to the driver."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomline.llm import shard


def test_all_overfull_ranges_are_divided(spark, monkeypatch):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("hash"), "id", (F.col("id") % 90 + 1).alias("size"), F.when(F.col("id") % 500 == 0, 40).otherwise(1).cast("bigint").alias("copies")).repartition(3).cache()
    drawn, sent = shard._draw, []

    def few(rows, wanted, salt):
        found = drawn(rows, wanted, salt)
        sent.append(len(found))
        return found if salt else sorted(found, key=lambda r: r["hash"])[::100]  # a poor sample: far too few splitters

    monkeypatch.setattr(shard, "_draw", few)
    splitters = shard.splitters_of(rows, 32, 100, 20, 64)
    share = 1.0 * rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] / 1000
    held = shard._ranged(rows, splitters).groupBy("range").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.max(F.col("size") * F.col("copies")).alias("key"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] <= 40 and r["b"] - r["key"] <= 2 * share for r in held)  # a key of many copies may be more by itself
    assert 5000 < sent[0] < 9000 and len(sent) > 1 and sent[1] < 64 * 100 * 1.3


def test_groups_are_cut_by_boundaries_only(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("text "), (F.col("id") % 900).cast("string"))).alias("text"))
    got = shard.sharded(docs, 8, range_rows=200).join(docs, "doc_id").collect()
    where, size = defaultdict(set), Counter()
    for r in got:
        where[r["text"]].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert len(got) == 9000 and max(size.values()) - min(size.values()) <= 20
    assert sum(len(x) - 1 for x in where.values()) <= 7 and len(where["hot"]) >= 2


def test_places_are_those_of_a_running_sum(spark):
    docs = [(i % 700, "x" * (i * 7919 % 53)) for i in range(1500)] + [(None, None), (None, ""), (3, "é" * 40)]
    got = shard.sharded(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), 5, range_rows=100).collect()
    total, parts = sum(r["size"] for r in got), defaultdict(list)
    for r in got:
        parts[r["shard"]].append((r["slot"], r["size"]))
    at = 0
    for s in range(5):
        assert [slot for slot, _ in sorted(parts[s])] == list(range(len(parts[s])))
        for _, size in sorted(parts[s]):
            assert (at + size // 2) * 5 // total == s  # a record lies where its middle falls
            at += size
