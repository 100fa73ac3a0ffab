"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def _stars(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as stars: every node with the smallest one that a run of links connects it to. A run ends at `most` nodes, which bounds what is held."""
    up: dict = {}
    kinds: list = []

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i, kind in enumerate(kinds)], names=["u", "v"])

    for batch in batches:
        kinds = [batch.column(0).type, batch.column(1).type]
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) >= most:
            yield flush()
    if up:
        yield flush()


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the smallest node of its component.

    Links are first contracted to stars within each partition, run by run, which leaves short chains of runs. Each round after
    that is two aggregations and joins on nodes; the number of rounds grows with the logarithm of the longest chain. A
    node of very many links is an ordinary skewed join key. Rounds are written to the shared folder.
    """
    kind = links.schema["a"].dataType.simpleString()
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges, seen = written(edges.mapInArrow(_stars, f"u {kind}, v {kind}").distinct(), "links"), None
    size = edges.count()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", size)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(now) == seen:
            break
        seen, size = tuple(now), now["n"]
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").cast(kind).alias("label")).distinct())


def _named(name: str):
    return lambda x: F.concat(F.lit(name + ":"), x.cast("string"))


def linked_by_keys(rows: DataFrame, row: str, keys: Mapping[str, Column]) -> DataFrame:
    """rows with `component`: the smallest row id reachable over shared keys; each named column is an array of keys.

    A key of any number of rows gives a link from each of them to its first, never all pairs; null keys link nothing.
    """
    parts = [rows.select(F.col(row).alias("_r"), F.explode(F.transform(values, _named(name))).alias("_k")) for name, values in keys.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = written(found.where("_k IS NOT NULL").distinct(), "keys")
    links = found.join(found.groupBy("_k").agg(F.min("_r").alias("_first")), "_k").select(F.col("_r").alias("a"), F.col("_first").alias("b")).where("a <> b").distinct()
    labels = components(links).select(F.col("node").alias(row), F.col("label").alias("component"))
    return rows.join(labels, row, "left").withColumn("component", F.coalesce("component", row))
