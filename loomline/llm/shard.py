"""Sharding by sampled splitters: records in order of (hash of the text, key), cut so that shards hold nearly equal bytes.

A sample of keys, weighted by size, gives splitters at even quantiles, and records are dealt to the ranges between them.
All ranges that hold over twice their share are subdivided in one pass, by splitters drawn in each, until none is left or
what is left cannot be divided: one key (and its copies) that is more than that by itself. Each record is drawn or not by itself, with odds by its size, so a
pass sends the driver about `sample` keys, or `again` for each overfull range, whatever the number of tasks. The exact bytes and rows of the ranges then place every record: a record belongs to the shard in whose
stretch of the bytes its middle lies, and its slot is its place among the shard's records. So shards are equal up to one
record, equal texts lie side by side, and a group of copies is cut only by one of the shards - 1 boundaries: it goes on in
the next shard. (Keeping every group whole would break the law of bytes where a group is larger than a shard.)

Cases: a null text has no bytes (size 1); a null key comes first; rows equal in key and text are counted, not carried,
and take consecutive places; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .frames import col, table

LAW = "bytes"
LOWEST = -(1 << 63)


def _draw(rows: DataFrame, wanted, salt: int) -> list:
    """Rows drawn each by itself, as likely as large: those whose exponential time, at the rate of their bytes, is under `wanted`."""
    u = (F.pmod(F.xxhash64("hash", "id", F.lit(salt)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return rows.where(-F.log(u) / (F.col("size") * F.col("copies")) < wanted).collect()


def _quantiles(drawn: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    drawn = sorted(drawn)
    return sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if len(drawn) >= parts else sorted(set(drawn[1:]))


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """rows with the number of the range that (hash, id) lies in."""
    hashes, ids = np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((hashes, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids = sent.value
        for batch in batches:
            h, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            out = low.copy()
            for r in np.flatnonzero(low < high):
                out[r] += np.searchsorted(ids[low[r] : high[r]], i[r], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", range bigint")


def splitters_of(rows: DataFrame, least: int, sample: int, range_rows: int, again: int) -> list[tuple[int, int]]:
    """Splitters of (hash, id, size, copies) for `least` ranges or more, none of over twice its share of bytes or 2 * range_rows rows if it can be divided."""
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)).alias("bytes")).first()
    parts = max(least, -(-whole["n"] // range_rows))
    drawn = _draw(rows.select("hash", "id", "size", "copies"), max(sample, 8 * parts) / max(whole["bytes"], 1), 0)
    splitters = _quantiles([(r["hash"], r["id"]) for r in drawn], parts)
    totals = F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.count(F.lit(1)).alias("rows")
    share, salt = whole["bytes"] / parts, 0
    while True:
        found = _ranged(rows, splitters).groupBy("range").agg(*totals).where((F.col("rows") > 1) & ((F.col("rows") > 2 * range_rows) | (F.col("bytes") > 2 * share))).select("range", "bytes").collect()
        if not found:
            break
        salt += 1
        over = rows.sparkSession.createDataFrame([(r["range"], again / r["bytes"]) for r in found], "range bigint, wanted double")
        inside: dict[int, list[tuple[int, int]]] = {}
        for r in _draw(_ranged(rows, splitters).join(F.broadcast(over), "range").select("range", "hash", "id", "size", "copies", "wanted"), F.col("wanted"), salt):
            inside.setdefault(r["range"], []).append((r["hash"], r["id"]))
        more = {*splitters, *(s for drawn in inside.values() for s in _quantiles(drawn, 8))}
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    return splitters


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", sample: int = 8192, range_rows: int = 200_000, again: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(body).alias("hash"), F.coalesce(col(key).cast("bigint"), F.lit(LOWEST)).alias("id"), col(key).isNull().alias("none"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    rows = written(rows.groupBy("hash", "id", "none", "size", "crc").agg(F.count(F.lit(1)).alias("copies")), "shard")
    splitters = splitters_of(rows, 4 * shards, sample, range_rows, again)
    totals = F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("copies")
    found = {r["range"]: r for r in _ranged(rows, splitters).groupBy("range").agg(*totals).collect()}
    total, at, before = sum(r["bytes"] for r in found.values()), 0, []
    place = 0
    for part in range(len(splitters) + 1):
        before.append((part, at, place))
        if part in found:
            at, place = at + found[part]["bytes"], place + found[part]["copies"]
    base = docs.sparkSession.createDataFrame(before, "range bigint, bytes_before bigint, rows_before bigint")
    order = Window.partitionBy("range").orderBy("hash", "id", "none", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = _ranged(rows, splitters).withColumn("b", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))).withColumn("r", F.coalesce(F.sum("copies").over(order), F.lit(0)))
    placed = placed.join(F.broadcast(base), "range").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    middle = F.col("bytes_before") + F.col("b") + F.col("copy") * F.col("size") + F.floor(F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")).withColumn("place", F.col("rows_before") + F.col("r") + F.col("copy"))
    placed = written(placed.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "place"), "shard")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    done = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
