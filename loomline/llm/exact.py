"""Exact dedup by a minimal perfect hash over historical distinct digests.

The digests of the history get slots by a minimal perfect hash, one for each bucket of digests. A slot holds the full
digest and the locator of its winner. A looked-up digest hits a slot in any case, so all 32 bytes of it are compared;
digests that are no members group separately, in a sorted table beside the slots.

Cases: a null text counts as empty; a null doc_id is smaller than any other; of rows equal in doc_id and text one is
kept; an empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .frames import col, crc_mod, fresh, past_side, small_batches, table, trimmed
from .words import U, mix

GAMMA, LEVELS = 2.0, 40


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte keys: in each level the keys that are alone at their place take it, the others go on."""

    def __init__(self, keys: np.ndarray):
        left, self.bits, self.ranks, before = np.arange(len(keys)), [], [], 0
        self.slot = np.zeros(len(keys), np.int64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(int(len(left) * GAMMA), 64)
            at = self._place(keys[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - alone + before
            ok = alone[at]
            self.slot[left[ok]] = rank[at[ok]]
            self.bits.append(np.packbits(alone))
            self.ranks.append(rank[::512].astype(np.int64))
            before += int(alone.sum())
            left = left[~ok]
        self.sizes = [len(b) * 8 for b in self.bits]
        self.rest = keys[left]  # none in practice; found by comparison
        self.slot[left] = before + np.arange(len(left))
        self.members = before

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, level % 3 + 1] + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each member; any slot or -1 for others."""
        out, left, n = np.full(len(keys), -1), np.arange(len(keys)), len(self.slot)
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            size = max(int(n * GAMMA), 64)
            at = self._place(keys[left], level, size)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            found = at[hit]
            ones = np.bitwise_count(bits)
            upto = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
            within = np.bitwise_count(bits[found >> 3] >> (8 - (found & 7)).astype(np.uint8))
            out[left[hit]] = upto[found >> 3] - upto[(found >> 9) << 6] + ranks[found >> 9] + within
            n -= int(ones.sum(dtype=np.int64))
            left = left[~hit]
        for k, key in enumerate(self.rest):
            out[left[(keys[left] == key).all(axis=1)]] = self.members + k
        return out


class DigestIndex:
    """Digests with (winner or null, size): members of the history in slots, others in a sorted table."""

    def __init__(self, digests: np.ndarray, historical: np.ndarray, winners: np.ndarray, known: np.ndarray, sizes: np.ndarray):
        old = np.flatnonzero(historical)
        self.hash = PerfectHash(digests[old])
        order = np.empty(len(old), np.int64)
        order[self.hash.slot] = old
        self.slots = digests[order], winners[order], known[order], sizes[order]
        new = np.flatnonzero(~historical)
        new = new[np.argsort(digests[new, 0], kind="stable")]
        self.others = digests[new], winners[new], known[new], sizes[new]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """found, winner, winner known, size."""
        out = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)

        def take(rows: np.ndarray, at: np.ndarray, of: tuple) -> None:
            same = (of[0][at] == keys[rows]).all(axis=1)
            rows, at = rows[same], at[same]
            out[0][rows] = True
            for o, x in zip(out[1:], of[1:]):
                o[rows] = x[at]

        slot = self.hash(keys)
        take(np.flatnonzero(slot >= 0), slot[slot >= 0], self.slots)
        left, at = np.flatnonzero(~out[0]), np.searchsorted(self.others[0][:, 0], keys[~out[0], 0])
        while len(left):  # a step further for each digest of equal first bytes
            inside = at < len(self.others[0])
            left, at = left[inside], at[inside]
            same = self.others[0][at, 0] == keys[left, 0]
            left, at = left[same], at[same]
            take(left, at, self.others)
            more = ~out[0][left]
            left, at = left[more], at[more] + 1
        return out


def as_words(digests: pa.Array) -> np.ndarray:
    """Fixed digests as four big-endian words each."""
    return np.frombuffer(b"".join(digests.to_pylist()), ">u8").astype(U).reshape(-1, 4)


def _build(rows: pa.Table) -> pa.Table:
    """The index of one bucket as one row."""
    winners = rows["keep_id"].combine_chunks()
    made = DigestIndex(as_words(rows["digest"].combine_chunks()), rows["historical"].to_numpy(), winners.fill_null(0).to_numpy(), winners.is_valid().to_numpy(zero_copy_only=False), rows["size"].to_numpy())
    return pa.table({"bucket": pa.array([rows["bucket"][0].as_py()], pa.int32()), "blob": pa.array([pickle.dumps(made)], pa.binary())})


@lru_cache(maxsize=1)
def _loaded(blob: bytes) -> DigestIndex:
    return pickle.loads(blob)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def decided(docs: DataFrame, key: str = "doc_id", text: str = "text", historical: Column | None = None, digested: Column | None = None, bucket_rows: int = 200_000, hot_parts: int = 1000) -> tuple[DataFrame, list[str]]:
    """docs with digest, keep_id, group_size and kept (names that clash with no column; returned too).

    digested: the digest, where it is a column already. historical: true for rows of the history; without it, rows of even crc32 of the key count as such. Of equal
    texts the row of the largest key stays, from either side. A digest with over 1 / hot_parts of all rows is hot:
    there are at most hot_parts of those, which go to all tasks, so that their rows need no common bucket.
    """
    small_batches(docs.sparkSession)
    names = fresh(docs.columns, "digest", "keep_id", "group_size", "kept", "bucket", "blob", "here")
    digest, keep, size, kept, bucket, blob, here = names
    old = crc_mod(col(key), 2) == 0 if historical is None else historical
    rows = docs.withColumn(digest, digest_of(col(text)) if digested is None else digested)
    groups = written(rows.groupBy(col(digest).alias("digest")).agg(F.max(col(key).cast("bigint")).alias("keep_id"), F.count(F.lit(1)).alias("size"), F.coalesce(F.bool_or(old), F.lit(False)).alias("historical")), "exact")
    total = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows")).first()
    buckets = max(1, -(-total["n"] // bucket_rows), min(512, total["n"] // 500))
    where = lambda d: F.pmod(F.conv(F.hex(F.substring(d, 1, 4)), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
    index = groups.withColumn("bucket", where(F.col("digest"))).groupBy("bucket").applyInArrow(_build, T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())]))
    hot_rows = groups.where(F.col("size") > max(100, total["rows"] // hot_parts)).collect()
    hot = DigestIndex(np.frombuffer(b"".join(bytes(r["digest"]) for r in hot_rows), ">u8").astype(U).reshape(-1, 4), np.ones(len(hot_rows), bool), np.array([r["keep_id"] or 0 for r in hot_rows], np.int64), np.array([r["keep_id"] is not None for r in hot_rows], bool), np.array([r["size"] for r in hot_rows], np.int64))
    sent = rows.sparkSession.sparkContext.broadcast(hot)

    def fill(found: DigestIndex, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
        ok, winners, known, sizes = found.look_up(as_words(batch.column(batch.schema.get_field_index(digest))))
        return ok, pa.array(winners, pa.int64(), mask=~(ok & known)), pa.array(sizes, pa.int64(), mask=~ok)

    def put(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])

    def hot_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, winners, sizes = fill(sent.value, batch)
            yield put(batch, **{keep: winners, size: sizes})

    held = rows.mapInArrow(trimmed(hot_first), T.StructType([*rows.schema.fields, T.StructField(keep, T.LongType()), T.StructField(size, T.LongType())]))
    held = held.withColumn(bucket, F.when(col(size).isNull(), where(col(digest))).otherwise(-1 - F.pmod(F.xxhash64(col(key)), F.lit(1 << 10)).cast("int")))
    schema = T.StructType([f for f in held.schema.fields if f.name != bucket] + [T.StructField(kept, T.BooleanType())])

    def finish(part: bytes | None, batches: Iterator[pa.RecordBatch], seen: dict = {}) -> Iterator[pa.RecordBatch]:  # noqa: B006
        for batch in batches:
            at = batch.schema.get_field_index
            winners, sizes = batch.column(at(keep)), batch.column(at(size))
            if part is not None and sizes.null_count:
                ok, winners, sizes = fill(_loaded(part), batch)
                assert ok.all(), "a digest is missing from its bucket"
            own = (batch.column(at(bucket))[0].as_py(), pa.compute.cast(batch.column(at(key)), pa.int64(), safe=False).to_pylist())
            if seen.get("bucket") != own[0]:
                seen.update(bucket=own[0], digests=set())
            flags = []
            for d, k, w in zip(batch.column(at(digest)).to_pylist(), own[1], winners.to_pylist()):
                flags.append(k == w and d not in seen["digests"])
                if flags[-1]:
                    seen["digests"].add(d)
            out = {n: batch.column(at(n)) for n in batch.schema.names if n not in (bucket, blob)} | {keep: winners, size: sizes, kept: pa.array(flags)}
            yield pa.RecordBatch.from_arrays([out[f.name] for f in schema.fields], names=schema.names)

    done = past_side(held, index.select(F.col("bucket").alias(bucket), F.col("blob").alias(blob)), bucket, blob, finish, schema)
    return done, [digest, keep, size, kept]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs without the rows whose text another row of a larger key has; the columns as they were."""
    done, (_, _, _, kept) = decided(docs, key, text, **more)
    return done.where(col(kept)).select(*[col(c) for c in docs.columns])


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", digest_of(F.col("text")).alias("sha"))
    done, (digest, keep, size, kept) = decided(docs, digested=F.col("sha"))
    return done.select("doc_id", col(keep).alias("keep_id"), col(size).alias("group_size"), col(kept).alias("kept"), F.lower(F.hex(col(digest))).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
