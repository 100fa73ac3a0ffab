"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams, scanned over every document.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters outside ASCII. A window is n consecutive words of
one item; an item of fewer words, but not none, is one window. Window hashes of a document are looked up in the set;
hits are verified on the words themselves, so the hash decides nothing.

The set is broadcast in blocks of about `block_bytes` of item text: the documents go through one scan for each block. A
block is held as flat arrays, the items' words and 16 to 24 bytes for each window: some five times its text, eleven times
where every word is one letter (measured in tests/llm/test_decontam.py). So what a worker holds has that bound whatever
the benchmark's size. A usual benchmark is one block.

Cases: a null text has no words; an item without words has no window; the windows of an item without id hit words, but
no item is counted; repeated items are one item; repeated documents are judged one by one; an empty benchmark hits
nothing; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .frames import col, fresh, small_batches, table, trimmed
from .words import ALNUM_LOWER, U, Words, binary, chunks, rolling, window_starts

BITS = 20


class WindowSet:
    """The windows of some items: the items' words, and by length the sorted hashes of distinct windows, where each starts and its items."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.keys = sorted({k for k, _ in items if k is not None})
        at = {k: i for i, k in enumerate(self.keys)}
        owner = np.fromiter((-1 if k is None else at[k] for k, _ in items), np.int32, len(items))
        words = Words([b" ".join(t.translate(ALNUM_LOWER).split()) for _, t in items], ALNUM_LOWER)
        self.raw, h, counts = words.raw, words.hashes(), words.counts()
        self.by_size = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            some = np.flatnonzero(counts >= n if size == n else counts == size)
            many = counts[some] - size + 1
            first = np.repeat(words.first[:-1][some] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            self.by_size[size] = self._grouped(rolling(h, size)[first], words.starts[first], words.starts[first + size - 1] + words.lens[first + size - 1], np.repeat(owner[some], many))

    def _grouped(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of distinct windows: hashes, starts and ends of the words, where the items start (and the end); the items; a bitmap of the hashes' first bits."""
        order = np.lexsort((owner, h))
        h, start, end, owner = h[order], start[order], end[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        same = np.flatnonzero(~new)
        for j in {int(lead[i]) for i in same.tolist() if self.raw[start[i] : end[i]] != self.raw[start[lead[i]] : end[lead[i]]]}:
            new[lead == j] = True  # equal hashes of other words: each of these windows stands by itself
        keep = new.copy()
        keep[1:] |= owner[1:] != owner[:-1]
        group = np.cumsum(new)[keep] - 1
        heads = np.flatnonzero(new)
        bitmap = np.zeros(1 << BITS, bool)
        bitmap[h[heads] >> U(64 - BITS)] = True
        return h[heads], start[heads].astype(np.uint32), end[heads].astype(np.uint32), np.searchsorted(group, np.arange(len(heads) + 1)).astype(np.uint32), owner[keep], np.packbits(bitmap)

    def held(self) -> int:
        """Bytes of all arrays."""
        return len(self.raw) + sum(len(k) for k in self.keys) + sum(a.nbytes for arrays in self.by_size.values() for a in arrays)

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Whether each word is hit, and the items found in each text."""
        hit, found = np.zeros(len(words.starts) + 1, np.int64), {}
        h = words.hashes() if self.by_size else None
        for size, (hashes, start, end, first, owner, bitmap) in self.by_size.items():
            at = window_starts(words.first, size)
            if not len(at):
                continue
            seen = rolling(h, size)[at]
            place = seen >> U(64 - BITS)
            maybe = np.flatnonzero((bitmap[place >> U(3)] >> (U(7) - (place & U(7))).astype(np.uint8)) & 1)
            low, high = np.searchsorted(hashes, seen[maybe], "left"), np.searchsorted(hashes, seen[maybe], "right")
            maybe, low, high = (x[low < high] for x in (maybe, low, high))
            for i, d, a, b in zip(at[maybe].tolist(), (np.searchsorted(words.first, at[maybe], side="right") - 1).tolist(), low.tolist(), high.tolist()):
                own = words.joined(i, size)
                for g in range(a, b):
                    if self.raw[start[g] : end[g]] == own:
                        hit[i] += 1
                        hit[i + size] -= 1
                        found.setdefault(d, set()).update(owner[first[g] : first[g + 1]].tolist())
        return np.cumsum(hit[:-1]) > 0, {d: {self.keys[o] for o in owners if o >= 0} for d, owners in found.items()}


def blocks(items: DataFrame, key: str, text: str, n: int, block_bytes: int) -> Iterator[WindowSet]:
    """The items' windows in blocks; one block is on the driver at a time."""
    named = items.select(col(key).cast("string").alias("k"), col(text).cast("string").alias("t")).where("t is not null")
    total = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for b in range(count):
        part = named if count == 1 else named.where(F.pmod(F.xxhash64("t"), F.lit(count)) == b)
        yield WindowSet([(r["k"], r["t"].encode()) for r in part.collect()], n)


def _runs(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true flags, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))


def scanned(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 10, block_bytes: int = 32 << 20) -> tuple[DataFrame, list[str]]:
    """docs with n_words, hits (starts and ends of runs of hit words, flat) and items (ids); the names clash with no column."""
    small_batches(docs.sparkSession)
    names = fresh(docs.columns, "n_words", "hits", "items")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.ArrayType(T.StringType()))])
    done = docs.withColumn(names[0], F.lit(0).cast("bigint")).withColumn(names[1], F.array().cast("array<int>")).withColumn(names[2], F.array().cast("array<string>"))
    for k, block in enumerate(blocks(items, item_key, item_text, n, block_bytes)):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        done = (written(done, "decontam") if k else done).mapInArrow(trimmed(_scan(sent, text, names)), schema)
    return done, names


def _scan(sent, text: str, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            found = binary(batch.column(at(text)))
            count, hits, items = [], batch.column(at(names[1])).to_pylist(), batch.column(at(names[2])).to_pylist()
            for i, j in chunks(found):
                words = Words(found[i:j], ALNUM_LOWER)
                flags, by = sent.value.scan(words)
                count += words.counts().tolist()
                for d, new in by.items():
                    own = flags[words.first[d] : words.first[d + 1]].copy()
                    for a, b in zip(hits[i + d][::2], hits[i + d][1::2]):
                        own[a:b] = True
                    hits[i + d] = _runs(own).tolist()
                    items[i + d] = sorted({*items[i + d], *new})
            out = dict(zip(batch.schema.names, batch.columns)) | {names[0]: pa.array(count, pa.int64()), names[1]: pa.array(hits, pa.list_(pa.int32())), names[2]: pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return scan


def clean(docs: DataFrame, items: DataFrame, remove: str = "documents", key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words taken out of their texts; the columns as they were."""
    done, (_, hits, _) = scanned(docs, items, key, text, **more)
    columns = [col(c) for c in docs.columns]
    if remove == "documents":
        return done.where(F.size(col(hits)) == 0).select(*columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found, runs = binary(batch.column(at)), batch.column(batch.schema.get_field_index(hits)).to_pylist()
            for d, own in enumerate(runs):
                if own:
                    words, left, out = Words([found[d]], ALNUM_LOWER), 0, []
                    for a, b in zip(own[::2], own[1::2]):
                        out.append(found[d][left : words.starts[a] - 1])
                        left = words.starts[b - 1] + words.lens[b - 1] - 1
                    found[d] = b"".join([*out, found[d][left:]])
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else t.decode() for t in found], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return done.mapInArrow(cut, done.schema).select(*columns)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done, _ = scanned(docs, table(spark, sf_dir, "benchmark"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sum(h[1::2]) - sum(h[::2]) for h in batch.column(2).to_pylist()]
            items = batch.column(3).to_pylist()
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_words": batch.column(1), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()), "contaminated": pa.array([h > 0 for h in hits], pa.bool_()),
            })

    return done.select("doc_id", "n_words", "hits", "items").mapInArrow(digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


WORDS = "string_split_regex(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"
SQL = f"""
WITH d AS (SELECT doc_id, list_filter({WORDS.format("coalesce(text, '')")}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter({WORDS.format("coalesce(text, '')")}, lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS v FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT dw.doc_id, dw.n, dw.i, windows.item_id FROM dw JOIN windows ON dw.n = windows.n AND list_slice(dw.w, dw.i, dw.i + dw.n - 1) = windows.v),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
