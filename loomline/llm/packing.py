"""Hierarchical multi-length packing of token sequences.

Documents are cut into full windows of the longest context and a rest. Each rest is routed to the tier, the smallest
context size that holds it, and waits in the tier's pool. The tiers are packed, longest first: a window starts with the
largest rest of its own pool, and its gap is filled with the largest rests that fit, of its own tier, then of shorter
ones; where none fits, the shortest rest is cut to measure. A tier is done when its pool is empty or all that is left
fills no window of it. What is left at the end is cut into windows of powers of two, so that no window has padding.
Windows are dealt to step groups of nearly equal token counts.

A block of documents is packed at a time, within one partition: nothing is shuffled, and memory has a bound.

Ids are those that the `tokenizers` library gives for the named vocabulary: the string of a special token in a text is
that token, unless `plain_specials` makes such strings ordinary text (see bpe).

Cases: a null or empty text is a document of the end id alone; repeated documents are packed one by one; an empty table
gives no piece; a null key stays null; a text of any length is one document; other columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder
from .frames import col, small_batches, table, trimmed
from .words import binary, chunks

TIERS = (1024, 512, 256)
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


Piece = tuple[int, int, int]  # document, start, length


class Pools:
    """The rests that wait in each tier: (length, document, start), ascending."""

    def __init__(self, rests: list[tuple[int, int, int]], tiers: tuple[int, ...]):
        self.tiers, self.left = tiers, sum(n for n, _, _ in rests)
        self.of: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        for rest in sorted(rests):
            self.of[self.tier(rest[0])].append(rest)

    def tier(self, n: int) -> int:
        """The smallest tier that holds n tokens."""
        return min(t for t in self.tiers if t >= n)

    def fitting(self, most: int) -> tuple[int, int, int] | None:
        """Takes the largest rest of at most `most` tokens: from the tier that holds so many, or a shorter one."""
        for t in self.tiers:
            if (pool := self.of[t]) and pool[0][0] <= most:
                return pool.pop(bisect_right(pool, (most, 1 << 62, 0)) - 1)
        return None

    def window(self, size: int) -> list[Piece]:
        """Fills a window of this size; there are that many tokens left."""
        out, gap = [], size
        while gap:
            n, d, start = self.fitting(gap) or next(self.of[t] for t in reversed(self.tiers) if self.of[t]).pop(0)
            if n > gap:  # all are longer: the shortest is cut to measure, and its end is a rest again
                insort(self.of[self.tier(n - gap)], (n - gap, d, start + gap))
                n = gap
            out.append((d, start, n))
            gap -= n
        self.left -= size
        return out


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows (size, [(document, start, length)]) for documents of these sizes: each id is in one window, and no window has padding."""
    longest = tiers[0]
    windows = [(longest, [(d, k * longest, longest)]) for d, n in enumerate(sizes) for k in range(n // longest)]
    pools = Pools([(n % longest, d, n // longest * longest) for d, n in enumerate(sizes) if n % longest], tiers)
    for tier in tiers:
        while pools.of[tier] and pools.left >= tier:
            windows.append((tier, pools.window(tier)))
    for power in (1 << k for k in reversed(range(longest.bit_length()))):
        while pools.left >= power:
            windows.append((power, pools.window(power)))
    return windows


def balance(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each window: groups of about step_tokens, the largest windows dealt first, each to the group that has least."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    heapify(groups)
    out = [0] * len(sizes)
    for w in sorted(range(len(sizes)), key=lambda w: -sizes[w]):
        held, out[w] = groups[0]
        heapreplace(groups, (held + sizes[w], out[w]))
    return out


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, plain_specials: bool = False, end_id: int = 0, tiers: tuple[int, ...] = TIERS, block_tokens: int = 1 << 21, step_tokens: int = 1 << 16) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's size), step_group.

    path: the file of the tokenizer, on every executor. The ids of a document are those of its text, then end_id.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers are powers of two, the longest first")

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(path, plain_specials), TaskContext.get().partitionId() << 40
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            windows = pack([len(x) for x in ids], tiers)
            groups = balance([size for size, _ in windows], step_tokens)
            out = []
            for w, (size, window) in enumerate(windows):
                offset = 0
                for d, start, n in window:
                    out.append((keys[d], start, n, zlib.crc32(ids[d][start : start + n]), len(ids[d]), base + w, offset, size, base + groups[w]))
                    offset += n
            base, held = base + len(windows), 0
            keys.clear()
            ids.clear()
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            own, found = batch.column(0).to_pylist(), binary(batch.column(1))
            for i, j in chunks(found):
                for k, made in zip(own[i:j], encode([(t or b"").decode() for t in found[i:j]])):
                    keys.append(k)
                    ids.append(np.append(made, np.uint32(end_id)))
                    held += len(ids[-1])
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(col(key).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
