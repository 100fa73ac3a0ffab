"""Substring dedup: windows of words that also start earlier lose their words; a count-min sketch finds where to look.

1. Each block of documents makes a count-min sketch of its windows (two rows of cells; sparse, as nearly all cells of a
   block are empty). The sketches are merged in shards of the cell space. A window's least cell never counts less than
   the window occurs, so windows whose cells do not both reach two are unique, and are not looked at again.
2. The other windows of each block, by a digest of their words, go to shards that group them: a shard tells each block
   which of its digests start earlier elsewhere. Each block sends a digest once, with the first place of it, however often
   it occurs. A digest is 128 bits: two 64-bit halves, each over other hashes of the words and with other factors; of
   10 ** 13 different windows two agree with odds of 1e-13.
3. Each block removes the words of all windows that start earlier somewhere.

The sketch has 2 * `cells` cells for each window of the corpus, so the share of unique windows that pass step 1 is the
same at every size; blocks and shards have bounded sizes, and only their number grows.

Cases: a null text has no words; a text shorter than a window loses nothing; a null key comes before all others; rows of
the same key start equally early, so that none removes the other's words at the same place; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..scratch import written
from . import blocks as B
from .frames import table
from .words import SPACED, U, Words, chunks, rolling, window_starts

ROWS = 2
CELLS, KEYS, REPEATED, EARLIER = 1, 2, 3, 4
LOWEST = -(1 << 63)


def _windows(texts: list[bytes | None], n: int) -> tuple[np.ndarray, ...]:
    """Of all windows: two halves of the digest, the text, the word it starts at."""
    parts = []
    for i, j in chunks(texts):
        words = Words(texts[i:j], SPACED)
        at = window_starts(words.first, n)
        doc = np.searchsorted(words.first, at, side="right") - 1
        parts.append((*(rolling(words.hashes(half), n, half)[at] for half in (1, 2)), doc + i, at - words.first[doc]))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))


class Plan:
    """How large things are: window length, shards of the sketch and bits of the cells of each, shards of the digests."""

    def __init__(self, n: int, text_bytes: int, cells: int, shard_bits: int):
        windows = max(1, text_bytes // 6)  # an estimate: it sets sizes, not results
        self.n, self.shard_bits = n, min(shard_bits, max(12, (windows * cells).bit_length() - 4))
        self.sketches, self.groups = -(-windows * cells >> self.shard_bits), max(8, -(-windows // 2_000_000))

    def cells(self, keys: np.ndarray) -> np.ndarray:
        """The cell of each hash: its shard of the sketch, then its place there."""
        return (_dealt(keys, self.sketches) << U(self.shard_bits)) | (keys & U((1 << self.shard_bits) - 1))


def _dealt(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; it grows with the hash."""
    return ((keys >> U(32)) * U(shards)) >> U(32)


def _split(shard: np.ndarray):
    """(shard, from, to) for runs of equal shards."""
    shard = shard.astype(np.int64)
    edges = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *edges], [*edges, len(shard)]):
        if b > a:
            yield int(shard[a]), a, b


def _sketch(plan: Plan):
    def run(block: int, blob: bytes):
        k1, k2, _, _ = _windows(B.documents(blob)[1], plan.n)
        for row, keys in enumerate((k1, k2)):
            cells, counts = np.unique(plan.cells(keys), return_counts=True)
            for shard, a, b in _split(cells >> U(plan.shard_bits)):
                local = (cells[a:b] - (U(shard) << U(plan.shard_bits))).astype(np.uint32)
                yield shard * ROWS + row, CELLS, block, B.pack(B.steps(local), np.minimum(counts[a:b], 2).astype(np.uint8))

    return run


def _merge(plan: Plan):
    def run(dest: int, by: dict):
        counts = np.zeros(1 << plan.shard_bits, np.uint8)
        for _, blob in by[CELLS]:
            step, own = B.unpack(blob)
            cells = np.cumsum(step, dtype=np.uint32)
            counts[cells] = np.minimum(counts[cells] + own, 2)
        for block, blob in by[CELLS]:
            cells = np.cumsum(B.unpack(blob)[0], dtype=np.uint32)
            yield block, REPEATED, dest, B.pack(B.steps(cells[counts[cells] >= 2]))

    return run


def _maybe(plan: Plan, by: dict) -> tuple:
    """ids, texts and the windows estimated repeated, ordered by digest, then by place; and where each distinct digest starts."""
    ids, texts = B.documents(by[B.DOCS][0][1])
    k1, k2, doc, start = _windows(texts, plan.n)
    for row, keys in enumerate((k1, k2)):
        parts = [np.cumsum(B.unpack(blob)[0], dtype=np.uint32).astype(U) + (U(dest // ROWS) << U(plan.shard_bits)) for dest, blob in by.get(REPEATED, ()) if dest % ROWS == row]
        found = np.concatenate(parts) if parts else np.zeros(0, U)
        cells = plan.cells(keys)
        ok = found[np.minimum(np.searchsorted(found, cells), max(len(found) - 1, 0))] == cells if len(found) else np.zeros(len(cells), bool)
        if row == 0:
            keep = ok
        else:
            keep &= ok
    k1, k2, doc, start = k1[keep], k2[keep], doc[keep], start[keep]
    key = np.array([LOWEST if i is None else i for i in ids], np.int64)
    order = np.lexsort((start, key[doc], k2, k1))
    k1, k2, doc, start = k1[order], k2[order], doc[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])) if len(k1) else np.zeros(0, np.int64)
    return texts, key, k1, k2, doc, start, first, ids


def _ask(plan: Plan):
    def run(block: int, by: dict):
        _, key, k1, k2, doc, start, first, _ = _maybe(plan, by)
        k1, k2, doc, start = k1[first], k2[first], doc[first], start[first]
        for shard, a, b in _split(_dealt(k1, plan.groups)):
            used, local = np.unique(key[doc[a:b]], return_inverse=True)
            yield shard, KEYS, block, B.pack(B.steps(k1[a:b]), k2[a:b], used, local.astype(np.uint32), start[a:b].astype(np.uint32))

    return run


def _first(dest: int, by: dict):
    """For each block, whether each of its keys starts earlier in another block."""
    parts = []
    for at, (_, blob) in enumerate(by[KEYS]):
        step, k2, used, local, start = B.unpack(blob)
        parts.append((np.cumsum(step, dtype=U), k2, used[local], start, np.full(len(step), at, np.int32)))
    k1, k2, key, start, of = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, key, k2, k1))
    k1, k2, key, start = k1[order], k2[order], key[order], start[order]
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    earlier = np.empty(len(order), bool)
    earlier[order] = (key != key[lead]) | (start != start[lead])
    at = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    for i, (block, _) in enumerate(by[KEYS]):
        yield block, EARLIER, dest, B.pack(np.packbits(earlier[at[i] : at[i + 1]]))


def _removed(plan: Plan, by: dict) -> tuple[list, list, list[np.ndarray | None]]:
    """ids, texts and, of each text that loses words, whether each word goes."""
    texts, key, k1, _, doc, start, first, ids = _maybe(plan, by)
    told = dict(by.get(EARLIER, ()))
    lost = np.zeros(len(first), bool)
    for shard, a, b in _split(_dealt(k1[first], plan.groups)):
        lost[a:b] = np.unpackbits(B.unpack(told[shard])[0], count=b - a).astype(bool)
    size = np.diff(np.concatenate([first, [len(k1)]]))
    lead = np.repeat(first, size)
    go = np.repeat(lost, size) | (key[doc] != key[doc[lead]]) | (start != start[lead]) if len(k1) else np.zeros(0, bool)
    doc, start = doc[go], start[go]
    order = np.argsort(doc, kind="stable")
    doc, start = doc[order], start[order]
    flags: list[np.ndarray | None] = [None] * len(texts)
    edges = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip([0, *edges], [*edges, len(doc)]):
        if b > a:
            flags[doc[a]] = start[a:b]
    return ids, texts, flags


def _cut(text: bytes | None, starts: np.ndarray | None, n: int) -> tuple[int, int, bytes]:
    """Words, words removed, and what is kept, joined by single spaces."""
    words = (text or b"").split()
    if starts is None:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    keep = np.cumsum(change[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _finish(plan: Plan, texts_too: bool):
    def run(block: int, by: dict) -> pa.Table:
        ids, texts, flags = _removed(plan, by)
        out = [_cut(t, s, plan.n) for t, s in zip(texts, flags)]
        last = pa.array([k.decode() for _, _, k in out], pa.string()) if texts_too else pa.array([hashlib.sha256(k).hexdigest() for _, _, k in out], pa.string())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([x[0] for x in out], pa.int64()), "n_removed": pa.array([x[1] for x in out], pa.int64()), "kept_text" if texts_too else "kept_sha256": last})

    return run


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 20, texts: bool = True, cells: int = 4, block_bytes: int = 16 << 20, shard_bits: int = 24) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or, without texts, kept_sha256) for each row of docs."""
    plan = Plan(n, B.text_bytes(docs, text), cells, shard_bits)
    made = written(B.made(docs, key, text, block_bytes, level=6), "substring")
    repeated = written(B.gathered(B.each(made, _sketch(plan)), _merge(plan)), "substring")
    earlier = B.gathered(B.gathered(made.unionByName(repeated), _ask(plan)), _first)
    return B.gathered(made.unionByName(repeated).unionByName(earlier), _finish(plan, texts), f"doc_id bigint, n_words bigint, n_removed bigint, {'kept_text' if texts else 'kept_sha256'} string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)


SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
