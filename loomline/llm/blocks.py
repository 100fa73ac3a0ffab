"""Blocks of documents that ask shards of a key space, and get answers back.

A block is a run of documents of about `block_bytes`, compressed in one row. Operators that need corpus-wide statistics of
very many keys send, from each block, its distinct keys (sorted, differences packed by byte planes) to the shards they
belong to; a shard merges what all blocks sent and answers each block, in the block's own order. A key that fills a third
of all rows is thus one entry for each block, and no task holds more than a block or a shard.

Cases: nulls and repeated rows are kept as they are in the blocks; an empty table makes no block; a text is a cell of Spark
and so under 2 GB, as is the block that holds it.

All rows are (dest, kind, part, blob): where a row goes, what it holds, where it came from, and the packed arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import give_back, small_batches, trimmed
from .frames import texts as only_texts
from .words import binary

SCHEMA = "dest bigint, kind int, part bigint, blob binary"
NAMES = ["dest", "kind", "part", "blob"]
DOCS = 0
Row = tuple[int, int, int, bytes]


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as byte planes, compressed; of unsigned numbers only the planes that are not all zero. Sorted keys shrink most as differences (see steps)."""
    out = []
    for a in arrays:
        size = -(-int(a.max()).bit_length() // 8) if a.dtype.kind == "u" and len(a) else a.itemsize
        out.append((a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)[:, :size].T.tobytes()))
    return zstandard.compress(pickle.dumps(out, 5), level)


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, planes in pickle.loads(zstandard.decompress(blob)):
        a = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        if planes:
            a[:, : len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
        out.append(a.view(kind).ravel())
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned numbers; cumsum (of the same kind) gives them back."""
    return np.diff(x, prepend=x.dtype.type(0))


def turns(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours in any order, the sign in the last bit; unturned gives the numbers back."""
    step = np.diff(x.astype(np.int64), prepend=0)
    return ((step << 1) ^ (step >> 63)).view(np.uint64)


def unturned(x: np.ndarray) -> np.ndarray:
    return np.cumsum((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64))


def batch(rows: list[Row]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=NAMES)


def made(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """A row for each block of docs: its own number as dest and part, and the packed (keys, texts)."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, keys, texts = TaskContext.get().partitionId() << 32, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, held, keys, texts
            out = batch([(number, DOCS, number, zstandard.compress(pickle.dumps((keys, texts), 5), level))])
            number, held, keys, texts = number + 1, 0, [], []
            return out

        for rows in batches:
            for k, t in zip(rows.column(0).to_pylist(), binary(rows.column(1))):
                keys.append(k)
                texts.append(t)
                held += len(t or b"") + 1
                if held >= block_bytes:
                    yield flush()
        if keys:
            yield flush()

    return only_texts(docs, key, text).mapInArrow(trimmed(run), SCHEMA)


def documents(blob: bytes) -> tuple[list[int | None], list[bytes | None]]:
    return pickle.loads(zstandard.decompress(blob))


def each(blocks: DataFrame, f: Callable[[int, bytes], Iterable[Row]]) -> DataFrame:
    """f(block, packed documents) for every block where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for dest, blob in zip(rows.column(0).to_pylist(), rows.column(3)):
                yield batch(list(f(dest, blob.as_py())))

    return blocks.mapInArrow(trimmed(run), SCHEMA)


def gathered(rows: DataFrame, f: Callable[[int, dict[int, list[tuple[int, bytes]]]], object], schema: str = SCHEMA, also: DataFrame | None = None) -> DataFrame:
    """f(dest, {kind: [(part, blob), ...] by part}) for every dest; it gives rows, or an Arrow table for another schema.

    also: more rows for the same dests; they are not joined to rows before the shuffle, so that one shuffle of rows serves
    every call on them in a query.
    """

    def run(table: pa.Table) -> pa.Table:
        dest, by = table["dest"][0].as_py(), {}
        for kind, part, blob in zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["blob"]):
            by.setdefault(kind, []).append((part, blob))
        by = {kind: sorted(found, key=lambda x: x[0]) for kind, found in by.items()}
        out = f(dest, {kind: [(part, blob.as_py()) for part, blob in found] for kind, found in by.items()})
        out = out if isinstance(out, pa.Table) else pa.Table.from_batches([batch(list(out))])
        give_back(every=2)
        return out

    if also is not None:
        return rows.groupBy("dest").cogroup(also.groupBy("dest")).applyInArrow(lambda a, b: run(pa.concat_tables([a, b])), schema)
    return rows.groupBy("dest").applyInArrow(run, schema)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
