"""Helpers for frames: column names that clash with nothing, and streaming rows past the side data of their bucket.

Cases: names are compared without case; a bucket without side data gets None; empty batches are passed over; a null key
counts as the empty text in `crc_mod`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no column has, in either case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark) -> None:
    """Arrow batches of few rows and bytes for this session: a worker and its JVM then hold little of long texts at a time."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        held = spark.conf.get(name, None)
        now = int(re.sub(r"\D", "", held)) if held and re.fullmatch(r"\d+[bB]?", held) else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def trimmed(f: Callable) -> Callable:
    """f over batches, after which the worker gives the memory that it has freed back to the machine: idle workers stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


_gave = [0.0]


def give_back(every: float = 0.0) -> None:
    """Gives freed memory back, unless that was done within the last seconds."""
    import ctypes
    import time

    if time.monotonic() - _gave[0] < every:
        return
    _gave[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only doc_id (bigint) and text."""
    return docs.select(col(key).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def past_side(rows: DataFrame, side: DataFrame, bucket: str, blob: str, f: Callable[[bytes | None, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """f(blob, batches) for every bucket of rows: the side frame holds one row (bucket, blob) a bucket at most.

    Rows and blobs of a bucket meet in one partition, sorted so that the blob comes first. Rows then go past it
    in Arrow batches: a task holds one blob and one batch, however many rows a bucket has.
    """
    both = rows.withColumn(blob, F.lit(None).cast("binary")).unionByName(side.select(bucket, blob), allowMissingColumns=True)
    both = both.repartition(*([partitions] if partitions else []), col(bucket)).sortWithinPartitions(col(bucket), col(blob).isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(bucket)
            keys, is_blob = batch.column(at), batch.column(batch.schema.get_field_index(blob)).is_valid().to_numpy(zero_copy_only=False)
            ends = [i for i, (a, b) in enumerate(zip(keys[:-1].to_pylist(), keys[1:].to_pylist()), 1) if a != b or is_blob[i - 1]] if batch.num_rows > 1 else []
            for i, j in zip([0, *ends], [*ends, batch.num_rows]):
                part, key = batch.slice(i, j - i), keys[i].as_py()
                if is_blob[i]:
                    held = (key, part.column(part.schema.get_field_index(blob))[0].as_py())
                else:
                    yield from f(held[1] if held[0] == key else None, iter([part]))

    return both.mapInArrow(trimmed(run), schema)
