"""Structured Streaming operators; each has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUN = 8


def appended(batch: DataFrame, path: str, key: str, buckets: int = 64) -> int:
    """Appends the rows of batch whose key the Parquet table at path does not have, one row a key; gives their number. Running it again adds nothing.

    The table is partitioned by a hash of the key (_bucket), so that a small batch reads the keys of its own buckets only.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    used = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # no more than buckets
    try:
        new = new.join(spark.read.parquet(path).where(F.col("_bucket").isin(used)).select(key), key, "left_anti")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(path)
        return n
    finally:
        new.unpersist()


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str):
    """A query that appends each micro-batch once by key, however often parts of it are read again."""
    return stream.writeStream.foreachBatch(lambda batch, _: appended(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first row of each key, with state kept for the delay only."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def guarded(stream: DataFrame, key: str, order: str, token: str, run: int = RUN) -> DataFrame:
    """Per key, for each token in order: how many came, and whether the last `run` equal those before and those before that. State is the last three runs.

    A micro-batch may bring the rows of a key in any order and in many pieces (they are held as two numbers a row);
    micro-batches have to be in order.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, [])
        codes: dict[str, int] = {}
        coded = lambda tokens: np.array([codes.setdefault(str(t), len(codes)) for t in tokens], np.int32)
        before, pieces = coded(last), [(pdf[order].to_numpy(), coded(pdf[token])) for pdf in batches]
        at, came = (np.concatenate(x) for x in zip(*pieces))
        place = np.argsort(at, kind="stable")
        at, seen = at[place], np.concatenate([before, came[place]])
        same = np.zeros(len(seen) + 1, np.int64)  # how many of the first tokens equal the one a run before
        same[run + 1 :] = np.cumsum(seen[run:] == seen[:-run]) if len(seen) > run else 0
        for i in range(0, len(at), 10_000):
            ends = np.arange(i, min(i + 10_000, len(at)))
            upto = ends + len(before) + 1
            repeats = same[upto] - same[np.maximum(upto - 2 * run, 0)] == 2 * run
            yield pd.DataFrame({key: k[0], order: at[ends], "tokens": n + 1 + ends, "repeats": repeats})
        names = list(codes)
        state.update((n + len(at), [names[c] for c in seen[-3 * run :]]))

    kind, at = stream.schema[key].dataType.simpleString(), stream.schema[order].dataType.simpleString()
    return stream.select(key, order, token).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {at}, tokens bigint, repeats boolean", "n bigint, last array<string>", "append", GroupStateTimeout.NoTimeout)


def run_events(stream: DataFrame, key: str, order: str, token: str, last: str, limit: int) -> DataFrame:
    """Per run (key) its token events in order, and exactly one done event after the last: at the token `last`, or when `limit` tokens have come.

    Rows: key, order, kind (token or done), tokens so far, reason (of done: end_token or token_limit). What comes after done
    gives nothing. A micro-batch may bring the rows of a key in any order and in many pieces; micro-batches have to be in order.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, over = state.get if state.exists else (0, False)
        first = None  # of all pieces, the rows that the limit leaves room for
        for pdf in batches:
            if not over:
                first = pdf[[order, token]] if first is None else pd.concat([first, pdf[[order, token]]])
                first = first.sort_values(order, kind="stable").head(max(1, limit - n))
        out = []
        for at, t in first.itertuples(index=False) if first is not None else ():
            n += 1
            out.append((k[0], at, "token", n, None))
            over = str(t) == last or n >= limit
            if over:
                out.append((k[0], at, "done", n, "end_token" if str(t) == last else "token_limit"))
                break
        yield pd.DataFrame(out, columns=[key, order, "kind", "tokens", "reason"])
        state.update((n, over))

    kind, at = stream.schema[key].dataType.simpleString(), stream.schema[order].dataType.simpleString()
    return stream.select(key, order, token).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {at}, kind string, tokens bigint, reason string", "n bigint, over boolean", "append", GroupStateTimeout.NoTimeout)


def progress(completed: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows with `done`: whether a resumed run has completed them; and per key how many are left is one aggregation away."""
    marks = completed.select(*keys).distinct().withColumn("_done", F.lit(True))
    return windows.join(marks, keys, "left").withColumn("done", F.coalesce("_done", F.lit(False))).drop("_done")


def leases(events: DataFrame, key: str, at: str, lease: str) -> DataFrame:
    """Spans of heartbeats of a key no further apart than the lease: start, end (when the lease runs out) and beats; for streams and tables."""
    rows = events.withWatermark(at, lease) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(at, lease).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def tumbling(events: DataFrame, at: str, width: str, *keys: str, delay: str | None = None) -> DataFrame:
    """Rows and sum of value per window; with a delay, late rows beyond it are left out of a stream."""
    rows = events.withWatermark(at, delay) if delay and events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, width: str, slide: str, delay: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, delay) if delay and events.isStreaming else events
    return rows.groupBy(F.window(at, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def late(events: DataFrame, order: str, at: str, delay_seconds: int) -> DataFrame:
    """Of a recorded stream in arrival order, the rows that come later than the delay behind the newest time seen before."""
    from pyspark.sql import Window

    newest = F.max(at).over(Window.partitionBy("user_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("newest", newest).where(F.col(at) < F.col("newest") - F.make_dt_interval(secs=F.lit(delay_seconds)))


def drained(spark: SparkSession, make: Callable[[DataFrame], DataFrame], path: str, schema, name: str, checkpoint: str, mode: str = "append", files: int | None = 4) -> DataFrame:
    """Runs make over the Parquet files at path as a stream until all are read, and gives what it wrote.

    In mode append rows go to a Parquet table beside the checkpoint; other modes keep theirs, small ones, in a memory table.
    files: how many make a micro-batch; None: all are one, as is due where order counts, for files have none.
    """
    source = spark.readStream.schema(schema)
    made = make((source if files is None else source.option("maxFilesPerTrigger", files)).parquet(path))
    out = made.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode != "append":
        out.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    out.format("parquet").queryName(name).start(f"{checkpoint}-rows").awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{checkpoint}-rows")


def unrecorded(wanted: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do: rows whose keys are not recorded."""
    return wanted.join(recorded.select(*keys).distinct(), keys, "left_anti")


def only_candidate(runs: DataFrame, pinned: dict[str, str]) -> DataFrame:
    """The one run that matches every pinned value; an error if there is none or more than one."""
    for name, value in pinned.items():
        runs = runs.where(F.col(name) == value)
    n = runs.limit(2).count()
    if n != 1:
        raise ValueError("no run matches" if n == 0 else "more than one run matches")
    return runs
