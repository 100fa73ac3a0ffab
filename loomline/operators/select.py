"""Ranking, selection, sampling and splitting. Ties are always broken by the columns given; nothing depends on row order.

Where a rank or a running sum spans the whole table, rows are range-partitioned and each partition's total is added to
those after it (see placed): no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written

Names = Sequence[str]


def best_per_key(df: DataFrame, keys: Names, order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return top_k_per_key(df, keys, order, F.lit(1))


def top_k_per_key(df: DataFrame, keys: Names, order: Sequence[Column], k: Column) -> DataFrame:
    """The first k rows of each key; k may depend on the row."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def placed(df: DataFrame, order: Sequence[Column], value: Column | None = None) -> DataFrame:
    """df with `place` (0 for the first row in order) and, for a value, `before`: its sum over all rows before."""
    value = F.lit(1) if value is None else value
    rows = written(df.withColumn("_v", value.cast("bigint")).sort(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "placed")
    totals = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("v")).orderBy("_p").collect()
    at, total, bases = 0, 0, []
    for r in totals:  # one entry a partition
        bases.append((r["_p"], at, total))
        at, total = at + r["n"], total + (r["v"] or 0)
    within = Window.partitionBy("_p").orderBy("_i")
    base = df.sparkSession.createDataFrame(bases or [(0, 0, 0)], "_p int, _n bigint, _t bigint")
    rows = rows.withColumn("_r", F.row_number().over(within) - 1).withColumn("_s", F.coalesce(F.sum("_v").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(base), "_p").withColumn("place", F.col("_n") + F.col("_r")).withColumn("before", F.col("_t") + F.col("_s")).drop("_p", "_i", "_v", "_n", "_t", "_r", "_s")


def placed_within(df: DataFrame, within: Names, order: Sequence[Column], value: Column | None = None) -> DataFrame:
    """As placed, but `place` and `before` start anew in each group of `within`; a group of any size is spread over many tasks."""
    rows = placed(df, [*map(F.col, within), *order], value)
    if not within:
        return rows
    starts = rows.groupBy(*within).agg(F.min("place").alias("_p0"), F.min("before").alias("_b0"))
    match = F.lit(True)
    for k in within:
        match = match & F.col(f"_r.{k}").eqNullSafe(F.col(f"_s.{k}"))
    both = rows.alias("_r").join(starts.alias("_s"), match)
    return both.select(*[F.col(f"_r.{c}") for c in rows.columns if c not in ("place", "before")], (F.col("place") - F.col("_p0")).alias("place"), (F.col("before") - F.col("_b0")).alias("before"))


def capped_low(df: DataFrame, low: str, order: Sequence[Column], share: float = 0.20, least: int = 20, within: Names = ()) -> DataFrame:
    """All rows that are not low, and of the low ones the first: a share of the others' number, `least` at least (of each group of `within`)."""
    high = df.where(~F.col(low))
    ranked = placed_within(df.where(low), within, order).drop("before")
    cap = F.greatest(F.lit(least), F.floor(share * F.greatest(F.lit(1), F.coalesce(F.col("_n"), F.lit(0)))))
    counts = high.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(counts, list(within), "left") if within else ranked.crossJoin(F.broadcast(counts))  # one row
    return high.unionByName(ranked.where(F.col("place") < cap).drop("place", "_n"))


def round_robin(df: DataFrame, bucket: Names, order: Sequence[Column], n: int, within: Names = ()) -> DataFrame:
    """n rows (of each group of `within`): the first of every bucket in the buckets' order, then the second of each, and so on; all rows if there are no more."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*within, *bucket).orderBy(*order))).where(F.col("_rank") <= n)
    if not within:
        return ranked.orderBy("_rank", *bucket).limit(n).drop("_rank")
    return placed_within(ranked, within, [F.col("_rank"), *map(F.col, bucket)]).where(F.col("place") < n).drop("_rank", "place", "before")


def systematic(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Every k-th row in order, k as large as gives n rows; n at most."""
    rows = placed(df, order)
    step = max(1, rows.count() // n)
    return rows.where((F.col("place") % step == 0) & (F.col("place") < step * n)).drop("place", "before")


def quantile_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """n rows evenly spaced in order, first and last included; positions are rounded half to even."""
    rows = placed(df, order)
    total = rows.count()
    if total <= n:
        return rows.drop("place", "before")
    return rows.where(F.col("place").isin(sorted({round(i * (total - 1) / max(1, n - 1)) for i in range(n)}))).drop("place", "before")


def weighted_draws(df: DataFrame, weight: Column, key: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement, in proportion to weight, with `draw` 0 to n - 1.

    Draws are points on the line of all weights, found by the stretch they fall in; a point's place comes from a hash.
    """
    scale = 1_000_000
    rows = placed(df, [F.col(key)], F.greatest(weight, F.lit(0.0)) * scale).withColumn("_w", (F.greatest(weight, F.lit(0.0)) * scale).cast("bigint"))
    total = rows.agg(F.sum("_w")).first()[0] or 0
    points = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("_x"))
    cell = max(1, total // 4096)  # an equi-join on cells of the line stands for the range join
    cells = rows.where("_w > 0").withColumn("_c", F.explode(F.sequence(F.floor(F.col("before") / cell), F.floor((F.col("before") + F.col("_w") - 1) / cell))))
    return points.withColumn("_c", F.floor(F.col("_x") / cell)).join(cells, "_c").where((F.col("_x") >= F.col("before")) & (F.col("_x") < F.col("before") + F.col("_w"))).drop("_c", "_x", "_w", "before", "place")


def within_budget(df: DataFrame, group: Names, newest_first: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Of each group the newest rows whose sizes sum to the budget at most."""
    running = F.sum(size).over(Window.partitionBy(*group).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_sum", running).where(F.col("_sum") <= budget).drop("_sum")


def split_targets(total: int, train: float, validation: float) -> tuple[int, int]:
    """Sizes of train and validation, rounded half to even; from ten rows on none of the three is empty."""
    first, second = round(total * train), round(total * validation)
    if total >= 10:
        first = min(max(first, 1), total - 2)
        second = min(max(second, 1), total - first - 1)
    return first, second


def _rounded(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def prefix_split(groups: DataFrame, order: Sequence[Column], size: str, train: float = 0.8, validation: float = 0.1, within: Names = ()) -> DataFrame:
    """groups with `split`: whole groups in order go to train while fewer rows than its target are before them, then to validation, then to test; for each group of `within` by itself."""
    rows = placed_within(groups, within, order, F.col(size))
    if not within:
        first, second = split_targets(rows.agg(F.sum(size)).first()[0] or 0, train, validation)
        return rows.withColumn("split", F.when(F.col("before") < first, "train").when(F.col("before") < first + second, "validation").otherwise("test")).drop("place", "before")
    totals = rows.groupBy(*within).agg(F.sum(size).alias("_n"))
    first, second = _rounded(F.col("_n") * train), _rounded(F.col("_n") * validation)
    totals = totals.withColumn("_a", F.when(F.col("_n") >= 10, F.least(F.greatest(first, F.lit(1)), F.col("_n") - 2)).otherwise(first))
    totals = totals.withColumn("_b", F.when(F.col("_n") >= 10, F.least(F.greatest(second, F.lit(1)), F.col("_n") - F.col("_a") - 1)).otherwise(second))
    split = F.when(F.col("before") < F.col("_a"), "train").when(F.col("before") < F.col("_a") + F.col("_b"), "validation").otherwise("test")
    return rows.join(totals, list(within)).withColumn("split", split).drop("place", "before", "_n", "_a", "_b")


def disjoint(df: DataFrame, keys: Names, split: str) -> DataFrame:
    """df, or an error if a key of any of the columns is in more than one split."""
    for key in keys:
        shared = split_overlap(df.where(F.col(key).isNotNull()), [key], split).limit(3).collect()
        if shared:
            raise ValueError(f"{key} is in more than one split: {[r[key] for r in shared]}")
    return df


def hash_split(key: Column, parts: Sequence[tuple[str, int]] = (("train", 800), ("validation", 900), ("test", 1000))) -> Column:
    """A split by the first 15 hexadecimal digits of the key's SHA-256, modulo 1000; parts are (name, upper bound)."""
    at = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("bigint") % 1000
    out = F.lit(parts[-1][0])
    for name, bound in reversed(parts[:-1]):
        out = F.when(at < bound, F.lit(name)).otherwise(out)
    return out


def balanced_hash_split(groups: DataFrame, key: str, size: str, seed: int) -> DataFrame:
    """groups with `split`: 80, 10 and 10 percent by a hash of seed and key; where validation or test has too few rows, train gives groups, in the order of another hash, until it has enough."""
    from ..functions.text import stable_hash

    hashed = lambda *parts: stable_hash(F.concat_ws("|", *parts))
    at = (hashed(F.lit(str(seed)), F.col(key)) % 1000).cast("int")
    out = groups.withColumn("split", F.when(at < 800, "train").when(at < 900, "validation").otherwise("test"))
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = min(24, max(12, total // 15))
    for target in ("validation", "test"):
        have = out.where(F.col("split") == target).agg(F.sum(size)).first()[0] or 0
        if have < least:
            donors = placed(out.where("split = 'train'"), [hashed(F.lit("rebalance"), F.lit(target), F.col(key)), F.col(key)], F.col(size))
            given = donors.withColumn("split", F.when(F.col("before") < least - have, F.lit(target)).otherwise(F.col("split"))).drop("place", "before")
            out = out.where("split <> 'train'").unionByName(given)
    return out


def split_overlap(df: DataFrame, keys: Names, split: str) -> DataFrame:
    """Keys that are in more than one split, and in how many."""
    return df.groupBy(*keys).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def day_windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Half-open windows of some days from start to end, the last one cut off."""
    first = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1), F.expr(f"interval {days} days"))).alias("window_start"))
    return first.withColumn("window_end", F.least(F.date_add("window_start", days), F.lit(end).cast("date")))


def bisected(spark: SparkSession, days: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """Windows of at most `most` rows, from halving denser ones down to a day. days: (day, rows), one row a day at most."""
    at = [(start, end)]
    found: list[tuple[str, str, int]] = []
    counts = {r["day"]: r["rows"] for r in days.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).collect()}  # one entry a day
    import datetime as dt

    while at:
        a, b = (dt.date.fromisoformat(x) if isinstance(x, str) else x for x in at.pop())
        n = sum(counts.get(a + dt.timedelta(k), 0) for k in range((b - a).days))
        if n <= most or (b - a).days <= 1:
            found.append((a, b, n))
        else:
            middle = a + dt.timedelta((b - a).days // 2)
            at += [(middle, b), (a, middle)]
    return spark.createDataFrame(sorted(found), "window_start date, window_end date, rows bigint")


def branch(messages: DataFrame, group: Names, order: str, at: int, text: str, edited: str) -> DataFrame:
    """Of each group the turns up to number `at`, its text replaced."""
    return messages.where(F.col(order) <= at).withColumn(text, F.when(F.col(order) == at, F.lit(edited)).otherwise(F.col(text)))


def gaps(df: DataFrame, group: Names, start: str, end: str) -> DataFrame:
    """df with `fault`: gap or overlap where a row does not start where the one before it ends, else null."""
    before = F.lag(end).over(Window.partitionBy(*group).orderBy(start, end))
    return df.withColumn("fault", F.when(F.col(start) > before, "gap").when(F.col(start) < before, "overlap"))


def islands(df: DataFrame, group: Names, order: str, label: str, text: str, separator: str) -> DataFrame:
    """Consecutive rows of one label as one: group, island (from 0), label, text joined, rows, first and last order."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), separator)
    return rows.groupBy(*group, "island", label).agg(joined.alias(text), F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))


def highest_complete(files: DataFrame, directory: str, name: str, number: Column, required: Sequence[str]) -> DataFrame:
    """The directory of the highest number that has every required file."""
    have = files.groupBy(directory).agg(*[F.bool_or(F.col(name) == r).alias(f"_{k}") for k, r in enumerate(required)], F.max(number).alias("number"))
    return have.where(" AND ".join(f"_{k}" for k in range(len(required)))).orderBy(F.col("number").desc(), directory).limit(1).select(directory, "number")
