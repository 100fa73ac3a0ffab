"""Joins beyond the plain equi-join, and the joins of the corpus workflow."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .select import placed_within


def with_parent(rows: DataFrame, parents: DataFrame, unavailable: DataFrame, key: str, parent: str) -> DataFrame:
    """rows with the struct `parent_row` and `parent_status`: not_applicable, found, the recorded status, or not_fetched. What is found counts as found, whatever was recorded."""
    found = parents.select(F.col(key).alias("_pid"), F.struct("*").alias("parent_row"))
    said = unavailable.select(F.col("id").alias("_uid"), F.coalesce("status", F.lit("unavailable")).alias("_said"))
    out = rows.join(found, rows[parent] == F.col("_pid"), "left").join(said, rows[parent] == F.col("_uid"), "left")
    status = F.when(rows[parent].isNull(), "not_applicable").when(F.col("_pid").isNotNull(), "found").when(F.col("_uid").isNotNull(), F.col("_said")).otherwise("not_fetched")
    return out.withColumn("parent_status", status).drop("_pid", "_uid", "_said")


def pending(wanted: DataFrame, *had: DataFrame) -> DataFrame:
    """Distinct keys of wanted (one column) that no other frame has; null is no key."""
    (key,) = wanted.columns
    out = wanted.where(F.col(key).isNotNull()).distinct()
    for other in had:
        out = out.join(other.toDF(key), key, "left_anti")
    return out


def coalesced(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All keys of either frame; each column from the first that has it."""
    a, b = first.alias("a"), second.alias("b")
    columns = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in first.columns if c != key and c in second.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *columns)


def chains(rows: DataFrame, key: str, parent: str, most: int = 8) -> DataFrame:
    """For each row `chain`: the keys from its oldest ancestor reached to itself, `most` at most; a key met again ends it.

    One left join a level, on columns of two keys; no recursion limit, and levels are few.
    """
    links = rows.select(F.col(key).alias("_k"), F.col(parent).alias("_up"))
    out = rows.withColumn("chain", F.array(key)).withColumn("_next", F.col(parent))
    for _ in range(most - 1):
        step = out.join(links, out["_next"] == links["_k"], "left")
        ok = F.col("_k").isNotNull() & ~F.array_contains("chain", F.col("_k"))
        out = step.withColumns({"chain": F.when(ok, F.concat(F.array("_k"), F.col("chain"))).otherwise(F.col("chain")), "_next": F.when(ok, F.col("_up"))}).drop("_k", "_up")
    return out.drop("_next")


def without_leaks(rows: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows that share none of the keys with held: an anti-join for each key, as one with OR would compare all pairs."""
    for key in keys:
        rows = rows.join(held.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows


def pruned_splits(train: DataFrame, validation: DataFrame, test: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Train and validation without what leaks: validation against test, train against both."""
    validation = without_leaks(validation, test, keys)
    return without_leaks(train, test.select(*keys).unionByName(validation.select(*keys)), keys), validation


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the latest right row of the same key at or before it (null if none), by one sort of both.

    Right rows sort before left rows of the same time; of right rows at one time the largest values win.
    """
    found = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    rows = left.withColumn("_at", F.col(left_at)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(found.schema["_v"].dataType))
    both = rows.unionByName(found, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def proximity(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, width: int) -> DataFrame:
    """Pairs of the same key whose positions differ by width at most: an equi-join on bands of positions, then the exact test."""
    band = lambda c: F.floor(c / (width + 1)).cast("bigint")
    a = left.withColumn("_band", F.explode(F.array(*[band(F.col(at)) + d for d in (-1, 0, 1)])))
    b = right.withColumnRenamed(at, "_other").withColumn("_band", band(F.col("_other")))
    return a.join(b, [*by, "_band"]).where(F.abs(F.col(at) - F.col("_other")) <= width).drop("_band").withColumnRenamed("_other", f"{at}_right")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (added, removed or changed) of what differs between two manifests."""
    a, b = old.alias("a"), new.alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").where(~F.col(f"a.{digest}").eqNullSafe(F.col(f"b.{digest}")))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").otherwise("changed")
    return out.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), change.alias("change"))


def by_turn(left: DataFrame, right: DataFrame, left_place: str, right_place: str, n: int) -> DataFrame:
    """Row i of left with row i mod n of right, whose places are distinct; right is broadcast if it is counted to be small."""
    few = right.where(F.col(right_place) < n)
    small = few.limit(100_001).count() <= 100_000
    return left.join(F.broadcast(few) if small else few, F.pmod(left[left_place], F.lit(n)) == few[right_place])


def grid(left: DataFrame, right: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Every pair of two small frames of settings; it refuses frames whose product is not small."""
    n = left.count() * right.count()
    if n > most:
        raise ValueError(f"a grid of {n} settings; {most} at most")
    return left.crossJoin(F.broadcast(right))


def upserted(config: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """config with the rows of new in place of those of the same key, whatever the case."""
    return config.join(new.select(F.lower(key).alias("_k")), F.lower(config[key]) == F.col("_k"), "left_anti").unionByName(new)


def state_after(state: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """The state of unavailable keys after new outcomes: what was found goes, other outcomes replace or add."""
    a, b = state.alias("a"), outcomes.alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").where(~F.coalesce(F.col("b.status") == "found", F.lit(False)))
    return out.select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), F.coalesce("b.status", "a.status").alias("status"))


def length_matched(targets: DataFrame, pool: DataFrame, most: int | None = None) -> DataFrame:
    """For each target, in order (place, length, digest), the unused row of its pool (neutral for even turns, other for odd) that is nearest in length.

    A row with the target's text (but for case and outer spaces) is passed over; of rows equally near the first by place, then
    id, is taken, and its id is used for both pools; null is an id like others. All rows are candidates, or the first `most`
    of each pool. Every choice takes a row away, so choosing is one task for each profile. It gets no texts, and only rows that
    may be chosen: at turn i of a pool i ids are used, so nothing is chosen beyond the i + 1 nearest ids that are in this pool
    alone with no target's text; and of rows alike in length and text (or with no target's text) no more than there are
    targets. targets: profile, place, text; pool: profile, kind, place, id, text.
    """
    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(t.strip().lower().encode("utf-8", "surrogatepass")).hexdigest()[:32])

    text, at = F.coalesce("text", F.lit("")), F.col("place").cast("bigint").alias("at")
    slim = lambda df, *names: df.select("profile", at, *names, F.length(text).cast("bigint").alias("size"), digest(text).alias("digest"))
    in_order = lambda *names: [F.col(c).asc_nulls_last() for c in names]
    joined = lambda a, b, how, *names: a.alias("a").join(b.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names], how)

    wanted = placed_within(slim(targets), ["profile"], in_order("at", "size", "digest")).withColumnRenamed("place", "turn").drop("before")
    n = (wanted.agg(F.max("turn")).first()[0] or 0) + 1
    half = (n + 1) // 2  # targets of a pool
    marks = wanted.select("profile", "digest").distinct()
    rows = slim(pool.where(F.col("kind").isin("neutral", "other")), "kind", F.col("id").cast("bigint").alias("id"))
    rows = written(joined(rows, marks, "left", "profile", "digest").select("a.profile", "kind", "at", "id", "size", F.col("b.digest").alias("mark")), "lengths")
    if most is not None:
        rows = placed_within(rows, ["profile", "kind"], in_order("at", "id", "size", "mark")).where(F.col("place") < most).drop("place", "before")

    # lengths and targets in a line: `before` counts the ids of a pool alone, one place each, half at most at a length
    own = rows.groupBy("profile", "id").agg(F.min("kind").alias("kind"), F.max("kind").alias("_last"), F.min(F.when(F.col("mark").isNull(), F.col("size"))).alias("size"))
    own = own.where("kind = _last AND size IS NOT NULL").select("profile", "kind", "size", F.lit(1).alias("n"))
    sizes = rows.select("profile", "kind", "size", F.lit(0).alias("n")).unionByName(own).groupBy("profile", "kind", "size").agg(F.least(F.sum("n"), F.lit(half)).alias("n"))
    turns = wanted.select("profile", F.when(F.col("turn") % 2 == 0, "neutral").otherwise("other").alias("kind"), "size", F.lit(0).alias("n"), (F.floor(F.col("turn") / 2) + 1).alias("reach"))
    line = placed_within(sizes.withColumn("reach", F.lit(None).cast("bigint")).unionByName(turns), ["profile", "kind"], [F.col("size")], F.col("n"))
    step = half // 8 + 1  # an equi-join on stretches of the line stands for the range join
    stretches = lambda low, high: F.explode(F.sequence(F.floor(low / step), F.floor(high / step))).alias("_s")
    reached = line.where("reach IS NOT NULL").select("profile", "kind", stretches(F.col("before") - F.col("reach"), F.col("before") + F.col("reach"))).distinct()
    near = line.where("reach IS NULL").select("profile", "kind", "size", stretches(F.col("before") - 1, F.col("before") + F.col("n")))
    near = joined(near, reached, "left_semi", "profile", "kind", "_s").select("profile", "kind", "size").distinct()
    offered = joined(rows, near, "left_semi", "profile", "kind", "size").groupBy("profile", "kind", "size", "mark", "id").agg(F.min("at").alias("at"))
    offered = placed_within(offered, ["profile", "kind", "size", "mark"], in_order("at", "id")).where(F.col("place") < n).drop("place", "before")
    return wanted.groupBy("profile").cogroup(offered.groupBy("profile")).applyInArrow(_nearest_unused, "profile string, place bigint, match_id bigint")


def _nearest_unused(key, mine, offered):
    """The choices of one profile for length_matched, as Arrow tables; chosen rows and lengths without rows are jumped over."""
    import pyarrow as pa
    import pyarrow.compute as pc

    mine = mine.sort_by("turn")
    if len(offered):
        offered = offered.sort_by([("at", "ascending"), ("id", "ascending")])
        offered = offered.append_column("rank", pa.array(np.arange(len(offered)))).sort_by([("kind", "ascending"), ("size", "ascending"), ("rank", "ascending")])
    column = lambda c: offered[c].combine_chunks()
    texts = pc.unique(mine["digest"])
    marks = pc.fill_null(pc.index_in(column("mark"), value_set=texts), -1).to_numpy(zero_copy_only=False)
    other = pc.equal(column("kind"), "other").to_numpy(zero_copy_only=False).astype(bool)
    sizes, ids = column("size").to_numpy(zero_copy_only=False), column("id")
    ranks = column("rank").to_numpy() if len(offered) else ids
    codes = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    by_code = np.argsort(codes, kind="stable")
    code_ends = np.searchsorted(codes[by_code], np.arange(codes.max(initial=-1) + 2))
    starts = np.flatnonzero(np.r_[True, (other[1:] != other[:-1]) | (sizes[1:] != sizes[:-1])]) if len(offered) else np.zeros(0, int)
    group_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(offered)]))
    lengths, neutral = sizes[starts], int((~other[starts]).sum())
    spans = ((0, neutral), (neutral, len(starts)))
    starts = np.r_[starts, len(offered)]
    free = np.diff(starts)
    after, up, down = np.arange(len(offered) + 1), np.arange(len(free) + 1), np.arange(len(free) + 1)  # down[g + 1] is of group g
    passed: dict[tuple[int, int], int] = {}

    def root(jump, i):
        while jump[i] != i:
            jump[i] = jump[jump[i]]
            i = jump[i]
        return int(i)

    def first(group: int, mark: int) -> list[int]:
        """The first free row of a group with another text; as rows only go, a search starts where the last one ended."""
        row = root(after, passed.get((group, mark), starts[group]))
        while row < starts[group + 1] and marks[row] == mark:
            row = root(after, row + 1)
        passed[group, mark] = row
        return [row] if row < starts[group + 1] else []

    places, chosen = [], []
    own_marks = pc.index_in(mine["digest"], value_set=texts).to_pylist()
    for i, (at, size, mark) in enumerate(zip(mine["at"].to_pylist(), mine["size"].to_pylist(), own_marks, strict=True)):
        low, high = spans[i % 2]
        here = low + int(np.searchsorted(lengths[low:high], size))
        left, right, best = root(down, here), root(up, here), []
        while not best and (left > low or right < high):
            short = size - lengths[left - 1] if left > low else np.inf
            long = lengths[right] - size if right < high else np.inf
            if short <= long:
                best, left = best + first(left - 1, mark), root(down, left - 1)
            if long <= short:
                best, right = best + first(right, mark), root(up, right + 1)
        if best:
            row = min(best, key=lambda r: ranks[r])
            places.append(at)
            chosen.append(row)
            for used in by_code[code_ends[codes[row]] : code_ends[codes[row] + 1]]:
                after[used] = used + 1
                group = group_of[used]
                free[group] -= 1
                if not free[group]:
                    up[group], down[group + 1] = group + 1, group
    return pa.table({"profile": pa.array([key[0].as_py()] * len(places), pa.string()), "place": pa.array(places, pa.int64()), "match_id": pa.array([ids[r].as_py() for r in chosen], pa.int64())})
