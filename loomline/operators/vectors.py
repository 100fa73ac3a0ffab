"""Directions, projections and tests over tables of vectors (row, layer, vec ARRAY<DOUBLE>).

Fits of a direction and their resamples (components, folds, intervals) are one grouped task a layer, whose matrix must fit
into it: activations of labelled examples, not of a corpus. Every other operator spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import placed_within


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_vectors(rows: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Per key the mean vector."""
    each = rows.select(*keys, F.posexplode(vec).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def raw_direction(rows: DataFrame, keys: Sequence[str], positive: Column, vec: str = "vec") -> DataFrame:
    """Per key the unit difference of the positive and the negative mean."""
    means = mean_vectors(rows.withColumn("_y", positive), [*keys, "_y"], vec)
    a, b = means.where("_y").select(*keys, F.col("mean").alias("p")), means.where("NOT _y").select(*keys, F.col("mean").alias("n"))
    both = a.join(b, list(keys)) if keys else a.crossJoin(F.broadcast(b))  # without keys one row each
    out = both.select(*keys, F.zip_with("p", "n", lambda x, y: x - y).alias("d"))
    return out.withColumn("length", norm(F.col("d"))).where("length >= 1e-10").select(*keys, F.transform("d", lambda x: x / F.col("length")).alias("direction"))


def kept_components(negative: np.ndarray, share: float = 0.5) -> np.ndarray:
    """The leading unit components (as rows) that hold this share of the variance, the one that crosses it included."""
    centered = negative - negative.mean(0)
    _, s, rows = np.linalg.svd(centered, full_matrices=False)
    power = s**2
    ok = power > max(power[0] * 1e-10, 1e-12) if len(power) else np.zeros(0, bool)
    power, rows = power[ok], rows[ok]
    return rows[: int(np.searchsorted(np.cumsum(power), share * power.sum())) + 1]


def denoised_difference(x: np.ndarray, y: np.ndarray, cloud: np.ndarray | None = None) -> np.ndarray:
    """The difference of class means without what lies in the leading components of the cloud (the negative class, if none is given)."""
    cloud = x[~y] if cloud is None else cloud
    v = x[y].mean(0) - x[~y].mean(0)
    if len(cloud) > 1:
        parts = kept_components(cloud)
        v = v - parts.T @ (parts @ v)
    return v


def unit(v: np.ndarray) -> np.ndarray | None:
    length = float(np.linalg.norm(v))
    return v / length if length >= 1e-10 else None


def area(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    _, of, n = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[of]
    p = int(y.sum())
    return float((ranks[y].sum() - p * (p + 1) / 2) / (p * (len(y) - p)))


def auc(rows: DataFrame, keys: Sequence[str], score: str, label: Column) -> DataFrame:
    """Per key the area under the ROC curve from mean ranks: scores are counted first, so a tie is one row, and ranked over many tasks."""
    tied = rows.withColumn("_y", label.cast("int")).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n0"), F.sum("_y").alias("_pos"))
    ranked = placed_within(tied, list(keys), [F.col(score)], F.col("_n0")).withColumn("_rank", F.col("before") + (F.col("_n0") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("_pos")).alias("_r"), F.sum("_pos").alias("_a"), F.sum("_n0").alias("_b"))
    return out.select(*keys, ((F.col("_r") - F.col("_a") * (F.col("_a") + 1) / 2) / F.nullif(F.col("_a") * (F.col("_b") - F.col("_a")), F.lit(0))).alias("auc"))


def auc_interval(rows: DataFrame, keys: Sequence[str], score: str, label: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """Per key the 2.5 and 97.5 percentiles of the area over resamples of both classes."""
    (key,) = keys
    kind = rows.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        y, s = pdf[label].to_numpy(bool), pdf[score].to_numpy(float)
        a, b = s[y], s[~y]
        if not len(a) or not len(b):
            return pd.DataFrame({key: [pdf[key].iloc[0]], "low": [None], "high": [None]})
        found = [area(np.repeat([True, False], [len(a), len(b)]), np.concatenate([rng.choice(a, len(a)), rng.choice(b, len(b))])) for _ in range(draws)]
        low, high = np.quantile(found, [0.025, 0.975])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "low": [low], "high": [high]})

    return rows.select(key, score, label).groupBy(key).applyInPandas(run, f"{key} {kind}, low double, high double")


def folds(groups: np.ndarray, n: int) -> np.ndarray:
    """A fold for each row: groups, the largest first, go to the fold that has fewest rows."""
    names, of, size = np.unique(groups, return_inverse=True, return_counts=True)
    load, out = np.zeros(n), np.zeros(len(names), int)
    for g in np.argsort(-size, kind="stable"):
        out[g] = int(load.argmin())
        load[out[g]] += size[g]
    return out[of]


def shuffled_folds(groups: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """A fold for each row: sorted groups, shuffled by the seed, are cut into n runs whose numbers of groups differ by one at most."""
    names, of = np.unique(groups, return_inverse=True)
    out = np.empty(len(names), int)
    for f, part in enumerate(np.array_split(np.random.default_rng(seed).permutation(len(names)), n)):
        out[part] = f
    return out[of]


def held_out(group: Column, share: float = 0.2, salt: str = "heldout") -> Column:
    """Whether a group is held out, by a hash of it."""
    return F.pmod(F.xxhash64(group.cast("string"), F.lit(salt)), F.lit(10_000)) < int(share * 10_000)


def fitted_axes(rows: DataFrame, n_folds: int = 5, denoise: bool = True, shuffled: bool = False) -> DataFrame:
    """Per layer of (layer, grp, label BOOLEAN, test BOOLEAN, vec): the direction from the training rows with its center, scale and mean norm; the mean area over grouped folds (-1 where no direction exists); and the area on the test rows, raw and with shuffled labels too. `chosen` marks the first layer of the best mean. Folds are even in rows, or, shuffled, in groups."""

    def one(x: np.ndarray, y: np.ndarray, clean: bool) -> np.ndarray | None:
        return unit(denoised_difference(x, y) if clean else x[y].mean(0) - x[~y].mean(0)) if y.any() and not y.all() else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, test = np.stack(pdf["vec"]).astype(float), pdf["label"].to_numpy(bool), pdf["test"].to_numpy(bool)
        tx, ty, tg = x[~test], y[~test], pdf["grp"].to_numpy()[~test]
        fold, scores = shuffled_folds(tg, n_folds) if shuffled else folds(tg, n_folds), []
        for f in range(n_folds):
            v, out = one(tx[fold != f], ty[fold != f], denoise), fold == f
            if v is None or not ty[out].any() or ty[out].all():
                scores = None
                break
            scores.append(area(ty[out], tx[out] @ v))
        v = one(tx, ty, denoise) if scores else None
        both = test.any() and y[test].any() and not y[test].all()
        held = lambda d: area(y[test], x[test] @ d) if both and d is not None else None
        if v is None:
            v = np.eye(1, x.shape[1])[0]
            row = (0.0, 1.0, 1.0, -1.0, None, None, None)
        else:
            p = tx @ v
            mixed = np.random.default_rng(1).permutation(ty)
            row = (float(p.mean()), max(float(p.std(ddof=1)), 1e-8), float(np.linalg.norm(tx, axis=1).mean()), float(np.mean(scores)), held(v), held(one(tx, ty, False)), held(one(tx, mixed, denoise)))
        return pd.DataFrame([(int(pdf["layer"].iloc[0]), v.tolist(), *row)], columns=["layer", "direction", "center", "scale", "norm", "cv_auc", "test_auc", "raw_auc", "shuffled_auc"])

    found = rows.select("layer", "grp", "label", "test", "vec").groupBy("layer").applyInPandas(run, "layer bigint, direction array<double>, center double, scale double, norm double, cv_auc double, test_auc double, raw_auc double, shuffled_auc double")
    best = found.agg(F.min_by("layer", F.struct((-F.col("cv_auc")).alias("a"), F.col("layer").alias("l"))).alias("_best"))
    return found.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("layer") == F.col("_best")).drop("_best")  # one row


def z_scores(rows: DataFrame, axes: DataFrame, layer: str = "layer") -> DataFrame:
    """rows (…, layer, vec) with axis and z, for every axis of the layer; axes: axis, layer, direction, center, scale."""
    return rows.join(axes, layer).withColumn("z", (dot(F.col("vec"), F.col("direction")) - F.col("center")) / F.col("scale")).drop("vec", "direction", "center", "scale", "norm")


def standardised(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """value less the mean, over the population deviation, within each key."""
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")) if keys else rows.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    both = rows.join(stats, list(keys)) if keys else rows.crossJoin(F.broadcast(stats))
    return both.withColumn("z", (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def cosine_matrix(axes: DataFrame, name: str, vec: str, most: int = 2000) -> DataFrame:
    """Cosines of all pairs of axes; a table of named axes is small, and this refuses one that is not."""
    if axes.count() > most:
        raise ValueError(f"more than {most} axes")
    a, b = axes.select(F.col(name).alias("a"), F.col(vec).alias("x")), axes.select(F.col(name).alias("b"), F.col(vec).alias("y"))
    return a.crossJoin(F.broadcast(b)).select("a", "b", cosine(F.col("x"), F.col("y")).alias("cosine"))


def spectrum(rows: DataFrame) -> DataFrame:
    """Per layer the singular values of its matrix and the cumulative share of the energy.

    From the sums of the rows' outer products, which each partition adds up for itself: a task holds one square matrix of
    the vectors' length a layer, however many rows there are. Values under 1e-8 of the largest are rounding.
    """

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for layer, own in pdf.groupby("layer"):
                x = np.stack(own["vec"]).astype(float)
                n, gram = sums.get(layer, (0, 0.0))
                sums[layer] = n + len(x), gram + x.T @ x
        yield pd.DataFrame([(layer, n, gram.ravel().tolist()) for layer, (n, gram) in sums.items()], columns=["layer", "n", "gram"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.sum(np.stack(pdf["gram"]), 0)
        size = int(round(len(gram) ** 0.5))
        power = np.maximum(np.linalg.eigvalsh(gram.reshape(size, size))[::-1], 0)
        power = power[: min(int(pdf["n"].sum()), size)]
        return pd.DataFrame({"layer": int(pdf["layer"].iloc[0]), "i": np.arange(len(power)), "value": np.sqrt(power), "energy": np.cumsum(power) / max(float(power.sum()), 1e-300)})

    sums = rows.select("layer", "vec").mapInPandas(partial, "layer bigint, n bigint, gram array<double>")
    return sums.groupBy("layer").applyInPandas(whole, "layer bigint, i bigint, value double, energy double")


def nonnegative(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The least-squares weights of a's columns for b that are not negative, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if free.all() or slope.max() <= 1e-10:
            break
        free[int(slope.argmax())] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            bad = free & (z <= 0)
            step = min((x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min(), 1.0)
            x += step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def pursuit(rows: DataFrame, atoms: np.ndarray, most: int = 25) -> DataFrame:
    """For each (row, vec) up to `most` atoms (unit rows) with weights that are not negative, chosen one by one and refitted, and the share of the power they explain."""
    atoms = np.asarray(atoms, float)

    def run(batches):
        for pdf in batches:
            out = []
            for key, vec in zip(pdf["row"], pdf["vec"]):
                target, picked, weights = np.asarray(vec, float), [], np.zeros(0)
                for _ in range(min(most, len(atoms))):
                    gain = atoms @ (target - (atoms[picked].T @ weights if picked else 0))
                    gain[picked] = -np.inf
                    if gain.max() <= 1e-10:
                        break
                    picked.append(int(gain.argmax()))
                    weights = nonnegative(atoms[picked].T, target)
                rest = target - (atoms[picked].T @ weights if picked else 0)
                out.append((key, picked, weights.tolist(), 1 - float(rest @ rest) / max(float(target @ target), 1e-300)))
            yield pd.DataFrame(out, columns=["row", "atoms", "weights", "explained"])

    return rows.select("row", "vec").mapInPandas(run, "row bigint, atoms array<bigint>, weights array<double>, explained double")


def vocabulary_ends(axes: DataFrame, tokens: DataFrame, n: int, most: int = 2000) -> DataFrame:
    """Per axis the n tokens of the largest and of the smallest dot product, with ranks; more than `most` axes are refused."""
    if axes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} axes")
    scores = tokens.crossJoin(F.broadcast(axes.select("axis", "direction"))).select("axis", "token_id", dot(F.col("vec"), F.col("direction")).alias("score"))
    up, down = Window.partitionBy("axis").orderBy(F.col("score").desc(), "token_id"), Window.partitionBy("axis").orderBy("score", "token_id")
    top = scores.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= n).withColumn("side", F.lit("top"))
    return top.unionByName(scores.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= n).withColumn("side", F.lit("bottom")))


def paired_fit(pairs: DataFrame) -> DataFrame:
    """Per layer of (layer, part, positive, negative): the unit mean difference over train pairs, the area of dev and of test responses along it, and `chosen`, the first layer of the best dev area.

    part is train, dev or test; a group of prompts belongs to one part, which is the caller's to see to (select.disjoint).
    """
    change = pairs.where("part = 'train'").select("layer", F.zip_with("positive", "negative", lambda a, b: a.cast("double") - b.cast("double")).alias("vec"))
    means = mean_vectors(change, ["layer"]).withColumn("length", norm(F.col("mean"))).where("length >= 1e-10")
    axes = means.select("layer", F.transform("mean", lambda x: x / F.col("length")).alias("direction"))
    sides = pairs.where("part <> 'train'").select("layer", "part", F.explode(F.array(F.struct(F.lit(True).alias("y"), F.col("positive").alias("v")), F.struct(F.lit(False).alias("y"), F.col("negative").alias("v")))).alias("s"))
    scored = sides.join(axes, "layer").select("layer", "part", F.col("s.y").alias("y"), dot(F.col("s.v"), F.col("direction")).alias("score"))
    areas = auc(scored, ["layer", "part"], "score", F.col("y")).groupBy("layer").pivot("part", ["dev", "test"]).agg(F.first("auc"))
    out = axes.join(areas.withColumnsRenamed({"dev": "dev_auc", "test": "test_auc"}), "layer", "left")
    best = out.agg(F.min_by("layer", F.struct((-F.coalesce("dev_auc", F.lit(-1.0))).alias("a"), F.col("layer").alias("l"))).alias("_best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("layer") == F.col("_best")).drop("_best")  # one row


def official_fit(rows: DataFrame) -> DataFrame:
    """Per layer of (layer, part, label BOOLEAN, vec): the direction of train (denoised), its areas on dev and test, and `chosen`, the first layer of the best dev area."""
    data = rows.where("part = 'train'").select("layer", F.monotonically_increasing_id().alias("grp"), "label", F.lit(False).alias("test"), "vec")
    axes = fitted_axes(data).where("cv_auc >= 0").select("layer", "direction", "center", "scale", "norm")
    scored = rows.where("part <> 'train'").join(axes.select("layer", "direction"), "layer").select("layer", "part", "label", dot(F.col("vec"), F.col("direction")).alias("score"))
    areas = auc(scored, ["layer", "part"], "score", F.col("label")).groupBy("layer").pivot("part", ["dev", "test"]).agg(F.first("auc"))
    out = axes.join(areas.withColumnsRenamed({"dev": "dev_auc", "test": "test_auc"}), "layer", "left")
    best = out.agg(F.min_by("layer", F.struct((-F.coalesce("dev_auc", F.lit(-1.0))).alias("a"), F.col("layer").alias("l"))).alias("_best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("layer") == F.col("_best")).drop("_best")  # one row


def denoised_against(directions: DataFrame, cloud: DataFrame, share: float = 0.5) -> DataFrame:
    """directions (layer, direction) without what lies in the leading components of the layer's cloud (layer, vec); lengths are left as they come out."""

    def run(key, mine: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        parts = kept_components(np.stack(around["vec"]).astype(float), share) if len(around) > 1 else np.zeros((0, 0))
        found = [np.asarray(v, float) for v in mine["direction"]]
        out = [(v - parts.T @ (parts @ v) if len(parts) else v).tolist() for v in found]
        return pd.DataFrame({"layer": mine["layer"], "direction": out})

    return directions.select("layer", "direction").groupBy("layer").cogroup(cloud.select("layer", "vec").groupBy("layer")).applyInPandas(run, "layer bigint, direction array<double>")


def readout(rows: DataFrame, atoms: np.ndarray, anchor: np.ndarray, k: int = 4) -> DataFrame:
    """For each (row, vec), less the anchor: the k atoms (rows) of the largest projection, the projections, non-negative weights that fit it best, and the share of its power they explain."""
    atoms, anchor = np.asarray(atoms, float), np.asarray(anchor, float)

    def run(batches):
        for pdf in batches:
            out = []
            for key, vec in zip(pdf["row"], pdf["vec"]):
                h = np.asarray(vec, float) - anchor
                scores = atoms @ h
                picked = np.argsort(-scores, kind="stable")[:k]
                weights = nonnegative(atoms[picked].T, h)
                rest = h - atoms[picked].T @ weights
                out.append((key, picked.tolist(), scores[picked].tolist(), weights.tolist(), 1 - float(rest @ rest) / max(float(h @ h), 1e-12)))
            yield pd.DataFrame(out, columns=["row", "atoms", "projections", "weights", "explained"])

    return rows.select("row", "vec").mapInPandas(run, "row bigint, atoms array<bigint>, projections array<double>, weights array<double>, explained double")


def storage_tolerance(value: Column, bits: int) -> Column:
    """Half a unit in the last place of a number stored with this many bits of fraction."""
    return F.when(value == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - bits) / 2)


def measured(rows: DataFrame) -> DataFrame:
    """For rows (pre, post, direction, center, scale): projections before and after, their z, and the relative change of the vector."""
    before, after = dot(F.col("pre"), F.col("direction")), dot(F.col("post"), F.col("direction"))
    change = norm(F.zip_with("post", "pre", lambda a, b: a - b)) / F.greatest(norm(F.col("pre")), F.lit(1e-12))
    return rows.select("*", before.alias("before_projection"), after.alias("after_projection"), (after - before).alias("projection_delta"), change.alias("change_norm_fraction"), ((before - F.col("center")) / F.col("scale")).alias("before"), ((after - F.col("center")) / F.col("scale")).alias("after"))


def intervention_error(pre: Column, post: Column, expected: Column) -> Column:
    """(error, tolerance) of an intervention: the largest difference between the change made and the change asked for."""
    off = F.zip_with(F.zip_with(post, pre, lambda a, b: a - b), expected, lambda d, e: F.abs(d - e))
    return F.struct(F.array_max(off).alias("error"), (1e-4 * (1 + F.array_max(F.transform(expected, F.abs)))).alias("tolerance"))
