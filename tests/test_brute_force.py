"""Queries that SQL cannot give, against plain Python over the same small tables."""

from __future__ import annotations

import difflib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomline.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def rows():
    import pyarrow.parquet as pq

    return lambda name: pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


def got(spark, name):
    return registry.QUERIES[name](spark, SF_DIR).collect()


def layers(rows):
    by = defaultdict(list)
    for r in rows("embeddings"):
        by[r["vec_id"] % 2].append((r["vec_id"], r["label"], np.array(r["embedding"], float)))
    return by


def test_matching_ratio(spark, rows):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in rows("conversations")}
    by = defaultdict(list)
    for c, t in sorted(turns):
        by[c].append(t)
    want = {}
    for c, ts in by.items():
        for a, b in zip(ts, ts[1:]):
            x, y = " ".join(turns[c, b].split()), " ".join(turns[c, a].split())
            want[c, b] = round(difflib.SequenceMatcher(None, x, y).ratio(), 9)
    assert {(r["conv_id"], r["turn"]): r["ratio"] for r in got(spark, "matching_ratio")} == want


def test_spectrum(spark, rows):
    found = defaultdict(list)
    for r in sorted(got(spark, "svd_energy"), key=lambda r: r["i"]):
        found[r["layer"]].append((r["value"], r["energy"]))
    for layer, own in layers(rows).items():
        power = np.sort(np.linalg.eigvalsh(np.stack([v for *_, v in own]).T @ np.stack([v for *_, v in own])))[::-1]
        values, energy = map(np.array, zip(*found[layer]))
        assert np.allclose(values**2, power[: len(values)], rtol=1e-6, atol=1e-6) and np.allclose(energy, np.cumsum(power)[: len(energy)] / power.sum())


def test_denoised_directions(spark, rows):
    found = defaultdict(dict)
    for r in got(spark, "pca_denoised_direction"):
        found[r["layer"]][r["i"]] = r["x"]
    held = {(r["grp"], r["layer"]) for r in _held(spark)}
    for layer, own in layers(rows).items():
        own = [(k, y, v) for k, y, v in own if (k, layer) not in held]
        x, y = np.stack([v for *_, v in own]), np.array([label < 5 for _, label, _ in own])
        centered = x[~y] - x[~y].mean(0)
        power, vectors = np.linalg.eigh(centered.T @ centered)
        power, vectors = power[::-1], vectors[:, ::-1]
        many = int(np.searchsorted(np.cumsum(power), 0.5 * power.sum())) + 1
        d = x[y].mean(0) - x[~y].mean(0)
        d -= vectors[:, :many] @ (vectors[:, :many].T @ d)
        assert np.allclose([found[layer][i] for i in range(64)], d / np.linalg.norm(d), atol=1e-6)


def _held(spark):
    from pyspark.sql import functions as F

    from loomline.operators import vectors as V
    from loomline.plans.table_queries import vectors

    return vectors(spark, SF_DIR).select("layer", F.col("vec_id").alias("grp"), V.held_out(F.col("vec_id")).alias("test")).where("test").collect()


def test_area_interval(spark, rows):
    (r,) = got(spark, "auc_bootstrap")
    x = [(label, v) for own in layers(rows).values() for _, label, v in own]
    d = np.mean([v for label, v in x if label < 5], 0) - np.mean([v for label, v in x if label >= 5], 0)
    a, b = [v @ d for label, v in x if label < 5], [v @ d for label, v in x if label >= 5]
    area = np.mean([(p > q) + 0.5 * (p == q) for p in a for q in b])
    assert r["low"] < area < r["high"] and r["high"] - r["low"] < 0.3


def test_pursuit_weights_are_the_best_of_their_atoms(spark, rows):
    by = defaultdict(list)
    vecs = {}
    for own in layers(rows).values():
        for k, label, v in own:
            by[label].append(v)
            vecs[k] = v
    atoms = np.array([np.mean(by[label], 0) for label in sorted(by)])
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    for r in got(spark, "sparse_pursuit"):
        h, a, w = vecs[r["row"]], atoms[r["atoms"]].T, np.array(r["weights"])
        rest = h - a @ w if len(w) else h
        slope = a.T @ rest if len(w) else np.zeros(0)
        assert (w >= 0).all() and (np.abs(slope[w > 0]) < 1e-6).all() and (slope[w == 0] < 1e-6).all()
        assert abs(r["explained"] - (1 - rest @ rest / (h @ h))) < 1e-9
        if len(r["atoms"]) < len(atoms):
            assert (np.delete(atoms, r["atoms"], 0) @ rest).max() <= 1e-6


def test_weighted_draws(spark, rows):
    found = got(spark, "weighted_draws")
    quality = {r["doc_id"]: r["quality"] for r in rows("labels")}
    assert sorted(r["draw"] for r in found) == list(range(200)) and all(quality[r["doc_id"]] == r["quality"] for r in found)
    good = sum(q == 1 for q in quality.values())
    share = 1.05 * good / (1.05 * good + 0.05 * (len(quality) - good))
    assert abs(Counter(r["quality"] for r in found)[1] / 200 - share) < 4 * (share * (1 - share) / 200) ** 0.5 + 0.01


def test_length_matches(spark, rows):
    pools = {kind: [(r["doc_id"], r["text"] or "") for r in sorted(rows("documents"), key=lambda r: r["doc_id"]) if (r["doc_id"] % 2 == 0) == (kind == 0)][:2000] for kind in (0, 1)}
    taken, want = set(), {}
    for i, t in enumerate(sorted(rows("benchmark"), key=lambda r: r["item_id"])):
        offered = [(abs(len(x) - len(t["text"])), n, k) for n, (k, x) in enumerate(pools[i % 2]) if k not in taken and x.strip().lower() != t["text"].strip().lower()]
        if offered:
            want[t["item_id"]] = min(offered)[2]
            taken.add(want[t["item_id"]])
    assert {r["place"]: r["match_id"] for r in got(spark, "length_matched")} == want


def test_grouped_folds(spark, rows):
    for r in got(spark, "grouped_cv"):
        assert 0 <= r["cv_auc"] <= 1 and 0 <= r["test_auc"] <= 1 and r["scale"] > 0
    assert sum(r["chosen"] for r in got(spark, "grouped_cv")) == 1


def test_plans_and_rows_agree(spark):
    counts = Counter(r["split"] for r in got(spark, "training_rows"))
    plans = {r["profile"]: r for r in got(spark, "profile_plans")}
    for name in ("writer", "WRITER"):
        assert [plans[name][f"{s}_rows"] for s in ("train", "validation", "test")] == [counts[s] for s in ("train", "validation", "test")]
    assert plans["Nobody"]["status"] == "error" and plans["Nobody"]["error"] == "no examples of Nobody"
    if plans["WRITER"]["status"] == "ready":
        assert plans["WRITER"]["max_steps"] == 77 and plans["WRITER"]["estimated_microbatches"] == 616


def test_build_covers_routed_examples(spark, rows):
    """Each example is an assistant's turn after a user's, once a fingerprint, and conversations stay within one split."""
    turns = {r["conv_id"] * 1000 + r["turn"]: r for r in rows("conversations")}
    found = got(spark, "dataset_build")
    split = {}
    for r in found:
        at = int(r["id"].split(":")[1])
        assert turns[at]["role"] == "assistant" and turns[at - 1]["role"] != "assistant" and r["messages"] >= 2
        assert split.setdefault(at // 1000, r["split"]) == r["split"]
    answered = sum(t["role"] == "assistant" and t["turn"] > 0 and turns.get(at - 1, t)["role"] != "assistant" and bool((t["text"] or "").strip()) and bool((turns.get(at - 1, t)["text"] or "").strip()) for at, t in turns.items())
    assert sum(r["duplicate_count"] for r in found) == answered
