"""The corpus workflow end to end, and operators whose rows SQL cannot give."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.operators import joins as J
from loomline.operators import posts as P
from loomline.operators import select as S
from loomline.operators import vectors as V
from loomline.operators.graph import components

POST = "id string, username string, kind string, date string, conversation_id string, in_reply_to_tweet_id string, in_reply_to_username string, quoted_tweet_id string, text string, photos string, links string, lang string"


def post(id, username, kind="tweet", text="", parent=None, quote=None, to=None, conversation=None, photos=None, date="2026-01-01T00:00:00Z"):
    return (str(id), username, kind, date, conversation, parent, to, quote, text, photos, None, "en")


def built(spark, authored, cached):
    return P.built(spark.createDataFrame(authored, POST), spark.createDataFrame(cached, POST))


def test_every_reply_becomes_an_example_and_splits_are_disjoint(spark):
    authored = [post(2000 + i, "Writer", "reply", f"answer about thing{i} number{i}", str(1000 + i), to="Reader", conversation=str(1000 + i), date=f"2026-01-{1 + i % 28:02d}T12:01:00Z") for i in range(40)]
    cached = [post(1000 + i, "Reader", text=f"what about topic{i}?", conversation=str(1000 + i)) for i in range(40)]
    out = built(spark, authored, cached)
    rows = out["examples"].collect()
    assert len(rows) == 40 and {r["split"] for r in rows} == {"train", "validation", "test"}
    assert all(r["task"] == "external_reply_oneshot" and r["messages_portable"][0]["content"].startswith("<PARENT>: what") and r["mention_map"]["<SELF>"] == "writer" for r in rows)
    by = {}
    for r in rows:
        for k in r["conversation_keys"]:
            assert by.setdefault(k, r["split"]) == r["split"]
    assert out["counts"].first()["sft_deduplicated"] == 40 and out["corpus"].count() == 40 and out["queues"].count() == 0
    assert P.fan_out(out["examples"]).count() == 160


def test_routes(spark):
    cached = [post(1, "Other", text="hello there"), post(2, "Other", text="", photos='["p"]'), post(3, "Me", text="my own words")]
    authored = [
        post(10, "Me", "reply", "fine thanks", "1"), post(11, "Me", "reply", "where", "99"), post(12, "Me", "reply", "more of mine", "3"), post(13, "Me", "reply", "=", "1"), post(14, "Me", "reply", "a picture", "2"), post(15, "Me", "quote", "good point", quote="1"),
        post(16, "Me", "quote", "lost", quote="98"), post(17, "Me", "tweet", "alone"), post(18, "Me", "tweet", "", photos='["p"]'), post(19, "Me", "tweet", "="), post(20, "Me", "tweet", "Ã Ã Ã"), post(21, "Me", "quote", "again", quote="3"),
    ]
    posts = P.normalized(spark.createDataFrame(authored, POST), "authored")
    known = P.nodes(posts, P.normalized(spark.createDataFrame(cached, POST), "parent_cache"))
    got = {r["id"]: (r["route"], r["reason"]) for r in P.routed(posts, known).collect()}
    assert got == {
        "10": ("example", None), "11": ("prompt", "missing_direct_parent"), "12": ("self_thread", None), "13": ("low_information", "unusable_response_other_low_information"), "14": ("multimodal", "unusable_parent_media_only"), "15": ("example", None),
        "16": ("prompt", "missing_quoted_source"), "17": ("prompt", "standalone_no_observed_prompt"), "18": ("multimodal", "standalone_media_only_or_low_text"), "19": ("low_information", "standalone_other_low_information"), "20": ("corrupt", "unintelligible_text"), "21": ("self_thread", None),
    }


def test_rendering_numbers_people_by_first_appearance():
    turns = [dict(username="Ann", text="hey @bob and @Me", reply_to=None, kind="tweet", quoted=None), dict(username="Me", text="yes @ann", reply_to="Ann", kind="reply", quoted=None), dict(username="Cid", text="no", reply_to="Me", kind="reply", quoted=dict(username="Dan", text="old")), dict(username="Me", text="ok @cid @zed", reply_to="Cid", kind="reply", quoted=None)]
    out = P.render(turns, "Me", "Cid", True)
    assert [m["role"] for m in out["portable"]] == ["user", "assistant", "user", "assistant"]
    assert out["portable"][0]["content"] == "<USER_2>: hey <USER_3> and <SELF>" and out["portable"][2]["content"] == "<PARENT> [replying to <SELF>]: no\n↳ quoted <USER>: old"
    assert out["portable"][3]["content"] == "ok <PARENT> <USER_4>" and out["verbatim"][1]["content"] == "@Me [replying to @Ann]: yes @ann"


def test_duplicates_keep_the_best(spark):
    authored = [post(10, "Me", "reply", "Same  words", "1", date="2026-01-05T00:00:00Z"), post(11, "Me", "reply", "same words", "2", date="2026-01-03T00:00:00Z"), post(12, "Me", "reply", "same words", "3", photos='["x"]', date="2026-01-01T00:00:00Z")]
    out = built(spark, authored, [post(i, "Other", text="a question") for i in (1, 2, 3)])
    (kept,) = out["examples"].collect()
    assert kept["id"] == "reply:11" and kept["duplicate_count"] == 3 and kept["duplicate_source_ids"] == ["10", "12"]


def test_filtered_splits(spark):
    schema = "id string, profile string, task string, messages array<struct<role:string,content:string>>, metadata struct<conversation_id:string,direct_parent_id:string,quality_tier:string,context_depth:int,has_media_response:boolean,has_media_context:boolean,target_lang:string>"
    row = lambda i, prompt, reply, conv, tier="core_text": (f"r{i}", "Me", "external_reply_oneshot", [("user", prompt), ("assistant", reply)], (conv, None, tier, 1, False, False, "en"))
    train = [row(1, "what is new today", "a long enough reply here", "c1"), row(2, "another question here", "Shared reply in two", "c2"), row(3, "third question here", "unique words in this", "t1"), row(4, "fourth one here", "made up", "c4", "synthetic_x"), row(5, "what is new today", "A long enough reply here!", "c5"), row(6, "link only", "https://x.org/a", "c6")]
    got = P.filtered_splits(*[spark.createDataFrame(x, schema) for x in (train, [row(7, "held out question", "other words of reply", "v1"), row(9, "x question again", "another thing", "t1")], [row(8, "tested question here", "shared reply IN two", "t1")])], "Me")
    assert [sorted(r["id"] for r in part.collect()) for part in got] == [["r1"], ["r7"], ["r8"]]


def test_truncation(spark):
    df = spark.createDataFrame([(list(range(300)), list(range(1000, 1050)))], "p array<int>, t array<int>")
    r = df.select(P.truncated(F.col("p"), F.col("t"), 100, 20).alias("x")).first()["x"]
    assert len(r["input_ids"]) == 100 and r["input_ids"][-20:] == [*range(1000, 1019), 1049] and r["input_ids"][0] == 220 and r["labels"][:80] == [-100] * 80


def test_as_of_and_chains(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 5, "c"), (3, 1, "z")], "k int, s int, v string")
    assert sorted(map(tuple, J.as_of(left, right, ["k"], "t", "s", ["v"]).collect()), key=repr) == [(1, 1, None), (1, 5, "c"), (2, 9, None)]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", "a"), ("e", None), ("f", "gone")], "id string, up string")
    got = {r["id"]: r["chain"] for r in J.chains(edges, "id", "up", 8).collect()}
    assert got == {"a": ["b", "a"], "b": ["a", "b"], "c": ["c"], "d": ["b", "a", "d"], "e": ["e"], "f": ["f"]}


def test_components_are_those_of_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_placed_is_a_running_sum(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(100)], "i int, v int").repartition(7)
    at = 0
    for r in sorted(S.placed(df, [F.col("i")], F.col("v")).collect(), key=lambda r: r["i"]):
        assert r["place"] == r["i"] and r["before"] == at
        at += r["v"]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.floats(0, 1), st.floats(0, 1))
def test_split_targets_leave_no_split_empty(total, a, b):
    first, second = S.split_targets(total, a, b)
    if total >= 10:
        assert first >= 1 and second >= 1 and first + second < total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=10, max_size=60), st.integers(2, 5))
def test_folds_keep_groups_together(groups, n):
    fold = V.folds(np.array(groups), n)
    assert all(len({f for f, g in zip(fold, groups) if g == x}) == 1 for x in set(groups))


def test_area_and_directions():
    rng = np.random.default_rng(0)
    y, s = rng.random(200) < 0.4, rng.integers(0, 20, 200).astype(float)
    brute = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in s[y] for b in s[~y]])
    assert abs(V.area(y, s) - brute) < 1e-12
    x = rng.normal(size=(80, 10))
    v = V.denoised_difference(x, y[:80])
    parts = V.kept_components(x[~y[:80]])
    assert np.allclose(parts @ v, 0, atol=1e-9)
    a = np.abs(rng.normal(size=(12, 4)))
    w = np.array([0.5, 0.0, 2.0, 0.0])
    assert np.allclose(V.nonnegative(a, a @ w), w, atol=1e-6)


def test_a_grid_must_be_small(spark):
    with pytest.raises(ValueError):
        J.grid(spark.range(2000), spark.range(2000).toDF("b"))


def conversation_posts(profiles=("Writer", "Other"), n=30):
    authored = [post(f"{w}{2000 + i}", w, "reply", f"answer about thing{i} of {w} number{i}", f"{w}{1000 + i}", to="Reader", conversation=f"{w}{1000 + i}", date=f"2026-01-{1 + i % 28:02d}T12:01:00Z") for w in profiles for i in range(n)]
    cached = [post(f"{w}{1000 + i}", "Reader", text=f"what about topic{i}?", conversation=f"{w}{1000 + i}") for w in profiles for i in range(n)]
    return authored, cached


def test_profiles_are_split_each_by_itself(spark):
    one = {w: {r["id"]: r["split"] for r in built(spark, *conversation_posts((w,)))["examples"].collect()} for w in ("Writer", "Other")}
    both = {r["id"]: r["split"] for r in built(spark, *conversation_posts())["examples"].collect()}
    assert both == one["Writer"] | one["Other"]


def test_plans_keep_errors_by_profile(spark):
    kept = built(spark, *conversation_posts())["examples"]
    published = P.public(kept, True).join(kept.select("id", "split"), "id").where("NOT (profile = 'Other' AND split = 'test')")
    config = spark.createDataFrame([("writer", 0), ("Other", 50), ("Nobody", 0)], "profile string, max_steps bigint")
    got = {r["profile"]: r for r in P.planned(published, config).collect()}
    assert got["writer"]["status"] == "ready" and got["writer"]["max_steps"] == 120 and got["writer"]["estimated_microbatches"] == 960 and got["writer"]["train_rows"] == 24
    assert got["Other"]["status"] == "error" and "test=0" in got["Other"]["error"] and got["Other"]["max_steps"] is None
    assert got["Nobody"]["status"] == "error" and got["Nobody"]["train_rows"] == 0
    single = P.filtered_splits(*(published.where((F.col("split") == s) & (F.col("profile") == "Writer")).drop("split") for s in ("train", "validation", "test")), "Writer")
    every = P.filtered_splits(*(published.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")), None)
    assert sorted(r["id"] for r in single[0].collect()) == sorted(r["id"] for r in every[0].where("profile = 'Writer'").collect())


def test_training_json(spark):
    import json

    kept = built(spark, *conversation_posts(("Writer",)))["examples"]
    rows = [json.loads(r["json"]) for r in P.training_json(P.prepared(P.public(kept, True), F.lit("Writer"))).collect()]
    assert len(rows) == 30 and all(list(r) == ["id", "profile", "messages", "task", "quality", "low_info", "metadata"] and r["messages"][-1]["role"] == "assistant" for r in rows)


def test_microbatches(spark):
    said = [("user", "q"), ("assistant", "a")]
    train = spark.createDataFrame([(i, 0.0 if i == 3 else 2.0 if i == 4 else 1.0, said) for i in range(8)], "id bigint, quality double, messages array<struct<role:string,content:string>>")
    anchors = spark.createDataFrame([(100, said)], "id bigint, messages array<struct<role:string,content:string>>")
    out = P.microbatches(train, anchors, ["one", "two", "three"], [("who?", "none")], 500, 8, (0.2, 0.1, 0.1), 7).collect()
    assert sorted(r["place"] for r in out) == list(range(4000))
    by = {}
    for r in out:
        by.setdefault(r["source_kind"], []).append(r["row_id"])
    assert {k: len(v) for k, v in by.items()} == {"replay": 800, "boundary": 400, "anchor": 400, "persona": 2400}
    counts = {i: by["persona"].count(str(i)) for i in range(8)}
    assert abs(counts[4] - 2 * counts[0]) < 200 and counts[3] < 60 and abs(by["replay"].count("replay:0") - 267) <= 1
    again = P.microbatches(train, anchors, ["one", "two", "three"], [("who?", "none")], 500, 8, (0.2, 0.1, 0.1), 7)
    assert sorted(map(str, out)) == sorted(map(str, again.collect()))
    assert {r["source_kind"] for r in P.microbatches(train, anchors.limit(0), ["one"], [("w", "n")], 10, 8, (0.2, 0.1, 0.1), 7).collect()} == {"replay", "boundary", "persona"}


def test_fits_on_given_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(layer, ("train", "dev", "test")[i % 3], i % 2 == 0, (rng.normal(size=6) + (2.0 * layer * (i % 2 == 0)) * np.eye(6)[layer]).tolist()) for layer in (0, 1, 2) for i in range(90)]
    got = {r["layer"]: r for r in V.official_fit(spark.createDataFrame(rows, "layer bigint, part string, label boolean, vec array<double>")).collect()}
    assert got[2]["chosen"] and got[2]["dev_auc"] > 0.8 and got[2]["test_auc"] > 0.75 and abs(np.linalg.norm(got[2]["direction"]) - 1) < 1e-9
    scored = [(y, np.dot(v, got[2]["direction"])) for layer, part, y, v in rows if layer == 2 and part == "dev"]
    assert abs(V.area(np.array([y for y, _ in scored]), np.array([s for _, s in scored])) - got[2]["dev_auc"]) < 1e-9


def test_denoising_against_a_cloud_and_readout(spark):
    rng = np.random.default_rng(5)
    cloud = rng.normal(size=(60, 5)) * np.array([9, 1, 1, 1, 1])
    v = np.array([3.0, 1, 0, 0, 2])
    (row,) = V.denoised_against(spark.createDataFrame([(1, v.tolist())], "layer bigint, direction array<double>"), spark.createDataFrame([(1, x.tolist()) for x in cloud], "layer bigint, vec array<double>")).collect()
    parts = V.kept_components(cloud)
    assert np.allclose(row["direction"], v - parts.T @ (parts @ v)) and abs(row["direction"][0]) < 0.5
    atoms = rng.normal(size=(12, 6))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    anchor = rng.normal(size=6)
    (out,) = V.readout(spark.createDataFrame([(7, (anchor + 2 * atoms[3] + atoms[8]).tolist())], "row bigint, vec array<double>"), atoms, anchor, 4).collect()
    h = 2 * atoms[3] + atoms[8]
    assert out["atoms"] == np.argsort(-(atoms @ h), kind="stable")[:4].tolist() and np.allclose(out["projections"], (atoms @ h)[out["atoms"]])
    a = atoms[out["atoms"]].T
    best = min((np.linalg.norm(h - a[:, k] @ np.linalg.lstsq(a[:, k], h, rcond=None)[0]) for n in range(1, 5) for k in map(list, __import__("itertools").combinations(range(4), n)) if (np.linalg.lstsq(a[:, k], h, rcond=None)[0] >= -1e-12).all()))
    assert abs(np.linalg.norm(h - a @ np.array(out["weights"])) - best) < 1e-6 and min(out["weights"]) >= 0


def test_results_of_other_inputs_are_refused(spark):
    from loomline.operators import exports as E

    done, saved = spark.range(3), spark.createDataFrame([("a",)], "fingerprint string")
    assert E.compatible(done, saved, "a").count() == 3 and E.compatible(done.limit(0), saved.limit(0), "b").count() == 0
    for manifest, wanted in ((saved, "b"), (saved.limit(0), "a")):
        with pytest.raises(ValueError):
            E.compatible(done, manifest, wanted)
    with pytest.raises(ValueError):
        S.disjoint(spark.createDataFrame([(1, "train"), (1, "test")], "k int, split string"), ["k"], "split")


def test_reply_context_files(spark, tmp_path):
    from loomline.operators import exports as E
    from loomline.sources import files as files

    columns = "id string, username string, kind string, in_reply_to_tweet_id string, text string"
    posts = spark.createDataFrame([("1", "Me", "reply", "9", "a, \"b\"\nc"), ("2", "Me", "reply", "1", "d"), ("3", "You", "tweet", None, "e"), ("4", "Me", "reply", "8", "f"), ("5", "Me", "reply", "7", "g")], columns)
    cached = spark.createDataFrame([("9", "X", "tweet", None, "parent"), ("1", "Me", "reply", "9", "cached copy")], columns)
    gone = spark.createDataFrame([("8", None, "404", ""), ("9", "deleted", "", "")], "id string, status string, error string, last_attempt string")
    out = E.reply_context(posts, cached, gone)
    got = {r["id"]: (r["parent_status"], r["parent_text"]) for r in out["all"].collect()}
    assert got == {"1": ("found", "parent"), "2": ("found", "cached copy"), "3": ("not_applicable", None), "4": ("unavailable", None), "5": ("not_fetched", None)}
    s = out["status"].first().asDict()
    assert s == {"target_records": 5, "replies": 4, "unique_parent_ids": 4, "parents_found": 2, "parents_inside_target_dataset": 1, "parents_cached_separately": 2, "parents_unavailable": 2, "parents_pending": 1, "replies_with_parent": 2, "replies_unavailable": 2, "replies_pending": 0, "coverage_percent": 50.0}
    E.write_reply_context(out, str(tmp_path), ["me"])
    assert files.csv(spark, f"{tmp_path}/replies_with_context").count() == 4 and (tmp_path / "by_account" / "all_posts_with_context" / "account=me").is_dir()
    assert [r["status"] for r in files.csv(spark, f"{tmp_path}/reply_context/unavailable").orderBy("parent_tweet_id").collect()] == ["unavailable", "deleted"]


def test_ranks_within_groups_span_tasks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(10**6), rng.randrange(5)) for _ in range(500)] + [(None, 5, 1)]
    got = S.placed_within(spark.createDataFrame(rows, "k string, o int, v int").repartition(5), ["k"], [F.col("o"), F.col("v")], F.col("v")).collect()
    for k in ("a", "b", None):
        own = sorted((o, v) for g, o, v in rows if g == k)
        assert [(r["o"], r["v"]) for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["place"])] == own
        assert sorted((r["place"], r["before"]) for r in got if r["k"] == k) == [(i, sum(v for _, v in own[:i])) for i in range(len(own))]
    low = S.capped_low(spark.createDataFrame([(g, i, i % 3 == 0) for g in "xy" for i in range(200 if g == "x" else 30)], "g string, i int, low boolean"), "low", [F.col("i")], 0.1, 5, within=["g"])
    assert {r["g"]: r["n"] for r in low.where("low").groupBy("g").agg(F.count("i").alias("n")).collect()} == {"x": 13, "y": 5}
    some = S.round_robin(spark.createDataFrame([(g, b, i) for g in "xy" for b in "pqr" for i in range(20)], "g string, b string, i int"), ["b"], [F.col("i")], 10, within=["g"])
    assert {(r["g"], r["b"]): r["n"] for r in some.groupBy("g", "b").agg(F.count("i").alias("n")).collect()} == {(g, b): 4 if b == "p" else 3 for g in "xy" for b in "pqr"}


def test_shuffled_folds_are_even_in_groups():
    groups = np.array([f"g{i % 23}" for i in range(200)])
    fold = V.shuffled_folds(groups, 5)
    by = {g: set(fold[groups == g]) for g in set(groups)}
    assert all(len(x) == 1 for x in by.values())
    assert sorted(sum(x == {f} for x in by.values()) for f in range(5)) == [4, 4, 5, 5, 5] and (fold == V.shuffled_folds(groups, 5)).all()
