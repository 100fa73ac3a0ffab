"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing names, against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import decontam, exact, langid, lm, neardup, packing, pii, shard, substring, urls

from .helpers import as_list, empty, plain, rows, sentences, table

LOWEST = -(1 << 63)


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_dedup(spark):
    done, (_, keep, size, kept) = exact.decided(table(spark))
    groups = defaultdict(list)
    for k, t in plain():
        groups[t or ""].append(k)
    found = as_list(done, "doc_id", "text", keep, size)
    assert found == sorted(((k, t, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for k, t in plain()), key=repr)
    assert Counter(r["text"] or "" for r in done.where(kept).collect()) == Counter(groups.keys())
    left = exact.dedup(table(spark))
    assert left.columns == table(spark).columns and left.count() == len(groups)
    assert exact.dedup(empty(spark)).count() == 0


def test_exact_dedup_hot_group_and_history(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    for historical in (F.lit(True), F.lit(False), F.col("doc_id") < 100):
        done, (_, keep, size, kept) = exact.decided(docs, historical=historical, bucket_rows=50)
        expected = docs.groupBy("text").agg(F.max("doc_id").alias("k"), F.count(F.lit(1)).alias("n"))
        assert done.join(expected, "text").where((F.col(keep) != F.col("k")) | (F.col(size) != F.col("n")) | (F.col(kept) != (F.col("doc_id") == F.col("k")))).count() == 0
        assert done.count() == 3000


def test_perfect_hash():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    h = exact.PerfectHash(keys)
    assert sorted(h(keys).tolist()) == list(range(5000)) and (h(keys) == h.slot).all()
    index = exact.DigestIndex(keys, np.arange(5000) < 3000, np.arange(5000), np.ones(5000, bool), np.arange(5000) * 2)
    others = np.random.default_rng(2).integers(0, 1 << 63, (1000, 4), dtype=np.uint64)
    ok, winner, _, size = index.look_up(np.concatenate([keys, others]))
    assert ok.tolist() == [True] * 5000 + [False] * 1000 and (winner[:5000] == np.arange(5000)).all() and (size[:5000] == np.arange(5000) * 2).all()


def hits(text: str, items: list[tuple], n: int = 10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, marked, found = re.findall(word, low(text)), set(), set()
    for k, t in items:
        own = re.findall(word, low(t))
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    marked.update(range(j, j + size))
                    found.add(k)
    return len(words), marked, {str(k) for k in found if k is not None}


@pytest.mark.parametrize("block_bytes", [64 << 20, 150])
def test_decontamination(spark, block_bytes):
    items = [(1, " ".join(sentences(1, 120).split()[30:45])), (2, "One"), (3, None), (4, ""), (None, "ONE-two"), (2, "One"), (5, sentences(9, 30)), (6, "café, DÉBUT")]
    done, (n, runs, found) = decontam.scanned(table(spark), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
    got = sorted(((r["doc_id"], r["text"], r[n], sum(r[runs][1::2]) - sum(r[runs][::2]), tuple(r[found])) for r in done.collect()), key=repr)
    want = sorted(((k, t, w, len(m), tuple(sorted(f))) for k, t in plain() for w, m, f in [hits(t, items)]), key=repr)
    assert got == want
    left = decontam.clean(table(spark), spark.createDataFrame(items, "item_id bigint, text string"))
    assert left.columns == table(spark).columns and left.count() == sum(not m for k, t in plain() for _, m, _ in [hits(t, items)])


def test_decontamination_empty_and_spans(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.clean(table(spark), none).count() == len(rows()) and decontam.clean(empty(spark), none).count() == 0
    docs = spark.createDataFrame([(1, "keep, This Passage goes away! and stay")], "doc_id bigint, text string")
    item = spark.createDataFrame([(1, "this passage goes away")], "item_id bigint, text string")
    assert decontam.clean(docs, item, remove="spans").first()["text"] == "keep, ! and stay"


def test_urls(spark):
    found = ["http://a.example.com/en/7?x#y", "HTTP://EN.ORG/es/", "https://m.adult-x.example.net/fr/1", "x.com/en/", None, "", "http://", "http://spamfarm.test/", "http://cheap.test/free", "http://free.test/free", "ftp://com/en/", "http://x.net/de/8", "http://b.example.net/de/8#q", "http://notexample.net/de/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(found)], "page_id bigint, url string, host string")
    got = {r["key"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[1] == ("en.org", "/es/", "org/es/", "block")
    assert got[2][2:] == (None, "block") and got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][3] == "allow" and got[8][3] == "block" and got[9][3] == "allow" and got[10] == ("com", "/en/", "com/en/", "block")
    assert got[11][2] == "net/de/" and got[12] == ("b.example.net", "/de/8", "example.net/de/8", "block") and got[13][2] == "net/de/"
    assert urls.judged(pages.limit(0)).count() == 0


def removed(docs: list[tuple], n: int) -> list[tuple]:
    first = {}
    for k, t in docs:
        words = spaced(t)
        for i in range(len(words) - n + 1):
            at = (LOWEST if k is None else k, i)
            key = tuple(words[i : i + n])
            first[key] = min(first.get(key, at), at)
    out = []
    for k, t in docs:
        words, gone = spaced(t), set()
        for i in range(len(words) - n + 1):
            if first[tuple(words[i : i + n])] < (LOWEST if k is None else k, i):
                gone.update(range(i, i + n))
        out.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000])
def test_substring_dedup(spark, block_bytes):
    done = substring.deduplicated(table(spark), block_bytes=block_bytes)
    assert as_list(done, "doc_id", "n_words", "n_removed", "kept_text") == removed(plain(), 20)
    assert substring.deduplicated(empty(spark)).count() == 0


def test_substring_dedup_repeats_within(spark):
    docs = [(i, " ".join(f"a{(j * j + i) % 5}" for j in range(40 + i))) for i in range(30)]
    done = substring.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), n=3, block_bytes=500)
    assert as_list(done, "doc_id", "n_words", "n_removed", "kept_text") == removed(docs, 3)


def test_personal_data(spark):
    done = pii.found(table(spark).select("doc_id", "text"))
    got = {(r["doc_id"]): r["base"] for r in done.collect()}
    text = rows()[-1][1]
    assert done.count() == len(rows()) and got[2] == [] and got[6] == []
    assert [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[16]] == [("email", "a.b@mail.example.com"), ("phone", "+1 (171) 555-2028"), ("ip", "10.0.0.1"), ("card", "1 4111 1111 1111 111")] or [s.split(":")[0] for s in got[16]][:3] == ["email", "phone", "ip"]
    assert pii.found(empty(spark).select("doc_id", "text")).count() == 0
    assert pii.redacted("call +1 now", ["phone:5:7"]) == "call <phone> now"


def test_base_spans_are_those_of_the_patterns():
    import random

    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["@", ".", "a", "B", "1", "255", "4111111111111111", "+1", " ", "-", "(", ")", "é", "@b.c"]) for _ in range(rng.randint(0, 25)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if k == 0 or pii.valid(pii.KINDS[k], m.group()))
        assert pii.base_spans(text) == want, text


def test_labelers_reliabilities_are_found():
    import numpy as np

    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) for a in (0.95, 0.8, 0.7, 0.55)], 1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    q, theta, share = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.03 and [round(theta[1, j, 2], 1) for j in range(3)] == [0.9 if round(theta[1, 0, 2], 1) == 0.9 else 1.0, 0.8, 0.7]


def test_sharding(spark):
    done = as_list(shard.sharded(table(spark), 8), "doc_id", "size", "text_crc32", "shard", "slot")
    assert [(k, s, c) for k, s, c, _, _ in done] == sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in plain()), key=repr)
    slots = defaultdict(list)
    for _, _, _, part, slot in done:
        slots[part].append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(0 <= p < 8 for p in slots)
    assert shard.sharded(empty(spark)).count() == 0


def test_sharding_is_even_with_a_hot_text(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 10).otherwise(F.col("id").cast("string")).alias("text"))
    done = shard.sharded(docs, 8, range_rows=300)
    sizes = [r["b"] for r in done.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 90 and done.count() == 6000


def jaccard_components(docs: list[tuple], n: int) -> dict:
    sets = {}
    for i, (_, t) in enumerate(docs):
        words = spaced(low(t))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[root(i)] = min(least[root(i)], k)
    return sorted(((k, len(sets[i]), None if k is None else least[root(i)], k is None or k == least[root(i)]) for i, (k, _) in enumerate(docs)), key=repr)


def test_near_duplicates(spark):
    done = neardup.clustered(table(spark), n=2)
    assert as_list(done, "doc_id", "n_shingles", "component_id", "kept") == jaccard_components(plain(), 2)
    assert neardup.clustered(empty(spark)).count() == 0
    assert neardup.dedup(table(spark)).columns == table(spark).columns


def test_near_duplicates_in_large_nodes(spark):
    import random

    rng = random.Random(4)
    base = sentences(11, 150, 5000).split()
    docs = []
    for i in range(140):  # a group far larger than a node, loosely linked, and strangers
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, sentences(100 + i, 40, 5000)) for i in range(40)]
    done = neardup.clustered(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), n=2, node_rows=16)
    assert as_list(done, "doc_id", "n_shingles", "component_id", "kept") == jaccard_components(docs, 2)


def test_language_id(spark):
    import random

    rng = random.Random(8)
    words = {"en": "the of and ing tion ed th is on er".split(), "fr": "le de ment ou eau ique é ç les un".split(), "es": "el ción ado que ñ os las ar ez do".split()}
    say = lambda lang, n: " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(i, say(lang, rng.randint(20, 60)), lang, "c", "c") for i, lang in enumerate(["en", "fr", "es"] * 80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score string, bits string")
    model = langid.trained(df, F.col("doc_id") % 4 != 2)
    done, (pred, score, _) = langid.predicted(df, model)
    held = done.where("doc_id % 4 = 2").select("lang", pred, score).collect()
    assert sum(r[0] == r[1] for r in held) >= 0.97 * len(held) and all(0 <= r[2] <= 1 for r in held)
    odd, (pred, score, _) = langid.predicted(table(spark), model)
    got = {r["doc_id"]: (r[pred], r[score]) for r in odd.collect()}
    assert odd.count() == len(rows()) and all(got[k] == ("und", 0.0) for k in (2, 3, 4)) and got[13][0] == "fr"
    nothing, (pred, _, _) = langid.predicted(table(spark), langid.trained(empty(spark), F.lit(True)))
    assert {r[pred] for r in nothing.collect()} == {"und"} and langid.predicted(empty(spark), model)[0].count() == 0


def test_lm_scoring(spark):
    import math

    docs = plain() + [(100 + i, sentences(i % 7, 30, 60)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    train = lm.not_in_fold(7, 2)
    done, plan = lm.scored(df, train, block_bytes=3000)
    tokens = [(k, [*spaced(low(t)), None]) for k, t in docs]
    count = Counter(w for k, ws in tokens if train(k) for w in ws)
    total, distinct = sum(count.values()), len(count)
    assert (plan.total, plan.distinct) == (total, distinct)
    want = sorted(((k, train(k), len(ws), sum(count[w] > 0 for w in ws), round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), 5)) for k, ws in tokens), key=repr)
    got = sorted(((r["doc_id"], r["trained"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in done.collect()), key=repr)
    assert got == want
    both = done.agg(F.sum("base_score"), F.sum("score"), F.max("score")).first()
    assert both[1] > both[0] and both[2] <= 0
    assert lm.scored(empty(spark), train)[0].count() == 0


@pytest.mark.parametrize("shard_tokens", [1_000_000, 100, 10])
def test_lm_order_three_after_hot_words(spark, shard_tokens):
    import math

    docs = [(i, " ".join(f"{a} of {b}" for a, b in zip(sentences(i % 23, 20, 12).split(), sentences(i % 23 + 50, 20, 12).split()))) for i in range(90)]
    train, strength = lm.not_in_fold(7, 2), 2.0
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    done, plan = lm.scored(df, train, strength=strength, block_bytes=2000, shard_tokens=shard_tokens)
    assert len(plan.hot)
    tokens = {k: [*spaced(low(t)), None] for k, t in docs}
    grams = {k: list(zip(["^", "^", *ws], ["^", *ws], ws)) for k, ws in tokens.items()}
    c1 = Counter(w for k, ws in tokens.items() if train(k) for w in ws)
    c3 = Counter(g for k, gs in grams.items() if train(k) for g in gs)
    c2, cuv, cv = Counter(), Counter(), Counter()
    for (u, v, w), n in c3.items():
        c2[v, w] += n
        cuv[u, v] += n
        cv[v] += n
    mass = lambda c: strength * c**0.75 + 1

    def log_p(u, v, w):
        p = (c1[w] + 1) / (plan.total + plan.distinct + 1)
        for n, c in ((c2[v, w], cv[v]), (c3[u, v, w], cuv[u, v])):
            p = (n + mass(c) * p) / (c + mass(c))
        return math.log10(p)

    for r in done.collect():
        want = sum(log_p(*g) for g in grams[r["doc_id"]])
        assert abs(r["score"] - want) < 0.004 * r["n_tokens"]


def test_trie_answers_as_a_dictionary():
    import numpy as np

    from loomline.llm.trie import EliasFano, Trie

    rng = np.random.default_rng(0)
    for top in (3, 1000, 10**9):
        x = np.sort(rng.integers(0, top, 200))
        coded = EliasFano(EliasFano.coded(x))
        assert (coded[np.arange(200)] == x).all()
        q, lo = rng.integers(0, top + 5, 100), rng.integers(0, 200, 100)
        assert (coded.successor(lo, np.full(100, 200), q) == [a + np.searchsorted(x[a:], y) for a, y in zip(lo, q)]).all()
    triples = np.unique(rng.integers(0, 30, (2000, 3)), axis=0)
    pairs = np.unique(triples[:, [0, 2]], axis=0)
    p2, p3, back2, back3 = -rng.random(len(pairs)), -rng.random(len(triples)), -rng.random(30), -rng.random((30, 30))
    trie = Trie(Trie.build(pairs[:, 0], pairs[:, 1], p2, back2[pairs[:, 0]], triples[:, 0], triples[:, 1], triples[:, 2], p3, back3[triples[:, 0], triples[:, 1]]))
    two, three, past = {tuple(k): p for k, p in zip(pairs.tolist(), p2)}, {tuple(k): p for k, p in zip(triples.tolist(), p3)}, {tuple(k[:2]) for k in triples.tolist()}
    q = rng.integers(0, 32, (3000, 3))
    asked, pair = np.unique(q[:, [0, 2]], axis=0, return_inverse=True)
    pasts, of = np.unique(q[:, :2], axis=0, return_inverse=True)
    for (v, u, w), got in zip(q.tolist(), trie.log_p(asked[:, 0], asked[:, 1], np.full(len(asked), -4.0), pasts[:, 0], pasts[:, 1], pair, of)):
        p = two.get((v, w), -4.0 + (back2[v] if v < 30 else 0))
        p = three.get((v, u, w), p + (back3[v, u] if (v, u) in past else 0))
        assert abs(p - got) < 0.03


@pytest.mark.parametrize("block_tokens", [1 << 21, 500])
def test_packing(spark, block_tokens):
    import public_tokenizers
    from tokenizers import Tokenizer

    import numpy as np

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    done = packing.packed(table(spark), block_tokens=block_tokens).collect()
    want = sorted(((k, tuple([*encoder.encode(t or "", add_special_tokens=False).ids, 0])) for k, t in plain() if k is not None), key=repr)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in done:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for k, ids in want:
        own = pieces[k]
        copies = sum(x == (k, ids) for x in want)
        assert sum(r["length"] for r in own) == len(ids) * copies and {r["doc_tokens"] for r in own} == {len(ids)}
        assert all(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.packed(empty(spark)).count() == 0


def test_rolling_over_fewer_words_than_a_window():
    import numpy as np

    from loomline.llm.words import rolling

    for n in range(31):
        h = np.arange(1, n + 1, dtype=np.uint64)
        assert len(rolling(h, 20)) == n
        k1, k2, doc, start = substring._windows([b" ".join([b"w"] * n)], 20)
        assert len(k1) == len(k2) == len(doc) == len(start) == max(0, n - 19)


def test_packing_keeps_short_documents_in_their_tier():
    import random

    rng = random.Random(5)
    for low_, high, tier in ((257, 512, 512), (20, 256, 256), (513, 1024, 1024)):
        sizes = [rng.randint(low_, high) for _ in range(3000)]
        windows = packing.pack(sizes)
        assert sum(size for size, _ in windows if size == tier) > 0.8 * sum(sizes)
        assert all(size <= tier for size, _ in windows)
    sizes = [rng.choice((rng.randint(1, 256), rng.randint(257, 512), rng.randint(513, 3000))) for _ in range(3000)]
    windows = packing.pack(sizes)
    assert all(sum(n for _, _, n in window) == size for size, window in windows)
    pieces = defaultdict(list)
    for _, window in windows:
        for d, start, n in window:
            pieces[d].append((start, n))
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted(pieces[d]):
            assert start == at
            at += n
        assert at == size
    assert sum(size == 512 for size, _ in windows) > 100  # rests up to 256 mostly fill gaps here


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark)
    spark.createDataFrame([(1, " ".join(sentences(3, 3000).split()[100:130]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    ids = {r["doc_id"] for r in kept.collect()}
    assert 7 not in ids and not ids & {2, 3, 4} and 1 not in ids
    assert len(ids & {5, 8, -15}) == 1 and 11 in ids and len(ids & {9, 10}) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "benchmark_passages", "pack"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0


def test_nothing_outside_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in (root / "loomline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in re.findall(r"(?:from|import) [.\w]*", path.read_text()).__str__(), path
