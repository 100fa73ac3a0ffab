"""LM scoring: a smoothed model of order three in Elias-Fano tries, one for each shard of the contexts.

Each block of documents (see blocks) asks word shards for the training counts of its distinct words, then sends its
distinct n-grams, with those counts, to the shards of their contexts (the word before). A shard holds all n-grams of its
contexts: it sums the training counts, smooths, builds its trie in a memory map and answers every block's n-grams from
it. So the model may be larger than any machine, and a scored token costs a lookup within one shard.

Words are numbered by their counts' ranks, so the numbers that occur most are small and what is sent packs well.

Smoothing: p(w) = (c(w) + 1) / (N + V + 1); p(w | v) = (c(v w) + m p(w)) / (c(v) + m) and p(w | u v) likewise over
p(w | v), where m = strength * c ** 0.75 + 1 of the context's count c. Texts start after two start symbols and end in an
end symbol, a token. Contexts of over 1 / shards of all tokens are hot (no more of them than shards): their n-grams are
dealt by both words. So no shard holds all successors of a hot v after u; c(u v) is asked of the shard of that pair first,
and goes with the n-grams. The order is three for every context, however many shards there are.

Cases: a null text counts as empty: one token, the end; a null key counts as the empty text where the training rows are
chosen; repeated rows train and are scored one by one; without training rows every word is unknown and V = N = 0; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from . import blocks as B
from .frames import table
from .trie import Trie
from .words import SPACED_LOWER, U, Words, chunks, mix

WORDS, COUNTS, STATS, TOPS, GRAMS, SCORES, MODEL, PAIRS, TOTALS = range(1, 10)
START, END = U(0), U(2)
UNIT = 1000  # answers are -log10 p in thousandths
SCHEMA = "doc_id bigint, trained boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def not_in_fold(mod: int, rest: int) -> Callable[[int | None], bool]:
    """Whether a key's row is for training: crc32 of the key as text, modulo mod, is not rest."""
    return lambda key: zlib.crc32(b"" if key is None else str(key).encode()) % mod != rest


class Plan:
    def __init__(self, text_bytes: int, train: Callable[[int | None], bool], strength: float, shard_tokens: int):
        tokens = max(1, text_bytes // 6)  # an estimate: it sets sizes, not results
        self.train, self.strength = train, strength
        self.shards = max(8, -(-tokens // shard_tokens))
        self.total = self.distinct = self.texts = 0
        self.hot = np.zeros(0, U)

    def shard(self, h: np.ndarray) -> np.ndarray:
        """The shard of each hash; it grows with the hash."""
        return ((h >> U(32)) * U(self.shards)) >> U(32)

    def counted(self, sums: list[np.ndarray]) -> float:
        """Takes the word shards' sums; the count above which a word is hot, of which there are no more than shards."""
        self.total, self.distinct, self.texts = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0, 0)
        return self.total / self.shards


def _tokens(plan: Plan, blob: bytes) -> tuple:
    """ids, whether each text trains, every token's hash and text."""
    ids, texts = B.documents(blob)
    parts, counts = [], []
    for i, j in chunks(texts):
        words = Words(texts[i:j], SPACED_LOWER)
        parts.append(words.hashes())
        counts.append(words.counts())
    h, count = np.concatenate(parts), np.concatenate(counts)
    h[h <= END] += U(3)
    text = np.repeat(np.arange(len(ids)), count + 1)
    tokens = np.full(len(text), END, U)
    tokens[np.arange(len(h)) + np.repeat(np.arange(len(ids)), count)] = h
    return ids, np.array([plan.train(i) for i in ids], bool), tokens, text


def _split(shard: np.ndarray):
    """(shard, from, to) for runs of equal shards."""
    edges = np.flatnonzero(np.diff(shard.astype(np.int64))) + 1
    for a, b in zip([0, *edges], [*edges, len(shard)]):
        if b > a:
            yield int(shard[a]), a, b


def _ask_words(plan: Plan):
    def run(block: int, blob: bytes):
        _, train, tokens, text = _tokens(plan, blob)
        words, of = np.unique(tokens, return_inverse=True)
        count = np.bincount(of, train[text], len(words)).astype(np.uint32)
        for shard, a, b in _split(plan.shard(words)):
            yield shard, WORDS, block, B.pack(B.steps(words[a:b]), count[a:b])

    return run


def _count_words(plan: Plan):
    def run(dest: int, by: dict):
        parts = [B.unpack(blob) for _, blob in by[WORDS]]
        hashes = [np.cumsum(step, dtype=U) for step, _ in parts]
        words = np.unique(np.concatenate(hashes))
        total = np.zeros(len(words), np.int64)
        for h, (_, count) in zip(hashes, parts):
            total[np.searchsorted(words, h)] += count
        order = np.argsort(-total, kind="stable")
        number = np.empty(len(words), U)
        number[order] = np.arange(len(words), dtype=U) * U(plan.shards) + U(dest + 1)  # 0 is the start
        for (block, _), h in zip(by[WORDS], hashes):
            place = np.searchsorted(words, h)
            yield block, COUNTS, dest, B.pack(number[place], total[place].astype(U))
        top = order[words[order] != END][: plan.shards]
        yield -1, STATS, dest, B.pack(np.array([total.sum(), (total > 0).sum(), total[0] if len(words) and words[0] == END else 0], np.int64))
        yield -1, TOPS, dest, B.pack(number[top], total[top].astype(U))

    return run


def _over(least: float):
    """The numbers of a shard's words that occur more often."""

    def run(batches):
        for rows in batches:
            found = [number[count > least].view(np.int64) for number, count in (B.unpack(blob.as_py()) for blob in rows.column(0))]
            yield pa.record_batch({"number": pa.array(np.concatenate(found))})

    return run


class _Words:
    """The tokens of a block by its words, which are ordered by number; the words' counts; the distinct pairs (v, w), and the pair of each token."""

    def __init__(self, plan: Plan, by: dict):
        self.ids, self.train, tokens, self.text = _tokens(plan, by[B.DOCS][0][1])
        _, w = np.unique(tokens, return_inverse=True)
        told = [B.unpack(blob) for _, blob in by[COUNTS]]  # by shard, as the words by hash
        numbers, counts = (np.concatenate(x) for x in zip(*told))
        self.token_counts = counts[w].astype(np.int64)
        order = np.argsort(numbers, kind="stable")
        self.words, self.counts = np.concatenate([[START], numbers[order]]), np.concatenate([np.array([plan.texts], U), counts[order]])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        w = place[w]
        first = np.ones(len(w), bool)
        first[1:] = self.text[1:] != self.text[:-1]
        v = np.where(first, 0, np.concatenate([[0], w[:-1]]))
        self.token_u = np.where(first, 0, np.concatenate([[0], v[:-1]]))
        self.hot = np.isin(self.words, plan.hot)
        self.pairs, self.token_pair = np.unique((v << 32) | w, return_inverse=True)
        self.v, self.w = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        at = mix(self.words[self.v])
        at[self.hot[self.v]] = mix(at[self.hot[self.v]] ^ self.words[self.w[self.hot[self.v]]])
        self.shard = plan.shard(at)
        asked = np.flatnonzero(self.hot[self.w])  # pairs that end in a hot word are histories that several shards need
        self.asked = asked[np.argsort(self.shard[asked], kind="stable")]
        self.asked_shards = list(_split(self.shard[self.asked]))


class _Grams(_Words):
    """Further the distinct triples, ordered by shard, and the triple of each token."""

    def __init__(self, plan: Plan, by: dict):
        super().__init__(plan, by)
        triples, self.of = np.unique((self.token_pair.astype(np.int64) << 32) | self.token_u, return_inverse=True)
        self.count = np.bincount(self.of, self.train[self.text], len(triples)).astype(np.uint32)
        self.pair, self.u = triples >> 32, triples & 0xFFFFFFFF
        shard = self.shard[self.pair]
        self.order = np.argsort(shard, kind="stable")
        self.shards = list(_split(shard[self.order]))
        self.late = self.hot[self.v] & (self.v > 0)  # the pair's context is hot, and not the start


def _ask_pairs(plan: Plan):
    """The training counts of a block's pairs that end in a hot word."""

    def run(block: int, by: dict):
        x = _Words(plan, by)
        count = np.bincount(x.token_pair, x.train[x.text], len(x.pairs)).astype(np.uint32)
        for shard, a, b in x.asked_shards:
            k = x.asked[a:b]
            used, local = np.unique(np.concatenate([x.v[k], x.w[k]]), return_inverse=True)
            local = local.astype(np.uint32)
            yield shard, PAIRS, block, B.pack(B.steps(x.words[used]), B.steps(local[: b - a]), local[b - a :], count[k])

    return run


def _sum_pairs(plan: Plan):
    def run(dest: int, by: dict):
        parts = []
        for _, blob in by[PAIRS]:
            step, v, w, n = B.unpack(blob)
            parts.append((np.cumsum(step, dtype=U), np.cumsum(v, dtype=np.uint32), w, n))
        words = np.unique(np.concatenate([p[0] for p in parts]))
        keys = []
        for h, v, w, _ in parts:
            to = np.searchsorted(words, h)
            keys.append((to[v] << 32) | to[w])
        pairs, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate([p[3] for p in parts]), len(pairs)).astype(U)[of]
        at = 0
        for (block, _), p in zip(by[PAIRS], parts):
            yield block, TOTALS, dest, B.pack(total[at : at + len(p[3])])
            at += len(p[3])

    return run


def _ask_grams(plan: Plan):
    def run(block: int, by: dict):
        x, told = _Grams(plan, by), dict(by.get(TOTALS, ()))
        totals = np.zeros(len(x.pairs), U)
        for shard, a, b in x.asked_shards:
            totals[x.asked[a:b]] = B.unpack(told[shard])[0]
        used, local = np.zeros(len(x.words), bool), np.zeros(len(x.words), np.uint32)
        for shard, a, b in x.shards:
            t = x.order[a:b]
            first = np.flatnonzero(np.concatenate([[True], x.pair[t[1:]] != x.pair[t[:-1]]]))
            pair = x.pair[t[first]]
            used[:] = False
            for k in (x.v[pair], x.w[pair], x.u[t]):
                used[k] = True
            own = np.flatnonzero(used)
            local[own] = np.arange(len(own), dtype=np.uint32)
            late = t[x.late[x.pair[t]]]
            past = totals[np.searchsorted(x.pairs, (x.u[late] << 32) | x.v[x.pair[late]])]
            yield shard, GRAMS, block, B.pack(B.steps(x.words[own]), B.turns(x.counts[own]), B.steps(local[x.v[pair]]), local[x.w[pair]], np.diff(np.append(first, len(t))).astype(np.uint32), local[x.u[t]], x.count[t], past)

    return run


def _score_grams(plan: Plan, keep_model: bool = False):
    def run(dest: int, by: dict):
        parts = []
        for _, blob in by[GRAMS]:
            step, counts, v, w, many, u, n, past = B.unpack(blob)
            parts.append((np.cumsum(step, dtype=U), B.unturned(counts), np.cumsum(v, dtype=np.uint32), w, many, u, n, past))
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        counts = np.concatenate([p[1] for p in parts])[at].astype(float)
        hot, start = np.isin(words, plan.hot), words == START
        keys, many, u, told = [], [], [], []
        for h, _, pv, pw, repeat, pu, _, past in parts:
            to = np.searchsorted(words, h)
            keys.append((to[pv] << 32) | to[pw])
            many.append(repeat)
            u.append(to[pu])
            v = np.repeat(to[pv], repeat)
            told.append(np.where(start[v], float(plan.texts), 0.0))
            told[-1][hot[v] & ~start[v]] = past
        n = np.concatenate([p[6] for p in parts]).astype(float)
        sizes = [len(p[5]) for p in parts]
        blocks, parts = [block for block, _ in by[GRAMS]], None
        by.clear()
        pairs, of = np.unique(np.concatenate(keys), return_inverse=True)
        triples, of = np.unique((np.repeat(of.astype(np.int64), np.concatenate(many)) << 32) | np.concatenate(u), return_inverse=True)
        n = np.bincount(of, n, len(triples))
        whole = np.zeros(len(triples))
        whole[of] = np.concatenate(told)
        keys = many = told = None
        pair, u = triples >> 32, triples & 0xFFFFFFFF
        v, w, n2 = pairs >> 32, pairs & 0xFFFFFFFF, np.bincount(pair, n, len(pairs))
        mass = lambda c: plan.strength * c**0.75 + 1
        base = (counts + 1) / (plan.total + plan.distinct + 1)
        context, m = counts[v], mass(counts)[v]
        p2, back2 = (n2 + m * base[w]) / (context + m), m / (context + m)
        contexts, at = np.unique(v, return_index=True)
        at = at[counts[contexts] > 0]
        pasts, past = np.unique((v[pair] << 32) | u, return_inverse=True)
        held = np.bincount(past, n, len(pasts))
        late = hot[v[pair]]
        held[past[late]] = whole[late]  # successors of a hot context are in other shards too
        whole = None
        m3 = mass(held)
        back3 = m3 / (held + m3)
        t = np.flatnonzero(n > 0)
        t = t[np.argsort((past[t].astype(np.int64) << 32) | w[pair[t]], kind="stable")]  # by v, u, w
        p3 = (n[t] + m3[past[t]] * p2[pair[t]]) / (held[past[t]] + m3[past[t]])
        s, k, pv, pu = np.flatnonzero(n2 > 0), np.flatnonzero(held > 0), pasts >> 32, pasts & 0xFFFFFFFF
        coded = Trie.build(
            v[s], w[s], np.log10(p2[s]), np.log10(back2[s]), v[pair[t]], u[t], w[pair[t]], np.log10(p3), np.log10(back3[past[t]]),
            (v[at], np.log10(back2[at])), (pv[k], pu[k], np.log10(back3[k])),
        )
        with mmap.mmap(-1, len(coded)) as mapped:
            mapped.write(coded)
            trie = Trie(mapped)
            got = trie.log_p(v, w, np.log10(base)[w], pv, pu, pair, past)
            del trie
        answer = np.clip(np.rint(-got * UNIT), 0, 65535).astype(np.uint16)[of]
        at = 0
        for block, size in zip(blocks, sizes):
            yield block, SCORES, dest, B.pack(answer[at : at + size])
            at += size
        if keep_model:
            yield -1, MODEL, dest, coded

    return run


def _finish(plan: Plan):
    def run(block: int, by: dict) -> pa.Table:
        x, told = _Grams(plan, by), dict(by[SCORES])
        answer = np.empty(len(x.order))
        for shard, a, b in x.shards:
            answer[x.order[a:b]] = B.unpack(told[shard])[0]
        size = len(x.ids)
        total = lambda each: np.bincount(x.text, each, size)
        return pa.table({
            "doc_id": pa.array(x.ids, pa.int64()), "trained": pa.array(x.train), "n_tokens": pa.array(np.bincount(x.text, minlength=size).astype(np.int64)), "n_known": pa.array(total(x.token_counts > 0).astype(np.int64)),
            "base_score": pa.array(total(np.log10((x.token_counts + 1) / (plan.total + plan.distinct + 1)))), "score": pa.array(total(-answer[x.of] / UNIT)),
        })

    return run


def scored(docs: DataFrame, train: Callable[[int | None], bool], key: str = "doc_id", text: str = "text", strength: float = 2.0, block_bytes: int = 12 << 20, shard_tokens: int = 1_000_000) -> tuple[DataFrame, Plan]:
    """doc_id, trained, n_tokens, n_known, base_score and score for each row of docs, and the plan with N (total) and V (distinct)."""
    plan = Plan(B.text_bytes(docs, text), train, strength, shard_tokens)
    made = written(B.made(docs, key, text, block_bytes, level=6), "lm")
    counts = written(B.gathered(B.each(made, _ask_words(plan)), _count_words(plan)), "lm")
    least = plan.counted([B.unpack(r["blob"])[0] for r in counts.where(F.col("kind") == STATS).select("blob").collect()])  # three sums a shard
    hot = counts.where(F.col("kind") == TOPS).select("blob").mapInArrow(_over(least), "number bigint").collect()  # no more than shards
    plan.hot = np.array(sorted([r["number"] for r in hot] + [int(START)] * (plan.texts > least)), U)
    known = made.unionByName(counts.where(F.col("kind") == COUNTS))
    totals = B.gathered(B.gathered(known, _ask_pairs(plan)), _sum_pairs(plan))
    scores = B.gathered(B.gathered(known, _ask_grams(plan), also=totals), _score_grams(plan))
    return B.gathered(known, _finish(plan), SCHEMA, also=scores), plan


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    done, plan = scored(table(spark, sf_dir, "documents"), not_in_fold(7, 2))
    return done.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", F.lit(plan.total).cast("bigint").alias("train_tokens"), "base_score", "score")
