"""Language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts of order 0 up to `order`, with counts frozen after training. The probability of
a byte is that of the longest context that was followed by it, times the escapes from the longer contexts; what a context
escapes with goes to the bytes not seen in it, in proportion to the next shorter context (so that all bytes' probabilities
sum to one). The code length of a text under each language is exact; the shortest wins.

Bytes: A-Z in lower case; each run of ASCII that is no letter is one space; bytes that training never saw are one symbol.

Contexts are kept sparsely and without any cut: for each language and order, the sorted (context, byte) numbers that its
sample holds, with their code lengths, and for each context what escaping from it costs. A batch's distinct contexts are
looked up once in each language, so a byte costs a sort and one addition a language.

Training takes a bounded sample: for each language, the `sample_rows` training rows that come first by a hash of their
key, whole texts, up to `sample_bytes`, and up to `all_bytes` over all languages together (each language's bound shrinks
as languages grow in number). That sample bounds the model, and so what is broadcast: 8 to 12 bytes for each distinct
context of a byte, four for a sampled byte at the most. More than `most_langs` languages are an error, not a cut.

Cases: a null text, or one without a letter, is `und` with score 0; without any training row every text is `und`, and
`accepted` keeps what has a letter, as there is no language to judge by; ties go to the language that sorts first; rows
with a null language, key or text are never sampled; repeated rows are predicted one by one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import col, crc_mod, fresh, small_batches, table, trimmed
from .words import LOWER, binary, chunks

_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in LOWER)


def symbols_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in normal form, each text between two spaces that it shares with its neighbours, and where texts start (and the end)."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" " + b" ".join((t or b"").translate(_PLAIN) for t in texts) + b" ", np.uint8)
    keep = np.ones(len(data), bool)
    np.logical_or(data[1:] != 32, data[:-1] != 32, out=keep[1:])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    keep[at] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


class Tree:
    """The contexts of one language: by order, (context, symbol) numbers and their bits, context numbers and the bits of an escape."""

    def __init__(self, x: np.ndarray, size: int, order: int):
        self.size, self.levels = size, []
        for k in range(order + 1):
            grams, n = np.unique(codes_of(x, k, size), return_counts=True)
            contexts, first = np.unique(grams // size, return_index=True)
            of = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(grams))))
            total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
            # what the next shorter context gives to the bytes seen here: they were all seen there too
            under = 2.0 ** -self._seen(k - 1, grams % size**k) if k else np.full(len(grams), 1 / size)
            rest = np.maximum(1 - np.bincount(of, under, len(contexts)), 0)
            rest = np.where((distinct < size) & (rest > 1e-12), rest, 0)
            escape = np.where(rest > 0, distinct / np.maximum(total + distinct, 1), 0)
            bits = -np.log2(n / total[of] * (1 - escape[of])) if len(grams) else np.zeros(0)
            out = np.where(rest > 0, np.log2(np.maximum(rest, 1e-300)) - np.log2(np.maximum(escape, 1e-300)), 0)
            self.levels.append((grams, bits, contexts, out))

    def _seen(self, k: int, grams: np.ndarray) -> np.ndarray:
        own, bits, _, _ = self.levels[k]
        return bits[np.searchsorted(own, grams)]

    def compact(self) -> None:
        """Bits in four bytes, once all orders are made."""
        self.levels = [(g, b.astype(np.float32), c, o.astype(np.float32)) for g, b, c, o in self.levels]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of (context, symbol) numbers of the longest order."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in reversed(range(len(self.levels))):
            own, bits, contexts, escape = self.levels[k]
            g = grams[left] % self.size ** (k + 1)
            if len(own):
                at = np.minimum(np.searchsorted(own, g), len(own) - 1)
                hit = own[at] == g
                out[left[hit]] += bits[at[hit]]
                left, g = left[~hit], g[~hit]
                at = np.minimum(np.searchsorted(contexts, g // self.size), len(contexts) - 1)
                known = contexts[at] == g // self.size
                out[left[known]] += escape[at[known]]
        out[left] += np.log2(self.size)
        return out


def codes_of(x: np.ndarray, k: int, size: int) -> np.ndarray:
    """Of each symbol that has k before it: those and itself as a number."""
    out = np.zeros(max(len(x) - k, 0), np.int64)
    for i in range(k + 1):
        out *= size
        out += x[i : len(x) - k + i]
    return out


class Model:
    """A tree for each language, over the bytes that training saw and one symbol (0) for all others."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3):
        self.langs, self.order = sorted(samples), order
        streams = [symbols_of(samples[lang])[0] for lang in self.langs]
        seen = np.unique(np.concatenate([np.array([32], np.uint8), *streams]))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.size = len(seen) + 1
        self.trees = []
        for x in streams:
            self.trees.append(Tree(self.symbol[x], self.size, order))
            self.trees[-1].compact()

    def held(self) -> int:
        return sum(a.nbytes for tree in self.trees for level in tree.levels for a in level)

    def lengths(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language, and symbols of each text."""
        data, at = symbols_of(texts)
        x = np.concatenate([np.full(self.order, self.symbol[32]), self.symbol[data]])
        grams = codes_of(x, self.order, self.size)
        # the first symbols of a text follow the end of the text before: their contexts start anew
        for k in range(1, self.order + 1):
            i = at[:-1] + k
            i = i[i < at[1:]]
            anew = np.zeros(len(i), np.int64)
            for j in range(self.order, -1, -1):
                anew = anew * self.size + (x[i + self.order - j] if j <= k else self.symbol[32])
            grams[i] = anew
        own, of = np.unique(grams, return_inverse=True)
        count, out = np.diff(at) - 1, np.zeros((len(at) - 1, len(self.trees)))
        for k, tree in enumerate(self.trees):
            bits = tree.bits(own)[of]
            bits[at] = 0  # the space before a text is given
            out[:, k] = np.add.reduceat(bits, at[:-1])
        return out, count


def trained(docs: DataFrame, use: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 300, sample_bytes: int = 1 << 20, all_bytes: int = 32 << 20, most_langs: int = 1000, order: int = 3) -> Model | None:
    """A model of the rows for which `use` holds; None if there are none."""
    rows = docs.where(use & col(lang).isNotNull() & col(key).isNotNull() & col(text).isNotNull()).select(col(key).alias("k"), col(lang).cast("string").alias("l"))
    langs = [r["l"] for r in rows.select("l").distinct().limit(most_langs + 1).collect()]
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not langs:
        return None
    each = min(sample_bytes, all_bytes // len(langs))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))).where(F.col("n") <= min(sample_rows, max(1, each // 64))).select("k").collect()
    sample = docs.where(use & col(lang).isNotNull() & col(key).isin(sorted({r["k"] for r in first}))).select(col(key).alias("k"), col(lang).cast("string").alias("l"), col(text).cast("string").alias("t"), F.xxhash64(col(key)).alias("h"))
    samples: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for r in sample.orderBy("h", "k", "t").toLocalIterator():
        if held.get(r["l"], 0) < each and r["t"] is not None:
            samples.setdefault(r["l"], []).append(r["t"].encode())
            held[r["l"]] = held.get(r["l"], 0) + len(samples[r["l"]][-1])
    return Model(samples, order) if samples else None


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with lang_pred, score (the language's share of the probability) and bits (a symbol, under that language); the names clash with no column."""
    small_batches(docs.sparkSession)
    pred, score, bits, letter = names = fresh(docs.columns, "lang_pred", "score", "bits", "letter")
    rows = docs.withColumn(letter, F.coalesce(col(text).cast("string").rlike(r"\p{L}"), F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(bits, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            at = batch.schema.get_field_index
            has = batch.column(at(letter)).to_pylist()
            found = [t if ok else None for t, ok in zip(binary(batch.column(at(text))), has)]
            langs: list[str] = []
            scores, each = [], []
            for i, j in chunks(found) if known else ():
                length, count = known.lengths(found[i:j])
                best = length.argmin(1)
                least = length.min(1)
                scores.append(1 / np.exp2(np.clip(least[:, None] - length, -1000, 0)).sum(1))
                each.append(least / np.maximum(count, 1))
                langs += [known.langs[b] for b in best.tolist()]
            keep = [bool(known and ok) for ok in has]
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != letter]
            put = lambda x: pa.array([v if ok else 0.0 for v, ok in zip(np.concatenate(x).tolist() if x else [0.0] * len(has), keep)], pa.float64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x if ok else "und" for x, ok in zip(langs or [None] * len(has), keep)], pa.string()), put(scores), put(each)], names=schema.names)

    return rows.mapInArrow(trimmed(run), schema), names[:3]


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs in a known language: those that are not `und` and that a language codes in fewer bits than symbols drawn evenly would take."""
    if model is None:
        return docs.where(col(text).cast("string").rlike(r"\p{L}"))
    done, (pred, _, bits) = predicted(docs, model, text)
    return done.where((col(pred) != "und") & (col(bits) < float(np.log2(model.size)))).select(*[col(c) for c in docs.columns])


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    done, _ = predicted(docs.select("doc_id", "text"), trained(docs, ~held_out))
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.col("bits").alias("bits_per_symbol"))
