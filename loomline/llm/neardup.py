"""Near duplicates by a chosen-path set similarity join.

Documents of equal shingle sets are one set. Each set has a signature of minwise tokens. From the root of each of
`trees` independent trees a set branches, at each node, by 1 / similarity of the signature's places on average: which
places is drawn from the node's path, so that similar sets go the same way. Two sets of just the wanted similarity share
one branch of a node on average, sets of less fewer, so nodes get small with depth, and a pair's chance to meet in a leaf
grows with the trees to the target recall. Nodes above `node_rows` branch on, round by round, until they are small; a node
whose members mostly go the same way is a group of alike members, which no branching makes small, and stays as it is. The
members of small nodes are compared exhaustively by signature, and the pairs that pass are confirmed on the full sets.

A node of many alike members would give all their pairs. It gives the links of a spanning forest instead, the likeliest
first; when those are confirmed and components known, its members outside its largest component are held against all its
members on the full sets, which travel with the members, not with pairs. So no link that would join two components is
skipped, and rows grow with members. Nodes that stay large are compared in cells: in the first round with the node's
first member in each cell, in the second each cell of the largest component's members with all others, in cells too.

Cases: a null or empty text has an empty set and is linked with nothing; texts with fewer words than a shingle have one
shingle, the whole sequence; rows with a null key are linked with nothing, have no component and are kept; rows of the
same key and text share their decision, rows of the same key and other texts are decided each by its own text; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import written
from .frames import col, fresh, small_batches, table, trimmed
from .frames import texts as only_texts
from .words import SPACED_LOWER, U, Words, binary, chunks, mix, rolling

PLACES = 128
_ODD = np.random.default_rng(7).integers(0, 1 << 63, PLACES, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    for i, j in chunks(texts):
        words = Words(texts[i:j], SPACED_LOWER)
        h = words.hashes()
        full = rolling(h, n)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            else:  # the whole sequence as one shingle
                yield rolling(h[a:b], b - a, 99)[:1] if b > a else np.zeros(0, U)


def signature(shingles: np.ndarray) -> np.ndarray:
    """PLACES tokens of 16 bits of the least value of the shingles under each of PLACES hash functions."""
    least = np.full(PLACES, np.iinfo(U).max, U)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * _ODD).min(0), out=least)
    return (mix(least) >> U(48)).astype("<u2")


def branches(tokens: np.ndarray, paths: np.ndarray, owner: np.ndarray, depth: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes `depth` levels further down that each (owner of tokens, path) reaches, and their owners."""
    sure, more = int(1 / similarity), U(int((1 / similarity % 1) * (1 << 64)))
    for _ in range(depth):
        place = mix(paths + U(1)) % U(PLACES)
        stride = mix(paths + U(2)) % U(PLACES // 2) * U(2) + U(1)  # odd: places of one node differ
        found = []
        for k in range(sure + 1):
            go = np.arange(len(paths)) if k < sure else np.flatnonzero(mix(paths + U(3)) < more)
            at = (place[go] + stride[go] * U(k)) % U(PLACES)
            found.append((mix(mix(paths[go] ^ (at + U(1)) * _STEP) ^ (tokens[owner[go], at.astype(np.int64)].astype(U) + U(1)) * _STEP), owner[go]))
        paths, owner = (np.concatenate(x) for x in zip(*found))
    return paths, owner


class Links:
    """Union of members within a node."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def alike(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs i < j of rows that agree in `least` places, and in how many."""
    out_i, out_j, places = [], [], []
    for i in range(0, len(tokens), 64):
        same = (tokens[i : i + 64, None, :] == tokens[None, i:, :]).sum(2, dtype=np.int16)
        a, b = np.nonzero(same >= least)
        ok = b > a
        out_i.append(a[ok] + i)
        out_j.append(b[ok] + i)
        places.append(same[a[ok], b[ok]])
    return (np.concatenate(out_i), np.concatenate(out_j), np.concatenate(places)) if out_i else (np.zeros(0, np.int64),) * 3


def _tokens(blobs: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(-1, PLACES)


class Join:
    def __init__(self, docs: DataFrame, key: str, text: str, n: int, percent: int, trees: int, depth: int, node_rows: int, digested: bool = False):
        small_batches(docs.sparkSession)
        self.extra = [F.sha2(F.col("text").cast("binary"), 256).alias("digest")] if digested else []
        self.docs, self.n, self.percent, self.trees, self.depth, self.node_rows = only_texts(docs, key, text), n, percent, trees, depth, node_rows
        self.similarity, self.cell_rows = percent / 100, 8 * node_rows
        # four standard deviations of the share of agreeing places
        self.least = int(PLACES * (self.similarity - 4 * (self.similarity * (1 - self.similarity) / PLACES) ** 0.5))

    def signed(self) -> DataFrame:
        n, more = self.n, bool(self.extra)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                count, ids, signs = [], [], []
                for s in shingle_sets(binary(batch.column(1)), n):
                    count.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    signs.append(signature(s).tobytes() if len(s) else None)
                yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": pa.array(count, pa.int64()), "set": pa.array(ids, pa.binary()), "sign": pa.array(signs, pa.binary())} | ({"digest": batch.column(2)} if more else {}))

        return written(self.docs.select("doc_id", "text", *self.extra).mapInArrow(trimmed(run), "doc_id bigint, n_shingles bigint, set binary, sign binary" + ", digest string" * more), "neardup")

    def rooted(self, sets: DataFrame) -> DataFrame:
        """(node, set) at `depth` below the roots."""
        trees, depth, similarity = self.trees, self.depth, self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    tokens = _tokens(batch.column(1), "<u2")
                    roots = mix(np.arange(1, trees + 1, dtype=U) * _STEP)
                    node, owner = branches(tokens, np.tile(roots, len(tokens)), np.repeat(np.arange(len(tokens)), trees), depth, similarity)
                    yield pa.record_batch({"node": pa.array(node.view(np.int64)), "set": batch.column(0).take(pa.array(owner))})

        return sets.select("set", "sign").mapInArrow(trimmed(run), "node bigint, set binary")

    def deeper(self, rows: DataFrame, subtrees: int) -> DataFrame:
        """(parent, node, set) further down for rows (node, set, sign): in each of so many subtrees of the node."""
        depth, similarity = self.depth, self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    nodes = batch.column(0).to_numpy().view(U)
                    roots = np.concatenate([nodes, *(mix(nodes ^ mix(U(k) * _STEP)) for k in range(1, subtrees))])
                    node, owner = branches(_tokens(batch.column(2), "<u2"), roots, np.tile(np.arange(batch.num_rows), subtrees), depth, similarity)
                    owner = pa.array(owner)
                    yield pa.record_batch({"parent": batch.column(0).take(owner), "node": pa.array(node.view(np.int64)), "set": batch.column(1).take(owner)})

        return rows.select("node", "set", "sign").mapInArrow(trimmed(run), "parent bigint, node bigint, set binary")

    def nodes(self, sets: DataFrame) -> DataFrame:
        """(node, set, sign, size) of all nodes with two members or more that branch no further."""
        signs, parts = sets.select("set", "sign"), []
        rows, subtrees = self.rooted(sets).distinct(), 2
        while True:
            rows = written(rows, "neardup")
            found = written(rows.join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "node"), "neardup")
            parts.append(found.where(F.col("size") <= self.node_rows))
            large = found.where(F.col("size") > self.node_rows)
            if large.isEmpty():
                break
            below = written(self.deeper(large.join(signs, "set"), subtrees).distinct(), "neardup")
            # members as alike as is wanted go the same way at each place with odds of the root of the similarity
            together = below.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.max("n").alias("n"))
            sizes = large.groupBy(F.col("node").alias("parent")).agg(F.first("size").alias("size"))
            shrinking = written(together.join(sizes, "parent").where(F.col("n") < F.col("size") * self.similarity ** (self.depth / 2)).select("parent"), "neardup")
            parts.append(large.join(shrinking.withColumnRenamed("parent", "node"), "node", "left_anti"))
            rows, subtrees = below.join(shrinking, "parent").select("node", "set").distinct(), 1
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return written(found.join(signs, "set"), "neardup")

    def compared(self, cells: DataFrame) -> DataFrame:
        """Pairs (a, b) of members alike in a cell (node, cell, set, sign, label); where there are many, only a spanning forest of the likeliest, and a row (node, null, null) that says so."""
        least = self.least

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("set")
            ids, node, whole = rows["set"].to_pylist(), rows["node"][0].as_py(), True
            i, j, places = alike(_tokens(rows["sign"], "<u2").astype(np.uint8), least)
            if len(i) > 2 * len(ids):
                links = Links(len(ids))
                most = np.argsort(-places.astype(int), kind="stable")  # the likeliest links first
                i, j = i[most], j[most]
                pairs = [(a, b) for a, b in zip(i.tolist(), j.tolist()) if links.join(a, b)]
                whole = False
            else:
                pairs = list(zip(i.tolist(), j.tolist()))
            left, right = [ids[a] for a, _ in pairs], [ids[b] for _, b in pairs]
            if not whole:
                left, right = [*left, None], [*right, None]
            return pa.table({"node": pa.array([node] * len(left), pa.int64()), "a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

        return cells.groupBy("node", "cell").applyInArrow(run, "node bigint, a binary, b binary")

    def bodies(self, need: DataFrame, sets: DataFrame) -> DataFrame:
        """(set, words) of the sets wanted: the text, packed, of a document of each."""
        n = self.n
        need = need.join(sets.select("set", "rep"), "set")

        def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [t or b"" for t in binary(batch.column(1))]
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in shingle_sets(found, n)]
                yield pa.record_batch({"set": batch.column(0), "own": pa.array(ids, pa.binary()), "words": pa.array([zstandard.compress(t, 3) for t in found], pa.binary())})

        found = self.docs.join(need, self.docs["doc_id"] == need["rep"]).select("set", "text").mapInArrow(trimmed(squeezed), "set binary, own binary, words binary")
        return written(found.where("set = own").dropDuplicates(["set"]).select("set", "words"), "neardup")  # one key can have several texts

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs (a, b) those of full sets that are similar enough."""
        n, percent = self.n, self.percent
        bodies = self.bodies(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), sets)
        rows = pairs.join(bodies.select(F.col("set").alias("b"), F.col("words").alias("right")), "b").join(bodies.select(F.col("set").alias("a"), F.col("words").alias("left")), "a")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple = (None, None)
            for batch in batches:
                ok = []
                for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                    if held[0] != a:
                        held = (a, next(shingle_sets([zstandard.decompress(left.as_py())], n)))
                    other = next(shingle_sets([zstandard.decompress(right.as_py())], n))
                    both = len(np.intersect1d(held[1], other, assume_unique=True))
                    ok.append(100 * both >= percent * (len(held[1]) + len(other) - both))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return rows.select("a", "b", "left", "right").mapInArrow(trimmed(check), "a binary, b binary")

    def settled(self, cells: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b): a spanning forest of the links of full sets between members of different labels of each cell.

        Every member that is not of the cell's most common label is held against all members, on full sets.
        """
        n, percent = self.n, self.percent
        rows = cells.join(self.bodies(cells.select("set").distinct(), sets), "set").select("node", "cell", "set", "label", "words")

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("set")
            ids = rows["set"].to_pylist()
            _, own = np.unique(np.array(rows["label"].to_pylist(), dtype=object), return_inverse=True)
            found = list(shingle_sets([zstandard.decompress(w.as_py()) for w in rows["words"]], n))
            size = np.array([len(s) for s in found])
            seen, flat = np.unique(np.concatenate(found), return_inverse=True)
            starts, mark, links, pairs = np.cumsum(size) - size, np.zeros(len(seen), bool), Links(len(ids)), []
            for i in np.flatnonzero(own != np.bincount(own).argmax()).tolist():
                at = flat[starts[i] : starts[i] + size[i]]
                mark[at] = True
                both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                mark[at] = False
                alike = np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (own != own[i]))
                pairs += [(ids[min(i, j)], ids[max(i, j)]) for j in alike.tolist() if links.join(i, j)]
            return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

        return rows.groupBy("node", "cell").applyInArrow(run, "a binary, b binary")

    def cells(self, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
        """(node, cell, set, sign, label): small nodes are one cell, large ones several."""
        most = self.node_rows if labels is None else self.cell_rows
        count = F.ceil(F.col("size") / most).cast("bigint")
        own = F.pmod(F.xxhash64("set"), count)
        if labels is None:
            rows = nodes.withColumn("label", F.col("set"))
            first = rows.where(count > 1).groupBy("node").agg(F.min(F.struct("set", "sign", "size")).alias("x")).select("node", F.col("x.set").alias("set"), F.col("x.sign").alias("sign"), F.col("x.size").alias("size"), F.col("x.set").alias("label"))
            spread = first.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
            return rows.withColumn("cell", own).select("node", "cell", "set", "sign", "label").unionByName(spread.select("node", "cell", "set", "sign", "label")).dropDuplicates(["node", "cell", "set"])
        rows = written(nodes.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set")), "neardup")
        by = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all")).where("most.n < all")
        rows = rows.join(by.select("node", F.col("most.label").alias("main"), (F.col("all") - F.col("most.n")).alias("others")), "node")
        wide = F.ceil(F.col("others") / most).cast("bigint")
        side = F.pmod(F.xxhash64("set", F.lit(1)), wide)
        # main members take a row of cells, others a column of them and, to meet each other, a row too
        main = rows.where("label = main").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), wide - 1), lambda j: own * wide + j)))
        column = rows.where("label <> main").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: i * wide + side)))
        meet = rows.where((F.col("label") != F.col("main")) & (wide > 1)).withColumn("cell", F.explode(F.flatten(F.array(F.transform(F.sequence(F.lit(0).cast("bigint"), wide - 1), lambda j: -1 - (F.least(side, j) * wide + F.greatest(side, j)))))))
        return main.unionByName(column).unionByName(meet).select("node", "cell", "set", "sign", "label").dropDuplicates(["node", "cell", "set"])

    def run(self) -> DataFrame:
        """doc_id, n_shingles, set, component_id, kept (and the digest if asked for) for each row of docs."""
        signed = self.signed()
        linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        sets = written(linked.groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("sign").alias("sign")), "neardup")
        nodes = self.nodes(sets)
        found = written(self.compared(self.cells(nodes, None)), "neardup")
        pairs = written(found.where("a IS NOT NULL").select("a", "b").distinct(), "neardup")
        links = written(self.confirmed(pairs, sets), "neardup")
        labels = written(components(links), "neardup")
        again = nodes.join(found.where("a IS NULL").select("node").unionByName(nodes.where(F.col("size") > self.node_rows).select("node")).distinct(), "node", "left_semi")
        rest = written(self.settled(self.cells(again, labels), sets).distinct(), "neardup")
        if not rest.isEmpty():
            labels = written(components(links.unionByName(rest)), "neardup")
        labelled = sets.select("set", "rep").join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
        least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
        parts = written(labelled.join(least, "label").select("set", "component_id"), "neardup")
        columns = ["doc_id", "n_shingles", "set", *(["digest"] if self.extra else [])]
        done = linked.select(*columns).join(parts, "set")
        alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select(*columns, F.col("doc_id").alias("component_id"))
        return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def clustered(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, trees: int = 10, depth: int = 3, node_rows: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; n words a shingle, linked at `percent` of Jaccard similarity.

    At the defaults a pair of exactly 80 percent meets in a tree with probability 0.64, and in none of ten trees with 3e-5;
    a pair all of whose common nodes are large goes on in two subtrees of each, and meets in a tree with 0.59 at depth 6, 0.47
    at 12 and 0.33 at 24 (none of ten trees: 1e-4, 2e-3, 2e-2; at 85 percent 6e-6, 5e-5, 3e-4), by simulation of the branching.
    """
    return Join(docs, key, text, n, percent, trees, depth, node_rows).run().select("doc_id", "n_shingles", "component_id", "kept")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, trees: int = 10, depth: int = 3, node_rows: int = 512) -> DataFrame:
    """docs with one document of each group; the columns as they were. A row goes by its key and its text, so that others of its key stay."""
    gone, mark = fresh(docs.columns, "gone", "mark")
    found = Join(docs, key, text, n, percent, trees, depth, node_rows, digested=True).run()
    dropped = found.where("NOT kept").select(F.col("doc_id").alias(gone), F.col("digest").alias(mark)).distinct()
    return docs.join(dropped, (col(key).cast("bigint") == F.col(gone)) & (F.sha2(col(text).cast("string").cast("binary"), 256) == F.col(mark)), "left_anti")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "documents"), n=2)


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
often AS (SELECT x, count(*) AS f FROM e GROUP BY x),
ranked AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS r FROM e JOIN often USING (x)),
prefix AS (SELECT doc_id, x, n FROM ranked JOIN n USING (doc_id) WHERE r <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
candidates AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
common AS (SELECT a, b, na, nb, len(list_intersect(sa.s, sb.s)) AS i FROM candidates JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b),
links AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(c, n.doc_id) AS component_id, coalesce(c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN least USING (doc_id)
"""
