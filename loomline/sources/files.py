"""Readers and writers of exports, archives, manifests and model files, through Spark's own file access."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def listed(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, length) of every file below root, empty ones too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found, files = [], path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen()))
    return found


def located(spark: SparkSession, root: str, suffixes: Sequence[str]) -> str:
    """The file below root whose path ends in the first suffix that any has; of several the shortest."""
    found = [path for path, _ in listed(spark, root)]
    for suffix in suffixes:
        fits = sorted((f for f in found if f.endswith(suffix)), key=lambda f: (len(f), f))
        if fits:
            return fits[0]
    raise FileNotFoundError(f"none of {list(suffixes)} below {root}")


def csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header, every column text, cells over several lines allowed; a byte order mark goes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df if columns is None else df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def json_lines(spark: SparkSession, path: str, schema: T.StructType, faults: str = "raise") -> DataFrame:
    """JSON lines by a schema. faults: raise (with the record), keep (in the column _broken) or drop; blank lines are no records."""
    if faults == "keep":
        held = spark.read.schema(T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
        return held.json(path)
    return spark.read.schema(schema).option("mode", {"raise": "FAILFAST", "drop": "DROPMALFORMED"}[faults]).json(path)


def _faulty(schema: T.StructType) -> Column:
    """Whether a line (value) is no blank and no record: an object that does not parse, another value, or bytes that are no text."""
    held = F.from_json("value", T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())]), {"columnNameOfCorruptRecord": BROKEN})
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return (F.trim("value") != "") & (held[BROKEN].isNotNull() | F.coalesce(~kind.startswith("OBJECT"), F.lit(True)) | ~F.is_valid_utf8("value"))


def broken_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(path, line, value) of the lines that are no record of the schema. Lines count from 1, blank ones too."""
    from ..operators.select import placed_within

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.when(_faulty(schema), F.col("value")).alias("value"))
    return placed_within(rows, ["path"], [F.col("_block"), F.col("_row")]).where("value IS NOT NULL").select("path", (F.col("place") + 1).alias("line"), "value")


def fail_fast(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by a schema; the first line that is no record is an error that names the file and the line. Lines are numbered only if one is at fault."""
    if not spark.read.text(path).where(_faulty(schema)).isEmpty():
        first = broken_lines(spark, path, schema).orderBy("path", "line").first()
        raise ValueError(f"{first['path']}, line {first['line']}: {first['value'][:200]}")
    return json_lines(spark, path, schema)


def known_ids(spark: SparkSession, path: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The distinct ids of JSON lines, only that field read, and the lines that could not be read."""
    schema = T.StructType([T.StructField(key, T.StringType())])
    ids = json_lines(spark, path, schema, "keep").select(F.when(F.col(BROKEN).isNull(), F.col(key)).alias(key)).where(F.col(key).isNotNull()).distinct()
    return ids, broken_lines(spark, path, schema)


def strict_objects(spark: SparkSession, path: str) -> DataFrame:
    """(line, value VARIANT) of JSON lines: a line that is no JSON is an error that shows it, one that is no object is skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("parsed", F.try_parse_json("value"))
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 200)))
    rows = rows.withColumn("parsed", F.when(F.col("parsed").isNull(), F.parse_json(bad)).otherwise(F.col("parsed")))
    return rows.where(F.schema_of_variant("parsed").startswith("OBJECT")).select(F.col("value").alias("line"), F.col("parsed").alias("value"))


def labelled_texts(spark: SparkSession, path: str, labels: Sequence[str], least: int = 8, most: int = 360) -> DataFrame:
    """(text, id, labels) of tab-separated text, label numbers and id; lines of other shapes and texts of other lengths go."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") == 3)
    names = F.array(*[F.lit(x) for x in labels])
    rows = parts.select(F.col("p")[0].alias("text"), F.col("p")[2].alias("id"), F.transform(F.split(F.col("p")[1], ","), lambda i: F.element_at(names, i.cast("int") + 1)).alias("labels"))
    return rows.where(F.char_length("text").between(least, most))


def nested_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, text, category, group) of one JSON document {datasets: {name: {sentences: [...]}}}."""
    schema = "datasets map<string,struct<sentences:array<struct<prompt:string,category:string,set:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("datasets").alias("dataset", "d"))
    return rows.select("dataset", F.explode("d.sentences").alias("s")).select("dataset", F.col("s.prompt").alias("text"), F.col("s.category").alias("category"), F.col("s.set").alias("group"))


def anchors(spark: SparkSession, path: str, key, n: int = 96) -> DataFrame:
    """The first n (prompt, response) of a JSON list, distinct by key of the response; items are objects of either two fields or messages."""
    from pyspark.sql import Window

    schema = "prompt string, response string, messages array<struct<role:string,content:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("place", F.monotonically_increasing_id())
    said = lambda role: F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(-1))["content"]
    rows = rows.select("place", F.coalesce("prompt", said("user")).alias("prompt"), F.coalesce("response", said("assistant")).alias("response")).where("prompt IS NOT NULL AND response IS NOT NULL").withColumn("key", key(F.col("response")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where("_n = 1")
    return first.orderBy("place").limit(n).select("prompt", "response", "key")


_SCHEME = r"^[A-Za-z0-9+.-]+:(?://[^/]*)?"


def below(root: str) -> Column:
    """The column `path` from below root on, whatever way the file system writes either; null for other paths."""
    import re

    at = re.sub(_SCHEME, "", root).rstrip("/") + "/"
    bare = F.regexp_replace("path", _SCHEME, "")
    return F.when(bare.startswith(at), F.substring(bare, len(at) + 1, 1 << 20))


#: Parts of a path that no inventory enters.
SKIPPED = ("staging", "backup", "backups", "quarantine")


def inventory(spark: SparkSession, root: str, manifest: str, schema: str, required: Sequence[str], depth: int | None = None, skipped: Sequence[str] = (), allowed: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifests (JSON files of one name) below root, decoded: the accepted, one a name, and the rejected with a reason.

    depth: how many directories below root a manifest may lie; skipped: directories not to enter, whatever their case;
    allowed: the names (first required field) that may be accepted, all if none are given.
    """
    from pyspark.sql import Window

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", manifest).load(root)
    rows = raw.select("path", "modificationTime", F.from_json(F.col("content").cast("string"), schema).alias("m"), F.try_parse_json(F.col("content").cast("string")).isNull().alias("_bad")).select("path", "modificationTime", "m.*", "_bad")
    parts = F.split(below(root), "/")
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required], F.lit(None).cast("string"))
    deep = F.size(parts) - 1 > depth if depth is not None else F.lit(False)
    closed = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.lower(d).isin(*[x.lower() for x in skipped])) if skipped else F.lit(False)
    foreign = ~F.lower(required[0]).isin(*[x.lower() for x in allowed]) if allowed is not None else F.lit(False)
    rows = rows.withColumn("reason", F.when(deep, F.lit("too deep")).when(closed, F.lit("skipped directory")).when(F.col("_bad"), F.lit("not JSON")).when(missing.isNotNull(), missing).when(foreign, F.lit("not allowed"))).drop("_bad")
    good = rows.where("reason IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy(required[0]).orderBy("path"))).where("_n = 1").drop("_n", "reason")
    return good, rows.where("reason IS NOT NULL")


def members(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(archive, name, content, fault) of every member of zip and tar files: duplicate, not_regular or off_root, else null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                found = []
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for x in z.infolist():
                            kind = (x.external_attr >> 16) & 0o170000
                            if not x.is_dir():
                                found.append((x.filename, z.read(x), kind in (0, 0o100000)))
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        for x in t:
                            if not x.isdir():
                                found.append((x.name, t.extractfile(x).read() if x.isreg() else b"", x.isreg()))
                seen: set[str] = set()
                out = []
                for name, body, regular in found:
                    off = name.startswith("/") or ".." in name.split("/") or "\\" in name or ":" in name
                    out.append((archive, name, body, "duplicate" if name in seen else "not_regular" if not regular else "off_root" if off else None))
                    seen.add(name)
                yield pd.DataFrame(out, columns=["archive", "name", "content", "fault"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "archive string, name string, content binary, fault string")
    return rows if pattern is None else rows.where(F.col("name").rlike(pattern))


#: The sizes of GGUF's numbers by kind, and the bounds of a header.
_GGUF = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
_MOST_ENTRIES, _LONGEST_TEXT, _LONGEST_ARRAY, _LARGEST_ALIGNMENT, _LARGEST_HEADER = 1_000_000, 4 << 20, 10_000_000, 1 << 20, 100 << 20


class Ranges:
    """A file read by ranges: `read(start, n)` gives bytes, and no more is fetched than what is asked for, in pieces of `piece` bytes."""

    def __init__(self, size: int, read, piece: int = 1 << 20):
        self.size, self.read, self.piece, self.at, self.held, self.start = size, read, piece, 0, b"", 0

    def skip(self, n: int) -> None:
        if not 0 <= n <= self.size - self.at:
            raise ValueError("the header ends early")
        self.at += n

    def take(self, n: int) -> bytes:
        self.skip(n)
        a = self.at - n - self.start
        if not 0 <= a <= a + n <= len(self.held):
            self.start, a = self.at - n, 0
            self.held = self.read(self.start, min(max(n, self.piece), self.size - self.start))
        return self.held[a : a + n]

    def number(self, kind: str):
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def text(self) -> str:
        n = self.number("<Q")
        if n > _LONGEST_TEXT:
            raise ValueError("a text of the header is too long")
        return self.take(n).decode("utf-8", "replace")

    def value(self, kind: int):
        """A value of the metadata; arrays are passed over."""
        if kind in _GGUF:
            return self.number(_GGUF[kind])
        if kind == 8:
            return self.text()
        if kind != 9:
            raise ValueError(f"unknown kind {kind}")
        inner, n = self.number("<I"), self.number("<Q")
        if n > _LONGEST_ARRAY:
            raise ValueError("an array of the header is too long")
        if inner in _GGUF:
            self.skip(n * struct.calcsize(_GGUF[inner]))
        else:
            for _ in range(n):
                self.skip(self.number("<Q")) if inner == 8 else self.value(inner)
        return None


def gguf_header(r: Ranges) -> tuple[dict, list[tuple[str, list[int], int, int]]]:
    """Metadata and (name, shape, start, size) of the tensors of a GGUF file, from its header; the extents must lie in the file."""
    if r.take(4) != b"GGUF":
        raise ValueError("no GGUF file")
    if (version := r.number("<I")) not in (2, 3):
        raise ValueError(f"unknown GGUF version {version}")
    tensors, pairs = r.number("<Q"), r.number("<Q")
    if max(tensors, pairs) > _MOST_ENTRIES:
        raise ValueError("too many entries")
    meta = {}
    for _ in range(pairs):
        name = r.text()
        meta[name] = r.value(r.number("<I"))
    found = []
    for _ in range(tensors):
        name, rank = r.text(), r.number("<I")
        if not 1 <= rank <= 8:
            raise ValueError(f"{name} has rank {rank}")
        shape = [r.number("<Q") for _ in range(rank)]
        r.number("<I")
        found.append((r.number("<Q"), name, shape))
    unit = meta.get("general.alignment", 32)
    if not isinstance(unit, int) or not 0 < unit <= _LARGEST_ALIGNMENT:
        raise ValueError("the alignment is out of bounds")
    base = -(-r.at // unit) * unit
    found.sort(key=lambda x: (x[0], x[1]))
    ends = [start for start, _, _ in found[1:]] + [r.size - base]
    for (start, name, _), end in zip(found, ends):
        if not start <= end <= r.size - base:
            raise ValueError(f"{name} does not lie in the file")
    return meta, [(name, shape, start, end - start) for (start, name, shape), end in zip(found, ends)]


def safetensors_header(r: Ranges) -> list[tuple[str, list[int], int, int]]:
    """(name, shape, start, size) of a safetensors file, from its header; the extents must tile the payload."""
    length = r.number("<Q")
    if length > _LARGEST_HEADER:
        raise ValueError("the header is too long")
    head = json.loads(r.take(length))
    rows, at = sorted((v["data_offsets"][0], v["data_offsets"][1], k, v["shape"]) for k, v in head.items() if k != "__metadata__"), 0
    for start, end, name, _ in rows:
        if start != at or end < start:
            raise ValueError(f"{name} does not start where the one before ends")
        at = end
    if r.at + at != r.size:
        raise ValueError("the payload is not covered")
    return [(name, shape, start, end - start) for start, end, name, shape in rows]


def tensor_headers(spark: SparkSession, path: str, threads: int = 8) -> DataFrame:
    """(path, format, tensor, shape, start, size, fault) of the GGUF and safetensors files below path.

    Only headers are read, by ranges, through the file system of the session. Model files are few, so the driver reads their headers (a few MB each), some at a time.
    """
    from concurrent.futures import ThreadPoolExecutor

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def one(name: str, size: int) -> list[tuple]:
        at = jvm.org.apache.hadoop.fs.Path(name)
        stream = at.getFileSystem(conf).open(at)

        def read(start: int, n: int) -> bytes:
            stream.seek(start)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""

        kind = None
        try:
            r = Ranges(size, read)
            kind = "gguf" if r.take(min(4, size)) == b"GGUF" else "safetensors"
            r.at = 0
            rows = gguf_header(r)[1] if kind == "gguf" else safetensors_header(r)
            return [(name, kind, tensor, list(shape), start, n, None) for tensor, shape, start, n in rows]
        except (ValueError, KeyError, TypeError, struct.error) as e:
            return [(name, kind, None, None, None, None, str(e))]
        finally:
            stream.close()

    with ThreadPoolExecutor(threads) as pool:
        rows = [row for part in pool.map(lambda f: one(*f), listed(spark, path)) for row in part]
    return spark.createDataFrame(rows, "path string, format string, tensor string, shape array<bigint>, start bigint, size bigint, fault string")


def arrays(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """(path, name, layer, vec) of the two-dimensional arrays of NPZ files whose SHA-256 is the one recorded for the file name; others are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import numpy as np

        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                if hashlib.sha256(content).hexdigest() != digests.get(p.rsplit("/", 1)[-1]):
                    raise ValueError(f"{p} is not the file that was recorded")
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    out += [(p, name, i, row.astype(float).tolist()) for name in z.files for i, row in enumerate(np.atleast_2d(z[name]))]
            yield pd.DataFrame(out, columns=["path", "name", "layer", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, layer bigint, vec array<double>")


def write_json_lines(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Compact JSON lines, null fields left out; gives the number of rows, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str, order: Sequence[Column] = (), partition_by: Sequence[str] = (), mark: bool = False) -> None:
    """A CSV with a header; nested cells are JSON text. mark: each file starts with a byte order mark, as spreadsheets expect."""
    flat = df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields])
    if mark:
        flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    writer = (flat.orderBy(*order) if order else flat).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def union_header(rows: DataFrame, cells: str, first: Sequence[str] = ()) -> DataFrame:
    """A column for every key that any of the maps in `cells` has: those of `first`, then the others by name."""
    keys = [r["k"] for r in rows.select(F.explode(F.map_keys(cells)).alias("k")).distinct().orderBy("k").collect()]  # a header
    names = [*first, *(k for k in keys if k not in first)]
    return rows.select(*[F.try_element_at(F.col(cells), F.lit(k)).alias(k) for k in names])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(counts: DataFrame, parameters: dict, files: DataFrame | None = None) -> str:
    """A manifest of a run as JSON, from a one-row frame of counts and the digests of its input files."""
    inputs = {} if files is None else {"inputs": {r["path"]: r["sha256"] for r in files.orderBy("path").collect()}}  # an entry an input file
    return json.dumps({"parameters": parameters, "counts": counts.first().asDict(recursive=True)} | inputs, ensure_ascii=False, sort_keys=True, default=str)


def put_json(spark: SparkSession, path: str, value) -> None:
    """Writes one JSON file so that a reader sees the old one or the new one: to a name beside it, then renamed over it in one step.

    Local files are replaced by the operating system; others by their file system, which HDFS does in one step too.
    """
    import os
    import uuid

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    data = json.dumps(value, ensure_ascii=False, sort_keys=True).encode()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    name = f"{target.getName()}.{uuid.uuid4().hex}.new"
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), name)
    if target.toUri().getScheme() == "file":
        with open(beside.toUri().getPath(), "wb") as f:
            f.write(data)
        os.replace(beside.toUri().getPath(), target.toUri().getPath())
        return
    out = fs.create(beside, True)
    out.write(bytearray(data))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, over)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one small file through its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def append_snapshot(df: DataFrame, root: str, version: str, keep: int = 8) -> list[str]:
    """Writes df as the snapshot `version` below root and removes all but the newest `keep`, by modification time, then name; gives the names left."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{version}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(((s.getModificationTime(), s.getPath().getName(), s.getPath()) for s in fs.listStatus(at) if s.isDirectory()), key=lambda x: x[:2], reverse=True)
    for _, _, old in found[keep:]:
        fs.delete(old, True)
    return [name for _, name, _ in found[:keep]]
