"""Queries over files that they write from the test tables and read again; the SQL gives the rows from the tables."""

from __future__ import annotations

import io
import json
import struct
import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import exports as E
from ..scratch import shared_dir
from ..sources import files as S
from .registry import query
from .text_queries import table


def place(spark, name: str) -> str:
    """A new folder in the shared place."""
    return f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


@query("csv_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, NULL AS missing FROM documents")
def csv_round_trip(spark, sf_dir):
    """Whole texts, line ends and quotes included, with a byte order mark and a column that the file lacks."""
    path = place(spark, "csv")
    S.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, mark=True)
    return S.csv(spark, path, ["doc_id", "text", "lang", "missing"])


@query("json_lines_kept", "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS text, turn % 4 = 3 AS broken FROM conversations")
def json_lines_kept(spark, sf_dir):
    """Lines that do not parse are kept apart; here they still tell which they were."""
    path = place(spark, "lines")
    rows = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    rows.select(F.when(F.col("turn") % 4 == 3, F.format_string('{"conv_id": %d, "turn": %d, "text": broken', "conv_id", "turn")).otherwise(line).alias("value")).write.text(path)
    found = S.json_lines(spark, path, schema("conv_id bigint, turn bigint, text string"), "keep")
    told = lambda c: F.coalesce(F.when(F.col(S.BROKEN).isNull(), F.col(c)), F.regexp_extract(S.BROKEN, f'"{c}": ([0-9]+)', 1).try_cast("bigint"))
    return found.select(told("conv_id").alias("conv_id"), told("turn").alias("turn"), F.when(F.col(S.BROKEN).isNull(), F.col("text")).alias("text"), F.col(S.BROKEN).isNotNull().alias("broken"))


@query("json_lines_sound", "SELECT conv_id, turn, text FROM conversations WHERE turn % 4 <> 3")
def json_lines_sound(spark, sf_dir):
    """Lines that do not parse are left out."""
    path = place(spark, "lines")
    rows = table(spark, sf_dir, "conversations")
    rows.select(F.when(F.col("turn") % 4 == 3, "{broken").otherwise(F.to_json(F.struct("conv_id", "turn", "text"))).alias("value")).write.text(path)
    return S.json_lines(spark, path, schema("conv_id bigint, turn bigint, text string"), "drop")


@query("json_lines_written", "SELECT doc_id, lang, text FROM documents")
def json_lines_written(spark, sf_dir):
    path = place(spark, "lines")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    if S.write_json_lines(rows.withColumn("part", F.col("lang")), path, ["part"]) != rows.count():
        raise ValueError("rows were lost")
    return S.fail_fast(spark, path, schema("doc_id bigint, lang string, text string")).drop("part")


@query("faulty_lines", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS line FROM nation WHERE n_nationkey % 4 = 2 OR n_nationkey % 5 = 3")
def faulty_lines(spark, sf_dir):
    """The numbers of the lines that do not parse or are no objects, in one file."""
    path = place(spark, "lines")
    line = F.when(F.col("n_nationkey") % 4 == 2, "[1, 2]").when(F.col("n_nationkey") % 5 == 3, '{"id": ').otherwise(F.to_json(F.struct(F.col("n_name").alias("id"))))
    table(spark, sf_dir, "nation").orderBy("n_nationkey").select(line.alias("value")).coalesce(1).write.text(path)
    return S.broken_lines(spark, path, schema("id string")).select("line")


@query("known_ids", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 5 <> 4")
def known_ids(spark, sf_dir):
    path = place(spark, "lines")
    line = F.when(F.col("o_orderkey") % 5 == 4, "{oops").otherwise(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("id"), "o_orderpriority")))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return S.known_ids(spark, path)[0]


@query("strict_objects", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 2")
def strict_objects(spark, sf_dir):
    """Lines that are JSON, but no objects, are skipped."""
    path = place(spark, "lines")
    line = F.when(F.col("o_orderkey") % 3 == 2, F.format_string("[%d]", "o_orderkey")).otherwise(F.to_json(F.struct("o_orderkey", "o_custkey")))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    found = S.strict_objects(spark, path)
    return found.select(*[F.variant_get("value", f"$.{c}", "bigint").alias(c) for c in ("o_orderkey", "o_custkey")])


@query("labelled_texts", "WITH t AS (SELECT c_custkey, c_name || ' of ' || c_mktsegment AS text FROM customer) SELECT text, 'q' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'joy' WHEN 1 THEN 'joy,anger' ELSE 'fear' END AS labels FROM t WHERE c_custkey % 7 <> 0 AND length(text) BETWEEN 8 AND 360")
def labelled_texts(spark, sf_dir):
    path = place(spark, "tsv")
    text, n = F.concat("c_name", F.lit(" of "), "c_mktsegment"), F.col("c_custkey").cast("string")
    labels = F.when(F.col("c_custkey") % 3 == 0, "0").when(F.col("c_custkey") % 3 == 1, "0,2").otherwise("1")
    line = F.when(F.col("c_custkey") % 14 == 0, F.lit("short\t0\tq")).when(F.col("c_custkey") % 7 == 0, text).otherwise(F.concat_ws("\t", text, labels, F.concat(F.lit("q"), n)))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return S.labelled_texts(spark, path, ["joy", "fear", "anger"]).withColumn("labels", F.array_join("labels", ","))


@query("nested_sentences", "SELECT r_name AS dataset, n_name AS text, 'c' || n_nationkey % 3 AS category, 's' AS \"group\" FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_sentences(spark, sf_dir):
    path = place(spark, "nested")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()  # 25
    value: dict = {}
    for r in rows:
        value.setdefault(r["r_name"], {"sentences": []})["sentences"].append({"prompt": r["n_name"], "category": f"c{r['n_nationkey'] % 3}", "set": "s"})
    S.put_bytes(spark, f"{path}/all.json", json.dumps({"datasets": value}).encode())
    return S.nested_sentences(spark, path)


@query("anchor_list", "SELECT 'about ' || n_name AS prompt, lower(n_name) AS response FROM nation WHERE n_nationkey < 20")
def anchor_list(spark, sf_dir):
    """The first twenty of a list whose responses differ; some come twice, some as messages."""
    items = []
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25
        prompt, response = f"about {r['n_name']}", r["n_name"].lower()
        items.append({"prompt": prompt, "response": response} if r["n_nationkey"] % 2 else {"messages": [{"role": "user", "content": prompt}, {"role": "assistant", "content": response}]})
        items.append({"prompt": "again", "response": response})
    path = place(spark, "anchors")
    S.put_bytes(spark, f"{path}/anchors.json", json.dumps(items).encode())
    return S.anchors(spark, path, X.token_key, 20).select("prompt", "response")


@query("adapter_inventory", "SELECT n_name AS name, CAST(CASE WHEN n_nationkey % 6 = 5 THEN 'not JSON' WHEN n_nationkey % 6 = 4 THEN 'missing base' WHEN n_nationkey % 6 = 3 THEN 'skipped directory' WHEN n_nationkey % 6 = 2 THEN 'too deep' WHEN n_nationkey = 0 THEN 'not allowed' END AS VARCHAR) AS reason FROM nation")
def adapter_inventory(spark, sf_dir):
    """Manifests in folders of their own: sound, too deep, in a backup, without a base, and no JSON."""
    path, names = place(spark, "adapters"), []
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25
        k, body = r["n_nationkey"] % 6, {"name": r["n_name"], "base": "b"}
        names.append(r["n_name"])
        folder = r["n_name"]
        where = f"{path}/a/b/c/{folder}" if k == 2 else f"{path}/Backup/{folder}" if k == 3 else f"{path}/{folder}"
        S.put_bytes(spark, f"{where}/adapter.json", b"no" if k == 5 else json.dumps({"name": r["n_name"]} if k == 4 else body).encode())
    good, bad = S.inventory(spark, path, "adapter.json", "name string, base string", ["name", "base"], depth=2, skipped=S.SKIPPED, allowed=names[1:])
    own = F.element_at(F.split("path", "/"), -2)
    return good.select("name", F.lit(None).cast("string").alias("reason")).unionByName(bad.select(own.alias("name"), "reason"))


@query("archive_members", "SELECT n_name || '.txt' AS name, 'of ' || n_regionkey AS content, CASE WHEN n_nationkey % 9 = 8 THEN 'off_root' END AS fault FROM nation")
def archive_members(spark, sf_dir):
    """A zip or a tar for each region, some members off its root."""
    import tarfile
    import zipfile

    path, by = place(spark, "archives"), {}
    for r in table(spark, sf_dir, "nation").collect():  # 25
        by.setdefault(r["n_regionkey"], []).append((("../" if r["n_nationkey"] % 9 == 8 else "") + f"{r['n_name']}.txt", f"of {r['n_regionkey']}".encode()))
    for region, found in by.items():
        out = io.BytesIO()
        if region % 2:
            with zipfile.ZipFile(out, "w") as z:
                for name, body in found:
                    z.writestr(name, body)
        else:
            with tarfile.open(fileobj=out, mode="w") as t:
                for name, body in found:
                    info = tarfile.TarInfo(name)
                    info.size = len(body)
                    t.addfile(info, io.BytesIO(body))
        S.put_bytes(spark, f"{path}/{region}.{'zip' if region % 2 else 'tar'}", out.getvalue())
    return S.members(spark, path, r"\.txt$").select(F.regexp_replace("name", r"^\.\./", "").alias("name"), F.col("content").cast("string").alias("content"), "fault")


@query("tensor_headers", "SELECT 't' || n_nationkey AS tensor, CAST(n_regionkey + 1 AS BIGINT) AS columns, CASE WHEN n_regionkey % 2 = 0 THEN 'safetensors' ELSE 'gguf' END AS format, CAST(CASE WHEN n_regionkey % 2 = 0 THEN 4 * (n_regionkey + 1) ELSE 32 END AS BIGINT) AS size FROM nation")
def tensor_headers(spark, sf_dir):
    """A model file for each region, with a tensor for each of its nations."""
    path, by = place(spark, "tensors"), {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25
        by.setdefault(r["n_regionkey"], []).append(f"t{r['n_nationkey']}")
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    for region, names in by.items():
        n = 4 * (region + 1)
        if region % 2 == 0:
            head = json.dumps({t: {"dtype": "F32", "shape": [1, region + 1], "data_offsets": [i * n, i * n + n]} for i, t in enumerate(names)}).encode()
            S.put_bytes(spark, f"{path}/{region}.safetensors", struct.pack("<Q", len(head)) + head + b"\0" * (n * len(names)))
        else:
            head = b"GGUF" + struct.pack("<IQQ", 3, len(names), 1) + text("general.architecture") + struct.pack("<I", 8) + text("x")
            head += b"".join(text(t) + struct.pack("<IQQIQ", 2, 1, region + 1, 0, 32 * i) for i, t in enumerate(names))
            S.put_bytes(spark, f"{path}/{region}.gguf", head + b"\0" * (-len(head) % 32) + b"\0" * (32 * len(names)))
    return S.tensor_headers(spark, path).select("tensor", F.col("shape")[1].alias("columns"), "format", "size")


@query("recorded_arrays", "SELECT 'label' || label AS name, count(*) AS layers, CAST(min(vec_id) AS BIGINT) AS least FROM embeddings GROUP BY label")
def recorded_arrays(spark, sf_dir):
    """An array file whose digest was recorded: a matrix for each label, whose rows are layers."""
    import hashlib

    by: dict = {}
    for r in table(spark, sf_dir, "embeddings").select("label", "vec_id").orderBy("vec_id").collect():  # the file's two columns
        by.setdefault(f"label{r['label']}", []).append([float(r["vec_id"]), 1.0])
    out = io.BytesIO()
    np.savez(out, **{k: np.array(v) for k, v in by.items()})
    path = place(spark, "arrays")
    S.put_bytes(spark, f"{path}/a.npz", out.getvalue())
    rows = S.arrays(spark, path, {"a.npz": hashlib.sha256(out.getvalue()).hexdigest()})
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("layers"), F.min(F.col("vec")[0]).cast("bigint").alias("least"))


@query("united_columns", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment FROM customer")
def united_columns(spark, sf_dir):
    """Rows of different fields as one CSV whose header is the union of them."""
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    cells = F.array(pair("id", F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 2 == 0, pair("name", F.col("c_name"))), F.when(F.col("c_custkey") % 3 == 0, pair("segment", F.col("c_mktsegment"))))
    rows = table(spark, sf_dir, "customer").select(F.map_from_entries(F.filter(cells, lambda x: x.isNotNull())).alias("cells"))
    path = place(spark, "csv")
    S.write_csv(S.union_header(rows, "cells", ["id"]), path)
    return S.csv(spark, path)


@query("fan_out_files", "SELECT role AS account, CASE WHEN turn > 0 THEN 'reply' ELSE 'tweet' END AS of_kind, count(*) AS posts FROM conversations GROUP BY ALL")
def fan_out_files(spark, sf_dir):
    path, rows = place(spark, "fan"), table(spark, sf_dir, "conversations")
    posts = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("username"), F.when(F.col("turn") > 0, "reply").otherwise("tweet").alias("kind"), "text")
    E.write_fan_out(posts, path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/by_account").groupBy("account", "of_kind").agg(F.count(F.lit(1)).alias("posts"))


@query("kept_snapshots", "SELECT 'v' || lpad(CAST(i AS VARCHAR), 2, '0') AS version, i AS rows FROM range(3, 11) t(i)")
def kept_snapshots(spark, sf_dir):
    """Eleven snapshots, of which the newest eight stay."""
    path = place(spark, "snapshots")
    for i in range(11):
        left = S.append_snapshot(spark.range(i), path, f"v{i:02d}")
    out = [(name, spark.read.schema("id bigint").parquet(f"{path}/{name}").count()) for name in left]
    return spark.createDataFrame(out, "version string, rows bigint")


@query("run_manifest", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(n_chars) FROM documents) AS characters, 2 AS files, 'x' AS setting")
def run_manifest(spark, sf_dir):
    """A manifest with counts, parameters and the digests of its inputs, replaced once and read back."""
    path = place(spark, "manifest")
    for name in ("a", "b"):
        S.put_bytes(spark, f"{path}/in/{name}", name.encode())
    counts = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"))
    S.put_json(spark, f"{path}/manifest.json", {"old": True})
    S.put_json(spark, f"{path}/manifest.json", json.loads(S.manifest(counts, {"setting": "x"}, S.file_digests(spark, f"{path}/in"))))
    m = spark.read.schema("counts struct<documents:bigint,characters:bigint>, inputs map<string,string>, parameters struct<setting:string>").json(S.located(spark, path, ["none.json", "manifest.json"]))
    return m.select("counts.documents", "counts.characters", F.size("inputs").alias("files"), "parameters.setting")
