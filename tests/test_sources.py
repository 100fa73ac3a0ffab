"""Readers and writers on files made here, and streams against their batch twins."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.sources import files as S
from loomline.streaming import stateful as R

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_json_lines_by_policy(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": broken\n{"id": "c"}\n')
    path = str(tmp_path / "a.jsonl")
    assert sorted(r["id"] for r in S.json_lines(spark, path, SCHEMA, "drop").collect()) == ["a", "c"]
    assert S.json_lines(spark, path, SCHEMA, "keep").cache().where(f"{S.BROKEN} IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        S.json_lines(spark, path, SCHEMA).collect()


def test_strict_objects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n[2]\n\n')
    assert [r["line"] for r in S.strict_objects(spark, str(tmp_path / "a.jsonl")).collect()] == ['{"id": 1}']


def test_csv_with_mark_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"two\nlines, ""quoted"""\n', encoding="utf-8")
    (r,) = S.csv(spark, str(tmp_path / "a.csv"), ["id", "text", "more"]).collect()
    assert (r["id"], r["text"], r["more"]) == ("1", 'two\nlines, "quoted"', None)
    assert S.located(spark, str(tmp_path), ["none.csv", "a.csv"]).endswith("a.csv")


def test_documents_and_labels(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"datasets": {"x": {"sentences": [{"prompt": "p", "category": "c", "set": "1"}]}}}))
    assert [tuple(r) for r in S.nested_sentences(spark, str(tmp_path / "d.json")).collect()] == [("x", "p", "c", "1")]
    (tmp_path / "l.tsv").write_text("long enough text\t0,2\tq1\nshort\t0\tq2\nno columns here\n")
    assert [tuple(r) for r in S.labelled_texts(spark, str(tmp_path / "l.tsv"), ["joy", "fear", "anger"]).collect()] == [("long enough text", "q1", ["joy", "anger"])]


def test_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.txt", "x")
        z.writestr("../bad.txt", "x")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        x = tarfile.TarInfo("link")
        x.type, x.linkname = tarfile.SYMTYPE, "/etc"
        t.addfile(x)
        for _ in range(2):
            y = tarfile.TarInfo("twice")
            y.size = 1
            t.addfile(y, io.BytesIO(b"z"))
    got = sorted(((r["name"], r["fault"]) for r in S.members(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("../bad.txt", "off_root"), ("link", "not_regular"), ("ok.txt", None), ("twice", None), ("twice", "duplicate")], key=repr)


def test_tensor_headers(spark, tmp_path):
    head = json.dumps({"a": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}, "b": {"dtype": "F32", "shape": [1], "data_offsets": [4, 8]}}).encode()
    (tmp_path / "x.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 8)
    (tmp_path / "y.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 9)
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    
    def gguf(version=3, offsets=(0, 64), payload=100, pairs=None) -> bytes:
        pairs = pairs if pairs is not None else [text("k") + struct.pack("<I", 8) + text("v"), text("list") + struct.pack("<IIQ", 9, 8, 2) + text("a") + text("b"), text("n") + struct.pack("<IIQ", 9, 4, 3) + b"\0" * 12]
        head = b"GGUF" + struct.pack("<IQQ", version, len(offsets), len(pairs)) + b"".join(pairs) + b"".join(text(f"t{i}") + struct.pack("<IQQIQ", 2, 4, 5, 0, o) for i, o in enumerate(offsets))
        return head + b"\0" * (-len(head) % 32) + b"\1" * payload

    (tmp_path / "z.gguf").write_bytes(gguf())
    (tmp_path / "v.gguf").write_bytes(gguf(version=1))
    (tmp_path / "o.gguf").write_bytes(gguf(offsets=(0, 101)))
    (tmp_path / "c.gguf").write_bytes(gguf()[:40])
    (tmp_path / "e.gguf").write_bytes(b"")
    got = {(r["path"].rsplit("/", 1)[-1], r["tensor"], r["start"], r["size"], r["fault"] is not None) for r in S.tensor_headers(spark, str(tmp_path)).collect()}
    assert got == {("x.safetensors", "a", 0, 4, False), ("x.safetensors", "b", 4, 4, False), ("y.safetensors", None, None, None, True), ("z.gguf", "t0", 0, 64, False), ("z.gguf", "t1", 64, 36, False)} | {(f"{n}.gguf", None, None, None, True) for n in "voce"}


def test_headers_are_read_by_ranges():
    head = json.dumps({"a": {"dtype": "F32", "shape": [1 << 30], "data_offsets": [0, 4 << 30]}}).encode()
    data, asked = struct.pack("<Q", len(head)) + head, []
    r = S.Ranges(len(data) + (4 << 30), lambda start, n: asked.append((start, n)) or data[start : start + n], piece=16)
    assert S.safetensors_header(r) == [("a", [1 << 30], 0, 4 << 30)] and sum(n for _, n in asked) < len(data) + 32


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "x"), (2, [], "y")], "i int, l array<string>, k string")
    assert S.write_json_lines(df, str(tmp_path / "j"), ["k"]) == 2 and spark.read.json(str(tmp_path / "j")).count() == 2
    S.write_csv(df, str(tmp_path / "c"), [F.col("i")])
    assert [r["l"] for r in S.csv(spark, str(tmp_path / "c")).orderBy("i").collect()] == ['["a"]', "[]"]
    S.put_json(spark, str(tmp_path / "m.json"), {"b": 1})
    S.put_json(spark, str(tmp_path / "m.json"), {"b": 2})
    assert json.loads((tmp_path / "m.json").read_text()) == {"b": 2}


def test_faulty_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"id": "a", "n": 1}\n\n{"id": "b", "n": broken\n[3]\n{"id": "c", "n": 2}\n{"id": "\xff"}\n7\n')
    path = str(tmp_path / "a.jsonl")
    assert sorted(r["line"] for r in S.broken_lines(spark, path, SCHEMA).collect()) == [3, 4, 6, 7]
    with pytest.raises(ValueError, match="line 3"):
        S.fail_fast(spark, path, SCHEMA)
    ids, faults = S.known_ids(spark, path)
    assert {"a", "c"} <= {r["id"] for r in ids.collect()} and faults.count() == 4
    (tmp_path / "b.jsonl").write_text('{"id": "x", "n": 1}\n')
    assert S.fail_fast(spark, str(tmp_path / "b.jsonl"), SCHEMA).count() == 1


def test_inventory_rules(spark, tmp_path):
    for at, body in {"a": '{"name": "A", "base": "x"}', "b/c/d": '{"name": "B", "base": "x"}', "Backup/e": '{"name": "C", "base": "x"}', "f": "no", "g": '{"name": "G"}', "h": '{"name": "a", "base": "y"}', "i": '{"name": "I", "base": "y"}'}.items():
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "m.json").write_text(body)
    good, bad = S.inventory(spark, str(tmp_path), "m.json", "name string, base string", ["name", "base"], depth=2, skipped=S.SKIPPED, allowed=["A"])
    assert sorted(r["name"] for r in good.collect()) == ["A", "a"]
    assert {r["path"].split("/")[-2]: r["reason"] for r in bad.collect()} == {"d": "too deep", "e": "skipped directory", "f": "not JSON", "g": "missing base", "i": "not allowed"}


def test_more_sinks(spark, tmp_path):
    rows = spark.createDataFrame([({"id": "1", "b": "x"},), ({"id": "2", "a": "ä"},)], "cells map<string,string>")
    wide = S.union_header(rows, "cells", ["id"])
    assert wide.columns == ["id", "a", "b"]
    S.write_csv(wide, str(tmp_path / "c"), [F.col("id")], mark=True)
    first = sorted(p for p in (tmp_path / "c").iterdir() if p.suffix == ".csv")[0].read_bytes()
    assert first.startswith(b"\xef\xbb\xbfid,a,b") and sorted(map(tuple, S.csv(spark, str(tmp_path / "c")).collect())) == [("1", None, "x"), ("2", "ä", None)]
    for i in range(10):
        left = S.append_snapshot(spark.range(i), str(tmp_path / "s"), f"v{i:02d}", keep=3)
    assert sorted(left) == ["v07", "v08", "v09"] and sorted(p.name for p in (tmp_path / "s").iterdir()) == ["v07", "v08", "v09"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_bytes(b"abc")
    import hashlib

    told = json.loads(S.manifest(spark.range(3).agg(F.count("id").alias("n")), {"p": 1}, S.file_digests(spark, str(tmp_path / "in"))))
    assert told["counts"] == {"n": 3} and list(told["inputs"].values()) == [hashlib.sha256(b"abc").hexdigest()]


def test_replacing_json_never_leaves_a_gap(spark, tmp_path):
    import threading

    path, seen, stop = tmp_path / "m.json", [], threading.Event()
    S.put_json(spark, str(path), {"v": -1})

    def watch():
        while not stop.is_set():
            seen.append(json.loads(path.read_text())["v"])

    t = threading.Thread(target=watch)
    t.start()
    for i in range(40):
        S.put_json(spark, str(path), {"v": i})
    stop.set()
    t.join()
    assert seen and seen == sorted(seen) and not list(tmp_path.glob("*.new"))


def test_streams_are_idempotent(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # read twice from the start
        R.append_stream(stream(), str(tmp_path / "out"), "id", str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    with pytest.raises(ValueError):
        R.only_candidate(df, {"k": 1})
