"""The queries of the subpackage against their SQL, or against plain Python where SQL has no words for them."""

from __future__ import annotations

import os
import zlib

import pytest

from loomline.llm import entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF_DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_rows_are_those_of_the_sql(spark, duck, name):
    df = entry.QUERIES[name](spark, SF_DIR)
    found = duck.execute(entry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_language_id_on_held_out_documents(spark, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = entry.QUERIES["op9_language_id"](spark, SF_DIR).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_sharding_places_every_document_once(spark, duck):
    rows = entry.QUERIES["op6_sharding"](spark, SF_DIR).collect()
    size = dict(duck.execute("SELECT doc_id, strlen(coalesce(text, '')) + 1 FROM documents").fetchall())
    assert {r["doc_id"]: r["size"] for r in rows} == size and len(rows) == len(size)
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in by.values())
    sums = [sum(n for _, n in x) for x in by.values()]
    assert max(sums) - min(sums) <= 2 * max(size.values())


def test_personal_data_keeps_base_spans(spark, duck):
    from loomline.llm import pii

    text = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in entry.QUERIES["op5_personal_data"](spark, SF_DIR).collect():
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(text[r["doc_id"]])]
        assert set(base) <= set(r["spans"].split(",")) | {""} and r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(base)
