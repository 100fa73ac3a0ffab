"""Every registered query of this library against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from loomline.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF_DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return c


def cell(v):
    if v is None or v != v:
        return None
    return repr(float(v)) if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def bag(columns: list[str], rows) -> tuple:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_are_those_of_the_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    found = duck.execute(registry.ORACLES[name])
    assert bag(df.columns, df.collect()) == bag([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def test_length_matched_takes_long_documents(spark, tmp_path):
    docs = [(2, "a" * 100, 100), (4, "b" * 2900, 2900), (6, None, None), (1, "c" * 1900, 1900), (3, "d" * 2100, 2100)]
    spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "x" * 3000), (1, "y" * 2050), (2, "z")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["length_matched"](spark, str(tmp_path)).collect()
    assert sorted((r["place"], r["match_id"]) for r in got) == [(0, 4), (1, 3), (2, 6)]


def test_length_matching_holds_no_texts_and_only_the_first_of_each_pool(spark):
    from loomline.operators import joins as J

    targets = spark.createDataFrame([("p", n, t) for n, t in enumerate(["x" * 9, "yy", " SAME ", "z" * 5, "w", "v"])] + [("q", 0, None)], "profile string, place bigint, text string")
    pool = [("p", "neutral", n, 10 + n, t) for n, t in enumerate(["same", "m" * 7, "n" * 11, "o" * 9])] + [("p", "other", n, 20 + n, t) for n, t in enumerate(["", "abcd", "ab", "abcde", "ef"])]
    df = J.length_matched(targets, spark.createDataFrame(pool + [("q", "neutral", 0, 30, None), ("q", "neutral", 1, 31, "k")], "profile string, kind string, place bigint, id bigint, text string"), most=3)
    assert sorted(map(tuple, df.collect())) == [("p", 0, 11), ("p", 1, 22), ("p", 2, 12), ("p", 3, 21), ("p", 4, 10), ("p", 5, 20), ("q", 0, 31)]
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    held = [x for x in plan if "FlatMapCoGroups" in x]
    assert held and not any("text" in x for x in held)


def test_length_matched_takes_candidates_beyond_the_first_two_thousand(spark, tmp_path):
    spark.range(5000).selectExpr("id AS doc_id", "repeat('a', CAST(10 + id % 7 AS INT)) AS text").unionByName(
        spark.createDataFrame([(9000, "b" * 90), (9001, "c" * 80), (9003, "d" * 81)], "doc_id bigint, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "x" * 100), (1, "y" * 80), (2, "a" * 10), (3, "z" * 80)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["length_matched"](spark, str(tmp_path)).collect()
    assert sorted((r["place"], r["match_id"]) for r in got) == [(0, 9000), (1, 9001), (2, 8), (3, 9003)]


def nearest_unused(targets, pool):
    """length_matched in plain Python: the reference's loop over whole pools. Targets of one place go by length, then digest."""
    from hashlib import sha256

    last, out = lambda v: (v is None, v or 0), []
    turn = lambda t: (last(t[1]), len(t[2] or ""), sha256((t[2] or "").strip().lower().encode()).hexdigest())
    for p in {t[0] for t in targets}:
        taken = set()
        for i, (_, place, text) in enumerate(sorted((t for t in targets if t[0] == p), key=turn)):
            mine = [r for r in pool if r[0] == p and r[1] == ("neutral", "other")[i % 2] and r[3] not in taken and (r[4] or "").strip().lower() != (text or "").strip().lower()]
            if mine:
                best = min(mine, key=lambda r: (abs(len(r[4] or "") - len(text or "")), last(r[2]), last(r[3])))[3]
                taken.add(best)
                out.append((p, place, best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_length_matching_is_that_of_the_loop_over_whole_pools(spark, seed):
    """Repeated, shared and null ids, copies of targets with other spaces, crowded and empty lengths, targets without rows."""
    import random

    from loomline.operators import joins as J

    x = random.Random(seed)
    words = [c * n for c in "aB" for n in (0, 1, 3, 9)] + [" a ", "b  ", "\u0130", "cd" * 40]
    text = lambda: x.choice([None, *words]) if x.random() < 0.4 else x.choice("mn") * int(x.paretovariate(0.7))
    targets = [(p, n if n % 9 else None, text() if seed % 2 else x.choice(words[:3])) for p, many in (("p", 60), ("q", 7), (None, 5), ("r", 2)) for n in range(many)]
    targets = [t for k, t in enumerate(targets) if t[1] is not None or k % 9 == 0]
    big = 1 << 60
    pool = [(p, x.choice(["neutral", "other", "else", None]), x.choice([None, x.randrange(300)]), x.choice([None, big + x.randrange(ids)]), text()) for p, many, ids in (("p", 1500, 900), ("q", 40, 5), (None, 30, 30), ("s", 9, 9)) for _ in range(many)]
    df = J.length_matched(spark.createDataFrame(targets, "profile string, place bigint, text string"), spark.createDataFrame(pool, "profile string, kind string, place bigint, id bigint, text string"))
    assert sorted(map(tuple, df.collect()), key=repr) == nearest_unused(targets, pool)


def test_length_matching_hands_over_only_rows_that_may_be_chosen(spark):
    from loomline.operators import joins as J

    targets = spark.range(20).selectExpr("'p' AS profile", "id AS place", "repeat('x', CAST(50 * id AS INT)) AS text")
    pool = spark.range(30000).selectExpr("'p' AS profile", "IF(id % 2 = 0, 'neutral', 'other') AS kind", "id AS place", "id", "repeat('a', CAST(IF(id % 3 = 0, 700, id % 1000) AS INT)) AS text")
    plan = J.length_matched(targets, pool)._jdf.queryExecution().optimizedPlan()
    while "FlatMapCoGroups" not in plan.nodeName():
        plan = plan.children().head()
    offered = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().last()).count()
    assert 20 <= offered <= 5 * 20 * 20


def test_html_text_of_cut_and_odd_references(spark, tmp_path):
    import duckdb

    pages = ["a &amp", "b &quot", "c &am", "d &lt;b&gt;&copy;&nbsp;&middot;", "&amp;lt; &amp;amp; &amp", "x?a=1&copy=2&lt=3", "see https://a.example/?q=1&copy=2&amp;b=&quot;3 now", "&#39;&#39 &#38; &eacute; &Amp; & &; &&amp;", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df, found = registry.QUERIES["html_text"](spark, str(tmp_path)), c.execute(registry.ORACLES["html_text"])
    assert bag(df.columns, df.collect()) == bag([d[0] for d in found.description], found.fetchall())


@pytest.fixture
def scattered(spark, tmp_path):
    """Events of few users in seven files, later ones in earlier files, none in order; Arrow batches are short, so that users have many."""
    import duckdb

    os.mkdir(tmp_path / "events.parquet")
    for i in range(7):
        rows = f"SELECT * REPLACE (user_id % 9 AS user_id, CASE WHEN event_type = 'error' AND user_id % 7 < 5 THEN 'view' ELSE event_type END AS event_type) FROM '{SF_DIR}/events.parquet' WHERE event_id % 7 = {6 - i}"
        duckdb.connect().execute(f"COPY ({rows} ORDER BY hash(event_id)) TO '{tmp_path}/events.parquet/part-{i}.parquet' (FORMAT parquet)")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield str(tmp_path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


@pytest.mark.parametrize("name", ["run_events", "repetition_guard"])
def test_keyed_streams_keep_the_order_of_scattered_files(spark, scattered, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{scattered}/events.parquet/*.parquet'")
    df, found = registry.QUERIES[name](spark, scattered), c.execute(registry.ORACLES[name])
    assert bag(df.columns, df.collect()) == bag([d[0] for d in found.description], found.fetchall())


def test_rows_of_an_appending_stream_are_not_kept_in_the_driver(spark):
    plan = registry.QUERIES["repetition_guard"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Memory" not in plan


def test_a_guard_goes_on_over_micro_batches(spark, tmp_path):
    """Two runs of a query by one checkpoint; a token may be null, as may a key."""
    from loomline.streaming import stateful as R

    tokens = ["ab"[n // 3 % 2] if n > 20 else None if n % 8 == 3 else "abcdefgh"[n % 8] for n in range(50)] + list("abcdefgh") * 4
    for part, (a, b) in enumerate([(0, 27), (27, 60), (60, len(tokens))]):
        rows = [(k, n, tokens[n]) for k in (1, None) for n in reversed(range(a, b))]
        spark.createDataFrame(rows, "k bigint, n bigint, t string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        df = R.drained(spark, lambda s: R.guarded(s, "k", "n", "t"), f"{tmp_path}/in", "k bigint, n bigint, t string", f"guard{part}", f"{tmp_path}/at", files=None)
    want = [(k, n, n + 1, n >= 23 and tokens[n - 23 : n - 15] == tokens[n - 15 : n - 7] == tokens[n - 7 : n + 1]) for k in (1, None) for n in range(len(tokens))]
    assert any(w[3] for w in want) and sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_the_entry_works_without_the_subpackage(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "loomline", tmp_path / "loomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sft_examples' in q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
