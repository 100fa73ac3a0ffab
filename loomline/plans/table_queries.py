"""Queries over events, embeddings and the star tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import select as S
from ..operators import vectors as V
from .registry import query
from .text_queries import table


@query("half_open_window", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def half_open_window(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.where(C.in_window(F.col("ts"), "2024-01-05", "2024-01-09")).select("event_id", "ts")


@query("fixed_windows", "SELECT strftime(d, '%Y-%m-%d') AS window_start, strftime(least(d + INTERVAL 7 DAY, DATE '2024-01-31'), '%Y-%m-%d') AS window_end FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 7 DAY) t(d)")
def fixed_windows(spark, sf_dir):
    return S.day_windows(spark, "2024-01-01", "2024-01-31", 7).select(F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query("bisected_windows", """
WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT DATE '2024-01-01' AS a, DATE '2024-01-31' AS b UNION ALL SELECT unnest([a, a + CAST((b - a) // 2 AS INTEGER)]), unnest([a + CAST((b - a) // 2 AS INTEGER), b]) FROM w WHERE b - a > 1 AND (SELECT coalesce(sum(n), 0) FROM d WHERE day >= a AND day < b) > 2000),
c AS (SELECT a, b, CAST((SELECT coalesce(sum(n), 0) FROM d WHERE day >= a AND day < b) AS BIGINT) AS n FROM w)
SELECT strftime(a, '%Y-%m-%d') AS window_start, strftime(b, '%Y-%m-%d') AS window_end, n AS rows FROM c WHERE n <= 2000 OR b - a <= 1""")
def bisected_windows(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    out = S.bisected(spark, days, "2024-01-01", "2024-01-31", 2000)
    return out.select(F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"), "rows")


KINDS = ("view", "click", "purchase")


@query("counts_by_kind", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, min(strftime(ts, '%Y-%m-%d')) AS earliest, max(strftime(ts, '%Y-%m-%d')) AS latest FROM events GROUP BY user_id")
def counts_by_kind(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return A.account_counts(events, "user_id", "event_type", "day", KINDS)


@query("asof_control", """
SELECT e.event_id, c.value AS control_value, c.event_id AS control_event FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_control(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    right = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("control_event"), F.col("value").alias("control_value"))
    return J.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "rts", ["control_event", "control_value"]).select("event_id", "control_value", "control_event")


@query("change_log", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def change_log(spark, sf_dir):
    return A.changes(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "event_type")


@query("phase_summary", "SELECT user_id % 10 AS run, event_type AS phase, count(*) AS tokens, round(avg(value), 6) AS mean_entropy_nats, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY ALL")
def phase_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    axes = F.from_json("props", "map<string,double>")
    trace = events.select((F.col("user_id") % 10).alias("run"), F.col("event_type").alias("phase"), "value", axes.alias("axes"))
    out = A.phase_summary(trace, ["run"], "phase", "value", "axes")
    return out.select("run", "phase", "tokens", F.round("mean_entropy_nats", 6).alias("mean_entropy_nats"), F.round(F.col("axis_means")["k"], 6).alias("mean_k"))


@query("type_entropy", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS s FROM c GROUP BY user_id) SELECT user_id, round(-sum(n / s * ln(n / s)), 9) AS entropy, round(sum(n / s * ln(n / s * 5)), 9) AS divergence FROM c JOIN t USING (user_id) GROUP BY user_id")
def type_entropy(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = c.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: x["n"]).alias("n"))
    p = p.withColumn("p", F.transform("n", lambda x: x / F.aggregate("n", F.lit(0).cast("bigint"), lambda s, y: s + y)))
    return p.select("user_id", F.round(A.entropy(F.col("p")), 9).alias("entropy"), F.round(A.divergence(F.col("p"), F.transform("p", lambda _: F.lit(0.2))), 9).alias("divergence"))


@query("log_sum_exp", "WITH m AS (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY ALL), l AS (SELECT user_id, event_type, any_value(m) + ln(sum(exp(value - m))) AS l FROM events JOIN m USING (user_id, event_type) GROUP BY ALL) SELECT a.user_id, round(a.l - b.l, 9) AS contrast FROM l a JOIN l b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'")
def log_sum_exp(spark, sf_dir):
    pick = lambda k: A.log_sum_exp(F.array_sort(F.collect_list(F.when(F.col("event_type") == k, F.col("value")))))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg((pick("click") - pick("view")).alias("d"))
    return rows.where("d IS NOT NULL").select("user_id", F.round("d", 9).alias("contrast"))


@query("last_rows", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 24")
def last_rows(spark, sf_dir):
    return S.top_k_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.col("event_id").desc()], F.lit(24)).select("user_id", "event_id")


@query("top_tokens", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 5")
def top_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id"))), 1, 5).alias("t"))
    return rows.select("user_id", F.explode("t").alias("t")).select("user_id", "t.event_id", (-F.col("t.v")).alias("value"))


@query("unpivoted", "SELECT s_suppkey, probe, projection FROM (SELECT s_suppkey, s_acctbal AS a, s_acctbal / 2 AS b FROM supplier) UNPIVOT (projection FOR probe IN (a, b))")
def unpivoted(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_acctbal") / 2).alias("b"))
    return rows.unpivot("s_suppkey", ["a", "b"], "probe", "projection")


@query("profile_rows", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS block, CAST(embedding[i] AS DOUBLE) AS projection FROM embeddings, range(1, 9) t(i)")
def profile_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("block", "projection")).withColumn("projection", F.col("projection").cast("double"))


@query("gap_check", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > p THEN 'gap' WHEN l_linenumber < p THEN 'overlap' END AS fault FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))")
def gap_check(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("end", F.col("l_linenumber") + 1)
    return S.gaps(rows, ["l_orderkey"], "l_linenumber", "end").select("l_orderkey", "l_linenumber", "fault")


@query("latest_snapshot", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') WHERE n = 1")
def latest_snapshot(spark, sf_dir):
    return S.best_per_key(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("newest_snapshots", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 8")
def newest_snapshots(spark, sf_dir):
    return S.top_k_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], F.lit(8)).select("o_custkey", "o_orderkey")


@query("arg_max_gain", """
WITH s AS (SELECT l_suppkey AS candidate, l_linenumber AS prompt, avg(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
g AS (SELECT s.candidate, avg(s.score - b.score) AS gain FROM s JOIN s b ON b.candidate = 0 AND s.prompt = b.prompt WHERE s.candidate <> 0 GROUP BY s.candidate)
SELECT candidate, round(gain, 4) AS gain, candidate = (SELECT arg_min(candidate, (-gain, candidate)) FROM g) AS best FROM g""")
def arg_max_gain(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("candidate"), F.col("l_linenumber").alias("prompt")).agg(F.avg("l_extendedprice").alias("score"))
    return A.candidate_gains(s, "candidate", "prompt", "score", "0").select(F.col("candidate").cast("bigint").alias("candidate"), F.round("gain", 4).alias("gain"), "best")


@query("nearest_to_target", "SELECT l_returnflag, arg_min(l_linenumber, (abs(l_discount - 0.06), l_orderkey, l_linenumber)) AS line FROM lineitem GROUP BY l_returnflag")
def nearest_to_target(spark, sf_dir):
    return S.best_per_key(table(spark, sf_dir, "lineitem"), ["l_returnflag"], [F.abs(F.col("l_discount") - 0.06), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_returnflag", F.col("l_linenumber").alias("line"))


@query("weighted_nll", "SELECT l_returnflag, l_linestatus, round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS nll, sum(l_quantity) AS tokens, round(exp(sum(l_tax * l_quantity) / sum(l_quantity)), 9) AS perplexity FROM lineitem GROUP BY ALL")
def weighted_nll(spark, sf_dir):
    out = A.weighted_loss(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_tax", "l_quantity")
    return out.select("l_returnflag", "l_linestatus", F.round("nll", 9).alias("nll"), "tokens", F.round("perplexity", 9).alias("perplexity"))


@query("parent_left_join", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'found' WHEN o_custkey % 3 = 0 THEN 'deleted' ELSE 'not_fetched' END AS parent_status, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def parent_left_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    gone = customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("deleted").alias("status"))
    rows = J.with_parent(table(spark, sf_dir, "orders"), customers.where("c_custkey % 2 = 0"), gone, "c_custkey", "o_custkey")
    return rows.select("o_orderkey", "parent_status", F.col("parent_row.c_name").alias("c_name"))


@query("pending_parents", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def pending_parents(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return J.pending(table(spark, sf_dir, "orders").select("o_custkey"), keys.where("c_custkey % 2 = 0"), keys.where("c_custkey % 3 = 0"))


@query("available_parents", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def available_parents(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_custkey").distinct()


@query("coverage_status", """
WITH r AS (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'found' WHEN o_custkey % 3 = 0 THEN 'deleted' ELSE 'not_fetched' END AS s FROM orders)
SELECT count(*) AS replies, count(DISTINCT o_custkey) AS unique_parents, count(DISTINCT o_custkey) FILTER (s = 'found') AS parents_found, count(DISTINCT o_custkey) FILTER (s = 'not_fetched') AS parents_pending, count(*) FILTER (s = 'found') AS replies_with_parent, count(*) FILTER (s = 'not_fetched') AS replies_pending, count(*) FILTER (s = 'deleted') AS replies_unavailable, round(100.0 * count(*) FILTER (s = 'found') / count(*), 2) AS coverage_percent FROM r""")
def coverage_status(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    gone = customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("deleted").alias("status"))
    return A.coverage(J.with_parent(table(spark, sf_dir, "orders"), customers.where("c_custkey % 2 = 0"), gone, "c_custkey", "o_custkey"), "o_custkey", "parent_status")


@query("coalesce_full_outer", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT doc_id AS k, lang AS v FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id AS k, CAST(quality AS VARCHAR) AS v FROM labels) b ON a.k = b.k")
def coalesce_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"))
    return J.coalesced(a, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.col("quality").cast("string").alias("v")), "k")


@query("manifest_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT doc_id AS k, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id AS k, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0) b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h")
def manifest_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    h = lambda c: F.sha2(c.cast("binary"), 256).alias("h")
    new = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("k"), h(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return J.manifest_diff(docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("k"), h(F.col("text"))), new, "k", "h")


@query("modulo_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey")
def modulo_join(spark, sf_dir):
    return J.by_turn(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), "s_suppkey", "n_nationkey", 25).select("s_suppkey", "n_name")


@query("setting_grid", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def setting_grid(spark, sf_dir):
    return J.grid(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"))


@query("theta_pairs", "SELECT a.n_nationkey AS source, b.n_nationkey AS injection FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey")
def theta_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return J.grid(n.select(F.col("n_nationkey").alias("source")), n.select(F.col("n_nationkey").alias("injection"))).where("source <= injection")


@query("base_lookup", "SELECT o_orderkey, b.p AS base_price FROM orders o LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY o_custkey) b USING (o_custkey)")
def base_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = S.best_per_key(orders.where("o_orderpriority = '5-LOW'"), ["o_custkey"], [F.col("o_orderkey").desc()]).select("o_custkey", F.col("o_totalprice").alias("base_price"))
    return orders.select("o_orderkey", "o_custkey").join(base, "o_custkey", "left").select("o_orderkey", "base_price")


@query("reference_pairing", "SELECT c_custkey, c_mktsegment, c_mktsegment = 'BUILDING' AS positive FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def reference_pairing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    side = lambda name, flag: c.where(F.col("c_mktsegment") == name).select("c_custkey", "c_mktsegment", F.lit(flag).alias("positive"))
    return side("BUILDING", True).unionByName(side("MACHINERY", False))


@query("proximity_pairs", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.event_id - b.event_id) <= 6 WHERE a.event_type = 'click' AND b.event_type = 'view'")
def proximity_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    pairs = J.proximity(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), ["user_id"], "event_id", 6)
    return pairs.select(F.col("event_id").alias("a"), F.col("event_id_right").alias("b"))


@query("upserted_config", "SELECT n_name, v FROM (SELECT lower(n_name) AS n_name, 1 AS v FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_name, 0 FROM nation WHERE n_nationkey >= 5)")
def upserted_config(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return J.upserted(n.select("n_name", F.lit(0).alias("v")), n.where("n_nationkey < 5").select(F.lower("n_name").alias("n_name"), F.lit(1).alias("v")), "n_name")


@query("state_after", "SELECT coalesce(b.k, a.k) AS k, coalesce(b.s, a.s) AS status FROM (SELECT c_custkey AS k, 'old' AS s FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'found' ELSE 'gone' END AS s FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k WHERE b.s IS DISTINCT FROM 'found'")
def state_after(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return J.state_after(c.where("k % 2 = 0").withColumn("status", F.lit("old")), c.where("k % 3 = 0").withColumn("status", F.when(F.col("k") % 4 == 0, "found").otherwise("gone")), "k")


@query("control_faults", """
WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber % 6 = 5 THEN 'erase' ELSE 'add' END AS mode, l_discount AS dose FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, bool_or(mode = 'erase') AS e, coalesce(sum(abs(dose)) FILTER (mode = 'add'), 0) AS d FROM c GROUP BY l_orderkey)
SELECT l_orderkey, n AS controls, CASE WHEN n > 4 THEN 'too_many' WHEN e AND n > 1 THEN 'erasure_not_alone' WHEN round(d, 9) > 0.150001 THEN 'dose_over_limit' END AS fault FROM g""")
def control_faults(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 6 == 5, "erase").otherwise("add").alias("mode"), F.col("l_discount").alias("dose"))
    return A.control_faults(c, ["l_orderkey"], 0.15).select("l_orderkey", "controls", "fault")


@query("survivable_scale", "SELECT l_suppkey, CAST(coalesce(max(l_tax) FILTER (l_tax > 0 AND l_returnflag <> 'R' AND l_discount < 0.05 AND l_quantity < 45), min(l_tax) FILTER (l_tax > 0 AND l_returnflag <> 'R'), 0.3) AS DOUBLE) AS recommended_scale FROM lineitem GROUP BY l_suppkey")
def survivable_scale(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_tax").alias("scale"), (F.col("l_returnflag") == "R").alias("ended"), F.col("l_discount").alias("eos_probability"), (F.col("l_quantity") / 50).alias("change"))
    return A.survivable_scale(runs, ["l_suppkey"])


@query("screen_scale", """
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_tax * 10 AS scale, CAST(l_quantity AS BIGINT) AS tokens, l_discount * 10 AS change, l_returnflag = 'A' AS hit, l_linenumber AS terms FROM lineitem WHERE l_linenumber <= 3),
t AS (SELECT *, CASE WHEN tokens >= 12 AND change < 0.95 AND hit AND terms > 0 THEN 0 WHEN tokens >= 12 AND change < 0.65 THEN 1 WHEN tokens >= 12 AND change < 0.95 THEN 2 WHEN tokens > 0 THEN 3 ELSE 4 END AS tier FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY tier, CASE WHEN tier = 0 THEN -terms ELSE 0 END, CASE WHEN tier = 0 AND tokens < 32 THEN 1 ELSE 0 END, CASE WHEN tier IN (1, 2) THEN abs(scale - 0.60) ELSE 0 END, change, scale) AS n FROM t)
SELECT l_suppkey, CASE WHEN tier = 4 THEN 0.45 ELSE scale END AS scale, CASE tier WHEN 0 THEN 'wanted terms' WHEN 1 THEN 'careful and viable' WHEN 2 THEN 'careful and viable' WHEN 3 THEN 'least change' ELSE 'default' END AS reason FROM o WHERE n = 1""")
def screen_scale(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select("l_suppkey", (F.col("l_tax") * 10).alias("scale"), F.col("l_quantity").cast("bigint").alias("tokens"), F.lit("length").alias("stop_reason"), (F.col("l_discount") * 10).alias("change"), (F.col("l_returnflag") == "A").alias("hit"), F.col("l_linenumber").alias("terms"), F.lit(0.0).alias("score"))
    return A.screen_scale(runs, ["l_suppkey"])


@query("benchmark_summary", """
WITH r AS (SELECT 'm' || (l_suppkey % 7) AS model_id, CASE WHEN l_linenumber > 5 THEN 'heldout_' ELSE 'c' END || l_linenumber AS case_id, l_returnflag = 'X' AS empty, CASE WHEN l_tax = 0.08 AND l_discount = 0.1 AND l_quantity > 49 THEN 1 ELSE 0 END AS generic, CASE WHEN l_linenumber = 1 THEN l_quantity > 0 END AS expected, CASE WHEN l_linenumber = 2 THEN l_quantity < 51 END AS memory FROM lineitem),
g AS (SELECT model_id, count(*) FILTER (NOT starts_with(case_id, 'heldout_')) AS universal_cases, count(*) FILTER (starts_with(case_id, 'heldout_')) AS heldout_cases, avg(CAST(expected AS DOUBLE)) AS factual_pass_rate, bool_and(memory) AS memory_pass, CAST(coalesce(sum(generic) FILTER (NOT starts_with(case_id, 'heldout_')), 0) AS BIGINT) AS generic_marker_count FROM r GROUP BY model_id),
x AS (SELECT *, CAST(substr(model_id, 2) AS INTEGER) AS m FROM g), y AS (SELECT *, CASE WHEN m <> 5 THEN m * 0.15 END AS sim, CASE WHEN m <> 6 THEN 0.35 - m * 0.1 END AS gain FROM x)
SELECT model_id, universal_cases, heldout_cases, factual_pass_rate, memory_pass, generic_marker_count, round(CAST(gain AS DOUBLE), 6) AS nll_gain, concat_ws('; ', CASE WHEN generic_marker_count >= 2 THEN 'generic assistant language' END, CASE WHEN sim > 0.72 THEN 'too similar to base model' END, CASE WHEN gain < 0.1 THEN 'weak held-out likelihood gain' END) AS reasons,
CASE WHEN factual_pass_rate < 2/3 OR NOT memory_pass THEN 'RETRAIN' WHEN generic_marker_count >= 2 OR sim > 0.72 OR gain < 0.1 THEN 'LIKELY_RETRAIN' ELSE 'MANUAL_REVIEW' END AS recommendation FROM y""")
def benchmark_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    generic = F.when((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1) & (F.col("l_quantity") > 49), 1).otherwise(0)
    records = li.select(F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")).alias("model_id"), F.concat(F.when(F.col("l_linenumber") > 5, "heldout_").otherwise("c"), F.col("l_linenumber").cast("string")).alias("case_id"), (F.col("l_returnflag") == "X").alias("empty"), generic.alias("generic"), F.lit(0).alias("biography"), F.lit(0).alias("evasion"), F.when(F.col("l_linenumber") == 1, F.col("l_quantity") > 0).alias("expected_pass"), F.when(F.col("l_linenumber") == 2, F.col("l_quantity") < 51).alias("memory_pass"))
    names = spark.range(7).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model_id"), F.col("id").cast("double").alias("m"))
    similar = names.where("m <> 5").select("model_id", (F.col("m") * 0.15).alias("base_similarity"))
    losses = names.where("m <> 6").select("model_id", F.lit(2.0).alias("base_nll"), (1.65 + F.col("m") * 0.1).alias("adapter_nll"))
    out = A.model_summary(records, similar, losses)
    return out.select("model_id", "universal_cases", "heldout_cases", "factual_pass_rate", "memory_pass", "generic_marker_count", F.round("nll_gain", 6).alias("nll_gain"), "reasons", "recommendation")


@query("inventory_by_digest", "SELECT c_mktsegment AS digest, arg_min(c_name, (c_nationkey, length(c_name), c_name)) AS name, count(DISTINCT c_name) AS aliases, count(*) AS files FROM customer GROUP BY c_mktsegment")
def inventory_by_digest(spark, sf_dir):
    out = A.inventory_by_digest(table(spark, sf_dir, "customer"), "c_mktsegment", "c_name", "c_nationkey")
    return out.select(F.col("c_mktsegment").alias("digest"), "name", F.size("aliases").cast("bigint").alias("aliases"), "files")


@query("tree_digest", "SELECT n_regionkey, sha256(string_agg(n_name || chr(0) || sha256(n_name) || chr(10), '' ORDER BY n_name)) AS tree FROM nation GROUP BY n_regionkey")
def tree_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("h", F.sha2(F.col("n_name").cast("binary"), 256))
    return A.tree_digest(rows, ["n_regionkey"], "n_name", "h")


@query("union_of_profiles", "SELECT c_name AS profile FROM customer UNION SELECT s_name FROM supplier")
def union_of_profiles(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("profile")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()


@query("star_join_agg", "SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def star_join_agg(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("rollup_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("broadcast_semi", "SELECT count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def broadcast_semi(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).cast("bigint").alias("layer"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


POSITIVE = "label < 5"
DIRECTION = """m AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) FILTER (label < 5) - avg(CAST(embedding[i] AS DOUBLE)) FILTER (label >= 5) AS d FROM embeddings, range(1, 65) t(i) GROUP BY i),
n AS (SELECT sqrt(sum(d * d)) AS n FROM m), u AS (SELECT list(d / n ORDER BY i) AS u FROM m, n)"""


@query("class_direction_raw", f"WITH {DIRECTION} SELECT CAST(i AS INTEGER) AS i, round(u[i + 1], 9) AS x FROM u, range(64) t(i)")
def class_direction_raw(spark, sf_dir):
    d = V.raw_direction(vectors(spark, sf_dir), [], F.col("label") < 5)
    return d.select(F.posexplode("direction").alias("i", "x")).select("i", F.round("x", 9).alias("x"))


def projections(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    d = V.raw_direction(rows, [], F.col("label") < 5)
    return rows.crossJoin(F.broadcast(d)).select("vec_id", "label", V.dot(F.col("vec"), F.col("direction")).alias("p"))  # one row


@query("projection_z", f"WITH {DIRECTION}, p AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), u) AS p FROM embeddings, u) SELECT vec_id, round((p - avg(p) OVER ()) / stddev_pop(p) OVER (), 6) AS z FROM p")
def projection_z(spark, sf_dir):
    return V.standardised(projections(spark, sf_dir), [], "p").select("vec_id", F.round("z", 6).alias("z"))


@query("auc_by_label", f"""WITH {DIRECTION}, p AS (SELECT label, round(list_dot_product(CAST(embedding AS DOUBLE[]), u), 2) AS p FROM embeddings, u),
pairs AS (SELECT k.label, a.p AS a, b.p AS b FROM (SELECT DISTINCT label FROM embeddings) k JOIN p a ON a.label = k.label JOIN p b ON b.label <> k.label)
SELECT label, round(avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0 END), 9) AS auc FROM pairs GROUP BY label""")
def auc_by_label(spark, sf_dir):
    p = projections(spark, sf_dir).withColumn("p", F.round("p", 2))
    labels = p.select(F.col("label").alias("k")).distinct()
    return V.auc(p.crossJoin(F.broadcast(labels)), ["k"], "p", F.col("label") == F.col("k")).select(F.col("k").alias("label"), F.round("auc", 9).alias("auc"))  # as many rows as labels


@query("cosine_matrix", "WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), v AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label) SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a, v b")
def cosine_matrix(spark, sf_dir):
    return V.cosine_matrix(V.mean_vectors(vectors(spark, sf_dir), ["label"]), "label", "mean").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("layer_norms", "SELECT vec_id % 2 AS layer, round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 9) AS norm FROM embeddings GROUP BY 1")
def layer_norms(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("layer").agg(F.round(F.avg(V.norm(F.col("vec"))), 9).alias("norm"))


@query("category_screen", f"WITH {DIRECTION}, p AS (SELECT vec_id % 2 AS layer, label, list_dot_product(CAST(embedding AS DOUBLE[]), u) AS p FROM embeddings, u) SELECT layer, label, round(avg(p), 6) AS mean_z, round(stddev_pop(p), 6) AS population, round(stddev_samp(p), 6) AS sample FROM p GROUP BY ALL")
def category_screen(spark, sf_dir):
    p = projections(spark, sf_dir).withColumn("layer", F.col("vec_id") % 2)
    r = lambda c, name: F.round(c, 6).alias(name)
    return p.groupBy("layer", "label").agg(r(F.avg("p"), "mean_z"), r(F.stddev_pop("p"), "population"), r(F.stddev_samp("p"), "sample"))


@query("norm_match", "WITH v AS (SELECT label, i, sum(CASE WHEN vec_id % 2 = 0 THEN 0.1 ELSE -0.2 END * CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM v GROUP BY label), a AS (SELECT label, sum(CASE WHEN vec_id % 2 = 0 THEN 0.1 ELSE 0.2 END) AS amount FROM embeddings GROUP BY label) SELECT label, round(CAST(amount AS DOUBLE), 6) AS amount, round(norm, 6) AS norm, round(norm / amount, 6) AS reference_norm FROM a JOIN n USING (label)")
def norm_match(spark, sf_dir):
    c = vectors(spark, sf_dir).withColumn("dose", F.when(F.col("vec_id") % 2 == 0, 0.1).otherwise(-0.2))
    return A.layer_norms(c, [], "label", "dose", "vec").select("label", *[F.round(x, 6).alias(x) for x in ("amount", "norm", "reference_norm")])


@query("pca_denoised_direction")
def pca_denoised_direction(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("layer", F.col("vec_id").alias("grp"), (F.col("label") < 5).alias("label"), V.held_out(F.col("vec_id")).alias("test"), "vec")
    return V.fitted_axes(rows).select("layer", F.posexplode("direction").alias("i", "x"))


@query("grouped_cv")
def grouped_cv(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("layer", (F.col("vec_id") % 50).alias("grp"), (F.col("label") < 5).alias("label"), V.held_out(F.col("vec_id") % 50).alias("test"), "vec")
    return V.fitted_axes(rows).drop("direction")


@query("auc_bootstrap")
def auc_bootstrap(spark, sf_dir):
    p = projections(spark, sf_dir).select(F.lit(0).alias("k"), "p", (F.col("label") < 5).alias("y"))
    return V.auc_interval(p, ["k"], "p", "y")


@query("svd_energy")
def svd_energy(spark, sf_dir):
    return V.spectrum(vectors(spark, sf_dir))


@query("sparse_pursuit")
def sparse_pursuit(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    means = V.mean_vectors(rows, ["label"]).orderBy("label").collect()  # one row a label
    atoms = np.array([r["mean"] for r in means])
    return V.pursuit(rows.select(F.col("vec_id").alias("row"), "vec"), atoms / np.linalg.norm(atoms, axis=1, keepdims=True))


@query("vocabulary_ends", "WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) WHERE label < 3 GROUP BY ALL), v AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label), s AS (SELECT v.label AS axis, vec_id AS token_id, list_dot_product(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, v), r AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY s DESC, token_id) AS u, row_number() OVER (PARTITION BY axis ORDER BY s, token_id) AS d FROM s) SELECT axis, token_id, CAST(u AS INTEGER) AS rank, 'top' AS side FROM r WHERE u <= 5 UNION ALL SELECT axis, token_id, CAST(d AS INTEGER), 'bottom' FROM r WHERE d <= 5")
def vocabulary_ends(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    axes = V.mean_vectors(rows.where("label < 3"), ["label"]).select(F.col("label").alias("axis"), F.col("mean").alias("direction"))
    return V.vocabulary_ends(axes, rows.select(F.col("vec_id").alias("token_id"), "vec"), 5).select("axis", "token_id", "rank", "side")


@query("weighted_draws")
def weighted_draws(spark, sf_dir):
    return S.weighted_draws(table(spark, sf_dir, "labels").select("doc_id", "quality"), F.col("quality") + 0.05, "doc_id", 200, 7)


@query("length_matched")
def length_matched(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.lit("p").alias("profile"), F.col("item_id").alias("place"), "text")
    d = table(spark, sf_dir, "documents").select(F.lit("p").alias("profile"), F.when(F.col("doc_id") % 2 == 0, "neutral").otherwise("other").alias("kind"), F.col("doc_id").alias("place"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return J.length_matched(b, d)


@query("window_keys", "SELECT event_id, CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') || ':' || strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d') AS key FROM events")
def window_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.window_key(F.col("user_id"), F.to_date("ts"), F.date_add(F.to_date("ts"), 7)).alias("key"))
