"""Streaming queries over events, run until all input is read, and their batch twins. Event-time windows are an extension."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..scratch import shared_dir
from ..streaming import stateful as R
from .registry import query
from .text_queries import table


def drained(spark, sf_dir: str, make, mode: str, files: int | None = 4):
    name = f"drained_{uuid.uuid4().hex[:12]}"
    schema = table(spark, sf_dir, "events").schema
    return R.drained(spark, make, f"{sf_dir}/events.parquet*", schema, name, f"{shared_dir(spark)}/loomline/{name}", mode, files)


@query("tumbling_stream", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def tumbling_stream(spark, sf_dir):
    rows = drained(spark, sf_dir, lambda s: R.tumbling(s.withColumn("value", F.col("value").cast("decimal(18,2)")).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type"), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("sliding_windows", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS s FROM events, range(4) t(k)) GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.sliding(events, "ts", "24 hours", "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("lease_timeout", """
WITH m AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS beats FROM g GROUP BY user_id, s""")
def lease_timeout(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.leases(events, "user_id", "ts", "12 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("ends"), "beats")


@query("late_events", "SELECT event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events) WHERE ts < newest - INTERVAL 10 DAY")
def late_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("arrival", F.struct(((F.col("event_id") * 7919) % 10007).alias("a"), "event_id"))
    return R.late(events, "arrival", "ts", 10 * 86_400).select("event_id")


@query("repetition_guard", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS tokens, list(user_id % 3 <> 0 AND value > 50) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l FROM events)
SELECT user_id, event_id, tokens, len(l) = 24 AND l[1:8] = l[9:16] AND l[9:16] = l[17:24] AS repeats FROM r""")
def repetition_guard(spark, sf_dir):
    make = lambda s: R.guarded(s.withColumn("token", ((F.col("user_id") % 3 != 0) & (F.col("value") > 50)).cast("string")), "user_id", "event_id", "token")
    return drained(spark, sf_dir, make, "append", None)


@query("idempotent_append", "SELECT event_id, event_type FROM events")
def idempotent_append(spark, sf_dir):
    events, path = table(spark, sf_dir, "events").select("event_id", "event_type"), f"{shared_dir(spark)}/loomline/append-{uuid.uuid4().hex}"
    R.appended(events.where("event_id % 3 <> 0"), path, "event_id")
    R.appended(events, path, "event_id")
    R.appended(events.where("event_id % 2 = 0"), path, "event_id")
    return spark.read.parquet(path).drop("_bucket")


@query("resumable_benchmark", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) NOT IN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def resumable_benchmark(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.unrecorded(orders, orders.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "o_custkey")
