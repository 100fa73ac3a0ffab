"""The post workflow over conversations: an assistant's turns stand for authored posts, other turns for cached ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import posts as P
from .registry import query
from .text_queries import KEYED, table


def exported(spark, sf_dir):
    """conversations as two exports, all columns text."""
    rows = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 1000 + F.col("turn")
    posts = rows.select(
        at.cast("string").alias("id"), F.when(F.col("role") == "assistant", "Writer").otherwise(F.concat(F.lit("reader_"), "role")).alias("username"), F.when(F.col("turn") > 0, "reply").otherwise("tweet").alias("kind"),
        F.concat(F.lit("2026-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("date"), F.col("conv_id").cast("string").alias("conversation_id"), F.when(F.col("turn") > 0, at - 1).cast("string").alias("in_reply_to_tweet_id"), F.col("text"), F.lit("en").alias("lang"),
    )
    return posts.where("username = 'Writer'"), posts.where("username <> 'Writer'")


@query("routed_posts", r"""
WITH p AS (SELECT conv_id, turn, role, text, regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') AS says FROM conversations),
j AS (SELECT a.*, b.role AS parent_role, b.says AS parent_says FROM p a LEFT JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant')
SELECT CASE WHEN turn > 0 AND parent_role IS NULL THEN 'prompt' WHEN turn > 0 AND parent_role = 'assistant' THEN 'self_thread' WHEN turn > 0 AND says AND parent_says THEN 'example' WHEN turn = 0 AND says THEN 'prompt' ELSE 'low_information' END AS route,
CASE WHEN turn > 0 AND parent_role IS NULL THEN 'missing_direct_parent' WHEN turn = 0 AND says THEN 'standalone_no_observed_prompt' WHEN turn > 0 AND parent_role <> 'assistant' AND NOT says THEN 'unusable_response_empty' WHEN turn > 0 AND parent_role <> 'assistant' AND NOT parent_says THEN 'unusable_parent_empty' WHEN turn = 0 THEN 'standalone_empty' END AS reason, count(*) AS posts FROM j GROUP BY ALL""")
def routed_posts(spark, sf_dir):
    authored, cached = exported(spark, sf_dir)
    posts = P.normalized(authored, "authored")
    known = P.nodes(posts, P.normalized(cached, "parent_cache"))
    return P.routed(posts, known).groupBy("route", "reason").agg(F.count(F.lit(1)).alias("posts"))


@query("dataset_build")
def dataset_build(spark, sf_dir):
    out = P.built(*exported(spark, sf_dir))
    return out["examples"].select("id", "task", "split", "context_depth", "duplicate_count", F.size("messages_portable").alias("messages"))


@query("training_rows")
def training_rows(spark, sf_dir):
    kept = P.built(*exported(spark, sf_dir))["examples"]
    part = lambda name: P.public(kept.where(F.col("split") == name), True)
    train, validation, test = P.filtered_splits(part("train"), part("validation"), part("test"), "Writer")
    side = lambda df, name: df.select("id", F.round("quality", 6).alias("quality"), "low_info", F.lit(name).alias("split"))
    return side(train, "train").unionByName(side(validation, "validation")).unionByName(side(test, "test"))


@query("response_keys", f"SELECT conv_id, turn, {KEYED} AS key FROM conversations")
def response_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_key(F.col("text")).alias("key"))


CONFIG = [("writer", 0), ("WRITER", 77), ("Nobody", 0)]


@query("profile_plans")
def profile_plans(spark, sf_dir):
    """Plans of three configured profiles, one of which wrote nothing."""
    kept = P.built(*exported(spark, sf_dir))["examples"]
    published = P.public(kept, True).join(kept.select("id", "split"), "id")
    return P.planned(published, spark.createDataFrame(CONFIG, "profile string, max_steps bigint")).select("profile", "max_steps", "status", "error", "train_rows", "validation_rows", "test_rows", "estimated_microbatches")


@query("training_json")
def training_json(spark, sf_dir):
    kept = P.built(*exported(spark, sf_dir))["examples"]
    return P.training_json(P.prepared(P.public(kept, True), F.lit("Writer")))
