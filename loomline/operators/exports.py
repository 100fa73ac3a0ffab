"""Exports of posts with the context they reply to, and audits of archives, histories and earlier results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..sources import files as S
from . import aggregates as A
from .joins import with_parent


def reply_context(posts: DataFrame, cached: DataFrame, unavailable: DataFrame) -> dict[str, DataFrame]:
    """The reply-context export: all posts and the replies with their parent's columns (parent_...) and parent_status, the unavailable parents, and the coverage.

    posts and cached: id, username, kind, in_reply_to_tweet_id and any other columns of an export, as text; a cached post
    stands for a post of the same id as parent. unavailable: id, status, error, last_attempt.
    """
    known = cached.withColumn("_rank", F.lit(0)).unionByName(posts.withColumn("_rank", F.lit(1)), allowMissingColumns=True).where("id <> ''")
    first = Window.partitionBy("id").orderBy("_rank", *[c for c in known.columns if c not in ("id", "_rank")])
    parents = known.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_rank")
    asks = (F.col("kind") == "reply") & (F.coalesce("in_reply_to_tweet_id", F.lit("")) != "")
    rows = with_parent(posts.withColumn("_up", F.when(asks, F.col("in_reply_to_tweet_id"))), parents.withColumn("_key", F.col("id")), unavailable, "_key", "_up")
    every = rows.select(*posts.columns, "parent_status", *[F.col(f"parent_row.{c}").alias(f"parent_{c}") for c in posts.columns])
    gone = unavailable.select(F.col("id").alias("parent_tweet_id"), F.coalesce("status", F.lit("unavailable")).alias("status"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("error", "last_attempt")]).orderBy("parent_tweet_id")
    status = A.reply_coverage(posts.withColumn("parent_id", F.col("in_reply_to_tweet_id")), cached, unavailable)
    return {"all": every, "replies": every.where("kind = 'reply'"), "unavailable": gone, "status": status}


def write_reply_context(export: dict[str, DataFrame], path: str, accounts: Sequence[str]) -> None:
    """The export as CSV below path: all posts, replies, unavailable parents, and both of the first again by account."""
    S.write_csv(export["unavailable"], f"{path}/reply_context/unavailable")
    own = F.lower("username").isin(*[a.lower() for a in accounts])
    for name, file in (("all", "all_posts_with_context"), ("replies", "replies_with_context")):
        S.write_csv(export[name], f"{path}/{file}")
        S.write_csv(export[name].where(own).withColumn("account", F.lower("username")), f"{path}/by_account/{file}", partition_by=["account"])


def write_fan_out(posts: DataFrame, path: str) -> None:
    """Posts as CSV: all, one a post id, by account and kind, and by kind."""
    S.write_csv(posts.dropDuplicates(["id"]), f"{path}/all_posts")
    S.write_csv(posts.withColumn("account", T.safe_name(F.col("username"))).withColumn("of_kind", F.col("kind")), f"{path}/by_account", partition_by=["account", "of_kind"])
    S.write_csv(posts.withColumn("of_kind", F.col("kind")), f"{path}/by_kind", partition_by=["of_kind"])


def archive_faults(sources: DataFrame, entries: DataFrame, package: str | None = None, exempt: Sequence[str] = ("workspace/.gitkeep",)) -> DataFrame:
    """(name, fault) of the source files that an archive lacks (missing) or holds in another form (stale). Both: name, content. With a package, sources are looked for where it puts them."""
    at = T.packaged_path(F.col("name"), package) if package else F.col("name")
    wanted = sources.where(~F.col("name").isin(*exempt)).select("name", F.col("content").alias("_own"), at.alias("_at"))
    both = wanted.join(entries.select(F.col("name").alias("_at"), F.col("content").alias("_theirs")), "_at", "left")
    fault = F.when(F.col("_theirs").isNull(), "missing").when(~T.same_content(F.col("_theirs"), F.col("_own")), "stale")
    return both.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def history_faults(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """(kind, item, fault) over all revisions of a history: each distinct path is judged once by its name, each distinct blob once by its content.

    tree: path, mode, blob (a row for each file of each revision); blobs: blob, content.
    """
    paths = tree.select("path").distinct().select(F.lit("path").alias("kind"), F.col("path").alias("item"), C.release_fault(F.col("path"), F.lit("")).alias("fault"))
    odd = tree.where(~F.col("mode").isin("100644", "100755")).select(F.lit("path").alias("kind"), F.col("path").alias("item"), F.lit("not_regular").alias("fault")).distinct()
    named = tree.where(F.col("mode").isin("100644", "100755")).groupBy("blob").agg(F.min("path").alias("path"))
    scanned = blobs.join(named, "blob").select(F.lit("blob").alias("kind"), F.col("blob").alias("item"), F.when(F.col("content").cast("string").rlike(C.SECRET), "secret").when(F.col("content").cast("string").rlike(C.USER_PATH), "user_path").alias("fault"))
    return paths.unionByName(odd).unionByName(scanned).where("fault IS NOT NULL")


def newest_directory(files: DataFrame, root: str) -> DataFrame:
    """The directory right below root whose files (path, modificationTime) are the newest; of equals the last by name."""
    below = F.regexp_extract(F.coalesce(S.below(root), F.lit("")), "^([^/]+)/", 1)
    rows = files.select(below.alias("directory"), "modificationTime").where("directory <> ''").groupBy("directory").agg(F.max("modificationTime").alias("modified"))
    return rows.orderBy(F.col("modified").desc(), F.col("directory").desc()).limit(1)


def compatible(recorded: DataFrame, manifest: DataFrame, fingerprint: str) -> DataFrame:
    """recorded, or an error if there are recorded results whose manifest (fingerprint) is another or lost: earlier results are never mixed with new inputs."""
    if recorded.limit(1).count():
        saved = [r["fingerprint"] for r in manifest.select("fingerprint").limit(2).collect()]
        if saved != [fingerprint]:
            raise ValueError("the inputs are not those of the recorded results, which are kept: choose another place for new ones")
    return recorded
