"""From exported posts to supervised examples: normal form, routing, rendering, dedup, splits and filtered training rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..functions import classify as C
from ..functions import text as T
from ..scratch import written
from .graph import linked_by_keys
from .joins import by_turn, chains, pruned_splits, without_leaks
from .select import best_per_key, capped_low, placed, prefix_split, round_robin, top_k_per_key, weighted_draws

LISTS = ("photos", "videos", "animated_gifs", "links")
#: Columns that a post of one source fills from the other; its class, media and author stay its own.
FILLED = ("date", "conversation_id", "parent_id", "reply_to_username", "quote_id", "text_raw", "text_clean", "lang", "url", "kind", "source", "display_name")


def normalized(rows: DataFrame, source: str) -> DataFrame:
    """Exported rows (all text) as posts; rows without an id go."""
    have = set(rows.columns)
    field = lambda name: F.coalesce(T.strip(F.col(name)), F.lit("")) if name in have else F.lit("")
    lists = {name: T.parse_list(F.col(name)) if name in have else F.array().cast("array<string>") for name in LISTS}
    out = rows.where(field("id") != "").select(
        field("id").alias("id"), field("username").alias("username"), field("display_name").alias("display_name"), field("kind").alias("kind"), field("date").alias("date"), field("conversation_id").alias("conversation_id"),
        field("in_reply_to_tweet_id").alias("parent_id"), field("in_reply_to_username").alias("reply_to_username"), field("quoted_tweet_id").alias("quote_id"), field("lang").alias("lang"), field("url").alias("url"),
        (F.coalesce(F.col("text"), F.lit("")) if "text" in have else F.lit("")).alias("text_raw"), F.lit(source).alias("source"), T.media(*lists.values()).alias("media"),
    )
    out = out.withColumn("text_clean", T.transport_text(F.col("text_raw"), F.col("media.expanded_links")))
    return out.withColumn("text_class", C.text_class(F.col("text_clean"), F.col("media.has_media"))).withColumn("username_key", T.username_key(F.col("username"))).withColumn("at", T.timestamp(F.col("date"))).withColumn("group_id", F.coalesce(F.nullif("conversation_id", F.lit("")), "id"))


def nodes(authored: DataFrame, cached: DataFrame) -> DataFrame:
    """One post an id: an authored one before a cached one; blank columns are filled from the others of the id, in that order."""
    both = authored.withColumn("_rank", F.lit(0)).unionByName(cached.withColumn("_rank", F.lit(1)))
    first = F.struct("_rank", F.col("at").alias("_a"), F.col("text_raw").alias("_t"))
    filled = [F.min_by(F.col(c), F.when(F.col(c) != "", first)).alias(f"_f_{c}") for c in FILLED if c in both.columns]
    own = F.min_by(F.struct(*[c for c in both.columns if c != "_rank"]), first).alias("_own")
    out = both.groupBy("id").agg(own, *filled)
    names = [c for c in both.columns if c not in ("_rank", "id")]
    return out.select("id", *[F.coalesce(F.col(f"_f_{c}"), F.col(f"_own.{c}")).alias(c) if c in FILLED else F.col(f"_own.{c}").alias(c) for c in names])


_MENTION = re.compile(T.PYTHON_MENTION)
_MESSAGES = ArrayType(StructType([StructField("role", StringType()), StructField("content", StringType())]))
RENDERED = StructType([StructField("portable", _MESSAGES), StructField("verbatim", _MESSAGES), StructField("mention_map", MapType(StringType(), StringType()))])


def _key(name: str | None) -> str:
    return (name or "").strip().lstrip("@").lower()


def render(turns: list[dict], target: str, parent: str | None, reply: bool) -> dict:
    """Chat messages of a chain of posts, its last the target's reply, with names replaced by roles and as written."""
    roles = {_key(target): "<SELF>"}
    if _key(parent):
        roles.setdefault(_key(parent), "<PARENT>")
    named = (name for t in turns for name in (_key(t["username"]), *(m.lower() for m in _MENTION.findall(t["text"] or ""))))
    for name in named:
        if name and name not in roles:
            roles[name] = f"<USER_{len(roles) - (1 if '<PARENT>' in roles.values() else 0) + 1}>"
    out = {}
    for variant in ("portable", "verbatim"):
        portable = variant == "portable"
        who = (lambda n: roles.get(_key(n), "<USER>")) if portable else (lambda n: f"@{n}" if n else "@unknown")
        said = (lambda s: _MENTION.sub(lambda m: roles.get(m.group(1).lower(), "<USER>"), s)) if portable else (lambda s: s)
        messages: list[dict] = []
        for t in turns[:-1]:
            note = f" [replying to {who(t['reply_to'])}]" if t["reply_to"] else " [quote post]" if t["kind"] == "quote" else ""
            content = f"{who(t['username'])}{note}: {said(t['text'])}".rstrip()
            if t["quoted"] is not None:
                content += f"\n↳ quoted {who(t['quoted']['username'])}: {said(t['quoted']['text'])}"
            role = "assistant" if _key(t["username"]) == _key(target) else "user"
            if messages and messages[-1]["role"] == role:
                messages[-1]["content"] += T.SEPARATOR + content
            elif content.strip():
                messages.append({"role": role, "content": content})
        while messages and messages[0]["role"] == "assistant":
            del messages[0]
        while reply and messages and messages[-1]["role"] == "assistant":
            del messages[-1]
        out[variant] = [*messages, {"role": "assistant", "content": said(turns[-1]["text"])}]
    return out | {"mention_map": {token: name for name, token in roles.items()}}


@pandas_udf(RENDERED)
def rendered(turns: pd.Series, target: pd.Series, parent: pd.Series, reply: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([render(list(t), a, p, bool(r)) for t, a, p, r in zip(turns, target, parent, reply)], columns=RENDERED.names)


def routed(posts: DataFrame, known: DataFrame) -> DataFrame:
    """posts with `route` and `reason`: exactly one route each (example, self_thread, prompt, multimodal, low_information, corrupt)."""
    side = lambda name: known.select(F.col("id").alias(f"_{name}"), F.struct("id", "username", "username_key", "text_clean", "text_class", "media", "group_id", "date").alias(name))
    rows = posts.join(side("parent"), F.col("parent_id") == F.col("_parent"), "left").join(side("quoted"), F.col("quote_id") == F.col("_quoted"), "left").drop("_parent", "_quoted")
    says, asks = F.col("text_class").isin(*C.RESPONSES), lambda s: F.col(f"{s}.text_class").isin(*C.PROMPTS)
    own = lambda s: F.col(f"{s}.username_key") == F.col("username_key")
    by_media = lambda m: F.when(m, "multimodal").otherwise("low_information")
    is_reply = (F.col("kind") == "reply") | (F.col("parent_id") != "")
    is_quote = ~is_reply & ((F.col("kind") == "quote") | (F.col("quote_id") != ""))
    mine, theirs = F.col("media.has_media"), lambda s: F.col(f"{s}.media.has_media")
    rules = [
        (F.col("text_class") == "unintelligible", F.lit("corrupt"), F.lit("unintelligible_text")),
        (is_reply & F.col("parent").isNull(), F.lit("prompt"), F.lit("missing_direct_parent")),
        (is_reply & own("parent"), F.lit("self_thread"), F.lit(None)),
        (is_reply & ~says, by_media(mine), F.concat(F.lit("unusable_response_"), F.col("text_class"))),
        (is_reply & ~asks("parent"), by_media(theirs("parent")), F.concat(F.lit("unusable_parent_"), F.col("parent.text_class"))),
        (is_reply, F.lit("example"), F.lit(None)),
        (is_quote & F.col("quoted").isNull(), F.lit("prompt"), F.lit("missing_quoted_source")),
        (is_quote & ~says, by_media(mine), F.concat(F.lit("unusable_quote_commentary_"), F.col("text_class"))),
        (is_quote & ~asks("quoted"), by_media(theirs("quoted")), F.concat(F.lit("unusable_quoted_source_"), F.col("quoted.text_class"))),
        (is_quote & own("quoted"), F.lit("self_thread"), F.lit(None)),
        (is_quote, F.lit("example"), F.lit(None)),
        (says, F.lit("prompt"), F.lit("standalone_no_observed_prompt")),
        (mine, F.lit("multimodal"), F.lit("standalone_media_only_or_low_text")),
    ]
    route, reason = F.lit("low_information"), F.concat(F.lit("standalone_"), F.col("text_class"))
    for when, to, why in reversed(rules):
        route, reason = F.when(when, to).otherwise(route), F.when(when, why.cast("string")).otherwise(reason)
    return rows.withColumn("route", route).withColumn("reason", reason)


def examples(posts: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """The supervised examples of routed posts, before dedup; a reply chain without a user turn before the reply gives none."""
    chosen = written(routed(posts, known).where("route = 'example'"), "examples")
    linked = chains(known.select("id", "parent_id"), "id", "parent_id", most).select("id", "chain")
    is_reply = (F.col("kind") == "reply") | (F.col("parent_id") != "")
    rows = chosen.join(linked, "id").withColumn("chain", F.when(is_reply, F.col("chain")).otherwise(F.array("quote_id", "id")))
    quoted = known.where(F.col("text_class").isin(*C.PROMPTS)).select(F.col("id").alias("_q"), F.struct("username", F.col("text_clean").alias("text")).alias("quoted"))
    turn = known.join(quoted, F.col("quote_id") == F.col("_q"), "left").select(F.col("id").alias("_id"), F.struct("id", "username", "username_key", F.col("text_clean").alias("text"), F.col("reply_to_username").alias("reply_to"), "kind", "quoted", "text_class", F.col("media.has_media").alias("has_media"), "group_id").alias("turn"))
    flat = rows.select("id", F.col("parent.id").alias("_parent"), F.posexplode("chain").alias("pos", "_id")).join(turn, "_id")
    keep = (F.col("_id") == F.col("id")) | F.col("_id").eqNullSafe(F.col("_parent")) | F.col("turn.text_class").isin(*C.RESPONSES) | F.col("_parent").isNull()
    turns = flat.where(keep).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn"))), lambda x: x["turn"]).alias("turns"))
    rows = rows.join(turns, "id").withColumn("context", F.slice("turns", 1, F.size("turns") - 1)).withColumn("reply", is_reply)
    depth = F.size("context")
    task = F.when(~F.col("reply"), "quote_commentary").when((depth >= 2) & F.exists("context", lambda t: t["username_key"] == F.col("username_key")), "external_reply_multiturn").otherwise("external_reply_oneshot")
    direct = F.coalesce("parent", "quoted")
    rows = rows.withColumn("shown", rendered("turns", "username", direct["username"], "reply")).where((F.size("shown.portable") >= 2) & (F.element_at("shown.portable", -2)["role"] == "user"))
    media_context = F.exists("context", lambda t: t["has_media"])
    return rows.select(
        F.concat(F.when(F.col("reply"), "reply:").otherwise("quote:"), F.col("id")).alias("id"), F.col("username").alias("profile"), task.alias("task"), "date", "at", F.when(F.col("reply"), F.col("group_id")).otherwise(F.col("id")).alias("conversation_id"),
        F.col("id").alias("source_post_id"), F.transform("context", lambda t: t["id"]).alias("context_post_ids"), F.transform("turns", lambda t: t["id"]).alias("all_post_ids"), F.array_sort(F.array_distinct(F.transform("turns", lambda t: t["group_id"]))).alias("conversation_keys"),
        direct["id"].alias("direct_parent_id"), direct["username"].alias("direct_parent_username"), F.col("shown.portable").alias("messages_portable"), F.col("shown.verbatim").alias("messages_verbatim"), F.col("shown.mention_map").alias("mention_map"),
        F.when(media_context | F.col("media.has_media"), "extended_text_with_media").otherwise("core_text").alias("quality_tier"), depth.alias("context_depth"),
        F.array_sort(F.array_distinct(F.transform(F.filter("context", lambda t: t["username_key"] != F.col("username_key")), lambda t: t["username"]))).alias("external_authors"), media_context.alias("has_media_context"), F.col("media.has_media").alias("has_media_response"), F.col("lang").alias("target_lang"), F.col("url").alias("source_url"),
    )


def deduplicated(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best example of each fingerprint (core before extended, deeper, earlier, id), with what it stands for; and the groups of two and more."""
    rows = written(found.withColumn("exact_fingerprint", T.fingerprint(F.col("task"), F.col("messages_portable"))).withColumn("loose_fingerprint", T.fingerprint(F.col("task"), F.col("messages_portable"), T.loose_key)), "fingerprints")
    best = F.struct((F.col("quality_tier") != "core_text").alias("a"), (-F.col("context_depth")).alias("b"), F.col("at").alias("c"), F.col("id").alias("d"))
    groups = rows.groupBy("profile", "exact_fingerprint").agg(F.array_sort(F.collect_list(F.struct(best.alias("o"), F.col("id"), F.col("source_post_id").alias("post")))).alias("g"))
    names = F.transform("g", lambda x: x["id"])
    groups = groups.select("profile", F.col("exact_fingerprint").alias("fingerprint"), F.element_at(names, 1).alias("kept_id"), F.slice(names, 2, F.size("g")).alias("duplicate_ids"), F.transform("g", lambda x: x["post"]).alias("source_post_ids"), F.size("g").alias("count"))
    kept = rows.join(groups.select(F.col("kept_id").alias("id"), F.col("count").alias("duplicate_count"), F.slice("source_post_ids", 2, F.col("count")).alias("duplicate_source_ids")), "id")
    return kept, groups.where("count > 1")


def split(kept: DataFrame, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """kept with `split`: of each profile, examples that share a post, a conversation or a loose fingerprint stay together; components in order of their last date."""
    own = lambda keys: F.transform(keys, lambda k: F.concat(F.col("profile"), F.lit("\x1f"), k))
    rows = linked_by_keys(kept, "id", {"post": own(F.col("all_post_ids")), "conv": own(F.col("conversation_keys")), "loose": own(F.array("loose_fingerprint"))})
    groups = rows.groupBy("profile", "component").agg(F.max("at").alias("last"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = prefix_split(groups, [F.col("last"), F.col("first")], "n", train, validation, within=["profile"])
    return rows.join(parts.select("profile", "component", "split"), ["profile", "component"]).drop("component")


def public(kept: DataFrame, portable: bool) -> DataFrame:
    """The published form of examples."""
    meta = ["date", "conversation_id", "source_post_id", "context_post_ids", "direct_parent_id", "direct_parent_username", "context_depth", "quality_tier", "has_media_context", "has_media_response", "target_lang", "source_url"]
    names = F.col("mention_map") if portable else F.create_map().cast("map<string,string>")
    return kept.select("id", "profile", "task", F.col("messages_portable" if portable else "messages_verbatim").alias("messages"), F.struct(*meta, names.alias("mention_map"), "duplicate_count", "duplicate_source_ids").alias("metadata"))


def fan_out(kept: DataFrame) -> DataFrame:
    """Each example once for every variant and tier it belongs to, with columns to partition files by."""
    tiers = F.when(F.col("quality_tier") == "core_text", F.array(F.lit("core"), F.lit("extended"))).otherwise(F.array(F.lit("extended")))
    parts = [public(kept, v == "portable").join(kept.select("id", "split", F.explode(tiers).alias("tier")), "id").withColumn("variant", F.lit(v)) for v in ("portable", "verbatim")]
    return parts[0].withColumn("metadata", F.to_json("metadata")).unionByName(parts[1].withColumn("metadata", F.to_json("metadata")))


def queue_records(rows: DataFrame) -> DataFrame:
    """Routed posts that wait in a queue, for review."""
    text = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), F.lit(""))
    return rows.where(~F.col("route").isin("example", "self_thread")).select(F.concat(F.lit("queue:"), "id").alias("id"), F.col("route").alias("queue"), F.col("username").alias("profile"), F.col("id").alias("source_post_id"), F.col("kind").alias("task_source"), "reason", F.col("text_clean").alias("observed_output"), F.col("text_class").alias("output_class"), "date", F.col("group_id").alias("conversation_id"), text("parent", "text_clean").alias("known_parent_text"), text("parent", "username").alias("known_parent_username"), text("quoted", "text_clean").alias("known_quote_text"), text("quoted", "username").alias("known_quote_username"), "media", F.lit("unreviewed").alias("review_status"))


def self_threads(rows: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """Continuations of one's own posts, with the chain of ids before them."""
    linked = chains(known.select("id", "parent_id"), "id", "parent_id", most).select("id", "chain")
    own = rows.where("route = 'self_thread'").join(linked, "id")
    quote = (F.col("kind") != "reply") & (F.col("parent_id") == "")
    return own.select(F.concat(F.when(quote, "self-quote:").otherwise("self-thread:"), "id").alias("id"), F.col("username").alias("profile"), F.when(quote, "self_quote_commentary").otherwise("self_thread_continuation").alias("task"), F.when(quote, F.array("quote_id")).otherwise(F.slice("chain", 1, F.size("chain") - 1)).alias("context_post_ids"), F.col("text_clean").alias("continuation"), "date", F.col("group_id").alias("conversation_id"), F.lit(True).alias("not_in_canonical_sft"))


def corpus(posts: DataFrame) -> DataFrame:
    """Every usable text a profile wrote."""
    return posts.where(F.col("text_class").isin(*C.RESPONSES)).select(F.concat(F.lit("corpus:"), "id").alias("id"), F.col("username").alias("profile"), F.col("text_clean").alias("text"), "date", "kind", "lang", F.col("group_id").alias("conversation_id"), "text_class", "media", "url")


CLASSES = ("substantive", "emoji_or_symbol", "punctuation_reaction", "mention_only", "link_only", "media_only", "media_or_low_information", "other_low_information", "empty", "unintelligible")


def profile_counts(rows: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of counts a profile: routes, kinds and classes of posts, what became of replies and quotes, examples before and after dedup, distinct partners."""
    reply = ((F.col("kind") == "reply") | (F.col("parent_id") != "")) & (F.col("route") != "corrupt")
    quote = ~reply & ((F.col("kind") == "quote") | (F.col("quote_id") != "")) & (F.col("route") != "corrupt")
    why, own = F.coalesce("reason", F.lit("")), F.col("route") == "self_thread"
    fates = {
        "replies_total": reply, "replies_missing_parent": why == "missing_direct_parent", "replies_parent_found": reply & (why != "missing_direct_parent"), "self_thread_replies": reply & own, "replies_unusable_response": why.startswith("unusable_response_"), "replies_unusable_parent": why.startswith("unusable_parent_"),
        "quotes_total": quote, "quotes_missing_source": why == "missing_quoted_source", "self_quote_commentary": quote & own, "standalone_prompt_queue": why == "standalone_no_observed_prompt", "_chosen_replies": reply & (F.col("route") == "example"),
    }
    at = lambda c, v: F.count_if(F.col(c) == v)
    posts = rows.groupBy(F.col("username").alias("profile")).agg(F.count(F.lit(1)).alias("authored_posts"), *[at("kind", k).alias(f"authored_kind_{k}") for k in ("tweet", "reply", "quote")], *[at("route", r).alias(f"route_{r}") for r in ("example", "self_thread", "prompt", "multimodal", "low_information", "corrupt")], *[at("text_class", c).alias(f"authored_class_{c}") for c in CLASSES], *[F.count_if(c).alias(name) for name, c in fates.items()])
    raw = found.groupBy("profile").agg(F.count(F.lit(1)).alias("sft_raw"), *[at("task", t).alias(f"sft_{t}") for t in ("external_reply_oneshot", "external_reply_multiturn", "quote_commentary")])
    authors = kept.select("profile", F.explode("external_authors").alias("a")).groupBy("profile").agg(F.count_distinct(F.lower("a")).alias("unique_external_authors"))
    done = kept.groupBy("profile").agg(F.count(F.lit(1)).alias("sft_deduplicated"), at("quality_tier", "core_text").alias("sft_core"))
    out = posts.join(raw, "profile", "left").join(done, "profile", "left").join(authors, "profile", "left").na.fill(0)
    out = out.withColumn("sft_extended", F.col("sft_deduplicated")).withColumn("sft_exact_duplicates_removed", F.col("sft_raw") - F.col("sft_deduplicated"))
    return out.withColumn("reply_chain_not_representable", F.col("_chosen_replies") - F.col("sft_external_reply_oneshot") - F.col("sft_external_reply_multiturn")).drop("_chosen_replies")


def built(authored_rows: DataFrame, cached_rows: DataFrame, most: int = 8) -> dict[str, DataFrame]:
    """The whole build of all profiles' datasets, in one job for all: kept examples with splits, duplicate groups, queues, self threads, corpus and counts."""
    authored, cached = normalized(authored_rows, "authored"), normalized(cached_rows, "parent_cache")
    known = written(nodes(authored, cached), "nodes")
    posts = written(authored, "posts")
    found = written(examples(posts, known, most), "found")
    kept, groups = deduplicated(found)
    rows = written(routed(posts, known), "routed")
    kept = written(split(kept), "split")
    return {"examples": kept, "duplicates": groups, "queues": queue_records(rows), "self_threads": self_threads(rows, known, most), "corpus": corpus(posts), "counts": profile_counts(rows, found, kept)}


def prepared(rows: DataFrame, wanted: Column) -> DataFrame:
    """Published examples as training rows: clean messages, reject_reason (null if usable), response, prompt, low_info, quality, keys."""
    said = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), T.response_text(m["content"]).alias("content")))
    out = rows.withColumn("messages", C.clean_messages(said))
    out = out.withColumn("response", F.try_element_at("messages", F.lit(-1))["content"]).withColumn("prompt", C.last_prompt(F.col("messages")))
    out = out.withColumn("reject_reason", C.reject_reason(F.col("messages"), F.col("profile"), wanted, C.synthetic(F.col("metadata.quality_tier"), F.lit(False)), F.col("metadata.has_media_response")))
    out = out.withColumn("low_info", C.low_information(F.col("response"))).withColumn("response_key", T.token_key(F.col("response"))).withColumn("pair_key", F.concat(T.token_key(F.col("prompt")), F.lit("\n=>\n"), T.token_key(F.col("response"))))
    depth = F.coalesce(F.nullif(F.col("metadata.context_depth"), F.lit(0)), F.lit(1))
    out = out.withColumn("quality", C.quality(F.coalesce("task", F.lit("")), depth, T.word_count(F.col("response")), T.word_count(F.col("prompt")), F.col("metadata.has_media_context"), F.col("low_info")))
    return out.withColumn("split_group", F.coalesce(T.blank_to_null(F.col("metadata.conversation_id")), T.blank_to_null(F.col("metadata.direct_parent_id")), F.col("id")))


def capped(rows: DataFrame, most: int = 1200, within: tuple[str, ...] = ()) -> DataFrame:
    """Training rows with few repeats of a reply, few of low information, and `most` at most, dealt evenly over language, task and length; for each group of `within`."""
    order = [F.col("quality").desc(), F.col("id")]
    few = F.col("response_key").isin(*T.LOW_INFORMATION) | (F.size(F.filter(F.split("response_key", " "), lambda x: x != "")) <= 2)
    rows = capped_low(top_k_per_key(rows, [*within, "response_key"], order, F.when(few, 4).otherwise(12)), "low_info", order, within=within)
    if not within and rows.count() <= most:
        return rows
    bucket = F.concat_ws("|", F.coalesce("metadata.target_lang", F.lit("unknown")), F.coalesce(F.nullif("task", F.lit("")), F.lit("other")), F.least(F.lit(5), F.floor(T.word_count(F.col("response")) / 20)).cast("string"))
    return round_robin(rows.withColumn("bucket", bucket), ["bucket"], order, most, within).drop("bucket")


def filtered_splits(train: DataFrame, validation: DataFrame, test: DataFrame, profile: str | None, most: int = 1200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usable rows, the best of each pair, without leaks from held-out rows, train capped. Without a profile, each row is judged within its own."""
    parts, own = [], ("profile",) if profile is None else ()
    wanted = F.col("profile") if profile is None else F.lit(profile)
    scoped = lambda c: F.concat(F.lower("profile"), F.lit("\x1f"), c) if own else c
    for part in (train, validation, test):
        usable = prepared(part, wanted).where("reject_reason IS NULL")
        usable = usable.withColumn("_group", scoped(F.col("split_group"))).withColumn("_reply", scoped(F.col("response_key")))
        parts.append(written(best_per_key(usable, [*own, "pair_key"], [F.col("quality").desc(), F.col("id")]), "usable"))
    train, validation = pruned_splits(parts[0], parts[1], parts[2], ["_group", "_reply"])
    return tuple(p.drop("_group", "_reply") for p in (capped(train, most, own), validation, parts[2]))


def planned(published: DataFrame, config: DataFrame, accumulate: int = 8, most: int = 1200) -> DataFrame:
    """A plan row for each profile of config (profile, max_steps), from published examples with `split`: all profiles in one job.

    status is ready, or error with the reason: an error of one profile takes no other with it.
    """
    part = lambda name: published.where(F.col("split") == name).drop("split")
    sides = dict(zip(("train", "validation", "test"), filtered_splits(part("train"), part("validation"), part("test"), None, most)))
    out = config.withColumn("_key", F.lower("profile"))
    seen = published.groupBy(F.lower("profile").alias("_key")).agg(F.count(F.lit(1)).alias("published_rows"))
    out = out.join(seen, "_key", "left")
    for name, rows in sides.items():
        counts = [F.count(F.lit(1)).alias(f"{name}_rows")]
        if name == "train":
            counts += [F.count_if("low_info").alias("low_information_retained"), F.count_if(F.col("task") == "external_reply_multiturn").alias("multiturn_retained"), F.median(T.word_count(F.col("response"))).cast("double").alias("median_response_words")]
        out = out.join(rows.groupBy(F.lower("profile").alias("_key")).agg(*counts), "_key", "left")
    out = out.fillna(0, ["published_rows", *[f"{n}_rows" for n in sides]])
    empty = (F.col("train_rows") == 0) | (F.col("validation_rows") == 0) | (F.col("test_rows") == 0)
    why = F.when(F.col("published_rows") == 0, F.concat(F.lit("no examples of "), F.col("profile"))).when(empty, F.concat(F.lit("an empty split for "), F.col("profile"), F.lit(": train="), F.col("train_rows"), F.lit(", validation="), F.col("validation_rows"), F.lit(", test="), F.col("test_rows")))
    steps = F.when(F.coalesce("max_steps", F.lit(0)) > 0, F.col("max_steps")).otherwise(T.training_steps(F.col("train_rows"))).cast("bigint")
    out = out.withColumn("error", why).withColumn("status", F.when(F.col("error").isNull(), "ready").otherwise("error"))
    return out.withColumn("max_steps", F.when(F.col("error").isNull(), steps)).withColumn("estimated_microbatches", F.col("max_steps") * accumulate).drop("_key", "published_rows")


def split_group_keys(rows: DataFrame) -> DataFrame:
    """rows (response_key, split_group) with `group_key`: the response where others have it too, else the conversation."""
    often = rows.where("response_key <> ''").groupBy("response_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(often, "response_key", "left").withColumn("group_key", F.when(F.col("_n").isNotNull(), F.concat(F.lit("response:"), "response_key")).otherwise(F.concat(F.lit("conversation:"), "split_group"))).drop("_n")


def training_json(rows: DataFrame) -> DataFrame:
    """(id, json): prepared rows as one JSON object each."""
    return rows.select("id", F.to_json(F.struct("id", "profile", "messages", "task", "quality", "low_info", "metadata")).alias("json"))


def microbatches(train: DataFrame, anchors: DataFrame, replay: list[str], boundary: list[tuple[str, str]], steps: int, accumulate: int, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """(place, source_kind, row_id, messages): a training run's microbatches, mixed by the ratios of replay, boundary and anchors.

    train (id, quality, messages) is drawn by quality (0.05 at least), anchors (id, messages) evenly, both with replacement;
    replay prompts and boundary pairs are taken in turn. The order is that of hashes of the seed.
    """
    spark = train.sparkSession
    said = "array<struct<role:string,content:string>>"
    mix = mix_counts(steps, accumulate, *ratios, anchors=not anchors.isEmpty())
    plain = lambda m: F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).cast(said).alias("messages")
    drawn = [weighted_draws(train.select("id", "quality", "messages"), F.greatest(F.lit(0.05), F.col("quality")), "id", mix["persona"], seed).select(F.lit("persona").alias("source_kind"), "draw", F.col("id").cast("string").alias("row_id"), plain(F.col("messages")))]
    if mix["anchor"]:
        drawn.append(weighted_draws(anchors.select("id", "messages"), F.lit(1.0), "id", mix["anchor"], seed + 1).select(F.lit("anchor").alias("source_kind"), "draw", F.col("id").cast("string").alias("row_id"), plain(F.col("messages"))))
    fixed = {"replay": [[("user", p)] for p in replay], "boundary": [[("user", p), ("assistant", r)] for p, r in boundary]}
    for kind, rows in fixed.items():
        few = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], f"_i bigint, messages {said}")
        drawn.append(by_turn(spark.range(mix[kind]).withColumnRenamed("id", "draw"), few, "draw", "_i", len(rows)).select(F.lit(kind).alias("source_kind"), "draw", F.concat(F.lit(f"{kind}:"), F.col("_i").cast("string")).alias("row_id"), "messages"))
    out = drawn[0]
    for part in drawn[1:]:
        out = out.unionByName(part)
    return placed(out, [F.xxhash64("source_kind", "draw", F.lit(seed)), F.col("source_kind"), F.col("draw")]).drop("before", "draw")


def without_heldout_responses(anchors: DataFrame, held: DataFrame) -> DataFrame:
    return without_leaks(anchors, held, ["response_key"])


def truncated(prefix: Column, target: Column, max_length: int, max_target: int) -> Column:
    """Token ids of context and target within a budget: a long target keeps its head and last token, the context its tail."""
    head = lambda c, n: F.when(F.size(c) > n, F.concat(F.slice(c, 1, n - 1), F.slice(c, -1, 1))).otherwise(c)
    kept = head(head(target, max_target), max_length - min(96, max_length // 4))
    room = F.lit(max_length) - F.size(kept)
    context = F.when(F.size(prefix) > room, F.slice(prefix, F.size(prefix) - room + 1, room)).otherwise(prefix)
    return F.struct(F.concat(context, kept).alias("input_ids"), F.concat(F.transform(context, lambda _: F.lit(-100)), kept).alias("labels"))


def mix_counts(steps: int, accumulate: int, replay: float, boundary: float, anchor: float, anchors: bool) -> dict[str, int]:
    """How many microbatches of each kind; rounded half to even."""
    total = steps * accumulate
    out = {"replay": max(1, round(total * replay)), "boundary": max(1, round(total * boundary)), "anchor": max(1, round(total * anchor)) if anchors else 0}
    out["persona"] = total - sum(out.values())
    if out["persona"] <= 0:
        raise ValueError("the ratios leave no persona batches")
    return out
