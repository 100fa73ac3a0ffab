"""Queries of single functions and small operators over whole tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import exports as E
from ..operators import posts as P
from ..operators import select as S
from ..operators import vectors as V
from ..streaming import stateful as R
from .registry import query
from .table_queries import DIRECTION, vectors
from .text_queries import WORD, table

#: DuckDB's lower and Spark's fold differ in one letter of the test tables.
FOLD = "replace(lower(text), 'ß', 'ss')"
KEY = f"array_to_string(regexp_extract_all({FOLD}, '{WORD}'), ' ')"


@query("listed_cells", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '|' || lang WHEN 1 THEN source WHEN 2 THEN lang || '|' || source ELSE '' END AS items, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n FROM documents")
def listed_cells(spark, sf_dir):
    """Lists written as JSON, in Python's way, blank and broken."""
    cell = F.when(F.col("doc_id") % 4 == 0, F.format_string('["%s","%s"]', "source", "lang")).when(F.col("doc_id") % 4 == 1, F.format_string("['%s']", "source")).when(F.col("doc_id") % 4 == 2, F.format_string("['%s', '%s']", "lang", "source")).otherwise("[broken")
    found = T.parse_list(cell)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "|").alias("items"), F.size(found).alias("n"))


@query("lenient_times", "SELECT event_id, strftime(CASE event_id % 4 WHEN 3 THEN TIMESTAMP '0001-01-01' ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def lenient_times(spark, sf_dir):
    """Times with Z, with an offset, without a zone, and junk."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    cell = F.when(F.col("event_id") % 4 == 0, F.concat(at, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), at, F.lit("+02:00"))).when(F.col("event_id") % 4 == 2, at).otherwise("yesterday")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(T.timestamp(cell), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("username_keys", "SELECT c_custkey, lower(c_name) AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'c_' || c_custkey WHEN c_custkey % 5 = 2 THEN NULL ELSE 'C' || c_custkey END AS handle FROM customer")
def username_keys(spark, sf_dir):
    n = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 5 == 0, "con").when(F.col("c_custkey") % 5 == 1, F.concat(F.lit(" @c_"), n, F.lit(" "))).when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("a-"), n)).otherwise(F.concat(F.lit("C"), n))
    return table(spark, sf_dir, "customer").select("c_custkey", T.username_key(F.concat(F.lit(" @@"), "c_name", F.lit(" "))).alias("key"), T.handle(raw).alias("handle"))


@query("media_counts", "SELECT doc_id, doc_id % 3 AS images, doc_id % 2 AS videos, doc_id % 3 + doc_id % 2 > 0 AS has_media, doc_id % 5 AS links, doc_id % 5 > 0 AS has_links FROM documents")
def media_counts(spark, sf_dir):
    many = lambda n: F.array_repeat(F.lit("x"), (F.col("doc_id") % n).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.media(many(3), many(2), F.lit(None).cast("array<string>"), many(5)).alias("m"))
    as_long = lambda c: F.col(f"m.{c}").cast("bigint").alias(c)
    return rows.select("doc_id", as_long("images"), as_long("videos"), "m.has_media", as_long("links"), "m.has_links")


@query("link_marker_lists", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<LINK:youtube>' WHEN 1 THEN '<LINK:x>|<LINK>' ELSE '<LINK:' || h || '>|<LINK:spotify>' END AS markers FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www[.]', '') AS h FROM pages)")
def link_marker_lists(spark, sf_dir):
    lit = F.lit
    links = F.when(F.col("page_id") % 3 == 0, F.array(lit("https://youtu.be/a"), lit("https://www.youtube.com/b"))).when(F.col("page_id") % 3 == 1, F.array(lit("https://twitter.com/a/1"), lit("no url"), lit("https://x.com/b"))).otherwise(F.array(F.col("url"), F.col("url"), lit("https://open.spotify.com/t")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.link_markers(links), "|").alias("markers"))


@query("canonical_texts", f"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({FOLD}, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ' || chr(10))) AS exact,
sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({FOLD}, '(^|[^\\p{{L}}\\p{{N}}_@])@[A-Za-z0-9_]{{1,50}}', '\\1@user', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])[0-9]+([.,][0-9]+)?($|[^\\p{{L}}\\p{{N}}_])', '\\1<n>\\3', 'g'), '[^\\p{{L}}\\p{{N}}_\\s@<>]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS loose
FROM documents WHERE NOT regexp_matches(text, '[0-9@+]')""")
def canonical_texts(spark, sf_dir):
    """Documents without numbers or mentions: around those the two engines' words end at other places."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return table(spark, sf_dir, "documents").where(~F.col("text").rlike("[0-9@+]")).select("doc_id", sha(T.exact_key(F.col("text"))).alias("exact"), sha(T.loose_key(F.col("text"))).alias("loose"))


@query("stable_hashes", "SELECT doc_id, CAST(CAST('0x' || substr(sha256(source || doc_id), 1, 16) AS UBIGINT) AS VARCHAR) AS hash, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS json_sha FROM documents WHERE lang IS NOT NULL")
def stable_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return rows.select("doc_id", T.stable_hash(F.concat("source", F.col("doc_id").cast("string"))).cast("string").alias("hash"), T.json_sha(F.col("doc_id"), F.col("lang")).alias("json_sha"))


COUNTED = "CAST(len(regexp_extract_all({}, '{}')) AS DOUBLE)"


@query("style_pairs", f"""
WITH v AS (SELECT conv_id, turn, [{COUNTED.format('text', '!')} / greatest(1, length(text)), {COUNTED.format('text', '[?]')} / greatest(1, length(text)), {COUNTED.format('text', '[.]')} / greatest(1, length(text)), {COUNTED.format('text', '[0-9]')} / greatest(1, length(text))] AS v FROM conversations),
p AS (SELECT conv_id, turn, v, lag(v) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM v)
SELECT conv_id, turn, round(1 / (1 + 8 * sqrt(pow(v[1] - u[1], 2) + pow(v[2] - u[2], 2) + pow(v[3] - u[3], 2) + pow(v[4] - u[4], 2))), 9) AS similarity FROM p WHERE u IS NOT NULL""")
def style_pairs(spark, sf_dir):
    """How alike each turn and the one before are in the four signs that both engines count alike."""
    from pyspark.sql import Window

    v = T.style(F.col("text"))
    rows = table(spark, sf_dir, "conversations").withColumn("v", F.array(v[1], v[2], v[3], v[7]))
    rows = rows.withColumn("u", F.lag("v").over(Window.partitionBy("conv_id").orderBy("turn"))).where("u IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(T.style_similarity(F.col("v"), F.col("u")), 9).alias("similarity"))


@query("scenario_turns", "SELECT c_custkey, 'user' AS role, 'I am ' || c_name AS content, 0 AS place FROM customer UNION ALL SELECT c_custkey, 'assistant', 'hello', 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'system', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END FROM customer")
def scenario_turns(spark, sf_dir):
    text = F.concat(F.lit("[User]: I am "), "c_name", F.when(F.col("c_custkey") % 2 == 0, " [Assistant]:  hello ").otherwise(" [Assistant]:  "), F.lit("[System]:"), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(T.scenario_messages(text)).alias("place", "m")).select("c_custkey", "m.role", "m.content", "place")


@query("axis_names", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN p_type WHEN p_partkey % 7 = 0 THEN 'Concepts' WHEN p_partkey % 7 = 1 THEN 'Pain research' WHEN p_partkey % 7 = 2 THEN 'Emotions and affect' WHEN p_partkey % 7 = 3 THEN 'Bodily sensations' WHEN p_partkey % 7 = 4 THEN 'Research controls' ELSE 'Concepts' END AS grp, CASE p_partkey % 7 WHEN 1 THEN 'pain_s2' WHEN 2 THEN 'fear' WHEN 3 THEN 'warmth' ELSE NULL END AS lexicon FROM part")
def axis_names(spark, sf_dir):
    names = ["concept_bridge", "pain_back", "state_terror", "state_physical_warmth", "paper_numb", "other", "golden_gate"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 7 + 1).cast("int"))
    own = F.when(F.col("p_partkey") % 7 == 6, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.axis_group(name, F.when(F.col("p_partkey") % 7 == 6, "recipe.json"), own).alias("grp"), T.lexicon_target(name).alias("lexicon"))


@query("best_variants", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'c' WHEN o_orderkey % 3 = 1 THEN 'b' ELSE 'c' END AS url FROM orders")
def best_variants(spark, sf_dir):
    v = lambda rate, url: F.struct(rate.cast("bigint").alias("bitrate"), F.lit(url).alias("url"))
    k, none = F.col("o_orderkey") % 3, F.lit(None)
    variants = F.array(v(none, "a"), v(F.when(k == 1, 900).otherwise(100), "b"), v(F.when(k == 2, 100).when(k == 0, 100).otherwise(none), "c"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.best_variant(variants)["url"].alias("url"))


@query("post_kinds", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'repost' WHEN o_orderkey % 3 = 0 THEN 'reply' WHEN o_orderkey % 2 = 0 THEN 'quote' ELSE 'tweet' END AS kind, o_orderkey % 7 <> 0 AND o_custkey % 2 = 0 AS own FROM orders")
def post_kinds(spark, sf_dir):
    when = lambda n, v: F.when(F.col("o_orderkey") % n == 0, v)
    kind = T.post_kind(when(7, "r"), when(3, "p").otherwise(""), when(2, "q"))
    who = F.when(F.col("o_custkey") % 2 == 0, "WRITER").otherwise("reader")
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), C.own_post(who, F.lit("Writer"), kind).alias("own"))


@query("evaluated", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN NULL ELSE CAST((l_partkey + 2) * 3 - l_suppkey % 7 AS DOUBLE) / l_linenumber END AS value FROM lineitem")
def evaluated(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 7, F.lit("2 ** 3")).when(F.col("l_linenumber") == 6, F.lit("1 / (3 - 3)")).otherwise(F.format_string("((%d + 2) * 3 - %d %% 7) / %d", "l_partkey", "l_suppkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.arithmetic(text).alias("value"))


@query("tool_proposals", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'calculator' WHEN 1 THEN 'read_note' END AS tool FROM customer")
def tool_proposals(spark, sf_dir):
    n = F.col("c_custkey").cast("string")
    said = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('{"tool": "calculator", "arguments": {"expression": "'), n, F.lit('+1"}}'))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('```json\n{"arguments": {"name": "'), n, F.lit('.txt"}, "tool": "read_note"}\n```'))).when(F.col("c_custkey") % 4 == 2, F.lit('{"tool": "shell", "arguments": {}}')).otherwise(F.lit('{"tool": "calculator", "arguments": {}, "more": 1}'))
    return table(spark, sf_dir, "customer").select("c_custkey", T.tool_proposal(said)["tool"].alias("tool"))


@query("equal_contents", "SELECT doc_id, doc_id % 3 <> 2 AS same FROM documents WHERE text IS NOT NULL")
def equal_contents(spark, sf_dir):
    text = F.concat("text", F.lit("\nend"))
    other = F.when(F.col("doc_id") % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, text).otherwise(F.concat(text, F.lit(".")))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.same_content(text.cast("binary"), other.cast("binary")).alias("same"))


@query("profile_names", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'run' || s_suppkey END AS profile, CASE WHEN s_suppkey % 2 = 0 THEN 'main.py' ELSE 'assets/docs/a.md' END AS packaged FROM supplier")
def profile_names(spark, sf_dir):
    reported, n = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), "s_name")).otherwise(" "), F.col("s_suppkey").cast("string")
    directory = F.concat(F.lit("run"), n, F.when(F.col("s_suppkey") % 3 == 1, "-LoRA").otherwise("_final"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.profile_name(reported, directory).alias("profile"), T.packaged_path(F.when(F.col("s_suppkey") % 2 == 0, "main.py").otherwise("docs/a.md"), "assets").alias("packaged"))


@query("mention_roles", "SELECT conv_id, turn, '<SELF> said to <PARENT>, <USER>: a@b ' || text || ' <USER>' AS text FROM conversations WHERE NOT contains(text, '@')")
def mention_roles(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("@")))
    roles = F.array(F.array(F.lit("me"), F.lit("<SELF>")), F.array(F.lit("you"), F.lit("<PARENT>")))
    return rows.select("conv_id", "turn", T.roles_for_mentions(F.concat(F.lit("@Me said to @you, @nobody: a@b "), "text", F.lit(" @they")), roles).alias("text"))


@query("response_texts", f"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g') || chr(10) || 'see link [media]' AS text FROM conversations WHERE NOT regexp_matches(text, '[<@]|^[ :,-]|(^|\\n) | ($|\\n)')")
def response_texts(spark, sf_dir):
    """Recorded turns with routing, mentions, role and link tokens before and after, which all go."""
    rows = table(spark, sf_dir, "conversations").where(~F.col("text").rlike("[<@]|^[ :,-]|(^|\n) | ($|\n)"))
    said = F.concat(F.lit("<SELF> <PARENT> [replying to <USER_2>]: @a @b: "), "text", F.lit("\r\n\r\n<USER>see <LINK:x>  <MEDIA:photo>"))
    return rows.select("conv_id", "turn", T.response_text(said).alias("text"))


@query("text_predicates", f"""
WITH t AS (SELECT conv_id, turn, text, {KEY} AS key, len(regexp_extract_all(text, '{WORD}')) AS words FROM conversations),
l AS (SELECT *, key IN ('yes', 'no', 'yeah', 'yep', 'nope', 'ok', 'okay', 'sure', 'true', 'real', 'lol', 'lmao', 'lmfao', 'thanks', 'thank you', 'what', 'why', 'huh', 'same') OR words <= 1 OR (words <= 2 AND length(text) <= 12) AS low FROM t)
SELECT conv_id, turn, low, CASE WHEN conv_id % 3 = 0 THEN true WHEN conv_id % 3 = 1 THEN true ELSE false END AS synthetic, CASE WHEN length(trim(text, ' ' || chr(10) || chr(9))) BETWEEN 2 AND 300 AND NOT contains(trim(text, ' ' || chr(10) || chr(9)), chr(10)) THEN trim(text, ' ' || chr(10) || chr(9)) END AS query FROM l""")
def text_predicates(spark, sf_dir):
    tier = F.when(F.col("conv_id") % 3 == 0, "Synthetic_v2").otherwise("core_text")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", C.low_information(F.col("text")).alias("low"), C.synthetic(tier, F.col("conv_id") % 3 == 1).alias("synthetic"), C.query_text(F.col("text")).alias("query"))


@query("release_faults", r"""
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'path' WHEN 1 THEN 'generated' WHEN 2 THEN 'private' WHEN 3 THEN 'private' WHEN 4 THEN 'path'
ELSE CASE WHEN doc_id % 8 = 5 OR regexp_matches(text, '(gh[pousr]_|github_pat_)[A-Za-z0-9_]{30,}|-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----|(auth_token|ct0)\s*=\s*[A-Fa-f0-9]{32,}') THEN 'secret' WHEN doc_id % 8 = 6 OR regexp_matches(text, '([A-Za-z]:[\\/]+Users[\\/]+|/home/|/Users/)[A-Za-z0-9_.-]+') THEN 'user_path' END END AS fault FROM documents""")
def release_faults(spark, sf_dir):
    names = ["../up.md", "runs/a.txt", "models/a.GGUF", "docs/.env.local", "/root.md", "docs/a.md", "docs/b.md", "docs/c.md"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 8 + 1).cast("int"))
    content = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 8 == 5, " ghp_" + "a" * 36).when(F.col("doc_id") % 8 == 6, " /home/someone").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", C.release_fault(name, content).alias("fault"))


@query("rejections", f"""
WITH m AS (SELECT conv_id, turn, text, lag(text) OVER w AS before, role, lag(role) OVER w AS before_role FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'synthetic' WHEN conv_id % 5 = 1 THEN 'other_profile' WHEN role <> 'assistant' THEN 'no_reply' WHEN before_role <> 'user' THEN 'no_prompt' WHEN conv_id % 5 = 2 AND len(regexp_extract_all(text, '{WORD}')) < 8 THEN 'media_reply_too_short' WHEN len(regexp_extract_all(text, '{WORD}')) > 300 THEN 'reply_too_long' WHEN len(regexp_extract_all(before, '{WORD}')) > 700 THEN 'prompt_too_long' END AS reason
FROM m WHERE before IS NOT NULL AND trim(text) <> '' AND trim(before) <> ''""")
def rejections(spark, sf_dir):
    """Each turn with the one before, as a row that might train."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").withColumn("before", F.lag("text").over(w)).withColumn("before_role", F.lag("role").over(w))
    rows = rows.where("before IS NOT NULL AND trim(text) <> '' AND trim(before) <> ''")
    said = lambda role, text: F.struct(F.col(role).alias("role"), F.col(text).alias("content"))
    messages = C.clean_messages(F.array(said("before_role", "before"), said("role", "text")))
    k = F.col("conv_id") % 5
    return rows.select("conv_id", "turn", C.reject_reason(messages, F.when(k == 1, "someone").otherwise("WRITER"), F.lit("Writer"), k == 0, k == 2).alias("reason"))


@query("response_flags", "SELECT doc_id, trim(coalesce(text, '')) = '' AS empty, CAST(regexp_matches(text, '(?i)token =') AS BIGINT) + CAST(regexp_matches(text, '(?i)license') AS BIGINT) AS generic, CASE doc_id % 3 WHEN 0 THEN regexp_matches(text, '(?i)the') WHEN 1 THEN contains(lower(text), 'den') OR contains(lower(text), 'que') END AS expected FROM documents")
def response_flags(spark, sf_dir):
    checks = C.response_checks(F.col("text"), ("token =", "license"), ("i am \\d+",), ("both sides",), F.when(F.col("doc_id") % 3 == 0, "the"), F.when(F.col("doc_id") % 3 == 1, F.array(F.lit("DEN"), F.lit("que"))), F.lit("x"))
    rows = table(spark, sf_dir, "documents").select("doc_id", checks.alias("c"))
    return rows.select("doc_id", "c.empty", F.size("c.generic_markers").cast("bigint").alias("generic"), F.col("c.expected_pass").alias("expected"))


@query("gates", """
SELECT l_orderkey, l_linenumber, l_quantity >= 12 AND l_returnflag = 'A' AND l_linenumber > 3 AS is_specific, l_discount * 10 >= 0.8 AND l_linenumber > 1 AND l_linenumber <> 3 AND l_tax < 0.04 AS installable,
round(CASE WHEN l_discount * 10 >= 0.8 AND l_linenumber > 1 THEN greatest(-3.0, least(3.0, 2.0 - l_tax * 50)) ELSE -100.0 + l_discount * 10 + CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END + 1 + 1 END - CASE WHEN l_linenumber <> 3 THEN 0 ELSE 2.0 END, 6) AS score,
CASE WHEN l_linestatus = 'F' THEN 'other_weights' WHEN l_linenumber = 1 THEN 'not_steered' WHEN l_returnflag = 'N' THEN 'ambiguous_scope' WHEN l_linenumber = 2 THEN 'direction_changed' WHEN l_tax > 0 AND l_linenumber = 3 THEN 'other_sampler' END AS replay FROM lineitem""")
def gates(spark, sf_dir):
    li, c = table(spark, sf_dir, "lineitem"), F.col
    run = lambda hit, terms, score: F.struct(c("l_quantity").alias("tokens"), F.lit("length").alias("stop_reason"), hit.alias("localized_burn_hit"), terms.alias("burn_term_count"), score.alias("target_score"))
    plain = run(F.lit(False), F.lit(3), F.lit(0.0))
    good, no = c("l_discount") * 10, F.lit(0)
    memory, boundary = c("l_linenumber") > 1, c("l_linenumber") != 3
    return li.select(
        "l_orderkey", "l_linenumber", C.specific(run(c("l_returnflag") == "A", c("l_linenumber"), F.lit(1.0)), plain, plain).alias("is_specific"), C.installable(good, memory, boundary, no, no, no, c("l_tax") * 50, F.lit(2.0)).alias("installable"),
        F.round(C.checkpoint_score(F.lit(2.0), c("l_tax") * 50, good, memory, boundary, no, no, no), 6).alias("score"),
        C.replay_fault(c("l_linestatus") != "F", F.array(F.when(c("l_linenumber") == 1, 0.0).otherwise(0.5)), F.when(c("l_returnflag") == "N", "mixed").otherwise("all"), c("l_linenumber") != 2, c("l_tax"), F.when(c("l_linenumber") == 3, "old").otherwise("new"), "new").alias("replay"),
    )


@query("axis_faults", "SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_finite' WHEN 2 THEN 'not_positive' WHEN 3 THEN 'not_a_unit' ELSE NULL END AS fault FROM embeddings")
def axis_faults(spark, sf_dir):
    k, size = F.col("vec_id") % 6, V.norm(F.col("vec"))
    rows = vectors(spark, sf_dir).withColumn("unit", F.transform("vec", lambda x: x / size))
    direction = F.when(k == 0, F.array().cast("array<double>")).when(k == 1, F.array(F.lit(float("nan")))).when(k == 3, F.transform("unit", lambda x: x * 1.001)).otherwise(F.col("unit"))
    return rows.select("vec_id", C.axis_fault(direction, F.lit(0.0), F.when(k == 2, 0.0).otherwise(1.0), F.lit(1.0)).alias("fault"))


@query("recipe_checks", """
WITH p AS (SELECT o_custkey % 30 AS grp, 'p' || o_orderkey AS prompt, 'yes ' || o_orderpriority AS positive, 'no ' || (o_orderkey % 9) AS negative FROM orders WHERE o_orderkey < 200),
k AS (SELECT grp, lower(positive) AS t FROM p UNION ALL SELECT grp, lower(negative) FROM p), r AS (SELECT count(*) FILTER (g > 1) AS n FROM (SELECT t, count(DISTINCT grp) AS g FROM k GROUP BY t))
SELECT count(*) AS pairs, count(DISTINCT lower(positive)) AS positive_distinct, count(DISTINCT lower(negative)) AS negative_distinct, round(avg(length(positive)) / greatest(avg(length(negative)), 1), 9) AS ratio, any_value(r.n) AS reused, CASE WHEN count(*) NOT BETWEEN 20 AND 256 THEN 'pairs' WHEN count(DISTINCT grp) < 20 THEN 'groups' END AS fault FROM p, r""")
def recipe_checks(spark, sf_dir):
    """A recipe of contrast pairs, which has 256 pairs at most."""
    o = table(spark, sf_dir, "orders").where("o_orderkey < 200")
    n = lambda c: c.cast("string")
    pairs = o.select((F.col("o_custkey") % 30).alias("group"), F.concat(F.lit("p"), n(F.col("o_orderkey"))).alias("prompt"), F.concat(F.lit("yes "), "o_orderpriority").alias("positive"), F.concat(F.lit("no "), n(F.col("o_orderkey") % 9)).alias("negative"))
    audit = A.recipe_audit(pairs).select("pairs", "positive_distinct", "negative_distinct", F.round("mean_character_ratio", 9).alias("ratio"), F.col("responses_reused_across_groups").alias("reused"))
    return audit.crossJoin(F.broadcast(A.recipe_faults(pairs).select("fault")))  # one row each


@query("fallback_scales", """
WITH r AS (SELECT l_suppkey, l_tax * 10 AS scale, CAST(l_quantity AS BIGINT) AS tokens, l_discount * 10 AS change FROM lineitem WHERE l_linenumber <= 3),
t AS (SELECT *, CASE WHEN tokens >= 12 AND change < 0.65 THEN 1 WHEN tokens >= 12 AND change < 0.95 THEN 2 WHEN tokens > 0 THEN 3 ELSE 4 END AS tier FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY tier, CASE WHEN tier IN (1, 2) THEN abs(scale - 0.60) ELSE 0 END, change, scale) AS n FROM t)
SELECT l_suppkey, CASE WHEN tier = 4 THEN 0.45 ELSE scale END AS scale, CASE WHEN tier < 3 THEN 'careful and viable' WHEN tier = 3 THEN 'least change' ELSE 'default' END AS reason FROM o WHERE n = 1""")
def fallback_scales(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select("l_suppkey", (F.col("l_tax") * 10).alias("scale"), F.col("l_quantity").cast("bigint").alias("tokens"), F.lit("length").alias("stop_reason"), (F.col("l_discount") * 10).alias("change"), F.lit(True).alias("hit"), F.col("l_linenumber").alias("terms"), F.lit(0.0).alias("score"))
    return A.fallback_scale(runs, ["l_suppkey"])


@query("lexical_changes", "WITH h AS (SELECT source AS grp, lang AS condition, doc_id, len(regexp_extract_all(text, '(?i)the')) AS hits, text FROM documents), b AS (SELECT grp, min(doc_id) AS base FROM h GROUP BY grp), j AS (SELECT h.*, x.hits AS bh, x.text AS bt FROM h JOIN b USING (grp) JOIN h x ON x.doc_id = b.base) SELECT doc_id, CAST(hits AS BIGINT) AS hits, CAST(hits - bh AS BIGINT) AS over, text IS DISTINCT FROM bt AS changed FROM j")
def lexical_changes(spark, sf_dir):
    """The first document of each source is the baseline of the others."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("base"))
    runs = docs.join(first, "source").select(F.col("source").alias("group"), F.when(F.col("doc_id") == F.col("base"), "Baseline").otherwise("x").alias("condition"), F.col("text").alias("answer_text"), F.lit("end").alias("stop_reason"), "doc_id")
    out = A.lexical_changes(runs, "the")
    return out.select("doc_id", F.col("lexical_hits").cast("bigint").alias("hits"), F.col("hits_over_baseline").cast("bigint").alias("over"), F.col("text_changed").alias("changed"))


@query("softmaxed", "WITH m AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings) SELECT vec_id, round(e[1] / list_sum(e), 9) AS first, round(list_max(e) / list_sum(e), 9) AS top FROM m")
def softmaxed(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", A.softmax(F.slice("vec", 1, 8)).alias("p"))
    return rows.select("vec_id", F.round(F.col("p")[0], 9).alias("first"), F.round(F.array_max("p"), 9).alias("top"))


@query("report_rows", "WITH c AS (SELECT c_name AS model_id, CASE c_custkey % 4 WHEN 0 THEN 'RETRAIN' WHEN 1 THEN 'LIKELY_RETRAIN' WHEN 2 THEN 'MANUAL_REVIEW' ELSE 'x' END AS r, c_custkey % 4 AS k FROM customer) SELECT model_id, r AS recommendation, row_number() OVER (ORDER BY CASE k WHEN 3 THEN 9 ELSE k END, lower(model_id)) - 1 AS place FROM c")
def report_rows(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("RETRAIN", "LIKELY_RETRAIN", "MANUAL_REVIEW", "x"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("model_id"), kinds.alias("recommendation"))
    return S.placed(rows, A.report_order()).drop("before")


@query("models_by_base", "SELECT c_nationkey AS base, min(c_custkey) AS first, string_agg(c_name, ',' ORDER BY c_custkey) AS models FROM customer GROUP BY c_nationkey")
def models_by_base(spark, sf_dir):
    out = A.models_by_base(table(spark, sf_dir, "customer"), "c_nationkey", "c_name", "c_custkey")
    return out.select(F.col("c_nationkey").alias("base"), "first", F.array_join("models", ",").alias("models"))


@query("complete_checkpoint", "WITH f AS (SELECT o_custkey, o_orderstatus FROM orders) SELECT 'dir' || max(o_custkey) AS directory, max(o_custkey) AS number FROM (SELECT o_custkey FROM f GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O'))")
def complete_checkpoint(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("dir"), F.col("o_custkey").cast("string")).alias("directory"), F.col("o_orderstatus").alias("name"), "o_custkey")
    return S.highest_complete(files, "directory", "name", F.col("o_custkey"), ["F", "O"])


@query("axis_z", f"WITH {DIRECTION}, p AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), u) AS p FROM embeddings, u) SELECT vec_id, round((p - 0.25) / 2.0, 6) AS z FROM p")
def axis_z(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("layer", F.lit(0))
    axes = V.raw_direction(rows, [], F.col("label") < 5).select(F.lit("a").alias("axis"), F.lit(0).alias("layer"), "direction", F.lit(0.25).alias("center"), F.lit(2.0).alias("scale"), F.lit(1.0).alias("norm"))
    return V.z_scores(rows, axes).select("vec_id", F.round("z", 6).alias("z"))


@query("measured_controls", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS pre, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN i = 1 THEN 0.5 ELSE 0 END) AS post FROM embeddings)
SELECT vec_id, round(pre[1], 9) AS before_projection, round(0.5, 9) AS projection_delta, round(0.5 / greatest(sqrt(list_dot_product(pre, pre)), 1e-12), 9) AS change, round((pre[1] - 0.1) / 2, 9) AS before_z, round(CASE WHEN pre[1] = 0 THEN 0 ELSE pow(2, floor(log2(abs(pre[1]))) - 10) / 2 END, 12) AS tolerance, true AS as_asked FROM e""")
def measured_controls(spark, sf_dir):
    along = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(64)])
    wanted = F.transform(along, lambda x: x * 0.5)
    rows = vectors(spark, sf_dir).select("vec_id", F.col("vec").alias("pre"), F.zip_with("vec", wanted, lambda a, b: a + b).alias("post"), along.alias("direction"), F.lit(0.1).alias("center"), F.lit(2.0).alias("scale"))
    out = V.measured(rows).withColumn("e", V.intervention_error(F.col("pre"), F.col("post"), wanted))
    r = lambda c, name, n=9: F.round(c, n).alias(name)
    return out.select("vec_id", r("before_projection", "before_projection"), r("projection_delta", "projection_delta"), r("change_norm_fraction", "change"), r("before", "before_z"), r(V.storage_tolerance(F.col("pre")[0], 10), "tolerance", 12), (F.col("e.error") <= F.col("e.tolerance")).alias("as_asked"))


PAIRED = """s AS (SELECT a.vec_id, a.vec_id % 2 AS layer, CASE WHEN a.vec_id % 10 < 6 THEN 'train' WHEN a.vec_id % 10 < 8 THEN 'dev' ELSE 'test' END AS part, list_transform(CAST(a.embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN i <= 3 THEN 0.7 ELSE 0 END) AS p, CAST(a.embedding AS DOUBLE[]) AS n FROM embeddings a),
d AS (SELECT layer, list_transform(range(1, 65), lambda i: CASE WHEN i <= 3 THEN 1 / sqrt(3) ELSE 0 END) AS u FROM (SELECT DISTINCT layer FROM s)),
q AS (SELECT s.layer, part, list_dot_product(p, u) AS a, list_dot_product(n, u) AS b FROM s JOIN d USING (layer) WHERE part <> 'train'),
r AS (SELECT x.layer, x.part, avg(CASE WHEN x.a > y.b THEN 1.0 WHEN x.a = y.b THEN 0.5 ELSE 0 END) AS auc FROM q x JOIN q y ON x.layer = y.layer AND x.part = y.part GROUP BY ALL)"""


@query("paired_fits", f"WITH {PAIRED} SELECT layer, round(max(auc) FILTER (part = 'dev'), 6) AS dev_auc, round(max(auc) FILTER (part = 'test'), 6) AS test_auc FROM r GROUP BY layer")
def paired_fits(spark, sf_dir):
    """Responses that differ in three coordinates: that difference is the direction."""
    part = F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "dev").otherwise("test")
    rows = vectors(spark, sf_dir).select("layer", part.alias("part"), F.transform("vec", lambda x, i: x + F.when(i < 3, 0.7).otherwise(0.0)).alias("positive"), F.col("vec").alias("negative"))
    return V.paired_fit(rows).select("layer", F.round("dev_auc", 6).alias("dev_auc"), F.round("test_auc", 6).alias("test_auc"))


@query("reply_coverage", """
WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'tweet' ELSE 'reply' END AS kind, (o_custkey * 7) % 40000 AS parent FROM orders),
g AS (SELECT parent, count(*) AS n, parent IN (SELECT id FROM p) AS inside, parent % 5 = 0 AND parent < 20000 AS cached, parent % 4 = 0 AS gone FROM p WHERE kind = 'reply' GROUP BY parent),
f AS (SELECT *, inside OR cached AS found FROM g)
SELECT (SELECT count(*) FROM p) AS target_records, CAST(sum(n) AS BIGINT) AS replies, count(*) AS unique_parent_ids, count(*) FILTER (found) AS parents_found, count(*) FILTER (inside) AS parents_inside_target_dataset, count(*) FILTER (cached) AS parents_cached_separately, count(*) FILTER (gone) AS parents_unavailable, count(*) FILTER (NOT found AND NOT gone) AS parents_pending,
CAST(coalesce(sum(n) FILTER (found), 0) AS BIGINT) AS replies_with_parent, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS replies_unavailable, CAST(sum(n) - coalesce(sum(n) FILTER (found), 0) - coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS replies_pending, round(100.0 * coalesce(sum(n) FILTER (found), 0) / sum(n), 2) AS coverage_percent FROM f""")
def reply_coverage(spark, sf_dir):
    o, text = table(spark, sf_dir, "orders"), lambda c: c.cast("string")
    posts = o.select(text(F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "tweet").otherwise("reply").alias("kind"), text((F.col("o_custkey") * 7) % 40000).alias("parent_id"))
    ids = spark.range(40000)
    return A.reply_coverage(posts, ids.where("id % 5 = 0 AND id < 20000").select(text(F.col("id")).alias("id")), ids.where("id % 4 = 0").select(text(F.col("id")).alias("id")))


EXPORT = """p AS (SELECT conv_id * 1000 + turn AS id, role AS username, CASE WHEN turn > 0 THEN 'reply' ELSE 'tweet' END AS kind, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS up, text FROM conversations),
mine AS (SELECT * FROM p WHERE username = 'assistant'), cached AS (SELECT * FROM p WHERE username <> 'assistant' AND id % 3 <> 0)"""


@query("reply_context", f"WITH {EXPORT}, k AS (SELECT * FROM cached UNION ALL SELECT * FROM mine) SELECT CAST(m.id AS VARCHAR) AS id, CASE WHEN m.up IS NULL THEN 'not_applicable' WHEN k.id IS NOT NULL THEN 'found' WHEN m.up % 2 = 0 THEN 'deleted' ELSE 'not_fetched' END AS parent_status, k.username AS parent_username, k.text AS parent_text FROM mine m LEFT JOIN k ON k.id = m.up")
def reply_context(spark, sf_dir):
    from .post_queries import exported

    rows = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 1000 + F.col("turn")
    p = rows.select(at.cast("string").alias("id"), F.col("role").alias("username"), F.when(F.col("turn") > 0, "reply").otherwise("tweet").alias("kind"), F.when(F.col("turn") > 0, at - 1).cast("string").alias("in_reply_to_tweet_id"), "text", at.alias("_n"))
    gone = p.where("_n % 2 = 0").select("id", F.lit("deleted").alias("status"), F.lit("").alias("error"), F.lit("").alias("last_attempt"))
    out = E.reply_context(p.where("username = 'assistant'").drop("_n"), p.where("username <> 'assistant' AND _n % 3 <> 0").drop("_n"), gone)
    return out["all"].select("id", "parent_status", "parent_username", "parent_text")


@query("archive_audit", "SELECT 'f' || doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'stale' END AS fault FROM documents WHERE doc_id % 5 < 2")
def archive_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.coalesce("text", F.lit("")).alias("t"))
    theirs = F.when(F.col("doc_id") % 5 == 1, F.concat("t", F.lit("!"))).when(F.col("doc_id") % 5 == 2, F.replace("t", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("t"))
    return E.archive_faults(docs.select("name", F.col("t").cast("binary").alias("content")), docs.where("doc_id % 5 <> 0").select("name", theirs.cast("binary").alias("content")))


@query("history_audit", r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'runs/' || doc_id WHEN doc_id % 6 = 1 THEN 'key' || doc_id || '.pem' ELSE 'docs/' || doc_id || '.md' END AS path, CASE WHEN doc_id % 6 = 2 THEN '120000' ELSE '100644' END AS mode, sha256(coalesce(text, '')) AS blob, coalesce(text, '') AS text FROM documents)
SELECT DISTINCT 'path' AS kind, path AS item, CASE WHEN doc_id % 6 = 0 THEN 'generated' ELSE 'private' END AS fault FROM t WHERE doc_id % 6 < 2 UNION ALL SELECT DISTINCT 'path', path, 'not_regular' FROM t WHERE mode = '120000'
UNION ALL SELECT DISTINCT 'blob', blob, CASE WHEN regexp_matches(text, '(gh[pousr]_|github_pat_)[A-Za-z0-9_]{30,}|-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----|(auth_token|ct0)\s*=\s*[A-Fa-f0-9]{32,}') THEN 'secret' ELSE 'user_path' END FROM t WHERE mode = '100644' AND regexp_matches(text, '(gh[pousr]_|github_pat_)[A-Za-z0-9_]{30,}|-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----|(auth_token|ct0)\s*=\s*[A-Fa-f0-9]{32,}|([A-Za-z]:[\\/]+Users[\\/]+|/home/|/Users/)[A-Za-z0-9_.-]+')""")
def history_audit(spark, sf_dir):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    path = F.when(k == 0, F.concat(F.lit("runs/"), n)).when(k == 1, F.concat(F.lit("key"), n, F.lit(".pem"))).otherwise(F.concat(F.lit("docs/"), n, F.lit(".md")))
    tree = docs.select(path.alias("path"), F.when(k == 2, "120000").otherwise("100644").alias("mode"), "blob")
    return E.history_faults(tree.unionByName(tree), docs.select("blob", F.col("text").cast("binary").alias("content")).dropDuplicates(["blob"]))  # two revisions of one tree


@query("newest_directory", "SELECT 'c' || o_custkey AS directory FROM orders ORDER BY o_orderdate DESC, 'c' || o_custkey DESC LIMIT 1")
def newest_directory(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("file:/data/c"), F.col("o_custkey").cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return E.newest_directory(files, "file:/data").select("directory")


@query("resumed_results", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def resumed_results(spark, sf_dir):
    """Recorded results whose manifest fits; another fingerprint is an error."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return E.compatible(done, spark.range(1).select(F.lit("abc").alias("fingerprint")), "abc")


@query("pattern_gates", """
SELECT s_suppkey, CAST(3 + s_suppkey % 3 AS BIGINT) AS capability_passed, s_suppkey % 2 = 0 AS memory_pass, s_suppkey % 5 = 0 AS boundary_pass, CAST(2 + s_suppkey % 2 AS BIGINT) AS leakage, CAST(s_suppkey % 4 AS BIGINT) AS artifacts, CAST(1 + s_suppkey % 2 AS BIGINT) AS verbose FROM supplier""")
def pattern_gates(spark, sf_dir):
    """Recorded answers of each supplier's model, right, leaking and long by its number."""
    k, long = F.col("s_suppkey"), " ".join(["word"] * 45)
    when = lambda c, a, b: F.when(c, a).otherwise(b)
    said = {
        "arithmetic": F.lit("It is 102."), "capital": F.lit("Paris, of course"), "copy": F.lit("Cedar-482"), "comparison": when(k % 3 >= 1, "0.7", "0.65"), "science": when(k % 3 == 2, "Rayleigh scattering", "magic"),
        "memory": when(k % 2 == 0, "CEDAR 482", "forgot 1020"), "biography": when(k % 5 == 0, "I don't have that", "I am 30"), "hello": F.lit("As an AI, I am happy to help"), "smalltalk": when(k % 2 == 1, F.lit("happy to help " + long), F.lit("fine")),
        "identity": F.concat(F.lit(long), when(k % 4 >= 1, " <think>", ""), when(k % 4 >= 2, " </think>", ""), when(k % 4 == 3, " [think]", "")), "style_resistance": F.lit(long),
    }
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("response")) for n, c in said.items()])).alias("o")).select("s_suppkey", "o.*")
    out = A.pattern_gate(rows, ["s_suppkey"], ["as an ai", "happy to help"], ["<think>", "</think>", r"\[think\]"])
    return out.select("s_suppkey", "capability_passed", "memory_pass", "boundary_pass", F.col("assistant_leakage_count").alias("leakage"), F.col("think_artifact_count").alias("artifacts"), F.col("verbose_flag_count").alias("verbose"))


@query("run_events", """
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
e AS (SELECT user_id, min(n) FILTER (event_type = 'error' OR n = 20) AS stop FROM r GROUP BY user_id),
k AS (SELECT r.* FROM r JOIN e USING (user_id) WHERE stop IS NULL OR n <= stop)
SELECT user_id, event_id, 'token' AS kind, n AS tokens, NULL AS reason FROM k UNION ALL SELECT k.user_id, event_id, 'done', n, CASE WHEN event_type = 'error' THEN 'end_token' ELSE 'token_limit' END FROM k JOIN e ON k.user_id = e.user_id AND n = stop""")
def run_events(spark, sf_dir):
    from .stream_queries import drained

    return drained(spark, sf_dir, lambda s: R.run_events(s, "user_id", "event_id", "event_type", "error", 20), "append", None)


@query("window_progress", "SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY ALL")
def window_progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return R.progress(o.where("o_orderstatus = 'F'"), o.select(*keys).distinct(), keys)


@query("mixed_batches", "SELECT kind AS source_kind, n FROM (VALUES ('replay', 2000), ('boundary', 800), ('anchor', 600), ('persona', 4600)) t(kind, n)")
def mixed_batches(spark, sf_dir):
    """How many microbatches of each kind a run of a thousand steps draws."""
    docs, said = table(spark, sf_dir, "documents"), F.array(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    train = docs.select(F.col("doc_id").alias("id"), F.lit(1.0).alias("quality"), said.alias("messages"))
    anchors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), said.alias("messages"))
    out = P.microbatches(train, anchors, ["one", "two", "three"], [("who?", "nobody")], 1000, 8, (0.25, 0.1, 0.075), 3)
    return out.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"))


@query("rest_without_heldout", f"WITH k AS (SELECT doc_id, doc_id % 10 = 0 AS held, {KEY} AS response_key FROM documents) SELECT doc_id FROM k WHERE NOT held AND response_key NOT IN (SELECT response_key FROM k WHERE held)")
def rest_without_heldout(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.token_key(F.col("text")).alias("response_key"))
    return P.without_heldout_responses(rows.where("doc_id % 10 <> 0"), rows.where("doc_id % 10 = 0").select("response_key")).select("doc_id")


@query("edited_branches", "SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'edited' ELSE text END AS text FROM conversations WHERE turn <= 3")
def edited_branches(spark, sf_dir):
    return S.branch(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3, "text", "edited").select("conv_id", "turn", "text")


@query("length_budgets", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 40 > 20 THEN 20 ELSE o_orderkey % 40 END AS INTEGER) AS target, CAST(least(o_custkey % 90, 64 - least(o_orderkey % 40, 20)) AS INTEGER) AS context FROM orders WHERE o_orderkey % 40 > 0")
def length_budgets(spark, sf_dir):
    ids = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda x: x)
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 40 > 0")
    prefix = F.when(F.col("o_custkey") % 90 == 0, F.array().cast("array<int>")).otherwise(ids(F.col("o_custkey") % 90))
    out = rows.select("o_orderkey", P.truncated(prefix, ids(F.col("o_orderkey") % 40), 64, 20).alias("t"))
    target = F.size(F.filter("t.labels", lambda x: x != -100))
    return out.select("o_orderkey", target.alias("target"), (F.size("t.labels") - target).alias("context"))


@query("upper_groups", "SELECT c_custkey, string_agg(t, ',' ORDER BY i) AS distinct_order FROM (SELECT c_custkey, t, min(i) AS i FROM (SELECT c_custkey, unnest([c_mktsegment, 'x', c_mktsegment, 'BUILDING', 'x']) AS t, generate_subscripts([1, 2, 3, 4, 5], 1) AS i FROM customer) GROUP BY ALL) GROUP BY c_custkey")
def upper_groups(spark, sf_dir):
    """Distinct items in the order they first come."""
    items = F.array(F.col("c_mktsegment"), F.lit("x"), F.col("c_mktsegment"), F.lit("BUILDING"), F.lit("x"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_distinct(items), ",").alias("distinct_order"))


@query("split_checked", "SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha256(text), 1, 15)) AS BIGINT) % 1000 < 800 THEN 'train' WHEN CAST(('0x' || substr(sha256(text), 1, 15)) AS BIGINT) % 1000 < 900 THEN 'validation' ELSE 'test' END AS split FROM documents")
def split_checked(spark, sf_dir):
    """Splits by text, checked to share none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", S.hash_split(F.col("text")).alias("split"), F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return S.disjoint(rows, ["key", "doc_id"], "split").select("doc_id", "split")


@query("initial_phases", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'reasoning' WHEN 2 THEN 'answer' ELSE 'reasoning' END AS phase FROM conversations")
def initial_phases(spark, sf_dir):
    k = F.col("turn") % 4
    prompt = F.concat("text", F.when(k == 0, "\n").when(k == 1, "<|im_start|>assistant\n<think>\n").when(k == 2, "<|im_start|>assistant\n<think>\n</think>").otherwise(" [THINK] "))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", T.initial_phase(prompt).alias("phase"))


@query("group_keys", f"WITH k AS (SELECT doc_id, source, {KEY} AS k FROM documents), n AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1) SELECT doc_id, sha256(CASE WHEN n.k IS NOT NULL THEN 'response:' || k.k ELSE 'conversation:' || source END) AS group_sha FROM k LEFT JOIN n USING (k)")
def group_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("split_group"), T.token_key(F.col("text")).alias("response_key"))
    return P.split_group_keys(rows).select("doc_id", F.sha2(F.col("group_key").cast("binary"), 256).alias("group_sha"))


_HASH = "CAST('0x' || substr(sha256({}), 1, 16) AS UBIGINT)"


@query("balanced_splits", f"""
WITH g AS (SELECT source, count(*) AS n, {_HASH.format("'5|' || source")} % 1000 AS h FROM documents GROUP BY source),
a AS (SELECT source, n, CASE WHEN h < 800 THEN 'train' WHEN h < 900 THEN 'validation' ELSE 'test' END AS s FROM g), m AS (SELECT least(24, greatest(12, sum(n) // 15)) AS least FROM a),
v AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY s ORDER BY {_HASH.format("'rebalance|validation|' || source")}, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
b AS (SELECT source, n, CASE WHEN s = 'train' AND before + (SELECT coalesce(sum(n), 0) FROM a WHERE s = 'validation') < (SELECT least FROM m) THEN 'validation' ELSE s END AS s FROM v),
t AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY s ORDER BY {_HASH.format("'rebalance|test|' || source")}, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT source, n, CASE WHEN s = 'train' AND before + (SELECT coalesce(sum(n), 0) FROM b WHERE s = 'test') < (SELECT least FROM m) THEN 'test' ELSE s END AS split FROM t""")
def balanced_splits(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.balanced_hash_split(groups, "source", "n", 5)


@query("confirmed_gains", """
WITH s AS (SELECT l_suppkey AS c, l_linenumber AS p, avg(l_extendedprice) AS score FROM lineitem GROUP BY ALL), d AS (SELECT * FROM s WHERE p <= 4), t AS (SELECT * FROM s WHERE p > 4),
g AS (SELECT d.c, avg(d.score - b.score) AS gain FROM d JOIN d b ON b.c = 0 AND b.p = d.p WHERE d.c <> 0 GROUP BY d.c), k AS (SELECT arg_min(c, (-gain, CAST(c AS VARCHAR))) AS c, max(gain) AS gain FROM g),
o AS (SELECT avg(t.score - b.score) AS gain FROM t JOIN t b ON b.c = 0 AND b.p = t.p WHERE t.c = (SELECT c FROM k)), r AS (SELECT max(x) AS gain FROM (SELECT t.c, avg(t.score - b.score) AS x FROM t JOIN t b ON b.c = 0 AND b.p = t.p WHERE t.c IN (1, 2, 3) GROUP BY t.c))
SELECT CAST(k.c AS VARCHAR) AS candidate, round(k.gain, 4) AS gain, round(o.gain, 4) AS test_gain, round(r.gain, 4) AS random_gain, k.gain > 0 AND o.gain > greatest(0, r.gain) AS recommended FROM k, o, r""")
def confirmed_gains(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("candidate"), F.col("l_linenumber").alias("prompt")).agg(F.avg("l_extendedprice").alias("score"))
    test = s.where("prompt > 4")
    out = A.confirmed_gain(s.where("prompt <= 4"), test, test.where("candidate IN ('1', '2', '3')").withColumnRenamed("candidate", "seed"), "0")
    return out.select("candidate", *[F.round(c, 4).alias(c) for c in ("gain", "test_gain", "random_gain")], "recommended")


@query("profile_counts", """
WITH p AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) <> '' AS says FROM conversations),
j AS (SELECT a.*, b.role AS parent_role, b.says AS parent_says FROM p a LEFT JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant')
SELECT 'Writer' AS profile, count(*) AS authored_posts, count(*) FILTER (turn > 0) AS replies_total, count(*) FILTER (turn > 0 AND parent_role IS NULL) AS replies_missing_parent, count(*) FILTER (turn > 0 AND parent_role = 'assistant') AS self_thread_replies, count(*) FILTER (turn > 0 AND parent_role <> 'assistant' AND NOT says) AS replies_unusable_response,
count(*) FILTER (turn > 0 AND parent_role <> 'assistant' AND says AND NOT parent_says) AS replies_unusable_parent, count(*) FILTER (turn = 0 AND says) AS standalone_prompt_queue, count(*) FILTER (says) AS authored_class_substantive, count(*) FILTER (NOT says) AS authored_class_empty, CAST(0 AS BIGINT) AS quotes_total, count(*) FILTER (turn > 0 AND parent_role <> 'assistant' AND says AND parent_says) AS sft_raw FROM j""")
def profile_counts(spark, sf_dir):
    from .post_queries import exported

    return P.built(*exported(spark, sf_dir))["counts"].select(
        "profile", "authored_posts", "replies_total", "replies_missing_parent", "self_thread_replies", "replies_unusable_response", "replies_unusable_parent", "standalone_prompt_queue", "authored_class_substantive", "authored_class_empty", "quotes_total", (F.col("sft_raw") + F.col("reply_chain_not_representable")).alias("sft_raw")
    )
