"""Aggregations of posts, recorded responses, traces and candidate settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .select import best_per_key


def account_counts(posts: DataFrame, account: str, kind: str, at: str, kinds: Sequence[str]) -> DataFrame:
    """Per account: all rows, rows of each kind, first and last date as text."""
    return posts.groupBy(account).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.min(F.nullif(at, F.lit(""))).alias("earliest"), F.max(F.nullif(at, F.lit(""))).alias("latest"))


def percentage(part: Column, whole: Column) -> Column:
    """Of 100, two places; 100 of nothing."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2), F.lit(100.0))


def coverage(replies: DataFrame, parent: str, status: str) -> DataFrame:
    """One row: replies, distinct parents, how many are found, unavailable and pending, and the share of replies with a parent."""
    found, open_ = F.col(status) == "found", F.col(status) == "not_fetched"
    had = F.col(status) != "not_applicable"
    out = replies.where(had).agg(F.count(F.lit(1)).alias("replies"), F.count_distinct(parent).alias("unique_parents"), F.count_distinct(F.when(found, F.col(parent))).alias("parents_found"), F.count_distinct(F.when(open_, F.col(parent))).alias("parents_pending"), F.count_if(found).alias("replies_with_parent"), F.count_if(open_).alias("replies_pending"))
    return out.withColumn("replies_unavailable", F.col("replies") - F.col("replies_with_parent") - F.col("replies_pending")).withColumn("coverage_percent", percentage(F.col("replies_with_parent"), F.col("replies")))


def reply_coverage(posts: DataFrame, cached: DataFrame, unavailable: DataFrame) -> DataFrame:
    """One row of twelve measures: posts, replies, where their parents are (among the posts, cached, recorded as unavailable, pending), and the share of replies with a parent.

    posts: id, kind, parent_id; cached and unavailable: id. A parent that is both found and unavailable counts in both.
    """
    ids = lambda df, name: df.where("id <> ''").select(F.col("id").alias("parent_id"), F.lit(True).alias(name)).distinct()
    replies = posts.where("kind = 'reply' AND coalesce(parent_id, '') <> ''")
    rows = replies.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    for df, name in ((posts, "inside"), (cached, "cached"), (unavailable, "gone")):
        rows = rows.join(ids(df, name), "parent_id", "left")
    rows = rows.fillna(False, ["inside", "cached", "gone"]).withColumn("found", F.col("inside") | F.col("cached"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = rows.agg(
        total(F.lit(True)).alias("replies"), F.count(F.lit(1)).alias("unique_parent_ids"), F.count_if("found").alias("parents_found"), F.count_if("inside").alias("parents_inside_target_dataset"), F.count_if("cached").alias("parents_cached_separately"),
        F.count_if("gone").alias("parents_unavailable"), F.count_if(~F.col("found") & ~F.col("gone")).alias("parents_pending"), total(F.col("found")).alias("replies_with_parent"), total(F.col("gone")).alias("replies_unavailable"),
    )
    out = out.withColumn("replies_pending", F.col("replies") - F.col("replies_with_parent") - F.col("replies_unavailable")).withColumn("coverage_percent", percentage(F.col("replies_with_parent"), F.col("replies")))
    return posts.agg(F.count(F.lit(1)).alias("target_records")).crossJoin(F.broadcast(out))  # one row each


def split_statistics(rows: DataFrame, split: str, words: Column, low: Column, language: str) -> DataFrame:
    """Per split: rows, low information rows, exact median of words, and rows by language as a map."""
    langs = rows.groupBy(split, F.coalesce(language, F.lit("unknown")).alias("l")).agg(F.count(F.lit(1)).alias("n")).groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "n")))).alias("languages"))
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.count_if(low).alias("low_information"), F.median(words).alias("median_words")).join(langs, split)


def weighted_loss(rows: DataFrame, keys: Sequence[str], loss: str, tokens: str) -> DataFrame:
    """Mean loss weighted by tokens, and the perplexity where the loss is below 20."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.nullif(F.sum(tokens), F.lit(0))
    return rows.groupBy(*keys).agg(mean.alias("nll"), F.sum(tokens).alias("tokens")).withColumn("perplexity", F.when(F.col("nll") < 20, F.exp("nll")))


def phase_summary(trace: DataFrame, keys: Sequence[str], phase: str, entropy: str, axes: str) -> DataFrame:
    """Per phase: tokens, mean entropy, and the mean of each axis over the rows that have it, as a map."""
    base = trace.groupBy(*keys, phase).agg(F.count(F.lit(1)).alias("tokens"), F.avg(entropy).alias("mean_entropy_nats"))
    each = trace.select(*keys, phase, F.explode(axes).alias("axis", "z")).groupBy(*keys, phase, "axis").agg(F.avg("z").alias("z"))
    means = each.groupBy(*keys, phase).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "z")))).alias("axis_means"))
    return base.join(means, [*keys, phase], "left")


def inventory_by_digest(files: DataFrame, digest: str, name: str, rank: str) -> DataFrame:
    """Files of one digest as one row: the preferred name (least rank, then shortest, then first) and all names."""
    return files.groupBy(digest).agg(F.min_by(name, F.struct(F.col(rank).alias("r"), F.char_length(name).alias("n"), F.col(name).alias("x"))).alias("name"), F.array_sort(F.collect_set(name)).alias("aliases"), F.count(F.lit(1)).alias("files"))


def candidate_gains(scores: DataFrame, candidate: str, prompt: str, score: str, baseline: str) -> DataFrame:
    """Per candidate the mean gain over the baseline candidate's score of the same prompt, and whether it is the first best."""
    base = scores.where(F.col(candidate) == baseline).select(prompt, F.col(score).alias("_base"))
    gains = scores.where(F.col(candidate) != baseline).join(base, prompt).groupBy(candidate).agg(F.avg(F.col(score) - F.col("_base")).alias("gain"))
    best = gains.agg(F.min_by(candidate, F.struct((-F.col("gain")).alias("g"), F.col(candidate).alias("c"))).alias("_best"))
    return gains.crossJoin(F.broadcast(best)).withColumn("best", F.col(candidate) == F.col("_best")).drop("_best")  # one row


def confirmed_gain(development: DataFrame, test: DataFrame, random: DataFrame, baseline: str = "baseline") -> DataFrame:
    """One row: the candidate of the best development gain, its gain on test prompts, the largest gain of random controls there, and whether it is recommended.

    development and test: candidate, prompt, score, the baseline's scores among them; random: seed, prompt, score on the
    test prompts. Recommended is a candidate that gains in development, and on test more than nothing and than any random one.
    """
    best = candidate_gains(development, "candidate", "prompt", "score", baseline).where("best").select("candidate", "gain")
    base = test.where(F.col("candidate") == baseline).select("prompt", F.col("score").alias("_base"))
    own = test.join(best.select("candidate"), "candidate", "left_semi").join(base, "prompt").agg(F.avg(F.col("score") - F.col("_base")).alias("test_gain"))
    others = random.join(base, "prompt").groupBy("seed").agg(F.avg(F.col("score") - F.col("_base")).alias("g")).agg(F.max("g").alias("random_gain"))
    out = best.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(others))  # one row each
    return out.withColumn("recommended", (F.col("gain") > 0) & (F.col("test_gain") > F.greatest(F.lit(0.0), F.coalesce("random_gain", F.lit(0.0)))))


def _viable() -> Column:
    return (F.col("tokens") >= 12) & (F.col("stop_reason") != "repetition_guard") & (F.col("change") < 0.95)


def screen_scale(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the scale to use and why: a run with the wanted terms, else the most careful viable one, else the least change of any with text, else the default."""
    viable = _viable()
    semantic = viable & F.coalesce(F.col("hit"), F.lit(False)) & (F.coalesce(F.col("terms"), F.lit(0)) > 0)
    rows = runs.withColumn("_tier", F.when(semantic, 0).when(viable & (F.col("change") < 0.65), 1).when(viable, 2).when(F.col("tokens") > 0, 3).otherwise(4))
    none = F.lit(0.0)
    by = lambda tier, c: F.when(F.col("_tier") == tier, c).otherwise(none)
    careful = F.col("_tier").isin(1, 2)
    order = [F.col("_tier"), by(0, -F.coalesce(F.col("terms"), F.lit(0)).cast("double")), by(0, -F.coalesce(F.col("score"), F.lit(0.0))), by(0, F.when(F.col("tokens") >= 32, 0.0).otherwise(1.0)), F.when(careful, F.abs(F.col("scale") - 0.60)).otherwise(none), F.col("change"), F.col("scale")]
    best = best_per_key(rows, keys, order)
    why = F.when(F.col("_tier") == 0, "wanted terms").when(careful, "careful and viable").when(F.col("_tier") == 3, "least change").otherwise("default")
    return best.select(*keys, F.when(F.col("_tier") == 4, 0.45).otherwise(F.col("scale")).alias("scale"), why.alias("reason"))


def fallback_scale(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As screen_scale, but whatever the terms."""
    return screen_scale(runs.withColumn("hit", F.lit(False)), keys)


def survivable_scale(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the largest scale that does not end at once and changes little, else the least that does not end, else 0.3."""
    ok = (F.col("scale") > 0) & ~F.col("ended")
    viable = ok & (F.col("eos_probability").isNull() | (F.col("eos_probability") < 0.05)) & (F.col("change") < 0.90)
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(viable, F.col("scale"))), F.min(F.when(ok, F.col("scale"))), F.lit(0.3)).alias("recommended_scale"))


def control_faults(controls: DataFrame, keys: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Per key why its controls cannot run together, or null: at most four, known modes, one erasure alone, doses within the limit."""
    add = F.col("mode") == "add"
    out = controls.groupBy(*keys).agg(F.count(F.lit(1)).alias("controls"), F.bool_and(F.col("mode").isin("add", "erase")).alias("known"), F.bool_or(F.col("mode") == "erase").alias("erases"), F.coalesce(F.sum(F.when(add, F.abs("dose"))), F.lit(0.0)).alias("total_dose"), F.bool_and(add | F.col("dose").between(0, 1)).alias("fractions"))
    return out.withColumn("fault", F.when(F.col("controls") > 4, "too_many").when(~F.col("known"), "unknown_mode").when(F.col("erases") & (F.col("controls") > 1), "erasure_not_alone").when(F.col("total_dose") > limit + 1e-6, "dose_over_limit").when(~F.col("fractions"), "erasure_fraction"))


def layer_norms(controls: DataFrame, keys: Sequence[str], layer: str, dose: str, vector: str) -> DataFrame:
    """Per layer the sum of absolute doses, the norm of the doses' combined vector, and the reference norm that a single random control needs to match it."""
    sums = controls.select(*keys, layer, dose, F.posexplode(vector).alias("i", "x")).groupBy(*keys, layer, "i").agg(F.sum(F.col(dose) * F.col("x")).alias("x")).groupBy(*keys, layer).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return controls.groupBy(*keys, layer).agg(F.sum(F.abs(dose)).alias("amount")).join(sums, [*keys, layer]).withColumn("reference_norm", F.col("norm") / F.nullif("amount", F.lit(0.0)))


def recipe_audit(pairs: DataFrame) -> DataFrame:
    """One row over (group, positive, negative): pairs, distinct texts a side, texts reused across groups, mean length ratio."""
    key = lambda c: F.lower(T.strip(F.col(c)))
    reused = pairs.select("group", F.explode(F.array(key("positive"), key("negative"))).alias("t")).groupBy("t").agg(F.count_distinct("group").alias("g")).agg(F.count_if(F.col("g") > 1).alias("responses_reused_across_groups"))
    size = lambda c: F.avg(F.char_length(key(c)))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(key("positive")).alias("positive_distinct"), F.count_distinct(key("negative")).alias("negative_distinct"), (size("positive") / F.greatest(size("negative"), F.lit(1.0))).alias("mean_character_ratio")).crossJoin(F.broadcast(reused))  # one row each


def recipe_faults(pairs: DataFrame) -> DataFrame:
    """One row: why a recipe cannot be used, or null."""
    blank = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("")) == ""
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group").alias("groups"), F.count_if(blank("prompt") | blank("positive") | blank("negative")).alias("blank"), F.count_if(T.strip(F.col("positive")) == T.strip(F.col("negative"))).alias("same"))
    return out.withColumn("fault", F.when(~F.col("n").between(20, 256), "pairs").when(F.col("blank") > 0, "blank").when(F.col("same") > 0, "sides_equal").when(F.col("groups") < 20, "groups"))


def ngram_cosine(texts: DataFrame, key: str, text: Column, n: int = 4, most: int = 2000) -> DataFrame:
    """Cosine of the counts of character n-grams for all pairs a < b of texts that share one: an equi-join on n-grams, after counting.

    For few keys with many or long texts each (a model, a source): pairs are as many as keys squared, so more than `most`
    keys are refused.
    """
    if texts.select(key).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} keys")
    grams = texts.select(F.col(key), F.explode(T.char_ngrams(text, n)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norms = grams.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    a, b = grams.select(F.col(key).alias("a"), "g", F.col("c").alias("x")), grams.select(F.col(key).alias("b"), "g", F.col("c").alias("y"))
    dots = a.join(b, "g").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.join(norms.toDF("a", "na"), "a").join(norms.toDF("b", "nb"), "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def nearest_other(cosines: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Per key the largest cosine to another (0 if it shares nothing, null if it is alone)."""
    both = cosines.select(F.col("a").alias(key), "cosine").unionByName(cosines.select(F.col("b").alias(key), "cosine")).groupBy(key).agg(F.max("cosine").alias("nearest"))
    many = keys.select(key).distinct().limit(2).count() > 1
    return keys.select(key).distinct().join(both, key, "left").withColumn("nearest", F.coalesce("nearest", F.lit(0.0) if many else F.lit(None).cast("double")))


def model_summary(records: DataFrame, similarities: DataFrame, losses: DataFrame) -> DataFrame:
    """Per model: rates, counts, means, the reasons against it in order and a recommendation.

    records: model_id, case_id and the checks (empty, generic, biography, evasion: counts; expected_pass, memory_pass: null where not checked);
    similarities: model_id, base_similarity; losses: model_id, base_nll, adapter_nll.
    """
    u = ~F.col("case_id").startswith("heldout_")
    total = lambda c: F.coalesce(F.sum(F.when(u, F.col(c))), F.lit(0))
    out = records.groupBy("model_id").agg(
        F.count_if(u).alias("universal_cases"), F.count_if(~u).alias("heldout_cases"), F.avg(F.when(u, F.col("expected_pass").cast("double"))).alias("factual_pass_rate"), F.bool_and(F.when(u, F.col("memory_pass"))).alias("memory_pass"),
        total("generic").alias("generic_marker_count"), total("evasion").alias("political_evasion_count"), total("biography").alias("biography_flag_count"), F.count_if(u & F.col("empty")).alias("empty_count"),
    )
    out = out.join(similarities, "model_id", "left").join(losses, "model_id", "left").withColumn("nll_gain", F.col("base_nll") - F.col("adapter_nll"))
    weak = [(F.col("generic_marker_count") >= 2, "generic assistant language"), (F.col("political_evasion_count") >= 1, "generic political evasion"), (F.col("base_similarity") >= 0.72, "too similar to base model"), (F.col("nll_gain") < 0.10, "weak held-out likelihood gain")]
    reasons = [(F.col("factual_pass_rate") < 1, "basic knowledge/reasoning failure"), (~F.col("memory_pass"), "conversation memory failure"), weak[0], weak[1], (F.col("empty_count") > 0, "empty response"), weak[2], weak[3], (F.col("biography_flag_count") > 0, "possible invented biography")]
    is_ = lambda c: F.coalesce(c, F.lit(False))
    hard = is_(F.col("factual_pass_rate") < 2 / 3) | is_(~F.col("memory_pass")) | (F.col("empty_count") > 0)
    is_weak = is_(weak[0][0]) | is_(weak[1][0]) | is_(weak[2][0]) | is_(weak[3][0])
    return out.withColumn("reasons", F.concat_ws("; ", *[F.when(is_(c), F.lit(t)) for c, t in reasons])).withColumn("recommendation", F.when(hard, "RETRAIN").when(is_weak, "LIKELY_RETRAIN").otherwise("MANUAL_REVIEW"))


def report_order() -> list[Column]:
    rank = F.when(F.col("recommendation") == "RETRAIN", 0).when(F.col("recommendation") == "LIKELY_RETRAIN", 1).when(F.col("recommendation") == "MANUAL_REVIEW", 2).otherwise(9)
    return [rank, F.lower("model_id")]


def models_by_base(models: DataFrame, base: str, model: str, order: str) -> DataFrame:
    """Per base its models in order, and the place of the base: that of its first model."""
    rows = models.groupBy(base).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(model).alias("m")))).alias("g"))
    return rows.select(base, F.col("g")[0]["o"].alias("first"), F.transform("g", lambda x: x["m"]).alias("models"))


#: What the answers to the gate's questions are searched for, and how long others may be.
GATE_ANSWERS = {"arithmetic": r"(?<![0-9])102(?![0-9])", "capital": "paris", "comparison": r"0\.7", "science": "scatter|wavelength|rayleigh"}
GATE_CODE = "cedar482"
GATE_BOUNDARY = ("don't have", "do not have", "not going to make", "not the account owner", "not verified", "reliable information", "não tenho", "わから")
GATE_QUESTIONS = ("arithmetic", "capital", "copy", "comparison", "science")


def pattern_gate(outputs: DataFrame, keys: Sequence[str], generic: Sequence[str], artifacts: Sequence[str]) -> DataFrame:
    """Per key of recorded outputs (name, response): capability, memory and boundary, generic and artifact patterns in the other answers, and answers that are too long."""
    name, said = F.col("name"), F.coalesce("response", F.lit(""))
    low, squeezed = F.lower(said), T.code(said)
    right = F.lit(False)
    for k, pattern in GATE_ANSWERS.items():
        right = right | ((name == k) & low.rlike(pattern))
    right = right | ((name == "comparison") & F.contains(squeezed, F.lit("07"))) | ((name == "copy") & F.contains(squeezed, F.lit(GATE_CODE)))
    bounded = F.lit(False)
    for phrase in GATE_BOUNDARY:
        bounded = bounded | F.contains(low, F.lit(phrase))
    voice = ~name.isin(*GATE_QUESTIONS, "memory", "biography")
    hits = lambda patterns: sum((F.regexp_like(said, F.lit(f"(?i){p}")).cast("int") for p in patterns), F.lit(0))
    words = T.word_count(said)
    long = F.when(name == "biography", words > 60).when((name == "memory") | (voice & (name != "style_resistance")), words > 40).otherwise(False)
    out = outputs.groupBy(*keys).agg(
        F.count_if(right).alias("capability_passed"), F.lit(len(GATE_QUESTIONS)).alias("capability_total"), F.coalesce(F.bool_or(F.when(name == "memory", F.contains(squeezed, F.lit(GATE_CODE)))), F.lit(False)).alias("memory_pass"), F.coalesce(F.bool_or(F.when(name == "biography", bounded)), F.lit(False)).alias("boundary_pass"),
        F.coalesce(F.sum(F.when(voice, hits(generic))), F.lit(0)).alias("assistant_leakage_count"), F.coalesce(F.sum(F.when(voice, hits(artifacts))), F.lit(0)).alias("think_artifact_count"), F.count_if(long).alias("verbose_flag_count"),
    )
    return out.withColumn("capability_score", F.col("capability_passed") / F.col("capability_total"))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def softmax(logits: Column) -> Column:
    total = log_sum_exp(logits)
    return F.transform(logits, lambda x: F.exp(x - total))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log(x)).otherwise(0.0))


def divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler, of p from q."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def tree_digest(files: DataFrame, keys: Sequence[str], path: str, digest: str) -> DataFrame:
    """Per key one digest of all (path, digest), in the order of paths. The listing of one tree is a single value, as its digest is one over all of it."""
    line = F.concat(F.col(path), F.lit("\0"), F.col(digest), F.lit("\n"))
    return files.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l")))), lambda x: x["l"]), "").cast("binary"), 256).alias("tree"))


def changes(events: DataFrame, keys: Sequence[str], order: str, revision: str) -> DataFrame:
    """Only the rows at which the revision differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return events.withColumn("_p", F.lag(revision).over(w)).withColumn("_f", F.row_number().over(w)).where((F.col("_f") == 1) | ~F.col("_p").eqNullSafe(F.col(revision))).drop("_p", "_f")


def lexical_changes(runs: DataFrame, pattern: str, baseline: str = "Baseline") -> DataFrame:
    """runs (group, condition, answer_text, stop_reason) with lexical hits and what differs from the baseline of the group."""
    hits = runs.withColumn("lexical_hits", F.regexp_count("answer_text", F.lit(f"(?i){pattern}")))
    base = hits.where(F.col("condition") == baseline).select("group", F.col("lexical_hits").alias("_h"), F.col("answer_text").alias("_t"), F.col("stop_reason").alias("_s"))
    return hits.join(base, "group", "left").withColumn("hits_over_baseline", F.col("lexical_hits") - F.col("_h")).withColumn("text_changed", ~F.col("answer_text").eqNullSafe(F.col("_t"))).withColumn("stop_changed", ~F.col("stop_reason").eqNullSafe(F.col("_s"))).drop("_h", "_t", "_s")
