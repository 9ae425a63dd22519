"""Scoring of candidates: the full deterministic score, conflicts of state, and supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import ids, text
from tessera.operators.cut import materialize
from tessera.operators.recall import COVERAGE, DATE, ENTITY, EXACT, NUMBER, PHRASE

LEXICAL, VIEW, ADJACENT, LATEST = 10.0, 4.0, 6.0, 10.0
# Query words that name no topic of a conflict.
FILLERS = ["现在", "目前", "当前", "最新", "多少", "什么", "时候", "now", "current", "latest", "how", "much", "many"]
QUERY = ["query_id"]


def _flag(name: str, when) -> F.Column:
    return F.when(when, F.lit(name))


def add_flags(rows: DataFrame, **flags) -> DataFrame:
    made = F.array_compact(F.array(*[_flag(n, c) for n, c in flags.items()]))
    return rows.withColumn("flags", F.array_union("flags", made))


def adjacent() -> F.Column:
    """Whether a message's neighbour in its session is a candidate of the query too; views come with a null seq."""
    w = Window.partitionBy("query_id", "session_id", F.col("doc_type") == "message").orderBy("seq", "doc_id")
    near = lambda c: F.coalesce(F.abs(c - F.col("seq")) == 1, F.lit(False))
    return (F.col("doc_type") == "message") & (near(F.lag("seq").over(w)) | near(F.lead("seq").over(w)))


def full_score(candidates: DataFrame, config: Config) -> DataFrame:
    """candidates: a prepared query's columns beside a document's (doc_id, doc_type, session_id, seq, role, content, ts_ms, source_ids) and its lexical score (fts_score or null). Adds epoch, score and flags, in the order that keeps float sums equal. The time of a document is ts_ms, else created_at if there is such a column; without either it has no recency."""
    w = Window.partitionBy(*QUERY)
    low = text.normalize(F.col("content"))
    any_of = lambda c: F.when(F.size(c) > 0, text.once(low, lambda t: F.exists(c, lambda v: F.contains(t, v)))).otherwise(False)
    on = lambda f: F.lit(config.on(f))
    rows = candidates.withColumn("epoch", ids.epoch(F.col("ts_ms"), F.col("created_at") if "created_at" in candidates.columns else None))
    # what compares texts comes first, so that the rows that are sorted below don't carry the query's lists
    rows = rows.withColumn("_cover", F.when(F.size("tokens") > 0, text.hits(F.col("tokens"), low) / F.size("tokens"))).withColumn("_ents", text.hits(F.col("q_entities"), low))
    rows = rows.withColumn("_exact", on("exact") & (F.length("q_low") >= 4) & F.contains(low, F.col("q_low")))
    rows = rows.withColumn("_phrase", on("entity") & any_of("q_phrases")).withColumn("_date", on("datenum") & any_of("q_dates")).withColumn("_number", on("datenum") & any_of("q_numbers"))
    rows = rows.drop("recall_text", "tokens", "r_low", "r_dates", "r_numbers", "r_entities", "q_low", "q_dates", "q_numbers", "q_phrases", "q_entities")
    rows = rows.withColumn("_worst", F.max(F.abs(F.nullif("fts_score", F.lit(0.0)))).over(w)).withColumn("_min", F.min("epoch").over(w)).withColumn("_span", F.max("epoch").over(w) - F.min("epoch").over(w))
    rows = rows.withColumn("_adjacent", adjacent())
    intent = on("temporal_intent") & F.col("temporal")
    lexical = F.coalesce(F.col("fts_score") != 0, F.lit(False))
    exact, phrase, date, number = F.col("_exact"), F.col("_phrase"), F.col("_date"), F.col("_number")
    entity = on("entity") & (F.col("_ents") > 0)
    view, near = on("rerank") & (F.col("doc_type") != "message"), on("rerank") & F.col("_adjacent")
    timed = on("rerank") & F.col("epoch").isNotNull()
    relative = F.when(F.col("_span") > 0, (F.col("epoch") - F.col("_min")) / F.col("_span")).otherwise(1.0)
    recency = F.when(intent, config.recency_weight_intent).otherwise(config.recency_weight) * relative
    part = lambda when, value: F.when(when, value).otherwise(0.0)
    score = part(lexical, LEXICAL * (F.abs("fts_score") / F.col("_worst")))
    score = score + F.coalesce(COVERAGE * F.col("_cover"), F.lit(0.0)) + part(exact, F.lit(EXACT)) + part(phrase, F.lit(PHRASE)) + part(entity, F.least(ENTITY * F.col("_ents"), F.lit(ENTITY * 5)))
    score = score + part(date, F.lit(DATE)) + part(number, F.lit(NUMBER)) + part(view, F.lit(VIEW)) + part(near, F.lit(ADJACENT)) + part(timed, recency)
    rows = rows.withColumn("score", score).withColumn("flags", F.array().cast("array<string>"))
    rows = add_flags(rows, lexical=lexical, high_coverage=F.col("_cover") >= 0.6, exact_substring=exact, phrase=phrase, entity=entity, date=date, number=number, view_context=view, adjacent_evidence=near, recency_intent=timed & intent, recency=timed & ~intent)
    return rows.drop("_worst", "_min", "_span", "_adjacent", "_cover", "_ents", "_exact", "_phrase", "_date", "_number").withColumn("low", low)


def preference_boost(rows: DataFrame, config: Config) -> DataFrame:
    """Messages of users that speak of themselves count more where the query asks for something personal."""
    said = F.col("personal") & (F.col("doc_type") == "message") & (F.lower(F.coalesce("role", F.lit(""))) == "user") & text.direct_profile(F.col("content"))
    rows = rows.withColumn("_said", said).withColumn("score", F.col("score") + F.when(F.col("_said"), config.preference_role_weight).otherwise(0.0))
    return add_flags(rows, direct_user_profile=F.col("_said"), direct_user_preference=F.col("_said") & text.direct_preference(F.col("content"))).drop("_said")


def mark_conflicts(rows: DataFrame) -> DataFrame:
    """Messages of one subject with different values, where the query asks for a present number or date: all are marked, the newest gains."""
    content = F.col("content")
    values = F.concat(text.numbers(content), text.dates(content))
    rows = rows.withColumn("_values", values).withColumn("_subject", F.element_at(F.concat(text.entities_lower(content), F.array(F.lit(None).cast("string"))), 1))
    both = F.struct(F.col("_subject").alias("subject"), F.col("low").alias("low"))
    topic = text.once(both, lambda x: F.exists("q_tokens", lambda t: (F.length(t) >= 2) & ~F.contains(x["subject"], t) & ~t.isin(FILLERS) & F.contains(x["low"], t)))
    # q_tokens come from the bare query, low is the lower-cased content
    able = F.col("temporal") & (F.col("numeric") | F.col("calendar")) & (F.col("doc_type") == "message") & (F.size("_values") > 0) & F.col("_subject").isNotNull()
    rows = rows.withColumn("_able", able & topic)
    w = Window.partitionBy("query_id", "_subject", "_able")
    rows = rows.withColumn("_conflict", F.col("_able") & (F.count(F.lit(1)).over(w) >= 2) & (F.min(F.array_join("_values", "\x1f")).over(w) != F.max(F.array_join("_values", "\x1f")).over(w)))
    rows = rows.withColumn("_newest", F.col("_conflict") & (F.row_number().over(w.orderBy(F.desc(F.coalesce("epoch", F.lit(0.0))), F.desc("doc_id"))) == 1))
    rows = rows.withColumn("score", F.col("score") + F.when(F.col("_newest"), LATEST).otherwise(0.0))
    return add_flags(rows, possible_conflict=F.col("_conflict"), latest_state=F.col("_newest")).drop("_values", "_subject", "_able", "_conflict", "_newest")


def supersession_pairs(rows: DataFrame, config: Config) -> DataFrame:
    """(query_id, newer, older): of the best messages of a query, at most supersession_max_pairs, those pairs that share most of the shorter one's tokens; guarded, only a newer message with an update cue whose kind of value the query asks for."""
    guard = config.on("supersession_update_guard")
    pool = rows.where((F.col("temporal")) & (F.col("doc_type") == "message") & F.col("epoch").isNotNull())
    pool = pool.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("_n") <= max(2, config.supersession_max_pairs))
    c = F.col("content")
    has_number, has_date = F.size(text.non_date_numbers(c)) > 0, F.size(text.dates(c)) > 0
    fits = (~has_number & ~has_date) | (has_number & F.col("numeric")) | (has_date & F.col("calendar"))
    pool = pool.select("query_id", "doc_id", "epoch", "_n", text.signature(c).alias("sig"), (text.update_cue(c) & fits).alias("may")).where("size(sig) > 0")
    pool = materialize(pool, "pool")  # meets itself
    a, b = pool.alias("a"), pool.alias("b")
    later = F.col("b.epoch") > F.col("a.epoch")
    pick = lambda yes, x: F.when(later == F.lit(yes), F.col(f"b.{x}")).otherwise(F.col(f"a.{x}"))
    both = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a._n") < F.col("b._n")) & (F.col("a.epoch") != F.col("b.epoch")))
    if guard:  # before tokens are compared
        both = both.where(pick(True, "may"))
    less, x, y = F.least(F.size("a.sig"), F.size("b.sig")), F.size("a.sig"), F.size("b.sig")
    alike = lambda n: (n > 0) & ~((n == x) & (n == y)) & (n / less >= config.supersession_min_overlap)
    both = both.where(text.once(F.size(F.array_intersect("a.sig", "b.sig")), alike))
    return both.select(F.col("a.query_id").alias("query_id"), pick(True, "doc_id").alias("newer"), pick(False, "doc_id").alias("older"))


def mark_supersession(rows: DataFrame, config: Config) -> DataFrame:
    """Newer messages that supersede gain, older ones lose; the middle of a chain stays as it is."""
    pairs = supersession_pairs(rows, config)
    roles = pairs.select("query_id", F.col("newer").alias("doc_id"), F.lit(True).alias("n"), F.lit(False).alias("o")).unionByName(pairs.select("query_id", F.col("older").alias("doc_id"), F.lit(False).alias("n"), F.lit(True).alias("o")))
    roles = roles.groupBy("query_id", "doc_id").agg(F.max("n").alias("_new"), F.max("o").alias("_old"))
    rows = rows.join(roles, ["query_id", "doc_id"], "left")
    new, old = F.coalesce(F.col("_new") & ~F.col("_old"), F.lit(False)), F.coalesce(F.col("_old") & ~F.col("_new"), F.lit(False))
    rows = rows.withColumn("score", F.col("score") + F.when(new, config.supersession_weight).when(old, -config.supersession_penalty).otherwise(0.0))
    return add_flags(rows, supersedes_earlier=new, explicit_update_cue=new & F.lit(config.on("supersession_update_guard")), superseded=old).drop("_new", "_old")


def score(candidates: DataFrame, config: Config) -> DataFrame:
    rows = full_score(candidates, config)
    if config.on("preference_role_boost"):
        rows = preference_boost(rows, config)
    if config.on("rerank"):
        rows = mark_conflicts(rows)
    if config.on("supersession"):  # compares its own rows: computed once, not three times
        rows = mark_supersession(materialize(rows.drop("low", "q_tokens"), "scored"), config)
    return rows
