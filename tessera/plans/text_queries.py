"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import embed, ids, text
from tessera.operators import recall
from tessera.plans import corpora as c
from tessera.plans.registry import query


def T() -> F.Column:
    return F.col("t")


def joined(col):
    return F.array_join(col, "|")


def _both(spark, sf_dir):
    """The literal lines, and the statements with their number."""
    made = c.statements(spark, sf_dir).select(F.xxhash64("id").alias("n"), F.col("content").alias("t"), "id")
    return c.lines(spark).withColumn("id", F.concat(F.lit("l"), F.col("n").cast("string"))).unionByName(made)


BOTH = f"{c.VALUES}, {c.STATEMENTS}, b AS (SELECT 'l' || n AS id, t FROM l UNION ALL SELECT id, content FROM m)"


def _simple(name: str, spark_value, sql_value: str, column: str = "v"):
    @query(name, f"WITH {BOTH} SELECT id, {sql_value} AS {column} FROM b")
    def run(spark, sf_dir):
        return _both(spark, sf_dir).select("id", spark_value().alias(column))

    return run


_simple("normalize", lambda: text.normalize(T()), "lower(coalesce(t, ''))")
_simple("latin_words", lambda: joined(text.words(T())), f"array_to_string({c.sql_all('lower(t)', '[a-z0-9]+')}, '|')")
_simple("cjk_runs", lambda: joined(F.regexp_extract_all(T(), F.lit(text.CJK), F.lit(0))), f"array_to_string({c.sql_all('t', c.S_CJK)}, '|')")
_simple("cjk_bigrams", lambda: joined(text.cjk_ngrams(T(), 2)), f"array_to_string({c.s_cjk('t', 2)}, '|')")
_simple("cjk_trigrams", lambda: joined(text.cjk_ngrams(T(), 3)), f"array_to_string({c.s_cjk('t', 3)}, '|')")
_simple("extract_numbers", lambda: joined(text.numbers(T())), f"array_to_string({c.s_numbers('t')}, '|')")
_simple("extract_dates", lambda: joined(text.dates(T())), f"array_to_string({c.s_dates('t')}, '|')")
NO_DATES = f"regexp_replace(t, '{c.S_DATE}', ' ', 'g')"
_simple("extract_non_date_numbers", lambda: joined(text.non_date_numbers(T())), f"array_to_string({c.s_numbers(NO_DATES)}, '|')")
_simple("extract_phrases", lambda: joined(text.phrases(T())), f"array_to_string({c.sql_all('t', c.S_PHRASE, 1)}, '|')")
_simple("tokenize", lambda: joined(text.tokenize(T())), f"array_to_string({c.s_tokens('t')}, '|')")


@query("index_text", f"WITH {BOTH}, k AS (SELECT id, {c.s_tokens('t')} AS x FROM b) SELECT id, array_to_string({c.s_first('x')}, ' ') AS v FROM k")
def index_text(spark, sf_dir):
    return _both(spark, sf_dir).select("id", text.index_text(T()).alias("v"))


@query(
    "query_tokens",
    f"""WITH {BOTH}, k AS (SELECT id, list_filter(list_distinct({c.s_tokens('t')}), lambda x: x <> '' AND NOT list_contains({c.s_stop()}, x)) AS x FROM b),
u AS (SELECT id, unnest(x) AS x FROM k), r AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY -length(x), x) AS n FROM u)
SELECT b.id, coalesce(string_agg(x, '|' ORDER BY n) FILTER (WHERE n <= 12), '') AS v FROM b LEFT JOIN r ON r.id = b.id GROUP BY b.id""",
)
def query_tokens(spark, sf_dir):
    return _both(spark, sf_dir).select("id", joined(text.query_tokens(T(), 12)).alias("v"))


ENT = f"e AS (SELECT id, {c.s_entities('t')} AS x FROM b), f AS (SELECT id, x, list_transform(x, lambda y: lower(y)) AS y FROM e), g AS (SELECT id, list_filter(x, lambda a, i: list_position(y, lower(a)) = i) AS x FROM f)"


@query("extract_entities", f"WITH {BOTH}, {ENT} SELECT id, array_to_string(x, '|') AS v FROM g")
def extract_entities(spark, sf_dir):
    return _both(spark, sf_dir).select("id", joined(text.entities(T())).alias("v"))


@query("extract_protection_entities", f"WITH {BOTH}, {ENT} SELECT id, array_to_string(list_filter(x, lambda a: NOT list_contains({c.s_stop()}, lower(a))), '|') AS v FROM g")
def extract_protection_entities(spark, sf_dir):
    return _both(spark, sf_dir).select("id", joined(text.protection_entities(T())).alias("v"))


PREFERS = r"regexp_matches(t, '(?:我|本人|我们)[^。！？!?]{0,16}(?:喜欢|偏好|首选|最爱|爱用|常用|习惯|更愿意)') OR regexp_matches(t, '(?i)\b(?:i|we)\s+(?:(?:really|usually|generally)\s+)?(?:prefer|like|favor|favour|use|tend\s+to\s+use)\b|\b(?:my|our)\s+(?:favorite|favourite|preferred|go-to)\b')"
PROFILE = r"regexp_matches(t, '我|本人') OR regexp_matches(t, '(?i)\b(?:i|i''m|i''ve|i''d|my|mine|we|we''re|we''ve|our|ours)\b')"


@query(
    "intent_flags",
    f"""WITH {BOTH} SELECT id, {c.s_any('t', text.TEMPORAL)} AS temporal, {c.s_any('t', text.UPDATE)} AS cue, {c.s_any('t', text.PREFERENCE)} AS preference,
({c.s_any('t', text.PREFERENCE)} OR {c.s_any('t', text.RECOMMEND)}) AS personal, {c.s_any('t', text.NUMERIC)} AS numeric_value, {c.s_any('t', text.CALENDAR)} AS date_value,
({PREFERS}) AS prefers, ({PREFERS} OR {PROFILE}) AS profile FROM b""",
)
def intent_flags(spark, sf_dir):
    return _both(spark, sf_dir).select(
        "id", text.temporal_intent(T()).alias("temporal"), text.update_cue(T()).alias("cue"), text.preference_intent(T()).alias("preference"), text.personalization_intent(T()).alias("personal"),
        text.numeric_intent(T()).alias("numeric_value"), text.date_intent(T()).alias("date_value"), text.direct_preference(T()).alias("prefers"), text.direct_profile(T()).alias("profile"),
    )


@query("signature", f"WITH {BOTH}, k AS (SELECT id, list_distinct({c.s_tokens('t')}) AS x FROM b) SELECT id, array_to_string(list_sort(list_filter(x, lambda a: length(a) >= 2)), '|') AS v FROM k")
def signature(spark, sf_dir):
    return _both(spark, sf_dir).select("id", joined(F.array_sort(text.signature(T()))).alias("v"))


#: The baseline's tokens: within a span without separators, CJK pairs run across Latin letters.
SPAN = f"list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda s: s <> '')"
ONLY = c.S_CJK.replace("[", "[^").removesuffix("+")
P0 = f"""p0 AS (SELECT id, {SPAN} AS spans FROM b), p1 AS (SELECT id, spans, list_filter(list_transform(spans, lambda s: regexp_replace(s, '{ONLY}', '', 'g')), lambda s: s <> '') AS cjk FROM p0),
p2 AS (SELECT id, list_concat(flatten(list_transform(cjk, lambda s: list_transform(generate_series(1, length(s)), lambda i: substr(s, i, 1)))),
  flatten(list_transform(list_filter(cjk, lambda s: length(s) >= 2), lambda s: list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, i, 2)))),
  list_filter(flatten(list_transform(spans, lambda s: string_split_regex(s, '{c.S_CJK}'))), lambda s: s <> '')) AS x FROM p1)"""


@query("baseline_tokens", f"WITH {BOTH}, {P0} SELECT id, array_to_string(x, '|') AS v FROM p2")
def baseline_tokens(spark, sf_dir):
    return _both(spark, sf_dir).select("id", joined(text.baseline_tokens(T())).alias("v"))


@query(
    "message_ids",
    f"""WITH {c.CHAT} SELECT id, 'w_' || substr(sha1(user_id || chr(0) || session_id), 1, 12) || '_' || seq AS window_id, 's_' || substr(sha1(user_id || chr(0) || session_id), 1, 12) || '_' || seq AS segment_id,
sha1(content) AS hash, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS created_at FROM m""",
)
def message_ids(spark, sf_dir):
    u, s, q = F.col("user_id"), F.col("session_id"), F.col("seq")
    return c.chat(spark, sf_dir).select("id", ids.window_id(u, s, q).alias("window_id"), ids.segment_id(u, s, q).alias("segment_id"), ids.content_hash(F.col("content")).alias("hash"), ids.iso(F.col("ts_ms")).alias("created_at"))


@query(
    "payload_hash",
    f"""WITH {c.STATEMENTS}, g AS (SELECT user_id, session_id, string_agg('{{"content":' || to_json(content)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || ',"ts_ms":' || ts_ms || '}}', ',' ORDER BY seq) AS body FROM m GROUP BY user_id, session_id)
SELECT user_id, session_id, sha256('{{"messages":[' || body || '],"session_id":' || to_json(session_id)::VARCHAR || ',"user_id":' || to_json(user_id)::VARCHAR || '}}') AS payload_hash FROM g""",
)
def payload_hash(spark, sf_dir):
    rows = c.statements(spark, sf_dir).groupBy("user_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content", "ts_ms"))).alias("messages"))
    return rows.select("user_id", "session_id", ids.payload_hash(F.col("user_id"), F.col("session_id"), F.col("messages")).alias("payload_hash"))


@query("hash_embedding")
def hash_embedding(spark, sf_dir):
    v = embed.embed(F.col("content"), embed.HashEmbedding(64))
    return c.chat(spark, sf_dir).select("id", v.alias("vector"))


@query("cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.label = b.label")
def cosine(spark, sf_dir):
    e = c.table(spark, sf_dir, "embeddings")
    v = e.select("vec_id", F.col("label").alias("user_id"), F.col("embedding").alias("vector"))
    rows = recall.similarities(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "doc_id"), None)
    return rows.select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"), F.round("score", 6).alias("similarity"))


@query(
    "epoch_age",
    f"WITH {c.STATEMENTS} SELECT id, ts_ms / 1000.0::DOUBLE AS epoch, round(greatest(0, (1735689600.0::DOUBLE - ts_ms / 1000.0::DOUBLE) / 86400.0::DOUBLE), 6) AS age FROM m",
)
def epoch_age(spark, sf_dir):
    e = ids.epoch(F.col("ts_ms"))
    return c.statements(spark, sf_dir).select("id", e.alias("epoch"), F.round(ids.age_days(e, F.lit(1735689600.0)), 6).alias("age"))
