"""Adding batches of messages: validation, the ledger of requests, sequence numbers and session cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import ids
from tessera.operators import views

SESSION = ["user_id", "session_id"]
MESSAGES = "array<struct<role:string,content:string,ts_ms:bigint>>"


# -- payloads


def _kind(payload: Column, path: str) -> Column:
    """The JSON type at a path: OBJECT, ARRAY, STRING, BIGINT, DOUBLE or DECIMAL, BOOLEAN, VOID; null where it is missing."""
    v = F.try_variant_get(payload, path, "variant")
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _filled(payload: Column, path: str) -> Column:
    return F.coalesce((_kind(payload, path) == "STRING") & (F.trim(F.try_variant_get(payload, path, "string")) != ""), F.lit(False))


def validate_search(payloads: DataFrame, top_k_max: int = 100) -> DataFrame:
    """payloads (payload: JSON text) with query, user_id, top_k (cut at the maximum), options and error: the first field that breaks a rule."""
    v = F.col("_v")
    kind = lambda p: _kind(v, p)
    options_ok = kind("$.options").isNull() | (kind("$.options") == "VOID") | ((kind("$.options") == "ARRAY") & F.coalesce(F.forall(F.try_variant_get(v, "$.options", "array<variant>"), lambda o: F.schema_of_variant(o) == "STRING"), F.lit(False)))
    top = F.try_variant_get(v, "$.top_k", "bigint")
    error = F.when(v.isNull() | ~kind("$").isin("OBJECT"), "body").when(~_filled(v, "$.query"), "query").when(~_filled(v, "$.user_id"), "user_id").when(~F.coalesce(kind("$.top_k") == "BIGINT", F.lit(False)), "top_k").when(top < 0, "top_k").when(~options_ok, "options")
    rows = payloads.withColumn("_v", F.try_parse_json("payload")).withColumn("error", error)
    ok = F.col("error").isNull()
    return rows.select("*", *[F.when(ok, c).alias(n) for n, c in (("query", F.try_variant_get(v, "$.query", "string")), ("user_id", F.try_variant_get(v, "$.user_id", "string")), ("top_k", F.least(top, F.lit(top_k_max))), ("options", F.try_variant_get(v, "$.options", "array<string>")))]).drop("_v")


def validate_add(payloads: DataFrame) -> DataFrame:
    """payloads (payload: JSON text) with request_id, user_id, session_id, messages and error: the first field that breaks a rule, messages by their place. Unknown fields are left out."""
    v = F.col("_v")
    items = F.try_variant_get(v, "$.messages", "array<variant>")

    def item_error(m: Column, i: Column) -> Column:
        at = lambda name: F.concat(F.lit("messages["), i.cast("string"), F.lit("]"), F.lit(name))
        stamp = _kind(m, "$.timestamp")
        ok = stamp.isNull() | stamp.isin("VOID", "BIGINT") | (stamp.isin("DECIMAL", "DOUBLE") & F.coalesce(F.try_variant_get(m, "$.timestamp", "double") % 1 == 0, F.lit(False)))
        return F.when(~F.coalesce(_kind(m, "$") == "OBJECT", F.lit(False)), at("")).when(~_filled(m, "$.content"), at(".content")).when(~_filled(m, "$.role"), at(".role")).when(~ok, at(".timestamp"))

    listed = F.coalesce((_kind(v, "$.messages") == "ARRAY") & (F.size(items) > 0), F.lit(False))
    first_bad = F.element_at(F.concat(F.array_compact(F.transform(items, item_error)), F.array(F.lit(None).cast("string"))), 1)
    error = F.when(v.isNull() | ~_kind(v, "$").isin("OBJECT"), "body").when(~_filled(v, "$.request_id"), "request_id").when(~_filled(v, "$.user_id"), "user_id").when(~_filled(v, "$.session_id"), "session_id").when(~listed, "messages").otherwise(first_bad)
    rows = payloads.withColumn("_v", F.try_parse_json("payload")).withColumn("error", error)
    ok = F.col("error").isNull()
    message = lambda m: F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), F.try_variant_get(m, "$.content", "string").alias("content"), F.try_variant_get(m, "$.timestamp", "double").cast("bigint").alias("ts_ms"))
    return rows.select("*", *[F.when(ok, F.try_variant_get(v, f"$.{n}", "string")).alias(n) for n in ("request_id", "user_id", "session_id")], F.when(ok, F.transform(items, message)).alias("messages")).drop("_v")


# -- the ledger


def judge(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """requests (request_id, user_id, session_id, messages, arrival) with payload_hash and verdict: new, replay (the same payload under its key, in the ledger or earlier in the batch) or conflict (another one)."""
    rows = requests.withColumn("payload_hash", ids.payload_hash(F.col("user_id"), F.col("session_id"), F.col("messages")))
    known = ledger.select("request_id", "user_id", F.col("payload_hash").alias("_known"))
    rows = rows.join(known, ["request_id", "user_id"], "left")
    w = Window.partitionBy("request_id", "user_id").orderBy("arrival")
    ruling = F.coalesce(F.col("_known"), F.first("payload_hash").over(w))
    first = F.col("_known").isNull() & (F.row_number().over(w) == 1)
    return rows.withColumn("verdict", F.when(first, "new").when(F.col("payload_hash") == ruling, "replay").otherwise("conflict")).drop("_known")


def numbered(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """The messages of requests as rows with their ids; seq goes on from each session's count, in the order of arrival. A null session is a session of its own."""
    rows = requests.select("request_id", "user_id", "session_id", "arrival", F.posexplode("messages").alias("pos", "m"))
    prior = sessions.select(F.col("user_id").alias("_u"), F.col("session_id").alias("_s"), "msg_count")
    rows = rows.join(prior, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("session_id").eqNullSafe(F.col("_s")), "left")
    w = Window.partitionBy("user_id", "session_id").orderBy("arrival", "pos")
    seq = (F.row_number().over(w) - 1 + F.coalesce("msg_count", F.lit(0))).cast("long")
    rows = rows.withColumn("seq", seq)
    return rows.select(ids.message_id(F.col("user_id"), F.col("session_id"), F.col("seq")).alias("id"), "user_id", "session_id", "seq", "m.role", "m.content", "m.ts_ms", "request_id")


def cursors(messages: DataFrame, config: Config) -> DataFrame:
    """Per session: msg_count, last_ts_ms (last known), seg_index, seg_start, seg_count."""
    rows = views.segmented(messages, config.segment_max_messages, config.segment_max_gap_seconds)
    last = F.max_by("segment", "seq")
    out = rows.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("msg_count"), F.max_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), F.col("seq"))).alias("last_ts_ms"), last.alias("seg_index"))
    seg = rows.groupBy(*SESSION, "segment").agg(F.min("seq").alias("seg_start"), F.count(F.lit(1)).alias("seg_count"))
    a, b = out.alias("a"), seg.alias("b")
    joined = a.join(b, F.col("a.user_id").eqNullSafe(F.col("b.user_id")) & F.col("a.session_id").eqNullSafe(F.col("b.session_id")) & (F.col("a.seg_index") == F.col("b.segment")))
    return joined.select("a.*", "b.seg_start", "b.seg_count")


def changed_views(new: DataFrame, old: DataFrame) -> DataFrame:
    """Views whose content isn't stored yet under their id: what an upsert writes."""
    return new.join(old.select("view_id", "content_hash"), ["view_id", "content_hash"], "left_anti")


def baseline_add(requests: DataFrame, ledger: DataFrame, now_iso: str) -> tuple[DataFrame, DataFrame]:
    """The single-table baseline's add: requests (request_id, user_id, content, view, message_id, created_at, arrival), one message each, against its ledger (request_id, user_id, message_id).

    Returns what each request is answered (message_id, idempotent) and the new rows of messages (id, user_id, view,
    content, created_at, request_id, added_at). A key that is known, or came earlier in the batch, is answered with its
    first message; its payload isn't compared. Without an id a message gets one from its key.
    """
    made = F.coalesce("message_id", F.substring(F.sha2(F.concat_ws("\0", "user_id", "request_id"), 256), 1, 32))
    rows = requests.withColumn("_id", made).join(ledger.select("request_id", "user_id", F.col("message_id").alias("_known")), ["request_id", "user_id"], "left")
    w = Window.partitionBy("request_id", "user_id").orderBy("arrival", "_id")
    rows = rows.withColumn("_first", F.first("_id").over(w)).withColumn("idempotent", F.col("_known").isNotNull() | (F.row_number().over(w) > 1))
    answers = rows.select("request_id", "user_id", "arrival", F.coalesce("_known", "_first").alias("message_id"), "idempotent")
    new = rows.where("not idempotent").select(F.col("_id").alias("id"), "user_id", F.coalesce("view", F.lit("message")).alias("view"), "content", F.coalesce("created_at", F.lit(now_iso)).alias("created_at"), "request_id", F.lit(now_iso).alias("added_at"))
    return answers, new
