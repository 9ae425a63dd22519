"""Derived views of sessions: sliding windows of messages, and segments cut at length or time gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import ids

SESSION = ["user_id", "session_id"]


def _collected(grouped) -> DataFrame:
    """Per group the messages in order, as content lines, sources and bounds."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "id", "role", "content", "ts_ms")))
    line = lambda m: F.concat(F.when(F.trim(F.coalesce(m["role"], F.lit(""))) != "", F.concat(m["role"], F.lit(": "))).otherwise(""), F.coalesce(m["content"], F.lit("")))
    return grouped.agg(ordered.alias("m")).select(
        "*", F.array_join(F.transform("m", line), "\n").alias("content"), F.transform("m", lambda x: x["id"]).alias("source_ids"),
        F.element_at("m", 1)["seq"].alias("start_seq"), F.element_at("m", -1)["seq"].alias("end_seq"), F.element_at("m", 1)["ts_ms"].alias("ts_ms"),
    ).drop("m")


def window_starts(messages: DataFrame, size: int, overlap: int) -> DataFrame:
    """messages with the start of every window that holds them; windows start at multiples of size - overlap below the session's length."""
    step = max(1, size - overlap)
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - (size - 1)) / F.lit(step)))
    return messages.withColumn("start", F.explode(F.sequence(first, F.floor(F.col("seq") / F.lit(step))))).withColumn("start", F.col("start") * step)


def windows(messages: DataFrame, config: Config) -> DataFrame:
    rows = window_starts(messages, config.window_size, config.window_overlap)
    made = _collected(rows.groupBy(*SESSION, "start"))
    return made.select(ids.window_id(F.col("user_id"), F.col("session_id"), F.col("start")).alias("view_id"), *SESSION, F.lit("window").alias("view_type"), "content", "source_ids", "start_seq", "end_seq", "ts_ms")


def affected_starts(sessions: DataFrame, size: int, overlap: int) -> DataFrame:
    """sessions (.., old_total, new_total) with the starts of the windows that an append touches."""
    step = max(1, size - overlap)
    # from the first start whose window reaches beyond the old end
    first = F.greatest(F.lit(0), F.floor((F.col("old_total") - size) / F.lit(step)) + 1)
    last = F.floor((F.col("new_total") - 1) / F.lit(step))
    grown = sessions.where("new_total > 0").withColumn("start", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    return grown.withColumn("start", F.col("start") * step)


def segmented(messages: DataFrame, max_messages: int, max_gap_seconds: int) -> DataFrame:
    """messages with their segment number. A gap is measured from the last known time; all windows go by one order, so that a task sorts a session's rows once."""
    order = Window.partitionBy(*SESSION).orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    gap_ms = max(0, max_gap_seconds) * 1000
    gap = F.coalesce(F.col("ts_ms") - F.last("ts_ms", ignorenulls=True).over(before) > gap_ms, F.lit(False)) if gap_ms else F.lit(False)
    rows = messages.withColumn("_gap", gap).withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("_first", F.max(F.when(F.col("_gap") | (F.col("_n") == 1), F.col("_n"))).over(upto))
    rows = rows.withColumn("_cut", ((F.col("_n") - F.col("_first")) % max(1, max_messages) == 0).cast("int"))
    return rows.withColumn("segment", F.sum("_cut").over(upto) - 1).drop("_gap", "_n", "_first", "_cut")


def segments(messages: DataFrame, config: Config) -> DataFrame:
    rows = segmented(messages, config.segment_max_messages, config.segment_max_gap_seconds)
    made = _collected(rows.groupBy(*SESSION, "segment"))
    return made.select(ids.segment_id(F.col("user_id"), F.col("session_id"), F.col("segment")).alias("view_id"), *SESSION, F.lit("session-segment").alias("view_type"), "content", "source_ids", "start_seq", "end_seq", "ts_ms")


def all_views(messages: DataFrame, config: Config) -> DataFrame:
    return windows(messages, config).unionByName(segments(messages, config)).withColumn("content_hash", ids.content_hash(F.col("content")))


def documents(messages: DataFrame, config: Config) -> DataFrame:
    """Messages and, if views are on, their views as one table of searchable documents."""
    docs = messages.select(F.col("id").alias("doc_id"), "user_id", F.lit("message").alias("doc_type"), "session_id", "seq", "role", "content", "ts_ms", F.array("id").alias("source_ids"))
    if config.on("views"):
        views = all_views(messages, config)
        docs = docs.unionByName(views.select(F.col("view_id").alias("doc_id"), "user_id", F.col("view_type").alias("doc_type"), "session_id", F.col("start_seq").alias("seq"), F.lit(None).cast("string").alias("role"), "content", "ts_ms", "source_ids"))
    return docs


def refresh(old: DataFrame, touched: DataFrame, messages: DataFrame, config: Config) -> DataFrame:
    """Views after an append: those of touched sessions (user_id, session_id) are made anew, the others stay; equals all_views of all messages."""
    key = [old.user_id.eqNullSafe(touched.user_id), old.session_id.eqNullSafe(touched.session_id)]
    kept = old.join(touched, key, "left_anti")
    mine = messages.join(touched, [messages.user_id.eqNullSafe(touched.user_id), messages.session_id.eqNullSafe(touched.session_id)], "left_semi")
    return kept.unionByName(all_views(mine, config))
