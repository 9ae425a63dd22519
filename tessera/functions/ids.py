"""Ids, hashes, time and vectors as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def message_id(user: Column, session: Column, seq: Column) -> Column:
    return F.concat(F.lit("m_"), F.substring(F.sha1(_joined(user, session, seq)), 1, 16))


def scope_key(user: Column, session: Column) -> Column:
    return F.substring(F.sha1(_joined(user, session)), 1, 12)


def window_id(user: Column, session: Column, start: Column) -> Column:
    return F.concat(F.lit("w_"), scope_key(user, session), F.lit("_"), start.cast("string"))


def segment_id(user: Column, session: Column, number: Column) -> Column:
    return F.concat(F.lit("s_"), scope_key(user, session), F.lit("_"), number.cast("string"))


def content_hash(c: Column) -> Column:
    return F.sha1(F.coalesce(c, F.lit("")))


def payload_hash(user: Column, session: Column, messages: Column) -> Column:
    """SHA-256 of the compact JSON of a batch with its keys in order and nulls kept; messages: array of (role, content, ts_ms)."""
    items = F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"), m["ts_ms"].alias("ts_ms")))
    return F.sha2(F.to_json(F.struct(items.alias("messages"), session.alias("session_id"), user.alias("user_id")), {"ignoreNullFields": "false"}), 256)


def epoch(ts_ms: Column, created_at: Column | None = None) -> Column:
    """Event time in seconds: ts_ms, else an ISO time (without a zone: UTC), else null."""
    own = ts_ms.cast("double") / 1000.0
    return own if created_at is None else F.coalesce(own, F.unix_micros(F.try_to_timestamp(created_at)).cast("double") / 1e6)


def age_days(seconds: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - seconds) / 86400.0)


def iso(ts_ms: Column) -> Column:
    """ISO-8601 in UTC; the fraction only where there is one."""
    t = F.timestamp_millis(ts_ms)
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(ts_ms, F.lit(1000)) != 0, F.date_format(t, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either vector has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda l, r: F.aggregate(F.zip_with(l, r, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)  # noqa: E731, E741
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def valid_vector(v: Column, dimension: Column) -> Column:
    """Whether a stored vector has its declared length and only finite values."""
    return v.isNotNull() & (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
