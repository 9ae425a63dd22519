"""Deletion, retention, counts and fingerprints over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete_users(table: DataFrame, users: DataFrame) -> DataFrame:
    """table without the rows of users (user_id)."""
    return table.join(users.select("user_id").distinct(), "user_id", "left_anti")


def deletion_report(tables: dict[str, DataFrame], users: DataFrame) -> DataFrame:
    """table, deleted: how many rows of each table the users have."""
    out = None
    gone = users.select("user_id").distinct()
    for name, table in sorted(tables.items()):
        part = table.join(gone, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        out = part if out is None else out.unionByName(part)
    return out


def stale_users(messages: DataFrame, cutoff, added_at: str = "added_at") -> DataFrame:
    """Users whose last message was added before the cutoff."""
    return messages.groupBy("user_id").agg(F.max(added_at).alias("last")).where(F.col("last") < cutoff).select("user_id")


def purge_stale(tables: dict[str, DataFrame], cutoff, days: int, added_at: str = "added_at") -> dict[str, DataFrame]:
    """tables without users that are stale; days <= 0 keeps everything."""
    if days <= 0:
        return tables
    users = stale_users(tables["messages"], cutoff, added_at)
    return {n: delete_users(t, users) if "user_id" in t.columns else t for n, t in tables.items()}


def purge_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: t.limit(0) for n, t in tables.items()}


def count(messages: DataFrame, user_id: str | None = None) -> int:
    return (messages if user_id is None else messages.where(F.col("user_id") == user_id)).count()


def stats(messages: DataFrame, views: DataFrame, requests: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: messages, views, requests, users, embeddings, vector_bytes."""
    parts = [
        messages.agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("user_id").alias("users")),
        views.agg(F.count(F.lit(1)).alias("views")),
        requests.agg(F.count(F.lit(1)).alias("requests")),
        embeddings.agg(F.count(F.lit(1)).alias("embeddings"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).cast("long").alias("vector_bytes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def fingerprint(table: DataFrame, *columns: str) -> DataFrame:
    """rows and a digest of the table's content whatever its order: the SHA-256 of rows are summed limb by limb, so no row list is collected."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), 256)
    limbs = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = table.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i, x in enumerate(limbs)])
    return sums.select("rows", F.sha2(F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(8)]), 256).alias("digest"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, counted, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
