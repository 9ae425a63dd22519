"""Reranking of a returned list: semantic order of its tail with pinned anchors, and pair scores in three modes. Membership never changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

EXACT_FLAGS = ["exact_substring", "phrase", "entity", "date", "number"]


def anchors(rows: DataFrame, bucket: str, quota: int) -> DataFrame:
    """rows with pinned: the first quota rows of each bucket that match exactly and share neither sources nor content with one before. An entity match counts only for an entity that is no question word (column entities; null: any)."""
    low = text.normalize(F.col("content"))
    named = F.col("entities").isNull() | F.exists("entities", lambda e: F.contains(low, e))
    exact = F.filter("flags", lambda f: f.isin(EXACT_FLAGS) & ((f != "entity") | named))
    sources = F.when(F.size("source_ids") > 0, F.col("source_ids")).otherwise(F.array("doc_id"))
    item = F.struct("position", sources.alias("sources"), F.trim(F.regexp_replace(low, r"(?U)\s+", " ")).alias("said"))
    empty = lambda t: F.array().cast(t)
    start = F.struct(empty("array<int>").alias("at"), empty("array<string>").alias("sources"), empty("array<string>").alias("said"))

    def step(s, x):
        skip = (F.size(s["at"]) >= quota) | F.arrays_overlap(s["sources"], x["sources"]) | ((x["said"] != "") & F.array_contains(s["said"], x["said"]))
        return F.when(skip, s).otherwise(F.struct(F.concat(s["at"], F.array(x["position"])).alias("at"), F.concat(s["sources"], x["sources"]).alias("sources"), F.concat(s["said"], F.array(x["said"])).alias("said")))

    able = rows.where(F.size(exact) > 0).groupBy("query_id", bucket).agg(F.array_sort(F.collect_list(item)).alias("items"))
    found = able.select("query_id", F.explode(F.aggregate("items", start, step, lambda s: s["at"])).alias("position")).withColumn("pinned", F.lit(True))
    return rows.join(found, ["query_id", "position"], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))


def reorder(rows: DataFrame, bucket: str, score: Column) -> DataFrame:
    """rows with new_position: within a bucket the rows that aren't pinned take the unpinned places by score, ties by their place before. Two row numbers, of free places and of movable rows, are joined; no list is collected."""
    w = Window.partitionBy("query_id", bucket)
    free = rows.where("not pinned").select("query_id", bucket, F.col("position").alias("new_position"), F.row_number().over(w.orderBy("position")).alias("_k"))
    moved = rows.where("not pinned").withColumn("_k", F.row_number().over(w.orderBy(F.desc(score), "position"))).join(free, ["query_id", bucket, "_k"]).drop("_k")
    return moved.unionByName(rows.where("pinned").withColumn("new_position", F.col("position")))


def usable(score: str = "model_score") -> Column:
    """Whether all scores of a query are finite numbers; else it falls back whole."""
    c = F.col(score)
    return F.min((c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))).cast("int")).over(Window.partitionBy("query_id")) == 1


def _finish(rows: DataFrame, flags: list, fallback: str) -> DataFrame:
    from tessera.operators.score import add_flags

    rows = add_flags(rows, **dict(flags), **{fallback: ~F.col("_ok")})
    rows = rows.withColumn("pre_rerank", F.col("position")).withColumn("position", F.when(F.col("_ok"), F.col("new_position")).otherwise(F.col("position")))
    return rows.withColumn("semantic_score", F.when(F.col("_ok"), F.col("model_score"))).drop("new_position", "_ok", "_bucket", "pinned")


def protected(rows: DataFrame, boundary: int = 20, pool: int = 100, quota: int = 3) -> DataFrame:
    """Order rows (position, model_score, flags, source_ids, content, entities) beyond the boundary by model score, bucket by bucket, with anchors pinned; the front keeps its order."""
    stop = F.least(F.lit(pool), F.max("position").over(Window.partitionBy("query_id")))
    end = F.when(F.col("position") > stop, -1).when(F.col("position") <= F.least(F.lit(5), stop), 5).when(F.col("position") <= F.least(F.lit(boundary), stop), boundary).otherwise(pool)
    if boundary < 5:
        end = F.when(F.col("position") > stop, -1).when(F.col("position") <= boundary, boundary).when(F.col("position") <= 5, 5).otherwise(pool)
    rows = rows.withColumn("_ok", usable()).withColumn("_bucket", end)
    rows = anchors(rows, "_bucket", quota)
    frozen = (F.col("_bucket") == -1) | (F.col("_bucket") <= boundary)
    rows = reorder(rows.withColumn("pinned", F.col("pinned") | frozen), "_bucket", F.col("model_score"))
    return _finish(rows, [("semantic_rerank", F.col("_ok"))], "semantic_rerank_fallback")


def validate_pair_policy(mode: str, weight: float, k: float, top20: bool = False, exact: bool = False) -> None:
    if mode not in ("model", "rrf", "cc"):
        raise ValueError("mode must be model, rrf or cc")
    if not isinstance(top20, bool) or not isinstance(exact, bool):
        raise ValueError("protections must be boolean")
    if (top20 or exact) and mode != "model":
        raise ValueError("protections need mode model")
    if isinstance(weight, bool) or not (math.isfinite(weight) and 0 <= weight <= 1) or isinstance(k, bool) or not (math.isfinite(k) and k > 0):
        raise ValueError("weight must be within [0, 1] and k positive")


def pair(rows: DataFrame, pool: int = 100, mode: str = "model", weight: float = 0.25, k: float = 60.0, top20: bool = False, exact: bool = False) -> DataFrame:
    """Order the first pool rows by pair scores (model_score): by themselves, fused by rank with the order before (rrf), or by a convex sum of min-max scaled scores (cc). top20 keeps the first twenty's membership, exact pins up to three anchors."""
    validate_pair_policy(mode, weight, k, top20, exact)
    scored = F.col("position") <= pool
    rest = rows.where(~scored)
    w = Window.partitionBy("query_id")
    rows = rows.where(scored).withColumn("_ok", usable())
    rows = rows.withColumn("pair_model", F.row_number().over(w.orderBy(F.desc("model_score"), "position")))
    by = F.col("model_score")
    if mode == "rrf":
        # in units of 1e-15: sums that are equal may differ in their last bits
        by = F.floor((F.lit(1 - weight) / (F.lit(float(k)) + F.col("position")) + F.lit(weight) / (F.lit(float(k)) + F.col("pair_model"))) * 1e15 + 0.5)
    elif mode == "cc":
        scale = lambda c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(0.0)
        rows = rows.withColumn("_s", scale("score")).withColumn("_m", scale("model_score"))
        by = F.lit(1 - weight) * F.col("_s") + F.lit(weight) * F.col("_m")
    rows = rows.withColumn("_by", by).withColumn("_all", F.lit(0))
    rows = anchors(rows, "_all", 3) if exact else rows.withColumn("pinned", F.lit(False))
    rows = rows.withColumn("_anchor", F.col("pinned")).withColumn("_bucket", F.when(F.lit(top20) & (F.col("position") > 20), 1).otherwise(0))
    rows = reorder(rows, "_bucket", F.col("_by"))
    ok = F.col("_ok")
    flags = [("pair_rerank", ok), ("pair_top20_protect", ok & F.lit(top20)), ("pair_exact_protect", ok & F.lit(exact)), ("pair_exact_anchor", ok & F.col("_anchor")), ("pair_rrf", ok & F.lit(mode == "rrf")), ("pair_cc", ok & F.lit(mode == "cc"))]
    rows = _finish(rows, flags, "pair_rerank_fallback").drop("_by", "_all", "_anchor", "_s", "_m")
    return rows.unionByName(rest.withColumn("pre_rerank", F.col("position")), allowMissingColumns=True)
