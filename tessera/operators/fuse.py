"""Candidate union, rank fusion, dedup, message slots and the evidence rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators.cut import materialize

CHANNELS = ("fts", "feature", "dense")


def best(digits: int) -> list[F.Column]:
    """Score down, content length up, id up. Scores are compared rounded, since sums that are equal may differ in their last bits."""
    return [F.desc(F.round("score", digits)), F.length(F.coalesce("content", F.lit(""))), F.col("doc_id")]


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """(query_id, doc_id) of any channel with each channel's rank and score, null where it lacks the document; one shuffle."""
    rows = None
    for name in CHANNELS:
        if name in channels:
            part = channels[name].select("query_id", "doc_id", *[F.when(F.lit(c == name), F.col(v)).alias(f"{c}_{v}") for c in CHANNELS for v in ("rank", "score")])
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "doc_id").agg(*[F.max(f"{c}_{v}").alias(f"{c}_{v}") for c in CHANNELS for v in ("rank", "score")])


def rerank_features(rows: DataFrame) -> DataFrame:
    """The feature channel's rank by the full score, among its own documents."""
    member = F.col("feature_rank").isNotNull()
    w = Window.partitionBy("query_id", member).orderBy(*best(9))
    return rows.withColumn("feature_rank", F.when(member, F.row_number().over(w)))


def channel_ranks() -> F.Column:
    entries = F.array_compact(F.array(*[F.when(F.col(f"{c}_rank").isNotNull(), F.struct(F.lit(c).alias("key"), F.col(f"{c}_rank").cast("int").alias("value"))) for c in ("dense", "feature", "fts")]))
    return F.map_from_entries(entries)


def fuse(rows: DataFrame, config: Config) -> DataFrame:
    """Weighted reciprocal ranks instead of the score, if on; terms are added in a fixed order, so that ties stay ties. Adds channel flags and ranks."""
    from tessera.operators.score import add_flags

    rows = add_flags(rows, **{f"channel:{c}": F.col(f"{c}_rank").isNotNull() for c in ("dense", "feature", "fts")}).withColumn("channel_ranks", channel_ranks())
    if not config.on("rrf"):
        return rows
    weight = {"fts": config.rrf_weight_lexical, "feature": config.rrf_weight_feature, "dense": config.rrf_weight_dense}
    total = F.lit(0.0)
    for c in CHANNELS:
        if weight[c]:
            total = total + F.coalesce(F.lit(float(weight[c])) / (F.lit(config.rrf_k) + F.col(f"{c}_rank")), F.lit(0.0))
    return add_flags(rows.withColumn("score", total), rrf=F.lit(True))


def in_order(rows: DataFrame) -> DataFrame:
    """rows with position: score down, content length up, id up."""
    w = Window.partitionBy("query_id").orderBy(*best(12))
    return rows.withColumn("position", F.row_number().over(w))


#: Rows that a task of dedup holds at once: several queries' candidates.
FOLDED = 100_000


def fold(rows) -> list[int]:
    """Numbers of the rows (digest, view, sources), in order, that dedup keeps."""
    out, n, hashes, holders = [], 0, set(), {}  # n: kept views, holders: the numbers of those that hold a source
    for place, (digest, view, sources) in enumerate(rows):
        if digest in hashes:
            continue
        if view and sources is not None:
            if n and (len(sources) == 0 or set.intersection(*(holders.get(s, set()) for s in sources))):
                continue
            for s in sources:
                holders.setdefault(s, set()).add(n)
            n += 1
        hashes.add(digest)
        out.append(place)
    return out


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """query_id and position of the rows that dedup keeps."""
    rows = rows.sort_values(["query_id", "position", "doc_id"], kind="stable", ignore_index=True)
    kept = [at[i] for at in rows.groupby("query_id", sort=False).indices.values() for i in fold(zip(*(rows[c].to_numpy()[at] for c in ("hash", "view", "sources"))))]
    return rows.loc[kept, ["query_id", "position"]]


def dedup(rows: DataFrame) -> DataFrame:
    """rows (with position) without those whose content a kept row has, and views whose sources a kept view covers. A query has at most the candidate limits' rows, so its ordered list is bounded; views alone enter the covered list."""
    rows = materialize(rows, "ranked")
    groups = max(1, -(-rows.count() // FOLDED))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query_id", "position")]
    item = rows.select(
        F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("_group"), "query_id", "position", "doc_id", F.unhex(F.sha1(F.coalesce("content", F.lit("")))).alias("hash"),
        (F.col("doc_type") != "message").alias("view"), F.when(F.col("doc_type") != "message", F.col("source_ids")).alias("sources"),
    )
    kept = item.groupBy("_group").applyInPandas(_folded, ", ".join(kinds))
    return rows.join(kept, ["query_id", "position"], "left_semi")


def slots(rows: DataFrame, config: Config) -> DataFrame:
    """The first k rows of each query, with enough messages among them: the last views make way for the next messages. Adds position (1-based) and total (before the cut)."""
    w = Window.partitionBy("query_id")
    order = w.orderBy(*best(12))
    rows = rows.withColumn("_rn", F.row_number().over(order) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    msg, head = F.col("doc_type") == "message", F.col("_rn") < F.col("k")
    rows = rows.withColumn("_have", F.sum((msg & head).cast("int")).over(w)).withColumn("_after", F.sum((msg & ~head).cast("int")).over(w)).withColumn("_views", F.sum((~msg & head).cast("int")).over(w))
    rank = F.row_number().over(Window.partitionBy("query_id", msg, head).orderBy("_rn"))
    need = F.greatest(F.floor(F.col("k") * F.lit(config.message_slot_ratio)) - F.col("_have"), F.lit(0))
    take = F.when((F.col("total") > F.col("k")) & F.lit(config.message_slot_ratio > 0), F.least(need, F.col("_after"))).otherwise(0)
    rows = rows.withColumn("_rank", rank).withColumn("_take", take)
    rows = rows.where((msg & head) | (~msg & head & (F.col("_rank") <= F.col("_views") - F.col("_take"))) | (msg & ~head & (F.col("_rank") <= F.col("_take"))))
    return rows.withColumn("position", F.row_number().over(w.orderBy("_rn"))).drop("_rn", "_have", "_after", "_views", "_rank", "_take")


def evidence(rows: DataFrame) -> DataFrame:
    """What a search returns, in the order of position."""
    ranks = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("channel_ranks")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"].cast("string"))), ", "), F.lit("}"))
    provenance = F.concat(F.col("doc_type"), F.lit(":"), F.col("doc_id"), F.lit("<-["), F.array_join("source_ids", ","), F.lit("];channels="), ranks)
    extra = [c for c in ("created_at", "semantic_score") if c in rows.columns]
    return rows.select("query_id", "user_id", "position", "doc_id", F.col("doc_type").alias("view"), "content", "ts_ms", F.round("score", 6).alias("score"), "source_ids", provenance.alias("provenance"), F.col("flags").alias("evidence_flags"), "channel_ranks", "total", *extra)
