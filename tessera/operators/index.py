"""The lexical index as tables: postings, term and corpus statistics; and the vector index's upkeep."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text


class Stored(NamedTuple):
    """An index kept between searches: terms (doc_id, .., dl, terms) and postings of the documents that are searched, and the global statistics: term_stats (term, df; a term may have several rows, which add up) and one row of n, avgdl."""

    terms: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus: DataFrame


def indexed(docs: DataFrame) -> DataFrame:
    """docs with their index terms and length."""
    return docs.withColumn("terms", text.index_terms(F.col("content"))).withColumn("dl", F.size("terms").cast("long"))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, user_id, doc_type, dl, term, tf; one shuffle, pre-aggregated. docs may be indexed already."""
    docs = docs if "terms" in docs.columns else indexed(docs)
    rows = docs.select("doc_id", "user_id", "doc_type", "dl", F.explode("terms").alias("term"))
    return rows.groupBy("doc_id", "user_id", "doc_type", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(posts: DataFrame, scope: str = "global") -> DataFrame:
    """How many documents have each term, over all users or by user."""
    return posts.groupBy(*(["user_id"] if scope == "user" else []), "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, scope: str = "global") -> DataFrame:
    """n documents and their average length; one row, or one a user."""
    rows = (docs if "terms" in docs.columns else indexed(docs)).select("user_id", "dl")
    return rows.groupBy(*(["user_id"] if scope == "user" else [])).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def sync_embeddings(docs: DataFrame, stored: DataFrame, model_hash: str, embed) -> DataFrame:
    """The embeddings table after a refresh: rows of documents that are gone are dropped, missing and stale ones (content or model changed) are computed by embed(content), fresh ones stay as they are."""
    now = docs.select("doc_id", "user_id", "doc_type", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), F.lit(model_hash).alias("model_hash"), "content")
    key = ["doc_id", "content_hash", "model_hash"]
    fresh = stored.join(now.select(*key), key, "left_semi")
    todo = now.join(stored.select(*key), key, "left_anti")
    made = todo.withColumn("vector", embed(F.col("content"))).withColumn("dimension", F.size("vector")).drop("content")
    return fresh.unionByName(made.select(fresh.columns))


def stale_embeddings(docs: DataFrame, stored: DataFrame, model_hash: str) -> DataFrame:
    """doc_id and action of each document: keep, embed (missing or stale) or drop (orphan)."""
    now = docs.select("doc_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    held = stored.select(F.col("doc_id").alias("old_id"), F.col("content_hash").alias("old_hash"), "model_hash")
    both = now.join(held, now.doc_id == held.old_id, "full_outer")
    action = F.when(F.col("doc_id").isNull(), "drop").when(F.col("old_id").isNull() | (F.col("content_hash") != F.col("old_hash")) | (F.col("model_hash") != model_hash), "embed").otherwise("keep")
    return both.select(F.coalesce("doc_id", "old_id").alias("doc_id"), action.alias("action"))


def cached_vectors(docs: DataFrame, cache: DataFrame, model_hash: str, dimension: int, embed=None) -> DataFrame:
    """docs (doc_id, content) with vectors from a read-only cache (content_hash, model_hash, dimension, vector); what it lacks is computed, or left null without embed. A text that several cache rows hold takes the least of their usable vectors, so each document stays one row."""
    from tessera.functions.ids import valid_vector

    good = cache.where((F.col("model_hash") == model_hash) & (F.col("dimension") == dimension) & valid_vector(F.col("vector"), F.col("dimension"))).groupBy("content_hash").agg(F.min("vector").alias("cached"))
    rows = docs.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).join(good, "content_hash", "left").withColumn("from_cache", F.col("cached").isNotNull())
    if embed is None:
        return rows.withColumnRenamed("cached", "vector")
    hit, miss = rows.where("from_cache").withColumnRenamed("cached", "vector"), rows.where("not from_cache").drop("cached")
    return hit.unionByName(miss.withColumn("vector", embed(F.col("content"))).select(hit.columns))
