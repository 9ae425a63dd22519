"""Search of a table of queries over a table of documents, as one plan keyed by query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text
from tessera.operators import blocks, fuse, index, recall, rerank, whole
from tessera.operators.cut import materialize

HYDRATED = ["doc_id", "doc_type", "session_id", "seq", "role", "content", "ts_ms", "source_ids"]


def union(prepared: DataFrame, docs: DataFrame, config: Config, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, stored: index.Stored | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prepared queries, documents and the union of the channels. Documents (unless they are indexed or their index is stored, as they are written then) and prepared queries are written once: all channels and the hydration read them."""
    docs, prepared = docs if stored is not None or "terms" in docs.columns else materialize(index.indexed(docs), "documents"), materialize(prepared, "queries")
    lexical = recall.lexical(prepared, docs, config, stored)
    if config.on("exact_scan"):
        messages = docs.where("doc_type = 'message'").withColumnRenamed("doc_id", "id")
        lexical = lexical.unionByName(recall.like_fallback(prepared, messages, lexical, config))
    channels = {"fts": lexical, "feature": recall.features(prepared, docs, config)}
    if config.on("vector") and query_vectors is not None and not (config.on("semantic_rerank") or config.on("pair_rerank")):
        channels["dense"] = recall.dense(query_vectors, vectors, config)
    return prepared, docs, fuse.union_channels(channels)


def hydrated(found: DataFrame, prepared: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of a query and a document with the columns of both."""
    # the queries' wide rows come last: what is shuffled by document is without them
    own = docs.join(prepared.select("user_id").distinct(), "user_id", "left_semi").select(*HYDRATED, *(c for c in ("created_at",) if c in docs.columns))
    return found.join(own, "doc_id").join(prepared, "query_id")


def candidates(prepared: DataFrame, docs: DataFrame, config: Config, **channels) -> DataFrame:
    """The union of the channels, hydrated."""
    prepared, docs, found = union(prepared, docs, config, **channels)
    return hydrated(found, prepared, docs)


def arranged(prepared: DataFrame, docs: DataFrame, config: Config, upto: int = whole.FOUND, **channels) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prepared queries, documents and the candidates as whole.arranged gives them, with channel_ranks; the channels' ranks are written before."""
    prepared, docs, found = union(prepared, docs, config, **channels)
    rows = whole.arranged(prepared, docs, materialize(found, "ranked"), config, upto)
    return prepared, docs, rows.withColumn("channel_ranks", fuse.channel_ranks())


def in_blocks(prepared: DataFrame, docs: DataFrame, config: Config, stored: index.Stored | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The returned rows of the users whose documents fit one block, searched where these lie; the documents, indexed and written; and the queries of the other users, None if there are none."""
    docs, prepared = docs if stored is not None else materialize(index.indexed(docs), "documents"), materialize(prepared, "queries")
    held = docs if stored is None else docs.join(stored.terms.select("doc_id", "dl", "terms"), "doc_id")
    held = held if config.on("views") else held.where("doc_type = 'message'")
    over = blocks.spread(prepared, held, whole.weight(), single=True)
    large = over.users.where("_nd > 1")
    asked = prepared.join(recall.wanted_terms(prepared, recall.terms_of(docs, stored), config, stored), ["query_id", "user_id"], "left")
    # what isn't searched here goes before anything is computed of it
    held = held.join(large.select("user_id"), "user_id", "left_anti") if over.most else held.join(over.users.where("_nd = 1").select("user_id"), "user_id", "left_semi")
    rows = whole.search(asked.select(*whole.ASKED, "wanted", "idf", "avgdl"), whole.described(held, config), over, config)
    return rows, docs, None if large.isEmpty() else prepared.join(large, "user_id", "left_semi")


def search(queries: DataFrame, docs: DataFrame, config: Config | None = None, model_score=None, **channels) -> DataFrame:
    """Evidence rows for queries (query_id, user_id, query[, options, top_k]) over docs (views.documents). channels: query_vectors and vectors, stored (an index kept between searches). model_score: rows -> rows with model_score, for the reranks."""
    config = (config or Config()).validate()
    prepared, done = recall.prepare(queries, config), None
    if whole.able(config, channels, model_score):
        done, docs, prepared = in_blocks(prepared, docs, config, channels.get("stored"))
        if prepared is None:
            return fuse.evidence(done)
    prepared, docs, rows = arranged(prepared, docs, config, **channels)
    rows = hydrated(rows, prepared, docs)
    if (config.on("semantic_rerank") or config.on("pair_rerank")) and model_score is not None:
        low = F.transform(text.protection_entities(F.col("query")), F.lower)
        rows = model_score(rows.withColumn("entities", low))
        if config.on("semantic_rerank"):
            rows = rerank.protected(rows, config.semantic_boundary, config.semantic_pool, config.semantic_exact_quota)
        else:
            rows = rerank.pair(rows, config.pair_pool, config.pair_mode, config.pair_weight, config.pair_k, config.on("pair_top20_protect"), config.on("pair_exact_protect"))
    return fuse.evidence(rows) if done is None else fuse.evidence(done).unionByName(fuse.evidence(rows))
