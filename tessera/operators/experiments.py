"""Ablation stages and parameter scans over one labelled corpus: searches by settings, with their metrics."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import STAGES, Config, stage
from tessera.functions import embed
from tessera.operators import evaluate, index, recall, search, views, whole
from tessera.operators.cut import materialize

#: Flags and settings of the points of each scan.
SCANS: dict[str, dict[str, dict]] = {
    "rrf": {"off": {"flags": {"rrf": False}}} | {f"lexical={w:g}": {"rrf_weight_lexical": w} for w in (0.1, 0.25, 0.5, 1.0)},
    "temporal": {"off": {"flags": {"temporal_intent": False}}, "on": {"flags": {"temporal_intent": True}}},
    "supersession": {"off": {"flags": {"supersession": False, "supersession_update_guard": False}}, "unguarded": {"flags": {"supersession": True, "supersession_update_guard": False}}}
    | {f"guarded={w:g}/{p:g}": {"supersession_weight": w, "supersession_penalty": p, "flags": {"supersession": True, "supersession_update_guard": True}} for w, p in ((4.0, 1.0), (6.0, 2.0), (8.0, 2.0), (10.0, 3.0), (12.0, 4.0), (14.0, 4.0), (18.0, 6.0))},
}
#: Flags that recall depends on.
RECALLED = ("views", "use_options", "exact_scan", "vector", "semantic_rerank", "pair_rerank")


class Corpus:
    """A corpus of messages whose index is built once for each setting of views, and searched once for each setting of recall."""

    def __init__(self, messages: DataFrame):
        self.messages, self.made, self.found = messages, {}, []

    def index(self, config: Config) -> tuple[DataFrame, index.Stored]:
        key = (config.on("views"), config.window_size, config.window_overlap, config.segment_max_messages, config.segment_max_gap_seconds)
        if key not in self.made:
            docs = materialize(views.documents(self.messages, config), "documents")
            terms = materialize(index.indexed(docs).select("doc_id", "user_id", "doc_type", "dl", "terms"), "terms")
            posts = materialize(index.postings(terms), "postings")
            self.made[key] = docs, index.Stored(terms, posts, materialize(index.term_stats(posts), "term-stats"), materialize(index.corpus_stats(terms), "corpus-stats"))
        return self.made[key]

    def recalled(self, queries: DataFrame, config: Config, backend=None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Prepared queries, documents and the union of the channels, found once and written for all settings that recall the same: what is scored and fused from it differs, not what is recalled."""
        flags = tuple(config.on(f) for f in RECALLED)
        key = (queries, backend, flags, tuple(getattr(config, f.name) for f in fields(config) if f.name != "flags"))
        for known, made in self.found:
            if all(a is b for a, b in zip(known[:2], key[:2])) and known[2:] == key[2:]:
                return made
        docs, stored = self.index(config)
        channels = {}
        if config.on("vector") and backend is not None:
            vector = lambda c: embed.embed(F.col(c), backend).alias("vector")
            channels = {"query_vectors": queries.select("query_id", "user_id", vector("query")), "vectors": docs.select("user_id", "doc_id", vector("content"))}
        prepared, docs, found = search.union(recall.prepare(queries, config), docs, config, stored=stored, **channels)
        self.found.append((key, (prepared, docs, materialize(found, "ranked"))))
        return self.found[-1][1]

    def search(self, queries: DataFrame, config: Config, backend=None) -> DataFrame:
        """query_id, doc_id, position and source_ids of what search.search returns."""
        config = config.validate()
        prepared, docs, found = self.recalled(queries, config, backend)
        rows = whole.arranged(prepared, docs, found, config).select("query_id", "doc_id", "position")
        return rows.join(docs.select("doc_id", "source_ids"), "doc_id")


def run(messages: DataFrame, queries: DataFrame, points: dict[str, Config], ks: tuple[int, ...] = (20, 100), backend=None) -> DataFrame:
    """Per point and query of queries (query_id, user_id, query, kind, difficulty, gold, distractors): its metrics, with the point's name as stage. A point that needs vectors is left out without a backend."""
    corpus, out = Corpus(messages), None
    for name, config in points.items():
        if config.on("vector") and backend is None:
            continue
        rows = evaluate.per_query(corpus.search(queries, config, backend), queries, ks).withColumn("stage", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def ladder(messages: DataFrame, queries: DataFrame, config: Config | None = None, names: tuple[str, ...] = STAGES, **options) -> DataFrame:
    """The stages of the ablation ladder, each with the flags of its own."""
    return run(messages, queries, {n: stage(n, config) for n in names}, **options)


def scan(messages: DataFrame, queries: DataFrame, kind: str, config: Config | None = None, **options) -> DataFrame:
    """One of SCANS: the points of a setting, all else as configured."""
    return run(messages, queries, {n: (config or Config()).merge(values) for n, values in SCANS[kind].items()}, **options)


def summary(metrics: DataFrame) -> DataFrame:
    """stage, kind, difficulty (null: all) with means, the queries and those that are scored."""
    values = [c for c in metrics.columns if c not in ("stage", "seed", "query_id", "kind", "difficulty", "returned")]
    rows = metrics.groupingSets([["stage"], ["stage", "kind"], ["stage", "difficulty"], ["stage", "kind", "difficulty"]], "stage", "kind", "difficulty")
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.count("rr").alias("scored"), *[F.avg(c).alias(c) for c in values])


def seeds(made: dict[int, tuple[DataFrame, DataFrame]], config: Config | None = None, names: tuple[str, ...] = STAGES, value: str = "rr", **options) -> DataFrame:
    """The ladder over several corpora (seed: messages, queries), as mean, min, max and n of a metric over seeds."""
    out = None
    for seed, (messages, queries) in made.items():
        rows = summary(ladder(messages, queries, config, names, **options)).withColumn("seed", F.lit(seed))
        out = rows if out is None else out.unionByName(rows)
    return evaluate.across_seeds(out, value)
