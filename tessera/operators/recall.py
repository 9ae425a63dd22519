"""Recall channels for a table of queries: lexical, feature and dense. Each gives (query_id, doc_id, score, rank)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text
from tessera.operators import blocks, index
from tessera.operators.cut import materialize

K1, B = 1.2, 0.75
#: A scan limit from here on is none.
WHOLE = 2**31 - 1
EXACT, COVERAGE, PHRASE, DATE, NUMBER, ENTITY = 120.0, 40.0, 60.0, 45.0, 25.0, 12.0


def prepare(queries: DataFrame, config: Config) -> DataFrame:
    """queries (query_id, user_id, query[, options, top_k]) with what recall and scoring need of them, computed once a query."""
    opts = F.col("options") if "options" in queries.columns else F.lit(None).cast("array<string>")
    top = F.col("top_k") if "top_k" in queries.columns else F.lit(None).cast("int")
    q = F.col("query")
    recall = F.when((F.coalesce(F.size(opts), F.lit(0)) > 0) & F.lit(config.on("use_options")), F.concat(q, F.lit(" "), F.array_join(opts, " "))).otherwise(q)
    rows = queries.select("query_id", "user_id", "query", recall.alias("recall_text"), F.greatest(F.lit(0), F.least(F.coalesce(top, F.lit(config.top_k_default)), F.lit(config.top_k_max))).cast("int").alias("k"))
    r = F.col("recall_text")
    return rows.where("k > 0").select(
        "*", text.query_tokens(r, config.max_query_tokens).alias("tokens"),
        text.normalize(r).alias("r_low"), text.dates(r).alias("r_dates"), text.numbers(r).alias("r_numbers"), F.slice(text.entities_lower(r), 1, 32).alias("r_entities"),
        text.normalize(q).alias("q_low"), text.dates(q).alias("q_dates"), text.numbers(q).alias("q_numbers"), F.transform(text.phrases(q), F.lower).alias("q_phrases"), F.slice(text.entities_lower(q), 1, 32).alias("q_entities"),
        text.query_tokens(q, config.max_query_tokens).alias("q_tokens"),
        text.temporal_intent(q).alias("temporal"), text.numeric_intent(q).alias("numeric"), text.date_intent(q).alias("calendar"), text.personalization_intent(q).alias("personal"),
    )


def _top(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n of each query; Spark keeps only n a partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)


def idf(n, df):
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def gain(tf, dl, avgdl):
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avgdl))


def bm25_rows(asked: blocks.Columns, held: blocks.Columns) -> Iterator[np.ndarray]:
    """BM25 of documents (dl, terms: a list, or text with spaces between) for queries (wanted; idf; avgdl), query by query. What is wanted with spaces is a run of adjacent terms. A pair's parts are added in the order of wanted, whatever else is in the block; only documents that have a term are visited for it."""
    values, lists = blocks.numbered([list(own) for own in asked["wanted"]])
    weight = np.zeros(len(values))
    for at, own in zip(lists, asked["idf"]):
        weight[at] = own  # of a term or run, one value, or the user's
    runs: dict[int, dict[tuple, int]] = {}
    for v, i in values.items():
        if " " in v:
            runs.setdefault(v.count(" ") + 1, {})[tuple(v.split(" "))] = i
    n = len(held["dl"])
    found: list[int] = []
    counts = np.zeros(n, np.int64)
    for j, terms in enumerate(held["terms"]):
        terms = terms.split(" ") if isinstance(terms, str) else list(terms)
        before = len(found)
        found += [values[t] for t in terms if t in values]
        for size, own in runs.items():
            found += [own[t] for t in zip(*(terms[k:] for k in range(size))) if t in own]
        counts[j] = len(found) - before
    cells, tf = np.unique(np.array(found, np.int64) * n + np.repeat(np.arange(n), counts), return_counts=True)
    of, places = np.divmod(cells, max(1, n))
    gains = gain(tf, np.array(held["dl"], float)[places], asked["avgdl"][0] if n else 1.0) * weight[of]  # avgdl: one value, or the user's
    starts = np.searchsorted(of, np.arange(len(values) + 1))
    for own in lists:
        at, parts = (np.concatenate([v[:0], *(v[starts[i] : starts[i + 1]] for i in own)]) for v in (places, gains))
        out = np.bincount(at, parts, n).astype(float)  # of nothing, it counts in whole numbers
        out[out <= 0] = np.nan
        yield out


def bm25_scores(asked: blocks.Columns, held: blocks.Columns) -> np.ndarray:
    """bm25_rows as one array."""
    return np.array(list(bm25_rows(asked, held))).reshape(len(asked["wanted"]), len(held["dl"]))


def grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows (terms, ..) with each distinct run of so many adjacent terms as term, with spaces between."""
    runs = [F.when(F.size("terms") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("terms") - (n - 1), F.lit(1))), lambda i, n=n: F.array_join(F.slice("terms", i, n), " "))) for n in sizes]
    return rows.withColumn("term", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*runs)))))).drop("terms")


def terms_of(docs: DataFrame, stored: index.Stored | None = None) -> DataFrame:
    """The terms of documents: stored, theirs if they are indexed, or written once."""
    if stored is not None:
        return stored.terms
    return docs if "terms" in docs.columns else materialize(index.indexed(docs).select("doc_id", "user_id", "doc_type", "dl", "terms"), "terms")


#: So many distinct terms and runs of all queries go to every task, which then counts no others.
FEW = 200_000


def wanted_terms(prepared: DataFrame, terms: DataFrame, config: Config, stored: index.Stored | None = None) -> DataFrame:
    """query_id, user_id, wanted (each of a query's tokens that a document has), idf (theirs) and avgdl, written once. A token of several pieces (a date, a decimal) is a phrase of adjacent terms, with spaces between.

    Documents are counted where they are read: only sums are shuffled, never a term of a document.
    """
    by_user = ["user_id"] if config.stats_scope == "user" else []
    own_stats = stored is None or bool(by_user)
    size = index.corpus_stats(terms, config.stats_scope) if own_stats else stored.corpus
    asked = prepared.select("query_id", "user_id", F.explode("tokens").alias("token")).withColumn("parts", text.pieces(F.col("token"))).where("size(parts) > 0")
    asked = materialize(asked.select("query_id", "user_id", F.array_join("parts", " ").alias("term"), F.size("parts").alias("pieces")), "asked")
    sought = materialize(asked.select("term", "pieces").distinct(), "sought")
    sizes = {r.pieces: r.n for r in sought.groupBy("pieces").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as there are lengths
    few = sum(sizes.values()) <= FEW

    def counted(rows: DataFrame, which: DataFrame) -> DataFrame:
        count = lambda r: r.groupBy(*by_user, "term").agg(F.count(F.lit(1)).alias("df"))
        return count(rows.join(F.broadcast(which), "term", "left_semi")) if few else count(rows).join(which, "term", "left_semi")

    single = sought.where("pieces = 1").select("term")
    if own_stats:
        stats = counted(terms.select(*by_user, F.explode(F.array_distinct("terms")).alias("term")), single)
    else:
        stats = stored.term_stats.join(F.broadcast(single) if few else single, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    many = sorted(n for n in sizes if n > 1)
    if many:
        # with a stored index a phrase's frequency is that among the searched buckets
        stats = stats.unionByName(counted(grams(terms.select(*by_user, "terms"), many), sought.where("pieces > 1").select("term")))
    want = asked.join(F.broadcast(stats) if few and not by_user else stats, [*by_user, "term"])
    want = want.join(size, "user_id") if by_user else want.crossJoin(F.broadcast(size))
    one = F.struct("term", idf(F.col("n"), F.col("df")).alias("idf"))
    want = want.groupBy("query_id", "user_id").agg(F.array_sort(F.collect_list(one)).alias("_w"), F.first("avgdl").alias("avgdl"))
    return materialize(want.select("query_id", "user_id", F.col("_w.term").alias("wanted"), F.col("_w.idf").alias("idf"), "avgdl"), "wanted")


def lexical(prepared: DataFrame, docs: DataFrame, config: Config, stored: index.Stored | None = None) -> DataFrame:
    """BM25 over any of the query's tokens.

    Queries meet the terms of their user's documents, block by block, so that no posting is ever shuffled; only the statistics are global. With a stored index no text is read.
    """
    terms = terms_of(docs, stored)
    want = wanted_terms(prepared, terms, config, stored)
    held = (terms if config.on("views") else terms.where("doc_type = 'message'")).select("user_id", "doc_id", "dl", F.array_join("terms", " ").alias("terms"))
    return blocks.top(want, held, F.col("dl") * 8 + 40, config.max_candidates, bm25_rows, digits=9)


def like_fallback(prepared: DataFrame, messages: DataFrame, found: DataFrame, config: Config) -> DataFrame:
    """For queries without a lexical hit: messages that contain the query, with % and _ as wildcards, ASCII case aside."""
    bare = prepared.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "user_id", F.trim("query").alias("needle")).where("needle <> ''")
    rows = bare.join(messages.select("user_id", F.col("id").alias("doc_id"), "content"), "user_id").where(F.expr("content ilike concat('%', replace(needle, '\\\\', '\\\\\\\\'), '%')"))
    return _top(rows.select("query_id", "doc_id", F.lit(0.0).alias("score")), config.max_candidates, "doc_id")


def feature_rows(asked: blocks.Columns, held: blocks.Columns) -> Iterator[np.ndarray]:
    """The cheap scores of documents (low) for prepared queries, query by query."""
    texts: dict[str, int] = {}
    place = np.array([texts.setdefault(t, len(texts)) for t in held["low"]], np.int64)  # equal texts are scored once
    lows = list(texts)
    names = ("tokens", "r_dates", "r_numbers", "r_entities")
    values, lists = blocks.numbered([own for n in names for own in asked[n]])
    hit = blocks.hits(lows, list(values))
    count = len(asked["r_low"])
    for i, query in enumerate(asked["r_low"]):
        tokens, dates, numbers, entities = (lists[i + k * count] for k in range(4))
        covered = hit.counted(tokens)
        row = np.zeros(len(lows))
        if len(query) >= 4:
            # a text that has the query has all its tokens that are in the query as they stand
            least = sum(t in query for t in asked["tokens"][i])
            for j in np.flatnonzero(covered >= least) if least else range(len(lows)):
                if query in lows[j]:
                    row[j] = EXACT
        if tokens:
            row += COVERAGE * covered / len(tokens)
        row = row + DATE * hit.counted(dates) + NUMBER * hit.counted(numbers) + np.minimum(ENTITY * hit.counted(entities), ENTITY * 5)
        row[row <= 0] = np.nan
        yield row[place]


def feature_scores(asked: blocks.Columns, held: blocks.Columns) -> np.ndarray:
    """feature_rows as one array."""
    return np.array(list(feature_rows(asked, held))).reshape(len(asked["r_low"]), len(held["low"]))


def scanned(docs: DataFrame, config: Config) -> DataFrame:
    """The documents that feature recall reads: a user's messages by id up to the limit, then views; all where there is no limit."""
    if config.feature_scan_limit >= WHOLE:
        return docs
    kind = F.when(F.col("doc_type") == "message", 0).otherwise(1)
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(kind, "doc_id"))).where(F.col("_n") <= config.feature_scan_limit).drop("_n")


def features(prepared: DataFrame, docs: DataFrame, config: Config) -> DataFrame:
    """Every document of the query's user by its cheap score, scored by blocks of queries and documents."""
    rows = docs.join(prepared.select("user_id").distinct(), "user_id", "left_semi")
    rows = scanned(rows if config.on("views") else rows.where("doc_type = 'message'"), config).select("user_id", "doc_id", text.normalize(F.col("content")).alias("low"))
    asked = prepared.select("query_id", "user_id", "r_low", "tokens", "r_dates", "r_numbers", "r_entities")
    return blocks.top(asked, rows, F.length("low") + 40, config.max_candidates, feature_rows)


def cosines(asked: blocks.Columns, held: blocks.Columns) -> np.ndarray:
    """Cosines of vectors of like dimension in double precision; 0 if either has no length."""
    out = np.full((len(asked["vector"]), len(held["vector"])), np.nan)
    of = lambda vectors, n: [i for i, v in enumerate(vectors) if len(v) == n]
    for n in {len(v) for v in asked["vector"]}:
        a, b = of(asked["vector"], n), of(held["vector"], n)
        if b:
            x, y = (np.array([v[i] for i in at], float).reshape(len(at), n) for v, at in ((asked["vector"], a), (held["vector"], b)))
            norm = np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))
            out[np.ix_(a, b)] = np.where(norm > 0, x @ y.T / np.where(norm > 0, norm, 1), 0.0)
    return out


def similarities(queries: DataFrame, vectors: DataFrame, n: int | None) -> DataFrame:
    """(query_id, doc_id, score, rank) of queries (query_id, user_id, vector) and vectors (doc_id, user_id, vector) of one user: each query's n best, or all. Rows that don't fit the dimension are left out."""
    asked, held = (rows.select(key, "user_id", "vector").where(F.col("vector").isNotNull()) for rows, key in ((queries, "query_id"), (vectors, "doc_id")))
    return blocks.top(asked, held, F.size("vector") * 8 + 40, n, cosines, digits=9, steady=False)


def dense(queries: DataFrame, vectors: DataFrame, config: Config) -> DataFrame:
    """queries against stored vectors of their user, the best by cosine."""
    return similarities(queries, vectors, config.dense_max_candidates)


def baseline_scores(asked: blocks.Columns, held: blocks.Columns) -> np.ndarray:
    """1000 for the query as a whole (low) and 10 for each of its tokens within a text that shares a token (own) with it."""
    values, lists = blocks.numbered([list(t) for t in asked["tokens"]])
    hit = blocks.contained(held["low"], list(values))
    shared = np.zeros_like(hit)
    for j, own in enumerate(held["own"]):
        shared[[i for t in own if (i := values.get(t)) is not None], j] = 1
    out = np.full((len(lists), len(held["low"])), np.nan)
    for i, (query, own) in enumerate(zip(asked["low"], lists)):
        if own:
            found, hits = shared[own].any(0), hit[own].sum(0, dtype=np.int32)
            out[i, found] = 10.0 * hits[found]
            least = sum(t in query for t in asked["tokens"][i])
            if query:
                out[i, [j for j in np.flatnonzero(found & (hits >= least)) if query in held["low"][j]]] += 1000
    return out


def baseline_search(queries: DataFrame, messages: DataFrame) -> DataFrame:
    """The single-table baseline: messages (id, user_id, view, content) of the query's user and view that share a token; query_id, doc_id, score, position, total."""
    key = F.concat("user_id", F.lit("\0"), "view").alias("user_id")
    tokens = lambda c: F.array_distinct(text.baseline_tokens(F.col(c)))
    asked = queries.select("query_id", key, tokens("query").alias("tokens"), text.normalize(F.col("query")).alias("low"))
    held = messages.select(F.col("id").alias("doc_id"), key, tokens("content").alias("own"), text.normalize(F.col("content")).alias("low"), F.length("content").cast("long").alias("length"))
    most = queries.agg(F.max("top_k")).first()[0]
    rows = blocks.top(asked, held, F.length("low") * 2 + 40, max(1, most or 0), baseline_scores, then="length", counted=True).join(queries.select("query_id", "top_k"), "query_id")
    w = Window.partitionBy("query_id")
    rows = rows.withColumn("total", F.sum("size").over(w)).withColumn("position", F.row_number().over(w.orderBy(F.desc("score"), "length", "doc_id")))
    return rows.where("position <= greatest(0, top_k)").select("query_id", "doc_id", F.col("score").cast("long").alias("score"), "position", "total")
