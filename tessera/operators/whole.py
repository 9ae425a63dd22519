"""Searches over arrays of one user's documents: recall, scoring, fusion, dedup and slots in one task, so that only what a search returns leaves it.

The steps are those of recall, score and fuse, which work on rows keyed by query. Users whose documents fit one block are searched whole (search); for others recall goes by blocks, and a part of their queries then meets the documents that are candidates of any of them, once each (arranged).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.config import Config
from tessera.functions import ids, text
from tessera.operators import blocks, fuse, recall, score

LISTS = ("tokens", "q_entities", "q_phrases", "q_dates", "q_numbers", "q_tokens")
ASKED = ["query_id", "user_id", "k", "r_low", "r_dates", "r_numbers", "r_entities", "q_low", *LISTS, "temporal", "numeric", "calendar", "personal"]
RETURNED = ["doc_id", "doc_type", "content", "ts_ms", "source_ids"]
#: Queries that meet their candidates in one task, at least and (where there are enough for all cores) at most; the candidates are at most so many times the channels' limits.
TOGETHER, MOST = 32, 128
RANKS = ("fts_rank", "feature_rank", "dense_rank")
#: How far arranged goes: the full score; all scores and the fused order; what dedup keeps; the rows that a search returns.
FULL, RANKED, KEPT, FOUND = range(4)


def able(config: Config, channels: dict, model_score) -> bool:
    """Whether a search is one of lexical and feature recall, without a model."""
    vectors = config.on("vector") and channels.get("query_vectors") is not None
    reranks = (config.on("semantic_rerank") or config.on("pair_rerank")) and model_score is not None
    return not (vectors or reranks or config.on("exact_scan"))


def weight():
    """About the bytes of a document with its terms and features."""
    return F.coalesce(F.length("content"), F.lit(0)) * 3 + F.col("dl") * 16 + 400


def described(docs: DataFrame, config: Config) -> DataFrame:
    """Indexed documents with what scoring takes of their text alone, computed once a document."""
    c, message = F.col("content"), F.col("doc_type") == "message"
    mine = lambda on, value: F.when(message, value) if on else F.lit(None)
    values = F.array_join(F.concat(text.numbers(c), text.dates(c)), "\x1f")
    subject = F.element_at(F.concat(text.entities_lower(c), F.array(F.lit(None).cast("string"))), 1)
    said = text.direct_profile(c) & (F.lower(F.coalesce("role", F.lit(""))) == "user")
    cue = F.when(text.update_cue(c), (F.size(text.non_date_numbers(c)) > 0).cast("int") + (F.size(text.dates(c)) > 0).cast("int") * 2)
    extra = ["created_at"] if "created_at" in docs.columns else []
    return docs.select(
        "user_id", *RETURNED, *extra, "session_id", "seq", "dl", "terms", text.normalize(c).alias("low"), ids.epoch(F.col("ts_ms"), F.col("created_at") if extra else None).alias("epoch"),
        mine(config.on("preference_role_boost"), said).cast("boolean").alias("said"), mine(config.on("preference_role_boost"), text.direct_preference(c)).cast("boolean").alias("prefers"),
        mine(config.on("rerank"), values).cast("string").alias("values"), mine(config.on("rerank"), subject).cast("string").alias("subject"),
        mine(config.on("supersession"), text.signature(c)).cast("array<string>").alias("sig"), mine(config.on("supersession"), cue).cast("int").alias("cue"),
    )


def _near(sessions: list, seq: list, ids_: list, at: np.ndarray) -> np.ndarray:
    """Which of the messages at these places have a neighbour of their session among them."""
    order = sorted(range(len(at)), key=lambda x: (sessions[at[x]] is not None, sessions[at[x]] or "", seq[at[x]] is not None, seq[at[x]] or 0, ids_[at[x]]))
    out = np.zeros(len(at), bool)
    for x, y in zip(order, order[1:]):
        i, j = at[x], at[y]
        if sessions[i] == sessions[j] and seq[i] is not None and seq[j] is not None and abs(seq[i] - seq[j]) == 1:
            out[x] = out[y] = True
    return out


def _conflicts(b: blocks.Columns, epoch: np.ndarray, at: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the messages at these places, all of one subject with several values: their numbers among them, and those of the newest of each."""
    groups: dict = defaultdict(list)
    for x, i in enumerate(at):
        groups[b["subject"][i]].append(x)
    marked, newest = [], []
    for own in groups.values():
        if len({b["values"][at[x]] for x in own}) > 1:
            marked += own
            newest.append(max(own, key=lambda x: (0.0 if np.isnan(epoch[at[x]]) else epoch[at[x]], b["doc_id"][at[x]])))
    return marked, newest


def _superseded(b: blocks.Columns, epoch: np.ndarray, may: np.ndarray, at: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the messages at these places, which supersede another and which are superseded; may: those that can."""
    sigs = [b["sig"][i] for i in at]
    known, lists = blocks.numbered(sigs)
    has = np.zeros((len(at), len(known)), np.float32)
    for x, own in enumerate(lists):
        has[x, own] = 1
    size = np.array([len(s) for s in sigs])
    shared = np.rint(has @ has.T)
    small = np.minimum.outer(size, size)
    alike = (shared > 0) & ~((shared == size[:, None]) & (shared == size)) & (shared / np.maximum(small, 1) >= least)
    over = alike & (epoch[at][:, None] > epoch[at]) & may[:, None]
    return over.any(1), over.any(0)


def _user(a: blocks.Columns, b: blocks.Columns, config: Config, emit) -> None:
    """The searches a of one user over its documents b, which are in order of id; emit(query, places, scores, flags, ranks of channels, total)."""
    n = config.max_candidates
    wanted = [i for i, w in enumerate(a["wanted"]) if w]
    lexical = np.full((len(a["k"]), len(b["low"])), np.nan)
    if wanted:
        lexical[wanted] = recall.bm25_scores({c: [a[c][i] for i in wanted] for c in ("wanted", "idf", "avgdl")}, b)
    feature = recall.feature_scores(a, b)
    message = np.array([t == "message" for t in b["doc_type"]])
    if config.feature_scan_limit < len(message):  # messages by id, then views
        feature[:, np.argsort(~message, kind="stable")[config.feature_scan_limit :]] = np.nan
    b = b | {"size": [len(c or "") for c in b["content"]], "digest": [c or "" for c in b["content"]]}
    finish = _finisher(a, b, config)
    for i in range(len(a["k"])):
        fts_at, feature_at = blocks.best(np.round(lexical[i], 9), n), blocks.best(feature[i], n)
        at = np.union1d(fts_at, feature_at)
        if len(at):
            ranks = {"dense": np.zeros(len(at), np.int64)}
            for name, own in (("fts", fts_at), ("feature", feature_at)):
                ranks[name] = np.zeros(len(at), np.int64)  # 0: not in this channel
                ranks[name][np.searchsorted(at, own)] = np.arange(1, len(own) + 1)
            emit(i, *finish(i, at, ranks, np.where(ranks["fts"] > 0, lexical[i, at], 0.0), FOUND))


def _finisher(a: blocks.Columns, b: blocks.Columns, config: Config):
    """A function of a query's number, the places of its candidates among the documents b (in order), their ranks by channel (0: none), their lexical scores and how far to go, which gives places, scores, flags, ranks, positions and the rows' number before slots."""
    on = config.on
    message = np.array([t == "message" for t in b["doc_type"]])
    values, lists = blocks.numbered([own for c in LISTS for own in a[c]])
    hit = blocks.hits(b["low"], list(values))
    epoch = np.array([np.nan if e is None else e for e in b["epoch"]], float)
    size = np.array(b["size"])
    has_values = np.array([bool(v) and s is not None for v, s in zip(b["values"], b["subject"])])
    held = np.array([c is not None for c in b["cue"]]), np.array([c or 0 for c in b["cue"]])
    texts = list(values)

    def finish(i: int, at: np.ndarray, ranks: dict[str, np.ndarray], fts: np.ndarray, upto: int):
        q_low = a["q_low"][i]
        tokens, entities, phrases, dates, numbers, topics = (lists[i + c * len(a["k"])] for c in range(len(LISTS)))
        flags: list[list[str]] = [[] for _ in at]

        def flag(name: str, which) -> None:
            for x in np.flatnonzero(which):
                flags[x].append(name)

        part = lambda which, value: np.where(which, value, 0.0)
        some = lambda own: hit.counted(own)[at]
        msg, when, low = message[at], epoch[at], [b["low"][j] for j in at]
        # the full score, its parts added in the order of score.full_score
        cover = some(tokens) / len(tokens) if tokens else np.zeros(len(at))
        exact = np.array([q_low in t for t in low]) if on("exact") and len(q_low) >= 4 else np.zeros(len(at), bool)
        named = some(entities)
        phrase, entity = (some(phrases) > 0) & on("entity"), (named > 0) & on("entity")
        date, number = (some(dates) > 0) & on("datenum"), (some(numbers) > 0) & on("datenum")
        near = np.zeros(len(at), bool)
        near[msg] = _near(b["session_id"], b["seq"], b["doc_id"], at[msg])
        view, near, timed = ~msg & on("rerank"), near & on("rerank"), ~np.isnan(when) & on("rerank")
        intent = on("temporal_intent") and a["temporal"][i]
        known = when[~np.isnan(when)]
        span = known.max() - known.min() if len(known) else 0.0
        recency = (config.recency_weight_intent if intent else config.recency_weight) * ((when - known.min()) / span if span > 0 else np.ones(len(at)))
        total = part(fts != 0, score.LEXICAL * (np.abs(fts) / max(np.abs(fts).max(), np.finfo(float).tiny)))
        total = total + score.COVERAGE * cover + part(exact, score.EXACT) + part(phrase, score.PHRASE) + part(entity, np.minimum(score.ENTITY * named, score.ENTITY * 5))
        total = total + part(date, score.DATE) + part(number, score.NUMBER) + part(view, score.VIEW) + part(near, score.ADJACENT) + part(timed, recency)
        for name, which in (("lexical", fts != 0), ("high_coverage", cover >= 0.6), ("exact_substring", exact), ("phrase", phrase), ("entity", entity), ("date", date), ("number", number), ("view_context", view), ("adjacent_evidence", near), ("recency_intent" if intent else "recency", timed)):
            flag(name, which)
        if upto == FULL:
            return at, total, flags, ranks, np.arange(1, len(at) + 1), len(at)
        if on("preference_role_boost") and a["personal"][i]:
            said = np.array([bool(b["said"][j]) for j in at])
            total = total + part(said, config.preference_role_weight)
            flag("direct_user_profile", said)
            flag("direct_user_preference", said & np.array([bool(b["prefers"][j]) for j in at]))
        if on("rerank") and a["temporal"][i] and (a["numeric"][i] or a["calendar"][i]):
            names = [(t, hit.counted([v])[at]) for v in topics if len(t := texts[v]) >= 2 and t not in score.FILLERS]
            able = [x for x in np.flatnonzero(msg & has_values[at]) if any(which[x] and t not in b["subject"][at[x]] for t, which in names)]
            marked, newest = _conflicts(b, epoch, at[able])
            for name, own in (("possible_conflict", marked), ("latest_state", newest)):
                which = np.zeros(len(at), bool)
                which[[able[x] for x in own]] = True
                flag(name, which)
            total = total + part(which, score.LATEST)
        if on("supersession") and a["temporal"][i]:
            pool = np.flatnonzero(msg & ~np.isnan(when))
            pool = pool[np.lexsort((pool, -total[pool]))][: max(2, config.supersession_max_pairs)]
            pool = pool[np.array([bool(b["sig"][j]) for j in at[pool]], bool)]
            if len(pool) > 1:
                guard = on("supersession_update_guard")
                cued, kind = held[0][at[pool]], held[1][at[pool]]
                fits = (kind == 0) | ((kind % 2 == 1) & bool(a["numeric"][i])) | ((kind >= 2) & bool(a["calendar"][i]))
                newer, older = _superseded(b, epoch, cued & fits if guard else np.ones(len(pool), bool), at[pool], config.supersession_min_overlap)
                new, old = np.zeros(len(at), bool), np.zeros(len(at), bool)
                new[pool], old[pool] = newer & ~older, older & ~newer
                total = total + np.where(new, config.supersession_weight, np.where(old, -config.supersession_penalty, 0.0))
                flag("supersedes_earlier", new)
                flag("explicit_update_cue", new & guard)
                flag("superseded", old)
        order = lambda own, digits: own[np.lexsort((own, size[at[own]], -np.round(total[own], digits)))]
        members = order(np.flatnonzero(ranks["feature"] > 0), 9)
        ranks["feature"][members] = np.arange(1, len(members) + 1)
        for name in ("dense", "feature", "fts"):
            flag(f"channel:{name}", ranks[name] > 0)
        if on("rrf"):
            total = np.zeros(len(at))
            for name, by in (("fts", config.rrf_weight_lexical), ("feature", config.rrf_weight_feature), ("dense", config.rrf_weight_dense)):
                if by:
                    total = total + np.where(ranks[name] > 0, float(by) / (config.rrf_k + ranks[name]), 0.0)
            flag("rrf", np.ones(len(at), bool))
        rows = order(np.arange(len(at)), 12)
        place = np.arange(1, len(rows) + 1)
        if on("dedup") and upto > RANKED:
            views = ((b["doc_type"][at[x]] != "message", b["source_ids"][at[x]]) for x in rows)
            keep = fuse.fold((b["digest"][at[x]], view, sources) for x, (view, sources) in zip(rows, views))
            rows, place = rows[keep], place[keep]
        count = len(rows)
        if upto == FOUND:
            rows = rows[_slots(msg[rows], a["k"][i], config)]
            place = np.arange(1, len(rows) + 1)
        return at[rows], total[rows], [flags[x] for x in rows], {c: r[rows] for c, r in ranks.items()}, place, count

    return finish


def _slots(message: np.ndarray, k: int, config: Config) -> np.ndarray:
    """Places of the first k rows, with enough messages among them: the last views make way for the next messages."""
    head = np.arange(len(message)) < k
    have, after = np.flatnonzero(message & head), np.flatnonzero(message & ~head)
    views = np.flatnonzero(~message & head)
    need = max(int(np.floor(k * config.message_slot_ratio)) - len(have), 0)
    take = min(need, len(after)) if len(message) > k and config.message_slot_ratio > 0 else 0
    return np.sort(np.concatenate([have, views[: max(len(views) - take, 0)], after[:take]]))


def search(asked: DataFrame, held: DataFrame, over: blocks.Spread, config: Config) -> DataFrame:
    """Rows as fuse.slots gives them, for queries (prepared, with wanted, idf and avgdl) of the users with one block of documents each."""
    extra = [c for c in ("created_at",) if c in held.columns]
    kept = [*RETURNED, *extra]
    own = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in ("query_id", "user_id"))
    schema = StructType([*held.select(*kept).schema, *StructType.fromDDL(f"{own}, k int, position int, score double, flags array<string>, fts_rank int, feature_rank int, total long")])
    shape = to_arrow_schema(schema)

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_id", "user_id", "k", "position", "score", "flags", "fts_rank", "feature_rank", "total")}
        d = d.drop_columns([c for c in d.column_names if c in blocks.KEY])
        ds, qs = d.to_pydict(), q.to_pydict()
        mine, theirs = defaultdict(list), defaultdict(list)
        for i, user in enumerate(qs["user_id"]):
            mine[user].append(i)
        for j in sorted(range(d.num_rows), key=lambda j: ds["doc_id"][j]):
            theirs[ds["user_id"][j]].append(j)
        places: list[int] = []
        for user, own in mine.items():
            if user is not None and (at := theirs.get(user)):
                a, b = blocks.part(qs, own), blocks.part(ds, at)

                def emit(i, chosen, scores, flags, ranks, place, total, a=a, at=at, user=user):
                    n = len(chosen)
                    places.extend(at[j] for j in chosen)
                    for c, v in (("query_id", [a["query_id"][i]] * n), ("user_id", [user] * n), ("k", [a["k"][i]] * n), ("position", place.tolist()), ("score", scores.tolist()), ("flags", flags), ("fts_rank", [r or None for r in ranks["fts"].tolist()]), ("feature_rank", [r or None for r in ranks["feature"].tolist()]), ("total", [total] * n)):
                        out[c].extend(v)

                _user(a, b, config, emit)
        rows = d.select(kept).take(pa.array(places, pa.int64()))
        return pa.Table.from_arrays([*(rows[c].cast(shape.field(c).type) for c in kept), *(pa.array(out[c], shape.field(c).type) for c in out)], schema=shape)

    a, b = (blocks.placed(rows, over) for rows in blocks.dealt(asked, held, over, single=True))
    rows = a.cogroup(b).applyInArrow(run, schema)
    return rows.withColumn("dense_rank", F.lit(None).cast("int")).withColumn("channel_ranks", fuse.channel_ranks()).drop("fts_rank", "feature_rank", "dense_rank")


def arranged(prepared: DataFrame, docs: DataFrame, found: DataFrame, config: Config, upto: int = FOUND) -> DataFrame:
    """query_id, doc_id, position, score, flags, size, ranks by channel and total of the candidates found (query_id, doc_id, ranks and lexical score by channel; read twice) of prepared queries, as score and fuse give them.

    The queries of a user are dealt over parts of about TOGETHER, or more where these are many more than cores, as queries share candidates; a part's task gets each document that is a candidate of any of its queries once, without its text as written, and with its signature only for queries that ask for one.
    """
    users = prepared.where("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.max("temporal").alias("_temporal"))
    count, temporal = users.agg(F.sum("_n"), F.max("_temporal")).first()
    together = min(max(TOGETHER, (count or 0) // (2 * prepared.sparkSession.sparkContext.defaultParallelism)), max(TOGETHER, MOST))
    users = users.select("user_id", F.ceil(F.col("_n") / together).cast("int").alias("_of"))
    parts = users.agg(F.sum("_of")).first()[0] or 1
    asked = prepared.join(users, "user_id").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_of")).cast("int"))
    one = F.struct("doc_id", *RANKS, F.coalesce("fts_score", F.lit(0.0)).alias("fts_score"))
    own = found.groupBy("query_id").agg(F.collect_list(one).alias("found"))
    a = asked.select(*ASKED, "_part").join(own, "query_id")
    needed = found.select("query_id", "doc_id").join(asked.select("query_id", "user_id", "_part", "temporal"), "query_id").groupBy("user_id", "_part", "doc_id").agg(F.max("temporal").alias("_signed"))
    docs = docs if "terms" in docs.columns else docs.withColumns({"dl": F.lit(0), "terms": F.lit(None)})
    docs = docs.join(users.select("user_id"), "user_id", "left_semi")  # before anything is computed of them
    d = described(docs, config).withColumn("size", F.length(F.coalesce("content", F.lit("")))).withColumn("digest", F.unhex(F.sha1(F.coalesce("content", F.lit("")))))
    d = d.drop("content", "ts_ms", "created_at", "dl", "terms").withColumn("source_ids", F.when(F.col("doc_type") != "message", F.col("source_ids")))
    sig = F.when(F.col("_signed"), F.col("sig")) if temporal else F.lit(None).cast("array<string>")
    b = needed.join(d, ["user_id", "doc_id"]).withColumn("sig", sig).drop("_signed")
    kinds = {c: rows.schema[c].dataType.simpleString() for rows, c in ((prepared, "query_id"), (docs, "doc_id"))}
    schema = StructType.fromDDL(f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, position int, score double, flags array<string>, size int, fts_rank int, feature_rank int, dense_rank int, total long")
    shape = to_arrow_schema(schema)

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if q.num_rows and d.num_rows:
            a, b = q.drop_columns("found").to_pydict(), d.to_pydict()
            b = blocks.part(b, np.array(sorted(range(d.num_rows), key=lambda j: b["doc_id"][j])))
            places = {x: j for j, x in enumerate(b["doc_id"])}
            finish = _finisher(a, b, config)
            lists = q["found"].combine_chunks()
            ends, rows = np.cumsum([0, *lists.value_lengths().to_pylist()]), lists.flatten()
            every = np.array([places[x] for x in rows.field("doc_id").to_pylist()], np.int64)
            channels = {c.removesuffix("_rank"): rows.field(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in RANKS}
            fts = rows.field("fts_score").to_numpy(zero_copy_only=False)
            for i in range(q.num_rows):
                own = np.arange(ends[i], ends[i + 1])
                own = own[np.argsort(every[own], kind="stable")]
                at, scores, flags, ranks, place, total = finish(i, every[own], {c: v[own] for c, v in channels.items()}, fts[own], upto)
                n = len(at)
                for c, v in (("query_id", [a["query_id"][i]] * n), ("doc_id", [b["doc_id"][j] for j in at]), ("position", place.tolist()), ("score", scores.tolist()), ("flags", flags), ("size", [b["size"][j] for j in at]), ("total", [total] * n), *((c, [r or None for r in ranks[c.removesuffix("_rank")].tolist()]) for c in RANKS)):
                    out[c].extend(v)
        return pa.Table.from_arrays([pa.array(out[c.name], c.type) for c in shape], schema=shape)

    key = ["user_id", "_part"]
    deal = lambda rows: rows.toDF(*rows.columns).repartition(min(3 * parts, 3000), *key).groupBy(*key)
    return deal(a).cogroup(deal(b)).applyInArrow(run, schema)
