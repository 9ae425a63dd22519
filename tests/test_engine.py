import random

import pytest
from pyspark.sql import functions as F

from tessera.config import STAGES, Config, stage
from tessera.functions import embed, ids, text
from tessera.operators import fuse, index, ingest, lifecycle, recall, rerank, score, search, views
from tessera.streaming import ingest as streaming

MESSAGE = "id string, user_id string, session_id string, seq long, role string, content string, ts_ms long"


def messages(spark, rows):
    """rows: (user, session, seq, role, content, ts_ms)"""
    return spark.createDataFrame([(f"m{i}", *r) for i, r in enumerate(rows)], MESSAGE)


def session(n, step=60_000):
    return [("u", "s", i, "user", f"text {i}", 1_700_000_000_000 + i * step) for i in range(n)]


@pytest.mark.parametrize("total, size, overlap, want", [(7, 3, 1, [0, 2, 4, 6]), (1, 3, 1, [0]), (6, 3, 0, [0, 3])])
def test_window_starts(spark, total, size, overlap, want):
    rows = views.window_starts(messages(spark, session(total)), size, overlap)
    assert [r.start for r in rows.select("start").distinct().orderBy("start").collect()] == want


def sequential_segments(rows, cap, gap):
    out, number, count, last = [], 0, 0, None
    for r in rows:
        late = gap > 0 and last is not None and r[5] is not None and r[5] - last > gap * 1000
        if count and (count >= cap or late):
            number, count = number + 1, 0
        count += 1
        last = r[5] if r[5] is not None else last
        out.append(number)
    return out


def test_segments_equal_a_sequential_scan_and_the_stream_state(spark):
    import pandas as pd

    rng = random.Random(1)
    rows = []
    for s in range(30):
        ts = 0
        for i in range(rng.randint(1, 25)):
            ts += rng.choice([1000, 1000, 5_000_000])
            rows.append(("u", f"s{s}", i, "user", "x", None if rng.random() < 0.2 else ts))
    got = {}
    for r in views.segmented(messages(spark, rows), 4, 1800).orderBy("session_id", "seq").collect():
        got.setdefault(r.session_id, []).append(r.segment)
    config = Config(segment_max_messages=4)
    for s in range(30):
        own = [r for r in rows if r[1] == f"s{s}"]
        want = sequential_segments(own, 4, 1800)
        assert got[f"s{s}"] == want
        state, streamed = None, []
        for a in range(0, len(own), 3):  # in batches, with state between them
            part = pd.DataFrame([("m", r[2], r[3], r[4], r[5]) for r in own[a : a + 3]], columns=["id", "seq", "role", "content", "ts_ms"])
            out, state = streaming.segment_rows(("u", "s"), part, state, config)
            streamed += [x[4] for x in out]
        assert streamed == want


def test_incremental_views_equal_a_rebuild(spark):
    rows = session(9) + [("v", None, i, "user", f"other {i}", None) for i in range(4)]
    m, config = messages(spark, rows), Config(segment_max_messages=3)
    old = views.all_views(m.where("seq < 5"), config)
    touched = m.where("seq >= 5").select("user_id", "session_id").distinct()
    both = [{(r.view_id, r.content_hash) for r in v.collect()} for v in (views.refresh(old, touched, m, config), views.all_views(m, config))]
    assert both[0] == both[1]


def docs_of(spark, rows, config=None):
    return views.documents(messages(spark, rows), config or Config())


def ask(spark, *queries):
    return spark.createDataFrame([(str(i), *q) for i, q in enumerate(queries)], "query_id string, user_id string, query string, top_k int")


def test_search_isolates_users_clamps_and_is_deterministic(spark):
    rows = [("a", "s", i, "user", f"the red car number {i}", i) for i in range(6)] + [("b", "s", i, "user", f"the red car number {i}", i) for i in range(3)]
    docs, q = docs_of(spark, rows), ask(spark, ("a", "red car", 3), ("b", "red car", 500), ("a", "red car", 0), ("c", "red car", 5), ("a", "zebra", 5))
    got = [r.asDict() for r in search.search(q, docs).orderBy("query_id", "position").collect()]
    own = {r["query_id"]: [x for x in got if x["query_id"] == r["query_id"]] for r in got}
    assert set(own) == {"0", "1"} and len(own["0"]) == 3
    ids_b = {r.id for r in messages(spark, rows).where("user_id = 'b'").collect()}
    assert all(set(r["source_ids"]) <= ids_b for r in own["1"])
    assert [r["position"] for r in own["0"]] == [1, 2, 3] and own["0"][0]["total"] >= 3
    assert got == [r.asDict() for r in search.search(q, docs).orderBy("query_id", "position").collect()]


def test_later_update_beats_the_statement_it_replaces(spark):
    rows = [("u", "s", 0, "user", "Apollo budget was 100 dollars", 1000), ("u", "s", 1, "user", "Apollo budget changed to 200 dollars", 90_000_000), ("u", "t", 0, "user", "Apollo documentation lists a budget table", 99_000_000)]
    config = Config().with_flags(views=False, rrf=False)
    found = search.search(ask(spark, ("u", "what is the current Apollo budget amount", 5)), docs_of(spark, rows, config), config).orderBy("position").collect()
    assert found[0].doc_id == "m1" and {"latest_state", "possible_conflict", "supersedes_earlier", "explicit_update_cue"} <= set(found[0].evidence_flags)
    assert "superseded" in next(r for r in found if r.doc_id == "m0").evidence_flags


def test_preference_of_the_user_gains(spark):
    rows = [("u", "s", 0, "user", "I prefer dark roast coffee", 1), ("u", "s", 1, "assistant", "I prefer light roast coffee", 2)]
    config = Config().with_flags(views=False, rrf=False, preference_role_boost=True)
    found = {r.doc_id: r for r in search.search(ask(spark, ("u", "recommend a coffee for me", 5)), docs_of(spark, rows, config), config).collect()}
    assert "direct_user_preference" in found["m0"].evidence_flags and "direct_user_profile" not in found["m1"].evidence_flags and found["m0"].score > found["m1"].score


def sequential_dedup(rows):
    seen, covered, kept = set(), [], []
    for doc, kind, content, sources in rows:
        if content in seen or (kind != "message" and any(set(sources) <= c for c in covered)):
            continue
        seen.add(content)
        if kind != "message":
            covered.append(set(sources))
        kept.append(doc)
    return kept


def test_dedup_equals_a_sequential_scan(spark):
    rng, rows, want = random.Random(2), [], {}
    for q in range(40):
        own = []
        for i in range(rng.randint(1, 25)):
            kind = rng.choice(["message", "window"])
            a = rng.randint(0, 8)
            own.append((f"d{i}", kind, f"c{rng.randint(0, 12)}", [f"m{x}" for x in range(a, a + rng.randint(1, 4))]))
        rows += [(str(q), i + 1, *r) for i, r in enumerate(own)]
        want[str(q)] = sequential_dedup(own)
    df = spark.createDataFrame(rows, "query_id string, position int, doc_id string, doc_type string, content string, source_ids array<string>")
    got = {}
    for r in fuse.dedup(df).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == want


def sequential_slots(kinds, limit, ratio=0.5):
    order = list(range(len(kinds)))
    head = order[:limit]
    need = int(limit * ratio)
    have = sum(kinds[i] == "message" for i in head)
    if len(order) <= limit or have >= need:
        return head
    extra = [i for i in order[limit:] if kinds[i] == "message"][: need - have]
    other = [i for i in head if kinds[i] != "message"]
    return sorted([i for i in head if kinds[i] == "message"] + extra + other[: max(0, len(other) - len(extra))])[:limit]


def test_slots_equal_a_sequential_choice(spark):
    rng, rows, want = random.Random(3), [], {}
    for q in range(60):
        kinds = rng.choices(["message", "window", "window"], k=rng.randint(1, 30))
        k = rng.randint(1, 12)
        rows += [(str(q), k, f"d{i:03}", kind, "x", float(100 - i)) for i, kind in enumerate(kinds)]
        want[str(q)] = [f"d{i:03}" for i in sequential_slots(kinds, k)]
    got = {}
    for r in fuse.slots(spark.createDataFrame(rows, "query_id string, k int, doc_id string, doc_type string, content string, score double"), Config()).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == want


RECORD = "query_id string, doc_id string, position int, score double, model_score double, flags array<string>, source_ids array<string>, content string, entities array<string>"


def records(spark, scores, flags=None, sources=None, contents=None):
    return spark.createDataFrame([("q", f"r{i}", i + 1, 1 / (61 + i), s, (flags or {}).get(i, []), (sources or {}).get(i, [f"s{i}"]), (contents or {}).get(i, f"text {i}"), None) for i, s in enumerate(scores)], RECORD)


def order(rows):
    return [r.doc_id for r in rows.orderBy("position").collect()]


def test_pair_orders(spark):
    rows = records(spark, [0.0, 1.0, 8.0, 2.0, 2.0, 9.0, 9.0, 9.0])
    assert order(rerank.pair(rows, pool=5)) == ["r2", "r3", "r4", "r1", "r0", "r5", "r6", "r7"]
    assert order(rerank.pair(rows, mode="rrf", weight=0.0)) == order(rerank.pair(rows, mode="cc", weight=0.0)) == [f"r{i}" for i in range(8)]
    assert order(rerank.pair(rows, mode="rrf", weight=1.0)) == order(rerank.pair(rows, mode="cc", weight=1.0)) == order(rerank.pair(rows))
    bad = records(spark, [1.0, float("nan"), 3.0])
    assert order(rerank.pair(bad)) == ["r0", "r1", "r2"] and all("pair_rerank_fallback" in r.flags for r in rerank.pair(bad).collect())
    with pytest.raises(ValueError):
        rerank.validate_pair_policy("rrf", 0.5, 60, top20=True)


def test_anchors_and_protected_tail(spark):
    flags = {i: ["exact_substring"] for i in range(5)}
    rows = records(spark, [float(i) for i in range(25)], flags, {1: ["s0"]}, {2: "text 0"})
    found = rerank.anchors(rows.withColumn("b", F.lit(0)), "b", 3).where("pinned").orderBy("position")
    assert [r.doc_id for r in found.collect()] == ["r0", "r3", "r4"]
    got = order(rerank.protected(rows))
    assert got[:20] == [f"r{i}" for i in range(20)] and got[20:] == ["r24", "r23", "r22", "r21", "r20"]
    top = order(rerank.pair(rows, top20=True))
    assert set(top[:20]) == {f"r{i}" for i in range(20)} and top[0] == "r19"


def test_ledger_rules_and_sequence(spark):
    schema = "request_id string, user_id string, session_id string, messages array<struct<role:string,content:string,ts_ms:bigint>>, arrival long"
    one, two = [("user", "hi", 1)], [("user", "other", 1), ("user", "more", None)]
    rows = spark.createDataFrame([("r", "u", "s", one, 1), ("r", "u", "s", one, 2), ("r", "u", "s", two, 3), ("r", "v", "s", two, 4), ("q", "u", None, two, 5), ("p", "u", None, one, 6)], schema)
    empty = spark.createDataFrame([], "request_id string, user_id string, payload_hash string")
    judged = ingest.judge(rows, empty)
    assert [r.verdict for r in judged.orderBy("arrival").collect()] == ["new", "replay", "conflict", "new", "new", "new"]
    counts = spark.createDataFrame([("u", None, 5)], "user_id string, session_id string, msg_count long")
    seq = ingest.numbered(judged.where("verdict = 'new'"), counts).where("user_id = 'u' AND session_id IS NULL").orderBy("seq").collect()
    assert [r.seq for r in seq] == [5, 6, 7] and len({r.id for r in seq}) == 3


def test_stream_adds_once(spark, tmp_path):
    schema = "request_id string, user_id string, session_id string, messages array<struct<role:string,content:string,ts_ms:bigint>>, arrival long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: streaming.add_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", Config(), f"{tmp_path}/cp").awaitTermination()
    put([("a", "u", "s", [("user", "x", 1), ("user", "y", 2)], 1)])
    run()
    put([("a", "u", "s", [("user", "x", 1), ("user", "y", 2)], 2), ("b", "u", "s", [("user", "z", 3)], 3), ("a", "u", "s", [("user", "other", 1)], 4)])
    run()
    got = spark.read.parquet(f"{tmp_path}/t/messages").orderBy("seq").collect()
    assert [(r.seq, r.content) for r in got] == [(0, "x"), (1, "y"), (2, "z")]
    assert spark.read.parquet(f"{tmp_path}/t/conflicts").count() == 1


def test_lifecycle_and_fingerprint(spark):
    m = messages(spark, session(5) + [("v", "s", 0, "user", "x", 1)])
    users = spark.createDataFrame([("v",)], "user_id string")
    left = lifecycle.delete_users(m, users)
    assert left.count() == 5 and lifecycle.deletion_report({"m": m}, users).first().deleted == 1
    a, b = (lifecycle.fingerprint(t, "id", "content").first().digest for t in (m, m.orderBy(F.desc("id")).repartition(3)))
    assert a == b != lifecycle.fingerprint(left, "id", "content").first().digest
    assert lifecycle.purge_stale({"messages": m}, 10**15, 0, "ts_ms")["messages"].count() == 6
    assert lifecycle.purge_stale({"messages": m}, 1_000, 30, "ts_ms")["messages"].count() == 5
    assert lifecycle.purge_all({"m": m})["m"].count() == 0


def test_bm25_prefers_rare_terms_and_takes_phrases(spark):
    rows = [("u", "s", i, "user", t, i) for i, t in enumerate(["common rare word", "common word", "common thing", "on 2024-01-02 we met", "2024 or 01 or 02 apart"])]
    config = Config().with_flags(views=False)
    q = recall.prepare(ask(spark, ("u", "common rare", 5), ("u", "2024-01-02", 5)), config)
    got = {}
    for r in recall.lexical(q, docs_of(spark, rows, config), config).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got["0"][0] == "m0" and got["1"][0] == "m3" and set(got["1"]) == {"m3", "m4"}


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"window_size": 5, "flags": {"views": false}}')
    c = Config.load(str(f), {"TESSERA_TOP_K_MAX": "50", "TESSERA_FLAG_VECTOR": "true"})
    assert (c.window_size, c.top_k_max, c.on("views"), c.on("vector")) == (5, 50, False, True)
    for bad in ({"window_size": 0}, {"unknown": 1}, {"flags": {"nope": True}}, {"window_overlap": 9}):
        with pytest.raises(ValueError):
            Config().merge(bad)
    assert stage("L9").flags == Config().flags and len(STAGES) == 11


def test_plugins():
    made = embed.load_embedding("tessera.functions.embed:HashEmbedding")
    v = made.embed(["alpha beta", "alpha beta", ""])
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and not any(v[2])
    assert not embed.available("no.such:thing") and embed.available("tessera.functions.embed:HashEmbedding")
    with pytest.raises(ValueError):
        embed.load_plugin("nocolon", ())


def test_remote_embedding_retries_and_keeps_order(spark):
    state = {"n": 0}

    def call(texts):
        state["n"] += 1
        if state["n"] == 1:
            raise OSError("busy")
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]

    rows = spark.createDataFrame([(str(i), "x" * i) for i in range(25)], "doc_id string, content string").coalesce(1)
    got = {r.doc_id: r.vector for r in embed.embed_remote(rows, call, wait=0.0).collect()}
    assert all(got[str(i)] == [float(i)] for i in range(25))


def test_pair_scorer_failure_falls_back_by_query(spark):
    class Scorer:
        identity = "t"

        def score(self, query, documents):
            if query == "bad":
                raise RuntimeError
            return [len(d) for d in documents]

    rows = spark.createDataFrame([("good", "aa"), ("good", "b"), ("bad", "c")], "query string, content string")
    got = {(r.query, r.content): r.model_score for r in embed.score_pairs(rows, Scorer()).collect()}
    assert got == {("good", "aa"): 2.0, ("good", "b"): 1.0, ("bad", "c"): None}
    assert {r.model_error for r in embed.score_pairs(rows, Scorer()).collect()} == {None, "RuntimeError: "}


def test_quoted_number_with_commas_matches_nothing(spark):
    df = spark.createDataFrame([("pay 1,200 now", "1,200")], "c string, q string")
    r = df.select(text.hits(text.numbers(F.col("q")), text.normalize(F.col("c"))).alias("n"), text.baseline_tokens(F.lit("北a京 x")).alias("t"), ids.iso(F.lit(1500)).alias("iso"), ids.iso(F.lit(2000)).alias("whole")).first()
    assert r.n == 0 and "北京" in r.t and r.iso == "1970-01-01T00:00:01.500000+00:00" and r.whole == "1970-01-01T00:00:02+00:00"


def test_embedding_upkeep(spark):
    docs = docs_of(spark, session(3), Config().with_flags(views=False))
    one = lambda t: F.when(F.length(t) >= 0, F.array(F.lit(1.0).cast("float")))
    empty = spark.createDataFrame([], "doc_id string, user_id string, doc_type string, content_hash string, model_hash string, vector array<float>, dimension int")
    first = index.sync_embeddings(docs, empty, "m", one)
    assert first.count() == 3
    again = index.stale_embeddings(docs.where("doc_id <> 'm0'"), first, "m")
    assert {(r.doc_id, r.action) for r in again.collect()} == {("m0", "drop"), ("m1", "keep"), ("m2", "keep")}
    assert {r.action for r in index.stale_embeddings(docs, first, "other").collect()} == {"embed"}


def test_full_score_flags(spark):
    rows = [("u", "s", 0, "user", 'Bob paid 42 on 2024-01-02 for "green tea"', 1), ("u", "s", 1, "user", "unrelated words", 2)]
    config = Config().with_flags(views=False)
    found = {r.doc_id: r for r in search.search(ask(spark, ("u", 'Bob paid 42 on 2024-01-02 for "green tea"', 5)), docs_of(spark, rows, config), config).collect()}
    assert {"lexical", "high_coverage", "exact_substring", "phrase", "entity", "date", "number", "recency", "rrf", "channel:fts", "channel:feature"} <= set(found["m0"].evidence_flags)
    assert score.FILLERS and found["m0"].provenance.startswith("message:m0<-[m0];channels={")


def test_engine_end_to_end(spark, tmp_path):
    from tessera.engine import Engine
    from tessera.operators import evaluate
    from tessera.sources import synth, tables

    m, queries = synth.dataset(spark, "smoke")
    engine = Engine(spark, f"file://{tmp_path}/t")
    requests = synth.bulk_requests(m, 8)
    first = requests.where("arrival = 0")
    assert {r.verdict for r in engine.add(first, now_ms=1000).collect()} == {"new"}
    assert {r.verdict for r in engine.add(requests, now_ms=2000).collect()} == {"new", "replay"}
    assert engine.count() == m.count() and engine.count("u1") == m.where("user_id = 'u1'").count()
    assert engine.sql("SELECT count(*) AS n FROM {messages} WHERE seq < :k", k=2).first().n == 24
    full = views.documents(m, Config())
    assert {(r.doc_id, r.content) for r in engine.documents().collect()} == {(r.doc_id, r.content) for r in full.collect()}
    found = engine.search(queries.withColumn("top_k", F.lit(20)))
    per = evaluate.per_query(found, queries, (5, 20))
    scored = per.agg(F.avg("recall_20").alias("r"), F.avg("rr").alias("m")).first()
    assert scored.r > 0.95 and scored.m > 0.3
    levels = {(r.level, r.queries) for r in evaluate.by_group(per).where("level = 3").collect()}
    assert levels == {(3, queries.count())}
    # the stored index answers as one made from the text
    plain = search.search(queries.withColumn("top_k", F.lit(20)), full, Config())
    what = lambda rows: {(r.query_id, r.position, r.doc_id, r.score) for r in rows.collect()}
    assert what(found) == what(plain)
    assert tables.evidence_json(found).count() == found.count() and "| level |" in tables.markdown(evaluate.by_group(per))
    copy = engine.snapshot(f"file://{tmp_path}/copy")
    assert engine.delete_user("u1").where("table = 'messages'").first().deleted == m.where("user_id = 'u1'").count()
    assert engine.count("u1") == 0 and copy.count("u1") > 0
    engine.purge_stale(1, now_ms=2000 + 2 * 86_400_000)
    assert engine.count() == 0 and copy.stats().first().users == 4
    copy.purge_all()
    assert copy.count() == 0


REQUEST = "request_id string, user_id string, session_id string, messages array<struct<role:string,content:string,ts_ms:bigint>>, arrival long"


def files_with(folder, text):
    """Parquet files below folder that hold a text in any string column."""
    import pyarrow.parquet as pq

    return [f for f in folder.rglob("*.parquet") if any(text in str(v) for c in pq.read_table(f).columns for v in c.to_pylist())]


def test_engine_survives_and_erases(spark, tmp_path):
    from tessera.engine import Engine

    path, backend = f"file://{tmp_path}/t", embed.HashEmbedding(16)
    config = Config().with_flags(vector=True)
    engine = Engine(spark, path, config, backend, buckets=3)
    say = lambda n, user, text: spark.createDataFrame([(f"r{n}", user, "s", [("user", text, None if n % 2 else n)], n)], REQUEST)
    for n in range(3):
        engine.add(say(n, "ann", f"the zebra number {n} is striped"), now_ms=1000)
    engine.add(say(3, "bob", "a quokka smiles"), now_ms=1000)
    again = Engine(spark, path, config, backend)
    assert again.manifest == engine.manifest and again.count() == 4 and again.manifest["buckets"] == 3
    stats = again.stats().first()
    assert stats.embeddings == again.documents().count() and stats.vector_bytes == 64 * stats.embeddings and stats.users == 2
    assert again.add(say(1, "ann", "the zebra number 1 is striped")).first().verdict == "replay" and again.manifest["version"] == engine.manifest["version"]
    ask_ = lambda user, text: spark.createDataFrame([("q", user, text, 5)], "query_id string, user_id string, query string, top_k int")
    hit = again.search(ask_("ann", "zebra number 2")).orderBy("position").first()
    assert "number 2" in hit.content and hit.created_at and any(f == "channel:dense" for f in hit.evidence_flags)
    assert again.table("messages").where("seq = 1").first().created_at == "1970-01-01T00:00:01+00:00"
    # a second writer of the same version fails, and a manifest cut short is passed over
    again.add(say(4, "bob", "the quokka sleeps"), now_ms=2000)
    with pytest.raises(Exception, match="(?i)exist"):
        engine.add(say(5, "bob", "lost"), now_ms=2000)
    (tmp_path / "t/_manifest/999999999999.json").write_text('{"version": 99999')
    assert Engine(spark, path, config, backend).count("bob") == 2
    (tmp_path / "t/_manifest/999999999999.json").unlink()
    # other backends' vectors are made anew at opening
    other = embed.HashEmbedding(8)
    assert {r.dimension for r in Engine(spark, path, config, other).table("embeddings").collect()} == {8}
    again = Engine(spark, path, config, other)
    report = {r["table"]: r.deleted for r in again.delete_user("ann").collect()}
    assert report["messages"] == 3 and report["embeddings"] > 3 and report["ledger"] == 3
    assert files_with(tmp_path / "t", "zebra") == [] and files_with(tmp_path / "t", "quokka")
    assert again.search(ask_("ann", "zebra")).collect() == [] and len(again.search(ask_("bob", "quokka")).collect()) > 1
    n = sum(r.df for r in again.table("term_stats").where("term = 'striped'").collect())
    assert n == 0 and again.table("corpus_stats").agg(F.sum("n")).first()[0] == again.documents().count()
    again.purge_all()
    assert again.count() == 0 and not list((tmp_path / "t").rglob("*.parquet"))


def test_many_adds_are_merged_and_old_files_lack_no_column(spark, tmp_path, monkeypatch):
    from tessera import engine as module

    monkeypatch.setattr(module, "FOLDERS", 2)
    engine = module.Engine(spark, f"file://{tmp_path}/t", Config().with_flags(views=False), buckets=1)
    for n in range(4):
        engine.add(spark.createDataFrame([(f"r{n}", "u", "s", [("user", f"word{n}", n)], n)], REQUEST), now_ms=5)
    assert len(engine.manifest["tables"]["messages"]["0"]) <= 2 and [r.seq for r in engine.table("messages").orderBy("seq").collect()] == [0, 1, 2, 3]
    # a file from before a column was added
    folder = engine.manifest["tables"]["messages"]["0"][0].removeprefix("file://")
    spark.read.parquet(folder).drop("created_at").write.mode("overwrite").parquet(f"{tmp_path}/old")
    engine.manifest["tables"]["messages"]["0"][0] = f"file://{tmp_path}/old"
    assert engine.count() == 4 and engine.table("messages").where("created_at is null").count() > 0


def test_command_line(spark, tmp_path, capsys):
    import json

    from tessera.__main__ import main

    path = ["--path", f"file://{tmp_path}/t"]
    assert main([*path, "add", "--user", "u", "--request", "r", "--content", "a red fox", "--timestamp", "5"], spark) == 0
    assert main([*path, "add", "--user", "u", "--request", "r", "--content", "another"], spark) == 1
    capsys.readouterr()
    main([*path, "search", "--user", "u", "--query", "fox"], spark)
    assert json.loads(capsys.readouterr().out)[0]["content"].endswith("a red fox")
    main([*path, "stats"], spark)
    assert json.loads(capsys.readouterr().out)["messages"] == 1
    assert main([*path, "purge"], spark) == 2 and main([*path, "selfcheck"], spark) == 0
    main([*path, "delete-user", "--user", "u"], spark)
    assert '"messages": 1' in capsys.readouterr().out


def test_experiments_on_the_synthetic_corpus(spark):
    from tessera.operators import experiments
    from tessera.sources import synth

    m, q = synth.dataset(spark, "smoke", 3, "mixed", "v11")
    kinds = {r.kind: r.n for r in q.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(kinds) == {"single_hop", "knowledge_update", "absent", "multi_session", "temporal", "governance_update_noise", "direct_preference"}
    held = {r.id for r in m.collect()}
    assert len(held) == m.count() and all(set(r.gold) | set(r.distractors) <= held for r in q.collect()) and {r.difficulty for r in q.collect()} == {"plain", "paraphrase"}
    rows = experiments.summary(experiments.ladder(m, q, names=("L0", "L7", "L10"), ks=(20,))).collect()
    over = {r.stage: r for r in rows if r.kind is None and r.difficulty is None}
    assert set(over) == {"L0", "L10"} and over["L10"].recall_20 > 0.9 and over["L10"].queries == q.count() > over["L10"].scored
    liked = {r.stage: r.rr for r in rows if r.kind == "direct_preference" and r.difficulty is None}
    assert liked["L10"] == 1.0
    assert set(experiments.SCANS) == {"rrf", "temporal", "supersession"} and len(experiments.SCANS["supersession"]) == 9
    points = experiments.scan(m, q, "temporal", ks=(20,))
    assert {r.stage for r in points.select("stage").distinct().collect()} == {"off", "on"}


def test_range_filters_and_out_of_order_times(spark):
    rows = messages(spark, [("u", "s", 0, "user", "alpha", 9_000), ("u", "s", 1, "user", "gamma", 1_000), ("u", "s", 2, "user", "omega", None)])
    assert [r.id for r in rows.where("user_id = 'u' AND session_id = 's' AND seq BETWEEN 1 AND 2").orderBy("seq").collect()] == ["m1", "m2"]
    config = Config().with_flags(views=False, rrf=False)
    found = {r.doc_id: r.score for r in search.search(ask(spark, ("u", "alpha gamma omega", 5)), views.documents(rows, config), config).collect()}
    # by event time, though seq is in the order of arrival; the oldest and the one without a time gain nothing
    assert found["m0"] > found["m1"] == pytest.approx(found["m2"])


def test_requests_from_json(spark, tmp_path):
    from tessera.plans.lifecycle_queries import ADDS
    from tessera.sources import tables

    (tmp_path / "r.jsonl").write_text("\n".join(p for p, _ in ADDS) + "\n")
    good, bad = tables.read_requests(spark, f"{tmp_path}/r.jsonl")
    assert good.count() == sum(e is None for _, e in ADDS) and sorted(r.error for r in bad.collect()) == sorted(e for _, e in ADDS if e)


def test_scores_that_differ_in_their_last_bits_are_ties(spark):
    rows = [("q", "a", 0.3, "x"), ("q", "b", 0.1 + 0.2, "x"), ("q", "c", 0.4, "x")]  # b is larger than a by one bit
    df = spark.createDataFrame(rows, "query_id string, doc_id string, score double, content string").withColumn("feature_rank", F.lit(1)).withColumn("doc_type", F.lit("message")).withColumn("k", F.lit(3))
    assert order(fuse.in_order(df)) == ["c", "a", "b"]
    assert [r.doc_id for r in fuse.rerank_features(df).orderBy("feature_rank").collect()] == ["c", "a", "b"]
    assert order(fuse.slots(df, Config())) == ["c", "a", "b"]


def test_pair_rrf_keeps_ties_of_fused_ranks(spark):
    """Places 3 and 5 with model ranks 18 and 10: equal as fractions, the second larger by one bit."""
    ranks = [r for r in range(1, 51) if r not in (18, 10)]
    ranks = [*ranks[:2], 18, ranks[2], 10, *ranks[3:]]
    assert 0.75 / 63 + 0.25 / 78 < 0.75 / 65 + 0.25 / 70
    got = order(rerank.pair(records(spark, [float(50 - r) for r in ranks]), pool=50, mode="rrf"))
    assert got.index("r2") < got.index("r4")


def test_cache_with_a_text_twice_keeps_one_row_a_document(spark):
    import hashlib

    key = hashlib.sha256(b"same").hexdigest()
    docs = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", "other")], "doc_id string, content string")
    cache = spark.createDataFrame([(key, "m", 2, [1.0, 0.0]), (key, "m", 2, [0.0, 1.0]), (key, "m", 2, [float("nan"), 0.0])], "content_hash string, model_hash string, dimension int, vector array<float>")
    got = sorted((r.doc_id, r.from_cache, r.vector) for r in index.cached_vectors(docs, cache, "m", 2).collect())
    assert got == [("a", True, [0.0, 1.0]), ("b", True, [0.0, 1.0]), ("c", False, None)]


def test_blocks_of_queries_and_documents_lose_no_pair(spark, monkeypatch):
    from tessera.operators import blocks

    rng = random.Random(5)
    words = ["car", "cart", "red", "2024-01-02", "1,200.5", "预算", "Rome", "x1", "sca", "rt r"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"u{i % 3}", "s", i, "user", said(rng.randint(0, 12)), i) for i in range(150)]
    queries = [(f"u{rng.randint(0, 3)}", said(rng.randint(1, 4)), 5) for _ in range(60)]
    docs, config = docs_of(spark, rows, Config(max_candidates=30)), Config(max_candidates=30, feature_scan_limit=2**31 - 1)
    prepared = recall.prepare(ask(spark, *queries), config)
    held, asked = docs.collect(), prepared.collect()
    found = {}
    for name, size, weight in (("one", 512, 6_000_000), ("many", 4, 900)):
        monkeypatch.setattr(blocks, "QUERIES", size)
        monkeypatch.setattr(blocks, "WEIGHT", weight)
        found[name] = {(r.query_id, r.doc_id): r.score for r in recall.features(prepared, docs, config).collect()}
        found["bm25 " + name] = {(r.query_id, r.doc_id): round(r.score, 9) for r in recall.lexical(prepared, docs, config).collect()}
    want = {}
    for q in asked:
        own = []
        for d in held:
            if d.user_id == q.user_id:
                low = d.content.lower()
                hits = lambda values: sum(v in low for v in values)  # noqa: B023, E731
                s = (120.0 if len(q.r_low) >= 4 and q.r_low in low else 0.0) + (40.0 * hits(q.tokens) / len(q.tokens) if q.tokens else 0.0) + 45.0 * hits(q.r_dates) + 25.0 * hits(q.r_numbers) + min(12.0 * hits(q.r_entities), 60.0)
                own.append((-s, d.doc_id))
        want |= {(q.query_id, i): -s for s, i in sorted(own)[:30] if s < 0}
    assert want and found["one"] == want and found["many"] == want
    assert found["bm25 one"] and found["bm25 one"] == found["bm25 many"]


def test_contained_values():
    from tessera.operators.blocks import contained

    values = ["ab", "b", "", "a-b", "预", "z" * 60, "1"]
    texts = ["cab a-b", "预算 1b", "", "z" * 70, "a b"]
    assert contained(texts, values).tolist() == [[int(v in t) for t in texts] for v in values]


def test_dedup_in_several_groups(spark, monkeypatch):
    rows = [(str(q), p, f"d{p}", kind, said, sources) for q in range(20) for p, kind, said, sources in [(1, "window", "a", ["x", "y"]), (2, "window", "b", ["y"]), (3, "message", "b", ["y"]), (4, "message", "a", ["z"]), (5, "window", "c", [])]]
    df = spark.createDataFrame(rows, "query_id string, position int, doc_id string, doc_type string, content string, source_ids array<string>")
    monkeypatch.setattr(fuse, "FOLDED", 10)
    assert sorted((r.query_id, r.position) for r in fuse.dedup(df).collect()) == sorted((str(q), p) for q in range(20) for p in (1, 3))


def test_all_cosines_and_the_best_with_negative_ones(spark, monkeypatch):
    from tessera.operators import blocks

    monkeypatch.setattr(blocks, "WEIGHT", 300)
    rows = [(i, i % 2, [float(i % 5 - 2), 1.0, float(-i)]) for i in range(30)] + [(30, 0, [0.0, 0.0, 0.0]), (31, 1, [1.0]), (32, 1, None)]
    v = spark.createDataFrame(rows, "doc_id long, user_id int, vector array<float>")
    q = v.where("doc_id in (3, 4, 30)").withColumnRenamed("doc_id", "query_id")
    pairs = q.join(v.withColumnRenamed("vector", "stored"), "user_id").where("size(vector) = size(stored)")
    want = {(r.query_id, r.doc_id): r.s for r in pairs.select("query_id", "doc_id", F.round(ids.cosine(F.col("vector"), F.col("stored")), 9).alias("s")).collect()}
    assert min(want.values()) < 0
    got = {(r.query_id, r.doc_id): r.s for r in recall.similarities(q, v, None).select("query_id", "doc_id", F.round("score", 9).alias("s")).collect()}
    assert got == pytest.approx(want, abs=2e-9)
    first = [(r.query_id, r.doc_id) for r in recall.dense(q, v, Config(dense_max_candidates=4)).orderBy("query_id", "rank").collect()]
    assert first == [(x, i) for x in (3, 4, 30) for s, i in sorted((-s, i) for (y, i), s in want.items() if y == x)[:4]]


def test_baseline_search_over_blocks_counts_all_hits(spark, monkeypatch):
    from tessera.operators import blocks

    monkeypatch.setattr(blocks, "QUERIES", 2)
    monkeypatch.setattr(blocks, "WEIGHT", 400)
    rng = random.Random(6)
    said = lambda n: " ".join(rng.choice(["red", "car", "cart", "预算", "x1"]) for _ in range(n))
    m = spark.createDataFrame([(f"m{i}", f"u{i % 2}", "message", said(rng.randint(0, 5))) for i in range(60)], "id string, user_id string, view string, content string")
    q = spark.createDataFrame([(str(i), f"u{i % 2}", "message", said(rng.randint(1, 3)), 3) for i in range(8)] + [("none", "u0", "other", "red", 3)], "query_id string, user_id string, view string, query string, top_k int")
    tokens = lambda rows, key, c: {r[key]: set(r.t) for r in rows.select(key, text.baseline_tokens(F.col(c)).alias("t")).collect()}
    of_q, of_m, want = tokens(q, "query_id", "query"), tokens(m, "id", "content"), {}
    for a in q.collect():
        own = [(1000 * (a.query in b.content) + 10 * sum(t in b.content for t in of_q[a.query_id]), len(b.content), b.id) for b in m.collect() if (a.user_id, a.view) == (b.user_id, b.view) and of_q[a.query_id] & of_m[b.id]]
        for p, (s, _, i) in enumerate(sorted(own, key=lambda x: (-x[0], x[1:]))[:3]):
            want[a.query_id, i] = (s, p + 1, len(own))
    assert {(r.query_id, r.doc_id): (r.score, r.position, r.total) for r in recall.baseline_search(q, m).collect()} == want


def test_segments_sort_a_session_once(spark):
    plan = views.segmented(messages(spark, session(9)), 4, 1800)._jdf.queryExecution().optimizedPlan().toString()
    assert "_island" not in plan and len({line.split("[")[-1] for line in plan.splitlines() if line.strip(" +-:").startswith("Window")}) == 1


@pytest.mark.parametrize("name", ["all", "stage", "no rrf", "no views"])
def test_search_in_one_block_equals_search_by_rows_and_writes_no_candidates(spark, monkeypatch, name):
    from tessera.operators import blocks, cut

    config = {
        "all": Config(segment_max_messages=3, max_candidates=25).with_flags(temporal_intent=True, preference_role_boost=True),
        "stage": stage("L4", Config(feature_scan_limit=20)),
        "no rrf": Config(max_candidates=12, supersession_max_pairs=9).with_flags(rrf=False, temporal_intent=True, supersession_update_guard=False, preference_role_boost=True),
        "no views": Config(stats_scope="user").with_flags(views=False, rrf=False, dedup=False, temporal_intent=True, preference_role_boost=True),
    }[name]
    rng = random.Random(9)
    words = ["Apollo", "budget", "quota", "is now", "was", "changed to", "100", "2,000", "2024-01-02", "I prefer", "red", "预算", "我喜欢", '"green tea"', "no longer"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n)) if n else None
    rows = [(f"u{i % 4}", rng.choice(["s", "t", None]), i // 4, rng.choice(["user", "assistant"]), said(rng.randint(0, 9)), rng.choice([None, 10**6 * i])) for i in range(160)]
    asked = ["what is the current Apollo budget amount", "when was the latest quota changed to 100", 'recommend "green tea" for me', "预算", "Apollo budget 2024-01-02 now 2,000", "red zebra"]
    docs, q = docs_of(spark, rows, config), ask(spark, *[(f"u{u}", t, k) for u in range(5) for t, k in zip(asked, (3, 10, 5, 100, 20, 7))])
    written, put = [], cut.materialize
    for module in (search, fuse, score, recall, blocks):
        monkeypatch.setattr(module, "materialize", lambda df, what: (written.append(what), put(df, what))[1])
    one = search.search(q, docs, config).orderBy("query_id", "position").collect()
    assert one and not {"scored", "ranked", "pool"} & set(written)
    monkeypatch.setattr(blocks, "WEIGHT", 900)
    many = search.search(q, docs, config).orderBy("query_id", "position").collect()
    assert "ranked" in written or name == "no views"
    assert [r.asDict() for r in one] == [r.asDict() for r in many]


def test_candidates_by_parts_equal_those_by_rows_at_each_step(spark, monkeypatch):
    from tessera.operators import blocks, cut, whole

    config = Config(segment_max_messages=3, max_candidates=25, dense_max_candidates=9, feature_scan_limit=2**31 - 1).with_flags(vector=True, temporal_intent=True, preference_role_boost=True)
    rng = random.Random(3)
    words = ["Apollo", "budget", "quota", "is now", "was", "changed to", "100", "2,000", "2024-01-02", "I prefer", "red", "预算", '"green tea"']
    said = lambda n: " ".join(rng.choice(words) for _ in range(n)) if n else None
    docs = docs_of(spark, [(f"u{i % 3}", rng.choice(["s", "t", None]), i // 3, rng.choice(["user", "assistant"]), said(rng.randint(0, 9)), rng.choice([None, 10**6 * i])) for i in range(90)], config)
    q = ask(spark, *[(f"u{u}", t, k) for u in range(4) for t, k in (("what is the current Apollo budget amount", 3), ('recommend "green tea" for me', 20), ("预算 2024-01-02 now 2,000", 7))])
    vector = lambda c: F.array(F.length(F.coalesce(c, F.lit(""))) * 1.0, F.lit(3.0)).alias("vector")
    channels = {"query_vectors": q.select("query_id", "user_id", vector("query")), "vectors": docs.select("user_id", "doc_id", vector("content"))}
    written, put = [], cut.materialize
    for module in (search, fuse, score, recall, blocks):
        monkeypatch.setattr(module, "materialize", lambda df, what: (written.append(what), put(df, what))[1])
    monkeypatch.setattr(whole, "TOGETHER", 2)
    prepared, docs, found = search.union(recall.prepare(q, config), docs, config, **channels)
    found = put(found, "found")
    full = score.full_score(search.hydrated(found, prepared, docs), config)
    ranked = fuse.in_order(fuse.fuse(fuse.rerank_features(score.score(search.hydrated(found, prepared, docs), config)), config))
    kept = fuse.dedup(ranked)
    columns = ["query_id", "doc_id", "score", "flags"]
    more = [*columns, "position", "fts_rank", "feature_rank", "dense_rank"]
    written.clear()
    for upto, by_rows, names in ((whole.FULL, full, columns), (whole.RANKED, ranked, more), (whole.KEPT, kept, more), (whole.FOUND, fuse.slots(kept, config), [*more, "total"])):
        got = whole.arranged(prepared, docs, found, config, upto).select(names).orderBy("query_id", "doc_id").collect()
        assert got and got == by_rows.select(names).orderBy("query_id", "doc_id").collect(), upto
    assert any(r.dense_rank for r in got) and any("superseded" in r.flags for r in got)
    written.clear()
    assert search.search(q, docs.drop("terms", "dl"), config, **channels).count() == len(got)
    assert not {"scored", "pool"} & set(written)  # no table of pairs with their texts


def test_few_users_with_much_to_compare_take_several_blocks(spark, monkeypatch):
    from tessera.operators import blocks

    asked = spark.createDataFrame([(f"q{i}", f"u{i % 2}") for i in range(40)], "query_id string, user_id string")
    held = spark.createDataFrame([(f"d{i}", f"u{i % 4}", 50) for i in range(200)], "doc_id string, user_id string, w int")
    assert blocks.spread(asked, held, F.col("w")).users.agg(F.max(F.col("_nq") * F.col("_nd"))).first()[0] == 1
    monkeypatch.setattr(blocks, "WORK", 10_000.0)
    over = blocks.spread(asked, held, F.col("w"))
    assert all(r._nq * r._nd >= 3 for r in over.users.collect()) and all(r._nd == 1 for r in blocks.spread(asked, held, F.col("w"), single=True).users.collect())
    a, b = blocks.dealt(asked, held, over)
    pairs = a.join(b, ["user_id", *blocks.KEY]).select("query_id", "doc_id").collect()
    assert len(pairs) == len(set(pairs)) == 40 * 50


def test_bounds_of_what_can_be_among_the_best_lose_no_row_and_send_fewer(spark, monkeypatch):
    from tessera.operators import blocks

    rng = random.Random(7)
    said = lambda n: " ".join(rng.choice(["red", "car", "cart", "2024-01-02", "预算", "x1", "Rome"]) for _ in range(n))
    rows = [(f"u{i % 2}", "s", i, "user", "red car" if i % 3 == 0 else said(rng.randint(1, 9)), i) for i in range(400)]  # many copies: ties at the bound
    docs = docs_of(spark, rows, Config(max_candidates=4).with_flags(views=False))
    config = Config(max_candidates=4, dense_max_candidates=4, feature_scan_limit=2**31 - 1).with_flags(views=False)
    prepared = recall.prepare(ask(spark, *[(f"u{i % 2}", said(3), 5) for i in range(12)]), config)
    vectors = spark.createDataFrame([(f"d{i}", f"u{i % 2}", [float(i % 7), 1.0, float(i % 3)]) for i in range(400)], "doc_id string, user_id string, vector array<float>")
    asked = vectors.where("doc_id like '%5'").withColumnRenamed("doc_id", "query_id")
    messages = docs.select(F.col("doc_id").alias("id"), "user_id", F.col("doc_type").alias("view"), "content")
    base = prepared.select("query_id", "user_id", F.lit("message").alias("view"), "query", F.lit(4).alias("top_k"))
    channels = {"lexical": lambda: recall.lexical(prepared, docs, config), "features": lambda: recall.features(prepared, docs, config), "dense": lambda: recall.dense(asked, vectors, config), "baseline": lambda: recall.baseline_search(base, messages)}
    rounded = lambda made: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in made().collect())
    want = {name: rounded(made) for name, made in channels.items()}
    assert all(want.values())
    monkeypatch.setattr(blocks, "WEIGHT", 500)
    monkeypatch.setattr(blocks, "SPLIT", 3)
    left, cogrouped = [], []
    place = blocks.placed
    monkeypatch.setattr(blocks, "placed", lambda rows, over: cogrouped.append(rows.columns) or place(rows, over))
    for name, made in channels.items():
        cogrouped.clear()
        assert rounded(made) == want[name], name
        left.append(any("_least" in columns for columns in cogrouped))
    assert all(left)


def test_statistics_of_terms_are_summed_before_they_are_shuffled(spark, monkeypatch):
    config = Config().with_flags(views=False)
    docs = index.indexed(docs_of(spark, [("u", "s", i, "user", f"common 2024-01-0{i % 3 + 1}", i) for i in range(60)], config))
    prepared = recall.prepare(ask(spark, ("u", "common 2024-01-02", 5), ("v", "absent 1.5", 5)), config)
    found, write = [], recall.materialize
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for few in (10, 0):
        monkeypatch.setattr(recall, "FEW", few)
        plans = {}
        monkeypatch.setattr(recall, "materialize", lambda df, name, plans=plans: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name))
        found.append(sorted((r.query_id, tuple(r.wanted), tuple(round(x, 9) for x in r.idf)) for r in recall.wanted_terms(prepared, docs, config).collect()))
        lines = plans["wanted"].splitlines()
        joins = [(line, below) for line, below in zip(lines, lines[1:]) if "LeftSemi" in line]
        assert len(joins) == 2  # of terms and of runs: with what is sought in every task, or of sums
        assert all("strategy=broadcast" in line if few else "Aggregate" in below for line, below in joins)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[0] == found[1]
    assert {t for _, wanted, _ in found[0] for t in wanted} == {"common", "2024", "01", "02", "2024 01 02"}


def test_bm25_of_queries_that_no_document_has():
    rows = list(recall.bm25_rows({"wanted": [["a"], [], ["b"]], "idf": [[1.0], [], [2.0]], "avgdl": [1.0] * 3}, {"dl": [1, 1], "terms": ["c", "b"]}))
    assert [(r > 0).tolist() for r in rows] == [[False, False], [False, False], [False, True]]


def test_bm25_of_a_pair_is_the_same_in_any_block():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["2024", "01", "02"]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(300)]
    asked = {"wanted": [rng.sample(words, 9) + ["2024 01", "01 02 2024"] for _ in range(20)], "avgdl": [30.0] * 20}
    weight = {t: rng.random() for own in asked["wanted"] for t in own}
    asked["idf"] = [[weight[t] for t in own] for own in asked["wanted"]]
    held = lambda rows: {"dl": [len(t) for t in rows], "terms": [" ".join(t) for t in rows]}
    every = recall.bm25_scores(asked, held(texts))
    one = recall.bm25_scores({c: v[3:4] for c, v in asked.items()}, held(texts[100:117]))
    assert (every[3, 100:117].tobytes(), every.shape) == (one[0].tobytes(), (20, 300))
    for j, terms in enumerate(texts[:50]):
        tf = [sum(terms[k : k + len(t.split())] == t.split() for k in range(len(terms))) for t in asked["wanted"][3]]
        want = sum(weight[t] * recall.gain(n, len(terms), 30.0) for t, n in zip(asked["wanted"][3], tf) if n)
        assert (want == pytest.approx(every[3, j])) if want else every[3, j] != every[3, j]


def test_hits_cost_no_cell_for_a_value_and_a_text_that_lacks_it():
    from tessera.operators import blocks

    rng = random.Random(9)
    said = lambda n: "".join(rng.choice("ab1é. 预") for _ in range(n))
    texts = [said(rng.randint(0, 60)) + rng.choice(["", "abcdefghijklmnop", "abcdefghijklx"]) for _ in range(80)]
    values = list(dict.fromkeys([t[i : i + rng.randint(1, 20)] for t in texts for i in (0, 5)] + ["", "abcdefghijkl", "abcdefghijklmn", "abcdefghijklmnopq", "b"]))
    found = blocks.hits(texts, values)
    assert [found.places[a:b].tolist() for a, b in zip(found.starts, found.starts[1:])] == [[j for j, t in enumerate(texts) if v in t] for v in values]
    assert found.counted([1, 1, 3]).tolist() == [2 * (values[1] in t) + (values[3] in t) for t in texts]
    assert found.counted([]).tolist() == [0] * len(texts)


def test_signatures_go_only_to_queries_that_ask_for_what_is_current(spark):
    from tessera.operators import search

    config = Config(feature_scan_limit=2**31 - 1).with_flags(views=False)
    docs = docs_of(spark, [("u", "s", i, "user", f"The Rome quota was {i}" if i % 2 else f"The Rome quota is now {i}", i * 1000) for i in range(12)] + [("v", "t", i, "user", f"red car {i}", i) for i in range(5)], config)
    prepared = recall.prepare(ask(spark, ("u", "what is the current Rome quota amount", 5), ("u", "Rome quota", 5), ("v", "red car", 5)), config)
    rows = search.arranged(prepared, docs, config)[2].collect()
    flags = {(r.query_id, f) for r in rows for f in r.flags}
    assert any(f == "supersedes_earlier" for _, f in flags) and len({r.query_id for r in rows}) == 3
    plain = search.arranged(prepared.where("not temporal"), docs, config)[2]
    assert "cast(null as array<string>) AS sig" in plain._jdf.queryExecution().analyzed().toString() and plain.count() == 10


def test_stages_that_recall_the_same_share_it_and_find_what_a_search_finds(spark):
    from tessera.config import stage
    from tessera.operators import experiments, search

    rows = [("u", "s", i, "user", f"The Rome quota was {i}" if i % 3 else f"The Rome quota is now {i}", i * 1000) for i in range(9)]
    docs = docs_of(spark, rows, Config())
    messages = docs.where("doc_type = 'message'").select(F.col("doc_id").alias("id"), "user_id", "session_id", "seq", "role", "content", "ts_ms")
    queries = ask(spark, ("u", "what is the current Rome quota amount", 5), ("u", "Rome 4", 5))
    corpus = experiments.Corpus(messages)
    for name in ("L3", "L9"):
        made = {(r.query_id, r.position, r.doc_id, tuple(r.source_ids)) for r in corpus.search(queries, stage(name)).collect()}
        want = {(r.query_id, r.position, r.doc_id, tuple(r.source_ids)) for r in search.search(queries, docs, stage(name)).collect()}
        assert made == want and len(made) == 10, name
    assert len(corpus.found) == 1
