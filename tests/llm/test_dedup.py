import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, line_dedup, ngram_join
from tessera.llm.common import components

WS = " \t\n\v\f\r"
DOCS = "doc_id long, text string, keep_id string, sig string, cls int, chunk int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], DOCS)


def squeeze(t):
    return "".join(c for c in (t or "") if c not in WS)


def odd_rows():
    rng = random.Random(3)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(200 + i, rows[i][1].replace(" ", "\n  ")) for i in range(10)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, "alpha beta"), (303, "Ünï   x"), (303, "Ünï   x"), (304, "word " * 30_000), (305, "y" * 200_000)]
    return rows


def test_exact_groups_equal_brute_force(spark):
    rows = odd_rows()
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted((str(i), str(min(groups[squeeze(t)])[3]), len(groups[squeeze(t)]), hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in rows)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(frame(spark, rows)).collect())
    assert got == want


def test_exact_keep_first_keeps_columns_and_one_row_each(spark):
    rows = odd_rows()
    kept = exact_dedup.keep_first(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    texts = [squeeze(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({squeeze(t) for _, t in rows})


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, ngram_join.jaccard_classes, line_dedup.dedup_passages, exact_dedup.keep_first, ngram_join.keep_one])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, []).limit(0)).collect() == []


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, live, rng = exact_dedup.CuckooIndex(8), {}, random.Random(5)
    for step in range(6000):
        content = str(rng.randint(0, 900)).encode()
        d = hashlib.sha256(content).digest()
        if rng.random() < 0.6:
            _, new = index.insert(d, content, None)
            assert new == (content not in live)
            live[content] = live.get(content, 0) + 1
        else:
            assert index.delete(d, content) == (content in live)
            if live.get(content, 0) > 1:
                live[content] -= 1
            else:
                live.pop(content, None)
    assert index.live == len(live) and index.resizes > 0
    for c in live:
        assert index.get(hashlib.sha256(c).digest(), c)[2] == live[c]
    for c in list(live):
        while index.delete(hashlib.sha256(c).digest(), c):
            pass
    assert index.live == 0 and not any(index.slots) and not index.keys


def test_cuckoo_hits_are_verified():
    index = exact_dedup.CuckooIndex()
    d = hashlib.sha256(b"a").digest()
    index.insert(d, b"a", None)
    other = d[:13] + bytes(19)  # the same fingerprint, place and bucket, another key
    assert index.maybe(other) and index.get(other, b"b") is None and index.false_hits == 1
    with pytest.raises(ValueError):
        index.get(d, b"not a")


def shingles(t, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in WS:
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_rows(seed, n, size):
    rng, rows = random.Random(seed), []
    for b in range(n):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, size))]
        for _ in range(rng.choice([1, 1, 1, 2, 5, 20])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else "\t ".join(own)))
    return rows


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    link, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                link[a] += 1
                link[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        r = find(a)
        least[r] = min(least.get(r, i), i)
    return sorted((rows[a][0], len(sets[a]), least[find(a)], link[a]) for a in range(len(rows)))


@pytest.mark.parametrize("k, num, den, size", [(3, 90, 100, 150), (5, 80, 100, 120), (3, 50, 100, 30)])
def test_ngram_join_equals_brute_force(spark, k, num, den, size):
    rows = near_rows(k * num, 40, size) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "One\vtwo"), (9006, "one two three")]
    got = ngram_join.jaccard_classes(frame(spark, rows), k, num, den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == brute(rows, k, num, den)


def test_ngram_join_splits_blocks_and_chunks(spark, monkeypatch):
    """Small parts, chunks and hot limits: the same result from many tasks."""
    import numpy as np

    rows = near_rows(11, 12, 60)
    sets = []
    for _, t in rows:
        sets.append(np.unique(np.array([hash(x) & (2**64 - 1) for x in shingles(t, 3)], np.uint64)))
    seen = {s.tobytes(): i for i, s in reversed(list(enumerate(sets)))}
    own = sorted(seen.values())
    toks = [sets[i] for i in own]
    n, one = np.array([len(t) for t in toks]), np.ones(len(own), np.int64)
    dfs = [np.array([sum(x in set(t.tolist()) for t in toks) for x in s.tolist()], np.uint32) for s in toks]
    order = [np.lexsort((s, d)) for s, d in zip(toks, dfs)]
    toks, dfs = [s[o] for s, o in zip(toks, order)], [d[o] for d, o in zip(dfs, order)]
    zero = np.zeros(len(own), np.int64)
    links, _ = ngram_join.join_block(np.array(own), one, n, zero, toks, dfs, 50, 100)
    half = np.arange(len(own)) % 2
    a = [i for i in range(len(own)) if half[i] == 0]
    b = [i for i in range(len(own)) if half[i] == 1]
    total = np.zeros(len(own), np.int64)
    for part, cut in ((a, None), (b, None), (list(range(len(own))), half)):
        got, _ = ngram_join.join_block(np.array(own)[part], one[part], n[part], zero[part], [toks[i] for i in part], [dfs[i] for i in part], 50, 100, cut)
        total[part] += got
    assert (total == links).all()


@pytest.mark.parametrize("num, den", [(80, 100), (50, 100), (100, 100)])
def test_ngram_join_in_bands_of_sizes_loses_no_link(spark, monkeypatch, num, den):
    """One block of many sizes, cut into parts of three documents or sixty shingles."""
    monkeypatch.setattr(ngram_join, "PART_DOCS", 3)
    monkeypatch.setattr(ngram_join, "PART_SHINGLES", 60)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 4 + i])) for i in range(50)] + [(100 + i, " ".join([*words[: 5 + 3 * i], f"own{i}"])) for i in range(15)] + [(200, " ".join(words[:30])), (201, "w1 w2 w3")]
    got = ngram_join.jaccard_classes(frame(spark, rows), 3, num, den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == brute(rows, 3, num, den)


def test_components_on_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(30)) and 500 not in got


def test_ngram_join_null_ids_and_repeats(spark):
    t = "a b c d e f g h"
    rows = [(None, t), (7, t), (7, t), (9, t + " i"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in ngram_join.jaccard_classes(frame(spark, rows), 3, 80, 100).collect())
    assert got == [("7", 6, "7", 3), ("7", 6, "7", 3), ("9", 7, "7", 3), ("None", 0, "None", 0), ("None", 6, "7", 3)]


PASSAGE = "\n".join(f"line {i} of a passage that many documents share with words enough" for i in range(12))


def test_line_dedup_removes_a_shared_passage_once(spark):
    rows = [(i, f"head {i}\nown {i}\n{PASSAGE}\ntail {i}\nend {i}") for i in range(5)] + [(50, "clean\nlines\nonly"), (51, None), (52, ""), (53, "x\n" * 50_000)]
    got = {r.doc_id: r for r in line_dedup.dedup_passages(frame(spark, rows)).collect()}
    assert got[0].text == dict(rows)[0] and got[0].removed_lines == 0 and got[50].text == "clean\nlines\nonly" and got[51].text == got[52].text == ""
    assert all(got[i].text == f"head {i}\nown {i}\ntail {i}\nend {i}" for i in range(1, 5))


def test_rows_that_repeat_an_id_lose_only_their_own_copies(spark):
    other = "\n".join(f"unrelated line {i} of another text" for i in range(24))
    rows = [(1, PASSAGE), (5, PASSAGE + "\n" + "\n".join(f"more words {i} here" for i in range(12))), (5, other), (None, other + "\nx y"), (None, "a b\nc d")]
    got = sorted((str(r.doc_id), r.n_lines, r.removed_lines) for r in line_dedup.dedup_passages(frame(spark, rows)).collect())
    assert got == [("1", 12, 0), ("5", 24, 12), ("5", 24, 24), ("None", 2, 0), ("None", 25, 0)]


def test_recall_of_repeated_passages_is_whole(spark):
    """Passages of 2 to 20 lines with random text around: every line of every later copy goes, and no other."""
    rng = random.Random(17)
    line = lambda: " ".join(rng.choices([f"w{i}" for i in range(5000)], k=8))
    rows, want = [], {}
    for n in (2, 3, 5, 8, 20):
        for _ in range(6):
            shared = [line() for _ in range(n)]
            for copy in range(3):
                want[len(rows)] = n if copy else 0
                rows.append((len(rows), "\n".join([line() for _ in range(rng.randint(0, 9))] + shared + [line() for _ in range(rng.randint(0, 9))])))
    assert {r.doc_id: r.removed_lines for r in line_dedup.dedup_passages(frame(spark, rows)).collect()} == want


def whole_passages(rows):
    """Plain Python: lines of pairs that occurred before go, lines of a repeated pair's first occurrence stay."""
    pairs = []
    for i, t in rows:
        own = (t or "").split("\n")
        ink = [k for k, x in enumerate(own) if x.strip()]
        pairs += [("\n".join(own[a : b + 1]), i, a, b) for a, b in zip(ink, ink[1:])]
    held, first = {}, {}
    for x, i, a, _ in pairs:
        held[x], first[x] = held.get(x, 0) + 1, min(first.get(x, (i, a)), (i, a))
    gone = {(i, k) for x, i, a, b in pairs if first[x] != (i, a) for k in range(a, b + 1)}
    gone -= {(i, k) for x, i, a, b in pairs if held[x] > 1 and first[x] == (i, a) for k in range(a, b + 1)}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in rows}


def test_whole_passages_of_two_to_six_lines_go(spark):
    rows, want = [], {}
    for n in range(2, 7):
        for v in range(4):
            shared = [f"shared line {x} of passage {n} {v} with some words" for x in range(n)]
            shared.insert(1, "") if v % 2 else None
            for copy in range(3):
                i, head, tail = len(rows), [f"head {n} {v} {copy}", "own words"][: 1 + copy % 2], [f"tail {n} {v} {copy}"]
                rows.append((i, "\n".join(head + shared + tail)))
                want[i] = (len(shared) if copy else 0, "\n".join(head + (shared if not copy else []) + tail))
    got = {r.doc_id: (r.removed_lines, r.text) for r in line_dedup.dedup_passages(frame(spark, rows)).collect()}
    assert got == want


def test_whole_passages_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [f"sentence number {i} with a few words" for i in range(25)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(60)] + [(90, None), (91, ""), (92, "x\n" * 20_000), (93, "one line")]
    got = {r.doc_id: r for r in line_dedup.dedup_passages(frame(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == whole_passages(rows) and any(got[i].text != (t or "") for i, t in rows)
    assert all(r.n_lines == len((dict(rows)[i] or "").split("\n")) for i, r in got.items())
    repeats = [(None, "a b\nc d"), (None, "a b\nc d"), (5, "q\na b\nc d"), (5, "a b")]
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_passages(frame(spark, repeats)).collect()) == [("5", "a b"), ("5", "q"), ("None", "a b\nc d"), ("None", "a b\nc d")]


def test_whole_passages_are_native(spark):
    plan = line_dedup.dedup_passages(frame(spark, [(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert line_dedup.dedup_passages(frame(spark, []).limit(0)).collect() == []


def sql_rows(sql, rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": pd.array([t for _, t in rows], "string")}))
    return con.sql(sql).fetchall()


def test_line_dedup_equals_its_sql(spark):
    rng = random.Random(5)
    pool = [f"sentence number {i} with a few words" for i in range(25)] + ["", " ", "\t"]
    rows = [(i % 50, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(60)] + [(90, None), (91, ""), (None, "q w\ne r"), (95, "q w\ne r\nt")]
    got = line_dedup.dedup_passages(frame(spark, rows)).select("doc_id", "n_lines", "removed_lines", F.sha2("text", 256)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, sql_rows(line_dedup.SQL, rows)))


def test_keep_first_keeps_no_copy_of_repeated_ids(spark):
    rows = [(2, "bbb"), (5, "bbb"), (5, "ccc"), (7, "a b"), (7, "a\tb"), (7, "ab"), (None, "dd"), (None, "dd"), (9, "dd")]
    got = sorted((str(r.doc_id), r.text) for r in exact_dedup.keep_first(frame(spark, rows)).collect())
    assert got == [("2", "bbb"), ("5", "ccc"), ("7", "a\tb"), ("9", "dd")]


def test_contents_of_met_digests_are_compared(spark, monkeypatch):
    rows = frame(spark, [(1, "a b"), (2, "ab"), (3, "c")]).repartition(3)
    leads = rows.select(F.unhex(F.sha2(F.lit("x"), 256)).alias("digest"))
    exact_dedup.verify(rows, leads)
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("ab"))
    with pytest.raises(ValueError):
        exact_dedup.verify(rows, rows.select(F.unhex(F.lit("ab")).alias("digest")))


def test_a_hot_key_is_spread_and_joined_whole(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 3)
    big = spark.range(6000).select(F.when(F.col("id") % 7 == 0, None).when(F.col("id") < 5000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = common.materialize(big.where("k is not null and id % 2 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("first")), "test-small")
    got = common.skewed_left_join(big, small, ["k"], "held")
    want = big.join(small, "k", "left")
    assert got.columns == ["k", "id", "held", "first"] and got.exceptAll(want.select(got.columns)).count() == 0 == want.select(got.columns).exceptAll(got).count()
