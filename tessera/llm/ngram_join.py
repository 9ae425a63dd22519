"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

1. Each task hashes the shingle sets of a stretch of rows (a chunk), drops equal sets within it, and deals its distinct
   shingles out by hash range, with the numbers of the chunk's documents that hold them.
2. A range counts the documents of each shingle and answers every chunk with its shingles that at least two hold.
   A shingle that many of a chunk's documents hold travels as a count, so an entry list grows with the chunks.
3. A chunk puts each document's shingles in the global order (document frequency, hash). A document with fewer shared
   shingles than any partner must share with it has no partner and leaves; that is nearly every document.
4. Documents whose prefixes share a shingle fall into one block: stars about each shingle's smallest document, then
   connected components. A large block is cut into bands of set sizes, and these into parts; tasks compare pairs of
   parts of the same or adjacent bands.
5. Within a block each document's prefix is lengthened by l - 1 for the l of least estimated cost; a pair is verified
   after min(l, l') shared prefix shingles. Tasks return a row per document: its links and a spanning star.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, materialize, mix, partitions, skewed_left_join, shingle_sets, table

#: Rows (65 535 at most: they are numbered in 16 bits) and shingles of a chunk.
CHUNK_DOCS, CHUNK_SHINGLES = 1536, 450_000
#: A shingle in more of a chunk's documents than this travels as a count; its documents stay with the chunk.
LOCAL_HOT = 16
#: Documents and shingles of a part of a block, where it has several documents; a task holds two parts.
PART_DOCS, PART_SHINGLES = 256, 1 << 20
#: Bytes of input, as it lies in files, whose shingles a hash range holds: with more input there are more ranges.
RANGE_BYTES = 16 << 20
MAX_MATCHES = 8
#: Estimated cost of a verification, in entries of an inverted list.
VERIFY_COST = 64

_BIN = "kind int, target long, chunk long, ids binary, a binary, b binary, c binary, d binary"
_NAMES = [x.split()[0] for x in _BIN.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _BIN.split(", ")]
DOCS = "doc_id long, n long, sig binary, lead boolean, own long, tokens binary, dfs binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in _NAMES]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def _planes(tokens: np.ndarray) -> bytes:
    """Sorted tokens byte plane by byte plane: the leading planes are runs that the shuffle's compression removes."""
    return tokens.view(np.uint8).reshape(-1, 8).T.tobytes()


def _tokens(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _least_overlap(n, num: int, den: int):
    """The fewest shared elements of a set of n with any set at Jaccard >= num/den."""
    return -(-n * num // den)


def _ranges(tokens: np.ndarray, count: int) -> np.ndarray:
    """The number of the hash range of each token."""
    return ((tokens >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _deal(k: int, count: int):
    """Chunks: a header row (kind 0) for the chunk, and a row (kind 1) for each range with the chunk's cold shingles as CSR and its hot ones as counts."""

    def chunk_rows(ids, valid, sets, number):
        n = np.array([len(s) for s in sets], np.int64)
        sig = [(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0)) for s in sets]
        sigs = [int(m).to_bytes(8, "little") + int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little") for m, (a, b) in zip(n, sig)]
        first: dict[bytes, int] = {}
        for i, x in enumerate(sigs):
            first.setdefault(x, i)
        lead = np.array([first[x] == i and n[i] > 0 for i, x in enumerate(sigs)], bool)
        who = np.repeat(np.arange(len(sets)), n)
        tok = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        use = lead[who]
        who, tok = who[use], tok[use]
        order = np.argsort(tok, kind="stable")
        who, tok = who[order].astype(np.uint16), tok[order]
        starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
        held = np.diff(np.append(starts, len(tok)))
        uniq = tok[starts]
        hot = np.repeat(held > LOCAL_HOT, held)
        head = {"n": n, "lead": lead, "valid": valid}
        rows = [(0, number, number, ids.tobytes(), head["n"].tobytes(), b"".join(sigs), np.packbits(np.stack([lead, valid])).tobytes(), tok[hot].tobytes() + who[hot].tobytes())]
        parts = _ranges(uniq, count)
        cuts = np.searchsorted(parts, np.arange(count + 1))
        ends = np.append(starts, len(tok))
        for r in range(count):
            a, b = cuts[r], cuts[r + 1]
            if a < b:
                keep = ~hot[ends[a] : ends[b]]
                rows.append((1, r, number, None, _planes(uniq[a:b]), held[a:b].astype(np.uint16).tobytes(), who[ends[a] : ends[b]][keep].tobytes(), None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 24) if TaskContext.get() else 0
        ids, valid, sets, total = [], [], [], 0
        for batch in batches:
            col = batch.column(0)
            known = col.is_valid().to_numpy(zero_copy_only=False)
            own = col.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b, d, h in shingle_sets(batch.column(1), k):
                cut = np.searchsorted(d, np.arange(a, b + 1))
                for i in range(b - a):
                    ids.append(own[a + i]), valid.append(known[a + i])
                    sets.append(h[cut[i] : cut[i + 1]])
                    total += len(sets[-1])
                    if len(ids) >= CHUNK_DOCS or total >= CHUNK_SHINGLES:
                        yield _batch(chunk_rows(np.array(ids, np.int64), np.array(valid, bool), sets, number))
                        number, ids, valid, sets, total = number + 1, [], [], [], 0
        if ids:
            yield _batch(chunk_rows(np.array(ids, np.int64), np.array(valid, bool), sets, number))
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the ranges dealt to this task, the frequency of each shingle; answers chunks with what two documents or more hold. Headers pass."""
    chunks, tok, held, cold = [], [], [], []
    for batch in batches:
        pass_on = []
        for kind, target, chunk, ids, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns)):
            if kind == 0:
                pass_on.append((0, target, chunk, ids, a, b, c, d))
            else:
                chunks.append(chunk)
                tok.append(_tokens(a)), held.append(np.frombuffer(b, np.uint16)), cold.append(np.frombuffer(c, np.uint16))
        if pass_on:
            yield _batch(pass_on)
    if not tok:
        return
    size = np.array([len(t) for t in tok])
    every = np.concatenate(tok)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(np.concatenate(held).astype(np.int64)[order], at)
    df = np.empty(len(every), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(at, len(every))))
    del order, new, every
    out, pos = [], 0
    for i, chunk in enumerate(chunks):
        own = df[pos : pos + size[i]]
        pos += size[i]
        use = own > 1
        if use.any():
            hot = held[i] > LOCAL_HOT
            reach = np.where(hot, 0, held[i])
            docs = cold[i][np.repeat(use, reach)]
            out.append((1, chunk, chunk, None, _planes(tok[i][use]), np.where(hot, 0, held[i])[use].astype(np.uint16).tobytes(), docs.tobytes(), np.minimum(own[use], 2**32 - 1).astype(np.uint32).tobytes()))
        tok[i] = cold[i] = None
        if len(out) >= 64:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)
    del tok, held, cold, df, out
    pa.default_memory_pool().release_unused()


def _order(num: int, den: int):
    """Of one chunk: a row per document; the leading ones that can have a partner carry their shared shingles in global order."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf.kind == 0].iloc[0]
        ids, n = np.frombuffer(head.ids, np.int64), np.frombuffer(head.a, np.int64)
        flags = np.unpackbits(np.frombuffer(head.c, np.uint8))[: 2 * len(ids)].reshape(2, -1).astype(bool)
        sigs = [head.b[24 * i : 24 * i + 24] for i in range(len(ids))]
        m = len(head.d) // 10
        hot_tok, hot_doc = np.frombuffer(head.d[: 8 * m], np.uint64), np.frombuffer(head.d[8 * m :], np.uint16)
        toks, docs, dfs = [], [], []
        for r in pdf[pdf.kind == 1].itertuples():
            t, held, df = _tokens(r.a), np.frombuffer(r.b, np.uint16), np.frombuffer(r.d, np.uint32)
            toks.append(np.repeat(t, held)), dfs.append(np.repeat(df, held)), docs.append(np.frombuffer(r.c, np.uint16))
            far = held == 0
            if far.any() and m:
                lo, hi = np.searchsorted(hot_tok, t[far]), np.searchsorted(hot_tok, t[far], "right")
                idx = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)]) if len(lo) else np.zeros(0, np.int64)
                toks.append(hot_tok[idx]), docs.append(hot_doc[idx]), dfs.append(np.repeat(df[far], hi - lo))
        tok = np.concatenate(toks) if toks else np.zeros(0, np.uint64)
        doc = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
        df = np.concatenate(dfs) if dfs else np.zeros(0, np.uint32)
        shared = np.bincount(doc, minlength=len(ids))
        able = (n > 0) & flags[0] & (shared >= _least_overlap(n, num, den))
        use = able[doc]
        tok, doc, df = tok[use], doc[use], df[use]
        order = np.lexsort((tok, df, doc))
        tok, doc, df = tok[order], doc[order], df[order]
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        return pd.DataFrame({
            "doc_id": pd.array(np.where(flags[1], ids, 0), "Int64").copy() if flags[1].all() else pd.array([int(x) if v else None for x, v in zip(ids, flags[1])], "Int64"),
            "n": n, "sig": sigs, "lead": able, "own": n - shared,
            "tokens": [tok[cut[i] : cut[i + 1]].tobytes() if able[i] else None for i in range(len(ids))],
            "dfs": [df[cut[i] : cut[i + 1]].tobytes() if able[i] else None for i in range(len(ids))],
        })

    return run


def _prefix(num: int, den: int, extra: int = 0):
    """How many of a document's shared shingles its prefix holds: n - least overlap + 1 + extra, less the ones it has alone."""
    return lambda n, own: np.maximum(0, n - _least_overlap(n, num, den) + 1 + extra - own)


def _postings(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, who = [], []
            for cls, n, own, tokens in zip(*(x.to_pylist() for x in batch.columns)):
                t = np.frombuffer(tokens, np.int64)[: int(_prefix(num, den)(n, own))]
                toks.append(t), who.append(np.full(len(t), cls, np.int64))
            if toks:
                yield pa.record_batch([pa.array(np.concatenate(toks)), pa.array(np.concatenate(who))], names=["token", "cls"])

    return run


def choose_matches(n: int, own: int, dfs: np.ndarray, num: int, den: int) -> int:
    """The l of least cost: entries in the lists of the prefix for l, and VERIFY_COST for each candidate that l matches leave by estimate."""
    base = n - _least_overlap(n, num, den) - own
    cum = np.cumsum(dfs.astype(np.float64))
    best, least = 1, np.inf
    for l in range(1, MAX_MATCHES + 1):  # noqa: E741
        p = base + l
        if p > len(dfs):  # more matches than any partner need share
            break
        cost = cum[p - 1] + VERIFY_COST * cum[p - 1] / l**2
        if cost < least:
            best, least = l, cost
    return best


def join_block(cls, cnt, n, own, toks, dfs, num: int, den: int, halves=None):
    """(links of each document in documents, number of its root): the links with Jaccard >= num/den within a block, or between halves 0 and 1 if given. Exact."""
    m = len(cls)
    matches = [choose_matches(int(n[i]), int(own[i]), dfs[i], num, den) for i in range(m)]
    length = [int(_prefix(num, den, matches[i] - 1)(n[i], own[i])) for i in range(m)]
    full = np.concatenate(toks) if m else np.zeros(0, np.uint64)
    uniq, code = np.unique(full, return_inverse=True)
    cut = np.concatenate([[0], np.cumsum([len(t) for t in toks])])
    pre_tok = np.concatenate([code[cut[i] : cut[i] + length[i]] for i in range(m)])
    pre_doc = np.concatenate([np.full(min(length[i], cut[i + 1] - cut[i]), i) for i in range(m)])
    order = np.argsort(pre_tok, kind="stable")
    lists, at = pre_doc[order], np.searchsorted(pre_tok[order], np.arange(len(uniq) + 1))
    links, root = np.zeros(m, np.int64), np.arange(m)
    need = np.array(matches)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mark = np.zeros(len(uniq), np.int64)
    for x in range(m):
        found = [lists[at[t] : at[t + 1]] for t in code[cut[x] : cut[x] + length[x]]]
        if not found:
            continue
        hits = np.bincount(np.concatenate(found), minlength=m)[:x]
        y = np.flatnonzero(hits >= np.minimum(need[:x], need[x]))
        y = y[(np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num)]
        if halves is not None:
            y = y[halves[y] != halves[x]]
        if not len(y):
            continue
        mark[code[cut[x] : cut[x + 1]]] = 1
        lens = cut[y + 1] - cut[y]
        idx = np.repeat(cut[y] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        both = np.add.reduceat(mark[code[idx]], np.concatenate([[0], np.cumsum(lens)[:-1]]))
        mark[code[cut[x] : cut[x + 1]]] = 0
        y = y[both * den >= (n[x] + n[y] - both) * num]
        links[y] += cnt[x]
        links[x] += cnt[y].sum()
        for i in y:
            a, b = find(i), find(x)
            if a != b:
                root[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(m)], np.int64)


def _block(num: int, den: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "cls"], kind="stable")
        cls, cnt, n, own = (pdf[c].to_numpy(np.int64) for c in ("cls", "cnt", "n", "own"))
        toks, dfs = [np.frombuffer(x, np.uint64) for x in pdf.tokens], [np.frombuffer(x, np.uint32) for x in pdf.dfs]
        halves = pdf["part"].to_numpy(np.int64) if key[1] != key[2] else None
        links, root = join_block(cls, cnt, n, own, toks, dfs, num, den, halves)
        return pd.DataFrame({"cls": cls, "root": cls[root], "links": links})

    return run


def _tasks(blocks: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """(cls, block, part, lo, hi): the parts of each block, and the pairs of parts that tasks compare.

    A block of more than one part is cut into bands of set sizes: linked sets differ in size by den/num at most, so
    they lie in one band or in adjacent ones, and only parts of such bands meet. A part is bounded in documents and,
    as the sets of a band are alike in size, in shingles.
    """
    width = max(math.log(den / num) * 1.0001, 1e-6)  # a little wide, so that rounding parts no linked sets by two bands
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(PART_DOCS)), F.ceil(F.sum("n") / F.lit(PART_SHINGLES))).cast("long")
    held = F.count(F.lit(1)).alias("held")
    sized = blocks.join(reps.selectExpr("cls as node", "n"), "node")
    whole = materialize(sized.groupBy("component").agg(parts.alias("whole"), held), "ngram-whole")
    band = F.when(F.col("whole") == 1, F.lit(0)).otherwise(F.floor(F.log("n") / F.lit(width))).cast("long")
    banded = materialize(skewed_left_join(sized, whole, ["component"], "held").select("component", "node", "n", band.alias("band")), "ngram-bands")
    key = ["component", "band"]
    own = banded.groupBy(*key).agg(parts.alias("parts"), held)
    near = own.select("component", F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"), F.struct(F.col("band").alias("other"), F.col("parts").alias("others")).alias("x"))
    met = near.groupBy(*key).agg(F.collect_list("x").alias("met"))  # three at most
    placed = skewed_left_join(banded, materialize(own.join(met, key), "ngram-parts"), key, "held").withColumn("part", F.expr("shiftleft(band, 32) + pmod(xxhash64(node), parts)"))
    pairs = F.expr("flatten(transform(met, x -> transform(sequence(0L, x.others - 1), q -> shiftleft(x.other, 32) + q)))")
    tasks = placed.withColumn("with", F.explode(pairs))
    return tasks.select(F.col("node").alias("cls"), F.col("component").alias("block"), "part", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"))


def _range_count(docs: DataFrame) -> int:
    """Hash ranges to count in: a task of them never holds more however large the input is."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= int(docs._jdf.sparkSession().sessionState().conf().defaultSizeInBytes()):  # of rows that lie in no file: unknown
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(partitions(docs.sparkSession), -(-size // RANGE_BYTES)), 1 << 24)


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, n_links, class_id.

    Documents link when their sets of k-word shingles have Jaccard >= num/den. Null or wordless text: an empty set,
    linked with nothing, its own component. class_id is the smallest doc_id with the same set, n_links the number of
    other documents linked with the row's. A null doc_id is never a component's smallest unless all are null; rows
    that repeat a doc_id are documents like any others; ids are taken as longs. Shingles are compared as hashes of 64 bits: of
    n distinct shingles some two share one with odds of n * n / 2^65, and a link could only turn by as many elements. No other column of docs is read, so names can't clash.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark, count = docs.sparkSession, _range_count(docs)
    dealt = docs.mapInArrow(_deal(k, count), _BIN)
    target = F.when(F.col("kind") == 0, F.xxhash64("target")).otherwise(F.col("target"))
    counted = dealt.withColumn("_at", target).repartition(count, "_at").drop("_at").mapInArrow(_count, _BIN)
    rows = materialize(counted.groupBy("chunk").applyInPandas(_order(num, den), DOCS), "ngram-docs")

    classes = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("cnt"))
    lead = rows.where("lead").select("sig", "n", "own", "tokens", "dfs")
    firsts = lead.groupBy("sig").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("tokens").alias("tokens"), F.first("dfs").alias("dfs"))
    reps = materialize(firsts.join(classes, "sig").where("cls is not null").select("cls", "cnt", "n", "own", "tokens", "dfs"), "ngram-reps")
    postings = materialize(reps.select("cls", "n", "own", "tokens").mapInArrow(_postings(num, den), "token long, cls long"), "ngram-postings")
    hubs = postings.groupBy("token").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1")
    stars = postings.join(hubs, "token").where("cls <> hub").selectExpr("cls as a", "hub as b").distinct()
    blocks = components(stars, "ngram-blocks")
    done = _tasks(blocks, reps, num, den).join(reps, "cls").groupBy("block", "lo", "hi").applyInPandas(_block(num, den), "cls long, root long, links long")
    done = materialize(done, "ngram-links")
    linked = done.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(done.where("cls <> root").selectExpr("cls as a", "root as b"), "ngram-components")
    found = classes.join(linked, "cls", "left").join(joined, classes.cls == joined.node, "left")
    found = found.select("sig", "cls", "cnt", F.coalesce("component", "cls").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    full = skewed_left_join(rows.where("n > 0").select("doc_id", "n", "sig"), materialize(found, "ngram-found"), ["sig"], "cnt")
    full = full.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("links") + F.col("cnt") - 1).alias("n_links"), F.col("cls").alias("class_id"))
    return full.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the documents that are not the smallest id of their component; all columns stay. Rows with a null id stay."""
    found = jaccard_classes(docs, k, num, den)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(dropped, docs.doc_id == dropped._drop, "left_anti")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS sh FROM w
), c AS (
  SELECT min(doc_id) AS cls, list_sort(sh) AS sh, len(sh) AS n FROM s GROUP BY list_sort(sh), len(sh)
), t AS (
  SELECT cls, n, unnest(sh) AS tok FROM c
), p AS (
  SELECT a.cls AS a, b.cls AS b FROM t a JOIN t b ON a.tok = b.tok AND a.cls < b.cls AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), bo AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM bo UNION SELECT r.a, bo.b FROM r JOIN bo ON r.b = bo.a) SELECT a, min(b) AS b FROM r GROUP BY a
), cnt AS (SELECT list_sort(sh) AS sh, count(*) AS k FROM s GROUP BY 1),
lnk AS (SELECT bo.a, sum(cnt.k)::BIGINT AS k FROM bo JOIN c ON c.cls = bo.b JOIN cnt ON cnt.sh = c.sh GROUP BY bo.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles,
  CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE least(c.cls, coalesce(reach.b, c.cls)) END AS component_id,
  CASE WHEN len(s.sh) = 0 THEN 0 ELSE coalesce(lnk.k, 0) + cnt.k - 1 END AS n_links,
  CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE c.cls END AS class_id
FROM s JOIN c ON c.sh = list_sort(s.sh) JOIN cnt ON cnt.sh = list_sort(s.sh) LEFT JOIN reach ON reach.a = c.cls LEFT JOIN lnk ON lnk.a = c.cls
"""
