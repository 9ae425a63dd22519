"""Queries against the documents of their user, block by block: every pair is scored by arrays in one task's memory, and only each query's best of a block leaves it."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable
from inspect import isgeneratorfunction
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cut import materialize

#: Queries of a block, the weight of its documents (about their characters), and how many characters of a-z and 0-9 one number holds.
QUERIES, WEIGHT, WIDE = 512, 6_000_000, 12
#: Queries times weight that are worth a block of their own.
WORK = 10_000_000.0
#: A block of top holds so many times QUERIES, so that fewer copies of documents are shuffled.
TOGETHER = 4
#: A user's queries with more blocks of documents than this first meet one in SAMPLE documents, for a bound of what can be among their best.
SPLIT, SAMPLE = 16, 8
KEY = ["_group", "_q", "_d"]
RUN = re.compile("[a-z0-9]+")
DIGIT = np.zeros(256, np.uint64)
DIGIT[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = np.arange(1, 37)

Columns = dict[str, list]


class Spread(NamedTuple):
    """Users that ask and hold documents, with their _nq blocks of queries by _nd of documents; how many blocks the small users share; whether most of what is held belongs to users that ask; how many blocks there are at most; and the most blocks of documents of one user."""

    users: DataFrame
    shared: int
    most: bool
    count: int
    split: int


def spread(asked: DataFrame, held: DataFrame, weight, single: bool = False, together: int = 1) -> Spread:
    """How many blocks users take: those of documents are bounded by weight, of queries by number, together times QUERIES. Sums are made before they are shuffled. With single, documents that fit one block stay in one."""
    held = held.toDF(*held.columns)  # columns of its own, also where both sides come from one table
    count = asked.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    heavy = held.groupBy("user_id").agg(F.sum(weight).alias("_w"))
    users = count.join(heavy, "user_id", "right").select("user_id", F.ceil(F.col("_n") / (QUERIES * together)).cast("int").alias("_nq"), F.greatest(F.ceil(F.col("_w") / WEIGHT), F.lit(1)).cast("int").alias("_nd"), "_n", "_w")
    users = materialize(users, "users")
    asks, small = F.col("_n").isNotNull(), (F.col("_nq") == 1) & (F.col("_nd") == 1)
    of = lambda c, which: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))
    # how many blocks the small users share, from sums over them
    work = F.col("_n").cast("double") * F.col("_w")
    b = F.col("_nq").cast("long") * F.col("_nd")
    n, w, own, all_, large, few, much = users.select("*", work.alias("_work"), b.alias("_b")).agg(of("_n", small), of("_w", small), of("_w", asks), of("_w", F.lit(True)), of("_b", asks & ~small), of("_work", asks & small), of("_work", asks)).first()
    shared = max(1, -(-n // QUERIES // 8), -(-int(w) // WEIGHT))
    least = 2 * asked.sparkSession.sparkContext.defaultParallelism
    if large + shared < least and much > WORK:  # fewer blocks than cores: they are made smaller, so that all have work
        each = max(much / least, WORK)
        parts = F.when(asks, F.ceil(work / each)).otherwise(1)
        nd = F.col("_nd") if single else F.greatest("_nd", F.least(F.lit(8), parts))
        users = users.withColumn("_nd", nd.cast("int")).withColumn("_nq", F.greatest("_nq", F.least(F.ceil(parts / F.col("_nd")), "_n")).cast("int"))
        shared, large = max(shared, min(least, int(few // each))), large + least
    users = users.where(asks).select("user_id", "_nq", "_nd")
    return Spread(users, shared, own * 2 >= all_, large + shared, users.agg(F.max("_nd")).first()[0] or 1)


def dealt(asked: DataFrame, held: DataFrame, over: Spread, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """asked and held (both with user_id) with the block they belong to: a large user's rows are dealt over blocks of queries by blocks of documents, small users share blocks. With single, without the users of several blocks of documents.

    Only large users are looked up, who are at most as many as full blocks; a small one's block follows from its id. What is held by users that don't ask goes along where it is the lesser part, and is left out before otherwise.
    """
    held = held.toDF(*held.columns)
    large = F.broadcast(over.users.where("_nq > 1 or _nd > 1").withColumn("_large", F.lit(True)))
    group = F.when(F.col("_large"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("user_id"), F.lit(over.shared)).cast("string")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    def place(rows: DataFrame) -> DataFrame:
        rows = rows.join(large.toDF(*large.columns), "user_id", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_nq", "_nd")})
        return (rows.where("_nd = 1") if single else rows).withColumn("_group", group)

    held = held if over.most else held.join(over.users.select("user_id"), "user_id", "left_semi")
    a = place(asked).withColumn("_q", own("query_id", "_nq")).withColumn("_d", every("_nd"))
    b = place(held).withColumn("_d", own("doc_id", "_nd")).withColumn("_q", every("_nq"))
    return a.drop("_nq", "_nd", "_large"), b.drop("_nq", "_nd", "_large")


def placed(rows: DataFrame, over: Spread):
    """rows grouped by block, over so many partitions that blocks with little to read aren't put into one task."""
    return rows.repartition(min(2 * (over.count + 8), 4000), *KEY).groupBy(*KEY)


def _by_user(rows: pd.DataFrame) -> dict:
    return rows.groupby("user_id", sort=False).indices


def part(columns: Columns, at: np.ndarray) -> Columns:
    return {c: [v[i] for i in at] for c, v in columns.items()}


def best(scores: np.ndarray, n: int | None) -> np.ndarray:
    """Places of the n largest scores (all without n) in a block whose documents are in order of id, which breaks ties."""
    at = np.flatnonzero(~np.isnan(scores))
    if n is None:
        return at
    if len(at) > max(n, 200):  # few are sorted at once
        least = np.partition(scores[at], len(at) - n)[len(at) - n]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")][:n]


def top(asked: DataFrame, held: DataFrame, weight, n: int | None, score: Callable[[Columns, Columns], Iterable[np.ndarray]], digits: int | None = None, then: str | None = None, counted: bool = False, steady: bool = True, level: int = 0) -> DataFrame:
    """(query_id, doc_id, score, rank) of the n best of each query among the documents of its user, or of all pairs without n, whose rank is that in a block; score gives a block's scores, a row for each query, NaN where there is no hit: as an array for QUERIES of them at a time, or, if it yields them row by row, for all. With digits, scores are compared rounded; then: a column of held, whole numbers, that breaks ties before the id and is returned too. With counted also size, the number of a query's hits in a block, given in one of its rows, 0 in the others. steady: a pair has the same score to the last bit in any block.

    Queries of a user of many blocks meet a part of the documents first. The last of their n best there bounds what is among the n best of all: of each block only that leaves its task, so that what is shuffled doesn't grow with queries times blocks. All documents are scored then.
    """
    types = [f"{c} {rows.schema[c].dataType.simpleString()}" for rows, c in ((asked, "query_id"), (held, "doc_id"))]
    over = spread(asked, held, weight, together=TOGETHER)
    bounds = ["_least", "_last", *(["_then"] if then else [])]
    bounded = n is not None and over.split > SPLIT
    if bounded:
        large = F.broadcast(over.users.where(F.col("_nd") > SPLIT).select("user_id"))
        some = held.where(F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(SAMPLE)) == 0)
        first = top(*(rows.join(large.toDF("user_id"), "user_id", "left_semi") for rows in (asked, some)), weight, n, score, digits, then, False, steady, level + 1)
        last = materialize(first.where(F.col("rank") == n).select("query_id", F.col("score").alias("_least"), F.col("doc_id").alias("_last"), *([F.col(then).alias("_then")] if then else [])), "bounds")
        asked = asked.join(last, "query_id", "left")
    compared = (lambda x: x) if digits is None else (lambda x: np.round(x, digits))

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(d):
            d = d.sort_values([then, "doc_id"] if then else "doc_id", kind="stable", ignore_index=True)  # text by code points, as Spark's bytes
            mine, theirs = _by_user(q), _by_user(d)
            qs, ds = ({c: rows[c].tolist() for c in rows.columns if c not in (*KEY, "user_id")} for rows in (q, d))
            numbers = d["doc_id"].to_numpy(), (d[then].to_numpy() if then else None)
            for user, every in mine.items():
                if (di := theirs.get(user)) is None:
                    continue
                b, ids, firsts = part(ds, di), numbers[0][di], numbers[1][di] if then else None
                step = len(every) if isgeneratorfunction(score) else QUERIES
                for start in range(0, len(every), step):
                    a = part(qs, every[start : start + step])
                    limits = list(zip(*(a.pop(c) for c in bounds))) if bounded else None
                    for i, values in enumerate(score(a, b)):
                        order = compared(values)
                        whole = order
                        if limits and limits[i][0] == limits[i][0] and limits[i][0] is not None:
                            least, last, *more = limits[i]
                            if steady:  # those before the bound in the order of results, and itself
                                least = compared(least)
                                upto = bisect_right(ids, last) if not more else bisect_right(list(zip(firsts, ids)), (more[0], last))
                                order = np.where((order > least) | ((order == least) & (np.arange(len(order)) < upto)), order, np.nan)
                            else:
                                order = np.where(order >= least - 2.0 * 10.0 ** -(digits or 9), order, np.nan)
                        at = best(order, n)
                        size = np.zeros(len(at), np.int64)
                        if counted:
                            if not len(at):  # a row that holds the number of hits
                                at = best(whole, 1)
                                size = np.zeros(len(at), np.int64)
                            size[:1] = np.count_nonzero(~np.isnan(whole))
                        if len(at):
                            out.append((a["query_id"][i], ids[at], values[at], np.arange(1, len(at) + 1, dtype=np.int32), size, *([firsts[at]] if then else [])))
        names = ["doc_id", "score", "rank", "size", *([then] if then else [])]
        if not out:
            return pd.DataFrame({c: pd.Series(dtype={"score": "float64", "rank": "int32", "size": "int64"}.get(c, object)) for c in ("query_id", *names)})
        query = np.repeat(np.array([x[0] for x in out], object), [len(x[1]) for x in out])
        return pd.DataFrame({"query_id": query} | {c: np.concatenate([x[i + 1] for x in out]) for i, c in enumerate(names)})

    a, b = (placed(rows, over) for rows in dealt(asked, held, over))
    rows = a.cogroup(b).applyInPandas(run, f"{types[0]}, {types[1]}, score double, rank int, size long" + (f", {then} long" if then else ""))
    rows = rows if counted else rows.drop("size")
    if n is None or counted or over.split == 1:  # a block has all documents of its queries
        return rows
    by = F.col("score") if digits is None else F.round("score", digits)
    w = Window.partitionBy("query_id").orderBy(F.desc(by), *([then] if then else []), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


class Hits(NamedTuple):
    """The texts that contain each of some values as a substring: places[starts[i] : starts[i + 1]] of value i, in order; and how many texts there are."""

    starts: np.ndarray
    places: np.ndarray
    size: int

    def counted(self, own: list[int]) -> np.ndarray:
        """How many of these values (by number) each text contains."""
        if not own:
            return np.zeros(self.size, np.int64)
        return np.bincount(np.concatenate([self.places[self.starts[i] : self.starts[i + 1]] for i in own]), minlength=self.size)


def _sorted(cells: np.ndarray) -> np.ndarray:
    """Distinct numbers in order."""
    cells = np.sort(cells)
    return cells[np.concatenate([[True], cells[1:] != cells[:-1]])] if len(cells) else cells


def _codes(texts: list[str]) -> np.ndarray:
    """The characters of runs, joined with a break after each, as digits to base 37; 0 is a break."""
    return DIGIT[np.frombuffer("".join(f"{t}\n" for t in texts).encode(), np.uint8)]


def within(runs: list[str], values: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places of runs, numbers of values) of the values that are in a run; both of a-z and 0-9 alone. Every stretch of a run is a number of at most WIDE digits, looked up among those of the values; only longer values are compared as text beyond that."""
    digits = _codes(runs)
    starts = np.cumsum([0, *(len(r) + 1 for r in runs)])[:-1]
    by: dict[int, list[str]] = {}
    for v in values:
        by.setdefault(len(v), []).append(v)
    code, at, of = np.zeros(len(digits), np.uint64), [], []
    for size in range(1, min(WIDE, max(by, default=0)) + 1):
        code = code[: len(digits) - size + 1] * np.uint64(37) + digits[size - 1 :]
        own = by.get(size, []) if size < WIDE else [v for n, vs in by.items() if n >= WIDE for v in vs]
        if not own or not len(code):
            continue
        heads: dict[str, list[str]] = {}
        for v in own:
            heads.setdefault(v[:size], []).append(v)
        head = list(heads)
        key = _codes(head).reshape(-1, size + 1)[:, :size] @ np.uint64(37) ** np.arange(size - 1, -1, -1, dtype=np.uint64)
        order = np.argsort(key)
        place = np.minimum(np.searchsorted(key[order], code), len(key) - 1)
        found = np.flatnonzero(key[order][place] == code)
        which, run = order[place[found]], np.searchsorted(starts, found, "right") - 1
        if size < WIDE:
            at.append(run)
            of.append(np.array([values[v] for v in head], np.int64)[which])
            continue
        longer = [(r, values[v]) for r, i, w in zip(run.tolist(), found.tolist(), which.tolist()) for v in heads[head[w]] if runs[r].startswith(v, i - int(starts[r]))]
        at.append(np.array([r for r, _ in longer], np.int64))
        of.append(np.array([v for _, v in longer], np.int64))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + at), np.concatenate(none + of)


def hits(texts: list[str], values: list[str]) -> Hits:
    """Values of a-z and 0-9 alone are looked for in the texts' runs of these, each distinct run once; others in the texts that have their longest such run."""
    sought = {v: i for i, v in enumerate(values) if RUN.fullmatch(v)}
    other = [(i, v, max(RUN.findall(v), key=len, default=None)) for i, v in enumerate(values) if v not in sought]
    for _, _, key in other:
        if key is not None:
            sought.setdefault(key, len(values) + len(sought))
    runs: dict[str, int] = {}
    own: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for column, low in enumerate(texts if sought else []):
        found = set(RUN.findall(low))
        counts[column] = len(found)
        own += [runs.setdefault(r, len(runs)) for r in found]
    n, base = max(1, len(texts)), len(values) + len(sought)
    pairs = _sorted(np.array(within(list(runs), sought), np.int64).T @ np.array([base, 1], np.int64))
    ends = np.searchsorted(pairs, np.arange(len(runs) + 1) * base)  # each run's values
    run = np.array(own, np.int64)
    each = np.diff(ends)[run]
    at = np.repeat(ends[run] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    cells = _sorted(pairs[at] % base * n + np.repeat(np.repeat(np.arange(len(texts)), counts), each))
    more = []
    for i, v, key in other:
        a, b = np.searchsorted(cells, (sought[key] * n, (sought[key] + 1) * n)) if key is not None else (0, 0)
        more += [i * n + j for j in ((cells[a:b] % n).tolist() if key is not None else range(len(texts))) if v in texts[j]]
    cells = cells[: np.searchsorted(cells, len(values) * n)]
    if more:
        cells = np.sort(np.concatenate([cells, np.array(more, np.int64)]))
    return Hits(np.searchsorted(cells, np.arange(len(values) + 1) * n), cells % n, len(texts))


def contained(texts: list[str], values: list[str]) -> np.ndarray:
    """Which values (rows) are substrings of which texts (columns), as 0 and 1."""
    found = hits(texts, values)
    out = np.zeros((len(values), len(texts)), np.uint8)
    out[np.repeat(np.arange(len(values)), np.diff(found.starts)), found.places] = 1
    return out


def numbered(lists: list[list]) -> tuple[dict, list[list[int]]]:
    """The distinct values of lists, numbered, and the lists as numbers."""
    known: dict = {}
    return known, [[known.setdefault(v, len(known)) for v in own] for own in lists]
