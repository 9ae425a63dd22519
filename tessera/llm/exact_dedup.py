"""Exact deduplication over a cuckoo-filter index of live digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, partitions, skewed_left_join, table

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Normalised text that a task's index holds before it is flushed; a flush costs a further partial group, no result.
CONTENT_BYTES = 48 << 20
SLOTS, KICKS = 4, 200


class CuckooIndex:
    """Live digests behind a cuckoo filter of 16-bit fingerprints.

    A miss in the filter proves that a digest is new. A hit is checked against the digest's bucket of stored keys and
    their content, so a false positive costs a comparison and never a wrong answer. When an insertion finds no place
    after KICKS evictions, the table doubles and is filled anew from the stored keys. A digest counts its members:
    delete() takes one away, and the last one's deletion frees its fingerprint.
    """

    def __init__(self, capacity: int = 1024):
        self.keys: dict[int, dict[bytes, list]] = {}
        self.live = self.hits = self.false_hits = self.resizes = 0
        self._table(capacity)

    def _table(self, capacity: int) -> None:
        self.size = 1 << max(4, (max(1, capacity * 5 // (4 * SLOTS)) - 1).bit_length())
        self.slots = [[] for _ in range(self.size)]

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _homes(self, digest: bytes) -> tuple[int, int, int]:
        p = self._print(digest)
        a = int.from_bytes(digest[2:10], "little") & (self.size - 1)
        return p, a, self._other(a, p)

    def _other(self, at: int, p: int) -> int:
        return (at ^ (p * 0x5BD1E995)) & (self.size - 1)

    def _place(self, digest: bytes) -> bool:
        p, a, b = self._homes(digest)
        for at in (a, b):
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(p)
                return True
        at, trail = b, []
        for kick in range(KICKS):
            k = (kick + p) % SLOTS
            trail.append((at, k))
            p, self.slots[at][k] = self.slots[at][k], p
            at = self._other(at, p)
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(p)
                return True
        for at, k in reversed(trail):  # as it was before
            p, self.slots[at][k] = self.slots[at][k], p
        return False

    def _resize(self) -> None:
        """Double the table and fill it from the stored keys; again while it overflows."""
        while True:
            self.resizes += 1
            self._table(self.size * SLOTS * 8 // 5)
            if all(self._place(d) for bucket in self.keys.values() for d in bucket):
                return

    def maybe(self, digest: bytes) -> bool:
        p, a, b = self._homes(digest)
        return p in self.slots[a] or p in self.slots[b]

    def _bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:13], "little")

    def get(self, digest: bytes, content: bytes) -> list | None:
        """The entry [content, value, members] of an equal live key."""
        if not self.maybe(digest):
            return None
        entry = self.keys.get(self._bucket(digest), {}).get(digest)
        if entry is None:
            self.false_hits += 1
            return None
        if entry[0] != content:
            raise ValueError("two contents have one digest")
        self.hits += 1
        return entry

    def insert(self, digest: bytes, content: bytes, value, members: int = 1) -> tuple[list, bool]:
        """The entry under the key and whether it is new; members are added to a live one."""
        entry = self.get(digest, content)
        if entry is not None:
            entry[2] += members
            return entry, False
        entry = [content, value, members]
        self.keys.setdefault(self._bucket(digest), {})[digest] = entry
        self.live += 1
        if not self._place(digest):
            self._resize()
        return entry, True

    def delete(self, digest: bytes, content: bytes) -> bool:
        """Take one member away; False if no such key is live."""
        entry = self.get(digest, content)
        if entry is None:
            return False
        entry[2] -= 1
        if entry[2] == 0:
            bucket = self.keys[self._bucket(digest)]
            del bucket[digest]
            if not bucket:
                del self.keys[self._bucket(digest)]
            self.live -= 1
            p, a, b = self._homes(digest)
            self.slots[a if p in self.slots[a] else b].remove(p)
        return True

    def entries(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.keys.values():
            yield from bucket.items()


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE)


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, doc_id), more code points, then the smaller id; null ids last."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return a if rank(a) <= rank(b) else b


LOCAL = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("key2", pa.binary()), ("n_chars", pa.int64()), ("part", pa.int64()), ("lead", pa.bool_()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("members", pa.int64())])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its digest; per distinct digest of a stretch of rows a leading row with the stretch's partial group. Hits compare the normalised bytes."""
    from pyspark import TaskContext

    part = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
    index, rows, held = CuckooIndex(), [], 0

    def flush():
        nonlocal index, rows, held, part
        out = []
        for doc_id, digest, key2, n, entry, lead in rows:
            best = entry[1] if lead else (None, None)
            out.append((doc_id, digest, key2, n, part, lead, best[0], best[1], entry[2] if lead else None))
        cols = list(zip(*out)) or [[] for _ in LOCAL]
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, LOCAL)], schema=LOCAL)
        index, rows, held, part = CuckooIndex(), [], 0, part + 1
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            content = normalise(text)
            digest = hashlib.sha256(content).digest()
            mine = (len(text), doc_id)
            entry, new = index.insert(digest, content, mine)
            if new:
                held += len(content)
            else:
                entry[1] = _better(entry[1], mine)
            rows.append((doc_id, digest, xxhash.xxh3_128_digest(content) + len(content).to_bytes(8, "little"), len(text), entry, new))
            if held > CONTENT_BYTES or len(rows) >= 50_000:
                yield flush()
    if rows:
        yield flush()


MERGED = "digest binary, keep_id long, group_size long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the partial groups of the digests dealt to this task. Hits compare a second 128-bit hash and the length; the texts themselves are compared by verify()."""
    index = CuckooIndex()
    for batch in batches:
        for digest, key2, chars, doc_id, members in zip(*(c.to_pylist() for c in batch.columns)):
            entry, new = index.insert(digest, key2, (chars, doc_id), members)
            if not new:
                entry[1] = _better(entry[1], (chars, doc_id))
    out = [(d, e[1][1], e[2]) for d, e in index.entries()]
    for a in range(0, len(out), 10_000):
        d, k, n = zip(*out[a : a + 10_000])
        yield pa.record_batch([pa.array(d, pa.binary()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["digest", "keep_id", "group_size"])


def _content(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]", "")


def verify(docs: DataFrame, leads: DataFrame) -> None:
    """Compare the contents of the digests that several stretches of input hold, byte by byte: only their texts are shuffled, once a task.

    Within a stretch the index has compared them. Raises ValueError if a digest stands for two contents.
    """
    met = leads.groupBy("digest").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("digest")
    texts = docs.select(_content(F.col("text")).alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256))).join(met, "digest", "left_semi")
    if texts.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("held")).groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").limit(1).count():
        raise ValueError("two contents have one digest")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts form one group. A null doc_id loses every tie and, if its row stays,
    keep_id is null. Rows that repeat a doc_id are members like any others; of rows that tie in length and id, all
    carry kept = true if their id is keep_id. Ids are taken as longs. Other columns of docs are not read, so their
    names can't clash. Groups meet by digest, a row per distinct digest and stretch of input, so a hot text is one row a
    task; the texts of digests that several stretches hold are then compared.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    local = materialize(own.mapInArrow(_local, "doc_id long, digest binary, key2 binary, n_chars long, part long, lead boolean, best_chars long, best_id long, members long"), "exact-local")
    leads = local.where("lead").select("digest", "key2", "best_chars", "best_id", "members")
    verify(own, leads)
    groups = materialize(leads.repartition(partitions(spark), "digest").mapInArrow(_merge, MERGED), "exact-groups")
    out = skewed_left_join(local.select("doc_id", "digest"), groups, ["digest"], "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of equal texts, with all its columns: the row that exact_groups keeps.

    Rows are told apart by id and text: of rows that share both the id and the normalised text of the kept one, the
    longest text stays, then the smallest.
    """
    groups = materialize(exact_groups(docs).where("kept").groupBy("keep_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows")), "exact-kept")
    keep = groups.select(F.col("keep_id").alias("_kept_id"), F.unhex("text_sha256").alias("_kept_sha"))
    rows = docs.withColumn("_own_sha", F.unhex(F.sha2(_content(F.col("text")), 256)))
    kept = rows.join(keep, rows.doc_id.cast("long").eqNullSafe(keep["_kept_id"]) & (rows["_own_sha"] == keep["_kept_sha"]), "left_semi")
    if groups.where("rows > 1").limit(1).count():
        order = Window.partitionBy(F.col("doc_id"), F.col("_own_sha")).orderBy(F.desc(F.length("text")), "text")
        kept = kept.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return kept.drop("_own_sha")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
