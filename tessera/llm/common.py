"""What the operators share: the shared folder, tables written between steps, and word hashing over Arrow buffers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by the array code, so that its temporaries stay near 50 MB.
SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
#: Keys that a join takes out of the shuffle, at most.
HOT_KEYS = 2000
#: Fixed odd base and seed of the word hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, unless the session has chosen its own size: long texts then fill megabytes, not hundreds of them, on both sides of a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints"
    return f"{where.rstrip('/')}/tessera"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def uri(path: str) -> str:
    """path for pyarrow's file systems."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before
            pass


atexit.register(_clean)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def skewed_left_join(big: DataFrame, small: DataFrame, key: list[str], held: str) -> DataFrame:
    """Left join on key, where big may have a third of its rows under one key; small has a row a key at most, and in held (not null) how many rows of big its key has.

    The keys of at least 1 / HOT_KEYS of all rows are HOT_KEYS at most, whatever the size: they are broadcast and their
    rows joined where they lie. These rows, and those with a null in the key, then go through the shuffled join
    of the others under a spread key of no match, so big is read once and no key gathers them. small is read twice: pass a written table.
    """
    total = small.agg(F.sum(held)).first()[0] or 0
    limit = max(1000, -(-total // HOT_KEYS))
    own = [c for c in small.columns if c not in key]
    hot = F.broadcast(small.where(F.col(held) >= limit).select(*key, F.struct(*own).alias("_hot")))
    spread = F.xxhash64(*[F.col(c) for c in big.columns if c not in key] or [F.lit(0)])
    alone = F.col("_hot").isNotNull()
    for c in key:
        alone = alone | F.col(c).isNull()
    left = big.join(hot, key, "left").withColumn("_spread", F.when(alone, F.pmod(spread, F.lit(1 << 20)) + 1).otherwise(0))
    rest = small.where(F.col(held) < limit).select(*key, F.struct(*own).alias("_cold"), F.lit(0).cast("long").alias("_spread"))
    out = left.withColumn("_spread", F.col("_spread").cast("long")).join(rest, [*key, "_spread"], "left")
    return out.select(*big.columns, *[F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in own])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"][:n], _powers["down"][:n]


def text_slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of slices of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + budget, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words between the six ASCII white-space bytes."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_WS[data]
    left = np.empty(len(data), bool)
    left[0], left[1:] = True, ~ink[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    left[edges] = True
    starts = np.flatnonzero(ink & left)
    right = np.empty(len(data), bool)
    right[-1], right[:-1] = True, ~ink[1:]
    right[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(ink & right) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes; A-Z count as a-z if lower."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, text numbers and first word numbers of all windows of k words within a text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), doc[at], at


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, row numbers, shingle hashes): distinct shingles by row and hash. A text of fewer than k words has its whole word sequence as its one shingle; a text without words has none."""
    for a, b, data, off in text_slices(texts):
        s, e, doc = word_bounds(data, off)
        w = span_hashes(data, s, e)
        h, d, _ = windows(w, doc, k)
        count = np.bincount(doc, minlength=b - a)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = np.searchsorted(doc, short)
            extra = np.zeros(len(short), np.uint64)
            for i in range(k - 1):
                use = count[short] > i
                extra[use] = extra[use] * np.uint64(0xD6E8FEB86659FD93) + w[first[use] + i]
            h, d = np.concatenate([h, mix(extra ^ count[short].astype(np.uint64))]), np.concatenate([d, short])
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        yield a, b, d[new] + a, h[new]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in edges (a, b: long, not null): the smallest node that it reaches.

    Each round every node takes the smallest label among itself and its neighbours, then the label of that label;
    labels are written to the shared folder after each round. A hub needs no row per pair: minima are pre-aggregated.
    """
    both = edges.select("a", "b").where("a <> b").union(edges.selectExpr("b as a", "a as b").where("b <> a"))
    both = materialize(both.distinct(), f"{name}-edges")
    lab = materialize(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as component"), name)
    while True:
        near = both.join(lab, both.b == lab.node).groupBy("a").agg(F.min("component").alias("m"))
        took = lab.join(near, lab.node == near.a).selectExpr("node", "component as old", "least(component, m) as step")
        jump = lab.selectExpr("node as hop", "component as far")
        new = materialize(took.join(jump, took.step == jump.hop, "left").selectExpr("node", "old", "least(step, coalesce(far, step)) as component"), name)
        changed = new.where("component <> old").limit(1).count()
        lab = new.select("node", "component")
        if not changed:
            return lab
