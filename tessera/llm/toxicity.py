"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with marks at both ends), hashed to rows of an embedding table, so an
unseen misspelling shares vectors with the word that it distorts. A segment of SEGMENT words is the average of its
words; a softmax layer scores it; a text scores as its worst segment, so that a long text doesn't dilute a short insult.
Training alternates between choosing each text's worst segment under the present model and joint gradient steps on
embeddings and softmax (multiple-instance learning: a toxic text has at least one toxic segment, a clean one none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, mix, table

BUCKETS, DIM, SEGMENT, SIZES = 1 << 16, 8, 8, (3, 4, 5)
#: The sample that the classifier is fitted on: labelled rows of either kind, in the order of a hash of their ids, and characters in all.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 2000, 4000, 25_000_000
#: Passes over the sample, at least this many gradient steps, and the share of n-grams that a step leaves out, so that a word's parts each carry its sign.
EPOCHS, STEPS, DROP, BATCH, RATE = 16, 500, 0.4, 256, 0.5

_ink: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    """Whether a code point is a letter, digit or mark that belongs to a word."""
    if not _ink:
        found = np.zeros(0x110000, bool)
        for a in range(0, 0x110000, 4096):
            if not 0xD800 <= a < 0xE000:
                found[a : a + 4096] = [c.isalnum() for c in map(chr, range(a, a + 4096))]
        _ink.append(found)
    return _ink[0]


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased text between two marks, and the starts and ends of its words."""
    codes = np.frombuffer(f"\n{text}\n\n\n\n\n".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ink = _alnum()[codes]
    edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
    return np.where(ink, codes, 1), edge[::2], edge[1::2]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each place."""
    m = len(codes) - n + 1
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + codes[i : i + m].astype(np.uint64)
    return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _word_scores(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The mean weight of each word's n-grams: those from its leading to its trailing mark."""
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for n in SIZES:
        run = np.concatenate([[0.0], np.cumsum(weight[_grams(codes, n)])])
        held = ends - starts - n + 3
        some = held > 0
        total[some] += run[(ends - n + 2)[some]] - run[(starts - 1)[some]]
        count += np.maximum(held, 0)
    return total / np.maximum(count, 1)


def _segments(doc: np.ndarray) -> np.ndarray:
    """First words of the segments: each SEGMENT-th word of a text."""
    first = np.searchsorted(doc, doc)
    return np.flatnonzero((np.arange(len(doc)) - first) % SEGMENT == 0)


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    """The score of each text, as if it were alone."""
    out = np.empty(len(texts))
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= SLICE_BYTES // 2):
            size += len(texts[b] or "")
            b += 1
        lowered = [(t or "").lower() for t in texts[a:b]]
        off = np.cumsum([0, *(len(t) + 1 for t in lowered)]) + 1
        codes, starts, ends = _words("\n".join(lowered))
        doc = np.searchsorted(off, starts, "right") - 1
        logit = np.full(b - a, model["bias"])
        if len(starts):
            score = _word_scores(codes, starts, ends, model["weight"])
            seg = _segments(doc)
            held = np.diff(np.append(seg, len(doc)))
            mean = np.add.reduceat(score, seg) / held
            which = doc[seg]
            at = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            logit[which[at]] = np.maximum.reduceat(mean, at) + model["bias"]
        out[a:b] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        a = b
    return out


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> dict:
    """Fit the model: {weight: per bucket the softmax's margin, bias, emb, out}. Without both labels every score is 0 or 1."""
    if len(texts) == 0 or toxic.all() or not toxic.any():
        return {"weight": np.zeros(BUCKETS), "bias": 30.0 if len(texts) and toxic.all() else -30.0}
    rng = np.random.default_rng(seed)
    # distinct words with their n-grams; texts as word numbers
    known: dict[str, int] = {}
    words, count = [], []
    for text in texts:
        _, s, e = _words(text)
        low = f"\n{text}\n\n\n\n\n".lower()
        words.append(np.array([known.setdefault(low[a:b], len(known)) for a, b in zip(s.tolist(), e.tolist())], np.int32))
        count.append(len(s))
    words, doc = np.concatenate(words), np.repeat(np.arange(len(texts), dtype=np.int32), count)
    codes, s, e = _words("\n".join(known))
    place, bucket = [], []
    for n in SIZES:
        h = np.maximum(e - s - n + 3, 0)
        place.append(np.repeat(np.arange(len(s), dtype=np.int32), h))
        bucket.append(_grams(codes, n)[np.repeat(s - 1 - np.cumsum(h) + h, h) + np.arange(h.sum())].astype(np.int32))
    place, bucket = np.concatenate(place), np.concatenate(bucket)
    order = np.argsort(place, kind="stable").astype(np.int32)
    bucket, place = bucket[order], place[order]
    del order, codes
    held = np.bincount(place, minlength=len(known))
    start = np.cumsum(held) - held
    seg = _segments(doc)
    seg_end = np.append(seg[1:], len(doc))
    seg_doc = doc[seg]
    doc_at = np.flatnonzero(np.concatenate([[True], seg_doc[1:] != seg_doc[:-1]]))
    docs = seg_doc[doc_at]
    doc_len = np.diff(np.append(doc_at, len(seg)))

    emb, out, bias = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM, np.zeros((2, DIM)), np.zeros(2)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-8), np.full((2, DIM), 1e-8), np.full(2, 1e-8)
    out += rng.normal(0, 0.1, out.shape)

    def gather(chosen):
        """n-gram buckets of segments, their weights, and the segment of each."""
        n = seg_end[chosen] - seg[chosen]
        w = words[np.repeat(seg[chosen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        which = np.repeat(np.arange(len(chosen)), n)
        k = held[w]
        b = bucket[np.repeat(start[w], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        stay = rng.random(len(b)) >= DROP
        return b[stay], np.repeat(1 / np.maximum(k, 1) / n[which], k)[stay] / (1 - DROP), np.repeat(which, k)[stay]

    share = np.where(toxic, 0.3 / toxic.sum(), 0.7 / (~toxic).sum()) * len(toxic)
    for epoch in range(max(EPOCHS, -(-STEPS * BATCH // (2 * len(docs))))):
        margin = emb @ (out[1] - out[0])
        score = np.bincount(place, weights=margin[bucket], minlength=len(known)) / np.maximum(held, 1)
        mean = np.add.reduceat(score[words], seg) / (seg_end - seg)
        worst = np.array([a + int(np.argmax(mean[a : a + n])) for a, n in zip(doc_at, doc_len)])
        other = doc_at + (rng.random(len(docs)) * doc_len).astype(np.int64)
        bad = toxic[docs]
        if epoch == 0:  # no model yet: a segment drawn from every text
            chosen = np.concatenate([other, doc_at + (rng.random(len(docs)) * doc_len).astype(np.int64)])
        else:
            chosen = np.concatenate([worst, other[~bad]])
        rng.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            part = chosen[a : a + BATCH]
            b, weight, which = gather(part)
            vec = np.zeros((len(part), DIM))
            for d in range(DIM):
                vec[:, d] = np.bincount(which, weights=emb[b, d] * weight, minlength=len(part))
            z = vec @ out.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = toxic[seg_doc[part]].astype(np.int64)
            p[np.arange(len(part)), y] -= 1
            p *= share[seg_doc[part]][:, None] / len(part)
            to_vec, to_out, to_bias = p @ out, p.T @ vec, p.sum(0)
            touched, back = np.unique(b, return_inverse=True)
            step = np.empty((len(touched), DIM))
            for d in range(DIM):
                step[:, d] = np.bincount(back, weights=to_vec[which, d] * weight, minlength=len(touched))
            g_emb[touched] += (step**2).mean(1)
            emb[touched] -= RATE * step / np.sqrt(g_emb[touched])[:, None]
            g_out += to_out**2
            out -= RATE / 4 * to_out / np.sqrt(g_out)
            g_bias += to_bias**2
            bias -= RATE / 4 * to_bias / np.sqrt(g_bias)
    return {"weight": emb @ (out[1] - out[0]), "bias": float(bias[1] - bias[0])}


def held_out(col) -> F.Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> dict:
    """Train on at most toxic_rows + clean_rows labelled rows outside the held-out fold, and SAMPLE_CHARS characters of them."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y is not null").where(~held_out("_id"))
    order = F.xxhash64("_id", F.lit(1))
    picked = known.where("_y = 1").orderBy(order, "_id").limit(toxic_rows).unionByName(known.where("_y = 0").orderBy(order, "_id").limit(clean_rows))
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    w = F.sum(F.length("text")).over(_by_hash())
    rows = rows.withColumn("_sum", w).where(F.col("_sum") <= SAMPLE_CHARS).select("doc_id", "text", "_y").toArrow().sort_by([("doc_id", "ascending"), ("_y", "ascending"), ("text", "ascending")])
    return train(rows["text"].to_pylist(), rows["_y"].to_numpy() == 1)


def _by_hash():
    """Over the bounded sample alone."""
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64("_id", F.lit(1)), "_id", "text").rowsBetween(Window.unboundedPreceding, 0)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) with score (0 to 1); null text counts as empty, a text without words scores by the bias alone. A row depends on its text only, so ties and repeated rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast({"weight": model["weight"].astype(np.float32), "bias": model["bias"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {"weight": shared.value["weight"].astype(np.float64), "bias": shared.value["bias"]}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.record_batch([part.column(0), pa.array(score_texts(part.column(1).to_pylist(), own))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The doc_ids of docs that score at least threshold."""
    return score(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
