"""Benchmark decontamination by templates.

Words become lower-case words or typed placeholders (numbers, names, units; a name is a word with a capital of any
script). Windows of WINDOW template words of the documents are hash-joined with those of the benchmark, whose windows are
held with placeholders and with plain names, so that a copy in lower case is found too; a document and item that share
enough windows are then checked for slot consistency: each slot value of the item must stand for one value throughout the document, so that a question
with other numbers or names is caught and a chance meeting of placeholders is not.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, span_hashes, table, text_slices, uri, windows, word_bounds

WINDOW, COVERAGE = 5, 0.5
#: Characters of benchmark text that a task holds at once; a larger benchmark goes in as many blocks.
BLOCK_CHARS = 8_000_000

# Unit and number words that count as placeholders.
UNITS = "km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph usd eur gbp dollar dollars euro euros cent cents percent meter meters metre metres gram grams degree degrees".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
SIGNS = "%$€£"

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
#: Whether a code point of two or three bytes is a capital, and its small letter if that has as many bytes.
_BIG, _SMALL = np.zeros(0x10000, bool), np.arange(0x10000)
for _c in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
    if chr(_c).isupper() or chr(_c).istitle():
        _low = chr(_c).lower()
        _BIG[_c] = True
        if len(_low) == 1 and len(_low.encode()) == len(chr(_c).encode()):
            _SMALL[_c] = ord(_low)
NUM, NAME, UNIT = (np.uint64(x) for x in (0x11F3A5C97B2D4E61, 0x22E4B6D88C3F5A72, 0x33D5C7E99D4A6B83))


def _hash_words(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return np.sort(span_hashes(np.frombuffer(data, np.uint8), *word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[:2]))


_UNIT_HASHES, _NUMBER_HASHES = _hash_words(UNITS), _hash_words(NUMBERS)


def _within(x: np.ndarray, table_: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(len(x), bool)
    return table_[np.minimum(np.searchsorted(table_, x), len(table_) - 1)] == x


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data with its capitals beyond ASCII as small letters, and where capitals of any script stood."""
    big = np.zeros(len(data) + 1, bool)
    big[:-1] = (data >= 65) & (data <= 90)
    data = data.copy()
    for size, lead in ((2, (data >= 0xC3) & (data <= 0xDF)), (3, (data >= 0xE0) & (data <= 0xEF))):
        at = np.flatnonzero(lead)
        at = at[at + size <= len(data)]
        code = data[at].astype(np.int64) & (0x1F if size == 2 else 0x0F)
        for k in range(1, size):
            code = code << 6 | (data[at + k] & 0x3F)
        up = _BIG[code]
        at, low = at[up], _SMALL[code[up]]
        big[at] = True
        for k in range(size - 1, 0, -1):
            data[at + k] = 0x80 | (low & 0x3F)
            low = low >> 6
        data[at] = (0xC0 if size == 2 else 0xE0) | low
    return data, big


def canonical(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, value hash, text number) of each word that has more than punctuation."""
    data, big = _lowered(data)
    s, e, doc = word_bounds(data, off)
    if not len(s):
        z = np.zeros(0, np.uint64)
        return z, z, doc
    while (go := (s < e) & _PUNCT[data[np.minimum(s, len(data) - 1)]]).any():
        s = s + go
    while (go := (s < e) & _PUNCT[data[np.maximum(e - 1, 0)]]).any():
        e = e - go
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    keep = s < e
    s, e, doc = s[keep], e[keep], doc[keep]
    value = span_hashes(data, s, e)
    kind = value.copy()
    kind[big[s]] = NAME
    kind[_within(value, _UNIT_HASHES)] = UNIT
    kind[(digits[e] > digits[s]) | _within(value, _NUMBER_HASHES)] = NUM
    return kind, value, doc


class Templates:
    """The windows of a block of items: hash, item number and place, by hash."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        self.kind, self.value = [], []
        hashes, item, place = [], [], []
        self.short: dict[int, list[int]] = defaultdict(list)
        for number, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            kind, value, doc = canonical(data, np.array([0, len(data)]))
            self.kind.append(kind), self.value.append(value)
            plain = np.where(kind == NAME, value, kind)
            if 0 < len(kind) < WINDOW:
                for form in {whole(kind), whole(plain)}:
                    self.short[form].append(number)
            h, _, at = windows(kind, doc, WINDOW)
            g, _, _ = windows(plain, doc, WINDOW)
            hashes += [h, g[g != h]]
            place += [at, at[g != h]]
            item.append(np.full(len(h) + (g != h).sum(), number))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.size = [max(0, len(k) - WINDOW + 1) for k in self.kind]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, entry number) of every match."""
        w = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, h[w]), np.searchsorted(self.hash, h[w], "right")
        n = hi - lo
        return np.repeat(w, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def whole(kind: np.ndarray) -> int:
    h = np.uint64(len(kind))
    with np.errstate(over="ignore"):
        for k in kind:
            h = h * np.uint64(0xD6E8FEB86659FD93) + k
    return int(h)


def consistent(kind_i, value_i, kind_d, value_d, places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, bool]:
    """Which matches (item place, text place) agree with the main reading of the item's slots, and whether that changes a value.

    A match counts for as many as stand at its distance from the item, so that rows of slots aren't read with a shift. A
    window of slots alone, which any row of numbers or names meets, agrees only with its own values.
    """
    _, back, held = np.unique(at - places, return_inverse=True, return_counts=True)
    weight = held[back].tolist()
    votes: dict[tuple[int, int], Counter] = defaultdict(Counter)
    slots = [[(int(kind_i[p + k]), int(value_i[p + k]), int(value_d[a + k])) for k in range(WINDOW) if kind_i[p + k] in (NUM, NAME, UNIT)] for p, a in zip(places, at)]
    for found, w in zip(slots, weight):
        for kind, mine, other in found:
            votes[kind, mine][other] += w
    reading: dict[tuple[int, int], int] = {}
    taken: set[tuple[int, int]] = set()
    for (kind, mine), c in sorted(votes.items(), key=lambda x: (-max(x[1].values()), x[0])):
        for other, _ in sorted(c.items(), key=lambda x: (-x[1], x[0] != mine, x[0])):
            if (kind, other) not in taken:
                reading[kind, mine] = other
                taken.add((kind, other))
                break
    good = np.array([all(reading.get((k, m)) == o for k, m, o in found) and (len(found) < WINDOW or all(m == o for _, m, o in found)) for found in slots], bool)
    return good, any(m != o for (_, m), o in reading.items())


def stretches(at: np.ndarray, place: np.ndarray, span: int, need: int, size: int) -> Iterator[tuple[int, int]]:
    """(first, past the last) match of the stretches of span windows that hold at least need distinct windows of an item, most first.

    Starts next to one that was tried, by less than an eighth of the item, are left out: they hold the same copy.
    """
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.searchsorted(at, at[first] + span)
    seen, distinct, hi, lo, held = [0] * size, 0, 0, 0, np.zeros(len(first), np.int64)
    places = place.tolist()
    for k, (i, end) in enumerate(zip(first.tolist(), ends.tolist())):
        while lo < i:
            seen[places[lo]] -= 1
            distinct -= not seen[places[lo]]
            lo += 1
        while hi < end:
            distinct += not seen[places[hi]]
            seen[places[hi]] += 1
            hi += 1
        held[k] = distinct
    able = np.flatnonzero(held >= need)
    starts, near = at[first], max(1, size // 8)
    open_ = np.ones(len(first), bool)
    for k in able[np.argsort(-held[able], kind="stable")]:
        if open_[k]:
            yield int(first[k]), int(ends[k])
            open_[np.searchsorted(starts, starts[k] - near, "right") : np.searchsorted(starts, starts[k] + near)] = False


def leaks_in(kind, value, doc, t: Templates, rows: int) -> Iterator[tuple[int, int, float, int, bool]]:
    """(text number, item number, coverage, windows matched, whether slot values differ) of the texts that hold an item."""
    count = np.bincount(doc, minlength=rows)
    if t.short:
        first = np.searchsorted(doc, np.arange(rows))
        for d in np.flatnonzero((count > 0) & (count < WINDOW)):
            own = slice(first[d], first[d] + count[d])
            for item in t.short.get(whole(kind[own]), ()):
                yield int(d), item, 1.0, 1, bool((value[own] != t.value[item]).any())
    h, _, at = windows(kind, doc, WINDOW)
    w, entry = t.find(h)
    if not len(w):
        return
    at, item, place = at[w], t.item[entry], t.place[entry]
    key = doc[at] * len(t.ids) + item
    order = np.lexsort((at, key))
    key, at, item, place = key[order], at[order], item[order], place[order]
    cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
    for a, b in zip(cut[:-1], cut[1:]):
        number = int(item[a])
        need = int(np.ceil(COVERAGE * t.size[number]))
        if b - a < need or len(np.unique(place[a:b])) < need:
            continue
        for lo, hi in stretches(at[a:b], place[a:b], 2 * len(t.kind[number]) + 8, need, t.size[number]):
            good, changed = consistent(t.kind[number], t.value[number], kind, value, place[a + lo : a + hi], at[a + lo : a + hi])
            held = len(np.unique(place[a + lo : a + hi][good]))
            if held >= need:
                yield int(doc[at[a]]), number, held / t.size[number], held, changed
                break


SCHEMA = "doc_id long, item_id long, coverage double, n_windows long, reparametrised boolean"


_loaded: dict[str, Templates] = {}


def _block(path: str) -> Templates:
    """The templates of a written block, the last two kept by a worker process for its tasks."""
    if path not in _loaded:
        while len(_loaded) > 1:
            _loaded.pop(next(iter(_loaded)))
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as f, pa.ipc.open_file(f) as items:
            own = items.read_all()
        _loaded[path] = Templates(list(zip(own["item_id"].to_pylist(), own["text"].to_pylist())))
    return _loaded[path]


def _scan(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _block(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, off in text_slices(batch.column(1)):
                kind, value, doc = canonical(data, off)
                found = [(ids[a + d], t.ids[i], c, n, r) for d, i, c, n, r in leaks_in(kind, value, doc, t, b - a)]
                if found:
                    cols = list(zip(*found))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()))], names=["doc_id", "item_id", "coverage", "n_windows", "reparametrised"])

    return run


def _blocks(benchmark: DataFrame) -> list[str]:
    """The items written in blocks of about BLOCK_CHARS characters; the driver holds their paths alone, however large the benchmark is."""
    rows, limit = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), BLOCK_CHARS
    folder = uri(new_path(rows.sparkSession, "benchmark"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, size, names = [], 0, []

        def flush():
            # a name that a second attempt of the task doesn't share: only blocks that are listed are read
            name = f"{uuid.uuid4().hex}.arrow"
            with fs.open_output_stream(f"{root}/{name}") as f, pa.ipc.new_file(f, held[0].schema) as out:
                for part in held:
                    out.write_batch(part)
            names.append(f"{folder}/{name}")

        for batch in batches:
            for a in range(batch.num_rows):
                one = batch.slice(a, 1)
                n = len(one.column(1)[0].as_py() or "")
                if held and size + n > limit:
                    flush()
                    held, size = [], 0
                held.append(one)
                size += n
        if held:
            flush()
        yield pa.record_batch([pa.array(names, pa.string())], names=["path"])

    if not total:
        return []
    parts = rows.where("text <> ''").repartition(-(-total // limit)).mapInArrow(write, "path string")
    return [r.path for r in parts.toLocalIterator()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item of which the document holds at least COVERAGE of the template windows, with slots read alike, within a stretch of about twice the item's length.

    Items of fewer than WINDOW words match a document only if they are all of it. Null and empty texts hold nothing
    and are held by nothing; repeated rows of docs yield repeated rows; a null id stays null. Only doc_id and text,
    item_id and text are read, so other columns can't clash; ids are taken as longs. Documents are scanned where they
    lie, once for each block of the benchmark: no shuffle.
    """
    out = None
    for path in _blocks(benchmark):
        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(path), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item; rows with a null id stay."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs.doc_id == found._leak, "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
