"""SentencePiece encoding and decoding by suffix-array matching.

The distinct pieces of text between which no merge can run (chunks) are concatenated and indexed by a suffix array cut at
the longest piece. Every piece's range of occurrences is found by binary search; the occurrences are the edges of a
lattice, sorted by position. Relaxation then depends on the model: a unigram model takes the best path from left to
right; a BPE model applies the edges in the order of their scores, each where both its halves are whole symbols.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters indexed at once, and chunks whose pieces a task remembers before it starts afresh.
INDEX_CHARS, REMEMBERED = 250_000, 200_000
#: Chunks of more characters are merged one by one over a heap instead of side by side.
SIDE_BY_SIDE = 48
SPACE = "▁"
LOW = -(2**31)


class Model:
    """The pieces of a SentencePiece model: 'unigram' or 'bpe', identity normalisation."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        kinds = proto.trainer_spec.model_type
        if kinds not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe, self.prefix = kinds == 2, spec.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.score = np.array([p.score for p in proto.pieces], np.float64)
        types = [p.type for p in proto.pieces]
        if 4 in types:
            raise ValueError("user-defined pieces are not supported")
        self.unk = types.index(2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.text, types)) if k == 6}
        self.normal = [i for i, k in enumerate(types) if k == 1]
        self.id = {self.text[i]: i for i in self.normal}
        self.longest = max((len(self.text[i]) for i in self.normal), default=1)
        # equal scores have equal priority, so that the leftmost goes first
        self.priority = np.unique(self.score, return_inverse=True)[1].astype(np.int32)
        letters = sorted({c for i in self.normal for c in self.text[i]})
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        size = np.array([len(self.text[i]) for i in self.normal])
        grid = np.zeros((len(self.normal), self.longest), np.int64)
        for row, i in enumerate(self.normal):
            grid[row, : size[row]] = [self.code[ord(c)] for c in self.text[i]]
        self.size, self.grid, self.number = size, grid, np.array(self.normal, np.int64)
        inner = {c for i in self.normal if len(self.text[i]) > 1 for c in self.text[i]}
        inside = any(SPACE in self.text[i].lstrip(SPACE) for i in self.normal)
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        cut = f"[{re.escape(alone)}]|" if alone else ""
        self.apart = not inside
        self.chunks = re.compile(r"(?s).+" if inside else f"{cut}{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+")
        special = {i for i, k in enumerate(types) if k == 3}
        self.out = [b"" if i in special else b" \xe2\x81\x87 " if i == self.unk else bytes([int(p[3:5], 16)]) if types[i] == 6 else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]

    # -- suffix array and edges

    def suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Positions ordered by their next `longest` characters, by prefix doubling from packed characters, and the (depth, sorted keys) of each doubling."""
        n = len(codes)
        bits = max(1, int(self.letters).bit_length())
        depth = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(depth):
            key <<= bits
            key[: max(0, n - k)] |= codes[k:]
        levels = []
        while True:
            order = np.argsort(key)
            ranks = key[order]
            levels.append((depth, ranks))
            if depth >= self.longest:
                return order, levels
            first = np.where(np.concatenate([[True], ranks[1:] != ranks[:-1]]), np.arange(n), 0)
            rank = np.empty(n, np.int64)
            rank[order] = np.maximum.accumulate(first)
            key = rank << 31
            key[: max(0, n - depth)] |= rank[depth:] + 1
            depth *= 2

    def ranges(self, levels: list[tuple[int, np.ndarray]], grid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece (row of grid), the range of the suffix array that begins with it: binary searches for its first half and, within that range, for the other."""
        depth, ranks = levels[-1]
        if len(levels) == 1:
            bits = max(1, int(self.letters).bit_length())
            key = np.zeros(len(size), np.int64)
            for k in range(depth):
                key <<= bits
                if k < grid.shape[1]:
                    key |= np.where(k < size, grid[:, k], 0)
            return np.searchsorted(ranks, key), np.searchsorted(ranks, key + (np.int64(1) << (bits * (depth - np.minimum(size, depth)))))
        half = levels[-2][0]
        lo, hi = self.ranges(levels[:-1], grid[:, :half], np.minimum(size, half))
        deep = np.flatnonzero((size > half) & (lo < hi))
        from_, to = self.ranges(levels[:-1], grid[deep, half:], size[deep] - half)
        head = lo[deep] << 31
        none = from_ >= to
        lo[deep], hi[deep] = np.searchsorted(ranks, head + from_ + 1), np.searchsorted(ranks, head + to + 1)
        hi[deep[none]] = lo[deep[none]]
        return lo, hi

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position * (longest + 1) + length, piece) of every occurrence of every piece, by position."""
        order, levels = self.suffixes(codes)
        lo, hi = self.ranges(levels, self.grid, self.size)
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        at = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key = at * (self.longest + 1) + self.size[which]
        by = np.argsort(key)
        return key[by], self.number[which[by]]

    # -- relaxation

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each chunk has."""
        points = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(size + 1) - size - 1
        codes[starts + size] = 0
        key, piece = self.edges(codes)
        wide = self.longest + 2  # the last place of each position stands for what is longer than any piece
        lattice = np.full((len(codes) + 1) * wide, -1, np.int32)
        lattice[key + key // (wide - 1)] = piece
        rank = np.append(self.priority, np.int32(LOW))[lattice]
        ids, count, rows = [], [], []

        def take(own: np.ndarray, cut: np.ndarray) -> None:
            got = lattice[(starts[own][:, None] + cut[:, :-1]) * wide + np.minimum(cut[:, 1:] - cut[:, :-1], wide - 1)]
            good = got.min(1) >= 0
            ids.append(got[good].ravel()), count.append(np.full(good.sum(), got.shape[1])), rows.append(own[good])
            for i in np.flatnonzero(~good):
                spelt = self._spell(chunks[own[i]], cut[i], got[i])
                ids.append(spelt), count.append(np.array([len(spelt)])), rows.append(own[i : i + 1])

        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            if not self.bpe:
                cuts = self._best_paths(starts[own], int(n), lattice, wide)
            elif n <= SIDE_BY_SIDE:
                self._merge(own, starts[own], int(n), rank, wide, take)
                continue
            else:
                cuts = [self._merge_one(int(x), int(n), lattice, wide) for x in starts[own]]
            for i, cut in zip(own, cuts):
                take(np.array([i]), cut[None, :])
        ids, count, rows = np.concatenate(ids), np.concatenate(count), np.concatenate(rows)
        by = np.argsort(rows)
        from_, held = (np.cumsum(count) - count)[by], count[by]
        return ids[np.repeat(from_ - np.cumsum(held) + held, held) + np.arange(held.sum())], held

    def _spell(self, chunk: str, cut: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece become bytes, or unknown where the model has no bytes."""
        got: list[int] = []
        for a, b, i in zip(cut[:-1], cut[1:], ids):
            if i >= 0:
                got.append(int(i))
            elif self.bytes:
                got += [self.bytes[x] for x in chunk[a:b].encode("utf-8", "surrogatepass")]
            elif not got or got[-1] != self.unk:
                got.append(self.unk)
        return np.array(got, np.int32)

    def _merge(self, live: np.ndarray, at: np.ndarray, n: int, rank: np.ndarray, wide: int, take) -> None:
        """Chunks of one length side by side: in each round every chunk merges its best pair, so that all have as many symbols; take() gets those that are done."""
        cut = np.tile(np.arange(n + 1, dtype=np.int32), (len(live), 1))
        at = at.astype(np.int32)[:, None]
        while len(live):
            if cut.shape[1] < 3:
                take(live, cut)
                return
            value = rank[(at + cut[:, :-2]) * np.int32(wide) + np.minimum(cut[:, 2:] - cut[:, :-2], wide - 1)]
            k = value.argmax(1)
            go = value[np.arange(len(live)), k] > LOW
            if not go.all():
                take(live[~go], cut[~go])
                live, cut, at, k = live[go], cut[go], at[go], k[go]
            cut = cut[np.arange(cut.shape[1]) != k[:, None] + 1].reshape(len(live), cut.shape[1] - 1)

    def _merge_one(self, start: int, n: int, lattice: np.ndarray, wide: int) -> np.ndarray:
        """One chunk over a heap of (score, position): n log n."""
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (length := end[b] - a) < wide - 1 and (i := lattice[(start + a) * wide + length]) >= 0:
                heapq.heappush(heap, (-int(self.priority[i]), a, b, end[b]))

        for a in range(n):
            offer(a)
        alive = [True] * n
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not alive[a] or end[a] != b or b >= n or not alive[b] or end[b] != c:
                continue
            end[a], alive[b] = c, False
            if c < n:
                prev[c] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        return np.array([*(a for a in range(n) if alive[a]), n])

    def _best_paths(self, starts: np.ndarray, n: int, lattice: np.ndarray, wide: int) -> list[np.ndarray]:
        """Unigram: edges relaxed from left to right for all chunks of one length; a character without a piece costs 10 below the lowest score."""
        low = self.score[self.number].min() - 10
        rows = len(starts)
        best = np.full((n + 1, rows), -np.inf)
        back = np.zeros((n + 1, rows), np.int64)
        best[0] = 0
        for j in range(1, n + 1):
            for length in range(1, min(j, wide - 2) + 1):
                i = lattice[(starts + j - length) * wide + length]
                score = best[j - length] + np.where(i >= 0, self.score[i], low if length == 1 else -np.inf)
                better = score > best[j]
                best[j][better], back[j][better] = score[better], length
        out = []
        for r in range(rows):
            cut, j = [n], n
            while j:
                j -= int(back[j, r])
                cut.append(j)
            out.append(np.array(cut[::-1]))
        return out

    # -- texts

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.chunks.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.out.__getitem__, ids))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Encoder:
    """Encodes batches; remembers the ids of words. Beyond REMEMBERED, words met only once or twice are forgotten, which costs time and changes no result."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.row: dict[str | bytes, int] = {}
        self.flat, self.from_, self.size, self.hits = (np.zeros(0, k) for k in (np.int32, np.int64, np.int64, np.int64))

    def _units(self, text: str | None) -> list[str | bytes]:
        """What is looked up: words after single spaces as str; other texts' chunks as bytes."""
        if not text:
            return []
        if not self.model.prefix or not self.model.apart or "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return [c.encode("utf-8", "surrogatepass") for c in self.model.split(text)]
        return text.split(" ")

    def _trim(self) -> None:
        keep = self.hits > 2
        if keep.sum() > REMEMBERED // 2:
            keep[:] = False
        old = np.flatnonzero(keep)
        held = self.size[old]
        self.flat = self.flat[np.repeat(self.from_[old] - np.cumsum(held) + held, held) + np.arange(held.sum())]
        self.from_, self.size, self.hits = np.cumsum(held) - held, held, np.zeros(len(old), np.int64)
        place = np.cumsum(keep) - 1
        self.row = {w: int(place[r]) for w, r in self.row.items() if keep[r]}

    def _learn(self, words: list[str | bytes]) -> None:
        chunks = [SPACE + w if isinstance(w, str) else w.decode("utf-8", "surrogatepass") for w in words]
        got, a, held = [], 0, 0
        for b, w in enumerate(chunks, 1):
            held += len(w) + 1
            if held >= INDEX_CHARS or b == len(chunks):
                got.append(self.model.encode_chunks(chunks[a:b]))
                a, held = b, 0
        size = np.concatenate([n for _, n in got])
        self.from_ = np.concatenate([self.from_, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, *(x for x, _ in got)])
        self.row.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.size = np.concatenate([self.size, size])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int64)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty, which has none."""
        if len(self.row) > REMEMBERED:
            self._trim()
        units, held = [], []
        for t in texts:
            own = self._units(t)
            units += own
            held.append(len(own))
        new = set(units) - self.row.keys()
        if new:
            self._learn(list(new))
        r = np.fromiter(map(self.row.__getitem__, units), np.int64, len(units))
        self.hits += np.bincount(r, minlength=len(self.hits))
        n = self.size[r]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(self.from_[r] - ends + n, n) + np.arange(n.sum())]
        cut = np.concatenate([[0], ends])[np.cumsum([0, *held])]
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]


_encoders: dict[str, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder a worker process, for all its tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


def _batches(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= chars):
            size += len(texts[b] or "")
            b += 1
        yield a, b
        a = b


def _run(data, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _batches(texts):
                got = encoder.encode(texts[a:b])
                cols = [ids.slice(a, b - a), pa.array([len(x) for x in got], pa.int64())]
                if digest:
                    cols.append(pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in got]))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), pa.array(np.concatenate(got))))
                cols.append(pa.array([encoder.model.decode(x) == (t or "").replace(SPACE, " ") for x, t in zip(got, texts[a:b])]))
                yield pa.record_batch(cols, names=["doc_id", "n_tokens", "ids_sha256" if digest else "ids", "round_trip"])

    return run


def encode(docs: DataFrame, model: str = MODEL, digest: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids (or, with digest, the SHA-256 of the ids as little-endian int32), and whether decoding gives the text again.

    Null and empty texts have no ids. Ids equal those of the reference library without control pieces; U+2581 in a
    text is a space to it, and is compared as one. Long texts are encoded whole; memory grows with the longest run
    without a space (about 100 bytes a character). Rows are independent: ties and repeated rows need no care.
    """
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    out = "ids_sha256 string" if digest else "ids array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(data, digest), f"doc_id long, n_tokens long, {out}, round_trip boolean")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of rows (doc_id, ids): doc_id, text; null ids give a null text."""
    with open(model, "rb") as f:
        data = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(data.value).model
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)
