"""WARC archives: a writer that records equal payloads once, and a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, new_path, partitions, skewed_left_join, table, uri

#: Compressed size at which a task begins its next archive; payloads of this many bytes are recorded once.
ROLL_BYTES, REVISIT_BYTES = 32 << 20, 1000
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ONCE = (b"warc-type", b"warc-record-id", b"content-length")
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}|{copy}' if page_id is not None else f'-|{url}|{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed: a response, or a revisit of the page refers_to."""
    clean = re.sub(r"[\r\n]", " ", url) if url else None
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url))]
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    if clean is not None:
        head.append(("WARC-Target-URI", clean))
    head.append(("WARC-Date", "2024-01-01T00:00:00Z"))
    block = HTTP + payload
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, None))]
        block = HTTP
    head += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def compress(data: bytes) -> bytes:
    """A gzip member of its own."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# -- reading


class Damage(ValueError):
    """A check that failed at a place of an archive."""


class Source:
    """Reads of an open file by place, a step at a time, whatever its size."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.at, self.held = 0, b""

    def read(self, pos: int, n: int) -> bytes:
        if not self.at <= pos <= pos + n <= self.at + len(self.held):
            self.file.seek(pos)
            self.at, self.held = pos, self.file.read(max(n, STEP))
        return self.held[pos - self.at : pos - self.at + n]

    def find(self, what: re.Pattern, pos: int, width: int) -> int:
        """The first place from pos where the pattern (of at most width bytes) matches, or the size."""
        while pos < self.size:
            data = self.read(pos, min(STEP, self.size - pos))
            if m := what.search(data):
                return pos + m.start()
            pos += max(1, len(data) - width + 1)
        return self.size


NUMBER, PAGE = re.compile(r"[0-9]{1,18}"), re.compile(r"-?[0-9]{1,19}")


def number(fields: dict[str, str], name: str, form: re.Pattern = NUMBER) -> int:
    """A header's number, in ASCII digits and the range of a long; anything else is damage."""
    value = fields.get(name, "")
    if not form.fullmatch(value) or not -(1 << 63) <= int(value) < 1 << 63:
        raise Damage(f"no number in {name}")
    return int(value)


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def _whole_payload(fields: dict[str, str], block: bytes) -> bool:
    """Whether the payload digest is that of this record's own payload: not of a revisit, a cut or segmented record, or a body in transfer coding."""
    if fields.get("warc-type") == "revisit" or "warc-truncated" in fields or "warc-segment-number" in fields:
        return False
    return b"transfer-encoding" not in block.partition(b"\r\n\r\n")[0].lower() or not fields.get("content-type", "").startswith("application/http")


def parse(data: bytes, pos: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, end) of the record that begins at pos; checks version, fields, numbers, closing lines and both digests."""
    m = VERSION.match(data, pos)
    if not m:
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", pos)
    if end < 0:
        raise Damage("header not closed")
    fields: dict[str, str] = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[A-Za-z0-9-]+", name) or re.search(rb"[\x00-\x08\x0a-\x1f]|WARC/1\.[01]$", value):
            raise Damage("bad header line")
        if name.decode().lower() in fields and name.lower() in ONCE:
            raise Damage("a field occurs twice")
        try:
            fields[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            raise Damage("header isn't UTF-8") from None
    a, b = end + 4, end + 4 + number(fields, "content-length")
    if "page-id" in fields:
        number(fields, "page-id", PAGE)
    if data[b : b + 4] != b"\r\n\r\n":
        raise Damage("length doesn't fit")
    block = data[a:b]
    if (said := fields.get("warc-block-digest", "")).startswith("sha1:") and digest(block) != said:
        raise Damage("block digest differs")
    if (said := fields.get("warc-payload-digest", "")).startswith("sha1:") and _whole_payload(fields, block) and digest(payload_of(fields, block)) != said:
        raise Damage("payload digest differs")
    return fields, block, b + 4


def _member(src: Source, pos: int) -> tuple[bytes, int, str | None]:
    """(content, end, failure) of the gzip member that begins at pos; after a failure what came before it, and the place up to which was read."""
    z, out, at = zlib.decompressobj(31), [], pos
    while not z.eof:
        data = src.read(at, min(STEP, src.size - at))
        if not data:
            return b"".join(out), at, "member not closed"
        before = z.copy()
        try:
            out.append(z.decompress(data))
        except zlib.error as e:
            # the step again in smaller and smaller pieces, up to the byte that fails
            i, piece = 0, len(data)
            while piece:
                z = before.copy()
                try:
                    out.append(z.decompress(data[i : i + piece]))
                    before, i = z, i + piece
                except zlib.error:
                    piece //= 2
            return b"".join(out), min(at + len(data), src.size), f"gzip: {e}"
        at += len(data)
    return b"".join(out), at - len(z.unused_data), None


def _contents(data: bytes, failure: str | None) -> Iterator[tuple]:
    """('record', fields, block) and ('gap', reason) of a member's content, in order. Where the member failed, only a record whose digest was checked is one."""
    at, bad = 0, None
    while at < len(data):
        try:
            fields, block, end = parse(data, at)
            if failure and not fields.get("warc-block-digest", "").startswith("sha1:"):
                raise Damage(failure)
        except Damage as e:
            bad = bad or str(e)
            m = VERSION.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad:
            yield "gap", bad
            bad = None
        yield "record", fields, block
        at = end
    if failure or bad or not data:
        yield "gap", failure or bad or "empty member"


#: What a header may be up to any of its bytes, so that no other text is read on and on for its closing lines.
HEADER = re.compile(rb"WARC/1\.[01]\r?\n(?:[A-Za-z0-9-]+:[^\x00-\x08\x0a-\x1f]*+\r\n)*+(?:[A-Za-z0-9-]+(?::[^\x00-\x08\x0a-\x1f]*+)?\r?)?")


def _plain(src: Source, pos: int) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at pos."""
    size = 4096
    while True:
        data = src.read(pos, min(size, src.size - pos))
        if not VERSION.match(data):
            raise Damage("no version line")
        end = data.find(b"\r\n\r\n")
        if end >= 0:
            break
        if len(data) < size or (size >= STEP and not HEADER.fullmatch(data)):
            raise Damage("header not closed")
        size *= 4
    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", data[: end + 2])
    if not m or pos + end + 4 + int(m[1]) > src.size:
        raise Damage("length doesn't fit")
    fields, block, n = parse(src.read(pos, min(end + 8 + int(m[1]), src.size - pos)))
    return fields, block, pos + n


MAGIC, LINE = re.compile(rb"\x1f\x8b\x08"), re.compile(rb"WARC/1\.[01]\r?\n")


def salvage(src: Source) -> Iterator[tuple]:
    """('record', start, end, fields, block) and ('gap', start, end, reason), in order and without holes.

    After a failed check the next place that looks like a gzip member or a version line is tried, then the next, until
    a whole record passes; the bytes between are one gap. Within a member the same goes for its content: records before
    and after the damage are kept, and they and the gaps between share the member's places.
    """
    pos, places = 0, [-1, -1]
    gap: tuple[int, str] | None = None

    def following() -> int:
        """The next place after pos that looks like a beginning. Each kind's is remembered until it is passed, so that a file is searched once for each."""
        for i, (what, width) in enumerate(((MAGIC, 3), (LINE, 10))):
            if places[i] <= pos:
                places[i] = src.find(what, pos + 1, width)
        return min(places)

    while pos < src.size:
        lead = src.read(pos, min(3, src.size - pos))
        failure = None
        try:
            if lead == b"\x1f\x8b\x08":
                data, end, failure = _member(src, pos)
                found = list(_contents(data, failure))
                if found[0][0] == "gap" and len(found) == 1:
                    raise Damage(found[0][1])
            else:
                fields, block, end = _plain(src, pos)
                found = [("record", fields, block)]
        except Damage as e:
            gap = gap or (pos, str(e))
            pos = following()
            continue
        if gap:
            yield "gap", gap[0], pos, gap[1]
            gap = None
        if failure:
            found.pop()  # the gap of the failure goes on to the next record
        for what, *rest in found:
            yield what, pos, end, *rest
        if failure:
            gap = (pos, failure)
            pos = following()
        else:
            pos = end
    if gap:
        yield "gap", gap[0], src.size, gap[1]


# -- tables

RECORDS = "path string, start long, end long, kind string, record_id string, refers string, page_id long, url string, payload binary, said string, reason string"
_FIELDS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("refers", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("said", pa.string()), ("reason", pa.string())])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        made, out, held = [], None, 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                data = compress(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py()))
                if out is None:
                    # a name that a second attempt of the task doesn't share: only archives that are listed are read
                    made.append([f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0])
                    out = fs.open_output_stream(f"{root}/{made[-1][0].rpartition('/')[2]}", compression=None)
                out.write(data)
                held += len(data)
                made[-1][1:] = [made[-1][1] + 1, held]
                if held >= ROLL_BYTES:
                    out.close()
                    out, held = None, 0
        if out is not None:
            out.close()
        if made:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives in the shared folder; returns path, records, bytes.

    Of pages with equal payloads of at least revisit_bytes, the one with the largest page_id is a response and the
    others revisit it; rows that repeat that id are responses too. Null html is an empty payload, a null url has no
    target, a page without an id revisits but is never revisited. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("sha", F.when(F.col("n") >= revisit_bytes, F.sha1("html")))
    tops = rows.where("sha is not null").groupBy("sha", "n").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("held")).where("held > 1 and top is not null")
    rows = skewed_left_join(rows, materialize(tops, "warc-tops"), ["sha", "n"], "held")
    rows = rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers"))
    return materialize(rows.mapInArrow(_write(uri(new_path(spark, "warc"))), "path string, records long, bytes long"), "warc-list")


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """The records of the archives in paths (path), and their gaps as rows of kind 'gap' with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(uri(path))
                rows, size = [], 0
                with fs.open_input_file(name) as f:
                    for what, a, b, *rest in salvage(Source(f)):
                        if what == "gap":
                            rows.append((path, a, b, "gap", None, None, None, None, None, None, rest[0]))
                        else:
                            fields, block = rest
                            payload = payload_of(fields, block)
                            page = fields.get("page-id")
                            rows.append((path, a, b, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), int(page) if page else None, fields.get("warc-target-uri"), payload, fields.get("warc-payload-digest"), None))
                            size += len(payload)
                        if size > STEP * 64 or len(rows) >= 2000:
                            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    return paths.select("path").repartition(partitions(spark)).mapInArrow(run, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """Per response or revisit: page_id, payload_bytes, payload_digest (hex), record_type, refers_to.

    A revisit has the payload of the response that it names (of several records of that id, of one: the largest
    page_id). One that names no response, or one with another payload digest than it says itself, has no payload and
    refers to nothing: three nulls.
    """
    said = F.when(F.col("said").startswith("sha1:"), F.col("said"))
    rows = records.where("kind in ('response', 'revisit')").select("kind", "record_id", "refers", "page_id", said.alias("said"), F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"))
    rows = materialize(rows, "warc-records")
    wanted = rows.where("kind = 'revisit'").groupBy("refers").agg(F.count(F.lit(1)).alias("held"))
    named = rows.where("kind = 'response'").select(F.col("record_id").alias("refers"), F.struct("page_id", "n", "sha", "said").alias("to")).join(wanted, "refers")
    named = materialize(named.groupBy("refers", "held").agg(F.max("to").alias("to")), "warc-named")
    full = skewed_left_join(rows.where("kind = 'revisit'"), named, ["refers"], "held")
    same = F.col("to").isNotNull() & F.coalesce(F.col("said") == F.col("to.said"), F.lit(True))
    plain = rows.where("kind = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(full.select("page_id", F.when(same, F.col("to.n")).alias("payload_bytes"), F.when(same, F.col("to.sha")).alias("payload_digest"), F.col("kind").alias("record_type"), F.when(same, F.col("to.page_id")).alias("refers_to")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_archives(table(spark, sf_dir, "pages"))
    return resolve(read_archives(spark, written))



def repeated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of pages made from those of the table so that payloads of 999, 1000 and 1001 bytes repeat: what the table itself has few of."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("substr(repeat(md5(cast(page_id % 50 as string)), 40), 1, cast(999 + page_id % 3 as int))").alias("html"))
    return resolve(read_archives(spark, write_archives(pages)))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS sha FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY sha, n) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, sha AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM t
"""
REPEATED_SQL = SQL.replace("SELECT page_id, coalesce(html, '') AS h FROM pages", "SELECT page_id, substr(repeat(md5((page_id % 50)::VARCHAR), 40), 1, 999 + page_id % 3) AS h FROM pages")
