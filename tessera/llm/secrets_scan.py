"""Secret scan by assignment-aware lexing.

Besides three base patterns, source and configuration syntax is lexed into pairs of names and expressions: assignments to
names, subscripts and keys, of literals with or without quotes, in code, shell lines and comments. Constants are
propagated: a name that stands for a literal, or for a sum of literals and names, carries the places of the literals to
whatever it is assigned to, before or after it in the text. Literals are scored by how sensitive the names are that they reach, and by their own form.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

KINDS = ("assign", "access", "hex", "lex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of fewer than 24 fail, so that the whole runs of 24 or more are the matches that stay.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "api")

# Name parts and how sensitive they make a target; literals that stand for no secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "passcode": 3, "secret": 3, "token": 3, "apikey": 3, "api_key": 3, "access_key": 3, "private_key": 3, "secret_key": 3,
    "auth_key": 3, "client_secret": 3, "credential": 2, "credentials": 2, "bearer": 2, "authorization": 2, "encryption_key": 3, "signing_key": 3, "connection_string": 2, "auth": 1, "key": 1, "pin": 1, "salt": 1,
}
#: What a text without any sensitive name lacks: the names without the signs between their parts, the shortest that hold the others.
_JOINED = {k.replace("_", "") for k in SENSITIVE}
STEMS = tuple(sorted(s for s in _JOINED if not any(k != s and k in s for k in _JOINED)))
SIGNS = re.compile(r"[^a-z0-9]+")
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|changeme|change_me|example.*|sample.*|placeholder.*|dummy.*|your[_-].*|my[_-][a-z_-]*|none|null|nil|true|false|undefined|todo|tbd|test|password|passwd|secret|token|string|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|\$[a-z_]+|env\..*|os\.environ.*|process\.env.*)$")
THRESHOLD = 4.0

TOKEN = re.compile(
    r"""(?P<string>\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`)
    |(?P<comment>(?:\#|//)[^\n]*)
    |(?P<op>:=|=>|==|!=|<=|>=|\+=|=|:|\+|,|;|\(|\)|\[|\]|\{|\})
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*)
    |(?P<bare>[0-9A-Za-z+/_.%@~^&*!?-]+)
    |(?P<line>\n)
    |(?P<space>[^\S\n]+)
    |(?P<other>.)""",
    re.VERBOSE,
)
#: A shell assignment, also several on a line; and a reference to a variable, which may be all of a quoted string.
SHELL = re.compile(r"(?:^|(?<=[\s;&|]))(?P<name>[A-Za-z_]\w*)=(?P<value>\$\{\w+\}|[^\s\"'#;,(){}\[\]+&|]+)(?=[\s;&|]|$)", re.MULTILINE | re.ASCII)
REFERENCE = re.compile(r"\$(?:\{(\w+)\}|(\w+))", re.ASCII)
CONFIG = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+)?(?P<name>[A-Za-z_][\w.-]*)[ \t]*(?:=|:)[ \t]*(?P<value>[^\s\"'#;,(){}\[\]+][^\s\"'#;,(){}\[\]]*)[ \t]*(?:[#;][^\n]*)?$", re.MULTILINE | re.ASCII)


def sensitivity(name: str) -> int:
    """How sensitive a target name is: by its last parts, whatever its style (snake, kebab, camel, dotted)."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    best = 0
    for i in range(len(parts)):
        weight = max(SENSITIVE.get("_".join(parts[i : i + 2]), 0), SENSITIVE.get(parts[i], 0), SENSITIVE.get("".join(parts[i : i + 2]), 0))
        # a later part that describes the secret instead of being it
        if parts[i + 1 :] and parts[-1] in ("name", "file", "path", "url", "id", "length", "type", "hint", "count", "size", "field", "label", "policy"):
            weight = 0
        best = max(best, weight)
    return best


class Value:
    """A literal, or a sum of two values that shares them: what its form needs, and the places of its literals as a tree."""

    __slots__ = ("n", "counts", "head", "tail", "of", "found")

    def __init__(self, n: int, counts: Counter | None, head: str, tail: str, of: tuple):
        self.n, self.counts, self.head, self.tail, self.of, self.found = n, counts, head, tail, of, False

    @classmethod
    def literal(cls, text: str, start: int, end: int) -> Value:
        return cls(len(text), None if any(c.isspace() for c in text) else Counter(text), text[:ENDS], text[-ENDS:], (start, end))

    def __add__(self, other: Value) -> Value:
        counts = None if self.counts is None or other.counts is None else self.counts + other.counts
        head = self.head if self.n >= ENDS else (self.head + other.head)[:ENDS]
        tail = other.tail if other.n >= ENDS else (self.tail + other.tail)[-ENDS:]
        return Value(self.n + other.n, counts, head, tail, (self, other))

    def places(self) -> Iterator[tuple[int, int]]:
        """The places of the literals that weren't asked for before."""
        work = [self]
        while work:
            v = work.pop()
            if v.found:
                continue
            v.found = True
            if isinstance(v.of[0], Value):
                work += v.of
            else:
                yield v.of


#: Characters that a value keeps of both ends; placeholders of fixed length are shorter.
ENDS = 32


def form(value: Value) -> float:
    """How much a literal looks like a secret: length, mixture and entropy; 0 for words, placeholders and templates."""
    n, counts = value.n, value.counts
    if n < 6 or counts is None:
        return 0.0
    # a longer value is a placeholder by its ends and the characters between, of which each counts once
    inner = "" if n <= ENDS else value.tail[ENDS - (n - ENDS) :] if n <= 2 * ENDS else "".join(counts - Counter(value.head + value.tail)) + value.tail
    if PLACEHOLDER.match(value.head + inner):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    literal = "".join(counts)
    kinds = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search("[0-9]", literal), re.search("[^A-Za-z0-9]", literal))))
    return min(n, 20) / 10 + (kinds - 1) * 0.5 + max(0.0, entropy - 2.5) * 0.5


def lex(text: str, start: int = 0, end: int | None = None) -> tuple[list[tuple[str, str, int, int]], list[tuple[int, int]]]:
    """(kind, text, start, end) of the tokens that matter to assignments, and the inner places of the comments."""
    tokens, comments = [], []
    for m in TOKEN.finditer(text, start, len(text) if end is None else end):
        if m.lastgroup == "comment":
            comments.append((m.start() + (2 if m[0][0] == "/" else 1), m.end()))
        elif m.lastgroup != "space":
            tokens.append((m.lastgroup, m[0], m.start(), m.end()))
    return tokens, comments


def _inner(raw: str, start: int, end: int) -> tuple[str, int, int]:
    q = 3 if raw[:3] in ('"""', "'''") and len(raw) >= 6 else 1
    return raw[q : len(raw) - q], start + q, end - q


def _expression(tokens: list[tuple[str, str, int, int]], j: int) -> tuple[list[Value | str] | None, int]:
    """The terms of the sum that begins at token j, literals and names, and the token after it; None if it is no such sum. Brackets around it or its terms don't matter."""
    terms: list[Value | str] = []
    depth, due = 0, True
    while j < len(tokens):
        kind, raw, a, b = tokens[j]
        if raw == "(" and due:
            depth += 1
        elif kind == "line" and depth:
            pass
        elif kind == "string" and (due or tokens[j - 1][0] in ("string", "line")):  # strings side by side are one
            inner, x, y = _inner(raw, a, b)
            ref = REFERENCE.fullmatch(inner)
            terms.append(ref[1] or ref[2] if ref else Value.literal(inner, x, y))
            due = False
        elif kind == "name" and due:
            after = tokens[j + 1][1] if j + 1 < len(tokens) else ""
            if after in ("(", "["):  # a call or a lookup stands for no constant
                return None, j
            terms.append(raw)
            due = False
        elif raw == "+" and not due:
            due = True
            if j + 1 < len(tokens) and tokens[j + 1][0] == "line":
                j += 1
        elif raw == ")" and depth and not due:
            depth -= 1
        else:
            break
        j += 1
    return (terms if terms and not due and not depth else None), j


def _assignments(text: str, tokens: list[tuple[str, str, int, int]]) -> Iterator[tuple[str, list[Value | str], bool]]:
    """(name, terms, whether they are added to what the name holds) of the assignments among tokens."""
    i = 0
    while i < len(tokens) - 2:
        kind, raw, a, b = tokens[i]
        if raw == "[" and i + 3 < len(tokens) and tokens[i + 1][0] == "string" and tokens[i + 2][1] == "]":  # a subscript
            kind, raw, a, b = tokens[i + 1]
            at = i + 3
        else:
            at = i + 1
        quoted = kind == "string"
        op = tokens[at]
        if not (kind == "name" or quoted) or op[0] != "op" or op[1] not in ("=", ":=", "=>", ":", "+="):
            i += 1
            continue
        j = at + 1
        if j + 1 < len(tokens) and op[1] == ":" and tokens[j][0] == "name" and tokens[j + 1][1] == "=":
            j += 2  # a type between name and value
        terms, end = _expression(tokens, j)
        if terms is not None:
            yield _inner(raw, a, b)[0] if quoted else raw, terms, op[1] == "+="
        i = max(j, end) if terms is not None else at + 1


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of every assignment, with constants propagated in the order of the text; those that need a later name follow when it is known."""
    known: dict[str, Value] = {}
    waiting: dict[str, list[tuple[str, list[Value | str]]]] = {}

    def settle(name: str, terms: list[Value | str], later: bool) -> Iterator[tuple[str, Value]]:
        work = [(name, terms, later)]
        while work:
            name, terms, later = work.pop()
            missing = next((t for t in terms if isinstance(t, str) and t not in known), None)
            if missing is not None:
                waiting.setdefault(missing, []).append((name, terms))
                continue
            value = None
            for t in terms:
                own = known[t] if isinstance(t, str) else t
                value = own if value is None else value + own
            if not later or name not in known:
                known[name] = value
            yield name, value
            work += [(n, t, True) for n, t in waiting.pop(name, ())]

    tokens, comments = lex(text)
    for region in (tokens, *(lex(text, a, b)[0] for a, b in comments)):
        for name, terms, more in _assignments(text, region):
            if more and name in known:
                terms = [known[name], *terms]
            yield from settle(name, terms, False)
    seen = set()
    for pattern in (CONFIG, SHELL):
        for m in pattern.finditer(text):
            a, b = m.span("value")
            if (a, b) not in seen:
                seen.add((a, b))
                ref = REFERENCE.fullmatch(m["value"])
                yield from settle(m["name"], [ref[1] or ref[2] if ref else Value.literal(m["value"], a, b)], False)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(n in low for n in ASSIGN_NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive target; nothing is lexed where no name could be sensitive."""
    if "=" not in text and ":" not in text:
        return []
    joined = SIGNS.sub("", text.lower())
    if not any(s in joined for s in STEMS):
        return []
    found: set[tuple[str, int, int]] = set()
    for name, value in pairs(text):
        weight = sensitivity(name)
        if weight > 0 and (own := form(value)) > 0 and weight + own >= THRESHOLD:
            found |= {("lex", a, b) for a, b in value.places() if a < b}
    return sorted(found)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by start, then kind: the base ones and the literals that no base span covers whole."""
    base = base_spans(text or "")
    more = [x for x in lexed_spans(text or "") if not any(a <= x[1] and x[2] <= b for _, a, b in base)]
    by = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=by), sorted(base + more, key=by)


SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and spans (kind, start, end in code points, end exclusive).

    Null and empty texts have no spans. Ids are taken as longs. A row depends on its own text only: ties, repeated rows and columns of other
    names need no care. Texts are scanned whole, each in memory once.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py())[1]] for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = lambda k: F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(joined.format("filter(spans, s -> s.kind <> 'lex')")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, as the query has it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
