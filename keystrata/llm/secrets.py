"""Secret scanning with structural confirmation.

Three base patterns report assignments, access keys and long hexadecimal runs. Further candidates
are reported only if their structure confirms them: base64 or hex runs and armoured blocks are
decoded and must parse as a private key (nested tag-length-value encoding without a byte left over,
or length-prefixed fields behind the key format's magic), and signed tokens must have a header that
decodes to a JSON object naming an algorithm.

One Arrow pass, no shuffle. Whole texts are tested by byte searches first, so the patterns only run
on texts that can match. Spans are in code points, end exclusive.

Null text counts as empty and gives no span. Repeated rows and null ids are kept; an empty table
gives an empty result. scan() ignores other columns, redact() passes them through.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.session import table

#: Order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "token", "armour", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[ \t]*\r?\n)*(?:[A-Za-z][A-Za-z0-9-]{0,40}:[^\n]*\n)*)([^-]+)-----END \1-----")
DEK = re.compile(r"^DEK-Info:[ \t]*[A-Z0-9-]+,[ \t]*(?:[0-9A-Fa-f]{2}){8,}[ \t]*\r?$", re.MULTILINE)
RUN64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{40,})*[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2}")
LINE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
RUN16 = re.compile(r"[0-9a-fA-F]{48,}")
MAGIC = b"openssh-key-v1\0"


def _mark(members: bytes) -> bytes:
    return bytes(1 if i in members else 0 for i in range(256))


IS_HEX = _mark(b"0123456789abcdefABCDEF")
IS_64 = _mark(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _elements(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of tag-length-value elements that fill data exactly, constructed ones checked within."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        content, at = data[at : at + size], at + size
        if tag & 0x20 and _elements(content, depth + 1) is None:
            return None
        out.append((tag, content))
    return out


def is_key(data: bytes) -> bool:
    """A private key: a sequence of a small version number and two or more parts, or length-prefixed fields.

    Two more forms have two parts: a version and octets (elliptic curves without parameters), and an
    algorithm with parameters and octets (an encrypted key; a digest's algorithm has no such parameters).
    """
    if data.startswith(MAGIC):
        at, fields = len(MAGIC), 0
        for _ in range(3):  # cipher, derivation, its options
            size = int.from_bytes(data[at : at + 4], "big")
            at, fields = at + 4 + size, fields + (at + 4 + size <= len(data))
        return fields == 3 and int.from_bytes(data[at : at + 4], "big") >= 1
    if data[:1] != b"\x30":
        return False
    outer = _elements(data)
    if outer is None or len(outer) != 1:
        return False
    inner = _elements(outer[0][1]) or []
    if sum(len(c) for _, c in inner) < 24:
        return False
    if len(inner) == 2 and inner[1][0] == 4:
        method = _elements(inner[0][1]) if inner[0][0] == 0x30 else None
        return inner[0] == (2, b"\1") or (method is not None and [t for t, _ in method] == [6, 0x30])
    return len(inner) >= 3 and inner[0][0] == 2 and inner[0][1] in (b"\0", b"\1")


def _is_armoured(headers: str, body: str) -> bool:
    """A key in the body, or whole cipher blocks where the headers say that and how it is encrypted."""
    data = _base64(body)
    return is_key(data) or ("ENCRYPTED" in headers and DEK.search(headers) is not None and len(data) >= 24 and len(data) % 8 == 0)


def _wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Spans of keys in base64 over lines of one width, the last perhaps shorter."""
    for block in WRAPPED.finditer(text):
        lines = [m.span() for m in LINE64.finditer(text, *block.span())]
        sizes, i = [b - a for a, b in lines], 0
        while i < len(lines):
            stop = i + 1
            while stop < len(lines) and sizes[stop] == sizes[i]:
                stop += 1
            shorter = stop < len(lines) and sizes[stop] < sizes[i]
            for k in range(i, stop):
                # Sequences and the key format's magic start like this; a sequence says how long it is.
                head = text[lines[k][0] : lines[k][0] + 12]
                if not head.startswith(("M", "b3Bl")):
                    continue
                start, size = _base64(head), 0
                if start[:1] == b"\x30":
                    n = start[1] & 0x7F if start[1] & 0x80 else 0
                    size = 2 + n + (int.from_bytes(start[2 : 2 + n], "big") if n else start[1])
                last = k + -(-((size * 8 + 5) // 6) // sizes[i]) if size else 0
                ends = [last] if size else [stop + 1, stop]
                for end in ends:
                    end = max(k + 2, end)
                    if end > stop + shorter:
                        continue
                    if is_key(_base64("".join(text[a:b] for a, b in lines[k:end]))):
                        yield lines[k][0], lines[end - 1][1]
                        break
            i = stop


def _base64(text: str) -> bytes:
    plain = re.sub(r"\s", "", text).translate({45: "+", 95: "/"}).rstrip("=")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return b""


def is_token_header(part: str) -> bool:
    try:
        header = json.loads(_base64(part))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text, by start and then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower()
    out: list[tuple[str, int, int]] = []
    if any(n in lower for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"\1" * 24 in raw.translate(IS_HEX):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        out += [("key", *m.span()) for m in RUN16.finditer(text) if is_key(bytes.fromhex(m[0][: len(m[0]) & ~1]))]
    if b"eyJ" in raw:
        out += [("token", *m.span()) for m in TOKEN.finditer(text) if is_token_header(m[1])]
    if b"-----BEGIN " in raw:
        out += [("armour", *m.span()) for m in ARMOUR.finditer(text) if _is_armoured(m[2], m[3])]
    if b"\1" * 40 in raw.translate(IS_64):
        out += [("key", *m.span()) for m in RUN64.finditer(text) if is_key(_base64(m[0]))]
        out += [("key", *span) for span in _wrapped(text)]
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with spans an array of (kind, start, end), for each row of docs."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs in their own columns, each stretch of overlapping secrets in `text` replaced by the mark."""
    at = docs.columns.index("text")

    def masked(text: str | None) -> str | None:
        if not text or not (spans := find(text)):
            return text
        out, to = [], 0
        for _, start, end in spans:
            if start >= to:
                out += [text[to:start], mark]
            to = max(to, end)
        return "".join([*out, text[to:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([masked(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


def queries() -> dict:
    return {"op8_secret_scan": op8_secret_scan}


def oracle_sql() -> dict:
    return {}
