"""Secrets in texts: plain patterns, and candidates confirmed by their structure.

Plain kinds report what their pattern says.  Confirmed kinds decode a candidate
(base64 or hex) and report it only if the bytes are what they look like: a
signed token's header and claims are JSON, a key's nested DER lengths add up to
the whole, an OpenSSH key's length fields do.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .words import beside, unpacked

Span = tuple[int, str, int]  # start, kind, end: code points, end exclusive

# Fixed values of the plain kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: All kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex")

TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]*")
PEM_LABEL = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,32}KEY(?: BLOCK)?)-----")
PEM_FIELD = re.compile(r"[A-Za-z][A-Za-z0-9-]*: ")
#: Whole runs only: looking back keeps the search from starting again inside a long run.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}")
BASE64_URL = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}+={0,2}")
#: Lines of base64; the last one may be followed by other text.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}+(?:\r?\n|\\n)[ \t]*+)++[A-Za-z0-9+/]*+={0,2}")
LINE_BREAK = re.compile(r"(?:\r?\n|\\n)[ \t]*")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+(?![0-9A-Za-z])")
OPENSSH_MAGIC = b"openssh-key-v1\0"


def decode_base64(value: str) -> bytes | None:
    """Standard or URL alphabet, with or without padding."""
    body = value.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the element at ``at``; None if its length does not fit before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at:at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements between ``at`` and ``end``, which they have to fill exactly."""
    out = []
    while at < end:
        element = der_element(data, at, end)
        if element is None:
            return None
        out.append(element)
        at = element[2]
    return out


SEQUENCE, INTEGER, OCTETS, OBJECT = 0x30, 0x02, 0x04, 0x06


def is_der_key(data: bytes) -> bool:
    """A private key: PKCS#1 (version and eight numbers), DSA (version and five), SEC1 (version, octets), PKCS#8 (version,
    algorithm, octets) or encrypted PKCS#8 (algorithm, octets)."""
    outer = der_element(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] != len(data):
        return False
    parts = der_children(data, *outer[1:])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]

    def names_algorithm(part: tuple[int, int, int]) -> bool:
        inner = der_children(data, *part[1:])
        return bool(inner) and inner[0][0] == OBJECT

    if tags == [SEQUENCE, OCTETS]:
        return names_algorithm(parts[0]) and parts[1][2] - parts[1][1] >= 16
    version = data[parts[0][1]:parts[0][2]]
    if tags[0] != INTEGER or version not in (b"\0", b"\1"):
        return False
    if tags[:9] == [INTEGER] * 9 or tags == [INTEGER] * 6:
        return all(e > s for _, s, e in parts)
    if tags[1] == OCTETS:
        return version == b"\1" and parts[1][2] - parts[1][1] >= 16
    return tags[1:3] == [SEQUENCE, OCTETS] and names_algorithm(parts[1])


def is_openpgp_key(data: bytes) -> bool:
    """Packets whose lengths fill the whole, the first one a secret key."""
    at, first = 0, None
    while at < len(data):
        head, at = data[at], at + 1
        if not head & 0x80 or at >= len(data):
            return False
        if head & 0x40:
            tag, size, at = head & 0x3F, data[at], at + 1
            if 192 <= size < 224:
                size, at = (size - 192 << 8) + (data[at] if at < len(data) else 0) + 192, at + 1
            elif size == 255:
                size, at = int.from_bytes(data[at:at + 4], "big"), at + 4
            elif size >= 224:  # parts of unknown number
                return False
        else:
            tag, n = head >> 2 & 0xF, (1, 2, 4, 0)[head & 3]
            if not n:
                return False
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
        first, at = first if first is not None else tag, at + size
    return first == 5 and at == len(data)


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, derivation, options, a count and the keys, each with its length, filling the whole."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at, fields = len(OPENSSH_MAGIC), 0
    count = None
    while at < len(data):
        if at + 4 > len(data):
            return False
        size, at = int.from_bytes(data[at:at + 4], "big"), at + 4
        if fields == 3:
            count = size
        else:
            at += size
        fields += 1
    return at == len(data) and count is not None and 1 <= count <= 64 and fields == 5 + count


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def is_key_block(label: str, body: str) -> bool:
    """What stands between the marks of a block: header lines, if any, then a key in base64.

    A key encrypted under header lines is opaque; its bytes have to fill cipher blocks.
    """
    lines = [line.strip() for line in LINE_BREAK.sub("\n", body.replace("\\r", "").replace("\r", "")).strip().split("\n")]
    fields = []
    if PEM_FIELD.match(lines[0]):  # header lines, folded ones among them, end at an empty line
        cut = lines.index("") if "" in lines else len(lines)
        fields, lines = lines[:cut], lines[cut:]
    lines = [line for line in lines if line]
    if label.endswith(" BLOCK") and lines and lines[-1].startswith("="):
        lines.pop()  # the checksum
    data = decode_base64("".join("".join(lines).split()))
    if label.endswith(" BLOCK"):
        return bool(data) and is_openpgp_key(data)
    if any("ENCRYPTED" in f for f in fields) and any(f.startswith("DEK-Info:") for f in fields):
        return bool(data) and len(data) >= 64 and len(data) % 8 == 0
    return is_key(data)


def is_signed_token(value: str) -> bool:
    """Header and claims are JSON objects, the header names an algorithm; signed unless that is none."""
    head, claims, signature = value.split(".", 2)
    try:
        head, claims = (json.loads(decode_base64(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(claims, dict) or not isinstance(head.get("alg"), str):
        return False
    return head["alg"].lower() == "none" or len(decode_base64(signature) or b"") >= 16


def plain_spans(text: str) -> Iterator[Span]:
    """The base kinds; leftmost, non-overlapping for each, failing matches dropped."""
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield m.start(), "assign", m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield m.start(), "access", m.end()
    for m in HEX.finditer(text):
        yield m.start(), "hex", m.end()


def token_spans(text: str) -> Iterator[tuple[int, int]]:
    """Places of ``eyJ``, two dots between runs of the URL alphabet: leftmost, non-overlapping; each run is passed three times at most."""
    at = text.find("eyJ")
    while at >= 0:
        end = TOKEN_RUN.match(text, at).end()
        after = end
        if end > at + 3 and text[end:end + 1] == ".":
            second = TOKEN_RUN.match(text, end + 1).end()
            if second > end + 1 and text[second:second + 1] == ".":
                after = TOKEN_RUN.match(text, second + 1).end()
                yield at, after
        at = text.find("eyJ", after)


def block_spans(text: str) -> Iterator[tuple[int, int]]:
    """Key blocks from their first to their last mark; the lines between are a key."""
    next_end: dict[str, int] = {}  # by label, so the text is searched once for each
    at = text.find("-----BEGIN ")
    while at >= 0:
        following = text.find("-----BEGIN ", at + 1)
        found = PEM_LABEL.match(text, at)
        if found:
            mark = f"-----END {found[1]}-----"
            end = next_end.get(mark, 0)
            if 0 <= end < found.end():
                end = next_end[mark] = text.find(mark, found.end())
            # A block ends before the next one begins.
            if 0 <= end < (following if following >= 0 else len(text)) and is_key_block(found[1], text[found.end():end]):
                yield at, end + len(mark)
        at = following


def wrapped_key_end(text: str, start: int, end: int) -> int | None:
    """The end of a key in lines of base64 from ``start`` on; what follows on the last line may be other text."""
    lines, at = [], start
    for gap in [*LINE_BREAK.finditer(text, start, end), None]:
        stop = gap.start() if gap else end
        lines.append((at, text[at:stop]))
        at = gap.end() if gap else end
    body = "".join(line for _, line in lines)
    need = len(body.rstrip("="))
    if body.startswith("M"):
        # The outer length says where the key ends.
        head = decode_base64(body[:16].rstrip("="))
        outer = der_element(head + bytes(1 << 20), 0, 1 << 20) if head else None
        if outer is None:
            return None
        need = -(-outer[2] * 4 // 3)
    if need > len(body) or not is_key(decode_base64(body[:need])):
        return None
    for at, line in lines:
        if need <= len(line):
            at += need
            while need % 4 and text[at:at + 1] == "=":
                at, need = at + 1, need + 1
            return at
        need -= len(line)
    return None


def may_be_key(base64_text: str) -> bool:
    """The first bytes say whether it can be a key, before the whole is decoded."""
    return base64_text.startswith("M") or base64_text.startswith("b3BlbnNzaC1rZXktdjEA")


def confirmed_spans(text: str) -> Iterator[Span]:
    """Candidates whose structure holds; a key inside a PEM block is reported once, as the block, one in lines once, as the lines."""
    if "eyJ" in text:
        for start, end in token_spans(text):
            if is_signed_token(text[start:end]):
                yield start, "jwt", end
    taken = []
    if "-----BEGIN " in text:
        for start, end in block_spans(text):
            taken.append((start, end))
            yield start, "pem", end

    def inside(start: int, end: int) -> bool:
        return any(s <= start and end <= e for s, e in taken)

    for m in BASE64_LINES.finditer(text):
        if may_be_key(m[0]) and not inside(*m.span()) and (end := wrapped_key_end(text, *m.span())) is not None:
            taken.append((m.start(), end))
            yield m.start(), "key64", end
    for pattern in (BASE64, BASE64_URL):
        for m in pattern.finditer(text):
            if may_be_key(m[0]) and not inside(*m.span()) and is_key(decode_base64(m[0])):
                taken.append(m.span())
                yield m.start(), "key64", m.end()
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2] in ("30", "6f", "6F") and not inside(*m.span()) and is_key(bytes.fromhex(m[0])):
            yield m.start(), "keyhex", m.end()


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as listed in ``KINDS``; none for NULL and empty texts."""
    if not text:
        return []
    return sorted([*plain_spans(text), *confirmed_spans(text)], key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def masked(text: str | None, spans: list[Span], replacement: str = "<secret>") -> str | None:
    """The text with every span replaced; spans that overlap or touch are one."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for start, _, stop in spans:
        if start > end:
            if end >= 0:
                at = end
            out += [text[at:start], replacement]
            end = stop
        end = max(end, stop)
    return "".join([*out, text[end:]])


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, *, text: str = "text", into: str = "secrets", masked_text: str | None = None,
                 replacement: str = "<secret>") -> DataFrame:
    """Adds a column ``into`` with all spans of ``text``; with ``masked_text``, also the text without them.

    One pass over whole texts without a shuffle; a row needs memory in proportion
    to its own text.  NULL and empty texts have no spans.  Columns of the input of
    the same names (in any case) are replaced (``masked_text`` may be ``text`` itself), all
    others are passed through.  Repeated rows each give their own result.
    """
    added = {into: F.col("spans")} | ({masked_text: F.col("masked")} if masked_text else {})
    slim = beside(docs, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_spans(t) for t in texts]
            columns = [batch.column(0), pa.array([[(k, s, e) for s, k, e in f] for f in found], _ARROW_SPANS)]
            if masked_text:
                columns.append(pa.array([masked(t, f, replacement) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "spans", "masked"][:len(columns)])

    made = StructType.fromDDL(f"spans {SPAN_TYPE}" + (", masked string" if masked_text else ""))
    return unpacked(slim.mapInArrow(scan, StructType([slim.schema["row"], *made.fields])), docs, added)
