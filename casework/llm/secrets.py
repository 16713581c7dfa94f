"""Secret scans with structural confirmation.

Three base patterns are reported as they match. Beyond them, runs that look like
base64 or hexadecimal are decoded, and reported only if what they hold has the
structure of a credential: a private key in DER whose nested lengths add up, an
OpenSSH key with its length-prefixed parts, or a signed token whose header names
an algorithm. Keys are found in armour (with real or escaped line ends, and with header
lines, where an encrypted body must be whole blocks of the cipher named there), in armour that
is encoded once more, on one line, and wrapped over lines without armour (keys of up to KEY_BYTES).
Rows are scanned alone; nothing is shuffled and no text is cut. Patterns begin at the border of a
run or take runs whole, so that a scan is linear in the text whatever it repeats.

Defined results: a null text counts as empty and has no spans; positions are
code points, the end exclusive; repeated rows give repeated results; an empty
table gives an empty one; other columns of the input are left alone.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "key", "ssh", "jwt")
BASE = KINDS[:3]
#: The base patterns and the least length of each.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters or more
LEAST = {"assign": 12, "access": 18}

RUN = re.compile(r"[A-Za-z0-9_.-]+")  # holds signed tokens
BREAK = r"(?:\s|\\[nrt])"
ARMOUR = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----" + BREAK + r"*((?:[A-Za-z][A-Za-z-]*: [^\r\n\\]*" + BREAK + r"+)*)"
    r"((?:[A-Za-z0-9+/=]|" + BREAK + r")+)-----END [A-Z0-9 ]*PRIVATE KEY-----"
)
CIPHER = re.compile(r"DEK-Info: (DES|AES|CAMELLIA|SEED|RC2|IDEA|BF|CAST5?)-?[A-Z0-9-]*,[0-9A-Fa-f]+")
#: Every DER sequence longer than 47 bytes starts with M in base64, and every OpenSSH key with b3BlbnNzaC1rZXkt.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]{39,}|b3BlbnNzaC1rZXkt[A-Za-z0-9+/_-]{24,})={0,2}")
ENCODED_ARMOUR = re.compile(r"(?<![A-Za-z0-9+/_-])LS0tLS1CRUdJTi[A-Za-z0-9+/_-]{40,}={0,2}")
LINE = re.compile(BREAK + r"+([A-Za-z0-9+/_-]+={0,2})")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")
KEY_BYTES = 1 << 14
MAGIC64 = "b3BlbnNzaC1rZXktdjEA"
MAGIC = b"openssh-key-v1\x00"


def elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[start:end] exactly, else None."""
    found = []
    while start < end:
        if start + 2 > end:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length == 0x80 or length > 0x84:
            return None
        if length > 0x80:
            width = length - 0x80
            if start + width > end:
                return None
            length, start = int.from_bytes(data[start : start + width], "big"), start + width
        if start + length > end:
            return None
        found.append((tag, start, start + length))
        start += length
    return found


def is_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8, DSA or SEC1 private keys: one sequence whose nested lengths add up."""
    outer = elements(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = elements(data, outer[0][1], outer[0][2])
    if not parts or parts[0][0] != 0x02 or data[parts[0][1] : parts[0][2]] not in (b"\x00", b"\x01"):
        return False
    tags = [t for t, _, _ in parts]
    if len(tags) >= 6 and tags[:6] == [0x02] * 6:  # PKCS#1 and DSA: integers only
        return all(t == 0x02 for t in tags)
    if tags[:2] == [0x02, 0x04]:  # SEC1: the secret, then tagged parameters
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: an algorithm with an object identifier, then the key
        algorithm = elements(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_openssh_key(data: bytes) -> bool:
    """Cipher, key derivation, its options, then counted public keys and the private part, to the last byte."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)
    for _ in range(3):
        if at + 8 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    count = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= count <= 16:
        return False
    at += 4
    for _ in range(count + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def decode64(text: str) -> bytes | None:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_openssh_key(data):
        return "ssh"
    return "key" if is_private_key(data) else None


def is_signed_token(text: str) -> bool:
    head = decode64(text.split(".")[0])
    body = decode64(text.split(".")[1])
    try:
        header, claims = json.loads(head or b""), json.loads(body or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three parts joined by dots, from the first ``eyJ`` of a part, whose decoded parts are a header and claims."""
    for run in RUN.finditer(text):
        parts = run[0].split(".")
        at, i = run.start(), 0
        while i + 2 < len(parts):
            begin = parts[i].find("eyJ")
            if begin >= 0 and len(parts[i]) > begin + 3 and parts[i + 1]:
                token = ".".join((parts[i][begin:], parts[i + 1], parts[i + 2]))
                if is_signed_token(token):
                    yield at + begin, at + begin + len(token)
                taken = 3
            else:
                taken = 1
            at += sum(len(p) + 1 for p in parts[i : i + taken])
            i += taken


def armoured_kind(found: re.Match[str]) -> str | None:
    label, headers, body = found.groups()
    data = decode64(re.sub(BREAK, "", body))
    if kind := key_kind(data):
        return kind
    if data and "ENCRYPTED" in headers and CIPHER.search(headers) and len(data) % 8 == 0:
        return "key"
    outer = elements(data, 0, len(data)) if data and "ENCRYPTED" in label else None
    if outer and len(outer) == 1 and outer[0][0] == 0x30:
        parts = elements(data, outer[0][1], outer[0][2]) or []
        algorithm = elements(data, parts[0][1], parts[0][2]) if [t for t, _, _ in parts] == [0x30, 0x04] else None
        if algorithm and algorithm[0][0] == 0x06:
            return "key"
    return None


def wrapped(text: str, first: re.Match[str]) -> tuple[int, str | None]:
    """End and kind of a key whose base64 begins with *first* and goes on over the next lines.

    Lines are only gathered for what begins as a private key does; a line that begins an OpenSSH key ends one.
    """
    end, size, found = first.end(), len(first[0]), [first[0]]
    head = decode64(first[0][:40])
    if not head or first[0].endswith("="):
        return end, None
    need = KEY_BYTES
    if head[0] == 0x30:
        width = head[1] - 0x80
        if not 1 <= width <= 4 or head[2 + width : 4 + width] != b"\x02\x01" or head[4 + width] > 1:
            return end, None
        need = 2 + width + int.from_bytes(head[2 : 2 + width], "big")
        if need > KEY_BYTES:
            return end, None
    elif not first[0].startswith(MAGIC64):
        return end, None
    while size * 3 // 4 < need:
        line = LINE.match(text, end)
        if not line or line[1].startswith(MAGIC64):
            break
        found.append(line[1])
        end, size = line.end(), size + len(line[1].rstrip("="))
        if line[1].endswith("="):
            break
    return end, key_kind(decode64("".join(found)))


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    text = text or ""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    more = {(m.start(), m.end(), kind) for m in ARMOUR.finditer(text) if (kind := armoured_kind(m))}
    bodies = sorted((start, end) for start, end, _ in more)
    for m in ENCODED_ARMOUR.finditer(text):
        inner = (decode64(m[0]) or b"").decode("latin-1")
        if kind := next((k for a in ARMOUR.finditer(inner) if (k := armoured_kind(a))), None):
            more.add((m.start(), m.end(), kind))
    reached = i = 0
    for m in ENCODED.finditer(text):
        while i < len(bodies) and bodies[i][1] <= m.start():
            i += 1
        if m.start() < reached or (i < len(bodies) and bodies[i][0] <= m.start()):
            continue
        end, kind = m.end(), key_kind(decode64(m[0]))
        if not kind:
            end, kind = wrapped(text, m)
        if kind:
            more.add((m.start(), end, kind))
            reached = end
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            more.add((m.start(), m.end(), kind))
    more |= {(start, end, "jwt") for start, end in signed_tokens(text)}
    return sorted([*found, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str | None:
    """The text with every maximal run of overlapping spans replaced by *mark*."""
    if not spans or text is None:
        return text
    out, at, end = [], 0, -1
    for start, stop, _ in spans:
        if start >= end:  # not inside the run before
            if end >= 0:
                at = end
            out += [text[at:start], mark]
            end = stop
        end = max(end, stop)
    return "".join([*out, text[end:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans, all spans."""
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = find_secrets(text.as_py())
                base = [s for s in spans if s[2] in BASE]
                counts = [sum(s[2] == k for s in base) for k in BASE]
                rows.append((*counts, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) if rows else [()] * 6
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The same rows and columns with every secret replaced; texts without one are untouched.

    *length_column*, where present, becomes the length of the new text in those rows.
    """
    place = docs.columns.index(text_column)
    length = docs.columns.index(length_column) if length_column in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(place).to_pylist()
            new = [redact(t, find_secrets(t)) for t in old]
            columns = list(batch.columns)
            columns[place] = pa.array(new, batch.schema.field(place).type)
            if length is not None:
                sizes = batch.column(length).to_pylist()
                sizes = [size if a == b else len(b) for a, b, size in zip(old, new, sizes)]
                columns[length] = pa.array(sizes, batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
