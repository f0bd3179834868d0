"""Secret scans with structural confirmation.

Patterns propose spans. The base kinds (assign, access, hex) are reported as they match. Other
candidates are decoded from base64 or hex first, and reported only if the bytes are what they claim to
be: a key in DER whose nested lengths fit exactly, an OpenSSH key container, or a signed token whose header
and payload are JSON objects.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm.common import ship, text_slices

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "token", "pem", "key64", "keyhex")
_ASSIGN = re.compile("""(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: One of these stands in every assignment, in lower case.
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: The shortest header of a signed token, {"alg":""}, has so many characters.
_HEADER_CHARS = 14
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
#: Line ends as string literals write them.
_ESCAPED = re.compile(r"\\+[nrt]")
_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*):[\x20\t]*(.*)")
_DEK = re.compile(r"([A-Z0-9-]+),([0-9A-Fa-f]+)")
#: How base64 of a DER sequence, of an OpenSSH container, of a PEM line and of either in base64 again begins.
_BEFORE = r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[A-P]|b3Bl|LS0tLS1C|T[UVW]|YjNCb)"
_KEY64 = (re.compile(_BEFORE + r"[A-Za-z0-9+/]{38,}={0,2}(?![A-Za-z0-9+/=])"), re.compile(_BEFORE + r"[A-Za-z0-9_-]{38,}={0,2}(?![A-Za-z0-9_=-])"))
_KEYHEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?(30(?:[0-9a-f]{62,}|[0-9A-F]{62,}))(?![0-9A-Za-z])")


def der(data: bytes, at: int = 0, depth: int = 0) -> tuple[int, int, int] | None:
    """(tag, where the contents begin, where they end) of the DER value at `at`, or None."""
    if depth > 16 or at + 2 > len(data):
        return None
    tag, size, begin = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or begin + n > len(data) or data[begin] == 0:
            return None
        size, begin = int.from_bytes(data[begin : begin + n], "big"), begin + n
        if size < 0x80:
            return None
    return (tag, begin, begin + size) if begin + size <= len(data) else None


def children(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill [begin, end) exactly, or None."""
    out = []
    while begin < end:
        value = der(data[:end], begin)
        if value is None or len(out) > 64:
            return None
        out.append(value)
        begin = value[2]
    return out


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are wholly a PKCS#1, PKCS#8 (also encrypted) or SEC1 private key in DER."""
    top = der(data)
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:  # encrypted: algorithm, then the key as octets
        algorithm = children(data, parts[0][1], parts[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[1][2] - parts[1][1] >= 16
    if tags[0] != 0x02 or data[parts[0][1] : parts[0][2]] not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [0x30, 0x04]:  # version, algorithm, key
        algorithm = children(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[2][2] - parts[2][1] >= 16
    if tags[1:2] == [0x04]:  # version, key of an elliptic curve, then tagged parts
        return 16 <= parts[1][2] - parts[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return len(tags) >= 6 and all(t == 0x02 for t in tags) and parts[1][2] - parts[1][1] >= 32  # numbers of an RSA or DSA key


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH key container whose length-prefixed fields fit."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), []
    for k in range(5):  # cipher, kdf, its options, then the number of keys, then a public key
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if k == 3:
            if n < 1:
                return False
            continue
        if at + n > len(data):
            return False
        fields.append(data[at : at + n])
        at += n
    return bool(fields[0]) and fields[0].isascii() and at + 4 <= len(data) and int.from_bytes(data[at : at + 4], "big") + at + 4 <= len(data)


def from_base64(text: str) -> bytes | None:
    """Decoded bytes, from either alphabet, with or without padding; None if it is no base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(text: str) -> bool:
    header, payload, signature = text.split(".")
    try:
        top, claims = (json.loads(from_base64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(top, dict) and isinstance(top.get("alg"), str) and isinstance(claims, dict) and (top["alg"].lower() == "none" or from_base64(signature) not in (None, b""))


def _is_key(data: bytes | None, depth: int = 0) -> bool:
    """Whether the bytes are a key, or base64 or PEM text of one, encoded at most twice again."""
    if data is None or is_private_key(data) or is_openssh_key(data):
        return data is not None
    if depth > 1 or len(data) < 40 or not data.isascii():
        return False
    text = data.decode().strip()
    pem = _PEM.fullmatch(text)
    return is_pem_key(pem[2]) if pem else _is_key(from_base64("".join(text.split())), depth + 1)


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the signed tokens: three parts with a dot between, of which the first begins with eyJ (its first or
    its last one in that part). Each part is decoded a bounded number of times, whatever the text."""
    for run in _DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, k = run[0].split("."), run.start(), 0
        while k + 2 < len(parts):
            step = 1
            for begin in dict.fromkeys((parts[k].find("eyJ"), parts[k].rfind("eyJ"))):
                if begin >= 0 and len(parts[k]) - begin >= _HEADER_CHARS and is_signed_token(".".join([parts[k][begin:], *parts[k + 1 : k + 3]])):
                    yield at + begin, at + sum(map(len, parts[k : k + 3])) + 2
                    step = 3
                    break
            at += sum(len(p) + 1 for p in parts[k : k + step])
            k += step


def is_pem_key(body: str) -> bool:
    """Whether what stands between the lines of a PEM block is a key. Line ends may be escaped, and headers may
    stand first. A body that its headers say is encrypted must be whole blocks of the cipher that they name."""
    lines = _ESCAPED.sub("\n", body).replace("\\/", "/").strip().splitlines()
    headers: dict[str, str] = {}
    while lines and (m := _HEADER.fullmatch(lines[0].strip())):
        headers[m[1].lower()] = m[2].strip()
        lines.pop(0)
    data = from_base64("".join("".join(lines).split()))
    if _is_key(data):
        return True
    dek = _DEK.fullmatch(headers.get("dek-info", ""))
    if not data or not dek or not headers.get("proc-type", "").replace(" ", "").endswith(",ENCRYPTED"):
        return False
    block = 16 if dek[1].startswith(("AES", "CAMELLIA", "ARIA", "SEED")) else 8
    return len(data) >= 32 and len(data) % block == 0 and len(dek[2]) == 2 * block


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of all spans, in order; code points, end exclusive."""
    out: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    # what the other patterns find holds no white space
    longest = max(map(len, text.split()), default=0)
    if longest >= 24:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += [(a, 3, b) for a, b in signed_tokens(text)]
    whole: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        whole = [m.span() for m in _PEM.finditer(text) if is_pem_key(m[2])]
        out += [(a, 4, b) for a, b in whole]
    keys: set[tuple[int, int, int]] = set()
    if longest >= 40:
        keys |= {(m.start(), 5, m.end()) for pattern in _KEY64 for m in pattern.finditer(text) if _is_key(from_base64(m[0]))}
    if longest >= 64 and "30" in text:
        keys |= {(m.start(), 6, m.end()) for m in _KEYHEX.finditer(text) if len(m[1]) % 2 == 0 and _is_key(bytes.fromhex(m[1]))}
    # what stands within a PEM block is that key, not another one
    starts = [a for a, _ in whole]
    out += [x for x in keys if not (k := bisect_right(starts, x[0])) or x[2] > whole[k - 1][1]]
    return sorted(out)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_assign, n_access, n_hex (base spans), base_sha256 (of the base spans as
    kind:start:end, joined by commas), spans (all spans, joined likewise).

    No shuffle. A null or empty text has no spans. Null or repeated ids and repeated rows pass through row by row; other
    columns are not read. Spans of different kinds may overlap. Empty tables give none.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, 1):
                found = [scan(t) for t in texts]
                base = [[x for x in spans if x[1] < 3] for spans in found]
                columns = [batch.column(0).slice(start, len(texts))]
                columns += [pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in range(3)]
                columns += [pa.array([hashlib.sha256(_listed(s).encode()).hexdigest() for s in base], pa.string()), pa.array([_listed(s) for s in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
