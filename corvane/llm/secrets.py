"""Operator 8: secret scan with structural confirmation.

Three base patterns find assignments, access key ids and long hex runs. Beside them, base64 and hex
candidates are decoded and reported only if their bytes have the structure of a key or signed token:

* jwt: three base64url parts of which the first decodes to a JSON object with a string `alg`, the second
  to a JSON object;
* der_key: bytes that are one DER SEQUENCE whose nested lengths fill it exactly, and whose first elements
  are those of a PKCS#1, PKCS#8 (plain or encrypted) or EC private key, or of a public key; in base64 or base64url (with or
  without armour and line breaks, indented or escaped) or hex;
  the length of the SEQUENCE tells where it ends, whatever text follows;
* ssh_key: the magic of an OpenSSH private key and its length-prefixed fields, or a public key or certificate blob of a
  known type with the fields of that type.

A candidate is decoded once, from front to back, as far as its own lengths say, so a text takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, require

# The base patterns. ASCII letters of keywords in either case.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "der_key", "ssh_key")
KEYWORDS = ("passw", "secret", "token", "api")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.ey[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: How a key in base64 or base64url starts, also after a slash or an escaped line break; its first line; and what
#: continues it: line breaks (plain, escaped as in JSON, or after a backslash), indented or not.
BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+])|(?<=\\[nrt]))(?:M|b3Bl|AAAA)[A-Za-z0-9+/_-]{30}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
NEXT_LINE = re.compile(r"[\x20\t]*(?:(?:\\+r)?\\+n|\\?\r?\n)[\x20\t]*([A-Za-z0-9+/_-]+)")
PADDING = re.compile(r"={0,2}")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}")
SSH_MAGIC = b"openssh-key-v1\x00"
#: What follows the type in public key blobs: 0 for a length-prefixed field, else a number of plain bytes.
_PLAIN = {
    b"ssh-ed25519": [0], b"ssh-rsa": [0, 0], b"ssh-dss": [0] * 4, b"ecdsa-sha2-nistp256": [0, 0], b"ecdsa-sha2-nistp384": [0, 0], b"ecdsa-sha2-nistp521": [0, 0],
    b"sk-ssh-ed25519@openssh.com": [0, 0], b"sk-ecdsa-sha2-nistp256@openssh.com": [0, 0, 0],
}
#: Certificates: a nonce, the key's own fields, serial number and kind, id, principals, the times from and to which they
#: hold, options, extensions, a reserved field, the authority's key and its signature.
_CERTIFIED = {name.split(b"@")[0] + b"-cert-v01@openssh.com": [0, *layout, 8, 4, 0, 0, 8, 8, 0, 0, 0, 0, 0] for name, layout in _PLAIN.items()}
SSH_LAYOUTS = _PLAIN | _CERTIFIED
#: Bytes of the largest key, or field of one, and keys in a private key's file, far beyond what programs accept (RSA of
#: 16,384 bits: 9 kB; one key). What claims more is no key.
MOST_KEY, MOST_KEYS = 1 << 16, 1 << 10

#: Object identifiers of key algorithms: rsaEncryption, ecPublicKey, X25519, Ed25519, dsa; and of what encrypts keys:
#: PBES2, and the start of those of PKCS#5 and PKCS#12.
KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b656e", "2b6570", "2a8648ce380401")}
CIPHER_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01"))


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the element at `at`; None if its length is malformed or passes `end`."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill data[at:end] exactly, else None."""
    out = []
    while at < end:
        if (item := der_item(data, at, end)) is None:
            return None
        out.append(item)
        at = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    top = der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or not (items := der_children(data, top[1], top[2])):
        return False
    tags = [t for t, _, _ in items]
    if len(items) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1: version and eight integers
        return True

    def algorithm(item) -> bool:
        inner = der_children(data, item[1], item[2]) if item[0] == 0x30 else None
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]] in KEY_OIDS

    if tags[:3] == [0x02, 0x30, 0x04] and algorithm(items[1]):  # PKCS#8
        return True
    if tags[:2] == [0x02, 0x04] and data[items[0][1] : items[0][2]] == b"\x01" and 16 <= items[1][2] - items[1][1] <= 66:  # EC private key
        return True
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        inner = der_children(data, items[0][1], items[0][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(CIPHER_OIDS) and items[1][2] - items[1][1] >= 16
    if tags == [0x02, 0x02]:  # PKCS#1 public key: a modulus of 512 bits at least, and a small odd exponent
        modulus, exponent = (x[2] - x[1] for x in items)
        return modulus >= 64 and 1 <= exponent <= 5 and data[items[1][2] - 1] & 1 == 1
    return tags == [0x30, 0x03] and algorithm(items[0])  # public key


def decoded64(x: str) -> bytes:
    x = "".join(x.split()).rstrip("=")
    if len(x) % 4 == 1:
        return b""
    try:
        return base64.urlsafe_b64decode(x.replace("+", "-").replace("/", "_") + "=" * (-len(x) % 4))
    except (ValueError, binascii.Error):
        return b""


class Folded:
    """The bytes of a base64 candidate, decoded once from front to back, as far as they are asked for."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.at, self.stop = text, start, end  # what comes next of the line at hand
        self.data, self.rest, self.whole = bytearray(), "", False
        self.lines = [(0, start, end)]  # characters before a line, its start and its end

    def _next_line(self) -> bool:
        m = NEXT_LINE.match(self.text, self.stop)
        if m is None:
            self.whole = True
            return False
        before, start, end = self.lines[-1]
        self.at, self.stop = m.span(1)
        self.lines.append((before + end - start, self.at, self.stop))
        return True

    def first(self, n: int) -> bytearray | None:
        """All bytes decoded so far, n at least; None if there are fewer."""
        while len(self.data) < n:
            if self.at == self.stop and not self._next_line():
                self._end()
                return self.data if len(self.data) >= n else None
            end = min(self.stop, self.at + max(64, (n - len(self.data)) * 4 // 3 + 4))
            piece = self.rest + self.text[self.at : end]
            self.at, whole = end, len(piece) // 4 * 4
            self.rest = piece[whole:]
            self.data += base64.urlsafe_b64decode(piece[:whole].replace("+", "-").replace("/", "_"))
        return self.data

    def _end(self) -> None:
        """The bytes of two or three characters that are left when all lines are read."""
        if len(self.rest) > 1:
            self.data += base64.urlsafe_b64decode((self.rest + "==").replace("+", "-").replace("/", "_")[:4])
        self.rest = ""

    def end(self, n: int) -> int | None:
        """Where the text of the first n bytes ends, padding included; None if base64 goes on in that line."""
        need = (4 * n + 2) // 3
        before, start, end = self.lines[bisect.bisect_left(self.lines, (need,)) - 1]
        at = start + need - before
        return None if at > end or (at < end and self.text[at] not in "-_") else PADDING.match(self.text, at).end()

    def rest_of_lines(self) -> int:
        """Where the last line ends, padding included."""
        while not self.whole:
            self._next_line()
        return PADDING.match(self.text, self.stop).end()


def der_end(key: Folded) -> int | None:
    head = key.first(2)
    if head is None or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80 or (head := key.first(3 + n)) is None or head[2 + n] not in (0x02, 0x30):
        return None
    total = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    data = key.first(total) if total <= MOST_KEY else None
    return key.end(total) if data is not None and is_der_key(bytes(data[:total])) else None


def _field(key: Folded, at: int, most: int) -> int | None:
    """Where the length-prefixed field at `at` ends; None if it isn't all there or has over `most` bytes."""
    data = key.first(at + 4)
    size = most + 1 if data is None else int.from_bytes(data[at : at + 4], "big")
    return None if size > most or key.first(at + 4 + size) is None else at + 4 + size


def private_end(key: Folded) -> int | None:
    """The end of an OpenSSH private key: its magic, cipher, key derivation and its options, then public keys and the
    private part. One that is cut off after these first fields ends with its lines."""
    at = len(SSH_MAGIC)
    for most in (64, 64, 1024):
        if at is not None:
            at = _field(key, at, most)
    count = None if at is None else key.first(at + 4)
    keys = 0 if count is None else int.from_bytes(count[at : at + 4], "big")
    if not 1 <= keys <= MOST_KEYS or key.first(at + 8) is None:
        return None
    at, left = at + 4, keys + 1
    while at is not None and left:
        at, left = _field(key, at, MOST_KEY), left - 1
    return (None if at is None else key.end(at)) or key.rest_of_lines()


def ssh_end(key: Folded) -> int | None:
    head = key.first(len(SSH_MAGIC))
    if head is not None and head.startswith(SSH_MAGIC):
        return private_end(key)
    size = int.from_bytes(head[:4], "big") if head is not None else 0
    if not 7 <= size <= 64 or (data := key.first(4 + size)) is None:
        return None
    layout = SSH_LAYOUTS.get(bytes(data[4 : 4 + size]))
    if layout is None:
        return None
    at = 4 + size
    for raw in layout:
        at = _field(key, at, MOST_KEY) if raw == 0 else (at + raw if key.first(at + raw) is not None else None)
        if at is None:
            return None
    return key.end(at)


def json_object(part: str) -> dict | None:
    try:
        found = json.loads(decoded64(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in order of start, then kind."""
    out = []
    low = text.lower() if not text.isascii() else text.translate(_LOWER)
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


_LOWER = {i: i + 32 for i in range(65, 91)}
_RANK = {k: i for i, k in enumerate(KINDS)}


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], _RANK[span[2]], span[1]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded bytes have the structure of a key or signed token."""
    out = []
    if ".ey" in text:
        for m in TOKEN.finditer(text):
            head, body, _ = m[0].split(".", 2)
            found = json_object(head)
            if found is not None and isinstance(found.get("alg"), str) and json_object(body) is not None:
                out.append((m.start(), m.end(), "jwt"))
    m, line_end = BASE64.search(text), 0
    while m:
        if m.start() >= line_end:
            line_end = LINE.match(text, m.start()).end()
        key, stop = Folded(text, m.start(), line_end), None
        for kind, ending in (("der_key", der_end), ("ssh_key", ssh_end)):
            if (stop := ending(key)) is not None:
                out.append((m.start(), stop, kind))
                break
        # what follows a slash, and lines after one that isn't a key, may hold one of their own
        m = BASE64.search(text, m.start() + 1 if stop is None else stop)
    for m in HEX_DER.finditer(text):
        data = bytes.fromhex(m[0][: len(m[0]) // 2 * 2])
        if (top := der_item(data, 0, len(data))) and is_der_key(data[: top[2]]):
            out.append((m.start(), m.start() + 2 * top[2], "der_key"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SPAN = "struct<kind:string,start:int,end:int,found:string>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, spans (array of kind, start, end, found; code points, end exclusive).

    Whole texts are scanned; a null or empty text has no spans; repeated rows stay; an empty table gives an
    empty result. Other columns are not read. Spans are in order of start, then kind, then end.
    """
    require(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.string())]))

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                x = x or ""
                out.append([{"kind": k, "start": a, "end": b, "found": x[a:b]} for a, b, k in sorted(base_spans(x) + confirmed_spans(x), key=_order)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of `scan`'s result: doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(line(base), "utf-8"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
