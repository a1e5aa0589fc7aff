"""Secret scans with structural confirmation.

Plain patterns find assignments, access keys and hex runs. Beyond them, runs of base64 or hex are decoded and only reported
when what they hold parses as a secret:

- `pem`: a PEM block of a private key whose body decodes to a key (below), or to one that its headers call encrypted.
- `key`: a base64 or hex run that is a key by itself: a DER SEQUENCE whose nested lengths fill each other without rest and
  whose fields are those of an RSA, EC, DSA, PKCS #8 or encrypted PKCS #8 private key; or the binary form of an OpenSSH
  private key, whose length-prefixed strings fill the block; or the base64 form of such a PEM block.
- `jwt`: three base64url parts, of which the first is a JSON object with a known `alg` and the second a JSON object, and
  whose third has the length of a signature of that algorithm.

Certificates, public keys, digests, random base64 and unsigned tokens parse as none of these and aren't reported. A span runs
over the characters of the candidate (for `pem` with its armour), counted in code points, end exclusive.

Defined cases: null text counts as empty; an empty text has no span. Runs that are cut off or have a rest don't parse. Rows
that repeat one id are scanned each for itself, and null ids stay null. An empty table gives an empty result. Texts are
scanned whole, one at a time; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of the plain patterns and those of the structural scan, in the order of spans that start alike.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "key", "jwt")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----(\s*(?:[A-Za-z-]+: [^\n]*\n)*[A-Za-z0-9+/=\s]*)-----END \1PRIVATE KEY-----", re.A)
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?![A-Za-z0-9_-])")
#: A DER SEQUENCE starts as MI.. to MH.. in base64 and as 30 in hex, an OpenSSH key as b3BlbnNzaC1rZXktdjE, PEM as LS0tLS1CRUdJTi.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:M[A-P]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{30,}={0,2}(?![A-Za-z0-9+/_=-])")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd])[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")

#: Least and greatest bytes of a signature.
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114),
    "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024), "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024),
}
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
SSH_MAGIC = b"openssh-key-v1\0"


def fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER values that stand one after another; None unless their lengths, in shortest form, fill data."""
    at, out = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or (length := int.from_bytes(data[at : at + n])) < (0x80 if n == 1 else 1 << 8 * (n - 1)):
                return None
            at += n
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def _algorithm(content: bytes) -> bool:
    inner = fields(content)
    return bool(inner) and inner[0][0] == OID and len(inner[0][1]) >= 3


def der_key(data: bytes) -> bool:
    """Whether data is one DER private key without rest."""
    outer = fields(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    parts = fields(outer[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [tag for tag, _ in parts]
    if tags[0] == SEQUENCE:  # encrypted: algorithm, octets
        return tags == [SEQUENCE, OCTETS] and _algorithm(parts[0][1]) and len(parts[1][1]) >= 16
    if tags[0] != INTEGER:
        return False
    version = parts[0][1]
    if tags[1:3] == [SEQUENCE, OCTETS]:  # version, algorithm, key, perhaps attributes
        return version in (b"\0", b"\1") and _algorithm(parts[1][1]) and len(parts[2][1]) >= 16
    if tags[1] == OCTETS:  # version 1, a scalar, perhaps curve and point
        return version == b"\1" and 20 <= len(parts[1][1]) <= 72 and all(tag in (0xA0, 0xA1) for tag in tags[2:])
    if set(tags) == {INTEGER} and version == b"\0" and len(parts) == 9:  # modulus, exponents, primes, coefficient
        n, _, d, p, q = (int.from_bytes(content) for _, content in parts[1:6])
        return n == p * q and 0 < d < n
    return set(tags) == {INTEGER} and version == b"\0" and len(parts) == 6 and len(parts[1][1]) >= 64  # p, q, g, y, x


def ssh_key(data: bytes) -> bool:
    """Whether data is one OpenSSH private key: its strings fill it."""
    if not data.startswith(SSH_MAGIC):
        return False
    at, parts = len(SSH_MAGIC), []

    def string() -> bytes | None:
        nonlocal at
        length = int.from_bytes(data[at : at + 4])
        if at + 4 + length > len(data):
            return None
        at += 4 + length
        return data[at - length : at]

    for _ in range(3):  # cipher, derivation, its options
        parts.append(string())
    if None in parts or not parts[0] or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if not 1 <= keys <= 16:
        return False
    parts = [string() for _ in range(keys + 1)]  # public keys, private part
    return None not in parts and len(parts[-1]) >= 16 and at == len(data)


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 or base64url run, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def private_key(data: bytes) -> bool:
    """Whether data is a private key in binary form or in a PEM block."""
    if data.startswith(b"-----BEGIN "):
        found = _PEM.search(data.decode("latin-1"))
        return found is not None and pem_key(found)
    return ssh_key(data) or der_key(data)


def pem_key(block: re.Match) -> bool:
    body = block[2]
    headers = [line for line in body.split("\n") if ":" in line]
    data = decoded("".join("".join(line.split()) for line in body.split("\n") if ":" not in line))
    if data is None:
        return False
    if any("ENCRYPTED" in line for line in headers):  # old form: the body is a cipher's blocks
        return len(data) >= 32 and len(data) % 8 == 0
    return private_key(data)


def signed_token(run: str) -> bool:
    head, claims, signature = (decoded(part) for part in run.split("."))
    if head is None or claims is None or signature is None:
        return False
    try:
        head, claims = json.loads(head), json.loads(claims)
    except (ValueError, RecursionError):
        return False
    least, most = SIGNATURES.get(str(head.get("alg")), (1, 0)) if isinstance(head, dict) and isinstance(claims, dict) else (1, 0)
    return least <= len(signature) <= most


def spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of all findings, by start, then kind in the order of KINDS."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    blocks = [m.span() for m in _PEM.finditer(text) if pem_key(m)]
    found += [(*s, 3) for s in blocks]
    for m in _BASE64.finditer(text):
        if (data := decoded(m[0])) and private_key(data) and not any(a <= m.start() < b for a, b in blocks):
            found.append((*m.span(), 4))
    for m in _HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and private_key(bytes.fromhex(m[0])):
            found.append((*m.span(), 4))
    found += [(*m.span(), 5) for m in _JWT.finditer(text) if signed_token(m[0])]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        rows = []
        for i in range(len(texts)):  # one text at a time becomes a Python string
            rows.append([{"kind": k, "start": a, "end": b} for a, b, k in spans(texts[i].as_py() or "")])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, SPANS)], names=["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end), for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every stretch of text that lies in some span replaced by the mark."""
    if "text" not in docs.columns:
        raise ValueError("docs needs a column text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for i in range(batch.num_rows):
                text, parts, end = batch.column(at)[i].as_py(), [], 0
                for a, b, _ in spans(text or ""):
                    if a >= end:
                        parts += [text[end:a], mark]
                    end = max(end, b)
                texts.append("".join([*parts, text[end:]]) if parts else text)
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
