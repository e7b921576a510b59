"""Secret scan: patterns, then structural confirmation of encoded keys and signed tokens."""

from __future__ import annotations

import binascii
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.arrowio import plainly_named, slices, texts
from helixlake.plans.staging import ship

#: In this order where spans start at the same place.
KINDS = ("assign", "access", "hex", "token", "key")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Dotted parts; the first with what follows it. Possessive, and tried at the start of a run only, so that a run is read once for
#: each place that it can have.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)(?=\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]++)(\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?)")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:(?:\s|\\[rn])*[A-Za-z][A-Za-z0-9-]*:[^\n\\]*(?:\n|\\[rn]))*)([A-Za-z0-9+/=\s\\]+)-----END \1-----")
#: How an encoded DER sequence or OpenSSH container starts, after whatever else, and what parts lines.
_FIRST = re.compile(r"M[A-P](?=[A-Za-z0-9+/_-]{14})|b3BlbnNzaC1rZXkt(?=[A-Za-z0-9+/_-])")
_NEXT = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*(?=[A-Za-z0-9+/_-])")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_PAD = re.compile(r"={0,2}")
_HEX_KEY = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=0x))[0-9A-Fa-f]{64,}(?![0-9A-Za-z])")
_CIPHER = re.compile(r"DEK-Info:[ \t]*([A-Za-z0-9-]+),([0-9A-Fa-f]+)")
#: Bytes that a key can have: RSA keys of 16,384 bits have some 9,000.
MAX_KEY = 1 << 15
#: Most parts of a key's outer sequence: the numbers of an RSA key of many primes.
_PARTS = 10
#: Schemes of password-based encryption, as object identifiers start.
_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def unbase64(s: str) -> bytes | None:
    """Decode plain or URL-safe base64, padded or not; None if it is neither."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return binascii.a2b_base64(s + "=" * (-len(s) % 4), strict_mode=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end of the value) of a DER element at `at`, if its length is well formed and stays within `end`."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _start(letters: str) -> bytes:
    """Decode letters that may end anywhere."""
    return unbase64(letters[: len(letters) - (len(letters) % 4 == 1)]) or b""


class Encoded:
    """Bytes in base64 letters, of which only the first few and those asked for are decoded."""

    def __init__(self, letters: str, at: int, length: int):
        self.letters, self.at, self.length = letters, at, length
        self.start = _start(letters[at : at + 128])[:length]

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, k):
        if not isinstance(k, slice):
            return self.start[k] if k < len(self.start) else self[k : k + 1][0]
        a, b, _ = k.indices(self.length)
        if b <= len(self.start):
            return self.start[a:b]
        if a >= b:
            return b""
        first = a // 3
        return _start(self.letters[self.at + 4 * first : self.at + 4 * -(-b // 3)])[a - 3 * first : b - 3 * first]


def _elements(data, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements from at to end; None if they don't fit, or are more than any key has."""
    out = []
    while at < end:
        if len(out) == _PARTS or not (e := _der(data, at, end)):
            return None
        out.append(e)
        at = e[2]
    return out


_MAGIC = b"openssh-key-v1\0"


def _container_length(data) -> int | None:
    """Bytes of an OpenSSH container up to its private block's end, from the lengths that it tells: cipher, kdf, its options,
    count, public keys, private block."""
    at = len(_MAGIC)
    for _ in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16:
        return None
    for _ in range(count + 1):
        if at > MAX_KEY or at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= MAX_KEY else None


def is_private_key(data, at: int = 0, end: int | None = None) -> bool:
    """Whether the bytes are wholly one private key: PKCS#1, PKCS#8, SEC1, DSA (DER, nested lengths all fitting, numbers of
    possible sizes) or the OpenSSH container."""
    if not data:
        return False
    end = len(data) if end is None else end
    if at == 0 and data[: len(_MAGIC)] == _MAGIC:
        return _container_length(data) == end
    top = _der(data, at, end)
    if not top or top[0] != 0x30 or top[2] != end or not (parts := _elements(data, top[1], top[2])):
        return False
    tags = [t for t, _, _ in parts]
    sizes = [b - a for _, a, b in parts]
    if tags[:1] != [0x02] or sizes[0] != 1 or (version := data[parts[0][1]]) > 1:
        return False
    if tags[:9] == [0x02] * 9:  # RSA: the two primes make up the modulus
        _, n, _, d, p, q = sizes[:6]
        return tags[9:] in ([], [0x30]) and n >= 64 and d >= n // 4 and p + q >= n - 2 and min(p, q) >= n // 8
    if tags[1:3] == [0x30, 0x04]:  # algorithm, then the key's octets, then attributes and public key
        return _is_algorithm(data, parts[1]) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) and _is_inner_key(data, *parts[2][1:])
    if tags[1:2] == [0x04] and version == 1:  # curve key
        return all(t in (0xA0, 0xA1) for t in tags[2:]) and 16 <= sizes[1] <= 80
    return tags == [0x02] * 6 and sizes[1] >= 64 and sizes[2] >= 16 and sizes[4] >= 32 and 8 <= sizes[5] <= sizes[2] + 1  # DSA


def _is_algorithm(data, part: tuple[int, int, int]) -> bool:
    inside = _elements(data, part[1], part[2])
    return bool(inside) and inside[0][0] == 0x06 and inside[0][2] > inside[0][1]


def _is_inner_key(data, at: int, end: int) -> bool:
    """The octets of PKCS#8: a key of numbers or of a curve, the octets of an Edwards key, or one number."""
    top = _der(data, at, end)
    if not top or top[2] != end:
        return False
    if top[0] == 0x30:
        parts = _elements(data, top[1], top[2])
        return bool(parts) and parts[0][0] == 0x02 and (is_private_key(data, at, end) or all(t == 0x02 for t, _, _ in parts) and parts[0][2] - parts[0][1] >= 16)
    return top[0] in (0x02, 0x04) and top[2] - top[1] >= 16


def is_encrypted_key(data, known: bool = False) -> bool:
    """Whether the bytes are wholly an encrypted PKCS#8 key: an algorithm with parameters (with `known`, one of password-based
    encryption), then octets."""
    top = _der(data, 0, len(data)) if data else None
    parts = _elements(data, top[1], top[2]) if top and top[0] == 0x30 and top[2] == len(data) else None
    if not parts or [t for t, _, _ in parts] != [0x30, 0x04] or not _is_algorithm(data, parts[0]) or parts[1][2] - parts[1][1] < 16:
        return False
    name = _der(data, parts[0][1], parts[0][2])
    return not known or any(data[name[1] : name[1] + len(x)] == x for x in _SCHEMES)


def _opens(name: str, headers: str, data: bytes | None) -> bool:
    """Whether a PEM body is a key, by its structure. Where headers name a cipher, only whole blocks of it can be asked."""
    if "ENCRYPTED" in name:
        return is_encrypted_key(data)
    if "ENCRYPTED" in headers and (start := _CIPHER.search(headers)):
        block = 16 if start[1].upper().startswith(("AES", "CAMELLIA", "ARIA", "SEED")) else 8
        return bool(data) and len(start[2]) >= 16 and len(data) % block == 0 and 48 <= len(data) <= MAX_KEY
    return is_private_key(data)


def _header(part: str) -> dict | None:
    """The JSON object that a token's first part decodes to, if it names an algorithm."""
    try:
        found = json.loads(unbase64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and isinstance(found.get("alg"), str) else None


def is_signed_token(s: str) -> bool:
    """Whether the header decodes to a JSON object that names an algorithm, and payload (of any kind) and signature decode."""
    head, body, sign = s.split(".")[:3]
    return _header(head) is not None and bool(unbase64(body)) and bool(unbase64(sign))


def is_sealed_token(s: str) -> bool:
    """Whether five parts are an encrypted token: a header that also names the encryption, a key (empty, where it is agreed),
    and vector, text and tag that all decode."""
    head, key, *rest = s.split(".")
    found = _header(head)
    return found is not None and isinstance(found.get("enc"), str) and (not key or bool(unbase64(key))) and len(rest) == 3 and all(map(unbase64, rest)) and len(unbase64(rest[2])) >= 8


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of signed and encrypted tokens. A token may follow other letters at once where its header starts as {" does."""
    out = []
    for m in _DOTTED.finditer(text):
        jumps = {m.start(1), m.start(1) + at if (at := m[1].find("eyJ")) > 0 else m.start(1)}
        for at in sorted(jumps):
            if m[4] and is_sealed_token(text[at : m.end(4)]):
                out.append((at, m.end(4)))
            elif m[2] and is_signed_token(text[at : m.end(3)]):
                out.append((at, m.end(3)))
    return out


def key_length(data) -> int | None:
    """How many bytes the private key has that starts so (in DER its first dozen count, in the OpenSSH container the lengths of
    its parts); None if none does, or none of MAX_KEY bytes or less."""
    if data[: len(_MAGIC)] == _MAGIC:
        return _container_length(data)
    n = data[1] if len(data) > 1 else 0
    k = n & 0x7F if n & 0x80 else 0
    at = 2 + k
    if data[:1] != b"\x30" or k > 4 or data[at : at + 3] not in (b"\2\1\0", b"\2\1\1") and data[at : at + 1] != b"\x30":
        return None
    n = at + (int.from_bytes(data[2:at], "big") if k else n)
    return n if n <= MAX_KEY else None


def encoded_keys(text: str) -> list[tuple[int, int]]:
    """Spans of base64 keys, on one line or over several. Each kind of key tells its length, so what follows it doesn't count.

    Lines of letters that go on are joined once, for all places in them where a key may start; at each place only the bytes
    that tell a key's lengths are decoded, so time is linear in the text whatever it holds.
    """
    out = []
    done = end = 0
    letters, starts, offsets = "", [], []
    for m in _FIRST.finditer(text):
        at = m.start()
        if at < done:
            continue
        if at >= end:
            parts, starts, offsets, have, end = [], [], [], 0, at
            while run := _RUN.match(text, end):
                parts.append(run[0])
                starts.append(run.start())
                offsets.append(have)
                have += len(run[0])
                end = run.end()
                more = _NEXT.match(text, end)
                if not more:
                    break
                end = more.end()
            letters = "".join(parts)
        line = bisect_right(starts, at) - 1
        offset = offsets[line] + at - starts[line]
        room = (len(letters) - offset) * 3 // 4
        head = _start(letters[offset : offset + 20])  # 15 bytes: enough for a DER key
        n = key_length(Encoded(letters, offset, room) if head == _MAGIC else head)
        if not n or n > room:
            continue
        key = Encoded(letters, offset, n)
        sealed = head[0] == 0x30 == head[2 + (head[1] & 0x7F if head[1] & 0x80 else 0)]
        if not (is_encrypted_key(key, known=True) if sealed else is_private_key(key)):
            continue
        last = offset + (4 * n + 2) // 3 - 1
        line = bisect_right(offsets, last) - 1
        done = _PAD.match(text, starts[line] + last - offsets[line] + 1).end()
        out.append((at, done))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start, then kind as listed in KINDS.

    assign, access and hex are the patterns' matches, leftmost and not overlapping for each kind. token and key are
    reported only after their structure is confirmed, and may overlap the others.
    """
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    spans += [("token", *t) for t in tokens(text)] if "." in text else []
    keys = []
    if "PRIVATE KEY-----" in text:
        keys += [m.span() for m in _PEM.finditer(text) if _opens(m[1], m[2], unbase64(re.sub(r"\\[rn]|\s", "", m[3])))]
    keys += encoded_keys(text)
    keys += [m.span() for m in _HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0]))]
    spans += [("key", *s) for s in keys if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in keys)]
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at = [], 0
    last = 0
    for kind, start, end in spans:
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
            last = end
        else:
            last = max(last, end)
    return "".join(out) + text[last:]


def _scan(names: list[str], redacting: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [scan(t) for t in texts(part)]
                cols = {c: part.column(c) for c in names}
                cols["spans"] = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                if redacting:
                    cols["redacted"] = pa.array([t if t is None or not f else redact(t, f) for t, f in zip(part.column("text").to_pylist(), found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def find_secrets(docs: DataFrame, redacting: bool = False) -> DataFrame:
    """Scan docs.text. Result: docs' columns without text, spans array<struct<kind,start,end>>, and with redacting also
    redacted (null for null).

    A null or empty text has no spans. Nulls elsewhere, repeated rows and further columns are kept as they are (those
    named spans or redacted are replaced); an empty table gives an empty result. Whole texts are scanned.
    """
    ship(docs.sparkSession)
    docs, named = plainly_named(docs.drop("spans", "redacted"))
    names = [c for c in docs.columns if c != "text"]
    added = T.StructType.fromDDL("spans array<struct<kind:string,start:bigint,end:bigint>>" + ", redacted string" * redacting)
    schema = T.StructType(docs.select(*names).schema.fields + added.fields)
    return named(docs.mapInArrow(_scan(names, redacting), schema))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and joined strings of the base kinds and of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
