"""SentencePiece encoding and decoding for merge-type models, by backtracking over longest matches."""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixlake.llm.arrowio import plainly_named, slices, texts
from helixlake.plans.staging import ship

SPACE = "▁"
#: Stretches of text whose ids a Python worker keeps, and compatibility answers; when full, they start anew.
CACHE_UNITS = 300_000
#: Characters beyond which a unit is not kept, so that the kept ones are bounded in bytes too.
LONG_UNIT = 64
CACHE_PAIRS = 500_000
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


def _fields(data: bytes):
    """(number, value) of a serialized message's fields."""

    def varint(at):
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return n, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """A merge-type model file: identity normalisation, white space as U+2581, a leading one added, bytes for unknown characters.

    Encoding a stretch: Aho-Corasick gives each place's longest piece. A sequence of pieces is the library's result
    exactly if each adjacent pair, when merged anew from its characters, comes out as that pair. So the search takes
    the longest piece, tries its shorter prefixes while the pair with the piece before is incompatible, and steps back
    where none is left, marking the place in a bitfield so that it is never tried again.

    Text is cut beforehand where no merge can cross: before white space that follows something else, at line feeds and
    at characters that no piece has. That this holds is checked when the model is read.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.piece: list[str] = []
        self.kind: list[int] = []
        score: list[float] = []
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                self.piece.append(got[1].decode())
                score.append(float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kind.append(got.get(3, 1))
        self.id = {p: i for i, p in enumerate(self.piece) if self.kind[i] == 1}
        self.score = {p: score[i] for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.kind[i] == 6}
        self.bos, self.eos = self.piece.index("<s>"), self.piece.index("</s>")
        if len(self.byte) != 256 or any(k not in (1, 2, 3, 6) for k in self.kind):
            raise ValueError("only models with byte fallback and without user-defined pieces are supported")
        letters = {c for p in self.id for c in p}
        if any(c not in self.id for c in letters) or any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id):
            raise ValueError("this model's pieces cross the places where text is cut")
        self.letters = letters
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}  # no merge crosses any other two characters
        self.lookup = ahocorasick.Automaton()
        for p in self.id:
            self.lookup.add_word(p, p)
        self.lookup.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), None) for p in self.id}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.units: dict[str, bytes] = {}
        # for decoding: the bytes of each id, one after another
        flat = [b"" if k == 3 else bytes([int(p[3:5], 16)]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(self.piece, self.kind, strict=True)]
        self.bytes = flat
        self.control = np.asarray(self.kind) == 3
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.flat_len = np.asarray([len(x) for x in flat], np.int64)
        self.flat_at = np.cumsum(self.flat_len) - self.flat_len

    def merged(self, text: str) -> list[str]:
        """Pieces by plain merging: best score first, leftmost of equals. Used on one or two pieces only."""
        parts = list(text)
        score = self.score
        while True:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                s = score.get(a + b)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: str | None, b: str) -> bool:
        if a is None:
            ok = self.alone.get(b)
            if ok is None:
                ok = self.alone[b] = self.merged(b) == [b]
            return ok
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs = {}
            ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def _backtrack(self, text: str) -> list[str]:
        """text has only characters that are pieces."""
        longest: list[str] = [""] * len(text)
        for end, p in self.lookup.iter(text):
            at = end + 1 - len(p)
            if len(p) > len(longest[at]):
                longest[at] = p
        out: list[str] = []
        at, failed, n = 0, 0, len(text)
        p: str | None = longest[0]
        while at < n:
            last = out[-1] if out else None
            while p is not None and (failed >> (at + len(p)) & 1 or not self._fits(last, p)):
                p = self.shorter[p]
            if p is not None:
                out.append(p)
                at += len(p)
                p = longest[at] if at < n else None
            else:
                failed |= 1 << at
                p = out.pop()
                at -= len(p)
                p = self.shorter[p]
        return out

    def _unit(self, text: str) -> bytes:
        ids: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.letters:
                if start < i:
                    ids += [self.id[p] for p in self._backtrack(text[start:i])]
                ids += [self.byte[b] for b in c.encode()]
                start = i + 1
        if start < len(text):
            ids += [self.id[p] for p in self._backtrack(text[start:])]
        return np.asarray(ids, "<u4").tobytes()

    def _known(self, unit: str) -> bytes:
        got = self.units.get(unit)
        if got is None:
            if len(self.units) >= CACHE_UNITS:
                self.units = {}
            cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.joined]  # such as before a comma after a word
            if cuts:
                got = b"".join(self._whole(unit[a:b]) for a, b in pairwise([0, *cuts, len(unit)]))
            else:
                got = self._unit(unit)
            if len(unit) <= LONG_UNIT:
                self.units[unit] = got
        return got

    def _whole(self, part: str) -> bytes:
        """A unit, or a part of one, that has no place to cut."""
        got = self.units.get(part)
        if got is None:
            if len(self.units) >= CACHE_UNITS:
                self.units = {}
            got = self._unit(part)
            if len(part) <= LONG_UNIT:
                self.units[part] = got
        return got

    def encode(self, text: str) -> bytes:
        """All ids of a text with begin and end, as little-endian unsigned 32-bit integers."""
        head, tail = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        if not text:
            return head + tail
        if "  " in text or SPACE in text or " \n" in text or text[0] == " " or text[-1] == " ":
            parts = _UNITS.findall(SPACE + text.replace(" ", SPACE))
        else:  # no stretch of white space: each word has its own
            parts = [(SPACE + w) if w[0] != "\n" else w for w in text.replace("\n", " \n").split(" ") if w]
            if text[0] == "\n":
                parts.insert(0, SPACE)
        try:
            return head + b"".join(map(self.units.__getitem__, parts)) + tail
        except KeyError:
            return head + b"".join(map(self._known, parts)) + tail

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """The UTF-8 texts of encoded documents."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        lens = self.flat_len[flat]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.flat_at[flat] - (ends - lens), lens)
        data = self.flat[at].tobytes()
        out, start, k = [], 0, 0
        for x in ids:
            k += len(x) // 4
            end = int(ends[k - 1]) if k else 0
            out.append(self._clean(data[start:end], x))
            start = end
        return out

    def _clean(self, data: bytes, ids: bytes) -> bytes:
        """Without the added white space; bytes that are no UTF-8 become U+FFFD, one for each. Control ids part them."""
        one = np.frombuffer(ids, "<u4")
        if self.control[one[1:-1]].any():
            parts, run = [], []
            for i in [*one.tolist(), self.eos]:
                if self.kind[i] == 3:
                    parts.append(_utf8(b"".join(self.bytes[j] for j in run)))
                    run = []
                else:
                    run.append(i)
            data = b"".join(parts)
        first = next((i for i in map(int, one) if not self.control[i]), None)
        return _utf8(data[1:] if first is not None and self.piece[first].startswith(SPACE) else data)

    def decode(self, ids: list[int]) -> str:
        return self.decode_all([np.asarray(ids, "<u4").tobytes()])[0].decode()


def _utf8(data: bytes) -> bytes:
    out = b""
    while data:
        try:
            data.decode()
            return out + data
        except UnicodeDecodeError as e:
            out, data = out + data[: e.start] + b"\xef\xbf\xbd", data[e.start + 1 :]
    return out


_loaded: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def _code(path: str, names: list[str], outputs: tuple[str, ...]):
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches):
        model = load(path)
        for batch in batches:
            for part in slices(batch):
                ids = [model.encode(t) for t in texts(part)]
                back = model.decode_all(ids)
                made = {
                    "ids": lambda ids=ids: [np.frombuffer(x, "<i4") for x in ids], "decoded": lambda back=back: [x.decode() for x in back], "n_tokens": lambda ids=ids: [len(x) // 4 for x in ids],
                    "ids_sha256": lambda ids=ids: [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": lambda back=back: [hashlib.sha256(x).hexdigest() for x in back],
                }
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(made[o](), kinds[o]) for o in outputs], names=[*names, *outputs])

    return run


def encode_decode(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode docs.text with begin and end ids and decode the ids again.

    Result: docs' columns without text, and the outputs asked for: ids array<int>, decoded string, n_tokens long,
    ids_sha256, decoded_sha256 string (of the ids' bytes, of the text's). Columns of docs named so are replaced.
    A null text is empty: begin and end ids, decoded to an empty text. Other nulls, repeated rows and further columns
    stay as they are; an empty table gives an empty result. Whole texts are encoded, of any length.
    """
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    docs, named = plainly_named(docs.drop(*outputs))
    names = [c for c in docs.columns if c != "text"]
    ddl = {"ids": "array<int>", "n_tokens": "long"}
    schema = T.StructType(docs.select(*names).schema.fields + T.StructType.fromDDL(", ".join(f"{o} {ddl.get(o, 'string')}" for o in outputs)).fields)
    return named(docs.mapInArrow(_code(model_path, names, tuple(outputs)), schema))
