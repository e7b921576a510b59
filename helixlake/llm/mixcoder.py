"""An adaptive context-mixing range coder of ids, many blocks in step.

A block is coded on its own, from a reset model, so that blocks can be read apart and one's damage stays in it. Its distinct
ids are listed first; then each id is one interval of a range coder:

* orders 2 and 1 each name the id that last followed the last two ids, or the last one, with a confidence 0 to 7 that
  grows with hits and falls by two with misses, below which another id is named;
* for each pair of confidences, and whether both name the same id, two adaptive probabilities tell how far order 2 is
  trusted and, where it fails, order 1; the rest of the interval goes to order 0;
* order 0 shares it by how often each id came before in the block, counted anew after 32, 128, 512 ids and each 1024.

Python steps through the places of a block; each step is array work over all blocks of a group, so its cost is shared by
them. Encoder and decoder run the same model on whole numbers only, so the bytes don't depend on the group or the machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"HXI1"
#: Ids of a block, and blocks that are coded in step at most.
BLOCK, LANES = 8192, 1024
#: Numbers kept for distinct ids, over all blocks of a group, at most (a group of one block may have more).
_CELLS = 1 << 22
_BITS0, _BITS = 14, 30
_TOTAL0 = 1 << _BITS0
_SLOTS2 = 1 << 13
_FLOOR, _UNIT = 40, 16
_HEAD = struct.Struct("<4sIIIIQIIII")
_REFRESH = {0, 32, 128, 512, *range(1024, BLOCK, 1024)}
#: Bounds of the probabilities of orders 2 and 1, of 65536: none of the three parts is ever empty.
_LOW2, _HIGH2, _LOW1, _HIGH1, _RATE = 128, 65408, 512, 65024, 4
_TWO, _THREE, _SEVEN, _SIXTEEN = (np.int32(x) for x in (2, 3, 7, 16))


class _Model:
    """The predictions for a group of blocks; lane i codes block i. Lanes are ordered from the longest block to the shortest.

    Tables are small and packed, as most of the time goes to looking up in them: a named id and its confidence in 16 bits,
    both probabilities of a state in 32, and an id's interval of order 0 in 32.
    """

    def __init__(self, distinct: np.ndarray, slots: bool):
        lanes, most = len(distinct), int(distinct.max())
        self.distinct, self.most, self.slotted = distinct, most, slots
        at = np.arange(lanes)
        self.base1, self.base2, self.base_state, self.base_slot = at * most, at * _SLOTS2, at * 128, at << _BITS0
        self.last1, self.last2 = np.zeros(lanes * most, np.uint16), np.zeros(lanes * _SLOTS2, np.uint16)
        trust = np.array([2000, 16000, 30000, 40000, 48000, 54000, 58000, 62000])
        k2, k1 = np.arange(64) >> 3, np.arange(64) & 7
        p2 = np.concatenate([trust[k2], trust[np.minimum(k2 + 1, 7)]])
        p1 = np.concatenate([np.maximum(trust[k1] // 2, _LOW1), np.full(64, _LOW1)])
        self.trust = np.tile(np.array([p2, p1]).T.astype(np.uint16).ravel().view(np.uint32), lanes)
        self.counts = np.zeros((lanes, most), np.int32)
        self.one = self.two = np.zeros(lanes, np.int32)

    def keep(self, lanes: int) -> None:
        """Go on with the first lanes only."""
        for name in ("base1", "base2", "base_state", "base_slot", "one", "two"):
            setattr(self, name, getattr(self, name)[:lanes])

    def refresh(self, seen: int, new: np.ndarray) -> None:
        """Frequencies of order 0 from the ids so far, of which `new` are the latest: one for each id, the rest by counts, what
        is left to the most frequent."""
        lanes = len(self.base1)
        self.counts = self.counts[:lanes]
        if len(new):
            self.counts += np.bincount((new[:, :lanes] + self.base1).ravel(), minlength=lanes * self.most).reshape(lanes, self.most)
        d = self.distinct[:lanes, None].astype(np.int64)
        inside = np.arange(self.most) < d
        if seen:
            freq = (self.counts * ((_TOTAL0 - d) * 65536 // seen)) >> 16
            freq += inside
        else:
            freq = inside * (_TOTAL0 // d)
        freq[np.arange(lanes), self.counts.argmax(1)] += _TOTAL0 - freq.sum(1)
        below = freq.cumsum(1)
        below -= freq
        if self.slotted:
            self.slots = np.repeat(np.tile(np.arange(self.most, dtype=np.uint16), lanes), freq.ravel())
        below <<= 16  # both are at most 2^14
        below |= freq
        self.interval = below.astype(np.uint32).ravel()

    def predict(self) -> None:
        """Set what orders 2 and 1 name, and how much of 65536 each gets."""
        one = self.one
        self.i1 = self.base1 + one
        self.i2 = self.base2 + ((self.two * 40503 + one * 24691 >> _THREE) & (_SLOTS2 - 1))
        self.v1, self.v2 = self.last1.take(self.i1).astype(np.int32), self.last2.take(self.i2).astype(np.int32)
        self.c1, self.c2 = self.v1 >> _THREE, self.v2 >> _THREE
        self.k1, self.k2 = self.v1 & _SEVEN, self.v2 & _SEVEN
        self.state = self.base_state + (((self.c1 == self.c2) << np.int32(6)) + (self.k2 << _THREE) + self.k1)
        trust = self.trust.take(self.state).view(np.uint16)
        self.f2, self.q1 = trust[::2].astype(np.int32), trust[1::2].astype(np.int32)
        self.f1 = ((65536 - self.f2).astype(np.uint32) * self.q1.astype(np.uint32) >> np.uint32(16)).astype(np.int32)

    def shares(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(below, width) of the part of 2^30 that id s gets, after predict(), and learn that s came."""
        hit2, hit1 = s == self.c2, s == self.c1
        f2, f1 = self.f2, self.f1
        both = f2 + f1
        cell = self.interval.take(self.base1 + s).view(np.uint16)
        rest = 65536 - both
        named = hit2 | hit1
        width = np.where(named, np.where(hit2, f2, f1) << np.int32(_BITS0), rest * cell[::2])
        below = (np.where(hit2, 0, np.where(hit1, f2, both)).astype(np.int64) << _BITS0) + np.where(named, 0, rest * cell[1::2])
        trust = np.empty((len(s), 2), np.uint16)
        trust[:, 0] = f2 + ((np.where(hit2, _HIGH2, _LOW2) - f2) >> _RATE)
        trust[:, 1] = self.q1 + np.where(hit2, 0, (np.where(hit1, _HIGH1, _LOW1) - self.q1) >> _RATE)
        self.trust[self.state] = trust.ravel().view(np.uint32)
        new = (s << _THREE) | np.int32(1)
        for table, at, v, k, hit in ((self.last1, self.i1, self.v1, self.k1, hit1), (self.last2, self.i2, self.v2, self.k2, hit2)):
            table[at] = np.where(hit, v + (k < _SEVEN), np.where(k > _TWO, v - _TWO, new))
        self.two, self.one = self.one, s
        return below, width


def _local(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct ids in order, and each id's place among them."""
    top = int(ids.max()) + 1
    if top > 1 << 20:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(top, bool)
    there[ids] = True
    known = np.flatnonzero(there)
    place = np.empty(top, np.uint16)
    place[known] = np.arange(len(known), dtype=np.uint16)
    return known, place[ids]


def _steps(lengths: np.ndarray):
    """(place, lanes still coding) of each step, for lengths from the longest down."""
    lanes = len(lengths)
    for t in range(int(lengths[0])):
        while lengths[lanes - 1] <= t:
            lanes -= 1
        yield t, lanes


def _encode_group(symbols: list[np.ndarray], distinct: np.ndarray) -> list[bytes]:
    lengths = np.array([len(s) for s in symbols])
    lanes, longest = len(symbols), int(lengths[0])
    grid = np.zeros((longest, lanes), np.uint16)
    for i, s in enumerate(symbols):
        grid[: len(s), i] = s
    model = _Model(distinct, slots=False)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 56, np.int64)
    width = 2 * longest + 2
    digits, used = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width
    active, lo, sp, fresh = lanes, low, span, 0
    for t, lanes_now in _steps(lengths):
        if lanes_now != active:
            active, lo, sp = lanes_now, low[:lanes_now], span[:lanes_now]
            model.keep(active)
        if t in _REFRESH:
            model.refresh(t, grid[fresh:t])
            fresh = t
        model.predict()
        below, freq = model.shares(grid[t, :active].astype(np.int32))
        sp >>= _BITS
        lo += sp * below
        sp *= freq
        out = np.flatnonzero(sp < 1 << _FLOOR)
        while len(out):
            x = lo[out]
            at = used[out]
            digits[at] = x >> _FLOOR  # a carry makes it 17 bits: settled below
            used[out] = at + 1
            lo[out] = (x & ((1 << _FLOOR) - 1)) << _UNIT
            sp[out] <<= _UNIT
            out = out[sp[out] < 1 << _FLOOR]
    digits[used] = (low + (1 << _FLOOR) - 1) >> _FLOOR
    used -= np.arange(lanes) * width - 1
    table = digits.reshape(lanes, width)[:, : int(used.max())]
    while (carry := table >> _UNIT).any():
        table &= 0xFFFF
        table[:, :-1] += carry[:, 1:]
    table = table.astype("<u2")
    return [table[i, : used[i]].tobytes() for i in range(lanes)]


def _decode_group(payloads: list[bytes], lengths: np.ndarray, distinct: np.ndarray) -> list[np.ndarray]:
    lanes, longest = len(payloads), int(lengths[0])
    width = max(map(len, payloads)) // 2 + 4
    digits = np.zeros((lanes, width), np.uint16)
    for i, p in enumerate(payloads):
        digits[i, : len(p) // 2] = np.frombuffer(p, "<u2")
    digits = digits.ravel()
    used = np.arange(lanes) * width
    code = np.zeros(lanes, np.int64)  # the read number less the coder's low end; a first digit, then 40 bits
    for shift in (40, 24, 8):
        code += digits[used].astype(np.int64) << shift
        used += 1
    code += digits[used].astype(np.int64) >> 8
    held = digits[used].astype(np.int64) & 255  # eight bits that were read but not yet shifted in
    used += 1
    span = np.full(lanes, 1 << 56, np.int64)
    model = _Model(distinct, slots=True)
    grid = np.zeros((longest, lanes), np.uint16)
    active, co, sp, fresh = lanes, code, span, 0
    for t, lanes_now in _steps(lengths):
        if lanes_now != active:
            active, co, sp = lanes_now, code[:lanes_now], span[:lanes_now]
            model.keep(active)
        if t in _REFRESH:
            model.refresh(t, grid[fresh:t])
            fresh = t
        model.predict()
        sp >>= _BITS
        v = co // sp
        f2 = model.f2
        both = f2 + model.f1
        w = (v >> _BITS0).astype(np.int32)
        named = w < both
        slot = (v - (both.astype(np.int64) << _BITS0)) // (65536 - both)
        slot[named] = 0
        s = np.where(named, np.where(w < f2, model.c2, model.c1), model.slots.take(model.base_slot + slot))
        below, freq = model.shares(s)
        co -= sp * below
        sp *= freq
        out = np.flatnonzero(sp < 1 << _FLOOR)
        while len(out):
            at = used[out]
            d = digits[at].astype(np.int64)
            used[out] = np.minimum(at + 1, (out + 1) * width - 1)
            co[out] = (co[out] << _UNIT) | (held[out] << 8) | (d >> 8)
            held[out] = d & 255
            sp[out] <<= _UNIT
            out = out[sp[out] < 1 << _FLOOR]
        grid[t, :active] = s
    return [grid[: lengths[i], i] for i in range(lanes)]


def _groups(distinct: list[int]):
    """Runs of blocks whose tables stay within _CELLS together, LANES blocks at most."""
    at = 0
    while at < len(distinct):
        most, end = 0, at
        while end < len(distinct) and end - at < LANES and max(most, distinct[end]) * (end - at + 1) <= max(_CELLS, distinct[at]):
            most = max(most, distinct[end])
            end += 1
        yield range(at, end)
        at = end


def encode(blocks: list[np.ndarray], firsts: list[int], directories: list[bytes]) -> list[bytes]:
    """Whole blocks: ids (uint32, 1 to BLOCK of them), the number of ids before each in its file, and bytes of any use.

    Layout, little-endian: "HXI1"; numbers of ids, of distinct ids, of bytes of the list of distinct ids and of the
    directory (32 bits each); ids before it (64); bytes of the payload; crc32 of the ids as 32-bit integers, of all
    three sections, and of the header so far; then list, directory and payload. The list is the differences of the ascending ids, and the
    directory as given, both as zlib streams.
    """
    local = [_local(b) for b in blocks]
    payloads: list[bytes] = [b""] * len(blocks)
    for some in _groups([len(k) for k, _ in local]):
        order = sorted(some, key=lambda i: -len(blocks[i]))
        coded = _encode_group([local[i][1] for i in order], np.array([len(local[i][0]) for i in order]))
        for i, p in zip(order, coded, strict=True):
            payloads[i] = p
    out = []
    for ids, (known, _), payload, first, directory in zip(blocks, local, payloads, firsts, directories, strict=True):
        listed = zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes(), 6)
        told = zlib.compress(directory, 1)
        body = listed + told + payload
        head = _HEAD.pack(MAGIC, len(ids), len(known), len(listed), len(told), first, len(payload), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body), 0)[:-4]
        out.append(head + struct.pack("<I", zlib.crc32(head)) + body)
    return out


class Damaged(ValueError):
    """A block whose bytes are not those written."""


def decode(blocks: list[bytes]) -> list[tuple[np.ndarray, int, bytes]]:
    """(ids, ids before it, directory) of each block. Raises Damaged where a checksum fails, before or after decoding."""
    heads, known, told, payloads = [], [], [], []
    for b in blocks:
        if len(b) < _HEAD.size or b[:4] != MAGIC:
            raise Damaged("not a block of ids")
        magic, n, d, n_list, n_dir, first, n_pay, crc, body_crc, head_crc = _HEAD.unpack_from(b)
        body = b[_HEAD.size :]
        if zlib.crc32(b[: _HEAD.size - 4]) != head_crc or len(body) != n_list + n_dir + n_pay or zlib.crc32(body) != body_crc:
            raise Damaged("a checksum of the block's bytes fails")
        heads.append((n, d, first, crc))
        known.append(np.cumsum(np.frombuffer(zlib.decompress(body[:n_list]), "<u4").astype(np.int64)))
        told.append(zlib.decompress(body[n_list : n_list + n_dir]))
        payloads.append(body[n_list + n_dir :])
    out: list = [None] * len(blocks)
    for some in _groups([h[1] for h in heads]):
        order = sorted(some, key=lambda i: -heads[i][0])
        symbols = _decode_group([payloads[i] for i in order], np.array([heads[i][0] for i in order]), np.array([heads[i][1] for i in order]))
        for i, s in zip(order, symbols, strict=True):
            ids = known[i][s].astype(np.uint32)
            if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][3]:
                raise Damaged("the checksum of the block's ids fails")
            out[i] = (ids, heads[i][2], told[i])
    return out
