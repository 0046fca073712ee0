"""Adaptive context-mixing range coder for token ids, run over all blocks of a file in step.

A file is a sequence of ids cut into blocks of BLOCK ids. Every block starts from an empty model and an empty coder and
carries a checksum, so a block decodes with the file's header and its own bytes alone. Blocks are the lanes of the arrays
below: step t codes id t of every block at once.

The model mixes three predictions of the next id. Order 2 and order 1 look up the id that last followed the hash of the two
ids or the one id before, with a confidence that grows with hits; order 0 is the file's table of frequencies. The weight of
each is learned within the block, per state of the two confidences: the interval of a step is dealt into the order-2 id, the
order-1 id and the rest by these weights, and an id in the rest is coded by order 0. The coder is a carryless range coder
with 64 bits of state that puts out 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION, BLOCK = b"PLTI", 1, 4096
HEAD = struct.Struct("<4sHIQQII")
SLOTS1, SLOTS2, CONFIDENT = 10, 11, 3
#: Bits of the weights and of order-0 frequencies; least weight of a prediction; rate at which weights adapt.
WEIGHT, ORDER0, LEAST, RATE = 16, 20, 24, 5
BOTTOM, TOP = np.uint64(1 << 40), np.uint64(1 << 48)
_U, _W = np.uint64, np.uint32


class Damaged(ValueError):
    """A file whose header, lengths or checksums don't hold."""


class Model:
    """Order-2 and order-1 predictions and their weights, one lane per block. All arrays hold unsigned 32-bit numbers."""

    def __init__(self, lanes: int):
        self.one, self.two = np.zeros(lanes << SLOTS1, _W), np.zeros(lanes << SLOTS2, _W)
        self.weights = np.full(lanes * 32, 1 << 30 | 1 << 14, _W)  # of order 2 above, of order 1 below bit 16
        self.last = self.before = np.zeros(lanes, _W)
        self.lanes(lanes)

    def lanes(self, lanes: int) -> None:
        number = np.arange(lanes, dtype=np.int64)
        self.at1, self.at2, self.at = number << SLOTS1, number << SLOTS2, (number << 5)
        self.last, self.before = self.last[:lanes], self.before[:lanes]

    def predict(self) -> None:
        """Sets the predicted ids p2 and p1, and the ends w2 and w1 of their intervals."""
        mixed = self.last * _W(0x9E3779B1)
        self.slot1 = self.at1 + (mixed >> _W(32 - SLOTS1))
        mixed ^= self.before * _W(0x85EBCA6B)
        mixed *= _W(0xC2B2AE35)
        self.slot2 = self.at2 + (mixed >> _W(32 - SLOTS2))
        e1, e2 = self.one.take(self.slot1), self.two.take(self.slot2)
        self.p1, self.p2 = e1 & _W(0x0FFFFFFF), e2 & _W(0x0FFFFFFF)
        self.c1, self.c2 = e1 >> _W(28), e2 >> _W(28)
        self.state = self.at + ((self.c2 << _W(3)) + (self.c1 << _W(1)) + (self.p1 == self.p2))
        both = self.weights.take(self.state)
        self.a, self.b = both >> _W(16), both & _W(0xFFFF)
        self.w2 = (self.a * _W((1 << WEIGHT) - 3 * LEAST) >> _W(16)) + _W(LEAST)
        self.w1 = ((_W((1 << WEIGHT) - 2 * LEAST) - self.w2) * self.b >> _W(16)) + self.w2 + _W(LEAST)

    def update(self, ids: np.ndarray, is2: np.ndarray, is1: np.ndarray) -> None:
        """Learns the ids of a step; is2 and is1 say which prediction took the interval."""
        a = self.a - (self.a >> _W(RATE)) + is2 * _W(65535 >> RATE)
        b = np.where(is2, self.b, self.b - (self.b >> _W(RATE)) + is1 * _W(65535 >> RATE))
        self.weights[self.state] = a << _W(16) | b
        for table, slot, c, right, p in ((self.two, self.slot2, self.c2, is2, self.p2), (self.one, self.slot1, self.c1, self.p1 == ids, self.p1)):
            held = c > 0
            sure = np.where(right, np.minimum(c + _W(1), _W(CONFIDENT)), c - held)
            table[slot] = np.where(right | held, p, ids) | sure << _W(28)
        self.before, self.last = self.last, ids


def _renew(low: np.ndarray, span: np.ndarray) -> np.ndarray | None:
    """Which lanes have a settled top word; spans that got short across a word's edge are cut to end there."""
    settled = (low ^ (low + span)) < TOP
    short = span < BOTTOM
    if short.any():
        short &= ~settled
        span[short] = -low[short] & (BOTTOM - _U(1))
        settled |= short
    return settled if settled.any() else None


def _order0(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^ORDER0, none of them zero."""
    if not len(counts):
        return counts
    freq = 1 + counts * ((1 << ORDER0) - len(counts)) // counts.sum()
    freq[np.argmax(counts)] += (1 << ORDER0) - freq.sum()
    return freq


def _lay_out(n: int) -> tuple[int, int]:
    """Blocks and the length of the last."""
    blocks = -(-n // BLOCK)
    return blocks, n - (blocks - 1) * BLOCK if blocks else 0


def encode(ids: np.ndarray) -> bytes:
    """The file for a sequence of ids below 2^28, of which at most 2^19 differ."""
    ids = np.ascontiguousarray(ids, np.uint32)
    counts = np.bincount(ids) if len(ids) else np.empty(0, np.int64)
    present = np.flatnonzero(counts)
    if len(present) > 1 << (ORDER0 - 1) or len(counts) > 1 << 28:
        raise ValueError("too many different ids for one file")
    freq = _order0(counts[present].astype(np.int64))
    number = np.zeros(len(counts) + 1, np.uint32)
    number[present] = np.arange(len(present))
    blocks, rest = _lay_out(len(ids))
    table = zlib.compress(np.diff(present, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    sums = [zlib.crc32(ids[i * BLOCK:(i + 1) * BLOCK].astype("<u4")) for i in range(blocks)]
    words, sizes = _encode_blocks(number[ids], blocks, rest, freq) if blocks else (b"", [])
    body = np.array(sums, "<u4").tobytes() + np.array(sizes, "<u4").tobytes()
    fields = (MAGIC, VERSION, BLOCK, len(ids), len(present), len(table))
    return HEAD.pack(*fields, _head_sum(*fields, table + body)) + table + body + words


def _head_sum(*parts) -> int:
    """Checksum of the header's fields and of what stands between them and the blocks."""
    return zlib.crc32(parts[-1], zlib.crc32(HEAD.pack(*parts[:-1], 0)))


def _encode_blocks(ids: np.ndarray, blocks: int, rest: int, freq: np.ndarray) -> tuple[bytes, np.ndarray]:
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:len(ids)] = ids
    steps = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    cum, freq = (np.cumsum(freq) - freq).astype(_U), freq.astype(_U)
    low, span = np.zeros(blocks, _U), np.full(blocks, (1 << 64) - 1, _U)
    room, at = 512, np.zeros(blocks, np.int64)
    page = np.zeros((blocks, room), np.uint16)
    model, lanes, number = Model(blocks), blocks, np.arange(blocks)
    total0 = _U(1 << ORDER0)
    for t in range(BLOCK if blocks > 1 else rest):
        if t == rest and lanes == blocks and rest < BLOCK:
            lanes -= 1
            model.lanes(lanes)
        if int(at.max()) + 8 > room:
            page = np.concatenate([page, np.zeros((blocks, room), np.uint16)], axis=1)
            room *= 2
        x, lo, sp = steps[t, :lanes], low[:lanes], span[:lanes]
        model.predict()
        is2 = x == model.p2
        is1 = (x == model.p1) & ~is2
        other = ~(is2 | is1)
        begin = np.where(is2, _W(0), np.where(is1, model.w2, model.w1))
        end = np.where(is2, model.w2, np.where(is1, model.w1, _W(1 << WEIGHT)))
        share = sp >> _U(WEIGHT)
        lo += share * begin
        share *= end - begin
        share >>= _U(ORDER0)
        lo += share * (cum.take(x) * other)
        sp[:] = share * np.where(other, freq.take(x), total0)
        model.update(x, is2, is1)
        flat, row = page.reshape(-1), number[:lanes] * room
        while (settled := _renew(lo, sp)) is not None:
            flat[row + at[:lanes]] = lo >> _U(48)  # a lane that is not settled writes this word again later
            at[:lanes] += settled
            shift = settled.astype(_U) << _U(4)
            lo <<= shift
            sp <<= shift
    if int(at.max()) + 4 > room:
        page = np.concatenate([page, np.zeros((blocks, 4), np.uint16)], axis=1)
    for shift in (48, 32, 16, 0):
        page[np.arange(blocks), at] = (low >> _U(shift)).astype(np.uint16)
        at += 1
    return page[np.arange(page.shape[1]) < at[:, None]].astype("<u2").tobytes(), at


def decode(data: bytes) -> np.ndarray:
    """The ids of a file; raises Damaged where a length or a checksum is wrong."""
    if len(data) < HEAD.size:
        raise Damaged("short header")
    magic, version, block, n, symbols, table_size, head_sum = HEAD.unpack_from(data)
    if (magic, version, block) != (MAGIC, VERSION, BLOCK):
        raise Damaged("unknown format")
    blocks, rest = _lay_out(n)
    body_at = HEAD.size + table_size
    words_at = body_at + 8 * blocks
    if words_at > len(data) or _head_sum(magic, version, block, n, symbols, table_size, data[HEAD.size:words_at]) != head_sum:
        raise Damaged("header checksum")
    table = np.frombuffer(zlib.decompress(data[HEAD.size:body_at]), "<u4").astype(np.int64)
    present, freq = np.cumsum(table[:symbols]), table[symbols:]
    sums, sizes = np.frombuffer(data, "<u4", 2 * blocks, body_at).reshape(2, blocks)
    if len(data) != words_at + 2 * int(sizes.sum()):
        raise Damaged("length")
    if not blocks:
        return np.empty(0, np.uint32)
    words = np.frombuffer(data, "<u2", -1, words_at)
    ids = present[_decode_blocks(words, sizes.astype(np.int64), blocks, rest, freq)[:n]].astype(np.uint32)
    for i in range(blocks):
        if zlib.crc32(ids[i * BLOCK:(i + 1) * BLOCK].astype("<u4")) != sums[i]:
            raise Damaged(f"checksum of block {i}")
    return ids


def _decode_blocks(words: np.ndarray, sizes: np.ndarray, blocks: int, rest: int, freq: np.ndarray) -> np.ndarray:
    words = np.concatenate([words, np.zeros(8, "<u2")]).astype(_U)
    at = np.cumsum(sizes) - sizes
    low, span, code = np.zeros(blocks, _U), np.full(blocks, (1 << 64) - 1, _U), np.zeros(blocks, _U)
    for _ in range(4):
        code = code << _U(16) | words[at]
        at += 1
    steps = np.zeros((BLOCK, blocks), np.uint32)
    symbol = np.repeat(np.arange(len(freq), dtype=_W), freq)
    cum, freq = (np.cumsum(freq) - freq).astype(_U), freq.astype(_U)
    model, lanes = Model(blocks), blocks
    total0 = _U(1 << ORDER0)
    for t in range(BLOCK if blocks > 1 else rest):
        if t == rest and lanes == blocks and rest < BLOCK:
            lanes -= 1
            model.lanes(lanes)
        lo, sp, co = low[:lanes], span[:lanes], code[:lanes]
        model.predict()
        share = sp >> _U(WEIGHT)
        value = np.minimum((co - lo) // share, _U((1 << WEIGHT) - 1)).astype(_W)
        is2 = value < model.w2
        is1 = (value < model.w1) & ~is2
        other = ~(is2 | is1)
        begin = np.where(is2, _W(0), np.where(is1, model.w2, model.w1))
        end = np.where(is2, model.w2, np.where(is1, model.w1, _W(1 << WEIGHT)))
        lo += share * begin
        share *= end - begin
        share >>= _U(ORDER0)
        value = np.minimum((co - lo) // share, total0 - _U(1)).astype(np.int64)
        x = np.where(is2, model.p2, np.where(is1, model.p1, symbol.take(value)))
        lo += share * (cum.take(x) * other)
        sp[:] = share * np.where(other, freq.take(x), total0)
        model.update(x, is2, is1)
        steps[t, :lanes] = x
        while (settled := _renew(lo, sp)) is not None:
            shift = settled.astype(_U) << _U(4)
            lo <<= shift
            sp <<= shift
            co <<= shift
            co |= words.take(at[:lanes], mode="clip") * settled
            at[:lanes] += settled
    return steps.T.reshape(-1)
