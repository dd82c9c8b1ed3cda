"""An adaptive context-mixing range coder for token ids, many blocks at once.

A block starts from nothing, so blocks can be coded side by side: every array
below has a place per block, and one pass of numpy codes one id of each.

The tables of order 2 and order 1 each predict an id from the ids before it,
with a confidence.  Whether the order-2 prediction is right is coded with a
probability mixed from what both orders and the block's hit rate say; the
weights follow the errors.  If it is wrong, the order-1 prediction is tried in
the same way.  What no order predicted is coded by order 0, in four nibbles
with adaptive counts.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Slots of a block's tables (a power of two), and rows of its third and last nibble counts.
SLOTS, ROWS3, ROWS4 = 4096, 256, 512
#: Bits of a probability; of an adaptive one; step of counts and the sum at which they are halved.
BITS, GAIN, MOST = 12, 24, 1 << 14
ONE = 1 << BITS
LOW32, LOW48 = (1 << 32) - 1, (1 << 48) - 1

#: ln(p / (1 - p)) of a probability in eighths of a bit's 256ths, and back.
_p = (np.arange(ONE) + 0.5) / ONE
STRETCH = np.clip(np.rint(256 * np.log(_p / (1 - _p))), -2047, 2047).astype(np.int64)
SQUASH = np.clip(np.rint(ONE / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, ONE - 1).astype(np.int64)
#: What a reader's tables have to agree with.
TABLES = zlib.crc32(STRETCH.astype("<i8").tobytes() + SQUASH.astype("<i8").tobytes())

EACH_BYTE, TOP_BYTE = np.uint64(0x0101010101010101), np.uint64(56)
#: What an occurrence of a nibble adds to the running sums of a row, and the sums of a new row.
ADDED = ((np.arange(16)[None, :] >= np.arange(16)[:, None]) * GAIN).astype(np.uint16)
FIRST = np.arange(1, 17, dtype=np.uint16)


def _floor(a, b):
    """Quotients of whole numbers below 2**48: exact in doubles, and faster."""
    return (a / b).astype(np.int64)


class _Out:
    """Range encoder of every block; carries are added up and passed on at the end."""

    def __init__(self, lanes: int, length: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, LOW48, np.int64)
        self.words, self.at = np.zeros((lanes, 2 * length + 64), np.uint32), np.zeros(lanes, np.int64)
        self.room = 2 * length + 64

    def put(self, i, start, size, unit) -> None:
        low = self.low[i] + unit * start
        range_ = unit * size
        if (over := low >> 48).any():
            at = np.flatnonzero(over)
            lane = at if isinstance(i, slice) else i[at]
            self.words[lane, self.at[lane] - 1] += 1
            low &= LOW48
        small = np.flatnonzero(range_ <= LOW32)
        if len(small):
            lane = small if isinstance(i, slice) else i[small]
            where = self.at[lane]
            self.words[lane, where] = low[small] >> 32
            self.at[lane] = where + 1
            low[small] = (low[small] & LOW32) << 16
            range_[small] <<= 16
        self.low[i], self.range[i] = low, range_

    def bit(self, i, p, bit):
        unit = self.range[i] >> BITS
        self.put(i, np.where(bit, 0, p), np.where(bit, p, ONE - p), unit)
        return bit

    def nibble(self, i, sums, symbol):
        own = np.arange(0, 16 * len(symbol), 16) + symbol
        flat = sums.ravel()
        high = flat.take(own).astype(np.int64)
        low = np.where(symbol > 0, flat.take(own - 1), 0)
        self.put(i, low, high - low, _floor(self.range[i], sums[:, 15]))
        return symbol

    def more(self, t: int) -> None:
        """Room for the next id (eight words at most)."""
        if t % 64 == 0 and int(self.at.max(initial=0)) + 8 * 65 > self.room:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            self.room = self.words.shape[1]

    def done(self) -> list[bytes]:
        lane = np.arange(len(self.low))
        if self.room < int(self.at.max(initial=0)) + 4:
            self.words = np.concatenate([self.words, np.zeros((len(lane), 4), np.uint32)], axis=1)
        for shift in (32, 16, 0):
            self.words[lane, self.at] = (self.low >> shift) & 0xFFFF
            self.at += 1
        while (over := self.words >> 16).any():
            self.words &= 0xFFFF
            self.words[:, :-1] += over[:, 1:]
        return [w[:n].astype("<u2").tobytes() for w, n in zip(self.words, self.at, strict=True)]


class _In:
    """Range decoder of every block."""

    def __init__(self, payloads: list[bytes]):
        sizes = [len(p) // 2 for p in payloads]
        self.words = np.frombuffer(b"".join([*payloads, bytes(16)]), "<u2").astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.range = np.full(len(payloads), LOW48, np.int64)
        self.code = (self.words[self.at] << 32) | (self.words[self.at + 1] << 16) | self.words[self.at + 2]
        self.at += 3

    def take(self, i, start, size, unit) -> None:
        code, range_ = self.code[i] - unit * start, unit * size
        small = np.flatnonzero(range_ <= LOW32)
        if len(small):
            lane = small if isinstance(i, slice) else i[small]
            where = self.at[lane]
            code[small] = (code[small] << 16) | self.words.take(where, mode="clip")
            self.at[lane] = where + 1
            range_[small] <<= 16
        self.code[i], self.range[i] = code, range_

    def bit(self, i, p, _):
        unit = self.range[i] >> BITS
        bit = self.code[i] < unit * p
        self.take(i, np.where(bit, 0, p), np.where(bit, p, ONE - p), unit)
        return bit

    def nibble(self, i, sums, _):
        unit = _floor(self.range[i], sums[:, 15])
        value = np.minimum(_floor(self.code[i], unit), sums[:, 15] - 1).astype(np.uint16)
        # Sums at or below the value: 16 truths of a byte each, added up as two words.
        below = (sums <= value[:, None]).view(np.uint64)
        symbol = (((below[:, 0] + below[:, 1]) * EACH_BYTE) >> TOP_BYTE).astype(np.int64)
        own = np.arange(0, 16 * len(symbol), 16) + symbol
        flat = sums.ravel()
        low = np.where(symbol > 0, flat.take(own - 1), 0).astype(np.int64)
        self.take(i, low, flat.take(own) - low, unit)
        return symbol

    def more(self, t: int) -> None:
        pass


class _Model:
    """Predictions of every block, and what they learn."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) * SLOTS
        self.sixteen = np.arange(lanes, dtype=np.int64) * 16
        #: Predicted ids and, in the last four bits, their confidence.
        self.slots = [np.zeros(lanes * SLOTS, np.uint32) for _ in range(2)]
        # Hit rates by confidence, of 16 bits: of the order-2 try, of order 1 as its witness, and of the order-1 try.
        self.rate = [np.full(lanes * 16, 1 << 14, np.int64) for _ in range(3)]
        self.overall = [np.full(lanes, 1 << 14, np.int64) for _ in range(2)]
        self.weight = [np.full((k, lanes), (1 << 16) // 2, np.int64) for k in (3, 2)]
        self.sums = [np.tile(FIRST, (lanes * rows, 1)) for rows in (1, 16, ROWS3, ROWS4)]

    def tried(self, coder, which: int, i, inputs, cells, bit):
        """Codes whether a prediction is right, and learns from it.  inputs: signed stretches; cells: (table, places)."""
        weight = self.weight[which]
        dot = weight[0][i] * inputs[0]
        for k in range(1, len(inputs)):
            dot += weight[k][i] * inputs[k]
        p = SQUASH.take((dot >> 16) + 2047, mode="clip")
        bit = coder.bit(i, p, bit)
        error = ((bit.astype(np.int64) << BITS) - p) * 14
        for k, x in enumerate(inputs):
            weight[k][i] += (x * error) >> 10
        for table, at, right in cells:
            old = table.take(at) if isinstance(at, np.ndarray) else table[at]
            table[at] = old + (((bit == right) * 65535 - old) >> 5)
        return bit

    def literal(self, coder, i, ids):
        """The ids that no order predicted, by the counts of order 0."""
        known = np.zeros(len(i), np.int64)
        for k, rows in enumerate((1, 16, ROWS3, ROWS4)):
            # The last row is found by a hash of the nibbles before it; rows may share counts.
            own = known if k < 3 else (known ^ (known >> 9)) & (ROWS4 - 1)
            at = i * rows + own
            sums = self.sums[k].take(at, axis=0)
            symbol = coder.nibble(i, sums, None if ids is None else (ids >> (12 - 4 * k)) & 15)
            sums += ADDED.take(symbol, axis=0)
            full = np.flatnonzero(sums[:, 15] > MOST)
            if len(full):
                sums[full] = (sums[full] >> 1) + FIRST
            self.sums[k][at] = sums
            known = (known << 4) | symbol
        return known

    def step(self, coder, n: int, before: np.ndarray, last: np.ndarray, ids):
        """Codes one id of each of the first n blocks, after ``last`` and, before that, ``before``."""
        s = slice(0, n)
        mixed = (last * 0x9E3779B1 + before * 0x85EBCA6B) & LOW32
        two = self.base[s] + ((mixed ^ (mixed >> 15)) & (SLOTS - 1))
        mixed = (last * 0xC2B2AE35) & LOW32
        one = self.base[s] + ((mixed ^ (mixed >> 15)) & (SLOTS - 1))
        slot2, slot1 = self.slots[0].take(two).astype(np.int64), self.slots[1].take(one).astype(np.int64)
        guess2, guess1 = slot2 >> 4, slot1 >> 4
        at2, at1 = self.sixteen[s] + (slot2 & 15), self.sixteen[s] + (slot1 & 15)
        agree = guess1 == guess2
        witness = STRETCH.take(self.rate[1].take(at1) >> 4)
        inputs = [STRETCH.take(self.rate[0].take(at2) >> 4), np.where(agree, witness, -witness), STRETCH.take(self.overall[0][s] >> 4)]
        hit = self.tried(coder, 0, s, inputs, [(self.rate[0], at2, True), (self.rate[1], at1, agree), (self.overall[0], s, True)], None if ids is None else ids == guess2)
        found = guess2.copy()
        miss = np.flatnonzero(~hit)
        if len(miss):
            second = miss[~agree[miss]]
            other = miss[agree[miss]]
            if len(second):
                a = at1[second]
                inputs = [STRETCH.take(self.rate[2].take(a) >> 4), STRETCH.take(self.overall[1].take(second) >> 4)]
                hit1 = self.tried(coder, 1, second, inputs, [(self.rate[2], a, True), (self.overall[1], second, True)], None if ids is None else ids[second] == guess1[second])
                found[second] = guess1[second]
                other = np.concatenate([other, second[~hit1]])
            if len(other):
                found[other] = self.literal(coder, other, None if ids is None else ids[other])
        for k, at, slot, guess in ((0, two, slot2, guess2), (1, one, slot1, guess1)):
            right, trust = found == guess, slot & 15
            # A right prediction gains trust, a wrong one loses half of it or its place.
            kept = np.where(right, slot + (trust < 15), slot - trust + (trust >> 1))
            self.slots[k][at] = np.where(right | (trust > 1), kept, (found << 4) | 1)
        return found


def _run(coder, lengths: list[int], ids: np.ndarray | None) -> np.ndarray:
    lanes, longest = len(lengths), max(lengths)
    model = _Model(lanes)
    before, last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    out = np.zeros((longest, lanes), np.uint16)
    n = lanes
    for t in range(longest):
        while lengths[n - 1] <= t:
            n -= 1
        coder.more(t)
        found = model.step(coder, n, before[:n], last[:n], None if ids is None else ids[t, :n].astype(np.int64))
        before[:n], last[:n] = last[:n], found
        out[t, :n] = found
    return out


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """A payload per block of ids below 65,536.  Blocks must not be empty nor grow in length."""
    lengths = [len(b) for b in blocks]
    ids = np.zeros((lengths[0], len(blocks)), np.uint16)
    for k, b in enumerate(blocks):
        ids[: len(b), k] = b
    coder = _Out(len(blocks), lengths[0])
    _run(coder, lengths, ids)
    return coder.done()


def decode(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The blocks' ids, again; ``lengths`` must not grow."""
    out = _run(_In(payloads), lengths, None)
    return [out[:n, k].copy() for k, n in enumerate(lengths)]
