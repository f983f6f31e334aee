"""An adaptive range coder for token ids, in blocks that are independent of each other.

A block starts from nothing. Its model predicts an id from the last two ids (order 2), from the last
one (order 1), and by how often ids occurred (order 0, digit by digit of four bits). What each order's
prediction is worth is learned for every pair of confidences, so the three are mixed in changing shares
of the coder's range; all numbers are whole, so any machine decodes what another wrote. Blocks are
coded side by side, one id of each at a time, in arrays.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"PTID", 1
#: Ids of a block at most and at least; blocks side by side at most.
BLOCK, LEAST_BLOCK, LANES = 2048, 512, 4096
#: Bits of an order's table of contexts; nodes of the digits' trees below the second level share so many.
BITS, SHARED = 11, 256
#: What is added to a count, and the sums at which a choice's and a digit's counts are halved.
STEP, MOST_CHOICE, MOST_DIGIT = 24, 4000, 6000
WORD, LEAST_RANGE, WHOLE = 16, 1 << 32, 1 << 48
#: Four counts of sixteen bits are packed in a long: times ONES it holds their running sums.
ONES, HALVES = 0x0001000100010001, 0x7FFF7FFF7FFF7FFF
HEADER = struct.Struct("<4sHHIIIQ")


class DamagedBlock(ValueError):
    """A block or header does not have its checksum."""


class _Coder:
    """The range of each block while it is written (words None) or read."""

    def __init__(self, n: int, words: np.ndarray | None = None, starts: np.ndarray | None = None) -> None:
        self.range = np.full(n, WHOLE, np.int64)
        self.low = np.zeros(n, np.int64)
        self.words, self.out = words, []
        if words is not None:
            self.at = starts.astype(np.int64)
            for _ in range(3):
                self.low = (self.low << WORD) | words[self.at]  # here: the code's distance from the low end
                self.at += 1

    def unit(self, lanes: slice | np.ndarray, total: np.ndarray) -> np.ndarray:
        """The range's width for one of the total."""
        return self.range[lanes] // total

    def value(self, lanes: slice | np.ndarray, r: np.ndarray) -> np.ndarray:
        """Where in the total the code stands; at the top it may be a rounding's width above."""
        return self.low[lanes] // r

    def take(self, lanes: slice | np.ndarray, start: np.ndarray, freq: np.ndarray, r: np.ndarray) -> None:
        now = r * freq
        moved = start * r
        low = self.low[lanes] + moved if self.words is None else self.low[lanes] - moved
        full = np.flatnonzero(now < LEAST_RANGE)
        if full.size:
            which = full if isinstance(lanes, slice) else lanes[full]
            now[full] <<= WORD
            if self.words is None:
                self.out.append((which.astype(np.int32), (low[full] >> 32).astype(np.int32)))  # with a carry, if any
                low[full] = (low[full] & 0xFFFFFFFF) << WORD
            else:
                at = self.at[which]
                low[full] = (low[full] << WORD) | self.words[at]
                self.at[which] = at + 1
        self.range[lanes], self.low[lanes] = now, low

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of all blocks, one block after the other, and how many each has."""
        every = np.arange(len(self.low), dtype=np.int32)
        for shift in (32, 16, 0):
            self.out.append((every, ((self.low >> shift) & (0xFFFFFFFF if shift == 32 else 0xFFFF)).astype(np.int32)))
        lane, word = (np.concatenate([x[i] for x in self.out]) for i in (0, 1))
        order = np.argsort(lane, kind="stable")
        word, n = word[order], np.bincount(lane, minlength=len(every))
        while (carry := word >> WORD).any():  # a carry goes to the word before, which is of the same block
            word &= 0xFFFF
            word[:-1] += carry[1:]
        return word.astype("<u2"), n


def _step(counts: np.ndarray, total: np.ndarray, most: int) -> np.ndarray:
    """Packed counts, halved (rounded up) where their total is over most."""
    over = np.flatnonzero(total > most)
    if over.size:
        counts[over] = ((counts[over] + ONES) >> 1) & HALVES
    return counts


def _place(v: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Sixteen times the place, of four, at whose running sum a value stands."""
    return ((v >= (upto & 0xFFFF)).astype(np.int64) + (v >= (upto >> 16 & 0xFFFF)) + (v >= (upto >> 32 & 0xFFFF))) << 4


class _Trees:
    """Counts of the digits under their nodes: four sums of four counts each a node, packed alike."""

    def __init__(self, nodes: int) -> None:
        self.sums = np.full(nodes, 4 * ONES, np.int64)
        self.counts = np.full(nodes * 4, ONES, np.int64)

    def code(self, coder: _Coder, node: np.ndarray, lanes: np.ndarray, want: np.ndarray | None) -> np.ndarray:
        """One digit of some blocks."""
        sums = self.sums.take(node)
        over = sums * ONES
        total = over >> 48
        r = coder.unit(lanes, total)
        if want is None:
            v = np.minimum(coder.value(lanes, r), total - 1)
            j = _place(v, over)
        else:
            j = want >> 2 << 4
        base = ((over << 16) >> j) & 0xFFFF
        at = node * 4 + (j >> 4)
        counts = self.counts.take(at)
        upto = counts * ONES
        k = _place(v - base, upto) if want is None else (want & 3) << 4
        freq = counts >> k & 0xFFFF
        coder.take(lanes, base + (((upto << 16) >> k) & 0xFFFF), freq, r)
        self.counts[at] = counts + (STEP << k)
        self.sums[node] = sums + (STEP << j)
        many = np.flatnonzero(total > MOST_DIGIT)
        if many.size:
            self._halve(node[many])
        return j >> 2 | k >> 4 if want is None else want

    def _halve(self, node: np.ndarray) -> None:
        packed = np.zeros(len(node), np.int64)
        for i in range(4):
            own = node * 4 + i
            self.counts[own] = less = ((self.counts[own] + ONES) >> 1) & HALVES
            packed |= (less * ONES >> 48) << 16 * i
        self.sums[node] = packed


def _run(lengths: np.ndarray, digits: int, ids: np.ndarray | None, coder: _Coder) -> np.ndarray:
    """Codes blocks of falling lengths, side by side; ids has a row for each place in the blocks."""
    n, longest = len(lengths), int(lengths[0])
    out = ids if ids is not None else np.zeros((longest, n), np.int32)
    nodes = 1 + (16 if digits > 1 else 0) + (256 if digits > 2 else 0) + SHARED * max(0, digits - 3)
    one, two = (np.zeros(n << BITS, np.int32) for _ in range(2))  # id << 3 | confidence
    choice = np.full(n * 128, 40 | 20 << 16 | 40 << 32, np.int64)
    trees = _Trees(n * nodes)
    base, mask = np.arange(n, dtype=np.int64), (1 << BITS) - 1
    last, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        k = int(live[t])
        lane, p, q = base[:k], last[:k], before[:k]
        i1 = (lane << BITS) + ((p * 0x9E3779B1 >> 12) & mask)
        i2 = (lane << BITS) + (((q * 0x9E3779B1 + p) * 0x85EBCA6B >> 14) & mask)
        g1, g2 = one.take(i1).astype(np.int64), two.take(i2).astype(np.int64)
        id1, c1, id2, c2 = g1 >> 3, g1 & 7, g2 >> 3, g2 & 7
        state = lane * 128 + ((id1 == id2) << 6 | c2 << 3 | c1)
        shares = choice.take(state)
        upto = shares * ONES
        total = upto >> 48
        r = coder.unit(slice(0, k), total)
        if ids is not None:
            s = out[t, :k].astype(np.int64)
            which = np.where(s == id2, 0, np.where(s == id1, 1, 2))
        else:
            v = coder.value(slice(0, k), r)
            which = (v >= (upto & 0xFFFF)).astype(np.int64) + (v >= (upto >> 16 & 0xFFFF))
            s = np.where(which == 0, id2, id1)
        bit = which << 4
        freq = shares >> bit & 0xFFFF
        coder.take(slice(0, k), (upto >> bit & 0xFFFF) - freq, freq, r)
        choice[state] = _step(shares + (STEP << bit), total, MOST_CHOICE)
        rest = np.flatnonzero(which == 2)
        if rest.size:
            want, head, at = s[rest], np.zeros(rest.size, np.int64), 0
            for d in range(digits):
                shift = 4 * (digits - 1 - d)
                node = rest * nodes + at + (head if d < 3 else (head * 0x9E3779B1 >> 9) % SHARED)
                got = trees.code(coder, node, rest, (want >> shift) & 15 if ids is not None else None)
                head = head << 4 | got
                at += (1, 16, 256)[d] if d < 3 else SHARED
            if ids is None:
                s[rest] = head
        one[i1] = np.where(id1 == s, g1 + (c1 < 7), np.where(c1 > 1, g1 - ((c1 + 1) >> 1), s << 3))
        two[i2] = np.where(id2 == s, g2 + (c2 < 7), np.where(c2 > 1, g2 - ((c2 + 1) >> 1), s << 3))
        if ids is None:
            out[t, :k] = s
        before[:k] = p
        last[:k] = s
    return out


def _digits(ids: np.ndarray) -> int:
    return max(1, -(-int(ids.max(initial=0)).bit_length() // 4))


def pack(ids: np.ndarray, lengths: np.ndarray, block: int | None = None) -> bytes:
    """A segment: ids (below 2^28) of documents of some lengths, in blocks. A small segment has shorter
    blocks, so that enough of them are coded side by side."""
    ids = np.ascontiguousarray(ids, "<u4")
    lengths = np.ascontiguousarray(lengths, "<u8")
    if int(lengths.sum()) != len(ids):
        raise ValueError("the lengths are not those of the ids")
    block = block or min(BLOCK, max(LEAST_BLOCK, len(ids) // 2048))
    digits, n_blocks = _digits(ids), -(-len(ids) // block)
    sums = np.array([zlib.crc32(ids[i * block : (i + 1) * block]) for i in range(n_blocks)], "<u4")
    words, sizes = [np.zeros(0, "<u2")], [np.zeros(0, "<u4")]
    for first in range(0, n_blocks, LANES):
        own = ids[first * block : (first + LANES) * block]
        n = -(-len(own) // block)
        each = np.full(n, block)
        each[-1] = len(own) - (n - 1) * block
        laid = np.zeros((n, block), np.int32)
        laid.ravel()[: len(own)] = own
        coder = _Coder(n)
        _run(each, digits, np.ascontiguousarray(laid.T)[: each[0]], coder)
        w, size = coder.finish()
        words.append(w)
        sizes.append(size.astype("<u4"))
    head = HEADER.pack(MAGIC, VERSION, digits, block, len(lengths), n_blocks, len(ids)) + lengths.tobytes() + sums.tobytes() + np.concatenate(sizes).astype("<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + np.concatenate(words).astype("<u2").tobytes()


class Segment:
    """What ``pack`` wrote; blocks may be read alone."""

    def __init__(self, data: bytes) -> None:
        if len(data) < HEADER.size:
            raise DamagedBlock("the header is cut")
        magic, version, self.digits, self.block, docs, self.n_blocks, self.n = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise DamagedBlock("no segment of this version")
        end = HEADER.size + 8 * docs + 8 * self.n_blocks
        if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[:end]):
            raise DamagedBlock("the header does not have its checksum")
        self.lengths = np.frombuffer(data, "<u8", docs, HEADER.size).astype(np.int64)
        self.sums = np.frombuffer(data, "<u4", self.n_blocks, HEADER.size + 8 * docs)
        self.sizes = np.frombuffer(data, "<u4", self.n_blocks, HEADER.size + 8 * docs + 4 * self.n_blocks).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        words = np.frombuffer(data, "<u2", (len(data) - end - 4) // 2, end + 4)
        # a damaged block may ask for more words than there are
        self.words = np.concatenate([words, np.zeros(8 * self.block + 8, "<u2")]).astype(np.int64)

    def blocks(self, first: int, count: int) -> np.ndarray:
        """The ids of some blocks that stand together, checked."""
        count = min(count, self.n_blocks - first)
        if count <= 0:
            return np.zeros(0, "<u4")
        each = np.full(count, self.block)
        each[-1] = min(self.block, self.n - (first + count - 1) * self.block)
        at = self.starts[first : first + count]
        ids = _run(each, self.digits, None, _Coder(count, self.words, at)).T.ravel()[: int(each.sum())].astype("<u4")
        for i in range(count):
            if zlib.crc32(ids[i * self.block : (i + 1) * self.block]) != self.sums[first + i]:
                raise DamagedBlock(f"block {first + i} does not have its checksum")
        return ids

    def ids(self) -> np.ndarray:
        parts = [self.blocks(i, LANES) for i in range(0, self.n_blocks, LANES)]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")
