"""Elias-Fano sequences and one part of an n-gram trie, laid out in a byte buffer that is mapped and searched as it is."""

from __future__ import annotations

import mmap
import struct

import numpy as np

U64 = np.uint64


#: How many bits of each byte are set, and where the first, second, ... set bit of each byte is.
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COUNT = _ONES.sum(axis=1).astype(np.uint8)
_NTH = np.argsort(1 - _ONES.astype(np.int8), axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A rising sequence of n whole numbers below `universe`: each one's low bits side by side, the high bits as unary gaps, and for
    every 64 bits of these the number of elements before them. Elements are found in the packed bytes; nothing is unpacked."""

    def __init__(self, buffer: memoryview):
        self.n, self.low_bits, high_bytes, low_bytes = struct.unpack_from("<QQQQ", buffer)
        words = high_bytes // 8
        self.size = 32 + high_bytes + low_bytes + 8 * words
        self._high = np.frombuffer(buffer, np.uint8, high_bytes, 32).reshape(-1, 8)
        low = np.frombuffer(buffer, np.uint8, low_bytes, 32 + high_bytes)
        self._before = np.frombuffer(buffer, np.int64, words, 32 + high_bytes + low_bytes)
        # eight bytes from each byte on, without a copy; the low part ends in eight spare bytes
        self._low = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), (low_bytes - 7,), (1,))

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = min(bits, 56)
        high = (values >> U64(bits)).astype(np.int64)
        unary = np.zeros(-(-(int(high[-1]) + n + 1 if n else 1) // 64) * 64, dtype=np.uint8)
        unary[high + np.arange(n)] = 1
        packed = np.packbits(unary, bitorder="little")
        before = np.cumsum(np.concatenate(([0], _COUNT[packed].reshape(-1, 8).sum(axis=1, dtype=np.int64))))[:-1]
        low = np.zeros((n, bits), dtype=np.uint8)
        for k in range(bits):
            low[:, k] = (values >> U64(k)) & U64(1)
        low_packed = np.packbits(low.ravel(), bitorder="little").tobytes()
        low_packed += bytes(8 + -len(low_packed) % 8)
        return struct.pack("<QQQQ", n, bits, len(packed), len(low_packed)) + packed.tobytes() + low_packed + before.astype(np.int64).tobytes()

    def _place(self, rank: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """The place of the bit of each rank (from 0) among the set bits, or with flip 255 among the others; before: how many stand before each word."""
        out = np.empty(len(rank), dtype=np.int64)
        for first in range(0, len(rank), 1 << 16):
            own = rank[first : first + (1 << 16)]
            word = np.searchsorted(before, own, side="right") - 1
            data = self._high[word] ^ np.uint8(flip)
            upto = np.cumsum(_COUNT[data], axis=1, dtype=np.int64)
            left = own - before[word]
            byte = np.minimum((upto <= left[:, None]).sum(axis=1), 7)
            row = np.arange(len(own))
            left -= np.where(byte > 0, upto[row, np.maximum(byte, 1) - 1], 0)
            out[first : first + len(own)] = word * 64 + byte * 8 + _NTH[data[row, byte], np.minimum(left, 7)]
        return out

    def at(self, index: np.ndarray) -> np.ndarray:
        """The values at some places."""
        high = (self._place(index, self._before, 0) - index).astype(U64) << U64(self.low_bits)
        if not self.low_bits:
            return high
        bit = index * self.low_bits
        return high | ((self._low[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.low_bits) - 1))

    def successor(self, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The first place in [first, last) whose value is at least `value`, or last: the values of one high part, one by one."""
        high = (value >> U64(self.low_bits)).astype(np.int64)
        zeros = np.arange(len(self._before)) * 64 - self._before
        # elements below a high part stand before the gap that ends the part below it
        inside = (high > 0) & (high <= 64 * len(self._before) - self.n)
        place = np.where(high > 0, self.n, 0)
        place[inside] = self._place(high[inside] - 1, zeros, 255) - (high[inside] - 1)
        place = np.clip(np.minimum(place, self.n), first, last)
        open_ = np.flatnonzero(place < last)
        while len(open_):
            below = self.at(place[open_]) < value[open_]
            open_ = open_[below]
            place[open_] += 1
            open_ = open_[place[open_] < last[open_]]
        return place


class TriePart:
    """Two levels: contexts, and the successors of each. A successor is stored relative to its context: its number plus the
    context's rank times the alphabet, so that the whole level rises and one sequence holds it. Values are one byte each."""

    WORD_BITS = 24

    def __init__(self, buffer: memoryview):
        self.contexts = EliasFano(buffer)
        at = self.contexts.size
        self.pointers = EliasFano(buffer[at:])
        at += self.pointers.size
        self.successors = EliasFano(buffer[at:])
        at += self.successors.size
        self.values = np.frombuffer(buffer, np.uint8, self.successors.n, at)

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, values: np.ndarray) -> bytes:
        """From distinct (context, successor) in rising order, both below 2**24, and their values."""
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        rank = np.cumsum(np.bincount(first, minlength=len(context))[: len(context)]) - 1
        return b"".join([
            EliasFano.encode(context[first].astype(U64), 1 << cls.WORD_BITS),
            EliasFano.encode(np.append(first, len(context)).astype(U64), len(context) + 1),
            EliasFano.encode(successor.astype(U64) + (rank.astype(U64) << U64(cls.WORD_BITS)), max(1, len(first)) << cls.WORD_BITS),
            values.astype(np.uint8).tobytes() + bytes(-len(values) % 8),
        ])

    @classmethod
    def mapped(cls, data: bytes) -> TriePart:
        """The trie over an anonymous memory map of its bytes."""
        view = mmap.mmap(-1, len(data))
        view.write(data)
        return cls(memoryview(view))

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The value of each n-gram, 0 where the trie has none."""
        n = len(context)
        out = np.zeros(n, dtype=np.uint8)
        if not self.contexts.n or not n:
            return out
        rank = self.contexts.successor(context.astype(U64), np.zeros(n, np.int64), np.full(n, self.contexts.n))
        known = np.flatnonzero(rank < self.contexts.n)
        known = known[self.contexts.at(rank[known]) == context[known].astype(U64)]
        rank = rank[known]
        first, last = (self.pointers.at(rank + k).astype(np.int64) for k in (0, 1))
        target = successor[known].astype(U64) + (rank.astype(U64) << U64(self.WORD_BITS))
        place = self.successors.successor(target, first, last)
        inside = place < last
        hit = np.zeros(len(place), dtype=bool)
        hit[inside] = self.successors.at(place[inside]) == target[inside]
        out[known[hit]] = self.values[place[hit]]
        return out
