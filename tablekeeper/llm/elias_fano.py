"""Elias-Fano coded monotone sequences and the two-level trie of a bigram model, over mapped files."""

import os
import tempfile

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
# Place of the k-th zero within each byte.
_ZERO_AT = np.full((256, 8), 8, np.int64)
for _b in range(256):
    _places = np.flatnonzero(_BITS[_b] == 0)
    _ZERO_AT[_b, :len(_places)] = _places
_CHUNK = 1 << 18


class EliasFano:
    """A sequence of ascending numbers below ``universe``: ``width`` low bits each as they are, high bits in
    unary, and per 64 high bits the number of zeros before. ``arrays()`` has all there is to store."""

    def __init__(self, values, universe):
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        ratio = int(universe) // max(1, self.n)
        self.width = min(56, max(0, ratio.bit_length() - 1))
        shift = np.uint64(self.width)
        high = (values >> shift).astype(np.int64)
        self.buckets = (int(universe) >> self.width) + 1
        bits = np.zeros(-(-(self.n + self.buckets + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.high = np.packbits(bits, bitorder="little")
        ones = _ONES[self.high].reshape(-1, 8).sum(axis=1)
        self.zeros = np.concatenate(([0], np.cumsum(64 - ones)))
        low = []
        for at in range(0, self.n, _CHUNK):
            part = np.ascontiguousarray(values[at:at + _CHUNK]).view(np.uint8).reshape(-1, 8)
            low.append(np.packbits(
                np.unpackbits(part, axis=1, bitorder="little")[:, :self.width].ravel(), bitorder="little"))
        self.low = np.concatenate(low + [np.zeros(8, np.uint8)])

    @classmethod
    def of(cls, n, width, buckets, high, zeros, low):
        """The sequence with these stored parts."""
        out = cls.__new__(cls)
        out.n, out.width, out.buckets = n, width, buckets
        out.high, out.zeros, out.low = high, zeros, low
        return out

    def arrays(self):
        return {"high": self.high, "zeros": self.zeros, "low": self.low}

    def _low(self, i):
        if self.width == 0:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.width
        # eight bytes from each byte on; the array ends with eight spare ones
        raw = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))[bit >> 3]
        return (raw >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def _select_zero(self, k):
        """Position of zero number k."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left = k - self.zeros[word]
        byte = word * 8
        for _ in range(7):
            here = 8 - _ONES[self.high[byte]]
            go = left >= here
            left = np.where(go, left - here, left)
            byte = byte + go
            if not go.any():
                break
        return byte * 8 + _ZERO_AT[self.high[byte], left]

    def _first(self, bucket):
        """Number of values whose high bits are below ``bucket``."""
        out = np.zeros(len(bucket), np.int64)
        some = bucket > 0
        k = np.minimum(bucket[some], self.buckets) - 1
        out[some] = self._select_zero(k) - k
        return np.minimum(out, self.n)

    def search(self, x):
        """(index of the first value not below each x, n if there is none; whether that value is x)."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        at, end = self._first(bucket), self._first(bucket + 1)
        wanted = x & np.uint64((1 << self.width) - 1)
        low, high = at, end.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):  # binary search within the buckets
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < wanted[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        held = low < end
        held[held] = self._low(low[held]) == wanted[held]
        return low, held

    def successor(self, x):
        """Index of the first value not below each x (n if there is none)."""
        return self.search(x)[0]

    def access(self, i):
        """Values at the indices i, by binary search for their bucket."""
        i = np.asarray(i, np.int64)
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.buckets, np.int64)
        while (low < high).any():
            middle = (low + high) >> 1
            go = self._first(middle + 1) <= i
            low, high = np.where(go, middle + 1, low), np.where(go, high, middle)
        return (low.astype(np.uint64) << np.uint64(self.width)) | self._low(i)


# Kinds of number of a stored trie's arrays: three sequences (high, zeros, low), then counts and codes.
_KINDS = ("u1", "i8", "u1") * 3 + ("i8", "u2", "u2", "u2")
_HEAD = 1 + 9 + len(_KINDS)
_ALIGN = 16


def _aligned(n):
    return -(-n // _ALIGN) * _ALIGN


class BigramTrie:
    """Level 1: words by hash, each with its count, two codes and a pointer. Level 2: the words seen before
    it, each with a code. Pointers and both levels are Elias-Fano coded.

    The sequence of level 2 is monotone over all words, as a context is kept relative to its word: number of
    the word above, hash of the context below. ``stored()`` gives the trie as bytes, ``mapped()`` opens them.
    """

    def __init__(self, words, counts, unseen, weights, parents, contexts, codes, bits):
        self.bits = bits
        relative = (parents.astype(np.uint64) << np.uint64(bits)) | contexts
        starts = np.searchsorted(parents, np.arange(len(words) + 1))
        self.words = EliasFano(words, 1 << 64)
        self.contexts = EliasFano(relative, max(1, len(words)) << bits)
        self.pointers = EliasFano(starts, len(parents) + 1)
        self.counts, self.unseen, self.weights, self.codes = counts, unseen, weights, codes

    def _sequences(self):
        return self.words, self.contexts, self.pointers

    def stored(self):
        """Header (bits; size, width and buckets of each sequence; length of each array), then the arrays."""
        arrays = [a for s in self._sequences() for a in (s.high, s.zeros, s.low)]
        arrays += [self.counts, self.unseen, self.weights, self.codes]
        head = [self.bits, *(x for s in self._sequences() for x in (s.n, s.width, s.buckets)), *map(len, arrays)]
        parts = [np.array(head, "i8").tobytes()] + [
            np.ascontiguousarray(a, kind).tobytes() for a, kind in zip(arrays, _KINDS)]
        return b"".join(part.ljust(_aligned(len(part)), b"\0") for part in parts)

    @classmethod
    def mapped(cls, data):
        """The trie of ``stored()`` bytes, copied to an unnamed file among Spark's scratch files and mapped:
        pages are read as queries touch them, and the file goes with the object."""
        scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryFile(dir=scratch or None) as file:
            file.write(data)
            file.flush()
            whole = np.memmap(file, np.uint8, "r")
        head = whole[:_HEAD * 8].view("i8").tolist()
        at, arrays = _aligned(_HEAD * 8), []
        for length, kind in zip(head[10:], _KINDS):
            size = length * np.dtype(kind).itemsize
            arrays.append(whole[at:at + size].view(kind))
            at += _aligned(size)
        out = cls.__new__(cls)
        out.bits = head[0]
        out.words, out.contexts, out.pointers = (
            EliasFano.of(*head[1 + 3 * k:4 + 3 * k], *arrays[3 * k:3 * k + 3]) for k in range(3))
        out.counts, out.unseen, out.weights, out.codes = arrays[9:]
        return out

    def find_words(self, hashes):
        """Numbers of the words, -1 for unknown ones."""
        i, held = self.words.search(hashes)
        return np.where(held, i, -1)

    def find(self, word, context):
        """Codes of (word number, context hash): that of the pair, or of the word where the pair is unseen."""
        relative = (word.astype(np.uint64) << np.uint64(self.bits)) | context
        j, held = self.contexts.search(relative)
        number, inverse = np.unique(word, return_inverse=True)
        # The successor must lie in the word's own range.
        end = self.pointers.access(number + 1).astype(np.int64)[inverse] if len(number) else number
        seen = held & (j < end)
        out = self.unseen[word].astype(np.int64)
        out[seen] = self.codes[j[seen]]
        return out
