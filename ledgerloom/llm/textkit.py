"""Numpy kernels over UTF-8 bytes: many texts at once are cut into words and the words are hashed without a
Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: True for bytes between words: `\x20` and `\x09`-`\x0D`.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for all bytes but ASCII letters, digits and those of non-ASCII characters.
NON_WORD = np.ones(256, bool)
NON_WORD[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = False


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts: byte ranges [start, end) in one buffer, and the text each belongs to."""

    def __init__(self, texts: list[bytes], separators: np.ndarray) -> None:
        self.data = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.data, np.uint8)
        gap = separators[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.r_[0, edge]
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        #: Words of text i are number first[i] up to first[i + 1].
        self.first = np.r_[0, np.searchsorted(self.start, ends)].astype(np.int64)
        self._sums: np.ndarray | None = None

    def hashes(self, prefix: int | None = None, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word, or of its first `prefix` bytes."""
        if self._sums is None:
            self._sums = hash_sums(self.buf)
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        return range_hashes(self._sums, self.start, end, seed)


def hash_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums from which range_hashes has the hash of any byte range of buf."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf + np.uint64(1)) * _POWERS.get(len(buf))[0], dtype=np.uint64, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _POWERS.get(len(sums))[1][start] + np.uint64(seed))


def chunks(ids: list, texts: list[str | None], limit: int = 1 << 18, lower: bool = False) -> Iterator[tuple[list, list[bytes]]]:
    """Cuts a batch into runs of texts of about `limit` bytes together, so that memory follows neither the
    batch nor the number of rows; one text is never cut."""
    own: list = []
    data: list[bytes] = []
    size = 0
    for i, t in zip(ids, texts, strict=True):
        b = ("" if t is None else t.lower() if lower else t).encode("utf-8", "surrogatepass")
        if data and size + len(b) > limit:
            yield own, data
            own, data, size = [], [], 0
        own.append(i)
        data.append(b)
        size += len(b) + 1
    if data:
        yield own, data


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
