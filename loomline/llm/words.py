"""Words and their hashes over whole batches of texts, with numpy on UTF-8 bytes.

Every separator of the word patterns used here is ASCII, so splitting bytes splits characters alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes as they are, white space as a space.
SPACED = bytes(32 if b in b"\t\n\x0b\x0c\r " else b for b in range(256))
#: The same in lower case.
SPACED_LOWER = bytes(SPACED[LOWER[b]] for b in range(256))
#: Only digits, lower-case letters and bytes outside ASCII are word bytes.
ALNUM_LOWER = bytes(c if chr(c := LOWER[b]).isalnum() and c < 128 or c >= 128 else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _C2
    x ^= x >> U(29)
    x *= _C3
    x ^= x >> U(32)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:start + len], of a function for each seed. data ends in eight bytes that belong to no span."""
    view = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    h = lens.astype(U) * _C1 ^ mix(np.array([seed], U))
    if not len(starts):
        return h
    h = mix(h ^ (view[starts] & _MASK[np.minimum(lens, 8)]))
    rest, k = np.flatnonzero(lens > 8), 8
    while len(rest):
        left = lens[rest] - k
        h[rest] = mix((h[rest] + _C1) ^ (view[starts[rest] + k] & _MASK[np.minimum(left, 8)]))
        rest, k = rest[left > 8], k + 8
    return h


class Words:
    """The words of some texts: data (bytes in normal form), starts, lens, and first (the words of text i are first[i] up to first[i + 1])."""

    def __init__(self, texts: list[bytes | None], table: bytes):
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.raw = b" " + b" ".join(t or b"" for t in texts).translate(table) + b" " * 9
        self.data = np.frombuffer(self.raw, np.uint8)
        inside = self.data != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.lens = edges[0::2], edges[1::2] - edges[0::2]
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1
        self.first = np.searchsorted(self.starts, self.at)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.lens, seed)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def joined(self, i: int, n: int) -> bytes:
        """Words i to i + n - 1 with one space between each."""
        return b" ".join(self.raw[self.starts[i] : self.starts[i + n - 1] + self.lens[i + n - 1]].split(b" ")) if n == 1 else b" ".join(w for w in self.raw[self.starts[i] : self.starts[i + n - 1] + self.lens[i + n - 1]].split(b" ") if w)


def rolling(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of the windows of n consecutive entries; as many as h has entries, the last n - 1 without meaning.

    Windows of powers of two are joined from halves, and the window of n from those in the binary form of n.
    """
    if len(h) < n:
        return np.zeros(len(h), U)
    odd = np.random.default_rng(seed).integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
    out, size, part, width, k = None, 0, h, 1, 0
    while True:
        if n & width:
            if out is None:
                out, size = part.copy(), width
            else:
                out *= odd[2 * k]
                out[: len(h) - size] += part[size:]
                size += width
        width, k = width * 2, k + 1
        if width > n:
            return mix(out)
        half = width // 2
        part, last = part * odd[2 * k + 1], part
        part[: len(h) - half] += last[half:]


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Indices of the words at which a window of n words of one text starts."""
    counts = np.diff(first)
    many = np.maximum(counts - n + 1, 0)
    total = int(many.sum())
    return np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1], many) if total else np.zeros(0, np.int64)


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes; a longer text is a run of its own."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t or b"") > most:
            yield i, j
            i, size = j, 0
        size += len(t or b"") + 1
    if i < len(texts):
        yield i, len(texts)
