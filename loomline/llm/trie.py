"""An n-gram trie of Elias-Fano levels in one buffer, which may be a memory map.

Order three: contexts v, their successors w, their histories u, and the successors of each (u, v). Identifiers within a
level grow within each parent only, so each parent's are raised by the last value before: the whole level is monotone
and is coded by Elias-Fano, as are the pointers to children. A successor under (u, v) is stored relative to its context,
as its position among the successors of v; a query finds w among those first and then looks for that small position.
Nothing is unpacked to query a level: its bits stay packed, beside a directory of two bits for each number.
Log-probabilities and back-off weights are quantised to 256 values each.

Cases: a level without numbers finds nothing, and a trie without contexts answers with the words' own probabilities; equal
queries are answered alike; ties do not occur, as the numbers within a parent are distinct.
"""

from __future__ import annotations

import pickle

import numpy as np

from .words import U


#: The place of the k-th set bit of a byte.
_SELECT = np.array([[next((i for i in range(8) if byte >> i & 1 and bin(byte & ((1 << i) - 1)).count("1") == k), 0) for k in range(8)] for byte in range(256)], np.uint8)


def _kth_bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each word."""
    words, k, at = words.copy(), k.copy(), np.zeros(len(words), np.int64)
    for half in (32, 16, 8):
        below = np.bitwise_count(words & U((1 << half) - 1)).astype(np.int64)
        up = k >= below
        k -= np.where(up, below, 0)
        at += np.where(up, half, 0)
        words >>= np.where(up, U(half), U(0))
    return at + _SELECT[(words & U(255)).astype(np.int64), k]


class EliasFano:
    """Monotone numbers: the low bits of each, packed, and the high bits in unary, both left packed.

    A directory counts the ones and the zeros before each word of the high bits: about two bits for a number.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width, self.low, self.high = int(arrays["meta"][0]), int(arrays["meta"][1]), arrays["low"], arrays["high"]
        self.zeros = int(arrays["meta"][2])
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        kind = np.uint32 if len(self.high) < 1 << 26 else np.int64
        self.before = np.concatenate([[0], ones[:-1]]).astype(kind)
        self.zeros_before = (np.arange(len(self.high), dtype=np.int64) * 64 - self.before).astype(kind)

    @staticmethod
    def coded(x: np.ndarray) -> dict[str, np.ndarray]:
        n, top = len(x), int(x[-1]) + 1 if len(x) else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        at = np.arange(n, dtype=U) * U(width)
        low = np.zeros((n * width + 63) // 64 + 1, U)
        part = x.astype(U) & U((1 << width) - 1)
        if width:
            np.bitwise_or.at(low, at >> U(6), part << (at & U(63)))
            over = np.flatnonzero((at & U(63)) + U(width) > 64)
            np.bitwise_or.at(low, (at[over] >> U(6)) + U(1), part[over] >> (U(64) - (at[over] & U(63))))
        upper = (x.astype(U) >> U(width)).astype(np.int64)
        zeros = (int(upper[-1]) if n else 0) + 1
        bits = np.zeros(-(-(n + zeros) // 64) * 64, np.uint8)
        bits[upper + np.arange(n)] = 1
        return {"meta": np.array([n, width, zeros], np.int64), "low": low, "high": np.packbits(bits, bitorder="little").view("<u8")}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, bit = (at >> U(6)).astype(np.int64), at & U(63)
        over = bit + U(self.width) > U(64)
        out = self.low[word] >> bit
        out[over] |= self.low[word[over] + 1] << (U(64) - bit[over])
        return out & U((1 << self.width) - 1)

    def _one(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th one."""
        word = np.searchsorted(self.before, i.astype(self.before.dtype), side="right") - 1
        return (word << 6) + _kth_bit(self.high[word], i - self.before[word].astype(np.int64))

    def _zero(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th zero."""
        word = np.searchsorted(self.zeros_before, i.astype(self.zeros_before.dtype), side="right") - 1
        return (word << 6) + _kth_bit(~self.high[word], i - self.zeros_before[word].astype(np.int64))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (((self._one(i) - i).astype(U) << U(self.width)) | self._low(i)).astype(np.int64)

    def successor(self, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first index in [lo, hi) whose number is target or more (hi if none)."""
        upper = (target.astype(U) >> U(self.width)).astype(np.int64)
        far = upper >= self.zeros
        upper = np.minimum(upper, self.zeros - 1)
        a = np.where(upper > 0, self._zero(np.maximum(upper - 1, 0)) + 1 - upper, 0)
        b = np.minimum(self._zero(upper) - upper, self.n)
        a, b = np.where(far, self.n, a), np.where(far, self.n, b)
        a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        want = target.astype(U) & U((1 << self.width) - 1)
        left = np.flatnonzero(a < b)
        while len(left):  # the numbers of equal high bits are few: halve them
            mid = (a[left] + b[left]) >> 1
            less = self._low(mid) < want[left]
            a[left] = np.where(less, mid + 1, a[left])
            b[left] = np.where(less, b[left], mid)
            left = left[a[left] < b[left]]
        return a

    def find(self, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The index in [lo, hi) of target, or -1; in a range of one number that is looked at, in others its successor is searched."""
        out = np.full(len(lo), -1, np.int64)
        at, many = lo.copy(), np.flatnonzero(hi - lo > 1)
        at[many] = self.successor(lo[many], hi[many], target[many])
        inside = np.flatnonzero(at < hi)
        same = inside[self[at[inside]] == target[inside]]
        out[same] = at[same]
        return out


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 8 bits, and the mean of each code's numbers: half of the bins' edges even in counts, half even in width."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    edges = np.sort(np.concatenate([np.quantile(x, np.arange(1, 128) / 128), np.linspace(x.min(), x.max(), 130)[1:-1]]))
    codes = np.searchsorted(edges, x, side="left").astype(np.uint8)
    n = np.bincount(codes, minlength=256)
    return codes, (np.bincount(codes, x, 256) / np.maximum(n, 1)).astype(np.float32)


def raised(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers that grow within each group (of which first are the starts), raised by the last number before the group."""
    if not len(x):
        return x.astype(np.int64)
    ends = np.append(first[1:], len(x)) - 1
    before = np.concatenate([[0], np.cumsum(x[ends])[:-1]])
    return x + np.repeat(before, ends + 1 - first)


class Trie:
    LEVELS = ("contexts", "next_at", "next", "past_at", "past", "then_at", "then")

    def __init__(self, buffer):
        size = int(np.frombuffer(buffer, "<i8", 1)[0])
        arrays = {name: np.frombuffer(buffer, kind, n, 8 + size + at) for name, (kind, n, at) in pickle.loads(bytes(memoryview(buffer)[8 : 8 + size])).items()}
        for level in self.LEVELS:
            setattr(self, level, EliasFano({k: arrays[f"{level}.{k}"] for k in ("meta", "low", "high")}))
        for name in ("next_p", "then_p", "next_back", "then_back"):
            setattr(self, name, (arrays[f"{name}.codes"], arrays[f"{name}.values"]))

    @classmethod
    def build(cls, v: np.ndarray, w: np.ndarray, p2: np.ndarray, back2: np.ndarray, tv: np.ndarray, tu: np.ndarray, tw: np.ndarray, p3: np.ndarray, back3: np.ndarray, contexts: tuple | None = None, pasts: tuple | None = None) -> bytes:
        """From pairs sorted by (v, w) and triples sorted by (v, u, w): log-probabilities, and the back-off weight of each pair's v and each triple's (u, v).

        contexts (v, weight) and pasts (v, u, weight), sorted, are given where some have no successor here.
        """
        arrays: dict[str, np.ndarray] = {}

        def level(name: str, x: np.ndarray) -> None:
            arrays.update({f"{name}.{k}": a for k, a in EliasFano.coded(x).items()})

        def codes(name: str, x: np.ndarray) -> None:
            arrays[f"{name}.codes"], arrays[f"{name}.values"] = quantised(x)

        if contexts is None:
            own, at = np.unique(v, return_index=True)
            contexts = own, back2[at]
        if pasts is None:
            new = np.ones(len(tv), bool)
            new[1:] = (tv[1:] != tv[:-1]) | (tu[1:] != tu[:-1])
            pasts = tv[new], tu[new], back3[new]
        (own, back), (pv, pu, past_back) = contexts, pasts
        join = lambda a, b: (a.astype(np.int64) << 32) | b
        filled = lambda starts: starts[:-1][starts[:-1] < starts[1:]]
        level("contexts", own)
        first = np.append(np.searchsorted(v, own), len(v))
        level("next_at", first)
        level("next", raised(w, filled(first)))
        codes("next_p", p2)
        codes("next_back", back)
        starts = np.append(np.searchsorted(pv, own), len(pv))
        level("past_at", starts)
        level("past", raised(pu, filled(starts)))
        place = np.searchsorted(join(v, w), join(tv, tw)) - first[np.searchsorted(own, tv)]
        starts = np.append(np.searchsorted(join(tv, tu), join(pv, pu)), len(tv))
        level("then_at", starts)
        level("then", raised(place, filled(starts)))
        codes("then_p", p3)
        codes("then_back", past_back)
        places, at = {}, 0
        for name, a in arrays.items():
            places[name] = (a.dtype.str, len(a), at)
            at += -(-a.nbytes // 8) * 8
        head = pickle.dumps(places)
        head += b" " * (-len(head) % 8)
        return b"".join([np.array([len(head)], "<i8").tobytes(), head, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())])

    @staticmethod
    def _coded(of: tuple, i: np.ndarray) -> np.ndarray:
        return of[1][of[0][i]].astype(float)

    @staticmethod
    def _range(pointers: EliasFano, level: EliasFano, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children of each parent, and what their numbers are raised by."""
        lo, hi = pointers[parent], pointers[parent + 1]
        base = np.zeros(len(lo), np.int64)
        some = np.flatnonzero(lo > 0)
        base[some] = level[lo[some] - 1]
        return lo, hi, base

    def log_p(self, v: np.ndarray, w: np.ndarray, log_base: np.ndarray, pv: np.ndarray, pu: np.ndarray, pair: np.ndarray, past: np.ndarray) -> np.ndarray:
        """log10 p(w | u, v), u before v, of n-grams given by their pair's place in (v, w) and their past's place in (pv, pu).

        log_base is that of each w without context. Each context, pair and past is searched once, however many n-grams it is in.
        """
        out, place, context = log_base.astype(float).copy(), np.full(len(v), -1, np.int64), np.full(len(v), -1, np.int64)
        if not self.contexts.n:
            return out[pair]

        def contexts_of(v: np.ndarray) -> np.ndarray:
            own, of = np.unique(v, return_inverse=True)
            every = np.zeros(len(own), np.int64)
            return self.contexts.find(every, every + self.contexts.n, own)[of]

        def each(pointers: EliasFano, level: EliasFano, parents: np.ndarray) -> tuple[np.ndarray, ...]:
            own, of = np.unique(parents, return_inverse=True)
            return tuple(x[of] for x in self._range(pointers, level, own))

        context = contexts_of(v)
        k = np.flatnonzero(context >= 0)
        lo, hi, base = each(self.next_at, self.next, context[k])
        at = self.next.find(lo, hi, base + w[k])
        seen = at >= 0
        out[k[seen]] = self._coded(self.next_p, at[seen])
        out[k[~seen]] += self._coded(self.next_back, context[k[~seen]])
        place[k[seen]] = (at - lo)[seen]  # context-relative
        answer = out[pair]
        if not self.past.n:
            return answer
        context, found = contexts_of(pv), np.full(len(pv), -1, np.int64)
        k = np.flatnonzero(context >= 0)
        lo, hi, base = each(self.past_at, self.past, context[k])
        found[k] = self.past.find(lo, hi, base + pu[k])
        ranges = np.zeros((3, len(pv)), np.int64)
        k = np.flatnonzero(found >= 0)
        ranges[:, k] = self._range(self.then_at, self.then, found[k])
        lo, hi, base = ranges
        then = np.full(len(pair), -1, np.int64)
        k = np.flatnonzero((found[past] >= 0) & (place[pair] >= 0))
        then[k] = self.then.find(lo[past[k]], hi[past[k]], base[past[k]] + place[pair[k]])
        k = np.flatnonzero(then >= 0)
        answer[k] = self._coded(self.then_p, then[k])
        k = np.flatnonzero((then < 0) & (found[past] >= 0))
        answer[k] += self._coded(self.then_back, found[past[k]])
        return answer
