"""Ids of whole batches of texts by the `tokenizers` library: pieces are cut with numpy, and each distinct piece is encoded once.

Where a vocabulary cuts texts as byte-level ones do, by the usual expression for words, numbers, signs and white space, no
id crosses two pieces. Pieces of up to 16 bytes are kept in a table of bounded size and compared whole; longer ones in a
dictionary by their bytes. Texts that hold the string of a special token, and all texts where a vocabulary cuts in
another way, are encoded one by one. So the ids are those of the library in any case (tests compare them).
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from .words import U, mix

MASK, ODD = np.array([(1 << (8 * k)) - 1 for k in range(9)], U), U(0x9E3779B97F4A7C15)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Characters of white space, and the endings that an apostrophe takes along.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    out[SPACES] = SPACE
    return out


def pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, the byte starts and byte lengths of all pieces, and the first piece of each text (and their number)."""
    joined = "".join(texts)
    raw, sizes = joined.encode(), np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    n, docs = len(points), np.concatenate([[0], np.cumsum(sizes)])
    kind = np.empty(n + 1, np.uint8)
    kind[:n], kind[n] = _classes()[points], 255
    begins = np.zeros(n + 1, bool)
    begins[docs] = True
    starts = begins.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:])  # the last space before something else
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    if "'" in joined:
        for i in np.flatnonzero(points == 39).tolist():
            if starts[i] and kind[i + 1] == LETTER and not begins[i + 1]:
                end = int(docs[np.searchsorted(docs, i, side="right")])
                size = next((len(e) for e in ENDINGS if joined[i + 1 : min(end, i + 1 + len(e))] == e), 0)
                if size:
                    starts[i + 1] = False
                    starts[i + 1 + size] = True
    starts[n] = False
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, docs)
    if len(raw) != n:
        wide = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        at, end = wide[at], len(raw)
    else:
        end = n
    return raw, at, np.diff(np.concatenate([at, [end]])), first


def cuts_plainly(path: str) -> bool:
    """Whether the file's tokenizer cuts as `pieces` does and joins nothing across pieces."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut, model = made.get("pre_tokenizer") or {}, made["model"]
    return made.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("end_of_word_suffix")


class Encoder:
    """Ids of texts. The table of pieces seen is a hash table of 2 ** bits places, emptied when it would be over half full."""

    LONG = 1 << 16

    def __init__(self, path: str, plain_specials: bool = False, bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share their machine
        from tokenizers import Tokenizer

        self.tokenizer, self.bits = Tokenizer.from_file(path), bits
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = cuts_plainly(path)
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.words, self.sizes, self.rows = np.zeros((size, 2), U), np.zeros(size, np.uint8), np.full(size, -1, np.int32)
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0
        self.long: dict[bytes, int] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, words: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The row of each piece, or -1."""
        out, left, at = np.full(len(h), -1, np.int32), np.arange(len(h)), (h >> U(64 - self.bits)).astype(np.int64)
        while len(left):
            rows = self.rows[at]
            same = (self.words[at] == words[left]).all(1) & (self.sizes[at] == sizes[left]) & (rows >= 0)
            out[left[same]] = rows[same]
            on = ~same & (rows >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _store(self, found: list[list[int]]) -> np.ndarray:
        """Rows for new ids."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        base = int(self.starts[-1])
        if base + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[base : base + len(flat)] = flat
        row = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(found), dtype=np.int32)
        self.starts = np.concatenate([self.starts, base + np.cumsum(sizes)])
        return row

    def _add(self, words: np.ndarray, sizes: np.ndarray, h: np.ndarray, row: np.ndarray) -> None:
        at = (h >> U(64 - self.bits)).astype(np.int64)
        self.used += len(h)
        while len(h):  # each free place goes to one of those that want it
            free = np.flatnonzero(self.rows[at] < 0)
            self.rows[at[free]] = row[free]
            won = free[self.rows[at[free]] == row[free]]
            self.words[at[won]], self.sizes[at[won]] = words[won], sizes[won]
            lost = self.rows[at] != row
            words, sizes, h, row, at = words[lost], sizes[lost], h[lost], row[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        alone = {i for i, t in enumerate(texts) if not self.plain or any(s in t for s in self.specials)}
        flat, first = self._joined(["" if i in alone else t for i, t in enumerate(texts)]) if len(alone) < len(texts) else (None, [0] * (len(texts) + 1))
        one = dict(zip(sorted(alone), self.encode([texts[i] for i in sorted(alone)])))
        return [np.array(one[i], "<u4") if i in one else flat[first[i] : first[i + 1]] for i in range(len(texts))]

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text start (and their number)."""
        raw, at, lens, first = pieces(texts)
        data = np.frombuffer(raw + b" " * 17, np.uint8)
        view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        short = np.flatnonzero(lens <= 16)
        row = np.full(len(at), -1, np.int32)
        if self.used + len(short) > 1 << self.bits - 1 or len(self.starts) > 1 << self.bits or len(self.long) > self.LONG:
            self.clear()
        whole = np.stack([view[at[short]] & MASK[np.minimum(lens[short], 8)], view[at[short] + 8] & MASK[np.maximum(lens[short] - 8, 0)]], 1)
        sizes = lens[short].astype(np.uint8)
        h = mix(whole[:, 0] ^ mix(whole[:, 1] ^ sizes.astype(U) * ODD))
        for a in range(0, len(short), max(1, 1 << self.bits - 2)):  # a table of any size takes a text of any length
            part = slice(a, a + (1 << self.bits - 2))
            row[short[part]] = self._rows(raw, at[short[part]], lens[short[part]], whole[part], sizes[part], h[part])
        far = np.flatnonzero(lens > 16).tolist()
        spans = [raw[i : i + n] for i, n in zip(at[far].tolist(), lens[far].tolist())]
        new = list(dict.fromkeys(x for x in spans if x not in self.long))
        self.long.update(zip(new, self._store(self.encode([x.decode() for x in new])).tolist() if new else ()))
        row[far] = [self.long[x] for x in spans]
        begin, n = self.starts[row], self.starts[row + 1] - self.starts[row]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(begin - (ends - n), n) + np.arange(total)]
        return flat, np.concatenate([[0], ends])[first]

    def _rows(self, raw: bytes, at: np.ndarray, lens: np.ndarray, words: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
        row = self._find(words, sizes, h)
        while len(new := np.flatnonzero(row < 0)):  # more than once only for pieces of equal hashes
            where = new[np.unique(h[new], return_index=True)[1]]
            made = self._store(self.encode([raw[a : a + n].decode() for a, n in zip(at[where].tolist(), lens[where].tolist())]))
            if self.used + len(where) > 1 << self.bits - 1:  # rows given so far stay; only the places are emptied
                self.words[:], self.sizes[:], self.rows[:], self.used = 0, 0, -1, 0
            self._add(words[where], sizes[where], h[where], made)
            row[new] = self._find(words[new], sizes[new], h[new])
        return row


@lru_cache(maxsize=1)
def encoder(path: str, plain_specials: bool) -> Encoder:
    return Encoder(path, plain_specials)
