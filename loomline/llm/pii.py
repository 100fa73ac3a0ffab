"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Candidates of a kind (email, ip, card, phone) are the base spans and those of looser patterns that overlap no base span:
written-out addresses, IPv6 and defanged addresses, card numbers of any checksum, national and 00-prefixed numbers. Each
kind has labelers of its own, which look at different things and may disagree: regular expressions on the written shape,
checks of the structure (Luhn's sum, lengths by issuer, area codes, labels of a domain, ranges of addresses), gazetteers
(top-level domains, calling codes, issuer prefixes), cue words in the text before, and the characters around the span.
No two labelers of a kind use the same evidence, and none looks at which pattern found the span. They vote yes, no or
abstain. Vote patterns of all documents are counted (22,000 a kind at the very most); expectation-maximisation over the counts
gives each labeler's reliability and each pattern a probability, and a logistic span classifier is fitted to those, on
votes and span features. Its spans are added to the base spans, which stay in any case.

Cases: a null text counts as empty and has no span; repeated rows are judged (and counted) one by one; an empty table
gives an empty result; the patterns take time in proportion to a text's length; other columns play no part.
"""

from __future__ import annotations

import ipaddress
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import table, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match cannot start within digits: it would start with them.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"(?i)\bat\b")
#: Looser patterns; bounded on both sides, so that they start in a few places only.
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\bdot\b) ?)[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+(])(?:\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4})(?![0-9A-Za-z])"),
}
#: What the gazetteers and the cue words know. Top-level domains of countries have two letters.
DOMAINS = frozenset("com org net edu gov mil int info biz name pro coop aero museum jobs mobi travel cat tel post app dev xyz online site shop store tech blog cloud email live news world page art bank wiki example test invalid".split())
CODES = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 248 249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 "
    "350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 420 421 423 "
    "501 502 503 504 505 506 507 509 591 592 593 594 595 596 597 598 599 670 673 675 676 677 678 679 685 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
)
#: Issuers: least and greatest prefix, and the lengths of their numbers.
ISSUERS = ((34, 34, (15,)), (37, 37, (15,)), (300, 305, (14,)), (36, 36, (14,)), (38, 39, (14,)), (3528, 3589, (16,)), (4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (6011, 6011, (16, 19)), (644, 649, (16, 19)), (65, 65, (16, 19)), (62, 62, (16, 17, 18, 19)), (50, 50, (16,)), (56, 58, (16,)))
CUES = {
    "email": ("mail", "contact", "write", "reach", "correo", "adresse", "courriel"),
    "ip": ("ip", "host", "server", "address", "ping", "from", "addr"),
    "card": ("card", "visa", "pay", "credit", "debit", "tarjeta", "carte", "karte"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "whatsapp", "ring"),
}
AGAINST = {
    "email": ("look", "meet", "arriv", "stay"),
    "ip": ("version", "section", "chapter", "release", "time", "clock"),
    "card": ("token", "order", "isbn", "serial", "hash", "id", "tracking", "account"),
    "phone": ("order", "isbn", "serial", "part", "ref", "id", "case", "ticket"),
}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    if kind == "email":
        return "." in s
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    digits = digits_of(s)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, number of the kind, end) of the base patterns, in order."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)) if _DIGIT.search(text) else ():
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m.group())]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """Spans of the looser patterns that overlap no base span and none before, (start, kind, end)."""
    digits = _DIGIT.search(text) is not None
    may = {"email": _AT.search(text) is not None, "ip": text.count(":") >= 2 or "[.]" in text, "card": digits, "phone": digits}
    found = sorted(((m.start(), k, m.end()) for k, kind in enumerate(KINDS) if may[kind] for m in _LOOSE[kind].finditer(text)), key=lambda x: (x[0], -x[1]))  # a phone number before a card
    out, taken = [], sorted((s, e) for s, _, e in base)
    i = end = 0
    for s, k, e in found:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= end and not (i < len(taken) and taken[i][0] < e):
            out.append((s, k, e))
            end = e
    return out


def _says(yes: bool | None) -> int:
    return -1 if yes is None else int(yes)


def _email(s: str) -> list[int]:
    name, _, domain = re.sub(r"(?i) ?(?:\(at\)|\[at\]|\bat\b) ?", "@", s, count=1).partition("@") if "@" not in s else s.partition("@")
    labels = [x for x in re.split(r"(?i)\.| ?(?:\(dot\)|\[dot\]|\bdot\b) ?", domain)]
    last = labels[-1].lower()
    return [
        int(last in DOMAINS or (len(last) == 2 and last.isalpha())),  # gazetteer
        int(len(labels) > 1 and all(x and len(x) <= 63 and x[0] != "-" != x[-1] for x in labels)),  # structure of the domain
        int(any(c.isalpha() for c in name) and name[0] not in ".-%" and name[-1] != "." and ".." not in name),  # structure of the name
        _says(True if "@" in s or "(" in s or "[" in s else None if s.isupper() or "AT" in s else False),  # shape: marks of an address, not prose
    ]


def _ip(s: str) -> list[int]:
    try:
        at = ipaddress.ip_address(s.replace("[.]", "."))
    except ValueError:  # parts beyond their range, leading zeros or too few groups
        at = None
    parts = re.split(r"[:.\[\]]+", s)
    return [
        _says(None if at is None else not (at.is_unspecified or at.is_multicast or at.is_reserved or at.is_link_local)),  # gazetteer of ranges
        int(at is not None),  # structure
        _says(len(set(parts)) > 2 if ":" in s else not all(len(p) == 1 for p in parts)),  # shape: a version or a clock has short, equal parts
        _says(any(c in "abcdefABCDEF" for c in s) or None if ":" in s else None if "[" in s else not any(len(p) > 1 and p[0] == "0" for p in parts)),  # notation
    ]


def _card(s: str) -> list[int]:
    digits = digits_of(s)
    runs = tuple(len(r) for r in re.split(r"[ -]+", s))
    return [
        int(any(least <= int(digits[: len(str(least))]) <= most and len(digits) in sizes for least, most, sizes in ISSUERS)),  # gazetteer
        int(luhn(digits)),  # structure
        _says(None if len(runs) == 1 else runs[:-1] == (4,) * (len(runs) - 1) or runs in ((4, 6, 5), (4, 6, 4))),  # shape
        int(len(set(digits)) >= 5 and digits not in "01234567890123456789"),  # not a filler
    ]


def _phone(s: str) -> list[int]:
    digits = digits_of(s)
    abroad = s[0] == "+" or (digits.startswith("00") and not re.fullmatch(r"\(?[0-9]{3}\)?[ .-]*[0-9]{3}[ .-][0-9]{4}", s))
    rest = digits[2:] if abroad and s[0] != "+" else digits
    code = next((c for c in sorted(CODES, key=len, reverse=True) if rest.startswith(c)), None) if abroad else None
    own = rest[1:] if abroad and code == "1" else rest if not abroad else None
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    return [
        _says(code is not None if abroad else None),  # gazetteer
        _says(None if own is None else len(own) == 10 and own[0] not in "01" and own[3] not in "01"),  # structure: area and exchange
        _says(8 <= len(rest) <= 15),  # length
        _says(None if len(groups) == 1 else max(groups) <= 8 and len(groups) <= 6 and groups[-1] >= 2),  # shape
    ]


LABELERS = (_email, _ip, _card, _phone)


def votes(text: str, start: int, k: int, end: int) -> tuple[int, ...]:
    """Of the six labelers: 1 yes, 0 no, -1 abstains; then features of the span."""
    kind, s, before = KINDS[k], text[start:end], text[max(0, start - 40) : start].lower()
    words = re.findall(r"[^\W\d_]+", before)[-4:]
    cue = next((1 if any(w.startswith(c) for c in CUES[kind]) else 0 for w in reversed(words) if w.startswith(CUES[kind] + AGAINST[kind])), -1)
    around = text[start - 1 : start] + text[end : end + 1]
    alone = 0 if any(c.isalnum() or c in "_/=#@" for c in around) or text[end : end + 2][1:].isdigit() and around[-1:] in ".-:" else 1
    parts = len(re.findall(r"[^0-9A-Za-z]+", s))
    return *LABELERS[k](s), cue, alone, min(parts, 5), min(len(s) // 8, 4)


N_VOTES, N_FEATURES = 6, 2


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation for labelers that err independently: each pattern's probability, each labeler's vote probabilities (class, labeler, vote + 1), the share of true spans."""
    yes, no = (patterns == 1).sum(1), (patterns == 0).sum(1)
    q = (yes + 1) / (yes + no + 2)
    for _ in range(rounds):
        share = float((q @ counts + 1) / (counts.sum() + 2))
        theta = np.stack([[[(w * counts * (patterns[:, j] == v)).sum() + 0.5 for v in (-1, 0, 1)] for j in range(patterns.shape[1])] for w in (1 - q, q)])
        theta /= theta.sum(2, keepdims=True)
        logs = np.stack([sum(np.log(theta[c, j, patterns[:, j] + 1]) for j in range(patterns.shape[1])) for c in (0, 1)]) + np.log([[1 - share], [share]])
        q = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return q, theta, share


def _inputs(keys: np.ndarray) -> np.ndarray:
    """A column for each vote and each value of a feature, and one that is 1."""
    columns = [np.ones(len(keys))]
    columns += [keys[:, j] == v for j in range(N_VOTES) for v in (0, 1)]
    columns += [keys[:, N_VOTES + j] == v for j in range(N_FEATURES) for v in range(1, 6)]
    return np.stack(columns, 1).astype(float)


class Classifier:
    """For each kind: reliabilities, and a logistic model of a span's votes and features."""

    def __init__(self, counted: list[tuple[int, tuple[int, ...], int]]):
        self.weights: dict[int, np.ndarray] = {}
        self.reliability: dict[int, np.ndarray] = {}
        for k in range(len(KINDS)):
            own = sorted((key, n) for kind, key, n in counted if kind == k)
            if not own:
                continue
            keys, n = np.array([key for key, _ in own]), np.array([n for _, n in own], float)
            q, self.reliability[k], _ = reliabilities(keys[:, :N_VOTES], n)
            x, w = _inputs(keys), np.zeros(_inputs(keys).shape[1])
            for _ in range(25):  # Newton's method with a ridge; counts are damped so that common patterns do not drown the rest
                p, g = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), np.sqrt(n)
                h = (x * (g * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
                w += np.linalg.solve(h, x.T @ (g * (q - p)) - 0.1 * w)
            self.weights[k] = w

    def __call__(self, k: int, key: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(_inputs(np.array([key]))[0] @ self.weights[k], -30, 30)))) if k in self.weights else 0.0


def _found(text: str | None) -> tuple[list, list]:
    if not text:
        return [], []
    base = base_spans(text)
    return base, candidates(text, base)


def fitted(docs: DataFrame) -> Classifier:
    """The classifier from the votes on all candidates of (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                base, more = _found(text)
                seen.update((k, votes(text, s, k, e)) for spans in (base, more) for s, k, e in spans)
        keys = list(seen)
        yield pa.record_batch({"kind": pa.array([k for k, _ in keys], pa.int32()), "key": pa.array([list(v) for _, v in keys], pa.list_(pa.int32())), "n": pa.array([seen[k] for k in keys], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "kind int, key array<int>, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    return Classifier([(r["kind"], tuple(r["key"]), r["n"]) for r in rows])


def found(docs: DataFrame, threshold: float = 0.5, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, base and all spans (each an array of kind:start:end, in order) of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier or fitted(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, known = lambda spans: [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans], {}
        for batch in batches:
            base, every = [], []
            for text in batch.column(1).to_pylist():
                strict, loose = _found(text)
                more = []
                for s, k, e in loose:
                    key = (k, votes(text, s, k, e))
                    if key not in known:
                        known[key] = sent.value(*key)
                    if known[key] >= threshold:
                        more.append((s, k, e))
                base.append(told(strict))
                every.append(told(sorted(strict + more)))
            yield pa.record_batch({"doc_id": batch.column(0), "base": pa.array(base, pa.list_(pa.string())), "spans": pa.array(every, pa.list_(pa.string()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, base array<string>, spans array<string>")


def redacted(text: str, spans: list[str]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, s, e in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans)):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join([*out, text[at:]])


def _starting(prefix: str):
    return lambda x: x.startswith(prefix)


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    done = found(texts(table(spark, sf_dir, "documents")))
    # the counts are those of the base spans, as base_sha256 is
    counts = [F.size(F.filter("base", _starting(k + ":"))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", *counts, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))
