"""Personal data by weak supervision over a base of exact patterns.

Base
    Leftmost, not overlapping within a kind; a match that fails its check is
    dropped and not tried again: email, ip (four numbers of at most 255), card
    (13 to 19 digits that pass Luhn), phone (a plus and 9 to 15 digits).

Weak supervision
    Looser patterns propose further candidates: written-out addresses ("name
    (at) host (dot) org"), national phone numbers, IPv6 addresses, cards with
    other separators or a failing check digit.  Labelers vote yes, no or not at
    all on every candidate, the base's included: its pattern, its check, a
    gazetteer (top-level domains, issuer numbers, private networks, area codes),
    cue words before it, and what it is glued to.  Votes are counted over all
    documents; expectation-maximisation (Dawid and Skene, two classes per kind)
    estimates each labeler's reliability and each vote pattern's posterior.  A
    logistic regression on votes and shape, trained on those posteriors, is the
    final span classifier: candidates at ``threshold`` or above that overlap no
    span taken before are added.  Base spans always stay.

Scale
    What is gathered is a count per kind, vote pattern and shape, some thousands
    at most whatever the input; texts are scanned twice and never shuffled.

Defined results
    A null text is empty and has no spans.  Spans are in code points, end
    exclusive.  Rows that repeat an id each give a row and each count as
    evidence.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
#: Weight of a vote pattern that all candidates of a kind have, against the penalty on the classifier's weights.
WEIGHT = 1000.0
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ outwards: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- candidates

_DOT = r"\(dot\)|\[dot\]|\{dot\}| dot "
#: After a bare " at " a full stop with a space beside it is the end of a sentence.
#: A name longer than the 64 characters that an address may have is none.
_WORDED_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:"
    rf"(?:\(at\)|\[at\]|\{{at\}}) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:{_DOT}|\.) ?[A-Za-z0-9-]{{1,63}}){{1,4}}"
    rf"| at (?: )?[A-Za-z0-9-]{{1,63}}(?:(?: ?(?:{_DOT}) ?|\.)[A-Za-z0-9-]{{1,63}}){{1,4}})",
    re.I,
)
#: Every match of the pattern above holds one.
_AT = re.compile(r"\(at\)|\[at\]|\{at\}| at ", re.I)
#: Eight groups, or fewer around a double colon; ``_ipv6`` checks what this finds.
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}([ .\-/]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .\-/])[0-9]{3,4}[ .\-/][0-9]{3,4}(?![0-9])")
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|mail ?to|reach|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|from|client|adresse|direcci[oó]n)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|master ?card|amex|credit|debit|carte|tarjeta|karte|cc)\b", re.I),
    "phone": re.compile(r"\b(?:tel|phone|call|mobile|cell|fax|t[eé]l[eé]fono|t[eé]l[eé]phone|telefon|whatsapp)\b", re.I),
}
_NOT = re.compile(r"\b(?:version|isbn|order|invoice|item|serial|ref|id|sku|page|section|chapter|no)\b[ .:#]*$", re.I)
_TLDS = frozenset("com org net edu gov mil int info biz io co me us uk de fr es it nl be ch at eu ca au jp cn in br mx ru se no fi dk pl pt ie".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|62|50|5[678]")


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    """Of pattern, check, gazetteer, cue words and neighbours: 1 yes, -1 no, 0 none."""
    shape: int

    @property
    def key(self) -> str:
        return f"{self.kind}:{','.join(map(str, self.votes))}:{self.shape}"


def _candidate(text: str, kind: str, start: int, end: int, base: bool) -> Candidate:
    own, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 40) : start]
    if kind == "email":
        parts = [p for p in re.split(r"[^A-Za-z0-9-]+", own) if p]
        check = 1 if len(parts) >= 3 or base else -1
        gazetteer = 1 if parts and parts[-1].lower() in _TLDS else -1
    elif kind == "ip":
        parts = own.split(".")
        check = 1 if base or ":" in own else -1
        gazetteer = -1 if len(parts) == 4 and (parts[0] in ("0", "255") or any(len(p) > 1 and p[0] == "0" for p in parts)) else 0
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if _ISSUERS.match(digits) else -1
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if own[0] == "+" or digits.startswith("00") else -1 if len(set(digits)) < 3 else 0
    cue = 1 if _CUES[kind].search(before) else -1 if _NOT.search(before) else 0
    around = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    glued = -1 if any(c.isalnum() for c in around) else 1 if all(c.isspace() or c in ".,;:!?()[]<>\"'" for c in around) else 0
    separators = {c for c in own if not c.isalnum()}
    shape = min(len(digits) // 4, 5) * 4 + min(len(separators), 3)
    return Candidate(kind, start, end, base, (1 if base else 0, check, gazetteer, cue, glued), shape)


def candidates(text: str) -> list[Candidate]:
    """The base's spans and what the looser patterns propose beside them."""
    spans = base_spans(text)
    out = [_candidate(text, k, a, b, True) for k, a, b in spans]
    loose: list[Span] = []
    if _AT.search(text):
        loose += [("email", *m.span()) for m in _WORDED_EMAIL.finditer(text)]
    if text.count(":") >= 2:
        loose += [("ip", *m.span()) for m in _IPV6.finditer(text) if _ipv6(m[0])]
    if _DIGIT.search(text):
        loose += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
        loose += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    taken = sorted((a, b) for _, a, b in spans)
    for kind, a, b in loose:
        if not _overlaps(taken, a, b):
            out.append(_candidate(text, kind, a, b, False))
    return out


def _ipv6(text: str) -> bool:
    """Whether it is an address of the standard's forms, with a digit and not all zero; ``a::b`` is more often code."""
    if not text.strip(":0") or not any(c.isdigit() for c in text):
        return False
    try:
        IPv6Address(text)
    except AddressValueError:
        return False
    return True


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) meets one of the sorted spans, of which few overlap."""
    at = bisect_left(taken, (b, 0))
    return any(taken[k][1] > a for k in range(max(0, at - 4), at))


# --------------------------------------------------------------------- model


def posteriors(counts: Counter, steps: int = 60) -> dict[str, float]:
    """Expectation-maximisation: for each key, the chance that its candidates are personal data."""
    out: dict[str, float] = {}
    for kind in KINDS:
        keys = [k for k in sorted(counts) if k.startswith(kind + ":")]
        if not keys:
            continue
        votes = np.array([[int(v) for v in k.split(":")[1].split(",")] for k in keys])
        n = np.array([counts[k] for k in keys], dtype=float)
        p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))  # the first guess: a majority
        for _ in range(steps):
            rate = (n @ p + 1) / (n.sum() + 2)
            log = np.full((len(keys), 2), [np.log(1 - rate), np.log(rate)])
            for labeler in range(votes.shape[1]):
                for c, w in enumerate((n * (1 - p), n * p)):
                    # smoothed towards labelers that are better than chance
                    prior = {1: (1.0, 4.0), -1: (4.0, 1.0), 0: (4.0, 4.0)}
                    total = sum(prior[v][c] for v in prior) + w.sum()
                    for v in prior:
                        mine = votes[:, labeler] == v
                        log[mine, c] += np.log((prior[v][c] + w[mine].sum()) / total)
            p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        out |= dict(zip(keys, p.tolist()))
    return out


def _features(key: str) -> np.ndarray:
    kind, votes, shape = key.split(":")
    x = np.zeros(len(KINDS) * (1 + 10 + 24))
    at = KINDS.index(kind) * 35
    x[at] = 1
    for k, v in enumerate(votes.split(",")):
        if v != "0":
            x[at + 1 + 2 * k + (v == "-1")] = 1
    x[at + 11 + int(shape)] = 0.5
    return x


@dataclass(frozen=True)
class Classifier:
    weights: tuple[float, ...]

    def probability(self, key: str) -> float:
        return 1 / (1 + float(np.exp(-np.clip(_features(key) @ np.array(self.weights), -500, 500))))


def fit(counts: Counter, steps: int = 300, penalty: float = 0.5) -> Classifier:
    """The span classifier, from the soft labels of every vote pattern and shape."""
    chance = posteriors(counts)
    keys = sorted(chance)
    if not keys:
        return Classifier((0.0,) * (len(KINDS) * 35))
    x = np.stack([_features(k) for k in keys])
    y = np.array([chance[k] for k in keys])
    totals = Counter()
    for k in keys:
        totals[k.split(":")[0]] += counts[k]
    # by the root of a pattern's share of its kind: a frequent one doesn't silence the others, and the fit is the same at every size
    n = WEIGHT * np.sqrt([counts[k] / totals[k.split(":")[0]] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps; the problem has 140 weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        move = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
        step = min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        w = w - step * move
        if np.abs(step * move).max() < 1e-9:
            break
    return Classifier(tuple(np.round(w, 9).tolist()))


def evidence(docs: DataFrame, text_col: str = "text") -> Counter:
    """Candidates of all documents, counted by kind, votes and shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update(c.key for c in candidates(x.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])

    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "key string, n long")
    return Counter({r.key: r.n for r in found.groupBy("key").agg(F.sum("n").alias("n")).collect()})  # 4 kinds x 3^5 votes x 24 shapes at most


# ------------------------------------------------------------------ operator


def all_spans(text: str, classifier: Classifier, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """(base, base and added): by kind as listed, then start."""
    found = candidates(text)
    base = [(c.kind, c.start, c.end) for c in found if c.base]
    added: list[Span] = []
    ranked = sorted(((-_probability(classifier, c.key), c.start, c.end, c.kind) for c in found if not c.base))
    taken: list[tuple[int, int]] = []  # sorted, and no two overlap
    for minus, a, b, kind in ranked:
        at = bisect_left(taken, (a, b))
        if -minus >= threshold and (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
            added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


@lru_cache(100_000)
def _probability(classifier: Classifier, key: str) -> float:
    return classifier.probability(key)


def find(docs: DataFrame, classifier: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, base and spans, each an array of (kind, start, end), of every row."""
    model = classifier or fit(evidence(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            both = [all_spans(x.as_py() or "", model, threshold) for x in batch.column(1)]
            columns = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in pair[i]] for pair in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "base", "spans"])

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    span = "array<struct<kind: string, start: long, end: long>>"
    return source.mapInArrow(run, f"id long, base {span}, spans {span}").withColumnRenamed("id", id_col)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base's kinds, the digest of its spans and all spans as a string, in place of the arrays."""

    def text(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.withColumns({f"n_{k}": count(k) for k in KINDS} | {"base_sha256": F.sha2(text("base"), 256), "spans": text("spans")}).drop("base")


def redact(docs: DataFrame, classifier: Classifier | None = None, text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans by one mark."""
    model = classifier or fit(evidence(docs, text_col))
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text or not (spans := all_spans(text, model, threshold)[1]):
            return text
        out, end = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [text[end:a], f"<{kind.upper()}>"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = pa.array([clean(x.as_py()) for x in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], cleaned, *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
