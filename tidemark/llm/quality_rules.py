"""Quality rules: fixed base rules and a hashed n-gram logistic regression.

Base rules
    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  ``word_chars`` are the
    code points in words, ``n_symbols`` the characters of ``#*$%&|<>``,
    ``n_dup_lines`` the lines (split at \\n) with a word that equal an earlier
    line, ``n_repeat_words`` the words that lie in a 3-word window found twice or
    more in the text.  A row fails with fewer than 50 words, or if more than half
    of its words are repeated.

Model
    Three families of hashed features (words, word pairs, character trigrams),
    each a frequency in its family.  Logistic regression on a bounded sample of
    labelled rows (``sample`` of each class, those with the smallest hash of
    their id, so the same rows at any partitioning), scaled by each feature's
    root mean square, with an L2 penalty; a quarter of the sample is held out to
    calibrate the probability (Platt); where it lacks a class, the training rows
    calibrate.  Weights are fixed-point integers, so a
    score doesn't depend on how rows were batched.  Every row is scored, in Arrow
    batches, against a fixed threshold.

Defined results
    A null or empty text has no words and fails the base rules.  Rows that
    repeat an id each get a row.  A labelled id with several labels counts as
    its smallest label; of its rows the one with the smallest text hash is learnt
    from.  Without labelled rows of both classes the probability
    is 1 and only base rules reject.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12
FAMILIES = 3
#: Labelled rows of each class that the model is fitted to, at most.
SAMPLE = 1500
THRESHOLD = 0.5
#: Characters of texts that are handled at once.
GROUP = 1 << 20
FIXED = 1 << 24
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
MIN_WORDS = 50


# ---------------------------------------------------------------- features


def _triples(ids: np.ndarray, kinds: int) -> np.ndarray:
    """An exact number for each 3-word window."""
    if kinds < 1 << 21:
        return (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1].astype(np.int64)
    return pairs[:-1] * kinds + ids[2:]


def repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    windows = _triples(ids, kinds)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(ids), dtype=bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            covered[at + k] = True
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    worded = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")]
    return len(worded) - len(set(worded))


@dataclass
class Group:
    """Texts with their base counts and the hashed features of each family.

    ``hashed[f]`` has the bucket of every feature of family f, ``spans[f]`` the
    first and the last of each text.
    """

    base: list[tuple[int, int, int, int, int]]
    hashed: list[np.ndarray]
    spans: list[tuple[np.ndarray, np.ndarray]]


def featurise(texts: Sequence[str]) -> Group:
    raw = [t.encode() for t in texts]
    words = [b.split() for b in raw]
    flat = [w for ws in words for w in ws]
    number = dict.fromkeys(flat)
    for k, w in enumerate(number):
        number[w] = k
    ids = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
    own = np.fromiter((xxhash.xxh32_intdigest(w) for w in number), dtype=np.uint32, count=len(number))[ids] if flat else np.zeros(0, np.uint32)
    counts = np.array([len(ws) for ws in words], dtype=np.int64)
    ends = np.cumsum(counts)
    base = []
    for text, b, ws, a, z in zip(texts, raw, words, (ends - counts).tolist(), ends.tolist()):
        word_bytes = sum(map(len, ws))
        base.append((len(ws), word_bytes - (len(b) - len(text)), sum(map(b.count, SYMBOLS)), dup_lines(b), repeat_words(ids[a:z], len(number))))
    with np.errstate(over="ignore"):
        pair = (own[:-1] * np.uint32(0x9E3779B1)) ^ (own[1:] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))
        pair *= np.uint32(0xC2B2AE3D)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        three = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
        three *= np.uint32(0x27D4EB2F)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    stops = np.cumsum(lengths)
    shift = np.uint32(32 - BITS)
    spans = [(ends - counts, ends), (ends - counts, np.maximum(ends - 1, ends - counts)), (stops - lengths, np.maximum(stops - 2, stops - lengths))]
    return Group(base, [own >> shift, pair >> shift, three >> shift], spans)


def groups(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > GROUP:
            yield texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


# ------------------------------------------------------------------- model


@dataclass(frozen=True)
class Model:
    """Fixed-point weights by family and bucket, and the calibrated line."""

    weights: np.ndarray
    slope: float
    offset: float

    def raw(self, group: Group) -> np.ndarray:
        """The sum over families of the mean weight of a text's features."""
        out = np.zeros(len(group.base))
        for own, hashed, (first, last) in zip(self.weights, group.hashed, group.spans):
            sums = np.concatenate([[0], np.cumsum(own[hashed])])
            some = last > first
            n = np.maximum(last - first, 1)
            out[some] += ((sums[last[some]] - sums[first[some]]) / n[some]) / FIXED
        return out

    def probability(self, group: Group) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(group) + self.offset, -500, 500)))


CONSTANT = Model(np.zeros((FAMILIES, 1 << BITS), dtype=np.int64), 0.0, 500.0)


def fit_logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights (the last is the intercept) of a sparse problem; classes weigh alike; accelerated gradient steps."""
    n = len(labels)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    norms = np.bincount(rows, weights=values**2, minlength=n)
    step = 4.0 / (norms.max() + 1.0 + penalty)
    w, last = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(steps):
        v = w + (k / (k + 3)) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=values * v[columns], minlength=n) + v[width], -500, 500)))
        slack = weight * (p - labels)
        gradient = np.append(np.bincount(columns, weights=values * slack[rows], minlength=width), slack.sum())
        gradient[:width] += penalty * v[:width]
        last, w = w, v - step * gradient
    return w


def calibrate(scores: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of Platt's line: damped Newton steps on smoothed targets."""
    good, bad = int((labels == 1).sum()), int((labels == 0).sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    inputs = np.stack([scores, np.ones_like(scores)])

    def loss(line: np.ndarray) -> float:
        z = line @ inputs
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-6 * line @ line)

    line = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(line @ inputs, -500, 500)))
        move = np.linalg.solve((inputs * (p * (1 - p))) @ inputs.T + 1e-6 * np.eye(2), inputs @ (p - target) + 2e-6 * line)
        size = 1.0
        while size > 1e-6 and loss(line - size * move) > loss(line):
            size /= 2
        line = line - size * move
        if np.abs(size * move).sum() < 1e-9 or size <= 1e-6:
            break
    return float(line[0]), float(line[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> Model:
    """The model of ``docs``'s labelled rows (label 1: good, 0: bad)."""
    marked = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("id")).agg(F.min(labels[label_col]).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = marked.where("label = 0").orderBy(*order).limit(sample).union(marked.where("label = 1").orderBy(*order).limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in groups([x or "" for x in batch.column(2).to_pylist()]):
                group, columns, values = featurise(some), [], []
                for k in range(len(some)):
                    own = np.zeros(FAMILIES << BITS)
                    for f, (hashed, (first, last)) in enumerate(zip(group.hashed, group.spans)):
                        if last[k] > first[k]:
                            own[f << BITS : (f + 1) << BITS] = np.bincount(hashed[first[k] : last[k]], minlength=1 << BITS) / (last[k] - first[k])
                    columns.append(np.flatnonzero(own).astype(np.int16))
                    values.append(own[columns[-1]].astype(np.float32))
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(columns, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))], names=["id", "label", "columns", "values"])

    # sample * 2 ids at most: a proven bound, so the texts needn't be shuffled; of an id's rows one is learnt from
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "id")
    source = source.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = source.mapInArrow(run, "id long, label int, columns array<short>, values array<float>").toArrow().combine_chunks()
    return fit(found)


def fit(found: pa.Table) -> Model:
    """The model of rows (id, label, columns, values)."""
    if not found.num_rows:
        return CONSTANT
    ids, labels = found["id"].to_numpy(), found["label"].to_numpy()
    columns, values = found["columns"].combine_chunks(), found["values"].combine_chunks()
    sizes = columns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows, cols, vals = np.repeat(np.arange(len(ids)), sizes), columns.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64)
    hashes = np.array([xxhash.xxh64_intdigest(str(i)) for i in ids], dtype=np.uint64)
    order = np.lexsort((sizes, ids, hashes))  # the same order however rows arrived
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    held = (hashes % np.uint64(4)) == 0
    train_labels = labels[~held]
    if len(set(train_labels.tolist())) < 2:
        return CONSTANT
    inside = ~held[rows]
    by = np.lexsort((cols, place[rows]))
    rows, cols, vals, inside = place[rows][by], cols[by], vals[by], inside[by]
    labels, held = labels[order], held[order]
    width = FAMILIES << BITS
    seen = np.bincount(cols[inside], minlength=width)
    rms = np.sqrt(np.bincount(cols[inside], weights=vals[inside] ** 2, minlength=width) / max(1, (~held).sum()))
    scale = np.where(seen >= 3, 1 / np.maximum(rms, 1e-12), 0.0)
    scaled = vals * scale[cols]
    number = np.cumsum(~held) - 1
    w = fit_logistic(number[rows[inside]], cols[inside], scaled[inside], labels[~held], width)
    scores = np.bincount(rows, weights=scaled * w[cols], minlength=len(labels)) + w[width]
    test = held if len(set(labels[held].tolist())) == 2 else ~held
    slope, offset = calibrate(scores[test], labels[test])
    fixed = np.rint(np.clip(w[:width] * scale, -1e9, 1e9) * FIXED).astype(np.int64).reshape(FAMILIES, 1 << BITS)
    return Model(fixed, slope, slope * float(w[width]) + offset)


# ----------------------------------------------------------------- scoring


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, keep_docs: bool = False) -> DataFrame:
    """Counts, probability and verdict of every row; or, with ``keep_docs``, the rows of ``docs`` that are kept."""
    # only the id and text are needed for the verdicts
    names = docs.columns
    text_at = names.index(text_col)

    def judge(texts: list[str]) -> Iterator[tuple[Group, np.ndarray]]:
        for some in groups(texts):
            group = featurise(some)
            yield group, model.probability(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, chance = [], []
            for group, p in judge([x or "" for x in batch.column(1).to_pylist()]):
                base += group.base
                chance.append(p)
            counts = np.array(base, dtype=np.int64).reshape(-1, 5)
            p = np.concatenate([*chance, np.zeros(0)])
            failed = fails(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, dtype=bool)]
            for group, p in judge([x or "" for x in batch.column(text_at).to_pylist()]):
                keep.append(~fails(np.array(group.base, dtype=np.int64).reshape(-1, 5)) & (p >= threshold))
            yield batch.filter(pa.array(np.concatenate(keep)))

    if keep_docs:
        return docs.mapInArrow(sieve, docs.schema)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    kinds = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return source.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def fails(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])
