"""Chroma audio fingerprints of media columns, and their alignment.

Fingerprint
    Mono PCM is cut into overlapping frames (Hann window); each frame's power
    spectrum is folded into twelve pitch classes and scaled to length one.  Over
    the image of frames and classes an integral image gives any rectangle's sum
    in four reads; sixteen filters compare two regions of a window of ``SPAN``
    frames, and each log ratio is quantised to two Gray-coded bits: one packed
    32-bit integer per frame position.

Alignment
    Recordings with the same fingerprint form a class; only its smallest id is
    searched.  Two neighbouring integers are a seed (of a run of equal integers,
    the first).  Query seeds are joined with all seeds, a histogram of offsets
    is counted per pair of classes, and the offset with the most votes (then the
    smallest shift) is verified: the share of differing bits over the whole
    overlap.  A pair links with at least ``votes`` seeds at its offset, an
    overlap of ``overlap`` integers and a bit error rate of at most ``errors``.

Scale
    Seeds are joined on equality, a key with more than ``HOT`` of them in parts;
    they are counted before anything else is shipped, and only pairs that reach ``votes`` fetch fingerprints; there is no cap on
    partners.  Equal recordings, thousands of them, are one class.

Defined results
    A null or empty recording has no integers and no class, nor has one too short
    for a window, unless the format's ``least`` asks for some.  Rows that
    repeat an id are recordings of their own with the same id.  Every input row
    gives one row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

SPAN = 16
#: (region pair, first class, classes, frames) of each filter.
FILTERS = (
    ("time", 0, 12, 16),
    ("time", 0, 4, 8),
    ("time", 4, 4, 8),
    ("time", 8, 4, 8),
    ("pitch", 0, 12, 4),
    ("pitch", 0, 6, 8),
    ("pitch", 6, 6, 8),
    ("pitch", 3, 6, 12),
    ("check", 0, 12, 8),
    ("check", 0, 6, 16),
    ("check", 6, 6, 16),
    ("middle time", 0, 6, 15),
    ("middle time", 6, 6, 15),
    ("middle pitch", 0, 12, 8),
    ("middle pitch", 0, 6, 12),
    ("middle pitch", 6, 6, 12),
)
#: Log ratios that part the four codes of a filter.
CUTS = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: Samples of frames whose spectra are held at once, and bytes of recordings handled together.
SAMPLES, BYTES = 1 << 22, 1 << 22
#: Seeds of one key that one task meets; a key with more is split.
HOT = 100_000


@dataclass(frozen=True)
class Format:
    """How samples are stored, and how they are cut into frames."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    bits: int = 16
    low: float = 65.0
    high: float = 3520.0
    #: Integers that every recording with a sample gets: a shorter one is played again until it has them.
    least: int = 0

    def whole(self, sound: np.ndarray) -> np.ndarray:
        """The samples, repeated if there are too few for ``least`` integers."""
        needed = self.frame + self.hop * (SPAN + self.least - 2) if self.least else 0
        return np.resize(sound, needed) if 0 < len(sound) < needed else sound

    def samples(self, pcm: bytes) -> np.ndarray:
        if self.bits == 8:
            return np.frombuffer(pcm, dtype=np.uint8).astype(np.float32) - 128
        return np.frombuffer(pcm[: len(pcm) // 2 * 2], dtype="<i2").astype(np.float32)

    def classes(self) -> list[np.ndarray]:
        """The bins of the spectrum of each pitch class."""
        frequency = np.arange(self.frame // 2 + 1) * self.rate / self.frame
        heard = np.flatnonzero((frequency >= self.low) & (frequency <= self.high))
        pitch = np.rint(12 * np.log2(frequency[heard] / 440.0)).astype(int) % 12
        return [heard[pitch == k] for k in range(12)]

    def fixed(self) -> float:
        """The factor under which a spectrum's powers add up within 60 bits."""
        return 2.0 ** (60 - 2 * (self.bits - 1) - 2 * int(np.ceil(np.log2(self.frame))))


def chroma(samples: np.ndarray, starts: np.ndarray, form: Format) -> np.ndarray:
    """Twelve pitch classes, of length one, of the frame at each start.

    Powers are added as integers: a frame's classes don't depend on the frames
    that are handled with it.
    """
    out = np.zeros((len(starts), 12))
    if not len(starts):
        return out
    windows = np.lib.stride_tricks.sliding_window_view(samples, form.frame)
    taper, bins, scale = np.hanning(form.frame).astype(np.float32), form.classes(), form.fixed()
    step = max(1, SAMPLES // form.frame)
    for k in range(0, len(starts), step):
        spectrum = np.fft.rfft(windows[starts[k : k + step]] * taper)
        power = np.rint((spectrum.real.astype(np.float64) ** 2 + spectrum.imag.astype(np.float64) ** 2) * scale).astype(np.int64)
        for pitch, own in enumerate(bins):
            out[k : k + step, pitch] = power[:, own].sum(axis=1)
    squares = out[:, :1] * out[:, :1]
    for pitch in range(1, 12):
        squares = squares + out[:, pitch : pitch + 1] * out[:, pitch : pitch + 1]
    norm = np.sqrt(squares)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-6 * scale)


def packed(image: np.ndarray) -> np.ndarray:
    """The integer at each position of an image of frames x 12, as unsigned 32 bits."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    # a window's sums are differences of running ones: fixed point keeps them the same wherever a window lies
    area = np.zeros((len(image) + 1, 13), dtype=np.int64)
    np.cumsum(np.cumsum(np.rint(image * (1 << 20)).astype(np.int64), axis=0), axis=1, out=area[1:, 1:])

    def box(t: int, y: int, w: int, h: int) -> np.ndarray:
        return area[t + w : t + w + n, y + h] - area[t : t + n, y + h] - area[t + w : t + w + n, y] + area[t : t + n, y]

    code = np.zeros(n, dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        whole = box(0, y, w, h)
        if kind == "time":
            part = box(0, y, w // 2, h)
        elif kind == "pitch":
            part = box(0, y, w, h // 2)
        elif kind == "check":
            part = box(0, y, w // 2, h // 2) + box(w // 2, y + h // 2, w - w // 2, h - h // 2)
        elif kind == "middle time":
            part = box(w // 3, y, w // 3, h)
        else:
            part = box(0, y + h // 3, w, h // 3)
        share = 2 if kind.startswith("middle") else 1  # the middle is a third
        ratio = np.log((1024.0 + share * part) / (1024.0 + whole - part))
        code = (code << np.uint32(2)) | GRAY[np.searchsorted(np.array(CUTS), ratio, side="right")]
    return code


def fingerprint_all(recordings: list[bytes], form: Format) -> list[np.ndarray]:
    """The integers of each recording; frames of all of them are transformed together."""
    sounds = [form.whole(form.samples(r)) for r in recordings]
    frames = [max(0, (len(s) - form.frame) // form.hop + 1) for s in sounds]
    offsets = np.cumsum([0, *map(len, sounds)])
    starts = np.concatenate([np.zeros(0, dtype=np.int64), *(o + form.hop * np.arange(n) for o, n in zip(offsets, frames))]).astype(np.int64)
    image = chroma(np.concatenate([np.zeros(0, dtype=np.float32), *sounds]), starts, form)
    ends = np.cumsum(frames)
    codes = packed(image)  # positions whose window spans two recordings are left out
    return [codes[e - n : max(e - n, e - SPAN + 1)] for e, n in zip(ends.tolist(), frames)]


def fingerprints(media: DataFrame, id_col: str, pcm_col: str, form: Format) -> DataFrame:
    """(id, ints): the packed integers of every recording, as signed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k, n in _together(whole.column(1)):
                batch = whole.slice(k, n)
                ints = fingerprint_all([x or b"" for x in batch.column(1).to_pylist()], form)
                ends = np.cumsum([0, *map(len, ints)])
                flat = np.concatenate([np.zeros(0, dtype=np.uint32), *ints]).view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "ints"])

    source = media.select(media[id_col].cast("long").alias("id"), media[pcm_col].cast("binary").alias("pcm"))
    return source.mapInArrow(run, "id long, ints array<int>")


def _together(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows bounded in bytes; a larger recording is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = size = 0
    for k, own in enumerate(sizes):
        if k > first and size + own > BYTES:
            yield first, k - first
            first, size = k, 0
        size += own
    if first < len(sizes):
        yield first, len(sizes) - first


def _seeds(classes: DataFrame) -> DataFrame:
    """(of, key, at): two neighbouring integers as a long, where the first begins a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
            for of, ints in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.asarray(ints.values).astype(np.int64)
                if len(own) > 1:
                    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[:-1])
                    for column, value in zip(out, (np.full(len(at), of), (own[at] << 32) | (own[at + 1] & 0xFFFFFFFF), at)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["of", "key", "at"])

    return classes.select("class", "ints").mapInArrow(run, "of long, key long, at long")


def bit_error(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int]:
    """(integers in the overlap, differing bits) with ``b`` shifted by ``shift`` against ``a``."""
    first, last = max(0, shift), min(len(a), len(b) + shift)
    if last <= first:
        return 0, 0
    return last - first, int(np.bitwise_count(a[first:last] ^ b[first - shift : last - shift]).sum())


def align(classes: DataFrame, asking: DataFrame, *, votes: int, overlap: int, errors: float, space: Workspace) -> DataFrame:
    """(query, found, shift, hits, overlap, errors) of every linked pair of different classes.

    ``classes`` has class (a long) and ints; ``asking`` has the class of queries.
    """
    seeds = space.save(_seeds(classes))
    of_queries = seeds.join(asking.select(F.col("class").alias("of")), "of", "left_semi")
    asked = of_queries.select("key").distinct()
    hot = space.save(seeds.join(asked, "key", "left_semi").groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select(F.col("key").alias("hot"), F.ceil(F.col("k") / HOT).cast("long").alias("parts")))
    left, right, same = of_queries, seeds, (F.col("q.key") == F.col("d.key")) & (F.col("q.of") != F.col("d.of"))
    if not hot.isEmpty():
        # a key that very many recordings share (silence): its seeds are split, and meet the queries' in each part
        none = F.lit(1).cast("long")
        left = left.join(hot, F.col("key") == F.col("hot"), "left").select("of", "key", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", none) - 1)).alias("part"))
        right = right.join(hot, F.col("key") == F.col("hot"), "left").select("of", "key", "at", F.pmod(F.xxhash64("of", "at"), F.coalesce("parts", none)).alias("part"))
        same = same & (F.col("q.part") == F.col("d.part"))
    pairs = left.alias("q").join(right.alias("d"), same)
    histogram = pairs.select(F.col("q.of").alias("query"), F.col("d.of").alias("found"), (F.col("q.at") - F.col("d.at")).alias("shift")).groupBy("query", "found", "shift").agg(F.count("*").alias("hits"))
    best = histogram.groupBy("query", "found").agg(F.min_by(F.struct("shift", "hits"), F.struct(-F.col("hits"), F.abs("shift"), "shift")).alias("b")).select("query", "found", "b.shift", "b.hits").where(F.col("hits") >= votes)
    best = space.save(best)
    for done in (seeds, hot):
        space.drop(done)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [bit_error(np.asarray(a.values), np.asarray(b.values), s) for a, b, s in zip(batch.column(4), batch.column(5), batch.column(2).to_pylist())]
            n = np.array([r[0] for r in rows], dtype=np.int64)
            rate = np.array([r[1] for r in rows]) / np.maximum(32 * n, 1)
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n), pa.array(rate)], names=["query", "found", "shift", "hits", "overlap", "errors"])
            yield out.filter(pa.array((n >= overlap) & (rate <= errors)))

    both = best.join(classes.select(F.col("class").alias("query"), F.col("ints").alias("a")), "query").join(classes.select(F.col("class").alias("found"), F.col("ints").alias("b")), "found")
    return both.select("query", "found", "shift", "hits", "a", "b").mapInArrow(verify, "query long, found long, shift long, hits long, overlap long, errors double")


def search(media: DataFrame, id_col: str, pcm_col: str, is_query: Column, form: Format, *, votes: int = 2, overlap: int = 8, errors: float = 0.35) -> DataFrame:
    """A row per recording: its class, fingerprint and the query recording it aligns with best.

    id_col, class_id, n_ints, fingerprint (SHA-256 of the decimal
    integers joined by commas), n_links (queries' classes that its class links to), best_query
    (a class of queries), best_shift (of the recording against the query, in
    frames) and best_errors.  ``is_query`` is a condition on id_col.
    """
    space = Workspace(media.sparkSession)
    printed = fingerprints(media, id_col, pcm_col, form)
    named = space.save(printed.withColumn("fingerprint", F.sha2(F.array_join("ints", ",").cast("binary"), 256)))
    some = named.where(F.size("ints") > 0)
    grouped = some.groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.any_value("ints").alias("ints")).where("class_id is not null")
    classes = space.save(grouped.withColumn("class", F.monotonically_increasing_id()))  # an id may repeat, so it can't name a class
    queried = some.select(F.col("id").alias(id_col), "fingerprint").where(is_query).select("fingerprint").distinct()
    asking = space.save(classes.join(queried, "fingerprint", "left_semi").select("class", F.col("class_id").alias("query_id")))
    links = space.save(align(classes, asking, votes=votes, overlap=overlap, errors=errors, space=space))
    named_links = links.join(asking, F.col("query") == F.col("class"))
    top = named_links.groupBy("found").agg(F.count("*").alias("n_links"), F.min_by(F.struct("query_id", "shift", "errors"), F.struct("errors", -F.col("overlap"), "query_id", "shift")).alias("t"))
    told = classes.drop("ints").join(top, F.col("class") == F.col("found"), "left").select("fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("t.query_id").alias("best_query"), F.col("t.shift").alias("best_shift"), F.col("t.errors").alias("best_errors"))
    rows = named.select("id", "fingerprint", F.size("ints").cast("long").alias("n_ints"))
    return rows.join(told, "fingerprint", "left").select(F.col("id").alias(id_col), "class_id", "n_ints", "fingerprint", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_query", "best_shift", "best_errors")
