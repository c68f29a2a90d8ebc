"""Byte-level BPE encoding and decoding by two tiers of lookup.

Tier one resolves a whole pre-token that is in the vocabulary by a minimal
perfect hash: ``hash and displace`` tables give every vocabulary entry its own
slot, one slot per entry, and the entry stored there is compared with the
pre-token.  A batch of pre-tokens is looked up at once with numpy.

Tier two merges the rest: a heap of candidate merges over a doubly linked list
of the token's bytes, lowest rank first, leftmost among equals; O(n log n) in
the token's length, however long it is.

A worker keeps the pre-tokens met before on a shelf of flat arrays of a stated
number of bytes; when it is full it starts afresh.  Texts go through in slices
bounded in characters, so a worker's memory doesn't depend on the batch.  ``transcribe`` encodes, decodes the ids and
hands both to a function in one pass.  Rank files are in the ``base64 rank``
form; the split pattern is a parameter.

Defined results
    A null or empty text has no ids and decodes to no bytes.  Special tokens'
    strings are ordinary text.  All columns of the input stay; a column that has
    the output's name is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a worker's shelf of pre-tokens, and of an entry of it on average.
CACHE, ENTRY = 64 << 20, 64
#: Characters of texts whose ids are held at once; a longer text is a slice of its own.
GROUP = 1 << 19
_SHIFT = np.uint64(32)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def _ranges(kind: str, limit: int) -> str:
    """The code points under ``limit`` of a class, as the inside of a set."""
    matches = regex.compile(kind).match
    runs: list[list[int]] = []
    for c in range(limit):
        if matches(chr(c)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def splitter(pattern: str, limit: int = 0x250) -> Callable[[str], list[str]]:
    """``findall`` of a pattern; texts under code point ``limit`` take a quicker engine.

    There, ``\\p{..}``, ``\\s`` and ``\\S`` are spelled out as ranges for the
    standard library's engine; other texts, and patterns it doesn't take, go to
    the engine that knows Unicode properties.
    """
    full = regex.compile(pattern)
    spelled, inside, at = [], False, 0
    while at < len(pattern):
        if kind := re.compile(r"\\p\{\w+\}|\\[sS]").match(pattern, at):
            runs = _ranges(kind[0], limit)
            spelled.append(runs if inside else f"[{runs}]")
            at = kind.end()
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        spelled.append(pattern[at : at + 2] if pattern[at] == "\\" else pattern[at])
        at += len(spelled[-1])
    try:
        quick = re.compile("".join(spelled))
    except re.error:
        return full.findall
    beyond = re.compile(f"[^\0-\\u{limit - 1:04x}]").search

    def split(text: str) -> list[str]:
        return full.findall(text) if beyond(text) else quick.findall(text)

    return split


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, displacements found per bucket."""

    def __init__(self, keys: Sequence[bytes], load: int = 4) -> None:
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // load))
        for seed in range(100):
            if self._build(keys, seed):
                return
        raise ValueError("the keys repeat")

    def hashes(self, keys: Sequence[bytes], seed: int) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(k, seed) for k in keys), dtype=np.uint64, count=len(keys))

    def _slots(self, hashes: np.ndarray, moved: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (moved * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (((mixed >> _SHIFT) * np.uint64(max(1, self.n))) >> _SHIFT).astype(np.int64)

    def _build(self, keys: Sequence[bytes], seed: int) -> bool:
        self.seed = seed
        hashes = self.hashes(keys, seed)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.moved = np.zeros(self.buckets, dtype=np.uint64)
        self.order = np.full(self.n, -1, dtype=np.int64)
        tries = np.arange(1 << 10, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = order[ends[b] - sizes[b] : ends[b]]
            for start in range(0, 1 << 22, len(tries)):
                slots = self._slots(hashes[own][None, :], (tries + np.uint64(start))[:, None])
                free = (self.order[slots] < 0).all(axis=1)
                if len(own) > 1:
                    placed = np.sort(slots, axis=1)
                    free &= (placed[:, 1:] != placed[:, :-1]).all(axis=1)
                if len(hit := np.flatnonzero(free)):
                    self.moved[b] = start + int(hit[0])
                    self.order[slots[hit[0]]] = own
                    break
            else:
                return False
        return True

    def lookup(self, keys: Sequence[bytes]) -> np.ndarray:
        """The number of the only key that each string may be."""
        hashes = self.hashes(keys, self.seed)
        return self.order[self._slots(hashes, self.moved[(hashes % np.uint64(self.buckets)).astype(np.int64)])]


class Decoder:
    """The bytes of ids, by one table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes = pa.array(by_id, pa.large_binary())

    def decode(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The bytes of each run of ``ids`` up to each of ``ends``."""
        return joined(self.bytes, ids, ends)


def joined(table: pa.Array, ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """The entries of ``table`` at each run of ``ids``, run together."""
    taken = table.take(ids.cast(pa.int64()))
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
    places = pa.py_buffer(np.ascontiguousarray(offsets[ends]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, places, taken.buffers()[2]])


class Numbered(dict):
    """Pre-token to its number, in order of first appearance."""

    def __missing__(self, token: str) -> int:
        k = self[token] = len(self)
        return k


class Shelf:
    """Pre-tokens with their ids, by open addressing in flat arrays of fixed size; texts are compared, not only hashes."""

    def __init__(self, size: int) -> None:
        self.most = max(1, size // ENTRY)
        self.flat, self.text = np.empty(4 * self.most, dtype=np.int32), np.empty(16 * self.most, dtype=np.uint8)
        self.hashes = np.empty(self.most, dtype=np.uint64)
        self.ends, self.text_ends = np.zeros(self.most + 1, dtype=np.int64), np.zeros(self.most + 1, dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << (2 * self.most - 1).bit_length(), -1, dtype=np.int32)
        self.mask = np.uint64(len(self.slots) - 1)

    def find(self, hashes: np.ndarray, text: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
        """The number of each pre-token, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        at, left = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        while len(left):
            there = self.slots[at[left]]
            left, there = left[there >= 0], there[there >= 0]
            same = self.hashes[there] == hashes[left]
            out[left[same]] = there[same]
            left = left[~same]
            at[left] = (at[left] + 1) & int(self.mask)
        found = np.flatnonzero(out >= 0)
        found = found[~self._same(out[found], found, text, text_ends)]
        out[found] = -1
        return out

    def _same(self, mine: np.ndarray, theirs: np.ndarray, text: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
        lengths = self.text_ends[mine + 1] - self.text_ends[mine]
        same = lengths == text_ends[theirs + 1] - text_ends[theirs]
        a, ends = gather(self.text, self.text_ends, mine[same])
        b, _ = gather(text, text_ends, theirs[same])
        differ = np.concatenate([[0], np.cumsum(a != b)])
        same[same] = differ[ends[1:]] == differ[ends[:-1]]
        return same

    def add(self, hashes: np.ndarray, text: np.ndarray, text_ends: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        """Adds pre-tokens that differ and aren't here; what doesn't fit an empty shelf isn't kept."""
        fits = lambda: self.n + len(hashes) <= self.most and self.ends[self.n] + len(flat) <= len(self.flat) and self.text_ends[self.n] + len(text) <= len(self.text)
        if not fits():
            self.clear()
            if not fits():
                return
        a, b, n = int(self.ends[self.n]), int(self.text_ends[self.n]), len(hashes)
        self.flat[a : a + len(flat)], self.text[b : b + len(text)] = flat, text
        self.ends[self.n + 1 : self.n + n + 1], self.text_ends[self.n + 1 : self.n + n + 1] = a + ends[1:], b + text_ends[1:]
        self.hashes[self.n : self.n + n] = hashes
        at, left = (hashes & self.mask).astype(np.int64), np.arange(n)
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = self.n + free
            left = left[self.slots[at[left]] != self.n + left]
            at[left] = (at[left] + 1) & int(self.mask)
        self.n += n


class Codec(Decoder):
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__(ranks)
        self.split = splitter(pattern)
        self.tokens = list(ranks)
        self.ids = np.array(list(ranks.values()), dtype=np.int64)
        self.hash = PerfectHash(self.tokens)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.merges = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.shelf = Shelf(CACHE)

    def merge(self, token: bytes) -> list[int]:
        """Tier two: merges by a heap over linked bytes."""
        ids = [self.single[b] for b in token]
        n, merge = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := merge(ids[i] << 32 | ids[i + 1], -1)) >= 0]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or merge(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := merge(rank << 32 | ids[k], -1)) >= 0:
                    heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := merge(ids[h] << 32 | rank, -1)) >= 0:
                heappush(heap, r * n + h)
        return [x for x in ids if x >= 0]

    def _new(self, raw: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends of pre-tokens: tier one for all at once, tier two for the rest."""
        found = self.hash.lookup(raw)
        tokens, merge = self.tokens, self.merge
        flat: list[int] = []
        lengths = []
        for token, k, own in zip(raw, found.tolist(), self.ids[found].tolist()):
            some = (own,) if tokens[k] == token else merge(token)
            flat += some
            lengths.append(len(some))
        return np.array(flat, dtype=np.int32), np.cumsum([0, *lengths])

    def _table(self, tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, ends, place): the ids of different pre-tokens, those of the k-th at run ``place[k]``."""
        raw = [t.encode() for t in tokens]
        hashes = self.hash.hashes(raw, 0)
        text, text_ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
        found = self.shelf.find(hashes, text, text_ends)
        place = np.empty(len(raw), dtype=np.int64)
        old, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        place[old], place[new] = np.arange(len(old)), len(old) + np.arange(len(new))
        flat, ends = gather(self.shelf.flat, self.shelf.ends, found[old])
        if len(new):
            more, more_ends = self._new([raw[k] for k in new.tolist()])
            self.shelf.add(hashes[new], *gather(text, text_ends, new), more, more_ends)
            flat, ends = np.concatenate([flat, more]), np.concatenate([ends, ends[-1] + more_ends[1:]])
        return flat, ends, place

    def flat_ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, end to end, and where each text's end."""
        numbers = Numbered()
        number = numbers.__getitem__
        parts = [np.fromiter(map(number, tokens), dtype=np.int64, count=len(tokens)) for tokens in map(self.split, texts)]
        flat, ends, place = self._table(list(numbers))
        flat, ends = gather(flat, ends, place[np.concatenate(parts)] if parts else place)
        return flat, ends[np.cumsum([0, *map(len, parts)])]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        flat, ends = self.flat_ids(texts)
        return [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def gather(flat: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` with these numbers, end to end, and their ends from 0."""
    starts = ends[numbers]
    lengths = ends[numbers + 1] - starts
    out = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.repeat(starts - out[:-1], lengths) + np.arange(out[-1])], out


def slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows bounded in characters."""
    first, some, size = 0, [], 0
    for k, x in enumerate(column):
        some.append(x.as_py() or "")
        size += len(some[-1])
        if size >= GROUP or len(some) >= 4096:
            yield first, some
            first, some, size = k + 1, [], 0
    if some:
        yield first, some


_codecs: dict[tuple[str, str | None], Decoder] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file; a worker builds it once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def decoder(path: str) -> Decoder:
    """The table of a rank file without hash, merges and cache; a worker builds it once."""
    if (path, None) not in _codecs:
        _codecs[path, None] = Decoder(load_ranks(path))
    return _codecs[path, None]


def _replace(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in columns]
    kept = [batch.column(batch.schema.names.index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*kept, *columns.values()], names=[*names, *columns])


def _schema(df: DataFrame, *added: T.StructField) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in {a.name for a in added}] + list(added))


#: Columns made of a slice's flat ids, their ends and the decoded bytes of each text.
Result = Callable[[np.ndarray, np.ndarray, pa.Array], dict[str, pa.Array]]


def transcribe(df: DataFrame, path: str, pattern: str, result: Result, fields: Sequence[T.StructField], text_col: str = "text") -> DataFrame:
    """``df`` with the columns that ``result`` makes of every text's ids and of the bytes that those decode to.

    One pass: neither ids nor bytes leave the worker unless ``result`` returns them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for first, texts in slices(batch.column(text_at)):
                ids, ends = own.flat_ids(texts)
                yield _replace(batch.slice(first, len(texts)), result(ids, ends, own.decode(pa.array(ids), ends)))

    text_at = df.columns.index(text_col)
    return df.mapInArrow(run, _schema(df, *fields))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with an array of ids for the text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for first, texts in slices(batch.column(text_at)):
                ids, ends = own.flat_ids(texts)
                yield _replace(batch.slice(first, len(texts)), {ids_col: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))})

    text_at = df.columns.index(text_col)
    return df.mapInArrow(run, _schema(df, T.StructField(ids_col, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, path: str, pattern: str = "", ids_col: str = "ids", bytes_col: str = "decoded", rows: int = 256) -> DataFrame:
    """``df`` with the bytes that an array of ids stands for; a null array gives none.

    Only the rank file's table is needed; ``pattern`` is there so that ``encode`` and ``decode`` take the same rule.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = batch.column(ids_at)
                ends = np.cumsum([0, *(x or 0 for x in ids.value_lengths().to_pylist())])
                yield _replace(batch, {bytes_col: own.decode(ids.flatten(), ends).cast(pa.binary())})

    ids_at = df.columns.index(ids_col)
    return df.mapInArrow(run, _schema(df, T.StructField(bytes_col, T.BinaryType())))


def digests(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 in place of ids and bytes."""
    written = F.concat_ws(",", F.col(ids_col).cast("array<string>"))
    return df.withColumns({"n_tokens": F.size(ids_col).cast("long"), "ids_sha256": F.sha2(written, 256), "decoded_sha256": F.sha2(bytes_col, 256)}).drop(ids_col, bytes_col)


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
_DECIMAL: list[pa.Array] = []


def digest_columns(ids: np.ndarray, ends: np.ndarray, decoded: pa.Array) -> dict[str, pa.Array]:
    """The columns of ``digests``, for ``transcribe``."""
    most = int(ids.max(initial=0))
    if not _DECIMAL or len(_DECIMAL[0]) <= most:
        _DECIMAL[:] = [pa.array([b"%d," % k for k in range(max(1 << 16, 2 * most))], pa.large_binary())]
    written = joined(_DECIMAL[0], pa.array(ids), ends)
    return {
        "n_tokens": pa.array(np.diff(ends), pa.int64()),
        "ids_sha256": pa.array([sha256(x.as_buffer()[:-1] if n else b"").hexdigest() for x, n in zip(written, np.diff(ends))], pa.string()),
        "decoded_sha256": pa.array([sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string()),
    }
