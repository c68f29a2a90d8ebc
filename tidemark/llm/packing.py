"""Best-fit packing of documents into sequences by bin completion.

Pieces
    A document's ids, with an end id, are cut only if there are more than
    ``capacity``: into pieces of ``capacity``, of which the first may be shorter.

Packing
    How pieces are packed depends only on how many there are of each length, and
    there are at most ``capacity`` lengths.  So the solver works on that
    histogram, whatever the number of documents.  Bin completion: take the
    largest length left, enumerate the fillings around it to which no piece left
    can be added, of any number of pieces, drop those that another dominates (its
    pieces can be laid into the other's, one or several into one), and use the
    chosen one so many times.  Sums that pieces left can make are bits of an
    integer, so every step of the enumeration leads to a filling.  Incumbents are
    best-fit decreasing and completion without backtracking, tried with several
    allowances of waste; depth-first
    branch-and-bound over fillings and repetitions leaves a branch when its
    sequences and the bound on the rest can't beat the incumbent, and stops when
    the incumbent meets the bound.  With ``nodes=None`` it tries all undominated
    fillings and all repetitions, so its result is optimal; the default visits
    ``NODES`` nodes, with the ``BRANCH`` fullest fillings and three repetitions at
    each, and then takes the incumbent.  All pieces are placed either way.

Assignment
    The solution is a list of (pattern, repetitions), at most a few thousand
    rows whatever the input.  Pieces of one length are numbered from 0: a
    row_number inside (length, bucket), plus the count of earlier buckets, so a
    length that a third of all pieces have is split over buckets.  A piece's
    number gives its sequence and offset by a join against the list.

Defined results
    Null and empty texts hold the end id only, so every row has a piece.  Rows
    that repeat an id are packed each; their pieces are told apart by
    ``row``.  An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import Workspace

#: Search nodes of the branch-and-bound before the incumbent is taken.
NODES = 2_000
#: Fillings tried at a node of a bounded search, the fullest first.
BRANCH = 6
#: 256ths of a sequence that completion may waste while longer pieces are left.
WASTE = (0, 2, 4, 8, 12, 16, 24, 32, 48, 64)
#: Pieces up to which a filling's dominance is searched with backtracking; beyond, best fit decides.
SEARCHED = 12
#: Pieces that one task numbers.
BUCKET = 1_000_000

Pattern = tuple[int, ...]


# ------------------------------------------------------------------ solver


def _sums(sizes: Sequence[int], left: Sequence[int], room: int) -> list[int]:
    """For each k, the sums up to ``room`` that pieces of the first k sizes can make, as bits."""
    mask, now = (1 << room + 1) - 1, 1
    out = [now]
    for n, count in zip(sizes, left):
        count, step = min(count, room // n), 1
        while count > 0:
            now |= now << n * min(step, count) & mask
            count -= step
            step *= 2
        out.append(now)
    return out


def _made(s: int, k: int, sizes: Sequence[int], left: Sequence[int], sums: Sequence[int]) -> Iterator[list[tuple[int, int]]]:
    """The (size, times) that make the sum ``s`` from the first ``k`` sizes, long pieces first."""
    if s == 0:
        yield []
        return
    for j in range(bisect_right(sizes, s, 0, k) - 1, -1, -1):
        if not sums[j + 1] >> s & 1:
            return
        n = sizes[j]
        for times in range(min(left[j], s // n), 0, -1):
            if sums[j] >> s - times * n & 1:
                for rest in _made(s - times * n, j, sizes, left, sums):
                    yield [(n, times), *rest]


def dominates(a: Pattern, b: Pattern) -> bool:
    """Whether the pieces of ``b`` can be laid into those of ``a``, one or several into one."""
    mine, theirs = Counter(a), Counter(b)
    rooms, small = sorted((mine - theirs).elements()), sorted((theirs - mine).elements(), reverse=True)
    if not small or sum(small) > sum(rooms):
        return not small

    def lay(k: int, rooms: list[int]) -> bool:
        if k == len(small):
            return True
        tried = set()
        for i, room in enumerate(rooms):  # the tightest first
            if room >= small[k] and room not in tried:
                tried.add(room)
                if lay(k + 1, sorted([*rooms[:i], room - small[k], *rooms[i + 1 :]])):
                    return True
                if len(small) > SEARCHED:
                    return False
        return False

    return lay(0, rooms) if len(small) <= 500 else False


def fillings(largest: int, counts: np.ndarray, capacity: int, limit: int | None = None) -> list[Pattern]:
    """Undominated fillings around ``largest``, the fullest first; ``limit`` at most, or all.

    ``counts[n]`` is how many pieces of length n are left, ``largest`` included.
    No piece left fits into the room that a filling leaves.
    """
    room = capacity - largest
    sizes = np.flatnonzero(counts[: min(room, largest) + 1]).tolist()
    left = [int(counts[n]) - (n == largest) for n in sizes]
    sums = _sums(sizes, left, room)
    found: list[Pattern] = []
    for s in range(room, -1, -1):
        if limit is not None and len(found) >= limit:
            break
        if not sums[-1] >> s & 1:
            continue
        for some in _made(s, len(sizes), sizes, left, sums):
            used = dict(some)
            if any(n <= room - s and left[k] > used.get(n, 0) for k, n in enumerate(sizes[: bisect_right(sizes, room - s)])):
                continue
            found.append((largest, *chain.from_iterable([n] * times for n, times in some)))
            if limit is not None and len(found) >= limit:
                break
    kept: list[Pattern] = []
    for pattern in sorted(found, key=lambda p: (-sum(p), len(p), tuple(-n for n in p))):  # none dominates an earlier one
        if not any(dominates(other, pattern) for other in kept):
            kept.append(pattern)
    return kept


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing: every piece, the longest first, goes to the fullest bin that has room."""
    rooms: dict[int, list[tuple[Pattern, int]]] = {}  # room -> (pattern, bins)
    done: list[tuple[Pattern, int]] = []
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        for room in sorted(r for r in rooms if r >= n):
            if not left:
                break
            each = room // n  # the fullest bin stays the fullest while the length fits
            groups, rooms[room] = rooms[room], []
            for pattern, bins_ in groups:
                whole = min(bins_, left // each)
                rest = min(left - whole * each, each - 1) if whole < bins_ else 0
                left -= whole * each + rest
                for more, number in ((each, whole), (rest, int(rest > 0)), (0, bins_ - whole - (rest > 0))):
                    if number:
                        rooms.setdefault(room - more * n, []).append((pattern + (n,) * more, number))
            if not rooms[room]:
                del rooms[room]
        each = capacity // n
        for more, number in ((each, left // each), (left % each, int(left % each > 0))):
            if number:
                rooms.setdefault(capacity - more * n, []).append(((n,) * more, number))
        done += rooms.pop(0, [])
    return done + [group for groups in rooms.values() for group in groups]


def _few(sizes: Sequence[int], left: Sequence[int], room: int, waste: int, times: int) -> list[int] | None:
    """The fewest pieces that leave at most ``waste`` of the room, of sizes that last so many times over."""
    sums, fits, mask = [1], [], (1 << room + 1) - 1
    while True:
        fits.append([n for n, count in zip(sizes, left) if count >= len(sums) * times])
        now = 0
        for n in fits[-1]:
            now |= sums[-1] << n & mask
        if not now:
            return None
        sums.append(now)
        s = now.bit_length() - 1
        if room - s <= waste:
            out = []
            for before, fit in zip(sums[-2::-1], fits[::-1]):
                out.append(next(n for n in reversed(fit) if n <= s and before >> s - n & 1))
                s -= out[-1]
            return sorted(out, reverse=True)


def chosen(left: np.ndarray, capacity: int, waste: int = 0) -> Pattern:
    """Completion's filling around the largest length left.

    The one of fewest pieces that wastes at most ``waste``, or no more than the
    fullest, and of those one that can be used often.  A little waste early keeps
    short pieces for those that need them.
    """
    present = np.flatnonzero(left)
    largest = int(present[-1])
    room = capacity - largest
    sizes = present[: np.searchsorted(present, min(room, largest), side="right")].tolist()
    own = [int(left[n]) - (n == largest) for n in sizes]
    sums = _sums(sizes, own, room)
    least = room - (sums[-1].bit_length() - 1)
    # no room is wasted that the shortest piece left could fill
    allowed = max(least, min([waste, *(n - 1 for n, k in zip(sizes[:1], own) if k)]))
    if room <= allowed:
        return (largest,)
    tries = int(left[largest])
    while tries:
        if some := _few(sizes, own, room, allowed, tries):
            return (largest, *some)
        tries //= 2
    made = next(_made(room - least, len(sizes), sizes, own, sums))
    return (largest, *chain.from_iterable([n] * times for n, times in made))


def completed(counts: np.ndarray, capacity: int, waste: int = 0) -> list[tuple[Pattern, int]]:
    """Bin completion without backtracking: ``chosen`` as often as the counts allow."""
    left = counts.copy()
    out: list[tuple[Pattern, int]] = []
    while left.any():
        pattern = chosen(left, capacity, waste)
        out.append((pattern, times := _times(pattern, left)))
        for n, k in Counter(pattern).items():
            left[n] -= k * times
    return out


def _times(pattern: Pattern, left: np.ndarray) -> int:
    return min(int(left[n]) // k for n, k in Counter(pattern).items())


def bins(solution: Sequence[tuple[Pattern, int]]) -> int:
    return sum(times for _, times in solution)


def bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and the bounds over long pieces (Martello and Toth)."""
    half = capacity // 2
    number = np.concatenate([[0], np.cumsum(counts)])  # of pieces shorter than n
    volume = np.concatenate([[0], np.cumsum(np.arange(len(counts)) * counts)])
    k = np.arange(half + 1)
    big = number[-1] - number[capacity - k + 1]
    middle = number[capacity - k + 1] - number[half + 1]
    free = capacity * middle - (volume[capacity - k + 1] - volume[half + 1])
    small = volume[half + 1] - volume[np.maximum(k, 1)]
    least = big + middle + np.maximum(0, -(-(small - free) // capacity))
    return max(-(-int(volume[-1]) // capacity), int(least.max()))


def pack(counts: np.ndarray, capacity: int, nodes: int | None = NODES) -> list[tuple[Pattern, int]]:
    """(pattern, repetitions) that hold every piece of the histogram ``counts[length]``.

    Optimal with ``nodes=None``, which takes exponential time.
    """
    least = bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    waste = 0
    for share in WASTE:
        own = completed(counts, capacity, capacity * share // 256) if bins(incumbent) > least else incumbent
        if bins(own) < bins(incumbent):
            incumbent, waste = own, capacity * share // 256
    visited = 0

    def steps(left: np.ndarray, count: int) -> list[tuple[Pattern, int]]:
        """The fillings and repetitions to try, the last first; none where the bound can't beat the incumbent."""
        nonlocal visited
        if count + bound(left, capacity) >= bins(incumbent) or nodes is not None and visited >= nodes:
            return []
        visited += 1
        out = []
        options = fillings(int(np.flatnonzero(left)[-1]), left, capacity, None if nodes is None else BRANCH)
        for pattern in options if nodes is None else dict.fromkeys([chosen(left, capacity, waste), *options]):
            most = _times(pattern, left)
            out += [(pattern, t) for t in (range(most, 0, -1) if nodes is None else dict.fromkeys((most, max(1, most // 2), 1)))]
        return out[::-1]

    if bins(incumbent) > least:
        done: list[tuple[Pattern, int]] = []
        trail = [(steps(counts, 0), counts, 0)]  # depth-first, without recursion per bin
        while trail and bins(incumbent) > least:
            options, left, count = trail[-1]
            del done[len(trail) - 1 :]
            if not options:
                trail.pop()
                continue
            pattern, times = options.pop()
            after = left.copy()
            for n, k in Counter(pattern).items():
                after[n] -= k * times
            done.append((pattern, times))
            if after.any():
                trail.append((steps(after, count + times), after, count + times))
            elif count + times < bins(incumbent):
                incumbent = list(done)
    return incumbent


# ------------------------------------------------------------ tokenization


def library_encoder(path: str) -> Callable[[Sequence[str]], list[list[int]]]:
    """Ids by the tokenizers library; special tokens' strings are ordinary text.

    Where the rank file of the same vocabulary lies beside it, its faster reader
    gives the same ids; texts that it refuses go to the library.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True

    def slow(texts: Sequence[str]) -> list[list[int]]:
        return [library.encode(text, add_special_tokens=False).ids for text in texts]

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def run(texts: Sequence[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(fast.encode_ordinary(text))
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # a panic of the native code isn't an Exception
                out += slow([text])
        return out

    return run


_encoders: dict[str, Callable[[Sequence[str]], list[list[int]]]] = {}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``length`` ids."""
    first = length % capacity or capacity
    starts = [0, *range(first, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc (the id), row (a hash of id and text), piece, start, length, ids_crc32 and, if asked, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = library_encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                columns: list[list] = [[] for _ in range(7)]
                for doc, row, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _encoders[path]([x or "" for x in part.column(2).to_pylist()])):
                    own = np.array([*ids, end_id], dtype="<u4")
                    for piece, (start, length) in enumerate(cut(len(own), capacity)):
                        some = own[start : start + length]
                        for column, value in zip(columns, (doc, row, piece, start, length, zlib.crc32(some.tobytes()), some.astype(np.int32) if with_ids else None)):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                n = 7 if with_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], kinds)], names=["doc", "row", "piece", "start", "length", "ids_crc32", "ids"][:n])

    source = docs.select(docs[id_col].cast("long").alias("doc"), F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string")).alias("row"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, "doc long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# -------------------------------------------------------------- assignment


def placements(solution: Sequence[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, last number, first sequence, pieces of the length per sequence, offset of the first of them).

    Pieces of one length lie side by side in a pattern.
    """
    used: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, times in solution:
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            each = pattern.count(n)
            base = used.get(n, 0)
            out.append((n, base, base + each * times - 1, sequence, each, offset))
            used[n] = base + each * times
            offset += n * each
        sequence += times
    return out


def best_fit_sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, end_id: int = 2, nodes: int | None = NODES, with_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    spark = docs.sparkSession
    space = Workspace(spark)
    cutted = space.save(pieces(docs, path, id_col, text_col, capacity=capacity, end_id=end_id, with_ids=with_ids))
    histogram = cutted.groupBy("length").count().collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram:
        counts[length] = n
    buckets = int(max(1, -(-counts.max() // BUCKET), min(64, counts.sum() // 10_000)))
    keyed = cutted.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy(F.col("doc").asc_nulls_first(), "row", "piece", "ids_crc32")
    numbered = keyed.withColumn("local", F.row_number().over(order) - 1).join(starts, ["length", "bucket"]).withColumn("number", F.col("local") + F.col("before"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "low", "high", "sequence", "each", "at")])
    places = F.broadcast(spark.createDataFrame(placements(pack(counts, capacity, nodes)), schema))  # bounded by the lengths, not the input
    on = (numbered["length"] == places["length"]) & F.col("number").between(F.col("low"), F.col("high"))
    within = F.col("number") - F.col("low")
    return numbered.join(places, on).select(
        F.col("doc").alias(id_col),
        "piece",
        "start",
        numbered["length"],
        "ids_crc32",
        (F.col("sequence") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(within, F.col("each")) * numbered["length"]).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
