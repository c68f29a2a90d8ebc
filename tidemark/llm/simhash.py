"""SimHash near-duplicate detection with deletion-variant signatures.

Fingerprint
    Texts are lower-cased on A-Z, cut into words ``[^\\x20\\x09-\\x0D]+`` and
    into ``width``-word shingles (repeats count).  Every shingle is hashed with
    XXH64 (UTF-8, seed 42); a fingerprint bit is set when it is set in more than
    half of the hashes.  A text with fewer words than ``width`` is one shingle;
    a text without words (null and empty texts included) has fingerprint zero.

Linking
    Two fingerprints link when at most ``distance`` bits differ.  The 64 bits
    are cut into ``distance // 2 + 1`` segments (two at least), fewer than the
    usual ``distance + 1``, so at least one segment differs by one bit at most.  Each
    segment is indexed unchanged and once per bit with that bit deleted
    (a wildcard); a pair that differs by exactly one bit there meets on the
    deleted-bit key, on opposite sides of the join, so no pair meets twice in a
    segment.  Every meeting is verified on all 64 bits.

    From some ten million fingerprints on, keys of one segment (21 bits) would
    meet too often.  Then the bits are cut finer and a key takes several
    segments that differ by one bit at most together: 26, 32 or 37 bits.

Scale
    Equal fingerprints are grouped before any join, so thousands of copies cost
    one row.  Exploded keys and tables of a row per fingerprint are joined by
    merging: Spark sizes them by the file that they come from, so it would build
    and broadcast dozens of keys for each 16 bytes of it on the driver.
    A first, linear pass links every fingerprint to the smallest one
    in its bucket; the joins then emit only pairs whose ends are still in
    different components, so a dense family yields a handful of rows, not all
    its pairs.  Hot keys stay splittable joins (adaptive skew handling), groups
    are never gathered in one task, and components are found by label
    propagation over tables written to the shared folder.

Defined results
    Every input row gives one row.  Null ids stay null and don't count towards
    ``component_id``; a component of null ids only has a null ``component_id``.
    Rows that repeat an id are separate nodes.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import utf8
from .components import propagate
from .store import Workspace

SEED = 42
#: Shingles whose bits are counted at once: bounds memory for texts of any length.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width]
    ends = ends[width - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), CHUNK):
        pairs = zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, *others: str) -> DataFrame:
    """(id, fp) and other long columns: the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, width) for x in utf8(batch.column(0))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], names=["id", *others, "fp"])

    source = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].cast("long").alias("id"), *others)
    return source.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", *others, "fp")))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments, at least two, that 64 bits are cut into."""
    return _cut(max(2, distance // 2 + 1))


def _cut(n: int) -> list[tuple[int, int]]:
    cuts = [round(64 * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


#: The bits of a fingerprint that a key holds: (first bit, bits) of each of its segments.
Choice = tuple[tuple[int, int], ...]


def choices(distance: int, together: int) -> list[Choice]:
    """The segments, ``together`` of them at a time, of which some choice differs by one bit at most.

    One of ``distance // 2 + 1`` segments does.  Of ``distance + m - 1`` segments
    some m do: else the m that differ least would differ by two bits, and the
    rest, by one each at least, by the others that are allowed and one more.
    """
    own = segments(distance) if together == 1 else _cut(distance + together - 1)
    return list(combinations(own, together))


def together(n: int, distance: int) -> int:
    """How many segments a key should have, so that ``n`` fingerprints make the fewest rows and meetings."""

    def cost(m: int) -> float:
        bits = [sum(b for _, b in c) for c in choices(distance, m)]
        return n * sum(b + 1 for b in bits) + n * n / 2 * sum((b + 1) / 2.0**b for b in bits)

    # several segments only where they leave bits out, and keys stay few and fit beside their numbers
    fits = lambda m: 1 < distance <= 9 - m and max(sum(b for _, b in c) for c in choices(distance, m)) <= 48
    return min((m for m in (1, 2, 3, 4) if m == 1 or fits(m)), key=cost)


def _part(choice: Choice, cleared: int = -1) -> Column:
    """The choice's bits side by side, without one."""
    out, at = F.lit(0).cast("long"), 0
    for first, bits in choice:
        kept = ((1 << bits) - 1) & ~(1 << cleared - at if at <= cleared < at + bits else 0)
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(kept).cast("long")), at))
        at += bits
    return out


def _key(choice: int, wildcard: int, rest: Column) -> Column:
    """The number of the variant above the bits of a choice, 48 at most."""
    return rest.bitwiseOR(F.lit((choice * 65 + wildcard) << 48).cast("long"))


def _variants(nodes: DataFrame, options: list[Choice], bit: int) -> DataFrame:
    """One row per deleted bit that has the value ``bit`` in the fingerprint."""
    keys = []
    for s, choice in enumerate(options):
        places = [first + k for first, bits in choice for k in range(bits)]
        for p, place in enumerate(places):
            has = F.shiftrightunsigned("fp", place).bitwiseAND(F.lit(1).cast("long")) == bit
            keys.append(F.when(has, _key(s, p + 1, _part(choice, p))))
    return nodes.select("fp", "comp", F.explode(F.array_compact(F.array(*keys))).alias("key"))


def _exact(nodes: DataFrame, options: list[Choice]) -> DataFrame:
    keys = [_key(s, 0, _part(choice)) for s, choice in enumerate(options)]
    return nodes.select("fp", "comp", F.explode(F.array(*keys)).alias("key"))


def _near(distance: int) -> Column:
    return F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance


def link(fps: DataFrame, distance: int, space: Workspace, at_a_time: int | None = None) -> DataFrame:
    """(fp, comp): for each different fingerprint, its component's smallest node number.

    ``fps`` has one row per different fingerprint.  ``comp`` is the smallest
    fingerprint value of the component.  Keys have as many segments as make the
    fewest meetings for so many fingerprints; links are the same with any.
    """
    nodes = fps.select("fp", F.col("fp").alias("comp"))
    options = choices(distance, at_a_time or together(fps.count(), distance))
    exact = _exact(nodes, options)
    hubs = exact.groupBy("key").agg(F.min("fp").alias("hub"))
    stars = exact.join(hubs.hint("merge"), "key").where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= distance)).select(F.col("fp").alias("src"), F.col("hub").alias("dst")).distinct()
    stars = space.save(stars)
    first = propagate(fps.select("fp"), stars, space)
    space.drop(stars)
    exact, zeros, ones = _exact(first, options), _variants(first, options, 0), _variants(first, options, 1)
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & _near(distance)
    ends = [F.least("a.comp", "b.comp").alias("src"), F.greatest("a.comp", "b.comp").alias("dst")]
    pairs = exact.alias("a").join(exact.alias("b").hint("merge"), same & (F.col("a.fp") < F.col("b.fp"))).select(*ends).union(zeros.alias("a").join(ones.alias("b").hint("merge"), same).select(*ends))
    edges = space.save(pairs.distinct())
    second = propagate(first.select(F.col("comp").alias("fp")).distinct(), edges, space)
    space.drop(edges)
    return first.alias("f").join(second.alias("s").hint("merge"), F.col("f.comp") == F.col("s.fp")).select("f.fp", "s.comp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4, distance: int = 4, space: Workspace | None = None) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id that a row reaches over links, its own
    included.
    """
    if not 0 <= distance < 32:
        raise ValueError("distance must be in [0, 32)")
    space = space or Workspace(docs.sparkSession)
    fps = space.save(fingerprints(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id", "text", width))
    return _classes(fps, distance, space).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(fps: DataFrame, distance: int, space: Workspace) -> DataFrame:
    """The rows of ``fps`` (id, fp and others) with component and component_id."""
    nodes = space.save(fps.groupBy("fp").agg(F.min("id").alias("least")))
    comps = space.save(link(nodes.select("fp"), distance, space))
    names = comps.join(nodes.hint("merge"), "fp").groupBy("comp").agg(F.min("least").alias("component_id"))
    named = space.save(comps.join(names.hint("merge"), "comp").select("fp", F.col("comp").alias("component"), "component_id"))
    for done in (nodes, comps):
        space.drop(done)
    return fps.join(named.hint("merge"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, then text hash.

    All columns stay, whatever their names.  A row with a null id stays only if
    its group has no other.  Of rows with the same id and text, one stays.
    """
    space = Workspace(docs.sparkSession)
    identity = [docs[id_col].alias("__tm_id"), F.xxhash64(docs[text_col].cast("string")).alias("__tm_hash")]
    marked = docs.select("*", *identity)
    keyed = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col].cast("string")).alias("hash"))
    fps = space.save(fingerprints(keyed, "id", "text", width, "hash"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("w")
    winners = space.save(_classes(fps, distance, space).groupBy("component").agg(first).select("w.id", "w.hash").distinct())
    kept = marked.join(winners, marked["__tm_id"].eqNullSafe(winners["id"]) & (marked["__tm_hash"] == winners["hash"]), "left_semi")
    return kept.dropDuplicates(["__tm_id", "__tm_hash"]).drop("__tm_id", "__tm_hash")
