"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

Model
    Interpolated modified Kneser-Ney over character ``order``-grams, each text
    padded with a start mark and ended with an end mark, counted over all
    trusted texts except a held-out fifth (by the hash of the id).  The highest
    order has counts, lower orders continuation counts; the three discounts of
    each order come from its counts of counts; the lowest order is interpolated
    with the uniform distribution.

Scale
    Texts are grouped into blocks of about ``block`` bytes by the hash of
    their id; an id whose rows fill more than a block is split by the hash of its
    texts, so a block is bounded and no key is hot.  A block sends each of
    its different n-grams once, with its count in trusted text: characters are
    aggregated before anything is shuffled.  Count tables are sharded by n-gram
    and joined by n-gram, prefix and suffix to give each n-gram's
    log-probability; these are joined back to the blocks that asked, where each
    document's mean is taken.  The model is never in one place, nor broadcast.

Threshold
    For each language the ``quantile`` of held-out trusted documents' mean
    negative log-probability, from counts in bins of a thousandth of a nat (the
    same however rows are spread), plus ``SPREAD / sqrt(n)`` for a document of n
    characters, since the mean of a short text varies.  A few held-out
    documents leave a quantile uncertain, so ``SURE`` times their deviation over
    the root of their number is added, unless a caller gives a ``margin`` in
    nats.  A document is rejected above it.  A language without held-out trusted documents rejects nothing.

Defined results
    A null text is empty; an empty text is scored by its end mark.  NUL counts
    as U+FFFD.  A null language is a language of its own.  Rows that repeat an
    id each get a row; a label holds for all rows of its id; of several labels
    of an id, one untrusted makes it untrusted.  Without trusted text every
    document is kept and its perplexity is null.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import open_parcels, parcels
from .store import Workspace

ORDER = 5
BLOCK = 16 << 20
QUANTILE = 0.99
#: Twice about the deviation of one character's negative log-probability.
SPREAD = 4.0
#: Deviations / sqrt(documents) from a normal 0.99 quantile's estimate to its one-sided 95 % bound.
SURE = 3.2
#: One in so many trusted documents is held out for the thresholds.
HELD_OUT = 5
START, END = "\x02", "\x03"
#: Characters whose n-grams are numbered at once.
CHUNK = 1 << 21
FIXED = 1 << 20
BINS = 1000


# ------------------------------------------------------- n-grams of a block


def _codes(texts: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded texts, one after the other, and the number of n-grams of each."""
    pad = START * (order - 1)
    joined = "".join(f"{pad}{t}{END}" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    if "\0" in joined:
        codes = np.where(codes == 0, np.uint32(0xFFFD), codes)
    return codes, np.array([len(t) + 1 for t in texts], dtype=np.int64)


def ngrams(texts: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different n-grams as numpy strings, number of each n-gram of the texts in turn, n-grams per text)."""
    codes, sizes = _codes(texts, order)
    present = np.flatnonzero(np.bincount(codes, minlength=1)) if len(codes) else np.zeros(0, dtype=np.int64)
    local = np.zeros(int(present[-1]) + 1 if len(present) else 1, dtype=np.int64)
    local[present] = np.arange(len(present))
    small = local[codes]
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=f"<U{order}"), np.zeros(0, dtype=np.int64), sizes
    key, bound = small[:n], len(present)
    for k in range(1, order):
        if bound * len(present) >= 1 << 62:
            key, kinds = pd.factorize(key)
            bound = len(kinds)
        key = key * len(present) + small[k : n + k]
        bound *= len(present)
    # windows that begin in a text's last order - 1 codes span two texts
    whole = sizes + order - 1
    starts = np.cumsum(whole) - whole
    inside = np.ones(n, dtype=bool)
    for k in range(order - 1):
        at = starts[1:] - 1 - k
        inside[at[at >= 0]] = False
    places = np.flatnonzero(inside)
    numbers, kinds = pd.factorize(key[places])
    first = np.full(len(kinds), len(places), dtype=np.int64)
    first[numbers[::-1]] = np.arange(len(numbers))[::-1]
    windows = np.lib.stride_tricks.sliding_window_view(codes, order)[places[first]]
    return np.ascontiguousarray(windows).view(f"<U{order}").ravel(), numbers.astype(np.int64), sizes


def _chunks(texts: Sequence[str]):
    """(first, last) of runs of texts of about CHUNK characters."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > CHUNK:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _merged(parts: Sequence[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by("gram").aggregate([("c", "sum")])
    return pa.table({"gram": found["gram"], "c": found["c_sum"]})


# ------------------------------------------------------------ count tables


def _discounts(counts: DataFrame, name: str) -> tuple[float, float, float]:
    """The three discounts of an order, from the numbers of n-grams with counts 1 to 4; half the count where those give none."""
    n = [0] * 5
    for c, k in counts.where(F.col(name) <= 4).groupBy(name).count().collect():  # four rows at most
        n[c] = k
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    told = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.0 for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else 0.5 * k for k, d in zip((1, 2, 3), told))


def _discounted(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, c - d[0]).when(c == 2, c - d[1]).otherwise(c - d[2])


def probabilities(fitted: DataFrame, wanted: DataFrame, order: int, space: Workspace) -> DataFrame:
    """(gram, logp): log-probability of the last character of each wanted n-gram after the others.

    ``fitted`` has (gram, c), ``wanted`` different grams, all of ``order`` characters.
    """
    tables = {order: fitted}
    for k in range(order - 1, 0, -1):
        tables[k] = space.save(tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")))
    asked = {order: wanted}
    for k in range(order - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()
        if k == order - 1:
            asked[k] = space.save(asked[k])
    total, kinds = tables[1].agg(F.sum("c"), F.count("*")).first()
    d = _discounts(tables[1], "c")
    classes = [F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count_if(F.col("c") >= 3)]
    n1, n2, n3 = tables[1].agg(*classes).first()
    # one more kind than seen: an unseen character has a probability too
    spare = (d[0] * n1 + d[1] * n2 + d[2] * n3) / total / (kinds + 1)
    p = asked[1].join(tables[1], "gram", "left").select("gram", (F.when(F.col("c").isNotNull(), _discounted(F.col("c"), d) / total).otherwise(0.0) + spare).alias("p"))
    for k in range(2, order + 1):
        d = _discounts(tables[k], "c")
        contexts = tables[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("c").alias("all"), *(x.alias(f"n{i + 1}") for i, x in enumerate(classes)))
        rows = asked[k].select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest"))
        # tables that grow with the text are never broadcast
        lower = p.withColumnsRenamed({"gram": "rest", "p": "lower"})
        joined = rows.join(tables[k].hint("merge"), "gram", "left").join(contexts.hint("merge"), "context", "left").join(lower.hint("merge"), "rest")
        spread = (F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / F.col("all")
        own = F.when(F.col("c").isNotNull(), _discounted(F.col("c"), d) / F.col("all")).otherwise(0.0)
        before, p = p, space.save(joined.select("gram", F.when(F.col("all").isNull(), F.col("lower")).otherwise(own + spread * F.col("lower")).alias("p")))
        space.drop(before)
    for done in (*(tables[k] for k in range(1, order)), asked[max(order - 1, 1)]):
        space.drop(done)
    return space.named(p.select("gram", F.log("p").alias("logp")), p)


# ---------------------------------------------------------------- operator


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(id): labelled good and not toxic, in every label of the id."""
    good = (F.coalesce(labels[quality_col], F.lit(0)) == 1) & (F.coalesce(labels[toxic_col], F.lit(0)) == 0)
    return labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("id")).agg(F.bool_and(good).alias("good")).where("good").select("id")


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, order: int = ORDER, block: int = BLOCK, space: Workspace | None = None) -> DataFrame:
    """(id, hash, lang, held, n, nll): for each row its n-grams and the sum of their negative log-probabilities.

    ``hash`` is of the text; ``held`` marks held-out trusted rows; ``nll`` is null
    without trusted text.
    """
    spark = docs.sparkSession
    space = space or Workspace(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 64 * F.count("*")).first()[0]
    blocks = max(1, -(-size // block))
    of_id = F.pmod(F.xxhash64("id"), F.lit(blocks))
    held = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(HELD_OUT)) == 0
    marks = trusted.select(of_id.alias("block"), "id", held.alias("held"))
    spread = rows.withColumn("hash", F.xxhash64("text"))
    own = spread.groupBy("id").agg((F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 64 * F.count("*")).alias("bytes"))
    # ids whose rows fill more than a block are split by their texts; there are no more of them than blocks
    heavy = space.save(own.where((F.col("bytes") > block) & F.col("id").isNotNull()).select(F.col("id").alias("heavy"), F.ceil(F.col("bytes") / block).cast("long").alias("parts")))
    at = F.when(F.col("id").isNull(), F.pmod("hash", F.lit(blocks))).otherwise(of_id)
    if not heavy.isEmpty():
        part = lambda salt: F.pmod(F.xxhash64("id", salt), F.lit(blocks))
        spread = spread.join(heavy, F.col("id") == F.col("heavy"), "left")
        at = F.when(F.col("parts").isNotNull(), part(F.pmod("hash", "parts"))).otherwise(at)
        salts = trusted.join(heavy, F.col("id") == F.col("heavy")).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
        marks = marks.union(salts.select(part(F.col("salt")).alias("block"), "id", held.alias("held"))).distinct()
    spread = spread.withColumn("block", at).select("id", "text", "lang", "hash", "block")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        used = right.filter(pc.invert(right["held"]))["id"].combine_chunks()
        parts, at = [pa.table({"gram": pa.array([], pa.string()), "c": pa.array([], pa.int64())})], None
        for rows in open_parcels(left):
            at = rows["block"][0].as_py()
            fits = pc.fill_null(pc.is_in(rows["id"], used), False).to_numpy(zero_copy_only=False)
            texts = [x or "" for x in rows["text"].to_pylist()]
            for a, b in _chunks(texts):
                grams, numbers, sizes = ngrams(texts[a:b], order)
                counted = np.bincount(numbers[np.repeat(fits[a:b], sizes)], minlength=len(grams))
                parts.append(pa.table({"gram": pa.array(grams, pa.string()), "c": counted.astype(np.int64)}))
            if len(parts) > 8:
                parts = [_merged(parts)]
        both = _merged(parts)
        return pa.table({"block": pa.array(np.full(both.num_rows, at or 0, dtype=np.int64)), "gram": both["gram"], "c": both["c"]})

    with space.tidy():
        grams = space.save(parcels(spread.select("block", "id", "text"), "block").groupBy("key").cogroup(marks.groupBy("block")).applyInArrow(count, "block long, gram string, c long"))
        counts = space.save(grams.groupBy("gram").agg(F.sum("c").alias("c")))  # 0 for what only other text holds
        fitted, wanted = counts.where("c > 0"), counts.select("gram")
        if fitted.isEmpty():
            return spread.select("id", "hash", "lang", F.lit(False).alias("held"), (F.coalesce(F.char_length("text"), F.lit(0)) + 1).cast("long").alias("n"), F.lit(None).cast("double").alias("nll"))
        known = probabilities(fitted, wanted, order, space)
        # a gram that every block asks for is one row joined to as many as there are blocks; written, so that the
        # join's shuffle is gone before the texts are shuffled again
        sent = space.save(grams.select("block", "gram").join(known.hint("merge"), "gram").select("block", "gram", F.round(F.col("logp") * FIXED).cast("long").alias("logp")))
        for done in (grams, counts, known):
            space.drop(done)
        held_ids = marks.where("held").select("block", F.lit(None).cast("string").alias("gram"), F.col("id").alias("logp"))

        def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
            model = right.filter(pc.is_valid(right["gram"]))
            known_grams, logs = model["gram"].combine_chunks(), model["logp"].to_numpy()
            ids = right.filter(pc.is_null(right["gram"]))["logp"].combine_chunks()
            found = [pa.table({"id": pa.array([], pa.int64()), "hash": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "held": pa.array([], pa.bool_()), "n": pa.array([], pa.int64()), "nll": pa.array([], pa.float64())})]
            for rows in open_parcels(left):
                texts = [x or "" for x in rows["text"].to_pylist()]
                totals, lengths = [], []
                for a, b in _chunks(texts):
                    own, numbers, sizes = ngrams(texts[a:b], order)
                    values = logs[pc.index_in(pa.array(own, pa.string()), value_set=known_grams).to_numpy(zero_copy_only=False)]
                    sums = np.concatenate([[0], np.cumsum(values[numbers])])
                    ends = np.cumsum(sizes)
                    totals.append(sums[ends] - sums[ends - sizes])
                    lengths.append(sizes)
                held = pc.fill_null(pc.is_in(rows["id"], ids), False)
                found.append(pa.table({"id": rows["id"], "hash": rows["hash"], "lang": rows["lang"], "held": held, "n": np.concatenate(lengths), "nll": -np.concatenate(totals) / FIXED}))
            return pa.concat_tables(found)

        right = sent.union(held_ids)
        scored = space.save(parcels(spread, "block").groupBy("key").cogroup(right.groupBy("block")).applyInArrow(weigh, "id long, hash long, lang string, held boolean, n long, nll double"))
    space.drop(sent)
    return scored


def judge(scored: DataFrame, *, quantile: float = QUANTILE, margin: float | None = None) -> DataFrame:
    """``scored`` with threshold (of the mean, in nats, for a text of its length) and kept."""
    mean, slack = F.col("nll") / F.col("n"), F.lit(SPREAD) / F.sqrt("n")
    bins = scored.where("held").groupBy("lang", F.ceil((mean - slack) * BINS).alias("bin")).agg(F.count("*").alias("k"))
    upto = Window.partitionBy("lang").orderBy("bin")
    whole = Window.partitionBy("lang")
    sums = {"upto": F.sum("k").over(upto), "all": F.sum("k").over(whole), "one": F.sum(F.col("k") * F.col("bin")).over(whole), "two": F.sum(F.col("k") * F.col("bin") * F.col("bin")).over(whole)}
    ranked = bins.withColumns(sums)
    variance = F.greatest(F.col("two") - F.col("one") * F.col("one") / F.col("all"), F.lit(0.0)) / F.greatest(F.col("all") - 1, F.lit(1))
    above = F.max(SURE * F.sqrt(variance / F.col("all")) / BINS) if margin is None else F.lit(margin)
    cuts = ranked.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg((F.min("bin") / BINS + above).alias("threshold")).withColumnRenamed("lang", "of")
    # one row a language against rows without text; adaptive execution sends it to all, or splits the hot language
    return scored.join(cuts, scored["lang"].eqNullSafe(cuts["of"]), "left").drop("of").withColumn("threshold", F.col("threshold") + slack).withColumn("kept", F.coalesce(mean <= F.col("threshold"), F.lit(True)))


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, order: int = ORDER, quantile: float = QUANTILE, margin: float | None = None) -> DataFrame:
    """id_col, lang_col, n_chars, perplexity, threshold (as a perplexity) and kept of every row."""
    found = judge(score(docs, trusted_ids(labels, id_col), id_col, text_col, lang_col, order=order), quantile=quantile, margin=margin)
    return found.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.greatest(F.col("n") - 1, F.lit(0)).alias("n_chars"), F.exp(F.col("nll") / F.col("n")).alias("perplexity"), F.exp("threshold").alias("threshold"), "kept")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **rules: float) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    space = Workspace(docs.sparkSession)
    scored = score(docs, trusted_ids(labels, id_col), id_col, text_col, lang_col, space=space)
    gone = space.save(judge(scored, **rules).where("not kept").select(F.col("id").alias("__tm_id"), F.col("hash").alias("__tm_hash"), F.col("lang").alias("__tm_lang")).distinct())
    same = docs[id_col].cast("long").eqNullSafe(gone["__tm_id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__tm_hash"]) & docs[lang_col].cast("string").eqNullSafe(gone["__tm_lang"])
    return docs.join(gone, same, "left_anti")
