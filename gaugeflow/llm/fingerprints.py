"""Threshold-scaled sketches: of a document's shingle hashes, those below a fixed fraction of the hash space.

A sketch grows with its document, the sketch of a union is the union of sketches, and both Jaccard and containment of
documents of very unequal length can be read off two sketches. Documents of few shingles keep all of them, as a fraction
would leave nothing to compare. A document's sketch says up to which bound it is complete; sketches are compared and merged
below the smaller of their bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm._native import let, spaced_words

#: Words of a shingle.
SHINGLE = 5
#: One of so many shingle hashes is kept; of documents with at most WHOLE different shingles, all.
SCALE, WHOLE = 8, 256
LARGEST = (1 << 63) - 1
#: Rows that one task orders to find each document's successor, about.
NEIGHBOUR_ROWS = 2_000
#: Ranges at most: their first keys are broadcast, 24 bytes each. Of quantiles that ranges begin with, at most.
MOST_RANGES, QUANTILES = 200_000, 2_000


def _bound(scale: int) -> Column:
    return F.lit(-(1 << 63) + (1 << 64) // scale - 1)


def _shingles(text: Column, shingle: int) -> Column:
    """Hashes of the text's word shingles, in order."""
    hashes = F.transform(F.filter(F.split(spaced_words(text), " "), lambda w: w != ""), lambda w: F.xxhash64(w))

    def rolled(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        short = F.when(n > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= shingle, full).otherwise(short)

    return let(hashes, rolled)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes (array<long>) of word shingles that lie in the lowest 1/scale of the hash space.

    Words are runs of letters and digits (all beyond ASCII counts as a letter), A-Z lower-cased. A text with fewer words
    than a shingle has its whole word sequence as one; null and empty texts have none.
    """
    return F.array_sort(F.array_distinct(F.filter(_shingles(text, shingle), lambda x: x <= _bound(scale))))


def document_sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE, whole: int = WHOLE) -> Column:
    """struct<n: long, hashes: array<long>, bound: long>: how many different shingles the text has, and its sketch, which holds
    all of them up to and with `bound`: the fraction's, or the largest hash if n <= whole."""

    def kept(h: Column) -> Column:
        few = F.size(h) <= whole
        hashes = F.array_sort(F.when(few, h).otherwise(F.filter(h, lambda x: x <= _bound(scale))))
        return F.struct(F.size(h).cast("long").alias("n"), hashes.alias("hashes"), F.when(few, F.lit(LARGEST)).otherwise(_bound(scale)).alias("bound"))

    return let(F.array_distinct(_shingles(text, shingle)), kept)


def _compared(left: Column, right: Column, of: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """of(left, right, and the hashes of both below the smaller of their bounds, where both hold all there are). Sketches are
    bound first, as lambdas would make them anew for each hash."""

    def below(p: Column) -> Column:
        bound = F.least(p["l"]["bound"], p["r"]["bound"])
        cut = lambda s: F.filter(s["hashes"], lambda h: h <= bound)
        return F.struct(p["l"].alias("l"), p["r"].alias("r"), cut(p["l"]).alias("low"), cut(p["r"]).alias("high"))

    return let(let(F.struct(left.alias("l"), right.alias("r")), below), lambda p: of(p["l"], p["r"], p["low"], p["high"]))


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of two document sketches, 0..1: exact where both hold all shingles. Documents without
    words are like each other (1) and unlike all others (0)."""

    def of(a: Column, b: Column, low: Column, high: Column) -> Column:
        return F.when((a["n"] == 0) & (b["n"] == 0), F.lit(1.0)).when((a["n"] == 0) | (b["n"] == 0), F.lit(0.0)).otherwise(jaccard(low, high))

    return _compared(left, right, of)


def document_containment(inner: Column, outer: Column) -> Column:
    """Estimated share of the inner document's shingles that the outer one holds, 0..1; 1 for a document without words.

    Exact where both sketches hold all shingles. Else the share c is measured on about n / scale of the inner one's n shingles,
    with a standard error of sqrt(c (1 - c) scale / n), so that a share of 0 or 1 is told exactly; null where none of them
    lies below the bound, as a short document has too few to say anything against a long one (of 5 shingles half the times,
    of 40 in one case of 200).
    """

    def of(a: Column, _: Column, low: Column, high: Column) -> Column:
        return F.when(a["n"] == 0, F.lit(1.0)).when(F.size(low) > 0, F.size(F.array_intersect(low, high)) / F.size(low))

    return _compared(inner, outer, of)


def document_merge(left: Column, right: Column, scale: int = SCALE) -> Column:
    """The sketch of both documents together, below the smaller of their bounds. Its n is exact while both hold all their
    shingles, and else scale times the hashes that are left, or the larger document's n where that is more."""

    def of(a: Column, b: Column, low: Column, high: Column) -> Column:
        bound = F.least(a["bound"], b["bound"])

        def counted(hashes: Column) -> Column:
            size = F.size(hashes).cast("long")
            return F.struct(F.when(bound == LARGEST, size).otherwise(F.greatest(a["n"], b["n"], size * scale)).alias("n"), hashes.alias("hashes"), bound.alias("bound"))

        return let(F.array_sort(F.array_union(low, high)), counted)

    return _compared(left, right, of)


def fingerprint(hashes: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, comma-joined."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def merge(left: Column, right: Column) -> Column:
    """The sketch of both documents together, of two sketches of one fraction (see document_merge() for others)."""
    return F.array_sort(F.array_union(left, right))


def jaccard(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity, 0..1; of two empty sketches 1, of one empty sketch 0."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def containment(inner: Column, outer: Column) -> Column:
    """Estimated share of inner's shingles that outer holds, 0..1, of two sketches of one fraction (see document_containment()
    for others); 1 for an empty sketch."""
    return F.when(F.size(inner) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(inner, outer)) / F.greatest(F.size(inner), F.lit(1)))


def with_sketch(df: DataFrame, text: str = "text", shingle: int = SHINGLE, scale: int = SCALE, whole: int = WHOLE) -> DataFrame:
    """Adds `sketch` (document_sketch()); rows are neither moved nor dropped."""
    return df.withColumn("sketch", document_sketch(F.col(text), shingle, scale, whole))


def document_fingerprint(found: Column) -> Column:
    """A document sketch as text: the count of different shingles, a colon, and the hashes as fingerprint() writes them."""
    return F.concat(found["n"].cast("string"), F.lit(":"), fingerprint(found["hashes"]))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= key, found in two steps of about a square root of comparisons each."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    long = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    part = F.size(F.filter(long([p[0] for p in parts]), lambda x: x <= key))
    inner = F.size(F.filter(F.get(F.array(*map(long, parts)), part - 1), lambda x: x <= key))
    return F.when(part == 0, 0).otherwise((part - 1) * width + inner)


def _placed(df: DataFrame, key: str, rows: int) -> Column:
    """The number (long) of each row's range. Ranges go by descending key, nulls last, and hold about NEIGHBOUR_ROWS rows
    wherever keys lie: they begin at quantiles and are divided evenly from there; rows of one key by their tie-break."""
    parts = min(QUANTILES, math.ceil(rows / NEIGHBOUR_ROWS))
    most = max(NEIGHBOUR_ROWS, math.ceil(rows / MOST_RANGES))
    found = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 4 * QUANTILES)).first()[0] if parts > 1 else []
    often = {a for a, b in zip(found or [], (found or [])[1:], strict=False) if a == b}
    bounds = sorted({*(found or []), *(x + 1 for x in often)})
    at = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(_range_of(F.col(key), bounds))
    stats = {r["r"]: r for r in df.groupBy(at.alias("r")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    every = [stats.get(i) for i in range(len(bounds) + 2)]
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), at)
    high, span, cuts = pick([r["hi"] if r and r["hi"] is not None else 0 for r in every]), pick([r["hi"] - r["lo"] + 1 if r and r["hi"] is not None else 1 for r in every]), pick([math.ceil(r["n"] / most) if r else 1 for r in every])
    share = F.when(span > 1, (high - F.coalesce(F.col(key), F.lit(0)).cast("double")) / span).otherwise(F.col("__tie").cast("double") / float(1 << 64) + 0.5)
    number = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(len(bounds) - at)
    return number.cast("long") * F.lit(1 << 32) + F.least(F.floor(share * cuts), cuts - 1).cast("long")


def with_next(df: DataFrame, key: str, tie: Column, carry: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds `next` (struct of carry): those columns of the row that follows in descending order of the integer key; after
    the last comes the first.

    Rows are dealt into ranges of about equal size, each ordered by itself; the first row of every range is also sent to
    the range before it. Null keys come last; equal keys are ordered by tie, rows equal in both in any order. prepare may
    add columns to the dealt rows, so that they need no shuffle of their own.
    """
    rows = df.count()
    keyed = df.withColumn("__tie", tie)
    keyed = keyed.withColumn("__range", _placed(keyed, key, rows) if rows else F.lit(0).cast("long"))
    keyed = keyed.withColumn("__key", F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit((1 << 63) - 1)))
    # The first row of each range and the range before it that has rows, the first range wrapping to the last.
    heads = keyed.groupBy("__range").agg(F.min(F.struct("__key", "__tie")).alias("__head"))
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("__range").over(Window.orderBy("__range")), F.last("__range").over(whole))
    heads = heads.select(F.col("__head.__key").alias("__k"), F.col("__head.__tie").alias("__t"), before.alias("__before"))
    sent = keyed.join(F.broadcast(heads), (F.col("__key") == F.col("__k")) & (F.col("__tie") == F.col("__t"))).drop("__k", "__t", "__range").withColumnRenamed("__before", "__range")
    both = keyed.withColumn("__sent", F.lit(False)).unionByName(sent.withColumn("__sent", F.lit(True))).repartition("__range")
    window = Window.partitionBy("__range").orderBy("__sent", "__key", "__tie")
    out = (prepare(both) if prepare else both).withColumn("next", F.lead(F.struct(*carry)).over(window))
    return out.where(~F.col("__sent")).drop("__sent", "__range", "__key", "__tie")
