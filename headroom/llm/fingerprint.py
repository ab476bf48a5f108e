"""Document fingerprints: one-permutation MinHash with optimal densification.

Word shingles are hashed once; the top bits of a hash name its bin, and each bin keeps its
minimum.  An empty bin takes the value of a filled one chosen by a hash of (empty bin, filled
bin), the same for every document, so fingerprints stay comparable however short the text.
The lowest ``BITS`` bits of each bin are stored; likeness corrects for chance agreement.

Only built-in expressions.  Fingerprints are computed inside the scan; the text that follows
in id order comes from a window inside ranges of ids, with one row per range carried over to
the range before.  Texts are shuffled once.  Ranges are cut in two levels, so their number
follows the rows; an id that repeats beyond a range is cut by a hash of its texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored, whole_text

SHINGLE = 5
BINS, BITS = 128, 8
#: Documents per range of ids; most parts of a level (its cuts are broadcast: 2 * PARTS squared longs, 4 MB);
#: parts of one repeated id.
RANGE_ROWS, PARTS, TIES = 1000, 512, 256


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BINS.bit_length() + 1).cast("int")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: an array of BINS small integers, empty for a text without words.

    Built in steps, so that each array is computed once and then read by the next one."""
    keep = [c for c in df.columns]
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    df = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("__w"))
    five = F.transform(F.sequence(F.lit(0), F.size("__w") - SHINGLE),
                       lambda i: F.xxhash64(*(F.get("__w", i + k) for k in range(SHINGLE))))
    shingles = (F.when(F.size("__w") >= SHINGLE, five).when(F.size("__w") > 0, F.array(F.xxhash64("__w")))
                .otherwise(F.expr("cast(array() as array<bigint>)")))
    df = df.select(*keep, F.sort_array(shingles).alias("__s"))
    least = F.filter("__s", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("__s", i - 1))))
    df = df.select(*keep, least.alias("__m"))
    df = df.select(*keep, "__m", F.transform("__m", lambda x: _bin(x)).alias("__b"))
    df = df.select(*keep, "__m", "__b", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)),
                                                    lambda j: F.array_position("__b", j).cast("int")).alias("__at"))

    def donor(j: Column) -> Column:
        ranked = F.transform("__b", lambda b, k: F.struct(F.xxhash64(j, b).alias("h"), (k + 1).alias("k")))
        return F.array_min(ranked)["k"]

    filled = F.transform("__at", lambda at, j: F.element_at("__m", F.when(at > 0, at).otherwise(donor(j))))
    low = F.transform(filled, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint"))
    return df.select(*keep, F.when(F.size("__m") > 0, low).otherwise(F.expr("cast(array() as array<smallint>)")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1; two empty ones are alike, one is not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    value = F.greatest((same - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def packed(fingerprint: Column) -> Column:
    """Hexadecimal text of a fingerprint, two digits a bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")), "")


def _parted(grouped, key: str, parts: int) -> DataFrame:
    """``cuts``: ascending cuts of ``key`` into about equal parts; a value that fills a part has one to itself."""
    if parts < 2:
        return grouped.agg(F.expr("cast(array() as array<bigint>)").alias("cuts"))
    found = grouped.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000).alias("at"))
    full = F.filter("at", lambda x, i: (i > 0) & (x == F.get("at", i - 1)))
    cuts = F.concat("at", F.filter(F.transform(full, lambda x: F.try_add(x, F.lit(1).cast("long"))), lambda x: x.isNotNull()))
    return found.withColumn("cuts", F.array_sort(F.array_distinct(F.coalesce(cuts, F.expr("cast(array() as array<bigint>)"))))).drop("at")


def _part(cuts: Column, key: str) -> Column:
    """Number of cuts at or below the key; 0 for a null key."""
    return F.size(F.filter(cuts, lambda c: c <= F.col(key)))


def _ranged(df: DataFrame, key: str, content: str) -> DataFrame:
    """Adds ``__tie``, a hash of the content, and ``__range``, whose order follows that of (key, ``__tie``), nulls first."""
    each = df.select(key)
    parts = min(PARTS, math.ceil(math.sqrt(max(1, each.count() / RANGE_ROWS))))
    cuts = _parted(each.groupBy(), key, parts).first()["cuts"] or [0]  # one cut at least, or the ranges are a constant
    first = F.array(*(F.lit(c).cast("long") for c in cuts))
    low = each.where(F.col(key).isNotNull()).withColumn("__one", _part(first, key))
    second = _parted(low.groupBy("__one"), key, parts).withColumnRenamed("cuts", "__cuts")
    df = df.withColumns({"__tie": F.xxhash64(content), "__one": _part(first, key)}).join(F.broadcast(second), "__one", "left")
    # A part of one value alone (or of nulls) is cut by the tie, whose order it has.
    both = F.array_sort(F.concat(first, F.coalesce("__cuts", F.expr("cast(array() as array<bigint>)"))))
    alone = F.array_contains(both, F.col(key)) & F.array_contains(both, F.try_add(F.col(key), F.lit(1).cast("long")))
    tie = F.floor(F.col("__tie") / F.lit(float(2**64 // TIES))).cast("long") + TIES // 2
    tie = F.when(F.coalesce(alone, F.col(key).isNull()), tie).otherwise(F.lit(0))
    part = F.when(F.col(key).isNull(), 0).otherwise((F.col("__one") + 1) * (4 * PARTS) + F.coalesce(_part(F.col("__cuts"), key), F.lit(0)))
    return df.withColumn("__range", part.cast("long") * (2 * TIES) + tie).drop("__one", "__cuts")


def with_next(df: DataFrame, key: str, derive) -> DataFrame:
    """Adds ``next_text`` and ``next_fp``: those of the next row in ascending ``key`` (the first row's after the last).

    ``derive`` adds ``fp`` to rows with a ``text``.  Nulls come first, and rows of one key by
    their text.  Ranges of keys are sorted apart; the first row of the next filled range
    serves the last row of each, so only those are fingerprinted twice."""
    ranged = _ranged(df, key, "text")
    order = [F.col(key).asc_nulls_first(), F.col("__tie")]
    first = ranged.groupBy("__range").agg(
        F.min_by("text", F.struct(F.col(key).isNotNull(), F.col(key), F.col("__tie"))).alias("text"))
    first = stored(derive(first))
    ids = Window.orderBy("__range")  # one id per range, without texts
    everything = ids.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = first.select("__range", F.coalesce(F.lead("__range").over(ids), F.min("__range").over(everything)).alias("__to"))
    carried = ring.join(first.select(F.col("__range").alias("__to"), F.col("text").alias("__text"), F.col("fp").alias("__fp")), "__to").drop("__to")
    within = Window.partitionBy("__range").orderBy(*order)
    led = derive(ranged)
    led = led.select("*", F.lead("text").over(within).alias("next_text"), F.lead("fp").over(within).alias("next_fp"))
    out = led.join(carried, "__range")
    last = F.col("next_text").isNull()  # texts are never null here
    return out.select(*df.columns, "fp", F.when(last, F.col("__text")).otherwise(F.col("next_text")).alias("next_text"),
                      F.when(last, F.col("__fp")).otherwise(F.col("next_fp")).alias("next_fp"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Null text is empty.  An empty text has an empty fingerprint.  A single document is its own
    next one.  Null ids come first and repeated ids in order of a hash of their texts; other
    columns are ignored; an empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ring = with_next(texts, "doc_id", lambda df: with_fingerprint(df, "text", "fp")).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(floor(n_chars / 4) as int))"),
                      F.when(cut > 0, F.expr("substring(next_text, 1, cast(floor(n_chars / 4) as int))")).otherwise(""))
    ring = with_fingerprint(ring.withColumn("edited", edited).drop("text", "next_text"), "edited", "edited_fp")
    return ring.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       packed(F.col("fp")).alias("fingerprint"), packed(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
