"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full sets.

Every document's set of word shingles is hashed into sorted signature orders; their number and
depth follow from the least similarity of a link and a bound on missed pairs (``forest``).  Documents that share a prefix in an order stand next to each
other; a region is read at the shortest depth at which it is small, and at the full depth
where it stays dense, so two documents that agree to the full depth in any order always
meet.  Inside a region signature likeness proposes links; an exact intersection of the full
sets confirms each link that is used.

Scale.  Equal sets collapse to one class first (a hash aggregation), so a hot text is one
row.  Regions are counted by partial aggregation; only members of regions of two or more go
on, carrying an 8-bit signature and no text; regions over ``BLOCK`` members are split into
pairs of blocks, so no task holds a whole hot region.  Only connectivity is asked for: a
first round confirms a spanning forest of proposals; a second one compares exactly, inside its
region, every remaining proposal between different groups.  Texts move once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, runs, stored, whole_text
from .graph import components

SHINGLE = 3
#: Least similarity of a link, as numerator and denominator.
SHARE = (85, 100)
#: Bound on the probability that two documents at the least similarity meet in no order.
MISS = 5e-4
#: An order is as deep as such a pair still agrees in it with this probability.
AGREE = 0.25
#: A region of at most this many members is not read any deeper.
REGION = 32
#: Members of one block of a dense region.
BLOCK = 256
#: Standard deviations by which a signature may understate a link in the second round.
SLACK = 3.5
CACHE_WORDS = 400_000

_WORDS: dict[bytes, int] = {}
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Forest(NamedTuple):
    trees: int
    #: Prefix lengths at which regions may be read.
    depths: tuple[int, ...]

    @property
    def hashes(self) -> int:
        return self.trees * self.depths[-1]


def forest(share: tuple[int, int]) -> Forest:
    """Orders for links of at least ``share``: 24 of 8 hashes at 0.85, 25 of 6 at 0.80."""
    part = min(share[0] / share[1], 0.99)
    depth = max(1, math.floor(math.log(AGREE) / math.log(part)))
    trees = math.ceil(math.log(MISS) / math.log1p(-part ** depth))
    return Forest(trees, tuple(sorted({math.ceil(depth / 2), math.ceil(depth * 3 / 4), depth})))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased, words split at ASCII
    white space); a text of fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly A-Z, exactly \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    hashes = []
    for w in words:
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    if len(h) < size:
        return np.array([int.from_bytes(hashlib.blake2b(b"\0".join([b"short", *words]), digest_size=8).digest(), "little")], np.uint64)
    out = h[:len(h) - size + 1]
    for k in range(1, size):
        out = _mix(out * _MULT + h[k:len(h) - size + 1 + k])
    return np.unique(out)


def _factors(hashes: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One 32-bit minimum per hash function (multiply-shift of mixed shingle hashes)."""
    low = np.full(len(factors), np.uint64(2**64 - 1))
    for k in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[None, k:k + 4096] * factors[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


_SIGNED = "doc_id long, n_shingles long, class binary, sig binary, prefixes array<binary>"


def _sign(size: int, shape: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(shape.hashes)
        for batch in batches:
            sizes, classes, sigs, prefixes = [], [], [], []
            for low in range(0, len(batch), 256):
                for text in batch.column(1).slice(low, 256).to_pylist():
                    s = shingle_set(text, size)
                    sizes.append(len(s))
                    if not len(s):
                        classes.append(None), sigs.append(None), prefixes.append([])
                        continue
                    classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig = signature(s, factors)
                    sigs.append(sig.astype(np.uint8).tobytes())
                    short = (sig >> np.uint32(8)).astype("<u2").reshape(shape.trees, -1)
                    prefixes.append([row.tobytes() for row in short])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.binary()))], ["doc_id", "n_shingles", "class", "sig", "prefixes"])
        _WORDS.clear()

    return run


def _regions(orders: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """``(region, class, size)``: members of every region of two or more, read at its own depth."""
    found, rest = None, orders
    for depth in depths:
        # A hash names the region: two that collide are read as one, which only adds proposals.
        keyed = rest.withColumn("region", F.xxhash64("tree", F.substring("prefix", 1, 2 * depth)))
        sizes = keyed.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
        keyed = stored(keyed.join(sizes, "region"))
        here = keyed if depth == depths[-1] else keyed.where(F.col("size") <= REGION)
        here = here.select("region", "class", "size")
        found = here if found is None else found.unionByName(here)
        rest = keyed.where(F.col("size") > REGION).select("tree", "prefix", "class")
    return found


def _blocks(members: DataFrame) -> DataFrame:
    """Adds ``i``, ``j`` (the pair of blocks a row is sent to) and ``side`` (1: first block, 2: second, 3: both)."""
    wide = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), wide).cast("int")
    return (members.withColumns({"wide": wide, "own": own})
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
            .select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
            .drop("wide", "own", "other"))


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from 8-bit minima, corrected for chance agreement."""
    same = np.empty((len(a), len(b)), np.float32)
    for k in range(len(a)):
        same[k] = np.count_nonzero(a[k] == b, axis=1) / a.shape[1]
    return (same - 1 / 256) / (1 - 1 / 256)


def _forest(x: np.ndarray, y: np.ndarray, like: np.ndarray) -> list[int]:
    """Numbers of the edges of a spanning forest, most alike first."""
    parent: dict[int, int] = {}

    def top(k: int) -> int:
        while parent.get(k, k) != k:
            parent[k] = k = parent.get(parent[k], parent[k])
        return k

    kept = []
    for e in np.argsort(-like, kind="stable").tolist():
        p, q = top(int(x[e])), top(int(y[e]))
        if p != q:
            parent[p] = q
            kept.append(e)
    return kept


def _allowed(group: pa.RecordBatch, low: float, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all pairs of a run, and which pairs of its two blocks may link at an estimate of ``low``."""
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(group), -1)
    side, n = (group.column(c).to_numpy() for c in ("side", "n_shingles"))
    like = _likeness(sigs, sigs)
    good = (like >= low) & (np.minimum(n[:, None], n) * share[1] >= share[0] * np.maximum(n[:, None], n))
    return like, good & ((side[:, None] == 3) | (side[:, None] != side))


def _pairs(left: list, right: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _forests(share: tuple[int, int]):
    """A spanning forest of each run's likely links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("region", "i", "j")):
            like, good = _allowed(group, share[0] / share[1], share)
            x, y = np.nonzero(np.triu(good, 1))
            if len(x):
                names, kept = group.column("class").to_pylist(), _forest(x, y, like[x, y])
                ends = [(names[x[e]], names[y[e]]) for e in kept]
                yield _pairs([min(e) for e in ends], [max(e) for e in ends])

    return run


def _undecided(low: float, share: tuple[int, int]):
    """Members of a run with a possible link to another group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("region", "i", "j")):
            number = pd.factorize(pd.Series(group.column("component").to_pylist()))[0]
            if number.max() == 0:
                continue
            _, good = _allowed(group, low, share)
            marked = (good & (number[:, None] != number)).any(1)
            yield group.select(["region", "i", "j", "side", "class", "component"]).filter(pa.array(marked))

    return run


def _exact_links(share: tuple[int, int]):
    """Links between different groups of a run, by exact intersection of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("region", "i", "j")):
            number = pd.factorize(pd.Series(group.column("component").to_pylist()))[0]
            sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
            side, size = group.column("side").to_numpy(), np.array([len(s) for s in sets])
            whole, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            mark, names = np.zeros(len(whole), np.int64), group.column("class").to_pylist()
            largest = np.bincount(number).argmax()
            left, right = [], []
            for x in np.flatnonzero(number != largest).tolist():
                own = inverse[starts[x]:starts[x] + size[x]]
                mark[own] = 1
                inter = np.add.reduceat(mark[inverse], starts)
                mark[own] = 0
                linked = (share[1] * inter >= share[0] * (size + size[x] - inter)) & (number != number[x])
                linked &= (side == 3) | (side != side[x])
                # One link to each other group joins it; more would say the same.
                _, first = np.unique(number[linked], return_index=True)
                for y in np.flatnonzero(linked)[first].tolist():
                    left.append(min(names[x], names[y]))
                    right.append(max(names[x], names[y]))
            if left:
                yield _pairs(left, right)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                sets = [shingle_set(t, size).tobytes() for t in batch.column(0).slice(low, 256).to_pylist()]
                names = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["class", "set"])
        _WORDS.clear()

    return run


def _confirm(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, good = batch.column(2), batch.column(3), []
            for k in range(len(batch)):
                p, q = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (a, b))
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                good.append(share[1] * inter >= share[0] * (len(both) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    both = (pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb"))
    return both.mapInArrow(_confirm(share), "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents link if 100 * |A & B| >= 85 * |A | B| (or another ``share``) over their sets of ``size``-word
    shingles; ``component_id`` is the smallest doc_id reachable.  A null or empty text, or
    one of white space, has an empty set and links with nothing.  Texts of equal sets are
    one class.  Rows that repeat a doc_id each count with their own text; a null doc_id
    takes part in links, and its ``component_id`` is the smallest id of its group, or null.
    Other columns are ignored; an empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    shape = forest(share)
    signed = stored(texts.mapInArrow(_sign(size, shape), _SIGNED))
    # One row per distinct set: its first row carries the signature.
    classes = stored(signed.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"),
        F.first("sig").alias("sig"), F.first("prefixes").alias("prefixes")))
    orders = classes.select("class", F.posexplode("prefixes").alias("tree", "prefix"))
    members = (_blocks(_regions(orders, shape.depths)).join(classes.select("class", "n_shingles", "sig"), "class"))
    members = stored(members.select("region", "i", "j", "side", "class", "n_shingles", "sig"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")

    pair, part = "a binary, b binary", share[0] / share[1]
    first = stored(dealt(members).mapInArrow(_forests(share), pair).distinct())
    least = part - SLACK * (part * (1 - part) / shape.hashes) ** 0.5
    # Full sets of the classes that stand in a region, from one text each (found by its row's id).
    carriers = classes.join(members.select("class").distinct(), "class", "left_semi").select(F.col("least").alias("id"))
    found = texts.join(carriers, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = stored(found.mapInArrow(_sets(size), "class binary, set binary").dropDuplicates(["class"]))
    linked = stored(_confirmed(first, sets, share))
    groups = stored(components(linked, "a", "b"))
    grouped = members.join(groups.withColumnRenamed("node", "class"), "class", "left").select(
        "region", "i", "j", "side", "class", "n_shingles", "sig", F.coalesce("component", "class").alias("component"))
    schema = "region long, i int, j int, side int, class binary, component binary"
    second = dealt(grouped).mapInArrow(_undecided(least, share), schema).join(sets, "class")
    linked = linked.unionByName(stored(dealt(second).mapInArrow(_exact_links(share), pair)))
    groups = components(linked, "a", "b").withColumnRenamed("node", "class")
    joined = classes.select("class", "least").join(groups, "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = joined.join(smallest, "component").select("class", "component_id")
    out = signed.select("doc_id", "n_shingles", "class").join(by_class, "class", "left")
    alone = F.col("class").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
                      ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
