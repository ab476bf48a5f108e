"""Near-duplicate embeddings by randomised-rotation binary codes.

Every vector is turned by ``ROTATIONS`` random orthogonal matrices; the signs of the turned
coordinates are its binary code, and the inner product of the code's unit vector with the
turned vector is stored beside it.  That product corrects the code: <code, y> / <code, x>
is an unbiased estimate of <x, y> over the random rotation, with an error bound from the
same product.  Bands of code bits bring vectors together, so many that a pair at the
threshold misses all of them with probability ``MISS`` at most; inside a band's bucket the
estimate's upper bound decides which vectors need an exact comparison, and only those are
compared by exact double-precision cosine.

Scale.  Equal vectors collapse to one row with a weight before anything else.  Buckets are
counted by partial aggregation and only those of two or more go on; a bucket over ``BLOCK``
members is split into pairs of blocks.  A pair is counted in the first band it shares, so
links are summed as partial counts per vector, never emitted as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, runs, stored
from .graph import components

THRESHOLD = 0.95
#: Code bits come from this many rotations of at least MIN_DIM coordinates.
MIN_DIM = 64
BAND_BITS = 20
#: Probability at most with which a pair at exactly the threshold meets in no band; decides their number.
MISS = 1e-4
#: Width of the estimate's confidence bound, in standard errors.
WIDTH = 4.0
BLOCK = 512


def band_count(threshold: float) -> int:
    """Bands so that a pair at ``threshold`` shares none with probability MISS at most: a sign of both
    agrees with probability 1 - angle / pi."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return 1 if agree == 1 else math.ceil(math.log(MISS) / math.log1p(-agree**BAND_BITS))


def _rotations(dim: int, bands: int) -> np.ndarray:
    """Stacked random orthogonal matrices, at least a row for each bit of the bands; the seed is the dimension."""
    rng, rows = np.random.default_rng(1000 + dim), []
    padded = max(dim, MIN_DIM)
    while sum(map(len, rows)) < bands * BAND_BITS:
        rows.append(np.linalg.qr(rng.standard_normal((padded, padded)))[0])
    return np.concatenate(rows)[:, :dim]


_TURNS: dict[tuple[int, int], np.ndarray] = {}


def _turn(dim: int, bands: int) -> np.ndarray:
    if (dim, bands) not in _TURNS:
        _TURNS[dim, bands] = _rotations(dim, bands)
    return _TURNS[dim, bands]


def _unit(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / big  # squares of large components stay finite
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _code(count: int):
    """class, dim, code bits, the code's product with its own vector, an 8-bit copy, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for dim in sorted({len(r) for r in rows}):
                at = [k for k, r in enumerate(rows) if len(r) == dim]
                for low in range(0, len(at), 1024):
                    part = at[low:low + 1024]
                    unit = _unit(np.array([rows[k] for k in part], np.float64))
                    turned = unit @ _turn(dim, count).T
                    bits = turned > 0
                    own = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
                    coarse = np.rint(unit * 127).astype(np.int8)
                    bands = bits[:, :count * BAND_BITS].reshape(len(part), count, BAND_BITS)
                    keys = bands @ (1 << np.arange(BAND_BITS)) + (np.arange(count) << BAND_BITS)
                    keys = keys * 65_536 + dim % 65_536
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(part)), pa.array(np.full(len(part), dim, np.int32)),
                         pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary()), pa.array(own),
                         pa.array([c.tobytes() for c in coarse], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                        ["class", "dim", "code", "own", "coarse", "keys"])

    return run


_CODED = "class long, dim int, code binary, own double, coarse binary, keys array<long>"


def _blocks(members: DataFrame) -> DataFrame:
    """Adds ``i``, ``j`` (the pair of blocks a row is sent to) and ``side`` (1: first block, 2: second, 3: both)."""
    wide = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), wide).cast("int")
    return (members.withColumns({"wide": wide, "own_block": own})
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
            .select("key", "class", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"),
                    F.when(F.col("own_block") == F.col("other"), 3).when(F.col("own_block") < F.col("other"), 1)
                    .otherwise(2).alias("side")))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _sides(group: pa.RecordBatch) -> np.ndarray:
    side = group.column("side").to_numpy()
    return ((side[:, None] == 3) | (side[:, None] != side)) & ~np.eye(len(side), dtype=bool)


def _suspects(threshold: float, count: int):
    """Members of a bucket with a partner whose estimated cosine may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("key", "i", "j")):
            dim = group.column("dim")[0].as_py()
            turns = _turn(dim, count)
            bits = np.unpackbits(_matrix(group.column("code"), np.uint8), axis=1)[:, :len(turns)]
            codes = (bits * 2.0 - 1.0) / np.sqrt(len(turns))
            coarse = _matrix(group.column("coarse"), np.int8) / 127.0
            coarse = coarse / np.maximum(np.sqrt((coarse * coarse).sum(1, keepdims=True)), 1e-9)
            own = group.column("own").to_numpy()[:, None]
            estimate = codes @ (coarse @ turns.T).T / own
            # held: <code, x> for a unit x; its square is the part of x that the code holds.
            held = np.minimum(own / np.sqrt(len(turns) / max(dim, MIN_DIM)), 1.0)
            error = WIDTH * np.sqrt(np.maximum(1 - held**2, 0) / held**2 / len(turns)) + 0.02
            near = (estimate + error >= threshold) | (estimate + error >= threshold).T
            marked = pa.array((near & _sides(group)).any(1))
            yield group.select(["key", "i", "j", "side", "class", "code"]).filter(marked)

    return run


def _exact(threshold: float, count: int):
    """Exact links of a bucket: partial link counts (in the pair's first shared band) and a star per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("key", "i", "j")):
            unit = _unit(np.array(group.column("vector").to_pylist(), np.float64))
            linked = (unit @ unit.T >= threshold) & _sides(group)
            x, y = np.nonzero(linked)
            if not len(x):
                continue
            bits = np.unpackbits(_matrix(group.column("code"), np.uint8), axis=1)[:, :count * BAND_BITS]
            bands = bits.reshape(len(bits), count, BAND_BITS) @ (1 << np.arange(BAND_BITS))
            band = (group.column("key")[0].as_py() // 65_536) >> BAND_BITS
            first = np.empty(len(x), np.int64)
            for k in range(0, len(x), 65_536):
                first[k:k + 65_536] = (bands[x[k:k + 65_536]] == bands[y[k:k + 65_536]]).argmax(1)
            weight = group.column("weight").to_numpy()
            counts = np.bincount(x[first == band], weight[y[first == band]], minlength=len(bits)).astype(np.int64)
            label = np.arange(len(bits))
            while True:  # smallest row reachable inside the group
                low = np.where(linked, label, len(bits)).min(1)
                new = np.minimum(label, low)
                if (new == label).all():
                    break
                label = new
            names = group.column("class").to_numpy()
            touched = np.flatnonzero(linked.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(names[touched]), pa.array(names[label[touched]]), pa.array(counts[touched])],
                                             ["class", "star", "links"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows link at a cosine of ``threshold`` or more in double precision.  A vector that is
    null, empty, zero, or holds null or non-finite components links with nothing; vectors of
    different lengths do not link.  Equal vectors link with each other and share their links.
    A null ``vec_id`` takes part like any other; ``component_id`` is the smallest id reachable,
    or null if no id is known.  Repeated ids count as rows of their own.  Other columns are
    ignored; an empty table gives no rows."""
    array = F.col("embedding").cast("array<double>")
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), array.alias("vector"))
    # Equal vectors are told by 128 bits: two hashes, one of them from the last component on.
    plain = F.when(F.coalesce(good, F.lit(False)), F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    rows = rows.withColumn("plain", plain)
    rows = stored(rows.select("vec_id", "vector", F.when(F.col("plain").isNotNull(), F.xxhash64("plain")).alias("h"),
                              F.when(F.col("plain").isNotNull(), F.xxhash64(F.lit(1), F.reverse("plain"))).alias("g")))
    classes = stored(rows.where("h is not null").groupBy("h", "g").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")
    ).withColumn("class", F.monotonically_increasing_id()))
    count = band_count(threshold)
    coded = stored(classes.select("class", "vector").mapInArrow(_code(count), _CODED))
    keyed = coded.select("class", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = _blocks(keyed.join(sizes, "key")).join(coded.drop("keys"), "class")
    dealt = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    schema = "key long, i int, j int, side int, class long, code binary"
    suspects = dealt.mapInArrow(_suspects(threshold, count), schema)
    exact = suspects.join(classes.select("class", "weight", "vector"), "class")
    dealt = exact.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = stored(dealt.mapInArrow(_exact(threshold, count), "class long, star long, links long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found, "class", "star").withColumnRenamed("node", "class")
    joined = classes.select("class", "h", "g", "weight", "least").join(groups, "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = (joined.join(smallest, "component").join(links, "class", "left")
                .select("h", "g", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n")))
    out = rows.select("vec_id", "h", "g").join(by_class, ["h", "g"], "left")
    alone = F.col("h").isNull()
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
                      ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
