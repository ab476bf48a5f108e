"""Merkle manifest of a dataset: a tree of SHA-256 digests per source, and one over the sources.

Every row is a leaf, the leaves of a source ascend by ``doc_id``, and every ``FAN`` consecutive nodes
have one parent until one node (the subroot) is left; the subroots, in order of their source, make one more
tree whose last node is the root.  The digest of a node is the lowercase hexadecimal SHA-256 of its children's
digests in a row; a leaf's is that of its fields (``leaf_digest``).

Layout: a tree is cut into aligned blocks of ``HEIGHT`` levels over ``FAN ** HEIGHT`` leaves; the root of
a block is a leaf of the next tier, until one block holds a tree's root.  Inside a block the nodes
lie in van Emde Boas order: the subtree is split at half its height, first the upper half, then each lower one, each laid
out the same way, so that a path touches few places whatever the size of a cache line.  ``address`` computes where a
node is, in a block with any number of leaves (a ragged last run leaves no gaps); construction writes by it, and
the siblings of a proof are read by it.

Scale: leaves are numbered by one distributed sort, blocks are groups of at most ``FAN ** HEIGHT`` rows whatever the size
of a source, a tier has that many times fewer rows than the one below, and the siblings above a block are handed down
tier by tier, so no path is ever joined row by row.  Every tier is written to the shared folder.

Defined results: null fields are encoded as ``-``; a null ``doc_id`` comes before all others, a null source before all sources;
rows that repeat are leaves of their own, those with equal ``doc_id`` in order of their digests; an empty table
has no rows, no root and no blocks; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored

FAN = 16
HEIGHT = 2
#: Encoded in this order into a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

col = F.col


# --- layout ---------------------------------------------------------------------

def level_sizes(leaves: int, height: int) -> list[int]:
    """Nodes per level of a block, leaves first."""
    sizes = [leaves]
    for _ in range(height):
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def height_of(leaves: int, most: int = HEIGHT) -> int:
    """Levels above the leaves until one node is left, at most ``most`` (a block's)."""
    height = 0
    while leaves > 1 and height < most:
        leaves, height = -(-leaves // FAN), height + 1
    return height


def address(sizes: list[int], level: int, index):
    """Place of node ``index`` (a number or an array) of ``level`` in the van Emde Boas order of a block."""
    at = np.asarray(index, np.int64)
    place = np.zeros_like(at)
    root, first, levels = len(sizes) - 1, 0, len(sizes)       # the subtree: its root's level and index, its levels
    while levels > 1:
        upper = (levels + 1) // 2
        cut = root - upper                                    # level of the lower subtrees' roots
        if level > cut:
            levels = upper
            continue
        lower = at // FAN ** (cut - level)                    # which lower subtree
        for k in range(upper):                                # all of the upper half comes first
            place += np.minimum((first + 1) * FAN ** k, sizes[root - k]) - first * FAN ** k
        start = first * FAN ** upper
        for k in range(levels - upper):                       # and the lower subtrees to the left
            place += np.minimum(lower * FAN ** k, sizes[cut - k]) - start * FAN ** k
        root, first, levels = cut, lower, levels - upper
    return place


def lay_out(leaves: list[str], height: int) -> tuple[bytes, str]:
    """The nodes of a block in order, 32 bytes each, and the digest of its root."""
    sizes = level_sizes(len(leaves), height)
    nodes = np.empty((sum(sizes), 32), np.uint8)
    digests = leaves
    for level, size in enumerate(sizes):
        if level:
            digests = [hashlib.sha256("".join(digests[k:k + FAN]).encode()).hexdigest() for k in range(0, len(digests), FAN)]
        nodes[address(sizes, level, np.arange(size))] = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(size, 32)
    return nodes.tobytes(), digests[0]


def run_of(nodes: np.ndarray, sizes: list[int], level: int, parent: int) -> str:
    """The digests of a parent's children in a row, read from a block by address."""
    children = np.arange(parent * FAN, min((parent + 1) * FAN, sizes[level]))
    return nodes[address(sizes, level, children)].tobytes().hex()


def path_of(nodes: bytes, leaves: int, height: int, index: int) -> list[tuple[str, int]]:
    """``(children in a row, place among them)`` at every level from a leaf up to a block's root."""
    table, sizes, out = np.frombuffer(nodes, np.uint8).reshape(-1, 32), level_sizes(leaves, height), []
    for level in range(height):
        out.append((run_of(table, sizes, level, index // FAN), index % FAN))
        index //= FAN
    return out


def siblings(path: list[tuple[str, int]]) -> str:
    """The other digests of every run, level by level, left to right."""
    return "".join(run[:64 * place] + run[64 * place + 64:] for run, place in path)


def fold(digest: str, path: list[tuple[str, int]]) -> str:
    """The root that a leaf's digest and the siblings of its path give."""
    for run, place in path:
        digest = hashlib.sha256((run[:64 * place] + digest + run[64 * place + 64:]).encode()).hexdigest()
    return digest


def _pack(path: list[tuple[str, int]]) -> bytes:
    return b"".join(bytes([place]) + (len(run) // 64).to_bytes(1, "little") + bytes.fromhex(run) for run, place in path)


def _unpack(data: bytes) -> list[tuple[str, int]]:
    out, at = [], 0
    while at < len(data):
        size = 32 * data[at + 1]
        out.append((data[at + 2:at + 2 + size].hex(), data[at]))
        at += 2 + size
    return out


# --- leaves -----------------------------------------------------------------------

def leaf_digest(**replaced: Column) -> Column:
    """Digest of a row of documents, with some fields replaced."""
    parts = []
    for name in FIELDS:
        value = replaced.get(name, col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """``members``: ``tree, block, n`` (leaves of the tree) and ``rows``, the block's leaves in order; ``tiers``: per tier the blocks of the
    source trees (``tree, block, n, nodes, root``); ``top``: the same for the tree over the sources; ``root``: its last node, None of an empty table."""

    members: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def _numbered(df: DataFrame, order: list[Column], within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` sorted and written with its task and row number, and per task (and value of ``within``) what to add to a row
    number to get its position (in that value's rows).  Rows that compare equal are spread over tasks."""
    keys = ["__task"] + ([within] if within else [])
    rows = df.withColumn("__tie", F.monotonically_increasing_id()).orderBy(*order, "__tie").drop("__tie")
    rows = stored(rows.withColumn("__task", F.spark_partition_id())
                  .withColumn("__row", F.monotonically_increasing_id() - F.shiftleft(col("__task").cast("long"), 33)))
    counts = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first")))
    before = Window.orderBy("__task") if within is None else Window.partitionBy(within).orderBy("__task")
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)),
                                                     F.lit(0)) - col("__first"))
    return rows, starts


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks over ``tree, n, pos, digest``: those of trees of more than one block have ``HEIGHT`` levels, a tree's
    last block as many as it needs."""
    span = FAN ** HEIGHT
    grouped = nodes.groupBy("tree", F.expr(f"pos div {span}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct((col("pos") % span).cast("int").alias("place"),
                                                                      "digest"))).alias("rows"))
    return stored(grouped.select("tree", "block", "n", col("rows.digest").alias("digests"))
                  .mapInArrow(_lay_out_batches, "tree long, block long, n long, nodes binary, root string"))


def _lay_out_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        laid = [lay_out(digests.as_py(), height_of(n.as_py())) for n, digests in zip(batch.column("n"), batch.column("digests"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("block"), batch.column("n"), pa.array([nodes for nodes, _ in laid], pa.binary()),
             pa.array([root for _, root in laid], pa.string())], names=["tree", "block", "n", "nodes", "root"])


def _tiers(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Blocks over blocks until every tree is one block; ``largest`` is the size of the largest tree."""
    span, tiers = FAN ** HEIGHT, [_blocks(nodes)]
    while largest > span:
        largest = -(-largest // span)
        below = tiers[-1].where(col("n") > span)
        tiers.append(_blocks(below.select("tree", F.ceil(col("n") / span).alias("n"), col("block").alias("pos"),
                                          col("root").alias("digest"))))
    return tiers


def _roots(tiers: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree: the blocks that are alone in theirs."""
    out = None
    for tier in tiers:
        last = tier.where(col("n") <= FAN ** HEIGHT).select("tree", "root")
        out = last if out is None else out.unionByName(last)
    return out


def build(docs: DataFrame, claimed: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``claimed`` is the digest by which ``audit`` checks a row, such as ``leaf_digest`` of a changed row;
    null (and by default) its own."""
    span = FAN ** HEIGHT
    leaves = docs.select("doc_id", "source", leaf_digest().alias("leaf"),
                         F.unhex(F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    rows, starts = _numbered(leaves, [col("source").asc_nulls_first(), col("doc_id").asc_nulls_first(), col("leaf")], "source")
    sizes, first = _numbered(starts.groupBy("source").agg(F.sum("__n").alias("n")), [col("source").asc_nulls_first()])
    trees = stored(sizes.join(first.select("__task", "__start"), "__task")
                   .select("source", "n", (col("__row") + col("__start")).alias("tree")))
    of = starts.select(col("__task").alias("__t"), col("source").alias("__s"), "__start").join(
        trees, col("source").eqNullSafe(col("__s"))).drop("source")
    placed = rows.join(of, (col("__task") == col("__t")) & col("source").eqNullSafe(col("__s"))).select(
        "tree", "n", (col("__row") + col("__start")).alias("pos"), "doc_id", F.unhex("leaf").alias("leaf"), "claimed")
    members = stored(placed.groupBy("tree", F.expr(f"pos div {span}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct((col("pos") % span).cast("int").alias("place"), "doc_id", "leaf",
                                                                      "claimed"))).alias("rows")))
    largest, count = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    if not count:
        return Manifest(members, [], [], None)
    lowest = stored(members.select("tree", "block", "n", F.transform("rows", lambda r: F.lower(F.hex(r["leaf"]))).alias("digests"))
                    .mapInArrow(_lay_out_batches, "tree long, block long, n long, nodes binary, root string"))
    tiers = [lowest]
    if largest > span:
        upper = lowest.where(col("n") > span).select("tree", F.ceil(col("n") / span).alias("n"), col("block").alias("pos"),
                                                     col("root").alias("digest"))
        tiers += _tiers(upper, -(-largest // span))
    top = _tiers(_roots(tiers).select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), col("tree").alias("pos"),
                                      col("root").alias("digest")), count)
    return Manifest(members, tiers, top, _roots(top).first()["root"])


# --- proofs -----------------------------------------------------------------------

def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: a row is a whole block."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def _paths_of_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per leaf of a block (it stands for a block or tree below it) its packed path from there to the top."""
    for row in _rows(batches):
        first = row["block"] * FAN ** HEIGHT
        leaves, height = min(FAN ** HEIGHT, row["n"] - first), height_of(row["n"])
        paths = [_pack(path_of(row["nodes"], leaves, height, k)) + row["above"] for k in range(leaves)]
        yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * leaves, pa.int64()), pa.array(range(first, first + leaves), pa.int64()),
                                          pa.array(paths, pa.binary())], names=["tree", "block", "above"])


def _above(tiers: list[DataFrame], over: DataFrame | None) -> DataFrame:
    """The lowest tier's blocks, each with the packed path above its root: handed down from the tier over it, or, for a block
    that is a whole tree, from ``over`` (by ``pos``, the tree's place in the next tree)."""
    blocks = None
    for k in range(len(tiers) - 1, -1, -1):
        rows = tiers[k].select("tree", "block", "n", "nodes")
        alone = rows.where(col("n") <= FAN ** HEIGHT)
        if over is None:
            alone = alone.withColumn("above", F.lit(b""))
        else:
            alone = alone.join(over.select(col("pos").alias("tree"), "above"), "tree")
        if blocks is not None:
            handed = stored(blocks.mapInArrow(_paths_of_leaves, "tree long, block long, above binary"))
            alone = alone.unionByName(rows.where(col("n") > FAN ** HEIGHT).join(handed, ["tree", "block"]))
        blocks = alone
    return blocks


def audit(manifest: Manifest) -> DataFrame:
    """Per row of the manifest: ``doc_id, leaf, subroot, root, proof_sha256`` (digest of its siblings in a row, leaf to root),
    ``folded_root`` (what the claimed digest and the siblings give) and ``verified``."""
    schema = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    if manifest.root is None:
        return manifest.members.sparkSession.createDataFrame([], schema)
    over = stored(_above(manifest.top, None).mapInArrow(_paths_of_leaves, "tree long, block long, above binary"))
    blocks = _above(manifest.tiers, over.select(col("block").alias("pos"), "above"))
    root = manifest.root

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _check_block(row, root)

    return (manifest.members.select("tree", "block", "rows").join(blocks, ["tree", "block"])
            .select("rows", "n", "nodes", "above").mapInArrow(check, schema))


def _check_block(row: dict, root: str) -> pa.RecordBatch:
    rows, height, above = row["rows"], height_of(row["n"]), _unpack(row["above"])
    leaves, size = [r["leaf"].hex() for r in rows], len(rows)
    in_tree = height_of(row["n"], 64)                         # levels of the source's whole tree
    subroot = fold(leaves[0], (path_of(row["nodes"], size, height, 0) + above)[:in_tree])
    proofs, folded = [], []
    for k, leaf in enumerate(leaves):
        if k % FAN == 0 or not height:                        # the path above a leaf's run is one for the whole run
            whole = path_of(row["nodes"], size, height, k) + above
            first, rest = whole[:min(height, 1)], whole[min(height, 1):]
            upper = siblings(rest)
        own = [(run, k % FAN) for run, _ in first]
        proofs.append(hashlib.sha256((siblings(own) + upper).encode()).hexdigest())
        claimed = rows[k]["claimed"]
        folded.append(fold(leaf if claimed is None else claimed.hex(), own + rest))
    return pa.RecordBatch.from_arrays(
        [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(leaves), pa.array([subroot] * size), pa.array([root] * size),
         pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])],
        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``; every fifth row by the checksum of its id claims a text in lower case (A-Z only)."""
    docs = read_table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(col("doc_id").cast("string").cast("binary")) % 5 == 0
    return audit(build(docs, F.when(changed, leaf_digest(text=lowered))))
