"""Merkle manifest against a plain Python tree, and the layout's address arithmetic."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, leaf int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def path(tree, k):
    out = []
    for level in tree[:-1]:
        low = k // 16 * 16
        out.append((level[low:low + 16], k % 16))
        k //= 16
    return out


def brute(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: [] for s in sources}
    for r in rows:
        trees[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    trees = {s: sorted(t, key=lambda x: x[:3]) for s, t in trees.items()}
    built = {s: levels([x[2] for x in t]) for s, t in trees.items()}
    top = levels([built[s][-1][0] for s in sources])
    out = []
    for s in sources:
        for k, (_, _, own, r) in enumerate(trees[s]):
            steps = path(built[s], k) + path(top, sources.index(s))
            digest = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                digest = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            for run, place in steps:
                digest = h("".join(run[:place]) + digest + "".join(run[place + 1:]))
            proof = h("".join(d for run, place in steps for i, d in enumerate(run) if i != place))
            root = top[-1][0]
            out.append((r["doc_id"], own, built[s][-1][0], root, proof, digest, digest == root))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, 2) for r in rows], DOCS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return [tuple(r) for r in merkle.audit(merkle.build(df, F.when(changed, merkle.leaf_digest(text=lowered)))).collect()]


def row(doc_id, text="Text", lang="en", source="s", n_chars=4):
    return dict(doc_id=doc_id, text=text, lang=lang, source=source, n_chars=n_chars)


def key(t):
    return tuple((x is not None, x) for x in t)


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 256, 257, 300, 4096, 4097])
@pytest.mark.parametrize("height", [1, 2, 3, 4])
def test_addresses_are_a_permutation_without_gaps(leaves, height):
    if leaves > 16 ** height:
        return                                                               # more than one block
    sizes = merkle.level_sizes(leaves, height)
    places = np.concatenate([merkle.address(sizes, k, np.arange(size)) for k, size in enumerate(sizes)])
    assert sorted(places) == list(range(sum(sizes)))


def test_layout_splits_at_half_height():
    """A full block of four levels: the upper two first, then each lower pair in one piece."""
    sizes = merkle.level_sizes(16 ** 3, 3)
    assert merkle.address(sizes, 3, 0) == 0 and sorted(merkle.address(sizes, 2, np.arange(16))) == list(range(1, 17))
    for lower in range(256):
        start = 17 + 17 * lower
        assert merkle.address(sizes, 1, lower) == start
        assert list(merkle.address(sizes, 0, 16 * lower + np.arange(16))) == list(range(start + 1, start + 17))


def test_paths_read_from_a_block():
    digests = [h(str(k)) for k in range(1000)]
    nodes, root = merkle.lay_out(digests, 3)
    assert root == levels(digests)[3][0]
    for k in (0, 15, 16, 999):
        steps = merkle.path_of(nodes, 1000, 3, k)
        assert steps == [("".join(run), place) for run, place in path(levels(digests), k)]
        assert merkle.fold(digests[k], steps) == root and merkle.fold(h("other"), steps) != root


def test_manifest_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [row(rnd.randrange(10 ** 6), rnd.choice(["Ab", "ab", "", None, "ÄÖ x"]), rnd.choice(["en", None]),
                rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice([None, 3])) for _ in range(900)]
    rows += [row(k, source=f"one{k:03d}") for k in range(300)]               # more sources than a block has leaves
    rows += [row(7, source="a"), row(7, source="a"), row(7, "other", source="a"), row(None, source="a"), row(None, None, None, None, None)]
    rows += [row(5, "Long " * 300_000, source="é"), row(6, "", source="")]
    got = run(spark, rows)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {r[6] for r in got} == {True, False}


def test_three_tiers(spark):
    """A source of more leaves than two tiers of blocks hold."""
    rows = [row(k, f"T{k}", source="s" if k % 40 else "t") for k in range(68_000)]
    df = spark.range(68_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 40 == 0, "t").otherwise("s").alias("source"), F.lit(4).alias("n_chars"))
    built = merkle.build(df.repartition(7))
    assert len(built.tiers) == 3 and len(built.top) == 1
    want = [(r[0], *r[1:5], r[3], True) for r in brute(rows)]
    assert sorted(tuple(r) for r in merkle.audit(built).collect()) == sorted(want)


def test_one_row_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [row(3)]) == brute([row(3)])
    lone = brute([row(3)])[0]
    assert lone[1] == lone[2] == lone[3] and lone[4] == h("")
