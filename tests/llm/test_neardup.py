"""Orders of the LSH forest: the stated bound on missed pairs, and links at the pipeline's threshold."""

import random

import numpy as np
import pytest

from headroom.llm import neardup, pipeline
from llm_frames import docs_of


def test_orders_follow_from_the_threshold():
    assert neardup.forest(neardup.SHARE) == neardup.Forest(24, (4, 6, 8))
    for share in ((50, 100), (80, 100), (85, 100), (95, 100), (1, 1)):
        shape = neardup.forest(share)
        part = min(share[0] / share[1], 0.99)
        assert (1 - part ** shape.depths[-1]) ** shape.trees <= neardup.MISS
        assert sorted(set(shape.depths)) == list(shape.depths)


def sets_at(rng, share, n):
    """Two sets of ``n`` hashes in all, ``share`` of them common."""
    whole = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
    common = round(n * share)
    half = common + (n - common) // 2
    return whole[:half], np.concatenate([whole[:common], whole[half:]])


@pytest.mark.parametrize("share", [(85, 100), (80, 100)])
def test_pairs_at_the_threshold_meet_in_an_order(share):
    rng, shape, missed = random.Random(5), neardup.forest(share), 0
    factors = neardup._factors(shape.hashes)
    for _ in range(2000):
        a, b = (neardup.signature(s, factors).reshape(shape.trees, -1) for s in sets_at(rng, share[0] / share[1], 200))
        missed += not (a == b).all(1).any()
    assert missed <= 6  # 1 is expected at the bound


def test_links_at_the_pipeline_threshold(spark):
    """Edited copies around 0.8 of five-word shingles, among a crowd of like texts, against brute force."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=120)
        texts.append(" ".join(base))
        for edits in (1, 2, 3):
            copy = list(base)
            for at in rng.sample(range(120), edits):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", "few words", texts[0]]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    low = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        before = list(low)
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, texts), pipeline.SHINGLE, pipeline.SHARE).collect()}
    assert (pipeline.SHINGLE, pipeline.SHARE) == (5, (80, 100)) and [got[k] for k in range(len(texts))] == low
