"""Spelling variants against all pairs on small vocabularies."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from headroom.llm import spelling
from llm_frames import docs_of


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(count):
    out = {}
    words = sorted(count)
    for w in words:
        friends = [v for v in words if near(w, v)]
        best = max(friends, key=lambda v: (count[v], [-ord(c) for c in v] + [1]), default=None)
        top = [v for v in friends if count[v] == count[best]] if friends else []
        best = min(top) if top else None
        form = best if best is not None and count[best] >= 2 * count[w] else None
        out[w] = [form, None, count[w], len(friends), count[form] if form else None]
    for w in words:
        r = w
        while out[r][0]:
            r = out[r][0]
        out[w][1] = r
    return {w: tuple(v) for w, v in out.items()}


def run(spark, count):
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}


def test_variants_against_all_pairs(spark):
    rnd = random.Random(3)
    words = set()
    for letters, size, n in (("ab", 9, 150), ("abcé", 7, 150), ("aÿ", 6, 40), ("abcdefghij", 5, 100)):
        words |= {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, size))) for _ in range(n)}
    words |= {"aaaaaa", "aaaaa", "aaaa", "abababab", "babababa", "hello", "hallo", "hell", "helloo", "xhello"}
    count = {w: rnd.choice([3, 3, 4, 8, 16, 50]) for w in words}
    assert run(spark, count) == brute(count)


def test_words_at_and_over_the_longest(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 9)
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abc") for _ in range(size)) for size in (7, 8, 9, 10, 11, 30, 100)]
    words = set(base) | {"a" * k for k in (7, 8, 9, 10, 11, 50, 51, 52)} | {"ab" * 20, "ba" * 20, "ab" * 20 + "a"}
    for w in base:
        for _ in range(4):
            p = rnd.randrange(len(w))
            words |= {w[:p] + w[p + 1:], w[:p] + "z" + w[p:], w[:p] + "y" + w[p + 1:], w + "q", "q" + w, w[1:], w[:-1]}
    count = {w: 3 + k % 7 for k, w in enumerate(sorted(words))}
    assert run(spark, count) == brute(count)


def test_endless_runs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 9)
    long = "ab" * 15_000
    count = {long: 9, long[:-1]: 3, long[:10_000] + "x" + long[10_001:]: 4, "a" * 20_000: 3, "a" * 20_001: 8}
    got = run(spark, count)
    assert {w[:3] + str(len(w)): v[2:] for w, v in got.items()} == {w[:3] + str(len(w)): v[2:] for w, v in brute(count).items()}


def test_words_of_documents(spark):
    texts = ["Hello hello HELLO ÀÉ ÀÉabc×÷ wörld wörld wörld x_yy12abcde", None, "", "hello wörld", "zzzzz " * 2000, "abcde-abcde-abcde", "abcde"] * 3
    ids = list(range(len(texts) - 2)) + [None, 7]
    want = Counter()
    for i, t in zip(ids, texts):
        for run_ in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run_)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            want[w] += 1
    got = {r["word"]: r["n"] for r in spelling.words_of(docs_of(spark, texts, ids).withColumn("word", F.lit("x"))).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_no_words(spark):
    assert spelling.variants(spelling.words_of(docs_of(spark, [None, "", "a b"]))).collect() == []
    assert spelling.variants(spelling.words_of(docs_of(spark, []))).collect() == []
