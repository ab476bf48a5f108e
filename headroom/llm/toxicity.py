"""Toxicity scores from class-conditional Kneser-Ney models.

One model of words as character sequences per class (toxic, ordinary): interpolated
Kneser-Ney over grams of up to ``ORDER`` characters, lower orders on continuation
counts, and a last backoff to counts shared by both classes, so that a rare or unseen
expression is judged by the parts it shares with known ones.  Length-normalised toxic and
ordinary log-likelihoods are compared per word over the whole text and over its most toxic
stretches (a long text may hold one); a logistic curve over these comparisons, fitted on
labelled rows that the counts did not use, makes them a probability.

Scale: word counts and gram counts are Spark aggregations with partial sums; the model
sent to tasks is a fixed number of hashed slots per order (``SLOT_BITS``), whatever the
corpus; the curve is fitted on every labelled row of its fold, each Newton step one row of sums.
Texts are scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored, whole_text

ORDER = 6
DISCOUNT = 0.75
#: Hashed slots per order of the shared counts, and of the classes' own counts.
SLOT_BITS, OWN_BITS = 19, 20
#: A word is split into stretches of this many characters, so one endless "word" stays cheap to count.
WORD_CHARS = 64
CACHE_WORDS = 200_000
#: Stretches of words over which likelihoods are compared, and the ratio from which a word speaks clearly.
STRETCHES, CLEAR = (1, 2, 8, 32, 128), 2.5
#: Letters only: digits, punctuation and markup carry no expression.
WORD = re.compile(r"[^\W\d_]+")

_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if any(len(w) > WORD_CHARS for w in found):
        found = [w[k:k + WORD_CHARS] for w in found for k in range(0, len(w), WORD_CHARS)]
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` in a row, and each one's place in its word."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words)) + 2
    marked = "".join("\x02" + w + "\x03" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
    return points, place


def _hashes(points: np.ndarray) -> list[np.ndarray]:
    """``[k][i]``: hash of the k characters that end at i (garbage where they leave the word)."""
    out = [np.zeros(len(points), np.uint64)]
    for k in range(1, ORDER + 1):
        h = np.zeros(len(points), np.uint64)
        if len(points) >= k:
            h[k - 1:] = _mix(points[:len(points) - k + 1] * _MULT + np.uint64(k))
            for j in range(1, k):
                h[k - 1:] = _mix((h[k - 1:] ^ points[j:len(points) - k + 1 + j]) * _MULT)
        out.append(h)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        texts, toxic = batch.column(0), batch.column(1).to_pylist()
        for low in range(0, len(toxic), 256):
            for text, y in zip(texts.slice(low, 256).to_pylist(), toxic[low:low + 256]):
                counts[y].update(words_of(text))
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], ["word", "n0", "n1"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        points, place = _characters(words)
        hashes = _hashes(points)
        weights = [np.repeat(np.array(batch.column(c).to_pylist(), np.int64), [len(w) + 2 for w in words]) for c in (1, 2)]
        for k in range(1, ORDER + 1):
            here = np.flatnonzero(place >= max(k - 1, 1))  # the mark before a word is given, not predicted
            gram, first, inverse = np.unique(hashes[k][here], return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, w[here]).astype(np.int64) for w in weights]
            at = here[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)),
                 pa.array(hashes[k - 1][at - 1].view(np.int64)), pa.array(hashes[k - 1][at].view(np.int64)),
                 pa.array(place[at] == k - 1), *map(pa.array, sums)],
                ["k", "gram", "context", "suffix", "starts", "n0", "n1"])


class Model:
    """Hashed counts; ``llr`` gives log P(word | toxic) - log P(word | ordinary).

    ``shared`` holds every order over both classes, ``own`` the widest gram at each place
    per class: a class predicts by its own widest counts and backs off to the shared model."""

    def __init__(self, shared: tuple[pd.DataFrame, pd.DataFrame], own: tuple[pd.DataFrame, pd.DataFrame]):
        self.shared = np.zeros((3, ORDER + 1, 1 << SLOT_BITS), np.float32)
        self.own = np.zeros((3, 2, 1 << OWN_BITS), np.float32)
        for frame, names in zip(shared, ((0,), (1, 2))):
            for at in names:
                self.shared[at, frame["k"], frame["slot"]] = frame["mst"[at]]
        for frame, names in zip(own, ((0,), (1, 2))):
            for at in names:
                for c in (0, 1):
                    self.own[at, c, frame["slot"]] = frame["mst"[at] + str(c)]

    def llr(self, words: list[str]) -> np.ndarray:
        points, place = _characters(words)
        hashes = _hashes(points)
        m, total, types = self.shared
        p = np.full(len(points), 1 / 4096)
        widest, context = hashes[1].copy(), hashes[0].copy()
        for k in range(1, ORDER + 1):
            inside = np.flatnonzero(place >= max(k - 1, 1))
            widest[inside], context[inside] = hashes[k][inside], hashes[k - 1][inside - 1]
            gram, before = (_slot(hashes[j][i], SLOT_BITS) for j, i in ((k, inside), (k - 1, inside - 1)))
            known = total[k][before] > 0
            inside, gram, before = inside[known], gram[known], before[known]
            p[inside] = (np.maximum(m[k][gram] - DISCOUNT, 0) + DISCOUNT * types[k][before] * p[inside]) / total[k][before]
        gram, before = _slot(widest, OWN_BITS), _slot(context, OWN_BITS)
        m, total, types = self.own
        logs = []
        for c in (0, 1):
            known = total[c][before]
            mixed = (np.maximum(m[c][gram] - DISCOUNT, 0) + DISCOUNT * types[c][before] * p) / np.maximum(known, 1)
            logs.append(np.log(np.maximum(np.where(known > 0, mixed, p), 1e-9)))
        difference = np.where(place > 0, logs[1] - logs[0], 0.0)
        starts = np.flatnonzero(place == 0)
        return np.add.reduceat(difference, starts) if len(starts) else np.zeros(0)


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def train(labelled: DataFrame) -> Model:
    """Model from ``(text, toxic)`` rows; null texts are empty.  Rows of both classes count whole."""
    pairs = labelled.select(whole_text().alias("text"), F.col("toxic").cast("int").alias("toxic"))
    words = (pairs.mapInArrow(_count_words, "word string, n0 long, n1 long")
             .groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    schema = "k int, gram long, context long, suffix long, starts boolean, n0 long, n1 long"
    grams = stored(words.mapInArrow(_count_grams, schema)
                   .groupBy("k", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"),
                                             F.first("starts").alias("starts"),
                                             F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    # Continuation counts: in how many longer grams a gram stands at the end.
    wider = grams.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(F.count("*").alias("r"))
    counted = grams.join(wider, ["k", "gram"], "left").select(
        "k", "gram", "context", F.when(F.col("starts") | (F.col("k") == ORDER) | F.col("r").isNull(), F.col("n0") + F.col("n1"))
        .otherwise(F.col("r")).alias("m"))

    def slot(name: str, bits: int) -> Column:
        return F.col(name).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("slot")

    def held(df: DataFrame) -> pd.DataFrame:  # at most ORDER * 2 ** SLOT_BITS or 2 ** OWN_BITS rows, whatever the corpus
        return df.toArrow().to_pandas()

    def sums(*names: str) -> list[Column]:
        return [F.sum(n).cast("float").alias(a) for n, a in (x.split() for x in names)]

    widest = grams.where(F.col("starts") | (F.col("k") == ORDER)).withColumns(
        {f"i{c}": (F.col(f"n{c}") > 0).cast("int") for c in (0, 1)})
    shared = (held(counted.groupBy("k", slot("gram", SLOT_BITS)).agg(*sums("m m"))),
              held(counted.withColumn("one", F.lit(1)).groupBy("k", slot("context", SLOT_BITS)).agg(*sums("m s", "one t"))))
    own = (held(widest.groupBy(slot("gram", OWN_BITS)).agg(*sums("n0 m0", "n1 m1"))),
           held(widest.groupBy(slot("context", OWN_BITS)).agg(*sums("n0 s0", "n1 s1", "i0 t0", "i1 t1"))))
    return Model(shared, own)


def evidence(llr: np.ndarray) -> list[float]:
    """Length-normalised comparisons of one text, from its words' log-likelihood ratios: per word over the
    whole text, over its most toxic stretch of each length in ``STRETCHES``, over its five most toxic words,
    and how many words speak clearly; with the text's length, which says how high a best stretch is by chance."""
    n = len(llr)
    if not n:
        return [0.0] * (len(STRETCHES) + 4)
    sums = np.concatenate([[0.0], np.cumsum(llr)])
    best = [float((sums[w:] - sums[:-w]).max() / w) if n >= w else float(sums[-1] / w) for w in STRETCHES]
    top = np.partition(llr, n - 5)[-5:] if n > 5 else llr
    return [float(sums[-1] / n), *best, float(np.maximum(top, 0).sum() / 5), float(np.log1p((llr > CLEAR).sum())), float(np.log1p(n))]


FEATURES = [f"f{k}" for k in range(len(STRETCHES) + 4)]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache: dict[str, float] = {}  # of this task: a worker that is used again may score by another model
        for batch in batches:
            texts, raw = batch.column(1), []
            for low in range(0, len(texts), 256):
                split = [words_of(t) for t in texts.slice(low, 256).to_pylist()]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                new = list({w for words in split for w in words if w not in cache})
                if new:
                    cache.update(zip(new, model.llr(new).tolist()))
                raw += [evidence(np.fromiter(map(cache.__getitem__, w), float, len(w))) for w in split]
            columns = zip(*raw) if raw else [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", *FEATURES])

    return run


def raw_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and its ``evidence``, of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        _score(shared), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def fit_curve(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic curve of all rows (``FEATURES, toxic``), by Newton steps on scaled columns."""
    total, toxic, *mean = rows.agg(F.count("*"), F.sum("toxic"), *map(F.avg, FEATURES)).first()
    if not total or toxic in (0, total):
        return np.eye(1, len(FEATURES))[0], 0.0
    spread = rows.agg(*(F.sqrt(F.avg((F.col(name) - m) * (F.col(name) - m))) for name, m in zip(FEATURES, mean))).first()
    mean, scale = np.array(mean), np.maximum(np.array(spread, float), 1e-6)
    width = len(FEATURES) + 1
    scaled = rows.select(F.col("toxic").cast("double").alias("y"), *((F.col(name) - float(m)) / float(d) for name, m, d in zip(FEATURES, mean, scale)),
                         F.lit(1.0)).toDF("y", *(f"z{k}" for k in range(width)))
    z, p, upper = [F.col(f"z{k}") for k in range(width)], F.col("p"), np.triu_indices(width)
    w, ridge = np.zeros(width), np.array([1.0] * (width - 1) + [1e-3])
    for _ in range(50):
        linear = sum((column * weight for column, weight in zip(z[1:], w[1:].tolist())), z[0] * float(w[0]))
        judged = scaled.withColumn("p", 1 / (1 + F.exp(-F.least(F.greatest(linear, F.lit(-30.0)), F.lit(30.0)))))
        sums = np.array(judged.agg(*(F.sum(z[i] * z[j] * p * (1 - p)) for i, j in zip(*upper)),
                                   *(F.sum(column * (p - F.col("y"))) for column in z)).first(), float)
        curved = np.zeros((width, width))
        curved[upper] = sums[:-width]
        curved = curved + np.triu(curved, 1).T
        step = np.linalg.solve(curved + np.diag(ridge), sums[-width:] + ridge * w)
        w = w - np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def fold(column: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return (F.crc32(column.cast("string").cast("binary")) % 5).cast("int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels count only for ids whose fold is not 0: folds 1 to 3 give the counts, fold 4
    the logistic curve.  A doc_id with several labels is toxic if any says so; null
    labels and null ids teach nothing.  A null or empty text has no evidence (all 0) and gets
    the curve's value there.  A null doc_id is scored and not held out; repeated rows are each
    scored.  Without labels of both classes every score is the curve's default."""
    marks = (labels.where("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    learn = part.where(fold(F.col("doc_id")).isin(1, 2, 3)).join(marks.where(fold(F.col("doc_id")).isin(1, 2, 3)), "doc_id")
    model = train(learn)
    raw = stored(raw_scores(docs, model))
    fitted = stored(raw.where(fold(F.col("doc_id")) == 4).join(marks.where(fold(F.col("doc_id")) == 4), "doc_id").select(*FEATURES, "toxic"))
    weights, intercept = fit_curve(fitted)
    linear = F.lit(intercept)
    for name, weight in zip(FEATURES, weights.tolist()):
        linear = linear + F.col(name) * F.lit(weight)
    score = 1 / (1 + F.exp(-F.least(F.greatest(linear, F.lit(-500.0)), F.lit(500.0))))
    return (raw.withColumn("score", score)
            .select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(1)) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
