"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes (UTF-8, A-Z in lower case; the last one filled with zeros).  Each byte has a small
vector; filters of several widths slide over them, the strongest response of every filter in the window
is kept, and a softmax over the languages reads these.  A text's score is the mean of its windows' probabilities by their bytes, over
all of its windows, from the first to the last.

The network is trained in numpy on the driver, on a bounded sample of labelled rows (``FIT_ROWS`` documents, equally many per language by the hash of their
ids, ``FIT_WINDOWS`` windows spread over each), some of them cut short as short texts are.  It is applied in tasks, batch by batch:
a batch's windows are one array, so the whole network is a few matrix products.  Nothing is shuffled.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if no labelled row can be learnt from;
rows without ``doc_id`` are neither learnt from nor held out; rows that repeat are scored each; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

WINDOW = 128
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 16, 8
#: Bound on the labelled documents that are learnt from, and on the windows of each.
FIT_ROWS, FIT_WINDOWS = 4000, 6
EPOCHS, BATCH, RATE = 12, 128, 0.01
#: Windows per matrix product in a task.
CHUNK = 1024
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

col = F.col

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- windows ----------------------------------------------------------------------

def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts ``data[starts[k]:ends[k]]``: the bytes, the text each belongs to, and how many bytes are its own."""
    count = -(-(ends - starts) // WINDOW)
    owner = np.repeat(np.arange(len(starts)), count)
    first = starts[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    size = np.minimum(ends[owner] - first, WINDOW)
    place, out = np.arange(WINDOW), np.zeros((len(owner), WINDOW), np.uint8)
    for low in range(0, len(owner), CHUNK):                    # the places of a chunk of windows at a time, not of all
        part = slice(low, low + CHUNK)
        found = _LOWER[data[np.minimum(first[part, None] + place, len(data) - 1)]]
        out[part] = np.where(place < size[part, None], found, 0)
    return out, owner, size


def _text_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    encoded = [t.encode() for t in texts]
    ends = np.cumsum([len(e) for e in encoded], dtype=np.int64)
    starts = ends - np.array([len(e) for e in encoded], np.int64)
    return windows_of(np.frombuffer(b"".join(encoded), np.uint8), starts, ends)


# --- network ------------------------------------------------------------------------

class Network:
    """Byte vectors, filters (one matrix: a narrow filter has zeros where it does not reach) and the softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        wide, all_filters = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        self.reach = np.zeros((wide * DEPTH, all_filters), np.float32)
        for k, width in enumerate(WIDTHS):
            self.reach[:width * DEPTH, k * FILTERS:(k + 1) * FILTERS] = 1
        self.params = {
            "bytes": rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
            "filters": rng.normal(0, (2 / (wide * DEPTH)) ** 0.5, self.reach.shape).astype(np.float32) * self.reach,
            "bias": np.zeros(all_filters, np.float32),
            "out": rng.normal(0, all_filters ** -0.5, (all_filters, len(languages))).astype(np.float32),
            "prior": np.zeros(len(languages), np.float32),
        }

    def _stacked(self, windows: np.ndarray) -> np.ndarray:
        """``[window, place]``: the vectors of the bytes from a place on, as many as the widest filter reaches."""
        wide = max(WIDTHS)
        vectors = self.params["bytes"][np.pad(windows, ((0, 0), (0, wide - 1)))]
        return np.concatenate([vectors[:, k:k + windows.shape[1]] for k in range(wide)], axis=2)

    def forward(self, windows: np.ndarray, keep: bool = False):
        p, stacked = self.params, self._stacked(windows)
        response = (stacked.reshape(-1, stacked.shape[2]) @ p["filters"]).reshape(len(windows), windows.shape[1], -1)
        strongest = response.max(axis=1) + p["bias"]
        pooled = np.maximum(strongest, 0)
        logits = pooled @ p["out"] + p["prior"]
        logits -= logits.max(axis=1, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(axis=1, keepdims=True)
        return (probs, pooled, response.argmax(axis=1), stacked) if keep else probs

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; only the places of the strongest responses carry it back."""
        p = self.params
        probs, pooled, place, stacked = self.forward(windows, keep=True)
        wrong = probs.copy()
        wrong[np.arange(len(label)), label] -= 1
        wrong /= len(label)
        back = (wrong @ p["out"].T) * (pooled > 0)
        rows = np.arange(len(windows))[:, None]
        seen = stacked[rows, place]                                     # [window, filter, reach * depth]
        grad_filters = np.einsum("wf,wfd->df", back, seen) * self.reach
        to_bytes = back[:, :, None] * p["filters"].T[None]
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
        grad_bytes = np.zeros_like(p["bytes"])
        for k in range(max(WIDTHS)):
            np.add.at(grad_bytes, padded[rows, place + k].ravel(), to_bytes[:, :, k * DEPTH:(k + 1) * DEPTH].reshape(-1, DEPTH))
        return {"bytes": grad_bytes, "filters": grad_filters, "bias": back.sum(axis=0), "out": pooled.T @ wrong, "prior": wrong.sum(axis=0)}

    def train(self, windows: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam over shuffled batches; the rate falls to nothing over the epochs."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        step, steps = 0, epochs * -(-len(label) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for low in range(0, len(order), BATCH):
                part = order[low:low + BATCH]
                step += 1
                rate = RATE * (1 - (step - 1) / steps)
                for k, g in self.gradients(windows[part], label[part]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    change = mean[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-7)
                    self.params[k] = (self.params[k] - rate * change).astype(np.float32)
        return self

    def score(self, windows: np.ndarray, owner: np.ndarray, size: np.ndarray, texts: int) -> np.ndarray:
        """``[text, language]``: the mean probability of a text's windows by their bytes."""
        total = np.zeros((texts, len(self.languages)))
        for low in range(0, len(windows), CHUNK):
            part = slice(low, low + CHUNK)
            np.add.at(total, owner[part], self.forward(windows[part]) * size[part, None])
        return total / np.maximum(np.bincount(owner, size, texts), 1)[:, None]


# --- learning and applying ---------------------------------------------------------------

def _fold(divisor: int) -> Column:
    """The row's fold by the checksum of its id; null without an id."""
    return F.crc32(col("doc_id").cast("string").cast("binary")) % divisor


def sample(labelled: DataFrame, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` pairs ``(text, lang)``, equally many per language as far as there are, by hashed id."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    each = max(1, rows // len(counts))
    order = F.xxhash64("doc_id", "lang")
    share = F.coalesce(*[F.when(col("lang") == lang, min(1.0, 3 * each / n)) for lang, n in counts.items()])
    some = labelled.select("lang", "text", order.alias("o")).where(F.pmod(F.xxhash64("o"), F.lit(1 << 20)) < share * (1 << 20))
    ranked = some.select("lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text")).alias("k"))
    return [(r["text"], r["lang"]) for r in ranked.where(col("k") <= each).select("text", "lang").collect()]


def learn(labelled: DataFrame, rows: int = FIT_ROWS) -> Network | None:
    """A network trained on a bounded sample of ``doc_id, text, lang``; None if there is nothing to learn from."""
    spread = labelled.where(col("lang").isNotNull() & col("text").isNotNull()).select("doc_id", "lang", "text")
    picked = sorted(pair for pair in _spread_windows(spread, rows))
    if not picked:
        return None
    languages = sorted({lang for lang, _ in picked})
    windows = np.stack([np.frombuffer(w, np.uint8) for _, w in picked])
    label = np.array([languages.index(lang) for lang, _ in picked])
    rng = np.random.default_rng(3)
    cut = np.where(rng.random(len(windows)) < 0.3, rng.integers(8, WINDOW, len(windows)), WINDOW)
    return Network(languages).train(np.where(np.arange(WINDOW) < cut[:, None], windows, 0).astype(np.uint8), label)


def _spread_windows(labelled: DataFrame, rows: int) -> list[tuple[str, bytes]]:
    """Windows of sampled documents, spread over the whole of each text."""
    out = []
    for text, lang in sample(labelled.where(F.col("text").rlike(r"\p{L}")), rows):
        windows, _, _ = _text_windows([text])
        for k in np.unique(np.linspace(0, len(windows) - 1, FIT_WINDOWS).astype(int)):
            out.append((lang, windows[k].tobytes()))
    return out


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            known = [network is not None and LETTER.search(t) is not None for t in texts]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if any(known):
                scores = network.score(*_text_windows(texts), len(texts))
                best = scores.argmax(axis=1)
                for k, has in enumerate(known):
                    if has:
                        lang[k], score[k] = network.languages[best[k]], float(min(1.0, scores[k, best[k]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, lang_pred string, score double")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learnt from the labelled rows of three of four folds."""
    docs = read_table(spark, sf_dir, "documents")
    network = learn(docs.where(_fold(4) != 2))
    return identify(docs, network).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
