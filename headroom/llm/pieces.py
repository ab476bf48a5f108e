"""SentencePiece encoding and decoding by suffix-array matching.

The units of a batch (a run of spaces with the word after it; no piece crosses into the next)
are laid end to end and indexed by a suffix array.  Every vocabulary piece is looked up by
binary search for its range of occurrences; occurrences are edges, sorted by position and
relaxed from left to right.  For a byte-pair vocabulary the relaxation is by validity instead
of cost: the encoding of every prefix is unique, and an edge extends it exactly if the last
piece and the new one are what merging their joint text gives, so one pass finds the
segmentation that merging by score finds.

Scale: a narrow map over whole texts without a shuffle.  Units met before come from a bounded
cache, so the index is built over new units only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, whole_text

CACHE_UNITS, CACHE_PAIRS = 700_000, 2_000_000
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_END = 0x110000  # stands after every unit; no character


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in normal}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for t, i in self.id.items()}
        if any(SPACE in t.lstrip(SPACE) for t in self.id):
            raise ValueError("a piece crosses from a word into the next space")
        self.size = sp.vocab_size()
        self.spelt = [b""] * self.size
        for i, t in self.text.items():
            self.spelt[i] = t.encode()
        for value, i in self.bytes.items():
            self.spelt[i] = bytes([value])
        self.spelt[self.unknown] = " ⁇ ".encode()
        order = np.array(normal, np.int64)
        self.order = order
        self.lengths = np.array([len(self.text[i]) for i in normal])
        self.letters = np.full((len(normal), int(self.lengths.max())), -1, np.int64)
        for row, i in enumerate(normal):
            self.letters[row, :len(self.text[i])] = [ord(c) for c in self.text[i]]
        self.units: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Segmentation by merging the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            k = scores.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether ``token`` may follow ``before`` (-1: nothing or an unknown character)."""
        keys, inverse = np.unique((before + 1) * self.size + token, return_inverse=True)
        good = np.empty(len(keys), bool)
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs = {}
        for k, key in enumerate(keys.tolist()):
            known = self.pairs.get(key)
            if known is None:
                a, b = divmod(key, self.size)
                own = [self.text[b]] if a == 0 else [self.text[a - 1], self.text[b]]
                known = self.pairs[key] = self.merged("".join(own)) == own
            good[k] = known
        return good[inverse]

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, piece and length of every occurrence of every piece."""
        n, depth = len(text), self.letters.shape[1]
        rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1
        while width < depth:
            later = np.zeros(n, np.int64)
            later[:n - width] = rank[width:]
            rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        padded = np.concatenate([text, np.full(depth, _END)])
        low, high = np.zeros(len(self.order), np.int64), np.full(len(self.order), n)

        def search(rows, lo, hi, letter, at, right):
            lo, hi = lo.copy(), hi.copy()
            while (open_ := lo < hi).any():
                middle = (lo + hi) >> 1
                here = padded[suffixes[np.minimum(middle, n - 1)] + at]
                up = open_ & ((here <= letter) if right else (here < letter))
                lo = np.where(up, middle + 1, lo)
                hi = np.where(open_ & ~up, middle, hi)
            return lo

        for at in range(depth):
            rows = np.flatnonzero((self.lengths > at) & (high > low))
            letter = self.letters[rows, at]
            first = search(rows, low[rows], high[rows], letter, at, False)
            high[rows] = search(rows, first, high[rows], letter, at, True)
            low[rows] = first
        counts = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(self.order)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        return suffixes[place], self.order[piece], self.lengths[piece]

    def _index(self, new: list[str]) -> None:
        sizes = np.array([len(u) for u in new])
        joined = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        inside = np.arange(len(joined)) + np.repeat(np.arange(len(new)), sizes)
        text = np.full(len(joined) + len(new), _END, np.int64)
        text[inside] = joined
        offset = np.zeros(len(text), np.int64)
        offset[inside] = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start, token, length = self._edges(text)
        covered = np.zeros(len(text), bool)
        covered[start[length == 1]] = True
        alone = inside[~covered[inside]]  # characters outside the vocabulary
        start, token = np.concatenate([start, alone]), np.concatenate([token, np.full(len(alone), -1)])
        length = np.concatenate([length, np.ones(len(alone), np.int64)])
        order = np.argsort(offset[start], kind="stable")
        start, token, length = start[order], token[order], length[order]
        last, back = np.full(len(text), -2, np.int64), np.zeros(len(text), np.int64)
        last[begins] = -1
        cuts = np.searchsorted(offset[start], np.arange(sizes.max() + 1))
        for low, high in zip(cuts, [*cuts[1:], len(start)]):
            s, t, n = start[low:high], token[low:high], length[low:high]
            good = t < 0
            good[~good] = self._fits(last[s[~good]], t[~good])
            last[(s + n)[good]] = t[good]
            back[(s + n)[good]] = s[good]
        found, where, unit = [], [], []
        at, who = begins + sizes, np.arange(len(new))
        while len(at):
            found.append(last[at])
            at = back[at]
            where.append(at)
            unit.append(who)
            more = at > begins[who]
            at, who = at[more], who[more]
        where, found, unit = map(np.concatenate, (where, found, unit))
        order = np.argsort(where)
        where, found, unit = where[order], found[order], unit[order]
        ends = np.searchsorted(unit, np.arange(len(new)), side="right").tolist()
        plain, low = found.astype("<i4"), 0
        strange = set(unit[found < 0].tolist())
        for k, high in enumerate(ends):
            if k in strange:
                ids: list[int] = []
                for p, t in zip(where[low:high].tolist(), found[low:high].tolist()):
                    ids += [t] if t >= 0 else [self.bytes[b] for b in chr(text[p]).encode("utf-8", "surrogatepass")]
                self.units[new[k]] = np.array(ids, "<i4").tobytes()
            else:
                self.units[new[k]] = plain[low:high].tobytes()
            low = high

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian signed 32-bit ids of each text."""
        split = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.units) > CACHE_UNITS:
            self.units = {}
        new = list({u for units in split for u in units if u not in self.units})
        if new:
            self._index(new)
        return [b"".join(map(self.units.__getitem__, units)) for units in split]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.spelt.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text.replace(SPACE, " ")[1:] if text.startswith(SPACE) else text


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_ids, ids, round_trip`` of every row of ``docs``.

    ``round_trip`` says whether decoding gives the text back (spaces for the model's space mark).
    Null text is empty and has no ids; null and repeated doc_ids are rows of their own; other
    columns are ignored; an empty table gives no rows."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for low in range(0, len(batch), 2048):
                texts = batch.column(1).slice(low, 2048).to_pylist()
                ids = model.encode(texts)
                sizes = np.array([len(i) // 4 for i in ids], np.int64)
                good = [model.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts)]
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 2048), pa.array(sizes), lists, pa.array(good)],
                                                 ["doc_id", "n_ids", "ids", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids give a null text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            texts = [None if i is None else model.decode(np.array(i, "<i4").tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))
