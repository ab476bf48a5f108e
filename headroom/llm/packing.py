"""Packing of documents into training sequences (bounded-space online best fit).

Documents are tokenised, closed by the separator id 0, and cut into pieces of at
most ``capacity`` tokens (only longer documents are cut).  Pieces are packed by
best fit: a fixed number of bins is open at a time, indexed by a bitset keyed by
free space, so the tightest bin that still fits is one shift and one lowest-set-bit
away; when the number is reached, the fullest bin closes.

Scale: the first pass packs inside the tokenising tasks, without a shuffle.  Bins
still open at the end of a task hand their pieces (numbers only, no texts) to a
second pass over far fewer tasks, so the waste does not grow with the number of
tasks.  The first pass is written to the shared folder: sequence numbers come from
task numbers and are fixed by that write.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored, whole_text

CAPACITY = 2048
#: Open bins of one packing task.
OPEN_BINS = 4096
#: Pieces that one task of the second pass packs, largest first, and its open bins
#: (more than those pieces can fill to over a half).
SECOND_PASS_PIECES = 200_000
SECOND_PASS_BINS = 1 << 18
#: Entries of a worker's caches of words as written and of lower-case letter runs.
CACHE_WORDS, CACHE_STEMS = 600_000, 450_000
#: Closing punctuation: a run of it after letters is one tokenizer word (an apostrophe may open a contraction,
#: and the special tokens hold the other three signs left out).
CLOSING = "".join(sign for sign in string.punctuation if sign not in "'<|>")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Bounded-space best fit over integer sizes; ``add`` returns a bin that closed, if any."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f is set if a bin with f free places is open
        self.stacks: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def _take(self, space: int) -> list:
        stack = self.stacks[space]
        found = stack.pop()
        if not stack:
            self.free ^= 1 << space
        self.count -= 1
        return found

    def add(self, item, size: int) -> Iterator[list]:
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            content = self._take(space)
        else:
            space, content = self.capacity, []
            if self.count >= self.open_bins:
                yield self._take((self.free & -self.free).bit_length() - 1)
        content.append((item, self.capacity - space))
        space -= size
        if space == 0:
            yield content
            return
        if not self.stacks[space]:
            self.free |= 1 << space
        self.stacks[space].append(content)
        self.count += 1

    def rest(self) -> Iterator[list]:
        while self.free:
            yield self._take((self.free & -self.free).bit_length() - 1)


class WordCache(dict):
    """Token ids (little-endian unsigned 32-bit) of white-space-free words, and of whole texts.

    No token spans white space, so a text's ids are its words' ids in a row.  Only plain
    ASCII white space separates words here; anything else stays inside a word.  A word of
    Latin letters with closing punctuation is two tokenizer words, and goes straight to the
    model (lower-cased, byte by byte in its alphabet); every other word goes through the
    whole tokenizer.  Both caches are bounded: a full one is emptied."""

    def __init__(self, path: str):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The byte-level alphabet: printable bytes stand for themselves, the rest for 256 upwards.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.letters: dict[str, bytes] = {"": b""}
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(CLOSING)
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250" and is_normalized("NFC", stem)):
            found = self._letters(stem.lower())
            if len(stem) < len(word):
                end = word[len(stem):]
                found += self.letters.get(end) or self.letters.setdefault(end, self._whole(end))
        else:
            found = self._whole(word)
        self[word] = found
        return found

    def _letters(self, stem: str) -> bytes:
        found = self.letters.get(stem)
        if found is None:
            if len(self.letters) > CACHE_STEMS:
                self.letters = {"": b""}
            spelt = stem if stem.isascii() else "".join(map(self.alphabet.__getitem__, stem.encode()))
            ids = [t.id for t in self.model.tokenize(spelt)]
            found = self.letters[stem] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self) > CACHE_WORDS:
                self.clear()
                self[""] = b""
            out.append(b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" "))))
        return out


    def forget(self) -> None:
        """Empties both caches: a worker kept for later tasks holds the tokenizer only."""
        self.clear()
        self.letters.clear()
        self[""] = self.letters[""] = b""


_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _first_pass(path: str, capacity: int, open_bins: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        cache, fit, made = _cache(path), BestFit(capacity, open_bins), 0
        rows: list[tuple] = []

        def closed(content: list, sequence) -> None:
            rows.extend((*item, sequence, at) for item, at in content)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * (7 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            kinds += [pa.binary()] * with_ids + [pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["sequence_id", "offset"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            rows.clear()
            return batch

        step = 4 * capacity
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(keys), 256):
                part = texts.slice(low, 256).to_pylist()
                for key, ids in zip(keys[low:low + 256], cache.ids(part)):
                    ids += b"\0\0\0\0"
                    for n, at in enumerate(range(0, len(ids), step)):
                        own = ids[at:at + step]
                        size = len(own) // 4
                        item = (key, n, at // 4, size, zlib.crc32(own)) + ((own,) if with_ids else ())
                        for content in fit.add(item, size):
                            closed(content, base + made)
                            made += 1
                if len(rows) >= 20_000:
                    yield flush()
        cache.forget()
        for content in fit.rest():
            closed(content, None)
            if len(rows) >= 20_000:
                yield flush()
        yield flush()

    return run


def _second_pass(capacity: int, open_bins: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (1 << 62) + (TaskContext.get().partitionId() << 36)
        fit, made = BestFit(capacity, open_bins), 0
        for batch in batches:
            rows = []

            def put(content: list, sequence: int) -> None:
                rows.extend((*item, sequence, at) for item, at in content)

            for item in zip(*(batch.column(n).to_pylist() for n in names)):
                for content in fit.add(item, item[3]):
                    put(content, base + made)
                    made += 1
            yield _table(rows, batch, names)
        rows = []
        for content in fit.rest():
            rows.extend((*item, base + made, at) for item, at in content)
            made += 1
        if rows:
            yield _table(rows, batch, names)

    def _table(rows, like, names):
        columns = list(zip(*rows)) if rows else [()] * (len(names) + 2)
        kinds = [like.schema.field(n).type for n in names] + [pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False,
         open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    Uses ``doc_id`` and ``text``; other columns are ignored.  A null or empty text is
    the separator alone (one piece of length 1).  Null and repeated ``doc_id`` are
    packed like any other row.  An empty table gives no rows.  ``ids`` (with
    ``with_ids``) holds the piece's ids as little-endian unsigned 32-bit integers."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    first = stored(texts.mapInArrow(_first_pass(path, capacity, open_bins, with_ids), schema))
    left = first.where("sequence_id is null").select(*names)
    tasks = -(-left.count() // SECOND_PASS_PIECES) or 1
    # Dealt by row content: the same rows meet in the same task if a task is run again.
    dealt = left.repartition(tasks, "doc_id", "piece", "ids_crc32").sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    second = dealt.mapInArrow(_second_pass(capacity, SECOND_PASS_BINS, names), schema)
    return first.where("sequence_id is not null").unionByName(stored(second))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
