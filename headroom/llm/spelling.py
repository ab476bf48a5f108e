"""Spelling variants: words one edit apart, each assigned to the more frequent form it varies.

Words that differ by exactly one inserted, deleted or replaced code point are near.  They are found with a trie kept
as a distributed edge table (``depth, node, ch``; a node is its prefix) and a frontier of states (word, place in it, node,
edits) that is joined with the edges of one level after the other.  States without an edit follow the word's own path, so
they are read off the word; at each place they branch into a replaced, an inserted and a deleted code point, and a state with its one
edit goes on only along edges that match.  A state whose word is used up at a node that is a word is a pair of neighbours.

A word branches in its second half only, once in the trie of the words and once in that of the reversed words: an edit lies in one
of the halves, and the branches start at deep nodes with few children instead of at the root, which all words would share.  An edge has a row for
every exit below it (length and last ``TAIL`` letters of a word there), and a state, whose neighbour's exit is known from its own word, follows
only the edges with that exit, so that nearly all states end as neighbours.

Scale: words are counted with partial sums per task; the frontier grows with the words times their branches, every level is one join on the
node and written to the shared folder; there are as many levels as the longest word has letters, at most ``LONG``.
Longer words (endless letter runs) go by halving instead: the place of the edit is narrowed by halves, and a word stays in a half only while
another word agrees with it outside of it, so the rounds are the logarithm of the length.

Defined results: null and empty texts have no runs; a row without ``doc_id`` keeps its runs as they are; rows that repeat count each;
ties between forms go to the smallest word in code-point order; an empty table has no words; further columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.session import ensure_checkpoint_dir

from .common import read_table, stored

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One occurrence in so many, by checksum, loses a letter.
TYPO = 97
#: Longest word of the tries, and the letters of an exit.
LONG, TAIL = 32, 3
EDGE = "way int, node string, ch string, goal int, exit string, depth int"
#: Words counted in memory before a task hands them on.
HELD = 400_000

col = F.col


# --- words -----------------------------------------------------------------------

def runs_of(text: str, doc_id: int | None) -> Counter:
    """Counts of the lower-cased letter runs of a text, with the deletions that the checksum orders."""
    found = Counter(RUN.findall(text.encode().translate(LOWER).decode()))
    if doc_id is None:
        return found
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, count in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % TYPO == 0:
            place = h % len(run)
            run = run[:place] + run[place + 1:]
        out[run] += count
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            for word, count in runs_of(text.as_py() or "", doc_id.as_py()).items():
                if len(word) >= LEAST_LETTERS:
                    held[word] = held.get(word, 0) + count
            if len(held) > HELD:
                yield out()
    yield out()


def words_of(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words with at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences."""
    partial = docs.select("doc_id", "text").mapInArrow(_count_batches, "word string, n long")
    return stored(partial.groupBy("word").agg(F.sum("n").alias("n")).where(col("n") >= LEAST_COUNT))


# --- the trie frontier ---------------------------------------------------------------

def _at(place) -> Column:
    """Letter of the word at a place, from 0."""
    return F.substring(col("word"), place + 1, F.lit(1))


def _oriented(words: DataFrame) -> DataFrame:
    """Every word forwards and backwards with its length, the place from which it branches, and its last letters."""
    length = F.char_length("word").cast("int")
    half = F.call_function("div", length, F.lit(2)).cast("int")
    both = words.select(F.lit(0).alias("way"), "word", length.alias("size"), half.alias("start"))
    back = both.select(F.lit(1).alias("way"), F.reverse("word").alias("word"), "size", (col("size") - col("start")).alias("start"))
    return both.unionByName(back).withColumn("last", F.right("word", F.lit(TAIL)))


def _exit(goal: Column, depth: Column) -> Column:
    """The last letters of a word of length ``goal``, where all of them come after the edge at ``depth``."""
    return F.when(goal - depth - 1 >= TAIL, col("last")).otherwise("")


def _edges(oriented: DataFrame, first: int) -> DataFrame:
    """``depth, way, node, ch, goal, exit`` from depth ``first`` down: an edge once per exit."""
    steps = oriented.where(col("size") > first).select("way", "word", "size", "last", F.explode(F.sequence(F.lit(first), col("size") - 1)).alias("depth"))
    return steps.select("depth", "way", F.substring(col("word"), F.lit(1), col("depth")).alias("node"), _at(col("depth")).alias("ch"),
                        col("size").alias("goal"), _exit(col("size"), col("depth")).alias("exit")).distinct()


def _level(own: DataFrame, carried: DataFrame | None, edges: DataFrame, depth: int) -> DataFrame:
    """The states after level ``depth``: ``way, word, size, last, at`` (letters used up), ``node, goal`` (the neighbour's length)."""
    d, size, letter = F.lit(depth), col("size"), _at(F.lit(depth))
    none = F.lit(None).cast("string")

    def step(possible: Column, at: Column, goal: Column, wanted: Column, other: Column) -> Column:
        return F.when(possible, F.struct(at.cast("int").alias("at"), goal.cast("int").alias("goal"), wanted.alias("wanted"), other.alias("other")))

    # a letter is replaced by another, or one is put in; of a run of equal letters the last stands for the run, so neither a letter
    # equal to the next one is put in nor one before its equal left out.  Leaving one out uses no edge, so its next letter is asked for.
    steps = F.array(step(size > d, d + 1, size, none, letter), step(size >= d, d, size + 1, none, F.when(size > d, letter)),
                    step((size > d + 1) & (_at(d + 1) != letter), d + 2, size - 1, _at(d + 1), none))
    asked = own.select("way", "word", "size", "last", "node", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("x")).select(
        "way", "word", "size", "last", "node", "x.*")
    if carried is not None:
        asked = asked.unionByName(carried.select("way", "word", "size", "last", "node", (col("at") + 1).alias("at"), "goal", _at(col("at")).alias("wanted"),
                                                 none.alias("other")))
    asked = asked.withColumn("exit", _exit(col("goal"), d))
    went = asked.join(edges, ["way", "node", "goal", "exit"]).where(
        (col("wanted").isNull() | (col("ch") == col("wanted"))) & (col("other").isNull() | (col("ch") != col("other"))))
    went = went.select("way", "word", "size", "last", "at", F.concat("node", "ch").alias("node"), "goal")
    ends = own.where(size == d + 1).select("way", "word", "size", "last", (d + 1).alias("at"), "node", (size - 1).alias("goal"))
    return went.unionByName(ends)


def _near_by_trie(words: DataFrame) -> DataFrame:
    short = words.where(F.char_length("word") <= LONG).select("word")
    oriented = stored(_oriented(short))
    least, most = oriented.agg(F.min("start"), F.max("size")).first()
    pairs, carried = words.select("word", col("word").alias("near")).where("false"), None
    if least is None:
        return pairs
    edges = oriented.sparkSession.read.schema(EDGE).parquet(_by_depth(_edges(oriented, least)))
    for depth in range(least, most + 1):
        own = (oriented.where((col("start") <= depth) & (col("size") >= depth))
               .withColumn("node", F.substring(col("word"), F.lit(1), F.lit(depth))))
        states = stored(_level(own, carried, edges.where(col("depth") == depth).drop("depth"), depth))
        carried = states.where(col("at") < col("size"))
        ended = states.where(col("at") == col("size")).select(
            F.when(col("way") == 1, F.reverse("word")).otherwise(col("word")).alias("word"),
            F.when(col("way") == 1, F.reverse("node")).otherwise(col("node")).alias("near"))
        pairs = pairs.unionByName(ended)
    return pairs.join(short.select(col("word").alias("near")), "near", "left_semi").select("word", "near").distinct()


def _by_depth(edges: DataFrame) -> str:
    """Folder of the edges, one part per level, so that a level reads its own."""
    spark = edges.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/headroom-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    edges.write.partitionBy("depth").parquet(path)
    return path


# --- words too long for a trie --------------------------------------------------------------

def _near_by_halving(words: DataFrame) -> DataFrame:
    """Near pairs among words of ``LONG`` letters and more.  A state says that a word's edit, if any, lies at the places ``low`` to
    ``high``: a replaced letter (role r, both words have one there), a letter too many (d) or one too few (s: one place less).  It lives while a
    word of the fitting role has the same length and text outside; ranges are halved until they hold one place."""
    long = stored(words.where(F.char_length("word") >= LONG).select("word", F.char_length("word").cast("int").alias("size")))
    most = long.agg(F.max("size")).first()[0]
    if most is None:
        return words.select("word", col("word").alias("near")).where("false")
    size = col("size")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(0).alias("low"), high.alias("high"), goal.alias("goal"))
                      for r, high, goal in (("r", size, size), ("d", size, size - 1), ("s", size + 1, size))])
    states = long.select("word", "size", F.explode(roles).alias("x")).select("word", "x.*")
    span = 1
    while span < most + 1:
        span *= 2

    def outside(low: Column, high: Column) -> Column:
        kept = F.when(col("role") == "s", high - 1).otherwise(high)
        return F.struct(F.substring(col("word"), F.lit(1), low), F.substring(col("word"), kept + 1, F.lit(1 << 30)))

    def alive(df: DataFrame) -> DataFrame:
        df = df.withColumn("rest", F.sha2(F.to_json(outside(col("low"), col("high"))), 256))
        kind = F.when(col("role") == "r", "r").otherwise("i")
        keys = ["kind", "goal", "low", "high", "rest"]
        df = stored(df.withColumn("kind", kind))
        met = df.groupBy(*keys).agg(F.min("word").alias("a"), F.max("word").alias("b"), F.min("role").alias("ra"), F.max("role").alias("rb"))
        met = met.where(((col("kind") == "r") & (col("a") != col("b"))) | ((col("kind") == "i") & (col("ra") != col("rb")))).select(*keys)
        return df.join(met, keys, "left_semi").drop("kind", "rest")

    while span > 1:
        span //= 2
        halves = F.array(F.struct("low", F.least("high", col("low") + span).alias("high")), F.struct((col("low") + span).alias("low"), "high"))
        states = states.select("word", "role", "goal", F.explode(halves).alias("x")).select("word", "role", "goal", "x.*").where("low < high")
        # of a run of equal letters the first stands for the run, so a range without a first one holds no deletion
        if span == 1:
            first = (col("low") == 0) | (F.substring(col("word"), col("low"), F.lit(1)) != F.substring(col("word"), col("low") + 1, F.lit(1)))
            states = states.where((col("role") != "d") | first)
        states = alive(states)
    one = outside(col("low"), col("high"))
    ends = states.select("word", "role", "goal", "low", F.sha2(F.to_json(one), 256).alias("rest"), F.concat(one["col1"], one["col2"]).alias("text"))
    other = ends.select(col("word").alias("near"), col("role").alias("as"), "goal", "low", "rest", col("text").alias("same"))
    met = ends.join(other, ["goal", "low", "rest"]).where((col("text") == col("same")) & (col("word") != col("near")))
    return met.where(((col("role") == "r") & (col("as") == "r")) | ((col("role") != "r") & (col("as") != "r") & (col("role") != col("as")))
                     ).select("word", "near").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """``word, near`` for every ordered pair of words one edit apart."""
    return stored(_near_by_trie(words).unionByName(_near_by_halving(words)).distinct())


# --- forms -------------------------------------------------------------------------------------

def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table ``word, n``."""
    near = near_words(words).join(words.select(col("word").alias("near"), col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    strong = -col("best.less") >= 2 * col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, col("best.near")).alias("form"),
                              F.when(strong, -col("best.less")).alias("form_n")))
    # each form has twice the count of its word, so paths are short; every round doubles what a pointer covers
    root = stored(rows.where(col("form").isNotNull()).select("word", col("form").alias("root")))
    while True:
        ahead = root.select(col("word").alias("root"), col("root").alias("ahead"))
        longer = stored(root.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), col("ahead").isNotNull().alias("moved")))
        root = longer.select("word", "root")
        if longer.where("moved").limit(1).count() == 0:
            break
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all ``documents``."""
    return variants(words_of(read_table(spark, sf_dir, "documents")))
