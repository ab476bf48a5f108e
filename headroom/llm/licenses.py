"""License scan: TF-IDF cosine of headers and licence files to templates, and inheritance from ancestor directories.

Templates are licence texts, file headers and short notices (``license_texts``).  A template is
compared by the cosine of sparse TF-IDF vectors with each line, with runs of lines of its own
length (so a wrapped header is seen whole) and with the whole file; a file's notice is the best
of these.  A short notice counts only where it holds the words that name its licence.  A licence
file (named so, or a match as a whole without a word foreign to the template) also speaks for its directory.  A file without a
notice inherits from its nearest ancestor directory that has one, by a join on paths.

Only built-in expressions.  Document frequencies of all words are an aggregation over all
files.  A text is looked at line by line only if it holds enough of a template's heaviest words
for a match to be possible (Cauchy-Schwarz: the shared words must carry LEAST ** 2 of the
template's square); such texts are taken once however often they repeat.  What the driver
gathers are counts of template words, whose number is fixed.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored, whole_text
from .license_texts import IDENTIFIER, NAMES, PHRASES, TEXTS

#: Least cosine of a match, and names of licence files.
LEAST = 0.7
LICENSE_FILE = r"(?i)(^|/)((un)?licen[sc]e|copying(\.lesser)?|notice)(\.[a-z]+)?$"
#: Shares of a template's square that its lighter words may hold unseen when texts are chosen; each gives a
#: necessary condition.  By the first one alone, a match holds at least one of the template's heaviest words.
LIGHT = (0.48, 0.4, 0.3, 0.2, 0.1)

_SPLIT = r"[^a-z0-9]+"


def tokens(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def templates() -> list[tuple[str, Counter, frozenset]]:
    """``(licence, words, marks)`` of every template."""
    short = [(licence, phrase.format(name=name), marks) for licence, name, marks in NAMES for phrase in PHRASES]
    short += [(licence, IDENTIFIER.format(licence=licence), "spdx " + " ".join(tokens(licence)[:1])) for licence in sorted({n[0] for n in NAMES})]
    return [(licence, Counter(tokens(text)), frozenset(marks.split())) for licence, text, marks in [*((x, t, "") for x, t in TEXTS), *short]]


TEMPLATES = templates()
VOCABULARY = sorted({w for _, words, _ in TEMPLATES for w in words})


def _idf(n: int, df):
    return math.log((1 + n) / (1 + df)) + 1


def _demand(words: Counter, idf: dict[str, float], light: float) -> tuple[tuple[str, ...], int]:
    """The heaviest words of a template, and how many of them a match holds at least, if the others hold ``light`` of its square."""
    square = {w: (k * idf[w]) ** 2 for w, k in words.items()}
    whole = left = sum(square.values())
    heavy = []
    for w in sorted(square, key=lambda w: (-square[w], w)):
        if left < light * whole:
            break
        heavy.append(w)
        left -= square[w]
    missing, least = LEAST**2 * whole * 0.999 - left, 0
    for w in heavy:
        if missing <= 0:
            break
        missing -= square[w]
        least += 1
    return tuple(heavy), max(least, 1)


def _demands(words: Counter, marks: frozenset, idf: dict[str, float]) -> tuple:
    """Conditions that a match meets, the first one on single words that it holds one of."""
    if marks:
        return ((max(sorted(marks), key=lambda w: idf[w]),), 1), (tuple(sorted(marks)), len(marks))
    return tuple(_demand(words, idf, light) for light in LIGHT)


def _words(texts: list[str]) -> Column:
    return F.array(*map(F.lit, texts))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _once(value: Column) -> Column:
    """The value as a generated column, which a filter above reads and does not compute again."""
    return F.explode_outer(F.array(value))


def _runs(lines: DataFrame, lengths: DataFrame) -> DataFrame:
    """``__id, s, e, size``: from each line shorter than ``size`` words, the shortest run of at least so many
    (or to the end).  ``lengths``: the sizes asked for by text."""
    asked = lines.join(lengths, "__id").where("n < size")
    starts = asked.select("__id", "size", F.lit(1).alias("kind"), (F.col("upto") - F.col("n") + F.col("size")).alias("at"), F.col("pos").alias("s"),
                          F.col("seen").alias("before"), F.lit(None).cast("struct<pos:int,seen:long>").alias("end"))
    stops = lines.join(asked.select("__id", "size").distinct(), "__id").select(
        "__id", "size", F.lit(0).alias("kind"), F.col("upto").alias("at"), F.lit(None).cast("int").alias("s"),
        F.lit(None).cast("long").alias("before"), F.struct("pos", (F.col("seen") + F.col("hit")).alias("seen")).alias("end"))
    down = Window.partitionBy("__id", "size").orderBy(F.col("at").desc(), "kind")
    whole = Window.partitionBy("__id", "size").orderBy(F.col("at").desc(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = starts.unionByName(stops).select("*", F.last("end", ignorenulls=True).over(whole).alias("last"),
                                            F.first("end", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("final"))
    both = both.where("kind = 1").select("__id", "s", "size", "before", F.coalesce("last", "final").alias("last"))
    return both.where("last.seen > before and last.pos > s").select("__id", "s", F.col("last.pos").alias("e"), "size")


def _notices(texts: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """``__id, best: struct<order, name>, whole`` of every text (``__id, text``) with a notice."""
    spark = texts.sparkSession
    known = {r["word"]: r["df"] for r in counts.where(F.col("word").isin(VOCABULARY)).collect()}  # one row per template word at most
    idf = {w: _idf(n, known.get(w, 0)) for w in VOCABULARY}
    demands = [_demands(words, marks, idf) for _, words, marks in TEMPLATES]
    wanted = sorted({w for several in demands for words, _ in several for w in words})
    signs = sorted({w for several in demands for w in several[0][0]})
    # Templates of the same demands are asked for once.
    fits: dict[tuple, set[int]] = {}
    for (_, words, _), several in zip(TEMPLATES, demands):
        fits.setdefault(several, set()).add(sum(words.values()))
    held = {key: reduce(Column.__and__, (F.size(F.array_intersect(F.col("held"), _words(list(words)))) >= least for words, least in key)) for key in fits}
    split = F.split(F.lower("text"), _SPLIT)
    chosen = (texts.select("__id", "text", _once(F.array_intersect(split, _words(wanted))).alias("held"))
              .where(F.arrays_overlap("held", _words(signs))).where(reduce(Column.__or__, held.values())).dropDuplicates(["__id"]))
    sizes = F.array_distinct(F.flatten(F.array(*(F.when(held[key], F.array(*map(F.lit, sorted(lengths)))).otherwise(
        F.expr("cast(array() as array<int>)")) for key, lengths in fits.items()))))
    # Texts are dealt once, by the choice of one row of each; their lines are numbered in the same task.
    each = chosen.select("__id", sizes.alias("sizes"), F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "raw"))
    each = each.select("__id", "sizes", "line", _once(F.array_remove(F.split("raw", _SPLIT), "")).alias("words")).where(F.size("words") > 0)
    order = Window.partitionBy("__id").orderBy("line")
    each = each.select("__id", "sizes", "line", "words", F.size("words").alias("n"), F.arrays_overlap("words", _words(signs)).cast("long").alias("hit"))
    known = F.filter("words", lambda w: w.isin(VOCABULARY))
    # A line travels as one string, less than half the size of an array of its words.
    lines = each.select("__id", "sizes", F.array_join("words", " ").alias("said"), known.alias("known"), "n", "hit", (F.row_number().over(order) - 1).alias("pos"), F.sum("n").over(order).alias("upto"),
                        (F.sum("hit").over(order) - F.col("hit")).alias("seen"))
    lines = stored(lines.withColumn("sizes", F.when(F.col("pos") == 0, F.col("sizes"))))
    flat = lines.drop("sizes", "said", "known")
    ends = flat.groupBy("__id").agg(F.max("pos").alias("e"))
    single = flat.where("hit = 1").join(ends, "__id").select("__id", F.col("pos").alias("s"), F.col("pos").alias("e"), F.lit(0).alias("size"),
                                                              (F.col("e") == 0).alias("whole"))
    whole = ends.where("e > 0").select("__id", F.lit(0).alias("s"), "e", F.lit(0).alias("size"), F.lit(True).alias("whole"))
    several = _runs(flat, lines.where("pos = 0").select("__id", F.explode("sizes").alias("size"))).withColumn("whole", F.lit(False))
    span = ["__id", "s", "e", "size", "whole"]
    spans = stored(single.unionByName(whole).unionByName(several))
    rows, info, meant = [], [], {}
    for t, ((licence, words, marks), several) in enumerate(zip(TEMPLATES, demands)):
        length = math.sqrt(sum((k * idf[w]) ** 2 for w, k in words.items()))
        rows += [{"word": w, "t": t, "part": k * idf[w] / length, "idf": idf[w], "mark": int(w in marks), "length": sum(words.values())}
                 for w, k in words.items()]
        info.append({"t": t, "name": licence, "marks": len(marks)})
        for w in several[0][0]:
            meant.setdefault(w, []).append(t)
    weights = F.broadcast(_table(spark, rows, "word:string,t:int,part:double,idf:double,mark:int,length:int"))  # fixed templates
    names = F.broadcast(_table(spark, info, "t:int,name:string,marks:int"))
    # Template words alone give the dot product, and a bound of the cosine: every other word weighs 1 at least.
    # All of this stays in the task of the span.
    bags = _content(spans, lines.select("__id", "pos", "n", "known"), span).groupBy(*span).agg(
        F.sum("n").alias("total"), F.flatten(F.collect_list("known")).alias("bag"))
    map_of = F.from_json(F.lit(json.dumps(meant)), "map<string,array<int>>")
    ts = F.array_distinct(F.flatten(F.transform(F.array_intersect("bag", _words(signs)), lambda w: F.element_at(map_of, w))))
    tf = (bags.select(*span, "total", "bag", F.explode(ts).alias("t")).select(*span, "total", "t", F.explode("bag").alias("word"))
          .groupBy(*span, "total", "t", "word").agg(F.count("*").alias("tf")).join(weights, ["word", "t"]).where("size = 0 or size = length"))
    x = F.col("tf") * F.col("idf")
    dots = tf.groupBy(*span, "total", "t").agg(F.sum(x * F.col("part")).alias("dot"), F.sum(x * x).alias("own"),
                                               F.sum("mark").alias("held"), F.sum("tf").alias("shared"))
    likely = F.col("dot") >= LEAST * 0.999 * F.sqrt(F.col("own") + F.col("total") - F.col("shared"))
    near = stored(dots.join(names, "t").where("held = marks").where(likely))
    content = _content(near.select(*span).distinct(), lines.select("__id", "pos", "said"), span)
    each = content.select(*span, F.explode(F.split("said", " ")).alias("word")).groupBy(*span, "word").agg(F.count("*").alias("tf"))
    x = F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    norms = each.join(counts, "word").groupBy(*span).agg(F.sqrt(F.sum(x * x)).alias("norm"))
    scored = near.join(norms, span).select(
        "__id", (F.col("whole") & (F.col("shared") == F.col("total"))).alias("whole"), "name", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"))
    scored = scored.where(F.col("cosine") >= LEAST)
    return scored.groupBy("__id").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "name")).alias("best"), F.max("whole").alias("whole"))


def _content(spans: DataFrame, lines: DataFrame, span: list[str]) -> DataFrame:
    """The lines of every span."""
    return spans.select(*span, F.explode(F.sequence("s", "e")).alias("pos")).join(lines, ["__id", "pos"])


def _ancestors(directory: Column) -> Column:
    """The directory and those above it, the nearest first; the root is empty."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``path``, the columns ``keep`` (of any name), ``own_license``, ``cosine`` (0 without a match), ``license``, ``inherited_from``.

    Whole texts are judged.  Null text is empty; a null path has no directory
    and inherits nothing; repeated rows are each judged; ties go to the smaller name; an empty
    table gives no rows."""
    boxed = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("boolean")
    rows = files.select("path", boxed.alias("__keep"), whole_text().alias("text")).withColumn("__id", F.md5(F.col("text").cast("binary")))
    once = F.array_remove(F.array_distinct(F.split(F.lower("text"), _SPLIT)), "")
    counts = stored(rows.select(F.explode_outer(once).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("df")))
    notices = stored(_notices(rows.select("__id", "text"), counts, files.count()))
    judged = rows.select("path", "__keep", "__id").join(notices, "__id", "left").select(
        "path", "__keep", (-F.col("best.order")).alias("cosine"), F.col("best.name").alias("own_license"),
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("__dir"), F.coalesce("whole", F.lit(False)).alias("__whole"))
    judged = stored(judged)
    speaks = judged.where("own_license is not null").where(F.col("path").rlike(LICENSE_FILE) | F.col("__whole"))
    holders = speaks.groupBy("__dir").agg(F.min(F.struct(-F.col("cosine"), "own_license")).alias("m")).select(
        F.col("__dir").alias("__above"), F.col("m.own_license").alias("__license"))
    # Directories, not files, meet their ancestors.
    above = judged.where("path is not null").select("__dir").distinct().select("__dir", F.posexplode(_ancestors(F.col("__dir"))).alias("__up", "__above"))
    nearest = above.join(holders, "__above").groupBy("__dir").agg(F.min(F.struct("__up", "__above", "__license")).alias("__n"))
    out = judged.join(nearest, "__dir", "left")
    inherits = F.col("own_license").isNull() & F.col("path").isNotNull()
    return out.select("path", *(F.col("__keep").getField(c).alias(c) for c in keep), "own_license", F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
                      F.coalesce("own_license", F.when(inherits, F.col("__n.__license"))).alias("license"),
                      F.when(inherits, F.col("__n.__above")).alias("inherited_from"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan(read_table(spark, sf_dir, "documents").withColumn("path", path), ("doc_id",))
