"""Secret scan: fixed patterns, and a battery of randomness tests over other token-like strings.

Base spans come from three patterns.  Every other run of 20 or more token characters that
mixes letters and digits is tested, in its inferred encoding (digits, hex, base 32, base 36,
base 64): chi-squared uniformity of its alphabet, runs about the median, and lag-one serial
correlation, combined to one probability that a random string looks like this.  Which
probability counts as random is set per class of length and alphabet, so that the share of false finds,
measured on decoys, stays under ``FDR``.  Decoys are what ordinary text makes: runs of letters only,
and, as those are rare at greater lengths, the words of every whole text, joined and cut to the least
lengths of the classes in turn, and words of a fixed list, so that no class is without decoys however small the input.
Tokens of one case and of the wide alphabet are classes of their own: ordinary words look more even in 36 signs than in 64.

Only built-in expressions.  Whole texts are read twice, for spans and for decoys, without a shuffle; the
thresholds come from a table of counts of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored, whole_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (r"""(?=[PpSsTtAa])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"[A-Za-z0-9+/=_-]{20,}+"
FDR = 0.05
#: Length classes start here; probabilities are counted in steps of 1 / STEPS.
LENGTHS, STEPS = (20, 24, 32, 48), 20
#: A sum of squared scores from which the probability is under 1 / STEPS.
SURE = 8.5
#: Ordinary words, joined in an order of their own to REFERENCES decoys of each class.
WORDS = ("the of and to in is that for it was on are with as his they be at one have this from or had by hot but some what there we can out "
         "other were all your when up use word how said an each she which do their time if will way about many then them would write like so these "
         "her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people "
         "may down side been now find any new work part take get place made live where after back little only round man year came show every good").split()
REFERENCES = 60


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(text: Column, match: Column, pattern: str, kind: int) -> Column:
    """``array<struct<start, kind, end, match, value>>`` of ``match``, all matches of the pattern in the text, left to right."""
    value = F.transform(match, lambda m: F.regexp_extract(m, pattern, 2)) if kind == 0 else match
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start: long, kind: int, end: long, match: string, value: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"),
                       x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(match)).alias("gap"), match.alias("match"), value.alias("value"))
    walked = F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.size(match) > 0, walked).otherwise(empty)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _inside(tokens: Column, pattern: str, kind: int) -> Column:
    """The matches of a pattern of token characters only, at least as long as a token: each lies within one token."""
    def moved(token: Column) -> Column:
        return F.transform(_let(_matches(token["match"], pattern), lambda m: _places(token["match"], m, pattern, kind)), lambda s: F.struct(
            (token["start"] + s["start"]).alias("start"), s["kind"].alias("kind"), (token["start"] + s["end"]).alias("end"),
            s["match"].alias("match"), s["value"].alias("value")))

    return F.flatten(F.transform(tokens, moved))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation, error under 0.0002)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _cube_root_z(x: Column, df: Column) -> Column:
    """Normal score of a chi-squared value (Wilson and Hilferty)."""
    return (F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def randomness(token: Column) -> Column:
    """Probability that a random string of the token's encoding looks at least this uneven."""
    return _let(F.split(token, ""), lambda letters: _let(_rise(token, letters), lambda rise: _randomness(token, letters, rise)))


def _step(token: Column) -> Column:
    """``randomness`` in whole steps; the two tests of order are only made where the letters' shares alone do not give step 0."""
    return _let(F.split(token, ""), lambda letters: _let(_rise(token, letters), lambda rise: F.when(
        rise * rise >= SURE, 0).otherwise(F.floor(_randomness(token, letters, rise) * STEPS).cast("int"))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _rise(token: Column, letters: Column) -> Column:
    """Normal score of the letters' unevenness, 0 if they are more even than by chance."""
    n = F.length(token).cast("double")
    size = (F.when(token.rlike("^[0-9]+$"), 10).when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+=*$"), 32)
            .when(token.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36).otherwise(64).cast("double"))
    squares = F.aggregate(F.array_distinct(letters), F.lit(0.0),
                          lambda s, c: s + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    return _let(size, lambda size: F.greatest(_cube_root_z(F.greatest(size / n * squares - n, F.lit(0.01)), size - 1), F.lit(0.0)))


def _randomness(token: Column, letters: Column, rise: Column) -> Column:
    return _let(F.transform(letters, lambda c: F.ascii(c).cast("double")), lambda codes: _combined(F.length(token).cast("double"), codes, rise))


def _combined(n: Column, codes: Column, rise: Column) -> Column:
    """Sums of whole numbers, so that mean and spread are no inner loops; the median is found once."""
    last, most = (n - 1).cast("int"), F.size(codes)
    ahead, behind = F.slice(codes, F.lit(2), last), F.slice(codes, F.lit(1), last)

    def runs(middle: Column) -> Column:
        changes = _sum(F.zip_with(behind, ahead, lambda a, b: ((a >= middle) != (b >= middle)).cast("double")))
        return _let(F.size(F.filter(codes, lambda c: c >= middle)).cast("double"), lambda ones: _let(
            2 * ones * (n - ones) / n, lambda e: (changes - e) / F.sqrt(F.greatest(e * (e - 1) / (n - 1), F.lit(0.25)))))

    def serial(total: Column) -> Column:
        spread = (n * F.aggregate(codes, F.lit(0.0), lambda s, x: s + x * x) - total * total) / n
        lagged = (n * n * _sum(F.zip_with(behind, ahead, lambda a, b: a * b))
                  - n * total * (2 * total - F.get(codes, F.lit(0)) - F.get(codes, most - 1)) + (n - 1) * total * total) / (n * n)
        return (lagged / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)

    return _let(_let(F.get(F.sort_array(codes), F.floor(n / 2).cast("int")), runs), lambda r: _let(_let(_sum(codes), serial), lambda c: (
        _normal_tail(_let(F.greatest(rise * rise + r * r + c * c, F.lit(0.01)), lambda x: _cube_root_z(x, F.lit(3.0)))))))


def _length_class(token: Column) -> Column:
    """Twice the number of the length in LENGTHS, and one more in the wide alphabet."""
    found = F.lit(0)
    for k, low in enumerate(LENGTHS):
        found = F.when(F.length(token) >= low, 2 * k).otherwise(found)
    return found + (~token.rlike("^([a-z0-9]+|[A-Z0-9]+=*)$")).cast("int")


def _reference() -> list[str]:
    """REFERENCES strings of the least length of each class, of WORDS in a fixed order: small, then with capital initials."""
    at, out = 0, []
    for low in LENGTHS:
        for _ in range(REFERENCES):
            joined = []
            while sum(map(len, joined)) < low:
                at += 1
                joined.append(WORDS[at * at * 31 % 1009 % len(WORDS)])
            out += ["".join(joined)[:low], "".join(map(str.capitalize, joined))[:low]]
    return out


def _joined(text: Column) -> Column:
    """The letters of all words of the text, joined and cut to the lengths of LENGTHS in turn, by turns in small letters
    and with capital initials.  Token-like runs are no words; only a rest too short for any class is in no string."""
    words = F.initcap(F.regexp_replace(F.regexp_replace(text, TOKEN, " "), "[^A-Za-z]+", " "))
    rounds = F.regexp_extract_all(F.replace(words, F.lit(" "), F.lit("")), F.lit(f".{{1,{sum(LENGTHS)}}}"), F.lit(0))

    def cut(letters: Column, number: Column) -> Column:
        strings = [F.substring(letters, sum(LENGTHS[:k]) + 1, low) for k, low in enumerate(LENGTHS)]
        return F.array(*(F.when((number + k) % 2 == 0, F.lower(one)).otherwise(one) for k, one in enumerate(strings)))

    return F.filter(F.flatten(F.transform(rounds, cut)), lambda one: F.length(one) >= LENGTHS[0])


def _decoys(strings: DataFrame) -> DataFrame:
    """``length_class, decoy, step`` of every string ``w``."""
    return strings.select(_length_class(F.col("w")).alias("length_class"), F.lit(1).alias("decoy"), _step(F.col("w")).alias("step"))


def _thresholds(counts: list) -> dict[int, int]:
    """Per length class the lowest step at which the estimated share of false finds is at most FDR."""
    out = {}
    for k in range(2 * len(LENGTHS)):
        own = [[0] * (STEPS + 1), [0] * (STEPS + 1)]
        for row in counts:
            if row["length_class"] == k:
                own[row["decoy"]][row["step"]] += row["n"]
        for step in range(1, STEPS + 1):
            found, false = sum(own[0][step:]), sum(own[1][step:])
            if found and (false + 1) / (sum(own[1]) + 1) * sum(own[0]) / found <= FDR:
                out[k] = step
                break
    return out


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns ``keep`` and ``found: array<struct<start, kind, end>>`` of every row, by start and kind.

    ``kind`` numbers ``KINDS``; starts and ends count code points, ends are exclusive.  A null
    or empty text has no spans; ``with_text`` adds ``__text``, the text that was scanned; repeated rows are scanned each; other columns are ignored."""
    carried = [*keep, *["__text"] * with_text]
    text = F.col("__text")
    # Long matches are few: places are looked for only in the texts that have any, hex runs and access keys only inside tokens.
    matched = docs.select(*keep, whole_text().alias("__text")).select(
        *keep, "__text", _matches(text, ASSIGN).alias("__a"), _matches(text, TOKEN).alias("__t"))
    places = matched.select(*carried, _places(text, F.col("__a"), ASSIGN, 0).alias("a"), _places(text, F.col("__t"), TOKEN, 3).alias("t"))
    places = places.select(*carried, "a", "t", _inside(F.col("t"), ACCESS, 1).alias("k"), _inside(F.col("t"), HEX, 2).alias("h"))
    base = F.filter(F.concat("a", "k", "h"), lambda s: (s["kind"] > 0) | (F.length(s["value"]) >= 6))
    tried = (places.select(*carried, F.transform(base, lambda s: s.dropFields("match", "value")).alias("base"), F.col("t"))
             .withColumn("t", F.transform("t", lambda s: F.struct(
                 s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                 _length_class(s["match"]).alias("length_class"),
                 s["match"].rlike("^[A-Za-z]+$").cast("int").alias("decoy"),
                 (s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]")).alias("mixed"),
                 _step(s["match"]).alias("step")))))
    tried = stored(tried)
    spark = docs.sparkSession
    each = tried.select(F.explode("t").alias("x")).where("x.decoy = 1 or x.mixed").select("x.length_class", "x.decoy", "x.step")
    words = docs.select(F.explode(_joined(whole_text())).alias("w"))
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, _reference()))).alias("w"))
    each = each.unionByName(_decoys(words)).unionByName(_decoys(listed))
    counts = each.groupBy("length_class", "decoy", "step").agg(F.count("*").alias("n")).collect()  # 8 * 2 * 21 rows at most
    least = _thresholds(counts)
    bar = F.lit(STEPS + 1)
    passed = F.filter("t", lambda s: s["mixed"] & (s["step"] >= _bar(s["length_class"], least, bar)))
    # A tested run that only repeats a base span (or lies within one) adds nothing.
    new = F.filter(passed, lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    spans = F.array_sort(F.concat("base", F.transform(new, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    return tried.select(*carried, spans.alias("found"))


def _bar(length_class: Column, least: dict[int, int], none: Column) -> Column:
    out = none
    for k, step in least.items():
        out = F.when(length_class == k, step).otherwise(out)
    return out


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] < 3)

    def number(kind: int) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *map(number, range(4)), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(found).alias("spans"))
