"""Main text of web pages by wrapper inference.

Per host, the tag streams of its pages are aligned into one union-free regular expression:
neighbouring repeats fold into repeated groups, tags that only some pages have become optional
groups, and text becomes slots.  A slot is main text or not by where it stands in the wrapper
and by the texts it holds over the host's pages: a text that comes back in the same slot page
after page belongs to the template, not to the page.  A page is then aligned with its host's
wrapper and the text in main slots is kept, without template texts.

A text is template if its slot holds it on at least LEAST_PAGES pages, and on at least half of
the pages that have the slot.  Pages with the same longest block count as one, so copies of an
article do not make a template of it.  Text inside ``article`` or ``main`` is never template,
and a page that would have no text left keeps what its slots alone decide.

Scale: pages are reduced to counted, folded tag streams by partial aggregation, so a host with
a third of all pages sends each different stream once; inference sees streams, never pages, in
groups of about GROUP that are merged in rounds.  Texts of slots are counted by grouped
aggregations over (host, slot, text).  Pages meet their host's wrapper in a join that AQE may
split, and are parsed one at a time.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import operator
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)"
                   r"|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# Elements by their meaning in HTML.  Fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
BESIDE = frozenset("head nav footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
#: Words of a class, id or role that mark an element as beside the main text.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|footer|side-?bar|cookies?|"
                   r"consent|notice|alert|popup|modal|newsletter|subscribe|comments?|replies|respond|related|share|social|login|search)"
                   r"(?:$|[\s_-])", re.I)
LONGEST_GROUP, ROUNDS = 8, 4
#: Streams merged in one task of a round of the inference (mean).
GROUP = 32
LEAST_PAGES = 3
#: Items of aligned streams that a task keeps for pages to come.
REMEMBERED = 1_000_000


@lru_cache(maxsize=4096)
def _start(name: str, attributes: str) -> str:
    marks = " ".join(x.strip("\"'") for x in CLASS.findall(attributes)) if "=" in attributes else ""
    return f"<{name} {marks}".rstrip()


def parse(page: str) -> tuple[list[str], list[str]]:
    """Structure of a page in page order, ``<name class`` and ``/name`` for block tags and one slot ``#`` for the text
    between them, and the raw text of each slot (empty for tags)."""
    keys, texts, current = [], [], []

    def close() -> None:
        text = "".join(current)
        if text and not text.isspace():
            keys.append("#")
            texts.append(text)
        current.clear()

    for m in TOKEN.finditer(page):
        name = m[3]
        if name:
            name = name.lower()
            if name not in INLINE:
                close()
                keys.append("/" + name if m[2] else _start(name, m[4]))
                texts.append("")
            elif name == "br" and not m[2]:
                current.append(" ")
        elif m[0][0] != "<" or len(m[0]) == 1:
            current.append(m[0])
    close()
    return keys, texts


def _name(key: str) -> str:
    return key[1:].split(" ", 1)[0]


def _decoded(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def folded(seq: list[str]) -> tuple[list, list[list[int]]]:
    """Folded stream, in which neighbouring repeats of up to LONGEST_GROUP items are ``["+", group]``, and the places in
    ``seq`` of each of its flat items (all repeats of a group under its first)."""
    numbers: dict = {}
    shapes: list = []

    def number(shape) -> int:
        if shape not in numbers:
            numbers[shape] = len(shapes)
            shapes.append(shape)
        return numbers[shape]

    def unfolded(n: int):
        return shapes[n] if isinstance(shapes[n], str) else ["+", [unfolded(x) for x in shapes[n]]]

    slot = number("#")
    keys, places = [number(x) for x in seq], [[[k]] for k in range(len(seq))]
    for _ in range(ROUNDS):
        before = len(keys)
        for width in range(1, LONGEST_GROUP + 1):
            if not any(map(operator.eq, keys, keys[width:])):
                continue
            out, kept, k = [], [], 0
            while k < len(keys):
                n, group = 1, keys[k:k + width]
                if k + width < len(keys) and keys[k] == keys[k + width]:
                    while keys[k + n * width:k + (n + 1) * width] == group:
                        n += 1
                if n > 1 and group != [slot]:
                    out.append(group[0] if width == 1 and not isinstance(shapes[group[0]], str) else number(tuple(group)))
                    kept.append([[x for part in same for x in part] for w in range(width)
                                 for same in zip(*places[k + w:k + n * width:width])])
                    k += n * width
                else:
                    out.append(keys[k])
                    kept.append(places[k])
                    k += 1
            keys, places = out, kept
        if len(keys) == before:
            break
    return [unfolded(n) for n in keys], [flat for item in places for flat in item]


def fold(seq: list[str]) -> list:
    """Neighbouring repeats of up to LONGEST_GROUP items become ``["+", group]``."""
    return folded(seq)[0]


def _bare(item):
    while isinstance(item, list) and item[0] == "?" and len(item[1]) == 1:
        item = item[1][0]
    return item


def _regroup(seq: list, groups: list) -> list:
    """Single occurrences of the other side's repeated groups, as groups."""
    for group in groups:
        body, out, k = group[1], [], 0
        while k < len(seq):
            if seq[k:k + len(body)] == body:
                out.append(group)
                k += len(body)
            else:
                out.append(seq[k])
                k += 1
        seq = out
    return seq


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence (optional marks aside)."""
    x, y = ([i if isinstance(i, str) else json.dumps(_bare(i)) for i in side] for side in (a, b))
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    high = 0
    while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
        high += 1
    m, n = len(x) - high, len(y) - high
    best = [[0] * (n - low + 1) for _ in range(m - low + 1)]
    for i in range(m - 1, low - 1, -1):
        row, below = best[i - low], best[i - low + 1]
        for j in range(n - 1, low - 1, -1):
            row[j - low] = below[j - low + 1] + 1 if x[i] == y[j] else max(below[j - low], row[j - low + 1])
    pairs, i, j = [(k, k) for k in range(low)], low, low
    while i < m and j < n:
        if x[i] == y[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i - low + 1][j - low] >= best[i - low][j - low + 1]:
            i += 1
        else:
            j += 1
    return pairs + [(m + k, n + k) for k in range(high)]


def merge(wrapper: list, seq: list) -> list:
    """The wrapper widened to cover another folded stream: mismatches become optional or repeated groups."""
    seq = _regroup(seq, [g for g in map(_bare, wrapper) if isinstance(g, list)])
    wrapper = _regroup(wrapper, [g for g in map(_bare, seq) if isinstance(g, list)])
    out, i, j = [], 0, 0

    def optional(items: list) -> None:
        out.extend(x if isinstance(x, list) and x[0] == "?" else ["?", [x]] for x in items)

    for p, q in [*align(wrapper, seq), (len(wrapper), len(seq))]:
        optional(wrapper[i:p])
        optional(seq[j:q])
        if p < len(wrapper):
            either = [x for x in (wrapper[p], seq[q]) if isinstance(x, list) and x[0] == "?"]
            out.append(either[0] if either else wrapper[p])
        i, j = p + 1, q + 1
    return out


def _flat(items: list) -> list[str]:
    return [k for x in items for k in (_flat(x[1]) if isinstance(x, list) else [x])]


@lru_cache(maxsize=4096)
def _element(key: str) -> tuple[str, bool, bool, bool]:
    name = _name(key)
    return name, name in VOID, name in BESIDE or bool(MARKS.search(key[1:].partition(" ")[2])), name in MAIN


def _context(keys: list[str]) -> list[tuple[bool, bool]]:
    """For each key, whether it stands inside an element beside the main text, and inside a main element."""
    out, stack, state = [], [], (False, False)
    for key in keys:
        if key[0] == "<":
            name, void, beside, main = _element(key)
            if not void:
                stack.append((name, state))
                state = (state[0] or beside or (name == "header" and not state[1]), state[1] or main)
        elif key[0] == "/":
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == key[1:]), None)
            if at is not None:
                state = stack[at][1]
                del stack[at:]
        out.append(state)
    return out


def _main(context: list[tuple[bool, bool]]) -> list[bool]:
    has_main = any(m for _, m in context)
    return [not beside and (main or not has_main) for beside, main in context]


def infer(streams: list[list]) -> list:
    """Wrapper of folded streams or of wrappers (most frequent first)."""
    wrapper = streams[0]
    for seq in streams[1:]:
        wrapper = merge(wrapper, seq)
    return wrapper


class Wrapper:
    """A host's wrapper: its flat items, which of them are main text, and the template texts of its slots."""

    def __init__(self, items: list, constant: list[tuple[int, str]] = ()):
        self.flat = _flat(items)
        self.main = _main(_context(self.flat))
        # A template text may stand in another template slot where a page's blocks fold differently.
        self.template_slots = {q for q, _ in constant}
        self.template_texts = {text for _, text in constant}
        self.known: dict[tuple, dict[int, int]] = {}
        self.remembered = 0

    def slots(self, own: list[str]) -> dict[int, int]:
        """Place in the wrapper of each aligned slot of a flat stream."""
        key = tuple(own)
        found = self.known.get(key)
        if found is None:
            found = {p: q for p, q in align(own, self.flat) if own[p] == "#"}
            if self.remembered + len(own) > REMEMBERED:
                self.known.clear()
                self.remembered = 0
            self.known[key] = found
            self.remembered += len(own)
        return found


def extract(page: str, wrapper: Wrapper | None) -> str:
    """Text of the page's main slots; without a wrapper the page is its own."""
    seq, texts = parse(page)
    context = _context(seq)
    keep = _main(context)
    at: dict[int, int] = {}
    if wrapper:
        # A place that the wrapper knows is judged by the wrapper: a page with a broken tag follows its host.
        _, places = folded(seq)
        for p, q in wrapper.slots([seq[k[0]] for k in places]).items():
            for place in places[p]:
                keep[place] = wrapper.main[q] and not context[place][0]
                at[place] = q
    lines = [(k, _decoded(texts[k])) for k, key in enumerate(seq) if key == "#" and keep[k]]
    lines = [(k, x) for k, x in lines if x]
    if wrapper and wrapper.template_slots:
        own = [(k, x) for k, x in lines
               if context[k][1] or at.get(k) not in wrapper.template_slots or _digest(x) not in wrapper.template_texts]
        lines = own or lines
    return "\n".join(x for _, x in lines)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for host, page in zip(*(c.to_pylist() for c in batch.columns)):
            seq, texts = parse(page)
            shape, places = folded(seq)
            context = _context(seq)
            slots, longest = set(), ""
            for own, same in enumerate(places):
                for k in same if seq[same[0]] == "#" else ():
                    if not any(context[k]) and (text := _decoded(texts[k])):
                        slots.add((own, _digest(text)))
                        longest = max(longest, text, key=lambda x: (len(x), x))
            found[host, json.dumps(shape), _digest(longest) if slots else "", tuple(sorted(slots))] += 1
        columns = [[k[c] for k in found] for c in range(4)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.string()) for c in columns[:3]), pa.array([[x[0] for x in slots] for slots in columns[3]], pa.list_(pa.int32())),
             pa.array([[x[1] for x in slots] for slots in columns[3]], pa.list_(pa.string())), pa.array(list(found.values()), pa.int64())],
            ["host", "stream", "page", "own", "text", "n"])


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    ordered = frame.sort_values(["n", "stream"], ascending=[False, True])["stream"].map(json.loads).tolist()
    return pd.DataFrame({"host": frame["host"].iloc[:1], "stream": [json.dumps(infer(ordered))], "n": [int(frame["n"].sum())]})


def wrappers(streams: DataFrame) -> DataFrame:
    """``host, stream``: the wrapper of each host's counted streams (``host, stream, n``), merged in rounds of bounded groups."""
    while True:
        sizes = streams.groupBy("host").agg(F.count("*").alias("size"))
        if (sizes.agg(F.max("size")).first()[0] or 0) <= 1:
            return streams.select("host", "stream")
        grouped = streams.join(sizes, "host").withColumn("bucket", F.pmod(F.xxhash64("stream"), F.ceil(F.col("size") / GROUP)))
        streams = stored(grouped.select("host", "bucket", "stream", "n").groupBy("host", "bucket")
                         .applyInPandas(_merged, "host string, stream string, n long"))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Wrapper] = {}
    for batch in batches:
        out = []
        for host, stream, text in zip(*(batch.column(c).to_pylist() for c in ("host", "stream", "wrapper"))):
            if text not in known:
                known = {} if len(known) > 1000 else known
                known[text] = Wrapper(json.loads(text))
            out.extend((host, stream, p, q) for p, q in known[text].slots(_flat(json.loads(stream))).items())
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()))],
                                         ["host", "stream", "own", "place"])


def templates(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """``host, constant``: the template texts of each host's wrapper, as pairs of slot and digest."""
    open_slots = parsed.where(F.size("own") > 0)
    places = (open_slots.select("host", "stream").distinct().join(found.withColumnRenamed("stream", "wrapper"), "host")
              .mapInArrow(_aligned, "host string, stream string, own int, place int"))
    texts = open_slots.select("host", "stream", "page", F.explode(F.arrays_zip("own", "text")).alias("slot"))
    seen = stored(texts.select("host", "stream", "page", "slot.own", "slot.text").join(places, ["host", "stream", "own"])
                  .select("host", "place", "text", "page").distinct())
    by_place = seen.select("host", "place", "page").distinct().groupBy("host", "place").agg(F.count("*").alias("pages"))
    by_text = seen.groupBy("host", "place", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    return (by_text.join(by_place, ["host", "place"]).where(2 * F.col("n") >= F.col("pages"))
            .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("constant")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Wrapper] = {}
    for batch in batches:
        texts = []
        for page, text in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            if text is not None and text not in known:
                known = {} if len(known) > 1000 else known
                both = json.loads(text)
                known[text] = Wrapper(json.loads(both["stream"]), [(x["place"], x["text"]) for x in both.get("constant") or ()])
            texts.append(extract(page, known.get(text)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null html is empty and gives an empty text.  Pages without a url share one wrapper; null and
    repeated ids are rows of their own; other columns are ignored; an empty table gives no rows."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    parsed = stored(rows.select("host", "html").mapInArrow(
        _parsed, "host string, stream string, page string, own array<int>, text array<string>, n long"))
    found = wrappers(stored(parsed.groupBy("host", "stream").agg(F.sum("n").alias("n"))))
    judged = stored(found.join(templates(parsed, found), "host", "left").select("host", F.to_json(F.struct("stream", "constant")).alias("wrapper")))
    joined = rows.join(judged, "host", "left").select("page_id", "url", "html", "wrapper")
    kinds = dict(joined.dtypes)
    return joined.mapInArrow(_extract, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
