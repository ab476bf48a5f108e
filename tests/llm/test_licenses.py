"""License scan against the same definition written out in Python, and on common notices."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from headroom.llm import licenses
from headroom.llm.common import read_table, stored
from headroom.llm.license_texts import TEXTS

SF = "/root/testdata/sf0.001"


def wrapped(text, width, prefix=""):
    words, lines = text.split(), [""]
    for w in words:
        if len(lines[-1]) + len(w) > width:
            lines.append("")
        lines[-1] += w + " "
    return "\n".join(prefix + x for x in lines)


def full(licence, number=0):
    return [t for name, t in TEXTS if name == licence][number]


def brute(texts):
    """Best licence of each text: every line, every run of a template's length, the whole file."""
    held = [licenses.tokens(t) for t in texts]
    df, n = Counter(w for ws in held for w in set(ws)), len(texts)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1

    def cosine(words, template):
        tf = Counter(words)
        dot = sum(k * template.get(w, 0) * idf(w) ** 2 for w, k in tf.items())
        return dot / math.sqrt(sum((k * idf(w)) ** 2 for w, k in tf.items()) * sum((k * idf(w)) ** 2 for w, k in template.items()))

    out = []
    for text in texts:
        lines = [ws for ws in map(licenses.tokens, text.split("\n")) if ws]
        best = (0.0, None)
        for name, template, marks in licenses.TEMPLATES:
            spans = {(k, k) for k in range(len(lines))} | ({(0, len(lines) - 1)} if lines else set())
            for s in range(len(lines)):
                e, words = s, len(lines[s])
                while words < sum(template.values()) and e + 1 < len(lines):
                    e += 1
                    words += len(lines[e])
                spans.add((s, e))
            for s, e in spans:
                words = [w for line in lines[s:e + 1] for w in line]
                if marks <= set(words):
                    score = round(cosine(words, template), 9)
                    if score >= licenses.LEAST:
                        best = min(best, (-score, name), key=lambda b: (b[0], b[1] or ""))
        out.append(best)
    return out


def test_common_notices_are_found_and_match_brute_force(spark):
    plain = [r["text"] or "" for r in read_table(spark, SF, "documents").orderBy("doc_id").limit(40).collect()]
    gnu = wrapped(full("GPL-3.0"), 60, " * ")
    named = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(full("MIT"), 75)),
        ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software"
                    " Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document,"
                    " but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free,"
                    " copyleft license for\nsoftware and other kinds of works.\n" + plain[0]),
        ("GPL-3.0", "/*\n" + gnu + "\n */\nint main(void) { return 0; }\n" + plain[1]),
        ("MIT", "# Readme\n" + plain[2] + "\nThis project is released under the MIT License, see the file for details.\n"),
        ("MIT", "// SPDX-License-Identifier: MIT\npackage main\n" + plain[3]),
        ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-only\nimport os\n" + plain[4]),
        ("Apache-2.0", wrapped(full("Apache-2.0"), 70, "# ") + "\n" + plain[5]),
        ("BSD-3-Clause", "Copyright 2019\n" + wrapped(full("BSD-3-Clause"), 80)),
        ("BSD-2-Clause", wrapped(full("BSD-2-Clause"), 64, "// ") + "\nx = 1"),
        (None, "Released under the Foo License."), (None, "All rights reserved, see the license file for details."),
    ]
    texts = plain + [t for _, t in named] + ["", "\n\n", named[0][1]]
    random.Random(1).shuffle(texts)
    rows = [(f"d{k}/x", t, 1, 2, "k") for k, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "path string, text string, words int, total int, best string")
    got = {r["path"]: r for r in licenses.scan(files, ("words", "total", "best")).collect()}
    assert len(got) == len(texts)
    for k, (order, name) in enumerate(brute(texts)):
        r = got[f"d{k}/x"]
        assert (r["own_license"], r["words"], r["total"], r["best"]) == (name, 1, 2, "k") and abs(r["cosine"] + order) < 1e-8
    for name, text in named:
        assert got[f"d{texts.index(text)}/x"]["own_license"] == name, text[:80]


def test_long_repeated_and_tied_texts(spark):
    long = "\n".join(f"line {k} of the notice" for k in range(20_000)) + "\nReleased under the MIT License.\n" + "word " * 100_000
    rows = [("a/x", long), ("a/x", long), (None, long), ("b/LICENSE", "Licensed under the zlib License.\nLicensed under the ISC License."), ("b/c/y", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = sorted(((r["path"] or "", r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(files).collect()), key=str)
    assert [g[1] for g in got if g[0] in ("", "a/x")] == ["MIT"] * 3
    assert ("b/LICENSE", "ISC", "ISC", None) in got and ("b/c/y", None, "ISC", "b") in got
    plan = licenses.scan(files.limit(0))
    assert plan.count() == 0 and "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert licenses.scan(files.withColumn("n", F.lit(1)), ("n",)).columns[:2] == ["path", "n"]


def test_texts_are_dealt_once_and_lines_travel_as_strings(spark, monkeypatch):
    """Chosen texts are shuffled once on the way to their numbered lines, and no array of a line's words is written."""
    frames = []

    def spy(df):
        frames.append((df.schema, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df)

    monkeypatch.setattr(licenses, "stored", spy)
    texts = [wrapped(full("MIT"), 60), "nothing here\n\nat all", "SPDX-License-Identifier: MIT\nx = 1", None]
    rows = licenses.scan(spark.createDataFrame([(f"d/{k}", t) for k, t in enumerate(texts)], "path string, text string")).collect()
    assert {r["path"]: r["own_license"] for r in rows} == {"d/0": "MIT", "d/1": None, "d/2": "MIT", "d/3": None}
    wide = [(schema, plan) for schema, plan in frames if {"text", "seen"} & set(schema.names)]
    assert sum(plan.count("hashpartitioning(__id") for _, plan in wide) == 1
    assert all("words" not in schema.names for schema, _ in wide)
