"""Wrappers of hosts: template texts, copies, inference in rounds, odd tables."""

import random

from headroom.llm import html

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def texts(spark, rows, schema=SCHEMA):
    got = html.main_text(spark.createDataFrame(rows, schema)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return {r["page_id"]: r["text"] for r in got}


def site(rng, n, host="s.example"):
    """Pages of plain ``div`` elements, with what each page says itself."""
    rows, own = [], {}
    for k in range(n):
        said = [words(rng, 30) for _ in range(rng.randint(1, 6))]
        tip = "<section>Read this too</section>" if k % 3 == 0 else ""
        rows.append((k, f"http://{host}/{k}", "<body><div>Welcome to our site</div><div>" + "".join(f"<p>{x}</p>" for x in said)
                     + f"</div>{tip}<div>All rights reserved</div></body>"))
        own[k] = "\n".join(said)
    return rows, own


def test_text_of_the_template_is_left_out(spark):
    rows, own = site(random.Random(1), 20)
    assert texts(spark, rows) == own
    alone = {k: html.extract(page, None) for k, _, page in rows}
    assert all(alone[k] != own[k] and "All rights reserved" in alone[k] for k in own)


def test_a_host_is_judged_by_its_own_pages(spark):
    rows, own = site(random.Random(2), 9)
    other = [(100, "http://other.example/", rows[0][2]), (101, "http://two.example/1", rows[0][2]), (102, "http://two.example/2", rows[1][2])]
    got = texts(spark, rows + other)
    assert {k: got[k] for k in own} == own
    assert all("All rights reserved" in got[k] for k in (100, 101, 102))


def test_copies_of_an_article_are_no_template(spark):
    rng = random.Random(3)
    body = "".join(f"<p>{words(rng, 40)}</p>" for _ in range(4))
    rows = [(k, f"http://c.example/{k}", f"<body><div>Note {k % 7}</div><div>{body}</div></body>") for k in range(40)]
    assert all(t.count("\n") == 4 for t in texts(spark, rows).values())


def test_text_in_an_article_is_no_template(spark):
    rng = random.Random(4)
    rows = [(k, f"http://d.example/{k}", f"<body><div>Menu</div><article><p>Our motto</p><p>{words(rng, 20)}</p></article></body>") for k in range(9)]
    assert all(t.startswith("Our motto\n") and "Menu" not in t for t in texts(spark, rows).values())


def test_pages_of_template_text_only_keep_it(spark):
    rows, own = site(random.Random(5), 9)
    got = texts(spark, rows + [(50, "http://s.example/x", "<body><div>Welcome to our site</div><div>All rights reserved</div></body>")])
    assert got.pop(50) == "Welcome to our site\nAll rights reserved" and got == own


def test_wrappers_merge_in_rounds(spark):
    """More streams than one group holds, of different block orders."""
    rng, rows, own = random.Random(6), [], {}
    for k in range(150):
        said = [(rng.choice(["p", "h2", "blockquote", "pre", "h3"]), words(rng, 12)) for _ in range(8)]
        rows.append((k, f"http://many.example/{k}", "<body><div>Our site</div>" + "".join(f"<{t}>{x}</{t}>" for t, x in said) + "</body>"))
        own[k] = "\n".join(x for _, x in said)
    streams = {str(html.fold(html.parse(r[2])[0])) for r in rows}
    assert len(streams) > 2 * html.GROUP
    assert texts(spark, rows) == own


def test_a_wrapper_covers_its_streams():
    rng = random.Random(7)
    streams = [html.fold(rng.choices(["<p", "#", "/p", "<ul", "<li", "/li", "/ul"], k=30)) for _ in range(12)]
    flat = html._flat(html.infer([html.infer(streams[:6]), html.infer(streams[6:])]))
    for s in streams:
        assert len(html.align(html._flat(s), flat)) == len(html._flat(s))


def test_places_of_a_folded_stream():
    rng = random.Random(8)
    for _ in range(300):
        seq = rng.choices(["<a1", "#", "/a1"], k=rng.randint(0, 40))
        shape, places = html.folded(seq)
        flat = html._flat(shape)
        assert [seq[p[0]] for p in places] == flat and all({seq[k] for k in p} == {key} for p, key in zip(places, flat))
        assert sorted(k for p in places for k in p) == list(range(len(seq)))


def test_odd_tables(spark):
    assert texts(spark, []) == {}
    long = "<p>" + "word " * 400_000 + "</p>"
    many = "<body>" + "".join(f"<p>line {k}</p>" for k in range(5000))
    rows = [(1, "http://a/1", long, 7), (2, "http://a/2", many, 7), (2, "http://a/2", many, 7), (None, None, None, None), (3, "http://a/3", "", 7)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host int").selectExpr(
        "*", "1 AS wrapper", "'x' AS stream", "2 AS n", "'y' AS text", "3 AS bucket", "4 AS constant")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html.main_text(frame).collect())
    assert got == [(0, 0), (1, 1_999_999), (2, 48_889), (2, 48_889), (3, 0)]
