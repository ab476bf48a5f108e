"""Text operators against brute force on small frames, with nulls, empty tables, ties and repeats."""

import hashlib
import os
import random
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headroom.llm import fingerprint, graph, html, licenses, lines, neardup, packing, pieces, queries, secrets, toxicity, vectors
from headroom.llm.common import read_table, stored
from llm_frames import docs_of

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "one", "one", "two words", "a b \U0001F600 x", "z " * 5000]


def groups(n, linked):
    low = list(range(n))
    for _ in range(n):
        new = [min([low[i], *(low[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == low:
            break
        low = new
    return low


def test_packing_is_gapless_and_exact(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    texts = [r["text"] for r in rows] + ODD + ["It's <|endoftext|> ÉtÉ ΣΣ don't 12,5."]
    got = packing.pack(docs_of(spark, texts), with_ids=True).collect()
    ids = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == 2048 * r["piece"] and r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + r["ids"]
    for k, text in enumerate(texts):
        assert ids[k] == np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.05 * -(-total // 2048) + 1


def test_closing_punctuation_needs_no_whole_tokenizer(monkeypatch):
    """The ids are the tokenizer's for every sign after letters; the whole tokenizer runs once for each distinct end."""
    from tokenizers import Tokenizer

    tok, cache, whole = Tokenizer.from_file(packing.default_tokenizer()), packing.WordCache(packing.default_tokenizer()), []
    run = cache._whole
    monkeypatch.setattr(cache, "_whole", lambda word: whole.append(word) or run(word))
    ends = [*packing.CLOSING, "$$$", ".%%%", ",***", "!?", "_-", "((", ""]
    texts = [" ".join(f"{word}{end}" for end in ends) for word in ("Kappa", "kappa", "\u00c9t\u00e9", "stra\u00dfe", "ZU")]
    for text, ids in zip(texts, cache.ids(texts)):
        assert ids == struct.pack(f"<{len(ids) // 4}I", *tok.encode(text, add_special_tokens=False).ids)
    assert sorted(whole) == sorted(e for e in ends if e)
    for text in ("it's", "it'", "rock'n'roll!", "a<|startoftext|>b", "x<|", "<|endoftext|>.", "don't'", "e\u0301.", "7$", "a7$", "$a", "a.b$"):
        assert cache.ids([text])[0] == struct.pack(f"<{len(i := tok.encode(text, add_special_tokens=False).ids)}I", *i)


def test_packing_of_nothing(spark):
    assert packing.pack(docs_of(spark, [])).count() == 0
    assert [r["length"] for r in packing.pack(docs_of(spark, ["", ""], [None, None])).collect()] == [1, 1]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [r["text"] for r in read_table(spark, SF, "documents").collect()] + ODD + ["aaaa   aaaa\r\n<s> ▁x"]
    got = {r["doc_id"]: r for r in pieces.encode(docs_of(spark, texts)).collect()}
    for k, text in enumerate(texts):
        assert got[k]["ids"] == sp.encode(text or "")
    assert all(r["round_trip"] for r in got.values())
    back = pieces.decode(pieces.encode(docs_of(spark, texts[:20]))).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(texts[:20]))
    assert pieces.encode(docs_of(spark, [])).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    data = [list(map(float, base[k % 30] + 0.25 * rng.standard_normal(16) * (k >= 30))) for k in range(200)]
    data += [data[0], data[0], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    frame = spark.createDataFrame([(k, v, "x") for k, v in enumerate(data)], "vec_id long, embedding array<double>, key string")
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}

    def linked(i, j):
        a, b = data[i], data[j]
        if i == j or not a or not b or len(a) != len(b) or None in a or None in b or not np.isfinite([a, b]).all():
            return False
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return n > 0 and np.dot(a, b) / n >= 0.95

    want = sum(linked(i, j) for i in range(len(data)) for j in range(len(data)))
    assert len(got) == len(data) and 0.97 * want <= sum(r["n_links"] for r in got.values()) <= want
    low = groups(len(data), linked)
    assert np.mean([got[k]["component_id"] == low[k] for k in got]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_vectors_meet_at_the_threshold(spark):
    """Recall of pairs at a cosine just above the threshold, on 64 coordinates; extra columns with working names."""
    rng, near = np.random.default_rng(6), []
    for k in range(1000):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        near += [a, 0.9501 * a + np.sqrt(1 - 0.9501**2) * b]
    rows = [(k, [float(x) for x in v], 1, 2, "h") for k, v in enumerate(near)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, class long, key int, h string")).collect()
    found = sum(r["n_links"] for r in got) / 2
    print(f"pairs at 0.9501: {found} of 1000 found")
    assert vectors.band_count(0.95) == 73 and found >= 998


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(40):
        text = [rng.choice(words) for _ in range(80)]
        texts.append(" ".join(text))
        for _ in range(3):
            copy = list(text)
            for k in rng.sample(range(80), rng.randrange(1, 6)):
                copy[k] = rng.choice(words)
            texts.append("\n".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += ODD + ["A b", "a  B"]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    low = groups(len(texts), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and bool(sets[j]))
    for k in got:
        assert got[k]["n_shingles"] == len(sets[k]) and got[k]["component_id"] == low[k] and got[k]["kept"] == (low[k] == k)
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0
    same = neardup.near_duplicates(docs_of(spark, ["a b c", "a b c", "a b c"], [None, 7, 7])).collect()
    assert {r["component_id"] for r in same} == {7}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_states_the_result(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_main_text_of_pages(spark):
    import html as entities

    pages = read_table(spark, SF, "pages")
    got = {r["page_id"]: r for r in html.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article.replace("<br>", " "))]
        text = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)


def test_main_text_without_article_and_odd_pages(spark):
    page = ("<body><nav><a>x</a></nav><div class='cookie-notice'>We use</div><div class=content><h2>T</h2><p>a <i>b</i>&nbsp;c &amp; d</p>"
            "<ul><li>one<li>two</ul></div><div id=comments><p>bad</p></div><form><p>mail</p></form></body>")
    rows = [(1, "http://a/1", page), (2, "http://a/2", page.replace("one", "three")), (3, None, None), (3, "x", ""), (None, "http://b", "<p>q<script>z")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in got) == ["", "", "T\na b c & d\none\ntwo", "T\na b c & d\nthree\ntwo", "q"]


def test_wrapper_has_optional_and_repeated_groups():
    a = html.fold(["<ul", "<li", "#", "/li", "<li", "#", "/li", "/ul", "#"])
    b = html.fold(["<ul", "<li", "#", "/li", "/ul", "<b2", "#"])
    assert a == ["<ul", ["+", ["<li", "#", "/li"]], "/ul", "#"]
    assert html.merge(a, b) == ["<ul", ["+", ["<li", "#", "/li"]], "/ul", ["?", ["<b2"]], "#"]


def test_toxicity_scores_by_the_model_of_its_task():
    """Two models, one after the other in one process."""
    class Fixed:
        def __init__(self, each):
            self.value, self.each = self, each

        def llr(self, words):
            return np.full(len(words), self.each)

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words here"])], ["doc_id", "text"])
    first, second = (next(toxicity._score(Fixed(each))(iter([batch])))["f0"][0].as_py() for each in (2.0, -1.0))
    assert (first, second) == (2.0, -1.0)


def test_toxicity_curve_is_fitted_on_every_row(spark):
    """Against the same Newton steps in numpy, on more rows than were read before (50,000)."""
    names, n = toxicity.FEATURES, 60_000
    rows = spark.range(n, numPartitions=4).select(
        *((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 250.0 - 2).alias(name) for k, name in enumerate(names)),
        (F.pmod(F.xxhash64("id", F.lit(0)), F.lit(1000)) + F.pmod(F.xxhash64("id", F.lit(99)), F.lit(600)) > 900).cast("int").alias("toxic"))
    table = rows.toPandas()
    x, y = table[names].to_numpy(float), table["toxic"].to_numpy(float)
    mean, scale = x.mean(0), x.std(0)
    z, w = np.column_stack([(x - mean) / scale, np.ones(n)]), np.zeros(len(names) + 1)
    ridge = np.array([1.0] * len(names) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w), -3, 3)
    weights, intercept = toxicity.fit_curve(rows)
    assert np.allclose(weights, w[:-1] / scale, atol=1e-7) and abs(intercept - (w[-1] - (w[:-1] / scale) @ mean)) < 1e-7
    assert toxicity.fit_curve(rows.where("toxic = 1"))[1] == toxicity.fit_curve(rows.limit(0))[1] == 0.0


def test_toxicity_learns_only_from_its_folds(spark):
    rng = random.Random(1)
    texts, marks = [], []
    for k in range(600):
        words = ["".join(rng.choice(["re", "th", "on", "an"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        toxic = k % 3 == 0
        if toxic:
            for at in rng.sample(range(60), 4):
                words[at] = rng.choice(["zolgu", "zolgex", "bwimp", "bwimpa"])
        texts.append(" ".join(words))
        marks.append((k, int(toxic)))
    docs = docs_of(spark, [*texts, None, ""], [*range(600), None, 601])
    labels = spark.createDataFrame([*marks, (None, 1), (601, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for k, toxic in marks:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= got[k]["score"] <= 1
    held = [got[k]["predicted"] == t for k, t in marks if got[k]["held_out"]]
    assert np.mean(held) > 0.95 and not got[None]["held_out"]
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-9 for k in again)
    assert toxicity.toxicity(docs_of(spark, ["a"]), labels.limit(0)).count() == 1


def test_fingerprints_follow_the_texts(spark):
    texts = [r["text"] for r in read_table(spark, SF, "documents").orderBy("doc_id").collect()] + ODD
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs_of(spark, texts)).collect()}

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def likeness(a, b):
        return len(a & b) / max(1, len(a | b))

    errors = []
    for k, text in enumerate(texts):
        text, after = text or "", texts[(k + 1) % len(texts)] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        assert got[k]["n_chars"] == len(text) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if k < len(texts) - len(ODD):
            errors.append(got[k]["near_edited"] - likeness(shingles(text), shingles(edited)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    by_text = {}
    for k, text in enumerate(texts):
        assert by_text.setdefault(text or "", got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert fingerprint.fingerprints(docs_of(spark, [])).count() == 0


def test_fingerprints_with_repeated_and_null_ids(spark, monkeypatch):
    """The next document follows (id, hash of the text), nulls first, over many ranges and a hot id cut by its texts."""
    import xxhash

    rnd = random.Random(8)
    words = [f"w{k}" for k in range(40)]

    def spark_hash(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (h >> 63 << 64)

    for ids in ([None] * 30 + [7] * 60 + list(range(60)) + [2**63 - 1] * 20, [5], [None, None, None], [3, 3, 3, 3]):
        monkeypatch.setattr(fingerprint, "RANGE_ROWS", 4)
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(30))) for _ in ids]
        docs = docs_of(spark, texts, ids).withColumn("text_key", F.lit(1)).withColumn("fp", F.lit("x"))
        got = fingerprint.fingerprints(docs).collect()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, spark_hash(texts[k])))
        want = []
        for at, k in enumerate(order):
            text, after = texts[k], texts[order[(at + 1) % len(order)]]
            q = len(text) // 4
            want.append((ids[k], hashlib.sha256((text[:len(text) - q] + after[:q]).encode()).hexdigest(), after))
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted([(r["doc_id"], r["edited_sha256"]) for r in got], key=key) == sorted([w[:2] for w in want], key=key)
        prints = {t: r["fingerprint"] for t, r in zip(texts, fingerprint.fingerprints(docs_of(spark, texts)).orderBy("doc_id").collect())}
        near = {}
        for doc_id, sha, after in want:
            a = next(r["fingerprint"] for r in got if (r["doc_id"], r["edited_sha256"]) == (doc_id, sha))
            b = prints[after]
            same = sum(a[j:j + 2] == b[j:j + 2] for j in range(0, len(a), 2)) / fingerprint.BINS if a and b else 0
            near.setdefault((doc_id, sha), []).append(1.0 if not a and not b else max(0.0, (same - 1 / 256) / (1 - 1 / 256)) if a and b else 0.0)
        for r in got:
            assert any(abs(r["near_next"] - x) < 1e-9 for x in near[r["doc_id"], r["edited_sha256"]])


def test_secrets_against_regular_expressions(spark):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    texts = [r["text"] for r in read_table(spark, SF, "documents").collect()] + ODD + [
        "secret: token:abcdefgh PASSWORD = 'x1' Api_Key=\"abc.def\" \U0001F600 AKIA" + "A" * 16 + " AKIAAKIA" + "0123456789abcdef" * 2,
        "key dGhpcyBpcyBh4Zk9QmX7Lw2VtR8sYc3E here"]
    got = {r["doc_id"]: r for r in secrets.scan(docs_of(spark, texts)).select("doc_id", "found", secrets._written(F.col("found")).alias("w")).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        assert [tuple(s) for s in got[k]["found"] if s["kind"] < 3] == sorted(want)
    assert secrets.scan(docs_of(spark, [])).count() == 0


def test_random_keys_are_found_in_a_small_corpus(spark):
    """No letter-only run is long enough to be a decoy; keys of the greater lengths, one corpus each."""
    rnd = random.Random(4)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = "the river was wide and slow, and nobody knew how long it had been there before the bridge was built"
    slug = "chapter-12-of-the-second-part-of-the-book-34-and-more-to-read"
    for low, used in ((32, signs), (48, signs), (32, signs[26:]), (48, signs[26:])):
        keys = ["".join(rnd.choice(used) for _ in range(low)) + "7q" for _ in range(10)]
        texts = [f"{plain} {key} {plain}" for key in keys] + [plain, f"{plain} {slug}"]
        got = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in secrets.scan(docs_of(spark, texts)).collect()}
        found = sum(got[k] == [(len(plain) + 1, 3, len(plain) + 1 + low + 2)] for k in range(10))
        print(f"keys of {low + 2} of {len(used)} signs: {found} of 10 found")
        assert found >= 6 and got[10] == got[11] == []
    alone = {r["doc_id"]: r["found"] for r in secrets.scan(docs_of(spark, [keys[0]])).collect()}
    assert [tuple(s) for s in alone[0]] == [(0, 3, 50)]


def test_secret_thresholds_count_every_word_of_every_document(spark, monkeypatch):
    """The joined words of a text hold all its letters, and each of them counts, with the listed ones."""
    texts = [("The river %d was wide; and slow\u00e9, nobody knew.\n" % k) * (1 + 9 * k) + "x7" * 15 + " \u0391 end" for k in range(70)]
    texts += [None, "", "12 34", "short"]
    docs, want = docs_of(spark, texts), 0
    got = docs.select("doc_id", secrets._joined(F.coalesce("text", F.lit(""))).alias("d")).collect()
    for row in got:
        letters = re.sub("[^A-Za-z]", "", re.sub("[A-Za-z0-9+/=_-]{20,}", " ", texts[row["doc_id"]] or "")).lower()
        joined = "".join(row["d"]).lower()
        assert letters.startswith(joined) and len(letters) - len(joined) < 20
        assert all(one.islower() or any(map(str.isupper, one)) for one in row["d"])
        want += len(row["d"])
    seen = []
    monkeypatch.setattr(secrets, "_thresholds", lambda counts: seen.extend(counts) or {})
    assert secrets.scan(docs).count() == len(texts)
    assert sum(r["n"] for r in seen if r["decoy"]) == want + len(secrets._reference())


def test_randomness_steps_skip_only_what_is_zero(spark):
    rnd = random.Random(5)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = [("".join(rnd.choice(signs[:2 + k % 60]) for _ in range(20 + k % 50)),) for k in range(600)] + [("a" * 30,), ("ab1" * 9,)]
    w = F.col("w")
    got = spark.createDataFrame(rows, "w string").select(secrets._step(w).alias("s"), secrets.randomness(w).alias("p")).collect()
    assert all(r["s"] == int(r["p"] * secrets.STEPS) for r in got) and len({r["s"] for r in got}) > 10


@pytest.mark.parametrize("n", [1, 2, 200, 300])
@pytest.mark.parametrize("copies", [1, 2])
def test_simhash_is_the_majority(spark, n, copies):
    """Over the words between what is no letter, however often the row is repeated."""
    words = ["w" + "abcdefghij"[k * k % 10] * (1 + k % 5) for k in range(n)]
    docs = spark.createDataFrame([(1, "7\n42 " + " - ".join(words))] * copies, "doc_id long, text string")
    hashes = [r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    row = lines._lines(lines._row_key(docs)).collect()
    assert [(r["line"], r["length"]) for r in row] == [(1, len(" ".join(words)))]
    assert row[0]["sim"] == sum(1 << b for b in range(56) if 2 * sum(h >> b & 1 for h in hashes) > n)


def test_line_ids_tell_orders_apart(spark):
    texts = ["one two three", "three two one", "ONE, two; 3 three!", "", "one two", "one two three\none two three"]
    got = lines._lines(lines._row_key(docs_of(spark, texts))).collect()
    ids = {(r["doc_id"], r["line"]): r["id"] for r in got}
    order = sorted({r["doc_id"] for r in got})
    assert len(got) == 6 and len(set(ids.values())) == 3
    assert ids[order[0], 0] == ids[order[2], 0] == ids[order[-1], 0] == ids[order[-1], 1] != ids[order[1], 0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_line_groups_match_all_pairs(spark):
    """Chains of lengths, near copies of one line, and lines of equal words in another order (near bits, no link)."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    near = [" ".join(words[:k] + ["zzqq" + "abcdefgh"[k % 8]] + words[k + 1:]) for k in range(0, 40, 3)]
    chains = [" ".join(words[:4] * n) for n in (1, 2, 3, 4, 5, 6, 8, 11, 14, 15)]
    mixed = [" ".join(rnd.sample(words, 40)) for _ in range(12)]
    texts = near + chains + mixed + [chains[3], mixed[0]]
    docs = docs_of(spark, texts)
    sims = {r["doc_id"]: r["sim"] for r in lines._lines(lines._row_key(docs)).collect()}

    def linked(i, j):
        longest = max(len(texts[i]), len(texts[j]))
        return texts[i] == texts[j] or (bin(sims[i] ^ sims[j]).count("1") <= lines.MAX_DISTANCE and (
            edits(texts[i], texts[j]) <= int((1 - lines.SIMILARITY) * longest + 1e-9)))

    low = groups(len(texts), linked)
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()}
    assert got == {i: int(low[i] != i) for i in range(len(texts))}
    assert 5 < sum(got.values()) < len(texts) - 12


def test_line_dedup_keeps_one_of_each_group(spark):
    line = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))
    near = line.replace("wordcb", "wordcc")
    texts = ["first\n" + line, near + "\nlast", line.upper() + " 17", None, "", "...\n...", "first\nFIRST!"]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] in ("last", texts[1]) and got[2] == "" and got[3] is None and got[4] == ""
    assert got[5] == texts[5] and got[6] == ""
    out = lines.dedup_lines(docs_of(spark, []))
    assert out.count() == 0 and "piece" in out.columns


def test_near_lines_are_found_by_edit_similarity_alone(spark):
    """Copies with words replaced, up to the edit similarity; brute force over all pairs, without SimHash bits."""
    rnd = random.Random(21)

    def word():
        return "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 10)))

    texts = []
    for k in range(100):
        words = [word() for _ in range(rnd.choice([10, 15, 20, 27, 40]))]
        changed, left = list(words), rnd.random() * 0.2 * len(" ".join(words))
        for at in rnd.sample(range(len(words)), len(words)):
            new = word()
            left -= max(len(new), len(words[at]))
            if left < 0:
                break
            changed[at] = new
        texts += [" ".join(words), " ".join(changed)]

    def linked(i, j):
        longest = max(len(texts[i]), len(texts[j]))
        most = int((1 - lines.SIMILARITY) * longest + 1e-9)
        return abs(len(texts[i]) - len(texts[j])) <= most and (j == i ^ 1 or len(set(texts[i].split()) & set(texts[j].split())) > 3) and (
            edits(texts[i], texts[j]) <= most)

    low = groups(len(texts), linked)
    wanted = {i for i in range(len(texts)) if low[i] != i}
    got = {r["doc_id"] for r in lines.dedup_lines(docs_of(spark, texts)).collect() if r["n_removed"]}
    print(f"near lines: {len(got & wanted)} of {len(wanted)} found")
    assert len(wanted) > 80 and got <= wanted and len(got) >= 0.95 * len(wanted)


def test_numbers_tell_lines_apart_and_repeat(spark):
    """Exact repeats of lines of digits go; lines that differ in numbers beyond the edit similarity stay."""
    texts = ["Total", "Total 730 12", "12 | 40", "12 | 40", "12 | 41", "2024-01-02\n2024-01-02", "Total 730 12", "total, 730 - 12"]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 1, 7: 1}


def test_stored_tables_leave_no_shuffle_files(spark):
    """Disk holds the shuffle of the table being written, not those of all tables before it."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {name for top in blocks.localDirs() for _, _, names in os.walk(top.getPath()) for name in names if name.startswith("shuffle_")}

    before = files()
    table = stored(spark.range(1000).selectExpr("id % 7 k", "id").repartition(5, "k"))
    for _ in range(50):
        if not (left := {name for name in files() - before if name.endswith(".data")}):
            break
        time.sleep(0.2)
    assert not left and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pairs_of_lines_are_all_judged_in_any_number_of_rounds(spark, monkeypatch):
    texts = [f"alpha beta gamma delta epsilon zeta eta theta iota {w}" for w in ("kappa", "kapps", "koppa", "lambda", "mu")]
    normal = spark.createDataFrame(list(enumerate(texts)), "id long, normal string")
    pairs = normal.alias("x").join(normal.alias("y"), F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    frames = []
    monkeypatch.setattr(lines, "stored", lambda df: frames.append(df.columns) or stored(df))
    got = []
    for share in (2, 0.5):
        monkeypatch.setattr(lines, "PER_ROUND", share)
        frames.clear()
        got.append({(r["a"], r["b"]) for r in lines._links(pairs, normal).collect()})
        assert sum("good" in columns for columns in frames) == (1 if share == 2 else 4)
    assert got[0] == got[1] and len(got[0]) == 10


def test_unlike_lines_of_frequent_words_are_not_compared(spark, monkeypatch):
    """Edit checks follow the near lines, not the square of the lines that share frequent words; every near copy goes."""
    rnd = random.Random(4)
    often = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(24)]
    seldom = ["".join(rnd.choice("klmnopqrst") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    unlike = [[rnd.choice(often if rnd.random() < 0.6 else seldom) for _ in range(60)] for _ in range(120)]
    near = [words[:k % 50] + ["uvwxy"] * 4 + words[k % 50 + 4:] for k, words in enumerate(unlike[:20])]
    texts = [" ".join(words) for words in unlike + near]
    judged, real = [], lines._edit_alike
    monkeypatch.setattr(lines, "_edit_alike", lambda rows, *more: judged.append(rows.count()) or real(rows, *more))
    got = {r["doc_id"] for r in lines.dedup_lines(docs_of(spark, texts)).collect() if r["n_removed"]}
    print(f"edit checks: {judged}")
    assert got == set(range(120, 140)) and 20 <= sum(judged) < 45


def test_bounds_of_the_edit_distance(spark):
    """Far heads and sums of pieces never tell a pair wrongly, and decide most pairs of unlike and of alike texts without a full comparison."""
    rnd = random.Random(31)
    words = ["".join(rnd.choice("abcdefghiklmnoprstué") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    rows = []
    for k in range(120):
        a = [rnd.choice(words) for _ in range(rnd.choice([6, 25, 60]))]
        b = [rnd.choice(words) for _ in a] if k % 3 == 0 else list(a)
        for _ in range(len(a) // 12 if k % 3 == 1 else rnd.randrange(len(a) // 2 + 1) if k % 3 == 2 else 0):
            at = rnd.randrange(len(b))
            b[at:at + rnd.randrange(3)] = [rnd.choice(words)] * rnd.randrange(3)
            b = b or ["x"]
        b = b[len(b) // 10:] if k % 4 == 0 else b
        rows.append((k, " ".join(a), " ".join(b)))
    frame = spark.createDataFrame(rows, "k long, na string, nb string").withColumn(
        "most", F.floor((1 - lines.SIMILARITY) * F.greatest(F.length("na"), F.length("nb")) + 1e-9).cast("int"))
    got = frame.select("k", "most", lines._far("na", "nb").alias("far"), lines._far("nb", "na").alias("raf"), lines._by_pieces("na", "nb").alias("sum")).collect()
    alike = unlike = 0
    for r in got:
        distance = edits(rows[r["k"]][1], rows[r["k"]][2])
        assert not (r["far"] or r["raf"]) or distance > r["most"]
        assert r["sum"] > r["most"] or distance <= r["sum"]
        alike += distance <= r["most"] and r["sum"] <= r["most"]
        unlike += distance > r["most"] and r["far"]
    near = sum(edits(a, b) <= r["most"] for r, (_, a, b) in zip(got, rows))
    print(f"bounds: {alike} of {near} alike, {unlike} of {len(rows) - near} unlike")
    assert near > 40 and alike >= 0.9 * near and unlike >= 0.5 * (len(rows) - near)


def test_line_dedup_leaves_no_used_up_tables(spark, monkeypatch):
    """Files of tables of lines and pairs go when what was made of them is stored; the links and groups, and the result, stay."""
    made = []

    def kept(df):
        made.append(stored(df))
        return made[-1]

    monkeypatch.setattr(lines, "stored", kept)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = [" ".join(words[:k % 50] + ["near"] + words[k % 50:]) + "\nx" for k in range(20)] + [None, "1 2\n1 2"]
    out = lines.dedup_lines(docs_of(spark, texts))
    left = [df.columns for df in made if os.path.exists(df.inputFiles()[0].removeprefix("file://"))]
    assert len(made) > 8 and all(set(c) in ({"a", "b", "good"}, {"id", "component"}, {"doc_id", "text_key", "removed"}) for c in left)
    assert sum(r["n_removed"] for r in out.collect()) == 39


def test_normal_forms_deal_texts_once(spark, monkeypatch):
    """Rows that repeat and null ids give each normal form once, without a shuffle of the forms."""
    made = []

    def kept(df):
        if df.columns == ["id", "normal"]:
            made.append((df._jdf.queryExecution().executedPlan().toString(), df.groupBy("id").count().agg(F.max("count"), F.count("*")).first()))
        return stored(df)

    monkeypatch.setattr(lines, "stored", kept)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = [" ".join(words[:k] + ["near"] + words[k:]) for k in (5, 20, 40)]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (0, texts[2])], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in lines.dedup_lines(docs).collect())
    assert got == [(False, 0, 0), (False, 1, 1), (False, 1, 1), (True, 0, 1), (True, 0, 1)]
    plan, (most, n) = made[0]
    assert (most, n) == (1, 3) and plan.index("explode(asked") < plan.index("Exchange")


def test_edit_check_is_exact(spark):
    rng = random.Random(2)
    rows = []
    for k in range(200):
        a = [rng.choice(["aa", "bbb", "c", "dddd"]) for _ in range(rng.randrange(1, 12))]
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            b[rng.randrange(len(b)):rng.randrange(len(b) + 1)] = rng.choice([[], ["x"], ["bbb", "c"]])
            b = b or ["q"]
        rows.append((str(2 * k), str(2 * k + 1), " ".join(a), " ".join(b)))
    got = {r["a"] for r in lines._edit_alike(spark.createDataFrame(rows, "a string, b string, na string, nb string")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    assert got == {a for a, _, na, nb in rows if distance(na, nb) <= 0.2 * max(len(na), len(nb)) + 1e-9}


def test_licenses_and_inheritance(spark):
    rows = [("a/b/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "print"), ("a/y.py", "foo"),
            ("a/b/z.py", "Licensed under the Apache License, Version 2.0.\ncode"), (None, None), ("top", "")]
    got = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in
           licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/b/LICENSE": ("MIT", "MIT", None), "a/b/c/x.py": (None, "MIT", "a/b"), "a/y.py": (None, None, None),
                   "a/b/z.py": ("Apache-2.0", "Apache-2.0", None), None: (None, None, None), "top": (None, None, None)}
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_pipeline_stages(spark):
    docs = read_table(spark, SF, "documents")
    first = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, first, SF).columns == docs.columns
    odd = docs_of(spark, [*ODD, "x password=abcdef123456 y"], [0, 1, 2, 3, 3, 5, None, 7, 8])
    out = corpus_pipeline.STAGES[3][1](spark, odd, SF)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[8] == "x [SECRET] y" and out.count() == 9
    assert corpus_pipeline.run(spark, SF).count() >= 150
    clash = odd.selectExpr("*", "1 a", "2 t", "'x' found", "3 n_lines", "4 n_removed", "5 base", "6 line", "7 text_key", "8 __text", "9 __row")
    for at in (1, 3):
        out = corpus_pipeline.STAGES[at][1](spark, clash, SF)
        assert out.columns == clash.columns and [tuple(r)[-10:] for r in out.collect()] == [(1, 2, "x", 3, 4, 5, 6, 7, 8, 9)] * 9


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    closed = [c for item, size in (("a", 7), ("b", 5), ("c", 9), ("d", 4)) for c in fit.add(item, size)]
    assert closed == [[("a", 0)]] and Counter(len(c) for c in fit.rest()) == {1: 1, 2: 1}
