"""Language network: forward pass and gradients against plain loops, held-out accuracy, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from headroom.llm import language
from headroom.llm.common import read_table

SF = "/root/testdata/sf0.01"


def plain(net, window):
    p, out = net.params, []
    padded = list(window) + [0] * (max(language.WIDTHS) - 1)
    for f in range(p["filters"].shape[1]):
        width = language.WIDTHS[f // language.FILTERS]
        best = max(sum(float(p["bytes"][padded[at + k], d] * p["filters"][k * language.DEPTH + d, f])
                       for k in range(width) for d in range(language.DEPTH)) for at in range(len(window)))
        out.append(max(best + p["bias"][f], 0.0))
    logits = np.array(out) @ p["out"] + p["prior"]
    e = np.exp(logits - logits.max())
    return e / e.sum()


def test_forward_equals_plain_loops():
    net = language.Network(["a", "b", "c"])
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    for w, got in zip(windows, net.forward(windows)):
        assert np.allclose(got, plain(net, w), atol=1e-4)


def test_gradients_equal_differences():
    net = language.Network(["a", "b"])
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(2)
    windows, label = rng.integers(97, 123, (4, language.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        return -np.log(net.forward(windows)[np.arange(4), label]).mean()

    grads = net.gradients(windows, label)
    for name, at in [("bytes", (100, 3)), ("filters", (5, 2)), ("filters", (30, 40)), ("bias", (7,)), ("out", (9, 1)), ("prior", (0,))]:
        kept, h = net.params[name][at], 1e-6
        net.params[name][at] = kept + h
        up = loss()
        net.params[name][at] = kept - h
        down = loss()
        net.params[name][at] = kept
        assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-4


def test_windows_cover_whole_texts():
    texts = ["", "Aé" * 100, "x", "y" * 128, "z" * 129]
    windows, owner, size = language._text_windows(texts)
    for k, t in enumerate(texts):
        joined = b"".join(bytes(w[:n]) for w, o, n in zip(windows, owner, size) if o == k)
        assert joined == t.encode().replace(b"A", b"a")
    assert list(np.bincount(owner, minlength=5)) == [0, 3, 1, 1, 2]


def test_held_out_accuracy(spark):
    rows = language.op12_language(spark, SF)
    docs = read_table(spark, SF, "documents")
    got = rows.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").select("lang", "lang_pred", "score").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got) / len(got)
    print("held-out", len(got), right)
    assert right >= 0.95 and all(0 <= r["score"] <= 1 for r in got)
    assert rows.count() == docs.count()


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string"
    rows = [(k, "the house and the garden " * (1 + k % 3), "en") for k in range(40)] + [(100 + k, "der hund und die katze " * 3, "de") for k in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 34 -- !", "en"), (203, "the dog and the house", None), (None, "und die katze", "de"),
             (204, "der hund und " * 100_000, None), (203, "the dog and the house", None)]
    df = spark.createDataFrame([(i, t, la, "s", 1, "x", "y") for i, t, la in rows], schema)
    net = language.learn(df.where(language._fold(4) != 2))
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(df, net).collect()]
    assert len(got) == len(rows)
    assert {p for i, p in got if i in (200, 201, 202)} == {"und"} and [p for i, p in got if i == 203] == ["en", "en"]
    assert [p for i, p in got if i is None or i == 204] == ["de", "de"]
    empty = df.where("false")
    assert language.learn(empty) is None and language.identify(empty, None).collect() == []
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}
    one = language.learn(df.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language.identify(df.where(F.col("doc_id") == 203), one).collect()} == {"en"}
