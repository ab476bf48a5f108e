"""Versioned tables, header-matched exports, single-file extracts, lasting ids, stored queries, intake without repeats."""

import datetime
import os
import threading

import pytest
from pyspark.sql import functions as F

from headroom.operators import ask
from headroom.operators import clean as B
from headroom.operators import workflow as G
from headroom.sources import io
from headroom.sources.store import Conflict, TableStore
from headroom.streaming import intake as S


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def numbers(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "n long")


# --- A2 -------------------------------------------------------------------------

def test_readers_see_the_old_version_until_the_swap(spark, scratch):
    store = TableStore(spark, scratch)
    store.rebuild({"a": numbers(spark, 1, 2), "b": numbers(spark, 3)})
    opened = store.read("a")
    store.put("a", numbers(spark, 9))                                # a rebuild in the middle: written, not committed
    assert values(store.read("a"), "n") == [(1,), (2,)]
    store.rebuild({"a": numbers(spark, 7), "b": numbers(spark, 8)})
    assert values(opened, "n") == [(1,), (2,)]                       # who has it open goes on reading the old one
    assert values(store.read("a"), "n") == [(7,)] and values(store.read("b"), "n") == [(8,)]


def test_a_rebuild_that_dies_changes_nothing(spark, scratch):
    store = TableStore(spark, scratch, patience=0.5)
    store.rebuild({"a": numbers(spark, 1), "b": numbers(spark, 2)})
    broken = numbers(spark, 1).select(F.raise_error(F.lit("dies")).cast("long").alias("n"))
    with pytest.raises(Exception):
        store.rebuild({"a": numbers(spark, 5), "b": broken})
    assert values(store.read("a"), "n") == [(1,)] and values(store.read("b"), "n") == [(2,)]
    parent, tables = store.current()
    store.files.claim(f"{scratch}/_manifest/{parent + 1:012d}.claim")     # a writer that died between its claim and its manifest
    store.rebuild({"a": numbers(spark, 6)})
    assert values(store.read("a"), "n") == [(6,)] and values(store.read("b"), "n") == [(2,)]
    assert store.vacuum(keep=1) and values(store.read("a"), "n") == [(6,)]


def test_second_commit_of_a_parent_fails(spark, scratch):
    store = TableStore(spark, scratch)
    store.commit(0, {"a": []})
    with pytest.raises(Conflict):
        store.commit(0, {"b": []})


# --- G6 -------------------------------------------------------------------------

DEC = ("decision_id long, site_id long, space_type_id int, source string, title string, options_summary string, owner string, "
       "decide_by_date date, decided_at date, decision_note string, created_at date")


def test_two_runs_at_once_leave_one_open_decision(spark, scratch, monkeypatch):
    d = datetime.date(2026, 1, 1)
    store = TableStore(spark, scratch)
    store.rebuild({"decisions": spark.createDataFrame([(40, 1, 1, "collision", "t", "o", None, d, None, None, d),
                                                       (41, 2, 1, "collision", "t", "o", None, d, d, "done", d)], DEC)})
    lrm = spark.createDataFrame([(s, f"s{s}", 1, "desk", "2026-Q3", d) for s in range(1, 7)],
                                "site_id long, site_name string, space_type_id int, space_type string, breach_quarter string, decide_by_date date")
    barrier, plain, first = threading.Barrier(2), TableStore.put, {}

    def put(self, name, df):
        folder = plain(self, name, df)
        if first.setdefault(threading.get_ident(), True):             # both have written before either commits
            first[threading.get_ident()] = False
            barrier.wait(120)
        return folder

    monkeypatch.setattr(TableStore, "put", put)
    added = []
    runs = [threading.Thread(target=lambda: added.append(G.commit_decisions(TableStore(spark, scratch), lrm, "2026-01-01"))) for _ in range(2)]
    [t.start() for t in runs]
    [t.join() for t in runs]
    rows = store.read("decisions")
    assert sorted(added) == [0, 5]
    assert values(rows.where("decided_at is null and source = 'collision'").groupBy("site_id", "space_type_id").count(), "site_id", "count") == \
        [(s, 1) for s in range(1, 7)]
    assert values(rows, "decision_id") == [(k,) for k in range(40, 47)]
    monkeypatch.setattr(TableStore, "put", plain)
    assert G.commit_decisions(store, lrm, "2026-02-01") == 0


# --- B12 ------------------------------------------------------------------------

def test_ids_last_over_new_rows_and_partitionings(spark, scratch):
    store = TableStore(spark, scratch)
    rows = spark.createDataFrame([("b", 1), ("a", 1), (None, 2), ("a", 1)], "code string, part int")
    one = {(r.code, r.part): r.id for r in B.lasting_ids(store, rows, ["code", "part"], "id", "keys").collect()}
    assert sorted(one.values()) == [1, 2, 3]
    more = rows.unionByName(spark.createDataFrame([("0", 0), ("zz", 1)], "code string, part int")).repartition(5)
    two = B.lasting_ids(store, more, ["code", "part"], "id", "keys").collect()
    assert len(two) == 6 and {(r.code, r.part): r.id for r in two if (r.code, r.part) in one} == one
    assert sorted({r.id for r in two}) == [1, 2, 3, 4, 5]
    before = store.current()[0]
    assert B.lasting_ids(store, rows, ["code", "part"], "id", "keys").count() == 4 and store.current()[0] == before
    assert B.lasting_ids(TableStore(spark, scratch + "/e"), rows.where("false"), ["code"], "id", "keys").count() == 0


# --- A8 -------------------------------------------------------------------------

def test_promoted_queries_outlive_the_session(spark, scratch):
    store = TableStore(spark, scratch)
    cost = spark.createDataFrame([(1, 2.0), (2, 3.0)], "site_id long, cost_per_sqft_usd double")
    views = {"cost": lambda: cost}
    ask.promote(store, views, "dear", "cost", {"site": "1"})
    ask.promote(store, views, "dear", "cost", {"site": "2"})             # replaced by name
    ask.promote(store, views, "every", "cost")
    with pytest.raises(ValueError):
        ask.promote(store, views, "Not valid", "cost")
    with pytest.raises(ValueError):
        ask.promote(store, views, "bad", "cost", {"quarter": "x"})
    other = spark.newSession()
    assert not other.catalog.tableExists("dear")
    again = other.createDataFrame([(1, 2.0), (2, 3.0), (2, 4.0)], "site_id long, cost_per_sqft_usd double")
    assert ask.load_promoted(TableStore(other, scratch), {"cost": lambda: again}) == {}
    assert other.table("dear").count() == 2 and other.table("every").count() == 3


# --- A1, A4 ---------------------------------------------------------------------

def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_export_columns_by_header_name(spark, scratch):
    put(scratch, "1.csv", "b,a\nB1,A1\n")
    put(scratch, "2.csv", '﻿A , x,B\n"A2, with ""quotes""",9,"line one\nline two"\n,,\n')
    put(scratch, "3.csv", "a,b\nA3\nA4,B4,extra\nA5,B5\n")
    put(scratch, "4.csv", "")
    rows = io.read_export(spark, scratch, ["a", "b"])
    good, bad = io.split_corrupt(rows, "x.csv")
    assert [(r.a, r.b) for r in good.orderBy("seq").collect()] == [
        ("A1", "B1"), ('A2, with "quotes"', "line one\nline two"), (None, None), ("A5", "B5")]
    assert sorted(r.raw_row for r in bad.collect()) == ['{"a":"A3","b":null,"corrupt":"A3"}', '{"a":"A4","b":"B4","corrupt":"A4,B4,extra"}']
    assert bad.columns == ["seq", "source_file", "raw_row", "reason"]
    put(scratch, "5.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="column 'b' occurs 0 times"):
        io.read_export(spark, scratch, ["a", "b"])


def test_export_of_nothing(spark, scratch):
    put(scratch, "a.csv", "")
    assert io.read_export(spark, scratch, ["a"]).collect() == []


def test_one_ordered_file_per_view_from_many_tasks(spark, scratch):
    odd = ['q"u', "new\nline", "com,ma", "", None, "é"]
    df = spark.range(2000).select("id", F.element_at(F.array(*[F.lit(o) for o in odd]), (F.col("id") % 6 + 1).cast("int")).alias("t"))
    view = df.repartition(7).sortWithinPartitions("t").repartitionByRange(5, "id").sortWithinPartitions("id")
    for _ in range(2):                                                   # a second run replaces the first
        paths = io.publish({"v": view, "none": df.where("false")}, scratch)
    assert view.rdd.getNumPartitions() == 5
    assert os.listdir(paths["none"]) == ["part-none.csv"] or set(os.listdir(paths["none"])) <= {"part-none.csv", ".part-none.csv.crc"}
    text = open(os.path.join(paths["v"], "part-v.csv"), encoding="utf-8").read()
    assert text.startswith("id,t\n") and text.count("id,t") == 1
    back = [(r.id, r.t) for r in io.read_export(spark, paths["v"], ["id", "t"]).orderBy("seq").collect()]
    assert back == [(str(k), odd[k % 6] or None) for k in range(2000)]
    assert sorted(n for n in os.listdir(scratch) if not n.startswith(".")) == ["none", "v"]


# --- A5 -------------------------------------------------------------------------

def test_intake_takes_a_repeated_event_once(spark, scratch):
    sites = spark.createDataFrame([(1, "one")], "site_id long, site_name string")
    src, out = os.path.join(scratch, "src"), {k: os.path.join(scratch, k) for k in ("issues", "quar", "ckpt")}

    def feed(*events):
        rows = [(i, datetime.datetime(2026, 1, day), 1, "error", 1.0, '{"k": 3}') for i, day in events]
        spark.createDataFrame(rows, S.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = S.start_intake(spark, src, sites, out["issues"], out["quar"], out["ckpt"])        # every call is a restart
        q.awaitTermination(200)
        assert q.exception() is None

    feed((1, 10), (2, 11), (1, 10))
    feed((2, 11), (3, 20))                                               # a repeat from the batch before
    feed((4, 1), (3, 20), (5, 14))                                       # late, a repeat, and one in time
    assert values(spark.read.parquet(out["issues"]), "issue_id") == [(1,), (2,), (3,), (5,)]
    assert values(spark.read.parquet(out["quar"]), "event_id", "reason") == [(4, "late: older than the watermark")]
