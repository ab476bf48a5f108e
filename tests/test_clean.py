"""Cleaning functions and reconciliation operators."""

from pyspark.sql import functions as F

from headroom.functions.clean import int_value, money, quarter_label
from headroom.operators import clean as B


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).collect()[0].y


def test_money_int_quarter(spark):
    assert float(one(spark, money, "$1,200,000")) == 1200000.0
    assert one(spark, money, "  ") is None and one(spark, money, "n/a") is None
    assert one(spark, int_value, "12.7") == 12 and one(spark, int_value, "") is None
    assert one(spark, quarter_label, "12/2025") == "2025-Q4"
    assert one(spark, quarter_label, "2025-Q2") == "2025-Q2"
    assert one(spark, quarter_label, "garbage") == "garbage"


def test_canonical_codes(spark):
    known = spark.createDataFrame([("costa-mesa", 1), ("hq", 2), ("advanced-imaging", 3)], "code string, site_id long")
    aliases = spark.createDataFrame([("aif", "advanced-imaging")], "alias string, code string")
    raw = spark.createDataFrame([(" Costa Mesa ",), ("HQ",), ("AIF",), ("costa_mesa",), ("nowhere",)], "c string")
    got = {r.raw_code: r.site_id for r in B.canonical_codes(raw, "c", aliases, known).collect()}
    assert got == {" Costa Mesa ": 1, "HQ": 2, "AIF": 3, "costa_mesa": 1, "nowhere": None}


def test_keep_last_logs_conflicts(spark):
    df = spark.createDataFrame([(1, "s", "2025-Q4", "p", 10), (2, "s", "2025-Q4", "p", 12), (3, "s", "2025-Q4", "p", 12),
                                (4, "t", "2025-Q4", "p", 5)], "seq long, site_id string, quarter string, program string, "
                                                              "headcount int")
    kept, log = B.keep_last(df, ["site_id", "quarter", "program"], "seq", ["headcount"], "headcount")
    k = {r.site_id: (r.headcount, r.seq) for r in kept.collect()}
    assert k == {"s": (12, 3), "t": (5, 4)}
    assert [(r.dropped_value, r.kept_value) for r in log.collect()] == [(10, 12)]


def test_canonical_codes_never_multiply(spark):
    raw = spark.createDataFrame([("AA",), ("bb",), ("x1",), ("x2",)], "c string")
    aliases = spark.createDataFrame([("x1", "aa"), ("x1", "aa"), ("x2", "aa"), ("x2", "bb")], "alias string, code string")
    known = spark.createDataFrame([("aa", 1), ("aa", 1), ("bb", 2), ("bb", 3)], "code string, site_id long")
    got = sorted((r.raw_code, r.site_id) for r in B.canonical_codes(raw, "c", aliases, known).collect())
    assert got == [("AA", 1), ("bb", None), ("x1", 1), ("x2", None)]


def test_merge_entities_and_quarantine(spark):
    rows = [(1, "KX4", "", "Delta", "", "75", "$640,000", "250", "USD", 9),
            (2, "Kiln Cross", "Kiln Cross Works", "", "31000", "", "800,000", "", "CAD", 9),
            (3, "KX4", "", "", "", "", "500,000", "", "EUR", 9),
            (4, "QQ1", "", "", "", "", "1", "", "USD", None),
            (5, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "seq long, facility_code string, facility_name string, loc_region string, "
                                     "gross_sq_ft string, workstations string, annual_rent string, op_ex string, "
                                     "currency string, site_id long")
    merged, ex = B.merge_entities(df)
    m, = merged.collect()
    assert (m.site_name, m.region, m.sq_ft, m.seat_capacity) == ("Kiln Cross Works", "Delta", 31000, 75)
    assert m.annual_rent_usd == 640000.0 and m.opex_usd_yr == 250.0
    e = {r.seq: r for r in ex.collect()}
    assert sorted(e) == [2, 3, 4, 5]                                  # loaded + quarantined = read
    assert "584,000" in e[2].reason and '"currency":"CAD"' in e[2].raw_row
    assert "without a rate" in e[3].reason and "no site" in e[4].reason and "no site" in e[5].reason
    rated = {r.seq: r.reason for r in B.merge_entities(df, {"EUR": 1.1})[1].collect()}
    assert "550,000" in rated[3] and "without a rate" in rated[2]


def test_surrogate_ids_dense(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("seq")).repartition(7)
    ids = sorted(r.i for r in B.with_surrogate_ids(df, ["seq"], "i").collect())
    assert ids == list(range(1, 501))


def test_driver_cleaning_counts(spark):
    from headroom.plans.registry import CleanPlan, Plan
    from headroom.sources.driver import DriverCatalog
    cp = CleanPlan(Plan(DriverCatalog(spark, "/root/testdata/sf0.01")))
    hc = cp.plan.cat.headcount_snapshots
    # every clean row equals the source it was rendered from (dirt removed, dupes resolved)
    clean = cp.clean_headcount.select("site_id", "quarter", "program", "headcount")
    src = hc.select("site_id", "quarter", "program", "headcount")
    assert clean.exceptAll(src).count() == 0 and src.exceptAll(clean).count() == 0
    assert cp.exceptions.where(F.col("source_file") == "hris_export.csv").count() > 0
