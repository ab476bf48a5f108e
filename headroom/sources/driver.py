"""Adapters from the driver's TPC-H-style tables to the capacity-planning roles.

Each role (site, demand, issue, lease, headcount, ...) is defined once as a list
of ``(column, SQL expression)`` pairs.  The Spark side renders them with
``F.expr`` over DataFrame joins; ``headroom.plans.oracle`` renders the very same
text as DuckDB CTEs, so engine and oracle see identical inputs.

Roles that grow with the data (demand, issues, headcount, requisitions,
actions, decisions, leases) are aggregated from ``lineitem``/``orders``; the
per-site configuration roles (capacities, incentives, cohorts, milestones,
programs) are derived from ``supplier`` rows by fixed arithmetic rules.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.functions.period import q_index_of_date, q_label
from headroom.operators import constraints as K
from headroom.session import materialize

# Fixed values of the driver adapter: the as-of date of every time-relative
# operator, and the lower ends of the fact windows: by default all history up to the
# as-of date is read (a later start is an explicit choice of the caller's fork of these).
AS_OF = "2001-07-01"
DEMAND_FROM = "0001-01-01"      # ship-date window for demand, headcount, leases
DEMAND_TO = "2001-07-01"        # exclusive
AS_OF_Q = 2001 * 4 + 2          # the as-of date's period: facts before it are known
REQ_FROM = "0001-01-01"         # order-date window for open requisitions
ACTION_FROM = "0001-01-01"      # order-date window for actions and decisions

# Explicit schemas of the driver tables (no inference: no footer-reading job per read).
DRIVER_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# --- per-column rules shared with the oracle --------------------------------

SITE_COLUMNS = [
    ("site_id", "s_suppkey"),
    ("site_name", "s_name"),
    ("region", "r_name"),
    ("sq_ft", "CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(500 + floor(s_acctbal / 8) AS BIGINT) END"),
    ("seat_capacity", "CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(8 + (s_suppkey * 17) % 40 AS BIGINT) END"),
    ("power_kw_capacity", "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(12000 + (s_suppkey * 7919) % 30000 AS BIGINT) END"),
    ("site_type", "CASE WHEN s_suppkey % 17 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'factory' "
                  "WHEN s_suppkey % 3 = 1 THEN 'office' ELSE 'lab' END"),
    ("status", "CASE WHEN s_suppkey % 4 = 0 THEN 'owned' ELSE 'leased' END"),
    ("site_status", "CASE WHEN s_suppkey % 10 = 0 THEN 'buildout' WHEN s_suppkey % 10 = 1 THEN 'acquired_integrating' "
                    "WHEN s_suppkey % 10 = 2 THEN 'acquired_complete' ELSE 'operational' END"),
    ("integration_start_date", "CASE WHEN s_suppkey % 10 IN (0, 1) "
                               "THEN DATE '1999-01-01' + CAST((s_suppkey * 37) % 1000 AS INT) END"),
    ("lease_expiration_date", "CASE WHEN s_suppkey % 7 = 0 THEN NULL "
                              "ELSE DATE '2001-06-01' + CAST((s_suppkey * 53) % 1200 AS INT) END"),
    ("lease_option_deadline", "CASE WHEN s_suppkey % 7 = 0 THEN NULL "
                              "ELSE DATE '2001-01-01' + CAST((s_suppkey * 29) % 900 AS INT) END"),
    ("source_system", "CASE WHEN s_suppkey % 10 IN (1, 2) THEN 'acquired_import' ELSE 'master' END"),
]

# Ceilings as data: (constraint, priority on ties, unit, gives the status of a site with no breach), and a site's capacity of each
CONSTRAINTS = [("power", 1, "kW", 0), ("floor", 2, "sq ft", 1), ("dock", 3, "lines", 0)]
CAPACITY_COLUMNS = [
    ("floor", "CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(500 + floor(s_acctbal / 8) AS DOUBLE) END"),
    ("power", "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(12000 + (s_suppkey * 7919) % 30000 AS DOUBLE) END"),
    ("dock", "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(20 + (s_suppkey * 13) % 90 AS DOUBLE) END"),
]

ISSUE_COLUMNS = [
    ("issue_id", "l_orderkey * 8 + l_linenumber"),
    ("site_id", "l_suppkey"),
    ("q_index", "year(o_orderdate) * 4 + quarter(o_orderdate) - 1"),
    ("category", "CASE l_linenumber % 4 WHEN 0 THEN 'facility' WHEN 1 THEN 'equipment' "
                 "WHEN 2 THEN 'safety' ELSE 'supply' END"),
    ("severity", "6 - CAST(substr(o_orderpriority, 1, 1) AS INT)"),
    ("status", "CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END"),
    ("reported_date", "CAST(o_orderdate AS DATE)"),
]

LEASE_COLUMNS = [
    ("lease_type", "CASE WHEN site_id % 4 = 0 THEN 'owned' ELSE 'leased' END"),
    ("start_date", "DATE '1995-01-01' + CAST((site_id * 11) % 365 AS INT)"),
]

ARCHETYPES = [  # fixed values: (archetype_id, name) — one per market segment
    (1, "AUTOMOBILE"), (2, "BUILDING"), (3, "FURNITURE"), (4, "HOUSEHOLD"), (5, "MACHINERY"),
]

SPACE_TYPES = [  # fixed values: (id, name, unit, lead days, restricted, util low, util high)
    (1, "desk", "seat", 90, 0, 60, 85),
    (2, "lab_bench", "bench", 180, 0, 55, 80),
    (3, "scif_seat", "seat", 365, 1, 50, 80),
    (4, "parking", "stall", 60, 0, 50, 90),
    (5, "assembly_bay", "bay", 270, 0, 60, 85),
]

ARCHETYPE_SPACE_MAP = [  # fixed values: (archetype_id, space_type_id, ratio); missing pair = 0
    (1, 1, 0.5), (1, 4, 1.0), (1, 5, 0.25),
    (2, 1, 1.0), (2, 4, 0.75), (2, 5, 0.5),
    (3, 1, 0.75), (3, 2, 0.5), (3, 4, 0.5),
    (4, 1, 1.0), (4, 3, 0.25), (4, 4, 0.25),
    (5, 2, 1.0), (5, 3, 0.5), (5, 5, 0.75),
]

MILESTONES = [  # fixed values: ordered accreditation stages
    (1, "design_approval"), (2, "construction"), (3, "inspection"), (4, "accreditation"),
]

SPACE_CAPACITY_COLUMNS = [
    ("site_id", "s_suppkey"),
    ("space_type_id", "space_type_id"),
    ("capacity", "CASE WHEN (s_suppkey + space_type_id) % 7 = 0 THEN NULL "
                 "ELSE CAST(6 + (s_suppkey * 31 + space_type_id * 17) % 60 AS INT) END"),
    ("capacity_status", "CASE WHEN (s_suppkey + space_type_id) % 7 = 0 THEN 'audit_pending' "
                        "WHEN (s_suppkey + space_type_id) % 7 = 1 THEN 'planned' ELSE 'confirmed' END"),
]

ACTION_COLUMNS = [
    ("action_id", "o_orderkey"),
    ("site_id", "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE site_key END"),
    ("source", "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'collision' "
               "WHEN o_orderpriority = '3-MEDIUM' THEN 'quality' ELSE 'lease' END"),
    ("title", "'Review order ' || CAST(o_orderkey AS STRING)"),
    ("owner", "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'owner-' || CAST(o_custkey % 50 AS STRING) END"),
    ("due_date", "CAST(o_orderdate AS DATE) + 90"),
    ("status", "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'in_progress' END"),
    ("created_at", "CAST(o_orderdate AS DATE)"),
    ("est_remedy_cost_usd", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END"),
    ("est_delay_cost_usd_per_quarter", "CAST(o_totalprice AS DECIMAL(18,2)) * 0.1"),
]

DECISION_COLUMNS = [
    ("decision_id", "o_orderkey"),
    ("site_id", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE site_key END"),
    ("space_type_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 5 + 1 AS INT) END"),
    ("source", "CASE WHEN o_orderkey % 4 = 0 THEN 'manual' ELSE 'collision' END"),
    ("title", "'Decide on order ' || CAST(o_orderkey AS STRING)"),
    ("options_summary", "'expand / relocate demand / accept the risk'"),
    ("owner", "'owner-' || CAST(o_custkey % 50 AS STRING)"),
    ("decide_by_date", "CAST(o_orderdate AS DATE) + 90"),
    ("decided_at", "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) END"),
    ("decision_note", "CASE WHEN o_orderstatus = 'F' THEN 'decided' END"),
    ("created_at", "CAST(o_orderdate AS DATE)"),
]

INCENTIVE_COLUMNS = [
    ("agreement_id", "s_suppkey"),
    ("site_id", "s_suppkey"),
    ("authority", "n_name || ' development board'"),
    ("committed_jobs", "CAST(20 + s_suppkey % 40 AS INT)"),
    ("committed_capex_usd", "CAST(1000000 + (s_suppkey * 7919) % 900000 AS DECIMAL(18,2))"),
    ("actual_capex_usd", "CAST(800000 + (s_suppkey * 104729) % 900000 AS DECIMAL(18,2))"),
    ("measurement_date", "DATE '2001-05-01' + CAST((s_suppkey * 13) % 500 AS INT)"),
    ("clawback_risk_usd", "CAST(50000 + (s_suppkey % 10) * 10000 AS DECIMAL(18,2))"),
]

COHORT_COLUMNS = [
    ("cohort_id", "s_suppkey * 10 + archetype_id"),
    ("site_id", "s_suppkey"),
    ("archetype_id", "archetype_id"),
    ("start_q_index", "CAST(8004 + (s_suppkey * archetype_id) % 4 AS INT)"),
    ("headcount", "CAST(3 + (s_suppkey + archetype_id) % 12 AS INT)"),
    ("seat_ready", "CASE WHEN (s_suppkey + archetype_id) % 3 = 0 THEN 0 ELSE 1 END"),
    ("equipment_ready", "CASE WHEN (s_suppkey * archetype_id) % 5 = 0 THEN 0 ELSE 1 END"),
    ("badge_ready", "CASE WHEN (s_suppkey + 2 * archetype_id) % 7 = 0 THEN 0 ELSE 1 END"),
    ("parking_ready", "CASE WHEN (s_suppkey + archetype_id) % 2 = 0 THEN 1 ELSE 0 END"),
]

MILESTONE_COLUMNS = [
    ("milestone_id", "(site_id * 10 + space_type_id) * 10 + stage_no"),
    ("site_id", "site_id"),
    ("space_type_id", "space_type_id"),
    ("milestone", "milestone"),
    ("planned_date", "DATE '2000-01-01' + CAST(stage_no * 120 + (site_id * space_type_id) % 90 AS INT)"),
    ("actual_date", "CASE WHEN stage_no <= (site_id * 3 + space_type_id) % 5 "
                    "THEN DATE '2000-01-01' + CAST(stage_no * 120 + (site_id * space_type_id) % 90 "
                    "+ (site_id * 7 + space_type_id * 3) % 41 - 10 AS INT) END"),
]

PROGRAM_COLUMNS = [
    ("program_id", "s_suppkey"),
    ("program_name", "'Program ' || CAST(s_suppkey AS STRING)"),
    ("program_type", "CASE s_suppkey % 3 WHEN 0 THEN 'hardware' WHEN 1 THEN 'software' ELSE 'services' END"),
    ("primary_site_id", "s_suppkey"),
    ("secondary_site_id", "s_suppkey + 1"),
    ("status", "CASE WHEN s_suppkey % 8 = 1 THEN 'ramping' ELSE 'active' END"),
    ("units_per_quarter_current", "CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE CAST(10 + s_suppkey % 30 AS INT) END"),
    ("units_per_quarter_target", "CASE WHEN s_suppkey % 3 = 1 OR s_suppkey % 8 = 5 THEN NULL "
                                 "ELSE CAST(10 + s_suppkey % 30 + s_suppkey % 7 AS INT) END"),
    ("kw_per_unit", "CAST(1 + s_suppkey % 5 AS DOUBLE)"),
    ("sqft_per_unit", "CAST(10 + s_suppkey % 9 AS DOUBLE)"),
]


def _select(df: DataFrame, columns) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns])


def ts(date: str):
    """A timestamp_ntz literal for filters on the driver's date columns (keeps
    the predicate pushable to the Parquet scan)."""
    return F.expr(f"TIMESTAMP_NTZ '{date} 00:00:00'")


class DriverCatalog:
    """Lazily built role tables over one driver directory.

    Attributes are plain DataFrames (nothing is cached or collected); each is a
    logical plan that Catalyst prunes and pushes down when composed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF, materialize=True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = as_of
        # True (all shared parents), False (none) or the names to write once
        self.materialize = materialize
        self._raw: dict[str, DataFrame] = {}

    def keeps(self, name: str) -> bool:
        m = self.materialize
        return bool(m) if isinstance(m, bool) else name in m

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a shared aggregate once when this plan reads it more than once
        (see ``headroom.session.materialize``); otherwise stream it through."""
        return materialize(df) if self.keeps(name) else df

    # raw tables -------------------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        """The driver table (read once per catalog: one listing and footer read)."""
        if name not in self._raw:
            reader = self.spark.read
            if name in DRIVER_SCHEMAS:
                reader = reader.schema(DRIVER_SCHEMAS[name])
            self._raw[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def _literal(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # configuration as data (fixed, tiny: broadcast-safe) ---------------------
    @cached_property
    def archetypes(self) -> DataFrame:
        return self._literal([(a, n, f"{n.lower()} segment staff") for a, n in ARCHETYPES],
                             "archetype_id int, name string, description string")

    @cached_property
    def space_types(self) -> DataFrame:
        return self._literal(SPACE_TYPES, "space_type_id int, name string, unit_label string, "
                             "lead_time_days int, restricted_sensing int, target_util_low int, "
                             "target_util_high int")

    @cached_property
    def archetype_space_map(self) -> DataFrame:
        return self._literal(ARCHETYPE_SPACE_MAP, "archetype_id int, space_type_id int, ratio double")

    @cached_property
    def milestone_stages(self) -> DataFrame:
        return self._literal(MILESTONES, "stage_no int, milestone string")

    # sites --------------------------------------------------------------------
    @cached_property
    def supplier_geo(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        region = self.raw("region").select("r_regionkey", "r_name")
        # nation / region have a fixed cardinality (25 / 5): broadcast is bounded.
        return (self.raw("supplier")
                .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
                .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))

    @cached_property
    def sites(self) -> DataFrame:
        return _select(self.supplier_geo, SITE_COLUMNS)

    # facts ----------------------------------------------------------------------
    def _lineitem_window(self, cols) -> DataFrame:
        return (self.raw("lineitem").select(*cols)
                .where((F.col("l_shipdate") >= ts(DEMAND_FROM)) & (F.col("l_shipdate") < ts(DEMAND_TO))))

    @cached_property
    def production_demand(self) -> DataFrame:
        """One row per shipped line: units = quantity, floor per unit 1, power per
        unit = part size (integer-valued doubles keep every sum exact)."""
        li = self._lineitem_window(["l_suppkey", "l_partkey", "l_quantity", "l_shipdate"])
        part = self.raw("part").select("p_partkey", "p_size", "p_brand")
        return (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
                .select(F.col("l_suppkey").alias("site_id"),
                        q_index_of_date("l_shipdate").alias("q_index"),
                        F.col("p_brand").alias("program"),
                        F.col("l_quantity").alias("units_planned"),
                        F.lit(1.0).alias("sqft_per_unit"),
                        F.col("p_size").cast("double").alias("kw_per_unit"))
                .withColumn("quarter", q_label("q_index")))

    @cached_property
    def quality_issues(self) -> DataFrame:
        """Every line of an order placed before the as-of date is an issue."""
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
        orders = (self.raw("orders")
                  .select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
                  .where((F.col("o_orderdate") >= ts(ACTION_FROM)) & (F.col("o_orderdate") < ts(self.as_of))))
        df = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return _select(df, ISSUE_COLUMNS).withColumn("quarter", q_label("q_index"))

    @cached_property
    def leases(self) -> DataFrame:
        """One lease per site with shipments."""
        li = self._lineitem_window(["l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"])
        agg = (li.groupBy(F.col("l_suppkey").alias("site_id"))
               .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("annual_rent_usd"),
                    (F.sum("l_quantity").cast("decimal(18,2)") * F.lit(40)).alias("opex_usd_yr")))
        return self.keep(agg.select(F.col("site_id").alias("lease_id"), "site_id", "annual_rent_usd", "opex_usd_yr",
                                    *[F.expr(e).alias(n) for n, e in LEASE_COLUMNS]), "leases")

    def _shipments(self, li_where=None, orders_where=None) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate")
        if li_where is not None:
            li = li.where(li_where)
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        if orders_where is not None:
            orders = orders.where(orders_where)
        cust = self.raw("customer").select("c_custkey", "c_mktsegment")
        arch = F.broadcast(self.archetypes.select("archetype_id", F.col("name").alias("c_mktsegment")))
        return (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(cust, F.col("o_custkey") == F.col("c_custkey"))
                .join(arch, "c_mktsegment"))

    @cached_property
    def headcount_snapshots(self) -> DataFrame:
        """Staff per (site, quarter, segment) = distinct customers served."""
        sh = self._shipments(li_where=(F.col("l_shipdate") >= ts(DEMAND_FROM)) & (F.col("l_shipdate") < ts(DEMAND_TO)))
        agg = (sh.groupBy(F.col("l_suppkey").alias("site_id"),
                          q_index_of_date("l_shipdate").alias("q_index"),
                          F.col("c_mktsegment").alias("archetype"))
               .agg(F.countDistinct("o_custkey").cast("int").alias("headcount")))
        return self.keep(agg.select("site_id", q_label("q_index").alias("quarter"), "q_index",
                                    F.col("archetype").alias("program"), "archetype", "headcount"),
                         "headcount_snapshots")

    @cached_property
    def requisition_pipeline(self) -> DataFrame:
        """Open requisitions = distinct pending orders per (site, segment, quarter)."""
        sh = self._shipments(orders_where=(F.col("o_orderstatus") == "P")
                             & (F.col("o_orderdate") >= ts(REQ_FROM)) & (F.col("o_orderdate") < ts(self.as_of)))
        agg = (sh.groupBy(F.col("l_suppkey").alias("site_id"), "archetype_id",
                          q_index_of_date("o_orderdate").alias("q_index"))
               .agg(F.countDistinct("o_orderkey").cast("int").alias("open_reqs"),
                    F.max((F.lit(20) + F.col("l_partkey") % 300).cast("int")).alias("avg_time_to_fill_days")))
        return self.keep(agg.select("site_id", "archetype_id", q_label("q_index").alias("quarter"), "q_index",
                                    "open_reqs", "avg_time_to_fill_days"), "requisition_pipeline")

    @cached_property
    def _orders_with_site(self) -> DataFrame:
        """Orders of the trailing year with the lowest supplier among their lines."""
        orders = (self.raw("orders")
                  .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                          "o_orderpriority")
                  .where((F.col("o_orderdate") >= ts(ACTION_FROM)) & (F.col("o_orderdate") < ts(self.as_of))))
        site = (self.raw("lineitem").select("l_orderkey", "l_suppkey")
                .groupBy("l_orderkey").agg(F.min("l_suppkey").alias("site_key")))
        return self.keep(orders.join(site, F.col("o_orderkey") == F.col("l_orderkey"), "left")
                         .drop("l_orderkey"), "orders_with_site")

    @cached_property
    def actions(self) -> DataFrame:
        return _select(self._orders_with_site, ACTION_COLUMNS)

    @cached_property
    def decisions(self) -> DataFrame:
        return _select(self._orders_with_site.where(F.col("o_orderpriority") == "1-URGENT"), DECISION_COLUMNS)

    @cached_property
    def constraints(self) -> DataFrame:
        return self._literal(CONSTRAINTS, K.CONSTRAINTS)

    @cached_property
    def constraint_capacity(self) -> DataFrame:
        wide = self.raw("supplier").select(F.col("s_suppkey").alias("site_id"), *[F.expr(e).alias(n) for n, e in CAPACITY_COLUMNS])
        return K.spread(wide, ["site_id"], {n: n for n, _ in CAPACITY_COLUMNS}, "capacity")

    @cached_property
    def constraint_demand(self) -> DataFrame:
        """Floor, power and dock lines per (site, period), aggregated once and then spread over the constraints."""
        d = self.production_demand
        per = d.groupBy("site_id", "q_index").agg(F.sum(F.col("units_planned") * F.col("sqft_per_unit")).alias("floor"),
                                                  F.sum(F.col("units_planned") * F.col("kw_per_unit")).alias("power"),
                                                  F.count(F.lit(1)).alias("dock"))
        return K.spread(per, ["site_id", "q_index"], {c: c for c, *_ in CONSTRAINTS}, "amount")

    # per-site configuration -----------------------------------------------------
    @cached_property
    def space_capacity(self) -> DataFrame:
        ids = F.array(*[F.lit(r[0]) for r in SPACE_TYPES])
        df = self.raw("supplier").select("s_suppkey", F.explode(ids).alias("space_type_id"))
        return _select(df, SPACE_CAPACITY_COLUMNS)

    @cached_property
    def incentive_agreements(self) -> DataFrame:
        return _select(self.supplier_geo, INCENTIVE_COLUMNS)

    @cached_property
    def onboarding_cohorts(self) -> DataFrame:
        ids = F.array(*[F.lit(a) for a, _ in ARCHETYPES])
        df = self.raw("supplier").select("s_suppkey", F.explode(ids).alias("archetype_id"))
        return _select(df, COHORT_COLUMNS).withColumn("start_quarter", q_label("start_q_index")).drop("start_q_index")

    @cached_property
    def accreditation_milestones(self) -> DataFrame:
        cap = self.space_capacity.where(F.col("capacity_status").isin("planned", "audit_pending"))
        stages = F.array(*[F.struct(F.lit(n).alias("stage_no"), F.lit(m).alias("milestone")) for n, m in MILESTONES])
        df = (cap.select("site_id", "space_type_id", F.explode(stages).alias("st"))
              .select("site_id", "space_type_id", "st.stage_no", "st.milestone"))
        return _select(df, MILESTONE_COLUMNS)

    @cached_property
    def programs(self) -> DataFrame:
        return _select(self.raw("supplier"), PROGRAM_COLUMNS)
