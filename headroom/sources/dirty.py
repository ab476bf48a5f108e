"""Raw (all-string) exports derived from the driver tables, with the dirt the
cleaning layer must handle: code spellings (case, spacing, aliases), 'MM/YYYY'
quarters, '12.0' counts, conflicting duplicates, orphan codes, and acquired
sites split over a USD and a CAD row with '$1,200'-style money.

Rules are SQL text shared with the DuckDB oracle, like ``driver``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.sources.driver import DriverCatalog

SITE_CODE = "lower(replace(s_name, '#', '-'))"

KNOWN_COLUMNS = [("code", SITE_CODE), ("site_id", "s_suppkey")]
ALIAS_COLUMNS = [("alias", "'sup' || CAST(s_suppkey AS STRING)"), ("code", SITE_CODE)]

# headcount rows (from the headcount role) rendered as an HRIS export
_V = "(site_id + q_index)"
HRIS_BASE_COLUMNS = [
    ("seq", "site_id * 1000000 + q_index * 10 + archetype_id"),
    ("site_code", f"CASE {_V} % 4 WHEN 0 THEN code WHEN 1 THEN '  ' || upper(code) || ' ' "
                  f"WHEN 2 THEN replace(code, '-', ' ') "
                  f"ELSE 'SUP' || CAST(site_id AS STRING) END"),
    ("quarter_raw", f"CASE WHEN {_V} % 3 = 0 THEN lpad(CAST((CAST(substr(quarter, 7, 1) AS INT) - 1) * 3 + 2 AS STRING), "
                    f"2, '0') || '/' || substr(quarter, 1, 4) ELSE quarter END"),
    ("program", "archetype"),
    ("archetype", "archetype"),
    ("headcount_raw", f"CASE WHEN {_V} % 5 = 0 THEN CAST(headcount AS STRING) || '.0' "
                      f"ELSE CAST(headcount AS STRING) END"),
]
# an earlier, conflicting duplicate of some rows
HRIS_DUP_COLUMNS = [
    ("seq", "site_id * 1000000 + q_index * 10 + archetype_id - 5"),
    ("site_code", "code"), ("quarter_raw", "quarter"), ("program", "archetype"), ("archetype", "archetype"),
    ("headcount_raw", "CAST(headcount + 3 AS STRING)"),
]
HRIS_DUP_FILTER = f"{_V} % 11 = 0"
# rows from a site code no registry knows
HRIS_ORPHAN_COLUMNS = [
    ("seq", "site_id * 1000000 + q_index * 10 + archetype_id + 7"),
    ("site_code", "'supplier-x' || CAST(site_id AS STRING)"), ("quarter_raw", "quarter"),
    ("program", "archetype"), ("archetype", "archetype"), ("headcount_raw", "CAST(headcount AS STRING)"),
]
HRIS_ORPHAN_FILTER = "(site_id * 7 + q_index) % 13 = 0"

# every site also arrives as two raw rows of an acquired-site dump
_RENT = "(1000000 + s_suppkey * 1000)"
_CAD_RENT = "(1370000 + s_suppkey * 1370)"


def _money_text(x: str) -> str:
    return f"'$' || CAST(CAST(floor({x} / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST({x} % 1000 AS STRING), 3, '0')"


ACQ_USD_COLUMNS = [
    ("seq", "s_suppkey * 10 + 1"),
    ("facility_code", f"upper({SITE_CODE})"),
    ("facility_name", "''"),
    ("loc_region", "r_name"),
    ("gross_sq_ft", "CASE WHEN s_suppkey % 20 = 1 OR s_acctbal < 0 THEN '' "
                    "ELSE CAST(CAST(500 + floor(s_acctbal / 8) AS BIGINT) AS STRING) END"),
    ("workstations", "CAST(8 + (s_suppkey * 17) % 40 AS STRING)"),
    ("annual_rent", _money_text(_RENT)),
    ("op_ex", "CAST(50000 + s_suppkey * 10 AS STRING)"),
    ("currency", "'USD'"),
]
ACQ_CAD_COLUMNS = [
    ("seq", "s_suppkey * 10 + 2"),
    ("facility_code", f"replace({SITE_CODE}, '-', ' ')"),
    ("facility_name", "s_name"),
    ("loc_region", "''"),
    ("gross_sq_ft", "CASE WHEN s_suppkey % 20 = 11 THEN '0' ELSE CAST(600 + s_suppkey % 400 AS STRING) END"),
    ("workstations", "''"),
    ("annual_rent", _money_text(_CAD_RENT)),
    ("op_ex", "''"),
    ("currency", "'cad'"),
]


# space capacity rows rendered as an export; blank status means 'confirmed'
_W = "(site_id + space_type_id)"
CAPACITY_COLUMNS = [
    ("seq", "site_id * 10 + space_type_id"),
    ("site_code", f"CASE {_W} % 3 WHEN 0 THEN code WHEN 1 THEN upper(code) ELSE replace(code, '-', '_') END"),
    ("space_type_id", "CAST(space_type_id AS STRING)"),
    ("capacity", "COALESCE(CAST(capacity AS STRING), '')"),
    ("capacity_status", f"CASE WHEN capacity_status = 'confirmed' AND {_W} % 4 = 0 THEN '' ELSE capacity_status END"),
]
CAPACITY_ORPHAN_COLUMNS = [
    ("seq", "site_id * 10 + space_type_id + 5"),
    ("site_code", "'closed-' || code"),
    ("space_type_id", "CAST(space_type_id AS STRING)"),
    ("capacity", "'10'"),
    ("capacity_status", "'confirmed'"),
]
CAPACITY_ORPHAN_FILTER = "(site_id * 3 + space_type_id) % 17 = 0"


def _select(df: DataFrame, columns) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns])


class DirtyExports:
    """The raw exports of one driver catalog."""

    def __init__(self, cat: DriverCatalog):
        self.cat = cat

    @cached_property
    def known_codes(self) -> DataFrame:
        return _select(self.cat.raw("supplier"), KNOWN_COLUMNS)

    @cached_property
    def aliases(self) -> DataFrame:
        return _select(self.cat.raw("supplier"), ALIAS_COLUMNS)

    @cached_property
    def hris(self) -> DataFrame:
        arch = F.broadcast(self.cat.archetypes.select("archetype_id", F.col("name").alias("archetype")))
        names = self.cat.raw("supplier").select(F.col("s_suppkey").alias("site_id"),
                                                F.expr(SITE_CODE).alias("code"))
        hc = self.cat.headcount_snapshots.join(arch, "archetype").join(names, "site_id")
        return (_select(hc, HRIS_BASE_COLUMNS)
                .unionByName(_select(hc.where(F.expr(HRIS_DUP_FILTER)), HRIS_DUP_COLUMNS))
                .unionByName(_select(hc.where(F.expr(HRIS_ORPHAN_FILTER)), HRIS_ORPHAN_COLUMNS)))

    @cached_property
    def capacity_export(self) -> DataFrame:
        names = self.cat.raw("supplier").select(F.col("s_suppkey").alias("site_id"),
                                                F.expr(SITE_CODE).alias("code"))
        cap = self.cat.space_capacity.join(names, "site_id")
        return (_select(cap, CAPACITY_COLUMNS)
                .unionByName(_select(cap.where(F.expr(CAPACITY_ORPHAN_FILTER)), CAPACITY_ORPHAN_COLUMNS)))

    @cached_property
    def acquired_dump(self) -> DataFrame:
        s = self.cat.supplier_geo
        return _select(s, ACQ_USD_COLUMNS).unionByName(_select(s, ACQ_CAD_COLUMNS))
