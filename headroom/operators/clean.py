"""Cleaning and reconciliation.

Raw exports arrive as all-string rows with an ingest sequence ``seq``.  Codes
are resolved on the *distinct* raw codes first (a small table), then joined
back once; de-duplication keeps the last row per key with an aggregation
(map-side combine), so a hot key never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.functions.clean import code_key, code_slug, int_value, money, raw_json
from headroom.functions.numeric import round_half_up
from headroom.operators.workflow import dense_ids
from headroom.session import materialize

col = F.col

# Fixed value: reference conversion rate applied to quarantined CAD amounts.
CAD_TO_USD = 0.73


def _one_value(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` of the keys that have one value."""
    return (pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__high"))
            .where(col(value) == col("__high")).select(key, value))


def canonical_codes(raw_codes: DataFrame, code_col: str, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """B1: map each distinct raw code to a site id: alias hit, else known code,
    else its slug if known, else null.  ``aliases(alias, code)`` and
    ``known(code, site_id)`` hold lower-case keys; a key that they repeat with different
    values is ambiguous and maps to nothing, so its rows are quarantined, not multiplied."""
    known, aliases = _one_value(known, "code", "site_id"), _one_value(aliases, "alias", "code")
    codes = raw_codes.select(col(code_col).alias("raw_code")).where(col("raw_code").isNotNull()).distinct()
    codes = codes.select("raw_code", code_key("raw_code").alias("key"))
    codes = codes.select("raw_code", "key", code_slug("key").alias("slug"))
    k_alias = (aliases.select(col("alias").alias("key"), col("code").alias("a_code"))
               .join(known.select(col("code").alias("a_code"), col("site_id").alias("via_alias")), "a_code")
               .select("key", "via_alias"))
    k_direct = known.select(col("code").alias("key"), col("site_id").alias("via_key"))
    k_slug = known.select(col("code").alias("slug"), col("site_id").alias("via_slug"))
    return (codes.join(k_alias, "key", "left").join(k_direct, "key", "left").join(k_slug, "slug", "left")
            .select("raw_code", F.coalesce("via_alias", "via_key", "via_slug").alias("site_id")))


def resolve_codes(raw: DataFrame, code_col: str, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Attach ``site_id`` (null when unresolved) to every raw row."""
    mapping = canonical_codes(raw, code_col, aliases, known)
    return raw.join(mapping.withColumnRenamed("raw_code", code_col), code_col, "left")


def quarantine_split(resolved: DataFrame, raw_cols: list[str], source_file: str,
                     reason) -> tuple[DataFrame, DataFrame]:
    """Rows without a site go to the exceptions table (with the raw row as
    JSON and a reason); the rest continue."""
    good = resolved.where(col("site_id").isNotNull())
    bad = (resolved.where(col("site_id").isNull())
           .select("seq", F.lit(source_file).alias("source_file"), raw_json(raw_cols).alias("raw_row"),
                   reason.alias("reason")))
    return good, bad


def keep_last(df: DataFrame, keys: list[str], seq: str, values: list[str], compare: str) -> tuple[DataFrame, DataFrame]:
    """Keep the last row (highest ``seq``) per key; log each earlier row
    whose ``compare`` value differs from the kept one (one log row per
    dropped value — nothing is collected per key)."""
    kept = (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*[col(v) for v in values], col(seq).alias("_seq")), seq).alias("k"))
            .select(*keys, *[col(f"k.{v}").alias(v) for v in values], col("k._seq").alias(seq)))
    ref = kept.select(*keys, col(compare).alias("kept_value"), col(seq).alias("kept_seq"))
    log = (df.select(*keys, col(compare).alias("dropped_value"), col(seq).alias("dropped_seq"))
           .join(ref, keys)
           .where((col("dropped_seq") < col("kept_seq")) & ~col("dropped_value").eqNullSafe(col("kept_value"))))
    return kept, log


def first_present(value, seq: str):
    """B10 helper: the value of the earliest row (by ``seq``) where the value
    is present (not null, not blank, not 0)."""
    v = value
    present = v.isNotNull() & (v.cast("string") != "") & ~(v.cast("string").isin("0", "0.0"))
    return F.min_by(v, F.when(present, col(seq)))


def merge_entities(resolved: DataFrame, rates: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold several raw rows of one acquired entity into one site:
    first present name / region / size / seats in file order; the USD row's
    rent and opex are authoritative.  Rows in another currency (or none) are quarantined with
    their conversion at ``rates`` (currency -> USD; CAD by default), and rows without a site are
    quarantined whole; neither amount is loaded."""
    rates = {"CAD": CAD_TO_USD} if rates is None else rates
    unit = F.coalesce(F.upper(F.trim("currency")), F.lit(""))
    rows = resolved.select(
        "seq", "site_id", "facility_code", "currency",
        F.when(F.trim("facility_name") != "", F.trim("facility_name")).alias("name"),
        F.when(F.trim("loc_region") != "", F.trim("loc_region")).alias("region"),
        int_value("gross_sq_ft").alias("sq_ft"), int_value("workstations").alias("seats"),
        money("annual_rent").alias("rent"), money("op_ex").alias("opex"))
    usd = unit == "USD"
    merged = (rows.where(col("site_id").isNotNull()).groupBy("site_id")
              .agg(first_present(col("name"), "seq").alias("site_name"),
                   first_present(col("region"), "seq").alias("region"),
                   first_present(col("sq_ft"), "seq").alias("sq_ft"),
                   first_present(col("seats"), "seq").alias("seat_capacity"),
                   F.min_by(col("rent"), F.when(usd, col("seq"))).cast("double").alias("annual_rent_usd"),
                   F.min_by(col("opex"), F.when(usd, col("seq"))).cast("double").alias("opex_usd_yr")))
    held = resolved.where(col("site_id").isNull() | ~usd)
    code = F.coalesce(col("facility_code"), F.lit(""))
    reason = F.when(col("site_id").isNull(), F.concat(F.lit("no site for facility code '"), code, F.lit("'")))
    for name, rate in rates.items():
        value = F.coalesce(F.format_number(round_half_up(money("annual_rent") * F.lit(rate), 0), 0), F.lit("unknown"))
        reason = reason.when(unit == name, F.concat(
            F.lit(f"currency/value conflict: {name} row for '"), code, F.lit("' (~USD "), value,
            F.lit(f" at the reference rate); kept the USD row, {name} row needs sign-off")))
    reason = reason.otherwise(F.concat(F.lit("currency '"), unit, F.lit("' without a rate for '"), code, F.lit("'")))
    exceptions = held.select("seq", F.lit("acquired_site_dump.csv").alias("source_file"),
                            raw_json(ACQUIRED_RAW_COLS).alias("raw_row"), reason.alias("reason"))
    return merged, exceptions


ACQUIRED_RAW_COLS = ["seq", "facility_code", "facility_name", "loc_region", "gross_sq_ft", "workstations",
                     "annual_rent", "op_ex", "currency"]
HRIS_RAW_COLS = ["seq", "site_code", "quarter_raw", "program", "archetype", "headcount_raw"]
CAPACITY_RAW_COLS = ["seq", "site_code", "space_type_id", "capacity", "capacity_status"]


def with_surrogate_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Ids 1..n in ``order`` (ingest order), distributed numbering."""
    return dense_ids(df, order, F.lit(0)).withColumnRenamed("_id", name)


def lasting_ids(store, df: DataFrame, keys: list[str], name: str, table: str) -> DataFrame:
    """B12 with memory: ``df`` with an id per key that stays the key's for good.  ``table`` of a ``TableStore`` holds ``keys, name``; keys that
    it lacks get the next block of ids in key order, and a run that loses the commit to another numbers only what is still missing.
    Null key values are values like others."""
    wanted = materialize(df.select(*keys).distinct())

    def work(now: dict) -> dict:
        known = store.read(table, now)
        if known is None:
            new, top = wanted, F.lit(0).cast("long")
        else:
            same = [col(f"w.{k}").eqNullSafe(col(f"k.{k}")) for k in keys]
            on = same[0]
            for s in same[1:]:
                on = on & s
            new, top = wanted.alias("w").join(known.alias("k"), on, "left_anti"), known.agg(F.coalesce(F.max(name), F.lit(0))).scalar()
        new = materialize(dense_ids(new, keys, top).select(*keys, col("_id").cast("long").alias(name)))
        if new.limit(1).count() == 0:
            return now
        return {**now, table: now.get(table, []) + [store.put(table, new)]}

    ids = store.read(table, store.change(work))
    if ids is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    on = None
    for k in keys:
        same = col(f"d.{k}").eqNullSafe(col(f"i.{k}"))
        on = same if on is None else on & same
    return df.alias("d").join(ids.alias("i"), on).select("d.*", col(f"i.{name}").alias(name))


def semi_filter(resolved: DataFrame, raw_cols: list[str], source_file: str) -> tuple[DataFrame, DataFrame]:
    """Configuration rows with an unknown site are not loaded; unlike a
    silent drop they are also reported as exceptions."""
    return quarantine_split(resolved, raw_cols, source_file,
                            F.lit("unknown site (configuration row not loaded)"))
