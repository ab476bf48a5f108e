"""Saved, parameterised queries over the published views.

A domain names a view and the filters it allows; values are compared as the
column's type (one that cannot be converted matches nothing), never spliced into SQL
text.  A filter the domain does not offer is an error, not silently ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# View names, and the domains with their filters.
VIEW_NAME = re.compile(r"^[a-z][a-z0-9_]*$")

# domain -> (plan attribute or callable, {filter: column})
DOMAINS: dict[str, tuple[str, dict[str, str]]] = {
    "quality": ("quality_sq", {"site": "site_id", "quarter": "quarter"}),
    "cost": ("cost", {"site": "site_id"}),
    "seats": ("headcount_vs_seats", {"site": "site_id", "quarter": "quarter"}),
    "capacity": ("capacity_vs_demand", {"site": "site_id", "quarter": "quarter"}),
    "collision": ("collision", {"site": "site_id", "status": "collision_status"}),
}


def saved_query(views: dict[str, Callable[[], DataFrame]], domain: str, filters: dict[str, str] | None = None,
                promote: str | None = None) -> DataFrame:
    """The domain's view with equality filters; ``promote`` registers the
    result as a named temporary view."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}; choose from {sorted(DOMAINS)}")
    view, allowed = DOMAINS[domain]
    df = views[view]()
    for key, value in (filters or {}).items():
        if key not in allowed:
            raise ValueError(f"domain {domain!r} has no filter {key!r}; allowed: {sorted(allowed)}")
        if value is None or value == "":
            continue
        name = allowed[key]
        df = df.where(F.col(name) == F.lit(str(value)).try_cast(df.schema[name].dataType))
    if promote is not None:
        if not VIEW_NAME.match(promote):
            raise ValueError(f"invalid view name {promote!r}")
        df.createOrReplaceTempView(promote)
    return df


#: Stored definitions: a saved query by its name.
DEFINITION = "name string, domain string, filters string"


def promote(store, views: dict[str, Callable[[], DataFrame]], name: str, domain: str, filters: dict[str, str] | None = None) -> None:
    """Keep a saved query for good: its definition is validated as ``saved_query`` does and put under its name (replacing
    one of that name) in the table ``saved_queries`` of a ``TableStore``, and the view exists in this session."""
    df = saved_query(views, domain, filters)
    if not VIEW_NAME.match(name):
        raise ValueError(f"invalid view name {name!r}")
    row = df.sparkSession.createDataFrame([(name, domain, json.dumps(filters or {}, sort_keys=True))], DEFINITION)

    def work(now: dict) -> dict:
        kept = store.read("saved_queries", now)
        rows = row if kept is None else kept.where(F.col("name") != name).unionByName(row)
        return {**now, "saved_queries": [store.put("saved_queries", rows)]}

    store.change(work)
    df.createOrReplaceTempView(name)


def load_promoted(store, views: dict[str, Callable[[], DataFrame]]) -> dict[str, str]:
    """Make every stored definition a view of this session; returns ``{name: reason}`` of those that are not valid (any more)."""
    kept, failed = store.read("saved_queries"), {}
    for row in [] if kept is None else kept.collect():           # one small row per promoted query
        try:
            saved_query(views, row["domain"], json.loads(row["filters"]), promote=row["name"])
        except ValueError as e:
            failed[row["name"]] = str(e)
    return failed
