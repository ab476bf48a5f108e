"""Tiny helpers for writing the DuckDB oracle SQL (text only, no parsing)."""

from __future__ import annotations


def rhu(x: str, digits: int = 0) -> str:
    """Round half away from zero on the binary value (same formula as
    ``headroom.functions.numeric.round_half_up``)."""
    s = float(10 ** digits)
    return f"(sign(CAST({x} AS DOUBLE)) * floor(abs(CAST({x} AS DOUBLE)) * {s} + 0.5) / {s})"


def qlabel(idx: str) -> str:
    return f"(CAST(({idx}) // 4 AS VARCHAR) || '-Q' || CAST(({idx}) % 4 + 1 AS VARCHAR))"


def qindex_label(label: str) -> str:
    return f"(CAST(split_part({label}, '-Q', 1) AS BIGINT) * 4 + CAST(split_part({label}, '-Q', 2) AS BIGINT) - 1)"


def qstart(idx: str) -> str:
    """First day of a period before the year 10000, else null."""
    return f"CASE WHEN ({idx}) < 40000 THEN make_date(({idx}) // 4, (({idx}) % 4) * 3 + 1, 1) END"


def qstart_day(idx: str) -> str:
    """Days from 1970-01-01 to a period's first day: whole 400-year cycles of 146097 days, and the day in one."""
    return (f"((({idx}) // 1600) * 146097 + (make_date(2000 + ((({idx}) // 4) % 400), (({idx}) % 4) * 3 + 1, 1)"
            f" - DATE '2000-01-01') - 719528)")


def trunc_int(x: str) -> str:
    """Cast to integer truncating toward zero (DuckDB's cast rounds)."""
    return f"CAST(trunc({x}) AS INTEGER)"


def trunc_periods(x: str) -> str:
    """A count of periods, which stays at 2^53 where a double has no neighbouring whole numbers."""
    return f"CAST(trunc(least({x}, 9007199254740992.0)) AS BIGINT)"


def cols(columns) -> str:
    return ",\n  ".join(f"{expr} AS {name}" for name, expr in columns)


def values(rows, names) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


class CteSet:
    """Named CTEs with dependencies; ``build`` emits a WITH clause holding the
    transitive closure of what a query needs, in definition order."""

    def __init__(self):
        self._defs: dict[str, tuple[str, tuple[str, ...]]] = {}

    def add(self, name: str, sql: str, deps=()):
        self._defs[name] = (sql, tuple(deps))

    def closure(self, names) -> list[str]:
        need: set[str] = set()

        def visit(n):
            if n in need:
                return
            need.add(n)
            for d in self._defs[n][1]:
                visit(d)

        for n in names:
            visit(n)
        return [n for n in self._defs if n in need]

    def build(self, body: str, *names: str) -> str:
        order = self.closure(names)
        if not order:
            return body
        parts = ",\n".join(f"{n} AS (\n{self._defs[n][0]}\n)" for n in order)
        stripped = body.lstrip()
        if stripped[:5].upper() == "WITH ":      # the query's own CTEs follow ours
            return f"WITH {parts},\n{stripped[5:]}"
        return f"WITH {parts}\n{body}"
