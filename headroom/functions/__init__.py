"""Column-expression building blocks (all JVM-side, codegen-friendly)."""

from headroom.functions.numeric import round_half_up, safe_ratio, pct
from headroom.functions.period import (
    q_index_of_date, q_index_of_label, q_first_date, q_label, q_start_date, q_start_day,
)
from headroom.functions.projection import WALL, with_binding, with_projection

__all__ = [
    "round_half_up", "safe_ratio", "pct",
    "q_index_of_date", "q_index_of_label", "q_first_date", "q_label", "q_start_date", "q_start_day",
    "WALL", "with_projection", "with_binding",
]
