"""Shared column expressions and fixed lookup values."""

from ledgerline.functions.exprs import (
    case_map,
    dbl,
    growth,
    money,
    ntile_from_row_number,
    pct,
    safe_div,
)

__all__ = ["case_map", "dbl", "growth", "money", "ntile_from_row_number", "pct", "safe_div"]
