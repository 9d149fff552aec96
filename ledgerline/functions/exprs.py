"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.model import MONEY


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Round to cents and keep DECIMAL(12,2)."""
    return F.round(col(c), 2).cast(MONEY)


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / NULLIF(den, 0) in double precision (decimal sums stay exact until here)."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def pct(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """ROUND(num / NULLIF(den,0) * 100, scale)."""
    return F.round(safe_div(num, den) * F.lit(100.0), scale)


def growth(cur: str | Column, prev: str | Column) -> Column:
    """(cur - prev) / NULLIF(prev, 0) computed on the exact decimals."""
    return safe_div(col(cur) - col(prev), prev)


def avg_money(sum_col: str, n_col: str) -> Column:
    """ROUND(sum / n, 2), half away from zero, computed exactly in integer
    cents (36 digits) for a DECIMAL(_,2) sum and a row count (NULL when n = 0).

    Rounding the double quotient instead can flip a tie such as x.xx5.
    """
    cents = f"CAST({sum_col} * 100 AS DECIMAL(36,0))"
    x, d = f"(2 * abs({cents}) + {n_col})", f"(2 * {n_col})"
    q = f"sign({cents}) * CAST(({x} - {x} % {d}) / {d} AS DECIMAL(38,0))"  # divides without a rest
    return F.expr(f"CASE WHEN {n_col} = 0 THEN NULL ELSE CAST({q} AS DOUBLE) / 100D END")


def ntile_from_row_number(rn: str | Column, n: str | Column, k: int) -> Column:
    """NTILE(k) from a 1-based row number ``rn`` in a set of ``n`` rows.

    With q = n div k and m = n mod k the first m tiles hold q+1 rows and the
    rest q rows (SQL standard NTILE).
    """
    rn, n = col(rn).cast("long"), col(n).cast("long")
    q = F.floor(n / F.lit(k)).cast("long")
    m = (n - q * F.lit(k)).cast("long")
    big = m * (q + F.lit(1))
    first = F.ceil(rn / (q + F.lit(1)))
    rest = m + F.ceil((rn - big) / F.nullif(q, F.lit(0)))
    return F.when(rn <= big, first).otherwise(rest).cast("long")


def case_map(c: str | Column, mapping: dict, default=None) -> Column:
    """Simple CASE c WHEN k THEN v ... END as a chained ``when``."""
    out = None
    for key, value in mapping.items():
        out = (F.when(col(c) == F.lit(key), F.lit(value)) if out is None
               else out.when(col(c) == F.lit(key), F.lit(value)))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)
