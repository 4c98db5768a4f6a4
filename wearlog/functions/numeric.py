"""Null-aware arithmetic and window helpers shared by all operators.

The diary reports follow statistics-package rules where Spark's defaults differ:
a plain sum is unknown if any addend is unknown, ratios never fail, rounding is
half-even, and a rolling window is empty until it is full.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def overflows(a: Column | str, b: Column | str) -> Column:
    """True where a / b would be infinite."""
    return (_col(b) == 0) & (_col(a) > 0)


def rounded(c: Column | str, digits: int = 0) -> Column:
    """Half-even rounding."""
    return F.bround(_col(c), digits)


def as_int(condition: Column | str) -> Column:
    """1, 0 or null for true, false or null."""
    return _col(condition).cast("int")


def count_if(condition: Column | str) -> Column:
    """Rows where the condition holds; null counts as not holding."""
    return F.count(F.when(_col(condition), F.lit(1)))


def strict_sum(c: Column | str) -> Column:
    """Sum that is null when any addend is null."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def loose_sum(c: Column | str) -> Column:
    """Sum over the known values, 0 when there are none."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def strict_sum_if(c: Column | str, condition: Column) -> Column:
    """strict_sum over the rows where the condition holds; null when no row does."""
    c = _col(c)
    unknown = F.count(F.when(condition & c.isNull(), F.lit(1)))
    return F.when(unknown == 0, F.sum(F.when(condition, c)))


def running_sum(c: Column | str, w: WindowSpec) -> Column:
    """Running sum that stays null from the first null on."""
    c = _col(c)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.when(F.count(c).over(so_far) == F.count(F.lit(1)).over(so_far), F.sum(c).over(so_far))


def rolling(
    agg: Column, w: WindowSpec, width: int, min_rows: int | None = None, of: Column | str | None = None
) -> Column:
    """Aggregate over the last ``width`` rows, null until ``min_rows`` (default: all) are there.

    With ``of`` only rows with a known value of that column count.
    """
    frame = w.rowsBetween(-(width - 1), W.currentRow)
    need = width if min_rows is None else min_rows
    seen = F.count(F.lit(1) if of is None else _col(of))
    return F.when(seen.over(frame) >= need, agg.over(frame))


def capped(c: Column | str, ceiling: float) -> Column:
    """Value limited to a ceiling, null stays null."""
    c = _col(c)
    return F.when(c > ceiling, F.lit(float(ceiling))).otherwise(c)


def floored(c: Column | str, floor: float) -> Column:
    """Value limited from below, null stays null."""
    c = _col(c)
    return F.when(c < floor, F.lit(float(floor))).otherwise(c)
