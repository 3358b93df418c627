"""Derived scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names in calendar order (month 1 .. 12).
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]

# ISO-week bands of the arrival season (inclusive ranges);
# everything else, null included, is Winter.
SEASON_BANDS = [("Spring", 10, 21), ("Summer", 22, 34), ("Fall", 35, 47)]
SEASON_DEFAULT = "Winter"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total_stay(weekend_nights, week_nights) -> Column:
    """Sum in a wide integer type (narrow sums could overflow)."""
    return _col(weekend_nights).cast("int") + _col(week_nights).cast("int")


def price_per_person(price, *party) -> Column:
    """Price / party size; a party of 0 counts as 1; a null part gives null."""
    size = None
    for p in party:
        size = _col(p) if size is None else size + _col(p)
    return _col(price).cast("double") / F.when(size == 0, F.lit(1)).otherwise(size)


def season_of_week(week) -> Column:
    """Season from an ISO week number."""
    w = _col(week)
    expr = None
    for name, lo, hi in SEASON_BANDS:
        cond = w.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(SEASON_DEFAULT))


def month_number(name) -> Column:
    """Month name -> 1..12; unknown -> null."""
    pairs = []
    for i, m in enumerate(MONTH_NAMES, start=1):
        pairs += [F.lit(m), F.lit(i)]
    return F.try_element_at(F.create_map(*pairs), _col(name))


def month_name(number) -> Column:
    """X18 inverse: 1..12 -> name; anything else -> null."""
    return F.try_element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), _col(number).cast("int"))


def make_date_safe(year, month, day) -> Column:
    """X4 core: a date from parts; impossible dates (or a null part) -> null."""
    y, m, d = (_col(c).cast("int") for c in (year, month, day))
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    ok = y.isNotNull() & m.isNotNull() & d.isNotNull() & y.between(1, 9999)
    return F.when(ok, F.try_to_date(text, "yyyy-MM-dd"))


def arrival_date(year, month_name_col, day) -> Column:
    """(year, month name, day) -> date, invalid -> null."""
    return make_date_safe(year, month_number(month_name_col), day)


def date_parts(date_col):
    """Year, month name, day of month and ISO week of a date."""
    d = _col(date_col)
    return {
        "year": F.year(d),
        "month": F.date_format(d, "MMMM"),
        "day": F.dayofmonth(d),
        "week": F.weekofyear(d),
    }


def clip(c, lo=None, hi=None) -> Column:
    """Clamp to [lo, hi] (either side optional); null stays null."""
    x = _col(c)
    out = x
    if lo is not None:
        out = F.when(x < F.lit(lo) if not isinstance(lo, Column) else x < lo, lo if isinstance(lo, Column) else F.lit(lo)).otherwise(out)
    if hi is not None:
        cond = x > (hi if isinstance(hi, Column) else F.lit(hi))
        out = F.when(cond, hi if isinstance(hi, Column) else F.lit(hi)).otherwise(out)
    return out


def threshold_class(prob, threshold) -> Column:
    """``p >= t`` as 0/1."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_col(prob) >= t).cast("int")


def residual(y, yhat) -> Column:
    """X17."""
    return _col(y).cast("double") - _col(yhat).cast("double")


def safe_number(c, to: str = "double") -> Column:
    """Unparsable -> null."""
    return _col(c).try_cast(to)
