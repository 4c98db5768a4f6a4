"""Row-level rules of the diary, all as Column expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearlog.functions.numeric import _col, capped, floored, ratio

# Upper bounds and labels of the report tiers, in report order.
WEAR_TIERS = ((0, "0"), (1, "1"), (2, "2"), (3, "3"), (5, "4-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"))
WEAR_TIER_TOP = (50, "Over 50")
AGE_TIERS = tuple((years, str(years)) for years in range(1, 10))
AGE_TIER_TOP = (10, "Over 10")
AGE_BANDS = ((365, "< 1 year"), (730, "1-2 years"), (1095, "2-3 years"))
AGE_BAND_TOP = (1095, "3+ years")

Tiers = Sequence[tuple[float, str]]


def cost_per_use(price: Column | str, cumuse: Column | str) -> Column:
    """Full price until the first use, then price shared over the uses."""
    price, cumuse = _col(price), _col(cumuse)
    return F.when(cumuse == 0, price).when(cumuse.isNotNull(), ratio(price, cumuse))


def days_before_start(purchased: Column | str, start: Column | dt.date) -> Column:
    """Days owned before the diary began; null when the purchase date is unknown."""
    purchased, start = _col(purchased), _date(start)
    return F.when(purchased > start, F.lit(0)).otherwise(F.datediff(start, purchased))


def day_increment(date: Column | str, purchased: Column | str, start: Column | dt.date) -> Column:
    """Days of ownership that a diary day adds: the time before on the first day, else one."""
    return F.when(_col(date) == _date(start), days_before_start(purchased, start)).otherwise(F.lit(1))


def uses_per_month(cumuse: Column | str, days: Column | str, month_days: float = 30.5) -> Column:
    days = _col(days)
    return F.when(days == 0, F.lit(0.0)).when(days.isNotNull(), ratio(_col(cumuse), days / F.lit(month_days)))


def calendar_months(earlier: Column | str, later: Column | str | dt.date) -> Column:
    """Difference of calendar months; the day of the month does not matter."""
    a, b = _date(earlier), _date(later)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def age_years(purchased: Column | str, asof: Column | str | dt.date, cap: float | None = None) -> Column:
    """Years since purchase, never negative, optionally capped."""
    years = floored(F.datediff(_date(asof), _col(purchased)) / F.lit(365.0), 0)
    return years if cap is None else capped(years, cap)


def tier(value: Column | str, tiers: Tiers, top: tuple[float, str]) -> Column:
    """Label of the first tier whose upper bound is not exceeded; the top tier is open."""
    value = _col(value)
    label = F.when(value <= tiers[0][0], tiers[0][1])
    for bound, name in tiers[1:]:
        label = label.when(value <= bound, name)
    return label.when(value > top[0], top[1])


def tier_rank(label: Column | str, tiers: Tiers, top: tuple[float, str]) -> Column:
    """1-based position of a tier label in report order."""
    names = [name for _, name in tiers] + [top[1]]
    return F.array_position(F.array(*[F.lit(n) for n in names]), _col(label)).cast("int")


def wear_tier(wears: Column | str) -> Column:
    return tier(wears, WEAR_TIERS, WEAR_TIER_TOP)


def age_tier(years: Column | str, compat: bool = True) -> Column:
    """Year tiers; with ``compat`` ages in (9, 10] have no tier, else they join tier 10."""
    if compat:
        return tier(years, AGE_TIERS, AGE_TIER_TOP)
    return tier(years, (*AGE_TIERS, (10, "10")), AGE_TIER_TOP)


def age_band(days: Column | str) -> Column:
    return tier(days, AGE_BANDS, AGE_BAND_TOP)


def effective_wears(wears: Column | str) -> Column:
    """Wears with 0 counted as 1, so that cost per wear falls back to the price."""
    wears = _col(wears)
    return F.when(wears == 0, F.lit(1.0)).otherwise(wears.cast("double"))


def worn_at_least(wears: Column | str, n: int = 1) -> Column:
    return _col(wears) >= n


def after(date: Column | str, day: dt.date) -> Column:
    """Strictly after a day; null dates stay null."""
    return _col(date) > F.lit(day)


def item_label(category: Column | str, item: Column | str) -> Column:
    """``category [item]``"""
    return F.concat(_col(category), F.lit(" ["), _col(item), F.lit("]"))


def label_category(label: Column | str) -> Column:
    return F.regexp_extract(_col(label), r"^(.*?) \[", 1)


def label_item(label: Column | str) -> Column:
    return F.regexp_extract(_col(label), r" \[(.*?)\]", 1)


def file_slug(text: Column | str) -> Column:
    """File-name form of a category: spaces to underscores."""
    return F.replace(_col(text), F.lit(" "), F.lit("_"))


def hosted_photo(photo: Column | str, base_url: str, folder: str = "Photos/") -> Column:
    """Public address of a photo: its local folder dropped, the host put in front."""
    name = F.regexp_replace(_col(photo), "^" + folder, "")
    return F.concat(F.lit(base_url), name, F.lit("?alt=media"))


def _date(value: Column | str | dt.date) -> Column:
    if isinstance(value, dt.date):
        return F.lit(value)
    return _col(value)
