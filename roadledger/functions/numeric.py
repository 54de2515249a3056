"""Numeric expressions: bins, guarded ratios, units, funding measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit factors.
METRES_PER_MILE = 1609.344
METRES_PER_FOOT = 0.3048
METRES_PER_KM = 1000.0


def miles_to_metres(c: Column) -> Column:
    return c * F.lit(METRES_PER_MILE)


def metres_to_miles(c: Column) -> Column:
    return c / F.lit(METRES_PER_MILE)


def distance_metres(value: Column, unit: Column) -> Column:
    """Distance in metres; NULL for an unknown unit."""
    return (F.when(unit == "ft", value * METRES_PER_FOOT)
            .when(unit == "mi", value * METRES_PER_MILE)
            .when(unit == "km", value * METRES_PER_KM))


def bin_floor(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)) * F.lit(width)


def log_bin(c: Column, width: float = 0.1) -> Column:
    """Natural-log bin index; NULL for non-positive values."""
    return F.when(c > 0, F.floor(F.ln(c) / F.lit(width)).cast("bigint"))


def block_start(year: Column, width: int = 5, origin: int = 1960) -> Column:
    """First year of the block, 0 before the origin."""
    inside = F.floor((year - origin) / width) * width + origin
    return F.when(year < origin, F.lit(0)).otherwise(inside).cast("int")


def block_label(block: Column, width: int = 5, origin: int = 1960) -> Column:
    closed = F.concat(block.cast("string"), F.lit("-"), (block + (width - 1)).cast("string"))
    return F.when(block == 0, F.lit(f"<{origin}")).otherwise(closed)


def cut_bin(c: Column, cuts: list[float]) -> Column:
    """Lower edge of the half-open bin that holds the value; NULL outside the list."""
    out = F.lit(None)
    for low, high in zip(cuts[:-1], cuts[1:]):
        out = F.when((c >= low) & (c < high), F.lit(low)).otherwise(out)
    return out


def guarded_ratio(num: Column, den: Column, floor: float = 0.0) -> Column:
    """Ratio, NULL unless the denominator reaches the floor (and is not zero)."""
    return F.when((den >= floor) & (den != 0), num / den)


def share_or_zero(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def log_cost_per_mile(cost: Column, miles: Column) -> Column:
    return F.when((cost > 0) & (miles > 0), F.ln(cost / miles))


def row_sum(columns: list[Column]) -> Column:
    """Row-wise sum that skips NULL; an all-NULL row sums to 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])


def parts_match_total(parts: list[Column], total: Column, tolerance: float = 1.0) -> Column:
    """Whether the funding parts add up to the total; a missing part or total counts as no."""
    gap = F.abs(reduce(lambda a, b: a + b, parts) - total)
    return F.coalesce(gap < tolerance, F.lit(False))


def measure_if(flag: Column, amount: Column) -> Column:
    return F.when(flag, amount)


def implied_decimal(c: Column, places: int = 2) -> Column:
    return c.cast("double") / F.lit(float(10**places))


def segment_measures(df: DataFrame, route: str, mile: str, length: str) -> DataFrame:
    """Typed measures of a segment record: route number without its last digit, start, length and end in miles.

    Mile-posts and lengths carry two implied decimals; the end is the start plus the length.
    """
    start, miles = implied_decimal(F.col(mile)), implied_decimal(F.col(length))
    return df.withColumns({"route": F.expr(f"`{route}` div 10").cast("int"), "mp_start": start, "seg_len": miles, "mp_end": start + miles})


def sum0(c: Column) -> Column:
    """Sum whose value over no or only NULL rows is 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def cumulative_layers(columns: list[tuple[str, Column]]) -> list[Column]:
    """Stacked layers s1, s1+s2, ... as aliased columns (NULL counts as 0)."""
    out, running = [], F.lit(0.0)
    for name, c in columns:
        running = running + F.coalesce(c, F.lit(0.0))
        out.append(running.alias(name))
    return out


def is_in(c: Column, values: list) -> Column:
    """Membership flag that is false, not NULL, for a missing value."""
    return F.coalesce(c.isin(*values), F.lit(False))
