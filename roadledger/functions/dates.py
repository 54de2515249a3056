"""Date expressions. Unparseable text gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_mdy(c: Column) -> Column:
    """First ``dd/dd/dddd`` in the text, read as month/day/year."""
    found = F.nullif(F.regexp_extract(c, r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), F.lit(""))
    return F.try_to_date(found, "MM/dd/yyyy")


def parse_columns_mdy(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: parse_mdy(F.col(c)) for c in columns})


def year_in_text(c: Column, anchored: bool = False) -> Column:
    """Four digits after a slash, optionally only at the end of the text."""
    pattern = r"/([0-9]{4})$" if anchored else r"/([0-9]{4})"
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("int")


def iso_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([0-9]{4})-", 1), F.lit("")).try_cast("int")


def yymm_year(c: Column, century: int = 1900) -> Column:
    return (F.floor(c / 100) + century).cast("int")


def yymm_month(c: Column) -> Column:
    return (c % 100).cast("int")


def mmyy_to_yymm(c: Column) -> Column:
    """Swap the halves of a packed month/year number (0756 -> 5607)."""
    text = F.lpad(c.cast("int").cast("string"), 4, "0")
    return F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2)).try_cast("int")


def swap_columns_mmyy(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Apply ``mmyy_to_yymm`` to many columns; ``columns`` maps source to output name."""
    return df.withColumns({out: mmyy_to_yymm(F.col(c)) for c, out in columns.items()})


def years_between(start: Column, end: Column, days_per_year: float = 365.25) -> Column:
    return F.datediff(end, start) / F.lit(float(days_per_year))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def opening_date(preferred: list[Column], improved: list[Column], later: list[Column],
                 fallback: Column) -> Column:
    """Least of the preferred dates, else greatest of the improved, else the later ones in turn."""
    return F.coalesce(F.least(*preferred), F.greatest(*improved), *later, fallback)
