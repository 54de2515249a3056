"""Flags and classes derived from code columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger import dims
from roadledger.functions.numeric import is_in


def work_flags(code: Column) -> dict[str, Column]:
    """One boolean per work type plus ``is_construction``; a missing code is false everywhere."""
    flags = {name: is_in(code, codes) for name, codes in dims.WORK_TYPES.items()}
    built = [c for t in dims.CONSTRUCTION_TYPES for c in dims.WORK_TYPES[t]]
    return flags | {"is_construction": is_in(code, built)}


def work_type(code: Column) -> Column:
    """1 new, 2 reconstruction, 3 rehabilitation, 4 maintenance, else NULL."""
    out = F.lit(None).cast("int")
    for number, codes in enumerate(dims.WORK_TYPES.values(), start=1):
        out = F.when(code.isin(*codes), F.lit(number)).otherwise(out)
    return out


def structure_flags(code: Column) -> dict[str, Column]:
    return {name: is_in(code, codes) for name, codes in dims.STRUCTURES.items()}


def equals_code(c: Column, code: int) -> Column:
    return F.coalesce(c == F.lit(code), F.lit(False))


def coalesce_sources(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``columns`` maps output -> (preferred column, fallback column)."""
    return df.withColumns({out: F.coalesce(F.col(a), F.col(b)) for out, (a, b) in columns.items()})


def county_status(county: Column, is_capital: Column) -> Column:
    return (F.when(county == 999, "statewide")
            .when(county.isNull() | (county == 0), "unknown")
            .when(F.coalesce(is_capital, F.lit(False)), "capital")
            .otherwise("other"))


def funding_source(status_group: Column) -> Column:
    """Source letter of a status group: 1 federal, 0 local, 2 highway-only; later rules win."""
    second, first = F.substring(status_group, 2, 1), F.substring(status_group, 1, 1)
    return (F.when(second == "H", 2).when(second == "B", 0).when(first == "6", 0)
            .when(second == "A", 1))


def route_text(route: Column) -> Column:
    """Route label: directional branches kept, other numbers divided by 10."""
    t = F.trim(route)
    number = t.try_cast("double") / 10
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("string"))
    return (F.when(t.isin("035E", "35E"), "35E").when(t.isin("035W", "03SW", "35W"), "35W")
            .otherwise(F.coalesce(whole, number.cast("string"))))


def shift_mileposts(df: DataFrame, state: str, route: str, mile: str, group: str,
                    rules: list[tuple] = dims.MILEPOST_RULES) -> DataFrame:
    """Apply an ordered table of conditional mile-post offsets.

    Rules of one (state, route) chain on the moved value; rules of different routes are
    independent, so each route contributes one branch of a single expression.
    """
    by_route: dict[tuple, list[tuple]] = {}
    for st, rt, op, bound, delta, grp in rules:
        by_route.setdefault((st, rt), []).append((op, bound, delta, grp))
    out = F.col(mile)
    for (st, rt), steps in by_route.items():
        value = F.col(mile)
        for op, bound, delta, grp in steps:
            hit = F.lit(True)
            if op == ">":
                hit = value > bound
            elif op == ">=":
                hit = value >= bound
            if grp is not None:
                hit = hit & (F.col(group) == grp)
            value = F.when(hit, value + delta).otherwise(value)
        out = F.when((F.col(state) == st) & (F.col(route) == rt), value).otherwise(out)
    return df.withColumn(mile, out)


def fix_open_years(df: DataFrame, state: str, route: str, start: str, year: str) -> DataFrame:
    """Replace mistyped opening years listed in the correction table."""
    spark = df.sparkSession
    fixes = spark.createDataFrame(dims.OPEN_YEAR_FIXES,
                                  "__st int, __rt string, __mp double, __old int, __new int")
    match = ((F.col(state) == F.col("__st")) & (F.col(route) == F.col("__rt"))
             & (F.col(year) == F.col("__old")) & (F.round(F.col(start), 2) == F.col("__mp")))
    out = df.join(F.broadcast(fixes), match, "left")
    out = out.withColumn(year, F.coalesce(F.col("__new"), F.col(year)))
    return out.drop("__st", "__rt", "__mp", "__old", "__new")
