"""Set operations, reshaping and panel completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_periods(series: list[DataFrame], year: str, keep: list[tuple[int, int]]) -> DataFrame:
    """Stack series by name, each cut to its own years so that overlaps are dropped."""
    cut = [s.where(F.col(year).between(lo, hi)) for s, (lo, hi) in zip(series, keep)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cut)


def both_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides."""
    return left.select(key).intersect(right.select(key))


def drop_shared(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys they share."""
    shared = both_sides(left, right, key)
    return left.join(shared, key, "left_anti"), right.join(shared, key, "left_anti")


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str,
         drop_null: bool = False) -> DataFrame:
    long = df.unpivot(ids, columns, name, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long


def spread(df: DataFrame, ids: list[str], name: str, values: list, value: str,
           fill: float | None = None) -> DataFrame:
    """Long to wide with the column values given, so no extra pass finds them."""
    wide = df.groupBy(*ids).pivot(name, values).agg(F.sum(value))
    return wide.fillna(fill, [str(v) for v in values]) if fill is not None else wide


def melt_pairs(df: DataFrame, ids: list[str], pairs: list[tuple[str, str]], first: str,
               second: str, key: str) -> DataFrame:
    """Numbered column pairs to rows; blank pairs dropped; adds a joined key."""
    items = F.array(*[F.struct(F.col(a).alias(first), F.col(b).alias(second)) for a, b in pairs])
    long = df.select(*ids, F.inline(items))
    long = long.where((F.coalesce(F.trim(first), F.lit("")) != "")
                      & (F.coalesce(F.trim(F.col(second).cast("string")), F.lit("")) != ""))
    return long.withColumn(key, F.concat_ws("|", F.col(first), F.col(second).cast("string")))


def stack_groups(df: DataFrame, ids: list[str], groups: dict[str, dict[str, str]], tag: str) -> DataFrame:
    """Parallel column groups (one per endpoint) to one row each."""
    items = F.array(*[F.struct(F.lit(name).alias(tag), *[F.col(c).alias(o) for o, c in cols.items()])
                      for name, cols in groups.items()])
    return df.select(*ids, F.inline(items))


def indicators(df: DataFrame, codes: Column, values: list[str], prefix: str = "has_") -> DataFrame:
    """One 0/1 column per code of a fixed list."""
    return df.withColumns({f"{prefix}{v}": F.coalesce(F.array_contains(codes, v), F.lit(False)).cast("int")
                           for v in values})


def rectangle(df: DataFrame, unit: list[str], time: str, values: list[str],
              bounds: DataFrame | None = None) -> DataFrame:
    """Every unit at every time between the table's first and last time; missing values are 0.

    The two bounds are one scalar subquery; each unit lists its own times, so there is no join
    of units with times.
    """
    span = (bounds if bounds is not None else df).agg(
        F.struct(F.min(time).alias("lo"), F.max(time).alias("hi")).alias("b")).scalar()
    units = df.select(*unit).distinct()
    frame = units.withColumn(time, F.explode(F.sequence(span["lo"], span["hi"])))
    return frame.join(df, [*unit, time], "left").fillna(0, values)


def fill_in(df: DataFrame, unit: list[str], time: str, values: list[str]) -> DataFrame:
    """Every observed unit at every observed time (not the years in between); missing is 0.

    The observed times travel as one array (a scalar subquery): they are calendar periods, whose
    number does not grow with the rows.
    """
    seen = df.agg(F.array_sort(F.collect_set(time)).alias("t")).scalar()
    units = df.select(*unit).distinct()
    frame = units.withColumn(time, F.explode(seen))
    return frame.join(df, [*unit, time], "left").fillna(0, values)


def explicit_gaps(df: DataFrame, keys: list[str], time: str, rows: DataFrame) -> DataFrame:
    """Add the given (key, time) rows with NULL values where the series has none."""
    missing = rows.join(df.select(*keys, time), [*keys, time], "left_anti")
    return df.unionByName(missing.select(*keys, time).distinct(), allowMissingColumns=True)


def bulk(df: DataFrame, columns: list[str], make, suffix: str) -> DataFrame:
    """Apply one expression to many columns: ``make(Column) -> Column``."""
    return df.withColumns({f"{c}{suffix}": make(F.col(c)) for c in columns})
