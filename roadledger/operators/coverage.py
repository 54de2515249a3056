"""Completeness audits, coverage shares, cost composition and code-list comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.operators.aggregates import with_share


def _long(df: DataFrame, parts: list[Column], name: str) -> DataFrame:
    """One aggregated row holding an array of structs, exploded to rows."""
    return df.agg(F.array(*parts).alias("__a")).select(F.explode("__a").alias(name)).select(f"{name}.*")


def completeness(df: DataFrame, columns: list[str], weight: str, by: list[str] | None = None) -> DataFrame:
    """Per column: non-NULL count, percent of rows and weight-percent, in one pass."""
    w = F.col(weight)
    parts = [F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"), (100.0 * F.count(c) / F.count(F.lit(1))).alias("pct"),
        (100.0 * F.try_divide(F.sum(F.when(F.col(c).isNotNull(), w)), F.sum(w))).alias("pct_weight"))
        for c in columns]
    grouped = df.groupBy(*(by or [])).agg(F.array(*parts).alias("__a"))
    return grouped.select(*(by or []), F.explode("__a").alias("__r")).select(*(by or []), "__r.*")


def copresence(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each pair of columns is filled together: counts and percent of rows, one pass."""
    parts = [F.struct(
        F.lit(a).alias("row"), F.lit(b).alias("col"),
        F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"),
        (100.0 * F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
         / F.count(F.lit(1))).alias("pct")) for a in columns for b in columns]
    return _long(df, parts, "__c")


def order_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where the column date is later than the row date, both filled; negative below the
    diagonal."""
    parts = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if i == j:
                continue
            sign = 1 if j > i else -1
            parts.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"),
                                  (F.count(F.when(F.col(b) > F.col(a), 1)) * sign).alias("n_later")))
    return _long(df, parts, "__c")


def presence_by_category(df: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """Wide table: per category the share of rows in which each column is filled."""
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[(100.0 * F.count(c) / F.count(F.lit(1))).alias(f"pct_{c}") for c in columns])


def coverage(df: DataFrame, keys: list[str], flag: Column, amount: str) -> DataFrame:
    """Records and spend, all and flagged, with the two shares, by key."""
    hit = F.coalesce(flag, F.lit(False))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("n_flag"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("spend"),
        F.coalesce(F.sum(F.when(hit, F.col(amount))), F.lit(0.0)).alias("spend_flag"))
    return out.withColumns({"share_n": F.col("n_flag") / F.col("n"),
                            "share_spend": F.try_divide("spend_flag", "spend")})


def coverage_by_type(df: DataFrame, year: str, types: dict[str, Column], standalone: Column,
                     flag: Column, amount: str) -> DataFrame:
    """Yearly coverage for records that have a type (mode ``has``) or have nothing else (``only``)."""
    tags = [F.when(cond, F.struct(F.lit(n).alias("type"), F.lit("has").alias("mode")))
            for n, cond in types.items()]
    tags += [F.when(cond & standalone, F.struct(F.lit(n).alias("type"), F.lit("only").alias("mode")))
             for n, cond in types.items()]
    rows = df.withColumn("__t", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())))
    rows = rows.withColumns({"type": F.col("__t.type"), "mode": F.col("__t.mode")})
    return coverage(rows, [year, "type", "mode"], flag, amount)


def composition(df: DataFrame, subset: str, parts: list[str], total: str) -> DataFrame:
    """Cost parts and the unexplained rest per subset, long form, in percent of the subset total."""
    sums = df.groupBy(subset).agg(F.coalesce(F.sum(total), F.lit(0.0)).alias("__t"),
                                  *[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in parts])
    rest = F.col("__t") - reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    rows = [F.struct(F.lit(p).alias("part"), F.col(p).alias("amount")) for p in parts]
    rows.append(F.struct(F.lit("other").alias("part"), rest.alias("amount")))
    long = sums.select(subset, "__t", F.explode(F.array(*rows)).alias("__p"))
    return long.select(subset, "__p.part", "__p.amount",
                       F.try_divide(100.0 * F.col("__p.amount"), F.col("__t")).alias("pct"))


def share_with_ci(df: DataFrame, types: dict[str, Column], flag: Column,
                  standalone: Column) -> DataFrame:
    """Flagged share with standard error and clipped 95% interval, per type and group.

    Groups: ``none`` (record without the type), ``any`` (has it), ``standalone`` (has only it).
    """
    tags = []
    for n, cond in types.items():
        c = F.coalesce(cond, F.lit(False))
        tags += [F.when(~c, F.struct(F.lit(n).alias("type"), F.lit("none").alias("group"))),
                 F.when(c, F.struct(F.lit(n).alias("type"), F.lit("any").alias("group"))),
                 F.when(c & standalone, F.struct(F.lit(n).alias("type"), F.lit("standalone").alias("group")))]
    rows = df.select(flag.cast("double").alias("__f"), F.explode(
        F.filter(F.array(*tags), lambda t: t.isNotNull())).alias("__t")).select("__f", "__t.*")
    out = rows.groupBy("type", "group").agg(F.count("__f").alias("n"), F.avg("__f").alias("share"))
    out = out.withColumn("se", F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("n")))
    return out.withColumns({"ci_low": F.greatest(F.col("share") - 1.96 * F.col("se"), F.lit(0.0)),
                            "ci_high": F.least(F.col("share") + 1.96 * F.col("se"), F.lit(1.0))})


def representativeness(df: DataFrame, group: str, subset: Column, amount: str) -> DataFrame:
    """Share of records and spend of each group in all rows and in the subset, and their ratio."""
    inside = F.coalesce(subset, F.lit(False))
    out = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(inside, 1)).alias("n_sub"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("spend"),
        F.coalesce(F.sum(F.when(inside, F.col(amount))), F.lit(0.0)).alias("spend_sub"))
    for c in ("n", "n_sub", "spend", "spend_sub"):
        out = with_share(out, c, f"share_{c}")
    return out.withColumn("over_representation", F.try_divide("share_n_sub", "share_n"))


def code_representativeness(df: DataFrame, id_col: str, codes: Column, subset: Column) -> DataFrame:
    """Distinct codes per record exploded: records and share with each code, all and subset."""
    flat = df.select(id_col, subset.cast("int").alias("__s"), F.explode(F.array_distinct(codes)).alias("code"))
    n_all = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_sub = df.agg(F.count(F.when(subset, 1)).alias("n")).scalar()
    out = flat.groupBy("code").agg(F.count(F.lit(1)).alias("n"),
                                   F.coalesce(F.sum("__s"), F.lit(0)).alias("n_sub"))
    return out.withColumns({"share": F.col("n") / n_all, "share_sub": F.try_divide("n_sub", n_sub)})


def group_profile(df: DataFrame, group: str, flag: Column, codes: Column, amount: str) -> DataFrame:
    """Coverage, mean number of codes and mean amount per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("coverage"),
        F.avg(F.size(codes).cast("double")).alias("mean_codes"), F.avg(amount).alias("mean_amount"))


def subpopulations(df: DataFrame, year: str, conditions: dict[str, Column], amount: str) -> DataFrame:
    """Counts, sums and means of filtered sub-populations side by side, by year."""
    aggs = []
    for n, cond in conditions.items():
        aggs += [F.count(F.when(cond, 1)).alias(f"n_{n}"),
                 F.coalesce(F.sum(F.when(cond, F.col(amount))), F.lit(0.0)).alias(f"sum_{n}"),
                 F.avg(F.when(cond, F.col(amount))).alias(f"mean_{n}")]
    return df.groupBy(year).agg(*aggs)


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule (NULL counts as broken), counted in one pass."""
    parts = [F.struct(F.lit(n).alias("rule"),
                      F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("n_broken"),
                      F.count(F.lit(1)).alias("n_rows")) for n, ok in rules.items()]
    return _long(df, parts, "__r")


def violations(df: DataFrame, ok: Column) -> DataFrame:
    return df.where(~F.coalesce(ok, F.lit(False)))
