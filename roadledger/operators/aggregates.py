"""Aggregation operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.operators.ordered import ordered, with_group_values
from roadledger.operators.selection import select_ranks, whole_weight


def roll_up(df: DataFrame, keys: list[str], order: list[str], sums: list[str] | None = None,
            firsts: list[str] | None = None, lasts: list[str] | None = None,
            maxima: dict[str, str] | None = None, count: str | None = None) -> DataFrame:
    """One row per key: sums (0 when all missing), first / last non-NULL along the order, maxima."""
    at = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias(count)] if count else []
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums or []]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in firsts or []]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in lasts or []]
    aggs += [F.max(c).alias(o) for o, c in (maxima or {}).items()]
    return df.groupBy(*keys).agg(*aggs)


def distinct_list(df: DataFrame, keys: list[str], value: str, order: list[str] | None,
                  out: str) -> DataFrame:
    """Distinct non-NULL values per key as an array, by first appearance or (no order) sorted.

    Repeats are removed before the list is built, so a hot key only gathers its distinct values.
    """
    rows = df.where(F.col(value).isNotNull())
    if order is None:
        once = rows.select(*keys, value).distinct()
        return once.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(out))
    once = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__at"))
    lists = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", value))).alias("__l"))
    return lists.select(*keys, F.transform("__l", lambda x: x[value]).alias(out))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    ratio = F.try_divide(F.sum(F.when(both, F.col(value) * F.col(weight))),
                         F.sum(F.when(both, F.col(weight))))
    return df.groupBy(*keys).agg(ratio.alias(out))


def weighted_percentiles(df: DataFrame, keys: list[str], value: str, weight: str | None,
                         points: list[float]) -> DataFrame:
    """Weighted percentiles: first value whose running weight passes p * total, averaged with the
    one before when the running weight meets it exactly.

    Weights count to twelve decimals and points to six, as whole numbers, so meeting is exact.
    """
    names = [f"p{int(round(100 * p))}" for p in points]
    targets = {}
    for i, p in enumerate(points):
        goal = F.col("total") * F.lit(int(round(p * 10**6)))
        targets |= {f"__gt{i}": (goal, True), f"__ge{i}": (goal, False)}
    w = whole_weight(F.col(weight)) if weight else None
    found = select_ranks(df, keys, value, targets, w, scale=10**6)
    return found.select(*keys, *[
        ((F.coalesce(f"__gt{i}", f"__ge{i}") + F.col(f"__ge{i}")) / 2).cast("double").alias(n) for i, n in enumerate(names)])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: list[float],
                      names: list[str]) -> DataFrame:
    """Linearly interpolated percentiles without holding a group's values in one task.

    The two order statistics around each point are selected by narrowing brackets.
    """
    at = {p: F.lit(float(p)) * (F.col("total").cast("double") - 1) for p in points}
    targets = {}
    for i, p in enumerate(points):
        targets |= {f"__lo{i}": (F.floor(at[p]), True), f"__hi{i}": (F.ceil(at[p]), True)}
    got = select_ranks(df, keys, value, targets)
    return got.select(*keys, *[
        (F.col(f"__lo{i}") + (at[p] - F.floor(at[p])) * (F.col(f"__hi{i}") - F.col(f"__lo{i}")))
        .cast("double").alias(n) for (i, p), n in zip(enumerate(points), names)])


def below_median(df: DataFrame, value: str, out: str) -> DataFrame:
    """Whether the value is below the table's median; a missing value is false."""
    median = exact_percentiles(df, [], value, [0.5], ["m"]).scalar()
    return df.withColumn(out, F.coalesce(F.col(value) < median, F.lit(False)))


def with_share(df: DataFrame, value: str, out: str, within: list[str] | None = None,
               percent: bool = False) -> DataFrame:
    """Share of the value in its group's total, or in the table total."""
    scale = 100.0 if percent else 1.0
    if within:
        df = with_group_values(df, within, __t=F.sum(value))
        return df.withColumn(out, F.try_divide(scale * F.col(value), F.col("__t"))).drop("__t")
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.withColumn(out, F.try_divide(scale * F.col(value), total))


def frequency(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Counts and percents of a class (NULL included), optionally of a weight as well."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight:
        aggs.append(F.coalesce(F.sum(weight), F.lit(0.0)).alias("weight"))
    out = with_share(df.groupBy(*keys).agg(*aggs), "n", "pct", percent=True)
    return with_share(out, "weight", "pct_weight", percent=True) if weight else out


def two_way(df: DataFrame, row: str, col: str, weight: str | None = None) -> DataFrame:
    """Cell, row and column percents of a two-way table in long form."""
    amount = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0.0))
    cells = df.groupBy(row, col).agg(amount.alias("n"))
    cells = with_share(cells, "n", "pct_cell", percent=True)
    cells = with_share(cells, "n", "pct_row", within=[row], percent=True)
    return with_share(cells, "n", "pct_col", within=[col], percent=True)


def dense_grid(df: DataFrame, a: str, a_range: range, b: str, b_range: range,
               weight: str | None = None) -> DataFrame:
    """Every cell of a rectangle and every cell of the rows outside it, with its amount (0 when absent) and
    percent of the total. A missing code counts as 0."""
    spark = df.sparkSession
    amount = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    codes = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in (a, b)]
    cells = df.groupBy(*codes).agg(amount.alias("n"))
    frame = spark.range(1).select(
        F.explode(F.array(*map(F.lit, a_range))).alias(a),
        F.lit(list(b_range)).alias("__b")).select(a, F.explode("__b").alias(b))
    grid = frame.join(cells, [a, b], "full_outer").withColumn("n", F.coalesce("n", F.lit(0.0)))
    return with_share(grid, "n", "pct", percent=True)


def mode_value(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent non-blank value; ties to the lowest value."""
    rows = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("__n"), F.col(value).alias("v"))).alias("__m"))
    return best.select(*keys, F.col("__m.v").alias(out))


def uniqueness_census(df: DataFrame, cells: dict[str, list[str]], unit: str, year: str,
                      ) -> DataFrame:
    """Cells at each grain that never had two units in a year, only one unit, only one year."""
    parts = []
    for grain, keys in cells.items():
        per_year = df.groupBy(*keys, year).agg(F.countDistinct(unit).alias("__u"))
        once = per_year.groupBy(*keys).agg(F.max("__u").alias("__max"), F.count(year).alias("__years"))
        ever = df.groupBy(*keys).agg(F.countDistinct(unit).alias("__ever"))
        both = once.join(ever, keys)
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        parts.append(both.select(
            F.lit(grain).alias("grain"), key.alias("cell"),
            (F.col("__max") == 1).alias("one_per_year"), (F.col("__ever") == 1).alias("single_unit"),
            (F.col("__years") == 1).alias("single_year")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def sample_keys(df: DataFrame, keys: list[str], unit: str, year: str, rule: str) -> DataFrame:
    """Key-only sample table for one of the three uniqueness rules."""
    if rule == "one_per_year":
        per = df.groupBy(*keys, year).agg(F.countDistinct(unit).alias("__u"))
        return per.groupBy(*keys).agg(F.max("__u").alias("__m")).where("__m = 1").select(*keys)
    column = {"single_unit": unit, "single_year": year}[rule]
    ever = df.groupBy(*keys).agg(F.min(column).alias("__a"), F.max(column).alias("__b"))
    return ever.where(F.col("__a") == F.col("__b")).select(*keys)


def describe_subsets(df: DataFrame, value: str, subsets: dict[str, Column]) -> DataFrame:
    """n, mean, sd, min, max and median of a value for several subsets side by side."""
    tags = F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in subsets.items()]),
                    lambda t: t.isNotNull())
    rows = df.select(F.col(value), F.explode(tags).alias("subset"))
    stats = rows.groupBy("subset").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    medians = exact_percentiles(rows, ["subset"], value, [0.5], ["median"])
    return stats.join(medians, "subset", "left")


def balance_table(df: DataFrame, flag: Column, values: list[str]) -> DataFrame:
    """Means of two groups, their difference, Welch t and stars, one row per variable."""
    long = df.select(flag.alias("__g"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x"))
        for v in values])).alias("__v")).select("__g", "__v.*")
    aggs = []
    for name, g in (("in", F.col("__g")), ("out", ~F.col("__g"))):
        x = F.when(g, F.col("x"))
        aggs += [F.avg(x).alias(f"mean_{name}"), F.var_samp(x).alias(f"v_{name}"),
                 F.count(x).alias(f"n_{name}")]
    m = long.groupBy("variable").agg(*aggs)
    se = F.sqrt(F.col("v_in") / F.col("n_in") + F.col("v_out") / F.col("n_out"))
    m = m.withColumns({"difference": F.col("mean_in") - F.col("mean_out")})
    m = m.withColumn("t", F.when(se > 0, F.col("difference") / se))
    size = F.abs("t")
    stars = F.when(size > 2.576, "***").when(size > 1.96, "**").when(size > 1.645, "*").otherwise("")
    return m.withColumn("stars", stars).drop("v_in", "v_out")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], left_value: str,
              right_value: str, tolerance: float = 1e-6) -> DataFrame:
    """Totals of two tables by key, full outer, with a flag for an absolute gap."""
    a = left.groupBy(*keys).agg(F.sum(left_value).alias("left_total"))
    b = right.groupBy(*keys).agg(F.sum(right_value).alias("right_total"))
    both = a.join(b, keys, "full_outer")
    gap = F.abs(F.coalesce("left_total", F.lit(0.0)) - F.coalesce("right_total", F.lit(0.0)))
    return both.withColumn("differs", (gap > tolerance).cast("int"))


def period_means(df: DataFrame, keys: list[str], year: str, value: str,
                 periods: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean and count of a value inside each named year range."""
    aggs = []
    for name, (lo, hi) in periods.items():
        inside = F.when(F.col(year).between(lo, hi), F.col(value))
        aggs += [F.avg(inside).alias(f"mean_{name}"), F.count(inside).alias(f"n_{name}")]
    return df.groupBy(*keys).agg(*aggs)


def histogram(df: DataFrame, value: str, width: float, start: float | None = None,
              weight: str | None = None) -> DataFrame:
    """Equal-width bins from ``start`` (default the minimum): count, relative frequency, sum."""
    low = F.lit(start) if start is not None else df.agg(F.min(value)).scalar()
    bin_no = F.floor((F.col(value) - low) / width)
    rows = df.where(F.col(value).isNotNull()).groupBy(bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight or value).alias("amount"))
    return with_share(rows, "n", "share")


def winsorise(df: DataFrame, value: str, low: float, high: float, out: str) -> DataFrame:
    """Clamp a value to two quantiles of the table."""
    q = exact_percentiles(df, [], value, [low, high], ["lo", "hi"])
    lo, hi = q.select("lo").scalar(), q.select("hi").scalar()
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), hi), lo)))


def top_k(df: DataFrame, category: str, k: int, weight: str | None = None) -> DataFrame:
    """Top categories by count or weight with their share of all rows."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    ranked = with_share(df.groupBy(category).agg(amount.alias("amount")), "amount", "share")
    return ranked.orderBy(F.desc("amount"), F.asc(category)).limit(k)


def top_k_within(df: DataFrame, group: str, category: str, k: int) -> DataFrame:
    """Counts of the table's overall top-k categories inside every group, with the rank there.

    The rank runs over one row per (group, category) of the k kept categories only.
    """
    best = top_k(df, category, k).select(category)
    kept = df.join(best, category, "left_semi")
    counts = kept.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("__neg", -F.col("n"))
    return ordered(counts, [group], ["__neg", category], rank="rank").drop("__neg")


def cumulative_share(df: DataFrame, keys: list[str], at: str, weight: str, split_width: float,
                     points: tuple[float, ...] = (0.5, 0.9),
                     ) -> tuple[DataFrame, DataFrame]:
    """Cumulative weight share by position, and the first position that reaches each point."""
    mass = df.groupBy(*keys, at).agg(F.sum(weight).alias("amount"))
    cum = ordered(mass, keys, [at], total={"__c": "amount"},
                  split=F.floor(F.col(at) / split_width))
    cum = with_group_values(cum, keys, __t=F.sum("amount")) if keys else cum.withColumn(
        "__t", mass.agg(F.sum("amount")).scalar())
    cum = cum.withColumn("share", F.try_divide("__c", "__t"))
    reach = cum.groupBy(*keys).agg(*[
        F.min(F.when(F.col("__c") >= F.col("__t") * p, F.col(at))).alias(f"at_{int(100 * p)}")
        for p in points])
    return cum.drop("__c", "__t"), reach


def per_capita(df: DataFrame, population: DataFrame, keys: list[str], value: str, people: str,
               out: str) -> DataFrame:
    joined = df.join(population.select(*keys, people), keys)
    return joined.withColumn(out, F.try_divide(value, people)).drop(people)


def membership(df: DataFrame, list_col: Column, allowed: DataFrame, key: str, id_col: str,
               share: float = 0.75) -> DataFrame:
    """How much of each record's list lies in a key set: all, any, and at least a share."""
    flat = df.select(id_col, F.explode(F.array_distinct(list_col)).alias(key))
    marked = flat.join(allowed.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    out = marked.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_listed"),
                                     F.count("__in").alias("n_inside"))
    part = F.col("n_inside") / F.col("n_listed")
    return out.withColumns({"all_inside": F.col("n_inside") == F.col("n_listed"),
                            "any_inside": F.col("n_inside") > 0, "mostly_inside": part >= share})
