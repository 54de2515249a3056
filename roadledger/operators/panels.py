"""Event-time panels, conservation-checked allocation and grain panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.functions.numeric import guarded_ratio
from roadledger.operators.aggregates import with_share
from roadledger.operators.joins import lagged_join
from roadledger.operators.ordered import range_window_sum, with_group_values
from roadledger.operators.reshape import fill_in, rectangle


def event_panel(events: DataFrame, records: DataFrame, unit: list[str], open_year: str, year: str,
                amount: str, fill: bool = True) -> DataFrame:
    """Spend by (unit, opening year, year) with event time.

    Records are summed to (unit, year) before they meet the openings, so the join carries years,
    not records. With ``fill`` every opening has a row for every year of the data.
    """
    spend = records.groupBy(*unit, year).agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias(amount))
    opened = events.select(*unit, open_year).distinct()
    panel = opened.join(spend, unit)
    if fill:
        panel = rectangle(panel, [*unit, open_year], year, [amount], bounds=panel)
    return panel.withColumn("event_time", F.col(year) - F.col(open_year))


def event_mean(events: DataFrame, records: DataFrame, unit: list[str], open_year: str, year: str,
               amount: str) -> DataFrame:
    """Mean spend by event time over the filled panel, without building the panel.

    The filled rows are zeros: the sum by event time needs only the real rows, and the number of
    (unit, opening) pairs seen at an event time follows from the counts per opening year.
    """
    spend = records.groupBy(*unit, year).agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias(amount))
    opened = events.select(*unit, open_year).distinct()
    joined = opened.join(spend, unit)
    cells = joined.groupBy(open_year, year).agg(F.sum(amount).alias("__s"))
    span = joined.agg(F.struct(F.min(year).alias("lo"), F.max(year).alias("hi")).alias("b")).scalar()
    seen = opened.join(spend.select(*unit).distinct(), unit, "left_semi")
    per_open = seen.groupBy(open_year).agg(F.count(F.lit(1)).alias("__n"))
    counts = per_open.withColumn("event_time", F.explode(F.sequence(
        span["lo"] - F.col(open_year), span["hi"] - F.col(open_year)))).groupBy("event_time").agg(
        F.sum("__n").alias("n"))
    sums = cells.groupBy((F.col(year) - F.col(open_year)).alias("event_time")).agg(
        F.sum("__s").alias("total"))
    out = counts.join(sums, "event_time", "left")
    return out.select("event_time", "n", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("mean"))


def window_share(panel: DataFrame, unit: list[str], amount: str, lo: int = -4, hi: int = 4,
                 minimum: float = 0.5) -> DataFrame:
    """Share of each unit's spend inside an event-time window; units above the minimum."""
    inside = F.when(F.col("event_time").between(lo, hi), F.col(amount))
    out = panel.groupBy(*unit).agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias("inside"),
                                   F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"))
    return out.withColumn("share", F.try_divide("inside", "total")).where(F.col("share") > minimum)


def spend_profile(means: DataFrame, mean: str, windows: dict[str, tuple[int, int] | None]) -> DataFrame:
    """Mean curve zeroed outside each window; the full curve for None."""
    cols = {}
    for name, span in windows.items():
        value = F.coalesce(F.col(mean), F.lit(0.0))
        cols[f"f_{name}"] = value if span is None else F.when(
            F.col("event_time").between(*span), value).otherwise(F.lit(0.0))
    return means.select("event_time", *[c.alias(n) for n, c in cols.items()])


def profile_summary(profile: DataFrame, name: str) -> DataFrame:
    f = F.col(f"f_{name}")
    return profile.agg(F.lit(name).alias("window"), F.sum(f).alias("area"), F.max(f).alias("peak"),
                       F.max_by("event_time", f).alias("peak_at"),
                       F.count(F.when(f > 0, 1)).alias("n_positive"))


def allocate_spend(chains: DataFrame, actual: DataFrame, profile: DataFrame, cell: list[str],
                   chain_id: str, open_year: str, miles: str, year: str, amounts: dict[str, str],
                   ) -> DataFrame:
    """Share the spend of each (cell, year) over the cell's chains by miles x profile(event time),
    or by miles alone when no chain has weight; summed per chain.

    ``amounts`` maps each money column of ``actual`` to its weight column in ``profile``. All
    chains of a cell that opened in the same year get the same rate per mile, so rates are worked
    out between (cell, opening year) and (cell, year) totals; each chain then looks up one rate.
    Chains are never crossed with years. Undated chains are kept with NULL estimates.
    """
    dated = chains.where(F.col(open_year).isNotNull())
    by_open = dated.groupBy(*cell, open_year).agg(F.sum(miles).alias("__m"))
    spend = actual.groupBy(*cell, year).agg(*[F.coalesce(F.sum(a), F.lit(0.0)).alias(a) for a in amounts])
    pairs = by_open.join(spend, cell).withColumn("event_time", F.col(year) - F.col(open_year))
    # one row per event time: at most twice the years of the data
    pairs = pairs.join(profile, "event_time", "left")
    weights = {a: F.coalesce(F.col(f), F.lit(0.0)) for a, f in amounts.items()}
    pairs = pairs.withColumns({f"__w_{a}": w for a, w in weights.items()})
    pairs = with_group_values(
        pairs, [*cell, year], __mt=F.sum("__m"),
        **{f"__tw_{a}": F.sum(F.col("__m") * F.col(f"__w_{a}")) for a in amounts})
    rate = {a: F.when(F.col(f"__tw_{a}") > 0, F.col(f"__w_{a}") / F.col(f"__tw_{a}"))
            .otherwise(F.try_divide(F.lit(1.0), F.col("__mt"))) * F.col(a) for a in amounts}
    rates = pairs.groupBy(*cell, open_year).agg(*[F.sum(r).alias(f"__r_{a}") for a, r in rate.items()])
    out = chains.join(rates, [*cell, open_year], "left")
    return out.select(chain_id, *cell, open_year, miles,
                      F.col(open_year).isNull().cast("int").alias("no_open_year"),
                      *[(F.col(miles) * F.col(f"__r_{a}")).alias(f"est_{a}") for a in amounts])


def allocation_gap(allocated: DataFrame, actual: DataFrame, cell: list[str], estimate: str,
                   amount: str) -> DataFrame:
    """Allocated against actual spend per cell that has at least one dated chain."""
    est = allocated.groupBy(*cell).agg(F.sum(estimate).alias("allocated"))
    act = actual.groupBy(*cell).agg(F.sum(amount).alias("actual"))
    both = est.where(F.col("allocated").isNotNull()).join(act, cell)
    return both.withColumn("gap", F.abs(F.col("allocated") - F.col("actual")))


def grain_panel(spend: DataFrame, miles: DataFrame, unit: list[str], time: Column, spend_year: str,
                mile_year: str, amount: str, length: str, shift: int = 1, rect: bool = False,
                ) -> DataFrame:
    """Spend and miles at one grain (unit x period), spend moved ``shift`` years back, zero-filled,
    with both ratios. ``time`` is an expression of the column ``year`` (the year, or its block)."""
    a = spend.withColumn("year", F.col(spend_year) - shift).withColumn("period", time)
    b = miles.withColumn("year", F.col(mile_year)).withColumn("period", time)
    a = a.groupBy(*unit, "period").agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("spend"))
    b = b.groupBy(*unit, "period").agg(F.coalesce(F.sum(length), F.lit(0.0)).alias("miles"))
    both = a.join(b, [*unit, "period"], "full_outer").fillna(0.0, ["spend", "miles"])
    if unit:
        both = (rectangle if rect else fill_in)(both, unit, "period", ["spend", "miles"])
    return both.withColumns({"spend_per_mile": F.try_divide("spend", "miles"),
                             "miles_per_spend": F.try_divide("miles", "spend")})


def pseudo_units(projects: DataFrame, yearly: DataFrame, year: str, amount: str, units: str,
                 lags: range, keep: list[str]) -> DataFrame:
    """A project's share of its year's spend times the yearly units at each lag."""
    shared = with_share(projects, amount, "share", within=[year])
    joined = lagged_join(shared, yearly, [], year, lags)
    return joined.select(*keep, year, "lag", (F.col("share") * F.col(units)).alias("pseudo_units"))


def match_success(rows: DataFrame, matched: DataFrame, keys: list[str], year: str, amount: str) -> DataFrame:
    """Matched and unmatched amount by year."""
    hit = matched.select(*keys).distinct().withColumn("__m", F.lit(True))
    out = rows.join(hit, keys, "left").groupBy(year).agg(
        F.coalesce(F.sum(F.when(F.col("__m"), F.col(amount))), F.lit(0.0)).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("__m").isNull(), F.col(amount))), F.lit(0.0)).alias("unmatched"))
    return out.withColumn("share_matched", F.try_divide("matched", F.col("matched") + F.col("unmatched")))


def cost_per_unit(cells: DataFrame, year: str, cost: str, units: str, floor: float = 0.0,
                  back: int = 2, ahead: int = 2, keys: list[str] | None = None) -> DataFrame:
    """Cost per mile by year and in centred windows: sums first, then the ratio; NULL below the floor."""
    out = range_window_sum(cells, keys or [], year, {cost: cost, units: units}, back, ahead)
    return out.withColumns({
        "cost_per_unit": guarded_ratio(F.col(cost), F.col(units), floor),
        "cost_per_unit_win": guarded_ratio(F.col(f"{cost}_win"), F.col(f"{units}_win"), floor)})


def merge_series(series: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer merge of several one-value series, each given as (key, value) frames."""
    named = [df.toDF(key, name) for name, df in series.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), named)


def split_by_flag(rows: DataFrame, unit: list[str], flag: str, year: str, amount: str) -> DataFrame:
    """Spend of units that have at least one flagged record, and of the others, by year."""
    totals = rows.groupBy(*unit).agg(F.max(F.col(flag).cast("int")).alias("has_flag"),
                                     F.max(year).alias(year),
                                     F.coalesce(F.sum(amount), F.lit(0.0)).alias(amount))
    return totals.groupBy(year, "has_flag").agg(F.sum(amount).alias(amount),
                                                F.count(F.lit(1)).alias("n_units"))


def type_series(rows: DataFrame, year: str, kind: str, amount: str) -> DataFrame:
    """Spend by type and year with its share of the year."""
    sums = rows.groupBy(year, kind).agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias(amount))
    return with_share(sums, amount, "share", within=[year])


def component_series(rows: DataFrame, year: str, components: dict[str, Column], amount: str,
                     scale: float = 1.0) -> DataFrame:
    """Yearly spend by component (conditions may overlap), one column each."""
    return rows.groupBy(year).agg(*[
        (F.coalesce(F.sum(F.when(cond, F.col(amount))), F.lit(0.0)) / scale).alias(n)
        for n, cond in components.items()])


def opening_stats(rows: DataFrame, year: str, length: str, cells: dict[str, list[str]]) -> DataFrame:
    """Yearly totals, mean length and number of distinct cells at each grain."""
    out = rows.groupBy(year).agg(F.sum(length).alias("total"), F.avg(length).alias("mean_length"),
                                 F.count(F.lit(1)).alias("n"))
    for name, keys in cells.items():
        seen = rows.select(year, *keys).distinct().groupBy(year).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(seen, year, "left")
    return out


def compare_totals(a: DataFrame, b: DataFrame, keys: list[str], a_value: str, b_value: str) -> DataFrame:
    """Totals of two tables by key, joined: difference and its sign."""
    left = a.groupBy(*keys).agg(F.sum(a_value).alias("left_total"))
    right = b.groupBy(*keys).agg(F.sum(b_value).alias("right_total"))
    out = left.join(right, keys)
    return out.withColumn("difference", F.col("left_total") - F.col("right_total")).withColumn(
        "sign", F.signum("difference").cast("int"))


def concentration_bands(rows: DataFrame, cell: list[str], year: str, points: list[float]) -> DataFrame:
    """Cells per year whose count is at most each percentile of all the cell counts."""
    from roadledger.operators.aggregates import exact_percentiles
    counts = rows.groupBy(*cell, year).agg(F.count(F.lit(1)).alias("n"))
    names = [f"p{int(100 * p)}" for p in points]
    cut = exact_percentiles(counts, [], "n", points, names)
    limits = cut.select(F.struct(*names).alias("l")).scalar()
    out = counts.groupBy(year).agg(F.count(F.lit(1)).alias("n_cells"), *[
        F.count(F.when(F.col("n") <= limits[n], 1)).alias(f"within_{n}") for n in names])
    return out.withColumns({f"share_{n}": F.col(f"within_{n}") / F.col("n_cells") for n in names})


def multiplicity(pairs: DataFrame, key: list[str], amount: str) -> DataFrame:
    """How many matches each record has: number of records and amount by multiplicity."""
    per = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_matches"), F.max(amount).alias("__a"))
    return per.groupBy("n_matches").agg(F.count(F.lit(1)).alias("n_records"), F.sum("__a").alias("amount"))
