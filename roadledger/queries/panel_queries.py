"""Event panels, allocation, grain panels, series and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.operators import ordered as od
from roadledger.operators import panels as pn
from roadledger.operators import regression as rg
from roadledger.queries.base import openings, query, read, receipts, rnd

_FIRST = "ev AS (SELECT o_custkey, CAST(min(open_year) AS INTEGER) AS open_year FROM openings GROUP BY 1)"
_SPEND = "sp AS (SELECT o_custkey, ship_year, sum(l_extendedprice) AS amount FROM receipts GROUP BY 1, 2)"
_PANEL = f"""{_FIRST}, {_SPEND}, jn AS (SELECT ev.o_custkey, open_year, ship_year, amount FROM ev JOIN sp USING (o_custkey)),
fr AS (SELECT DISTINCT o_custkey, open_year, unnest(range((SELECT min(ship_year) FROM jn), (SELECT max(ship_year) FROM jn) + 1)) AS y FROM jn),
pnl AS (SELECT fr.o_custkey, fr.open_year, CAST(y AS INTEGER) AS ship_year, coalesce(amount, 0) AS amount, CAST(y - fr.open_year AS INTEGER) AS event_time FROM fr LEFT JOIN jn
  ON jn.o_custkey = fr.o_custkey AND jn.open_year = fr.open_year AND jn.ship_year = y)"""


def _first(spark: SparkSession, sf: str) -> DataFrame:
    return openings(spark, sf).groupBy("o_custkey").agg(F.min("open_year").alias("open_year"))


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).withColumnRenamed("l_extendedprice", "amount")
    return pn.event_panel(_first(spark, sf), r, ["o_custkey"], "open_year", "ship_year", "amount")


@query(f"WITH {_PANEL} SELECT o_custkey, open_year, ship_year, round(amount, 2) AS amount, event_time FROM pnl")
def event_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(_panel(spark, sf), amount=2)


@query(f"WITH {_PANEL} SELECT event_time, count(*) AS n, round(avg(amount), 4) AS mean FROM pnl GROUP BY 1")
def event_mean(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).withColumnRenamed("l_extendedprice", "amount")
    return rnd(pn.event_mean(_first(spark, sf), r, ["o_custkey"], "open_year", "ship_year", "amount"), mean=4)


_ALL_OPEN = _PANEL.replace(_FIRST, "ev AS (SELECT DISTINCT o_custkey, open_year FROM openings)")


@query(f"WITH {_ALL_OPEN} SELECT event_time, count(*) AS n, round(avg(amount), 4) AS mean FROM pnl GROUP BY 1")
def event_mean_all_openings(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).withColumnRenamed("l_extendedprice", "amount")
    return rnd(pn.event_mean(openings(spark, sf), r, ["o_custkey"], "open_year", "ship_year", "amount"), mean=4)


@query(f"""WITH {_PANEL} SELECT o_custkey, round(sum(CASE WHEN event_time BETWEEN -1 AND 3 THEN amount ELSE 0 END), 2) AS inside, round(sum(amount), 2) AS total,
  round(sum(CASE WHEN event_time BETWEEN -1 AND 3 THEN amount ELSE 0 END) / sum(amount), 8) AS share FROM pnl GROUP BY 1
  HAVING sum(CASE WHEN event_time BETWEEN -1 AND 3 THEN amount ELSE 0 END) / sum(amount) > 0.5""")
def window_share(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pn.window_share(_panel(spark, sf), ["o_custkey"], "amount", -1, 3), inside=2, total=2, share=8)


_PROFILE = f"""{_PANEL}, prof AS (SELECT event_time, avg(amount) AS f_full, CASE WHEN event_time BETWEEN -1 AND 3 THEN avg(amount) ELSE 0 END AS f_narrow,
  CASE WHEN event_time BETWEEN -4 AND 6 THEN avg(amount) ELSE 0 END AS f_wide FROM pnl GROUP BY 1)"""
_WINDOWS = {"full": None, "narrow": (-1, 3), "wide": (-4, 6)}


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).withColumnRenamed("l_extendedprice", "amount")
    means = pn.event_mean(_first(spark, sf), r, ["o_custkey"], "open_year", "ship_year", "amount")
    return pn.spend_profile(means, "mean", _WINDOWS)


@query(f"WITH {_PROFILE} SELECT event_time, round(f_full, 4) AS f_full, round(f_narrow, 4) AS f_narrow, round(f_wide, 4) AS f_wide FROM prof")
def spend_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(_profile(spark, sf), f_full=4, f_narrow=4, f_wide=4)


@query(f"WITH {_PROFILE} " + " UNION ALL ".join(f"""SELECT '{n}' AS "window", round(sum(f_{n}), 3) AS area, round(max(f_{n}), 3) AS peak, arg_max(event_time, f_{n}) AS peak_at,
  count(CASE WHEN f_{n} > 0 THEN 1 END) AS n_positive FROM prof""" for n in _WINDOWS))
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = _profile(spark, sf)
    a, b, c = (pn.profile_summary(p, n) for n in _WINDOWS)
    return rnd(a.unionByName(b).unionByName(c), area=3, peak=3)


_ALLOC = f"""{_PROFILE}, ch AS (SELECT o_orderkey, o_custkey, o_totalprice / 1000 AS miles, CASE WHEN o_orderpriority <> '5-LOW' THEN open_year END AS open_year FROM openings),
pr AS (SELECT c.o_orderkey, c.o_custkey, c.miles, s.ship_year, s.amount, c.miles * coalesce(f_narrow, 0) AS w FROM ch c JOIN sp s USING (o_custkey)
  LEFT JOIN prof p ON p.event_time = s.ship_year - c.open_year WHERE c.open_year IS NOT NULL),
sh AS (SELECT *, sum(w) OVER (PARTITION BY o_custkey, ship_year) AS tw, sum(miles) OVER (PARTITION BY o_custkey, ship_year) AS tm FROM pr),
al AS (SELECT o_orderkey, sum(CASE WHEN tw > 0 THEN w / tw ELSE miles / tm END * amount) AS est FROM sh GROUP BY 1)"""


def _allocated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chains = openings(spark, sf).select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("miles"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("open_year")).alias("open_year"))
    r = receipts(spark, sf).withColumnRenamed("l_extendedprice", "amount")
    actual = r.groupBy("o_custkey", "ship_year").agg(F.sum("amount").alias("amount"))
    out = pn.allocate_spend(chains, actual, _profile(spark, sf), ["o_custkey"], "o_orderkey", "open_year", "miles", "ship_year",
                            {"amount": "f_narrow"})
    return out, actual


@query(f"""WITH {_ALLOC} SELECT ch.o_orderkey, ch.o_custkey, ch.open_year, ch.miles, CAST(ch.open_year IS NULL AS INTEGER) AS no_open_year, round(est, 3) AS est_amount
  FROM ch LEFT JOIN al USING (o_orderkey)""")
def allocate_spend(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(_allocated(spark, sf)[0], est_amount=3)


@query(f"""WITH {_ALLOC}, e AS (SELECT o_custkey, sum(est) AS a FROM ch JOIN al USING (o_orderkey) GROUP BY 1)
SELECT e.o_custkey, round(a, 2) AS allocated, round(t, 2) AS actual, round(abs(a - t), 2) AS gap FROM e JOIN (SELECT o_custkey, sum(amount) AS t FROM sp GROUP BY 1) USING (o_custkey)""")
def allocation_gap(spark: SparkSession, sf: str) -> DataFrame:
    allocated, actual = _allocated(spark, sf)
    return rnd(pn.allocation_gap(allocated, actual, ["o_custkey"], "est_amount", "amount"), allocated=2, actual=2, gap=2)


def _grain_sql(unit: str, time: str) -> str:
    u = f"{unit}, " if unit else ""
    frame = f"(SELECT DISTINCT {unit} FROM b0) CROSS JOIN (SELECT DISTINCT period FROM b0)" if unit else "b0"
    using = f"USING ({unit}, period)" if unit else ""
    src = f"FROM {frame} LEFT JOIN b0 {using}" if unit else "FROM b0"
    return f"""WITH n AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT {u}period, sum(l_extendedprice) AS spend FROM (SELECT *, {time.format('(ship_year - 1)')} AS period FROM receipts JOIN n ON o_custkey = c_custkey) GROUP BY ALL),
    m AS (SELECT {u}period, sum(o_totalprice) AS miles FROM (SELECT *, {time.format('open_year')} AS period FROM openings JOIN n ON o_custkey = c_custkey) GROUP BY ALL),
    b0 AS (SELECT {u}period, coalesce(spend, 0) AS spend, coalesce(miles, 0) AS miles FROM s FULL OUTER JOIN m USING ({u}period))
    SELECT {u}period, round(coalesce(spend, 0), 2) AS spend, round(coalesce(miles, 0), 2) AS miles, round(spend / nullif(miles, 0), 8) AS spend_per_mile,
      round(miles / nullif(spend, 0), 8) AS miles_per_spend {src}"""


def _grain(spark: SparkSession, sf: str, unit: list[str], block: bool) -> DataFrame:
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(n, "c_nationkey")
    time = (F.floor(F.col("year") / 5) * 5).cast("int") if block else F.col("year")
    out = pn.grain_panel(receipts(spark, sf).join(c, "o_custkey"), openings(spark, sf).join(c, "o_custkey"), unit, time,
                         "ship_year", "open_year", "l_extendedprice", "o_totalprice")
    return rnd(out, spend=2, miles=2, spend_per_mile=8, miles_per_spend=8)


_YEAR, _BLOCK = "CAST({} AS INTEGER)", "CAST(floor({} / 5) * 5 AS INTEGER)"
for _name, _unit, _five in [("grain_panel_nation_year", "c_nationkey", False), ("grain_panel_nation_5y", "c_nationkey", True),
                            ("grain_panel_region_5y", "n_regionkey", True), ("grain_panel_national_year", "", False),
                            ("grain_panel_national_5y", "", True)]:
    query(_grain_sql(_unit, _BLOCK if _five else _YEAR), _name)(
        lambda spark, sf, u=_unit, f=_five: _grain(spark, sf, [u] if u else [], f))


@query("""
WITH p AS (SELECT o_orderkey, order_year, sum(l_extendedprice) AS cost FROM receipts GROUP BY 1, 2),
s AS (SELECT *, cost / sum(cost) OVER (PARTITION BY order_year) AS share FROM p),
y AS (SELECT open_year, count(*) AS units FROM openings GROUP BY 1)
SELECT o_orderkey, order_year, lag, round(share * units, 8) AS pseudo_units FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS lag FROM s) JOIN y ON open_year = order_year - lag""")
def lagged_pseudo_units(spark: SparkSession, sf: str) -> DataFrame:
    p = receipts(spark, sf).groupBy("o_orderkey", "order_year").agg(F.sum("l_extendedprice").alias("cost"))
    y = openings(spark, sf).groupBy(F.col("open_year").alias("order_year")).agg(F.count(F.lit(1)).alias("units"))
    return rnd(pn.pseudo_units(p, y, "order_year", "cost", "units", range(6), ["o_orderkey"]), pseudo_units=8)


@query("""
WITH c AS (SELECT c_nationkey, order_year, sum(l_extendedprice) AS cost, sum(l_quantity) AS units FROM receipts JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
w AS (SELECT *, sum(cost) OVER v AS cost_win, sum(units) OVER v AS units_win FROM c WINDOW v AS (PARTITION BY c_nationkey ORDER BY order_year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT c_nationkey, order_year, round(cost, 2) AS cost, units, round(cost_win, 2) AS cost_win, units_win, round(CASE WHEN units >= 8000 THEN cost / units END, 6) AS cost_per_unit,
  round(CASE WHEN units_win >= 8000 THEN cost_win / units_win END, 6) AS cost_per_unit_win FROM w""")
def range_window_ratio(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    r = receipts(spark, sf).join(c, "o_custkey").select("c_nationkey", "order_year", F.col("l_extendedprice").alias("cost"), F.col("l_quantity").alias("units"))
    out = pn.cost_per_unit(r, "order_year", "cost", "units", 8000.0, keys=["c_nationkey"])
    return rnd(out, cost=2, cost_win=2, cost_per_unit=6, cost_per_unit_win=6)


@query("""
WITH a AS (SELECT order_year AS y, sum(l_extendedprice) / sum(l_quantity) AS v FROM receipts GROUP BY 1),
b AS (SELECT ship_year AS y, sum(l_extendedprice) / sum(l_quantity) AS v FROM receipts GROUP BY 1), c AS (SELECT open_year AS y, avg(o_totalprice) AS v FROM openings GROUP BY 1)
SELECT coalesce(a.y, b.y, c.y) AS y, round(a.v, 6) AS by_order, round(b.v, 6) AS by_ship, round(c.v, 6) AS mean_order FROM a FULL OUTER JOIN b ON a.y = b.y FULL OUTER JOIN c ON c.y = coalesce(a.y, b.y)""")
def merged_cost_series(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf)
    ratio = (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("v")
    out = pn.merge_series({"by_order": r.groupBy("order_year").agg(ratio), "by_ship": r.groupBy("ship_year").agg(ratio),
                           "mean_order": openings(spark, sf).groupBy("open_year").agg(F.avg("o_totalprice").alias("v"))}, "y")
    return rnd(out, by_order=6, by_ship=6, mean_order=6)


@query("""SELECT order_year, has_flag, round(sum(l_extendedprice), 2) AS l_extendedprice, count(*) AS n_units FROM (SELECT o_orderkey, CAST(max(CAST(l_returnflag = 'R' AS INTEGER)) AS INTEGER) AS has_flag,
  max(order_year) AS order_year, sum(l_extendedprice) AS l_extendedprice FROM receipts GROUP BY 1) GROUP BY 1, 2""")
def spend_by_flagged_unit(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).withColumn("ret", F.col("l_returnflag") == "R")
    return rnd(pn.split_by_flag(r, ["o_orderkey"], "ret", "order_year", "l_extendedprice"), l_extendedprice=2)


@query("""SELECT ship_year, l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY ship_year), 8) AS share FROM receipts GROUP BY 1, 2""")
def type_series(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pn.type_series(receipts(spark, sf), "ship_year", "l_returnflag", "l_extendedprice"), l_extendedprice=2, share=8)


@query("""SELECT ship_year, round(sum(l_extendedprice) / 1e6, 6) AS total, round(coalesce(sum(CASE WHEN l_tax > 0.05 THEN l_extendedprice END), 0) / 1e6, 6) AS taxed,
  round(coalesce(sum(CASE WHEN l_quantity >= 30 THEN l_extendedprice END), 0) / 1e6, 6) AS large FROM receipts GROUP BY 1""")
def component_series(spark: SparkSession, sf: str) -> DataFrame:
    out = pn.component_series(receipts(spark, sf), "ship_year", {"total": F.lit(True), "taxed": F.col("l_tax") > 0.05, "large": F.col("l_quantity") >= 30}, "l_extendedprice", 1e6)
    return rnd(out, total=6, taxed=6, large=6)


@query("""SELECT open_year, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean_length, count(*) AS n, count(DISTINCT o_custkey) AS n_customers,
  count(DISTINCT o_custkey || '-' || o_orderpriority) AS n_cells FROM openings GROUP BY 1""")
def opening_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = pn.opening_stats(openings(spark, sf), "open_year", "o_totalprice", {"customers": ["o_custkey"], "cells": ["o_custkey", "o_orderpriority"]})
    return rnd(out, total=2, mean_length=4)


_CMP = """SELECT o_custkey, round(a, 2) AS left_total, round(b, 2) AS right_total, round(a - b, 2) AS difference, CAST(sign(a - b) AS INTEGER) AS sign FROM
  (SELECT o_custkey, sum(o_totalprice) AS a FROM orders GROUP BY 1) JOIN (SELECT o_custkey, sum(l_extendedprice) AS b FROM receipts GROUP BY 1) USING (o_custkey)"""


@query(_CMP)
def length_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pn.compare_totals(read(spark, sf, "orders"), receipts(spark, sf), ["o_custkey"], "o_totalprice", "l_extendedprice"),
               left_total=2, right_total=2, difference=2)


@query(f"SELECT * FROM ({_CMP}) ORDER BY abs(difference) DESC, o_custkey LIMIT 10")
def top_differences(spark: SparkSession, sf: str) -> DataFrame:
    return length_comparison(spark, sf).orderBy(F.desc(F.abs("difference")), "o_custkey").limit(10)


_PTS = [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9)]


@query("""
WITH c AS (SELECT o_custkey, open_year, count(*) AS n FROM openings GROUP BY 1, 2), q AS (SELECT """ + ", ".join(f"quantile_cont(n, {p}) AS {n}" for n, p in _PTS) + """ FROM c)
SELECT open_year, count(*) AS n_cells, """ + ", ".join(f"count(CASE WHEN n <= {n} THEN 1 END) AS within_{n}, round(count(CASE WHEN n <= {n} THEN 1 END) / count(*), 8) AS share_{n}" for n, _ in _PTS) + """
FROM c, q GROUP BY 1""")
def concentration_bands(spark: SparkSession, sf: str) -> DataFrame:
    out = pn.concentration_bands(openings(spark, sf), ["o_custkey"], "open_year", [p for _, p in _PTS])
    return rnd(out, **{f"share_{n}": 8 for n, _ in _PTS})


@query("""SELECT CAST(floor(datediff('day', o_orderdate, l_shipdate) / 365.25) AS BIGINT) AS years, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate >= o_orderdate GROUP BY 1, 2""")
def duration_bins(spark: SparkSession, sf: str) -> DataFrame:
    from roadledger.functions.dates import years_between
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    d = l.join(o, l["l_orderkey"] == o["o_orderkey"]).where("l_shipdate >= o_orderdate")
    years = F.floor(years_between(F.col("o_orderdate"), F.col("l_shipdate")))
    return rnd(d.groupBy(years.alias("years"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("amount")), amount=2)


@query("""SELECT open_year, round(count(*) / nullif(sum(o_totalprice) / 1e6, 0), 8) AS units_per_amount, round(sum(o_totalprice) / 1e6 / count(*), 8) AS amount_per_unit FROM openings GROUP BY 1""")
def ratio_of_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = openings(spark, sf).groupBy("open_year").agg(F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") / 1e6).alias("a"))
    return t.select("open_year", F.round(F.try_divide("n", "a"), 8).alias("units_per_amount"), F.round(F.try_divide("a", "n"), 8).alias("amount_per_unit"))


@query("""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem),
m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(y, x1) AS s1y, covar_pop(y, x2) AS s2y, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, var_pop(y) AS syy FROM d),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
r AS (SELECT *, n * (syy - b1 * s1y - b2 * s2y) / (n - 3) AS v FROM b)
SELECT 'x1' AS term, round(b1, 5) AS estimate, round(sqrt(v * s22 / (n * (s11 * s22 - s12 * s12))), 5) AS se, n FROM r UNION ALL
SELECT 'x2', round(b2, 5), round(sqrt(v * s11 / (n * (s11 * s22 - s12 * s12))), 5), n FROM r UNION ALL
SELECT 'const', round(my - b1 * m1 - b2 * m2, 5), round(sqrt(v * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * (s11 * s22 - s12 * s12)))), 5), n FROM r""")
def ols_two_regressors(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"))
    return rnd(rg.ols(d, "y", ["x1", "x2"]), estimate=5, se=5)


@query("""
WITH d AS (SELECT c_nationkey AS s, l_extendedprice AS y, l_quantity AS x FROM receipts JOIN customer ON o_custkey = c_custkey),
m AS (SELECT s, avg(y) AS my, avg(x) AS mx FROM d GROUP BY 1), w AS (SELECT d.s, y - my AS y, x - mx AS x FROM d JOIN m ON d.s = m.s),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT s) AS g FROM w),
sc AS (SELECT w.s, sum(x * (y - b * x)) AS g FROM w, b GROUP BY 1)
SELECT 'x' AS term, round(b, 6) AS estimate, round(sqrt((SELECT sum(g * g) FROM sc)) / sxx * sqrt(g / (g - 1) * (n - 1) / (n - 1 - g)), 6) AS se, n FROM b""")
def fe_one_way_clustered(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("s"))
    d = receipts(spark, sf).join(c, "o_custkey").select("s", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    return rnd(rg.fixed_effects(d, "y", ["x"], first="s", cluster="s"), estimate=6, se=6)


def _reg(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("s"), "c_acctbal")
    return receipts(spark, sf).join(c, "o_custkey").select(
        "s", "ship_year", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("x2"),
        (F.col("l_tax") + 0.01).alias("w"), (F.col("s") % 2).alias("treated"), (F.col("ship_year") >= 1999).cast("int").alias("post"))


def _effects_sql(xs: list[str], weight: str = "1.0", counted: str = "n_s + n_t - 1", extra: str = "") -> str:
    """SQL for a regression on ``xs`` with one dummy per nation and year and errors clustered on the nation.

    Both systems of equations are solved by elimination, one row of the matrix per table row.
    """
    k, zs = len(xs), [*xs, "y"]
    z = [f"z{i}" for i in range(k + 1)]

    def eliminate(name: str, start: str) -> str:
        return f"""{name} AS (SELECT 0 AS k, i, v FROM {start} UNION ALL SELECT m.k + 1, m.i, CASE WHEN m.i = m.k + 1 THEN list_transform(m.v, lambda x: x / p.v[p.i])
          ELSE list_transform(list_zip(m.v, p.v), lambda q: q[1] - m.v[p.i] / p.v[p.i] * q[2]) END FROM {name} m JOIN {name} p ON p.i = m.k + 1)"""

    inner = ", ".join(f"sum(w * z{i} * z{j}) AS m{min(i, j)}_{max(i, j)}" for i in range(k + 1) for j in range(i, k + 1))

    def m(i: int, j: int) -> str:
        return f"m{min(i, j)}_{max(i, j)}"

    small = " UNION ALL ".join(f"SELECT {i + 1} AS i, [{', '.join([m(i, j) for j in range(k + 1)] + [str(float(i == j)) for j in range(k)])}] AS v FROM inn" for i in range(k))
    fitted = " - ".join([z[k], *[f"(SELECT v[{k + 1}] FROM sol WHERE i = {j + 1}) * z{j}" for j in range(k)]])
    scores = ", ".join(f"sum(w * z{i} * u) AS g{i}" for i in range(k))
    meat = ", ".join(f"sum(g{i} * g{j}) AS v{i}_{j}" for i in range(k) for j in range(k))

    def var(i: int) -> str:
        return " + ".join(f"(SELECT v[{k + 2 + a}] FROM sol WHERE i = {i + 1}) * v{a}_{b} * (SELECT v[{k + 2 + b}] FROM sol WHERE i = {i + 1})" for a in range(k) for b in range(k))

    return f"""
WITH RECURSIVE d AS (SELECT CAST(c_nationkey AS INTEGER) AS s, ship_year AS t, l_extendedprice AS y, l_quantity AS x, l_discount AS x2, {weight} AS w,
    c_nationkey % 2 AS treated, CASE WHEN ship_year >= 1999 THEN 1 ELSE 0 END AS post FROM receipts JOIN customer ON o_custkey = c_custkey),
  v AS (SELECT s, t, w, {", ".join(f"CAST({e} AS DOUBLE) AS z{i}" for i, e in enumerate(zs))} FROM d),
  lv AS (SELECT DISTINCT 's' AS kind, s AS l FROM v UNION ALL SELECT DISTINCT 't', t FROM v WHERE t > (SELECT min(t) FROM v)),
  dm AS (SELECT kind, l, row_number() OVER (ORDER BY kind, l) AS i FROM lv),
  c AS MATERIALIZED (SELECT s, t, sum(w) AS w, {", ".join(f"sum(w * {e}) AS {e}" for e in z)} FROM v GROUP BY s, t),
  ci AS MATERIALIZED (SELECT c.*, i FROM c JOIN dm ON (kind = 's' AND l = s) OR (kind = 't' AND l = t)),
  a AS (SELECT p.i, q.i AS j, sum(p.w) AS v FROM ci p JOIN ci q ON p.s = q.s AND p.t = q.t GROUP BY 1, 2),
  full_a AS (SELECT p.i, list(coalesce(a.v, 0) ORDER BY q.i) AS v FROM dm p CROSS JOIN dm q LEFT JOIN a ON a.i = p.i AND a.j = q.i GROUP BY p.i),
  start AS MATERIALIZED (SELECT i, list_concat(full_a.v, r) AS v FROM full_a JOIN (SELECT i, [{", ".join(f"sum({e})" for e in z)}] AS r FROM ci GROUP BY i) USING (i)),
  {eliminate("big", "start")},
  coef AS MATERIALIZED (SELECT kind, l, v[len(v) - {k}:] AS b FROM big JOIN dm USING (i) WHERE k = (SELECT max(k) FROM big)),
  res AS MATERIALIZED (SELECT v.s, w, {", ".join(f"{e} - a.b[{i + 1}] - coalesce(b.b[{i + 1}], 0) AS {e}" for i, e in enumerate(z))} FROM v JOIN coef a ON a.kind = 's' AND a.l = v.s
    LEFT JOIN coef b ON b.kind = 't' AND b.l = v.t),
  inn AS MATERIALIZED (SELECT {inner} FROM res), small AS MATERIALIZED ({small}), {eliminate("gs", "small")},
  sol AS MATERIALIZED (SELECT i, v FROM gs WHERE k = {k}),
  sc AS (SELECT s, {scores} FROM (SELECT *, {fitted} AS u FROM res) GROUP BY s),
  meat AS (SELECT {meat} FROM sc), sizes AS (SELECT count(*) AS n, count(DISTINCT s) AS n_s, count(DISTINCT t) AS n_t FROM v),
  fit AS ({" UNION ALL ".join(f"SELECT '{'y' + x.split('= ')[1][:4] if ' = ' in x else 'interaction' if '*' in x else x}' AS term, round((SELECT v[{k + 1}] FROM sol WHERE i = {i + 1}), 6) AS estimate, round(sqrt(({var(i)}) * n_s / (n_s - 1) * (n - 1) / (n - {k} - ({counted}))), 6) AS se, n FROM meat, sizes" for i, x in enumerate(xs))})
{extra or "SELECT * FROM fit"}"""


_STUDY = "SELECT term, estimate, se, n, true AS effects, 'estimated' AS status FROM fit"
_YEARS = [1995, 1996, 1997, 1999, 2000, 2001]


@query(_effects_sql(["x", "x2"], weight="l_tax + 0.01"))
def fe_two_way_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(rg.fixed_effects(_reg(spark, sf), "y", ["x", "x2"], first="s", second="ship_year", weight="w", cluster="s"), estimate=6, se=6)


@query(_effects_sql(["treated * post", "x"], counted="n_t", extra=f"""{_STUDY} UNION ALL
  SELECT unnest(['post', 'treated']), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), n, true, 'collinear' FROM sizes"""))
def difference_in_differences(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(rg.difference_in_differences(_reg(spark, sf), "y", "treated", "post", "s", "ship_year", ["x"]), estimate=6, se=6)


@query(_effects_sql([f"CASE WHEN t = {y} THEN treated ELSE 0 END" for y in _YEARS], counted="n_t", extra=_STUDY))
def event_study_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(rg.event_study(_reg(spark, sf), "y", "treated", "s", "ship_year", _YEARS, 1998), estimate=6, se=6)


@query("""SELECT o_custkey, round(sum(l_extendedprice), 2) AS total, CAST(length(string_agg(DISTINCT l_returnflag, '')) AS INTEGER) AS n_listed, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'multi' ELSE 'single' END AS kind
  FROM receipts GROUP BY 1""")
def spend_by_list_size(spark: SparkSession, sf: str) -> DataFrame:
    from roadledger.functions.text import list_size
    from roadledger.operators.aggregates import distinct_list
    r = receipts(spark, sf)
    lists = distinct_list(r, ["o_custkey"], "l_returnflag", None, "k").withColumn("k", F.array_join("k", "; "))
    t = r.groupBy("o_custkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).join(lists, "o_custkey")
    n = list_size(F.col("k"))
    return t.select("o_custkey", "total", n.alias("n_listed"), F.when(n > 1, "multi").otherwise("single").alias("kind"))
