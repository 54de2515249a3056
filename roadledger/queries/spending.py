"""Roll-ups, deflation, joins, samples and plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.functions import numeric
from roadledger.operators import aggregates as agg
from roadledger.operators import joins
from roadledger.plans.receipts import deflate
from roadledger.queries.base import openings, query, read, receipts, rnd

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_LO = ", ".join(LINE_ORDER)


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LO}) AS rn FROM lineitem),
flags AS (SELECT l_orderkey, l_returnflag, min(rn) AS rn FROM r GROUP BY ALL)
SELECT r.l_orderkey, count(*) AS receipts, round(sum(l_quantity), 2) AS l_quantity,
  round(sum(l_extendedprice), 2) AS l_extendedprice, arg_min(l_suppkey, rn) AS l_suppkey,
  arg_max(l_linestatus, rn) AS l_linestatus, max(l_discount) AS max_discount, any_value(f.kinds) AS kinds
FROM r JOIN (SELECT l_orderkey, string_agg(l_returnflag, '; ' ORDER BY rn) AS kinds FROM flags GROUP BY 1) f
  ON r.l_orderkey = f.l_orderkey GROUP BY r.l_orderkey""")
def project_rollup(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem")
    rolled = agg.roll_up(lines, ["l_orderkey"], LINE_ORDER, sums=["l_quantity", "l_extendedprice"],
                         firsts=["l_suppkey"], lasts=["l_linestatus"], maxima={"max_discount": "l_discount"},
                         count="receipts")
    kinds = agg.distinct_list(lines, ["l_orderkey"], "l_returnflag", LINE_ORDER, "kinds")
    out = rolled.join(kinds.withColumn("kinds", F.array_join("kinds", "; ")), "l_orderkey")
    return rnd(out, l_quantity=2, l_extendedprice=2)


@query("""
WITH idx AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
p AS (SELECT o_orderkey, order_year, sum(l_extendedprice) AS cost,
      sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS cost_new FROM receipts GROUP BY 1, 2)
SELECT order_year, round(sum(cost / ((100 + 3 * (order_year - 1990)) / 100.0)), 2) AS cost_adjusted,
  round(sum(cost_new / ((100 + 3 * (order_year - 1990)) / 100.0)), 2) AS cost_new_adjusted, count(*) AS n
FROM p JOIN idx ON y = order_year GROUP BY 1""")
def deflated_spend_by_year(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).withColumn("new", numeric.measure_if(F.col("l_returnflag") == "N", F.col("l_extendedprice")))
    projects = r.groupBy("o_orderkey", "order_year").agg(
        numeric.sum0(F.col("l_extendedprice")).alias("cost"), numeric.sum0(F.col("new")).alias("cost_new"))
    years = openings(spark, sf).select(F.col("open_year").alias("year")).distinct()
    index = years.withColumn("cpi", (100 + 3 * (F.col("year") - 1990)).cast("double"))
    real = deflate(projects, index, "order_year", ["cost", "cost_new"])
    out = real.groupBy("order_year").agg(F.sum("cost_adjusted").alias("cost_adjusted"),
                                         F.sum("cost_new_adjusted").alias("cost_new_adjusted"),
                                         F.count(F.lit(1)).alias("n"))
    return rnd(out, cost_adjusted=2, cost_new_adjusted=2)


@query("""
WITH big AS (SELECT o_custkey + 100 AS c_custkey, count(*) AS n_big FROM orders GROUP BY 1),
rich AS (SELECT c_custkey, c_acctbal FROM customer)
SELECT coalesce(rich.c_custkey, big.c_custkey) AS c_custkey, c_acctbal, n_big,
  CAST(CASE WHEN rich.c_custkey IS NULL THEN 2 WHEN big.c_custkey IS NULL THEN 1 ELSE 3 END AS INTEGER) AS merge_code
FROM rich FULL OUTER JOIN big ON rich.c_custkey = big.c_custkey""")
def merge_code_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    rich = read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    # whole tables on moved keys, so that both sides have rows of their own
    big = read(spark, sf, "orders").groupBy((F.col("o_custkey") + 100).alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_big"))
    return joins.merge_code(rich, big, ["c_custkey"])


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem
  WHERE l_orderkey + l_linenumber = o_orderkey)""")
def unmatched_left(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("o_orderkey"))
    return joins.unmatched(read(spark, sf, "orders"), lines, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS
  (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey + o_custkey % 3)""")
def unmatched_right(spark: SparkSession, sf: str) -> DataFrame:
    moved = read(spark, sf, "orders").select((F.col("o_orderkey") + F.col("o_custkey") % 3).alias("l_orderkey"))
    return joins.unmatched(read(spark, sf, "lineitem"), moved, ["l_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey")


def _matches(spark: SparkSession, sf: str, keys: list[str], before: int, after: int) -> DataFrame:
    o = openings(spark, sf).select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("opening"), "open_year")
    r = receipts(spark, sf).select(*keys, F.col("o_orderkey").alias("project"), "l_linenumber", "l_partkey",
                                   "l_extendedprice", "ship_year")
    return joins.window_match(o.select(*keys, "opening", "open_year"), r, keys, "open_year", "ship_year", before, after)


def _match_sql(keys: str, before: int, after: int) -> str:
    on = " AND ".join(f"o.{k} = r.{k}" for k in keys.split())
    cols = ", ".join(f"o.{k}" for k in keys.split())
    return f"""SELECT {cols}, o.o_orderkey AS opening, open_year, r.o_orderkey AS project, l_linenumber, l_partkey,
      l_extendedprice, ship_year, ship_year - open_year AS yr_gap FROM openings o JOIN receipts r ON {on}
      AND ship_year BETWEEN open_year - {before} AND open_year + {after}"""


@query(_match_sql("o_custkey o_orderpriority", 0, 2))
def window_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf, ["o_custkey", "o_orderpriority"], 0, 2)


@query(f"""SELECT open_year, yr_gap, count(*) AS n, round(sum(l_extendedprice), 2) AS amount
  FROM ({_match_sql("o_custkey", 9, 7)}) GROUP BY ALL""")
def window_match_loose(spark: SparkSession, sf: str) -> DataFrame:
    m = _matches(spark, sf, ["o_custkey"], 9, 7)
    return rnd(m.groupBy("open_year", "yr_gap").agg(F.count(F.lit(1)).alias("n"),
                                                    F.sum("l_extendedprice").alias("amount")), amount=2)


@query("""
WITH r AS (SELECT o_custkey, o_orderpriority, ship_year, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS i
  FROM receipts),
o AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS j FROM openings),
n AS (SELECT rc.o_custkey, rc.o_orderpriority, rc.n AS rn, oc.n AS onn FROM
  (SELECT o_custkey, o_orderpriority, count(*) n FROM r GROUP BY 1, 2) rc JOIN
  (SELECT o_custkey, o_orderpriority, count(*) n FROM o GROUP BY 1, 2) oc USING (o_custkey, o_orderpriority)),
pos AS (SELECT o_custkey, o_orderpriority, rn, onn, unnest(range(1, greatest(rn, onn) + 1)) AS k FROM n)
SELECT pos.o_custkey, pos.o_orderpriority, l_partkey, l_suppkey, l_extendedprice, o_orderkey, o_totalprice
FROM pos JOIN r ON r.o_custkey = pos.o_custkey AND r.o_orderpriority = pos.o_orderpriority AND r.i = least(k, rn)
JOIN o ON o.o_custkey = pos.o_custkey AND o.o_orderpriority = pos.o_orderpriority AND o.j = least(k, onn)""")
def positional_merge(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["o_custkey", "o_orderpriority"]
    r = receipts(spark, sf).select(*keys, "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    o = openings(spark, sf).select(*keys, "o_orderkey", "o_totalprice")
    m = joins.positional_merge(r, o, keys, ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"], ["o_orderkey"],
                               left_split=F.date_trunc("month", "l_shipdate"), right_split=F.floor(F.col("o_orderkey") / 100_000))
    # the SQL pairs keys of both sides only; positional_merge_outer keeps all
    return m.where("merge_code = 3").select(*keys, "l_partkey", "l_suppkey", "l_extendedprice", "o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT nullif(o_custkey % 50, 7) AS k, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY nullif(o_custkey % 50, 7) ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, o_custkey, l_extendedprice) AS i FROM receipts),
o AS (SELECT nullif(s_suppkey % 60, 7) + 20 AS k, s_suppkey, row_number() OVER (PARTITION BY nullif(s_suppkey % 60, 7) ORDER BY s_suppkey) AS j FROM supplier),
n AS (SELECT coalesce(a.k, b.k) AS k, a.n AS rn, b.n AS onn FROM (SELECT k, count(*) n FROM r GROUP BY 1) a
  FULL JOIN (SELECT k, count(*) n FROM o GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k),
pos AS (SELECT k, rn, onn, unnest(range(1, greatest(coalesce(rn, 0), coalesce(onn, 0)) + 1)) AS p FROM n)
SELECT pos.k, r.l_partkey, r.l_suppkey, o.s_suppkey, CAST(CASE WHEN onn IS NULL THEN 1 WHEN rn IS NULL THEN 2 ELSE 3 END AS INTEGER) AS merge_code
FROM pos LEFT JOIN r ON r.k IS NOT DISTINCT FROM pos.k AND r.i = least(p, rn) LEFT JOIN o ON o.k IS NOT DISTINCT FROM pos.k AND o.j = least(p, onn)""")
def positional_merge_outer(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).withColumn("k", F.nullif(F.col("o_custkey") % 50, F.lit(7)))
    r = r.select("k", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey", "l_extendedprice")
    o = read(spark, sf, "supplier").select((F.nullif(F.col("s_suppkey") % 60, F.lit(7)) + 20).alias("k"), "s_suppkey")
    m = joins.positional_merge(r, o, ["k"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey", "l_extendedprice"], ["s_suppkey"],
                               left_split=F.date_trunc("month", "l_shipdate"), right_split=F.floor(F.col("s_suppkey") / 100_000))
    return m.select("k", "l_partkey", "l_suppkey", "s_suppkey", "merge_code")


@query("""
WITH per AS (SELECT o_custkey, open_year, count(DISTINCT o_orderpriority) u FROM openings GROUP BY 1, 2),
a AS (SELECT o_custkey FROM per GROUP BY 1 HAVING max(u) = 1),
b AS (SELECT o_custkey FROM openings GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1),
c AS (SELECT o_custkey FROM openings GROUP BY 1 HAVING count(DISTINCT open_year) = 1)
SELECT 'one_per_year' AS rule, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_custkey IN (FROM a)
UNION ALL SELECT 'single_unit', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_custkey IN (FROM b)
UNION ALL SELECT 'single_year', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_custkey IN (FROM c)""")
def sample_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    o = openings(spark, sf)
    parts = []
    for rule in ("one_per_year", "single_unit", "single_year"):
        keys = agg.sample_keys(o, ["o_custkey"], "o_orderpriority", "open_year", rule)
        kept = o.join(keys, ["o_custkey"], "left_semi")
        parts.append(kept.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"),
                              F.round(F.sum("o_totalprice"), 2).alias("amount")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _census_sql(grain: str, keys: str) -> str:
    cell = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys.split(", "))
    return f"""SELECT '{grain}' AS grain, {cell} AS cell, max(u) = 1 AS one_per_year, any_value(e) = 1 AS single_unit,
      count(*) = 1 AS single_year FROM (SELECT {keys}, open_year, count(DISTINCT o_orderkey) AS u FROM openings GROUP BY ALL)
      JOIN (SELECT {keys}, count(DISTINCT o_orderkey) AS e FROM openings GROUP BY ALL) USING ({keys}) GROUP BY {keys}"""


@query(_census_sql("customer", "o_custkey") + " UNION ALL " + _census_sql("customer_priority", "o_custkey, o_orderpriority"))
def uniqueness_census(spark: SparkSession, sf: str) -> DataFrame:
    return agg.uniqueness_census(openings(spark, sf), {
        "customer": ["o_custkey"], "customer_priority": ["o_custkey", "o_orderpriority"]}, "o_orderkey", "open_year")


@query("""SELECT open_year, round(sum(CASE WHEN m THEN o_totalprice ELSE 0 END), 2) AS matched,
  round(sum(CASE WHEN m THEN 0 ELSE o_totalprice END), 2) AS unmatched,
  round(sum(CASE WHEN m THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 8) AS share_matched
FROM (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey + l_linenumber = o_orderkey) AS m FROM openings)
GROUP BY 1""")
def match_success(spark: SparkSession, sf: str) -> DataFrame:
    from roadledger.operators.panels import match_success as run
    hit = read(spark, sf, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("o_orderkey"))
    out = run(openings(spark, sf), hit, ["o_orderkey"], "open_year", "o_totalprice")
    return rnd(out, matched=2, unmatched=2, share_matched=8)


@query("""SELECT n_matches, count(*) AS n_records, round(sum(a), 2) AS amount FROM (
  SELECT o_orderkey, count(*) AS n_matches, max(l_extendedprice) AS a FROM receipts GROUP BY 1) GROUP BY 1""")
def match_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    from roadledger.operators.panels import multiplicity
    return rnd(multiplicity(receipts(spark, sf), ["o_orderkey"], "l_extendedprice"), amount=2)


@query("""SELECT n.n_name AS n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
  FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY 1""")
def lookup_matched(spark: SparkSession, sf: str) -> DataFrame:
    dim = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = joins.lookup(read(spark, sf, "customer"), dim, ["c_nationkey"])
    return rnd(out.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance")), balance=2)


@query("""SELECT p_partkey, coalesce(n, 0) AS n_lines, c.qty AS qty FROM part LEFT JOIN (SELECT 2 * l_partkey AS l_partkey, count(*) n,
  sum(l_quantity) qty FROM lineitem GROUP BY 1) c ON p_partkey = l_partkey""")
def lookup_keep_all(spark: SparkSession, sf: str) -> DataFrame:
    dim = read(spark, sf, "lineitem").groupBy((2 * F.col("l_partkey")).alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    out = joins.lookup(read(spark, sf, "part"), dim, ["p_partkey"], keep_unmatched=True)
    return out.select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_lines"), "qty")


@query("""SELECT c_name, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1 HAVING count(*) > 1""")
def duplicate_key_check(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return joins.duplicate_keys(c, ["c_name"]).unionByName(
        joins.duplicate_keys(c.select(F.col("c_mktsegment").alias("c_name")), ["c_name"]))


@query("""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean_price
  FROM lineitem GROUP BY 1""")
def weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(agg.weighted_mean(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity",
                                 "mean_price"), mean_price=6)


def _wp(p: float, n: str) -> str:
    return f"""coalesce((max(x) FILTER (cum = {p} * tot) + min(x) FILTER (cum > {p} * tot)) / 2,
      min(x) FILTER (cum > {p} * tot), max(x) FILTER (cum = {p} * tot)) AS {n}"""


@query(f"""
WITH m AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS tot FROM m)
SELECT l_returnflag, {_wp(0.1, 'p10')}, {_wp(0.25, 'p25')}, {_wp(0.5, 'p50')}, {_wp(0.75, 'p75')}, {_wp(0.9, 'p90')}
FROM c GROUP BY 1""")
def weighted_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return agg.weighted_percentiles(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity",
                                    [0.1, 0.25, 0.5, 0.75, 0.9])


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2,
  round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders GROUP BY 1""")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(agg.exact_percentiles(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", [0.25, 0.5, 0.9],
                                     ["q1", "q2", "q90"]), q1=4, q2=4, q90=4)


@query("""SELECT o_orderkey, o_totalprice < (SELECT median(o_totalprice) FROM orders) AS below FROM orders""")
def below_median_flag(spark: SparkSession, sf: str) -> DataFrame:
    return agg.below_median(read(spark, sf, "orders"), "o_totalprice", "below").select("o_orderkey", "below")


@query("""
WITH late AS (SELECT * FROM openings WHERE open_year >= 1998)
SELECT o_orderkey, o_totalprice < (SELECT median(o_totalprice) FROM late) AS below FROM late""")
def below_median_refiltered(spark: SparkSession, sf: str) -> DataFrame:
    late = openings(spark, sf).where("open_year >= 1998")
    return agg.below_median(late, "o_totalprice", "below").select("o_orderkey", "below")


@query("""SELECT CASE WHEN l_tax > 0 THEN l_tax END AS tax, count(*) AS n, round(sum(l_extendedprice), 2) AS weight,
  round(100.0 * count(*) / sum(count(*)) OVER (), 8) AS pct,
  round(100.0 * sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 8) AS pct_weight FROM lineitem GROUP BY 1""")
def frequency_table(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return rnd(agg.frequency(l, ["tax"], "l_extendedprice"), weight=2, pct=8, pct_weight=8)


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 8) AS pct_cell,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 8) AS pct_row,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 8) AS pct_col FROM orders GROUP BY 1, 2""")
def two_way_percent(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(agg.two_way(read(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), pct_cell=8, pct_row=8, pct_col=8)


@query("""
WITH c AS (SELECT CAST(p_size % 7 AS INTEGER) AS a, CAST(floor(p_retailprice / 10) % 9 AS INTEGER) AS b, sum(p_retailprice) AS n FROM part GROUP BY 1, 2),
g AS (SELECT CAST(x.range AS INTEGER) AS a, CAST(y.range AS INTEGER) AS b FROM range(0, 7) x, range(0, 7) y)
SELECT a, b, round(coalesce(n, 0), 2) AS n, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 8) AS pct
FROM g LEFT JOIN c USING (a, b)""")
def dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").withColumns({"a": F.col("p_size") % 7, "b": F.floor(F.col("p_retailprice") / 10) % 9})
    # the SQL counts inside the frame only; dense_grid_whole counts all
    return rnd(agg.dense_grid(p.where("b < 7"), "a", range(7), "b", range(7), "p_retailprice"), n=2, pct=8)


@query("""
WITH c AS (SELECT CAST(p_size % 7 AS INTEGER) AS a, CAST(floor(p_retailprice / 10) % 9 AS INTEGER) AS b, sum(p_retailprice) AS n FROM part GROUP BY 1, 2),
g AS (SELECT CAST(x.range AS INTEGER) AS a, CAST(y.range AS INTEGER) AS b FROM range(0, 7) x, range(0, 7) y)
SELECT a, b, round(coalesce(n, 0), 2) AS n, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 8) AS pct
FROM g FULL JOIN c USING (a, b)""")
def dense_grid_whole(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").withColumns({"a": F.col("p_size") % 7, "b": F.floor(F.col("p_retailprice") / 10) % 9})
    return rnd(agg.dense_grid(p, "a", range(7), "b", range(7), "p_retailprice"), n=2, pct=8)


@query("""SELECT p_brand, p_type AS top_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand
  ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY 1, 2) WHERE rn = 1""")
def mode_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return agg.mode_value(read(spark, sf, "part"), ["p_brand"], "p_type", "top_type")


@query("""SELECT o_custkey, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT ship_year) AS n_years,
  count(CASE WHEN l_tax > 0 THEN 1 END) AS n_taxed FROM receipts GROUP BY 1""")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return receipts(spark, sf).groupBy("o_custkey").agg(
        F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("ship_year").alias("n_years"),
        F.count(F.when(F.col("l_tax") > 0, 1)).alias("n_taxed"))


@query("""
WITH s AS (SELECT 'all' AS subset, l_extendedprice AS x FROM lineitem UNION ALL
  SELECT 'returned', l_extendedprice FROM lineitem WHERE l_returnflag = 'R' UNION ALL
  SELECT 'large', l_extendedprice FROM lineitem WHERE l_quantity >= 40)
SELECT subset, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, min(x) AS min, max(x) AS max,
  round(median(x), 4) AS median FROM s GROUP BY 1""")
def descriptives(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.describe_subsets(read(spark, sf, "lineitem"), "l_extendedprice", {
        "all": F.lit(True), "returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") >= 40})
    return rnd(out, mean=4, sd=4, median=4)


def _bal(v: str) -> str:
    return f"""SELECT '{v}' AS variable, avg({v}) FILTER (g) AS mi, avg({v}) FILTER (NOT g) AS mo, var_samp({v}) FILTER (g) AS vi,
      var_samp({v}) FILTER (NOT g) AS vo, count({v}) FILTER (g) AS ni, count({v}) FILTER (NOT g) AS no
      FROM (SELECT *, l_returnflag = 'R' AS g FROM lineitem)"""


@query(f"""SELECT variable, round(mi, 6) AS mean_in, round(mo, 6) AS mean_out, ni AS n_in, no AS n_out, round(mi - mo, 6) AS difference,
  round((mi - mo) / sqrt(vi / ni + vo / no), 6) AS t, CASE WHEN abs((mi - mo) / sqrt(vi / ni + vo / no)) > 2.576 THEN '***'
  WHEN abs((mi - mo) / sqrt(vi / ni + vo / no)) > 1.96 THEN '**' WHEN abs((mi - mo) / sqrt(vi / ni + vo / no)) > 1.645 THEN '*'
  ELSE '' END AS stars FROM ({_bal('l_quantity')} UNION ALL {_bal('l_extendedprice')} UNION ALL {_bal('l_discount')})""")
def balance_table(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.balance_table(read(spark, sf, "lineitem"), F.col("l_returnflag") == "R",
                            ["l_quantity", "l_extendedprice", "l_discount"])
    return rnd(out, mean_in=6, mean_out=6, difference=6, t=6)


@query("""
WITH a AS (SELECT open_year, sum(o_totalprice) t FROM openings GROUP BY 1),
b AS (SELECT ship_year AS open_year, sum(l_extendedprice) t FROM receipts GROUP BY 1)
SELECT coalesce(a.open_year, b.open_year) AS open_year, round(a.t, 2) AS left_total, round(b.t, 2) AS right_total,
  CAST(abs(coalesce(a.t, 0) - coalesce(b.t, 0)) > 1e-6 AS INTEGER) AS differs
FROM a FULL OUTER JOIN b ON a.open_year = b.open_year""")
def reconcile_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).withColumn("open_year", F.col("ship_year"))
    return rnd(agg.reconcile(openings(spark, sf), r, ["open_year"], "o_totalprice", "l_extendedprice"),
               left_total=2, right_total=2)


@query("""SELECT c_nationkey, round(avg(o_totalprice) FILTER (open_year BETWEEN 1995 AND 1997), 6) AS mean_pre,
  count(o_totalprice) FILTER (open_year BETWEEN 1995 AND 1997) AS n_pre,
  round(avg(o_totalprice) FILTER (open_year BETWEEN 1999 AND 2001), 6) AS mean_post,
  count(o_totalprice) FILTER (open_year BETWEEN 1999 AND 2001) AS n_post
FROM openings JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def period_means(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = openings(spark, sf).join(c, "o_custkey")
    out = agg.period_means(o, ["c_nationkey"], "open_year", "o_totalprice", {"pre": (1995, 1997), "post": (1999, 2001)})
    return rnd(out, mean_pre=6, mean_post=6)


@query("""
WITH lo AS (SELECT min(o_totalprice) AS m FROM orders)
SELECT CAST(floor((o_totalprice - m) / 25000) AS BIGINT) AS bin, count(*) AS n, round(sum(o_totalprice), 2) AS amount,
  round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders, lo GROUP BY 1""")
def histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(agg.histogram(read(spark, sf, "orders"), "o_totalprice", 25000.0), amount=2, share=8)


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)
SELECT l_returnflag, round(sum(greatest(least(l_extendedprice, hi), lo)), 2) AS clamped, count(*) AS n,
  count(CASE WHEN l_extendedprice > hi OR l_extendedprice < lo THEN 1 END) AS n_moved FROM lineitem, q GROUP BY 1""")
def winsorise(spark: SparkSession, sf: str) -> DataFrame:
    w = agg.winsorise(read(spark, sf, "lineitem"), "l_extendedprice", 0.05, 0.95, "clamped")
    moved = F.count(F.when(F.col("clamped") != F.col("l_extendedprice"), 1))
    return rnd(w.groupBy("l_returnflag").agg(F.sum("clamped").alias("clamped"), F.count(F.lit(1)).alias("n"),
                                             moved.alias("n_moved")), clamped=2)


@query("""SELECT p_brand, round(count(*) / (SELECT count(*) FROM part), 8) AS share, count(*) AS amount FROM part
  GROUP BY 1 ORDER BY amount DESC, p_brand LIMIT 10""")
def topk_categories(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(agg.top_k(read(spark, sf, "part"), "p_brand", 10), share=8)


@query("""
WITH l AS (SELECT p_brand, CAST(floor(year(l_shipdate) / 2) * 2 AS INTEGER) AS block FROM lineitem JOIN part ON l_partkey = p_partkey),
best AS (SELECT p_brand FROM l GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 6)
SELECT block, p_brand, count(*) AS n, CAST(row_number() OVER (PARTITION BY block ORDER BY count(*) DESC, p_brand) AS INTEGER) AS rank
FROM l WHERE p_brand IN (FROM best) GROUP BY 1, 2""")
def topk_per_block(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    l = read(spark, sf, "lineitem").select("l_partkey", (F.floor(F.year("l_shipdate") / 2) * 2).cast("int").alias("block"))
    return agg.top_k_within(l.join(p, "l_partkey"), "block", "p_brand", 6)


@query("""
WITH lagged AS (SELECT datediff('day', o_orderdate, l_shipdate) AS days, l_extendedprice AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT days, sum(w) AS w FROM lagged GROUP BY 1),
c AS (SELECT days, w, sum(w) OVER (ORDER BY days) AS cum, sum(w) OVER () AS tot FROM m)
SELECT CAST(days AS INTEGER) AS days, round(w, 2) AS amount, round(cum / tot, 8) AS share FROM c""")
def cumulative_share_lag(spark: SparkSession, sf: str) -> DataFrame:
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    d = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.datediff("l_shipdate", "o_orderdate").alias("days"), "l_extendedprice")
    curve, _ = agg.cumulative_share(d, [], "days", "l_extendedprice", 60.0)
    return rnd(curve, amount=2, share=8)


@query("""
WITH lagged AS (SELECT l_returnflag, datediff('day', o_orderdate, l_shipdate) AS days, l_quantity AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT l_returnflag, days, sum(w) AS w FROM lagged GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY days) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS tot FROM m)
SELECT l_returnflag, CAST(min(days) FILTER (cum >= tot * 0.5) AS INTEGER) AS at_50, CAST(min(days) FILTER (cum >= tot * 0.9) AS INTEGER) AS at_90
FROM c GROUP BY 1""")
def weighted_lag_points(spark: SparkSession, sf: str) -> DataFrame:
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    d = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        "l_returnflag", F.datediff("l_shipdate", "o_orderdate").alias("days"), "l_quantity")
    return agg.cumulative_share(d, ["l_returnflag"], "days", "l_quantity", 60.0)[1]


@query("""SELECT o_custkey, order_year, round(sum(l_extendedprice), 2) AS amount,
  round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY order_year), 10) AS share FROM receipts GROUP BY 1, 2""")
def share_within_group(spark: SparkSession, sf: str) -> DataFrame:
    s = receipts(spark, sf).groupBy("o_custkey", "order_year").agg(F.sum("l_extendedprice").alias("amount"))
    return rnd(agg.with_share(s, "amount", "share", within=["order_year"]), amount=2, share=10)


@query("""SELECT n_name, round(sum(o_totalprice) / any_value(pop), 6) AS per_head FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT c_nationkey AS k, count(*) AS pop FROM customer GROUP BY 1) ON k = n_nationkey GROUP BY 1""")
def per_capita(spark: SparkSession, sf: str) -> DataFrame:
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    people = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    spend = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.sum("o_totalprice").alias("spend"))
    out = agg.per_capita(spend, people, ["c_nationkey"], "spend", "people", "per_head")
    return out.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("per_head", 6).alias("per_head"))


@query("""
WITH words AS (SELECT o_custkey, list(DISTINCT p_type) AS types FROM receipts JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_custkey, CAST(len(types) AS BIGINT) AS n_listed, CAST(len(list_filter(types, lambda x: x IN ('PROMO', 'ECONOMY', 'SMALL', 'LARGE', 'MEDIUM'))) AS BIGINT) AS n_inside,
  len(list_filter(types, lambda x: x IN ('PROMO', 'ECONOMY', 'SMALL', 'LARGE', 'MEDIUM'))) = len(types) AS all_inside,
  len(list_filter(types, lambda x: x IN ('PROMO', 'ECONOMY', 'SMALL', 'LARGE', 'MEDIUM'))) > 0 AS any_inside,
  len(list_filter(types, lambda x: x IN ('PROMO', 'ECONOMY', 'SMALL', 'LARGE', 'MEDIUM'))) / len(types) >= 0.75 AS mostly_inside FROM words""")
def list_membership(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lists = agg.distinct_list(receipts(spark, sf).select("o_custkey", "l_partkey").join(p, "l_partkey"), ["o_custkey"],
                              "p_type", None, "types")
    allowed = p.where(F.col("p_type").isin("PROMO", "ECONOMY", "SMALL", "LARGE", "MEDIUM")).select("p_type")
    return agg.membership(lists, F.col("types"), allowed, "p_type", "o_custkey")
