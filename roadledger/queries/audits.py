"""Completeness audits, coverage, composition and expectation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.functions import numeric
from roadledger.operators import coverage as cov
from roadledger.queries.base import openings, query, read, receipts, rnd

DATES = ["order_date", "ship_date", "tax_date", "late_date"]


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with four dates, some missing by a rule on the line's own values."""
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_orderdate").alias("order_date"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("ship_date"),
        F.when(F.col("l_tax") > 0.02, F.date_add("o_orderdate", F.col("l_linenumber") * 30)).cast("timestamp").alias("tax_date"),
        F.when(F.col("l_quantity") > 25, F.date_add("l_shipdate", -200)).cast("timestamp").alias("late_date"),
        "l_extendedprice", "o_orderpriority", "l_linestatus")


_DATED = """(SELECT o_orderdate AS order_date, CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS ship_date,
  CASE WHEN l_tax > 0.02 THEN o_orderdate + INTERVAL 1 DAY * (l_linenumber * 30) END AS tax_date,
  CASE WHEN l_quantity > 25 THEN l_shipdate - INTERVAL 200 DAY END AS late_date, l_extendedprice, o_orderpriority, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(" UNION ALL ".join(f"""SELECT l_linestatus, '{c}' AS "column", count({c}) AS n, round(100.0 * count({c}) / count(*), 8) AS pct,
  round(100.0 * sum(CASE WHEN {c} IS NOT NULL THEN l_extendedprice END) / sum(l_extendedprice), 8) AS pct_weight
  FROM {_DATED} GROUP BY 1""" for c in DATES))
def completeness_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(cov.completeness(_dated(spark, sf), DATES, "l_extendedprice", by=["l_linestatus"]), pct=8, pct_weight=8)


@query(" UNION ALL ".join(f"""SELECT '{a}' AS "row", '{b}' AS col, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n,
  round(100.0 * count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) / count(*), 8) AS pct FROM {_DATED}"""
                          for a in DATES for b in DATES))
def copresence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(cov.copresence(_dated(spark, sf), DATES), pct=8)


@query(" UNION ALL ".join(f"""SELECT '{a}' AS "row", '{b}' AS col, {1 if j > i else -1} * count(CASE WHEN {b} > {a} THEN 1 END) AS n_later
  FROM {_DATED}""" for i, a in enumerate(DATES) for j, b in enumerate(DATES) if i != j))
def date_order_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return cov.order_matrix(_dated(spark, sf), DATES)


@query(f"""SELECT o_orderpriority, count(*) AS n_rows, {', '.join(f'count({c}) AS n_{c}' for c in DATES)},
  {', '.join(f'round(100.0 * count({c}) / count(*), 8) AS pct_{c}' for c in DATES)} FROM {_DATED} GROUP BY 1""")
def presence_by_type(spark: SparkSession, sf: str) -> DataFrame:
    out = cov.presence_by_category(_dated(spark, sf), "o_orderpriority", DATES)
    return rnd(out, **{f"pct_{c}": 8 for c in DATES})


_COV = """count(*) AS n, count(CASE WHEN flag THEN 1 END) AS n_flag, round(sum(amount), 2) AS spend,
  round(coalesce(sum(CASE WHEN flag THEN amount END), 0), 2) AS spend_flag, round(count(CASE WHEN flag THEN 1 END) / count(*), 8) AS share_n,
  round(coalesce(sum(CASE WHEN flag THEN amount END), 0) / sum(amount), 8) AS share_spend"""


@query(f"""SELECT c_nationkey, CAST(floor(open_year / 5) * 5 AS INTEGER) AS block, {_COV} FROM (SELECT c_nationkey, open_year,
  o_totalprice AS amount, o_orderpriority = '1-URGENT' AS flag FROM openings JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2""")
def coverage_by_key(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = openings(spark, sf).join(c, "o_custkey").withColumn("block", (F.floor(F.col("open_year") / 5) * 5).cast("int"))
    out = cov.coverage(o, ["c_nationkey", "block"], F.col("o_orderpriority") == "1-URGENT", "o_totalprice")
    return rnd(out, spend=2, spend_flag=2, share_n=8, share_spend=8)


TYPES = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "taxed": "l_tax > 0.04"}
_ALONE = "(CAST(l_returnflag = 'R' AS INTEGER) + CAST(l_linestatus = 'O' AS INTEGER) + CAST(l_tax > 0.04 AS INTEGER)) = 1"
_BASE = f"SELECT *, l_quantity > 20 AS flag, l_extendedprice AS amount, {_ALONE} AS alone FROM receipts"


def _typed(spark: SparkSession, sf: str) -> tuple[DataFrame, dict, object]:
    types = {n: F.expr(c) for n, c in TYPES.items()}
    alone = sum((c.cast("int") for c in types.values()), F.lit(0)) == 1
    return receipts(spark, sf), types, alone


@query(f"""SELECT order_year, type, mode, {_COV} FROM (""" + " UNION ALL ".join(
    f"SELECT order_year, '{n}' AS type, '{m}' AS mode, flag, amount FROM ({_BASE}) WHERE {c}{x}"
    for n, c in TYPES.items() for m, x in (("has", ""), ("only", " AND alone"))) + ") GROUP BY 1, 2, 3")
def coverage_by_type(spark: SparkSession, sf: str) -> DataFrame:
    r, types, alone = _typed(spark, sf)
    out = cov.coverage_by_type(r, "order_year", types, alone, F.col("l_quantity") > 20, "l_extendedprice")
    return rnd(out, spend=2, spend_flag=2, share_n=8, share_spend=8)


@query("""SELECT type, "group", n, round(p, 8) AS share, round(sqrt(p * (1 - p) / n), 8) AS se,
  round(greatest(p - 1.96 * sqrt(p * (1 - p) / n), 0), 8) AS ci_low, round(least(p + 1.96 * sqrt(p * (1 - p) / n), 1), 8) AS ci_high FROM (
  SELECT type, "group", count(*) AS n, avg(CAST(flag AS INTEGER)) AS p FROM (""" + " UNION ALL ".join(
    f"""SELECT '{n}' AS type, '{g}' AS "group", flag FROM ({_BASE}) WHERE {w}""" for n, c in TYPES.items()
    for g, w in (("none", f"NOT ({c})"), ("any", c), ("standalone", f"{c} AND alone"))) + ") GROUP BY 1, 2)")
def share_ci_by_type(spark: SparkSession, sf: str) -> DataFrame:
    r, types, alone = _typed(spark, sf)
    return rnd(cov.share_with_ci(r, types, F.col("l_quantity") > 20, alone), share=8, se=8, ci_low=8, ci_high=8)


@query("""
WITH s AS (SELECT l_linestatus, sum(l_extendedprice) AS t, sum(l_extendedprice * l_discount) AS discount,
  sum(l_extendedprice * l_tax) AS tax FROM lineitem GROUP BY 1)
SELECT l_linestatus, part, round(amount, 2) AS amount, round(100 * amount / t, 8) AS pct FROM (
  SELECT l_linestatus, t, 'discount' AS part, discount AS amount FROM s UNION ALL SELECT l_linestatus, t, 'tax', tax FROM s
  UNION ALL SELECT l_linestatus, t, 'other', t - discount - tax FROM s)""")
def cost_composition(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem").withColumns({"discount": F.col("l_extendedprice") * F.col("l_discount"),
                                                 "tax": F.col("l_extendedprice") * F.col("l_tax")})
    return rnd(cov.composition(l, "l_linestatus", ["discount", "tax"], "l_extendedprice"), amount=2, pct=8)


@query("""
WITH g AS (SELECT c_nationkey, count(*) AS n, count(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END) AS n_sub, sum(c_acctbal) AS spend,
  coalesce(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 0) AS spend_sub FROM customer GROUP BY 1)
SELECT c_nationkey, n, n_sub, round(spend, 2) AS spend, round(spend_sub, 2) AS spend_sub, round(n / sum(n) OVER (), 8) AS share_n,
  round(n_sub / sum(n_sub) OVER (), 8) AS share_n_sub, round(spend / sum(spend) OVER (), 8) AS share_spend,
  round(spend_sub / sum(spend_sub) OVER (), 8) AS share_spend_sub,
  round((n_sub / sum(n_sub) OVER ()) / (n / sum(n) OVER ()), 8) AS over_representation FROM g""")
def representativeness(spark: SparkSession, sf: str) -> DataFrame:
    out = cov.representativeness(read(spark, sf, "customer"), "c_nationkey", F.col("c_mktsegment") == "MACHINERY", "c_acctbal")
    return rnd(out, spend=2, spend_sub=2, share_n=8, share_n_sub=8, share_spend=8, share_spend_sub=8, over_representation=8)


@query("""
WITH f AS (SELECT DISTINCT p_partkey, p_retailprice > 1000 AS s, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS code FROM part)
SELECT code, count(*) AS n, CAST(sum(CAST(s AS INTEGER)) AS BIGINT) AS n_sub, round(count(*) / (SELECT count(*) FROM part), 8) AS share,
  round(sum(CAST(s AS INTEGER)) / (SELECT count(*) FROM part WHERE p_retailprice > 1000), 8) AS share_sub FROM f GROUP BY 1""")
def exploded_representativeness(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    codes = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    return rnd(cov.code_representativeness(p, "p_partkey", codes, F.col("p_retailprice") > 1000), share=8, share_sub=8)


@query("""SELECT p_brand, count(*) AS n, round(avg(CAST(p_size > 25 AS INTEGER)), 8) AS coverage,
  round(avg(len(string_split(p_name, ' '))), 8) AS mean_codes, round(avg(p_retailprice), 6) AS mean_amount FROM part GROUP BY 1""")
def group_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = cov.group_profile(read(spark, sf, "part"), "p_brand", F.col("p_size") > 25, F.split("p_name", " "), "p_retailprice")
    return rnd(out, coverage=8, mean_codes=8, mean_amount=6)


_SUB = {"all": "TRUE", "returned": "l_returnflag = 'R'", "returned_open": "l_returnflag = 'R' AND l_linestatus = 'O'"}


@query("SELECT ship_year, " + ", ".join(f"""count(CASE WHEN {c} THEN 1 END) AS n_{n},
  round(coalesce(sum(CASE WHEN {c} THEN l_extendedprice END), 0), 2) AS sum_{n}, round(avg(CASE WHEN {c} THEN l_extendedprice END), 6) AS mean_{n}"""
                                        for n, c in _SUB.items()) + " FROM receipts GROUP BY 1")
def subpopulations(spark: SparkSession, sf: str) -> DataFrame:
    out = cov.subpopulations(receipts(spark, sf), "ship_year", {n: F.expr(c) for n, c in _SUB.items()}, "l_extendedprice")
    return rnd(out, **{f"sum_{n}": 2 for n in _SUB}, **{f"mean_{n}": 6 for n in _SUB})


_RULES = {"discount range": "l_discount BETWEEN 0 AND 0.08", "large": "l_quantity >= 10 AND l_extendedprice > 20000",
          "ship year": "year(l_shipdate) = 1998 OR l_tax > 0", "flag filled": "nullif(l_returnflag, 'A') IN ('N', 'R')"}


@query(" UNION ALL ".join(f"""SELECT '{n}' AS rule, count(CASE WHEN NOT coalesce({c}, FALSE) THEN 1 END) AS n_broken, count(*) AS n_rows
  FROM lineitem""" for n, c in _RULES.items()))
def expectation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cov.expectations(read(spark, sf, "lineitem"), {n: F.expr(c) for n, c in _RULES.items()})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE NOT coalesce(nullif(l_quantity, 7) < 45, FALSE)""")
def expectation_violations(spark: SparkSession, sf: str) -> DataFrame:
    return cov.violations(read(spark, sf, "lineitem"), F.nullif(F.col("l_quantity"), F.lit(7.0)) < 45).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""SELECT l_linestatus, count(CASE WHEN abs(l_extendedprice * 0.25 + l_extendedprice * 0.75 + l_tax * 20 - l_extendedprice) < 1 THEN 1 END) AS n_equal,
  count(*) AS n FROM lineitem GROUP BY 1""")
def parts_match_total(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_extendedprice")
    ok = numeric.parts_match_total([p * 0.25, p * 0.75, F.col("l_tax") * 20], p)
    return read(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count(F.when(ok, 1)).alias("n_equal"),
                                                                   F.count(F.lit(1)).alias("n"))


@query("""SELECT ship_year, round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END), 2) AS s1,
  round(sum(CASE WHEN l_returnflag IN ('A', 'N') THEN l_extendedprice ELSE 0 END), 2) AS s2,
  round(sum(CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN l_extendedprice ELSE 0 END), 2) AS s3 FROM receipts GROUP BY 1""")
def cumulative_layers(spark: SparkSession, sf: str) -> DataFrame:
    wide = receipts(spark, sf).groupBy("ship_year").agg(*[
        F.sum(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice"))).alias(f) for f in "ANR"])
    layers = numeric.cumulative_layers([("s1", F.col("A")), ("s2", F.col("N")), ("s3", F.col("R"))])
    return rnd(wide.select("ship_year", *layers), s1=2, s2=2, s3=2)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(CASE WHEN l_tax > 0 THEN l_tax END, 0) + coalesce(l_discount, 0)
  + coalesce(CASE WHEN l_returnflag = 'R' THEN 1 END, 0), 6) AS total FROM lineitem""")
def row_sums(spark: SparkSession, sf: str) -> DataFrame:
    total = numeric.row_sum([F.when(F.col("l_tax") > 0, F.col("l_tax")), F.col("l_discount"),
                             F.when(F.col("l_returnflag") == "R", F.lit(1.0))])
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(total, 6).alias("total"))
