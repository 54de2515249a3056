"""Reshaping, panel completion, set operations and column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.functions import classify, dates, numeric, text
from roadledger.operators import reshape
from roadledger.queries.base import openings, query, read, receipts, rnd


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, measure, amount FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS l_quantity, CASE WHEN l_discount > 0 THEN l_discount END AS l_discount,
  l_tax FROM lineitem) UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))""")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    return reshape.melt(l, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_discount", "l_tax"],
                        "measure", "amount", drop_null=True)


@query("""SELECT ship_year, round(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 0), 2) AS A,
  round(coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END), 0), 2) AS N,
  round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 0), 2) AS R FROM receipts GROUP BY 1""")
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    out = reshape.spread(receipts(spark, sf), ["ship_year"], "l_returnflag", ["A", "N", "R"], "l_extendedprice", 0.0)
    return rnd(out, A=2, N=2, R=2)


@query("""
WITH s AS (SELECT o_custkey, open_year, sum(o_totalprice) AS amount FROM openings GROUP BY 1, 2),
b AS (SELECT min(open_year) AS lo, max(open_year) AS hi FROM s)
SELECT o_custkey, CAST(y AS INTEGER) AS open_year, round(coalesce(amount, 0), 2) AS amount FROM (
  SELECT DISTINCT o_custkey, unnest(range(lo, hi + 1)) AS y FROM s, b) LEFT JOIN s USING (o_custkey) WHERE s.open_year = y
UNION ALL SELECT o_custkey, CAST(y AS INTEGER), 0 FROM (SELECT DISTINCT o_custkey, unnest(range(lo, hi + 1)) AS y FROM s, b) g
  WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = g.o_custkey AND s.open_year = y)""")
def rectangular_panel(spark: SparkSession, sf: str) -> DataFrame:
    s = openings(spark, sf).groupBy("o_custkey", "open_year").agg(F.sum("o_totalprice").alias("amount"))
    return rnd(reshape.rectangle(s, ["o_custkey"], "open_year", ["amount"]), amount=2)


@query("""
WITH s AS (SELECT o_custkey, o_orderpriority, open_year, sum(o_totalprice) AS amount FROM openings GROUP BY 1, 2, 3)
SELECT o_custkey, o_orderpriority, open_year, round(coalesce(amount, 0), 2) AS amount FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM s) a
  CROSS JOIN (SELECT DISTINCT open_year FROM s) b LEFT JOIN s USING (o_custkey, o_orderpriority, open_year)""")
def fill_in_panel(spark: SparkSession, sf: str) -> DataFrame:
    unit = ["o_custkey", "o_orderpriority"]
    s = openings(spark, sf).groupBy(*unit, "open_year").agg(F.sum("o_totalprice").alias("amount"))
    return rnd(reshape.fill_in(s, unit, "open_year", ["amount"]), amount=2)


@query("""
WITH s AS (SELECT o_custkey, open_year, count(*) AS n FROM openings GROUP BY 1, 2),
g AS (SELECT DISTINCT c_custkey AS o_custkey, y FROM customer, (SELECT DISTINCT open_year AS y FROM s WHERE open_year BETWEEN 1997 AND 1999))
SELECT o_custkey, open_year, n FROM s UNION ALL
SELECT o_custkey, y, NULL FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = g.o_custkey AND s.open_year = g.y)""")
def explicit_gap_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = openings(spark, sf).groupBy("o_custkey", "open_year").agg(F.count(F.lit(1)).alias("n"))
    years = F.explode(F.sequence(F.lit(1997), F.lit(1999)))
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), years.alias("open_year"))
    return reshape.explicit_gaps(s, ["o_custkey"], "open_year", rows)


@query("""SELECT open_year AS yr, count(*) AS n, round(sum(o_totalprice), 2) AS amount, 'orders' AS src FROM openings WHERE open_year <= 1997 GROUP BY 1
  UNION ALL SELECT ship_year, count(*), round(sum(l_extendedprice), 2), 'lines' FROM receipts WHERE ship_year >= 1998 GROUP BY 1""")
def append_periods(spark: SparkSession, sf: str) -> DataFrame:
    a = openings(spark, sf).groupBy(F.col("open_year").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("amount")).withColumn("src", F.lit("orders"))
    b = receipts(spark, sf).groupBy(F.col("ship_year").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("amount")).withColumn("src", F.lit("lines"))
    return rnd(reshape.append_periods([a, b], "yr", [(0, 1997), (1998, 9999)]), amount=2)


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT 2 * o_custkey AS k FROM orders),
s AS (SELECT k FROM a INTERSECT SELECT k FROM b)
SELECT 'shared' AS side, k FROM s UNION ALL SELECT 'left', k FROM a WHERE k NOT IN (FROM s) UNION ALL SELECT 'right', k FROM b WHERE k NOT IN (FROM s)""")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    a = o.select(F.col("o_custkey").alias("k")).distinct()
    b = o.select((2 * F.col("o_custkey")).alias("k")).distinct()
    left, right = reshape.drop_shared(a, b, "k")
    tagged = [(reshape.both_sides(a, b, "k"), "shared"), (left, "left"), (right, "right")]
    frames = [df.select(F.lit(t).alias("side"), "k") for df, t in tagged]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""SELECT * FROM (
  SELECT o_custkey, o_orderpriority AS sign_type, o_orderkey % 5 AS sign_no, o_orderpriority || '|' || CAST(o_orderkey % 5 AS VARCHAR) AS sign FROM orders
  UNION ALL SELECT o_custkey, o_orderstatus, o_orderkey % 3, o_orderstatus || '|' || CAST(o_orderkey % 3 AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P')""")
def melt_numbered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumns({
        "n1": F.col("o_orderkey") % 5, "t2": F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")),
        "n2": F.col("o_orderkey") % 3, "t3": F.lit(None).cast("string"), "n3": F.col("o_orderkey")})
    return reshape.melt_pairs(o, ["o_custkey"], [("o_orderpriority", "n1"), ("t2", "n2"), ("t3", "n3")], "sign_type", "sign_no", "sign")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'a' AS endpoint, l_quantity AS pos, l_returnflag AS name FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'b', l_extendedprice, l_linestatus FROM lineitem""")
def stack_endpoint_groups(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.stack_groups(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], {
        "a": {"pos": "l_quantity", "name": "l_returnflag"}, "b": {"pos": "l_extendedprice", "name": "l_linestatus"}}, "endpoint")


_WORDS = ["red", "small", "ring", "widget"]


@query("SELECT p_partkey, " + ", ".join(f"CAST(list_contains(string_split(p_name, ' '), '{w}') AS INTEGER) AS has_{w}" for w in _WORDS) + " FROM part")
def code_indicators(spark: SparkSession, sf: str) -> DataFrame:
    out = reshape.indicators(read(spark, sf, "part"), F.split("p_name", " "), _WORDS)
    return out.select("p_partkey", *[f"has_{w}" for w in _WORDS])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"round({c} / 1000.0, 8) AS {c}_k" for c in ("l_quantity", "l_extendedprice", "l_tax")) + " FROM lineitem")
def bulk_expression(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    out = reshape.bulk(read(spark, sf, "lineitem"), cols, lambda c: F.round(c / 1000.0, 8), "_k")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"{c}_k" for c in cols])


@query("""SELECT o_orderkey, CAST(floor(ln(o_totalprice) / 0.1) AS BIGINT) AS log_bin, floor(o_totalprice / 2500) * 2500 AS bin,
  CASE WHEN y < 1997 THEN 0 ELSE CAST(floor((y - 1997) / 2) * 2 + 1997 AS INTEGER) END AS block,
  CASE WHEN y < 1997 THEN '<1997' ELSE CAST(CAST(floor((y - 1997) / 2) * 2 + 1997 AS INTEGER) AS VARCHAR) || '-' ||
    CAST(CAST(floor((y - 1997) / 2) * 2 + 1998 AS INTEGER) AS VARCHAR) END AS label,
  CAST(CASE WHEN o_totalprice < 1000 THEN NULL WHEN o_totalprice < 50000 THEN 1000.0 WHEN o_totalprice < 200000 THEN 50000.0
    WHEN o_totalprice < 400000 THEN 200000.0 END AS DOUBLE) AS cut, CAST(floor(y / 10) * 10 AS INTEGER) AS decade
FROM (SELECT *, year(o_orderdate) AS y FROM orders)""")
def value_bins(spark: SparkSession, sf: str) -> DataFrame:
    o = openings(spark, sf)
    block = numeric.block_start(F.col("open_year"), 2, 1997)
    price = F.col("o_totalprice")
    return o.select("o_orderkey", numeric.log_bin(price).alias("log_bin"), numeric.bin_floor(price, 2500.0).alias("bin"),
                    block.alias("block"), numeric.block_label(block, 2, 1997).alias("label"),
                    numeric.cut_bin(price, [1000.0, 50000.0, 200000.0, 400000.0]).alias("cut"),
                    dates.decade(F.col("open_year")).alias("decade"))


@query("""
WITH l AS (SELECT *, strftime(l_shipdate, '%m/%d/%Y') AS s, CAST(year(l_shipdate) % 100 * 100 + month(l_shipdate) AS INTEGER) AS yymm,
  CAST(month(l_shipdate) * 100 + year(l_shipdate) % 100 AS INTEGER) AS mmyy FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS parsed_year, CAST(month(l_shipdate) AS INTEGER) AS parsed_month,
  CAST(year(l_shipdate) AS INTEGER) AS anchored_year, CAST(CASE WHEN l_linestatus = 'F' THEN NULL ELSE year(l_shipdate) END AS INTEGER) AS strict_year,
  CAST(floor(yymm / 100) + 1900 AS INTEGER) AS packed_year, CAST(yymm % 100 AS INTEGER) AS packed_month, yymm AS swapped FROM l""")
def packed_dates(spark: SparkSession, sf: str) -> DataFrame:
    s = F.date_format("l_shipdate", "MM/dd/yyyy")
    yymm = (F.year("l_shipdate") % 100 * 100 + F.month("l_shipdate")).cast("int")
    mmyy = (F.month("l_shipdate") * 100 + F.year("l_shipdate") % 100).cast("int")
    noisy = F.concat(F.lit("closed "), s, F.when(F.col("l_linestatus") == "F", F.lit(" 00:00")).otherwise(F.lit("")))
    parsed = dates.parse_mdy(noisy)
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.year(parsed).alias("parsed_year"),
        F.month(parsed).alias("parsed_month"), dates.year_in_text(noisy).alias("anchored_year"),
        dates.year_in_text(noisy, anchored=True).alias("strict_year"), dates.yymm_year(yymm).alias("packed_year"),
        dates.yymm_month(yymm).alias("packed_month"), dates.mmyy_to_yymm(mmyy).alias("swapped"))


@query("""
WITH l AS (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS a, CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS INTEGER) + 1950 END AS b,
  CASE WHEN l_discount > 0.03 THEN CAST(l_quantity AS INTEGER) + 1960 END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN b IS NULL THEN c WHEN c IS NULL THEN b ELSE least(b, c) END,
  CASE WHEN l_linestatus = 'O' THEN a END, l_linenumber + 1900) AS opened FROM l""")
def priority_opening_date(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    b = F.when(F.col("l_tax") > 0.02, q + 1950)
    c = F.when(F.col("l_discount") > 0.03, q + 1960)
    a = F.when(F.col("l_linestatus") == "O", F.year("l_shipdate"))
    none = F.lit(None).cast("int")
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        dates.opening_date([b, c], [none, a], [], F.col("l_linenumber") + 1900).alias("opened"))


@query("""
WITH l AS (SELECT *, CAST(l_partkey % 73 AS INTEGER) AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, code IN (1, 7, 8, 50) AS new_construction, code IN (2, 3, 4, 9, 10, 11, 51) AS reconstruction,
  code IN (6, 12, 13, 14, 52) AS rehabilitation, code IN (5, 47, 48, 53, 54, 59, 60) AS maintenance,
  code IN (1, 7, 8, 50, 2, 3, 4, 9, 10, 11, 51, 6, 12, 13, 14, 52) AS is_construction,
  CASE WHEN code IN (1, 7, 8, 50) THEN 1 WHEN code IN (2, 3, 4, 9, 10, 11, 51) THEN 2 WHEN code IN (6, 12, 13, 14, 52) THEN 3
    WHEN code IN (5, 47, 48, 53, 54, 59, 60) THEN 4 END AS work_type, code IN (1, 2, 3, 4, 5, 6, 7, 60) AS road,
  code IN (8, 9, 10, 11, 12, 13, 14, 47, 48, 59) AS bridge, code IN (50, 51, 52, 53, 54) AS tunnel,
  coalesce(CASE WHEN l_suppkey % 100 IN (9, 23, 25, 33, 34, 36, 42, 44, 50) THEN 'Northeast'
    WHEN l_suppkey % 100 IN (17, 18, 19, 20, 26, 27, 29, 31, 38, 39, 46, 55) THEN 'Midwest'
    WHEN l_suppkey % 100 IN (1, 5, 10, 11, 12, 13, 21, 22, 24, 28, 37, 40, 45, 47, 48, 51, 54) THEN 'South'
    WHEN l_suppkey % 100 IN (2, 4, 6, 8, 15, 16, 30, 32, 35, 41, 49, 53, 56) THEN 'West' END, '') AS region FROM l""")
def code_classes(spark: SparkSession, sf: str) -> DataFrame:
    from roadledger import dims
    code = (F.col("l_partkey") % 73).cast("int")
    l = read(spark, sf, "lineitem").withColumn("recipient", (F.col("l_suppkey") % 100).cast("int"))
    l = l.withColumns(classify.work_flags(code) | {"work_type": classify.work_type(code)} | classify.structure_flags(code))
    l = dims.decode(l, "recipient", dims.code_table(spark, dims.region_pairs(), "c", "l"), "region")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *classify.work_flags(code), "work_type",
                    *classify.structure_flags(code), F.coalesce("region", F.lit("")).alias("region"))


@query("""SELECT o_orderkey, lpad(CAST(o_custkey % 57 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS county_key,
  (o_custkey % 57) * 1000 + o_orderkey % 1000 AS county_no, CASE WHEN o_orderkey % 1000 = 999 THEN 'statewide' WHEN o_orderkey % 1000 = 0 THEN 'unknown'
  WHEN o_orderstatus = 'F' THEN 'capital' ELSE 'other' END AS status, CASE WHEN o_custkey % 57 = 75 THEN 69 ELSE o_custkey % 57 END AS state,
  CAST(CASE WHEN substr(o_orderpriority, 3, 1) = 'H' THEN 2 WHEN substr(o_orderpriority, 1, 1) = '6' THEN 0 ELSE NULL END AS INTEGER) AS source,
  regexp_replace(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), '^0+', '') AS bare FROM orders""")
def key_columns(spark: SparkSession, sf: str) -> DataFrame:
    from roadledger import dims
    o = read(spark, sf, "orders")
    st, co = F.col("o_custkey") % 57, F.col("o_orderkey") % 1000
    return o.select("o_orderkey", text.padded_key([(st, 2), (co, 3)]).alias("county_key"),
                    text.numeric_key([(st, 2), (co, 3)]).alias("county_no"),
                    classify.county_status(co, F.col("o_orderstatus") == "F").alias("status"),
                    dims.recode(st, dims.STATE_RECODES).alias("state"),
                    classify.funding_source(F.substring("o_orderpriority", 2, 9)).alias("source"),
                    text.strip_zeros(F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("bare"))


@query("""
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'I' ELSE '' END || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '(7)' AS fpn FROM orders),
h AS (SELECT *, substr(trim(fpn), 1, 3) AS head FROM n)
SELECT o_orderkey, TRY_CAST(nullif(regexp_replace(head, '[A-Za-z]', '', 'g'), '') AS INTEGER) AS stripped,
  TRY_CAST(nullif(regexp_replace(head, '[^0-9]', '', 'g'), '') AS INTEGER) AS digits,
  CASE WHEN NOT regexp_matches(head, '[A-Za-z]') THEN TRY_CAST(nullif(trim(head), '') AS INTEGER) END AS strict,
  coalesce(nullif(TRY_CAST(substr(regexp_extract(fpn, '^[A-Za-z]*([0-9]{2,4})', 1), 1, 3) AS INTEGER), 0),
    nullif(TRY_CAST(substr(regexp_extract(fpn, '^[A-Za-z]*([0-9]{2,4})', 1), 1, 2) AS INTEGER), 0)) AS by_width FROM h""")
def project_number_route(spark: SparkSession, sf: str) -> DataFrame:
    fpn = F.concat(F.when(F.col("o_orderstatus") == "F", "I").otherwise(""),
                   F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("(7)"))
    return read(spark, sf, "orders").select(
        "o_orderkey", text.leading_route(fpn).alias("stripped"), text.leading_route(fpn, "digits").alias("digits"),
        text.leading_route(fpn, "strict").alias("strict"), text.leading_route_by_width(fpn).alias("by_width"))


@query("""
WITH s AS (SELECT o_orderkey, CAST([5, 18, 20, 27, 39, 48][1 + o_custkey % 6] AS INTEGER) AS st,
  ['20', '465', '435', '494', '271', '44'][1 + o_custkey % 6] AS rt, floor(o_totalprice / 20) AS mp FROM orders),
a AS (SELECT *, CASE WHEN st = 18 AND rt = '465' AND mp > 503 THEN mp - 10139 ELSE mp END AS m1 FROM s)
SELECT o_orderkey, st, rt, CASE WHEN st = 18 AND rt = '465' THEN CASE WHEN m1 >= 14482 THEN m1 - 557 ELSE m1 END
  WHEN st = 20 AND rt = '435' AND mp >= 7580 THEN mp - 5546 WHEN st = 27 AND rt = '494' AND mp > 2800 THEN mp - 3016
  WHEN st = 39 AND rt = '271' AND mp > 2070 THEN mp + 584 WHEN st = 48 AND rt = '44' THEN mp - 20000 ELSE mp END AS mp FROM a""")
def milepost_rules(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_custkey") % 6 + 1).cast("int"))
    s = read(spark, sf, "orders").select(
        "o_orderkey", pick([5, 18, 20, 27, 39, 48]).alias("st"), pick(["20", "465", "435", "494", "271", "44"]).alias("rt"),
        F.floor(F.col("o_totalprice") / 20).cast("double").alias("mp"), F.col("o_orderstatus").alias("grp"))
    return classify.shift_mileposts(s, "st", "rt", "mp", "grp").drop("grp")
