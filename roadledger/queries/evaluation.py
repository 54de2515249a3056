"""Sampling, splits and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.functions import scores as sc
from roadledger.operators import sampling as sm
from roadledger.operators import scoring as sg
from roadledger.queries.base import query, read, rnd

_FRAC = "('0x' || substr(md5({}), 1, 7))::BIGINT / pow(16, 7)"


@query("""SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '_s42'), o_orderkey LIMIT 500""")
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sm.sample_n(read(spark, sf, "orders"), "o_orderkey", 500, "s42").select("o_orderkey", "o_custkey")


_ALLOC = """s AS (SELECT c_mktsegment, c_nationkey, count(*) AS population, {n} * count(*) / (SELECT count(*) FROM customer) AS raw FROM customer GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY floor(raw) - raw, c_mktsegment, c_nationkey) AS place FROM s),
a AS (SELECT c_mktsegment, c_nationkey, population, CAST(floor(raw) AS BIGINT) + CASE WHEN place <= {n} - (SELECT sum(floor(raw)) FROM s) THEN 1 ELSE 0 END AS allocated FROM r)""".replace("{n}", "333")
_PICK = f"""{_ALLOC}, p AS (SELECT c.*, a.allocated, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR) || '_s42'), c_custkey) AS i
FROM customer c JOIN a USING (c_mktsegment, c_nationkey))"""
_STRATA = ["c_mktsegment", "c_nationkey"]


@query(f"WITH {_PICK} SELECT c_custkey, c_mktsegment, c_nationkey FROM p WHERE i <= allocated")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sm.stratified_sample(read(spark, sf, "customer"), "c_custkey", _STRATA, 333, "s42").select("c_custkey", *_STRATA)


@query(f"""WITH {_PICK} SELECT a.*, coalesce(n, 0) AS sampled FROM a LEFT JOIN (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM p WHERE i <= allocated GROUP BY 1, 2) USING (c_mktsegment, c_nationkey)""")
def sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return sm.sample_summary(c, sm.stratified_sample(c, "c_custkey", _STRATA, 333, "s42"), _STRATA, 333)


@query(f"""SELECT doc_id, lang || '-' || source AS cluster_key, CASE WHEN {_FRAC.format("lang || '-' || source || '_docs'")} < 0.4 THEN 'val' ELSE 'test' END AS split FROM documents""")
def cluster_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("cluster_key"))
    return sm.cluster_split(d, "cluster_key", "docs", 0.4)


@query(f"""
WITH s AS (SELECT source, arg_min(lang || '|' || CAST(n_chars > 2000 AS VARCHAR), doc_id) AS st FROM documents GROUP BY 1),
l AS (SELECT doc_id, source, CASE WHEN {_FRAC.format("source || '_docs_' || st")} < 0.5 THEN 'val' ELSE 'test' END AS split FROM documents JOIN s USING (source) WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT * FROM l UNION ALL SELECT doc_id, NULL, 'train' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)""")
def stratified_cluster_split(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "source", "lang", (F.col("n_chars") > 2000).alias("long"))
    split = sm.cluster_split(d, "source", "docs", 0.5, ["lang", "long"], ["doc_id"])
    labelled = split.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source", "split")
    return sm.add_train(labelled, d, "doc_id")


@query("""
WITH f AS (SELECT o_custkey AS id, unnest(list_distinct([o_orderkey % 211, o_custkey % 97])) AS k FROM orders), v AS (SELECT DISTINCT id FROM f WHERE k IN (SELECT p_partkey FROM part WHERE p_size < 3)),
t AS (SELECT DISTINCT id FROM f WHERE k IN (SELECT p_partkey FROM part WHERE p_size > 48))
SELECT id, 'val' AS split FROM v WHERE id NOT IN (FROM t) UNION ALL SELECT id, 'test' FROM t WHERE id NOT IN (FROM v)""")
def list_overlap_removal(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 211).alias("a"), (F.col("o_custkey") % 97).alias("b"))
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return sm.split_without_overlap(o, "id", F.array("a", "b"), p.where("p_size < 3"), p.where("p_size > 48"), "k")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted and true intervals of each line item, from its own values."""
    l = read(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("p1"),
                    (F.col("l_quantity") + F.col("l_linenumber") - 1).alias("p2"), (F.col("l_suppkey") % 50).cast("double").alias("t1"),
                    (F.col("l_suppkey") % 50 + F.col("l_partkey") % 9).cast("double").alias("t2"), (F.col("l_tax") * 100).alias("w"))


_PAIRS = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity AS p1, l_quantity + l_linenumber - 1 AS p2, CAST(l_suppkey % 50 AS DOUBLE) AS t1,
  CAST(l_suppkey % 50 + l_partkey % 9 AS DOUBLE) AS t2, l_tax * 100 AS w FROM lineitem)"""
_IOU = """CASE WHEN p1 = p2 AND t1 = t2 THEN CASE WHEN p1 = t1 THEN 1.0 ELSE 0.0 END WHEN greatest(p2, t2) = least(p1, t1) THEN 0.0
  ELSE greatest(0, least(p2, t2) - greatest(p1, t1)) / (greatest(p2, t2) - least(p1, t1)) END"""
_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""SELECT {_ID}, round(CAST({_IOU} AS DOUBLE), 10) AS iou, round(least(abs(p1 - t1) + abs(p2 - t2), abs(p1 - t2) + abs(p2 - t1)), 10) AS along, (p2 - p1) - (t2 - t1) AS len_signed, abs((p2 - p1) - (t2 - t1)) AS len_abs,
  round(CASE WHEN t2 <> t1 THEN (p2 - p1) / (t2 - t1) END, 10) AS len_ratio, round(least(sqrt(pow(p1 - t1, 2) + pow(w - 1, 2)) + sqrt(pow(p2 - t2, 2) + pow(w - 2, 2)), sqrt(pow(p1 - t2, 2) + pow(w - 2, 2)) + sqrt(pow(p2 - t1, 2) + pow(w - 1, 2))) / 1609.344, 10) AS crow,
  round(CASE WHEN abs(p1 - t1) = 0 OR w = 0 THEN 0.0 ELSE pow(abs(p1 - t1), 0.7) * pow(w, 0.3) END, 8) AS combined FROM {_PAIRS}""")
def interval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p1, p2, t1, t2, w = (F.col(c) for c in ("p1", "p2", "t1", "t2", "w"))
    one, two = F.lit(1.0), F.lit(2.0)
    errors = sc.length_errors(p2 - p1, t2 - t1)
    out = pairs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sc.interval_iou((p1, p2), (t1, t2)).alias("iou"), sc.along_route_error((p1, p2), (t1, t2)).alias("along"),
        *[c.alias(n) for n, c in errors.items()], sc.endpoint_error((p1, w, p2, w), (t1, one, t2, two)).alias("crow"),
        sc.combined_penalty(F.abs(p1 - t1), w, 0.7).alias("combined"))
    return rnd(out, iou=10, along=10, len_ratio=10, crow=10, combined=8)


@query(f"""
WITH m AS (SELECT l_returnflag, l_linestatus, CAST({_IOU} AS DOUBLE) AS iou, abs((p2 - p1) - (t2 - t1)) AS len_abs, CASE WHEN t2 <> t1 THEN (p2 - p1) / (t2 - t1) END AS len_ratio FROM {_PAIRS}),
v AS (SELECT 'iou' AS metric, iou AS value, l_returnflag, l_linestatus FROM m UNION ALL SELECT 'len_abs', len_abs, l_returnflag, l_linestatus FROM m UNION ALL SELECT 'len_ratio', len_ratio, l_returnflag, l_linestatus FROM m),
s AS (SELECT metric, 'all' AS stratum, 'all' AS level, value FROM v UNION ALL SELECT metric, 'l_returnflag', l_returnflag, value FROM v UNION ALL SELECT metric, 'l_linestatus', l_linestatus, value FROM v)
SELECT metric, stratum, level, count(value) AS n, round(avg(value), 8) AS mean, round(100.0 * avg(CAST(value <= 0.5 AS INTEGER)), 8) AS pct_within, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.25), 8) AS p25,
  round(quantile_cont(value, 0.75), 8) AS p75, round(quantile_cont(value, 0.9), 8) AS p90 FROM s WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    p1, p2, t1, t2 = (F.col(c) for c in ("p1", "p2", "t1", "t2"))
    errors = sc.length_errors(p2 - p1, t2 - t1)
    m = pairs(spark, sf).withColumns({"iou": sc.interval_iou((p1, p2), (t1, t2)), **errors})
    out = sg.metric_summary(m, ["iou", "len_abs", "len_ratio"], ["l_returnflag", "l_linestatus"], 0.5)
    return rnd(out, mean=8, pct_within=8, median=8, p25=8, p75=8, p90=8)


@query("""SELECT round(stddev_samp(l_extendedprice), 4) AS sd, CAST(ceil(pow(1.96 * stddev_samp(l_extendedprice) / 500, 2)) AS BIGINT) AS n_required FROM lineitem""")
def required_sample_size(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(sg.required_sample_size(read(spark, sf, "lineitem"), "l_extendedprice", 500.0), sd=4)


@query("""SELECT count(*) AS n_truth, count(l.doc_id) AS n_covered, round(count(l.doc_id) / count(*), 8) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def evaluation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(sg.coverage_row(read(spark, sf, "labels"), read(spark, sf, "documents"), "doc_id"), coverage=8)


@query("""SELECT l.doc_id, l.quality, d.n_chars - 1000 * l.quality AS error FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def evaluate_split(spark: SparkSession, sf: str) -> DataFrame:
    l, d = read(spark, sf, "labels"), read(spark, sf, "documents").select("doc_id", "n_chars")
    out = sg.evaluate(l, d, "doc_id", {"error": F.col("n_chars") - 1000 * F.col("quality")})
    return out.select("doc_id", "quality", "error")
