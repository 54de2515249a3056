"""Interval chains, gaps, overlaps and ordered scans over event spans (user = route, minute = mile-post)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.operators import intervals as iv
from roadledger.operators import joins, ordered as od
from roadledger.queries.base import day, openings, query, read, receipts, rnd, spans

W = "OVER (PARTITION BY user_id ORDER BY m_start, event_id)"


@query("""
WITH b AS (SELECT *, CASE WHEN lag(m_end) OVER w IS NULL OR abs(m_start - lag(m_end) OVER w) > 300 THEN 1 ELSE 0 END AS brk FROM spans
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY m_start, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY m_start, event_id) AS seq FROM b)
SELECT user_id, event_type, CAST(seq AS BIGINT) AS chain_seq, sum(span_len) AS chain_len, min(m_start) AS m_start, max(m_end) AS m_end, count(*) AS n_segments,
  arg_min(event_id, m_start * 1e6 + event_id / 1e6) AS event_id FROM s GROUP BY 1, 2, 3""")
def chain_intervals(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    c = iv.chain(spans(spark, sf), keys, "m_start", "m_end", ["event_id"], tolerance=300.0, split=day())
    return iv.collapse_chains(c, keys, "chain_seq", "m_start", "m_end", "span_len", first=["event_id"], order=["m_start", "event_id"])


@query("""
WITH b AS (SELECT *, CASE WHEN lag(m_end) OVER w IS NULL OR abs(m_start - lag(m_end) OVER w) > 500 OR abs(value - lag(value) OVER w) > 60 THEN 1 ELSE 0 END AS brk
  FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY m_start, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY m_start, event_id) AS seq FROM b)
SELECT user_id, CAST(seq AS BIGINT) AS chain_seq, sum(span_len) AS chain_len, min(m_start) AS m_start, max(m_end) AS m_end, count(*) AS n_segments,
  min(value) AS value_min, max(value) AS value_max FROM s GROUP BY 1, 2""")
def condense_intervals(spark: SparkSession, sf: str) -> DataFrame:
    c = iv.chain(spans(spark, sf), ["user_id"], "m_start", "m_end", ["event_id"], breaks={"value": 60.0}, tolerance=500.0, split=day())
    return iv.collapse_chains(c, ["user_id"], "chain_seq", "m_start", "m_end", "span_len", spans=["value"])


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, open_year FROM openings),
b AS (SELECT *, CASE WHEN lag(open_year) OVER w IS NULL OR abs(open_year - lag(open_year) OVER w) > 1 THEN 1 ELSE 0 END AS brk
  FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY open_year, o_orderkey)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY o_custkey ORDER BY open_year, o_orderkey) AS seq FROM b)
SELECT o_custkey, CAST(seq AS BIGINT) AS project_seq, min(open_year) AS first_year, max(open_year) AS last_year, count(*) AS n_chains,
  round(sum(o_totalprice), 2) AS total, max(open_year) - min(open_year) AS duration FROM s GROUP BY 1, 2""")
def condense_by_year(spark: SparkSession, sf: str) -> DataFrame:
    o = openings(spark, sf)
    c = iv.chain(o, ["o_custkey"], "open_year", "open_year", ["o_orderkey"], breaks={"open_year": 1}, tolerance=None,
                 order=["open_year", "o_orderkey"], out="project_seq", split=F.col("open_year"))
    g = c.groupBy("o_custkey", "project_seq").agg(
        F.min("open_year").alias("first_year"), F.max("open_year").alias("last_year"), F.count(F.lit(1)).alias("n_chains"),
        F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.withColumn("duration", F.col("last_year") - F.col("first_year"))


_GAPS = """g AS (SELECT *, CASE WHEN abs(m_start - lag(m_end) OVER w) < 5 THEN 0 ELSE m_start - lag(m_end) OVER w END AS link_gap
  FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY m_start, event_id)),
a AS (SELECT *, CASE WHEN coalesce(abs(abs(lag(link_gap) OVER w) - abs(link_gap)) <= 3, FALSE) OR coalesce(abs(abs(lead(link_gap) OVER w) - abs(link_gap)) <= 3, FALSE)
  THEN 0 ELSE link_gap END AS link_gap_adj FROM g WINDOW w AS (PARTITION BY user_id ORDER BY m_start, event_id))"""
_ROUTES = """r AS (SELECT user_id, count(*) AS n_segments, max(m_end) - min(m_start) AS route_length, CAST(coalesce(max(CAST(link_gap_adj > 0 AS INTEGER)), 0) AS INTEGER) AS any_broken,
  CAST(coalesce(max(CAST(link_gap_adj < 0 AS INTEGER)), 0) AS INTEGER) AS any_overlap, coalesce(sum(link_gap_adj) FILTER (link_gap_adj > 0), 0) AS tb,
  coalesce(-sum(link_gap_adj) FILTER (link_gap_adj < 0), 0) AS tov FROM a GROUP BY 1)"""


@query(f"WITH {_GAPS} SELECT event_id, user_id, link_gap, CAST(link_gap_adj AS DOUBLE) AS link_gap_adj FROM a")
def link_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf).select("event_id", "user_id", "link_gap", "link_gap_adj")


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return iv.link_gaps(spans(spark, sf), ["user_id"], "m_start", "m_end", ["event_id"], zero=5.0, cancel=3.0, split=day())


@query(f"""WITH {_GAPS}, {_ROUTES} SELECT user_id, n_segments, route_length, any_broken, any_overlap, CASE WHEN round(tb - tov, 3) = 0 THEN 0.0 ELSE tb END AS total_broken,
  CASE WHEN round(tb - tov, 3) = 0 THEN 0.0 ELSE tov END AS total_overlap, round(tb - tov, 3) AS total_balance FROM r""")
def route_continuity(spark: SparkSession, sf: str) -> DataFrame:
    return iv.route_continuity(_gaps(spark, sf), ["user_id"], "m_start", "m_end")


@query(f"""WITH {_GAPS}, {_ROUTES} SELECT count(*) AS n_routes, avg(CAST(any_broken = 0 AND any_overlap = 0 AS INTEGER)) AS share_continuous,
  round(avg(any_broken), 8) AS share_broken, round(avg(any_overlap), 8) AS share_overlap, sum(CASE WHEN round(tb - tov, 3) = 0 THEN 0.0 ELSE tb END) AS total_broken,
  sum(CASE WHEN round(tb - tov, 3) = 0 THEN 0.0 ELSE tov END) AS total_overlap FROM r""")
def continuity_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = iv.continuity_shares(iv.route_continuity(_gaps(spark, sf), ["user_id"], "m_start", "m_end"))
    return rnd(out, share_broken=8, share_overlap=8)


_OPEN = """y AS (SELECT o_custkey, open_year, sum(o_totalprice) AS miles FROM openings GROUP BY 1, 2),
g AS (SELECT *, open_year - lag(open_year) OVER (PARTITION BY o_custkey ORDER BY open_year) AS gap, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY open_year) AS INTEGER) AS opening_no FROM y),
c AS (SELECT o_custkey, count(*) AS n_openings, min(gap) AS min_gap, sum(miles) AS cell_amount, max(open_year) - min(open_year) AS span FROM g GROUP BY 1)"""


def _open_gaps(spark: SparkSession, sf: str) -> DataFrame:
    y = openings(spark, sf).groupBy("o_custkey", "open_year").agg(F.sum("o_totalprice").alias("miles"))
    return iv.opening_gaps(y, ["o_custkey"], "open_year", "open_year", "miles")


@query(f"""WITH {_OPEN} SELECT o_custkey, open_year, round(miles, 2) AS miles, gap, opening_no, n_openings, min_gap, round(cell_amount, 2) AS cell_amount, span FROM g JOIN c USING (o_custkey)""")
def opening_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(_open_gaps(spark, sf), miles=2, cell_amount=2)


@query(f"WITH {_OPEN} SELECT o_custkey FROM c WHERE n_openings = 1 OR min_gap >= 2")
def clean_cells(spark: SparkSession, sf: str) -> DataFrame:
    return iv.clean_cells(_open_gaps(spark, sf), ["o_custkey"], 2)


@query(f"""WITH {_OPEN}, k AS (SELECT 'single' AS category, cell_amount AS m FROM c WHERE n_openings = 1
  UNION ALL SELECT CASE WHEN min_gap >= 3 THEN 'spaced_wide' ELSE 'tight_wide' END, cell_amount FROM c WHERE n_openings > 1
  UNION ALL SELECT CASE WHEN min_gap >= 2 THEN 'spaced_narrow' ELSE 'tight_narrow' END, cell_amount FROM c WHERE n_openings > 1)
SELECT category, count(*) AS n_cells, round(sum(m), 2) AS amount, round(100 * count(*) / (SELECT count(*) FROM c), 8) AS pct_cells,
  round(100 * sum(m) / (SELECT sum(cell_amount) FROM c), 8) AS pct_amount FROM k GROUP BY 1""")
def attribution_classes(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(iv.attribution_classes(_open_gaps(spark, sf), ["o_custkey"], 3, 2), amount=2, pct_cells=8, pct_amount=8)


@query(f"""SELECT event_id, coalesce(abs(lead(m_start) {W} - m_end) < 100, FALSE) AS check0, coalesce(lead(m_start) {W} = m_end, FALSE) AS check1 FROM spans""")
def continuity_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = iv.continuity_flags(spans(spark, sf), ["user_id"], "m_start", "span_len", ["event_id"], 100, split=day())
    return out.select("event_id", "check0", "check1")


@query(f"""
WITH p AS (SELECT *, lag(m_start) {W} AS ps, lag(span_len) {W} AS pl, row_number() {W} AS rn FROM spans),
q AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE ps + pl END AS pe, CASE WHEN rn = 1 THEN m_start <> 0 ELSE m_start - ps - pl > 2000 END AS g FROM p)
SELECT event_id, user_id, m_start, span_len, event_type, CAST(g AS INTEGER) AS gap, 0 AS is_fill FROM q
UNION ALL SELECT event_id, user_id, pe, m_start - pe, NULL, 1, 1 FROM q WHERE g""")
def gap_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf).select("event_id", "user_id", "m_start", "span_len", "event_type")
    return iv.gap_rows(s, ["user_id"], "m_start", "span_len", ["event_id"], ["event_type"], 2000, split=day())


_LEADS = ", ".join(f"lead(m_start, {i}) {W} AS n{i}" for i in range(1, 7))
_RUN = "CASE " + " ".join(f"WHEN NOT coalesce(abs(n{i + 1} - e) < abs(n{i} - e), FALSE) THEN {i - 1}" for i in range(1, 6)) + " ELSE 5 END"


@query(f"""
WITH RECURSIVE l AS (SELECT *, m_start + span_len AS e, row_number() {W} AS rn, {_LEADS} FROM spans),
j AS (SELECT *, CASE WHEN n1 IS NULL OR abs(n1 - e) < 100 OR NOT e > n1 - 50 THEN 0 ELSE {_RUN} END AS k, n1 IS NULL OR abs(n1 - e) < 100 AS cont FROM l),
walk AS (SELECT user_id, CAST(1 AS BIGINT) AS rn FROM j WHERE j.rn = 1 UNION ALL
  SELECT w.user_id, w.rn + CASE WHEN j.cont THEN 1 ELSE j.k + 2 END FROM walk w JOIN j ON j.user_id = w.user_id AND j.rn = w.rn),
gone AS (SELECT w.user_id, unnest(range(w.rn + 1, w.rn + 1 + j.k)) AS rn FROM walk w JOIN j ON j.user_id = w.user_id AND j.rn = w.rn WHERE j.k > 0)
SELECT event_id, user_id, m_start, span_len FROM j WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = j.user_id AND g.rn = j.rn)""")
def overlap_drop(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf).select("event_id", "user_id", "m_start", "span_len")
    return iv.drop_overlaps(s, ["user_id"], "m_start", "span_len", ["event_id"], split=day())


@query("""SELECT event_id, user_id, CASE WHEN user_id > 100 THEN m_start - min(m_start) OVER (PARTITION BY user_id) ELSE m_start END AS m_start FROM spans""")
def subtract_first(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf).select("event_id", "user_id", "m_start")
    return iv.subtract_first(s, ["user_id"], "m_start", F.col("user_id") > 100)


@query("""
WITH t AS (SELECT event_id, user_id, floor(m_start / 720) AS s, floor(m_end / 720) AS e FROM spans),
n AS (SELECT *, lead(e) OVER (PARTITION BY user_id ORDER BY e, s, event_id) AS ne FROM t)
SELECT user_id, s, e, min(event_id) AS event_id FROM n WHERE ne IS NULL OR ne <> e GROUP BY 1, 2, 3""")
def repeated_segments(spark: SparkSession, sf: str) -> DataFrame:
    t = spans(spark, sf).select("event_id", "user_id", F.floor(F.col("m_start") / 720).cast("double").alias("s"),
                                F.floor(F.col("m_end") / 720).cast("double").alias("e"))
    return iv.repeated_segments(t, ["user_id"], "s", "e", ["event_id"], split=F.floor(F.col("e") / 2))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY m_start, event_id) AS rn FROM spans) WHERE rn = 1""")
def first_row_per_key(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf).select("user_id", "event_id", "event_type", "value", "m_start")
    return od.first_row(s, ["user_id", "event_type"], ["m_start", "event_id"]).drop("m_start")


@query(f"""
WITH p AS (SELECT *, lag(event_type) {W} AS pt, first_value(m_start) {W} AS f FROM spans)
SELECT event_id, CAST(sum(CASE WHEN pt IS NULL OR pt <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY m_start, event_id) AS BIGINT) AS n_runs, m_start - f AS since_first FROM p""")
def running_changes(spark: SparkSession, sf: str) -> DataFrame:
    s = od.distinct_running_count(spans(spark, sf), ["user_id"], ["m_start", "event_id"], "event_type", "n_runs", split=day())
    s = od.ordered(s, ["user_id"], ["m_start", "event_id"], first={"f": "m_start"}, split=day())
    return s.select("event_id", "n_runs", (F.col("m_start") - F.col("f")).alias("since_first"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type, day_no) AS n_same, arg_min(value, m_start * 1e6 + event_id / 1e6) OVER (PARTITION BY user_id, event_type) AS first_value,
  max(value) OVER (PARTITION BY user_id) AS max_value FROM spans""")
def group_values_on_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = od.duplicate_sizes(spans(spark, sf), ["user_id", "event_type", "day_no"])
    s = od.carry_first(s, ["user_id", "event_type"], ["m_start", "event_id"], "value", "first_value")
    return od.with_group_values(s, ["user_id"], max_value=F.max("value")).select("event_id", "n_same", "first_value", "max_value")


@query("""SELECT n_cluster, count(*) AS n_rows, count(DISTINCT gid) AS n_clusters FROM (SELECT count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n_cluster,
  l_partkey * 1000000 + l_suppkey AS gid FROM lineitem) GROUP BY 1""")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    l = od.duplicate_sizes(read(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], "n_cluster")
    l = od.group_ids(l, ["l_partkey", "l_suppkey"], "gid")
    return l.groupBy("n_cluster").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("gid").alias("n_clusters"))


@query("""SELECT o_orderkey, count(*) AS n_lines, round(sum(total), 2) AS total FROM (SELECT o_orderkey, l_extendedprice AS total, ship_year,
  lead(ship_year) OVER (PARTITION BY o_orderkey ORDER BY ship_year, l_linenumber, l_partkey, l_suppkey) AS n FROM receipts) WHERE n IS NULL OR n <> ship_year GROUP BY 1""")
def drop_when_next_equal(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).select("o_orderkey", "ship_year", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("total"))
    kept = od.drop_when_next_equal(r, ["o_orderkey"], ["ship_year", "l_linenumber", "l_partkey", "l_suppkey"], "ship_year", split=F.col("ship_year"))
    return kept.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("total"), 2).alias("total"))


@query("""
WITH p AS (SELECT event_id, user_id, m_start FROM spans WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, m_start FROM spans WHERE event_type = 'click'),
x AS (SELECT p.event_id, p.user_id, c.event_id AS click_id, c.m_start AS click_at, abs(p.m_start - c.m_start) AS gap, row_number() OVER (PARTITION BY p.event_id
  ORDER BY abs(p.m_start - c.m_start), c.event_id) AS rn FROM p JOIN c USING (user_id)) SELECT event_id, user_id, click_id, click_at, gap FROM x WHERE rn = 1""")
def nearest_record(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf)
    p = s.where("event_type = 'purchase'").select("event_id", "user_id", "m_start")
    c = s.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("m_start").alias("click_at"))
    return joins.nearest_record(p, c, ["user_id"], ["event_id"], "m_start", "click_at", "click_id", 1440.0)


@query("""
WITH p AS (SELECT event_id, user_id, m_start, m_start + 4000 AS till FROM spans WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, coalesce(sum(s.span_len), 0) AS inside_len, count(s.span_len) AS n_inside FROM p LEFT JOIN spans s ON s.user_id = p.user_id AND s.m_start >= p.m_start AND s.m_end <= p.till GROUP BY 1, 2""")
def containment_sums(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf)
    p = s.where("event_type = 'purchase'").select("event_id", "user_id", F.col("m_start").alias("begin_at"), (F.col("m_start") + 4000).alias("till"))
    seg = s.select("user_id", F.col("m_start").alias("seg_begin"), F.col("m_end").alias("seg_end"), "span_len")
    return joins.containment_sums(p, seg, ["user_id"], ["event_id"], "begin_at", "till", "seg_begin", "seg_end", "span_len", 600.0, "inside_len")


@query("""SELECT CAST(floor(avg(d)) AS BIGINT) AS mean_gap, count(*) AS n_bad FROM (SELECT o_orderkey, abs(sum(l_quantity) - (max(l_quantity) + min(l_quantity))) AS d FROM receipts GROUP BY 1) WHERE d > 1e-4""")
def length_consistency(spark: SparkSession, sf: str) -> DataFrame:
    r = receipts(spark, sf).groupBy("o_orderkey").agg(
        F.abs(F.sum("l_quantity") - (F.max("l_quantity") + F.min("l_quantity"))).alias("d"))
    return r.where(F.col("d") > 1e-4).agg(F.floor(F.avg("d")).alias("mean_gap"), F.count(F.lit(1)).alias("n_bad"))
