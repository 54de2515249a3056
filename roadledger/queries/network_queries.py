"""Linear referencing, network and area queries on paths derived from events and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.operators import joins
from roadledger.operators import linear as ln
from roadledger.operators import network as nw
from roadledger.operators import places as pl
from roadledger.queries.base import query, read, rnd
from roadledger.session import cut_lineage

_PATH = """v AS (SELECT user_id, event_id AS seq, floor(epoch(ts) / 60) - 28401120 AS x, round(value * 10, 3) AS y, event_type FROM events),
g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w - 1 AS seg_no FROM v WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
s AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS len FROM g WHERE x2 IS NOT NULL),
d AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY seq) - len AS d0, sum(len) OVER (PARTITION BY user_id) AS total FROM s)"""


def path(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a line: minutes against value."""
    e = read(spark, sf, "events")
    return e.select("user_id", F.col("event_id").alias("seq"), (F.floor(F.unix_timestamp("ts") / 60) - 28401120).cast("double").alias("x"),
                    F.round(F.col("value") * 10, 3).alias("y"), "event_type")


def path_segments(spark: SparkSession, sf: str) -> DataFrame:
    return ln.segments(path(spark, sf), ["user_id"], split=F.floor(F.col("seq") / 5000))


@query(f"WITH {_PATH} SELECT user_id, CAST(seg_no AS BIGINT) AS seg_no, round(len, 6) AS seg_len, round(abs(d0), 5) AS d0 FROM d")
def polyline_segments(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(path_segments(spark, sf).select("user_id", "seg_no", "seg_len", "d0"), seg_len=6, d0=5)


@query(f"WITH {_PATH} SELECT user_id, round(sum(len), 5) AS length, count(*) AS n_segments FROM d GROUP BY 1")
def polyline_length(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(ln.line_lengths(path_segments(spark, sf), ["user_id"]), length=5)


_PT = "p AS (SELECT user_id, seq AS pid, x + 37.0 AS px, y + 11.0 AS py FROM v WHERE event_type = 'signup')"


def path_points(spark: SparkSession, sf: str) -> DataFrame:
    p = path(spark, sf).where("event_type = 'signup'")
    return p.select("user_id", F.col("seq").alias("pid"), (F.col("x") + 37.0).alias("px"), (F.col("y") + 11.0).alias("py"))


@query(f"""WITH {_PATH}, {_PT},
m AS (SELECT p.pid, p.user_id, px, py, x, y, x2, y2, seg_no, d0, len, CASE WHEN len > 0 THEN greatest(0, least(1, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / (len * len))) ELSE 0 END AS t FROM p JOIN d ON p.user_id = d.user_id),
n AS (SELECT *, pow(x + t * (x2 - x) - px, 2) + pow(y + t * (y2 - y) - py, 2) AS d2 FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(d2, 6), seg_no) AS rn FROM n)
SELECT pid, user_id, round(sqrt(d2), 4) AS "offset" FROM r WHERE rn = 1""")
def polyline_position(spark: SparkSession, sf: str) -> DataFrame:
    at = ln.locate(path_points(spark, sf), path_segments(spark, sf), ["user_id"], ["pid"], fan=16)
    return rnd(at.select("pid", "user_id", "offset"), offset=4)


@query(f"""WITH {_PATH}, c AS (SELECT DISTINCT user_id, total * 0.2 AS f, total * 0.8 AS t FROM d),
k AS (SELECT d.user_id, greatest(d0, f) AS a, least(d0 + len, t) AS b FROM d JOIN c ON d.user_id = c.user_id WHERE d0 < t AND d0 + len > f)
SELECT user_id, round(sum(b - a), 4) AS length, count(*) + 1 AS n_vertices FROM k GROUP BY 1""")
def cut_line(spark: SparkSession, sf: str) -> DataFrame:
    s = path_segments(spark, sf)
    total = ln.line_lengths(s, ["user_id"])
    cuts = total.select("user_id", (F.col("length") * 0.2).alias("d_from"), (F.col("length") * 0.8).alias("d_to"))
    v = ln.cut_lines(s, cuts, ["user_id"], [], width=5000.0)
    n = v.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    return rnd(ln.vertex_lengths(v, ["user_id"]).join(n, "user_id"), length=4)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(1, greatest(0, CASE WHEN l_quantity > 10 THEN (l_suppkey - 10.0) / (l_quantity - 10.0) ELSE l_suppkey / 50.0 END)), 10) AS fraction FROM lineitem""")
def milepost_fraction(spark: SparkSession, sf: str) -> DataFrame:
    frac = ln.milepost_fraction(F.col("l_suppkey").cast("double"), F.lit(10.0), F.col("l_quantity"), F.lit(50.0))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(frac, 10).alias("fraction"))


_E2 = "0.00669438002290"


def _q(lat: str) -> str:
    s, e = f"sin(radians({lat}))", f"sqrt({_E2})"
    return f"((1 - {_E2}) * ({s} / (1 - {_E2} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e})))"


def _m2(lat: str) -> str:
    return f"(pow(cos(radians({lat})), 2) / (1 - {_E2} * pow(sin(radians({lat})), 2)))"


@query(f"""
WITH k AS (SELECT ({_m2('29.5')} - {_m2('45.5')}) / ({_q('45.5')} - {_q('29.5')}) AS n), c AS (SELECT n, {_m2('29.5')} + n * {_q('29.5')} AS c FROM k),
p AS (SELECT c_custkey, 6378137.0 * sqrt(c - n * {_q('(25.0 + c_nationkey)')}) / n AS rho, 6378137.0 * sqrt(c - n * {_q('23.0')}) / n AS rho0,
  n * radians(c_acctbal / 250.0 - 125.0 + 96.0) AS theta FROM customer, c)
SELECT c_custkey, round(rho * sin(theta), 3) AS x, round(rho0 - rho * cos(theta), 3) AS y FROM p""")
def project_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    x, y = ln.project_albers(-125.0 + F.col("c_acctbal") / 250.0, 25.0 + F.col("c_nationkey"))
    return c.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""
WITH a AS (SELECT c_custkey, c_acctbal AS x, (c_custkey * 37 % 10000) * 1.0 AS y FROM customer), b AS (SELECT s_suppkey, s_acctbal AS x, (s_suppkey * 91 % 10000) * 1.0 AS y FROM supplier)
SELECT c_custkey, s_suppkey, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM a, b WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 250""")
def within_distance(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 10000).cast("double").alias("y"))
    b = read(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 91 % 10000).cast("double").alias("y"))
    return rnd(joins.within_distance(a, b, 250.0).select("c_custkey", "s_suppkey", "distance"), distance=6)


_LINKS = """l AS (SELECT user_id, seq, lag(seq) OVER w AS ps, x - lag(x) OVER w AS gap FROM v WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS isl FROM l)"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between successive events of a user that lie close in time."""
    s = path_segments(spark, sf)
    nxt = s.where(F.col("x2") - F.col("x1") <= 400)
    v = path(spark, sf)
    from roadledger.operators.ordered import ordered
    nx = ordered(v.select("user_id", "seq"), ["user_id"], ["seq"], lead={"next_seq": "seq"}, split=F.floor(F.col("seq") / 5000))
    return nxt.join(nx, ["user_id", "seq"]).select(
        "user_id", F.col("seq").alias("eid"), F.col("seq").cast("string").alias("a"), F.col("next_seq").cast("string").alias("b"), F.col("seg_len").alias("len"))


@query(f"""WITH {_PATH}, {_LINKS}, c AS (SELECT user_id, isl, min(CAST(seq AS VARCHAR)) AS component, count(*) AS n FROM i GROUP BY 1, 2)
SELECT component, n FROM c WHERE n > 1""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return nw.components(links(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PATH}, {_LINKS}, c AS (SELECT user_id, isl, count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) > 1)
SELECT degree, count(*) AS n_nodes FROM (SELECT CAST(1 AS BIGINT) AS degree FROM c UNION ALL SELECT 1 FROM c UNION ALL SELECT 2 FROM (SELECT unnest(range(1, n - 1)) FROM c)) GROUP BY 1""")
def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return nw.degrees(links(spark, sf), ["user_id"]).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"""WITH {_PATH}, {_LINKS}, e AS (SELECT i.user_id, i.isl, s.len, i.seq FROM i JOIN i j ON j.ps = i.seq AND j.user_id = i.user_id AND j.isl = i.isl JOIN s ON s.seq = i.seq)
SELECT user_id, min(seq) AS first_edge, max(seq) AS last_edge, count(*) AS n_edges, round(sum(len), 4) AS length FROM e GROUP BY user_id, isl""")
def merged_parts(spark: SparkSession, sf: str) -> DataFrame:
    m = nw.merge_parts(links(spark, sf), ["user_id"])
    out = m.groupBy("user_id", "part").agg(F.min("eid").alias("first_edge"), F.max("eid").alias("last_edge"), F.count(F.lit(1)).alias("n_edges"),
                                           F.round(F.sum("len"), 4).alias("length"))
    return out.drop("part")


@query("""SELECT l_suppkey, count(*) AS n_edges, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT l_returnflag AS k FROM lineitem i WHERE i.l_suppkey = o.l_suppkey)) AS states,
  (SELECT m FROM (SELECT CAST(l_linenumber AS INTEGER) AS m, count(*) AS c FROM lineitem i WHERE i.l_suppkey = o.l_suppkey GROUP BY 1 ORDER BY c DESC, m LIMIT 1)) AS modal_l_linenumber FROM lineitem o GROUP BY 1""")
def route_table(spark: SparkSession, sf: str) -> DataFrame:
    t = nw.route_table(read(spark, sf, "lineitem"), ["l_suppkey"], ["l_linenumber"], "l_returnflag", ["l_orderkey"])
    return t.withColumn("states", F.array_join("states", ","))


@query("""SELECT c_custkey, round(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + c_nationkey * 1609.344 WHEN c_mktsegment = 'BUILDING' THEN c_acctbal - c_nationkey * 0.3048 ELSE c_acctbal END, 6) AS x,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS tolerance_m FROM customer""")
def reference_offset(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    c = read(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.when(seg == "HOUSEHOLD", "near").otherwise("offset").alias("rel"),
        F.when(seg == "MACHINERY", "E").when(seg == "BUILDING", "W").alias("dir"), F.col("c_nationkey").cast("double").alias("dist"),
        F.when(seg == "BUILDING", "ft").otherwise("mi").alias("unit"))
    out = ln.apply_offset(c, "rel", "dir", "dist", "unit")
    return rnd(out.select("c_custkey", "x", "tolerance_m"), x=6)


def squares(spark: SparkSession, sf: str) -> DataFrame:
    """Unit squares of a grid, one per supplier, 25 to a row, grouped into columns by nation."""
    s = read(spark, sf, "supplier")
    col, row = (F.col("s_suppkey") % 25).cast("double"), F.floor(F.col("s_suppkey") / 25).cast("double")
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), (col + a).alias("x"), (row + b).alias("y"))
                        for i, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])])
    return s.select(F.col("s_suppkey").alias("area"), (F.col("s_suppkey") % 5).alias("parent"), F.lit(0).alias("part"), F.inline(corners))


@query("""SELECT a.s_suppkey AS area, b.s_suppkey AS area_other FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey AND abs(a.s_suppkey % 25 - b.s_suppkey % 25) <= 1
  AND abs(floor(a.s_suppkey / 25) - floor(b.s_suppkey / 25)) <= 1""")
def area_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return pl.neighbours(squares(spark, sf), "area")


@query("""
WITH s AS (SELECT s_suppkey % 5 AS parent, s_suppkey % 25 AS c, floor(s_suppkey / 25) AS r FROM supplier)
SELECT parent, CAST(4 * count(*) - 2 * (SELECT count(*) FROM s a JOIN s b ON a.parent = b.parent AND a.c = b.c AND b.r = a.r + 1 WHERE a.parent = s.parent) AS BIGINT) AS n_edges FROM s GROUP BY parent""")
def dissolved_outline(spark: SparkSession, sf: str) -> DataFrame:
    e = pl.boundary_edges(squares(spark, sf), ["parent", "area"])
    return pl.dissolve(e, ["parent"]).groupBy("parent").agg(F.count(F.lit(1)).alias("n_edges"))


@query("""SELECT s_suppkey AS area, s_suppkey % 25 + 0.5::DOUBLE AS cx, floor(s_suppkey / 25) + 0.5::DOUBLE AS cy, 1.0::DOUBLE AS area_m2 FROM supplier""")
def area_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pl.centroids(pl.boundary_edges(squares(spark, sf), ["area"]), "area"), cx=9, cy=9, area_m2=9)


@query("""
WITH s AS (SELECT s_suppkey AS req, s_suppkey % 3 = 0 AND s_suppkey % 25 <> 24 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AS shared FROM supplier)
SELECT req, CASE WHEN shared THEN 'shared' WHEN req % 3 = 1 THEN 'half' ELSE 'outline' END AS kind, CAST(CASE WHEN shared THEN 1 WHEN req % 3 = 1 THEN 3 ELSE 4 END AS BIGINT) AS n_edges FROM s""")
def boundary_reference(spark: SparkSession, sf: str) -> DataFrame:
    e = pl.boundary_edges(squares(spark, sf), ["area"])
    s = read(spark, sf, "supplier")
    req = s.select(F.col("s_suppkey").alias("req"), F.col("s_suppkey").alias("area"),
                   F.when(F.col("s_suppkey") % 3 == 1, "N").when(F.col("s_suppkey") % 3 == 2, "bad").alias("direction"))
    best = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("req"), (F.col("s_suppkey") + 1).alias("area_other"))
    names = s.select(F.col("s_suppkey").alias("area"), F.col("s_name").alias("name"))
    return pl.boundary_reference(req, e, names, "area", best).groupBy("req", "kind").agg(F.count(F.lit(1)).alias("n_edges"))


_QUADS = """q AS (SELECT s_suppkey AS area, CAST(s_suppkey % 25 * 3 AS DOUBLE) AS ox, floor(s_suppkey / 25) * 3.0 AS oy, s_suppkey % 7 / 10.0 AS w FROM supplier),
r AS (SELECT area, unnest([0, 1, 2, 3, 4]) AS seq, unnest([ox, ox + 1 + w, ox + 0.8, ox - 0.2, ox]) AS x1, unnest([oy, oy - w, oy + 1, oy + 0.7, oy]) AS y1 FROM q),
e AS (SELECT * FROM (SELECT *, lead(x1) OVER (PARTITION BY area ORDER BY seq) AS x2, lead(y1) OVER (PARTITION BY area ORDER BY seq) AS y2 FROM r) WHERE x2 IS NOT NULL),
c AS (SELECT area, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy FROM e GROUP BY area),
d AS (SELECT e.*, cx, cy, k, area * 4 + k AS req, CASE k WHEN 0 THEN y1 - cy WHEN 1 THEN cy - y1 WHEN 2 THEN x1 - cx ELSE cx - x1 END AS s1,
  CASE k WHEN 0 THEN y2 - cy WHEN 1 THEN cy - y2 WHEN 2 THEN x2 - cx ELSE cx - x2 END AS s2 FROM e JOIN c USING (area), range(4) t(k)),
pts AS (SELECT req, k, seq, 0 AS i, x1 AS x, y1 AS y FROM d WHERE s1 >= 0 UNION ALL SELECT req, k, seq, 1, CASE WHEN k >= 2 THEN cx ELSE x1 + s1 / (s1 - s2) * (x2 - x1) END,
  CASE WHEN k >= 2 THEN y1 + s1 / (s1 - s2) * (y2 - y1) ELSE cy END FROM d WHERE s1 * s2 < 0),
ring AS (SELECT req, row_number() OVER (PARTITION BY req ORDER BY seq, i) - 1 AS seq, x, y FROM pts),
shut AS (SELECT * FROM ring UNION ALL SELECT req, (SELECT count(*) FROM ring z WHERE z.req = ring.req), x, y FROM ring WHERE seq = 0)"""


def _quads(spark: SparkSession, sf: str) -> DataFrame:
    """A slanted closed ring of four corners per supplier."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("area"), (F.col("s_suppkey") % 25 * 3).cast("double").alias("ox"),
                                           (F.floor(F.col("s_suppkey") / 25) * 3.0).alias("oy"), (F.col("s_suppkey") % 7 / 10.0).alias("w"))
    ox, oy, w = F.col("ox"), F.col("oy"), F.col("w")
    corners = [(ox, oy), (ox + 1 + w, oy - w), (ox + 0.8, oy + 1), (ox - 0.2, oy + 0.7), (ox, oy)]
    return s.select("area", F.lit(0).alias("part"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("seq"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(corners)])))


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = _quads(spark, sf)
    words = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(d).alias("direction")) for i, d in enumerate(("north", "south", "east", "west"))])
    req = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("area"), F.inline(words)).select(
        (F.col("area") * 4 + F.col("k")).alias("req"), "area", "direction")
    return v, pl.half_rings(v, pl.centroids(pl.boundary_edges(v, ["area"]), "area"), req, "area")


@query(f"WITH {_QUADS} SELECT req, CAST(seq AS BIGINT) AS seq, round(x, 9) AS x, round(y, 9) AS y FROM shut")
def half_rings(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(_halves(spark, sf)[1].select("req", "seq", "x", "y"), x=9, y=9)


@query(f"""WITH {_QUADS}, a AS (SELECT area, abs(sum(x1 * y2 - x2 * y1) / 2) AS whole FROM e GROUP BY area)
SELECT area, round(whole, 8) AS area_m2, round(whole, 8) AS north_south, round(whole, 8) AS east_west FROM a""")
def halves_add_up(spark: SparkSession, sf: str) -> DataFrame:
    """The halves of an area against the whole."""
    v, halves = _halves(spark, sf)
    parts = pl.ring_areas(halves, ["req", "area"]).groupBy("area").agg(
        F.sum(F.when(F.col("req") % 4 < 2, F.col("area_m2"))).alias("north_south"), F.sum(F.when(F.col("req") % 4 >= 2, F.col("area_m2"))).alias("east_west"))
    return rnd(pl.ring_areas(v, ["area"]).join(parts, "area"), area_m2=8, north_south=8, east_west=8)


@query("""WITH s AS (SELECT s_suppkey AS area, s_suppkey + 1 AS area_other FROM supplier WHERE s_suppkey % 25 <> 24 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier))
SELECT area, area_other, round(1.2::DOUBLE, 6) AS length FROM s""")
def border_within(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbour's border up to a tenth from the own one: the shared side and both stubs beside it."""
    e = pl.boundary_edges(squares(spark, sf), ["area"])
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("area"))
    pairs = s.where("area % 25 <> 24").select("area", (F.col("area") + 1).alias("area_other")).join(s.withColumnRenamed("area", "area_other"), "area_other")
    near = pl.border_within(e, "area", pairs.select("area", "area_other"), 0.1, width=0.75)
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return near.groupBy("area", "area_other").agg(F.round(F.sum(length), 6).alias("length"))


@query()
def crop_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's path cut between the signups and the purchases: kept parts, cut lines and their vertices."""
    s = path_segments(spark, sf).withColumn("part", F.lit(0))
    v = path(spark, sf)
    ends = v.where(F.col("event_type").isin("signup", "purchase")).select(
        "user_id", F.when(F.col("event_type") == "signup", "a").otherwise("b").alias("endpoint"), F.col("seq").alias("vid"), "x", "y")
    ranges = cut_lineage(ln.endpoint_ranges(s, ends, "user_id", "part"))
    cropped, vertices = ln.crop_routes(s, ends, "user_id", "part", rule="mid", ranges=ranges)
    return ln.crop_summary(cropped, s, "user_id", "part", ranges, vertices).drop("crop_from", "crop_to")


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS kind, 100 + s_suppkey % 200 AS a, CASE WHEN s_suppkey % 4 = 0 THEN 600 ELSE 700 END + s_suppkey % 100 AS b,
  CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS n_all FROM supplier)
SELECT s_suppkey, CAST(n_all AS BIGINT) AS n_parts_all, CAST(CASE WHEN kind = 3 THEN 0 ELSE n_all END AS BIGINT) AS n_parts_kept,
  round(CASE WHEN kind < 3 THEN (b - a) * n_all END::DOUBLE, 6) AS len_crop_m, CASE kind WHEN 2 THEN 30 WHEN 3 THEN 30000 ELSE 0 END::DOUBLE AS part_dist_m,
  round(CASE WHEN kind < 3 THEN b - a END::DOUBLE, 6) AS len_corr_m, round(CASE WHEN kind < 3 THEN a END / 1000::DOUBLE, 9) AS crop_from,
  round(CASE WHEN kind < 3 THEN b END / 1000::DOUBLE, 9) AS crop_to, CASE WHEN kind < 3 THEN 'intersect' END AS src_a,
  CASE WHEN kind < 2 THEN 'intersect' WHEN kind = 2 THEN 'nearest' END AS src_b FROM s""")
def crop_between_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Straight routes; one endpoint is a crossing line, the other an area, a spot on the route, beside it, or out of reach."""
    key = F.col("s_suppkey")

    def shape(*spots):
        return F.array(*[F.struct((x if isinstance(x, Column) else F.lit(x)).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in spots])

    s = read(spark, sf, "supplier").select("s_suppkey")
    straight = s.select("s_suppkey", F.lit(0).alias("part"), F.posexplode(shape((0, 0), (400, 0), (1000, 0))).alias("seq", "p")).unionByName(
        s.where(key % 2 == 0).select("s_suppkey", F.lit(1).alias("part"), F.posexplode(shape((0, 5000), (1000, 5000))).alias("seq", "p")))
    parts = ln.segments(straight.select("s_suppkey", "part", "seq", "p.*"), ["s_suppkey", "part"])
    a, left, spot = 100 + key % 200, 600 + key % 100, 700 + key % 100
    area = shape((left, -10), (spot, -10), (spot, 10), (left, 10), (left, -10))
    other = F.when(key % 4 == 0, area).when(key % 4 == 1, shape((spot, 0))).when(key % 4 == 2, shape((spot, 30))).otherwise(shape((spot, -30_000)))
    ends = s.select("s_suppkey", F.lit("a").alias("endpoint"), F.posexplode(shape((a, -50), (a, 50))).alias("vid", "p")).unionByName(
        s.select("s_suppkey", F.lit("b").alias("endpoint"), F.posexplode(other).alias("vid", "p"))).select("s_suppkey", "endpoint", "vid", "p.*")
    lines = ln.segments(ends, ["s_suppkey", "endpoint"], "vid")
    ranges = cut_lineage(ln.endpoint_ranges(parts, ends, "s_suppkey", "part", lines=lines))
    cropped, _ = ln.crop_routes(parts, ends, "s_suppkey", "part", lines=lines, ranges=ranges)
    return rnd(ln.crop_summary(cropped, parts, "s_suppkey", "part", ranges), len_crop_m=6, part_dist_m=6, len_corr_m=6, crop_from=9, crop_to=9)
