"""Text extraction, nested values, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.functions import designations as ds
from roadledger.functions import extraction as ex
from roadledger.functions import routes as rt
from roadledger.functions import text as tx
from roadledger.functions import titles as tt
from roadledger.operators import aggregates as agg
from roadledger.operators import joins
from roadledger.queries.base import query, read, rnd
from roadledger.sources.tables import json_fields

# a title per order, built from the order's own columns
_ROUTE = """['I-' || k, 'IH ' || k, 'FAI-' || k || ' & I ' || (k + 7), 'INTERSTATE ' || k || ' OVER I-' || (k + 3), 'US ' || k, 'IR-' || k || 'BL', 'BRIDGES ON IN-' || k,
  'VI-' || k][1 + o_custkey % 8]"""
_PLACE = """[' FROM MAIN ST TO ELM AVE, PAVING', ' BETWEEN OAK RD AND I-' || (k + 2) || ', SAFETY', ' MP ' || k || '.5 TO MP ' || (k + 4) || '.25', ' AT SR ' || k || ', DECK REPAIR',
  ', 2.5 MI N OF US 36, RESURFACING', ', MILL CREEK-PINE RIVER, PE', ' STATEWIDE; SIGN UPGRADE', ' NEAR SPRINGFIELD, LIGHTING', ', EXIT ' || k || ' RAMP', ''][1 + o_orderkey % 10]"""
_TITLE = f"(SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate) AS yr, o_custkey % 95 + 1 AS k, {_ROUTE} || {_PLACE} AS title FROM (SELECT *, o_custkey % 95 + 1 AS k FROM orders))"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")

    def plus(n: int):
        return (F.col("k") + n).cast("string")

    def pick(options: list, at):
        return F.element_at(F.array(*[o if not isinstance(o, str) else F.lit(o) for o in options]), (at + 1).cast("int"))

    route = pick([F.concat(F.lit("I-"), k), F.concat(F.lit("IH "), k), F.concat(F.lit("FAI-"), k, F.lit(" & I "), plus(7)),
                  F.concat(F.lit("INTERSTATE "), k, F.lit(" OVER I-"), plus(3)), F.concat(F.lit("US "), k), F.concat(F.lit("IR-"), k, F.lit("BL")),
                  F.concat(F.lit("BRIDGES ON IN-"), k), F.concat(F.lit("VI-"), k)], F.col("o_custkey") % 8)
    place = pick([" FROM MAIN ST TO ELM AVE, PAVING", F.concat(F.lit(" BETWEEN OAK RD AND I-"), plus(2), F.lit(", SAFETY")),
                  F.concat(F.lit(" MP "), k, F.lit(".5 TO MP "), plus(4), F.lit(".25")), F.concat(F.lit(" AT SR "), k, F.lit(", DECK REPAIR")),
                  ", 2.5 MI N OF US 36, RESURFACING", ", MILL CREEK-PINE RIVER, PE", " STATEWIDE; SIGN UPGRADE", " NEAR SPRINGFIELD, LIGHTING",
                  F.concat(F.lit(", EXIT "), k, F.lit(" RAMP")), ""], F.col("o_orderkey") % 10)
    # a title takes far longer to parse than to move, and the file may be one split
    o = read(spark, sf, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("k", F.col("o_custkey") % 95 + 1)
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("yr"), "k", F.concat(route, place).alias("title"))


# The reference patterns and prefixes of roadledger.functions.routes, for the SQL side.
_RE = r"(\bIH?[-\s]?\d{1,3}[A-Z]{0,2}\b)|(\bIR[-\s]?\d{1,3}[A-Z]{0,2}\b)|(\bIN[-\s]?\d{1,3}\b)|(\bINTERSTATE\s+\d{1,3}\b)|(\bFAI[-\s]?\d{1,3}\b)"
_PRE = r"^(INTERSTATE\s+|FAI[-\s]?|IR[-\s]?|IN[-\s]?|IH?[-\s]?)"


def _first_sql(src: str) -> str:
    return f"nullif(regexp_extract({src}, '{_RE}'), '')"


def _cut_sql(src: str, m: str) -> str:
    return (f"CASE WHEN {m} IS NULL THEN {src} ELSE substr({src}, 1, instr({src}, {m}) - 1) || '-----' || "
            f"substr({src}, instr({src}, {m}) + length({m})) END")


@query(f"""WITH a AS (SELECT o_orderkey, title AS t1, {_first_sql('title')} AS m1 FROM {_TITLE}), b AS (SELECT *, {_cut_sql('t1', 'm1')} AS t2 FROM a),
c AS (SELECT *, {_first_sql('t2')} AS m2 FROM b), d AS (SELECT *, {_cut_sql('t2', 'm2')} AS t3 FROM c), e AS (SELECT *, {_first_sql('t3')} AS m3 FROM d)
SELECT o_orderkey, m1 IS NOT NULL AS has_route, """ + ", ".join(f"""regexp_replace(m{i}, '{_PRE}', '') AS route_{i}, regexp_matches(regexp_replace(m{i}, '{_PRE}', ''), '[A-Za-z]') AS route_{i}_has_char,
  TRY_CAST(nullif(regexp_replace(regexp_replace(m{i}, '{_PRE}', ''), '[A-Za-z]', '', 'g'), '') AS INTEGER) AS route_{i}_int""" for i in (1, 2, 3)) + " FROM e")
def extract_routes(spark: SparkSession, sf: str) -> DataFrame:
    out = rt.extract_routes(titles(spark, sf), "title")
    return out.select("o_orderkey", "has_route", *[f"route_{i}{s}" for i in (1, 2, 3) for s in ("", "_has_char", "_int")])


@query(f"""SELECT doc_id, nullif(regexp_extract(upper(text), '{_RE}'), '') IS NOT NULL AS has_route,
  CAST(len(regexp_extract_all(upper(text), '{_RE}')) AS INTEGER) AS n_found FROM documents""")
def routes_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = rt.extract_routes(read(spark, sf, "documents"), "text")
    found = F.size(F.regexp_extract_all(F.upper("text"), F.lit("|".join(f"(?:{p})" for p in rt.REFERENCE_PATTERNS)), F.lit(0)))
    return d.select("doc_id", "has_route", found.alias("n_found"))


# The number patterns of roadledger.functions.routes, for the SQL side.
_ALL = [r"\bINTERSTATE\s+(\d{1,3})\b", r"\bIH\s*(\d{1,3})(?:[^0-9]|$)", r"\bFAI[\s-]*(\d{1,3})(?:[^0-9]|$)", r"\bIS\s+(\d{1,3})(?:[^0-9]|$)",
        r"\bIR[\s-]+(\d{1,3})(?:[^0-9]|$)", r"\bI[\s-]*(\d{1,3})(?:[^0-9]|$)"]


@query(f"""WITH f AS (SELECT o_orderkey, list_concat({', '.join(f"regexp_extract_all(title, '{p}', 1)" for p in _ALL)}) AS l FROM {_TITLE}),
u AS (SELECT o_orderkey, unnest(l) AS n, generate_subscripts(l, 1) AS i FROM f), d AS (SELECT o_orderkey, CAST(n AS INTEGER) AS n, min(i) AS i FROM u GROUP BY 1, 2)
SELECT o_orderkey, coalesce((SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) FROM d WHERE d.o_orderkey = f.o_orderkey AND n > 0), '') AS routes FROM f""")
def all_route_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return titles(spark, sf).select("o_orderkey", F.array_join(rt.all_routes(F.col("title")), ",").alias("routes"))


@query()
def segment_route_class(spark: SparkSession, sf: str) -> DataFrame:
    return rt.segment_route(titles(spark, sf), "title").groupBy("route_type", "route_raw", "route_number").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 2 THEN 'MP ' || k || '.5' END AS a_mile, CASE o_orderkey % 10 WHEN 2 THEN 'MP ' || (k + 4) || '.25' END AS b_mile,
  CAST(CASE WHEN o_orderkey % 10 = 2 THEN k + 0.5 END AS DOUBLE) AS milepost_start, CAST(CASE WHEN o_orderkey % 10 = 2 THEN k + 4.25 END AS DOUBLE) AS milepost_end,
  CASE o_orderkey % 10 WHEN 0 THEN 'MAIN ST' WHEN 1 THEN 'OAK RD' END AS a_named, CASE o_orderkey % 10 WHEN 0 THEN 'ELM AVE' WHEN 1 THEN 'I-' || (k + 2) END AS b_named FROM {_TITLE}""")
def title_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    p = tt.parse_titles(titles(spark, sf), "title")
    posted = F.col("milepost_start").isNotNull()
    named = (F.col("o_orderkey") % 10).isin(0, 1)
    return p.select("o_orderkey", F.when(posted, F.col("endpoint_a")).alias("a_mile"), F.when(posted, F.col("endpoint_b")).alias("b_mile"),
                    "milepost_start", "milepost_end", F.when(named, F.col("endpoint_a")).alias("a_named"),
                    F.when(named, F.col("endpoint_b")).alias("b_named"))


@query()
def title_precision(spark: SparkSession, sf: str) -> DataFrame:
    p = tt.parse_titles(titles(spark, sf), "title")
    return p.groupBy("precision_a", "precision_b", "project_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spend"))


@query("""
WITH t AS (SELECT p_partkey, p_name || [' MP 12', ' EXIT 4', ' AVE BRIDGE', ' STATEWIDE', ' 3 MI N OF ELM ST', ' 3 MI S OF TOWN', '', ' COUNTY LINE'][1 + p_partkey % 8] AS loc FROM part)
SELECT p_partkey, CAST([6, 5, 5, 1, 4, 3, 2, 5][1 + p_partkey % 8] AS INTEGER) AS precision FROM t""")
def precision_score(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, [" MP 12", " EXIT 4", " AVE BRIDGE", " STATEWIDE", " 3 MI N OF ELM ST", " 3 MI S OF TOWN", "", " COUNTY LINE"])),
                        (F.col("p_partkey") % 8 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", tt.precision_score(F.concat("p_name", tail)).alias("precision"))


@query()
def description_then_title(spark: SparkSession, sf: str) -> DataFrame:
    t = titles(spark, sf)
    t = t.withColumn("description", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("FROM "), F.col("k").cast("string"), F.lit(" MILE RD TO LAKE AVE")))
                     .when(F.col("o_orderkey") % 3 == 1, F.lit(" ")))
    p = tt.parse_with_fallback(t, "description", "title")
    return p.groupBy("location_source", "precision_a", "precision_b").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events""")
def json_props_flatten(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("p", json_fields(F.col("props"), "k int, `none` string"))
    return e.select("event_id", "p.k", F.col("p.none").alias("missing"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body,
  array_to_string(list_filter(list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: x <> ''), '; ') AS parts FROM pages""")
def html_collapse_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select(
        "page_id", tx.clean_text(F.regexp_replace("html", "<[^>]*>", " ")).alias("body"),
        tx.concat_repeated(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("parts"))


@query("""SELECT conv_id, turn, nullif(text, prev) AS changed FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN upper(text) ELSE role END AS prev0, CASE WHEN turn % 2 = 0 THEN text ELSE role END AS prev FROM conversations)""")
def suppress_repeated_text(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    other = F.when(F.col("turn") % 2 == 0, F.upper("text")).otherwise(F.col("role"))
    return c.select("conv_id", "turn", tx.suppress_repeat(F.col("text"), other).alias("changed"))


_WORD_SQL = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM"


@query(f"""
WITH b AS ({_WORD_SQL} benchmark), d AS ({_WORD_SQL} documents),
s AS (SELECT b.w AS word, d.w AS matched_name, 1 - jaro_similarity(b.w, d.w) AS dist FROM b, d WHERE length(b.w) >= 0.7 * length(d.w) AND length(d.w) >= 0.7 * length(b.w)),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(dist, 9), matched_name) AS rn FROM s WHERE dist <= 0.1 + 1e-12)
SELECT word, matched_name, round(dist, 8) AS match_dist FROM r WHERE rn = 1""")
def nearest_name(spark: SparkSession, sf: str) -> DataFrame:
    def words(table: str, name: str) -> DataFrame:
        found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
        texts = read(spark, sf, table).select("text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return texts.select(found.alias(name)).distinct().withColumn("pool", F.lit(1))

    out = joins.nearest_name(words("benchmark", "word"), words("documents", "name"), ["pool"], "word", "name", 0.1)
    return out.select("word", "matched_name", F.round("match_dist", 8).alias("match_dist"))


@query("""SELECT s_suppkey, p.p_brand, p.p_partkey FROM supplier JOIN part p ON CAST(regexp_extract(p.p_brand, '([0-9]+)\\s*$', 1) AS BIGINT) = s_nationkey
  AND p.p_type = CASE WHEN s_suppkey % 2 = 0 THEN 'PROMO' ELSE 'SMALL' END""")
def numbered_route_join(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("no"), F.when(F.col("s_suppkey") % 2 == 0, "PROMO").otherwise("SMALL").alias("kind"))
    p = read(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_type").alias("road_kind"))
    parts = p.select(F.struct("p_brand", "p_partkey").alias("road"), "p_brand", "road_kind")
    hits = joins.numbered_routes(s.withColumn("one", F.lit(1)), parts.withColumn("one", F.lit(1)).drop("road").distinct(), ["one"], "no", "p_brand", "road_kind", "kind")
    return joins.dealt_join(hits, p, [("p_brand", "p_brand"), ("kind", "road_kind")]).select("s_suppkey", "p_brand", "p_partkey")


@query("""
WITH h AS (SELECT l_partkey, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS tier, l_suppkey FROM lineitem), b AS (SELECT l_partkey, min(tier) AS t FROM h GROUP BY 1)
SELECT h.l_partkey, CAST(tier AS INTEGER) AS tier, l_suppkey FROM h JOIN b ON h.l_partkey = b.l_partkey AND tier = t""")
def tiered_fallback(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    h = read(spark, sf, "lineitem").select("l_partkey", tier.alias("tier"), "l_suppkey")
    return joins.first_tier(h, ["l_partkey"], "tier").select("l_partkey", "tier", "l_suppkey")


@query("""
WITH f AS (SELECT o_custkey AS k, 'big' AS how, o_orderkey AS ref FROM orders WHERE o_totalprice > 450000), s AS (SELECT o_custkey AS k, 'any' AS how, min(o_orderkey) AS ref FROM orders GROUP BY 1)
SELECT * FROM f UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM f)""")
def method_fallback(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    first = o.where("o_totalprice > 450000").select(F.col("o_custkey").alias("k"), F.lit("big").alias("how"), F.col("o_orderkey").alias("ref"))
    second = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("ref")).select("k", F.lit("any").alias("how"), "ref")
    return joins.with_fallback(o, ["k"], first, second)


@query("""
WITH a AS (SELECT c_custkey AS k, c_name, c_nationkey FROM customer WHERE c_acctbal > 0), b AS (SELECT s_suppkey AS k, s_name, s_nationkey FROM supplier)
SELECT coalesce(a.k, b.k) AS k, CAST(CASE WHEN a.k IS NULL THEN 2 WHEN b.k IS NULL THEN 1 ELSE 3 END AS INTEGER) AS merge_code, round(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN levenshtein(upper(substr(c_name, 1, length(s_name))), upper(s_name)) / length(s_name) END, 8) AS name_distance,
  CASE WHEN a.k IS NULL THEN 'right only' WHEN b.k IS NULL THEN 'left only' ELSE 'both' END AS match_group FROM a FULL OUTER JOIN b ON a.k = b.k""")
def external_record_match(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_name", F.lit("2020-01-01").cast("date").alias("d1"))
    b = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name", F.lit("2020-03-01").cast("date").alias("d2"))
    return rnd(joins.record_match(a, b, ["k"], "c_name", "s_name", "d1", "d2"), name_distance=8).select("k", "merge_code", "name_distance", "match_group")


@query("""
WITH RECURSIVE l AS (SELECT c_custkey AS l, c_nationkey AS k, c_name, min(o_orderdate) AS d1 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT s_suppkey AS r, s_nationkey AS k, s_name, min(l_shipdate) AS d2 FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL),
p AS (SELECT l.k, l, r, levenshtein(upper(substr(c_name, 1, length(s_name))), upper(s_name)) / length(s_name) AS far, datediff('day', d2, d1) AS gap FROM l JOIN r ON l.k = r.k),
q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY far, coalesce(abs(gap), 2147483647), l, r) AS n FROM p),
g AS (SELECT DISTINCT k, 0::BIGINT AS n, []::BIGINT[] AS ls, []::BIGINT[] AS rs FROM q UNION ALL
  SELECT g.k, q.n, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END,
    CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END FROM g JOIN q ON q.k = g.k AND q.n = g.n + 1),
m AS (SELECT unnest(ls) AS l, unnest(rs) AS r FROM g WHERE n = (SELECT max(n) FROM q WHERE q.k = g.k))
SELECT l.l AS c_custkey, r.r AS s_suppkey, CAST(CASE WHEN r.r IS NULL THEN 1 WHEN l.l IS NULL THEN 2 ELSE 3 END AS INTEGER) AS merge_code, round(far, 8) AS name_distance,
  CAST(gap AS INTEGER) AS date_gap, CASE WHEN r.r IS NULL THEN 'left only' WHEN l.l IS NULL THEN 'right only' ELSE 'both' END AS match_group
FROM l LEFT JOIN m ON m.l = l.l FULL OUTER JOIN r ON r.r = m.r LEFT JOIN q ON q.l = l.l AND q.r = r.r""")
def external_records_once(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers of a nation, each used once, with the gap between their first dates."""
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    first = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("d1"))
    a = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_name").join(first, "c_custkey", "left")
    shipped = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_shipdate").alias("d2"))
    b = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), "s_name").join(shipped, "s_suppkey", "left")
    out = joins.external_match(a, b, "k", "c_custkey", "s_suppkey", "c_name", "s_name", "d1", "d2")
    return rnd(out, name_distance=8).select("c_custkey", "s_suppkey", "merge_code", "name_distance", "date_gap", "match_group")


@query("""SELECT p_brand, count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#24') GROUP BY 1""")
def prefix_membership(spark: SparkSession, sf: str) -> DataFrame:
    return joins.prefix_members(read(spark, sf, "part"), "p_brand", ["Brand#1", "Brand#24"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT conv_id, n_regionkey FROM (SELECT conv_id, unnest(string_split(CAST(conv_id % 25 AS VARCHAR) || ';' || CAST(turn % 25 AS VARCHAR), ';')) AS k FROM conversations) JOIN nation ON CAST(k AS INTEGER) = n_nationkey""")
def list_key_join(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    ids = tx.split_list(F.concat_ws("; ", (F.col("conv_id") % 25).cast("string"), (F.col("turn") % 25).cast("string")))
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_regionkey")
    return joins.list_key_join(c, "conv_id", ids, n, "k", ["n_regionkey"])


@query("""
SELECT o_orderkey, CASE WHEN title LIKE 'I-%' THEN 'I' WHEN title LIKE 'US %' THEN 'U' WHEN regexp_matches(title, '^(?i)[A-Z]{2}\\s*-\\s*[0-9]+$') THEN 'S' ELSE 'M' END AS road_class FROM """ + _TITLE)
def road_class_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return titles(spark, sf).select("o_orderkey", rt.road_class(F.col("title")).alias("road_class"))


@query("""SELECT c_custkey, ['Adams', 'Oak', 'Pine Village', 'North', 'Springfield'][1 + c_custkey % 5] AS bare,
  CASE c_custkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'east' WHEN 2 THEN 'west' END AS direction, ['Elm St', 'Mill Crk', 'State Hwy', 'Lake Dr N'][1 + c_custkey % 4] AS short FROM customer""")
def name_cleaners(spark: SparkSession, sf: str) -> DataFrame:
    from roadledger.operators.places import direction_word
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (F.col("c_custkey") % n + 1).cast("int"))
    return read(spark, sf, "customer").select(
        "c_custkey", ds.strip_area_suffix(pick(["Adams County", "Oak  CDP", "Pine Village City and Borough", "North town", "Springfield"], 5)).alias("bare"),
        direction_word(pick(["Northbound", "E", "wb", "up"], 4)).alias("direction"),
        ds.abbreviate(pick(["Elm Street", "Mill Creek", "State Highway", "Lake Dr North"], 4)).alias("short"))


@query(f"""
WITH x AS (SELECT o_orderkey, k, CASE WHEN o_custkey % 8 IN (0, 1, 2, 3, 5, 6) THEN k WHEN o_orderkey % 10 = 1 THEN k + 2 END AS r, o_custkey % 100 AS fpn FROM {_TITLE})
SELECT o_orderkey, CASE WHEN r IS NOT NULL AND fpn > 0 THEN fpn = r END AS number_vs_first FROM x""")
def route_agreement(spark: SparkSession, sf: str) -> DataFrame:
    t = rt.extract_routes(titles(spark, sf), "title").withColumns({
        "fpn": F.nullif(F.col("o_custkey") % 100, F.lit(0)), "x": F.lit(None).cast("int")})
    out = ex.agreement(t, "fpn", "x", ["route_1_int"])
    return out.select("o_orderkey", F.col("number_vs_regex").alias("number_vs_first"))


@query(f"""
WITH c AS (SELECT DISTINCT c_nationkey AS nat, c_custkey % 95 + 1 AS rt FROM customer WHERE c_acctbal > 9000), x AS (SELECT o_orderkey, c_nationkey AS nat, CASE WHEN o_orderkey % 7 <> 0 THEN k END AS rt FROM {_TITLE} JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.nat = x.nat AND c.rt = x.rt) THEN 'valid' WHEN rt IS NOT NULL AND nat IN (SELECT nat FROM c) THEN 'invalid' ELSE 'unknown' END AS route_check FROM x""")
def route_in_county(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    listed = c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nat"), (F.col("c_custkey") % 95 + 1).alias("rt"))
    x = titles(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("nat"), F.when(F.col("o_orderkey") % 7 != 0, F.col("k")).alias("rt"))
    return ex.route_in_county(x, listed, "nat", "rt").select("o_orderkey", "route_check")


_Q = """SELECT *, CASE WHEN n = 2 AND lo >= 4 THEN 'possible' WHEN (n = 2 AND hi >= 4 AND lo >= 2 AND lo < 4) OR (n = 1 AND hi >= 4) THEN 'maybe'
  WHEN (n = 2 AND lo >= 2 AND hi < 4) OR (n = 1 AND hi >= 2 AND hi < 4) THEN 'unlikely' ELSE 'impossible' END AS quality FROM (
  SELECT o_orderkey, open_year, o_totalprice, o_orderkey % 3 AS n, CASE WHEN o_orderkey % 3 = 2 THEN least(o_custkey % 7, o_custkey % 5) END AS lo, greatest(o_custkey % 7, o_custkey % 5) AS hi FROM openings)"""


@query(f"""SELECT open_year, quality, count(*) AS n, round(sum(o_totalprice), 2) AS spend, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY open_year), 8) AS share FROM ({_Q}) GROUP BY 1, 2""")
def quality_by_year(spark: SparkSession, sf: str) -> DataFrame:
    from roadledger.queries.base import openings
    o = openings(spark, sf)
    n, a, b = F.col("o_orderkey") % 3, F.col("o_custkey") % 7, F.col("o_custkey") % 5
    o = o.withColumn("quality", ex.quality_class(n, F.when(n == 2, F.least(a, b)), F.greatest(a, b)))
    return rnd(ex.quality_by_year(o, "open_year", "quality", "o_totalprice"), spend=2, share=8)


@query("""
WITH r AS (SELECT o_orderkey, o_custkey % 7 AS a, o_custkey % 5 AS b, o_orderstatus = 'P' AS sw, o_custkey FROM orders),
p AS (SELECT *, CASE a WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN NULL ELSE 4 END AS pa, CASE b WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 1 END AS pb FROM r)
SELECT o_orderkey, CAST(greatest(coalesce(pa, 0), pb) AS INTEGER) AS max_precision, CAST(2 AS INTEGER) AS n_refs, CAST(CASE WHEN coalesce(pa, 0) >= pb THEN pa ELSE pb END AS INTEGER) AS first_precision,
  ['milepost', 'exit_number', 'highway', 'city', 'county', 'dot_district', 'tunnel'][1 + CASE WHEN coalesce(pa, 0) >= pb THEN a ELSE b END] AS first_type, CASE WHEN a = 3 THEN 'F3' WHEN b = 3 THEN 'G3' END AS city,
  CAST(CASE WHEN sw THEN 0 ELSE 1 END AS INTEGER) AS n_endpoints FROM p""")
def extraction_flatten(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["milepost", "exit_number", "highway", "city", "county", "dot_district", "tunnel"]))
    ref = lambda at, p: F.struct(F.element_at(kinds, (at + 1).cast("int")).alias("anchor_type"), F.concat(F.lit(p), at.cast("string")).alias("feature_name"))
    a, b = F.col("o_custkey") % 7, F.col("o_custkey") % 5
    js = F.to_json(F.struct((F.col("o_orderstatus") == "P").alias("statewide"), F.lit(False).alias("various_locs_unspecified"), F.lit(False).alias("multi_locs_specified"),
                            F.struct(F.array(ref(a, "F"), ref(b, "G")).alias("loc_refs")).alias("endpoint_a")))
    r = ex.parse_records(read(spark, sf, "orders").select("o_orderkey", js.alias("j")), "j")
    r = ex.adjusted_precision(ex.flatten_records(r.where(ex.record_is_valid(F.col("record")))))
    top = F.greatest(F.coalesce("ep_a_ref1_precision", F.lit(0)), F.coalesce("ep_a_ref2_precision", F.lit(0)))
    return r.select("o_orderkey", top.alias("max_precision"), F.col("ep_a_n_refs").alias("n_refs"), F.col("ep_a_ref1_precision").alias("first_precision"),
                    F.col("ep_a_ref1_anchor_type").alias("first_type"), F.col("ep_a_city").alias("city"), "n_endpoints")
