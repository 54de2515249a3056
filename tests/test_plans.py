"""How heavy queries are planned: steps worked out once, listed sides, tables of one split."""

from pyspark.sql import functions as F

from roadledger.functions import designations
from roadledger.llm import quality
from roadledger.operators import joins, linear as ln
from roadledger.operators import places as pl
from roadledger.queries import REGISTRY
from roadledger.session import cut_lineage
from tests.conftest import rows


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_cut_on_the_route_that_the_spot_belongs_to(spark, tmp_path):
    """Two routes on one line: the spots of the longer one lie on the shorter one too and must not widen its cut."""
    at = F.timestamp_seconds(F.lit(28401120 * 60) + F.col("id") * 600)
    events = [spark.range(n).select((F.col("id") + first).alias("event_id"), at.alias("ts"), F.lit(user).cast("long").alias("user_id"),
                                    F.lit("view").alias("event_type"), F.lit(1.0).alias("value")) for user, n, first in ((0, 11, 0), (150, 21, 100))]
    events[0].unionByName(events[1]).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(4, 300)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["route"]: (r["cut_from"], r["cut_to"]) for r in REGISTRY["crop_by_route"].run(spark, str(tmp_path)).collect()}
    assert got == {0: (10.0, 55.0), 150: (20.0, 110.0)}


def test_crop_routes_cuts_the_vertices(spark, tmp_path):
    """The line runs along y = 10 from x = 0 to 100 in steps of 10; user 1 has no purchase, so nothing of its route is kept."""
    at = F.timestamp_seconds(F.lit(28401120 * 60) + F.col("id") * 600)
    kind = F.when(F.col("id") == 2, "signup").when((F.col("id") == 7) & (F.col("user_id") == 0), "purchase").otherwise("view")
    users = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("user_id")
    spark.range(11).select("id", users).select((F.col("id") + 100 * F.col("user_id")).alias("event_id"), at.alias("ts"), "user_id",
                                               kind.alias("event_type"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    out = REGISTRY["crop_routes"].run(spark, str(tmp_path))
    assert rows(out, "user_id", "n_parts_kept", "len_crop_m", "n_vertices") == [(0, 1, 50.0, 6), (1, 0, None, 0)]


def test_wide_windows_list_an_opening_twice_at_most_and_are_not_broadcast(spark, tmp_path):
    opened = spark.createDataFrame([(1, y) for y in range(-3, 4)] + [(None, 0), (2, None)], "k int, open int")
    records = spark.createDataFrame([(1, y) for y in range(-9, 10)] + [(None, 0), (2, None)], "k int, yr int")
    opened.write.parquet(f"{tmp_path}/opened")
    opened = spark.read.parquet(f"{tmp_path}/opened")
    for before, after in ((0, 2), (9, 7), (3, 0)):
        out = joins.window_match(opened, records, ["k"], "open", "yr", before, after)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["open"], r["yr"], r["yr_gap"]) for r in out.collect())
        assert got == sorted((o, y, y - o) for o in range(-3, 4) for y in range(-9, 10) if o - before <= y <= o + after)


def test_points_of_one_split_are_dealt_out_before_they_meet(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(20)], "p int, x double, y double").coalesce(1)
    others = spark.createDataFrame([(i, float(i), 1.0) for i in range(20)], "o int, x double, y double").coalesce(1)
    out = joins.within_distance(points, others, 1.5)
    assert "Repartition 4, true" in plan(out)
    assert sorted((r["p"], r["o"]) for r in out.collect()) == [(i, j) for i in range(20) for j in range(20) if abs(i - j) <= 1]


def test_border_steps_are_written_out_once(spark):
    square = [(a, a + x1, y1, a + x2, y2) for a in (0, 1) for x1, y1, x2, y2 in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))]
    edges = spark.createDataFrame([(a, *map(float, r)) for a, *r in square], "area int, x1 double, y1 double, x2 double, y2 double")
    near = pl.border_within(edges, "area", spark.createDataFrame([(0, 1)], "area int, area_other int"), 0.1, width=0.75)
    assert plan(near).count("SQRT(") < 10
    assert near.select(F.round(F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))), 6)).first()[0] == 1.2


def test_reference_names_are_squished_once(spark):
    df = spark.createDataFrame([("A - B  County Line", "county_line", "north", "Ohio", "A County")], "f string, a string, d string, s string, c string")
    out = designations.normalise_reference(df.withColumn("f", F.concat("f", F.lit(""))), "f", "a", "d", "s", "c")
    assert df.columns + ["extracted_direction", "feature_clean"] == out.columns
    assert plan(out).count("regexp_replace(") < 100
    assert out.select("feature_clean", "extracted_direction").first() == ("B", "north")


def test_kept_documents_are_not_judged_by_a_pushed_filter(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "too short")], "doc_id long, text string")
    out = quality.quality_filter(docs, docs.select("doc_id"), buckets=16, prior=2.0)
    assert plan(out).count("xxhash64(") < 20
    assert [r["doc_id"] for r in out.collect()] == [1]


def test_crops_of_stored_ranges_do_not_locate_the_ends_again(spark):
    v = spark.createDataFrame([(u, 0, i, 10.0 * i, 0.0) for u in (1, 2) for i in range(4)], "u int, part int, seq int, x double, y double")
    parts = ln.segments(v, ["u", "part"])
    ends = spark.createDataFrame([(u, e, 0, x, 1.0) for u in (1, 2) for e, x in (("a", 3.0), ("b", 24.0))], "u int, endpoint string, vid int, x double, y double")
    ranges = cut_lineage(ln.endpoint_ranges(parts, ends, "u", "part"))
    (own, _), (again, _) = ln.crop_routes(parts, ends, "u", "part", ranges=ranges), ln.crop_routes(parts, ends, "u", "part")
    assert "Join" not in plan(own) and "Join" in plan(again)
    assert rows(own) == rows(again.select(*own.columns))


def test_only_keys_of_many_rows_are_scanned_in_parts(spark, monkeypatch):
    left = spark.createDataFrame([(k, x) for k, n in ((1, 9), (2, 2), (None, 4)) for x in range(n)], "k int, x int")
    right = spark.createDataFrame([(k, y) for k, n in ((1, 3), (2, 7), (None, 6), (3, 1)) for y in range(n)], "k int, y int")

    def merged():
        return joins.positional_merge(left, right, ["k"], ["x"], ["y"], F.floor(F.col("x") / 2), F.floor(F.col("y") / 2))

    assert f"> {joins.FEW_ROWS}" in plan(merged())
    whole = rows(merged(), "k", "x", "y", "merge_code")
    monkeypatch.setattr(joins, "FEW_ROWS", 3)
    assert rows(merged(), "k", "x", "y", "merge_code") == whole
    assert [r for r in whole if r[0] == 1] == [(1, x, min(x, 2), 3) for x in range(9)] and len(whole) == 9 + 7 + 6 + 1
