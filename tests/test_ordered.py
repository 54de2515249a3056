"""Split scans must equal plain windows, whatever counts as a hot group."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadledger.operators import intervals as iv
from roadledger.operators import ordered as od
from tests.conftest import rows


def _table(spark, data):
    return spark.createDataFrame([(k, p, i, v) for i, (k, p, v) in enumerate(data)],
                                 "k string, p int, i int, v double")


pairs = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 30),
                           st.one_of(st.none(), st.integers(-5, 5).map(float))), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=pairs)
def test_split_scan_equals_window(spark, data):
    df = _table(spark, data)
    args = dict(lag={"lg": "v"}, lead={"ld": "v"}, total={"t": "v"}, rank="r", first={"f": "v"}, ahead={"ah": ("p", 3)})
    plain = od.ordered(df, ["k"], ["p", "i"], **args)
    split = od.ordered(df, ["k"], ["p", "i"], **args, split=F.floor(F.col("p") / 7))
    assert "__part" not in split.columns
    assert rows(plain) == rows(split.select(*plain.columns))


def test_split_scan_over_whole_table(spark):
    df = _table(spark, [("a", p, 1.0) for p in range(20)])
    out = od.ordered(df, [], ["p", "i"], rank="r", total={"t": "v"}, split=F.floor(F.col("p") / 3))
    assert rows(out, "p", "r", "t") == sorted(((p, p + 1, float(p + 1)) for p in range(20)), key=repr)


def test_rows_without_a_position_form_the_first_part(spark):
    df = spark.createDataFrame([("a", None, 0, 2.0), ("a", None, 1, 3.0), ("a", 4, 2, 5.0), ("a", 40, 3, None)],
                               "k string, p int, i int, v double")
    args = dict(lag={"lg": "i"}, lead={"ld": "i"}, total={"t": "v"}, rank="r", first={"f": "v"})
    want = [(0, None, 1, 2.0, 1, 2.0), (1, 0, 2, 5.0, 2, 2.0), (2, 1, 3, 10.0, 3, 2.0), (3, 2, None, 10.0, 4, 2.0)]
    for width in (1, 7, 100):
        out = od.ordered(df, ["k"], ["p", "i"], **args, split=F.floor(F.col("p") / width))
        assert sorted(map(tuple, out.select("i", "lg", "ld", "t", "r", "f").collect())) == want


def test_range_window_equals_window(spark):
    random.seed(1)
    df = spark.createDataFrame([(random.choice("ab"), random.randint(1990, 2000), random.random()) for _ in range(60)],
                               "k string, y int, v double")
    got = od.range_window_sum(df, ["k"], "y", {"v": "v"}, 2, 2)
    w = Window.partitionBy("k").orderBy("y").rangeBetween(-2, 2)
    want = df.groupBy("k", "y").agg(F.sum("v").alias("v")).withColumn("w", F.sum("v").over(w))
    a = [(k, y, round(x, 9)) for k, y, x in rows(got, "k", "y", "v_win")]
    assert a == [(k, y, round(x, 9)) for k, y, x in rows(want, "k", "y", "w")]


def test_chain_tolerance_and_null_keys(spark):
    df = spark.createDataFrame([
        ("r", 1, 0.0, 1.0), ("r", 1, 1.009, 2.0), ("r", 1, 2.011, 3.0), ("r", 2, 3.0, 4.0), (None, 1, 0.0, 1.0), (None, 1, 1.0, 2.0)],
        "route string, month int, s double, e double")
    out = iv.chain(df, ["route", "month"], "s", "e", ["e"])
    keys = {(r["route"], r["month"], r["s"]): (r["chain_seq"], r["chain_key"]) for r in out.collect()}
    assert [keys[("r", 1, s)][0] for s in (0.0, 1.009, 2.011)] == [1, 1, 2]
    assert keys[("r", 2, 3.0)][0] == 1
    assert keys[(None, 1, 0.0)][0] is None and keys[(None, 1, 0.0)][1] != keys[(None, 1, 1.0)][1]
    assert len({k for _, k in keys.values()}) == 5


def _reference_drop(starts, lengths, depth=5):
    n, gone, i = len(starts), set(), 0
    while i < n:
        end = starts[i] + lengths[i]
        if i + 1 < n and not abs(starts[i + 1] - end) < 100:
            i += 1
            if end > starts[i] - 50:
                for _ in range(depth):
                    if i + 1 < n and abs(starts[i + 1] - end) < abs(starts[i] - end):
                        gone.add(i)
                        i += 1
        i += 1
    return [s for k, s in enumerate(starts) if k not in gone]


def test_overlap_removal_matches_a_plain_scan(spark):
    random.seed(7)
    data, want = [], {}
    for route in ("x", "y", "z"):
        starts = sorted(random.sample(range(0, 4000, 7), 60))
        lengths = [random.choice([50, 100, 400, 900]) for _ in starts]
        data += [(route, float(s), float(le)) for s, le in zip(starts, lengths)]
        want[route] = [float(s) for s in _reference_drop(starts, lengths)]
    df = spark.createDataFrame(data, "route string, s double, l double")
    for block in (4, 50_000):
        out = iv.drop_overlaps(df, ["route"], "s", "l", [], block_rows=block, split=F.floor(F.col("s") / 500))
        got = {}
        for r, s in rows(out, "route", "s"):
            got.setdefault(r, []).append(s)
        assert {r: sorted(v) for r, v in got.items()} == want


def test_gap_rows_and_group_values(spark):
    df = spark.createDataFrame([("a", 10.0, 5.0, "x"), ("a", 200.0, 1.0, "y")], "k string, s double, l double, d string")
    out = iv.gap_rows(df, ["k"], "s", "l", [], ["d"], 100)
    assert rows(out, "s", "l", "d", "is_fill") == sorted(
        [(0.0, 10.0, None, 1), (10.0, 5.0, "x", 0), (15.0, 185.0, None, 1), (200.0, 1.0, "y", 0)], key=repr)
    assert od.with_group_values(df, [], n=F.count(F.lit(1))).first()["n"] == 2


def test_dense_ids_count_from_one_in_key_order(spark):
    keys = [(None if i == 7 else f"k{i % 500:03d}", i // 500) for i in range(1500)]
    df = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "a string, b int, v int").repartition(7)
    got = {r["v"]: r["id"] for r in od.dense_ids(df, ["a", "b"]).collect()}
    rank = {v: n for n, (_, v) in enumerate(sorted(((a is not None, a or "", b), v) for v, (a, b) in enumerate(keys)), 1)}
    assert got == rank
    assert od.dense_ids(df.where("v < 0"), ["a"]).collect() == []


def test_even_parts_hold_for_skewed_values(spark):
    rng = random.Random(3)
    data = [("hot", rng.choice([rng.random(), 1e9 * rng.random(), 1e-9 * rng.random()]), i) for i in range(6000)]
    data += [("few", float(i % 5), i) for i in range(6000, 6050)] + [("hot", None, 7000), (None, 1.0, 7001), (None, -1.0, 7002)]
    df = spark.createDataFrame(data, "k string, v double, i int").repartition(5)
    tagged = od.even_parts(df, ["k"], "v", rows=100, points=256)
    sizes = tagged.groupBy("k", "__part").count().where("k = 'hot' AND __part IS NOT NULL").select("count").collect()
    assert 55 <= len(sizes) <= 70 and max(r[0] for r in sizes) <= 200
    assert tagged.where("k = 'few'").select("__part").distinct().count() == 1
    got = od.drop_parts(od.ordered(tagged, ["k"], ["v", "i"], lag={"p": "i"}, lead={"n": "i"}, total={"t": "i"}, rank="r"))
    w = Window.partitionBy("k").orderBy("v", "i")
    want = df.withColumns({"p": F.lag("i").over(w), "n": F.lead("i").over(w), "t": F.sum("i").over(w), "r": F.row_number().over(w).cast("long")})
    assert rows(got, *want.columns) == rows(want)


def test_group_numbers_and_keys_are_exact(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("ab", ""), ("", "ab"), (None, "-"), ("-", None), (None, None), ("1:a", "b")], "x string, y string")
    got = od.group_ids(df, ["x", "y"], "g").withColumn("k", od.group_key(["x", "y"]))
    assert sorted(r["g"] for r in got.collect()) == [1, 2, 3, 4, 5, 6, 6, 7]
    assert got.select("g").distinct().count() == got.select("k").distinct().count() == got.select("x", "y").distinct().count() == 7
