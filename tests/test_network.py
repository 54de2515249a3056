import math
import random
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from roadledger.operators import joins, linear as ln, network as nw, panels as pn, places as pl, regression as rg
from roadledger.operators import sampling as sm
from roadledger.operators.names import jaro_batch
from roadledger.session import shared_folder
from roadledger.streaming import incremental
from tests.conftest import rows


def line(spark, pts, key="r"):
    return spark.createDataFrame([(key, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "k string, seq int, x double, y double")


def test_cut_keeps_sixty_percent(spark):
    s = ln.segments(line(spark, [(0, 0), (30, 40), (30, 140), (80, 140)]), ["k"])
    total = ln.line_lengths(s, ["k"]).first()["length"]
    assert total == 200.0
    cuts = spark.createDataFrame([("r", "c", 40.0, 160.0), ("r", "p", 70.0, 70.0), ("none", "x", 0.0, 1.0)], "k string, cid string, d_from double, d_to double")
    v = ln.cut_lines(s, cuts, ["k"], ["cid"], width=30.0)
    got = rows(v, "cid", "d", "x", "y")
    assert got == sorted([("c", 40.0, 24.0, 32.0), ("c", 50.0, 30.0, 40.0), ("c", 150.0, 30.0, 140.0), ("c", 160.0, 40.0, 140.0), ("p", 70.0, 30.0, 60.0)], key=repr)
    assert rows(ln.vertex_lengths(v, ["cid"])) == [("c", 120.0), ("p", 0.0)]


def test_locate_matches_brute_force(spark):
    random.seed(3)
    pts = [(random.random() * 1000, random.random() * 1000) for _ in range(300)]
    s = ln.segments(line(spark, pts), ["k"])
    probes = [(i, random.random() * 1000, random.random() * 1000) for i in range(60)]
    df = spark.createDataFrame([("r", i, x, y) for i, x, y in probes], "k string, pid int, px double, py double")
    got = {r["pid"]: r["offset"] for r in ln.locate(df, s, ["k"], ["pid"], fan=8, levels=2).collect()}
    for i, px, py in probes:
        best = 1e18
        for (x1, y1), (x2, y2) in zip(pts[:-1], pts[1:]):
            dx, dy = x2 - x1, y2 - y1
            t = min(1, max(0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x1 + t * dx - px, y1 + t * dy - py))
        assert abs(best - got[i]) < 1e-6


def test_projection_origin_and_known_point(spark, monkeypatch):
    # the published worked example uses the Clarke 1866 ellipsoid
    monkeypatch.setattr(ln, "_A", 6378206.4)
    monkeypatch.setattr(ln, "_E2", 0.00676866)
    df = spark.createDataFrame([(-96.0, 23.0), (-75.0, 35.0)], "lon double, lat double")
    x, y = ln.project_albers(F.col("lon"), F.col("lat"))
    got = df.select(x.alias("x"), y.alias("y")).collect()
    assert abs(got[0]["x"]) < 1e-6 and abs(got[0]["y"]) < 1e-6
    assert abs(got[1]["x"] - 1885472.7) < 5 and abs(got[1]["y"] - 1535925.0) < 5


def test_components_and_parts(spark):
    random.seed(5)
    pairs = [(f"n{random.randint(0, 60)}", f"n{random.randint(0, 60)}") for _ in range(45)]
    got = dict(rows(nw.components(spark.createDataFrame(pairs, "a string, b string"))))
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        ra, rb = sorted((find(a), find(b)))
        root[rb] = ra
    assert all((find(a) == find(b)) == (got[a] == got[b]) for a in root for b in root)
    assert all(got[v] <= v for v in got)
    # a path of four edges drawn in mixed directions, a loop of three, and a junction
    e = [("r", 1, "a", "b"), ("r", 2, "c", "b"), ("r", 3, "c", "d"), ("r", 4, "e", "d"), ("r", 5, "x", "y"), ("r", 6, "y", "z"), ("r", 7, "z", "x"),
         ("r", 8, "p", "q"), ("r", 9, "q", "s"), ("r", 10, "q", "t")]
    df = spark.createDataFrame([(*v, float(v[1])) for v in e], "k string, eid int, a string, b string, len double")
    m = {r["eid"]: r for r in nw.merge_parts(df, ["k"]).collect()}
    assert len({m[i]["part"] for i in (1, 2, 3, 4)}) == 1 and len({m[i]["part"] for i in (5, 6, 7)}) == 1
    assert len({m[i]["part"] for i in m}) == 5
    order = [m[i]["place"] for i in (1, 2, 3, 4)]
    assert order in ([0, 1, 2, 3], [3, 2, 1, 0]) and sorted(m[i]["place"] for i in (5, 6, 7)) == [0, 1, 2]
    walk = {m[i]["forward"] for i in (1, 3)}
    assert walk != {m[i]["forward"] for i in (2, 4)} and len(walk) == 1
    ends = sorted((m[i]["start_at"], m[i]["len"]) for i in (1, 2, 3, 4))
    assert ends[0][0] == 0 and all(abs(a + le - b) < 1e-9 for (a, le), (b, _) in zip(ends[:-1], ends[1:]))
    assert {r["eid"] for r in nw.longest_part(nw.merge_parts(df, ["k"]), ["k"]).collect()} == {5, 6, 7}


def _edges(spark, items, snap=1.0):
    data, segs = [], []
    for k, eid, (x1, y1), (x2, y2) in items:
        data.append((k, eid, f"{round(x1)}:{round(y1)}", f"{round(x2)}:{round(y2)}", math.hypot(x2 - x1, y2 - y1)))
        segs.append((eid, float(x1), float(y1), float(x2), float(y2)))
    return (spark.createDataFrame(data, "k string, eid long, a string, b string, len double"),
            spark.createDataFrame(segs, "eid long, x1 double, y1 double, x2 double, y2 double"))


def test_stitch_takes_shortest_bridges_once(spark):
    matched, _ = _edges(spark, [("r", 1, (0, 0), (100, 0)), ("r", 2, (150, 0), (300, 0)), ("r", 3, (400, 0), (500, 0)), ("one", 9, (0, 900), (10, 900))])
    fill, segs = _edges(spark, [("", 11, (100, 0), (150, 0)), ("", 12, (100, 0), (125, 60)), ("", 13, (125, 60), (150, 0)), ("", 14, (300, 0), (350, 20)),
                                ("", 15, (350, 20), (400, 0)), ("", 16, (500, 0), (9000, 0)), ("", 17, (0, 0), (0, 3000)), ("", 18, (0, 3000), (500, 0))])
    got = rows(nw.stitch(matched, fill, segs, "k", snap=1.0, ratio=1.5, max_metres=200.0, buffer=200.0))
    assert got == [("r", 11), ("r", 14), ("r", 15)]


def test_stitch_looks_at_joined_fill_only(spark, monkeypatch):
    near, find = [], nw.edges_near_points
    monkeypatch.setattr(nw, "edges_near_points", lambda *a: near.append((out := find(*a)).count()) or out)
    matched, _ = _edges(spark, [("r", 1, (0, 0), (100, 0)), ("r", 2, (150, 0), (300, 0))])
    loose = [("", 100 + i, (i, 40 + i), (i + 50, 41 + i)) for i in range(60)]
    fill, segs = _edges(spark, [("", 11, (100, 0), (120, 5)), ("", 12, (120, 5), (150, 0)), ("", 13, (120, 5), (130, 30)), ("", 14, (300, 0), (900, 0)), *loose])
    got = rows(nw.stitch(matched, fill, segs, "k", snap=1.0, ratio=1.5, max_metres=200.0, buffer=200.0))
    assert got == [("r", 11), ("r", 12)]
    assert near == [3]  # neither the 60 edges joined to nothing nor the one longer than any path


def test_crop_inner_rule(spark):
    parts = ln.segments(line(spark, [(0, 0), (1000, 0)], "p"), ["k"]).withColumn("part", F.lit(0))
    ends = spark.createDataFrame([("p", "a", 1, 200.0, 0.0), ("p", "a", 2, 300.0, 0.0), ("p", "b", 3, 800.0, 50.0)], "k string, endpoint string, vid int, x double, y double")
    cropped, v = ln.crop_routes(parts, ends, "k", "part")
    r = cropped.first()
    assert (r["crop_from"], r["crop_to"], r["src_a"], r["src_b"]) == (0.3, 0.8, "intersect", "nearest")
    assert rows(ln.vertex_lengths(v, ["k"])) == [("p", 500.0)]
    q = ln.crop_quality(ln.crop_summary(cropped, parts, "k", "part")).first()
    assert q["n"] == 1 and q["failed"] == 0 and q["med_corr_km"] == 0.5
    x = ln.crossings(parts.select("k", "x1", "y1", "x2", "y2"), spark.createDataFrame([("p", 500.0, -5.0, 500.0, 5.0)], "k string, x1 double, y1 double, x2 double, y2 double"), ["k"], 100.0)
    assert rows(x, "x", "y") == [(500.0, 0.0)]


def test_crop_with_shapes(spark):
    parts = ln.segments(line(spark, [(0, 0), (1000, 0)], "p"), ["k"]).withColumn("part", F.lit(0))
    ends = spark.createDataFrame([("p", "a", 1, 20.0, -50.0), ("p", "a", 2, 20.0, 50.0), ("p", "b", 1, 990.0, -40.0), ("p", "b", 2, 1010.0, -30.0), ("p", "b", 3, 990.0, 5.0)],
                                 "k string, endpoint string, vid int, x double, y double")
    lines = ln.segments(ends.where("endpoint = 'a' or vid < 3"), ["k", "endpoint"], "vid")
    r = ln.endpoint_ranges(parts, ends, "k", "part", lines=lines).first()
    assert (r["lo_a"], r["hi_a"], r["dist_a"], r["src_a"]) == (0.02, 0.02, 0.0, "intersect")
    assert (r["dist_b"], r["lo_b"], r["src_b"]) == (5.0, 0.99, "nearest")
    cropped, _ = ln.crop_routes(parts, ends, "k", "part", max_metres=1.0, lines=lines)
    far = ln.crop_summary(cropped, parts, "k", "part", ln.endpoint_ranges(parts, ends, "k", "part", lines=lines)).first()
    assert (far["n_parts_kept"], far["part_dist_m"]) == (0, 5.0)


def test_jaro_and_name_join(spark):
    sim = jaro_batch(pd.Series(["martha", "dwayne", "dixon", "abc", ""]), pd.Series(["marhta", "duane", "dicksonx", "xyz", ""]))
    assert [round(v, 4) for v in sim] == [0.9444, 0.8222, 0.7667, 0.0, 1.0]
    random.seed(11)
    names = sorted({"".join(random.choice("abcdef ") for _ in range(random.randint(1, 9))).strip() or "z" for _ in range(150)})
    left, right = names[::3], names[1::3] + names[2::3]
    a = spark.createDataFrame([("s", n) for n in left], "b string, l string")
    b = spark.createDataFrame([("s", n) for n in right], "b string, r string")
    got = {r["l"]: (round(r["match_dist"], 9), r["matched_name"]) for r in joins.nearest_name(a, b, ["b"], "l", "r", 0.2).collect()}
    want = {}
    for n in left:
        d = 1 - jaro_batch(pd.Series([n] * len(right)), pd.Series(right))
        best = min((round(v, 9), r) for v, r in zip(d, right))
        if best[0] <= 0.2 + 1e-9:
            want[n] = best
    assert got == want


def test_allocation_conserves_spend(spark):
    random.seed(2)
    chains = spark.createDataFrame([(i, random.choice("ab"), random.choice([1970, 1972, 1990, None]), random.random() + 0.1) for i in range(30)],
                                   "cid int, cell string, oy int, miles double")
    actual = spark.createDataFrame([(c, y, random.random() * 10) for c in "abz" for y in range(1968, 1995)], "cell string, y int, amount double")
    profile = spark.createDataFrame([(t, max(0.0, 3.0 - abs(t))) for t in range(-5, 6)], "event_time int, f double")
    out = pn.allocate_spend(chains, actual, profile, ["cell"], "cid", "oy", "miles", "y", {"amount": "f"})
    assert out.count() == 30 and out.where("oy IS NULL AND est_amount IS NOT NULL").count() == 0
    assert all(r["gap"] < 1e-6 for r in pn.allocation_gap(out, actual, ["cell"], "est_amount", "amount").collect())


def test_fixed_effects_match_dummies(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    n = 200
    s, t = rng.integers(0, 7, n), rng.integers(0, 5, n)
    x, w = rng.normal(size=n), rng.random(n) + 0.5
    y = 2 * x + s - 0.5 * t + rng.normal(size=n)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d), float(e)) for a, b, c, d, e in zip(s, t, x, w, y)], "s int, t int, x double, w double, y double")
    fit = rg.fixed_effects(df, "y", ["x"], first="s", second="t", weight="w", cluster="s").first()
    d = np.column_stack([x, *[(s == i) * 1.0 for i in range(7)], *[(t == i) * 1.0 for i in range(1, 5)]])
    a = d.T @ (d * w[:, None])
    beta = np.linalg.solve(a, d.T @ (w * y))
    u = y - d @ beta
    scores = np.array([(d * (w * u)[:, None])[s == i].sum(axis=0) for i in range(7)])
    cov = np.linalg.inv(a) @ (scores.T @ scores) @ np.linalg.inv(a) * (7 / 6) * ((n - 1) / (n - d.shape[1]))
    assert abs(fit["estimate"] - beta[0]) < 1e-8 and abs(fit["se"] - math.sqrt(cov[0, 0])) < 1e-8


def test_sampling_is_exact_when_split(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 400, "big").otherwise("small").alias("s"))
    a = rows(sm.stratified_sample(df, "id", ["s"], 51, "x"))
    assert a == rows(sm.stratified_sample(df, "id", ["s"], 51, "x")) and len(a) == 51
    assert rows(sm.allocate_strata(df, ["s"], 51), "s", "allocated") == [("big", 41), ("small", 10)]


def test_areas(spark):
    ring = lambda a, x: [(a, 0, i, float(x + dx), float(dy)) for i, (dx, dy) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])]
    v = spark.createDataFrame(ring("A", 0) + ring("B", 2), "area string, part int, seq int, x double, y double")
    e = pl.boundary_edges(v, ["area"])
    assert rows(pl.neighbours(v, "area")) == [("A", "B"), ("B", "A")]
    req = spark.createDataFrame([(1, "A", None), (2, "A", "north"), (3, "A", None)], "req int, area string, direction string")
    best = spark.createDataFrame([(1, "B")], "req int, area_other string")
    names = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "area string, name string")
    kinds = pl.boundary_reference(req, e, names, "area", best).groupBy("req", "kind").count()
    assert rows(kinds) == [(1, "shared", 1), (2, "half", 3), (3, "outline", 4)]


def test_incremental_enrichment(spark, tmp_path):
    def provider(batches):
        for b in batches:
            yield b.assign(result=b["k"] * 10)

    req = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    done = spark.createDataFrame([(2, 99)], "k long, result long")
    out = incremental.enrich(req, done, ["k"], provider, "k long, result long")
    assert rows(out, "k", "result", "status") == [(1, 10, "new"), (2, 99, "reused"), (3, 30, "new")]
    src, res, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for part in ([1, 2], [2, 3]):
        spark.createDataFrame([(k,) for k in part], "k long").coalesce(1).write.mode("append").parquet(src)
        incremental.run_incremental(spark.readStream.schema("k long").parquet(src), res, chk, ["k"], provider, "k long, result long")
    assert rows(spark.read.parquet(res), "k", "result") == [(1, 10), (2, 20), (3, 30)]


def test_components_work_out_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    edges = spark.range(40).select(counted("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in nw.components(edges).collect()} == {0}
    assert seen.value == 40


def test_edges_side_by_side_are_near_once(spark):
    """Twenty edges between the same nodes: a route keeps the shortest near one, ties to the least id, but not its own."""
    matched, _ = _edges(spark, [("r", 1, (0, 0), (100, 0)), ("r", 2, (150, 0), (300, 0)), ("s", 3, (0, 0), (100, 0)), ("s", 11, (100, 0), (150, 0))])
    beside = [("", 11 + i, (100, 0), (150, 0)) for i in range(20)]
    fill, segs = _edges(spark, beside)
    assert rows(nw.stitch(matched, fill, segs, "k", snap=1.0, max_metres=200.0, buffer=200.0)) == [("r", 11)]
    points = spark.createDataFrame([("r", 100.0, 0.0), ("r", 150.0, 0.0), ("s", 100.0, 0.0)], "k string, px double, py double")
    listed = segs.join(fill.select("eid", "a", "b", "len"), "eid").withColumn("len", F.when(F.col("eid") % 2 == 0, F.col("len")).otherwise(F.col("len") + 1))
    near = nw.edges_near_points(points, listed, ["k"], ["eid"], 200.0, None, (["a", "b"], "len"), ~((F.col("k") == "s") & (F.col("eid") == 12)))
    assert rows(near) == [("r", 12), ("s", 14)]


def test_paths_and_components_keep_no_earlier_round(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {f.name for f in folder.iterdir()}
    edges, _ = _edges(spark, [("r", i, (10 * i, 0), (10 * i + 10, 0)) for i in range(12)])
    assert nw.components(edges).select("component").distinct().count() == 1
    paths = nw.bounded_paths(edges, spark.createDataFrame([("r", "0:0")], "k string, node string"), "k", 65.0)
    assert sorted(r["dist"] for r in paths.collect()) == [10.0 * i for i in range(7)]
    assert sorted(f.name.split("-")[0] for f in folder.iterdir() if f.name not in before) == ["edges", "edges", "paths"]
