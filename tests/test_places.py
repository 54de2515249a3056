"""Halves of areas, near borders, crossings and one-to-one matches against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from roadledger.operators import joins, linear as ln, places as pl
from tests.conftest import rows


def star(rng, n, cx, cy):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    pts = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in ((t, rng.uniform(1, 5)) for t in turns)]
    return [*pts, pts[0]]


def test_halves_of_rings_with_holes_add_up(spark):
    rng = random.Random(12)
    data = [(a, 0, i, x, y) for a in range(12) for i, (x, y) in enumerate(star(rng, 15, 20.0 * a, 0.0))]
    data += [(a, 1, i, x, y) for a in range(4) for i, (x, y) in enumerate([(20.0 * a + dx, dy) for dx, dy in ((-.3, -.3), (-.3, .4), (.5, .4), (.5, -.3), (-.3, -.3))])]
    v = spark.createDataFrame(data, "area int, part int, seq int, x double, y double").repartition(3)
    req = spark.createDataFrame([(a * 4 + k, a, d) for a in range(12) for k, d in enumerate(("north", "south", "east", "west"))], "req int, area int, direction string")
    centres = pl.centroids(pl.boundary_edges(v, ["area"]), "area").cache()
    halves = pl.half_rings(v, centres, req, "area").cache()
    area = {r["area"]: r["area_m2"] for r in pl.ring_areas(v, ["area"]).collect()}
    part = {r["req"]: r["area_m2"] for r in pl.ring_areas(halves, ["req"]).collect()}
    for a, whole in area.items():
        assert math.isclose(part[4 * a] + part[4 * a + 1], whole) and math.isclose(part[4 * a + 2] + part[4 * a + 3], whole)
    at = {r["area"]: r for r in centres.collect()}
    for r in halves.collect():
        c = at[r["area"]]
        assert {0: r["y"] >= c["cy"] - 1e-9, 1: r["y"] <= c["cy"] + 1e-9, 2: r["x"] >= c["cx"] - 1e-9, 3: r["x"] <= c["cx"] + 1e-9}[r["req"] % 4]
    ends = halves.groupBy("req", "part").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    assert ends.where("a <> b").count() == 0
    # the outline of a half: lines of both halves together are as long as the outline
    edges = pl.boundary_edges(v, ["area"])
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    total = edges.agg(F.sum(length)).first()[0]
    both = pl.directional_half(edges.withColumn("d", F.explode(F.array(F.lit("east"), F.lit("west")))), centres, "area", "d").agg(F.sum(length)).first()[0]
    assert math.isclose(total, both)


def test_border_within_a_distance(spark):
    rng = random.Random(4)
    a, b = star(rng, 20, 0, 0), star(rng, 25, 5.0, 1.0)
    v = spark.createDataFrame([("a", 0, i, x, y) for i, (x, y) in enumerate(a)] + [("b", 0, i, x, y) for i, (x, y) in enumerate(b)],
                              "area string, part int, seq int, x double, y double")
    edges = pl.boundary_edges(v, ["area"])
    pairs = spark.createDataFrame([("a", "b")], "area string, area_other string")

    def far(p, ring):
        p, best = np.array(p), math.inf
        for s, e in zip(np.array(ring[:-1]), np.array(ring[1:])):
            t = np.clip((p - s) @ (e - s) / ((e - s) @ (e - s)), 0, 1)
            best = min(best, np.hypot(*(p - s - t * (e - s))))
        return best

    for limit, width in ((0.4, 0.5), (1.5, 7.0)):
        got = pl.border_within(edges, "area", pairs, limit, width).collect()
        length = sum(math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in got)
        steps, want = 2000, 0.0
        for s, e in zip(np.array(b[:-1]), np.array(b[1:])):
            near = [far(s + (i + .5) / steps * (e - s), a) <= limit for i in range(0, steps, 10)]
            want += np.hypot(*(e - s)) * np.mean(near)
        assert abs(length - want) < 0.06, (limit, length, want)
        for r in got:
            for t in (0.001, 0.5, 0.999):
                assert far((r["x1"] + t * (r["x2"] - r["x1"]), r["y1"] + t * (r["y2"] - r["y1"])), a) <= limit + 1e-9


def test_crossings_by_cells_along_segments(spark):
    rng = random.Random(7)
    def made(n, reach):
        return [(i, *(rng.uniform(-reach, reach) for _ in range(4))) for i in range(n)] + [(n, -50.0, 3.0, 50.0, 3.0), (n + 1, 2.0, -50.0, 2.0, 50.0)]
    one, two = made(60, 40), made(60, 25)
    a = spark.createDataFrame([("k", *r) for r in one], "k string, i int, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame([("k", *r) for r in two], "k string, j int, x1 double, y1 double, x2 double, y2 double")
    want = set()
    for i, ax, ay, bx, by in one:
        for j, cx, cy, dx, dy in two:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    want.add((i, j))
    for width in (1.0, 9.0, 300.0):
        got = rows(ln.crossings(a, b, ["k"], width), "a_i", "b_j")
        assert len(got) == len(set(got)) and set(got) == want
    cells = a.where("i = 60").select(F.size(ln.cells_along(1.0)).alias("n")).first()["n"]
    assert cells <= 2 * 101  # a long line has cells along it alone


def test_no_record_is_used_twice(spark):
    rng = random.Random(2)
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["Oak Road", "Elm Way", "Ash"]), rng.randint(0, 900)) for i in range(60)]
    right = [(1000 + i, rng.choice(["a", "b", "d", None]), rng.choice(["oak", "ELM WAY", "", "ash st"]), rng.randint(0, 900)) for i in range(40)]
    day = "date_add(DATE'2020-01-01', d)"
    a = spark.createDataFrame(left, "l int, k string, ln string, d int").selectExpr("l", "k", "ln", f"{day} AS d1")
    b = spark.createDataFrame(right, "r int, k string, rn string, d int").selectExpr("r", "k", "rn", f"{day} AS d2")
    got = joins.external_match(a, b, "k", "l", "r", "ln", "rn", "d1", "d2").collect()
    assert sorted(r["l"] for r in got if r["l"] is not None) == list(range(60)) and sorted(r["r"] for r in got if r["r"] is not None) == list(range(1000, 1040))

    def edit(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, last = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != q)))
        return row[-1]

    pairs = sorted((edit(ln_[:len(rn)].upper(), rn.upper()) / len(rn) if rn else math.inf, abs(d1 - d2), i, j)
                   for i, k, ln_, d1 in left for j, m, rn, d2 in right if k is not None and k == m)
    used, want = set(), set()
    for _, _, i, j in pairs:
        if i not in used and j not in used:
            used |= {i, j}
            want.add((i, j))
    assert {(r["l"], r["r"]) for r in got if r["merge_code"] == 3} == want
    right[0] = (1000, "b", *right[0][2:])
    b = spark.createDataFrame(right, "r int, k string, rn string, d int")
    fixed = joins.repair_keys(b, "r", "k", {1000: "z"}, drop=["d"])
    assert {r["r"]: r["k"] for r in fixed.collect()} == {i: "z" if i == 1000 else k for i, k, *_ in right if k != "d"}


def test_nearest_names_at_any_distance(spark):
    from roadledger.operators.names import jaro_batch
    import pandas as pd
    rng = random.Random(9)
    def word(): return "".join(rng.choice("aabcde ") for _ in range(rng.randint(1, 9))).strip() or "x"  # noqa: E704
    left, right = sorted({word() for _ in range(40)}), sorted({word() for _ in range(60)})
    a = spark.createDataFrame([(i % 2, w) for i, w in enumerate(left)] + [(0, None), (0, "")], "b int, n string")
    b = spark.createDataFrame([(i % 2, w) for i, w in enumerate(right)] + [(1, None)], "b int, m string")
    for limit in (0.1, 0.3, 1 / 3, 0.34, 0.5):
        want = set()
        for i, x in enumerate(left):
            pool = [w for j, w in enumerate(right) if j % 2 == i % 2]
            far = 1.0 - jaro_batch(pd.Series([x] * len(pool)), pd.Series(pool))
            best = min(zip(far, pool))
            if best[0] <= limit + 1e-12:
                want.add((i % 2, x, best[1], round(best[0], 9)))
        got = joins.nearest_name(a, b, ["b"], "n", "m", limit).collect()
        assert {(r["b"], r["n"], r["matched_name"], round(r["match_dist"], 9)) for r in got} == want, limit


def test_match_once_stores_no_pairs(spark, monkeypatch):
    stored = []
    keep = joins.cut_lineage
    monkeypatch.setattr(joins, "cut_lineage", lambda df: stored.append((out := keep(df)).count()) or out)
    a = spark.range(400).selectExpr("id AS l", "IF(id < 300, 'Elm', 'Straße') AS ln", "'x' AS k", "DATE'2020-01-01' AS d1")
    b = spark.range(100).selectExpr("id AS r", "IF(id < 90, 'elm', 'strasse') AS rn", "'x' AS k", "DATE'2020-01-03' AS d2")
    for left, right in ((a, b), (a.where("l % 40 = 0"), b)):
        got = joins.external_match(left, right, "k", "l", "r", "ln", "rn", "d1", "d2").where("merge_code = 3")
        ls = sorted(r["l"] for r in left.collect())
        # equal names first, and among equal costs the smaller ids
        want = list(zip([x for x in ls if x < 300], range(90))) + list(zip([x for x in ls if x >= 300], range(90, 100)))
        assert sorted((r["l"], r["r"], r["date_gap"], r["name_distance"]) for r in got.collect()) == [(x, y, -2, 0.0) for x, y in sorted(want)]
    assert max(stored) <= 16_000  # of 40,000 pairs; a list that is used up is followed by a longer one
