"""Effects of any size, collinear terms, fallbacks and reference years against explicit dummies."""

import math

import numpy as np
from pyspark.sql import functions as F

from roadledger.operators import regression as rg


def explicit(y, x, w, s, t, cluster, counted=None):
    """Estimates and clustered errors with one dummy per level (pseudo-inverse, so empty directions do not matter)."""
    d = np.column_stack([x, *[(s == i) * 1.0 for i in np.unique(s)], *[(t == i) * 1.0 for i in np.unique(t)]])
    a = np.linalg.pinv(d.T @ (d * w[:, None]), rcond=1e-11)
    beta = a @ d.T @ (w * y)
    scores = d * (w * (y - d @ beta))[:, None]
    by = np.array([scores[cluster == g].sum(0) for g in np.unique(cluster)])
    rank = counted or np.linalg.matrix_rank(d)
    g, n = len(by), len(y)
    cov = a @ by.T @ by @ a * (g / (g - 1)) * ((n - 1) / (n - rank))
    return beta[:x.shape[1]], np.sqrt(np.diag(cov))[:x.shape[1]]


def made(n, levels_s, levels_t, seed=0):
    rng = np.random.default_rng(seed)
    s, t, c = rng.integers(0, levels_s, n), rng.integers(0, levels_t, n), rng.integers(0, 40, n)
    x = rng.normal(size=(n, 2)) + (s % 3)[:, None]
    w = rng.random(n) + 0.1
    return 2 * x[:, 0] - x[:, 1] + s - 0.01 * t + rng.normal(size=n), x, w, s, t, c


def frame(spark, y, x, w, s, t, c):
    return spark.createDataFrame([(float(a), float(b[0]), float(b[1]), float(d), int(e), int(f), int(g)) for a, b, d, e, f, g in zip(y, x, w, s, t, c)],
                                 "y double, x1 double, x2 double, w double, s int, t int, c int").repartition(4)


def test_two_effects_by_turns_equal_explicit_dummies(spark):
    data = made(900, 60, 150)
    fit = rg.fixed_effects(frame(spark, *data), "y", ["x1", "x2"], first="s", second="t", weight="w", cluster="c", max_levels=3).collect()
    beta, se = explicit(*data)
    assert np.allclose([r["estimate"] for r in fit], beta, atol=1e-7) and np.allclose([r["se"] for r in fit], se, atol=1e-7)


def test_five_thousand_levels_equal_the_dense_form(spark):
    y, x, w, s, t, c = made(16000, 200, 5000)
    df = frame(spark, y, x, w, s, t, c)
    wide = rg.fixed_effects(df, "y", ["x1", "x2"], first="s", second="t", weight="w", cluster="c").collect()
    # the many levels taken out in closed form, the others as explicit dummies
    d = np.column_stack([x, y, *[(s == i) * 1.0 for i in range(200)]])
    mean = np.zeros((5000, d.shape[1]))
    np.add.at(mean, t, d * w[:, None])
    d = d - (mean / np.maximum(np.bincount(t, w, 5000), 1e-300)[:, None])[t]
    f = np.column_stack([d[:, :2], d[:, 3:]])
    inverse = np.linalg.pinv(f.T @ (f * w[:, None]), rcond=1e-11)
    beta = inverse @ f.T @ (w * d[:, 2])
    scores = f * (w * (d[:, 2] - f @ beta))[:, None]
    by = np.array([scores[c == g].sum(0) for g in np.unique(c)])
    rank = 2 + len(np.unique(s)) + len(np.unique(t)) - 1
    se = np.sqrt(np.diag(inverse @ by.T @ by @ inverse * (40 / 39) * (15999 / (16000 - rank))))
    assert np.allclose([r["estimate"] for r in wide], beta[:2], atol=1e-6) and np.allclose([r["se"] for r in wide], se[:2], atol=1e-6)


def test_levels_without_ties_and_empty_input(spark):
    y, x, w, s, t, c = made(300, 10, 20)
    t = t + 100 * (s % 2)  # two groups of levels that no row ties together
    data = (y, x, w, s, t, c)
    fit = rg.fixed_effects(frame(spark, *data), "y", ["x1", "x2"], first="s", second="t", weight="w", cluster="c", max_levels=1).collect()
    beta, se = explicit(*data)
    assert np.allclose([r["estimate"] for r in fit], beta, atol=1e-7) and np.allclose([r["se"] for r in fit], se, atol=1e-7)
    none = rg.fixed_effects(frame(spark, *data).where("y > 1e9"), "y", ["x1"], first="s", second="t").collect()
    assert [(r["term"], r["estimate"], r["n"]) for r in none] == [("x1", None, 0)]


def test_collinear_terms_are_named(spark):
    y, x, w, s, t, c = made(400, 12, 8)
    df = frame(spark, y, x, w, s, t, c).withColumns({"twice": F.col("x1") * 2 + F.col("x2"), "of_s": F.col("s") * 3.0})
    fit = {r["term"]: r["estimate"] for r in rg.fixed_effects(df, "y", ["of_s", "x1", "x2", "twice"], first="s", second="t").collect()}
    assert fit["of_s"] is None and fit["twice"] is None and fit["x1"] is not None and fit["x2"] is not None


def test_difference_in_differences_follows_its_fallbacks(spark):
    rng = np.random.default_rng(5)
    rows = [(s, t, float(s % 3) / 2, int(t >= 4), 0.4 * (s % 3) * (t >= 4) + s + t + rng.normal(), [" b", "c/1", "."] if rng.random() < .5 else ["a"])
            for s in range(12) for t in range(8) for _ in range(3)]
    df = spark.createDataFrame(rows, "s int, t int, shock double, post int, y double, codes array<string>")
    fit = {r["term"]: r for r in rg.difference_in_differences(df, "y", "shock", "post", "s", "t", codes=F.col("codes")).collect()}
    assert set(fit) == {"post", "shock", "interaction", "ic_a", "ic_b", "ic_c_1"}
    assert fit["post"]["status"] == fit["shock"]["status"] == "collinear" and fit["interaction"]["status"] == "estimated" and fit["interaction"]["effects"]
    assert [fit[c]["status"] for c in ("ic_a", "ic_b", "ic_c_1")] == ["estimated", "collinear", "collinear"]
    d = {k: np.array(v) for k, v in zip(("s", "t", "shock", "post", "y"), zip(*[r[:5] for r in rows]))}
    x = np.column_stack([d["shock"] * d["post"], [r[5] == ["a"] for r in rows]]).astype(float)
    beta, se = explicit(d["y"], x, np.ones(len(rows)), d["s"], d["t"], d["s"], counted=2 + 1 + 7)
    assert abs(fit["interaction"]["estimate"] - beta[0]) < 1e-8 and abs(fit["interaction"]["se"] - se[0]) < 1e-8
    # one row per unit and year, one unit exposed in one year: everything is taken out, so the plain form is fitted
    thin = spark.createDataFrame([(s, s, float(s), int(s > 2), float(s * s)) for s in range(6)], "s int, t int, shock double, post int, y double")
    plain = rg.difference_in_differences(thin, "y", "shock", "post", "s", "t", controls=["t"]).collect()
    assert {r["term"] for r in plain} == {"const", "post", "shock", "interaction"} and not any(r["effects"] for r in plain)
    # an interaction that never varies has no error: no result
    assert rg.difference_in_differences(thin.withColumn("post", F.lit(0)), "y", "shock", "post", "s", "t").count() == 0


def test_event_study_needs_its_reference_year(spark):
    rng = np.random.default_rng(6)
    rows = [(s, t, float(s % 4), s + t + (s % 4) * (t - 2003) * 0.1 + rng.normal()) for s in range(20) for t in range(2000, 2006)]
    df = spark.createDataFrame(rows, "s int, t int, shock double, y double")
    fit = {r["term"]: r for r in rg.event_study(df, "y", "shock", "s", "t", reference=2003).collect()}
    assert set(fit) == {f"y{t}" for t in (2000, 2001, 2002, 2004, 2005)} and all(r["status"] == "estimated" for r in fit.values())
    s, t, shock, y = (np.array(c) for c in zip(*rows))
    x = np.column_stack([shock * (t == k) for k in (2000, 2001, 2002, 2004, 2005)])
    beta, se = explicit(y, x, np.ones(len(y)), s, t, s, counted=5 + 1 + 5)
    assert np.allclose([fit[f"y{k}"]["estimate"] for k in (2000, 2001, 2002, 2004, 2005)], beta, atol=1e-8)
    assert math.isclose(fit["y2005"]["se"], se[-1], rel_tol=1e-8)
    assert rg.event_study(df, "y", "shock", "s", "t", reference=1990).count() == 0
