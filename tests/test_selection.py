"""Narrowed brackets against sorting, on skewed and tied values."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadledger.operators import aggregates as agg
from roadledger.operators import sampling, selection
from tests.conftest import rows


def made(n=4000):
    rng = random.Random(8)
    kinds = {
        "tied": lambda: rng.choice([1.0, 1.0, 1.0, 2.0, 7.5]),
        "far": lambda: rng.choice([1e-300, 1.0, 1e12, -1e300, 5e-324]) * rng.random(),
        "log": lambda: rng.lognormvariate(0, 6),
        "one": lambda: 4.0,
        None: lambda: rng.uniform(-1, 1),
    }
    out = [(k, float(make()), rng.choice([0.1, 0.2, 0.7, 1.0, 3.25])) for k, make in kinds.items() for _ in range(n)]
    return out + [("tied", None, 1.0), ("tied", float("nan"), 1.0), ("tied", 3.0, 0.0), ("tied", 3.0, -1.0), ("tied", 3.0, None), ("none", None, 1.0)]


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(selection, "BINS", 8)
    monkeypatch.setattr(selection, "FINISH", 20)


def test_percentiles_equal_sorting(spark, narrow):
    data = made()
    df = spark.createDataFrame(data, "k string, v double, w double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(len(points))] for r in agg.exact_percentiles(df, ["k"], "v", points, [f"q{i}" for i in range(len(points))]).collect()}
    groups = {}
    for k, v, _ in data:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        s = sorted(values)
        for p, g in zip(points, got[k]):
            at = p * (len(s) - 1)
            lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert g == lo + (at - np.floor(at)) * (hi - lo), (k, p)
    assert agg.exact_percentiles(df.where("v > 1e301"), [], "v", [0.5], ["m"]).first()["m"] is None


def test_weighted_percentiles_meet_exactly(spark, narrow):
    data = made(1500)
    df = spark.createDataFrame(data, "k string, v double, w double").repartition(3)
    points = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = {r["k"]: list(r)[1:] for r in agg.weighted_percentiles(df, ["k"], "v", "w", points).collect()}
    groups = {}
    for k, v, w in data:
        if v is not None and v == v and w is not None and w > 0:
            groups.setdefault(k, []).append((v, Fraction(str(w))))
    for k, pairs in groups.items():
        pairs.sort()
        total = sum(w for _, w in pairs)
        for p, g in zip(points, got[k]):
            goal, cum, reached, passed = Fraction(str(p)) * total, Fraction(0), None, None
            for v, w in pairs:
                cum += w
                if cum >= goal and reached is None:
                    reached = v
                if cum > goal:
                    passed = v
                    break
            assert g == (reached + passed) / 2, (k, p)
    ten = spark.createDataFrame([(0.1, float(i)) for i in range(10)], "w double, v double")
    assert agg.weighted_percentiles(ten, [], "v", "w", [0.3]).first()[0] == 2.5  # ten times 0.1: the third one is met exactly


def test_whole_numbers_keep_all_digits(spark, narrow):
    values = [2**62 + i for i in range(200)] + [-(2**62)] * 3
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = selection.select_ranks(df, [], "v", {f"r{i}": (F.lit(i), True) for i in (0, 2, 3, 50, 202)}).first()
    assert [got[f"r{i}"] for i in (0, 2, 3, 50, 202)] == [sorted(values)[i] for i in (0, 2, 3, 50, 202)]


def test_sample_equals_sorting_by_hash(spark, narrow):
    import hashlib
    ids = [*range(900), *[5] * 30, None]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    order = sorted(ids, key=lambda i: hashlib.md5(f"{i}_s".encode() if i is not None else b"s").hexdigest())
    for n in (0, 1, 37, 931, 5000):
        got = [r[0] for r in rows(sampling.sample_n(df, "id", n, "s"))]
        assert sorted(got, key=repr) == sorted(order[:n], key=repr)
