"""Least squares with up to two sets of fixed effects and one-way clustered errors.

The data is reduced to moments inside Spark. Two effects of any size are absorbed: while the second has
at most ``MAX_LEVELS`` levels its normal equations are one matrix on the driver; beyond that the
variables are demeaned by both effects in turn, as joins of level tables, until a convergence
aggregate settles. What reaches the driver is then one matrix of the regressors.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.operators.network import components
from roadledger.session import cut_lineage

#: Levels of the second effect whose equations are solved on the driver.
MAX_LEVELS = 500


def _moments(names: list[str]) -> list:
    out = [F.sum("__w").alias("__sw")]
    for i, a in enumerate(names):
        out.append(F.sum(F.col("__w") * F.col(a)).alias(f"__s_{i}"))
        for j in range(i, len(names)):
            out.append(F.sum(F.col("__w") * F.col(a) * F.col(names[j])).alias(f"__q_{i}_{j}"))
    return out


def ols(df: DataFrame, y: str, xs: list[str], weight: str | None = None,
        cluster: str | None = None) -> DataFrame:
    """Regression with an intercept: one row per coefficient (term, estimate, se, n)."""
    return fixed_effects(df.withColumn("const", F.lit(1.0)), y, ["const", *xs], weight=weight,
                         cluster=cluster)


def fixed_effects(df: DataFrame, y: str, xs: list[str], first: str | None = None,
                  second: str | None = None, weight: str | None = None,
                  cluster: str | None = None, max_levels: int = MAX_LEVELS, nested: str = "count") -> DataFrame:
    """Weighted regression absorbing ``first`` and ``second``, each of any number of levels.

    Standard errors are clustered on ``cluster`` when given, else classical. Rows with a missing
    value or a non-positive weight are left out. A coefficient that the effects and the regressors
    before it determine gets NULL; one whose error is undefined has a NULL error. With ``nested="drop"`` an effect whose every level
    lies in one cluster does not count among the parameters of the small-sample factor.
    """
    spark = df.sparkSession
    names = [f"__x{i}" for i in range(len(xs))] + ["__y"]
    rows = df.select(
        *[F.col(c).cast("double").alias(n) for c, n in zip([*xs, y], names)],
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"),
        (F.col(first) if first else F.lit(0)).alias("__f"),
        (F.col(second).cast("string") if second else F.lit("all")).alias("__t"),
        (F.col(cluster) if cluster else F.lit(0)).alias("__c"))
    rows = rows.dropna().where("__w > 0")

    # moments per (first effect, second effect, cluster): everything below works on these cells
    cells = rows.groupBy("__f", "__t", "__c").agg(F.count(F.lit(1)).alias("__n"), *_moments(names))
    cells = cells.persist()
    try:
        return spark.createDataFrame(_solve(cells, xs, first, second, cluster, max_levels, nested),
                                     "term string, estimate double, se double, n bigint")
    finally:
        cells.unpersist()


def _solve(cells: DataFrame, xs: list[str], first: str | None, second: str | None,
           cluster: str | None, max_levels: int, nested: str) -> list[tuple]:
    p = len(xs)
    k = p + 1
    total = cells.agg(F.sum("__n").alias("n"), F.countDistinct("__c").alias("g"), F.countDistinct("__f").alias("f"),
                      F.countDistinct("__t").alias("t"), *[F.sum(f"__q_{i}_{i}").alias(f"q{i}") for i in range(k)]).first()
    n = total["n"] or 0
    if not n:
        return [(name, None, None, 0) for name in xs]
    if second is None:
        shift, rank = None, total["f"] if first else 0
    elif total["t"] <= max_levels:
        shift, rank = _dense_shift(cells, k, first)
        rank += total["f"] if first else 0
    else:
        shift, rank = _iterated_shift(cells, k, first), _levels(cells, first, total)

    # cross products of regressors and y without the effects
    off, c = _centred(cells, shift, k, first)
    sums = [F.sum(_product(off, i, j)).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]
    row = c.agg(*sums).first()
    inner = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    usable = independent(inner[:p, :p], np.array([total[f"q{i}"] for i in range(p)], float))
    if not usable:
        return [(name, None, None, n) for name in xs]
    a = inner[np.ix_(usable, usable)]
    beta = np.linalg.solve(a, inner[usable, p])
    inv = np.linalg.inv(a)
    used = len(usable) + rank
    if nested == "drop" and (first or second):
        inside = c.groupBy("__f").agg(F.countDistinct("__c").alias("n")).agg(F.max("n")).first()[0] == 1 if first else True
        inside_t = c.groupBy("__t").agg(F.countDistinct("__c").alias("n")).agg(F.max("n")).first()[0] == 1 if second else True
        used = len(usable) + 1 + (0 if inside else total["f"] - 1) + (0 if inside_t else total["t"] - 1)
    if cluster:
        g = int(total["g"])
        meat = _meat(c, off, usable, beta, p)
        adjust = (g / (g - 1)) * ((n - 1) / (n - used)) if g > 1 and n > used else float("nan")
        cov = adjust * inv @ meat @ inv
    else:
        cov = inv * ((inner[p, p] - beta @ inner[usable, p]) / (n - used)) if n > used else inv * float("nan")
    out = []
    for i, name in enumerate(xs):
        if i not in usable:
            out.append((name, None, None, n))
            continue
        j = usable.index(i)
        var = cov[j, j]
        out.append((name, float(beta[j]), math.sqrt(var) if var > 0 and math.isfinite(var) else None, n))
    return out


def independent(cross: np.ndarray, scale: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Places of the regressors that the effects and the kept ones before them leave undetermined."""
    kept: list[int] = []
    for j in range(len(cross)):
        rest = cross[j, j]
        if kept:
            rest -= cross[j, kept] @ np.linalg.solve(cross[np.ix_(kept, kept)], cross[kept, j])
        if rest > tolerance * max(scale[j], 1e-300):
            kept.append(j)
    return kept


def _dense_shift(cells: DataFrame, k: int, first: str | None) -> tuple[DataFrame, int]:
    """(__t, __b_i) that takes the second effect out, and the rank of its levels beside the first effect."""
    sums = [F.sum(f"__s_{i}").alias(f"s{i}") for i in range(k)]
    own = cells.groupBy("__t").agg(F.sum("__sw").alias("w"), *sums).orderBy("__t").collect()
    at = {r["__t"]: i for i, r in enumerate(own)}
    dums = np.diag([r["w"] for r in own])
    right = np.array([[r[f"s{i}"] for i in range(k)] for r in own], float)
    if first:
        by_f = cells.groupBy("__f").agg(F.sum("__sw").alias("__fw"), *[F.sum(f"__s_{i}").alias(f"__g_{i}") for i in range(k)])
        by_ft = cells.groupBy("__f", "__t").agg(F.sum("__sw").alias("__ftw"))
        joined = by_ft.join(by_f, "__f")
        mixed = [F.sum(F.col(f"__g_{i}") * F.col("__ftw") / F.col("__fw")).alias(f"m{i}") for i in range(k)]
        for r in joined.groupBy("__t").agg(*mixed).collect():
            right[at[r["__t"]]] -= [r[f"m{i}"] for i in range(k)]
        # level pairs inside one group: bounded by the square of the level limit
        both = joined.select("__f", "__t", "__ftw", "__fw").join(by_ft.toDF("__f", "__t2", "__ftw2"), "__f").groupBy("__t", "__t2").agg(
            F.sum(F.col("__ftw") * F.col("__ftw2") / F.col("__fw")).alias("v"))
        for r in both.collect():
            dums[at[r["__t"]], at[r["__t2"]]] -= r["v"]
    coefs = np.linalg.pinv(dums, rcond=1e-10) @ right
    shift = cells.sparkSession.createDataFrame([(t, *map(float, coefs[i])) for t, i in at.items()],
                                               "__t string, " + ", ".join(f"__b_{i} double" for i in range(k)))
    return F.broadcast(shift), int(np.linalg.matrix_rank(dums, tol=1e-8))


def _iterated_shift(cells: DataFrame, k: int, first: str | None, tolerance: float = 1e-10, max_rounds: int = 1000) -> DataFrame:
    """(__t, __b_i) that takes the second effect out, for any number of levels.

    One round averages a level table of the second effect over the first and back, two joins and
    aggregates over the (first, second) cells; all variables share it. Plain turns converge as slowly as
    the effects are tied together, so each round moves along the conjugate direction instead. The
    driver sees one row of scalars a round.
    """
    ft = cut_lineage(cells.groupBy("__f", "__t").agg(F.sum("__sw").alias("__sw"), *[F.sum(f"__s_{i}").alias(f"__s_{i}") for i in range(k)]))
    each = range(k)

    def over_first(level: DataFrame, name: str) -> DataFrame:
        """Per level of the second effect: the weighted means over the first effect of ``name``, added up again."""
        joined = ft.select("__f", "__t", "__sw").join(level, "__t")
        means = joined.groupBy("__f").agg(*[(F.sum(F.col("__sw") * F.col(f"{name}{i}")) / F.sum("__sw")).alias(f"__u{i}") for i in each])
        back = ft.select("__f", "__t", "__sw").join(means, "__f")
        return back.groupBy("__t").agg(*[F.sum(F.col("__sw") * F.col(f"__u{i}")).alias(f"__v{i}") for i in each])

    weights = ft.groupBy("__t").agg(F.sum("__sw").alias("__tw"), *[F.sum(f"__s_{i}").alias(f"__s{i}") for i in each])
    if first:
        means = ft.groupBy("__f").agg(*[(F.sum(f"__s_{i}") / F.sum("__sw")).alias(f"__u{i}") for i in each])
        back = ft.select("__f", "__t", "__sw").join(means, "__f").groupBy("__t").agg(
            *[F.sum(F.col("__sw") * F.col(f"__u{i}")).alias(f"__v{i}") for i in each])
        start = weights.join(back, "__t").select("__t", "__tw", *[(F.col(f"__s{i}") - F.col(f"__v{i}")).alias(f"__r{i}") for i in each])
    else:
        start = weights.select("__t", "__tw", *[F.col(f"__s{i}").alias(f"__r{i}") for i in each])
    state = start.select("*", *[F.lit(0.0).alias(f"__b_{i}") for i in each], *[(F.col(f"__r{i}") / F.col("__tw")).alias(f"__p{i}") for i in each])
    squares = [F.sum(F.col(f"__r{i}") * F.col(f"__r{i}") / F.col("__tw")).alias(f"rz{i}") for i in each]
    state = cut_lineage(state)
    rz = state.agg(*squares).first()
    rz = [rz[f"rz{i}"] for i in each]
    whole = ft.agg(*[F.sum(F.col(f"__s_{i}") * F.col(f"__s_{i}") / F.col("__sw")).alias(f"q{i}") for i in each]).first()
    goal = [tolerance ** 2 * whole[f"q{i}"] for i in each]
    for _ in range(max_rounds):
        if all(r <= g for r, g in zip(rz, goal)):
            return state.select("__t", *[f"__b_{i}" for i in each])
        moved = over_first(state.select("__t", *[f"__p{i}" for i in each]), "__p") if first else None
        if moved is None:
            turned = state.withColumns({f"__v{i}": F.lit(0.0) for i in each})
        else:
            turned = state.join(moved, "__t")
        turned = cut_lineage(turned.withColumns({f"__v{i}": F.col("__tw") * F.col(f"__p{i}") - F.col(f"__v{i}") for i in each}))
        pq = turned.agg(*[F.sum(F.col(f"__p{i}") * F.col(f"__v{i}")).alias(f"p{i}") for i in each]).first()
        step = [rz[i] / pq[f"p{i}"] if rz[i] > goal[i] and pq[f"p{i}"] > 0 else 0.0 for i in each]
        state = turned.withColumns({f"__b_{i}": F.col(f"__b_{i}") + step[i] * F.col(f"__p{i}") for i in each}
                                   | {f"__r{i}": F.col(f"__r{i}") - step[i] * F.col(f"__v{i}") for i in each})
        after = state.agg(*squares).first()
        state = state.select("__t", "__tw", *[f"__r{i}" for i in each], *[f"__b_{i}" for i in each],
                             *[(F.col(f"__r{i}") / F.col("__tw") + F.col(f"__p{i}") * (after[f"rz{i}"] / rz[i] if rz[i] > 0 else 0.0)).alias(f"__p{i}") for i in each])
        rz = [after[f"rz{i}"] if step[i] else 0.0 for i in each]
    raise RuntimeError(f"the effects did not settle in {max_rounds} rounds")


def _levels(cells: DataFrame, first: str | None, total) -> int:
    """Rank of all levels: one less for every group of levels that rows tie together, after the first effect's own."""
    if not first:
        return total["t"]
    ties = cells.select(F.concat(F.lit("f"), F.col("__f").cast("string")).alias("a"), F.concat(F.lit("t"), F.col("__t")).alias("b")).distinct()
    return total["f"] + total["t"] - components(ties).agg(F.countDistinct("component")).first()[0]


def _centred(cells: DataFrame, shift: DataFrame | None, k: int, first: str | None) -> tuple[list, DataFrame]:
    """What the effects take from each variable in a cell, and the cells that carry the columns for it."""
    c = cells.join(shift, "__t") if shift is not None else cells.withColumns({f"__b_{i}": F.lit(0.0) for i in range(k)})
    if first:
        group = c.groupBy("__f").agg(*[(F.sum(F.col(f"__s_{i}") - F.col("__sw") * F.col(f"__b_{i}")) / F.sum("__sw")).alias(f"__a_{i}") for i in range(k)])
        c = c.join(group, "__f")
    else:
        c = c.withColumns({f"__a_{i}": F.lit(0.0) for i in range(k)})
    return [F.col(f"__a_{i}") + F.col(f"__b_{i}") for i in range(k)], c


def _product(off: list, i: int, j: int):
    """Weighted sum of products of two centred variables in a cell."""
    return (F.col(f"__q_{min(i, j)}_{max(i, j)}") - off[i] * F.col(f"__s_{j}") - off[j] * F.col(f"__s_{i}")
            + off[i] * off[j] * F.col("__sw"))


def _meat(c: DataFrame, off: list, usable: list[int], beta: np.ndarray, p: int) -> np.ndarray:
    """Sum over clusters of the outer product of their score sums, from the cell moments."""
    scores = []
    for j in usable:
        s = _product(off, j, p)
        for m, b in zip(usable, beta):
            s = s - F.lit(float(b)) * _product(off, j, m)
        scores.append(F.sum(s).alias(f"g{j}"))
    row = c.groupBy("__c").agg(*scores).agg(*[F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m_{i}_{j}")
                                              for i in usable for j in usable]).first()
    return np.array([[row[f"m_{i}_{j}"] for j in usable] for i in usable])


def code_indicators(df: DataFrame, codes: Column, prefix: str = "ic_", limit: int = 500) -> tuple[DataFrame, list[str]]:
    """One 0/1 column for each code that occurs in the list column, and the names of these columns.

    Codes are trimmed; blanks, '.' and 'NA' are none. More than ``limit`` codes are refused.
    """
    listed = F.filter(F.transform(codes, lambda x: F.trim(x.cast("string"))), lambda x: ~x.isin("", ".", "NA"))
    found = [r[0] for r in df.select(F.explode(listed).alias("c")).distinct().orderBy("c").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} codes")
    names = {c: prefix + re.sub("[^A-Za-z0-9]", "_", c) for c in found}
    return df.withColumns({n: F.coalesce(F.array_contains(listed, c), F.lit(False)).cast("int") for c, n in names.items()}), list(names.values())


STUDY_SCHEMA = "term string, estimate double, se double, n bigint, effects boolean, status string"


def _study(df: DataFrame, y: str, xs: list[str], plain: list[str], unit: str, year: str, weight: str | None) -> DataFrame:
    """The fit with unit and year effects; where these leave nothing to estimate, the plain terms with an intercept.

    Errors are clustered on the unit. ``status`` is 'estimated', 'no error' or 'collinear'.
    """
    fit, effects = fixed_effects(df, y, xs, first=unit, second=year, weight=weight, cluster=unit, nested="drop").collect(), True
    if all(r["estimate"] is None for r in fit):
        fit, effects = ols(df, y, plain, weight=weight, cluster=unit).collect(), False

    def status(r) -> str:
        return "collinear" if r["estimate"] is None else "no error" if r["se"] is None else "estimated"

    return df.sparkSession.createDataFrame([(*r, effects, status(r)) for r in fit], STUDY_SCHEMA)


def difference_in_differences(df: DataFrame, y: str, treated: str, post: str, unit: str, year: str,
                              controls: list[str] | None = None, weight: str | None = None,
                              codes: Column | None = None) -> DataFrame:
    """Period, exposure and their interaction with controls, code indicators, unit and year effects.

    Where the effects leave nothing, period, exposure and interaction are fitted alone. Terms that others
    determine are named with status 'collinear'. Without a defined error of the interaction there is no result.
    """
    work = df.withColumn("interaction", F.col(treated) * F.col(post))
    names: list[str] = []
    if codes is not None:
        work, names = code_indicators(work, codes)
    main = [post, treated, "interaction"]
    fit = _study(work, y, [*main, *(controls or []), *names], main, unit, year, weight)
    defined = fit.where("term = 'interaction' AND status = 'estimated'").count() > 0
    return fit if defined else fit.where("false")


def event_study(df: DataFrame, y: str, exposure: str, unit: str, year: str, years: list[int] | None = None,
                reference: int = 0, weight: str | None = None) -> DataFrame:
    """Year x exposure coefficients with unit and year effects and one reference year.

    The years are those of the rows unless given. Rows of the reference year must exist, else there is no
    result; where the effects leave nothing, the terms are fitted with an intercept alone.
    """
    found = {r[0] for r in df.where(F.col(y).isNotNull() & F.col(exposure).isNotNull()).select(year).distinct().dropna().collect()}
    if reference not in found:
        return df.sparkSession.createDataFrame([], STUDY_SCHEMA)
    asked = [t for t in sorted(found if years is None else years) if t != reference]
    work = df.withColumns({f"y{t}": F.when(F.col(year) == t, F.col(exposure)).otherwise(F.lit(0.0)) for t in asked})
    terms = [f"y{t}" for t in asked]
    return _study(work, y, terms, terms, unit, year, weight)
