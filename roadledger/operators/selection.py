"""Exact selection of ranks and weighted ranks without sorting a table.

Every wanted rank starts with the bracket from the smallest to the largest value of its group. A round counts the
rows of a bracket in bins, which combine before the shuffle, and narrows the bracket to the smallest
and largest value of the bin that holds the rank. Rounds alternate between even bins and bins that grow with the distance from the
low end, so a few far values do not stop them. Once a bracket holds few rows they are sorted; a
bracket of one value is settled however many rows share it. Weights are whole numbers, so running sums are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.session import cut_lineage

#: Bins of a round, and rows that one task may sort.
BINS, FINISH = 512, 1_000_000
#: Weights are taken to this part of a unit.
UNITS = 10**12


def whole_weight(weight: Column) -> Column:
    """A weight as a whole number of 1e-12."""
    return F.round(weight.cast("double") * F.lit(float(UNITS))).cast("decimal(38,0)")


def _place(kind: T.DataType, v: Column, lo: Column, hi: Column) -> Column:
    """Where a value lies between two others, from 0 to 1; 0 for ``lo`` and more than 0 for ``hi``."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        most = F.lit(1.7976931348623157e308)
        v, lo, hi = (F.greatest(F.least(x.cast("double"), most), -most) for x in (v, lo, hi))
        half = F.when(F.greatest(F.abs(lo), F.abs(hi)) > 1e307, 0.5).otherwise(1.0)  # differences stay finite
        part = F.try_divide(v * half - lo * half, hi * half - lo * half)
    else:
        exact = kind.simpleString() if isinstance(kind, T.DecimalType) else "decimal(20,0)"
        part = F.try_divide((v.cast(exact) - lo.cast(exact)).cast("double"), (hi.cast(exact) - lo.cast(exact)).cast("double"))
    return F.coalesce(part, (v > lo).cast("double"))


def select_ranks(df: DataFrame, keys: list[str], value: str, targets: dict[str, tuple[Column, bool]],
                 weight: Column | None = None, scale: int = 1) -> DataFrame:
    """Per group the smallest value whose running weight passes each target: keys, one column per target, ``total``.

    ``targets`` maps an output to (threshold, strict): an expression of the column ``total`` (the weight of the
    group) and whether ``scale`` times the running weight must exceed it or may equal it. ``weight`` is a whole number, 1 by
    default; rows without a value or a positive weight, and NaN, do not take part. A target beyond the total gives NULL.
    """
    named = [f"__k{i}" for i in range(len(keys))]
    w = F.lit(1).cast("decimal(38,0)") if weight is None else weight.cast("decimal(38,0)")
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(value).alias("v"), w.alias("w")).where("v IS NOT NULL AND w > 0")
    if isinstance(rows.schema["v"].dataType, (T.DoubleType, T.FloatType)):
        rows = rows.where(~F.isnan("v"))
    kind = rows.schema["v"].dataType

    def matched(left: DataFrame, right: DataFrame, *extra: Column) -> Column:
        return reduce(lambda a, b: a & b, [*[left[n].eqNullSafe(right[f"{n}_r"]) for n in named], *extra], F.lit(True))

    def right(side: DataFrame) -> DataFrame:
        return side.withColumnsRenamed({n: f"{n}_r" for n in named})

    def passed(cum: Column) -> Column:
        return F.when(F.col("strict"), cum * F.lit(scale) > F.col("goal")).otherwise(cum * F.lit(scale) >= F.col("goal"))

    base = rows.groupBy(*named).agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("t"), goal.cast("decimal(38,0)").alias("goal"), F.lit(strict).alias("strict"))
                       for i, (goal, strict) in enumerate(targets.values())])
    base = base.where("n > 0").withColumn("g", F.explode(wanted)).select(*named, "total", "n", "lo", "hi", "g.*")
    exists = passed(F.col("total"))
    state = cut_lineage(base.select(*named, "total", "t", "goal", "strict", F.when(exists, F.col("lo")).alias("lo"), F.when(exists, F.col("hi")).alias("hi"),
                                    F.lit(0).cast("decimal(38,0)").alias("before"), "n"))
    columns = state.columns
    number = 0
    while state.where((F.col("lo") < F.col("hi")) & (F.col("n") > FINISH)).limit(1).count():
        wide = (F.col("lo") < F.col("hi")) & (F.col("n") > FINISH)
        going = state.where(wide)
        brackets = right(going.select(*named, "lo", "hi").distinct())
        held = rows.join(brackets, matched(rows, brackets, F.col("v").between(F.col("lo"), F.col("hi"))))
        part = _place(kind, F.col("v"), F.col("lo"), F.col("hi"))
        if number % 2:
            part = F.log1p(part * float(2**60)) / F.log1p(F.lit(float(2**60)))
        bin_no = F.least(F.floor(part * BINS), F.lit(BINS - 1))
        bins = held.groupBy(*named, "lo", bin_no.alias("bin")).agg(F.sum("w").alias("b_w"), F.count(F.lit(1)).alias("b_n"), F.min("v").alias("b_lo"), F.max("v").alias("b_hi"))
        upto = Window.partitionBy(*named, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = right(bins.withColumn("b_cum", F.sum("b_w").over(upto)).withColumnRenamed("lo", "b_from"))
        found = going.join(bins, matched(going, bins, F.col("lo") == F.col("b_from")))
        cum = F.col("before") + F.col("b_cum")
        found = found.where(passed(cum) & ~passed(cum - F.col("b_w"))).select(
            *named, "total", "t", "goal", "strict", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), (cum - F.col("b_w")).cast("decimal(38,0)").alias("before"), F.col("b_n").alias("n"))
        state = cut_lineage(found.select(*columns).unionByName(state.where(~F.coalesce(wide, F.lit(False)))))
        number += 1

    settled = state.where(~F.coalesce(F.col("lo") < F.col("hi"), F.lit(False))).select(*named, "total", "t", F.col("lo").alias("v"))
    few = state.where("lo < hi")
    brackets = right(few.select(*named, "lo", "hi").distinct())
    inside = rows.join(brackets, matched(rows, brackets, F.col("v").between(F.col("lo"), F.col("hi")))).groupBy(*named, "lo", "v").agg(F.sum("w").alias("w"))
    upto = Window.partitionBy(*named, "lo").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = right(inside.withColumn("cum", F.sum("w").over(upto)).withColumnRenamed("lo", "from"))
    picked = few.join(inside, matched(few, inside, F.col("lo") == F.col("from"))).where(passed(F.col("before") + F.col("cum")))
    picked = picked.groupBy(*named, "total", "t").agg(F.min("v").alias("v"))
    out = settled.unionByName(picked).groupBy(*named).agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("t") == i, F.col("v"))).alias(name) for i, name in enumerate(targets)])
    return out.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], *targets, "total")


def smallest(df: DataFrame, key: Column, order: list[Column], n: int) -> DataFrame:
    """The n first rows by ``order``, of which ``key`` is a non-negative whole number that never decreases along it.

    The n-th smallest key is selected; rows below it pass on where they are, and only rows that share it are ordered.
    """
    tagged = df.withColumn("__key", key)
    total = F.least(F.col("total"), F.lit(n))
    cut = select_ranks(tagged, [], "__key", {"at": (total, False)}).select("at").first()
    if n <= 0 or cut is None:
        return df.limit(0)
    below = tagged.where(F.col("__key") < F.lit(cut["at"]))
    rest = n - below.count()
    return below.unionByName(tagged.where(F.col("__key") == F.lit(cut["at"])).orderBy(*order).limit(rest)).drop("__key")
