"""Evaluation of predictions against held-out truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.operators.aggregates import exact_percentiles
from roadledger.operators.ordered import join_back


def metric_summary(df: DataFrame, metrics: list[str], strata: list[str], threshold: float) -> DataFrame:
    """n of finite values, mean, median, p25, p75, p90 and percent within a threshold, for all
    rows and for every value of every stratum."""
    tags = [F.struct(F.lit("all").alias("stratum"), F.lit("all").alias("level"))]
    tags += [F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("level")) for s in strata]
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                       for m in metrics])
    long = df.select(F.explode(F.array(*tags)).alias("__t"), values.alias("__v")).select(
        "__t.*", F.explode("__v").alias("__m")).select("stratum", "level", "__m.*")
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value")
                        & (F.abs("value") != float("inf")))
    keys = ["metric", "stratum", "level"]
    base = finite.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        (100.0 * F.avg((F.col("value") <= threshold).cast("double"))).alias("pct_within"))
    q = exact_percentiles(finite, keys, "value", [0.5, 0.25, 0.75, 0.9],
                          ["median", "p25", "p75", "p90"])
    return join_back(base, q, keys)


def evaluate(predictions: DataFrame, truth: DataFrame, id_col: str, metrics: dict[str, Column]) -> DataFrame:
    """Inner join by id with the metric columns added."""
    return predictions.join(truth, id_col).withColumns(metrics)


def coverage_row(predictions: DataFrame, truth: DataFrame, id_col: str) -> DataFrame:
    """How many truth ids have a prediction."""
    marked = truth.select(id_col).distinct().join(
        predictions.select(id_col).distinct().withColumn("__p", F.lit(1)), id_col, "left")
    return marked.agg(F.count(F.lit(1)).alias("n_truth"), F.count("__p").alias("n_covered"),
                      (F.count("__p") / F.count(F.lit(1))).alias("coverage"))


def required_sample_size(df: DataFrame, value: str, error: float, z: float = 1.96) -> DataFrame:
    """Rows needed for the mean to be within ``error``: (z * sd / error)^2, rounded up."""
    sd = F.stddev_samp(value)
    return df.agg(sd.alias("sd"), F.ceil(F.pow(F.lit(z) * sd / F.lit(error), 2)).alias("n_required"))
