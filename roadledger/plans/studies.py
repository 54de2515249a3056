"""Study samples, code comparisons and the geocoding chain, wired from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.functions.dates import years_between
from roadledger.operators import linear
from roadledger.operators.aggregates import exact_percentiles, frequency, top_k
from roadledger.operators.joins import merge_code, prefix_members
from roadledger.operators.network import longest_part, merge_parts, milepost_range, part_vertices


def sample_variants(df: DataFrame, years: dict[str, tuple[str, int, int]], start: str, end: str,
                    limits: dict[str, int], code: str, prefixes: list[str]) -> DataFrame:
    """Every combination of a year rule, a duration limit in days and a code list, stacked and
    labelled. Each row lists the samples it belongs to, so the table is read once."""
    days = F.datediff(end, start)
    listed = reduce(lambda a, b: a | b, [F.col(code).startswith(p) for p in prefixes])
    tags = []
    for y_name, (column, lo, hi) in years.items():
        for d_name, limit in limits.items():
            for c_name, cond in (("all", F.lit(True)), ("codes", listed)):
                ok = F.col(column).between(lo, hi) & (days <= limit) & cond
                tags.append(F.when(ok, F.lit(f"{y_name}/{d_name}/{c_name}")))
    return df.withColumn("sample", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())))


def code_match_frequency(left: DataFrame, right: DataFrame, keys: list[str], codes: Column, k: int) -> DataFrame:
    """Most frequent codes among matched and unmatched left records."""
    m = merge_code(left, right.select(*keys).distinct(), keys).where("merge_code <> 2")
    flat = m.select((F.col("merge_code") == 3).alias("matched"), F.explode(codes).alias("code"))
    best = top_k(flat, "code", k).select("code")
    return flat.join(best, "code", "left_semi").groupBy("code", "matched").agg(F.count(F.lit(1)).alias("n"))


def roll_up_deviation(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Absolute difference between two roll-ups of the same records."""
    other = b.select(*keys, F.col(value).alias("__v"))
    return a.join(other, keys).select(*keys, F.abs(F.col(value) - F.col("__v")).alias("deviation"))


def endpoint_vertices(references: DataFrame, project: str) -> DataFrame:
    """Vertices of all references of each endpoint, for projects that have both endpoints."""
    usable = references.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    both = usable.groupBy(project).agg(F.countDistinct("endpoint").alias("__n")).where("__n = 2").select(project)
    return usable.join(both, project, "left_semi").select(project, "endpoint", "vid", "x", "y")


def build_routes(edges: DataFrame, vertices: DataFrame, keys: list[str], begin: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Segments of each route's longest part, and its mile-post range and length in miles."""
    parts = longest_part(merge_parts(edges, keys), keys)
    segs = linear.segments(part_vertices(parts, vertices, keys), keys)
    length = linear.line_lengths(segs, keys).select(*keys, (F.col("length") / 1609.344).alias("length_miles"))
    return segs, milepost_range(edges, keys, begin, end).join(length, keys, "left")


def snap_records(records: DataFrame, segs: DataFrame, ranges: DataFrame, keys: list[str], record_id: str,
                 begin: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Cut each record's mile-post interval out of its route; records without a route are kept as
    not covered. Routes are built once and shared by all records."""
    r = records.join(ranges, keys, "left")
    at = {n: linear.milepost_fraction(F.col(c), F.col("mp_low"), F.col("mp_high"), F.col("length_miles"))
          for n, c in (("f1", begin), ("f2", end))}
    r = r.withColumns(at).withColumn("is_covered", F.col("length_miles").isNotNull())
    cuts = r.where("is_covered").select(*keys, record_id, *[
        (F.col(f) * F.col("length_miles") * 1609.344).alias(d) for f, d in (("f1", "d_from"), ("f2", "d_to"))])
    return r.drop("f1", "f2"), linear.cut_lines(segs, cuts, keys, [record_id])


def match_quality(matches: DataFrame, kind: str, distance: str) -> DataFrame:
    """Matches by kind: count, percent, and quartiles of the match distance."""
    counts = frequency(matches, [kind])
    q = exact_percentiles(matches, [kind], distance, [0.25, 0.5, 0.75], ["p25", "median", "p75"])
    return counts.join(q, kind, "left")


def duration_sample(df: DataFrame, start: str, end: str, code: str, prefixes: list[str]) -> DataFrame:
    """Records of a program list with both dates and a duration in years."""
    kept = prefix_members(df, code, prefixes).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return kept.withColumn("duration", years_between(F.col(start), F.col(end)))
