"""Groups of linked items: connected components, and linking by shared buckets without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.llm.common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): root is the smallest id that it reaches.

    Every round hangs the neighbours of each id on the smallest of them, first those above the id, then
    those below, so rounds grow with the logarithm of the longest path. A step is an aggregate and a
    join; rounds are written to the shared folder, and the one before is deleted.
    """
    work = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        done, work = work, stored(small, "edges")
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(done)
        if now == seen:
            break
        seen = now
    roots = work.select(F.col("v").alias("id")).distinct()
    return work.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))


def link_buckets(entries: DataFrame, attributes: list[str], near: Callable[[Callable, Callable], Column],
                 verify: Callable[[DataFrame], DataFrame], star_rounds: int = 2) -> DataFrame:
    """(id, root) for all ids of ``entries`` (bucket, id, attributes): the groups that verified pairs make.

    Two ids are candidates if they share a bucket in which ``near`` holds of their attributes; ``verify``
    keeps the pairs (a, b) that are linked. First each bucket's ids are compared with one member only,
    the one in most buckets, which settles large groups in as many pairs as they have members. Then all
    candidate pairs that are still in different groups and were not compared yet are compared, so no link between groups is lost.
    """
    degree = entries.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    work = stored(entries.join(degree, "id").withColumn("root", F.col("id")), "entries")

    def of(side: str):
        return lambda name: F.col(f"{side}.{name}")

    seen = []

    def settle(pairs: DataFrame, current: DataFrame) -> DataFrame:
        """``current`` with roots of groups joined by the pairs (a, b, ra, rb) that verify; none is verified twice."""
        pairs = pairs.groupBy("a", "b").agg(F.first("ra").alias("ra"), F.first("rb").alias("rb"))
        for done in seen:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        seen.append(pairs := stored(pairs, "pairs"))
        linked = verify(pairs).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        found = components(linked).select(F.col("id").alias("root"), F.col("root").alias("top"))
        after = stored(current.join(found, "root", "left").withColumn("root", F.coalesce("top", "root")).select(*current.columns), "entries")
        drop_stored(current)
        return after

    def pair_columns(a: str, b: str) -> list[Column]:
        ids = [F.col(f"{x}.id") for x in (a, b)]
        return [F.least(*ids).alias("a"), F.greatest(*ids).alias("b"), F.col(f"{a}.root").alias("ra"), F.col(f"{b}.root").alias("rb")]

    for number in range(star_rounds):
        first = F.struct("degree", (-F.col("id")).alias("least")) if number == 0 else F.struct(F.xxhash64("id", F.lit(number)).alias("h"))
        held = work.select("bucket", F.struct(first.alias("first"), "id", "root", *attributes).alias("m"))
        centre = held.groupBy("bucket").agg(F.max("m").alias("m")).select(F.col("bucket").alias("c_bucket"), "m.id", "m.root", *[f"m.{x}" for x in attributes])
        pairs = work.alias("x").join(centre.alias("y"), F.col("x.bucket") == F.col("y.c_bucket")).where(
            (F.col("x.root") != F.col("y.root")) & near(of("x"), of("y"))).select(*pair_columns("x", "y"))
        work = settle(pairs, work)
    open_buckets = work.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    rest = stored(work.join(open_buckets, "bucket"), "open")
    pairs = rest.alias("x").join(rest.alias("y"), F.col("x.bucket") == F.col("y.bucket")).where(
        (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & near(of("x"), of("y"))).select(*pair_columns("x", "y"))
    work = settle(pairs, work)
    for table in (rest, *seen):
        drop_stored(table)
    return work.select("id", "root").distinct()
