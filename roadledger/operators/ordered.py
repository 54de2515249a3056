"""Ordered scans and group totals that survive a group holding a large share of all rows.

A plain ordered window puts each group into one task. Here every group is cut into consecutive
parts by a caller-supplied expression that never decreases along the order (a month of a date, a
block of miles; NULL where the leading order column is NULL). Each part is scanned on its own; one
row per part then carries the running sums, ranks and border values across, so the result equals
the plain window's. The plan is the same at every size, and no job runs while it is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.session import cut_lineage

_PART = "__part"


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the key columns."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_back(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join per-group values to the rows, NULL keys included."""
    renamed = stats.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    match = [df[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
    out = df.join(renamed, reduce(lambda a, b: a & b, match), "left")
    return out.drop(*[f"__k_{k}" for k in keys])


def tag_parts(df: DataFrame, split: Column | None) -> DataFrame:
    """Add the part of each row. Operators with several scans tag once and pass the tagged table on."""
    return df if split is None or _PART in df.columns else df.withColumn(_PART, split)


def drop_parts(df: DataFrame) -> DataFrame:
    return df.drop(_PART)


def ordered(df: DataFrame, keys: list[str], order: list[str],
            lag: dict[str, str] | None = None, lead: dict[str, str] | None = None,
            total: dict[str, str] | None = None, rank: str | None = None,
            first: dict[str, str] | None = None, ahead: dict[str, tuple[str, int]] | None = None,
            split: Column | None = None) -> DataFrame:
    """Add columns computed along an ascending total order inside each group.

    ``lag``/``lead`` map output to source column (previous / next row), ``total`` gives running
    sums, ``rank`` names a row number, ``first`` gives the value of the group's first row, and
    ``ahead`` maps output to (column, depth) for the array of the next ``depth`` values.
    Without ``split`` the groups must be small enough for one task. With an empty key list the
    whole table is one group.
    """
    lag, lead, total, first = lag or {}, lead or {}, total or {}, first or {}
    ahead = ahead or {}
    owner = _PART not in df.columns
    base = tag_parts(df, split)
    parted = _PART in base.columns
    groups = [*keys, _PART] if parted else list(keys)
    w = Window.partitionBy(*groups).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {o: F.lag(c).over(w) for o, c in lag.items()}
    new |= {o: F.lead(c).over(w) for o, c in lead.items()}
    new |= {o: F.sum(c).over(upto) for o, c in total.items()}
    new |= {o: F.first(c).over(upto) for o, c in first.items()}
    new |= {o: F.collect_list(F.struct(F.col(c).alias("v"))).over(w.rowsBetween(1, n))
            for o, (c, n) in ahead.items()}
    if rank:
        new[rank] = F.row_number().over(w).cast("bigint")
    if not parted:
        if ahead:
            base = base.withColumns(new)
            return base.withColumns({o: F.transform(o, lambda x: x["v"]) for o in ahead})
        return base.withColumns(new)

    # one row per part, then one small window across the parts of each group
    at = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.max_by(F.struct(c), at)[c].alias(f"__last_{o}")
             for o, c in lag.items()]
    aggs += [F.min_by(F.struct(c), at)[c].alias(f"__first_{o}") for o, c in lead.items()]
    aggs += [F.min_by(F.struct(c), at)[c].alias(f"__head_{o}") for o, c in first.items()]
    aggs += [F.sum(c).alias(f"__sum_{o}") for o, c in total.items()]
    cut = base
    if ahead:
        # only the first rows of a part can be ahead of the rows before it
        depth = max(n for _, n in ahead.values())
        cut = cut.withColumn("__rn", F.row_number().over(w))
        aggs += [F.array_sort(F.collect_list(F.when(F.col("__rn") <= depth, F.struct("__rn", F.col(c).alias("v")))))
                 .alias(f"__heads_{o}") for o, (c, _) in ahead.items()]
    edges = cut.groupBy(*groups).agg(*aggs)
    across = Window.partitionBy(*keys).orderBy(_PART)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    header = {o: F.lag(f"__last_{o}").over(across) for o in lag}
    header |= {o: F.sum(f"__sum_{o}").over(before) for o in total}
    header |= {o: F.first(f"__head_{o}").over(before) for o in first}
    if rank:
        header[rank] = F.sum("__n").over(before)
    trailer = {o: F.array(F.lead(f"__first_{o}").over(across)) for o in lead}
    trailer |= {o: F.transform(F.slice(F.flatten(F.collect_list(f"__heads_{o}").over(across.rowsBetween(1, n))), 1, n), lambda x: x["v"])
                for o, (_, n) in ahead.items()}
    parts = edges.select(*groups, *[c.alias(f"__c_{o}") for o, c in header.items()], *[c.alias(f"__c_{o}") for o, c in trailer.items()],
                         F.lag(F.lit(1)).over(across).isNotNull().alias("__behind"), F.lead(F.lit(1)).over(across).isNotNull().alias("__beyond"))
    # what the rows before a part add up to comes as a row before its first, what follows it as rows after its last:
    # they travel with the rows in the one exchange, and plain windows take them up
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    empty = {o: F.lit(None).cast(kinds[f"__c_{o}"]) for o in header} | {o: F.lit(None).cast(kinds[f"__c_{o}"].elementType) for o in trailer}

    def carrier(kind: int, i: Column, **values: Column) -> Column:
        return F.struct(F.lit(kind).alias("__o_kind"), i.cast("int").alias("__o_i"), *[values.get(o, none).alias(f"__c_{o}") for o, none in empty.items()])

    sent = F.array(carrier(0, F.lit(0)))
    before_it = F.when(F.col("__behind"), F.array(carrier(-1, F.lit(0), **{o: F.col(f"__c_{o}") for o in header}))) if header else None
    after_it = None
    if trailer:
        sizes = [F.size(f"__c_{o}") for o in trailer]
        longest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
        after_it = F.when(F.col("__beyond"), F.transform(F.sequence(F.lit(1), longest), lambda i: carrier(
            1, i, **{o: F.get(f"__c_{o}", i - 1) for o in trailer})))
    none = F.slice(sent, 1, 0)
    carriers = parts.select(*groups, F.explode(F.concat(*[F.coalesce(x, none) for x in (before_it, after_it) if x is not None])).alias("__o"))
    carriers = carriers.select(*groups, "__o.*")
    rows = base.withColumns({"__o_kind": F.lit(0), "__o_i": F.lit(0)}).unionByName(carriers, allowMissingColumns=True)
    own = F.col("__o_kind") == 0
    w = Window.partitionBy(*groups).orderBy("__o_kind", "__o_i", *order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def source(o: str, c: Column) -> Column:
        return F.when(own, c).otherwise(F.col(f"__c_{o}"))

    new = {o: F.lag(source(o, F.col(c))).over(w) for o, c in lag.items()}
    new |= {o: F.lead(source(o, F.col(c))).over(w) for o, c in lead.items()}
    new |= {o: F.sum(source(o, F.col(c))).over(upto) for o, c in total.items()}
    new |= {o: F.first(source(o, F.col(c))).over(upto) for o, c in first.items()}
    new |= {o: F.collect_list(F.struct(source(o, F.col(c)).alias("v"))).over(w.rowsBetween(1, n))
            for o, (c, n) in ahead.items()}
    if rank:
        new[rank] = F.sum(source(rank, F.lit(1).cast("bigint"))).over(upto)
    out = rows.withColumns(new).where("__o_kind = 0")
    if ahead:
        out = out.withColumns({o: F.transform(o, lambda x: x["v"]) for o in ahead})
    out = out.drop("__o_kind", "__o_i", *[f"__c_{o}" for o in {**header, **trailer}])
    return drop_parts(out) if owner else out


def with_group_values(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Group totals, counts, extremes on every row, by aggregate-then-join instead of a window.

    The aggregate is combined before the shuffle, and the join splits a hot key (skew join).
    """
    named = [c.alias(n) for n, c in aggs.items()]
    if not keys:
        whole = df.agg(F.struct(*named).alias("v")).scalar()
        return df.withColumns({n: whole[n] for n in aggs})
    return join_back(df, df.groupBy(*keys).agg(*named), keys)


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each group in the order; a combinable aggregate, so no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def duplicate_sizes(df: DataFrame, keys: list[str], out: str = "n_same") -> DataFrame:
    """Rows with the size of their duplicate set."""
    return with_group_values(df, keys, **{out: F.count(F.lit(1))})


def dense_ids(df: DataFrame, keys: list[str], out: str = "id") -> DataFrame:
    """Number rows that are unique in ``keys`` 1..n in key order (NULL first), exactly.

    The rows are dealt out by key range and sorted there, and that table is checkpointed once, so every
    row keeps its place; a row's number is its place plus the rows of the ranges before its own. One row
    per range meets in one task, never the rows themselves.
    """
    at = F.monotonically_increasing_id()
    placed = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at))
    placed = placed.select(*df.columns, F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(starts, "__part").select(*df.columns, (F.col("__before") + F.col("__place") + 1).alias(out))


def group_key(keys: list[str]) -> Column:
    """Exact text key of a key combination, NULL parts included: equal only for equal parts."""
    parts = [F.when(F.col(k).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")))
             for k in keys]
    return F.concat(*parts)


def group_ids(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The rows with the number of their group, 1..n in key order (NULL parts included)."""
    return join_back(df, dense_ids(df.select(*keys).distinct(), keys, out), keys)


def even_parts(df: DataFrame, keys: list[str], column: str, rows: int = 1_000_000, points: int = 1024) -> DataFrame:
    """Tag rows for ``ordered`` with parts of about ``rows`` rows, found by one mergeable quantile sketch per key.

    A key with at most ``rows`` rows is one part, whatever its values; a larger one is cut at quantiles of the
    leading order column, so skewed values make no large part. Rows with equal values share a part. Beyond
    ``points`` * ``rows`` rows parts grow with the key.
    """
    value = F.col(column).cast("double")
    sketch = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(
        value, [i / points for i in range(1, points)], 4 * points).alias("__b")) if keys else df.agg(
            F.count(F.lit(1)).alias("__n"), F.percentile_approx(value, [i / points for i in range(1, points)], 4 * points).alias("__b"))
    n = F.least(F.ceil(F.col("__n") / F.lit(rows)), F.lit(points))
    # as many even steps through the sketch as the key needs parts, in blocks of 32 for a two-step search
    cuts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get("__b", F.floor(i * F.lit(points) / n).cast("int") - 1))
    cuts = sketch.where(n > 1).select(*keys, F.array_distinct(cuts).alias("__cuts"))
    cuts = cuts.withColumn("__tops", F.filter("__cuts", lambda x, i: i % 32 == 31))
    tagged = join_back(df, cuts, keys) if keys else df.join(cuts, F.lit(True), "left")
    block = F.size(F.filter("__tops", lambda x: x <= value))
    part = 32 * block + F.size(F.filter(F.slice("__cuts", 32 * block + 1, 32), lambda x: x <= value))
    found = F.when(value.isNotNull() & F.col("__cuts").isNotNull(), part).when(value.isNotNull(), F.lit(0))
    return tagged.withColumn(_PART, found).drop("__cuts", "__tops")


def drop_when_next_equal(df: DataFrame, keys: list[str], order: list[str], column: str,
                         split: Column | None = None) -> DataFrame:
    """Drop a row when the next one has the same value of ``column``."""
    nxt = ordered(df, keys, order, lead={"__next": column}, split=split)
    kept = nxt.where(F.col("__next").isNull() | (F.col("__next") != F.col(column)))
    return kept.drop("__next")


def distinct_running_count(df: DataFrame, keys: list[str], order: list[str], column: str,
                           out: str, split: Column | None = None) -> DataFrame:
    """Running number of distinct consecutive values of an ordered column (first row counts 1)."""
    df = ordered(tag_parts(df, split), keys, order, lag={"__prev": column})
    new = F.col("__prev").isNull() | (F.col("__prev") != F.col(column))
    df = df.withColumn("__step", new.cast("bigint")).drop("__prev")
    return drop_parts(ordered(df, keys, order, total={out: "__step"})).drop("__step")


def carry_first(df: DataFrame, keys: list[str], order: list[str], column: str,
                out: str) -> DataFrame:
    """First non-NULL value of the group on every row."""
    at = F.when(F.col(column).isNotNull(), F.struct(*order))
    return with_group_values(df, keys, **{out: F.min_by(column, at)})


def range_window_sum(df: DataFrame, keys: list[str], at: str, columns: dict[str, str],
                     back: int, ahead: int) -> DataFrame:
    """Sums over rows whose position lies within [at-back, at+ahead], on an aggregated series.

    The series is first reduced to one row per (keys, position); each row is then sent to the
    positions that see it, a fixed fan-out of back+ahead+1, and summed there. No ordered window
    is needed, so a single long series spreads over all tasks.
    """
    series = df.groupBy(*keys, at).agg(*[F.sum(c).alias(o) for o, c in columns.items()])
    moved = series.withColumn("__to", F.explode(F.sequence(
        F.col(at) - ahead, F.col(at) + back)))
    sums = moved.groupBy(*keys, F.col("__to").alias(at)).agg(
        *[F.sum(o).alias(f"{o}_win") for o in columns])
    return series.join(sums, [*keys, at], "left") if keys else series.join(sums, at, "left")
