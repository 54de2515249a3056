"""Interval operators on mile-post segments: chains, gaps, overlaps, fill rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.operators.ordered import (drop_parts, first_row, group_key, join_back,
                                          ordered, tag_parts, with_group_values)
from roadledger.session import cut_lineage


def chain(df: DataFrame, keys: list[str], start: str, end: str, tie: list[str],
          breaks: dict[str, float] | None = None, tolerance: float | None = 0.01,
          order: list[str] | None = None, solo_if_null: bool = True,
          out: str = "chain_seq", split: Column | None = None) -> DataFrame:
    """Number contiguous runs of intervals inside each key, along the start position.

    A run breaks when the start is farther than ``tolerance`` from the previous end, or when a
    column of ``breaks`` differs from the previous row by more than its limit. Rows with a NULL
    key form chains of their own: they get a NULL number, and ``chain_key`` tells them apart.
    """
    order = order or [start, *tie]
    breaks = breaks or {}
    solo = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    prev = {f"__p_{c}": c for c in breaks} | ({"__p_end": end} if tolerance is not None else {})
    marked = df.withColumn("__solo", solo if solo_if_null else F.lit(False))
    work = marked.where(~F.col("__solo"))
    work = tag_parts(work.withColumn("__one", F.lit(1)), split)
    work = ordered(work, keys, order, lag=prev | {"__seen": "__one"})
    tests = [F.col("__seen").isNull()]
    if tolerance is not None:
        # a missing border counts as a break, like a comparison with a value above every number
        tests.append(F.coalesce(F.abs(F.col(start) - F.col("__p_end")) > tolerance, F.lit(True)))
    tests += [F.coalesce(F.abs(F.col(c) - F.col(f"__p_{c}")) > lim, F.lit(True))
              for c, lim in breaks.items()]
    work = work.withColumn("__break", reduce(lambda a, b: a | b, tests).cast("bigint"))
    work = drop_parts(ordered(work, keys, order, total={out: "__break"}))
    work = work.drop("__break", "__one", "__seen", "__solo", *prev)
    work = work.withColumn("chain_key", group_key([*keys, out]))
    if not solo_if_null:
        return work
    alone = marked.where(F.col("__solo")).drop("__solo").withColumn(out, F.lit(None).cast("bigint"))
    alone = alone.withColumn("chain_key", group_key([*keys, *order]))
    return work.unionByName(alone)


def collapse_chains(df: DataFrame, keys: list[str], seq: str, start: str, end: str, length: str,
                    first: list[str] | None = None, order: list[str] | None = None,
                    spans: list[str] | None = None) -> DataFrame:
    """One row per chain: summed length, outer borders, count, first attributes, min/max spans."""
    order = order or [start]
    aggs = [F.sum(length).alias("chain_len"), F.min(start).alias(start), F.max(end).alias(end),
            F.count(F.lit(1)).alias("n_segments")]
    aggs += [F.min_by(c, F.struct(*order)).alias(c) for c in first or []]
    for c in spans or []:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys, seq).agg(*aggs)


def link_gaps(df: DataFrame, keys: list[str], start: str, end: str, tie: list[str],
              zero: float = 0.01, cancel: float = 0.001, split: Column | None = None) -> DataFrame:
    """Gap to the previous interval's end, with near-zero gaps cleared and neighbours cancelled.

    A gap is cancelled when the previous or next gap of the route has almost the same size.
    """
    order = [start, *tie]
    df = ordered(tag_parts(df, split), keys, order, lag={"__p": end})
    gap = F.round(F.col(start) - F.col("__p"), 9)
    df = df.withColumn("link_gap", F.when(F.abs(gap) < zero, F.lit(0.0)).otherwise(gap)).drop("__p")
    df = drop_parts(ordered(df, keys, order, lag={"__g0": "link_gap"}, lead={"__g1": "link_gap"}))

    def close(other: str) -> Column:
        near = F.abs(F.abs(F.col(other)) - F.abs(F.col("link_gap"))) <= cancel
        return F.coalesce(near, F.lit(False))

    adj = F.when(close("__g0") | close("__g1"), F.lit(0.0)).otherwise(F.col("link_gap"))
    return df.withColumn("link_gap_adj", adj).drop("__g0", "__g1")


def route_continuity(gaps: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per route: broken / overlap flags and totals; totals that cancel out are cleared."""
    g = F.col("link_gap_adj")
    out = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"),
        (F.max(end) - F.min(start)).alias("route_length"),
        F.coalesce(F.max((g > 0).cast("int")), F.lit(0)).alias("any_broken"),
        F.coalesce(F.max((g < 0).cast("int")), F.lit(0)).alias("any_overlap"),
        F.coalesce(F.sum(F.when(g > 0, g)), F.lit(0.0)).alias("total_broken"),
        F.coalesce(-F.sum(F.when(g < 0, g)), F.lit(0.0)).alias("total_overlap"))
    balance = F.round(F.col("total_broken") - F.col("total_overlap"), 3)
    out = out.withColumn("total_balance", balance)
    level = F.col("total_balance") == 0
    return out.withColumns({c: F.when(level, F.lit(0.0)).otherwise(F.col(c))
                            for c in ("total_broken", "total_overlap")})


def continuity_shares(routes: DataFrame) -> DataFrame:
    """Share of routes that are continuous, broken, overlapped; summed breaks and overlaps."""
    return routes.agg(
        F.count(F.lit(1)).alias("n_routes"),
        F.avg(((F.col("any_broken") == 0) & (F.col("any_overlap") == 0)).cast("double")).alias("share_continuous"),
        F.avg(F.col("any_broken").cast("double")).alias("share_broken"),
        F.avg(F.col("any_overlap").cast("double")).alias("share_overlap"),
        F.sum("total_broken").alias("total_broken"), F.sum("total_overlap").alias("total_overlap"))


def opening_gaps(df: DataFrame, cell: list[str], first_year: str, last_year: str, amount: str,
                 tie: list[str] | None = None, split: Column | None = None) -> DataFrame:
    """Years between successive openings of a cell, the opening's ordinal, cell count, min gap, span."""
    order = [last_year, first_year, *(tie or [])]
    df = ordered(df, cell, order, lag={"__p": last_year}, rank="opening_no", split=split)
    df = df.withColumn("gap", F.col(first_year) - F.col("__p")).drop("__p")
    return with_group_values(
        df, cell, n_openings=F.count(F.lit(1)), min_gap=F.min("gap"), cell_amount=F.sum(amount),
        span=F.max(last_year) - F.min(first_year))


def clean_cells(gaps: DataFrame, cell: list[str], min_gap: float) -> DataFrame:
    """Cells with a single opening, or whose openings are all at least ``min_gap`` years apart."""
    keep = (F.col("n_openings") == 1) | F.coalesce(F.col("min_gap") >= min_gap, F.lit(False))
    return gaps.where(keep).select(*cell).distinct()


def attribution_classes(gaps: DataFrame, cell: list[str], wide: float, narrow: float) -> DataFrame:
    """Cells and miles that are single, well spaced or tight, at two separations, with percents."""
    cells = gaps.groupBy(*cell).agg(F.max("n_openings").alias("n"), F.max("min_gap").alias("g"),
                                    F.max("cell_amount").alias("m"))
    multi = F.col("n") > 1
    labels = F.filter(F.array(
        F.when(F.col("n") == 1, "single"),
        F.when(multi, F.when(F.col("g") >= wide, "spaced_wide").otherwise("tight_wide")),
        F.when(multi, F.when(F.col("g") >= narrow, "spaced_narrow").otherwise("tight_narrow"))),
        lambda c: c.isNotNull())
    totals = cells.agg(F.count(F.lit(1)).alias("__nc"), F.sum("m").alias("__nm"))
    by_class = cells.withColumn("category", F.explode(labels)).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("m").alias("amount"))
    n_all, m_all = totals.select("__nc").scalar(), totals.select("__nm").scalar()
    return by_class.withColumns({"pct_cells": 100.0 * F.col("n_cells") / n_all,
                                 "pct_amount": 100.0 * F.col("amount") / m_all})


def continuity_flags(df: DataFrame, keys: list[str], start: str, length: str, tie: list[str],
                     tolerance: float = 100, split: Column | None = None) -> DataFrame:
    """Whether the next start equals this end exactly (``check1``) or within a tolerance (``check0``)."""
    df = ordered(df, keys, [start, *tie], lead={"__n": start}, split=split)
    end = F.col(start) + F.col(length)
    near = F.coalesce(F.abs(F.col("__n") - end) < tolerance, F.lit(False))
    same = F.coalesce(F.col("__n") == end, F.lit(False))
    return df.withColumns({"check0": near, "check1": same}).drop("__n")


def drop_overlaps(df: DataFrame, keys: list[str], start: str, length: str, tie: list[str],
                  tolerance: float = 100, slack: float = 50, depth: int = 5,
                  block_rows: int = 50_000, split: Column | None = None) -> DataFrame:
    """Remove repeated segments: after a discontinuity, drop up to ``depth`` later rows while the
    start after them fits the reference end better.

    How far the scan moves from a row depends only on that row and the few after it, so it is a
    column: 1 for a continuous row, 2 + dropped rows otherwise. Which rows the scan visits is a
    chain of such jumps. Blocks of ``block_rows`` rows first answer, for each of the possible
    entry offsets, where the scan leaves the block; the answers are chained per route; then each
    block replays the scan from its true entry. A long route is never held by one task.
    """
    order = [start, *tie]
    df = ordered(df, keys, order, rank="__rn", ahead={"__next": (start, depth + 2)}, split=split)
    end = F.col(start) + F.col(length)
    nxt = [F.try_element_at("__next", F.lit(i)) for i in range(1, depth + 3)]
    continuous = F.coalesce(F.abs(nxt[0] - end) < tolerance, F.lit(False))
    better = [F.coalesce(F.abs(nxt[i + 1] - end) < F.abs(nxt[i] - end), F.lit(False))
              for i in range(depth)]
    run = F.lit(0)
    for fits in reversed(better):
        run = F.when(fits, run + 1).otherwise(F.lit(0))
    dropped = F.when(nxt[0].isNull() | continuous | ~(end > nxt[0] - slack), 0).otherwise(run)
    jump = F.when(nxt[0].isNull() | continuous, 1).otherwise(dropped + 2)
    df = df.withColumns({"__drop": dropped.cast("int"), "__jump": jump.cast("int"),
                         "__block": F.floor((F.col("__rn") - 1) / block_rows)}).drop("__next")
    df = cut_lineage(df)  # read three times below
    names = [f"__key{i}" for i in range(len(keys))]
    types = [df.schema[k].dataType.simpleString() for k in keys]
    steps = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                      "__block", "__rn", "__jump", "__drop")
    reach = depth + 2

    def repeat(pdf: pd.DataFrame, times: int) -> dict:
        return {n: pd.Series([pdf[n].iloc[0]] * times, dtype=object) for n in names}

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn")
        jumps = pdf["__jump"].to_numpy()
        size = len(jumps)
        # exit offset of every row, from the last row back
        out = [0] * (size + reach)
        for i in range(size + reach - 1, -1, -1):
            out[i] = i - size if i >= size else out[i + jumps[i]]
        head = pdf.iloc[0]
        return pd.DataFrame({**repeat(pdf, 1), "__block": [head["__block"]],
                             "__exit": [[int(out[e]) for e in range(reach)]]})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        entry, entries = 0, []
        for exits in pdf["__exit"]:
            entries.append(entry)
            entry = int(exits[entry])
        return pd.DataFrame({**repeat(pdf, len(pdf)), "__block": pdf["__block"].to_numpy(), "__entry": entries})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn")
        jumps, drops = pdf["__jump"].to_numpy(), pdf["__drop"].to_numpy()
        first_rn = int(pdf["__rn"].iloc[0])
        at, gone = int(pdf["__entry"].iloc[0]), []
        while at < len(jumps):
            gone.extend(first_rn + at + d for d in range(1, drops[at] + 1))
            at += jumps[at]
        return pd.DataFrame({**repeat(pdf, len(gone)), "__gone": pd.Series(gone, dtype="int64")})

    key_ddl = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))
    # only routes of several blocks need entries, and only blocks with something to drop a replay
    blocks = steps.groupBy(*names, "__block").agg(F.max("__drop").alias("__d"))
    long_routes = blocks.where("__block > 0").select(*names).distinct()
    exits = steps.join(long_routes, names, "left_semi").groupBy(*names, "__block").applyInPandas(
        leave, f"{key_ddl}, `__block` bigint, `__exit` array<int>")
    entries = exits.groupBy(*names).applyInPandas(link, f"{key_ddl}, `__block` bigint, `__entry` int")
    dirty = steps.join(blocks.where("__d > 0").select(*names, "__block"), [*names, "__block"], "left_semi")
    started = join_back(dirty, entries, [*names, "__block"])
    started = started.withColumn("__entry", F.coalesce("__entry", F.lit(0)))
    gone = started.groupBy(*names, "__block").applyInPandas(replay, f"{key_ddl}, `__gone` bigint")
    gone = gone.select(*[F.col(n).alias(k) for k, n in zip(keys, names)],
                       F.col("__gone").alias("__rn"), F.lit(True).alias("__out"))
    kept = join_back(df, gone, [*keys, "__rn"]).where(F.col("__out").isNull())
    return kept.drop("__out", "__rn", "__drop", "__jump", "__block")


def gap_rows(df: DataFrame, keys: list[str], start: str, length: str, tie: list[str],
             blank: list[str], limit: float = 100, split: Column | None = None) -> DataFrame:
    """Add a row with blank attributes for every gap above ``limit`` and for a late first start."""
    df = df.withColumn("__one", F.lit(1))
    df = ordered(df, keys, [start, *tie], lag={"__ps": start, "__pl": length, "__seen": "__one"},
                 split=split)
    prev_end = F.when(F.col("__seen").isNull(), F.lit(0.0)).otherwise(F.col("__ps") + F.col("__pl"))
    gap = F.when(F.col("__seen").isNull(), F.col(start) != 0).otherwise(
        F.col(start) - prev_end > limit)
    df = df.withColumns({"__pe": prev_end, "gap": F.coalesce(gap, F.lit(False)).cast("int")})
    fill = df.where("gap = 1")
    fill = fill.withColumn(length, F.col(start) - F.col("__pe")).withColumn(start, F.col("__pe"))
    fill = fill.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in blank})
    both = df.withColumn("is_fill", F.lit(0)).unionByName(fill.withColumn("is_fill", F.lit(1)))
    return both.drop("__ps", "__pl", "__seen", "__one", "__pe")


def subtract_first(df: DataFrame, keys: list[str], column: str, when: Column) -> DataFrame:
    """Rebase a position to the group's lowest one where the condition holds."""
    df = with_group_values(df, keys, __low=F.min(column))
    moved = F.when(when, F.col(column) - F.col("__low")).otherwise(F.col(column))
    return df.withColumn(column, moved).drop("__low")


def repeated_segments(df: DataFrame, keys: list[str], start: str, end: str, tie: list[str],
                      split: Column | None = None) -> DataFrame:
    """Drop a segment when the next of its route ends at the same place, then exact repeats."""
    nxt = ordered(df, keys, [end, start, *tie], lead={"__n": end}, split=split)
    kept = nxt.where(F.col("__n").isNull() | (F.col("__n") != F.col(end))).drop("__n")
    return first_row(kept, [*keys, start, end], tie)
