"""Join operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.functions.text import strip_zeros
from roadledger.operators.names import (jaro_distance, match_keys, numbered, prefix_distances,
                                        ranked_characters, shared_needed)
from roadledger.operators.ordered import dense_ids, join_back, ordered
from roadledger.session import cut_lineage

# the functions below travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stands for a missing day.
NO_DAY = -2**40
#: A key of more rows is scanned in the parts that the caller names.
FEW_ROWS = 100_000


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], keep_unmatched: bool = False) -> DataFrame:
    """Many-to-one join to a table that is unique on the keys.

    No broadcast hint: the planner broadcasts the table when its measured size allows it.
    """
    return df.join(dim, keys, "left" if keep_unmatched else "inner")


def duplicate_keys(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that break the many-to-one rule, with their counts."""
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_code(left: DataFrame, right: DataFrame, keys: list[str],
               out: str = "merge_code") -> DataFrame:
    """Full outer join with 1 = left only, 2 = right only, 3 = both."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    joined = a.join(b, keys, "full_outer")
    code = F.when(F.col("__l") & F.col("__r"), 3).when(F.col("__l"), 1).otherwise(2)
    return joined.withColumn(out, code).drop("__l", "__r")


def positional_merge(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str],
                     right_order: list[str], left_split: Column | None = None,
                     right_split: Column | None = None, out: str = "merge_code") -> DataFrame:
    """Pair the i-th rows of both sides inside a key; the shorter side repeats its last row.

    NULL keys equal each other. Rows of a key on one side only stay, with NULLs for the other side;
    ``out`` is 1 = left only, 2 = right only, 3 = both.
    """
    count = F.count(F.lit(1)).alias("__n")
    l_n = left.groupBy(*keys).agg(count.alias("__ln"))
    r_n = right.groupBy(*keys).agg(count.alias("__rn"))

    def placed(df: DataFrame, order: list[str], n: str, rank: str, split: Column | None) -> DataFrame:
        # a key of few rows is one part: parts of a row each would send a carrier along with every row
        counted = join_back(join_back(df, l_n, keys), r_n, keys)
        return ordered(counted, keys, order, rank=rank, split=None if split is None else F.when(F.col(n) > FEW_ROWS, split))

    a = placed(left, left_order, "__ln", "__i", left_split)
    b = placed(right, right_order, "__rn", "__j", right_split)
    # the repeated last row of the shorter side becomes one row per missing position
    a = a.withColumn("__i", F.explode(F.when(
        (F.col("__i") == F.col("__ln")) & (F.col("__rn") > F.col("__ln")),
        F.sequence(F.col("__i"), F.col("__rn"))).otherwise(F.array("__i"))))
    b = b.withColumn("__j", F.explode(F.when(
        (F.col("__j") == F.col("__rn")) & (F.col("__ln") > F.col("__rn")),
        F.sequence(F.col("__j"), F.col("__ln"))).otherwise(F.array("__j"))))
    a, b = a.drop("__ln", "__rn"), b.drop("__ln", "__rn").withColumnsRenamed({k: f"__r_{k}" for k in keys})
    match = [F.col("__i") == F.col("__j"), *[F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]]
    both = a.join(b, reduce(lambda x, y: x & y, match), "full_outer")
    code = F.when(F.col("__j").isNull(), 1).when(F.col("__i").isNull(), 2).otherwise(3)
    own = [F.when(F.col("__i").isNull(), F.col(f"__r_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    rest = [F.col(c) for c in [*left.columns, *right.columns] if c not in keys]
    return both.select(*own, *rest, code.alias(out))


def window_match(openings: DataFrame, records: DataFrame, keys: list[str], open_year: str,
                 record_year: str, before: int, after: int, gap: str = "yr_gap") -> DataFrame:
    """Pairs within a key whose record year lies in [open - before, open + after].

    The window is turned into an equality on spans of as many years as it has: it touches two spans at
    most, so an opening is listed twice at most, however wide its window. The listed side is never broadcast:
    the planner measures it before it is listed.
    """
    width = before + after + 1
    span = lambda year: F.floor(year / width)
    first, last = span(F.col(open_year) - before), span(F.col(open_year) + after)
    listed = openings.withColumn("__span", F.explode(F.sequence(first, last))).hint("merge")
    pairs = listed.join(records.withColumn("__span", span(F.col(record_year))).hint("merge"), [*keys, "__span"])
    gap_years = F.col(record_year) - F.col(open_year)
    return pairs.where(gap_years.between(-before, after)).withColumn(gap, gap_years).drop("__span")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def lagged_join(series: DataFrame, other: DataFrame, keys: list[str], year: str,
                lags: range) -> DataFrame:
    """Join ``other`` at year - lag for every lag; adds the column ``lag``."""
    listed = series.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    moved = listed.withColumn("__at", F.col(year) - F.col("lag"))
    right = other.withColumnRenamed(year, "__at")
    return moved.join(right, [*keys, "__at"]).drop("__at")


def list_key_join(df: DataFrame, id_col: str, list_col: Column, other: DataFrame, key: str,
                  keep: list[str]) -> DataFrame:
    """Distinct (id, kept columns) of a join on any element of a list-valued key."""
    flat = df.select(id_col, F.explode(F.array_distinct(list_col)).alias(key))
    return flat.join(other, key).select(id_col, *keep).distinct()


def suffix_number(name: Column) -> Column:
    """Trailing number of a road name, for the numbered-route join."""
    return F.nullif(F.regexp_extract(name, r"([0-9]+)\s*$", 1), F.lit("")).try_cast("bigint")


def signed_routes(df: DataFrame, routes: DataFrame, keys: list[str], number: str, route_keys: list[str], route_number: str) -> DataFrame:
    """Left join on the keys and the number without leading zeros and blanks on both sides; every left row stays."""
    bare = routes.withColumns({"__n": strip_zeros(F.trim(F.col(route_number).cast("string")))} | {f"__r_{k}": F.col(k) for k in route_keys})
    bare = bare.drop(*[c for c in [*route_keys, route_number] if c in df.columns])
    match = [df[a] == bare[f"__r_{b}"] for a, b in zip(keys, route_keys)]
    left = strip_zeros(F.trim(df[number].cast("string")))
    return df.join(bare, reduce(lambda a, b: a & b, match, left == bare["__n"]), "left").drop("__n", *[f"__r_{k}" for k in route_keys])


def numbered_routes(requests: DataFrame, network: DataFrame, block: list[str], number: str,
                    name: str, kind: str, request_kind: str,
                    extra_kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """Network roads whose class equals and whose name ends in the requested number."""
    roads = network.withColumn("__no", suffix_number(F.col(name)))
    wanted = requests.where(F.col(number).isNotNull())
    if extra_kinds:
        kinds = F.lit(None).cast("array<string>")
        for k, more in extra_kinds.items():
            kinds = F.when(F.col(request_kind) == k, F.array(*map(F.lit, more))).otherwise(kinds)
        kinds = F.coalesce(kinds, F.array(F.col(request_kind)))
        wanted = wanted.withColumn("__kind", F.explode(kinds))
    else:
        wanted = wanted.withColumn("__kind", F.col(request_kind))
    roads = roads.select(*block, F.col(kind).alias("__kind"), "__no", F.col(name))
    return wanted.withColumn("__no", F.col(number).cast("bigint")).join(
        roads, [*block, "__kind", "__no"]).drop("__kind", "__no")


#: Parts that the rows of one key are dealt into by ``dealt_join``.
DEALT = 64


def dealt_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """All pairs of rows with equal keys, for few keys that hold many rows of both sides.

    The result of one key is far larger than its rows, so tasks are not left to follow the sizes of the inputs: the right
    rows of a key are dealt into parts by their hash, each meets all left rows of the key, and the parts are
    spread over all tasks whichever way the rows are then joined. Key columns keep the left names.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__key{i}" for i in range(len(on))]
    part = F.pmod(F.xxhash64(*right.columns), F.lit(DEALT)).cast("int")
    rows = right.select(*[F.col(r).alias(k) for k, (_, r) in zip(keys, on)], part.alias("__part"),
                        *[c for c in right.columns if c not in {r for _, r in on}])
    copies = left.select("*", *[F.col(c).alias(k) for k, (c, _) in zip(keys, on)], F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("__part"))
    met = [*keys, "__part"]
    return copies.repartition(tasks, *met).join(rows.repartition(tasks, *met), met).drop(*met)


def nearest_name(left: DataFrame, right: DataFrame, block: list[str], left_name: str,
                 right_name: str, max_distance: float = 0.1) -> DataFrame:
    """Best name on the right for each distinct name on the left, by Jaro distance.

    Exact for the accepted distances without comparing all names of a block: two names that close
    have similar lengths and share combinations of their rarest characters (see ``match_keys``),
    so the names meet on (block, both lengths, combination). Few pairs share several; the distance of
    these is worked out again. Ties go to the alphabetically first name. From a distance of a third on, lengths and
    characters say nothing, and all names of a block are compared.
    """
    share = 1.0 - 3.0 * max_distance

    def listed(df: DataFrame, name: str, out: str, lengths: tuple[str, str]) -> DataFrame:
        low = F.lower(F.col(name))
        names = df.where(F.col(name).isNotNull() & (low != "")).select(*block, low.alias(out)).distinct()
        own, other = lengths
        # few bytes but much work per name: keep the configured number of tasks
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        names = names.repartition(tasks, *block, out)
        names = names.withColumns({own: F.length(out), "__ranked": ranked_characters(F.col(out))})
        names = names.withColumn("__tokens", numbered(F.col("__ranked"))).drop("__ranked")

        def partner(n: Column) -> Column:
            need = shared_needed(F.col(own), n, max_distance)
            take = F.least(need, F.lit(3))
            return F.struct(n.cast("int").alias("other"), (F.col(own) - need + take).cast("int").alias("head"), take.alias("take"))

        lengths_met = F.sequence(F.greatest(F.ceil(F.col(own) * share - 1e-9), F.lit(1)), F.floor(F.col(own) / share + 1e-9))
        names = names.withColumn("__partners", F.transform(lengths_met, partner))
        names = names.select(*block, out, own, "__partners", F.explode(match_keys(F.col("__tokens"), F.col("__partners"))).alias("__k"))
        met = F.filter("__partners", lambda p: (p["take"] == F.col("__k.take")) & (p["head"] > F.col("__k.last")))
        return names.select(*block, out, own, F.col("__k.key").alias("__key"), F.explode(F.transform(met, lambda p: p["other"])).alias(other))

    if share > 1e-9:
        a = listed(left, left_name, "__a", ("__la", "__lb"))
        b = listed(right, right_name, "__b", ("__lb", "__la"))
        pairs = a.join(b, [*block, "__la", "__lb", "__key"])
    else:
        a, b = (df.where(F.lower(F.col(n)) != "").select(*block, F.lower(F.col(n)).alias(o)).distinct() for df, n, o in (
            (left, left_name, "__a"), (right, right_name, "__b")))
        pairs = a.join(b, block)
    scored = pairs.select(*block, "__a", "__b",
                          jaro_distance(F.col("__a"), F.col("__b")).alias("match_dist"))
    best = scored.where(F.col("match_dist") <= max_distance + 1e-12).groupBy(*block, "__a").agg(
        F.min(F.struct("match_dist", "__b")).alias("__m"))
    best = best.select(*block, F.col("__a").alias("name_key"), F.col("__m.__b").alias("matched_name"),
                       F.col("__m.match_dist").alias("match_dist"))
    names = left.select(*block, F.col(left_name), F.lower(F.col(left_name)).alias("name_key")).distinct()
    return names.join(best, [*block, "name_key"]).drop("name_key")


def first_tier(hits: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """Keep the hits of the best (lowest) tier of each key."""
    best = hits.groupBy(*keys).agg(F.min(tier).alias("__best"))
    return join_back(hits, best, keys).where(F.col(tier) == F.col("__best")).drop("__best")


def with_fallback(requests: DataFrame, keys: list[str], first: DataFrame,
                  second: DataFrame) -> DataFrame:
    """Union of the first method's hits and the second's for keys the first did not find."""
    rest = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.unionByName(rest, allowMissingColumns=True)


def nearest_record(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str],
                   left_at: str, right_at: str, right_tie: str, split_width: float) -> DataFrame:
    """Nearest right row by absolute difference inside a key, ties to the lowest ``right_tie``.

    Only the last position at or below and the first above can be nearest. Both sides are scanned
    once in order to count the right positions passed so far; the two candidates are then fetched
    by their number, so no pairs are formed.
    """
    spots = right.where(F.col(right_at).isNotNull()).groupBy(*keys, F.col(right_at).alias("__at")).agg(
        F.min(right_tie).alias("__tie"))
    mixed = spots.select(*keys, "__at", F.lit(0).alias("__side"), F.lit(1).alias("__one"),
                         "__tie", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left_id])
    mixed = mixed.unionByName(left.where(F.col(left_at).isNotNull()).select(
        *keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(0).alias("__one"),
        F.lit(None).cast(right.schema[right_tie].dataType).alias("__tie"), *left_id))
    split = F.floor(F.col("__at").cast("double") / split_width)
    seen = ordered(mixed, keys, ["__at", "__side", *left_id], total={"__k": "__one"}, split=split)
    numbered = seen.where("__side = 0").select(*keys, "__k", F.col("__at").alias("__r"), "__tie")
    probes = seen.where("__side = 1").select(*keys, *left_id, F.col("__at").alias("__l"),
                                             F.explode(F.array("__k", F.col("__k") + 1)).alias("__k"))
    gap = F.abs(F.col("__l").cast("double") - F.col("__r").cast("double"))
    best = probes.join(numbered, [*keys, "__k"]).groupBy(*keys, *left_id).agg(
        F.min(F.struct(gap.alias("gap"), F.col("__tie"), F.col("__r"))).alias("__m"))
    return best.select(*keys, *left_id, F.col("__m.__tie").alias(right_tie),
                       F.col("__m.__r").alias(right_at), F.col("__m.gap").alias("gap"))


def containment_sums(spans: DataFrame, segments: DataFrame, keys: list[str], span_id: list[str],
                     begin: str, end: str, seg_begin: str, seg_end: str, amount: str,
                     width: float, out: str = "total_inside") -> DataFrame:
    """Sum of an amount over segments that lie inside each span of the same key.

    Segments and spans meet on cells of ``width`` that the segment starts in. Whole cells strictly
    inside a span are summed once per cell (pre-aggregated when their segments also end inside
    the next cell), so a long span reads one row per cell instead of one per segment.
    """
    s = segments.withColumn("__cell", F.floor(F.col(seg_begin) / width).cast("bigint"))
    s = s.withColumn("__reach", F.floor(F.col(seg_end) / width).cast("bigint") - F.col("__cell"))
    lo = F.floor(F.col(begin) / width).cast("bigint")
    hi = F.floor(F.col(end) / width).cast("bigint")
    base = spans.select(*keys, *span_id, begin, end, lo.alias("__lo"), hi.alias("__hi"))
    # short segments (end in their own or the next cell) of cells lo+1 .. hi-2 are inside for sure
    inside = base.where("__hi - 2 >= __lo + 1").withColumn("__cell", F.explode(F.sequence(
        F.col("__lo") + 1, F.col("__hi") - 2)))
    cells = s.where("__reach <= 1").groupBy(*keys, "__cell").agg(
        F.sum(amount).alias("__v"), F.count(amount).alias("__n"))
    whole = inside.join(cells, [*keys, "__cell"]).select(*keys, *span_id, "__v", "__n")
    # every other segment is tested against the span
    edge = base.withColumn("__cell", F.explode(F.array_distinct(F.when(
        F.col("__hi") - F.col("__lo") < 3, F.sequence("__lo", "__hi")).otherwise(
        F.array(F.col("__lo"), F.col("__hi") - 1, F.col("__hi"))))))
    test = (F.col(seg_begin) >= F.col(begin)) & (F.col(seg_end) <= F.col(end))
    pick = [F.col(amount).alias("__v"), F.when(F.col(amount).isNotNull(), 1).otherwise(0)
            .cast("bigint").alias("__n")]
    seg_cols = s.select(*keys, "__cell", "__reach", seg_begin, seg_end, amount)
    tested = edge.join(seg_cols, [*keys, "__cell"]).where(test).select(*keys, *span_id, *pick)
    wide = inside.join(seg_cols.where("__reach > 1"), [*keys, "__cell"]).where(test).select(
        *keys, *span_id, *pick)
    sums = whole.unionByName(tested).unionByName(wide).groupBy(*keys, *span_id).agg(
        F.sum("__v").alias(out), F.sum("__n").alias("n_inside"))
    return spans.select(*keys, *span_id).join(sums, [*keys, *span_id], "left").select(
        *keys, *span_id, F.coalesce(out, F.lit(0.0)).alias(out),
        F.coalesce("n_inside", F.lit(0)).alias("n_inside"))


def within_distance(points: DataFrame, others: DataFrame, limit: float, x: str = "x", y: str = "y",
                    keys: list[str] | None = None) -> DataFrame:
    """Pairs closer than ``limit``: a grid of that cell size, own and neighbour cells, exact test."""
    keys = keys or []

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumns({"__cx": F.floor(F.col(x) / limit), "__cy": F.floor(F.col(y) / limit)})

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                       for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # points are small but each meets all others around it: a table of one split must not be one task
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = cells(points.repartition(tasks)).withColumn("__d", F.explode(around))
    a = a.withColumns({"__cx": F.col("__cx") + F.col("__d.i"), "__cy": F.col("__cy") + F.col("__d.j")})
    a = a.drop("__d").withColumnsRenamed({x: "__px", y: "__py"})
    b = cells(others)
    dist = F.sqrt(F.pow(F.col("__px") - F.col(x), 2) + F.pow(F.col("__py") - F.col(y), 2))
    pairs = a.join(b, [*keys, "__cx", "__cy"]).withColumn("distance", dist)
    return pairs.where(F.col("distance") <= limit).drop("__cx", "__cy", x, y).withColumnsRenamed(
        {"__px": x, "__py": y})


def record_match(left: DataFrame, right: DataFrame, keys: list[str], left_name: str,
                 right_name: str, left_date: str, right_date: str) -> DataFrame:
    """One-to-one match on repaired keys with checks: name distance, date gap, match group."""
    m = merge_code(left.dropDuplicates(keys), right.dropDuplicates(keys), keys)
    cut = F.upper(F.substring(F.col(left_name), F.lit(1), F.length(right_name)))
    dist = F.levenshtein(cut, F.upper(F.col(right_name))) / F.length(right_name)
    return m.withColumns({
        "name_distance": F.when(F.col("merge_code") == 3, dist),
        "date_gap": F.when(F.col("merge_code") == 3, F.datediff(left_date, right_date)),
        "match_group": F.element_at(F.array(F.lit("left only"), F.lit("right only"), F.lit("both")),
                                    F.col("merge_code"))})


def repair_keys(df: DataFrame, id_col: str, key: str, repairs: dict[int, str], drop: list[str] | None = None) -> DataFrame:
    """Rows with the listed keys dropped and the keys of listed ids replaced (a short, given list)."""
    rows = df.where(~F.coalesce(F.col(key).isin(*drop), F.lit(False))) if drop else df
    fixed = F.lit(None).cast(df.schema[key].dataType)
    for i, new in repairs.items():
        fixed = F.when(F.col(id_col) == i, F.lit(new)).otherwise(fixed)
    return rows.withColumn(key, F.coalesce(fixed, F.col(key)))


def _cheapest_of_block(row: dict, own_left: bool, n: int) -> tuple[np.ndarray, ...]:
    """The ``n`` cheapest partners of every asker of a chunk in a block, as (asker, partner, distance, days)."""
    own, other = row["owns"], row["others"]
    l, r = (own, other) if own_left else (other, own)
    length = np.array([x["length"] if x["length"] is not None else -1 for x in r])
    cut = np.array([[0 if x["name"] is None or k < 0 else min(k, x["length"]) if x["ends"] is None else ([0] + x["ends"])[min(k, len(x["ends"]))]
                     for x in l] for k in np.unique(length)])[np.unique(length, return_inverse=True)[1]]
    far = prefix_distances([x["name"] or "" for x in l], cut, [x["name"] or "" for x in r]).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where((length > 0)[:, None] & np.array([x["name"] is not None for x in l])[None, :], far / length[:, None], np.inf)
    day = [np.array([x["day"] if x["day"] is not None else NO_DAY for x in side], np.int64) for side in (l, r)]
    days = np.where((day[0] == NO_DAY)[None, :] | (day[1] == NO_DAY)[:, None], 2**31 - 1, np.abs(day[0][None, :] - day[1][:, None]))
    if own_left:
        far, days = far.T, days.T
    a, b = np.array([x["id"] for x in own]), np.array([x["id"] for x in other])

    def below(x: tuple, y: tuple) -> np.ndarray:
        return (x[0] < y[0]) | ((x[0] == y[0]) & ((x[1] < y[1]) | ((x[1] == y[1]) & (x[2] < y[2]))))

    pick = lambda side, f, no: np.array([x[f] if x[f] is not None else no for x in side])
    last = [pick(own, f, -1)[:, None] for f in ("far", "days", "partner")]
    held = [pick(other, f, np.inf if f == "far" else 2**62)[None, :] for f in ("far", "days", "partner")]
    usable = below(last, (far, days, b[None, :])) & below((far, days, a[:, None]), held)
    ranks = np.unique(far, return_inverse=True)[1].reshape(far.shape).astype(np.int64)
    # distance, days and id in one number
    bits = len(b).bit_length()
    order = np.where(usable, (ranks << (31 + bits)) | (days << bits) | np.argsort(np.argsort(b))[None, :], np.iinfo(np.int64).max)
    top = np.argpartition(order, n, axis=1)[:, :n] if n < len(b) else np.broadcast_to(np.arange(len(b)), order.shape)
    i, j = np.broadcast_to(np.arange(len(a))[:, None], top.shape).ravel(), top.ravel()
    keep = usable[i, j]
    i, j = i[keep], j[keep]
    return a[i], b[j], far[i, j], days[i, j]


def _offers_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists without the partners that hold a cheaper offer of another asker of the batch, each offer made in turn."""
    for batch in batches:
        own, lists = batch["own"].to_pylist(), batch["list"]
        first, flat = lists.offsets.to_pylist(), lists.flatten()
        first = [x - first[0] for x in first]
        far, days, other = (flat.field(f).to_pylist() for f in ("far", "days", "other"))
        held, at, turn = {}, first[:-1], list(range(len(own)))
        while turn:
            i = turn.pop()
            while at[i] < first[i + 1]:
                j = at[i]
                offer = (far[j], days[j], own[i], i)
                best = held.get(other[j])
                if best is None or offer < best:
                    held[other[j]] = offer
                    if best is not None:
                        at[best[3]] += 1
                        turn.append(best[3])
                    break
                at[i] += 1
        left = np.concatenate([np.arange(a, b) for a, b in zip(at, first[1:])] or [np.empty(0)]).astype(int)
        owns = np.repeat(np.array(own, np.int64), [b - a for a, b in zip(at, first[1:])])
        pick = lambda x, kind: pa.array(np.array(x, kind)[left])
        yield pa.RecordBatch.from_arrays([pa.array(owns), pick(other, np.int64), pick(far, float), pick(days, np.int64)], ["own", "other", "far", "days"])


def one_to_one(left: DataFrame, right: DataFrame, listed: int = 64, chunk: int = 64, block: int = 1024) -> DataFrame:
    """(l, r): ids of pairs of equal keys that use no id twice, chosen by name distance, days between dates, and ids.

    Both sides: (key, id long, name, length, ends, day). The pairs are never stored: blocks of both sides meet, and each id of the
    smaller side lists its ``listed`` cheapest partners. It offers itself to the first of its list; a partner holds its cheapest offer
    and turns every dearer one down for good. Where a list is used up, the next partners (four times as many) are listed, without those
    that hold a cheaper offer. As both sides order pairs alike, the result is that of taking pairs one by one in that order.
    """
    own_left = left.count() < right.count()
    own, other = (left, right) if own_left else (right, left)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, size: int) -> DataFrame:
        n = df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        return df.join(n, "key").withColumn("part", F.pmod(F.xxhash64("id"), "n").cast("int"))

    own, other = cut_lineage(dealt(own.distinct(), chunk)), cut_lineage(dealt(other.distinct(), block))
    parts = other.select("key", "n").distinct()
    pairs_schema = "own long, other long, far double, days long"

    def gathered(df: DataFrame, known: DataFrame, how: str, out: str) -> DataFrame:
        fields = ["id", "name", "length", "ends", "day", "far", "days", "partner"]
        return df.join(known, "id", how).groupBy("key", "part").agg(F.collect_list(F.struct(*fields)).alias(out))

    def cheapest(askers: DataFrame, how: str, held: DataFrame, n: int) -> DataFrame:
        """The ``n`` cheapest pairs of every asker, beyond its last pair and below what the partner holds."""
        asked = gathered(own, askers, how, "owns").join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        # few bytes but much work per row: keep the number of tasks, and give no task more than some hundred rows
        width = max(tasks, (asked.count() + 255) // 256)
        blocks = gathered(other, held, "left", "others").repartition(width, "key", "part")
        met = asked.repartition(width, "key", "part").hint("merge").join(blocks, ["key", "part"]).select("owns", "others")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    found = _cheapest_of_block({c: batch[c][i].as_py() for c in ("owns", "others")}, own_left, n)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["own", "other", "far", "days"])

        place = F.row_number().over(Window.partitionBy("own").orderBy("far", "days", "other"))
        pairs = met.mapInArrow(run, pairs_schema)
        return pairs.withColumn("i", place).where(F.col("i") <= n).drop("i")

    def ends(pairs: DataFrame, n: int) -> DataFrame:
        """The last pair of every full list; a shorter one has all partners that are left."""
        at = F.max(F.struct("far", "days", F.col("other").alias("partner"))).alias("at")
        return pairs.groupBy(F.col("own").alias("id")).agg(at, F.count(F.lit(1)).alias("c")).where(F.col("c") == n).select("id", "at.*")

    nothing = left.sparkSession.createDataFrame([], "id long, far double, days long, partner long")
    work = cut_lineage(cheapest(nothing, "left", nothing, listed))
    full = cut_lineage(ends(work, listed))
    while True:
        # what askers of the same first partner settle among themselves needs no round over all
        lists = work.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("far", "days", "other"))).alias("list"))
        work = lists.repartitionByRange(tasks, F.col("list")[0]["other"], "own").mapInArrow(_offers_of_batch, pairs_schema)
        work = cut_lineage(work)
        offers = cut_lineage(work.groupBy("own").agg(F.min(F.struct("far", "days", "other")).alias("at")).select("own", "at.*"))
        held = cut_lineage(offers.groupBy(F.col("other").alias("id")).agg(F.min(F.struct("far", "days", F.col("own").alias("partner"))).alias("at")).select("id", "at.*"))
        best = held.select(F.col("id").alias("other"), F.struct("far", "days", "partner").alias("held"))
        work = cut_lineage(work.join(best, "other", "left").where(
            F.col("held").isNull() | (F.struct("far", "days", F.col("own").alias("partner")) <= F.col("held"))).drop("held"))
        if offers.count() > held.count():
            continue
        used_up = full.join(work.select(F.col("own").alias("id")), "id", "left_anti")
        if not used_up.limit(1).count():
            return held.select(*(F.col(c).alias("l" if (c == "partner") == own_left else "r") for c in ("partner", "id")))
        listed *= 4
        more = cut_lineage(cheapest(used_up, "inner", held, listed))
        full = cut_lineage(full.join(used_up, "id", "left_anti").unionByName(ends(more, listed)))
        work = work.unionByName(more)


def external_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, left_name: str,
                   right_name: str, left_date: str, right_date: str) -> DataFrame:
    """Every record of both sides once: matched pairs of equal keys, then the records left alone.

    Pairs of a key are taken by name distance, then by the days between their dates, and no record
    is used twice. Adds name_distance (the start of the left name against the right one, per letter), date_gap in days, and
    merge_code and match_group (1 left only, 2 right only, 3 both). A missing key matches nothing.
    """
    def side(df: DataFrame, own: str, name: str, date: str) -> tuple[DataFrame, DataFrame]:
        ids = df.where(F.col(key).isNotNull() & F.col(own).isNotNull()).select(own).distinct()
        ids = cut_lineage(dense_ids(ids, [own], "id"))
        text = F.col(name)
        # where a letter has another length in capitals, the length in capitals of every prefix
        sizes = F.transform(F.split(text, ""), lambda c: F.length(F.upper(c)))
        ends = F.when(F.length(F.upper(text)) != F.length(text), F.transform(sizes, lambda _, i: F.aggregate(
            F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b)))
        return ids, df.where(F.col(key).isNotNull()).join(ids, own).select(
            F.col(key).alias("key"), "id", F.upper(text).alias("name"), F.length(text).alias("length"), ends.alias("ends"),
            F.unix_date(F.col(date).cast("date")).alias("day"))

    (l_ids, a), (r_ids, b) = side(left, left_id, left_name, left_date), side(right, right_id, right_name, right_date)
    chosen = one_to_one(a, b).join(l_ids.select(F.col("id").alias("l"), F.col(left_id).alias("__l")), "l").join(
        r_ids.select(F.col("id").alias("r"), F.col(right_id).alias("__r")), "r").select("__l", "__r")
    # the pairs of equal keys that were chosen, with the columns of both sides
    met = chosen.join(left, F.col("__l") == F.col(left_id))
    met = met.join(right.withColumnRenamed(key, "__key"), (F.col("__r") == F.col(right_id)) & (F.col(key) == F.col("__key"))).drop("__l", "__r", "__key")
    cut = F.upper(F.substring(F.col(left_name), F.lit(1), F.length(right_name)))
    both = met.withColumns({"name_distance": F.try_divide(F.levenshtein(cut, F.upper(F.col(right_name))), F.length(right_name)),
                            "date_gap": F.datediff(left_date, right_date)})
    both = both.dropDuplicates([left_id, right_id]).withColumn("merge_code", F.lit(3))
    alone = [df.join(both.select(i), i, "left_anti").withColumn("merge_code", F.lit(n)) for df, i, n in ((left, left_id, 1), (right, right_id, 2))]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alone, both)
    names = F.array(F.lit("left only"), F.lit("right only"), F.lit("both"))
    return out.withColumn("match_group", F.element_at(names, F.col("merge_code")))


def match_once(df: DataFrame, keys: list[str], match) -> DataFrame:
    """Match the distinct keys with ``match(distinct) -> DataFrame`` and join the results back."""
    return join_back(df, match(df.select(*keys).distinct()), keys)


def prefix_members(df: DataFrame, code: str, prefixes: list[str]) -> DataFrame:
    """Rows whose code starts with one of the given prefixes."""
    return df.where(reduce(lambda a, b: a | b, [F.col(code).startswith(p) for p in prefixes]))
