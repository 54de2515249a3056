"""Embedding near-dedup on a flat graph with robust pruning.

1. Equal vectors are one class with its number of copies. Centroids are fitted on a bounded sample of the classes
   (at most 32 for each centroid, ``MAX_CENTROIDS`` centroids); every class goes to the shards of its nearest
   ``overlap`` centroids. A shard of more than ``2 * PART`` classes is cut by hash into parts of about ``PART``, and every two
   parts make a shard of their own: no pair is lost and no task holds more.
2. Each shard builds a graph: vectors are put in by batches, a greedy search over the graph so far gives
   their candidates, and pruning drops a candidate that lies nearer, by the factor ``ALPHA``, to a neighbour already kept.
3. The neighbour lists of a class from all its shards are united.
4. Each class is searched in its shards over the united lists, greedily from the shard's medoids and its own place,
   then through all vectors in range (and a little below) and through links of links until no new one turns up.
   Cosines in double precision decide. A shard returns a count for each class and a spanning forest of the links
   it found, not the pairs. A pair that several shards hold counts in the first one.
5. Links of at most ``AUDIT`` classes are counted against all rows by brute force. While the graph finds less than
   ``LEAST_RECALL`` of them, everything is repeated with twice the overlap.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows without an id,
link with nothing, are their own component and stay; vectors of another length than most link among themselves only; rows that
repeat an id each count as a vector; all copies of a vector share its links. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.llm.common import drop_stored, stored
from roadledger.llm.links import components
from roadledger.operators.ordered import dense_ids

#: Neighbours of a vector in one shard's graph, vectors a greedy search keeps, and the pruning factor.
DEGREE, BEAM, ALPHA = 24, 40, 1.2
#: Vectors that are searched at once, and candidates that are opened at once.
BATCH, OPENED = 256, 4
#: Classes in a part of a cut shard, the mean size of a shard, and the most centroids.
PART, SHARD, MAX_CENTROIDS = 1024, 1200, 2048
#: Vectors this far below the threshold still lead on to others.
SLACK = 0.05
#: Classes whose links are counted by brute force, and the share that must be found.
AUDIT, LEAST_RECALL = 1000, 0.95


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pair_sims(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", u[a], u[b])


def _new(lists: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, vector) of the listed vectors of each row not seen before, once each; they count as seen from now on."""
    row = np.repeat(np.arange(len(lists)), lists.shape[1])
    at = lists.ravel()
    fresh = at >= 0
    row, at = row[fresh], at[fresh]
    fresh = ~seen[row, at]
    pair = np.unique(row[fresh] * np.int64(seen.shape[1]) + at[fresh])
    row, at = pair // seen.shape[1], pair % seen.shape[1]
    seen[row, at] = True
    return row, at


def greedy(u: np.ndarray, lists: np.ndarray, starts: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best vectors met [query, BEAM] (-1 for none) and sims [query, vector] (-2 where not met), from ``starts`` [query, any]."""
    n = len(u)
    sims = np.full((len(query), n), -2.0)
    seen, opened = np.zeros((len(query), n), bool), np.zeros((len(query), n), bool)
    beam = np.full((len(query), BEAM), -1)
    live, lists_now = np.arange(len(query)), starts
    while len(live):
        sub = seen[live]
        row, at = _new(lists_now, sub)
        seen[live] = sub
        sims[live[row], at] = _pair_sims(u, query[live[row]], at)
        width = int(np.bincount(row, minlength=1).max()) if len(row) else 0
        wide = np.full((len(live), BEAM + width), -1)
        wide[:, :BEAM] = beam[live]
        wide[row, BEAM + np.arange(len(row)) - np.searchsorted(row, row)] = at
        value = np.where(wide < 0, -3.0, sims[live[:, None], wide])
        order = np.argsort(-value, axis=1, kind="stable")[:, :BEAM]
        best = np.take_along_axis(wide, order, 1)
        beam[live] = best
        closed = (best >= 0) & ~opened[live[:, None], best]
        first = np.argsort(~closed, axis=1, kind="stable")[:, :OPENED]
        chosen = np.where(np.take_along_axis(closed, first, 1), np.take_along_axis(best, first, 1), -1)
        going = (chosen >= 0).any(1)
        live, chosen = live[going], chosen[going]
        row, col = np.nonzero(chosen >= 0)
        opened[live[row], chosen[row, col]] = True
        lists_now = np.where(chosen[:, :, None] >= 0, lists[chosen], -1).reshape(len(live), chosen.shape[1] * lists.shape[1])
    return beam, sims


def pruned(u: np.ndarray, at: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Neighbours [vector, DEGREE] of the vectors ``at`` from candidates [vector, any] (-1 for none), robustly pruned."""
    out = np.full((len(at), DEGREE), -1)
    for lo in range(0, len(at), BATCH):
        p, c = at[lo:lo + BATCH], candidates[lo:lo + BATCH]
        far = np.where(c < 0, np.inf, 2 - 2 * np.einsum("id,icd->ic", u[p], u[c]))
        far[c == p[:, None]] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        far, c = np.take_along_axis(far, order, 1), np.take_along_axis(c, order, 1)
        alive, uc, rows = np.isfinite(far), u[c], np.arange(len(p))
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        for r in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            k = alive.argmax(1)
            out[lo:lo + BATCH, r] = np.where(some, c[rows, k], -1)
            between = 2 - 2 * np.einsum("id,icd->ic", uc[rows, k], uc)
            alive &= ~(ALPHA * between < far)
            alive[rows, k] = False
    return out


def medoids(u: np.ndarray, count: int = 8) -> np.ndarray:
    """The vectors nearest to the means of ``count`` cells around evenly taken vectors, and to the mean of all."""
    pivots = np.unique(np.linspace(0, len(u) - 1, count).astype(int))
    cell = (u @ u[pivots].T).argmax(1)
    found = [int((u @ u.mean(0)).argmax())]
    for c in range(len(pivots)):
        members = np.flatnonzero(cell == c)
        if len(members):
            found.append(int(members[(u[members] @ u[members].mean(0)).argmax()]))
    return np.unique(found)


def graph(u: np.ndarray) -> np.ndarray:
    """Neighbour lists [vector, DEGREE] of a shard (-1 for none)."""
    n = len(u)
    order = np.random.default_rng(n).permutation(n)
    lists = np.full((n, DEGREE), -1)
    done, size = 0, min(n, 64)
    while done < n:
        new = order[done:done + size]
        inner = u[new] @ u[new].T
        near = np.argsort(-inner, axis=1, kind="stable")[:, :BEAM if not done else 9]
        candidates = new[near]
        if done:
            entries = order[medoids(u[order[:done]])]
            beam, _ = greedy(u, lists, np.broadcast_to(entries, (len(new), len(entries))), new)
            candidates = np.hstack([candidates, beam])
        lists[new] = pruned(u, new, candidates)
        # the other direction of every edge
        row, col = np.nonzero(lists[new] >= 0)
        to, frm = lists[new][row, col], new[row]
        by = np.lexsort((-_pair_sims(u, to, frm), to))
        to, frm = to[by], frm[by]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        fits = place < 2 * DEGREE  # the nearest ones
        wide = np.full((len(target), DEGREE + min(int(count.max(initial=0)), 2 * DEGREE)), -1)
        wide[:, :DEGREE] = lists[target]
        wide[np.repeat(np.arange(len(target)), count)[fits], DEGREE + place[fits]] = frm[fits]
        wide = -np.sort(-wide, axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        wide = -np.sort(-wide, axis=1)
        full = (wide >= 0).sum(1) > DEGREE
        lists[target[~full]] = wide[~full][:, :DEGREE] if wide.shape[1] >= DEGREE else wide[~full]
        if full.any():
            lists[target[full]] = pruned(u, target[full], wide[full])
        done, size = done + len(new), min(2 * size, BATCH)
    return lists


def in_range(u: np.ndarray, lists: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of the pairs of vectors with a cosine of ``threshold`` that range searches over ``lists`` find."""
    n = len(u)
    found, entries = np.zeros((n, n), bool), medoids(u)
    for lo in range(0, n, BATCH):
        query = np.arange(lo, min(lo + BATCH, n))
        starts = np.hstack([np.broadcast_to(entries, (len(query), len(entries))), query[:, None]])
        _, sims = greedy(u, lists, starts, query)
        opened, seen = np.zeros_like(sims, bool), sims > -2
        while True:
            row, at = np.nonzero((sims >= threshold - SLACK) & ~opened)
            if not len(row):
                break
            opened[row, at] = True
            for a in range(0, len(row), 1 << 14):
                to = lists[at[a:a + (1 << 14)]]
                flat = np.repeat(row[a:a + (1 << 14)], to.shape[1]) * np.int64(n) + to.ravel()
                flat = np.unique(flat[to.ravel() >= 0])
                r, c = flat // n, flat % n
                fresh = ~seen[r, c]
                r, c = r[fresh], c[fresh]
                seen[r, c] = True
                sims[r, c] = _pair_sims(u, query[r], c)
        found[query] = sims >= threshold
    found |= found.T
    np.fill_diagonal(found, False)
    # links of links, until none is new
    some = np.flatnonzero(found.any(1))
    inner, sims = found[np.ix_(some, some)], u[some] @ u[some].T >= threshold
    np.fill_diagonal(sims, False)
    while True:
        wide = inner.astype(np.float32)
        more = inner | (wide @ wide > 0) & sims
        if (more == inner).all():
            break
        inner = more
    found[np.ix_(some, some)] = inner
    return found


def forest(found: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches."""
    label = np.arange(len(found))
    row, col = np.nonzero(found)
    while True:
        low = label.copy()
        np.minimum.at(low, row, label[col])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    ids = table["id"].to_numpy()
    lists = graph(unit(_vectors(table["vec"])))
    return pa.table({"id": ids, "near": pa.array([ids[x[x >= 0]] for x in lists], pa.list_(pa.int64()))})


def _search(shard: int, i: int, j: int, threshold: float, table: pa.Table) -> pa.Table:
    """(id, n) links that this shard counts, and (id, to) of a forest of all that it found."""
    table = table.sort_by("id")
    ids, u = table["id"].to_numpy(), unit(_vectors(table["vec"]))
    near = table["near"].combine_chunks()
    size = np.diff(near.offsets.to_numpy())
    flat = near.flatten().to_numpy()
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    row = np.repeat(np.arange(len(ids)), size)
    here = ids[at] == flat
    row, at = row[here], at[here]
    lists = np.full((len(ids), max(int(np.bincount(row, minlength=1).max()), 1)), -1)
    lists[row, np.arange(len(row)) - np.searchsorted(row, row)] = at
    found = in_range(u, lists, threshold)
    label = forest(found)
    homes, part = _vectors(table["homes"]).astype(np.int64), table["part"].to_numpy()
    for home in np.unique(homes[homes < shard]):
        both = np.flatnonzero((homes == home).any(1))
        found[np.ix_(both, both)] = False
    if i != j:
        found &= part[:, None] != part[None, :]
    n = (found @ table["copies"].to_numpy().astype(np.float64)).astype(np.int64)
    moved = label != np.arange(len(ids))
    return pa.table({"id": np.append(ids, ids[moved]), "n": np.append(n, np.zeros(moved.sum(), np.int64)),
                     "to": pa.array(np.append(ids, ids[label[moved]]), pa.int64())})


def _fit(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions from a sample of unit vectors."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centroids)
        for lo in range(0, len(sample), 4096):
            part = sample[lo:lo + 4096]
            np.add.at(sums, (part @ centroids.T).argmax(1), part)
        held = np.abs(sums).max(1) > 1e-12
        centroids[held] = unit(sums[held])
    return centroids


def _homes(centroids: np.ndarray, overlap: int):
    """mapInArrow function: the shards of each class, smallest first; other lengths share a shard of their own."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["vec"].value_lengths().to_numpy(zero_copy_only=False)
            homes = np.repeat(-size[:, None].astype(np.int32), overlap, 1)
            fit = np.flatnonzero(size == centroids.shape[1])
            for lo in range(0, len(fit), 4096):
                some = fit[lo:lo + 4096]
                sims = unit(_vectors(batch["vec"].take(pa.array(some)))) @ centroids.T
                homes[some] = np.sort(np.argpartition(-sims, overlap - 1, axis=1)[:, :overlap], axis=1)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("id", "vec", "copies")], pa.array(list(homes), pa.list_(pa.int32()))],
                                             ["id", "vec", "copies", "homes"])
    return work


def _linked(classes: DataFrame, centroids: np.ndarray, overlap: int, threshold: float) -> DataFrame:
    """Stored rows (id, n, to) of all shards."""
    vec = classes.schema["vec"].dataType.simpleString()
    homes = classes.select("id", "vec", "copies").mapInArrow(_homes(centroids, overlap), f"id long, vec {vec}, copies long, homes array<int>")
    homes = stored(homes, "homes")
    dealt = homes.select("*", F.explode(F.array_distinct("homes")).alias("shard"))
    parts = dealt.groupBy("shard").count().select("shard", F.when(F.col("count") > 2 * PART, F.ceil(F.col("count") / PART)).otherwise(1).cast("int").alias("parts"))
    dealt = dealt.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id", "shard"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "vec", "copies", "homes", "part")
    lists = dealt.select("shard", "i", "j", "id", "vec").groupBy("shard", "i", "j").applyInArrow(lambda key, t: _build(t), "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    placed = dealt.join(united, "id").groupBy("shard", "i", "j")
    out = stored(placed.applyInArrow(lambda key, t: _search(*[k.as_py() for k in key], threshold, t), "id long, n long, to long"), "links")
    drop_stored(homes)
    return out


def audited_links(classes: DataFrame, audit: int, threshold: float) -> DataFrame:
    """(id, truth): links of at most ``audit`` classes, counted against all rows in blocks."""
    sample = classes.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(audit).toArrow()
    by_size = {}
    for k, v in zip(sample["id"].to_pylist(), sample["vec"].to_pylist()):
        by_size.setdefault(len(v), ([], []))[0].append(k)
        by_size[len(v)][1].append(v)
    asked = {size: (np.array(ids), unit(np.array(vecs, np.float64))) for size, (ids, vecs) in by_size.items()}

    def work(batches):
        total = {}
        for batch in batches:
            size = batch["vec"].value_lengths().to_numpy(zero_copy_only=False)
            for s, (ids, u) in asked.items():
                some = np.flatnonzero(size == s)
                for lo in range(0, len(some), 4096):
                    rows = batch.take(pa.array(some[lo:lo + 4096]))
                    near = unit(_vectors(rows["vec"])) @ u.T >= threshold
                    near &= rows["id"].to_numpy()[:, None] != ids[None, :]
                    total[s] = total.get(s, 0) + rows["copies"].to_numpy().astype(np.float64) @ near
        for s, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[s][0], pa.int64()), pa.array(n.astype(np.int64))], ["id", "n"])

    return classes.select("id", "vec", "copies").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("truth"))


def near_duplicates(df: DataFrame, key: str, vector: str, threshold: float = 0.9, overlap: int = 2) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept, and the audited recall of the links (null without any)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    v = F.col(vector)
    unfit = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fit = F.col(key).isNotNull() & (F.size(v) > 0) & ~unfit & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("vec"), F.coalesce(fit, F.lit(False)).alias("fit"))
    good = rows.where("fit")
    # numbered by their smallest id, so the smallest number of a group has the group's smallest id
    classes = good.groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stored(dense_ids(classes, ["first", "vec"], "id"), "classes")
    n = classes.count()
    shards = max(1, min(MAX_CENTROIDS, -(-n * overlap // SHARD)))
    lengths = classes.groupBy(F.size("vec").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    sample = classes.where(F.size("vec") == (lengths[0]["s"] if lengths else 0)).orderBy(F.xxhash64("id"), "id").limit(32 * shards).select("vec").toArrow()
    recall, truth = None, stored(audited_links(classes, AUDIT, threshold), "truth")
    linked = None
    if sample.num_rows:
        units = unit(_vectors(sample["vec"]))
        centroids = _fit(units, min(shards, len(units)))
        while True:
            overlap = min(overlap, len(centroids))
            linked = _linked(classes, centroids, overlap, threshold)
            got = truth.join(linked.groupBy("id").agg(F.sum("n").alias("n")), "id").agg(F.sum("truth").alias("t"), F.sum("n").alias("n")).first()
            recall = got["n"] / got["t"] if got["t"] else None
            if recall is None or recall >= LEAST_RECALL or overlap == len(centroids):
                break
            drop_stored(linked)
            overlap *= 2
    drop_stored(truth)
    if linked is None:
        result = classes.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("first").alias("component_id"))
    else:
        counts = linked.groupBy("id").agg(F.sum("n").alias("n"))
        groups = components(linked.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
        groups = groups.join(classes.select(F.col("id").alias("root"), F.col("first").alias("component_id")), "root").select("id", "component_id")
        result = classes.join(counts, "id", "left").join(groups, "id", "left").select(
            "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    joined = good.join(result, "vec").select("id", "n_links", "component_id")
    alone = rows.where("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
