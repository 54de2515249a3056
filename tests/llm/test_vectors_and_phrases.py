"""Centroid clustering, phrase collocations and embedding near-dedup against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from roadledger.llm import centroids, neighbour_graph, phrases, quotient

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, id long, vec string, n long, kept boolean, shard int, key int"


def made_vectors(n=260, dims=64, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)) / 8
    base[40:70] = base[40] + rng.normal(size=(30, dims)) * 0.02  # near copies
    base[80:110] = base[80]  # exact copies
    base[120] = base[121] * 3  # the same direction
    for i in range(130, 160):  # a chain: each one is near the next
        base[i] = base[i - 1] + rng.normal(size=dims) * 0.045
    rows = [(i, [float(x) for x in v.astype(np.float32)], 1, 2, -i, "x", 7, False, 3, 4) for i, v in enumerate(base)]
    odd = [None, [], [0.0] * dims, [1.0] * (dims - 1) + [None], [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [0.5] * 3, [0.5] * 3, [1e30] + [0.1] * (dims - 1)]
    rows += [(1000 + i, v, None, None, None, None, None, None, None, None) for i, v in enumerate(odd)]
    return [*rows, rows[5], (5, rows[6][1], *[None] * 8), (None, rows[7][1], *[None] * 8), (None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(made_vectors(), VECTORS).repartition(5)


def usable(v, dims):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def clusters_by_force(rows, dims, k, rounds):
    kept = [(r[0], [max(-centroids.REACH, min(centroids.REACH, math.floor(256 * x))) for x in np.array(r[1], np.float32).astype(float)]) for r in rows if usable(r[1], dims)]
    by_hash = sorted(kept, key=lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1]))
    c = [v for _, v in by_hash[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for i in range(len(c)):
            own = [v for (_, v), j in zip(kept, at) if j == i]
            c[i] = [sum(x) // len(own) for x in zip(*own)] if own else c[i]
    found = [(key, nearest(v)) for key, v in kept]
    inertia = Counter()
    for _, (d, i) in found:
        inertia[i] += d
    return sorted(((key, i, d, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest())
                   for key, (d, i) in found), key=repr)


@pytest.mark.parametrize("k", [7, 400])
def test_clusters_equal_brute_force(vectors, k):
    got = centroids.cluster_vectors(vectors, "vec_id", "embedding", dims=64, k=k, rounds=3)
    assert sorted(map(tuple, got.collect()), key=repr) == clusters_by_force(made_vectors(), 64, k, 3)
    assert centroids.cluster_vectors(vectors.where("vec_id > 5000"), "vec_id", "embedding", dims=64, k=k, rounds=3).collect() == []


def test_threshold_walk_stops_early_and_keeps_ties():
    rng = np.random.default_rng(1)
    for dims in (1, 2, 5, 64):
        c = rng.integers(-40, 40, (60, dims))
        c[30:35] = c[10:15]
        x = np.vstack([rng.integers(-60, 60, (500, dims)), c])
        far = ((x[:, None, :] - c[None]) ** 2).sum(2)
        number, best, spent = centroids.nearest(x, c)
        assert (best == far.min(1)).all() and (number == far.argmin(1)).all()
        assert spent < (0.5 if dims <= 2 else 1.01) * far.size


def test_quotient_filters_lose_nothing():
    rng = np.random.default_rng(2)
    for size, bits, range_bits in [(3, 21, 5), (3, 1, 9), (3, 30, 8), (5, 25, 3), (2, 5, 3), (3, 42, 6)]:
        p = quotient.Packing(size, bits, range_bits)
        ids = rng.integers(0, 1 << bits, (4000, size))
        ids[:900], ids[1000:1300] = ids[0], ids[1000]
        found, counts = np.unique(ids, axis=0, return_counts=True)
        hi, lo, n = p.counted(*p.pack(list(ids.T)))
        merged = []
        for number, cell in p.filters(hi, lo, n):
            assert all((a == b).all() for a, b in zip(p.decode(number, cell), p.merged(number, [cell])))
            merged.append(p.merged(number, [cell, cell]))
        hi, lo, n = (np.concatenate(x) for x in zip(*merged))
        back = p.unpack(hi, lo)
        order = np.lexsort(back.T[::-1])
        assert (back[order] == found).all() and (n[order] == 2 * counts).all()
    with pytest.raises(ValueError):
        quotient.Packing(3, 43, 0)


def collocations_by_force(rows, least, top):
    fold = {i: i + 32 for i in range(65, 91)}
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            own.update(tuple(words[i:i + m]) for m in (1, 2, 3) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cand.items():
            score, k = min(((1000000 * a * a) // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(h) > len(g) and 100 * b >= 50 * a and any(h[i:i + len(g)] == g for i in range(len(h))) for h, b in cand.items()):
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(c for g, c in f.items() if len(g) == 1)
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["New", "york", "city", "a", "b", "ÉTÉ", "été", "x\x01", "x", "日本", "the", "\x1c", "no\x00w"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ? ", "\x0b"]
    texts = ["".join(rng.choice(words) + rng.choice(ends if rng.random() < .3 else [" "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["new york city " * 5000, None, "", " . , ", *["same line"] * 40]
    rows = [(rng.choice(["en", "de", None]), t) for t in texts]
    schema = "lang string, text string, word string, id long, f long, n long, block string, score int, phrase string, k int"
    docs = spark.createDataFrame([(*r, "w", 1, 2, 3, "b", 4, "p", 5) for r in rows], schema).repartition(3)
    want = collocations_by_force(rows, 10, 40)
    assert sorted(map(tuple, phrases.collocations(docs, least=10, top=40).collect())) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if r[1] is None or "\x00" not in r[1]])
    clean = docs.where("text IS NULL OR NOT contains(text, '\0')")
    assert sorted(map(tuple, phrases.collocations(clean).collect())) == sorted(con.execute(phrases.COLLOCATION_SQL).fetchall())
    assert phrases.collocations(docs.where("lang = 'none'")).collect() == []


def links_by_force(rows, threshold):
    fit = [v is not None and len(v) > 0 and k is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for k, v in rows]
    unit = [neighbour_graph.unit(np.array([v], float))[0] if ok else None for (_, v), ok in zip(rows, fit)]
    n = len(rows)
    links = [[j for j in range(n) if j != i and fit[i] and fit[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        group, todo = {i}, [i]
        while todo:
            todo = [j for x in todo for j in links[x] if not (j in group or group.add(j))]
        root = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), root, rows[i][0] == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cut", [False, True])
def test_near_duplicates_equal_brute_force(vectors, monkeypatch, cut):
    if cut:  # several shards, and hot ones cut into parts
        for name, value in (("PART", 16), ("SHARD", 60), ("BATCH", 32)):
            monkeypatch.setattr(neighbour_graph, name, value)
    got = neighbour_graph.near_duplicates(vectors, "vec_id", "embedding", 0.9)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.select("vec_id", "embedding").collect()]
    want = links_by_force(rows, 0.9)
    found = sorted((tuple(r)[:4] for r in got.collect()), key=repr)
    if cut:  # shards may miss pairs, and never add any
        assert sum(r[1] for r in found) >= 0.95 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(found, want))
    else:
        assert found == want
    assert got.first()["audited_recall"] >= 0.95


def test_near_duplicates_without_any_vector(vectors):
    none = neighbour_graph.near_duplicates(vectors.where("embedding IS NULL"), "vec_id", "embedding")
    assert sorted((tuple(r) for r in none.collect()), key=repr) == sorted([(1000, 0, 1000, True, None), (None, 0, None, True, None)], key=repr)
    assert neighbour_graph.near_duplicates(vectors.where("vec_id > 5000"), "vec_id", "embedding").collect() == []


def test_graph_search_finds_what_the_threshold_asks():
    rng = np.random.default_rng(9)
    centres = neighbour_graph.unit(rng.normal(size=(40, 32)))
    u = neighbour_graph.unit(centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 32)) * rng.choice([0.02, 0.05, 0.1], (1500, 1)))
    truth = u @ u.T >= 0.9
    np.fill_diagonal(truth, False)
    found = neighbour_graph.in_range(u, neighbour_graph.graph(u), 0.9)
    assert not (found & ~truth).any() and found.sum() >= 0.97 * truth.sum()
    label = neighbour_graph.forest(found)
    assert all((label[np.flatnonzero(row)] == label[i]).all() for i, row in enumerate(found))
