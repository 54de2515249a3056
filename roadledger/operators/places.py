"""Areas as boundary edges and rings: adjacency, outlines, shared and near borders, directional halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.operators.linear import cells_along
from roadledger.operators.ordered import ordered


def boundary_edges(vertices: DataFrame, keys: list[str], ring: str = "part", seq: str = "seq",
                   split: Column | None = None) -> DataFrame:
    """Ring vertices (closed: last equals first) to undirected boundary edges."""
    v = ordered(vertices.select(*keys, ring, seq, "x", "y"), [*keys, ring], [seq],
                lead={"x2": "x", "y2": "y"}, split=split).where(F.col("x2").isNotNull())
    p, q = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return v.select(*keys, F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2",
                    F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).where(F.col("p") != F.col("q"))


def neighbours(vertices: DataFrame, area: str) -> DataFrame:
    """Pairs of areas that share a boundary vertex (a vertex belongs to a handful of areas)."""
    v = vertices.select(area, "x", "y").distinct()
    other = v.withColumnRenamed(area, f"{area}_other")
    return v.join(other, ["x", "y"]).where(F.col(area) != F.col(f"{area}_other")).select(
        area, f"{area}_other").distinct()


def dissolve(edges: DataFrame, parent: list[str]) -> DataFrame:
    """Outline of the union: boundary edges that occur once inside the parent."""
    return edges.groupBy(*parent, "p", "q").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")


def shared_border(edges: DataFrame, area: str, pairs: DataFrame) -> DataFrame:
    """Common boundary edges of given (area, area_other) pairs."""
    mine = pairs.join(edges.select(area, "p", "q").distinct(), area)
    theirs = edges.select(F.col(area).alias(f"{area}_other"), "p", "q").distinct()
    return mine.join(theirs, [f"{area}_other", "p", "q"])


def centroids(edges: DataFrame, area: str) -> DataFrame:
    """Area centroids from directed ring edges, taken about the box corner for accuracy."""
    box = edges.groupBy(area).agg(F.min("x1").alias("ox"), F.min("y1").alias("oy"))
    e = edges.join(box, area)
    x1, y1 = F.col("x1") - F.col("ox"), F.col("y1") - F.col("oy")
    x2, y2 = F.col("x2") - F.col("ox"), F.col("y2") - F.col("oy")
    cross = x1 * y2 - x2 * y1
    s = e.groupBy(area).agg(F.sum(cross).alias("a2"), F.sum((x1 + x2) * cross).alias("sx"),
                            F.sum((y1 + y2) * cross).alias("sy"), F.min("ox").alias("ox"), F.min("oy").alias("oy"))
    return s.select(area, (F.col("ox") + F.try_divide(F.col("sx"), 3 * F.col("a2"))).alias("cx"),
                    (F.col("oy") + F.try_divide(F.col("sy"), 3 * F.col("a2"))).alias("cy"),
                    F.abs(F.col("a2") / 2).alias("area_m2"))


def direction_word(c: Column) -> Column:
    """Direction words and abbreviations to north / south / east / west, else NULL."""
    d = F.lower(F.trim(c))
    out = F.lit(None).cast("string")
    for name in ("north", "south", "east", "west"):
        out = F.when(d.isin(name[0], name, f"{name}bound", f"{name[0]}b"), name).otherwise(out)
    return out


def _beyond(direction: Column, x: Column, y: Column) -> Column:
    """How far a point lies on the asked side of the centroid cx, cy."""
    return (F.when(direction == "north", y - F.col("cy")).when(direction == "south", F.col("cy") - y)
            .when(direction == "east", x - F.col("cx")).when(direction == "west", F.col("cx") - x))


def _crossing(direction: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Where the segment x1, y1, x2, y2 crosses the line through the centroid."""
    t = F.try_divide(s1, s1 - s2)
    upright = direction.isin("east", "west")
    return (F.when(upright, F.col("cx")).otherwise(F.col("x1") + t * (F.col("x2") - F.col("x1"))),
            F.when(upright, F.col("y1") + t * (F.col("y2") - F.col("y1"))).otherwise(F.col("cy")))


def directional_half(edges: DataFrame, centres: DataFrame, area: str, direction: str) -> DataFrame:
    """Boundary lines on the asked side of the centroid, cut where they cross the line through it."""
    e = edges.join(centres, area)
    d = F.col(direction)
    e = e.withColumns({"__s1": _beyond(d, F.col("x1"), F.col("y1")), "__s2": _beyond(d, F.col("x2"), F.col("y2"))})
    s1, s2 = F.col("__s1"), F.col("__s2")
    e = e.where((F.greatest(s1, s2) > 0) | ((s1 == 0) & (s2 == 0)))
    x, y = _crossing(d, s1, s2)
    e = e.withColumns({"__x1": F.when(s1 < 0, x).otherwise(F.col("x1")), "__y1": F.when(s1 < 0, y).otherwise(F.col("y1")),
                       "__x2": F.when(s2 < 0, x).otherwise(F.col("x2")), "__y2": F.when(s2 < 0, y).otherwise(F.col("y2"))})
    e = e.withColumns({c: F.col(f"__{c}") for c in ("x1", "y1", "x2", "y2")})
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return e.withColumns({"p": F.least(p, q), "q": F.greatest(p, q)}).drop("__s1", "__s2", "__x1", "__y1", "__x2", "__y2")


def half_rings(vertices: DataFrame, centres: DataFrame, requests: DataFrame, area: str, ring: str = "part", seq: str = "seq",
               split: Column | None = None) -> DataFrame:
    """Closed rings of the asked half of each requested area: (req, area, ring, seq, x, y).

    ``requests``: (req, area, direction) with direction words. A ring follows its vertices on the asked side and the
    points where it crosses the line through the centroid, and closes along that line, so both halves of an
    area add up to it, holes included. Rings wholly beyond the line give none.
    """
    v = ordered(vertices.select(area, ring, seq, F.col("x").alias("x1"), F.col("y").alias("y1")), [area, ring], [seq],
                lead={"x2": "x1", "y2": "y1"}, split=split).where(F.col("x2").isNotNull())
    v = v.join(centres.select(area, "cx", "cy"), area).join(requests.select("req", area, "direction"), area)
    d = F.col("direction")
    v = v.withColumns({"__s1": _beyond(d, F.col("x1"), F.col("y1")), "__s2": _beyond(d, F.col("x2"), F.col("y2"))})
    s1, s2 = F.col("__s1"), F.col("__s2")
    x, y = _crossing(d, s1, s2)
    own = F.when(s1 >= 0, F.struct(F.lit(0).alias("i"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    cut = F.when(s1 * s2 < 0, F.struct(F.lit(1).alias("i"), x.alias("x"), y.alias("y")))
    points = v.select("req", area, ring, seq, F.explode(F.filter(F.array(own, cut), lambda p: p.isNotNull())).alias("p")).select(
        "req", area, ring, seq, "p.*")
    keys = ["req", area, ring]
    points = ordered(points, keys, [seq, "i"], rank="__n")
    ends = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y"), F.col("__n")).alias("p")).where("n > 2")
    rows = points.join(ends.select(*keys), keys, "left_semi").select(*keys, (F.col("__n") - 1).alias(seq), "x", "y")
    return rows.unionByName(ends.select(*keys, F.col("n").alias(seq), "p.x", "p.y"))


def ring_areas(vertices: DataFrame, keys: list[str], ring: str = "part", seq: str = "seq", split: Column | None = None) -> DataFrame:
    """Area of closed rings per key, holes (rings of the other turn) taken off."""
    v = ordered(vertices.select(*keys, ring, seq, "x", "y"), [*keys, ring], [seq], lead={"x2": "x", "y2": "y"}, split=split)
    v = v.where(F.col("x2").isNotNull())
    return v.groupBy(*keys).agg(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area_m2"))


def _with_within(df: DataFrame, limit: float) -> DataFrame:
    """Adds ``w``: the part (from, to) of the segment x1..y2 that lies within ``limit`` of the segment o_x1..o_y2, as fractions; NULL for none.

    The spots within a distance of a segment are a convex shape: two discs and the strip between them. Every step
    is a column of its own, because each is used several times by the next.
    """
    own_columns = df.columns
    df = df.withColumns({"__ax": F.col("x1") - F.col("o_x1"), "__ay": F.col("y1") - F.col("o_y1"), "__dx": F.col("x2") - F.col("x1"),
                         "__dy": F.col("y2") - F.col("y1"), "__vx": F.col("o_x2") - F.col("o_x1"), "__vy": F.col("o_y2") - F.col("o_y1")})
    df = df.withColumn("__length", F.sqrt(F.col("__vx") * F.col("__vx") + F.col("__vy") * F.col("__vy")))
    df = df.withColumns({"__ux": F.col("__vx") / F.col("__length"), "__uy": F.col("__vy") / F.col("__length"),
                         "__own": F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy")})
    ax, ay, dx, dy, ux, uy, length, own = (F.col(f"__{c}") for c in ("ax", "ay", "dx", "dy", "ux", "uy", "length", "own"))
    for n, (px, py) in enumerate([(ax, ay), (ax - ux * length, ay - uy * length)]):
        df = df.withColumns({f"__b{n}": px * dx + py * dy, f"__c{n}": px * px + py * py - limit * limit})
    df = df.withColumns({f"__root{n}": F.col(f"__b{n}") * F.col(f"__b{n}") - own * F.col(f"__c{n}") for n in (0, 1)})

    def disc(n: int) -> Column:
        root = F.sqrt(F.greatest(F.col(f"__root{n}"), F.lit(0.0)))
        return F.when(F.col(f"__root{n}") >= 0, F.struct(((-F.col(f"__b{n}") - root) / own).alias("a"), ((-F.col(f"__b{n}") + root) / own).alias("b")))

    def slab(at: Column, step: Column, low: Column, high: Column) -> Column:
        """Fractions at which at + t * step lies between two borders."""
        t1, t2 = F.try_divide(low - at, step), F.try_divide(high - at, step)
        still = F.when(at.between(low, high), F.struct(F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b")))
        return F.when(step != 0, F.struct(F.least(t1, t2).alias("a"), F.greatest(t1, t2).alias("b"))).otherwise(still)

    df = df.withColumns({"__at1": ax * ux + ay * uy, "__step1": dx * ux + dy * uy, "__at2": ay * ux - ax * uy, "__step2": dy * ux - dx * uy})
    df = df.withColumns({"__along": slab(F.col("__at1"), F.col("__step1"), F.lit(0.0), length),
                         "__across": slab(F.col("__at2"), F.col("__step2"), F.lit(-limit), F.lit(limit)), "__disc0": disc(0), "__disc1": disc(1)})
    along, across = F.col("__along"), F.col("__across")
    df = df.withColumn("__strip", F.struct(F.greatest(along["a"], across["a"]).alias("a"), F.least(along["b"], across["b"]).alias("b")))
    strip = F.when(along.isNotNull() & across.isNotNull() & (F.col("__strip.a") <= F.col("__strip.b")), F.col("__strip"))
    df = df.withColumn("__found", F.filter(F.array("__disc0", "__disc1", strip), lambda s: s.isNotNull()))
    df = df.withColumns({"__low": F.greatest(F.array_min(F.transform("__found", lambda s: s["a"])), F.lit(0.0)),
                         "__high": F.least(F.array_max(F.transform("__found", lambda s: s["b"])), F.lit(1.0))})
    w = F.when((F.size("__found") > 0) & (F.col("__low") < F.col("__high")), F.struct(F.col("__low").alias("a"), F.col("__high").alias("b")))
    return df.select(*own_columns, w.alias("w"))


def border_within(edges: DataFrame, area: str, pairs: DataFrame, limit: float, width: float | None = None) -> DataFrame:
    """The border of ``area_other`` within ``limit`` of the border of ``area``, for given pairs: (req.., x1, y1, x2, y2).

    Edges meet in the grid cells along them; each keeps the parts that some edge of the other area reaches, joined up.
    """
    width = width or max(100 * limit, 1.0)
    other = f"{area}_other"
    ids = pairs.columns
    box = ["x1", "y1", "x2", "y2"]
    theirs = pairs.join(edges.select(F.col(area).alias(other), *box), other).withColumn("__cell", F.explode(cells_along(width, limit)))
    mine = pairs.join(edges.select(area, *box), area).withColumn("__cell", F.explode(cells_along(width, limit)))
    mine = mine.select(*ids, "__cell", *[F.col(c).alias(f"o_{c}") for c in box])
    # no filter on w: it would be rewritten onto the coordinates; the sets leave NULL out
    met = _with_within(theirs.join(mine, [*ids, "__cell"]), limit)
    spans = met.groupBy(*ids, *box).agg(F.array_sort(F.collect_set("w")).alias("w"))
    start = F.array().cast("array<struct<a:double,b:double>>")

    def grown(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], w["b"]).alias("b"))))
        return F.when(F.size(done) == 0, F.array(w)).when(w["a"] <= last["b"], longer).otherwise(F.concat(done, F.array(w)))

    parts = spans.select(*ids, *box, F.explode(F.aggregate("w", start, grown)).alias("w"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def spot(t: str, c: str, d: Column) -> Column:
        return F.when(F.col(t) == 0, F.col(f"{c}1")).when(F.col(t) == 1, F.col(f"{c}2")).otherwise(F.col(f"{c}1") + F.col(t) * d)

    return parts.select(*ids, spot("w.a", "x", dx).alias("x1"), spot("w.a", "y", dy).alias("y1"), spot("w.b", "x", dx).alias("x2"), spot("w.b", "y", dy).alias("y2"))


def boundary_reference(requests: DataFrame, edges: DataFrame, names: DataFrame, area: str,
                       best_neighbour: DataFrame) -> DataFrame:
    """Boundary for each request: the border with the best-named neighbour, else the asked half of
    the outline, else the whole outline.

    ``requests``: (req, area, direction); ``best_neighbour``: (req, area_other) already accepted
    by name; ``names``: (area, name).
    """
    wanted = requests.join(best_neighbour, "req", "left")
    other = f"{area}_other"
    borders = shared_border(edges, area, wanted.where(F.col(other).isNotNull()).select("req", area, other))
    first = borders.select("req", area, "p", "q", F.lit("shared").alias("kind"))
    rest = wanted.join(first.select("req").distinct(), "req", "left_anti").join(names, area, "left")
    dirs = rest.withColumn("dir", direction_word(F.col("direction")))
    named_so = F.coalesce(F.contains(F.lower("name"), F.col("dir")), F.lit(False))
    dirs = dirs.withColumn("dir", F.when(~named_so, F.col("dir")))
    halves = directional_half(dirs.where(F.col("dir").isNotNull()).select("req", area, "dir").join(edges, area),
                              centroids(edges, area), area, "dir")
    second = halves.select("req", area, "p", "q", F.lit("half").alias("kind"))
    whole = rest.join(second.select("req").distinct(), "req", "left_anti").select("req", area).join(edges, area)
    third = whole.select("req", area, "p", "q", F.lit("outline").alias("kind"))
    return first.unionByName(second).unionByName(third)
