"""Linear referencing on vertex tables (``keys, seq, x, y`` in planar metres)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.functions.numeric import METRES_PER_FOOT, METRES_PER_MILE
from roadledger.operators.ordered import drop_parts, ordered, tag_parts
from roadledger.session import cut_lineage

# GRS80 ellipsoid and the parameters of the CONUS equal-area projection.
_A, _E2 = 6378137.0, 0.00669438002290
_LAT1, _LAT2, _LAT0, _LON0 = 29.5, 45.5, 23.0, -96.0


def _m2(lat: float) -> float:
    return math.cos(lat) ** 2 / (1 - _E2 * math.sin(lat) ** 2)


def _q(s: float) -> float:
    e = math.sqrt(_E2)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def project_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude / latitude in degrees to equal-area metres, in closed form."""
    p1, p2, p0 = (math.radians(v) for v in (_LAT1, _LAT2, _LAT0))
    n = (_m2(p1) - _m2(p2)) / (_q(math.sin(p2)) - _q(math.sin(p1)))
    c = _m2(p1) + n * _q(math.sin(p1))
    rho0 = _A * math.sqrt(c - n * _q(math.sin(p0))) / n
    e = math.sqrt(_E2)
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * _E2) - F.ln((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - _E2)
    rho = F.sqrt(c - q * n) * (_A / n)
    theta = F.radians(lon - _LON0) * n
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def segments(vertices: DataFrame, keys: list[str], seq: str = "seq", split: Column | None = None) -> DataFrame:
    """Consecutive vertex pairs with number, length and the distance of their start.

    Positions, boxes and cuts all read the segments several times, so they are stored once.
    """
    v = tag_parts(vertices.select(*keys, seq, "x", "y"), split)
    part = [c for c in v.columns if c not in (*keys, seq, "x", "y")]
    v = ordered(v, keys, [seq], lead={"x2": "x", "y2": "y"}, rank="__rn")
    v = v.where(F.col("x2").isNotNull())
    length = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))
    v = v.select(*keys, *part, seq, (F.col("__rn") - 1).cast("bigint").alias("seg_no"),
                 F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", length.alias("seg_len"))
    v = drop_parts(ordered(v, keys, [seq], total={"__end": "seg_len"}))
    return cut_lineage(v.withColumn("d0", F.greatest(F.col("__end") - F.col("seg_len"), F.lit(0.0))).drop("__end"))


def line_lengths(segs: DataFrame, keys: list[str]) -> DataFrame:
    return segs.groupBy(*keys).agg(F.sum("seg_len").alias("length"), F.count(F.lit(1)).alias("n_segments"))


def _clamped(px: Column, py: Column) -> tuple[Column, Column]:
    """Fraction along the segment of the nearest spot to a point, and the squared distance."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ll = dx * dx + dy * dy
    t = F.when(ll > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        (px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / ll))).otherwise(F.lit(0.0))
    ex, ey = F.col("x1") + t * dx - px, F.col("y1") + t * dy - py
    return t, ex * ex + ey * ey


def _near_segments(queries: DataFrame, segs: DataFrame, keys: list[str], query_id: list[str], fan: int,
                   levels: int | None, slack: float = 0.0) -> DataFrame:
    """Segments of its line that may hold the spot nearest to each query, or one within ``slack`` of it.

    Queries are boxes (__x0, __y0, __x1, __y1) with a point of theirs (__ux, __uy). Lines are summarised
    as boxes over runs of ``fan``, ``fan``^2 ... segments. A query starts at the widest boxes and only
    opens a box whose nearest possible distance does not exceed the best distance some box already
    guarantees, so it meets a few dozen segments, not all of them.
    ``levels`` defaults to what leaves at most ``fan`` boxes of the longest line at the top.
    """
    if levels is None:
        longest = segs.agg(F.max("seg_no")).first()[0] or 0
        levels = max(1, math.ceil(math.log(longest + 1, fan)) - 1) if longest else 1

    def boxes(level: int) -> DataFrame:
        node = F.floor(F.col("seg_no") / F.lit(fan**level)).cast("bigint")
        return segs.groupBy(*keys, node.alias("__node")).agg(
            F.min(F.least("x1", "x2")).alias("bx0"), F.max(F.greatest("x1", "x2")).alias("bx1"),
            F.min(F.least("y1", "y2")).alias("by0"), F.max(F.greatest("y1", "y2")).alias("by1"),
            F.min(F.struct("seg_no", "x1", "y1")).alias("v"))

    per_query = Window.partitionBy(*keys, *query_id)
    carried = queries.columns

    def prune(df: DataFrame) -> DataFrame:
        gx = F.greatest(F.col("bx0") - F.col("__x1"), F.lit(0.0), F.col("__x0") - F.col("bx1"))
        gy = F.greatest(F.col("by0") - F.col("__y1"), F.lit(0.0), F.col("__y0") - F.col("by1"))
        reach = F.pow(F.col("v.x1") - F.col("__ux"), 2) + F.pow(F.col("v.y1") - F.col("__uy"), 2)
        df = df.withColumn("__ub", F.greatest(F.min(reach).over(per_query), F.lit(float(slack) ** 2)))
        near = df.where(gx * gx + gy * gy <= F.col("__ub") * (1 + 1e-9) + 1e-9)
        return near.select(*carried, "__node")

    cand = prune(queries.join(boxes(levels), keys))
    for level in range(levels - 1, 0, -1):
        child = boxes(level).withColumn("__up", F.floor(F.col("__node") / fan).cast("bigint"))
        cand = cand.withColumnRenamed("__node", "__up").join(child, [*keys, "__up"])
        cand = prune(cand)
    return cand.join(segs.withColumn("__node", F.floor(F.col("seg_no") / fan).cast("bigint")), [*keys, "__node"])


def locate(points: DataFrame, segs: DataFrame, keys: list[str], point_id: list[str],
           px: str = "px", py: str = "py", fan: int = 64, levels: int | None = None) -> DataFrame:
    """Nearest spot of its route for every point: distance along the route and off it."""
    x, y = F.col(px), F.col(py)
    queries = points.select(*keys, *point_id, px, py).withColumns({
        "__x0": x, "__x1": x, "__y0": y, "__y1": y, "__ux": x, "__uy": y})
    hits = _near_segments(queries, segs, keys, point_id, fan, levels)
    t, d2 = _clamped(x, y)
    hits = hits.withColumns({"__t": t, "__d2": d2})
    best = hits.groupBy(*keys, *point_id).agg(F.min(F.struct(
        F.col("__d2"), F.col("seg_no"), (F.col("d0") + F.col("__t") * F.col("seg_len")).alias("pos"))).alias("m"))
    return best.select(*keys, *point_id, F.col("m.pos").alias("position"),
                       F.sqrt("m.__d2").alias("offset"))


def corners_near(lines: DataFrame, segs: DataFrame, keys: list[str], line_id: list[str], slack: float,
                 fan: int = 64, levels: int | None = None) -> DataFrame:
    """Corners of routes near the segments of other lines (x1, y1, x2, y2): (keys, line_id, position, offset).

    The corner nearest to each line segment is among them, and every corner within ``slack`` of it, unless
    another spot of the route is nearer; only these segments of a route are met.
    """
    box = ["x1", "y1", "x2", "y2"]
    queries = lines.select(*keys, *line_id, *[F.col(c).alias(f"__q{c}") for c in box]).withColumns({
        "__x0": F.least("__qx1", "__qx2"), "__x1": F.greatest("__qx1", "__qx2"), "__y0": F.least("__qy1", "__qy2"),
        "__y1": F.greatest("__qy1", "__qy2"), "__ux": F.col("__qx1"), "__uy": F.col("__qy1")})
    hits = _near_segments(queries, segs, keys, line_id, fan, levels, slack)
    ends = F.array(F.struct(F.col("x1").alias("__px"), F.col("y1").alias("__py"), F.col("d0").alias("position")),
                   F.struct(F.col("x2").alias("__px"), F.col("y2").alias("__py"), (F.col("d0") + F.col("seg_len")).alias("position")))
    spots = hits.select(*keys, *line_id, *[F.col(f"__q{c}").alias(c) for c in box], F.inline(ends))
    _, d2 = _clamped(F.col("__px"), F.col("__py"))
    return spots.select(*keys, *line_id, "position", F.sqrt(d2).alias("offset"))


def interval_on_route(ends: DataFrame, segs: DataFrame, keys: list[str], line_id: list[str]) -> DataFrame:
    """Sorted positions of a line's two end points (x1, y1, x2, y2) on its route."""
    pts = ends.select(*keys, *line_id, F.posexplode(F.array(
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("__end", "p"))
    pts = pts.select(*keys, *line_id, "__end", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    at = locate(pts, segs, keys, [*line_id, "__end"])
    return at.groupBy(*keys, *line_id).agg(F.min("position").alias("m_start"), F.max("position").alias("m_end"))


def milepost_fraction(mile: Column, low: Column, high: Column, length_miles: Column) -> Column:
    """Fraction of the route at a mile-post, clamped; by length when the range is unknown."""
    by_range = (mile - low) / (high - low)
    by_length = F.when(length_miles > 0, mile / length_miles).otherwise(F.lit(0.0))
    raw = F.when(low.isNotNull() & high.isNotNull() & (high > low), by_range).otherwise(by_length)
    return F.when(mile.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def cut_lines(segs: DataFrame, cuts: DataFrame, keys: list[str], cut_id: list[str],
              start: str = "d_from", end: str = "d_to", width: float = 1000.0) -> DataFrame:
    """Vertices of each route between two distances, with interpolated cut vertices.

    Cuts and segments meet on cells of ``width`` along the route; a pair is kept at its first
    common cell. Equal distances give a single vertex; a route without segments gives none.
    """
    lo, hi = F.least(start, end), F.greatest(start, end)
    total = segs.groupBy(*keys).agg(F.max(F.col("d0") + F.col("seg_len")).alias("__len"))
    c = cuts.select(*keys, *cut_id, lo.alias("__f"), hi.alias("__t")).join(total, keys)
    c = c.withColumns({"__f": F.greatest(F.lit(0.0), F.least("__f", "__len")),
                       "__t": F.greatest(F.lit(0.0), F.least("__t", "__len"))})
    cell = lambda v: F.floor(v / width).cast("bigint")
    c = c.withColumn("__c0", cell(F.col("__f"))).withColumn(
        "__cell", F.explode(F.sequence(cell(F.col("__f")), cell(F.col("__t")))))
    s = segs.withColumn("d1", F.col("d0") + F.col("seg_len"))
    s = s.withColumn("__s0", cell(F.col("d0"))).withColumn(
        "__cell", F.explode(F.sequence(cell(F.col("d0")), cell(F.col("d1")))))
    pairs = c.join(s, [*keys, "__cell"]).where(F.col("__cell") == F.greatest("__c0", "__s0"))
    f, t = F.col("__f"), F.col("__t")
    line = (f < t) & (F.col("d0") < t) & (F.col("d1") > f)
    spot = (f == t) & (F.col("d0") <= f) & ((F.col("d1") > f) | ((F.col("d1") == f) & (f == F.col("__len"))
                                                             & (F.col("seg_len") > 0)))
    pairs = pairs.where(line | spot)

    def at(d: Column) -> Column:
        r = F.when(F.col("seg_len") > 0, (d - F.col("d0")) / F.col("seg_len")).otherwise(F.lit(0.0))
        return F.struct(d.alias("d"), (F.col("x1") + r * (F.col("x2") - F.col("x1"))).alias("x"),
                        (F.col("y1") + r * (F.col("y2") - F.col("y1"))).alias("y"))

    begin = at(F.greatest("d0", f))
    out = F.when(line & (F.col("d1") >= t), F.array(begin, at(t))).otherwise(F.array(begin))
    flat = pairs.select(*keys, *cut_id, F.explode(out).alias("v"))
    return flat.select(*keys, *cut_id, "v.d", "v.x", "v.y").distinct()


def vertex_lengths(vertices: DataFrame, keys: list[str], order: str = "d") -> DataFrame:
    """Length of lines given as ordered vertices (0 for a single vertex)."""
    span = vertices.groupBy(*keys).agg(F.min(order).alias("__a"), F.max(order).alias("__b"))
    return span.select(*keys, (F.col("__b") - F.col("__a")).alias("length"))


def apply_offset(points: DataFrame, rel_type: str, direction: str, distance: str, unit: str,
                 x: str = "x", y: str = "y", buffer_m: float = 100.0) -> DataFrame:
    """Shift a reference by its offset; ``near`` and ``side_of`` become a tolerance instead."""
    # Unit vectors of the eight compass directions.
    r = 1 / math.sqrt(2)
    vectors = {"N": (0, 1), "S": (0, -1), "E": (1, 0), "W": (-1, 0),
               "NE": (r, r), "NW": (-r, r), "SE": (r, -r), "SW": (-r, -r)}
    metres = (F.when(F.col(unit) == "ft", F.col(distance) * METRES_PER_FOOT)
              .when(F.col(unit) == "mi", F.col(distance) * METRES_PER_MILE))

    def component(i: int) -> Column:
        out = F.lit(0.0)
        for name, v in vectors.items():
            out = F.when(F.col(direction) == name, F.lit(float(v[i]))).otherwise(out)
        return out

    move = (F.col(rel_type) == "offset") & metres.isNotNull()
    near = F.col(rel_type).isin("near", "side_of")
    return points.withColumns({
        x: F.when(move, F.col(x) + metres * component(0)).otherwise(F.col(x)),
        y: F.when(move, F.col(y) + metres * component(1)).otherwise(F.col(y)),
        "tolerance_m": F.when(near, F.lit(buffer_m)).otherwise(F.lit(0.0))})


def cells_along(width: float, pad: float = 0.0) -> Column:
    """Grid cells within ``pad`` of the segment x1, y1, x2, y2: one column of cells after the other.

    The cells grow with the length of the segment, not with the area of its box.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    west, east, south, north = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)

    def cell(v: Column) -> Column:
        return F.floor(v / width).cast("bigint")

    def at(x: Column) -> Column:
        return F.when(x1 == x2, y1).otherwise(y1 + (x - x1) * F.try_divide(y2 - y1, x2 - x1))

    def rows(cx: Column) -> Column:
        a = F.greatest(west, F.least(cx * width - pad, east))
        b = F.least(east, F.greatest((cx + 1) * width + pad, west))
        flat = x1 == x2
        low = F.when(flat, south).otherwise(F.greatest(F.least(at(a), at(b)), south))
        high = F.when(flat, north).otherwise(F.least(F.greatest(at(a), at(b)), north))
        return F.transform(F.sequence(cell(low - pad), cell(high + pad)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(west - pad), cell(east + pad)), rows))


def crossings(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Points where segments of two tables with the same keys cross or touch.

    Both sides are listed in the grid cells that they pass through, so long segments are compared only
    where they can meet; a crossing counts in the cell that holds its point.
    """
    def listed(df: DataFrame, tag: str) -> DataFrame:
        df = df.withColumn("__cell", F.explode(cells_along(width, 1e-6 * width))).withColumns({"__cx": F.col("__cell.cx"), "__cy": F.col("__cell.cy")}).drop("__cell")
        return df.withColumnsRenamed({c: f"{tag}{c}" for c in df.columns if c not in (*keys, "__cx", "__cy")})

    p = listed(a, "a_").join(listed(b, "b_"), [*keys, "__cx", "__cy"])
    rx, ry = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")
    sx, sy = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    qx, qy = F.col("b_x1") - F.col("a_x1"), F.col("b_y1") - F.col("a_y1")
    den = rx * sy - ry * sx
    t = F.try_divide(qx * sy - qy * sx, den)
    u = F.try_divide(qx * ry - qy * rx, den)
    hit = p.withColumns({"t": t, "u": u}).where(F.col("t").between(0, 1) & F.col("u").between(0, 1))
    hit = hit.withColumns({"x": F.col("a_x1") + F.col("t") * rx, "y": F.col("a_y1") + F.col("t") * ry})
    return hit.where((F.floor(F.col("x") / width) == F.col("__cx")) & (F.floor(F.col("y") / width) == F.col("__cy")))


def endpoint_ranges(parts: DataFrame, endpoints: DataFrame, project: str, part: str, touch: float = 1e-6,
                    lines: DataFrame | None = None, width: float = 1000.0, routes: DataFrame | None = None) -> DataFrame:
    """Where both endpoints of a project lie on each part of its route, and how far off, near or far.

    ``endpoints`` are vertices (project, endpoint 'a'/'b', vid, x, y). Those of line and area endpoints
    come a second time as segments in ``lines`` (project, endpoint, as from ``segments``; an area by its
    closed outline). An endpoint's range on a part spans the spots where a segment of it crosses the part
    or a vertex of either lies on the other; without any, it is the nearest spot. ``width`` is the side of
    the grid cells in which crossings are looked for.
    With ``routes`` (project and one other column, the route) parts are keyed by route and exist once, however many
    projects share it: endpoints probe the boxes of the route, and no geometry is copied per project.
    """
    if routes is None:
        route = "__route"
        parts = parts.withColumnRenamed(project, route)
        routes = parts.select(F.col(route).alias(project), route).distinct()
    else:
        route = next(c for c in routes.columns if c != project)
    keys = [route, part]
    box = ["x1", "y1", "x2", "y2"]
    ids = parts.select(*keys).distinct().join(routes, route)
    pts = endpoints.select(project, "endpoint", "vid", F.col("x").alias("px"), F.col("y").alias("py"))
    at = locate(ids.join(pts, project), parts, keys, [project, "endpoint", "vid"]).select(*keys, project, "endpoint", "offset", "position")
    if lines is not None:
        own = lines.select(project, "endpoint", F.col("seg_no").alias("line_seg"), *box).join(routes, project)
        met = crossings(parts.select(*keys, *box, "d0", "seg_len"), own.select(route, project, "endpoint", *box), [route], width)
        met = met.select(route, F.col(f"a_{part}").alias(part), F.col(f"b_{project}").alias(project), F.col("b_endpoint").alias("endpoint"),
                         F.lit(0.0).alias("offset"), (F.col("a_d0") + F.col("t") * F.col("a_seg_len")).alias("position"))
        near = corners_near(own.join(parts.select(*keys).distinct(), route), parts, keys, [project, "endpoint", "line_seg"], touch)
        at = at.unionByName(met).unionByName(near.select(*at.columns))
    length = line_lengths(parts, keys).select(*keys, "length").where("length > 0")
    at = at.join(length, keys).withColumn("f", F.col("position") / F.col("length"))
    on = F.col("offset") <= touch
    named = [project, *keys]
    ep = at.groupBy(*named, "endpoint", "length").agg(
        F.min("offset").alias("dist"), F.min(F.when(on, F.col("f"))).alias("lo_on"),
        F.max(F.when(on, F.col("f"))).alias("hi_on"), F.min(F.struct("offset", "f")).alias("n"))
    ep = ep.select(*named, "endpoint", "length", "dist",
                   F.coalesce("lo_on", "n.f").alias("lo"), F.coalesce("hi_on", "n.f").alias("hi"),
                   F.when(F.col("lo_on").isNotNull(), "intersect").otherwise("nearest").alias("src"))
    sides = [ep.where(F.col("endpoint") == e).select(*named, *(["length"] if e == "a" else []), *[
        F.col(c).alias(f"{c}_{e}") for c in ("dist", "lo", "hi", "src")]) for e in ("a", "b")]
    return sides[0].join(sides[1], named).drop("__route")


def crop_routes(parts: DataFrame, endpoints: DataFrame, project: str, part: str,
                max_metres: float = 25_000.0, rule: str = "inner", touch: float = 1e-6,
                lines: DataFrame | None = None, width: float = 1000.0, routes: DataFrame | None = None,
                ranges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Crop every part of a project's route between its two endpoints.

    ``parts`` are segments keyed by (project, part), or by (route, part) with ``routes``; ``endpoints``,
    ``lines`` and ``routes`` are as in ``endpoint_ranges``. Parts farther than ``max_metres`` from either endpoint are left out.
    A caller that reads the result of ``endpoint_ranges`` as well stores it and passes it on as ``ranges``.
    Returns one row per kept part (fractions, distances, sources) and the cropped vertices.
    """
    shared = routes is not None
    keys = [next(c for c in routes.columns if c != project), part] if shared else [project, part]
    both = endpoint_ranges(parts, endpoints, project, part, touch, lines, width, routes) if ranges is None else ranges
    both = both.where(F.greatest("dist_a", "dist_b") <= max_metres)
    swap = F.col("lo_a") + F.col("hi_a") > F.col("lo_b") + F.col("hi_b")
    first = {c: F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")) for c in ("lo", "hi")}
    last = {c: F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")) for c in ("lo", "hi")}
    picks = {"inner": (first["hi"], last["lo"]), "outer": (first["lo"], last["hi"]),
             "mid": ((first["lo"] + first["hi"]) / 2, (last["lo"] + last["hi"]) / 2)}
    f0, f1 = picks[rule]
    mid = (f0 + f1) / 2
    both = both.withColumns({"crop_from": F.when(f0 > f1, mid).otherwise(f0),
                             "crop_to": F.when(f0 > f1, mid).otherwise(f1)})
    cut_id = [project] if shared else []
    cuts = both.select(*keys, *cut_id, (F.col("crop_from") * F.col("length")).alias("d_from"),
                       (F.col("crop_to") * F.col("length")).alias("d_to"))
    return both, cut_lines(parts, cuts, keys, cut_id)


def crop_summary(cropped: DataFrame, all_parts: DataFrame, project: str, part: str, ranges: DataFrame | None = None,
                 vertices: DataFrame | None = None) -> DataFrame:
    """Per project: parts, kept parts, cropped length, length per carriageway and distance of the nearest part.

    ``ranges``, from ``endpoint_ranges``, gives the distance for projects with no part in reach as well. With the cropped
    ``vertices`` the length is that of the cut lines, and their number is a further column.
    """
    n_all = all_parts.select(project, part).distinct().groupBy(project).agg(F.count(F.lit(1)).alias("n_parts_all"))
    length, counted = (F.col("crop_to") - F.col("crop_from")) * F.col("length"), []
    if vertices is not None:
        keys = [project, part]
        n = vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_vertices"))
        cut = vertex_lengths(vertices, keys).withColumnRenamed("length", "__cut").join(n, keys)
        cropped = cropped.join(cut, keys, "left")
        length, counted = F.col("__cut"), [F.sum("n_vertices").alias("n_vertices")]
    best = F.min_by(F.struct("crop_from", "crop_to", "src_a", "src_b"), F.col(part))
    kept = cropped.groupBy(project).agg(F.count(F.lit(1)).alias("n_parts_kept"), F.sum(length).alias("len_crop_m"), best.alias("b"), *counted)
    reach = (cropped if ranges is None else ranges).groupBy(project).agg(F.min(F.greatest("dist_a", "dist_b")).alias("part_dist_m"))
    out = n_all.join(kept, project, "left").join(reach, project, "left")
    n = F.coalesce("n_parts_kept", F.lit(0))
    return out.select(project, "n_parts_all", n.alias("n_parts_kept"), "len_crop_m", "part_dist_m",
                      (F.col("len_crop_m") / F.greatest(n, F.lit(1))).alias("len_corr_m"), "b.*",
                      *[F.coalesce("n_vertices", F.lit(0)).alias("n_vertices") for _ in counted])


def crop_quality(summary: DataFrame) -> DataFrame:
    """One row: failed, two-part, both-touch and full-length shares, median kept length in km."""
    from roadledger.operators.aggregates import exact_percentiles
    kept = summary.where("n_parts_kept > 0")
    median = exact_percentiles(kept, [], "len_corr_m", [0.5], ["m"]).scalar()
    touch = (F.col("src_a") == "intersect") & (F.col("src_b") == "intersect")
    full = (F.col("crop_from") < 1e-6) & (F.col("crop_to") > 1 - 1e-6)
    return summary.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("n_parts_kept") == 0).cast("double")).alias("failed"),
        F.avg((F.col("n_parts_kept") >= 2).cast("double")).alias("kept_2plus"),
        F.avg(touch.cast("double")).alias("both_touch"), F.avg(full.cast("double")).alias("frac_full")
    ).withColumn("med_corr_km", median / 1000.0)
