"""Lines over country polygons: spatial join, overlay, metric lengths and the country of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import ellipsoid_distance, utm_xy, utm_zone
from ..sources.sinks import kept

#: Side of a grid cell in degrees. Smaller cells give fewer pairs to test and more rows for large polygons.
CELL = 1.0
#: Edges of a cell beyond which it is split, how often at most, and rows of a cell beyond which it is dealt over several tasks.
CELL_EDGES, MOST_SPLITS, CELL_ROWS = 64, 5, 50_000
#: Where in a cell its reference point is; off the places that borders drawn on a grid have.
REFERENCE = (0.5123, 0.4871)
#: Breakpoints closer than this on a segment are one.
SAME = 1e-12


def unsized(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle of both sides. A small file of routes becomes many rows by its explodes, which Spark's estimates leave
    out, so it would send millions of rows through the driver as a table to broadcast."""
    return df.hint("merge")


def coordinates(points: Column) -> Column:
    """[[x, y(, z)], ...] as an array of (x, y)."""
    return F.transform(points, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))


def segments(routes: DataFrame) -> DataFrame:
    """(request_id, seg, px, py, qx, qy): the segments of each line; none for fewer than two points."""
    c = F.col("coordinates")
    each = F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.struct(i.alias("seg"), c[i]["x"].alias("px"), c[i]["y"].alias("py"), c[i + 1]["x"].alias("qx"), c[i + 1]["y"].alias("qy"))))
    return routes.select("request_id", F.inline(each))


def multi_polygon(kind: Column, polygon: Column, multi: Column) -> Column:
    """A polygon as a multi-polygon of one."""
    return F.when(kind == "Polygon", F.array(polygon)).otherwise(multi)


def edges(countries: DataFrame) -> DataFrame:
    """(country, part, ring, j, ax, ay, bx, by) of polygons > rings > points."""
    rings = countries.select("country", F.posexplode("polygons").alias("part", "rings")).select("country", "part", F.posexplode("rings").alias("ring", "points"))
    p = F.col("points")
    each = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda j: F.struct(j.alias("j"), p[j]["x"].alias("ax"), p[j]["y"].alias("ay"), p[j + 1]["x"].alias("bx"), p[j + 1]["y"].alias("by")))
    return rings.select("country", "part", "ring", F.inline(F.when(F.size(p) > 1, each)))


def _cell(c: Column, cell: float) -> Column:
    return F.floor(c / cell).cast("int")


def _with_cells(df: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell of the box x0..x1, y0..y1; cx0 and cy0 stay for the reference-cell test."""
    df = df.withColumns({"cx0": _cell(F.col("x0"), cell), "cy0": _cell(F.col("y0"), cell)})
    df = df.withColumn("cx", F.explode(F.sequence("cx0", _cell(F.col("x1"), cell))))
    return df.withColumn("cy", F.explode(F.sequence("cy0", _cell(F.col("y1"), cell))))


def _intervals(cuts: Column) -> Column:
    """Neighbouring breakpoints as (t0, t1); those of no length are left out."""
    sorted_cuts = F.array_sort(F.array_distinct(cuts))
    pairs = F.zip_with(F.slice(sorted_cuts, F.lit(1), F.size(sorted_cuts) - 1), F.slice(sorted_cuts, F.lit(2), F.size(sorted_cuts) - 1), lambda a, b: F.struct(a.alias("t0"), b.alias("t1")))
    return F.filter(pairs, lambda i: i["t1"] - i["t0"] > SAME)


def _within_cell(cell: float | Column) -> tuple[Column, Column]:
    """The part (t0, t1) of a segment p + t (q - p) that lies in the cell (cx, cy); t0 >= t1 where none does."""
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for p, q, c in (("px", "qx", "cx"), ("py", "qy", "cy")):
        d = F.col(q) - F.col(p)
        a, b = F.try_divide(F.col(c) * cell - F.col(p), d), F.try_divide((F.col(c) + 1) * cell - F.col(p), d)
        low.append(F.coalesce(F.least(a, b), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(a, b), F.lit(1.0)))
    return F.greatest(*low), F.least(*high)


def _merged(intervals: Column) -> Column:
    """Intervals (t0, t1) in order, those that touch made one."""
    def add(out: Column, i: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["t0"].alias("t0"), F.greatest(last["t1"], i["t1"]).alias("t1"))))
        return F.when((F.size(out) > 0) & (last["t1"] >= i["t0"] - 2 * SAME), longer).otherwise(F.concat(out, F.array(i)))

    empty = F.array().cast("array<struct<t0:double,t1:double>>")
    return F.aggregate(F.array_sort(intervals), empty, add)


def overlay(routes: DataFrame, countries: DataFrame, cell: float = CELL) -> DataFrame:
    """(request_id, seg, country, x0, y0, x1, y1): each line cut at the borders, in country parts; what lies in no country
    has a null country. Each country's part is cut from the whole line, so countries that overlap count twice.

    Segments are dealt to the grid cells that they touch and meet the countries that have a part of the cell, never in a cross
    join, and with no more edges than the cell has; cells with many edges are split, and those with many segments dealt over
    several tasks, see adapted. A segment p + t (q - p) meets an edge at a t by the cross products; between
    two such t it is in the country or not, which the midpoint tells. Parts of neighbouring cells are then put together.
    """
    segs = segments(routes)
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    keys = ["request_id", "seg", "px", "py", "qx", "qy"]
    boxed = segs.withColumns({"x0": F.least("px", "qx"), "x1": F.greatest("px", "qx"), "y0": F.least("py", "qy"), "y1": F.greatest("py", "qy")})
    start, end = _within_cell(cell)
    placed = _with_cells(boxed, cell).filter(end > start).select(*keys, "cx", "cy")
    cells, busy = adapted(country_cells(countries, cell), placed, cell)

    def finer(level: Column) -> Column:
        """The cells of a level that the segment's part of its cell may touch."""
        side, spans = F.lit(cell) / F.pow(2.0, level), []
        for p, d, c in (("px", dx, "cx"), ("py", dy, "cy")):
            ends = [F.floor((F.col(p) + d * t) / side).cast("int") for t in (start, end)]
            low, high = (F.col(c) * F.pow(2.0, level)).cast("int"), ((F.col(c) + 1) * F.pow(2.0, level)).cast("int") - 1
            at = lambda e: F.greatest(low, F.least(high, e))  # noqa: B023, E731
            spans.append(F.sequence(at(F.least(*ends)), at(F.greatest(*ends))))
        return F.flatten(F.transform(spans[0], lambda x: F.transform(spans[1], lambda y: F.struct(x.alias("fx"), y.alias("fy")))))

    salt = F.pmod(F.xxhash64("request_id", "seg"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = placed.join(F.broadcast(busy), ["cx", "cy"], "left").withColumns({"level": F.coalesce("level", F.lit(0)), "salt": salt})
    own = F.array(F.struct(F.col("cx").alias("fx"), F.col("cy").alias("fy")))
    dealt = dealt.withColumn("f", F.explode(F.when(F.col("level") > 0, finer(F.col("level"))).otherwise(own)))
    dealt = dealt.select(*keys, "level", "salt", F.col("f.fx").alias("cx"), F.col("f.fy").alias("cy"))
    start, end = _within_cell(F.lit(cell) / F.pow(2.0, F.col("level")))
    near = dealt.select("*", start.alias("start"), end.alias("end")).filter(F.col("end") > F.col("start")).join(unsized(cells), ["level", "cx", "cy", "salt"])

    def cut(e: Column) -> Column:
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        gx, gy = e["ax"] - F.col("px"), e["ay"] - F.col("py")
        det = dx * ey - dy * ex
        t, u = F.try_divide(gx * ey - gy * ex, det), F.try_divide(gx * dy - gy * dx, det)
        return F.when((det != 0) & t.between(F.col("start"), F.col("end")) & u.between(0, 1), t)

    cuts = F.concat(F.array("start", "end"), F.filter(F.transform("edges", cut), lambda t: t.isNotNull()))
    mid = lambda i: (F.col("px") + dx * (i["t0"] + i["t1"]) / 2, F.col("py") + dy * (i["t0"] + i["t1"]) / 2)
    own = F.filter(_intervals(cuts), lambda i: _on_side(*mid(i)))
    pieces = near.select(*keys, "country", F.inline(own))
    inside = pieces.groupBy(*keys, "country").agg(_merged(F.collect_list(F.struct("t0", "t1"))).alias("own")).select(*keys, "country", F.inline("own"))

    covered = inside.groupBy("request_id", "seg").agg(F.collect_list(F.struct("t0", "t1")).alias("own"))
    own_cuts = F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform("own", lambda i: i["t0"]), F.transform("own", lambda i: i["t1"]))
    outside = F.filter(_intervals(own_cuts), lambda i: ~F.exists("own", lambda o: (o["t0"] < (i["t0"] + i["t1"]) / 2) & ((i["t0"] + i["t1"]) / 2 < o["t1"])))
    whole = F.array(F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1")))
    rest = segs.join(unsized(covered), ["request_id", "seg"], "left").select(*keys, F.lit(None).cast("string").alias("country"), F.inline(F.when(F.col("own").isNull(), whole).otherwise(outside)))

    at = lambda p, d, t: (F.col(p) + d * F.col(t))
    return inside.unionByName(rest).select(
        "request_id", "seg", "country", at("px", dx, "t0").alias("x0"), at("py", dy, "t0").alias("y0"), at("px", dx, "t1").alias("x1"), at("py", dy, "t1").alias("y1")
    )


def planar(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt(F.pow(x1 - x0, 2) + F.pow(y1 - y0, 2))


def metric_lengths(pieces: DataFrame, *keys: str) -> DataFrame:
    """(keys, degrees, meters): the length of each group of pieces x0..y1, in the UTM zone of the group's centroid (the
    mean of the pieces' middles, weighted by length). One shuffle: the zone and the sum share the partitioning."""
    whole = Window.partitionBy(*keys)
    length = planar(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    mean = lambda a, b: F.try_divide(F.sum(length * (F.col(a) + F.col(b)) / 2).over(whole), F.sum(length).over(whole))
    placed = pieces.withColumn("zone", utm_zone(mean("x0", "x1")))
    (e0, n0), (e1, n1) = (utm_xy(F.col(x), F.col(y), F.col("zone")) for x, y in (("x0", "y0"), ("x1", "y1")))
    return placed.withColumns({"d": length, "m": planar(e0, n0, e1, n1)}).groupBy(*keys).agg(F.sum("d").alias("degrees"), F.sum("m").alias("meters"))


def route_lengths(routes: DataFrame) -> DataFrame:
    """(request_id, degrees, meters) of whole lines."""
    return metric_lengths(segments(routes).withColumnsRenamed({"px": "x0", "py": "y0", "qx": "x1", "qy": "y1"}), "request_id")


def country_cells(countries: DataFrame, cell: float = CELL) -> DataFrame:
    """(country, cx, cy, rx, ry, inside, edges): for each grid cell that a country has a part of, whether the cell's reference
    point (rx, ry) is inside, and the edges that meet the cell. Cells wholly inside have no edges. The table grows with the
    borders and areas of countries, not with what is looked up in it."""
    e = edges(countries).withColumns({"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")})
    boxes = e.groupBy("country").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))])
    grid = _with_cells(boxes, cell).select("country", "cx", "cy", ((F.col("cx") + F.lit(REFERENCE[0])) * cell).alias("rx"), ((F.col("cy") + F.lit(REFERENCE[1])) * cell).alias("ry"))
    rows = e.withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), cell), _cell(F.col("y1"), cell))))
    meets = grid.join(rows.select("country", "cy", "ax", "ay", "bx", "by", "x0", "x1"), ["country", "cy"])
    right = F.count_if(_crosses(F.col("rx"), F.col("ry"), *[F.col(c) for c in ("ax", "ay", "bx", "by")])) % 2 == 1
    here = (F.col("x0") <= (F.col("cx") + 1) * cell) & (F.col("x1") >= F.col("cx") * cell)
    near = F.filter(F.collect_list(F.when(here, F.struct("ax", "ay", "bx", "by"))), lambda x: x.isNotNull())
    out = meets.groupBy("country", "cx", "cy", "rx", "ry").agg(right.alias("inside"), near.alias("edges"))
    return out.filter(F.col("inside") | (F.size("edges") > 0))


def adapted(cells: DataFrame, placed: DataFrame, cell: float = CELL) -> tuple[DataFrame, DataFrame]:
    """(cells, busy): country_cells with level and salt, adapted to what is looked up in them, and the cells (cx, cy) of the grid that
    differ from the others, with their level and number of salts.

    A cell with more than CELL_EDGES edges of countries is split in four, and these again, up to MOST_SPLITS times, as often as it
    takes if its edges are spread evenly; in its parts the way from the cell's reference point tells which side of the borders
    they are on. The parts of a cell that more than CELL_ROWS rows of placed (cx, cy) are in are given once for each salt, so that rows
    are dealt over that many tasks, however close together they are. Only cells with so many edges or rows are in busy: no
    more than all edges and rows divided by these numbers.
    """
    edges_of = cells.groupBy("cx", "cy").agg(F.sum(F.size("edges")).alias("edges"))
    rows_of = placed.groupBy("cx", "cy").agg(F.count("*").alias("rows"))
    splits = F.least(F.lit(MOST_SPLITS), F.ceil(F.log2(F.col("edges") / CELL_EDGES) / 2)).cast("int")
    busy = edges_of.join(rows_of, ["cx", "cy"]).filter((F.col("edges") > CELL_EDGES) | (F.col("rows") > CELL_ROWS))
    busy = busy.select("cx", "cy", F.when(F.col("edges") > CELL_EDGES, splits).otherwise(0).alias("level"), F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("salts"))
    busy = kept(busy, "busy-cells")
    marked = cells.join(F.broadcast(busy), ["cx", "cy"], "left").withColumns({"level": F.coalesce("level", F.lit(0)), "salts": F.coalesce("salts", F.lit(1))})
    plain = marked.filter("level = 0").select("country", "level", "cx", "cy", "rx", "ry", "inside", "edges", "salts")
    n = F.pow(2.0, F.col("level")).cast("int")
    parts = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((F.col("cx") * n + i).alias("fx"), (F.col("cy") * n + j).alias("fy")))))
    side = F.lit(cell) / n
    split = marked.filter("level > 0").select("*", F.explode(parts).alias("f"))
    split = split.withColumns({"sx": (F.col("f.fx") + REFERENCE[0]) * side, "sy": (F.col("f.fy") + REFERENCE[1]) * side})
    low = lambda a, b: F.least(a, b)
    touches = lambda e: (low(e["ax"], e["bx"]) <= (F.col("f.fx") + 1) * side) & (F.greatest(e["ax"], e["bx"]) >= F.col("f.fx") * side) & (low(e["ay"], e["by"]) <= (F.col("f.fy") + 1) * side) & (F.greatest(e["ay"], e["by"]) >= F.col("f.fy") * side)
    split = split.withColumns({"within": _on_side(F.col("sx"), F.col("sy")), "own_edges": F.filter("edges", touches)}).filter(F.col("within") | (F.size("own_edges") > 0))
    split = split.select("country", "level", F.col("f.fx").alias("cx"), F.col("f.fy").alias("cy"), F.col("sx").alias("rx"), F.col("sy").alias("ry"), F.col("within").alias("inside"), F.col("own_edges").alias("edges"), "salts")
    both = plain.unionByName(split)
    return both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), busy


def _crosses(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the ray from (x, y) to the right meets an edge; edges are half open, so a vertex counts once."""
    return F.coalesce(((ay > y) != (by > y)) & (x < ax + F.try_divide((y - ay) * (bx - ax), by - ay)), F.lit(False))


def _on_side(x: Column, y: Column) -> Column:
    """Whether a point of a cell (see country_cells) is in the country. From the point the way goes along y to below or above
    the cell's reference point and then to it; each edge that it meets changes sides, and only edges of the cell can be met."""
    rx, ry = F.col("rx"), F.col("ry")
    ray = lambda at, e: _crosses(at, y, e["ax"], e["ay"], e["bx"], e["by"])
    up = lambda at, e: _crosses(at, rx, e["ay"], e["ax"], e["by"], e["bx"])  # noqa: E731  with x and y changed over
    across = lambda e: (ray(x, e) != ray(rx, e)).cast("int") + (up(y, e) != up(ry, e)).cast("int")
    return F.col("inside") != (F.aggregate("edges", F.lit(0), lambda n, e: n + across(e)) % 2 == 1)


def point_countries(points: DataFrame, countries: DataFrame, cell: float = CELL) -> DataFrame:
    """points (point_id, x, y) with the country each is in, a row for each such country; none for points at sea. A point
    meets the countries that its grid cell has a part of; busy cells are dealt over several tasks, see adapted."""
    placed = points.select("point_id", "x", "y", _cell(F.col("x"), cell).alias("cx"), _cell(F.col("y"), cell).alias("cy"))
    cells, busy = adapted(country_cells(countries, cell), placed, cell)
    salt = F.pmod(F.xxhash64("point_id", "x", "y"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = placed.join(F.broadcast(busy), ["cx", "cy"], "left").withColumns({"level": F.coalesce("level", F.lit(0)), "salt": salt})
    side = F.lit(cell) / F.pow(2.0, F.col("level"))
    dealt = dealt.select("point_id", "x", "y", "level", "salt", F.floor(F.col("x") / side).cast("int").alias("cx"), F.floor(F.col("y") / side).cast("int").alias("cy"))
    met = dealt.join(unsized(cells), ["level", "cx", "cy", "salt"])
    return met.filter(_on_side(F.col("x"), F.col("y"))).select("point_id", "x", "y", "country")


def point_distances(points: DataFrame) -> DataFrame:
    """points (route, seq, x, y) with the metres on the ellipsoid to the previous point of the route, zero for the first."""
    before = Window.partitionBy("route").orderBy("seq")
    far = ellipsoid_distance(F.lag("x").over(before), F.lag("y").over(before), F.col("x"), F.col("y"))
    return points.withColumn("meters", F.coalesce(far, F.lit(0.0)))


def within_limit(radius: Column, limit: float) -> Column:
    return radius.between(0, limit)
