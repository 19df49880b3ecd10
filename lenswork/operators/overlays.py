"""Map overlays: markers, routes, zones, boxes and connectors; their measures, hits and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import BUCKET, kept, numbered, previous
from .geo import global_pixels

#: Earth radii in m (distances, areas), pixels around a marker, cluster cells and the zoom that ends them.
DISTANCE_RADIUS, AREA_RADIUS = 6_371_000.0, 6_378_137.0
MARKER_PIXELS, CLUSTER_PIXELS, CLUSTER_ZOOM = 16.0, 80, 16
FILTERS = {"marker": "marker", "route": "polyline", "zone": "polygon", "box": "rectangle"}
TINY = 1e-12
#: Cells of zones: degrees of the top one, the deepest level, edges from which one is cut, degrees around one in
#: which edges count as its own.
TOP_DEGREES, DEEPEST, MOST_EDGES, MARGIN = 512.0, 24, 16, 1e-9
#: Levels that a round goes down.
CUT_LEVELS = 3


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * DISTANCE_RADIUS * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def _segments(points: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("seq")
    rows = points.withColumns({"lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)})
    return rows.withColumn("length", F.when(F.col("lat2").isNotNull(), haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))))


def route_length(points: DataFrame, key: str = "route_id") -> DataFrame:
    """points: key, seq, lat, lng. Metres and kilometres along the points; 0 for a single one."""
    rows = _segments(points, key).groupBy(key).agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("length_m"))
    return rows.withColumn("length_km", F.col("length_m") / 1000.0)


def route_midpoint(points: DataFrame, key: str = "route_id") -> DataFrame:
    """The point at half the length, along a straight line within its segment; a route of one point is that point."""
    w = Window.partitionBy(key).orderBy("seq")
    whole = Window.partitionBy(key)
    rows = _segments(points, key).withColumns({"until": F.sum("length").over(w), "half": F.sum("length").over(whole) / 2, "n": F.count(F.lit(1)).over(whole)})
    rows = rows.filter((F.col("n") == 1) | (F.col("until") >= F.col("half")) & F.col("length").isNotNull())
    first = rows.groupBy(key).agg(F.min_by(F.struct("lat", "lng", "lat2", "lng2", "length", "until", "half"), "seq").alias("s"))
    ratio = F.when(F.coalesce(F.col("s.length"), F.lit(0.0)) == 0, 0.0).otherwise((F.col("s.half") - (F.col("s.until") - F.col("s.length"))) / F.col("s.length"))
    mid = lambda c: F.col(f"s.{c}") + F.coalesce(F.col(f"s.{c}2") - F.col(f"s.{c}"), F.lit(0.0)) * ratio
    return first.select(key, mid("lat").alias("lat"), mid("lng").alias("lng"))


def polygon_area(vertices: DataFrame, key: str = "zone_id") -> DataFrame:
    """vertices: key, ring, vtx, lat, lng. Square metres of the outer ring (0); fewer than three points give 0."""
    w = Window.partitionBy(key).orderBy("vtx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = vertices.filter("ring = 0").withColumns({"lat2": F.coalesce(F.lead("lat").over(w), F.first("lat").over(whole)), "lng2": F.coalesce(F.lead("lng").over(w), F.first("lng").over(whole))})
    part = F.radians(F.col("lng2") - F.col("lng")) * (2 + F.sin(F.radians("lat")) + F.sin(F.radians("lat2")))
    area = F.when(F.count(F.lit(1)) >= 3, F.abs(F.sum(part)) * AREA_RADIUS * AREA_RADIUS / 2).otherwise(0.0)
    return rows.groupBy(key).agg(area.alias("area_m2"))


def rectangle_area(boxes: DataFrame, key: str = "box_id") -> DataFrame:
    """boxes: key, south, west, north, east; by its four corners."""
    corner = lambda k, lat, lng: F.struct(F.lit(0).alias("ring"), F.lit(k).alias("vtx"), F.col(lat).alias("lat"), F.col(lng).alias("lng"))
    corners = F.array(corner(0, "south", "west"), corner(1, "south", "east"), corner(2, "north", "east"), corner(3, "north", "west"))
    return polygon_area(boxes.select(key, F.inline(corners)), key)


def bounds(points: DataFrame, key: str) -> DataFrame:
    """South, west, north, east and centre of a key's points."""
    rows = points.groupBy(key).agg(F.min("lat").alias("south"), F.min("lng").alias("west"), F.max("lat").alias("north"), F.max("lng").alias("east"))
    return rows.withColumns({"center_lat": (F.col("south") + F.col("north")) / 2, "center_lng": (F.col("west") + F.col("east")) / 2})


def _edges(vertices: DataFrame, key: str) -> DataFrame:
    """Each vertex with the one before it in its ring (the last one before the first); ranges of a ring are looked at apart."""
    ring = [key, "ring"]
    rows = vertices.select(*ring, "vtx", "lat", "lng", F.struct("lat", "lng").alias("_p"))
    last = rows.groupBy(*ring).agg(F.max_by("_p", "vtx").alias("_last"))
    rows = previous(rows, ring, "vtx", "_p", BUCKET, "_q").join(last, ring).withColumn("_q", F.coalesce("_q", "_last"))
    return rows.select(*ring, "vtx", "lat", "lng", F.col("_q.lat").alias("lat0"), F.col("_q.lng").alias("lng0"))


CELL = ["level", "cx", "cy"]


def _side(level: Column) -> Column:
    """Degrees of a cell's side: halves of TOP_DEGREES, which are exact numbers."""
    return F.lit(TOP_DEGREES) / F.pow(F.lit(2.0), level)


def _centre() -> tuple[Column, Column]:
    """A cell's reference point (lat, lng): near the middle, off all round numbers."""
    return (F.col("cy") + 0.4876543211) * _side(F.col("level")), (F.col("cx") + 0.5123456789) * _side(F.col("level"))


def _few_cells(box: DataFrame) -> DataFrame:
    """Bounds with the cells that they touch, of the level at which these are two by two, or three where rounding has it so."""
    extent = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"), F.lit(TOP_DEGREES / 2**DEEPEST))
    rows = box.withColumn("level", F.greatest(F.lit(0), F.floor(F.log2(F.lit(TOP_DEGREES) / extent))).cast("int"))
    over = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / _side(F.col("level"))), F.floor(F.col(high) / _side(F.col("level")))))
    return rows.withColumn("cx", over("west", "east")).withColumn("cy", over("south", "north"))


def _crosses_flat(e, lat: Column, lng_a: Column, lng_b: Column | None = None) -> Column:
    """Whether an edge crosses the parallel `lat` east of lng_a, or between lng_a and lng_b."""
    dy = e("lat0") - e("lat")
    at = (e("lng0") - e("lng")) * (lat - e("lat")) / F.when(dy == 0, TINY).otherwise(dy) + e("lng")
    there = (lng_a < at) if lng_b is None else ((lng_a < at) != (lng_b < at))
    return ((e("lat") > lat) != (e("lat0") > lat)) & there


def _crosses_steep(e, lng: Column, lat_a: Column, lat_b: Column) -> Column:
    dx = e("lng0") - e("lng")
    at = (e("lat0") - e("lat")) * (lng - e("lng")) / F.when(dx == 0, TINY).otherwise(dx) + e("lat")
    return ((e("lng") > lng) != (e("lng0") > lng)) & ((lat_a < at) != (lat_b < at))


def _touches() -> Column:
    """Whether an edge (lat, lng, lat0, lng0) comes within MARGIN of a cell."""
    side = _side(F.col("level"))
    south, west = F.col("cy") * side - MARGIN, F.col("cx") * side - MARGIN
    north, east = south + side + 2 * MARGIN, west + side + 2 * MARGIN
    near = (F.greatest("lat", "lat0") >= south) & (F.least("lat", "lat0") <= north) & (F.greatest("lng", "lng0") >= west) & (F.least("lng", "lng0") <= east)
    turn = lambda lat, lng: (F.col("lng0") - F.col("lng")) * (lat - F.col("lat")) - (F.col("lat0") - F.col("lat")) * (lng - F.col("lng"))
    corners = [turn(lat, lng) for lat in (south, north) for lng in (west, east)]
    return near & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _differ(a: str, b: str) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def zone_cells(vertices: DataFrame, zone: str = "zone_id") -> DataFrame:
    """An adaptive cover of zones (zone, ring, vtx, lat, lng): rows (level, cx, cy, zone, odd, edges), stored.

    A cell is a square of the map that halves from level to level. `odd` has the rings around its reference point,
    `edges` the edges that come into it; the number of edges between two points of a cell tells whether they are
    on the same side of a ring, and none of the zone's other edges matters. A cell with more than MOST_EDGES is cut
    into those CUT_LEVELS below it, in rounds, whose reference points follow from its own. Cells without edges are wholly inside (the
    others are left out), so a large zone has few, and no row has a whole zone.
    """
    edges = _edges(vertices, zone)
    cells = _few_cells(bounds(vertices.filter("ring = 0"), zone)).select(zone, *CELL)
    lat, lng = _centre()
    here = edges.join(cells, zone)
    around = here.filter(_crosses_flat(F.col, lat, lng)).groupBy(zone, *CELL, "ring").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    none = F.array().cast("array<int>")

    def with_rings(cells: DataFrame, rings: DataFrame, name: str) -> DataFrame:
        lists = rings.groupBy(zone, *CELL).agg(F.collect_list(F.col("ring").cast("int")).alias(name))
        return cells.join(lists, [zone, *CELL], "left").withColumn(name, F.coalesce(name, none))

    cells = kept(with_rings(cells, around, "odd"), "cells")
    inside = kept(here.filter(_touches()).select(zone, *CELL, "ring", "lat", "lng", "lat0", "lng0"), "edges-of-cells")
    done = []
    while True:
        sizes = inside.groupBy(zone, *CELL).agg(F.count(F.lit(1)).alias("n"))
        heavy = sizes.filter((F.col("n") > MOST_EDGES) & (F.col("level") < DEEPEST)).drop("n")
        edge = F.collect_list(F.struct("ring", "lat", "lng", "lat0", "lng0")).alias("edges")
        light = inside.join(heavy, [zone, *CELL], "left_anti").groupBy(zone, *CELL).agg(edge)
        rows = cells.join(heavy, [zone, *CELL], "left_anti").join(light, [zone, *CELL], "left")
        whole = F.array_contains("odd", 0) & ~F.exists("odd", lambda r: r > 0)
        done.append(kept(rows.filter(F.col("edges").isNotNull() | whole).select(*CELL, zone, "odd", "edges"), "zone-cells"))
        if heavy.isEmpty():
            break
        part = range(2**CUT_LEVELS)
        quarter = F.explode(F.array(*[F.struct((F.col("level") + CUT_LEVELS).alias("level"), (2**CUT_LEVELS * F.col("cx") + i).alias("cx"), (2**CUT_LEVELS * F.col("cy") + j).alias("cy")) for i in part for j in part]))
        from_lat, from_lng = _centre()
        split = lambda df, *c: df.join(heavy, [zone, *CELL]).select(zone, *c, from_lat.alias("_lat"), from_lng.alias("_lng"), quarter.alias("q")).select(zone, "q.*", *c, "_lat", "_lng")
        parts = split(inside, "ring", "lat", "lng", "lat0", "lng0")
        lat, lng = _centre()
        times = _crosses_flat(F.col, lat, lng, F.col("_lng")).cast("int") + _crosses_steep(F.col, F.col("_lng"), lat, F.col("_lat")).cast("int")
        flips = parts.groupBy(zone, *CELL, "ring").agg(F.sum(times).alias("n")).filter("n % 2 = 1")
        cells = kept(with_rings(split(cells, "odd").drop("_lat", "_lng"), flips, "flips").withColumn("odd", _differ("odd", "flips")).drop("flips"), "cells")
        inside = kept(parts.filter(_touches()).drop("_lat", "_lng"), "edges-of-cells")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def point_in_zone(points: DataFrame, vertices: DataFrame, point: str = "marker_id", zone: str = "zone_id") -> DataFrame:
    """Pairs of points and zones (vertices: zone, ring, vtx, lat, lng) with the point inside ring 0 and outside of the others.

    A point meets the cells of zone_cells that it lies in. In a cell without edges it is inside; in another one
    the edges between it and the cell's reference point decide within the row. So points can be a stream.
    """
    cells = zone_cells(vertices, zone)
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # at most DEEPEST + 1
    at = F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))
    p = points.select(point, F.col("lat").alias("plat"), F.col("lng").alias("plng"), at.alias("level"))
    p = p.withColumns({"cx": F.floor(F.col("plng") / _side(F.col("level"))), "cy": F.floor(F.col("plat") / _side(F.col("level")))})
    lat, lng = _centre()
    rows = p.join(cells, CELL).withColumns({"clat": lat, "clng": lng})
    met = lambda test: F.transform(F.filter("edges", test), lambda e: e["ring"].cast("int"))
    flat = met(lambda e: _crosses_flat(lambda c: e[c], F.col("plat"), F.col("plng"), F.col("clng")))
    steep = met(lambda e: _crosses_steep(lambda c: e[c], F.col("clng"), F.col("plat"), F.col("clat")))
    rows = rows.withColumn("crossed", F.coalesce(F.concat("odd", flat, steep), F.col("odd")))
    inside = lambda ring: F.size(F.filter("crossed", lambda r: r == ring)) % 2 == 1
    hole = F.exists(F.array_distinct("crossed"), lambda r: (r > 0) & inside(r))
    return rows.filter(inside(0) & ~hole).select(point, zone)


def hit_test(points: DataFrame, markers: DataFrame, shapes: DataFrame, zoom: float) -> DataFrame:
    """Pairs (point_id, overlay_id): markers (overlay_id, lat, lng) within MARKER_PIXELS, shapes (overlay_id, ring, vtx, lat, lng) whose bounds or any ring hold the point.

    A ring lies within its shape's bounds, so the bounds decide. Markers meet points in cells of pixels,
    shapes in the few cells of their size. Markers are shuffled: by the size of their file Spark would take millions
    of them for few and send them through the driver.
    """
    x, y = global_pixels(F.col("lat"), F.col("lng"), zoom)
    cell = lambda c: F.floor(c / MARKER_PIXELS)
    p = points.withColumns({"px": x, "py": y})
    m = markers.withColumns({"mx": x, "my": y})
    around = F.sequence(F.lit(-1), F.lit(1))
    cells = p.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("point_id", "px", "py", (cell(F.col("px")) + F.col("dx")).alias("cx"), (cell(F.col("py")) + F.col("dy")).alias("cy"))
    on_marker = cells.join(m.select("overlay_id", "mx", "my", cell(F.col("mx")).alias("cx"), cell(F.col("my")).alias("cy")).hint("merge"), ["cx", "cy"])
    on_marker = on_marker.filter(F.pow(F.col("px") - F.col("mx"), 2) + F.pow(F.col("py") - F.col("my"), 2) <= MARKER_PIXELS**2).select("point_id", "overlay_id")
    box = kept(_few_cells(bounds(shapes, "overlay_id")), "shapes-in-cells")
    levels = [r["level"] for r in box.select("level").distinct().collect()]  # at most DEEPEST + 1
    at = p.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    at = at.withColumns({"cx": F.floor(F.col("lng") / _side(F.col("level"))), "cy": F.floor(F.col("lat") / _side(F.col("level")))})
    on_shape = at.join(box, CELL).filter("lat between south and north and lng between west and east").select("point_id", "overlay_id")
    return on_marker.unionByName(on_shape).distinct()


def overlays_at(hits: DataFrame, order: DataFrame) -> DataFrame:
    """hits with order (overlay_id, created; a row for each overlay, so it is never broadcast): each point's overlays once, in order."""
    rows = hits.distinct().join(order.hint("merge"), "overlay_id").groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("created", "overlay_id"))).alias("o"))
    return rows.select("point_id", F.transform("o", lambda x: x["overlay_id"]).alias("overlays"))


def filter_overlays(df: DataFrame, kind: str) -> DataFrame:
    """By the names that users see; unknown ones and `all` keep everything."""
    return df.filter(F.col("type") == FILTERS[kind]) if kind in FILTERS else df


def auto_label(df: DataFrame) -> DataFrame:
    """Numbers per type by time of creation: POINT 001, ROUTE 1, ZONE 1, BOX 1, LINK 1, else ENTITY 1."""
    n = F.col("_nth")
    name = F.when(F.col("type") == "polyline", "ROUTE").when(F.col("type") == "polygon", "ZONE").when(F.col("type") == "rectangle", "BOX").when(F.col("type") == "connector", "LINK").otherwise("ENTITY")
    label = F.when(F.col("type") == "marker", F.format_string("POINT %03d", n)).otherwise(F.format_string("%s %d", name, n))
    return numbered(df, ["type"], ["created", "overlay_id"], BUCKET, "_nth").withColumn("auto_label", label).drop("_nth")


def anchors(markers: DataFrame, routes: DataFrame, zones: DataFrame, mode: str = "polyline-mid") -> DataFrame:
    """Where connectors attach, rows (overlay_id, lat, lng): markers (overlay_id, lat, lng) at their place, routes
    (overlay_id, seq, lat, lng) at half their length or, by mode polyline-start or polyline-end, at an end, zones
    and boxes (overlay_id, lat, lng of the vertices) at the centre of their bounds."""
    if mode == "polyline-mid":
        on_routes = route_midpoint(routes, "overlay_id")
    else:
        end = F.max_by if mode == "polyline-end" else F.min_by
        on_routes = routes.groupBy("overlay_id").agg(end(F.struct("lat", "lng"), "seq").alias("p")).select("overlay_id", "p.lat", "p.lng")
    centres = bounds(zones, "overlay_id").select("overlay_id", F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"))
    return markers.select("overlay_id", "lat", "lng").unionByName(on_routes).unionByName(centres)


def connector_endpoints(connectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """connectors: overlay_id, start_id, end_id; anchors: overlay_id, lat, lng. Both ends and the length; open ends are null."""
    at = lambda side: anchors.select(F.col("overlay_id").alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lng").alias(f"{side}_lng"))
    rows = connectors.join(at("start"), "start_id", "left").join(at("end"), "end_id", "left")
    return rows.withColumn("length_m", haversine(F.col("start_lat"), F.col("start_lng"), F.col("end_lat"), F.col("end_lng")))


def connector_arrows(connectors: DataFrame, zoom: float) -> DataFrame:
    """Rows (overlay_id, side, lat, lng, angle) of the arrow heads; direction is start, end or both."""
    sx, sy = global_pixels(F.col("start_lat"), F.col("start_lng"), zoom)
    ex, ey = global_pixels(F.col("end_lat"), F.col("end_lng"), zoom)
    angle = F.atan2(ey - sy, ex - sx)
    head = lambda side, a: F.struct(F.lit(side).alias("side"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lng").alias("lng"), a.alias("angle"))
    heads = F.filter(F.array(head("start", angle + F.pi()), head("end", angle)), lambda h: F.col("direction").isin("both") | (F.col("direction") == h["side"]))
    return connectors.filter("start_lat is not null and end_lat is not null").select("overlay_id", F.inline(heads))


def remove_overlays(overlays: DataFrame, removed: DataFrame) -> DataFrame:
    """Without the removed ids, and without connectors that touch a removed overlay that is no connector."""
    gone = overlays.join(removed.select("overlay_id").distinct(), "overlay_id", "left_semi")
    solid = gone.filter("type <> 'connector'").select(F.col("overlay_id").alias("gone_id"))
    left = overlays.join(removed.select("overlay_id").distinct(), "overlay_id", "left_anti")
    ends = left.filter("type = 'connector'").select("overlay_id", F.explode(F.array("start_id", "end_id")).alias("gone_id")).join(solid, "gone_id", "left_semi").select("overlay_id").distinct()
    return left.join(ends, "overlay_id", "left_anti")


def overlay_state(log: DataFrame) -> DataFrame:
    """log: op_id, overlay_id, op (upsert, delete, clear), type, ts. What is there after the last clear: each overlay's last upsert unless deleted later."""
    cleared = log.filter("op = 'clear'").agg(F.coalesce(F.max("op_id"), F.lit(-1)).alias("cleared"))  # one row
    rows = log.filter("op <> 'clear'").join(F.broadcast(cleared), F.col("op_id") > F.col("cleared"))
    last = rows.groupBy("overlay_id").agg(F.max_by(F.struct("op_id", "op", "type", "ts"), "op_id").alias("s"))
    return last.filter("s.op <> 'delete'").select("overlay_id", "s.op_id", "s.type", "s.ts")


def connectable(overlays: DataFrame) -> DataFrame:
    return overlays.filter("type <> 'connector'").orderBy("label", "overlay_id")


def overlay_meta(routes: DataFrame, zones: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows (kind, overlay_id, length_m, area_m2) of all measured overlays."""
    none = F.lit(None).cast("double")
    r = route_length(routes).select(F.lit("polyline").alias("kind"), F.col("route_id").alias("overlay_id"), "length_m", none.alias("area_m2"))
    z = polygon_area(zones).select(F.lit("polygon").alias("kind"), F.col("zone_id").alias("overlay_id"), none.alias("length_m"), "area_m2")
    b = rectangle_area(boxes).select(F.lit("rectangle").alias("kind"), F.col("box_id").alias("overlay_id"), none.alias("length_m"), "area_m2")
    return r.unionByName(z).unionByName(b)


def format_lat(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "N ").otherwise("S "), F.format_string("%.5f", F.abs(c)))


def format_lng(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "E ").otherwise("W "), F.format_string("%.5f", F.abs(c)))


def format_length(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "0 m").when(c >= 1000, F.format_string("%.2f km", c / 1000)).otherwise(F.format_string("%.0f m", c))


def format_area(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "0 m²").when(c >= 1e6, F.format_string("%.2f km²", c / 1e6)).when(c >= 1e4, F.format_string("%.1f ha", c / 1e4)).otherwise(F.format_string("%.0f m²", c))


def cluster_markers(markers: DataFrame, zoom: int) -> DataFrame:
    """Markers per cell of CLUSTER_PIXELS and their mean place (an approximation of what map libraries do); from CLUSTER_ZOOM on each is its own."""
    x, y = global_pixels(F.col("lat"), F.col("lng"), zoom)
    if zoom >= CLUSTER_ZOOM:
        cell = [F.col("marker_id").alias("cell_x"), F.lit(0).cast("long").alias("cell_y")]
    else:
        cell = [F.floor(x / CLUSTER_PIXELS).alias("cell_x"), F.floor(y / CLUSTER_PIXELS).alias("cell_y")]
    return markers.select(*cell, "lat", "lng").groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def _lead(points: DataFrame, radius: float) -> DataFrame:
    """points: id, x, y, n. Rows (id, lead): every point's cluster.

    Points are taken in the order of most markers, then of a mixed id: a point that no earlier leader has within the
    radius leads, and each other point goes to the first leader that has it. Done in rounds: a point leads once no
    undecided point before it is within the radius, and then decides those around it. Cells are so small that all
    points of one are within the radius of each other, so a round looks at one candidate of a cell, and a point at
    those of the 25 cells around it: the work is in proportion to the points, however crowded a place is.
    """
    side = radius / 2**0.5
    rank = F.struct((-F.col("n")).alias("n"), F.xxhash64("id").alias("h"), "id").alias("rank")
    cell = [F.floor(F.col(c) / side).alias(f"c{c}") for c in "xy"]
    points = kept(points.select("id", "x", "y", rank, *cell), "points")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])

    def around(df: DataFrame) -> DataFrame:
        """Candidates or leaders in each cell in which a point can be within the radius."""
        spread = df.select(F.col("rank").alias("lead"), F.col("x").alias("lx"), F.col("y").alias("ly"), "cx", "cy", F.explode(offsets).alias("o"))
        return spread.select("lead", "lx", "ly", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))

    near = F.pow(F.col("x") - F.col("lx"), 2) + F.pow(F.col("y") - F.col("ly"), 2) <= radius**2
    left, leaders = points, []
    while not left.isEmpty():
        best = left.groupBy("cx", "cy").agg(F.min(F.struct("rank", "x", "y")).alias("b")).select("cx", "cy", "b.*")
        late = left.join(around(best), ["cx", "cy"]).filter(near & (F.col("rank") < F.col("lead"))).select(F.col("lead").alias("rank")).distinct()
        leaders.append(kept(best.join(late, "rank", "left_anti").select("rank", "x", "y", "cx", "cy"), "leaders"))
        decided = left.join(around(leaders[-1]), ["cx", "cy"]).filter(near).select("id").distinct()
        left = kept(left.join(decided, "id", "left_anti"), "points")
    every = leaders[0] if leaders else points.limit(0).select("rank", "x", "y", "cx", "cy")
    for found in leaders[1:]:
        every = every.unionByName(found)
    of = points.join(around(every), ["cx", "cy"]).filter(near).groupBy("id").agg(F.min("lead").alias("lead"))
    return of.select("id", F.col("lead.id").alias("lead"))


def cluster_levels(markers: DataFrame, low: int = 0, top: int = CLUSTER_ZOOM) -> DataFrame:
    """markers: marker_id, lat, lng. Rows (zoom, cluster_id, n, lat, lng, parent_id) of a hierarchy of clusters from zoom top down to low.

    At `top` every marker is its own cluster. At each zoom below, the clusters of the zoom above are gathered around
    those that lead (see _lead) within CLUSTER_PIXELS; a cluster has its leader's id, its place is the mean of its
    markers, and parent_id names its cluster one zoom below (null at `low`). So a marker is in one cluster a zoom.
    """
    found = kept(markers.filter("marker_id is not null and lat is not null and lng is not null").select(F.col("marker_id").alias("cluster_id"), F.lit(1).cast("long").alias("n"), "lat", "lng"), "clusters")
    out = []
    for zoom in range(top, low, -1):
        x, y = global_pixels(F.col("lat"), F.col("lng"), zoom - 1)
        lead = kept(_lead(found.select(F.col("cluster_id").alias("id"), x.alias("x"), y.alias("y"), "n"), float(CLUSTER_PIXELS)).withColumnsRenamed({"id": "cluster_id", "lead": "parent_id"}), "parents")
        rows = found.join(lead, "cluster_id")
        out.append(rows.select(F.lit(zoom).alias("zoom"), "cluster_id", "n", "lat", "lng", "parent_id"))
        mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
        found = kept(rows.groupBy(F.col("parent_id").alias("cluster_id")).agg(mean("lat"), mean("lng"), F.sum("n").alias("n")).select("cluster_id", "n", "lat", "lng"), "clusters")
    last = found.select(F.lit(low).alias("zoom"), "cluster_id", "n", "lat", "lng", F.lit(None).cast(markers.schema["marker_id"].dataType).alias("parent_id"))
    for rows in out:
        last = last.unionByName(rows)
    return last


def normalise_rings(c: Column, depth: int) -> Column:
    """Nested arrays of points to an array of rings; depth counts the array levels (1: a single ring)."""
    if depth == 1:
        return F.array(c)
    for _ in range(depth - 2):
        c = F.flatten(c)
    return c


def close_ring(c: Column) -> Column:
    return F.when((F.size(c) > 0) & (c[0] != F.element_at(c, -1)), F.concat(c, F.slice(c, 1, 1))).otherwise(c)


def drop_closing_point(c: Column) -> Column:
    return F.when((F.size(c) > 1) & (c[0] == F.element_at(c, -1)), F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)


def validate_geometry(df: DataFrame, points: str = "points") -> DataFrame:
    """Routes of two points or more, zones of three, boxes of two; markers and connectors pass."""
    least = F.when(F.col("type") == "polygon", 3).when(F.col("type").isin("polyline", "rectangle"), 2).otherwise(0)
    return df.filter(F.coalesce(F.size(points), F.lit(0)) >= least)


def overlay_labels(ids: DataFrame, overlays: DataFrame) -> DataFrame:
    """ids (overlay_id): the overlay's label, else `ID n`; a null id gives a dash."""
    label = overlays.select("overlay_id", "label")
    return ids.join(label, "overlay_id", "left").withColumn("label", F.when(F.col("overlay_id").isNull(), "—").otherwise(F.coalesce("label", F.concat(F.lit("ID "), F.col("overlay_id").cast("string")))))
