"""Map geometry: tiles, web-mercator pixels, detections' places and bearings. All plain columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.common import clamp

#: Tile side, highest zoom, names of the eight winds, camera yaw offset (radians).
TILE, MAX_ZOOM = 256, 22
WINDS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
YAW_OFFSET = 3.141592653589793
FIELD_OF_VIEW, FAR = 50.0, 60.0


def _num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Tile numbers: x wraps around the world, y stays inside."""
    n = 1 << min(zoom, MAX_ZOOM)
    rad = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / F.pi()) / 2.0 * n)
    return F.pmod(x, F.lit(n)).cast("long"), clamp(y, 0, n - 1).cast("long")


def tile_url(template: str, lat: Column, lon: Column, zoom: int, size: int) -> Column:
    """The template with {s}, {z}, {zoom}, {x}, {y}, {lat}, {lon}, {size} and {r} filled in."""
    x, y = tile_xy(lat, lon, zoom)
    z = F.lit(str(min(zoom, MAX_ZOOM)))
    url = F.lit(template)
    values = {"s": F.lit("a"), "z": z, "zoom": z, "x": x.cast("string"), "y": y.cast("string"), "lat": lat.cast("string"), "lon": lon.cast("string"), "size": F.lit(str(size)), "r": F.lit("@2x" if size >= 512 else "")}
    for name, value in values.items():
        url = F.replace(url, F.lit("{" + name + "}"), value)
    return url


def global_pixels(lat: Column, lon: Column, zoom) -> tuple[Column, Column]:
    """Web-mercator pixels of the whole world's picture at the zoom."""
    scale = TILE * F.pow(F.lit(2.0), _num(zoom))
    s = F.sin(F.radians(lat))
    return (lon + 180.0) / 360.0 * scale, (0.5 - F.log((1.0 + s) / (1.0 - s)) / (4.0 * F.pi())) * scale


def tile_cover(df: DataFrame, zoom: int, lat: str = "lat", lon: str = "lng") -> DataFrame:
    """Tiles (tile_x, tile_y) of a picture of five by five tiles with the point in its middle; a sixth row or column where it sticks out."""
    x, y = global_pixels(F.col(lat), F.col(lon), zoom)
    tx, ty = x / TILE, y / TILE
    reach = lambda t: F.sequence(F.when(t - F.floor(t) < 0.5, -3).otherwise(-2), F.when(t - F.floor(t) > 0.5, 3).otherwise(2))
    rows = df.withColumns({"_tx": tx, "_ty": ty}).withColumn("_dx", F.explode(reach(F.col("_tx")))).withColumn("_dy", F.explode(reach(F.col("_ty"))))
    return rows.withColumns({"tile_x": (F.floor("_tx") + F.col("_dx")).cast("long"), "tile_y": (F.floor("_ty") + F.col("_dy")).cast("long")}).drop("_tx", "_ty", "_dx", "_dy")


def latlon_to_world(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, zoom, scale_x=1.0, scale_z=1.0) -> tuple[Column, Column]:
    """Offset from the centre in world units: (x, z), z against the picture's y."""
    px, py = global_pixels(lat, lon, zoom)
    cx, cy = global_pixels(centre_lat, centre_lon, zoom)
    return (px - cx) * _num(scale_x), -(py - cy) * _num(scale_z)


def bbox_center_uv(bbox: Column, width, height) -> tuple[Column, Column]:
    """Centre of a four-number box in 0 to 1: corners in pixels, else corners in shares, else corner and size; others the middle."""
    w, h = _num(width), _num(height)
    a, b, c, d = (F.get(bbox, F.lit(k)) for k in range(4))
    ordered, small = (a < c) & (b < d), (a <= 1) & (b <= 1) & (c <= 1) & (d <= 1)
    pixels = ordered & (c <= w + 1) & (d <= h + 1)
    one = F.lit(1.0)

    def share(lo, hi, side):
        x = F.when(pixels, (lo + hi) * 0.5 / side).when(ordered & small, (lo + hi) * 0.5).otherwise((lo + hi * 0.5) / F.when(small, one).otherwise(side))
        return F.when(F.size(bbox) == 4, clamp(x, 0.0, 1.0)).otherwise(F.lit(0.5))

    return share(a, c, w), share(b, d, h)


def _fields(df: DataFrame, bbox: str):
    """A function that gives the first of some fields that a struct column has with a value."""
    kind = df.schema[bbox].dataType
    have = {f.name for f in kind.fields} if isinstance(kind, StructType) else set()
    return lambda *names: F.coalesce(*[F.col(bbox)[n].cast("double") for n in names if n in have], F.lit(None).cast("double"))


def _all(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def box_center_uv(df: DataFrame, bbox: str, width, height) -> tuple[Column, Column]:
    """Centre of a box of any shape in 0 to 1, by the first shape that fits: named corners (x1..y2, else left..bottom),
    a named corner and size (w or width, h or height), four numbers; all at most 1 means shares. Others: the middle."""
    if isinstance(df.schema[bbox].dataType, ArrayType):
        return bbox_center_uv(F.col(bbox), width, height)
    get = _fields(df, bbox)
    corners = _all(*map(get, ("x1", "y1", "x2", "y2"))) | _all(*map(get, ("left", "top", "right", "bottom")))
    x1, y1, x2, y2 = get("x1", "left"), get("y1", "top"), get("x2", "right"), get("y2", "bottom")
    x, y, w, h = get("x"), get("y"), get("w", "width"), get("h", "height")
    small, tiny = (x1 <= 1) & (y1 <= 1) & (x2 <= 1) & (y2 <= 1), (x <= 1) & (y <= 1) & (w <= 1) & (h <= 1)

    def share(lo, hi, at, size, side):
        between = (lo + hi) * 0.5 / F.when(small, F.lit(1.0)).otherwise(_num(side))
        sized = (at + size * 0.5) / F.when(tiny, F.lit(1.0)).otherwise(_num(side))
        return F.when(corners, clamp(between, 0.0, 1.0)).when(_all(x, y, w, h), clamp(sized, 0.0, 1.0)).otherwise(0.5)

    return share(x1, x2, x, w, width), share(y1, y2, y, h, height)


def bbox_size(bbox: Column) -> tuple[Column, Column]:
    """Width and height of a box of two corners."""
    return F.abs(bbox[2] - bbox[0]), F.abs(bbox[3] - bbox[1])


def box_size(df: DataFrame, bbox: str) -> tuple[Column, Column]:
    """Width and height of a box of any shape: four numbers as corners, left..bottom, w or width (with h or height, else 0); others 0."""
    if isinstance(df.schema[bbox].dataType, ArrayType):
        of = lambda lo, hi: F.when(F.size(bbox) == 4, F.abs(F.get(bbox, F.lit(hi)) - F.get(bbox, F.lit(lo)))).otherwise(0.0)
        return of(0, 2), of(1, 3)
    get = _fields(df, bbox)
    left, top, right, bottom, w, h = get("left"), get("top"), get("right"), get("bottom"), get("w", "width"), get("h", "height")
    of = lambda lo, hi, size: F.when(_all(left, top, right, bottom), F.abs(hi - lo)).when(w.isNotNull(), F.abs(F.coalesce(size, F.lit(0.0)))).otherwise(0.0)
    return of(left, right, w), of(top, bottom, h)


def uv_to_world(u: Column, v: Column, feed_w, feed_h, yaw_deg: Column, pos_x: Column, pos_y: Column, pos_z: Column) -> tuple[Column, Column, Column]:
    """A place on a camera's picture plane in the world: turned by the yaw about the upright axis, then moved."""
    lx, ly = (u - 0.5) * _num(feed_w), (0.5 - v) * _num(feed_h)
    angle = F.radians(yaw_deg) + YAW_OFFSET
    return pos_x + lx * F.cos(angle), pos_y + ly, pos_z - lx * F.sin(angle)


def azimuth_deg(dx: Column, dz: Column) -> Column:
    return F.pmod(540.0 - F.degrees(F.atan2(dx, dz)), F.lit(360.0))


def compass8(deg: Column) -> Column:
    """The nearest of eight winds; of two as near the first."""
    gap = lambda k: F.abs(F.pmod(deg - 45.0 * k + 180.0, F.lit(360.0)) - 180.0)
    best = F.array_min(F.array(*[F.struct(gap(k).alias("gap"), F.lit(k).alias("k")) for k in range(8)]))
    return F.element_at(F.array(*map(F.lit, WINDS)), best["k"] + 1)


def score_color(score: Column) -> Column:
    """#rrggbb from red (0) to green (1); saturation 0.9, lightness 0.55, as plain sRGB."""
    hue = clamp(F.coalesce(score, F.lit(0.5)), 0.0, 1.0) * 120.0
    chroma, low = (1 - abs(2 * 0.55 - 1)) * 0.9, 0.55 - (1 - abs(2 * 0.55 - 1)) * 0.45
    x = chroma * (1 - F.abs((hue / 60.0) % 2 - 1))
    r, g = F.when(hue < 60, chroma).otherwise(x), F.when(hue < 60, x).otherwise(chroma)
    byte = lambda c: F.lower(F.lpad(F.hex(F.round((c + low) * 255).cast("int")), 2, "0"))
    return F.concat(F.lit("#"), byte(r), byte(g), byte(F.lit(0.0)))


def _fixed(c: Column, digits: int) -> Column:
    """So many decimals of the exact value; an exact half, which only odd multiples of a power of two are, away from zero."""
    tie = F.abs(c * 2 ** (digits + 1)) % 2 == 1
    return F.call_function("format_number", F.when(tie, c + F.signum(c) * 1e-9).otherwise(c), F.lit("0." + "0" * digits))


def detection_key(u: Column, v: Column, score: Column) -> Column:
    return F.concat_ws(":", _fixed(u, 3), _fixed(v, 3), _fixed(score, 2))


def rig_frustum(cameras: DataFrame, fov: float = FIELD_OF_VIEW, far: float = FAR) -> DataFrame:
    """cameras: camera_id, x, y, z (plane's centre), yaw_deg, half_w, half_h. Rows (camera_id, plane, corner, x, y, z) of origin, near and far corners."""
    angle = F.radians("yaw_deg") + YAW_OFFSET
    nx, nz, rx, rz = F.sin(angle), F.cos(angle), F.cos(angle), -F.sin(angle)
    dist = F.col("half_h") / F.tan(F.radians(F.lit(fov / 2)))
    ox, oz = F.col("x") - nx * dist, F.col("z") - nz * dist
    point = lambda plane, corner, x, y, z: F.struct(F.lit(plane).alias("plane"), F.lit(corner).alias("corner"), x.alias("x"), y.alias("y"), z.alias("z"))
    items = [point("origin", "O", ox, F.col("y"), oz)]
    for plane, cx, cz, s in (("near", F.col("x"), F.col("z"), F.lit(1.0)), ("far", ox + nx * far, oz + nz * far, F.lit(far) / dist)):
        for corner, up, side in (("TL", 1, -1), ("TR", 1, 1), ("BL", -1, -1), ("BR", -1, 1)):
            items.append(point(plane, corner, cx + rx * F.col("half_w") * s * side, F.col("y") + F.col("half_h") * s * up, cz + rz * F.col("half_w") * s * side))
    return cameras.select("camera_id", F.inline(F.array(*items)))


def bearings(detections: DataFrame, cameras: DataFrame, feed: tuple[float, float] = (16.0, 9.0), zoom: float = 16.0, height: float = 5.0, fov: float = FIELD_OF_VIEW, only: str = "FACE") -> DataFrame:
    """detections: camera_id, bbox, width, height, score, maybe class; cameras: camera_id, lat, lon, yaw_deg, centre_lat, centre_lon (a row per camera).

    Of the class `only` (a null class is one of it) with u, v, the place on the camera's picture plane, the box's
    size, the azimuth as seen from the rig's origin behind that plane, and its wind. A null score counts as 0.
    """
    rows = detections.join(cameras, "camera_id")
    if "class" in detections.columns:
        rows = rows.filter(F.coalesce("class", F.lit(only)) == only)
    u, v = box_center_uv(rows, "bbox", F.col("width").cast("double"), F.col("height").cast("double"))
    w, h = box_size(rows, "bbox")
    ax, az = latlon_to_world(F.col("lat"), F.col("lon"), F.col("centre_lat"), F.col("centre_lon"), zoom)
    rows = rows.withColumns({"u": u, "v": v, "box_w": w, "box_h": h, "_ax": ax, "_az": az})
    x, y, z = uv_to_world(F.col("u"), F.col("v"), *feed, F.col("yaw_deg"), F.col("_ax"), F.lit(height), F.col("_az"))
    angle, behind = F.radians("yaw_deg") + YAW_OFFSET, feed[1] / 2 / F.tan(F.radians(F.lit(fov / 2)))
    rows = rows.withColumns({"world_x": x, "world_y": y, "world_z": z, "_ox": F.col("_ax") - F.sin(angle) * behind, "_oz": F.col("_az") - F.cos(angle) * behind})
    rows = rows.withColumn("azimuth", azimuth_deg(F.col("world_x") - F.col("_ox"), F.col("world_z") - F.col("_oz"))).drop("_ax", "_az", "_ox", "_oz")
    score = F.coalesce("score", F.lit(0.0))
    return rows.withColumns({"wind": compass8(F.col("azimuth")), "color": score_color(score), "key": detection_key(F.col("u"), F.col("v"), score)})
