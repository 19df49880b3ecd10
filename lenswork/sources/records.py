"""Readers and writers of the stream's records: detection messages, server-sent events, raw frames, metrics text, capture addresses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import keys_of, open_file

#: Bytes of a file of frames that a task reads at most.
RANGE_BYTES = 64 << 20

#: Class of a box without one, default host and payload type of a udp source, reconnection delay of an event stream.
DEFAULT_CLASS, ANY_HOST, PAYLOAD, RETRY = "FACE", "0.0.0.0", "96", "retry: 500"
_MESSAGE = "timestamp_ms long, frame_number long, fps double, width long, image_width long, height long, image_height long, detections array<variant>, boxes array<variant>, objects array<variant>"
#: The names of a box's corners and sides.
SIDES = ("x1", "y1", "x2", "y2", "left", "top", "right", "bottom", "x", "y", "w", "h", "width", "height")


def to_detections_json(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """frames: keys, frame_number, ts_ms, fps. One message (payload) for each frame; one without detections has an empty list."""
    keys = keys_of(frames, "frame_number")
    box = F.struct("class", "score", F.array("x1", "y1", "x2", "y2").alias("bbox"), "track_id")
    lists = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("det_idx", box.alias("d")))).alias("_all"))
    rows = frames.join(lists, keys, "left").withColumn("_list", F.coalesce(F.transform("_all", lambda x: x["d"]), F.expr("transform(slice(_all, 1, 0), x -> x.d)"), F.array()))
    message = F.struct(F.col("ts_ms").alias("timestamp_ms"), "frame_number", "fps", F.col("_list").alias("detections"))
    return rows.select(*keys, F.to_json(message).alias("payload"))


def parse_detections_json(df: DataFrame, column: str = "payload") -> DataFrame:
    """A row for each box of the messages, whichever of the known names their fields have; unreadable messages and empty lists give none.

    A box is the item's `bbox` or, without one, the item itself. Four numbers come as bbox, named corners or sides as
    the fields of the struct `box`; what has neither shape is null in both.
    """
    rows = df.select(F.from_json(column, _MESSAGE).alias("m"))
    found = F.posexplode(F.coalesce("m.detections", "m.boxes", "m.objects"))
    rows = rows.select("m", found.alias("det_idx", "d"))
    size = [F.coalesce("m.width", "m.image_width").alias("width"), F.coalesce("m.height", "m.image_height").alias("height")]
    get = lambda name, kind: F.try_variant_get("d", f"$.{name}", kind)
    own = get("bbox", "variant")
    there = own.isNotNull() & ~F.is_variant_null(own)
    side = lambda name: F.when(there, F.try_variant_get(own, f"$.{name}", "double")).otherwise(get(name, "double"))
    sides = F.struct(*[side(name).alias(name) for name in SIDES])
    named = F.coalesce(*[F.col(f"_box.{name}") for name in SIDES]).isNotNull()
    name = F.coalesce(get("class", "string"), get("label", "string"), F.lit(DEFAULT_CLASS)).alias("class")
    rows = rows.select("m.timestamp_ms", "m.frame_number", "m.fps", *size, "det_idx", name, get("score", "double").alias("score"), get("bbox", "array<double>").alias("bbox"), sides.alias("_box"), get("track_id", "long").alias("track_id"))
    return rows.withColumn("box", F.when(named, F.col("_box"))).drop("_box")


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """Events of a server-sent event stream: id, event, data (lines joined), retry, comment; fields that are not there are null."""

    def field(name: str) -> Column:
        return F.regexp_extract_all("value", F.lit(rf"(?m)^{name}: ?(.*)$"), F.lit(1))

    first = {n: F.get(field(n), F.lit(0)) for n in ("id", "event", "retry")}
    data = F.when(F.size(field("data")) > 0, F.array_join(field("data"), "\n"))
    rows = spark.read.text(path, lineSep="\n\n").filter("trim(value) <> ''")
    return rows.select(first["id"].try_cast("long").alias("id"), first["event"].alias("event"), data.alias("data"), first["retry"].try_cast("long").alias("retry"), F.get(field(""), F.lit(0)).alias("comment"))


def to_sse(messages: DataFrame) -> DataFrame:
    """messages: frame_number, payload. Rows (value), one per event."""
    return messages.select(F.concat(F.lit("id: "), F.col("frame_number").cast("string"), F.lit("\ndata: "), F.col("payload")).alias("value"))


def write_sse(messages: DataFrame, path: str) -> None:
    """The events as text files; the first one begins with the reconnection delay."""
    start = messages.sparkSession.range(1).select(F.lit(RETRY).alias("value"))
    start.unionByName(to_sse(messages)).write.option("lineSep", "\n\n").text(path)


def read_raw_bgr(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Frames (path, frame_number from 1, data, width, height) of files of fixed-size records; a file that ends within a record is an error.

    A file is cut into ranges of records, which tasks read apart and a few records at a time.
    """
    size = width * height * 3
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    short = listed.filter(F.col("length") % size != 0).first()
    if short:
        raise ValueError(f"{short.path}: {short.length} bytes are no whole number of frames of {size}")
    each = max(1, RANGE_BYTES // size)
    n = (F.col("length") / size).cast("long")
    ranges = listed.filter("length > 0").select("path", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(each).cast("long"))).alias("lo"))
    ranges = ranges.select("path", "lo", F.least(F.col("lo") + each, F.col("n")).alias("hi")).repartition("path", "lo")

    def read(batches):
        for b in batches:
            for name, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                with open_file(name) as f:
                    f.seek(lo * size)
                    for k in range(lo, hi):
                        yield pa.RecordBatch.from_pydict({"path": [name], "frame_number": [k + 1], "data": [f.read(size)]})

    rows = ranges.mapInArrow(read, "path string, frame_number long, data binary")
    return rows.withColumns({"width": F.lit(width), "height": F.lit(height)})


def source_catalog(df: DataFrame, uri: str = "uri") -> DataFrame:
    """Adds kind (rtsp, udp or device), device_index, host, port, payload, sprop and error (null: fine)."""
    u = F.col(uri)
    kind = F.when(u.startswith("rtsp://") | u.startswith("rtsps://"), "rtsp").when(u.startswith("udp://"), "udp").otherwise("device")
    rows = df.withColumn("kind", kind)
    udp, device = F.col("kind") == "udp", F.col("kind") == "device"
    rest = F.substring_index(F.substring(u, 7, 1 << 30), "?", 1)
    query = F.str_to_map(F.when(F.instr(u, "?") > 0, F.regexp_extract(u, r"\?(.*)$", 1)), F.lit("&"), F.lit("="))
    host = F.regexp_extract(rest, r"^(.*):[^:]*$", 1)
    port = F.substring_index(rest, ":", -1).try_cast("int")
    index = F.coalesce(u.try_cast("int"), F.regexp_extract(u, r"^/dev/video(\d+)$", 1).try_cast("int"))
    rows = rows.withColumns({
        "device_index": F.when(device, index), "host": F.when(udp, F.coalesce(F.nullif(host, F.lit("")), F.lit(ANY_HOST))), "port": F.when(udp & port.between(0, 65535), port),
        "payload": F.when(udp, F.coalesce(query["payload"], query["pt"], F.lit(PAYLOAD))), "sprop": F.when(udp, F.coalesce(query["sprop"], query["sprop-parameter-sets"])),
    })
    return rows.withColumn("error", F.when(udp & (rest == ""), "no host and port").when(udp & F.col("port").isNull(), "invalid port"))


def plain_number(c: Column) -> Column:
    """A double in its shortest digits, with a point from 0.0001 up to 10^16 and with an exponent (1e-05, 1.5e+17) beyond."""
    size, text = F.abs(c), c.cast("string")
    digits = F.regexp_replace(c.cast("decimal(38,21)").cast("string"), "0+$", "")
    whole = F.concat(digits, F.when(digits.endswith("."), "0").otherwise(""))
    power = F.regexp_extract(text, "E-?([0-9]+)$", 1)
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    scientific = F.concat(mantissa, F.when(text.contains("E-"), "e-").otherwise("e+"), F.when(F.length(power) < 2, "0").otherwise(""), power)
    endless = F.when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
    own = F.when((c == 0) | (size >= 1e-3) & (size < 1e7), text)  # as Spark writes it
    return F.coalesce(endless, own, F.when((size >= 1e-4) & (size < 1e16), whole), scientific)


def to_prometheus(metrics: DataFrame) -> DataFrame:
    """metrics as aggregate_metrics gives them. Lines (value) of the text exposition, a row each."""
    label = F.when(F.col("label_key") == "none", "").otherwise(F.concat(F.col("label_key"), F.lit('="'), F.col("label_val"), F.lit('"')))
    rows = metrics.withColumn("_label", label)
    braces = lambda c: F.when(c == "", "").otherwise(F.concat(F.lit("{"), c, F.lit("}")))
    line = lambda suffix, labels, v: F.concat(F.col("name"), F.lit(suffix), braces(labels), F.lit(" "), v)
    own = F.col("_label")
    quantiles = [
        line("", F.concat_ws(",", F.nullif(own, F.lit("")), F.lit(f'quantile="{int(c[1:]) / 100}"')), plain_number(F.col(c))) for c in metrics.columns if c[0] == "p" and c[1:].isdigit()
    ]
    value = plain_number(F.col("value"))
    histogram = F.array(*quantiles, line("_sum", own, value), line("_count", own, F.col("count").cast("string")))
    lines = F.when(F.col("kind") == "histogram", histogram).otherwise(F.array(line("", own, value)))
    return rows.select(F.explode(lines).alias("value"))
