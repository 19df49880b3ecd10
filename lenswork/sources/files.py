"""Readers of image folders, motion-JPEG streams and digit sets; writers of GeoJSON and trace files.

Files are listed by Spark; their bytes are read inside tasks, in pieces, so none has to fit in memory whole.
"""

from __future__ import annotations

import posixpath
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import open_file
from ..operators.telemetry import trace_order
from .mjpeg import RANGE, images_ending_in

#: Magic numbers of image and label files, names of a digit set's files.
IMAGES_MAGIC, LABELS_MAGIC = 2051, 2049
DIGIT_FILES = {"train": ("train-images-idx3-ubyte", "train-labels-idx1-ubyte"), "test": ("t10k-images-idx3-ubyte", "t10k-labels-idx1-ubyte")}
#: Records of a digit set that one row of the plan stands for.
RECORDS = 4096


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Paths and lengths; the content column is pruned, so nothing is read yet."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """JPEG and PNG files of a folder as frames (path, width, height, data: BGR bytes); files that are no images are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.data").filter("nChannels = 3").drop("nChannels")


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder as they arrive (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").load(path)


def read_mjpeg(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    """Rows (path, frame_number from 1, start, jpeg), in a stream's order; ranges of `width` bytes of a file are read by tasks of their own.

    A first look counts the images that end in each range, a row each; so the second one knows its first number.
    """
    listed = _listed(spark, path).filter("length > 0")
    ranges = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(width).cast("long"))).alias("lo"))
    ranges = ranges.select("path", "lo", F.least(F.col("lo") + width, F.col("length")).alias("hi")).repartition("path", "lo")

    def count(batches):
        for b in batches:
            n = []
            for name, lo, hi in zip(*(b.column(c).to_pylist() for c in ("path", "lo", "hi"))):
                with open_file(name) as f:
                    n.append(sum(1 for _ in images_ending_in(f, lo, hi)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], ["path", "lo", "hi", "n"])

    counts = ranges.mapInArrow(count, "path string, lo long, hi long, n long")
    before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("n > 0").repartition("path", "lo")

    def split(batches):
        for b in batches:
            for name, lo, hi, first in zip(*(b.column(c).to_pylist() for c in ("path", "lo", "hi", "before"))):
                with open_file(name) as f:
                    for n, (at, jpeg) in enumerate(images_ending_in(f, lo, hi), first + 1):
                        yield pa.RecordBatch.from_pydict({"path": [name], "frame_number": [n], "start": [at], "jpeg": [jpeg]})

    return numbered.mapInArrow(split, "path string, frame_number long, start long, jpeg binary")


def read_idx(spark: SparkSession, path: str, part: str = "train") -> DataFrame:
    """Rows (record, features: pixels / 255, label) of a folder's digit set; both files are cut into ranges of records.

    A file with another magic number, unequal counts, or bytes short of its count is an error.
    """
    images, labels = (posixpath.join(path, name) for name in DIGIT_FILES[part])

    def head(name: str, fields: str):
        with open_file(name) as f:
            return struct.unpack(fields, f.read(struct.calcsize(fields))), f.size()

    (magic, n, h, w), size = head(images, ">4I")
    (label_magic, m), label_size = head(labels, ">2I")
    if (magic, label_magic) != (IMAGES_MAGIC, LABELS_MAGIC) or n != m or size < 16 + n * h * w or label_size < 8 + n:
        raise ValueError(f"{images}, {labels}: no digit set, or not whole")

    def cut(batches):
        import numpy as np

        for b in batches:
            for i in b.column("id").to_pylist():
                lo, hi = i * RECORDS, min(n, (i + 1) * RECORDS)
                with open_file(images) as f, open_file(labels) as g:
                    f.seek(16 + lo * h * w)
                    g.seek(8 + lo)
                    pixels, digits = f.read((hi - lo) * h * w), g.read(hi - lo)
                values = pa.array(np.frombuffer(pixels, np.uint8) / 255.0)
                features = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (h * w)), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), features, pa.array(np.frombuffer(digits, np.uint8).astype(float))], ["record", "features", "label"])

    return spark.range(-(-n // RECORDS)).mapInArrow(cut, "record long, features array<double>, label double")


def to_geojson(overlays: DataFrame, vertices: DataFrame, key: str = "overlay_id") -> DataFrame:
    """overlays: key, type, label; vertices: key, ring, vtx, lat, lng. Rows (key, feature): one GeoJSON feature for each overlay with vertices.

    Coordinates are [lng, lat]; rings of polygons and rectangles are closed; a rectangle's vertices are its corners in order.
    """
    point = F.struct("ring", "vtx", F.array("lng", "lat").alias("at"))
    shapes = vertices.groupBy(key).agg(F.array_sort(F.collect_list(point)).alias("p"))
    line = F.transform("p", lambda x: x["at"])
    ring = lambda r: F.transform(F.filter("p", lambda x: x["ring"] == r), lambda x: x["at"])
    closed = lambda c: F.when(F.get(c, F.lit(0)) == F.element_at(c, -1), c).otherwise(F.concat(c, F.slice(c, 1, 1)))
    rings = F.transform(F.array_distinct(F.transform("p", lambda x: x["ring"])), lambda r: closed(ring(r)))
    kind = F.when(F.col("type") == "marker", "Point").when(F.col("type").isin("polygon", "rectangle"), "Polygon").otherwise("LineString")
    places = F.when(kind == "Point", F.to_json(F.get(line, F.lit(0)))).when(kind == "Polygon", F.to_json(rings)).otherwise(F.to_json(line))
    properties = F.to_json(F.struct(F.col(key), "type", "label"))
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), places, F.lit('},"properties":'), properties, F.lit("}"))
    return overlays.join(shapes, key).select(key, text.alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    """A folder of line-delimited features in parallel: together, in a FeatureCollection's brackets, they are one document."""
    features.select(F.col("feature").alias("value")).write.text(path)


def trace_lines(events: DataFrame) -> DataFrame:
    """events as normalise_trace gives them. Rows (value) in the order of a trace file, metadata first."""
    fields = ["ph", "id", "tid", "ts", "name"]
    return events.orderBy(*trace_order()).select(F.to_json(F.struct(*fields)).alias("value"))


def write_trace_json(events: DataFrame, path: str) -> None:
    """Line-delimited trace events; the sort is by ranges, so the files in the order of their names are the trace."""
    trace_lines(events).write.text(path)
