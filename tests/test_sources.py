"""Ranges of one file, streams of growing files, boxes of any shape."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lenswork.sources import files, mjpeg, records


def stream_of(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.random()
        body = bytes(rng.choice([0, 1, 0xFF, 0xD8, 0xD9, 0xD8]) for _ in range(rng.randrange(12)))
        out.append(mjpeg.JPEG_START + body + mjpeg.JPEG_END if kind < 0.7 else body)
    return b"".join(out) + mjpeg.JPEG_START + b"tail"


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_bytes_give_what_one_pass_gives(seed, monkeypatch):
    monkeypatch.setattr(mjpeg, "PIECE", 1 + seed * 3)
    data = stream_of(seed)
    whole = list(mjpeg.split_jpegs([data]))
    assert whole
    for width in (1, 2, 3, 7, 50, len(data)):
        got = [x for lo in range(0, len(data), width) for x in mjpeg.images_ending_in(io.BytesIO(data), lo, min(lo + width, len(data)))]
        assert got == whole


def test_one_stream_read_by_several_tasks(spark, tmp_path):
    data = stream_of(11, 300)
    (tmp_path / "one.mjpeg").write_bytes(data)
    (tmp_path / "empty.mjpeg").write_bytes(b"")
    whole = list(mjpeg.split_jpegs([data]))
    rows = files.read_mjpeg(spark, str(tmp_path), width=97)
    got = sorted((r.frame_number, r.start, bytes(r.jpeg)) for r in rows.collect())
    assert got == [(k, at, x) for k, (at, x) in enumerate(whole, 1)]
    spark.dataSource.register(mjpeg.MjpegSource)
    table = spark.read.format("mjpeg").option("range", 97).load(str(tmp_path))
    assert sorted((r.start, bytes(r.jpeg)) for r in table.collect()) == whole
    assert table.rdd.getNumPartitions() == -(-len(data) // 97)
    (tmp_path / "none").mkdir()
    assert spark.read.format("mjpeg").load(str(tmp_path / "none")).count() == 0


def test_a_file_that_grows_is_a_stream(spark, tmp_path):
    data = stream_of(12, 120)
    whole = list(mjpeg.split_jpegs([data]))
    (tmp_path / "in").mkdir()
    spark.dataSource.register(mjpeg.MjpegSource)
    for cut in (len(data) // 3, len(data) // 2, len(data)):  # the query starts again each time, from its checkpoint
        (tmp_path / "in" / "a.mjpeg").write_bytes(data[:cut])
        rows = spark.readStream.format("mjpeg").option("range", 64).load(str(tmp_path / "in"))
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        q.processAllAvailable()
        q.stop()
        got = sorted((r.start, bytes(r.jpeg)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got == [(at, x) for at, x in whole if at + len(x) <= cut]


def test_raw_frames_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RANGE_BYTES", 40)
    data = np.random.default_rng(1).integers(0, 256, 12 * 11, dtype=np.uint8).tobytes()
    (tmp_path / "a.bgr").write_bytes(data)
    got = sorted((r.frame_number, bytes(r.data), r.width) for r in records.read_raw_bgr(spark, str(tmp_path / "a.bgr"), 2, 2).collect())
    assert got == [(k + 1, data[12 * k : 12 * k + 12], 2) for k in range(11)]


def test_messages_with_boxes_of_any_shape(spark):
    texts = [
        '{"frame_number":1,"detections":[{"bbox":[1,2,3,4],"class":"A","score":0.5},{"bbox":{"x1":1,"y1":2.5,"x2":3,"y2":4}},{"x":1,"y":2,"w":3,"h":4,"label":"B"}]}',
        '{"boxes":[{"bbox":null,"left":1,"top":2,"right":3,"bottom":4},{"bbox":"no"},{"score":"0.25"}],"image_width":9}', "no json", '{"objects":[]}', None,
    ]
    rows = records.parse_detections_json(spark.createDataFrame([(t,) for t in texts], "payload string")).collect()
    sides = [{k: v for k, v in r.box.asDict().items() if v is not None} if r.box else None for r in rows]
    assert [(r.det_idx, r["class"], r.bbox) for r in rows] == [(0, "A", [1.0, 2.0, 3.0, 4.0]), (1, "FACE", None), (2, "B", None), (0, "FACE", None), (1, "FACE", None), (2, "FACE", None)]
    assert sides == [None, {"x1": 1, "y1": 2.5, "x2": 3, "y2": 4}, {"x": 1, "y": 2, "w": 3, "h": 4}, {"left": 1, "top": 2, "right": 3, "bottom": 4}, None, None]
    assert [r.score for r in rows] == [0.5, None, None, None, None, 0.25] and rows[3].width == 9


def test_messages_of_a_stream(spark, tmp_path):
    messages = spark.createDataFrame([('{"frame_number":1,"boxes":[{"left":1,"top":2,"right":3,"bottom":4}]}',)], "payload string")
    messages.write.parquet(f"{tmp_path}/in")
    rows = records.parse_detections_json(spark.readStream.schema(messages.schema).parquet(f"{tmp_path}/in")).select("frame_number", F.col("box.right").alias("right"))
    rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [r[:] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 3.0)]
