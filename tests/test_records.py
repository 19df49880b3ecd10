import pytest
from pyspark.sql import functions as F

from lenswork.sources import records as R


def messages(spark):
    boxes = spark.createDataFrame([(1, 0, "FACE", 0.5, 1.0, 2.0, 3.0, 4.0, 7), (1, 1, "OBJECT", 0.25, 0.0, 0.0, 1.0, 1.0, 8)], "frame_number long, det_idx long, class string, score double, x1 double, y1 double, x2 double, y2 double, track_id long")
    frames = spark.createDataFrame([(1, 33, 30.0), (2, 66, 30.0)], "frame_number long, ts_ms long, fps double")
    return R.to_detections_json(boxes, frames)


def test_messages_and_empty_frames(spark):
    got = {r.frame_number: r.payload for r in messages(spark).collect()}
    assert got[2] == '{"timestamp_ms":66,"frame_number":2,"fps":30.0,"detections":[]}'
    assert got[1].startswith('{"timestamp_ms":33,"frame_number":1,"fps":30.0,"detections":[{"class":"FACE","score":0.5,"bbox":[1.0,2.0,3.0,4.0],"track_id":7},')


def test_messages_by_other_names(spark):
    df = spark.createDataFrame([('{"image_width": 5, "boxes": [{"label": "A"}, {}]}',), ("junk",), (None,), ('{"objects": []}',)], "payload string")
    assert [(r["class"], r.width) for r in R.parse_detections_json(df).orderBy("det_idx").collect()] == [("A", 5), ("FACE", 5)]


def test_event_stream_round_trip(spark, tmp_path):
    path = str(tmp_path / "sse")
    R.write_sse(messages(spark), path)
    got = R.read_sse(spark, path)
    assert got.filter("retry = 500").count() == 1
    assert sorted(r.id for r in got.filter("id is not null").collect()) == [1, 2]
    assert R.parse_detections_json(got, "data").count() == 2


def test_event_stream_errors_and_comments(spark, tmp_path):
    (tmp_path / "a.txt").write_text("event: error\ndata: x\ndata: y\n\n: keep-alive\n\n")
    rows = {(r.event, r.data, r.comment) for r in R.read_sse(spark, str(tmp_path / "a.txt")).collect()}
    assert rows == {("error", "x\ny", None), (None, None, "keep-alive")}


def test_raw_frames(spark, tmp_path):
    (tmp_path / "whole.bgr").write_bytes(bytes(range(24)))
    assert sorted(bytes(r.data) for r in R.read_raw_bgr(spark, str(tmp_path / "whole.bgr"), 2, 2).collect()) == [bytes(range(12)), bytes(range(12, 24))]
    (tmp_path / "short.bgr").write_bytes(bytes(13))
    with pytest.raises(ValueError):
        R.read_raw_bgr(spark, str(tmp_path / "short.bgr"), 2, 2)


def test_sources(spark):
    uris = ["rtsp://a/b", "udp://1.2.3.4:5000?pt=97&sprop=x", "udp://:6", "udp://h:port", "udp://", "/dev/video3", "2", "/dev/videox", None]
    rows = R.source_catalog(spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "i long, uri string")).orderBy("i").collect()
    assert [r.kind for r in rows] == ["rtsp", "udp", "udp", "udp", "udp", "device", "device", "device", "device"]
    assert (rows[1].host, rows[1].port, rows[1].payload, rows[1].sprop, rows[1].error) == ("1.2.3.4", 5000, "97", "x", None)
    assert (rows[2].host, rows[2].port, rows[2].payload) == ("0.0.0.0", 6, "96")
    assert [r.error is not None for r in rows[3:5]] == [True, True]
    assert [r.device_index for r in rows[5:]] == [3, 2, None, None]


def test_prometheus_lines(spark):
    m = spark.createDataFrame([("a", "counter", "none", "x", 2, 3.0, None), ("b", "histogram", "stage", "capture", 2, 3.0, 1.5)], "name string, kind string, label_key string, label_val string, count long, value double, p50 double")
    got = [r.value for r in R.to_prometheus(m.orderBy(F.col("name"))).collect()]
    assert got == ["a 3.0", 'b{stage="capture",quantile="0.5"} 1.5', 'b_sum{stage="capture"} 3.0', 'b_count{stage="capture"} 2']
