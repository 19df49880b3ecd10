import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lenswork.operators import telemetry as T
from lenswork.plans.fixtures import view
from lenswork.sources import files as S
from lenswork.sources import mjpeg as MJ


def png(width, height, rgb):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(2, 1, (255, 0, 7)))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = S.read_frames(spark, str(tmp_path)).collect()
    assert [(r.width, r.height, bytes(r.data)) for r in got] == [(2, 1, bytes([7, 0, 255]) * 2)]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_jpegs_across_pieces(size):
    a, b = b"\xff\xd8one\xff\xd9", b"\xff\xd8\xfftwo\xff\xd9"
    stream = b"junk\xff" + a + b"--" + b + b"\xff\xd8tail"
    got = list(MJ.split_jpegs(stream[i : i + size] for i in range(0, len(stream), size)))
    assert got == [(5, a), (5 + len(a) + 2, b)]
    assert list(MJ.split_jpegs([])) == []


def test_mjpeg_files(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).write_bytes(b"".join(b"\xff\xd8" + name.encode() + str(i).encode() + b"\xff\xd9" for i in range(3)))
    (tmp_path / "empty").write_bytes(b"")
    got = S.read_mjpeg(spark, str(tmp_path)).collect()
    assert sorted((r.path[-1], r.frame_number, bytes(r.jpeg)[2:-2]) for r in got) == [(n, i + 1, f"{n}{i}".encode()) for n in "xy" for i in range(3)]


def digits(path, n, label_count=None):
    names = S.DIGIT_FILES["train"]
    (path / names[0]).write_bytes(struct.pack(">4I", 2051, n, 28, 28) + bytes(i % 256 for i in range(n) for _ in range(784)))
    (path / names[1]).write_bytes(struct.pack(">2I", 2049, n if label_count is None else label_count) + bytes(i % 10 for i in range(n)))


def test_digit_set(spark, tmp_path):
    digits(tmp_path, 5000)
    got = S.read_idx(spark, str(tmp_path))
    sums = got.select("record", "label", F.element_at("features", 784).alias("last"), F.size("features").alias("n"))
    assert [tuple(r) for r in sums.orderBy("record").collect()] == [(i, float(i % 10), i % 256 / 255, 784) for i in range(5000)]


def test_digit_sets_that_do_not_fit(spark, tmp_path):
    digits(tmp_path, 5, 4)
    with pytest.raises(ValueError):
        S.read_idx(spark, str(tmp_path))


def test_features(spark, tmp_path):
    overlays = spark.createDataFrame([(1, "marker", "P"), (2, "polyline", None), (3, "polygon", 'Z "1"'), (4, "marker", "nowhere")], "overlay_id long, type string, label string")
    v = [(1, 0, 0, 1.0, 2.0), (2, 0, 1, 3.0, 4.0), (2, 0, 0, 1.0, 2.0)] + [(3, r, i, float(i), float(r)) for r in (0, 1) for i in range(3)]
    vertices = spark.createDataFrame(v, "overlay_id long, ring int, vtx int, lat double, lng double")
    features = S.to_geojson(overlays, vertices)
    S.write_geojson(features, str(tmp_path / "g"))
    got = {f["properties"]["overlay_id"]: f for f in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect())}
    assert set(got) == {1, 2, 3}
    assert got[1]["geometry"] == {"type": "Point", "coordinates": [2.0, 1.0]}
    assert got[2]["geometry"] == {"type": "LineString", "coordinates": [[2.0, 1.0], [4.0, 3.0]]}
    assert got[3]["geometry"] == {"type": "Polygon", "coordinates": [[[float(r), 0.0], [float(r), 1.0], [float(r), 2.0], [float(r), 0.0]] for r in (0, 1)]}
    assert got[3]["properties"]["label"] == 'Z "1"'


def test_trace_files(spark, sf, tmp_path):
    events = T.normalise_trace(view(spark, sf, "trace_events"))
    S.write_trace_json(events, str(tmp_path / "t"))
    got = [json.loads(line) for f in sorted((tmp_path / "t").glob("part-*")) for line in f.read_text().splitlines()]
    meta = [e["ph"] == "M" for e in got]
    assert len(got) == events.count() and meta == sorted(meta, reverse=True)
    times = [e["ts"] for e in got if e["ph"] != "M"]
    assert times == sorted(times)
