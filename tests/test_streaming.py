"""Streaming forms give what the batch forms give on the same rows, whatever the batches are."""

import pytest
from pyspark.sql import functions as F

from lenswork.operators import detection as D
from lenswork.operators import health as H
from lenswork.operators import overlays as O
from lenswork.operators import timeline as L
from lenswork.plans.fixtures import view
from lenswork.streaming import streams as S


def as_stream(spark, df, path, order, parts=3):
    """df in `parts` files by order, one read per batch."""
    edges = df.approxQuantile(order, [i / parts for i in range(parts + 1)], 0.0)
    for i in range(parts):
        low = F.col(order) > edges[i] if i else F.lit(True)
        df.filter(low & (F.col(order) <= edges[i + 1])).coalesce(1).write.mode("append").parquet(f"{path}/part{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/part*")


def ran(stream, tmp_path, name):
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/{name}")


def folded(stream, sink, tmp_path, name):
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["batchId"]


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_numbers_and_rates(spark, sf, tmp_path):
    frames = view(spark, sf, "frames").select("camera_id", "event_id", "ts_ms").filter("ts_ms < 5000000")
    got = ran(S.numbered_frames(as_stream(spark, frames, f"{tmp_path}/in", "ts_ms")), tmp_path, "out")
    want = L.smoothed_fps(L.number_frames(frames))
    columns = ("camera_id", "event_id", "frame_number", "fps")
    assert rows(got, *columns) == rows(want, *columns) and got.count() > 0


def test_stalls(spark, sf, tmp_path):
    beats = view(spark, sf, "heartbeats")
    got = ran(S.stall_alerts(as_stream(spark, beats, f"{tmp_path}/in", "ts_ms")), tmp_path, "out")
    columns = ("camera_id", "component", "ts_ms", "gap_ms")
    assert rows(got.filter("gap_ms is not null"), *columns) == rows(H.stalls(beats), *columns)


def test_silence_is_told_before_the_next_beat(spark, tmp_path):
    beats = spark.createDataFrame([("a", 1000, 0), ("b", 1000, 1), ("b", 90_000, 2), ("b", 91_000, 3), ("b", 92_000, 4)], "component string, ts_ms long, n long")
    got = ran(S.stall_alerts(as_stream(spark, beats, f"{tmp_path}/in", "n")), tmp_path, "out")
    assert ("a", 1000, None) in [tuple(r) for r in got.collect()] and ("b", 1000, 89_000) in [tuple(r) for r in got.collect()]


def test_inflight(spark, tmp_path):
    sent = spark.createDataFrame([(1, 1000), (2, 2000), (3, 3000), (9, 900_000)], "frame_number long, ts_ms long")
    done = spark.createDataFrame([(1, 1500), (3, 3400), (7, 3500), (9, 900_001)], "frame_number long, ts_ms long")
    found = S.inflight_stream(as_stream(spark, sent, f"{tmp_path}/a", "ts_ms"), as_stream(spark, done, f"{tmp_path}/b", "ts_ms"))
    got = {tuple(r) for r in ran(found, tmp_path, "out").collect()}
    assert got >= {(1, "done", 500), (3, "done", 400), (2, "open", None), (7, "unknown", None)}


@pytest.mark.parametrize("sink,batch", [(S.latest_sink, L.latest_frame), (S.history_sink, L.frame_history)])
def test_latest_and_history(spark, sf, tmp_path, sink, batch):
    frames = view(spark, sf, "frames").withColumn("done_seq", F.col("event_id").cast("long"))
    last = folded(as_stream(spark, frames, f"{tmp_path}/in", "ts_ms"), sink(f"{tmp_path}/s"), tmp_path, "q")
    got = spark.read.parquet(f"{tmp_path}/s/batch={last}")
    assert last > 0 and rows(got, "camera_id", "frame_number") == rows(batch(frames), "camera_id", "frame_number")


def test_overlay_log(spark, sf, tmp_path):
    log = view(spark, sf, "overlay_log").withColumn("op", F.when(F.col("op_id") == 400, "clear").otherwise(F.col("op")))
    last = folded(as_stream(spark, log, f"{tmp_path}/in", "op_id"), S.overlay_log_sink(f"{tmp_path}/s"), tmp_path, "q")
    got = O.overlay_state(spark.read.parquet(f"{tmp_path}/s/batch={last}"))
    assert rows(got, "overlay_id", "op_id", "type") == rows(O.overlay_state(log), "overlay_id", "op_id", "type")


def test_track_ids_go_on(spark, sf, tmp_path):
    preds = view(spark, sf, "raw_preds").filter("frame_number < 60")
    folded(as_stream(spark, preds, f"{tmp_path}/in", "frame_number"), S.detection_sink(f"{tmp_path}/s"), tmp_path, "q")
    columns = ("frame_number", "det_idx", "track_id", "class", "score")
    got = spark.read.parquet(f"{tmp_path}/s/detections")
    assert rows(got, *columns) == rows(D.detect_chain(preds), *columns)


def test_window_rates(spark, sf, tmp_path):
    frames = view(spark, sf, "frames").select("camera_id", "frame_number", "ts_ms")
    got = ran(S.window_rates(as_stream(spark, frames, f"{tmp_path}/in", "ts_ms")), tmp_path, "out")
    want = L.window_fps(frames)
    assert rows(got, "camera_id", "ts_ms", "fps") == rows(want, "camera_id", "ts_ms", "fps") and got.count() > 0


@pytest.mark.parametrize("parts", [(2, 5), (5, 2)])
def test_lost_frames(spark, sf, tmp_path, parts):
    frames = view(spark, sf, "frames").select("camera_id", "frame_number", "ts_ms")
    sent = frames.filter("frame_number % 7 <> 3")
    streams = [as_stream(spark, df, f"{tmp_path}/in{i}", "frame_number", n) for i, (df, n) in enumerate(zip((frames, sent), parts))]
    got = ran(S.lost_frames(*streams), tmp_path, "out")
    last = sent.groupBy("camera_id").agg(F.max("frame_number").alias("last"))
    want = L.dropped_frames(frames, sent).join(last, "camera_id").filter("frame_number < last")
    assert rows(got, "camera_id", "frame_number", "dropped_total") == rows(want, "camera_id", "frame_number", "dropped_total") and got.count() > 0


def test_points_of_a_stream_in_zones(spark, sf, tmp_path):
    markers, zones = view(spark, sf, "markers"), view(spark, sf, "zone_vertices")
    got = ran(O.point_in_zone(as_stream(spark, markers, f"{tmp_path}/in", "marker_id"), zones), tmp_path, "out")
    assert rows(got, "marker_id", "zone_id") == rows(O.point_in_zone(markers, zones), "marker_id", "zone_id") and got.count() > 0
