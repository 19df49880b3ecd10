import numpy as np
from pyspark.sql import functions as F

from lenswork.functions import common as C
from lenswork.operators import detection as D
from lenswork.operators import geo as G
from lenswork.operators import health as H
from lenswork.operators import ml as M
from lenswork.operators import overlays as O
from lenswork.operators import pixels as P
from lenswork.operators import timeline as L

RAW = "frame_number long, pred_idx long, x double, y double, w double, h double, score double, class_id long"


def test_nan_and_null_scores_go(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, float("nan"), 0), (1, 2, 0.0, 0.0, 1.0, 1.0, None, 0), (1, 3, 0.0, 0.0, 1.0, 1.0, 0.25, 0)], RAW)
    assert [r.pred_idx for r in D.filter_confidence(rows).collect()] == [3]


def test_nms_like_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(f, i, *map(float, rng.integers(0, 200, 2)), *map(float, rng.integers(0, 90, 2)), float(rng.integers(0, 20)) / 20, 0) for f in range(6) for i in range(60)]
    kept = {(r.frame_number, r.pred_idx) for r in D.nms(D.xywh_to_corners(spark.createDataFrame(rows, RAW))).collect()}

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return w * h / (area(a) + area(b) - w * h + 1e-6) if w > 0 and h > 0 else 0

    wanted = set()
    for f in range(6):
        chosen = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[6], r[1])):
            box = (r[2] - r[4] / 2, r[3] - r[5] / 2, r[2] + r[4] / 2, r[3] + r[5] / 2)
            if all(iou(box, c) <= 0.45 for c in chosen):
                chosen.append(box)
                wanted.add((f, r[1]))
    assert kept == wanted


def test_predictions_need_five_channels(spark):
    six = spark.createDataFrame([(1, [[1.0, 2.0], [1.0, 2.0], [3.0, 3.0], [4.0, 4.0], [0.5, 0.6], [1.9, 0.0]])], "frame_number long, tensor array<array<double>>")
    assert [(r.pred_idx, r.score, r.class_id) for r in D.explode_predictions(six).orderBy("pred_idx").collect()] == [(1, 0.5, 1), (2, 0.6, 0)]


def test_label_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("FACE", 3, 0.125), ("FACE", 4, 0.375)], "class string, track_id long, score double")
    assert [r.label_text for r in D.label_text(rows).collect()] == ["FACE 3 12%", "FACE 4 38%"]


def test_stalls_beyond_the_threshold_only(spark):
    beats = spark.createDataFrame([("capture", 0, 1), ("capture", 1500, 2), ("capture", 3001, 3)], "component string, ts_ms long, event_id long")
    assert [(r.ts_ms, r.gap_ms) for r in H.stalls(beats).collect()] == [(1500, 1501)]


def test_watchdog_grace_without_beats(spark):
    runs = spark.createDataFrame([(1, 0, 10000)], "run_id long, start_ms long, end_ms long")
    beats = spark.createDataFrame([(1, "capture", t, t) for t in range(0, 10001, 500)], "run_id long, component string, ts_ms long, event_id long")
    found = H.watchdog_trigger(beats, runs).first()
    assert (found.trigger_ms, found.component) == (7000, "processing")


def test_smoothed_rate_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 7)
    rng = np.random.default_rng(2)
    ts = np.cumsum(rng.integers(0, 50, 40)).tolist()
    rows = spark.createDataFrame([(0, i + 1, t) for i, t in enumerate(ts)], "camera_id long, frame_number long, ts_ms long")
    state, wanted = 0.0, []
    for i, t in enumerate(ts):
        dt = (t - ts[i - 1]) / 1000 if i else 0
        if dt > 0:
            state = 1 / dt if state == 0 else 0.9 * state + 0.1 / dt
        wanted.append(state)
    got = [r.fps for r in L.smoothed_fps(rows).orderBy("frame_number").collect()]
    assert np.allclose(got, wanted)


def test_compass_ties_and_wrap(spark):
    rows = spark.createDataFrame([(0.0,), (22.5,), (22.6,), (337.5,), (359.0,)], "d double")
    assert [r.w for r in rows.select(G.compass8(F.col("d")).alias("w")).collect()] == ["N", "N", "NE", "N", "N"]


def test_boxes_of_each_shape(spark):
    rows = spark.createDataFrame([([10.0, 20.0, 30.0, 40.0],), ([0.1, 0.2, 0.3, 0.4],), ([0.5, 0.5, 0.2, 0.2],), ([1.0],)], "b array<double>")
    u, v = G.bbox_center_uv(F.col("b"), 100, 100)
    got = [(round(r.u, 4), round(r.v, 4)) for r in rows.select(u.alias("u"), v.alias("v")).collect()]
    assert got == [(0.2, 0.3), (0.002, 0.003), (0.6, 0.6), (0.5, 0.5)]


def test_short_ring_has_no_area(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 1.0, 1.0)], "zone_id long, ring int, vtx int, lat double, lng double")
    assert O.polygon_area(rows).first().area_m2 == 0


def test_preprocess_keeps_a_same_size_picture(spark):
    data = bytes(range(48))
    frames = spark.createDataFrame([(1, bytearray(data), 4, 4)], "frame_number long, data binary, width int, height int")
    got = P.preprocess(frames, 4, 4).first()
    assert bytes(got.resized) == data
    assert np.allclose(got.tensor, (np.frombuffer(data, np.uint8).reshape(4, 4, 3)[:, :, ::-1] / 255).transpose(2, 0, 1).ravel())
    assert P.check_buffer(frames).count() == 0 and P.check_buffer(frames.withColumn("width", F.lit(5))).count() == 1


def test_classifier_learns(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(k, 0.1, 4).tolist(), float(k)) for k in range(10) for _ in range(10)]
    df = spark.createDataFrame(rows, "features array<double>, label double")
    assert M.evaluate(M.predict(M.train_classifier(df), df)).first().accuracy > 0.9


def test_detect_needs_a_result_for_each_frame(spark):
    frames = spark.createDataFrame([(i,) for i in range(20)], "frame_number long")
    got = D.detect(frames, lambda pdf: [{"score": float(x)} for x in pdf.frame_number], "score double", ["frame_number"], 3)
    assert sorted((r.frame_number, r.score) for r in got.collect()) == [(i, float(i)) for i in range(20)]


def test_frame_delta_of_bytes(spark):
    import numpy as np

    from lenswork.operators import pixels as P

    rng = np.random.default_rng(3)
    shots = [rng.integers(0, 256, 36).astype(np.uint8) for _ in range(4)]
    frames = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(shots)] + [(4, None), (5, bytearray(b"abc"))], "frame_number long, data binary")
    got = {r.frame_number: r.mags for r in P.frame_delta(frames).collect()}
    for i in (1, 2, 3):
        d = np.abs(shots[i].astype(int) - shots[i - 1]).reshape(-1, 3).sum(axis=1) / 3
        assert list(got[i]) == [0 if x < 20 else int(x) for x in d]
    assert got[0] is None and got[4] is None and got[5] is None
    swapped = {r.frame_number: r.data for r in P.bgr_to_rgb(frames).collect()}
    assert bytes(swapped[5]) == b"cba" and swapped[4] is None


def test_model_is_saved_and_read(spark, tmp_path):
    from pyspark.sql import functions as F

    from lenswork.operators import ml as M

    rows = spark.range(60).select(F.array([(F.col("id") % 2).cast("double")] * 3).alias("features"), (F.col("id") % 2).cast("double").alias("label"))
    model = M.train_classifier(rows, max_iter=5)
    M.save_model(model, str(tmp_path / "m"))
    a, b = (M.predict(m, rows).select("digit").collect() for m in (model, M.load_model(str(tmp_path / "m"))))
    assert a == b and M.epoch_loss(spark, model).count() > 0


def test_window_fps_with_and_without_silences(spark):
    from lenswork.operators import timeline as L

    times = {0: [0, 400, 900, 1001, 1500, 2001, 2002, 9000, 9001, 10_500, 20_000], 1: [5], 2: [0, 5000]}
    frames = spark.createDataFrame([(c, i + 1, t) for c, ts in times.items() for i, t in enumerate(ts)], "camera_id long, frame_number long, ts_ms long")
    want = []
    for c, ts in times.items():
        start, n = ts[0], 0
        for t in ts:
            n += 1
            if t - start > 1000:
                want.append((c, t, round(n * 1000 / (t - start), 6)))
                start, n = t, 0
    assert sorted((r.camera_id, r.ts_ms, round(r.fps, 6)) for r in L.window_fps(frames).collect()) == sorted(want)
    one = L.window_fps(frames.filter("camera_id = 0").drop("camera_id")).collect()
    assert len(one) == sum(c == 0 for c, _, _ in want)


def test_boxes_of_every_shape(spark):
    def centre_and_size(fields, values):
        df = spark.createDataFrame([(values,)], f"b struct<{', '.join(f + ':double' for f in fields)}>")
        return df.select(*G.box_center_uv(df, "b", 100, 50), *G.box_size(df, "b")).first()[:]

    assert centre_and_size(["x1", "y1", "x2", "y2"], (10.0, 10.0, 30.0, 20.0)) == (0.2, 0.3, 0.0, 0.0)
    assert centre_and_size(["x1", "y1", "x2", "y2"], (0.0, 0.2, 0.5, 0.6)) == (0.25, 0.4, 0.0, 0.0)
    assert centre_and_size(["left", "top", "right", "bottom"], (30.0, 20.0, 10.0, 10.0)) == (0.2, 0.3, 20.0, 10.0)
    assert centre_and_size(["x", "y", "w", "h"], (10.0, 10.0, 20.0, 10.0)) == (0.2, 0.3, 20.0, 10.0)
    assert centre_and_size(["x", "y", "width", "height"], (0.5, 0.5, 0.5, 0.25)) == (0.75, 0.625, 0.5, 0.25)
    assert centre_and_size(["x", "y", "width", "height"], (1.0, None, 5.0, None)) == (0.5, 0.5, 5.0, 0.0)
    assert centre_and_size(["x1", "y1", "x2", "y2", "x", "y", "w", "h"], (None, 1.0, 2.0, 3.0, 10.0, 10.0, 20.0, 10.0)) == (0.2, 0.3, 20.0, 10.0)
    df = spark.createDataFrame([([10.0, 10.0, 30.0, 20.0],), ([1.0, 2.0],)], "b array<double>")
    assert [r[:] for r in df.select(*G.box_center_uv(df, "b", 100, 50), *G.box_size(df, "b")).collect()] == [(0.2, 0.3, 20.0, 10.0), (0.5, 0.5, 0.0, 0.0)]


def test_one_camera_over_many_ranges(spark):
    import random

    rng = random.Random(3)
    times = sorted(rng.choice(range(0, 60_000, 7)) for _ in range(400))
    events = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "ts_ms long, event_id long").repartition(5)
    got = C.previous(C.numbered(events, [], ["ts_ms", "event_id"], 1000, "n"), [], "n", "ts_ms", 16, "before").orderBy("n").collect()
    assert [(r.n, r.event_id, r.before) for r in got] == [(i + 1, i, times[i - 1] if i else None) for i in range(400)]
    ticks = spark.createDataFrame([(t,) for t in range(-500, 61_000, 250)], "ts_ms long")
    found = C.as_of(ticks, events, [], "ts_ms", ["event_id"], ["event_id"], width=1000).collect()
    assert len(found) == 246
    for r in found:
        assert r.event_id == max((i for i, t in enumerate(times) if t <= r.ts_ms), default=None)


def test_preprocess_resizes_by_pixel_centres(spark):
    rng = np.random.default_rng(1)
    for (h, w), (th, tw) in (((5, 7), (3, 4)), ((3, 2), (8, 9))):
        image = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        frame = spark.createDataFrame([(1, bytearray(image.tobytes()), w, h)], "frame_number long, data binary, width int, height int")
        want = np.zeros((th, tw, 3))
        for y in range(th):
            for x in range(tw):
                fy, fx = (y + 0.5) * h / th - 0.5, (x + 0.5) * w / tw - 0.5
                y0, x0 = max(0, int(np.floor(fy))), max(0, int(np.floor(fx)))
                ty, tx = (fy - y0 if fy > 0 else 0.0), (fx - x0 if fx > 0 else 0.0)
                y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
                a, b, c, d = (image[p].astype(float) for p in ((y0, x0), (y0, x1), (y1, x0), (y1, x1)))
                want[y, x] = (a * (1 - tx) + b * tx) * (1 - ty) + (c * (1 - tx) + d * tx) * ty
        for order in ("rgb", "bgr"):
            got = P.preprocess(frame, tw, th, order).first()
            channels = want[:, :, ::-1] if order == "rgb" else want
            assert np.allclose(np.array(got.tensor).reshape(3, th, tw), channels.transpose(2, 0, 1) / 255)
            assert np.abs(np.frombuffer(got.resized, np.uint8).reshape(th, tw, 3) - want).max() <= 1


def test_image_to_features_like_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    h, w, side = 40, 31, M.SIDE
    image = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
    frame = spark.createDataFrame([(1, bytearray(image.tobytes()), w, h)], "frame_number long, data binary, width int, height int")
    grey = image[:, :, 0] * 0.114 + image[:, :, 1] * 0.587 + image[:, :, 2] * 0.299

    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def weights(n, at):
        scale = max(1.0, n / side)
        k = [kernel((i - ((at + 0.5) * n / side - 0.5)) / scale) for i in range(n)]
        return [x / sum(k) for x in k]

    rows, columns = [weights(h, y) for y in range(side)], [weights(w, x) for x in range(side)]
    want = [sum(rows[y][i] * sum(columns[x][j] * grey[i, j] for j in range(w) if columns[x][j]) for i in range(h) if rows[y][i]) / 255 for y in range(side) for x in range(side)]
    got = M.image_to_features(frame).first().features
    assert len(got) == side * side and np.allclose(got, np.clip(want, 0, 1))


def test_detection_key_rounds_exact_values(spark):
    rows = spark.createDataFrame([(0.0625, -0.0625, 0.125), (0.1875, 0.3, 0.345), (1.0005, 0.0, 1.005)], "u double, v double, s double")
    got = [r.k for r in rows.coalesce(1).select(G.detection_key(F.col("u"), F.col("v"), F.col("s")).alias("k")).collect()]
    assert sorted(got) == ["0.063:-0.063:0.13", "0.188:0.300:0.34", "1.000:0.000:1.00"]
