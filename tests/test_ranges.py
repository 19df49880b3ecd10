"""Operators that deal one camera, series or id out over ranges, against plain loops, with ranges of a few rows."""

import math
import random

import numpy as np
import pytest

from lenswork.functions import common as C
from lenswork.operators import health as H
from lenswork.operators import telemetry as T
from lenswork.operators import timeline as L


@pytest.fixture
def narrow(monkeypatch):
    for module in (L, H):
        monkeypatch.setattr(module, "RANGE_MS", 3000)
    monkeypatch.setattr(L, "BUCKET", 8)
    monkeypatch.setattr(L, "TICKS", 16)
    monkeypatch.setattr(T, "SEGMENT", 10)
    for name, value in (("CUTS", 64), ("FEW", 20)):
        monkeypatch.setattr(C, name, value)


def rates(times):
    out, start, n = [], times[0], 0
    for t in times:
        n += 1
        if t - start > 1000:
            out.append((t, round(n * 1000 / (t - start), 6)))
            start, n = t, 0
    return out


@pytest.mark.parametrize("steps", [(0, 2500), (900, 9000)])
def test_window_rates_of_one_camera_in_many_ranges(spark, narrow, steps):
    rng = random.Random(steps[1])
    cameras = {c: sorted(np.cumsum([rng.randint(*steps) for _ in range(300)]).tolist()) for c in range(3)}
    cameras[3] = [5]
    cameras[4] = [-7000, 100_000]
    rows = [(c, i + 1, t) for c, ts in cameras.items() for i, t in enumerate(ts)]
    frames = spark.createDataFrame([*rows, (5, 1, None)], "camera_id long, frame_number long, ts_ms long").repartition(4)
    got = sorted((r.camera_id, r.ts_ms, round(r.fps, 6)) for r in L.window_fps(frames).collect())
    assert got == sorted((c, *x) for c, ts in cameras.items() for x in rates(ts))
    alone = sorted((r.ts_ms, round(r.fps, 6)) for r in L.window_fps(frames.filter("camera_id = 1").drop("camera_id")).collect())
    assert alone == rates(cameras[1])
    assert L.window_fps(frames.limit(0)).count() == 0


def test_no_task_has_a_whole_camera(spark, narrow):
    frames = spark.createDataFrame([(0, i + 1, i * 40) for i in range(2000)], "camera_id long, frame_number long, ts_ms long")
    ranges = {math.floor(i * 40 / 3000) for i in range(2000)}
    assert len(ranges) == 27 and L.window_fps(frames).count() == len(rates([i * 40 for i in range(2000)]))


def test_ticks_of_a_long_timeline(spark):
    ten_years = 10 * 365 * 86_400_000
    frames = spark.createDataFrame([(0, 1, 7), (0, 2, 90_000), (0, 3, ten_years)], "camera_id long, frame_number long, ts_ms long")
    found = L.ticks(frames.groupBy("camera_id").agg({"ts_ms": "min"}).selectExpr("camera_id", "0L lo", f"{ten_years}L hi"), 330_000)
    assert found.count() == ten_years // 330_000 + 1 and found.selectExpr("max(ts_ms) % 330000", "min(ts_ms)").first()[:] == (0, 0)
    got = L.tick_snapshots(frames.filter("frame_number < 3"), 33).collect()
    assert sorted((r.ts_ms, r.frame_number) for r in got) == [(t, 2 if t >= 90_000 else 1 if t >= 7 else None) for t in range(0, 90_000, 33)]
    assert L.tick_snapshots(frames.filter("frame_number < 3"), 33, keep_alive=False).count() == len(got) - 1


def watchdog(beats, start, end):
    for p in range(start + 500, end + 1, 500):
        for name in H.COMPONENTS:
            last = max((t for c, t in beats if c == name and t <= p), default=start + 5000)
            if p - last > 1500:
                return p, name
    return None


@pytest.mark.parametrize("seed", range(2))
def test_watchdog_without_polls(spark, narrow, seed):
    rng = random.Random(seed)
    runs, rows, wanted = [], [], []
    for run in range(12):
        start, end = rng.randint(0, 900), rng.randint(5000, 40_000)
        beats = []
        for name in rng.sample([*H.COMPONENTS, "other"], rng.randint(0, 4)):
            t = start + rng.randint(-2000, 6000)
            while t < end:
                beats.append((name, t))
                t += rng.choice([0, 300, 700, 1400, 1500, 1501, rng.choice([900, 2100])])
        runs.append((run, start, end))
        rows += [(run, name, t, i) for i, (name, t) in enumerate(beats)]
        found = watchdog(beats, start, end)
        wanted += [(run, *found)] if found else []
    got = H.watchdog_trigger(spark.createDataFrame(rows, "run_id long, component string, ts_ms long, event_id long"), spark.createDataFrame(runs, "run_id long, start_ms long, end_ms long"))
    assert sorted(tuple(r) for r in got.collect()) == wanted and wanted


def test_watchdog_of_ten_years(spark):
    end = 10 * 365 * 86_400_000
    runs = spark.createDataFrame([(1, 0, end)], "run_id long, start_ms long, end_ms long")
    beats = spark.createDataFrame([(1, c, t, t) for c in H.COMPONENTS for t in (1000, end - 100_000)], "run_id long, component string, ts_ms long, event_id long")
    assert H.watchdog_trigger(beats, runs).first()[:] == (1, 3000, "capture")
    assert H.watchdog_trigger(beats, runs, threshold=end).count() == 0


def test_gaps_stalls_and_restarts_in_ranges(spark, narrow):
    rng = random.Random(9)
    numbers = sorted(rng.sample(range(1, 400), 200))
    frames = spark.createDataFrame([(1, n, f"x{n}") for n in numbers], "camera_id long, frame_number long, note string").repartition(3)
    got = sorted((r.frame_number, r.missing, r.note) for r in L.gaps(frames).collect())
    assert got == [(a, b - a - 1, f"x{a}") for a, b in zip(numbers, numbers[1:]) if b - a > 1]
    times = sorted(rng.choice(range(0, 90_000, 100)) for _ in range(150))
    events = spark.createDataFrame([("capture", t, i, rng.random() < 0.2) for i, t in enumerate(times)], "component string, ts_ms long, event_id long, is_restart boolean").repartition(3)
    assert sorted((r.ts_ms, r.gap_ms) for r in H.stalls(events).collect()) == [(a, b - a) for a, b in zip(times, times[1:]) if b - a > 1500]
    flags = {r.event_id: r.is_restart for r in events.collect()}
    assert {r.event_id: r.run_id for r in H.restart_runs(events).collect()} == {i: sum(flags[j] for j in range(i + 1)) for i in flags}


def pairs(events):
    open_, out = {}, {}
    for idx, ph, id_ in events:
        if ph == "b":
            out[idx] = None
            if id_ is not None:
                open_.setdefault(id_, []).append(idx)
        elif id_ is None:
            out[idx] = None
        elif open_.get(id_):
            b = open_[id_].pop()
            out[b], out[idx] = idx, b
    return out


@pytest.mark.parametrize(("seed", "begins"), [(1, 0.5), (4, 0.95)])
def test_spans_of_one_busy_id(spark, narrow, seed, begins):
    rng = random.Random(seed)
    share = begins
    events = []
    for i in range(1500):
        if i % 200 == 0:
            share = 1 - share if rng.random() < 0.5 else begins
        events.append((i * rng.choice([1, 1]), "b" if rng.random() < share else "e", rng.choice([7, 7, 7, 7, 8, None])))
    rows = [(i, ph, id_, i % 3 or None, i * 10, ph) for i, ph, id_ in events]
    table = spark.createDataFrame([*rows, (9999, "M", None, 0, 0, "meta")], "idx long, ph string, id long, tid int, ts long, name string").repartition(4)
    got = T._paired(table).collect()
    assert {r.idx: r.pair for r in got} == pairs(events) and len(got) == len(pairs(events))
    for r in got:
        assert r.pair is None or (r.other_ts, r.other_tid) == (r.pair * 10, r.pair % 3 or 0)


@pytest.mark.parametrize("kind", ["ties", "wide", "odd"])
def test_quantiles_by_selection(spark, narrow, kind):
    rng = np.random.default_rng(7)
    values = {
        "plain": rng.normal(0, 10, 700), "ties": rng.integers(0, 3, 700).astype(float), "wide": np.exp(rng.normal(0, 20, 400)) * rng.choice([-1, 1], 400), "few": rng.random(3),
        "odd": np.concatenate([rng.random(60), [np.inf, np.inf, -np.inf, 1e308, -1e308]]),
    }[kind]
    rows = [("a", None, float(v)) for v in values] + [("a", "x", 4.0), ("b", None, None), (None, "y", -1.0), (None, "y", 2.0)]
    table = spark.createDataFrame(rows, "name string, label string, value double").repartition(5)
    q = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    got = {(r.name, r.label): r.quantiles for r in C.exact_quantiles(table, ["name", "label"], "value", q).collect()}
    assert set(got) == {("a", None), ("a", "x"), (None, "y")}
    wanted = {(r[0], r[1]): r[2] for r in table.selectExpr("name", "label", "value").groupBy("name", "label").agg({"value": "count"}).collect()}
    assert wanted["b", None] == 0 and got["a", "x"] == [4.0] * 6 and np.allclose(got[None, "y"], [-1, -0.85, 0.5, 1.85, 1.97, 2.0])
    s, n = sorted(values), len(values)
    for rate, found in zip(q, got["a", None]):
        at = rate * (n - 1)
        lo, hi = math.floor(at), math.ceil(at)
        want = s[lo] if lo == hi else (hi - at) * s[lo] + (at - lo) * s[hi]
        assert found == want or abs(found - want) <= 1e-12 * max(abs(s[lo]), abs(s[hi])), rate


def test_quantiles_with_nan_and_without_rows(spark, narrow):
    rows = spark.createDataFrame([("a", float(v)) for v in range(40)] + [("a", float("nan"))] * 3, "k string, v double")
    got = C.exact_quantiles(rows, ["k"], "v", (0.0, 0.5, 1.0)).first().quantiles
    assert got[:2] == [0.0, 21.0] and math.isnan(got[2])
    assert C.exact_quantiles(rows.limit(0), ["k"], "v", (0.5,)).count() == 0
