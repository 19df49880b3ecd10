"""Zones by adaptive cells, marker clusters and overlapping boxes against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lenswork.operators import detection as D
from lenswork.operators import overlays as O

VERTICES = "zone_id long, ring int, vtx int, lat double, lng double"


def inside(rings, lat, lng):
    def odd(ring):
        out = False
        for (a, b), (c, d) in zip(ring, [ring[-1], *ring[:-1]]):
            if (a > lat) != (c > lat) and lng < (d - b) * (lat - a) / ((c - a) or 1e-12) + b:
                out = not out
        return out

    return odd(rings[0]) and not any(odd(r) for k, r in rings.items() if k > 0)


def star(rng, lat, lng, size, n):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(lat + size * rng.uniform(0.3, 1) * math.sin(t), lng + size * rng.uniform(0.3, 1) * math.cos(t)) for t in turns]


@pytest.mark.parametrize(("most", "deepest"), [(6, 24), (2, 9)])
def test_zones_by_adaptive_cells(spark, monkeypatch, most, deepest):
    monkeypatch.setattr(O, "MOST_EDGES", most)
    monkeypatch.setattr(O, "DEEPEST", deepest)
    rng = random.Random(most)
    zones = {1: {0: star(rng, 10, 10, 30, 70), 1: star(rng, 10, 10, 5, 20), 2: star(rng, 25, 10, 2, 12)}, 2: {0: [(-80, -170), (-80, 170), (80, 170), (80, -170)]}, 3: {0: [(0, 0), (0, 8), (8, 8), (4, 4), (8, 0)], 1: [(1, 1), (1, 2), (2, 2), (2, 1)]}}
    zones[4] = {0: [(5.0, 5.0), (6.0, 6.0)]}
    zones[5] = {0: [(1.0, 1.0)]}
    zones[6] = {0: star(rng, -0.001, 0.001, 0.0005, 30)}
    rows = [(z, r, k, float(a), float(b)) for z, rings in zones.items() for r, ring in rings.items() for k, (a, b) in enumerate(ring)]
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(rng.uniform(-25, 45), rng.uniform(-25, 45)) for _ in range(900)]
    points += [(x / 2, y / 2) for x in range(-2, 20) for y in range(-2, 20)] + [(rng.uniform(-0.002, 0), rng.uniform(0, 0.002)) for _ in range(300)]
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(points)] + [(-1, None, 1.0)], "marker_id long, lat double, lng double")
    got = sorted((r.marker_id, r.zone_id) for r in O.point_in_zone(table, spark.createDataFrame(rows, VERTICES)).collect())
    edge = lambda lat, lng: lat * 2 == int(lat * 2) and lng * 2 == int(lng * 2)  # noqa: E731  on an edge either side will do for rounding's sake
    wanted = sorted((k, z) for k, (a, b) in enumerate(points) for z, rings in zones.items() if inside(rings, a, b))
    assert [x for x in got if not (x[1] == 1 and edge(*points[x[0]]))] == [x for x in wanted if not (x[1] == 1 and edge(*points[x[0]]))]
    assert len(wanted) > 500


def test_no_cell_has_a_whole_zone(spark):
    rng = random.Random(3)
    rows = [(1, 0, k, a, b) for k, (a, b) in enumerate(star(rng, 0, 0, 40, 300))] + [(2, 0, k, float(a), float(b)) for k, (a, b) in enumerate([(-80, -170), (-80, 170), (80, 170), (80, -170)])]
    cells = O.zone_cells(spark.createDataFrame(rows, VERTICES)).collect()
    assert max(len(c.edges) for c in cells if c.edges) <= O.MOST_EDGES and any(c.edges is None for c in cells)
    assert sum(c.zone_id == 2 for c in cells) <= 9 and sum(c.zone_id == 1 for c in cells) < 2000


def pixels(lat, lng, zoom):
    s = math.sin(math.radians(lat))
    return (lng + 180) / 360 * 256 * 2**zoom, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * 256 * 2**zoom


def test_clusters_like_a_plain_loop(spark):
    rng = random.Random(5)
    centres = [(rng.uniform(-60, 60), rng.uniform(-170, 170)) for _ in range(12)]
    places = [(a + rng.gauss(0, 2), b + rng.gauss(0, 3)) for a, b in centres for _ in range(25)] + [(10.0, 10.0)] * 40
    markers = spark.createDataFrame([(k * 3 + 1, a, b) for k, (a, b) in enumerate(places)] + [(9999, None, 1.0)], "marker_id long, lat double, lng double").repartition(4)
    hashes = {r.marker_id: r.h for r in markers.withColumn("h", F.xxhash64("marker_id")).collect()}
    found = {(r.zoom, r.cluster_id): r for r in O.cluster_levels(markers, 2, 4).collect()}
    now = {k * 3 + 1: (1, a, b) for k, (a, b) in enumerate(places)}
    for zoom in range(4, 1, -1):
        here = {c: r for (z, c), r in found.items() if z == zoom}
        assert set(here) == set(now) and sum(r.n for r in here.values()) == len(places)
        for c, (n, a, b) in now.items():
            assert here[c].n == n and abs(here[c].lat - a) < 1e-9 and abs(here[c].lng - b) < 1e-9
        if zoom == 2:
            assert all(r.parent_id is None for r in here.values())
            break
        at = {c: pixels(a, b, zoom - 1) for c, (_, a, b) in now.items()}
        leader = {}
        for c in sorted(now, key=lambda c: (-now[c][0], hashes[c], c)):
            if c not in leader:
                for d in now:
                    if d not in leader and math.dist(at[c], at[d]) <= O.CLUSTER_PIXELS:
                        leader[d] = c
        assert {c: r.parent_id for c, r in here.items()} == leader
        groups = {}
        for c, lead in leader.items():
            groups.setdefault(lead, []).append(now[c])
        now = {lead: (n := sum(x[0] for x in xs), sum(x[0] * x[1] for x in xs) / n, sum(x[0] * x[2] for x in xs) / n) for lead, xs in groups.items()}
    assert len(now) < 60
    assert O.cluster_levels(markers.limit(0), 3, 5).count() == 0


def test_overlaps_of_a_crowded_frame(spark):
    rng = random.Random(6)
    rows = []
    for f in range(4):
        for k in range([0, 1, 30, 250][f]):
            w, h = rng.choice([(4, 4), (8, 5), (300, 200), (0, 3)]) if k % 9 == 0 else (rng.uniform(3, 9), rng.uniform(3, 9))
            x, y = rng.uniform(-20, 400), rng.uniform(0, 300)
            rows.append((f, k, x, y, x + w, y + h))
    table = spark.createDataFrame(rows, "frame_number long, pred_idx long, x1 double, y1 double, x2 double, y2 double")

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        return w * h / (area(a) + area(b) - w * h + 1e-6) if w > 0 and h > 0 else 0

    for least in (0.0, 0.2, 0.45):
        wanted = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a, b) > least)
        assert sorted((r.frame_number, r.pred_a, r.pred_b) for r in D.iou_pairs(table, least).collect()) == wanted and wanted


def test_a_model_is_made_once_for_a_worker(spark, tmp_path):
    frames = spark.createDataFrame([(k, [float(k)] * 3) for k in range(40)], "frame_number long, pixel array<double>").select("frame_number").repartition(1)
    log = str(tmp_path / "made")

    def make():
        with open(log, "a") as f:
            f.write("made\n")
        return lambda part: [{"score": float(x) / 2, "best": int(x) % 3} for x in part.frame_number]

    got = D.detect(frames, make, "score double, best long", ["frame_number"], 7, made=True)
    assert sorted(tuple(r) for r in got.collect()) == [(k, k / 2, k % 3) for k in range(40)]
    with open(log) as f:
        assert len(f.readlines()) == 1
    with pytest.raises(Exception, match="results for"):
        D.detect(frames, lambda part: [{"score": 1.0}] * (len(part) - 1), "score double", ["frame_number"], 7).collect()
