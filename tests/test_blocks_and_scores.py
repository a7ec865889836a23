"""Blocks of rasters, lines and boxes against brute force, with counts of what they touch; scores and gates with NaN and zero."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathframe.operators import aggregates as A
from swathframe.operators import blocks, lines, raster, scoring, windows

NAN = float("nan")


# ------------------------------------------------------------------ regions
def pixels(spark, masks):
    rows = [(t, int(r), int(c)) for t, m in masks.items() for r, c in zip(*np.nonzero(m))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + rows[:3], "tile_id bigint, r int, c int").repartition(3)


def brute_regions(mask, width):
    label = {(int(r), int(c)): int(r) * width + int(c) for r, c in zip(*np.nonzero(mask))}
    moved = True
    while moved:
        moved = False
        for r, c in label:
            least = min(label.get(p, 1 << 62) for p in ((r, c), (r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)))
            moved, label[r, c] = moved or least < label[r, c], least
    return label


@pytest.mark.parametrize("rows", [2, 3, 256])
def test_regions_by_blocks(spark, rows):
    rng = np.random.default_rng(3)
    spiral = np.zeros((11, 11), int)
    for k in range(0, 6, 2):
        spiral[k, k : 11 - k] = spiral[k : 11 - k, 10 - k] = spiral[10 - k, k : 11 - k] = spiral[k + 2 : 11 - k, k] = 1
        spiral[k + 2, k : k + 2] = 1
    masks = {1: rng.random((13, 17)) < 0.6, -5: rng.random((9, 30)) < 0.4, 7: spiral, 8: np.ones((8, 8))}
    got = blocks.regions(pixels(spark, masks), rows=rows)
    assert got.columns == ["tile_id", "r", "c", "region"] and got.schema["r"].dataType.simpleString() == "int"
    found = {(x.tile_id, x.r, x.c): x.region for x in got.collect()}
    want = {(t, r, c): v for t, m in masks.items() for (r, c), v in brute_regions(m, 1 << 14).items()}
    assert found == want
    assert blocks.regions(spark.createDataFrame([], "tile_id bigint, r int, c int")).count() == 0


def test_regions_of_wide_rasters(spark):
    rows = [(1, 0, 16384), (1, 1, 0), (1, 0, 16385), (2**40, 5, 3), (2**40, 6, 3)]
    found = {(x.tile_id, x.r, x.c): x.region for x in blocks.regions(spark.createDataFrame(rows, "tile_id bigint, r int, c int"), rows=2).collect()}
    assert found[1, 0, 16384] == found[1, 0, 16385] != found[1, 1, 0] and found[2**40, 5, 3] == found[2**40, 6, 3]


def test_only_seams_are_linked(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(blocks, "connected_components", lambda edges: seen.append(edges.count()) or real(edges))
    from swathframe.operators.components import connected_components as real

    blocks.regions(pixels(spark, {1: np.ones((64, 300))}), rows=16).count()
    assert seen == [3]  # 19,200 pixels, four blocks, a link for each of three seams


def test_rings_of_large_regions(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(20):
        r, c = np.nonzero((rng.random((9, 12)) < 0.1) | (np.add.outer(np.arange(9), np.arange(12)) == 7))
        near = [blocks.distance_rings(r + 3, c + 3, (15, 18), inner, 5) for inner in (1, 3)]
        monkeypatch.setattr(blocks, "NEAR_CELLS", 0)
        assert all((a == b).all() for a, b in zip(near, [blocks.distance_rings(r + 3, c + 3, (15, 18), inner, 5) for inner in (1, 3)]))
        monkeypatch.undo()


@pytest.mark.parametrize("rows", [3, 5, 256])
def test_rings_by_blocks(spark, rows):
    rng = np.random.default_rng(12)
    mask = rng.random((14, 18)) < 0.12
    values = [(1, r, c, None if (r, c) == (2, 2) else float(100 * r + c)) for r in range(14) for c in range(18) if (r + c) % 13]
    px = spark.createDataFrame(values, "tile_id bigint, r int, c int, power double")
    marked = raster.regions(pixels(spark, {1: mask}))
    found: dict = {}
    for x in blocks.ring_values(marked, px, "power", 1, 4, rows=rows).collect():
        found.setdefault(x.region, []).extend(x["values"])
    whole: dict = {}
    for x in raster.background_ring(marked, px, 1, 4).where("power IS NOT NULL").collect():
        whole.setdefault(x.region, []).append(x.power)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in whole.items()} and found
    for method in ("mean", "median", "p90", "trimmed_mean"):
        stats = [{r.region: round(r.background, 9) for r in df.collect()} for df in (blocks.ring_stats(marked, px, "power", method, 1, 4, rows=rows), A.parts_stat(blocks.ring_values(marked, px, "power", 1, 4, rows=rows), ["region"], "values", method), A.background_stat(raster.background_ring(marked, px, 1, 4), ["region"], "power", method))]
        assert stats[0] == stats[1] == stats[2]


# ------------------------------------------------------------ local filter
def brute_filter(v):
    h, w = v.shape
    at = lambda r, c: [v[min(max(r + a, 0), h - 1), min(max(c + b, 0), w - 1)] for a in (-1, 0, 1) for b in (-1, 0, 1)]
    held = {(r, c): [x for x in at(r, c) if not math.isnan(x)] for r in range(h) for c in range(w)}
    m, s = {k: np.mean(x) if x else 0 for k, x in held.items()}, {k: np.var(x) if x else 0 for k, x in held.items()}
    noise = np.mean(list(s.values()))
    return {k: m[k] + (max(s[k] - noise, 0) / max(s[k], noise) if s[k] > 0 else 0) * (v[k] - m[k]) for k in m}


@pytest.mark.parametrize("rows", [2, 3, 100])
def test_filter_by_blocks_with_halos(spark, rows):
    rng = np.random.default_rng(5)
    tiles = {t: rng.normal(1000, 3, (8, 6)) for t in (1, 2)} | {3: np.full((8, 6), 4.0)}
    tiles[2][3, 2] = NAN
    data = [(t, r, c, None if math.isnan(v[r, c]) else float(v[r, c])) for t, v in tiles.items() for r in range(8) for c in range(6)]
    random.Random(2).shuffle(data)
    got = blocks.adaptive_filter(spark.createDataFrame(data, "tile_id bigint, r int, c int, x double"), "x", 8, 6, rows=rows)
    found = {(x.tile_id, x.r, x.c): x.filtered for x in got.collect()}
    assert len(found) == len(data)
    for t, v in tiles.items():
        for (r, c), x in brute_filter(v).items():
            assert found[t, r, c] is None if math.isnan(x) else abs(found[t, r, c] - x) < 1e-9


# ------------------------------------------------------------------- lines
@pytest.mark.parametrize("block", [4, 16, lines.BLOCK])
def test_best_lag(spark, block):
    rng = np.random.default_rng(6)
    sides = {1: (rng.normal(size=40), rng.normal(size=25)), 2: (np.sin(np.arange(30)), np.roll(np.sin(np.arange(30)), 5)), 3: (np.array([1.0, 0, 1.0]), np.array([2.0])), 4: (np.zeros(5), np.ones(3)), 5: (np.array([3.0]), np.array([-2.0]))}
    line = lambda k: spark.createDataFrame([(t, 7 + s, float(x)) for t, pair in sides.items() for s, x in enumerate(pair[k])], "tile_id bigint, s int, value double")
    found = {r.tile_id: (r.lag, r.score) for r in lines.best_lag(line(0), line(1), ["tile_id"], block=block).collect()}
    for t, (x, y) in sides.items():
        scores = {d: sum(x[s] * y[s - d] for s in range(len(x)) if 0 <= s - d < len(y)) for d in range(1 - len(y), len(x))}
        best = min(scores, key=lambda d: (-round(abs(scores[d]), 9), d))
        assert found[t][0] == best and abs(found[t][1] - scores[best]) < 1e-9, t


def test_a_long_line_is_no_square(spark):
    n = 20_000
    own = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("s"), F.sin(F.col("id") * F.col("id") * 0.001).alias("value"))
    moved = own.where("s >= 300").select("k", (F.col("s") - 300).alias("s"), "value")
    assert lines.best_lag(own, moved, ["k"]).first().lag == 300


# --------------------------------------------------------------- quantiles
def test_quantiles_of_large_groups(spark):
    rng = random.Random(8)
    rows = [(k, None if rng.random() < 0.05 else round(rng.gauss(0, 1), 1)) for k in ("a", "b", None) for _ in range(rng.randint(5, 300))] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    want = {r.k: (r.m, r.p) for r in df.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("m"), F.percentile("x", F.lit(0.9)).alias("p")).collect()}
    for most in (0, None):
        got = {r.k: (r.m, r.p) for r in A.group_quantiles(df, ["k"], "x", most, m=0.5, p=0.9).collect()}
        assert got.keys() == want.keys()
        assert all((got[k][i] is None) == (want[k][i] is None) and (want[k][i] is None or abs(got[k][i] - want[k][i]) < 1e-12) for k in want for i in (0, 1))
    trims = [{r.k: r.background for r in A.background_stat(df, ["k"], "x", "trimmed_mean", most=most).collect()} for most in (0, None)]
    assert trims[0].keys() == trims[1].keys() and all(abs(trims[0][k] - trims[1][k]) < 1e-12 for k in trims[0])
    for k in ("a", "b"):
        own = sorted(x for key, x in rows if key == k and x is not None)
        cut = int(len(own) * 0.1)
        assert abs(trims[0][k] - np.mean(own[cut : len(own) - cut])) < 1e-12
    scaled = [sorted((r.k or "", r.x, r.scaled) for r in windows.percentile_scaled(df.where("x > 0 AND k IS NOT NULL"), ["k"], "x", most=most).collect()) for most in (0, None)]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(*scaled)) and len(scaled[0]) == len(scaled[1]) > 50


# --------------------------------------------------------------------- runs
def test_bursts_across_ranges(spark):
    rng = random.Random(4)
    rows = [(k, s, rng.choice(["IW1", "IW2", None]) if s > 100 else "IW1", s // 2) for k in (1, None) for s in range(300)]
    df = spark.createDataFrame(rows, "stream int, seq int, swath string, ts int")
    want, count = [], {}
    for k in (1, None):
        for swath, run in itertools.groupby((r for r in rows if r[0] == k), key=lambda r: r[2]):
            run = list(run)
            count[k, swath] = count.get((k, swath), 0) + 1
            want.append((str(k), str(swath), count[k, swath], run[0][3], run[-1][3], len(run)))
    got = windows.bursts(df, ["stream"], ["ts", "seq"])
    assert sorted((str(r.stream), str(r.swath), r.burst, r.start_ts, r.stop_ts, r.n) for r in got.collect()) == sorted(want)
    runs = windows.runs_of(df, ["stream"], ["ts", "seq"]).collect()
    assert len(runs) == len(want) and len({(r.stream, r.run) for r in runs}) == len(want)


# -------------------------------------------------------------------- boxes
def brute_hits(dets, truth, thresholds):
    def iou(d, g):
        side = lambda i, j: max(0, min(d[i] + d[j] / 2, g[i] + g[j] / 2) - max(d[i] - d[j] / 2, g[i] - g[j] / 2))
        inter = side(2, 4) * side(3, 5)
        union = d[4] * d[5] + g[4] * g[5] - inter
        return inter / union if union else 0.0

    hits = set()
    for t in thresholds:
        best: dict = {}
        for d in dets:
            own = [(-iou(d, g), g[1]) for g in truth if g[0] == d[0]]
            if own and -min(own)[0] >= t:
                best.setdefault((d[0], min(own)[1]), []).append((-(d[6] if not math.isnan(d[6]) else -math.inf), d[1]))
        hits |= {(t, image, min(v)[1]) for (image, _), v in best.items()}
    return hits


def test_boxes_meet_in_cells(spark):
    rng = random.Random(11)
    box = lambda: (rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([0.0, 0.4, 3.0, 8.0, 20.0, 64.0]) * rng.uniform(0.8, 1.2), rng.choice([0.4, 3.0, 8.0, 20.0]) * rng.uniform(0.8, 1.2))
    truth = [(i, k, *box()) for i in (1, 2) for k in range(60)] + [(3, 0, 5.0, 5.0, 0.0, 0.0), (3, 1, -8.0, -8.0, 4.0, 4.0)]
    dets = [(g[0], g[1], g[2] + rng.uniform(-1, 1), g[3] + rng.uniform(-1, 1), g[4] * rng.uniform(0.7, 1.4), g[5] * rng.uniform(0.7, 1.4), rng.choice([0.1, 0.5, 0.9, NAN])) for g in truth for _ in range(2)]
    dets = [(d[0], n, *d[2:]) for n, d in enumerate(dets)] + [(9, 0, 1.0, 1.0, 1.0, 1.0, 0.5), (3, 900, 5.0, 5.0, 0.0, 0.0, 0.5)]
    d = spark.createDataFrame(dets, "image_id int, det_no int, x double, y double, w double, h double, conf double")
    g = spark.createDataFrame(truth, "image_id int, gt_no int, x double, y double, w double, h double")
    for thresholds in ([0.5, 0.75], [0.2], [0.95]):
        out = scoring.match_boxes(d, g, thresholds).collect()
        assert len(out) == len(dets) * len(thresholds)
        assert {(r.threshold, r.image_id, r.det_no) for r in out if r.hit} == brute_hits(dets, truth, thresholds)


def test_a_full_image_compares_neighbours(spark):
    grid = spark.range(10_000).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("gt_no"), (F.col("id") % 100 * 10).cast("double").alias("x"), (F.floor(F.col("id") / 100) * 10).cast("double").alias("y"), F.lit(8.0).alias("w"), F.lit(8.0).alias("h"))
    dets = grid.withColumnRenamed("gt_no", "det_no").withColumn("conf", F.lit(0.5))
    met = scoring.in_cells(dets, 1).join(scoring.in_cells(grid, 0), ["image_id", "lw", "lh", "cx", "cy"])
    assert met.count() < 20 * 10_000
    assert scoring.match_boxes(dets, grid, [0.5]).where("hit").count() == 10_000


# ------------------------------------------------------------- NaN and zero
def test_nan_reaches_no_threshold(spark):
    rows = [(1, NAN, True, True), (1, NAN, False, True), (1, 0.9, True, True), (1, 0.2, False, True), (1, NAN, True, False), (2, NAN, False, True)]
    pred = spark.createDataFrame([(k, k, *r) for k, *r in rows], "model int, image_id int, prob double, gt boolean, valid boolean")
    counts = {r.model: (r.tp, r.fp, r.fn, r.tn) for r in scoring.pooled_scores(pred, ["model"], 0.5).collect()}
    assert counts == {1: (1, 0, 1, 2), 2: (0, 0, 0, 1)}
    assert {r.model: r.tp for r in scoring.smooth_scores(pred, ["model"], 0.5).collect()} == {1: 1, 2: 0}
    sweep = scoring.threshold_sweep(pred, ["model"], [0.1, 0.5, 0.95]).where("model = 1").orderBy("threshold").collect()
    assert [(r.tp, r.fp, r.fn, r.tn) for r in sweep] == [(1, 1, 1, 1), (1, 0, 1, 2), (0, 0, 2, 2)]
    assert {(r.bucket, r.fp) for r in scoring.bucketed_scores(pred, spark.createDataFrame([(1, "x"), (2, "y")], "image_id int, bucket string"), 0.5).collect()} == {("x", 0), ("y", 0), ("all", 0)}
    found = A.per_threshold(spark.createDataFrame([(NAN,), (0.6,), (None,)], "conf double"), [0.5, 0.9]).collect()
    assert {r.threshold: r.n for r in found} == {0.5: 1, 0.9: 0}


def test_gates_refuse_nan(spark):
    metrics = spark.createDataFrame([("a", NAN), ("b", 0.9), ("c", 0.82), ("d", 0.5), ("e", None)], "metric string, value double")
    gates = spark.createDataFrame([(m, 0.85) for m in "abcdef"], "metric string, expected double")
    assert {r.metric: r.verdict for r in scoring.tolerance_gate(metrics, gates).collect()} == {"a": "FAIL", "b": "PASS", "c": "ALMOST_PASS", "d": "FAIL", "e": "FAIL", "f": "FAIL"}
    own = spark.createDataFrame([("all", 0.8), ("x", NAN), ("y", 0.75), ("z", None)], "bucket string, precision double")
    assert {r.bucket: r.verdict for r in scoring.degradation_gate(own).collect()} == {"x": "FAIL", "y": "PASS", "z": "FAIL"}
    assert spark.createDataFrame([(NAN,)], "v double").select(scoring.limit_gate(F.col("v"), 5).alias("g")).first().g == "FAIL"


def test_nothing_is_divided_by_zero(spark):
    pulse = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 3.0), (2, 1, 4.0)], "stream int, sample int, value double")
    assert sorted((r.stream, r.sample, r.value) for r in A.mean_pulse(pulse).collect()) == [(1, 0, None), (1, 1, None), (2, 0, 0.6), (2, 1, 0.8)]
    tiles = spark.createDataFrame([([3.0, 100.0], [4.0, 100.0], [True, False]), ([], [], []), (None, None, None), ([0.0], [5.0], None)], "i array<float>, q array<float>, valid array<boolean>")
    assert tuple(A.dataset_rms(tiles, "valid").first()) == (5.0, 2)
    assert A.dataset_rms(tiles).first().samples == 3 and tuple(A.dataset_rms(tiles.limit(0)).first()) == (None, 0)
    matched = spark.createDataFrame([(0.5, 0.9, True)], "threshold double, conf double, hit boolean")
    assert scoring.average_precision(matched, F.lit(0)).first().recall is None


# ---------------------------------------------------------------- contrasts
def test_regions_without_a_ring_are_not_kept(spark):
    power = [(1, r, c, 100.0 if c < 2 else 1.0) for r in range(6) for c in range(20)] + [(2, r, c, 5.0) for r in range(3) for c in range(3)]
    values = spark.createDataFrame(power, "tile_id bigint, r int, c int, power double")
    marked = blocks.regions(values.where("tile_id = 2 OR c < 2"))
    high = {r.tile_id: (r.db, r.keep) for r in raster.region_contrast(marked, values, 5.0).collect()}
    low = {r.tile_id: (r.db, r.keep) for r in raster.region_contrast(marked, values, 5.0, mode="remove_high_rfi").collect()}
    assert abs(high[1][0] - 20) < 1e-9 and high[1][1] and not low[1][1]
    assert high[2] == low[2] == (None, False)
    with pytest.raises(ValueError, match="mode"):
        raster.region_contrast(marked, values, 5.0, mode="other")


def test_patches_that_are_all_mask_are_kept(spark):
    rows = [(1, r, 0, r < 2, 100.0 if r < 2 else 1.0) for r in range(6)] + [(2, r, 0, True, 5.0) for r in range(3)] + [(3, r, 0, False, 5.0) for r in range(3)]
    values = spark.createDataFrame(rows, "tile_id bigint, r int, c int, is_mask boolean, power double")
    high = {r.tile_id: (r.db, r.kept) for r in raster.patch_contrast(values, 5.0).collect()}
    low = {r.tile_id: (r.db, r.kept) for r in raster.patch_contrast(values, 5.0, "remove_high_rfi").collect()}
    assert high[1][1] and not low[1][1] and high[2] == low[2] == (None, True) and high[3] == low[3] == (None, False)
