"""Literal fixtures, semantic traps and properties of single operators."""

import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swathframe.functions import columns as C
from swathframe.operators import aggregates, filters, joins, ranges, raster, scoring, splits, windows
from swathframe.operators.components import connected_components
from swathframe.sources import files
from swathframe.streaming import jobs

NAN = float("nan")


def ships(spark, extra=()):
    rows = [(True, 5.0, 10.0), (False, 15.0, 20.0), (True, 25.0, 30.0), (False, 35.0, 40.0), *extra]
    return spark.createDataFrame(rows, "is_vessel boolean, xview_km double, global_km double")


@pytest.mark.parametrize("args,n", [((None, "xview", True), 2), ((20, "xview", None), 2), ((25, "global", None), 2), ((30, "both", None), 1), ((30, "both", False), 1)])
def test_filter_ships(spark, args, n):
    assert filters.filter_ships(ships(spark), *args).count() == n


def test_nan_and_null_distances_go(spark):
    held = ships(spark, [(True, NAN, 50.0), (True, 60.0, NAN), (True, None, 70.0)])
    assert filters.filter_ships(held, 10, "both").count() == 3
    with pytest.raises(ValueError):
        filters.filter_ships(held, 10, "other")


def test_selection_spec():
    assert filters.parse_selection("3, 7-5,3,,5-8") == [3, 7, 6, 5, 8]


def test_pose_line_and_inflation(spark):
    one = spark.range(1)
    d = F.lit
    line = one.select(C.pose_line(d(10.0), d(20.0), d(50.0), d(60.0), d(100.0), d(100.0)).alias("v")).first().v
    assert line == "0 0.300000 0.400000 0.400000 0.400000 0.300000 0.400000 2"
    box = one.select(C.inflated(d(0.5), d(0.5), d(0.2), d(0.2), d(0.1), d(0.1)).alias("b")).first().b
    assert box.w == pytest.approx(0.4) and box.h == pytest.approx(0.4)
    edge = one.select(C.inflated(d(0.05), d(0.05), d(0.1), d(0.1), d(0.1), d(0.1)).alias("b")).first().b
    assert edge.xc - edge.w / 2 >= 0 and edge.yc - edge.h / 2 >= 0
    lines = spark.createDataFrame([("0 0.5 0.5 0.2 0.2",), ("0 0.5",), ("1 0.5 0.5 0.2 0.2 9 x",)], "l string").select(C.inflated_line(F.col("l"), d(100), d(100), 10).alias("l")).collect()
    assert [r.l for r in lines] == ["0 0.500000 0.500000 0.400000 0.400000", "0 0.5", "1 0.500000 0.500000 0.400000 0.400000 9 x"]


def test_rounding_is_half_even(spark):
    row = spark.range(1).select(C.centred_box(F.lit(10), F.lit(20), F.lit(2.5), F.lit(600.0)).alias("b")).first().b
    assert (row.left, row.right, row.top, row.bottom) == (8, 12, 1, 512)


def test_names(spark):
    df = spark.createDataFrame([("a_12_b_7.xml",), ("nope.xml",), ("x_9_",)], "n string")
    assert [r.v for r in df.select(C.last_digits(F.col("n")).alias("v")).collect()] == ["7", None, "9"]
    names = spark.createDataFrame([("f10",), ("f9",), ("f1a",)], "n string")
    assert [r.n for r in names.orderBy(C.natural_key(F.col("n"))).collect()] == ["f1a", "f9", "f10"]


def test_empty_denominators(spark):
    pred = spark.createDataFrame([(1, 0.9, False, True), (1, 0.4, False, True)], "k int, prob double, gt boolean, valid boolean")
    row = scoring.pooled_scores(pred, ["k"], 0.5).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.recall, row.precision) == (0, 1, 0, 1, 0.0, 0.0)
    assert scoring.derived(pred.groupBy("k").agg(*scoring.confusion(0.5)), None).first().recall is None
    edge = spark.createDataFrame([(1, 0.5, True, True)], "k int, prob double, gt boolean, valid boolean")
    assert scoring.pooled_scores(edge, ["k"], 0.5).first().tp == 0 and scoring.smooth_scores(edge, ["k"], 0.5).first().tp == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 60), seed=st.integers(0, 99))
def test_split_properties(spark, n, seed):
    scenes = spark.range(n).select(F.concat(F.lit("s"), "id").alias("scene"), "id")
    twice = scenes.union(scenes)
    out = {r.scene: r.split for r in splits.split_keys(twice, "scene", seed=seed).collect()}
    assert len(out) == n
    kinds = list(out.values())
    assert kinds.count("train") == int(np.floor(n * 0.7)) and kinds.count("val") == int(np.floor(n * 0.15))
    assert out == {r.scene: r.split for r in splits.split_keys(twice.repartition(3), "scene", seed=seed).collect()}
    assert splits.leakage(twice.join(splits.split_keys(twice, "scene", seed=seed), "scene")).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    comp = list(range(26))
    for a, b in edges:
        x, y = comp[a], comp[b]
        comp = [min(x, y) if c in (x, y) else c for c in comp]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {v: comp[v] for e in edges for v in e}


def test_components_of_a_long_path_and_a_star(spark):
    path = spark.range(300).select("id", (F.col("id") + 1).alias("to"))
    star = spark.range(1, 400).select((F.col("id") + 1000).alias("id"), F.lit(1000).cast("bigint").alias("to"))
    got = connected_components(path.union(star), "id", "to")
    assert sorted(r.component for r in got.select("component").distinct().collect()) == [0, 1000] and got.count() == 701


def test_regions_count(spark):
    rng = np.random.default_rng(0)
    mask = rng.random((12, 12)) < 0.5
    label = np.where(mask, np.arange(144).reshape(12, 12), -1)
    for _ in range(144):
        for a, b in ((label[1:], label[:-1]), (label[:, 1:], label[:, :-1])):
            both = (a >= 0) & (b >= 0)
            low = np.minimum(a, b)
            for side in (a, b):
                np.minimum(side, low, out=side, where=both)
    df = spark.createDataFrame([(7, int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "tile_id bigint, r int, c int")
    assert raster.regions(df).select("region").distinct().count() == len(set(label[mask].tolist()))


def test_forward_fill_over_files(spark):
    df = spark.createDataFrame([(i, "a" if i == 0 else "b" if i == 70 else " ", i) for i in range(200)], "ord int, id string, x int")
    out = windows.forward_fill(df.repartition(5), ["id"], ["ord"]).orderBy("ord").collect()
    assert [r.id for r in out] == ["a"] * 70 + ["b"] * 130


def test_nearest_in_time_prefers_the_earlier(spark):
    stamp = lambda s: f"2024-01-01 00:00:{s:02d}"
    left = spark.createDataFrame([("k", 1, stamp(10)), ("k", 2, stamp(50)), ("z", 3, stamp(1))], "g string, l int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    right = spark.createDataFrame([("k", 5, stamp(8)), ("k", 6, stamp(12)), ("k", 7, stamp(40))], "g string, r int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.l: r.r for r in joins.nearest_in_time(left, right, ["g"], "l", "r").collect()} == {1: 5, 2: 7, 3: None}


def test_short_l0_files(spark):
    import struct

    good = struct.pack("<II", 2, 3) + np.arange(12, dtype="<f4").tobytes()
    rows = [("a", bytearray(good)), ("b", bytearray(good[:20])), ("c", bytearray(b"xx")), ("d", None)]
    out = {r.key: r for r in files.read_l0(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (out["a"].h, out["a"].w, out["a"].q) == (2, 3, [1.0, 3.0, 5.0, 7.0, 9.0, 11.0])
    assert out["b"].h is None and out["c"].i is None and out["d"].w is None


def test_labels_with_one_ship_and_none(spark):
    xml = "<label><Number_of_ships>1</Number_of_ships><List_of_ships><Ship><Name>Ship_1</Name></Ship></List_of_ships></label>"
    df = spark.createDataFrame([(1, xml), (2, "<label><Number_of_ships>0</Number_of_ships></label>")], "id int, text string")
    out = {r.id: r["ship"] for r in files.ships_of(files.parse_labels(df)).collect()}
    assert out[1].Name == "Ship_1" and out[2] is None


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="swath"):
        files.require_columns(spark.range(1), ["id", "swath"])


def test_natural_order_without_case_and_with_long_numbers(spark):
    names = ["b2", "B10", "a" + "9" * 21, "a1" + "0" * 22, "A007", "a7", "10x", "9x", "x", "a07b", "a7B"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("key", C.natural_key(F.col("name"))).withColumn("all", F.lit(1))
    out = [r.name for r in ranges.range_ranked(df, "all", "key", "name").orderBy("rn").collect()]
    assert out == sorted(names, key=lambda n: (re_key(n), n))


def re_key(name):
    """Texts and numbers in turn, a text first."""
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", name)]


def test_deviation_of_large_values(spark):
    df = spark.createDataFrame([("i", 1e9), ("i", 1e9 + 1)], "channel string, value double")
    assert aggregates.channel_stats(df).first().std == pytest.approx(0.5)


@pytest.fixture(scope="module")
def pulses(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), i, "IW1" if rng.random() < 0.7 else "IW2", int(t)) for i, (s, t) in enumerate(zip(rng.choice([0, 0, 0, 1], 600), rng.integers(0, 150, 600)))]
    return rows


def brute_runs(rows):
    out, counts = [], {}
    for s in sorted({r[0] for r in rows}):
        last = None
        for _, _, swath, ts in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1])):
            if swath != last:
                counts[s, swath] = counts.get((s, swath), 0) + 1
                out.append([s, swath, counts[s, swath], ts, ts, 0])
                last = swath
            out[-1][4], out[-1][5] = ts, out[-1][5] + 1
    return sorted(map(tuple, out))


def test_bursts_over_ranges(spark, pulses):
    df = spark.createDataFrame(pulses, "stream bigint, seq bigint, swath string, ts bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all ranges apart
    try:
        out = windows.bursts(df, ["stream"], ["ts", "seq"]).select("stream", "swath", "burst", "start_ts", "stop_ts", "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, out)) == brute_runs(pulses)


def test_burst_stream_in_batches_with_late_pulses(spark, pulses):
    schema, held = "stream bigint, seq bigint, swath string, ts_us bigint", {}
    state = spark.createDataFrame([], jobs.STATE)
    cut = [[r for r in pulses if lo <= r[3] < hi] for lo, hi in ((0, 40), (40, 41), (41, 110), (110, 150))]
    for part in cut:
        updates, state, late = jobs.segment(spark.createDataFrame(part, schema), state)
        held.update({(r.stream, r.swath, r.burst): (r.start_us, r.stop_us, r.n) for r in updates.collect()})
        assert late.count() == 0
    assert sorted((*k, *v) for k, v in held.items()) == brute_runs(pulses)
    updates, _, late = jobs.segment(spark.createDataFrame([(0, 9999, "IW1", 3), (5, 1, "IW2", 3)], schema), state)
    assert [r.seq for r in late.collect()] == [9999] and [tuple(r) for r in updates.collect()] == [(5, "IW2", 1, 3, 3, 1)]


def test_nearest_in_time_over_ranges(spark):
    rng = np.random.default_rng(6)
    left = [(int(rng.integers(0, 2)), i, int(t)) for i, t in enumerate(rng.integers(0, 5000, 200))]
    right = [(int(rng.integers(0, 2)), i, int(t)) for i, t in enumerate(rng.integers(0, 5000, 12))]
    frame = lambda rows, n: spark.createDataFrame(rows, f"k int, {n} int, s int").select("k", n, F.timestamp_seconds("s").alias("ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = {r.l: r.r for r in joins.nearest_in_time(frame(left, "l"), frame(right, "r"), ["k"], "l", "r").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for k, i, t in left:
        best = min(((abs(t - u), u, j) for q, j, u in right if q == k), default=(0, 0, None))
        assert out[i] == best[2]


def test_average_precision_of_fine_confidences(spark):
    rng = np.random.default_rng(7)
    rows = [(0.5, float(c), bool(h)) for c, h in zip(0.5 + rng.random(300) / 1e4, rng.random(300) < 0.6)]
    out = scoring.average_precision(spark.createDataFrame(rows, "threshold double, conf double, hit boolean"), F.lit(400)).first()
    hits = [h for _, _, h in sorted(rows, key=lambda r: -r[1])]
    assert out.ap == pytest.approx(sum(h / 400 * (sum(hits[: i + 1]) / (i + 1)) for i, h in enumerate(hits)))


def test_ring_against_distances(spark):
    rng = np.random.default_rng(8)
    mask = rng.random((24, 30)) < 0.03
    px = spark.createDataFrame([(1, r, c, bool(mask[r, c])) for r in range(24) for c in range(30)], "tile_id bigint, r int, c int, m boolean")
    labelled = raster.regions(px.where("m")).persist()
    regions = {}
    for r in labelled.collect():
        regions.setdefault(r.region, []).append((r.r, r.c))
    out = {(x.region, x.r, x.c) for x in raster.background_ring(labelled, px, 2, 5).collect()}
    near = lambda own, r, c: min(abs(r - a) + abs(c - b) for a, b in own)
    assert out == {(k, r, c) for k, own in regions.items() for r in range(24) for c in range(30) if not mask[r, c] and 2 < near(own, r, c) <= 5}


def test_null_keys_are_a_key(spark):
    rows = [(None, i, "IW1" if i % 3 else "IW2", i) for i in range(40)] + [(1, i, "IW1", i) for i in range(5)]
    df = spark.createDataFrame(rows, "stream bigint, seq bigint, swath string, ts bigint")
    out = windows.bursts(df, ["stream"], ["ts", "seq"]).collect()
    assert sum(r.n for r in out) == 45 and max(r.burst for r in out if r.stream is None) == 14
    assert sorted(r.rn for r in ranges.range_ranked(df, "stream", "seq").where("stream IS NULL").collect()) == list(range(1, 41))
