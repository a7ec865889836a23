"""What came out only on larger tables: sizes at which steps gave other rows, or moved more than their input."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from swathframe.operators import blocks, joins, raster, scoring, splits
from swathframe.plans.bound import ORACLE, QUERIES
from swathframe.plans.storage import saved
from swathframe.sources import files
from swathframe.streaming import keyed


def test_split_shares_are_those_of_the_sql(spark, tmp_path):
    """floor(90 * 0.7) is 63, and 62 in floating point."""
    spark.range(90).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(1).alias("toxic")).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    own = {tuple(r) for r in QUERIES["t04_stratified_split"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/labels.parquet/*.parquet'")
        wanted = set(db.execute(ORACLE["t04_stratified_split"]).fetchall())
    assert own == wanted
    assert sum(r[2] == "train" for r in own) == 63
    held = splits.hold_out(spark.range(1000).select("id"), "id", 0.29, 1)  # 290 in whole numbers, 289.99... in floating point
    assert held.where("split = 'val'").count() == 290


def plan(df):
    return df._jdf.queryExecution().toString()


def test_boxes_of_images_with_few_meet_by_image(spark):
    """No box is spread over cells where images have few; images over the bounds give the same rows in cells."""
    box = lambda n, shift: spark.range(n).selectExpr("id % 40 AS image_id", "int(id div 40) AS no", f"double(id * 7 % 50) + {shift} AS x", f"double(id * 5 % 40) + {shift} AS y", "double(10 + id % 3) AS w", "double(8 + id % 2) AS h")
    found = box(600, 0.5).withColumnRenamed("no", "det_no").withColumn("conf", F.expr("double(x * 13 % 7) / 7"))
    truth = box(400, 0).withColumnRenamed("no", "gt_no").where("image_id <> 3")
    few = scoring.match_boxes(found, truth, [0.25, 0.5])
    assert "sequence(" not in plan(few)
    rows = lambda df: sorted(map(tuple, df.collect()))
    mixed = scoring.match_boxes(found.where("image_id % 2 = 0 OR det_no < 5"), truth, [0.25, 0.5], few=(64, 5))
    wanted = rows(scoring.match_crowded(found, truth, [0.25, 0.5]))
    assert rows(few) == wanted and len(wanted) == 1200 and any(r[4] for r in wanted)
    assert rows(mixed) == rows(scoring.match_crowded(found.where("image_id % 2 = 0 OR det_no < 5"), truth, [0.25, 0.5]))


def test_resampling_joins_nothing(spark):
    """Lines of samples were joined with their positions, by a broadcast of all samples."""
    own = spark.range(64 * 5).selectExpr("id div 64 AS tile_id", "int(id % 64) AS s", "double(id * 37 % 101) AS value").where("s <> 9")
    out = raster.sinc_resample(own, ["tile_id"], 64, 80)
    assert "Join" not in plan(out)
    held = {(r.tile_id, r.s): r.value for r in own.collect()}
    got = {(r.tile_id, r.o): r.value for r in out.collect()}
    assert len(got) == 400
    for (tile, o), value in got.items():
        x = o * 64 / 80
        near = [(np.sinc(x - s) * (0.5 + 0.5 * np.cos((x - s) * np.pi / 8)), held[tile, s]) for s in range(max(0, int(x) - 7), min(63, int(x) + 8) + 1) if (tile, s) in held]
        assert abs(value - sum(a * b for a, b in near) / sum(a for a, _ in near)) < 1e-9


def test_nearest_cells_of_crowded_places(spark, monkeypatch):
    """As brute force, where many points share places and squares of the first step hold all cells; a key of two places has one row."""
    points = spark.range(3000).selectExpr("id % 2990 AS patch_id", "double(id * 7 % 31) / 9 AS lat", "IF(id >= 2990, 150.0, double(id * 11 % 23) / 7) AS lon")
    cells = spark.range(400).selectExpr("id AS cell", "double(id * 13 % 200) / 50 AS lat", "double(id * 29 % 190) / 50 AS lon")
    kept = []

    def spied(df, tag):
        out = saved(df, tag)
        kept.extend([out] if tag == "nearest" else [])
        return out

    monkeypatch.setattr(joins, "saved", spied)
    found = joins.nearest_cell(points, cells, "patch_id").collect()
    assert sum(df.count() for df in kept) == points.select("lat", "lon").distinct().count() < 1000  # places look, not points
    got = {r.patch_id: r.cell for r in found}
    held, wanted = [(c.lat, c.lon, c.cell) for c in cells.collect()], {}
    for p in points.collect():
        best = min((pow(p.lat - lat, 2) + pow(p.lon - lon, 2), cell) for lat, lon, cell in held)
        wanted[p.patch_id] = min(best, wanted.get(p.patch_id, best))
    assert len(found) == 2990 and got == {k: v[1] for k, v in wanted.items()}


def test_rings_are_not_grouped_again_by_rows(spark):
    """Rows of a ring stay with it: one grouping, by the ring, is all; what is inside is as by crossing number."""
    rng = np.random.default_rng(3)
    rings = [(k, i, float(x), float(y)) for k in range(20) for i, (x, y) in enumerate(rng.uniform(-4, 20, (3 + k % 4, 2)))]
    rings += [(20, 0, float("nan"), 1.0), (20, 1, 9.0, float("nan")), (20, 2, 3.0, 9.0), (21, 0, 2.0, 5.0), (21, 1, 8.0, 5.0)]
    out = raster.rasterise(spark.createDataFrame(rings, "k bigint, ord int, px double, py double"), "k", 16)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    got = {tuple(r) for r in out.collect()}
    for k in range(20):
        own = [r[2:] for r in rings if r[0] == k]
        for r in range(16):
            for c in range(16):
                cut = [(x2 - x1) * (r + 0.5 - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(own, own[1:] + own[:1]) if (y1 > r + 0.5) != (y2 > r + 0.5)]
                assert (sum(c + 0.5 < x for x in cut) % 2 == 1) == ((k, r, c) in got)


def test_keyed_bursts_look_at_runs_not_pulses():
    """A stream of 300,000 pulses in 3 runs is cut by its runs; null swaths are runs of their own."""
    swaths = ["IW1"] * 100_000 + [None] * 100_000 + ["IW1"] * 100_000
    pulses = keyed.in_order(pd.DataFrame({"ts_us": range(300_000), "seq": 0, "swath": swaths}).sample(frac=1, random_state=1), [(300_000, 1, "IW2"), (300_000, 0, "IW1")])
    assert list(keyed.runs_of(pulses)) == [("IW1", 0, 99_999, 100_000), (None, 100_000, 199_999, 100_000), ("IW1", 200_000, 300_000, 100_001), ("IW2", 300_000, 300_000, 1)]


def test_windows_are_counted_without_pairs(spark):
    """As the pairs give it: products around a window, at its ends, longer than it, and such as stop before they start."""
    rng = np.random.default_rng(5)
    span = lambda n, name, low, high: spark.createDataFrame([(i, int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 400, n), rng.integers(low, high, n)))], f"{name} bigint, a bigint, b bigint").selectExpr(name, "timestamp_seconds(a * 43200) AS start_ts", "timestamp_seconds(b * 43200) AS stop_ts")
    targets, products = span(60, "target_id", 0, 60).unionByName(span(5, "target_id", 0, 3).withColumn("target_id", F.col("target_id") + 60)), span(300, "product_id", -1, 12)
    wanted = {tuple(r) for r in joins.containing_windows(targets, products).groupBy("target_id").agg(F.count("*"), F.sum("product_id")).collect()}
    assert {tuple(r) for r in joins.counted_windows(targets, products, "target_id", "product_id").collect()} == wanted and len(wanted) > 40


def test_rings_of_one_shape_are_found_once(monkeypatch):
    """Each region had its ring worked out alone. Values and statistics are as by distance, over blocks too."""
    calls, plain = [], blocks.distance_rings
    monkeypatch.setattr(blocks, "distance_rings", lambda *a: calls.append(1) or plain(*a))
    rng = np.random.default_rng(2)
    r, c = np.mgrid[-3:19, :30]  # block 0 of 16 rows, and three of the next
    region = np.where((r % 5 == 1) & (c % 6 < 2), r * 100 + c // 6, -1)
    value, mask = rng.normal(size=r.shape), region >= 0
    columns = [np.concatenate([x.ravel(), y[mask]]) for x, y in ((r, r), (c, c), (value, value * 0), (np.full(r.shape, -1), region), (np.ones(r.shape, int), np.zeros(r.shape, int)))]
    columns = [x[columns[0] >= 0] for x in columns]
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), k)) for k in (7, 0)] + [pa.array(x) for x in columns], list("tbrcvgh"))
    medians = [x for b in blocks.block_rings(iter([batch]), 16, 1, 3, "median") for x in b.to_pylist()]
    assert len(calls) == 1
    totals = {x["region"]: x for b in blocks.block_rings(iter([batch]), 16, 1, 3, "total") for x in b.to_pylist()}
    assert len(medians) == len(totals) == len(np.unique(region[mask & (r >= 0)]))
    for x in medians:
        y, z = np.nonzero((region == x["region"]) & (r >= 0))
        far = np.min([abs(r - r[a, b]) + abs(c - c[a, b]) for a, b in zip(y, z)], axis=0)
        want = value[(far > 1) & (far <= 3) & ~mask & (r >= 0) & (r < 16)]
        assert totals[x["region"]]["n"] == len(want) and abs(totals[x["region"]]["total"] - want.sum()) < 1e-9
        assert x["values"] == want.tolist() if x["background"] is None else abs(x["background"] - np.median(want)) < 1e-12


def test_distances_in_windows_are_made_where_they_are_handed_on(spark):
    """36 rows a pair were made and all pairs shuffled; the same rows as by pairs, with odd windows, ids and points."""
    plan = QUERIES["j05_grid_distance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "hashpartitioning(target_id" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rng = np.random.default_rng(5)
    day = lambda n: (pd.Timestamp("2020-01-01") + pd.Timedelta(hours=int(n))).to_pydatetime()
    targets = [(i, float(rng.integers(0, 5)), float(rng.integers(0, 5)), day(a := rng.integers(0, 900)), day(a + rng.integers(-5, 200))) for i in range(120)]
    targets += [(200, None, 1.0, day(0), day(900)), (201, float("nan"), 1.0, day(0), day(900)), (202, 1.0, 1.0, None, day(900))]
    products = [(int(rng.integers(0, 60)), day(a := rng.integers(0, 900)), day(a + rng.integers(0, 30))) for _ in range(150)] + [(61, day(5), day(6)), (62, day(5), day(6)), (63, None, day(6))]
    points = [(int(rng.integers(0, 58)), rng.normal() * 5, rng.normal() * 5) for _ in range(400)] + [(61, None, 2.0), (62, 1.0, float("nan")), (62, 2.0, 2.0), (63, 1.0, 1.0)]
    t = spark.createDataFrame(targets, "target_id bigint, lat double, lon double, start_ts timestamp, stop_ts timestamp")
    p = spark.createDataFrame(products, "product_id bigint, start_ts timestamp, stop_ts timestamp")
    g = spark.createDataFrame(points, "product_id bigint, lat double, lon double")
    rows = lambda df: sorted((r.target_id, r.product_id, None if r.min_distance_deg is None else str(round(r.min_distance_deg, 9))) for r in df.collect())
    want = rows(joins.grid_distance(joins.containing_windows(t, p).select("target_id", "product_id", "lat", "lon"), g))
    assert len(want) > 1000 and any(d is None for *_, d in want) and any(d == "nan" for *_, d in want)
    assert rows(joins.window_distances(t, p, g)) == want == rows(joins.window_distances(t, p, g, block=(7, 3)))


def test_buckets_of_days_follow_the_windows(spark):
    """Windows of three days met all products of 32 days."""
    t = lambda days: spark.range(5).selectExpr("id AS target_id", "timestamp'2020-01-01' AS start_ts", f"timestamp'2020-01-01' + INTERVAL {days} DAYS AS stop_ts")
    p = spark.range(40).selectExpr("id AS product_id", "timestamp'2020-01-01' + make_dt_interval(CAST(id AS INT)) AS start_ts").selectExpr("*", "start_ts + INTERVAL 30 SECONDS AS stop_ts")
    for days, bucket, n in ((3, 1, 3), (30, 10, 30), (2000, 32, 40)):
        assert joins.bucket_days(t(days)) == bucket
        met = joins.containing_windows(t(days), p)
        assert f"/ {bucket}.0" in plan(met).replace("cast(", "") or f"/ cast({bucket} as double)" in plan(met)
        assert met.count() == 5 * n == joins.containing_windows(t(days), p, 32).count()
    assert joins.bucket_days(t(3).limit(0)) == 1


def test_pairs_of_windows_are_dealt_to_tasks(spark):
    """Tables that are small beside their pairs were joined in one task; parts of buckets meet, each pair once."""
    t = spark.range(300).selectExpr("id AS target_id", "timestamp'2020-01-01' + make_dt_interval(CAST(id % 7 AS INT)) AS start_ts", "timestamp'2020-03-01' + make_dt_interval(CAST(id % 50 AS INT)) AS stop_ts")
    p = spark.range(400).selectExpr("id AS product_id", "timestamp'2020-01-01' + make_dt_interval(CAST(id % 120 AS INT)) AS start_ts").selectExpr("*", "start_ts + INTERVAL 30 SECONDS AS stop_ts")
    day = [(a % 7, 60 + a % 50) for a in range(300)]
    wanted = sorted((a, b) for a, (first, last) in enumerate(day) for b in range(400) if first <= b % 120 < last)
    for options, tasks in (({}, 1), ({"block": 16, "pairs": 4096}, 16), ({"block": 16, "pairs": 4096, "most": 6}, 6)):
        met = joins.containing_windows(t, p, **options).select("target_id", "product_id")
        assert sorted(map(tuple, met.collect())) == wanted
        assert met.groupBy(F.spark_partition_id()).count().count() >= min(tasks, 4)
    whole = QUERIES["j03_interval_match_whole"](spark, "/root/testdata/sf0.01")
    each = [r["count"] for r in whole.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 17_981_384 and len(each) >= 4 and max(each) < sum(each) / 2


def test_match_tables_are_written_by_lists(spark, tmp_path):
    """A row a pair went through Spark's CSV writer and parser, in one task; the files have the same lines, each with a header."""
    rng = np.random.default_rng(7)
    span = lambda n, name, low, high: spark.createDataFrame([(i, int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 90, n), rng.integers(low, high, n)))], f"{name} bigint, a bigint, b bigint").selectExpr(name, "timestamp_seconds(a * 43200) AS start_ts", "timestamp_seconds(b * 43200) AS stop_ts")
    odd = spark.sql("SELECT CAST(NULL AS bigint) AS id, timestamp_seconds(0) AS a, timestamp_seconds(4000000) AS b UNION ALL SELECT 900, NULL, timestamp_seconds(9) UNION ALL SELECT 901, timestamp_seconds(9), NULL UNION ALL SELECT -5, timestamp_seconds(2000000), timestamp_seconds(2000030)").toDF("id", "start_ts", "stop_ts")
    t = span(60, "target_id", -2, 60).unionByName(odd.withColumnRenamed("id", "target_id"))
    p = span(300, "product_id", -1, 6).unionByName(odd.withColumnRenamed("id", "product_id"))
    pairs = lambda rows: sorted(((a, b) for a, b in rows), key=str)
    wanted = pairs(joins.containing_windows(t, p).select("target_id", "product_id").collect())
    assert len(wanted) > 1000 and (None, -5) in wanted and (None, None) in wanted
    for n, sizes in enumerate(({}, {"block": 16, "pairs": 1024})):
        named = p.withColumn("product_id", F.coalesce(F.col("product_id").cast("string"), F.lit("")))
        lists = joins.listed_windows(t, named, "target_id", "product_id", **sizes).withColumnRenamed("values", "product_ids")
        files.write_listed_matches(lists, str(tmp_path / f"m{n}"))
        read = files.read_matches(spark, str(tmp_path / f"m{n}"))
        assert pairs(read.collect()) == wanted and [k for _, k in read.dtypes] == ["bigint", "bigint"]
        held = [x.read_text().split("\n") for x in (tmp_path / f"m{n}").glob("part-*") if x.stat().st_size]
        assert all(lines[0] == "target_id,product_id" for lines in held) and sum(len(lines) - 2 for lines in held) == len(wanted)
    files.write_listed_matches(lists.limit(0), str(tmp_path / "none"))
    assert files.read_matches(spark, str(tmp_path / "none")).count() == 0
    assert any(x.read_text() == "target_id,product_id\n" for x in (tmp_path / "none").glob("part-*"))
    assert "FileScan csv" not in plan(QUERIES["s10_match_table"](spark, "/root/testdata/sf0.001"))


def odd_windows(spark, seed, ntz=False):
    """Targets and products with null ids and times, windows that end before they start, equal times and products of any length."""
    rng = np.random.default_rng(seed)
    kind = "timestamp_ntz" if ntz else "timestamp"
    span = lambda n, low, high: [(None if i == 3 else i % 90, None if i == 5 else int(a), None if i == 6 else int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 300, n), rng.integers(low, high, n)))]
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, a bigint, b bigint").selectExpr(name, f"CAST(timestamp_seconds(a * 21600) AS {kind}) AS start_ts", f"CAST(timestamp_seconds(b * 21600) AS {kind}) AS stop_ts")
    t, p = span(100, -3, 90), span(400, 0, 9)
    wanted = sorted(((i, j) for i, a, b in t for j, c, d in p if None not in (a, b, c, d) and a <= c and b >= d), key=str)
    return table(t, "target_id"), table(p, "product_id"), wanted


def test_pairs_leave_as_lists_of_both_sides(spark):
    """Every row was shuffled once for each part that it meets, and every pair was a row of a join; lists are copied and meet now, and pairs are made last."""
    for ntz in (False, True):
        t, p, wanted = odd_windows(spark, 11, ntz)
        assert len(wanted) > 1000 and any(a is None for a, _ in wanted)
        for options in [{"block": 16, "pairs": 2048, "tall": 3, "wide": 5}] + [{}, {"block": 16, "most": 2, "days": 7}] * (not ntz):
            lists = joins.window_rectangles(t, p, "target_id", "product_id", **options).collect()
            assert sorted(((a, b) for r in lists for a in r["keys"] for b in r["values"]), key=str) == wanted and len(lists) < len(wanted) / 2
            pairs = joins.containing_windows(t, p, only=("target_id", "product_id"), **options)
            assert pairs.columns == ["target_id", "product_id"] and sorted(map(tuple, pairs.collect()), key=str) == wanted
        assert joins.containing_windows(t.limit(0), p, only=("target_id", "product_id")).count() == 0
    final = plan(QUERIES["j03_interval_match_whole"](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
    assert "MapInArrow" in final and "filename" not in final


def test_distances_are_rounded_as_spark_does(spark):
    """Each pair was rounded by itself; distances of a place are rounded now, with the same digits."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random(3000) * 10.0 ** rng.integers(-9, 12, 3000), np.arange(0.5, 400) / 1e6, [0.0, 2.5, 1.0000005, 0.1234565, 1e300, 123456789012.1234565, np.inf, np.nan]])
    for digits in (6, 2):
        wanted = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double").select("k", F.round("x", digits).alias("x")).orderBy("k").toPandas().x.to_numpy(dtype=float)
        assert np.array_equal(joins.rounded(x[:, None], digits)[:, 0], wanted, equal_nan=True)


def test_distances_of_places_are_found_for_all_products_at_once():
    """Products were looked at one by one, and whole windows pair by pair; sizes that differ, no points and NaN stay right."""
    rng = np.random.default_rng(4)
    sizes = np.array([0, 3, 1, 0, 40, 7, 0])
    lats, lons = rng.normal(size=(2, sizes.sum()))
    lats[[1, 3, 9]] = np.nan
    places = rng.normal(size=(2, 50))
    ends = np.cumsum(sizes)
    with np.errstate(invalid="ignore"):
        wanted = np.array([[np.sqrt(np.fmin.reduce((y - lats[e - n : e]) ** 2 + (x - lons[e - n : e]) ** 2)) if n else np.nan for n, e in zip(sizes, ends)] for y, x in places.T])
    for room in (1, 120, 1 << 16):
        assert np.array_equal(joins.place_distances(places, lats, lons, sizes, room), wanted, equal_nan=True)
    assert np.isnan(joins.place_distances(places, lats[:0], lons[:0], sizes * 0)).all()
    batch = pa.RecordBatch.from_arrays([pa.array([5, 4, 5, 6, 4]), pa.array([1.0, 2.0, None, None, 3.0]), pa.array([1.0, 2.0, 3.0, 4.0, 5.0])], ["product_id", "lat", "lon"])
    assert [r for b in joins.listed_points(iter([batch])) for r in b.to_pylist()] == [{"product_id": 5, "lats": [1.0], "lons": [1.0]}, {"product_id": 4, "lats": [2.0, 3.0], "lons": [2.0, 5.0]}, {"product_id": 6, "lats": [], "lons": []}]


def test_distances_by_lists_are_those_by_pairs(spark):
    """Also where blocks are cut within a list, batches hold few pairs and points come from several batches."""
    final = plan(QUERIES["j05_grid_distance"](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
    assert "round(" not in final
    t, p, pairs = odd_windows(spark, 12)
    t = t.where("target_id IS NOT NULL").dropDuplicates(["target_id"]).withColumns({"lat": F.expr("target_id % 7 / 3"), "lon": F.expr("target_id % 5 / 7")}).localCheckpoint()
    g = spark.range(900).selectExpr("id % 70 AS product_id", "if(id % 31 = 0, null, id % 13 / 11D) AS lat", "id % 17 / 13D AS lon").repartition(5)
    rows = lambda df: sorted((r.target_id, r.product_id, str(r.min_distance_deg)) for r in df.collect())
    wanted = rows(joins.grid_distance(joins.containing_windows(t, p).select("target_id", "product_id", "lat", "lon"), g).withColumn("min_distance_deg", F.round("min_distance_deg", 6)))
    assert len(wanted) > 300 and pairs
    assert rows(joins.window_distances(t, p, g, digits=6)) == wanted == rows(joins.window_distances(t, p, g, block=(9, 40), digits=6))
    lists = joins.met_lists(*(df.withColumn("b", F.lit(1)) for df in (spark.range(20), spark.range(50))), (8, 16), pairs=100).collect()
    assert sorted((x.id, y.id) for r in lists for x in r.targets for y in r.products) == [(x, y) for x in range(20) for y in range(50)] and len(lists) > 6
    span = lambda a, b: {"start": a, "stop": b}
    targets = [{"id": k, "lat": k / 7, "lon": None if k == 4 else k / 3, "start": k % 5, "stop": 20 + k % 9} for k in range(40)]
    products = [{"id": k, "lats": [k / 5] * (k % 4), "lons": [k / 9, 1.0, 2.0][: k % 4], "spans": [span(3, 22), span(k % 6, 20 + k % 6)][: 1 + k % 2], "nth": n} for k in range(50) for n in range(1 + k % 2)]
    batch = pa.RecordBatch.from_arrays([pa.array([targets]), pa.array([products])], ["targets", "products"])
    found = {(a, b, d) for x in joins.least_distances(iter([batch]), 3, pairs=99, tall=3, cells=1) for r in x.to_pylist() for a, own in zip(r["keys"], r["least"], strict=True) for b, d in zip(r["values"], own, strict=True)}
    near = lambda t, p: round(min(np.hypot(t["lat"] - y, t["lon"] - x) for y, x in zip(p["lats"], p["lons"])), 3) if p["lats"] and t["id"] != 4 else None
    assert found == {(t["id"], p["id"], near(t, p)) for t in targets for p in products if any(t["start"] <= x["start"] and t["stop"] >= x["stop"] for x in p["spans"])}


def test_match_tables_are_packed(spark, tmp_path, monkeypatch):
    """A line of 13 bytes a pair was kept as it is; files are compressed, each with a header and every pair a line, and what a failed attempt left is not read."""
    t, p, wanted = odd_windows(spark, 13)
    text = lambda c: F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))).alias(c)
    matches = joins.window_rectangles(t, p, "target_id", "product_id", block=32, pairs=2048).select(text("keys"), text("values"))
    path = tmp_path / "m"
    files.write_packed_matches(matches, str(path))
    assert sorted(map(tuple, files.read_matches(spark, str(path)).collect()), key=str) == wanted
    lines = []
    for x in path.glob("*.csv.zst"):
        with pa.input_stream(x, compression="zstd") as f:
            head, *own = f.read().decode().splitlines()
        assert head == "target_id,product_id" and own
        lines += own
    show = lambda x: "" if x is None else str(x)
    assert sorted(lines) == sorted(f"{show(a)},{show(b)}" for a, b in wanted)
    (path / ".part-failed.csv.zst").write_bytes(b"left")
    assert files.read_matches(spark, str(path)).count() == len(wanted)
    files.write_packed_matches(matches.limit(0), str(tmp_path / "none"))
    assert files.read_matches(spark, str(tmp_path / "none")).count() == 0 and [x.name for x in (tmp_path / "none").iterdir()] == ["part-none.csv.zst"]

    def closed(path):
        raise pa.ArrowInvalid("no access")

    monkeypatch.setattr(files, "opened", closed)
    files.write_packed_matches(matches, str(tmp_path / "far"))
    assert sorted(map(tuple, files.read_matches(spark, str(tmp_path / "far")).collect()), key=str) == wanted and [*(tmp_path / "far").glob("*.txt.gz")]
    monkeypatch.undo()
    folder = tmp_path / "query"
    monkeypatch.setattr(files, "scratch", lambda spark, tag: str(folder))
    assert QUERIES["s10_match_table_whole"](spark, "/root/testdata/sf0.001").count() == 180_579
    assert sum(x.stat().st_size for x in folder.iterdir()) < 180_579 * 3
