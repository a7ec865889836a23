"""J and W: joins and windows bound to the driver's tables."""

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import windows as W
from .registry import bound


@bound("j01_equi_by_id", "SELECT doc_id, scene FROM mask_file m JOIN (SELECT o_orderkey AS base, min(concat('S1A_', o_custkey % 97)) AS scene FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL) s ON m.base = s.base")
def _(t):
    scenes = t.patch.where("patch_id % 3 <> 0").select(F.col("patch_id").alias("base"), "scene")
    return J.equi_by_id(t.mask_file, scenes, "base")[0].select("doc_id", "scene")


@bound("j01b_unmapped", "SELECT split, count(*) AS dropped FROM mask_file WHERE base NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY split")
def _(t):
    scenes = t.patch.where("patch_id % 3 <> 0").select(F.col("patch_id").alias("base"), "scene")
    return J.equi_by_id(t.mask_file, scenes, "base")[1].groupBy("split").agg(F.count("*").alias("dropped"))


@bound("j02_pair_polarisations", "SELECT base, max(path) FILTER (pol = 'vv') AS vv, max(path) FILTER (pol = 'vh') AS vh FROM tile_file GROUP BY base")
def _(t):
    return J.pair_polarisations(t.tile_file)


@bound("j03_interval_match", "SELECT target_id, product_id FROM target t JOIN product p ON t.start_ts <= p.start_ts AND t.stop_ts >= p.stop_ts")
def _(t):
    return J.containing_windows(t.target, t.product, only=("target_id", "product_id"))


def whole_targets(t):
    """Targets with the window from their first to their last order, as FIXTURES binds them; ``target`` has three days."""
    own = t.orders.groupBy(F.col("o_custkey").alias("target_id")).agg(F.min("o_orderdate").alias("start_ts"), F.max("o_orderdate").alias("stop_ts"))
    return t.target.select("target_id", "lat", "lon").join(own, "target_id")


@bound("j03_interval_match_whole")
def _(t):
    return J.containing_windows(whole_targets(t), t.product, only=("target_id", "product_id"))


@bound("j03c_matches_per_target", "SELECT target_id, count(*) AS n, sum(product_id)::BIGINT AS mark FROM (SELECT c_custkey AS target_id, min(o_orderdate) AS a, max(o_orderdate) AS b FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) JOIN product p ON a <= p.start_ts AND b >= p.stop_ts GROUP BY target_id")
def _(t):
    """The whole join, a row a target."""
    return J.counted_windows(whole_targets(t), t.product, "target_id", "product_id")


@bound("j04_nearest_wind", "SELECT patch_id, min(struct_pack(d := pow(c.lat - w.lat, 2) + pow(c.lon - w.lon, 2), cell := cell)).cell AS cell FROM centre c, wind_cell w GROUP BY patch_id")
def _(t):
    return J.nearest_cell(t.centre, t.wind_cell, "patch_id").select("patch_id", "cell")


@bound("j05_grid_distance", "SELECT target_id, product_id, round(min(sqrt(pow(t.lat - g.lat, 2) + pow(t.lon - g.lon, 2))), 6) AS min_distance_deg FROM (SELECT target_id, product_id, t.lat, t.lon FROM target t JOIN product p ON t.start_ts <= p.start_ts AND t.stop_ts >= p.stop_ts) t JOIN grid_point g USING (product_id) GROUP BY ALL")
def _(t):
    return J.window_distances(t.target, t.product, t.grid_point, digits=6)


@bound("j05_grid_distance_whole")
def _(t):
    return J.window_distances(whole_targets(t), t.product, t.grid_point, digits=6)


CROSSING = """WITH e AS (SELECT patch_id, px AS x1, py AS y1, coalesce(lead(px) OVER w, first_value(px) OVER w) AS x2, coalesce(lead(py) OVER w, first_value(py) OVER w) AS y2 FROM patch_polygon WINDOW w AS (PARTITION BY patch_id ORDER BY ord)),
hits AS (SELECT s.patch_id, ship_no, count(*) FILTER ((y1 > s.y) <> (y2 > s.y) AND s.x < (x2 - x1) * (s.y - y1) / (y2 - y1) + x1) AS c FROM ship s JOIN e USING (patch_id) GROUP BY ALL)"""


def inside(t):
    points = t.ship.withColumn("px", F.col("x").cast("double")).withColumn("py", F.col("y").cast("double"))
    return J.points_in_polygons(points, t.patch_polygon, "patch_id")


@bound("j06_points_in_patch", CROSSING + " SELECT patch_id, ship_no FROM hits WHERE c % 2 = 1")
def _(t):
    return inside(t).select("patch_id", "ship_no")


@bound("j07_nearest_burst", "WITH l AS (SELECT user_id % 4 AS stream, event_id AS patch, ts FROM events WHERE event_type IN ('view', 'click')), r AS (SELECT user_id % 4 AS stream, event_id AS burst, ts FROM events WHERE event_type = 'signup') SELECT stream, patch, burst FROM (SELECT l.stream, patch, burst, row_number() OVER (PARTITION BY l.stream, patch ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, burst) AS n FROM l JOIN r ON l.stream = r.stream AND r.ts BETWEEN l.ts - INTERVAL 20 DAYS AND l.ts + INTERVAL 20 DAYS) WHERE n = 1")
def _(t):
    own = t.events.withColumn("stream", F.col("user_id") % 4)
    left = own.where("event_type IN ('view', 'click')").select("stream", F.col("event_id").alias("patch"), "ts")
    right = own.where("event_type = 'signup'").select("stream", F.col("event_id").alias("burst"), "ts")
    return J.nearest_in_time(left, right, ["stream"], "patch", "burst").select("stream", "patch", "burst")


RAW = "SELECT o_orderkey AS id, concat('S1A_IW_RAW__0SDV_20200407T0529', CAST(o_orderkey % 60 AS VARCHAR(9)), '_20200407T053029_', CAST(o_custkey AS VARCHAR(20)), '_03B2E2_') AS prefix FROM orders"


@bound("j08_prefix_match", f"WITH a AS ({RAW}), b AS (SELECT prefix, concat(prefix, CASE id % 2 WHEN 0 THEN 'AAAA' ELSE 'BBBB' END, CASE WHEN id % 11 = 0 THEN '.zip' ELSE '.SAFE' END) AS name FROM a WHERE id % 4 <> 1) SELECT id AS patch_id, min(name) AS name FROM a JOIN b USING (prefix) WHERE ends_with(name, '.SAFE') GROUP BY id")
def _(t):
    own = t.sql(RAW)
    names = own.where("id % 4 <> 1").select(F.concat("prefix", F.when(F.col("id") % 2 == 0, "AAAA").otherwise("BBBB"), F.when(F.col("id") % 11 == 0, ".zip").otherwise(".SAFE")).alias("name"))
    return J.by_prefix(own.select(F.col("id").alias("patch_id"), "prefix"), names).select("patch_id", "name")


CALS = "SELECT l_suppkey AS key, concat('CAL', CAST(l_linenumber AS VARCHAR(3))) AS kind, concat('c', CAST(l_partkey AS VARCHAR(20))) AS path FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_linenumber > l_suppkey % 6"


@bound("j09_calibration_fallback", f"WITH c AS ({CALS}), b AS (SELECT key, arg_min(path, struct_pack(r := kind, p := path)) AS path FROM c WHERE kind IN ('CAL1', 'CAL2', 'CAL3') GROUP BY key) SELECT p.patch_id, b.path, CASE WHEN b.path IS NOT NULL THEN NULL WHEN p.k IN (SELECT key FROM c) THEN 'no_usable_kind' ELSE 'no_calibration' END AS miss FROM (SELECT patch_id, area % (SELECT count(*) FROM supplier) AS k FROM patch) p LEFT JOIN b ON p.k = b.key")
def _(t):
    n = t.supplier.count()
    patches = t.patch.select("patch_id", (F.col("area") % n).alias("key"))
    return J.with_fallback(patches, t.sql(CALS), ["CAL1", "CAL2", "CAL3"]).select("patch_id", "path", "miss")


@bound("j10_tiles_with_mask", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_mask FROM documents")
def _(t):
    docs, masks = t.documents.select("doc_id"), t.labels.select("doc_id")
    return docs.join(masks, "doc_id", "left_semi").withColumn("has_mask", F.lit(True)).unionByName(docs.join(masks, "doc_id", "left_anti").withColumn("has_mask", F.lit(False)))


@bound("j11_image_label", "SELECT f.base AS n, lpad(f.base::VARCHAR, 8, '0') AS image, m.base::VARCHAR AS label FROM tile_file f JOIN mask_file m ON f.base = m.base")
def _(t):
    return J.image_with_label(t.tile_file.select(F.lpad(F.col("base").cast("string"), 8, "0").alias("image")), t.mask_file.select(F.col("base").cast("string").alias("label")))


@bound("j12_label_file", "SELECT f.stem, m.path FROM tile_file f JOIN mask_file m ON regexp_replace(f.stem, '(VH|VV)_', '') = concat('DB_SAR_', m.base)")
def _(t):
    files = t.tile_file.select("stem", F.regexp_replace("stem", "(VH|VV)_", "").alias("key"))
    return files.join(t.mask_file.select(F.concat(F.lit("DB_SAR_"), "base").alias("key"), "path"), "key").select("stem", "path")


@bound("j13_mask_templates", "SELECT concat(p, '_', base) AS name, min(path) AS path FROM mask_file CROSS JOIN (VALUES ('VH'), ('VV')) v(p) GROUP BY ALL")
def _(t):
    return J.mask_templates(t.mask_file).select("name", "path")


@bound("j14_prefer_split", "SELECT doc_id AS tile, label_path FROM (SELECT f.doc_id, m.path AS label_path, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.split = m.split DESC, m.path) AS n FROM tile_file f JOIN mask_file m USING (base)) WHERE n = 1")
def _(t):
    tiles = t.tile_file.select(F.col("doc_id").alias("tile"), "base", "split")
    return J.prefer_split(tiles, t.mask_file.select("base", "split", "path")).select("tile", "label_path")


@bound("j15_prediction_tile", "SELECT concat(f.stem, '_pred') AS pred, m.path, m.path IS NULL AS failed FROM tile_file f LEFT JOIN mask_file m ON m.doc_id = f.doc_id")
def _(t):
    preds = t.tile_file.select(F.concat("stem", F.lit("_pred")).alias("pred"))
    tiles = t.tile_file.select("stem", "doc_id").join(t.mask_file.select("doc_id", "path"), "doc_id", "left").select("stem", "path")
    return preds.withColumn("stem", F.regexp_replace("pred", "_pred$", "")).join(tiles, "stem", "left").select("pred", "path", F.col("path").isNull().alias("failed"))


@bound("j16_raw_with_label", "SELECT name FROM file WHERE contains(name, '.dat') AND string_split(name, '-')[8] IN (SELECT string_split(name, '-')[8] FROM file WHERE contains(name, '.xml'))")
def _(t):
    orbit = F.split("name", "-")[7]
    labels = t.file.where(F.col("name").contains(".xml")).select(orbit.alias("orbit")).distinct()
    return t.file.where(F.col("name").contains(".dat")).withColumn("orbit", orbit).join(labels, "orbit", "left_semi").select("name")


@bound("j17_orbit_lookup", "SELECT product_id, n_name AS orbit_file FROM product JOIN nation ON orbit = n_nationkey")
def _(t):
    return t.product.join(t.nation.select(F.trim("n_name").alias("orbit_file"), F.col("n_nationkey").alias("orbit")), "orbit").select("product_id", "orbit_file")


@bound("j18_prefix_groups", "WITH s AS (SELECT DISTINCT concat('DB_SAR_', p) AS stem FROM (VALUES ('VH'), ('VV')) v(p) UNION ALL SELECT 'DB'), f AS (SELECT concat(stem, '_x') AS name FROM tile_file) SELECT s.stem, count(*) AS n, min(name) AS first_name FROM s JOIN f ON starts_with(name, concat(s.stem, '_')) GROUP BY s.stem")
def _(t):
    stems = t.tile_file.select(F.concat(F.lit("DB_SAR_"), F.upper("pol")).alias("stem")).union(t.region.limit(1).select(F.lit("DB").alias("stem"))).distinct()
    met = J.by_any_prefix(stems, t.tile_file.select(F.concat("stem", F.lit("_x")).alias("name")))
    return met.groupBy("stem").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@bound("j19_mask_index", "SELECT source AS scene, base AS tile, pol, path FROM (SELECT *, row_number() OVER (PARTITION BY source, base, pol ORDER BY path) AS n FROM tile_file) WHERE n = 1")
def _(t):
    return J.first_by(t.tile_file, ["source", "base", "pol"], F.col("path")).select(F.col("source").alias("scene"), F.col("base").alias("tile"), "pol", "path")


WANTED = "SELECT DISTINCT concat('P_', CAST(o_custkey % 50 AS VARCHAR(9)), CASE WHEN o_custkey % 3 = 0 THEN '_1' ELSE '' END) AS wanted FROM orders"
HAVE = "SELECT DISTINCT concat('P_', CAST(o_custkey % 40 AS VARCHAR(9)), '_', CAST(o_orderkey % 3 AS VARCHAR(9)), CASE WHEN o_custkey % 7 = 0 THEN '_long' ELSE '' END) AS name FROM orders"


@bound("j20_resolve_products", f"WITH w AS ({WANTED}), h AS ({HAVE}), m AS (SELECT wanted, name, (name <> wanted)::INT AS rank FROM w JOIN h ON name = wanted OR starts_with(name, concat(wanted, '_'))), g AS (SELECT wanted, arg_min(name, struct_pack(r := rank, l := length(name), n := name)) AS name, min(rank) AS r, count(*) AS n FROM m GROUP BY wanted) SELECT wanted, name, CASE WHEN n IS NULL THEN 'missing' WHEN r = 0 THEN 'exact' WHEN n = 1 THEN 'prefix' ELSE 'shortest' END AS status FROM w LEFT JOIN g USING (wanted)")
def _(t):
    return J.resolve_products(t.sql(WANTED), t.sql(HAVE))


@bound("j21_remap_lines", "WITH l AS (SELECT (o_orderkey % 700) AS line, o_orderkey % 2 AS c, max(o_orderkey) AS target FROM orders GROUP BY ALL), two AS (SELECT line, arg_min(target, c) AS a, arg_max(target, c) AS b FROM l GROUP BY line) SELECT patch_id, ship_no, CASE WHEN y >= 250 THEN b ELSE a END AS target FROM ship JOIN two ON x + y = line")
def _(t):
    lines = t.orders.groupBy((F.col("o_orderkey") % 700).alias("line"), (F.col("o_orderkey") % 2).alias("candidate")).agg(F.max("o_orderkey").alias("target"))
    points = t.ship.select("patch_id", "ship_no", (F.col("x") + F.col("y")).cast("bigint").alias("line"), F.col("y").alias("local_line"))
    return J.remap_lines(points, lines, 250).select("patch_id", "ship_no", "target")


# windows

DIST = "SELECT patch_id % 90 AS lat, patch_id % 45 AS lon, confidence AS filename, patch_id * 10 + ship_no AS ord, size_m AS dist FROM ship"


@bound("w01_best_match", f"SELECT lat, lon, filename, ord FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon, filename ORDER BY dist, ord) AS n FROM ({DIST})) WHERE n = 1")
def _(t):
    return W.best_match(t.sql(DIST), ["lat", "lon", "filename"], "dist", F.col("ord")).select("lat", "lon", "filename", "ord")


@bound("w02_at_most_k", f"SELECT lat, lon, ord FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY filename, ord) AS n FROM ({DIST})) WHERE n <= 10")
def _(t):
    return W.at_most(t.sql(DIST), ["lat", "lon"], 10, F.col("filename"), F.col("ord")).select("lat", "lon", "ord")


FILL = "SELECT event_id AS ord, CASE WHEN event_id % 6 = 0 THEN CAST(user_id AS VARCHAR(20)) ELSE ' ' END AS id, CASE WHEN event_id % 4 = 1 THEN event_type ELSE '' END AS aoi FROM events"


@bound("w03_forward_fill", f"WITH f AS ({FILL}), a AS (SELECT ord, last_value(nullif(trim(id), '') IGNORE NULLS) OVER (ORDER BY ord) AS id, aoi FROM f) SELECT ord, id, last_value(nullif(aoi, '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY ord) AS aoi FROM a")
def _(t):
    return W.forward_fill(W.forward_fill(t.sql(FILL), ["id"], ["ord"]), ["aoi"], ["ord"], ["id"])


@bound("w04_bursts", "WITH m AS (SELECT *, CASE WHEN lag(swath) OVER (PARTITION BY stream ORDER BY ts, seq) <> swath THEN 1 ELSE 0 END AS c FROM pulse), r AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM m), g AS (SELECT stream, swath, run, min(ts) AS start_ts, max(ts) AS stop_ts, count(*) AS n FROM r GROUP BY ALL) SELECT stream, swath, row_number() OVER (PARTITION BY stream, swath ORDER BY run)::INT AS burst, start_ts, stop_ts, n FROM g")
def _(t):
    return W.bursts(t.pulse, ["stream"], ["ts", "seq"]).select("stream", "swath", F.col("burst").cast("int").alias("burst"), "start_ts", "stop_ts", "n")


@bound("w05_patch_counter", "SELECT patch_id, row_number() OVER (PARTITION BY scene ORDER BY swath, x0, y0, patch_id)::INT AS n FROM patch")
def _(t):
    return W.numbered(t.patch, ["scene"], *map(F.col, ("swath", "x0", "y0", "patch_id"))).select("patch_id", "n")


@bound("w06_ship_names", "SELECT patch_id, ship_no, concat('Ship_', ship_no) AS name, ship_no % 9 <> 8 AS matches FROM ship")
def _(t):
    own = W.numbered(t.ship, ["patch_id"], F.col("ship_no"), name="k").withColumn("name", F.concat(F.lit("Ship_"), "k"))
    held = F.when(F.col("ship_no") % 9 == 8, "Ship_x").otherwise(F.concat(F.lit("Ship_"), "ship_no"))
    return own.select("patch_id", "ship_no", "name", (F.col("name") == held).alias("matches"))


@bound("w07_first_filled", "SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS kind, arg_min(value, event_id) FILTER (value > 20) AS value FROM events GROUP BY user_id")
def _(t):
    own = t.events.select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("kind"), F.when(F.col("value") > 20, F.col("value")).alias("value"))
    return W.first_filled(own, ["user_id"], ["kind", "value"], "event_id")


@bound("w08_burst_overlap", "SELECT stream, seq, 1500 - round_even((epoch_us(lead(ts) OVER (PARTITION BY stream ORDER BY ts)) - epoch_us(ts)) / 1e6 / 0.5, 0) AS overlap FROM pulse")
def _(t):
    return W.overlap_lines(t.pulse, ["stream"], "ts", 0.5, 1500).select("stream", "seq", "overlap")


@bound("w09_shortest_candidate", "SELECT source, arg_min(name, struct_pack(l := length(name), n := name)) AS name FROM (SELECT folder AS source, name FROM file) GROUP BY source")
def _(t):
    return t.file.groupBy(F.col("folder").alias("source")).agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"))


@bound("w10_leading_run", "WITH s AS (SELECT patch_id, list_concat(list_resize([]::INT[], patch_id % 7, -1), [patch_id % 5, -1, 4]) AS v FROM patch) SELECT patch_id, (patch_id % 7)::INT AS lead_n FROM s")
def _(t):
    series = F.concat(F.expr("array_repeat(-1, cast(patch_id % 7 as int))"), F.array((F.col("patch_id") % 5).cast("int"), F.lit(-1), F.lit(4)))
    return t.patch.select("patch_id", W.leading_run(series).alias("lead_n"))


@bound("w11_reverse_cumulative", "SELECT model, b, sum(n) OVER (PARTITION BY model ORDER BY b DESC)::BIGINT AS at_least FROM (SELECT model, (prob * 100)::INT AS b, count(*) AS n FROM prediction GROUP BY ALL)")
def _(t):
    from pyspark.sql.window import Window

    own = t.prediction.groupBy("model", F.rint(F.col("prob") * 100).cast("int").alias("b")).agg(F.count("*").alias("n"))
    return own.select("model", "b", F.sum("n").over(Window.partitionBy("model").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)).alias("at_least"))


@bound("w12_percentile_scaled", "WITH c AS (SELECT user_id, quantile_cont(ln(1 + value), 0.02) AS lo, quantile_cont(ln(1 + value), 0.98) AS hi FROM events GROUP BY user_id) SELECT event_id, round(CASE WHEN hi > lo THEN (greatest(lo, least(hi, ln(1 + value))) - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM events JOIN c USING (user_id)")
def _(t):
    return W.percentile_scaled(t.events, ["user_id"], "value").select("event_id", F.round("scaled", 6).alias("scaled"))
