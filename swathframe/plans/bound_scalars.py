"""P and F: filters, predicates and scalar functions bound to the driver's tables."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import filters as P
from .registry import bound

TRUTH = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 = 0 THEN ' nan' ELSE concat(' \"s', CAST(o_custkey AS VARCHAR(20)), '\" ') END AS scene, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_orderkey % 50 / 10.0 AS VARCHAR(10)) END AS swath, CAST(o_custkey % 90 AS VARCHAR(9)) AS lat, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 180 AS VARCHAR(9)) END AS lon, CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'T ' WHEN 2 THEN '0' ELSE 'no' END AS is_vessel FROM orders"


@bound("p01_clean_truth", f"WITH truth AS ({TRUTH}), typed AS (SELECT id, CASE WHEN lower(trim(scene)) = 'nan' THEN '' ELSE upper(trim(trim(scene), '\"')) END AS scene, round_even(TRY_CAST(swath AS DOUBLE), 0) AS swath, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon, lower(trim(is_vessel)) IN ('true', '1', 'yes', 'y', 't') AS is_vessel FROM truth) SELECT id, scene, swath::INT AS swath, lat, lon, is_vessel FROM typed WHERE scene <> '' AND lat IS NOT NULL AND lon IS NOT NULL AND swath BETWEEN 1 AND 3")
def _(t):
    return P.clean_truth(t.sql(TRUTH))


@bound("p02_filter_ships", "SELECT patch_id, ship_no, xview_km, global_km FROM ship WHERE is_vessel AND xview_km >= 10 AND NOT isnan(xview_km) AND global_km >= 10 AND NOT isnan(global_km)")
def _(t):
    return P.filter_ships(t.ship, 10, "both", True).select("patch_id", "ship_no", "xview_km", "global_km")


BOXES = "SELECT patch_id, ship_no, CASE WHEN patch_id % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(y AS DOUBLE) END AS t, CASE WHEN ship_no % 6 = 0 THEN NULL ELSE CAST(x AS DOUBLE) END AS l FROM ship"


@bound("p03_skip_bad_boxes", f"SELECT patch_id, ship_no, CASE WHEN t IS NULL OR l IS NULL THEN 'missing_box' WHEN isnan(t) OR isnan(l) THEN 'nan_box' END AS reason FROM ({BOXES})")
def _(t):
    return t.sql(BOXES).select("patch_id", "ship_no", P.skip_reason({"t": F.col("t"), "l": F.col("l")}).alias("reason"))


@bound("p04_keep_tiles", "SELECT patch_id, x0, y0 FROM (SELECT *, price % 400 * 655 AS zeros FROM patch) WHERE x0 + 512 <= 15000 AND y0 + 512 <= 1400 AND zeros <= 65536")
def _(t):
    return P.keep_tiles(t.patch.withColumn("zeros", F.col("price") % 400 * 655), F.lit(15000), F.lit(1400), 512).select("patch_id", "x0", "y0")


@bound("p05_drop_weak_starts", "SELECT patch_id, ship_no FROM ship WHERE NOT (size_m / 8 < 10 AND y < 20)")
def _(t):
    return P.drop_weak_starts(t.ship.withColumn("amp", F.col("size_m") / 8).withColumn("local_line", F.col("y"))).select("patch_id", "ship_no")


@bound("p06_select_scenes", "WITH wanted AS (SELECT * FROM (VALUES (7, 0), (5, 1), (9, 2), (8, 3), (6, 4), (20, 5)) w(c, pos)) SELECT pos, o_custkey, o_orderkey FROM orders JOIN wanted ON o_custkey = c")
def _(t):
    return P.select_ordered(t.orders, "o_custkey", "7,5,9-6,20").select("pos", "o_custkey", "o_orderkey")


@bound("p07_by_token", "SELECT name, split FROM file WHERE contains(name, '-vv-')")
def _(t):
    return t.file.where(F.col("name").contains("-vv-")).select("name", "split")


@bound("p08_allow_list", "WITH ids AS (SELECT DISTINCT concat('DB_', p, '_', doc_id) AS id FROM labels CROSS JOIN (VALUES ('VV'), ('VH')) v(p) WHERE quality = 1), f AS (SELECT concat('DB_', upper(pol), '_', base, CASE WHEN doc_id % 3 = 0 THEN '_aug2' ELSE '' END) AS name, split FROM tile_file) SELECT split, count(*) AS before, count(*) FILTER (regexp_replace(name, '_aug\\d+$', '') IN (SELECT id FROM ids)) AS after FROM f GROUP BY split")
def _(t):
    files = t.tile_file.select(F.concat(F.upper("pol"), F.lit("_"), F.col("base"), F.when(F.col("doc_id") % 3 == 0, "_aug2").otherwise("")).alias("name"), "split")
    kept = P.filter_allowed(files, t.labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("label")))
    before, after = files.groupBy("split").agg(F.count("*").alias("before")), kept.groupBy("split").agg(F.count("*").alias("after"))
    return before.join(after, "split", "left").fillna(0)


@bound("p09_parse_names", "WITH p AS (SELECT name, string_split(regexp_replace(name, '\\.[^.]*$', ''), '-') AS k FROM file) SELECT name, CASE WHEN len(k) >= 11 THEN k[5] END AS pol, CASE WHEN len(k) >= 11 THEN upper(k[6]) END AS start, CASE WHEN len(k) >= 11 THEN k[8] END AS orbit, CASE WHEN len(k) >= 11 THEN regexp_extract(k[10], 'IW(\\d)', 1)::INT END AS swath, CASE WHEN len(k) >= 11 THEN regexp_replace(regexp_extract(k[-1], '^([A-Z]+)_', 1), '^VD$', 'DVD') END AS kind, CASE WHEN len(k) >= 11 THEN regexp_extract(k[-1], '_(\\d+)', 1)::BIGINT END AS patch FROM p")
def _(t):
    return P.parsed_names(t.file).select("name", "pol", "start", "orbit", "swath", "kind", "patch")


PRODUCTS = "SELECT o_orderkey AS id, concat(CASE o_orderkey % 2 WHEN 0 THEN 'S1A' ELSE 'S1B' END, '_IW_SLC__1S', CASE o_orderkey % 5 WHEN 0 THEN 'DV' WHEN 1 THEN 'SV' WHEN 2 THEN 'SH' WHEN 3 THEN 'DH' ELSE 'XX' END, '_20200407T052956_20200407T053029_', CAST(o_orderkey AS VARCHAR(20)), '.SAFE') AS product FROM orders"


@bound("p10_parse_products", f"SELECT id, substr(product, 1, 3) AS mission, substr(product, 18, 15) AS start, substr(product, 34, 15) AS stop, CASE WHEN contains(product, 'DV') THEN 'DV' WHEN contains(product, 'SV') THEN 'SV' WHEN contains(product, 'SH') THEN 'SH' WHEN contains(product, 'DH') THEN 'DH' END AS pol FROM ({PRODUCTS})")
def _(t):
    p = F.col("product")
    return t.sql(PRODUCTS).select("id", F.substring(p, 1, 3).alias("mission"), F.substring(p, 18, 15).alias("start"), F.substring(p, 34, 15).alias("stop"), C.polarisation_class(p).alias("pol"))


@bound("p11_traceability", "SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(name, 'RFI_\\d+_|VD_\\d+')) AS offenders, CASE WHEN count(*) FILTER (NOT regexp_matches(name, 'RFI_\\d+_|VD_\\d+')) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM file")
def _(t):
    return P.traceable(t.file)


PATHS = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat('data\\\\S1A_IW_', CAST(o_custkey AS VARCHAR(20)), '.SAFE\\\\measurement') WHEN 1 THEN concat('/x/S1B_', CAST(o_custkey AS VARCHAR(20)), '/S1A_1') ELSE concat('a/', 'longest_', CAST(o_custkey AS VARCHAR(20)), '.SAFE/bb') END AS path FROM orders"


@bound("p12_scene_of_path", "WITH q AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 3 AS k FROM orders) SELECT id, CASE k WHEN 0 THEN concat('S1A_IW_', c) WHEN 1 THEN concat('S1B_', c) ELSE concat('longest_', c) END AS scene FROM q")
def _(t):
    return t.sql(PATHS).select("id", C.scene_of(F.col("path")).alias("scene"))


@bound("p13_valid_pixels", "SELECT image_id, px, label FROM (SELECT *, CASE WHEN px = 7 THEN 255 ELSE gt::INT END AS label FROM prediction) WHERE valid AND label <> 255")
def _(t):
    return P.valid_pixels(t.prediction.withColumn("label", F.when(F.col("px") == 7, 255).otherwise(F.col("gt").cast("int")))).select("image_id", "px", "label")


@bound("p14_blank_masks", "SELECT doc_id AS file_id FROM labels WHERE toxic = 0")
def _(t):
    return P.blank_worklist(t.labels.select(F.col("doc_id").alias("file_id"), F.col("toxic").alias("rfi")))


REQS = "SELECT p_partkey AS req, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS txt, CASE p_partkey % 3 WHEN 0 THEN ' DS ' WHEN 1 THEN 'DS' ELSE 'SW' END AS applies, p_brand FROM part"


@bound("p15_requirements", f"SELECT req, txt, applies FROM ({REQS}) WHERE trim(applies) = 'DS' AND txt IS NOT NULL")
def _(t):
    return P.requirement_rows(t.sql(REQS), ("req", "txt", "applies"))


# scalar functions


@bound("f01_last_digits", "WITH s AS (SELECT stem FROM tile_file), k AS (SELECT stem, list_filter(string_split(stem, '_'), lambda x: regexp_matches(x, '^[0-9]+$')) AS d FROM s) SELECT stem, d[-1] AS id FROM k")
def _(t):
    return t.tile_file.select("stem", C.last_digits(F.col("stem")).alias("id"))


@bound("f02_loose_stem", "SELECT name, CASE WHEN regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), '^.+_[^_]*$') THEN regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '^(.+)_[^_]*$', 1) ELSE regexp_replace(name, '\\.[^.]*$', '') END AS stem FROM file")
def _(t):
    return t.file.select("name", C.loose_stem(F.col("name")).alias("stem"))


@bound("f03_scene_and_tile", "SELECT name, nullif(regexp_extract(name, '-(\\d{6})-', 1), '')::BIGINT AS scene, nullif(regexp_extract(name, '(?:RFI|DVD|VD)_(\\d+)', 1), '')::BIGINT AS tile FROM file")
def _(t):
    scene, tile = C.scene_and_tile(F.col("name"))
    return t.file.select("name", scene.alias("scene"), tile.alias("tile"))


@bound("f04_polarisation", "SELECT name, CASE WHEN regexp_matches(lower(name), '[-_]vv[-_]') THEN 'vv' WHEN regexp_matches(lower(name), '[-_]vh[-_]') THEN 'vh' ELSE 'unknown' END AS pol FROM file")
def _(t):
    return t.file.select("name", C.polarisation(F.col("name")).alias("pol"))


AREAS = "SELECT o_orderkey AS id, concat(CAST(o_orderkey % 12 AS VARCHAR(9)), ', ', CAST(o_custkey AS VARCHAR(9)), ',,3') AS areas FROM orders"


@bound("f05_area_list", f"SELECT id, array_to_string(list_transform(list_filter(list_transform(string_split(areas, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: CASE WHEN length(x) < 2 THEN lpad(x, 2, '0') ELSE x END), '|') AS areas FROM ({AREAS})")
def _(t):
    return t.sql(AREAS).select("id", F.array_join(C.padded_areas(F.col("areas")), "|").alias("areas"))


@bound("f06_stamps", "SELECT event_id, date_trunc('second', ts) AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS b, strftime(ts, '%Y%m%d_%H%M%S') AS txt FROM events")
def _(t):
    txt = C.stamp_text(F.col("ts"))
    iso = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return t.events.select("event_id", C.parse_stamp(txt).alias("a"), C.parse_stamp(iso).alias("b"), txt.alias("txt"))


@bound("f07_gps_seconds", "SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 - 315964800 + CASE WHEN o_orderdate >= '2017-01-01' THEN 18 WHEN o_orderdate >= '2015-07-01' THEN 17 WHEN o_orderdate >= '2012-07-01' THEN 16 WHEN o_orderdate >= '2009-01-01' THEN 15 WHEN o_orderdate >= '2006-01-01' THEN 14 WHEN o_orderdate >= '1999-01-01' THEN 13 ELSE 12 END AS gps FROM orders")
def _(t):
    return t.orders.select("o_orderkey", C.gps_seconds(F.col("o_orderdate")).alias("gps"))


@bound("f08_wrap_longitude", "SELECT target_id, (((lon * 3 + 180) % 360 + 360) % 360) - 180 AS lon FROM target")
def _(t):
    return t.target.select("target_id", C.wrap_longitude(F.col("lon") * 3).alias("lon"))


@bound("f09_great_circle", "WITH p AS (SELECT patch_id, radians(lat) AS a, radians(lat / 2 + 10) AS b, radians(20 - lon) AS d FROM centre) SELECT patch_id, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(d / 2), 2)))), 5) AS km, round((degrees(atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d))) + 360) % 360, 5) AS bearing FROM p")
def _(t):
    a = (F.col("lat"), F.col("lon"), F.col("lat") / 2 + 10, F.lit(20.0))
    return t.centre.select("patch_id", F.round(C.great_circle_km(*a), 5).alias("km"), F.round(C.bearing_deg(*a), 5).alias("bearing"))


@bound("f10_contrast_db", "SELECT event_id, round(10 * log10(greatest(value, 1e-12) / greatest(user_id, 1e-12)), 6) AS db FROM events")
def _(t):
    return t.events.select("event_id", F.round(C.contrast_db(F.col("value"), F.col("user_id").cast("double")), 6).alias("db"))


@bound("f11_amplitude_phase", "WITH p AS (SELECT tile_id, embedding[1]::DOUBLE AS i, embedding[33]::DOUBLE AS q FROM tile) SELECT tile_id, round(sqrt(i * i + q * q), 6) AS amp, round(degrees(atan2(q, i)), 5) AS ph FROM p")
def _(t):
    i, q = F.col("embedding")[0].cast("double"), F.col("embedding")[32].cast("double")
    return t.tile.select("tile_id", F.round(C.amplitude(i, q), 6).alias("amp"), F.round(C.phase(i, q, True), 5).alias("ph"))


@bound("f12_log_scaled", "SELECT event_id, round((greatest(1.0, least(4.0, ln(1 + value))) - 1.0) / 3.0, 6) AS v FROM events")
def _(t):
    return t.events.select("event_id", F.round(C.log_scaled(F.col("value"), F.lit(1.0), F.lit(4.0)), 6).alias("v"))


@bound("f13_pose_line", "WITH b AS (SELECT patch_id, ship_no, x::DOUBLE AS l, y::DOUBLE AS t, (x + w)::DOUBLE AS r, (y + h)::DOUBLE AS b FROM ship) SELECT patch_id, ship_no, format('0 {:.6f} {:.6f} {:.6f} {:.6f} {:.6f} {:.6f} 2', (l + r) / 2 / 512, (t + b) / 2 / 512, (r - l) / 512, (b - t) / 512, (l + r) / 2 / 512, (t + b) / 2 / 512) AS line FROM b")
def _(t):
    d = lambda x: x.cast("double")
    x, y, w, h = map(F.col, "xywh")
    return t.ship.select("patch_id", "ship_no", C.pose_line(d(x), d(y), d(x + w), d(y + h), F.lit(512.0), F.lit(512.0)).alias("line"))


@bound("f14_pixel_box", "SELECT patch_id, ship_no, trunc((x / 600.0 - w / 1200.0) * 640)::INT AS l, trunc((y / 600.0 - h / 1200.0) * 640)::INT AS t, trunc((x / 600.0 + w / 1200.0) * 640)::INT AS r, trunc((y / 600.0 + h / 1200.0) * 640)::INT AS b FROM (SELECT patch_id, ship_no, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM ship)")
def _(t):
    n = lambda c: F.col(c).cast("double") / 600.0
    w, h = (F.col(c).cast("double") / 1200.0 * 2 for c in "wh")
    box = C.pixel_box(n("x"), n("y"), w, h, F.lit(640), F.lit(640))
    return t.ship.select("patch_id", "ship_no", box.alias("q")).select("patch_id", "ship_no", F.col("q.left").alias("l"), F.col("q.top").alias("t"), F.col("q.right").alias("r"), F.col("q.bottom").alias("b"))


@bound("f15_inflate_box", "WITH b AS (SELECT patch_id, ship_no, x / 512.0::DOUBLE AS x, y / 512.0::DOUBLE AS y, least(w / 512.0::DOUBLE + 0.0390625, 1.0) AS w, least(h / 512.0::DOUBLE + 0.0390625, 1.0) AS h FROM ship) SELECT patch_id, ship_no, round(greatest(w / 2, least(x, 1 - w / 2)), 6) AS xc, round(greatest(h / 2, least(y, 1 - h / 2)), 6) AS yc, round(w, 6) AS w, round(h, 6) AS h FROM b")
def _(t):
    n = lambda c: F.col(c) / F.lit(512.0)
    pad = F.lit(10 / 512)
    return t.ship.select("patch_id", "ship_no", C.inflated(n("x"), n("y"), n("w"), n("h"), pad, pad).alias("q")).select("patch_id", "ship_no", *[F.round(f"q.{c}", 6).alias(c) for c in ("xc", "yc", "w", "h")])


@bound("f16_centred_box", "WITH b AS (SELECT patch_id, ship_no, greatest(1, least(512, round_even(x - w / 2.0, 0)))::INT AS l, greatest(1, least(512, round_even(x + w / 2.0, 0)))::INT AS r, greatest(1, least(512, round_even(y - h / 2.0, 0)))::INT AS t, greatest(1, least(512, round_even(y + h / 2.0, 0)))::INT AS b FROM ship) SELECT patch_id, ship_no, least(l, r) AS l, greatest(l, r) AS r, least(t, b) AS t, greatest(t, b) AS b FROM b")
def _(t):
    box = C.centred_box(F.col("x"), F.col("y"), F.col("w") / 2, F.col("h") / 2)
    return t.ship.select("patch_id", "ship_no", box.alias("q")).select("patch_id", "ship_no", F.col("q.left").alias("l"), F.col("q.right").alias("r"), F.col("q.top").alias("t"), F.col("q.bottom").alias("b"))


@bound("f17_relative_coordinates", "SELECT s.patch_id, ship_no, x + x0 - min(x + x0) OVER (PARTITION BY s.patch_id) + 1 AS sample, y + y0 + swath * 1500 AS line FROM ship s JOIN patch p ON s.patch_id = p.patch_id")
def _(t):
    from pyspark.sql.window import Window

    own = t.ship.join(t.patch, "patch_id").withColumn("s", F.col("x") + F.col("x0"))
    return own.select("patch_id", "ship_no", (F.col("s") - F.min("s").over(Window.partitionBy("patch_id")) + 1).alias("sample"), (F.col("y") + F.col("y0") + F.col("swath") * 1500).alias("line"))


@bound("f18_burst_number", "SELECT patch_id, (y0 // 500)::BIGINT AS first_burst, ((y0 + 511) // 500)::BIGINT AS last_burst, y0 // 500 = (y0 + 511) // 500 AS same FROM patch")
def _(t):
    a, b = F.expr("y0 div 500"), F.expr("(y0 + 511) div 500")
    return t.patch.select("patch_id", a.alias("first_burst"), b.alias("last_burst"), (a == b).alias("same"))


@bound("f22_swath_scaling", "WITH s AS (SELECT patch_id, swath, CASE swath WHEN 1 THEN 1.0 WHEN 2 THEN 1.178571429 ELSE 1.371428571 END AS k, x0 FROM patch) SELECT patch_id, round(x0 * k, 4) AS expected, abs(x0 * k - round_even(x0 * k, 0)) <= 1 AS fits FROM s")
def _(t):
    k = F.create_map(*[F.lit(v) for p in ((1, 1.0), (2, 1.178571429), (3, 1.371428571)) for v in p])[F.col("swath")]
    n = F.col("x0") * k
    return t.patch.select("patch_id", F.round(n, 4).alias("expected"), (F.abs(n - F.rint(n)) <= 1).alias("fits"))


@bound("f23_padded_size", "WITH s AS (SELECT patch_id, patch_id % 50 AS batch, (x0 % 600 + 1) AS w, (y0 % 500 + 1) AS h FROM patch) SELECT patch_id, (ceil(max(w) OVER (PARTITION BY batch) / 32.0) * 32)::BIGINT AS pad_w, (ceil(max(h) OVER (PARTITION BY batch) / 32.0) * 32)::BIGINT AS pad_h, w AS valid_w, h AS valid_h FROM s")
def _(t):
    from pyspark.sql.window import Window

    by = Window.partitionBy(F.col("patch_id") % 50)
    w, h = F.col("x0") % 600 + 1, F.col("y0") % 500 + 1
    return t.patch.select("patch_id", C.ceil_to(F.max(w).over(by), 32).alias("pad_w"), C.ceil_to(F.max(h).over(by), 32).alias("pad_h"), w.alias("valid_w"), h.alias("valid_h"))


@bound("f24_scene_to_image", "SELECT patch_id, greatest(0.0, least(511.0, (x0 - 2000) * 512.0 / 15000)) AS px, greatest(0.0, least(511.0, (y0 - 100) * 512.0 / 1200)) AS py FROM patch")
def _(t):
    at = lambda c, lo, n: C.clip((F.col(c) - lo) * F.lit(512.0) / n, 0.0, 511.0)
    return t.patch.select("patch_id", at("x0", 2000, 15000).alias("px"), at("y0", 100, 1200).alias("py"))


SERIES = "SELECT o_orderkey AS id, concat(' ', CAST(o_custkey AS VARCHAR(9)), '.5 nan 7  inf ', CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '8 9' END) AS a, concat('1 2 3', CASE WHEN o_orderkey % 2 = 0 THEN ' 4' ELSE '' END) AS b FROM orders"


@bound("f25_float_series", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat(o_custkey, '.5/1.0|7.0/2.0|8.0/3.0|9.0/4.0') ELSE concat(o_custkey, '.5/1.0|7.0/2.0|8.0/3.0') END AS pts FROM orders")
def _(t):
    pts = C.paired_series(F.col("a"), F.col("b"))
    return t.sql(SERIES).select("id", F.array_join(F.transform(pts, lambda p: F.concat(p["x"].cast("string"), F.lit("/"), p["y"].cast("string"))), "|").alias("pts"))


@bound("f26_buckets", "WITH v AS (SELECT patch_id, ship_no, unnest([CASE WHEN isnan(xview_km) THEN NULL WHEN xview_km < 5 THEN 'shore_low' WHEN xview_km < 20 THEN 'shore_mid' ELSE 'shore_high' END, CASE WHEN size_m < 50 THEN 'size_low' WHEN size_m < 150 THEN 'size_mid' ELSE 'size_high' END]) AS bucket FROM ship) SELECT bucket, count(*) AS n FROM v WHERE bucket IS NOT NULL GROUP BY bucket")
def _(t):
    return t.ship.select(F.explode(C.buckets(shore=F.col("xview_km"), size=F.col("size_m"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@bound("f30_nested_defaults", "SELECT event_id, coalesce((props->>'$.k')::INT, -1) AS k, coalesce(props->>'$.absent', 'none') AS absent FROM events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("PROPS", "$.absent"), F.lit("none")).alias("absent"))


@bound("f31_cross_field", f"WITH p AS ({PRODUCTS}) SELECT id, starts_with(product, concat(CASE id % 2 WHEN 0 THEN 'S1A' ELSE 'S1B' END, '_')) AND contains(product, '_20200407T052956_20200407T053029_') AND regexp_matches(product, '[DS]V_.*SAFE$') AS ok FROM p")
def _(t):
    p = F.col("product")
    mission = F.when(F.col("id") % 2 == 0, "S1A").otherwise("S1B")
    return t.sql(PRODUCTS).select("id", (p.startswith(F.concat(mission, F.lit("_"))) & p.contains("_20200407T052956_20200407T053029_") & p.rlike("[DS]V_.*SAFE$")).alias("ok"))
