"""A and G: aggregates, scores and gates bound to the driver's tables."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import scoring as G
from .registry import bound

R6 = lambda *names: {n: F.round(n, 6) for n in names}
META = "SELECT patch_id % 5 AS k, CASE patch_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, patch_id, ship_no, CASE WHEN patch_id % 4 = 0 THEN NULL ELSE patch_id % 20 END AS wind, CASE WHEN ship_no % 3 = 0 THEN NULL ELSE size_m END AS length FROM ship"


@bound("a01_ships_per_patch", "SELECT p.patch_id, count(ship_no) AS n_ships, count(ship_no) > 0 AS has_ship FROM patch p LEFT JOIN ship s ON p.patch_id = s.patch_id GROUP BY ALL")
def _(t):
    return A.ships_per_patch(t.patch, t.ship)


@bound("a02_patch_metadata", "SELECT patch_id, arg_min(x, ship_no) AS wind, arg_min(y, ship_no) AS shore, array_to_string(list_sort(list(size_m::INT)), ',') AS lengths, count(*) AS ship_count, round(avg(size_m), 6) AS mean_length FROM ship GROUP BY patch_id")
def _(t):
    own = A.patch_metadata(t.ship, ["x", "y"], "size_m", "ship_no")
    return own.select("patch_id", F.col("x").alias("wind"), F.col("y").alias("shore"), F.array_join(F.transform("vessel_lengths", lambda v: v.cast("int").cast("string")), ",").alias("lengths"), "ship_count", F.round("mean_length", 6).alias("mean_length"))


@bound("a03_coverage", f"SELECT coalesce(split, 'all') AS split, count(DISTINCT patch_id) AS patches, count(*) AS vessels, count(DISTINCT CASE WHEN wind IS NOT NULL THEN patch_id END) AS patches_with_wind, count(DISTINCT CASE WHEN length IS NOT NULL THEN patch_id END) AS patches_with_length, count(length) AS vessels_with_length, count(*) FILTER (length IS NOT NULL AND wind IS NOT NULL) AS vessels_with_both FROM ({META}) GROUP BY ROLLUP (split)")
def _(t):
    return A.coverage(t.sql(META))


HIT = "(NOT isnan(prob) AND prob {op} 0.4)"
COUNTS = f"count(*) FILTER (valid AND {HIT} AND gt) AS tp, count(*) FILTER (valid AND {HIT} AND NOT gt) AS fp, count(*) FILTER (valid AND NOT {HIT} AND gt) AS fn, count(*) FILTER (valid AND NOT {HIT} AND NOT gt) AS tn"


@bound("a04_pooled_scores", f"WITH c AS (SELECT model, {COUNTS.format(op='>')} FROM odd_prediction GROUP BY model) SELECT model, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS dice, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity FROM c")
def _(t):
    return G.pooled_scores(t.odd_prediction, ["model"], 0.4).withColumns(R6("precision", "recall", "iou", "dice", "accuracy", "specificity"))


@bound("a05_smooth_scores", f"WITH c AS (SELECT model, {COUNTS.format(op='>=')}, sum(prob * gt::INT) FILTER (valid) AS py, sum(prob) FILTER (valid) AS p, sum(gt::INT) FILTER (valid) AS y FROM prediction GROUP BY model) SELECT model, tp, fp, fn, tn, round(tp / (tp + fp + 1e-8), 6) AS precision, round(tp / (tp + fn + 1e-8), 6) AS recall, round(tp / (tp + fp + fn + 1e-8), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-8), 6) AS dice, round((2 * py + 1e-8) / (p + y + 1e-8), 6) AS soft_dice FROM c")
def _(t):
    return G.smooth_scores(t.prediction, ["model"], 0.4).withColumns(R6("precision", "recall", "iou", "dice", "soft_dice"))


@bound("a06_macro_scores", f"WITH c AS (SELECT image_id, {COUNTS.format(op='>')} FROM odd_prediction GROUP BY image_id) SELECT image_id % 10 AS k, round(avg((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6)), 6) AS dice, round(avg((tp + 1e-6) / (tp + fp + fn + 1e-6)), 6) AS iou, count(*) AS images FROM c GROUP BY k")
def _(t):
    return G.macro_scores(t.odd_prediction.withColumn("k", F.col("image_id") % 10), ["k"], 0.4).withColumns(R6("dice", "iou"))


@bound("a07_guarded_scores", f"WITH c AS (SELECT model, {COUNTS.format(op='>')} FROM odd_prediction GROUP BY model), s AS (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM c) SELECT model, round(p, 6) AS precision, round(r, 6) AS recall, round(tn / (tn + fp + 1e-8), 6) AS specificity, round(2 * p * r / (p + r + 1e-8), 6) AS f1 FROM s")
def _(t):
    return G.guarded_scores(t.odd_prediction, ["model"], 0.4).select("model", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "f1")])


@bound("a08_threshold_sweep", "WITH g AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) r(i)), c AS (SELECT threshold, count(*) FILTER (NOT isnan(prob) AND prob >= threshold AND gt) AS tp, count(*) FILTER (NOT isnan(prob) AND prob >= threshold AND NOT gt) AS fp, count(*) FILTER ((isnan(prob) OR prob < threshold) AND gt) AS fn FROM odd_prediction CROSS JOIN g WHERE valid GROUP BY threshold), s AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS d FROM c) SELECT threshold, tp, fp, fn, round(d, 6) AS dice, row_number() OVER (ORDER BY d DESC, threshold) = 1 AS best FROM s")
def _(t):
    own = G.threshold_sweep(t.odd_prediction.withColumn("one", F.lit(1)), ["one"], [i / 100 for i in range(1, 100)])
    return own.select("threshold", "tp", "fp", "fn", F.round("dice", 6).alias("dice"), "best")


@bound("a09_imbalance_weight", "WITH c AS (SELECT image_id, count(*) FILTER (valid AND gt) AS pos, count(*) FILTER (valid AND NOT gt) AS neg FROM prediction GROUP BY image_id) SELECT image_id, pos, neg, CASE WHEN pos = 0 OR neg = 0 THEN 1.0 ELSE least(14.0, neg / pos) END::DOUBLE AS weight FROM c")
def _(t):
    return A.imbalance_weight(t.prediction, ["image_id"])


@bound("a10_weight_of_first", "WITH m AS (SELECT event_type AS class, user_id AS name, value * 5 AS v, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS n FROM events) SELECT class, count(*) FILTER (v > 127) AS pos, count(*) AS n, round(CASE WHEN count(*) FILTER (v > 127) = 0 THEN 1.0 ELSE count(*) FILTER (v <= 127) / count(*) FILTER (v > 127) END, 6) AS weight FROM m WHERE n <= 20 GROUP BY class")
def _(t):
    own = t.events.select(F.col("event_type").alias("class"), F.col("user_id").alias("name"), (F.col("value") * 5).alias("value"))
    return A.weight_of_first(own, 20).withColumn("weight", F.round("weight", 6))


def iq(t):
    return t.tile.select("tile_id", "scene", F.slice("embedding", 1, 32).alias("i"), F.slice("embedding", 33, 32).alias("q"))


def components(t):
    return t.tile.select("tile_id", "scene", F.posexplode("embedding").alias("pos", "v")).select("tile_id", "scene", "pos", F.col("v").cast("double").alias("value"))


@bound("a11_dataset_rms", "SELECT round(sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / (count(*) * 32)), 6) AS rms, count(*) * 32 AS samples FROM tile")
def _(t):
    return A.dataset_rms(iq(t)).withColumn("rms", F.round("rms", 6))


@bound("a12_channel_stats", "WITH v AS (SELECT CASE WHEN pos <= 32 THEN 'i' ELSE 'q' END AS channel, x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM tile)) SELECT channel, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n FROM v GROUP BY channel")
def _(t):
    own = components(t).withColumn("channel", F.when(F.col("pos") < 32, "i").otherwise("q"))
    return A.channel_stats(own).withColumns(R6("mean", "std"))


@bound("a13_white_pixels", "WITH v AS (SELECT patch_id % 7 AS scene, patch_id % 70 AS mask, CASE WHEN ship_no % 3 = 0 THEN 255 WHEN ship_no % 4 = 0 THEN 1 ELSE 0 END AS value FROM ship) SELECT scene, mask, greatest(count(*) FILTER (value = 255), count(*) FILTER (value = 1)) AS white, count(*) AS n, round(greatest(count(*) FILTER (value = 255), count(*) FILTER (value = 1)) / count(*), 6) AS ratio FROM v GROUP BY GROUPING SETS ((scene, mask), (scene))")
def _(t):
    no = F.col("ship_no")
    own = t.ship.select((F.col("patch_id") % 7).alias("scene"), (F.col("patch_id") % 70).alias("mask"), F.when(no % 3 == 0, 255).when(no % 4 == 0, 1).otherwise(0).alias("value"))
    return A.white_pixels(own).withColumn("ratio", F.round("ratio", 6))


RESULTS = "SELECT concat('TC', CAST(patch_id % 4 AS VARCHAR(3))) AS test_case, CASE WHEN patch_id % 44 = 1 THEN 'FAIL' WHEN patch_id % 9 = 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM patch"


@bound("a14_validation_summary", f"WITH g AS (SELECT test_case, count(*) FILTER (status = 'PASS') AS ok, count(*) FILTER (status = 'FAIL') AS ko, count(*) FILTER (status = 'WARNING') AS warnings FROM ({RESULTS}) GROUP BY test_case) SELECT *, sum(warnings) OVER (ORDER BY test_case)::BIGINT AS running_warnings, CASE WHEN ko = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN max(ko) OVER () = 0 THEN 'PASS' ELSE 'FAIL' END AS overall FROM g")
def _(t):
    return A.validation_summary(t.sql(RESULTS))


KINDS = "CASE WHEN contains(name, '.dat') THEN 'raw' WHEN contains(name, '.npy') THEN 'mask' WHEN contains(name, '.xml') THEN 'label' ELSE 'l1' END"


@bound("a15_count_rules", f"WITH f AS (SELECT {KINDS} AS kind, folder FROM file), g AS (SELECT count(*) FILTER (kind = 'mask') AS masks, count(*) FILTER (kind = 'label') AS labels, count(*) FILTER (kind = 'raw') AS raw, count(*) FILTER (kind = 'l1') AS l1, count(DISTINCT folder) AS products FROM f) SELECT *, masks = labels AS masks_match, raw = 2 * labels AS raw_match, l1 = 4 * labels AS l1_match, raw + l1 >= 1000 AS enough_images, products >= 10 AS enough_products FROM g")
def _(t):
    return A.count_rules(t.file, F.expr(KINDS), F.col("folder"))


@bound("a16_distinct_products", "SELECT split, count(DISTINCT folder) AS products FROM file GROUP BY split")
def _(t):
    return t.file.groupBy("split").agg(F.countDistinct("folder").alias("products"))


@bound("a17_large_groups", "SELECT stem, count(*) AS n FROM (SELECT regexp_replace(name, '_.*$', '') AS stem FROM file) GROUP BY stem HAVING count(*) >= 3")
def _(t):
    return A.large_groups(t.file.withColumn("stem", F.regexp_replace("name", "_.*$", "")), "stem", 3)


@bound("a18_area_boxes", "SELECT patch_id, min(px) AS min_px, max(px) AS max_px, min(py) AS min_py, max(py) AS max_py FROM patch_polygon GROUP BY patch_id")
def _(t):
    return A.bounds(t.patch_polygon, ["patch_id"], ["px", "py"])


@bound("a19_patch_bounds", "SELECT scene, swath, min(x0) AS min_x0, max(x0) AS max_x0, min(y0) AS min_y0, max(y0) AS max_y0 FROM patch GROUP BY ALL")
def _(t):
    return A.bounds(t.patch, ["scene", "swath"], ["x0", "y0"])


@bound("a20_mean_pulse", "WITH m AS (SELECT user_id % 4 AS stream, event_id % 50 AS sample, avg(value) AS m FROM events GROUP BY ALL) SELECT stream, sample, round(m / sqrt(sum(m * m) OVER (PARTITION BY stream)), 6) AS value FROM m")
def _(t):
    own = t.events.select((F.col("user_id") % 4).alias("stream"), (F.col("event_id") % 50).alias("sample"), "value")
    return A.mean_pulse(own).withColumn("value", F.round("value", 6))


@bound("a21_per_threshold", "SELECT v.t::DOUBLE AS threshold, count(conf) AS n FROM (VALUES (0.1), (0.25), (0.5), (0.9)) v(t) LEFT JOIN odd_detection ON NOT isnan(conf) AND conf >= v.t::DOUBLE GROUP BY v.t")
def _(t):
    return A.per_threshold(t.odd_detection, [0.1, 0.25, 0.5, 0.9])


@bound("a22_latency", "SELECT coalesce(event_type, 'all') AS bucket, round(avg(value), 6) AS ms, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def _(t):
    return A.latency(t.events.select(F.col("event_type").alias("bucket"), F.col("value").alias("ms"))).withColumn("ms", F.round("ms", 6))


@bound("a23_region_background", "WITH b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS n, count(*) OVER (PARTITION BY user_id) AS k FROM events) SELECT user_id, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.9), 9) AS p90, round(avg(value) FILTER (n > floor(k * 0.1) AND n <= k - floor(k * 0.1)), 9) AS trimmed FROM b GROUP BY user_id")
def _(t):
    own = t.events.groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("mean"))
    own = own.join(A.group_quantiles(t.events, ["user_id"], "value", median=0.5, p90=0.9).withColumns({n: F.round(n, 9) for n in ("median", "p90")}), "user_id")
    return own.join(A.background_stat(t.events, ["user_id"], "value", "trimmed_mean").select("user_id", F.round("background", 9).alias("trimmed")), "user_id")


@bound("a23b_large_groups", "WITH b AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS k FROM events) SELECT event_type, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.9), 9) AS p90, round(avg(value) FILTER (n > floor(k * 0.1) AND n <= k - floor(k * 0.1)), 9) AS trimmed FROM b GROUP BY event_type")
def _(t):
    """Few groups of many rows, ordered in ranges."""
    own = A.group_quantiles(t.events, ["event_type"], "value", most=0, median=0.5, p90=0.9).withColumns({n: F.round(n, 9) for n in ("median", "p90")})
    return own.join(A.background_stat(t.events, ["event_type"], "value", "trimmed_mean", most=0).select("event_type", F.round("background", 9).alias("trimmed")), "event_type")


@bound("a24_resource_use", "SELECT event_type, round(avg(value), 6) AS avg_power, max(value) AS peak_power, count(*) AS samples FROM events GROUP BY event_type")
def _(t):
    return A.resource_use(t.events.withColumnRenamed("value", "power"), ["event_type"]).withColumn("avg_power", F.round("avg_power", 6))


@bound("a25_linear_fit", "WITH e AS (SELECT l_suppkey AS g, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL) SELECT g, round(regr_intercept(l_extendedprice, (l_quantity - lo) / (hi - lo)), 2) AS c0, round(regr_slope(l_extendedprice, (l_quantity - lo) / (hi - lo)), 2) AS c1 FROM lineitem JOIN e ON g = l_suppkey GROUP BY g")
def _(t):
    own = A.polynomial_fit(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice", 1)
    return own.select(F.col("l_suppkey").alias("g"), F.round("c0", 2).alias("c0"), F.round("c1", 2).alias("c1"))


def fitted_sql(degree: int) -> str:
    """Values of least-squares polynomials at five places, by orthogonal polynomials; the places are rows of weight 0."""
    steps = ["e AS (SELECT l_suppkey AS g, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL)", "t0 AS (SELECT g, 1 AS w, (l_quantity - lo) / (hi - lo) AS u, l_extendedprice AS y, 0.0::DOUBLE AS q, 1.0::DOUBLE AS p, 0.0::DOUBLE AS f, 1.0::DOUBLE AS m FROM lineitem JOIN e ON g = l_suppkey UNION ALL SELECT g, 0, i / 4.0, 0, 0, 1, 0, 1 FROM e, range(5) r(i))"]
    for k in range(degree + 1):
        steps.append(f"a{k} AS (SELECT g, sum(w * p * p) AS n, sum(w * u * p * p) / sum(w * p * p) AS al, sum(w * y * p) / sum(w * p * p) AS c FROM t{k} GROUP BY g)")
        steps.append(f"t{k + 1} AS (SELECT g, w, u, y, p AS q, (u - al) * p - {'n / m * q' if k else '0'} AS p, f + c * p AS f, n AS m FROM t{k} JOIN a{k} USING (g))")
    return f"WITH {', '.join(steps)} SELECT g, lo::DOUBLE AS lo, hi::DOUBLE AS hi, " + ", ".join(f"round(sum(f) FILTER (w = 0 AND u = {i / 4}), 2) AS f{i}" for i in range(5)) + f" FROM t{degree + 1} JOIN e USING (g) GROUP BY g, lo, hi"


@bound("a25b_polynomial_fit", fitted_sql(4))
def _(t):
    own = A.polynomial_fit(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice", 4)
    at = lambda u: sum((F.col(f"c{k}") * u**k for k in range(1, 5)), F.col("c0"))
    return own.select(F.col("l_suppkey").alias("g"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), *[F.round(at(i / 4), 2).alias(f"f{i}") for i in range(5)])


@bound("a26_tile_profile", "SELECT vec_id AS tile_id, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def _(t):
    return A.profile(components(t), ["tile_id"], "value").withColumns(R6("min", "max", "mean", "std"))


@bound("a27_version_difference", "WITH v AS (SELECT vec_id AS tile_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), d AS (SELECT tile_id, abs(x - x * (1 + (p - 1) % 3) / 2.0) AS d FROM v) SELECT tile_id, round(avg(d), 6) AS l1, round(sqrt(avg(d * d)), 6) AS l2, round(max(d), 6) AS linf FROM d GROUP BY tile_id")
def _(t):
    a = components(t)
    b = a.withColumn("value", F.col("value") * (1 + F.col("pos") % 3) / 2.0)
    return A.version_difference(a, b, ["tile_id", "pos"], "value").withColumns(R6("l1", "l2", "linf"))


@bound("a28_run_summary", f"WITH f AS (SELECT folder AS scene, {KINDS} AS kind FROM file), s AS (SELECT DISTINCT folder AS scene FROM file), g AS (SELECT s.scene, count(*) FILTER (kind = 'raw') AS raw, count(*) FILTER (kind = 'mask') AS mask, count(*) FILTER (kind = 'label') AS label FROM s LEFT JOIN f ON f.scene = s.scene AND s.scene <> 'src3' GROUP BY s.scene), h AS (SELECT *, nullif(concat_ws('; ', CASE WHEN raw = 0 THEN 'no raw' END, CASE WHEN mask = 0 THEN 'no mask' END, CASE WHEN label = 0 THEN 'no label' END), '') AS reason FROM g) SELECT *, CASE WHEN count(reason) OVER () > 0 THEN 'FAIL' ELSE 'PASS' END AS run FROM h")
def _(t):
    out = t.file.select(F.col("folder").alias("scene"), F.expr(KINDS).alias("kind")).where("scene <> 'src3'")
    return A.run_summary(out, t.file.select(F.col("folder").alias("scene")).distinct(), ["raw", "mask", "label"])


# detection scores and gates

IMAGE_BUCKETS = "SELECT DISTINCT image_id, concat('b', CAST(image_id % 6 AS VARCHAR(3))) AS bucket FROM prediction"


@bound("g01_bucketed_scores", f"WITH b AS ({IMAGE_BUCKETS}), u AS (SELECT bucket, prob, gt, valid FROM odd_prediction JOIN b USING (image_id) UNION ALL SELECT 'all', prob, gt, valid FROM odd_prediction), c AS (SELECT bucket, {COUNTS.format(op='>')} FROM u GROUP BY bucket) SELECT bucket, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c")
def _(t):
    return G.bucketed_scores(t.odd_prediction, t.sql(IMAGE_BUCKETS), 0.4).select("bucket", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


IOUS = "WITH m AS (SELECT d.image_id, det_no, conf, gt_no, greatest(0, least(d.x + d.w / 2, g.x + g.w / 2) - greatest(d.x - d.w / 2, g.x - g.w / 2)) * greatest(0, least(d.y + d.h / 2, g.y + g.h / 2) - greatest(d.y - d.h / 2, g.y - g.h / 2)) AS i, d.w * d.h + g.w * g.h AS s FROM detection d JOIN gt_box g USING (image_id)), b AS (SELECT *, i / (s - i) AS iou FROM m QUALIFY row_number() OVER (PARTITION BY image_id, det_no ORDER BY i / (s - i) DESC, gt_no) = 1), a AS (SELECT t.t::DOUBLE AS threshold, * EXCLUDE (t) FROM b CROSS JOIN (VALUES (0.5), (0.75)) t(t) WHERE iou >= t.t::DOUBLE), w AS (SELECT threshold, image_id, det_no, true AS hit FROM a QUALIFY row_number() OVER (PARTITION BY threshold, image_id, gt_no ORDER BY conf DESC, det_no) = 1), e AS (SELECT image_id, det_no, conf, t.t::DOUBLE AS threshold FROM detection CROSS JOIN (VALUES (0.5), (0.75)) t(t))"


@bound("g02_box_match", IOUS + " SELECT threshold, image_id, det_no, coalesce(hit, false) AS hit FROM e LEFT JOIN w USING (threshold, image_id, det_no)")
def _(t):
    return G.match_boxes(t.detection, t.gt_box, [0.5, 0.75]).select("threshold", "image_id", "det_no", "hit")


@bound("g02b_average_precision", IOUS + ", h AS (SELECT threshold, conf AS c, count(*) FILTER (hit) AS tp, count(*) AS n FROM e LEFT JOIN w USING (threshold, image_id, det_no) GROUP BY ALL), k AS (SELECT *, sum(tp) OVER (PARTITION BY threshold ORDER BY c DESC) AS ctp, sum(n) OVER (PARTITION BY threshold ORDER BY c DESC) AS cn, (SELECT count(*) FROM gt_box) AS gts FROM h) SELECT threshold, round(max(ctp) / max(cn), 6) AS precision, round(max(ctp) / max(gts), 6) AS recall, round(sum(tp / gts * ctp / cn), 6) AS ap FROM k GROUP BY threshold")
def _(t):
    matched = G.match_boxes(t.detection, t.gt_box, [0.5, 0.75])
    return G.average_precision(matched, F.lit(t.gt_box.count())).withColumns(R6("precision", "recall", "ap"))


METRICS = "SELECT 'm' || CAST(model % 4 AS VARCHAR(3)) AS metric, avg(CASE WHEN model % 4 = 3 THEN CAST('NaN' AS DOUBLE) ELSE prob END) AS value FROM prediction GROUP BY 1"
GATES = "SELECT 'm' || CAST(v.i AS VARCHAR(3)) AS metric, CAST(v.e AS DOUBLE) AS expected FROM (VALUES (0, 0.3), (1, 0.52), (2, 0.9), (3, 0.1), (7, 0.5)) AS v(i, e)"


@bound("g03_tolerance_gate", f"WITH m AS ({METRICS}), g AS ({GATES}) SELECT metric, expected, round(value, 6) AS value, CASE WHEN isnan(value) THEN 'FAIL' WHEN value >= expected THEN 'PASS' WHEN value >= expected - 0.05 THEN 'ALMOST_PASS' ELSE 'FAIL' END AS verdict FROM g LEFT JOIN m USING (metric)")
def _(t):
    return G.tolerance_gate(t.sql(METRICS), t.sql(GATES)).select("metric", "expected", F.round("value", 6).alias("value"), "verdict")


@bound("g04_degradation_gate", f"WITH b AS ({IMAGE_BUCKETS}), u AS (SELECT bucket, prob, gt, valid FROM odd_prediction JOIN b USING (image_id) UNION ALL SELECT 'all', prob, gt, valid FROM odd_prediction), c AS (SELECT bucket, {COUNTS.format(op='>')} FROM u GROUP BY bucket), p AS (SELECT bucket, tp / (tp + fp) AS precision FROM c), a AS (SELECT precision AS general FROM p WHERE bucket = 'all') SELECT bucket, round(general - precision, 6) AS drop, CASE WHEN general - precision <= 0.0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p, a WHERE bucket <> 'all'")
def _(t):
    own = G.bucketed_scores(t.odd_prediction, t.sql(IMAGE_BUCKETS), 0.4)
    return G.degradation_gate(own, most=0.0).select("bucket", F.round("drop", 6).alias("drop"), "verdict")


RUNS = "SELECT user_id AS run, sum(value) AS total, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN NULL ELSE avg(value) END AS second FROM events GROUP BY user_id"


@bound("g05_swath_time", f"SELECT run, round(total / greatest(n, 1) * 120, 4) AS seconds, CASE WHEN total / greatest(n, 1) * 120 < 1200 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({RUNS})")
def _(t):
    v = G.swath_time(F.col("total"), F.col("n"), 120)
    return t.sql(RUNS).select("run", F.round(v, 4).alias("seconds"), G.limit_gate(v, 1200).alias("verdict"))


@bound("g06_area_latency", f"SELECT run, round(total / greatest(n * 28.1, 1e-9) * 100, 4) AS seconds, CASE WHEN total / greatest(n * 28.1, 1e-9) * 100 < 30 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({RUNS})")
def _(t):
    v = G.area_latency(F.col("total"), F.col("n"), 28.1)
    return t.sql(RUNS).select("run", F.round(v, 4).alias("seconds"), G.limit_gate(v, 30).alias("verdict"))


@bound("g07_batch_gate", "SELECT event_type, CASE WHEN count(*) FILTER (value > 1) > 0 AND count(*) FILTER (value <= 0.01) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events GROUP BY event_type")
def _(t):
    own = t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 1).alias("a"), F.count_if(F.col("value") <= 0.01).alias("b"))
    return own.select("event_type", G.batch_gate(F.col("a"), F.col("b")).alias("verdict"))


@bound("g08_memory_gate", "SELECT user_id, max(value) AS peak, CASE WHEN max(value) <= 60 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events GROUP BY user_id")
def _(t):
    own = t.events.groupBy("user_id").agg(F.max("value").alias("peak"))
    return own.withColumn("verdict", F.when(F.col("peak") <= 60, "PASS").otherwise("FAIL"))


@bound("g09_completeness", "WITH m AS (SELECT DISTINCT user_id AS model, event_type AS metric FROM events WHERE value > 30), w AS (SELECT model, r.metric FROM (SELECT DISTINCT user_id AS model FROM events) CROSS JOIN (VALUES ('click'), ('error'), ('view')) r(metric)) SELECT model, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (NOT EXISTS (SELECT 1 FROM m WHERE m.model = w.model AND m.metric = w.metric)), '') AS missing, CASE WHEN count(*) FILTER (NOT EXISTS (SELECT 1 FROM m WHERE m.model = w.model AND m.metric = w.metric)) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM w GROUP BY model")
def _(t):
    have = t.events.where("value > 30").select(F.col("user_id").alias("model"), F.col("event_type").alias("metric")).distinct()
    return G.completeness(have, t.events.select(F.col("user_id").alias("model")).distinct(), ["click", "error", "view"])


@bound("g10_average_latency", f"SELECT run, round((total + second) / greatest(n, 1), 6) AS latency, CASE WHEN (total + second) / greatest(n, 1) <= 10 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({RUNS})")
def _(t):
    value, verdict = G.average_latency(F.col("total"), F.col("second"), F.col("n"), 10)
    return t.sql(RUNS).select("run", F.round(value, 6).alias("latency"), verdict.alias("verdict"))
