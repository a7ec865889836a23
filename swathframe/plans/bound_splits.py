"""T and U: sorting, sampling, splitting and set operations bound to the driver's tables."""

from pyspark.sql import functions as F

from ..functions.columns import natural_key
from ..operators import splits as T
from ..operators.ranges import range_ranked
from .registry import bound

SPLIT = "CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split"


def hashed(key: str, source: str, seed: int = 42, within: str = "") -> str:
    by = f"PARTITION BY {within} " if within else ""
    cols = f"{within}, {key}" if within else key
    return f"(SELECT {cols}, row_number() OVER ({by}ORDER BY md5(concat('{seed}', {key}))) AS rn, count(*) OVER ({by}) AS n FROM (SELECT DISTINCT {cols} FROM {source}))"


@bound("t01_natural_order", "SELECT name, row_number() OVER (ORDER BY a, lpad(b, 20, '0'), c) AS place FROM (SELECT DISTINCT concat(source, '.xml') AS name, regexp_extract(source, '^\\D*', 0) AS a, regexp_extract(source, '\\d+', 0) AS b, '' AS c FROM documents)")
def _(t):
    names = t.documents.select(F.concat("source", F.lit(".xml")).alias("name")).distinct()
    keyed = names.withColumn("key", natural_key(F.col("name"))).withColumn("all", F.lit(1))
    return range_ranked(keyed, "all", "key", "name").select("name", F.col("rn").cast("bigint").alias("place"))


@bound("t02_scene_split", f"SELECT scene, {SPLIT} FROM {hashed('scene', 'patch')}")
def _(t):
    return T.split_keys(t.patch, "scene")


@bound("t03_id_split", f"SELECT o_orderkey, {SPLIT} FROM {hashed('o_orderkey', 'orders')}")
def _(t):
    return T.split_keys(t.orders, "o_orderkey")


@bound("t04_stratified_split", f"SELECT toxic, doc_id, {SPLIT.replace('0.15', '0.2')} FROM {hashed('doc_id', 'labels', within='toxic')}")
def _(t):
    return T.split_keys(t.labels, "doc_id", (0.7, 0.2), within=["toxic"])


@bound("t05_hold_out", f"SELECT doc_id, CASE WHEN rn <= floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM {hashed('doc_id', 'labels', 7)}")
def _(t):
    return T.hold_out(t.labels, "doc_id", 0.2, 7)


@bound("t06_balanced", "WITH m AS (SELECT min(k) AS least FROM (SELECT count(*) AS k FROM labels GROUP BY toxic)) SELECT toxic, doc_id FROM (SELECT toxic, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS n FROM labels), m WHERE n <= least")
def _(t):
    return T.balanced(t.labels, "toxic", "doc_id").select("toxic", "doc_id")


@bound("t07_sampled_targets", "WITH c AS (SELECT product_id FROM product ORDER BY md5(concat('3', product_id)), product_id LIMIT 20) SELECT product_id, gx, gy FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY md5(concat('3', product_id, '/', gx, '/', gy))) AS n FROM grid_point JOIN c USING (product_id)) WHERE n = 1")
def _(t):
    return T.sampled_targets(t.product, t.grid_point, 20, 3).select("product_id", "gx", "gy")


@bound("t08_first_files", "SELECT name FROM file ORDER BY name LIMIT 25")
def _(t):
    return t.file.select("name").orderBy("name").limit(25)


@bound("t09_sorted_times", "SELECT product_id, start_ts FROM product ORDER BY start_ts, product_id")
def _(t):
    return t.product.select("product_id", "start_ts").orderBy("start_ts", "product_id")


ASSIGNED = "SELECT source AS scene, CASE WHEN doc_id % 97 = 0 THEN 'test' WHEN doc_id % 2 = 0 AND source IN ('src1', 'src2') THEN 'val' ELSE 'train' END AS split, doc_id FROM documents"


@bound("u01_scene_leakage", f"SELECT scene, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM ({ASSIGNED}) GROUP BY scene HAVING count(DISTINCT split) > 1")
def _(t):
    return T.leakage(t.sql(ASSIGNED))


@bound("u01b_split_is_clean", f"WITH s AS (SELECT scene, {SPLIT} FROM {hashed('scene', 'patch')}), l AS (SELECT scene FROM patch JOIN s USING (scene) GROUP BY scene HAVING count(DISTINCT split) > 1) SELECT count(*)::BIGINT AS leaking, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM l")
def _(t):
    return T.leakage_verdict(t.patch.join(T.split_keys(t.patch, "scene"), "scene"))


@bound("u02_mask_union", "SELECT tile_id, r, c, max(l) AS label FROM (SELECT tile_id, r, c, is_mask::INT AS l FROM pixel_mask UNION ALL SELECT tile_id, r, c, (power > 90)::INT FROM pixel_mask) GROUP BY ALL")
def _(t):
    p = t.pixel_mask
    keys = ["tile_id", "r", "c"]
    return T.mask_union(p.select(*keys, F.col("is_mask").cast("int").alias("label")), p.select(*keys, (F.col("power") > 90).cast("int").alias("label")))


@bound("u03_swath_union", "SELECT swath, patch_id, x0, y0 FROM patch WHERE swath = 1 UNION ALL SELECT swath, patch_id, x0, y0 FROM patch WHERE swath = 2")
def _(t):
    cols = ["swath", "patch_id", "x0", "y0"]
    return t.patch.where("swath = 1").select(*cols).unionByName(t.patch.where("swath = 2").select(*cols))


@bound("u04_missing_files", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id").distinct()).distinct()


@bound("u05_allow_union", "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0")
def _(t):
    return t.labels.where("toxic = 1").select("doc_id").union(t.labels.where("quality = 0").select("doc_id")).distinct()


@bound("u06_sample_union", "SELECT doc_id, 1 AS positive FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 0 FROM labels WHERE toxic = 0")
def _(t):
    return t.labels.where("toxic = 1").select("doc_id", F.lit(1).alias("positive")).union(t.labels.where("toxic = 0").select("doc_id", F.lit(0).alias("positive")))


@bound("s15_membership_report", f"SELECT split, scene, doc_id AS name, count(*) OVER (PARTITION BY split, scene) AS n FROM ({ASSIGNED})")
def _(t):
    return T.membership(t.sql(ASSIGNED), "doc_id")


@bound("s17_split_manifest", f"WITH s AS (SELECT scene, {SPLIT} FROM {hashed('scene', '(SELECT folder AS scene FROM file)')}) SELECT split, pol AS kind, path AS src, concat('dataset/', split, '/', pol, '/', doc_id) AS dst FROM (SELECT source AS scene, pol, path, doc_id FROM tile_file) JOIN s USING (scene)")
def _(t):
    files = t.tile_file.select(F.col("source").alias("scene"), F.col("pol").alias("kind"), "path")
    return T.manifest(files, T.split_keys(t.file.select(F.col("folder").alias("scene")), "scene"))
