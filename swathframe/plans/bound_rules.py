"""V: label rules over labels made of orders and line items, with faults planted by key."""

from pyspark.sql import functions as F

from ..rules import checks  # noqa: F401
from ..rules.checks import missing_inputs
from ..rules.registry import opaque, validate
from .bindings import CTE
from .registry import bound

CTE["label_text"] = """SELECT patch_id, CAST(patch_id AS VARCHAR(20)) AS file,
 CASE WHEN patch_id % 17 = 0 THEN 'bad id' WHEN patch_id % 17 = 1 THEN NULL ELSE concat('DB_SAR_DVD_', CAST(patch_id % 12000 AS VARCHAR(20))) END AS scene_id,
 concat('FD_', CAST(patch_id % 130 AS VARCHAR(20)), '_', CAST(patch_id % 70000 AS VARCHAR(20))) AS flood_id, concat('TS_', CAST(patch_id % 13 * 10 AS VARCHAR(20))) AS series_id,
 CASE patch_id % 17 WHEN 2 THEN '20301301' WHEN 3 THEN 'x' ELSE '20200407' END AS "date", CASE patch_id % 19 WHEN 3 THEN '-1' WHEN 4 THEN '1.5' ELSE '2' END AS version, CASE WHEN patch_id % 23 = 4 THEN 'Other' ELSE 'DarkVesselDetection' END AS case_study,
 CASE patch_id % 5 WHEN 0 THEN 'S1A' WHEN 1 THEN 'S1B' WHEN 2 THEN 'S1C' WHEN 3 THEN 'S1A' ELSE 'S2A' END AS mission,
 CASE patch_id % 13 WHEN 0 THEN '20130407_052956' WHEN 1 THEN 'never' WHEN 2 THEN '20200407_063029' ELSE '20200407_052956' END AS start, '20200407_053029' AS stop,
 concat('S1A_IW_SLC__1SDV_20200407T052956_20200407T053029_0320', CAST(patch_id % 9 AS VARCHAR(3)), '7_03B2E2_', CASE WHEN patch_id % 7 = 0 THEN 'xyz' ELSE 'A1F2' END, '.SAFE') AS product,
 CASE patch_id % 6 WHEN 4 THEN 'two' WHEN 5 THEN '4' ELSE CAST(swath AS VARCHAR(3)) END AS swath,
 CASE patch_id % 11 WHEN 0 THEN '10 11 12' WHEN 1 THEN '10 nan 12 13' WHEN 2 THEN '10 95 12 13' WHEN 3 THEN '10 x 12 13' ELSE ' 10.5 11 12 13 ' END AS latitude, CASE WHEN patch_id % 29 = 0 THEN NULL ELSE '20 21 22 -180' END AS longitude,
 CASE patch_id % 10 WHEN 0 THEN '16 480 481 16' WHEN 1 THEN '16 480 480 17' WHEN 2 THEN '16 4.5 4.5 16' ELSE '16 480 480 16' END AS scene_sample, CASE WHEN patch_id % 10 = 3 THEN '16 17 480 480' ELSE '16 16 480 480' END AS scene_line,
 CASE patch_id % 8 WHEN 0 THEN '1 2 3 4 5' WHEN 1 THEN '1 2 3 1' ELSE '1 2 3 4 1' END AS ring,
 CASE patch_id % 9 WHEN 0 THEN 'NaN' WHEN 1 THEN '361' WHEN 2 THEN 'x' ELSE '180' END AS wind_direction, CASE patch_id % 14 WHEN 0 THEN '-1' WHEN 1 THEN NULL ELSE '3.5' END AS wind_speed,
 CASE patch_id % 4 WHEN 3 THEN '2' WHEN 2 THEN 'x' ELSE CAST(patch_id % 4 AS VARCHAR(3)) END AS rfi FROM patch"""
CTE["label_ship"] = "SELECT patch_id, ship_no, CASE WHEN patch_id % 19 = 5 AND ship_no = 2 THEN 'Ship_1' ELSE concat('Ship_', CAST(ship_no AS VARCHAR(9))) END AS name, CASE WHEN patch_id % 23 = 0 THEN 'nan' ELSE CAST(y AS VARCHAR(9)) END AS top, CAST(x AS VARCHAR(9)) AS \"left\", CASE WHEN patch_id % 29 = 0 THEN '1' ELSE CAST(y + h AS VARCHAR(9)) END AS bottom, CASE WHEN patch_id % 31 = 0 THEN NULL ELSE CAST(x + w AS VARCHAR(9)) END AS \"right\", CASE WHEN patch_id % 23 = 1 THEN 'NaN' WHEN patch_id % 23 = 2 THEN 'big' ELSE CAST(CAST(size_m * 3 AS BIGINT) AS VARCHAR(9)) END AS size FROM ship"
for _name in ("label_text", "label_ship"):  # both engines read unquoted names
    CTE[_name] = CTE[_name].replace('AS "date"', "AS date").replace('AS "left"', "AS box_left").replace('AS "right"', "AS box_right").replace("AS top,", "AS box_top,").replace("AS bottom,", "AS box_bottom,")
CTE["label_event"] = "SELECT patch_id, ship_no, concat(CASE ship_no % 3 WHEN 0 THEN 'WaterBody_' WHEN 1 THEN 'FloodEvent_' ELSE CASE WHEN patch_id % 37 = 0 THEN 'Other_' ELSE 'FloodEvent_' END END, CAST(ship_no AS VARCHAR(9))) AS name, CASE WHEN patch_id % 41 = 0 THEN '1 nan 91' ELSE '1 nan 3' END AS lat, CASE patch_id % 43 WHEN 0 THEN '1 2' WHEN 1 THEN '1 2 181' ELSE '1 2 3' END AS lon FROM ship WHERE ship_no <= 3"


def labels(t):
    ships = t.label_ship.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("ship_no", "name", F.col("box_top").alias("top"), F.col("box_left").alias("left"), F.col("box_bottom").alias("bottom"), F.col("box_right").alias("right"), "size", F.col("box_left").alias("x"), F.col("box_top").alias("y")))).alias("ships"))
    events = t.label_event.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("ship_no", "name", "lat", "lon"))).alias("events"))
    none = F.array().cast(ships.schema["ships"].dataType)
    own = t.label_text.join(ships, "patch_id", "left").join(events, "patch_id", "left").withColumn("ships", F.coalesce("ships", none))
    count = lambda c, k: F.when(F.col("patch_id") % k == 6, F.coalesce(F.size(c), F.lit(0)) + 1).otherwise(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))).cast("string")
    return own.withColumn("n_ships", count("ships", 19)).withColumn("n_events", count("events", 47))


COUNTED = """n AS (SELECT t.patch_id, count(s.ship_no) AS k FROM label_text t LEFT JOIN label_ship s USING (patch_id) GROUP BY ALL), m AS (SELECT patch_id, k, CASE WHEN patch_id % 19 = 6 THEN k + 1 ELSE k END AS told FROM n)"""


def status(fails: str, warns: str = "false", source: str = "label_text", head: str = "") -> str:
    return f"{head}SELECT patch_id::VARCHAR AS file, CASE WHEN coalesce({fails}, false) THEN 'FAIL' WHEN coalesce({warns}, false) THEN 'WARNING' ELSE 'PASS' END AS status FROM {source}"


def whole(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^[+-]?\\d+$') THEN TRY_CAST(trim({c}) AS BIGINT) END"


def run(t, *names):
    return validate(labels(t), list(names)).select("file", "status")


def series(c: str, count: int, most: float, least: float | None = None) -> str:
    v = f"list_transform(list_filter(string_split_regex(trim({c}), '\\s+'), lambda x: x <> ''), lambda x: TRY_CAST(x AS DOUBLE))"
    return f"({c} IS NULL OR len({v}) <> {count} OR len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR x > {most} OR x < {-most if least is None else least})) > 0)"


PER_SHIP = "WITH b AS (SELECT patch_id, bool_or({bad}) AS bad, bool_or({warn}) AS warn FROM label_ship GROUP BY patch_id), " + COUNTED + ", j AS (SELECT * FROM m LEFT JOIN b USING (patch_id)) "
OUT = lambda c, null="true": f"CASE WHEN {c} IS NULL THEN {null} WHEN lower(trim({c})) = 'nan' THEN false ELSE coalesce(({whole(c)}) NOT BETWEEN 1 AND 512, true) END"

CASES = {
    "v01_scene_id": status("scene_id IS NULL OR NOT regexp_matches(scene_id, '^DB_[A-Z]+_(DVD|VD|RFI)_\\d{1,4}$') OR patch_id % 12000 NOT BETWEEN 1 AND 9999"),
    "v01b_flood_scene_id": status("patch_id % 130 > 100 OR patch_id % 70000 NOT BETWEEN 1 AND 60000"),
    "v02_date_version": status("patch_id % 17 IN (2, 3) OR patch_id % 19 IN (3, 4) OR patch_id % 23 = 4"),
    "v03_series_id": status("patch_id % 130 <> patch_id % 13 * 10"),
    "v04_mission_times": status("patch_id % 5 = 4 OR patch_id % 13 IN (0, 1, 2)"),
    "v05_product_name": status("mission <> 'S1A' OR patch_id % 13 IN (0, 1, 2) OR patch_id % 7 = 0"),
    "v06_swath": status("patch_id % 6 IN (4, 5)"),
    "v07_corners": status(f"{series('latitude', 4, 90)} OR {series('longitude', 4, 180)} OR patch_id % 10 IN (0, 1, 2, 3)"),
    "v07b_closed_corners": status("patch_id % 8 IN (0, 1)"),
    "v08_wind": status("patch_id % 9 = 2 OR patch_id % 14 = 1", "patch_id % 9 = 1 OR patch_id % 14 = 0"),
    "v09_ship_count": status("told <> k", source="m", head=f"WITH {COUNTED} "),
    "v10_ship_names": status("patch_id % 19 = 5 AND k >= 2", source="m", head=f"WITH {COUNTED} "),
    "v11_centroids": status("bad OR told <> k", source="j", head=PER_SHIP.format(bad="lower(box_top) <> 'nan' AND coalesce(TRY_CAST(box_top AS DOUBLE) NOT BETWEEN 1 AND 512, true)", warn="false")),
    "v12_boxes": status("bad", source="j", head=PER_SHIP.format(bad=" OR ".join([OUT("box_top"), OUT("box_left"), OUT("box_bottom"), OUT("box_right"), f"coalesce(({whole('box_top')}) > ({whole('box_bottom')}), false)", f"coalesce(({whole('box_left')}) > ({whole('box_right')}), false)"]), warn="false")),
    "v13_sizes": status("bad", "warn", source="j", head=PER_SHIP.format(bad="lower(size) <> 'nan' AND TRY_CAST(size AS DOUBLE) IS NULL", warn="lower(size) <> 'nan' AND coalesce(TRY_CAST(size AS DOUBLE) NOT BETWEEN 1 AND 1000, false)")),
    "v14_rfi_flag": status("patch_id % 4 IN (2, 3)"),
    "v15_event_count": status("patch_id % 47 = 6"),
    "v16_event_series": status("bad", source="j", head="WITH b AS (SELECT patch_id, bool_or(patch_id % 41 = 0 OR patch_id % 43 IN (0, 1)) AS bad FROM label_event GROUP BY patch_id), j AS (SELECT patch_id, bad FROM label_text LEFT JOIN b USING (patch_id)) "),
    "v17_event_names": status("bad", source="j", head="WITH b AS (SELECT patch_id, bool_or(NOT regexp_matches(name, '^(FloodEvent|WaterBody)_\\d+$')) AS bad FROM label_event GROUP BY patch_id), j AS (SELECT patch_id, bad FROM label_text LEFT JOIN b USING (patch_id)) "),
}
for _name, _sql in CASES.items():
    bound(_name, _sql)(lambda t, n=_name: run(t, n))

FILE_STATUS = "SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN {bad} THEN 'FAIL' ELSE 'PASS' END AS status FROM file"


def of_files(t, name):
    own = t.file.withColumn("file", F.col("doc_id").cast("string")).withColumn("kind", F.when(F.col("name").contains("slc"), "slc").otherwise("raw"))
    return validate(own.withColumn("width", 508 + F.col("bytes") % 9).withColumn("height", F.lit(512)), [name]).select("file", "status")


FILES = {
    "v18_file_name": "NOT regexp_matches(name, '^s1a-iw-(raw-s-v[vh]|slc)-\\d{8}t\\d{6}-\\d{8}t\\d{6}-\\d{6}-[0-9a-f]{6}-IW[1-3]-(RFI|VD)_\\d+') OR coalesce(TRY_CAST(regexp_extract(name, '_(\\d+)(?:_scaled)?\\.[a-z]+$', 1) AS BIGINT) NOT BETWEEN 1 AND 9999, true)",
    "v19_image_size": "contains(name, 'slc') AND abs(508 + bytes % 9 - 512) > 1",
    "v20_product_token": "NOT regexp_matches(upper(name), 'SLC|GRD')",
    "v21_raw_extension": "contains(name, '-raw-') AND NOT ends_with(name, '.dat')",
}
for _name, _bad in FILES.items():
    bound(_name, FILE_STATUS.format(bad=_bad))(lambda t, n=_name: of_files(t, n))


@bound("v22_required_inputs", "SELECT source AS scene, string_agg(concat('masks/', doc_id, '.png'), ',' ORDER BY concat('masks/', doc_id, '.png')) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def _(t):
    required = t.documents.select(F.col("source").alias("scene"), F.concat(F.lit("masks/"), "doc_id", F.lit(".png")).alias("path"))
    return missing_inputs(required, t.mask_file).select("scene", F.array_join("missing", ",").alias("missing"))


@bound("x01_rule_registry", "SELECT patch_id::VARCHAR AS file, CASE WHEN patch_id % 6 IN (4, 5) THEN 'FAIL' ELSE 'PASS' END AS status FROM patch")
def _(t):
    def check(row):
        return {} if row["swath"] in ("1", "2", "3") else {"missing": ["SLCSwath"]}

    return validate(t.label_text, rules={"own": opaque(check, ["swath"])}).select("file", "status")


def written_results(t):
    """Results of a rule, a row a file, written as CSV and read back."""
    from ..sources.files import round_trip_csv

    return round_trip_csv(validate(labels(t), ["v06_swath"]).select("test_case", "file", "status", F.array_join("missing", ";").alias("missing")))


@bound("s12_validation_results", "SELECT 'v06_swath' AS test_case, patch_id::VARCHAR AS file, CASE WHEN patch_id % 6 IN (4, 5) THEN 'FAIL' ELSE 'PASS' END AS status FROM patch")
def _(t):
    return written_results(t).select("test_case", "file", "status")


@bound("s12b_validation_summary", "SELECT 'v06_swath' AS test_case, count(*) FILTER (patch_id % 6 NOT IN (4, 5)) AS ok, count(*) FILTER (patch_id % 6 IN (4, 5)) AS ko FROM patch")
def _(t):
    return written_results(t).groupBy("test_case").agg(F.count_if(F.col("status") == "PASS").alias("ok"), F.count_if(F.col("status") == "FAIL").alias("ko"))
