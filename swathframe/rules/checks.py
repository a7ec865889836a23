"""The rules. Texts come as strings, as labels hold them; NaN is ignored or refused as each rule says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import parse_stamp, polarisation
from .registry import issues, rule

say = lambda bad, text: F.when(bad, F.lit(text))
known = lambda c: F.coalesce(c, F.lit(False))
whole = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))
nan = lambda c: F.lower(F.trim(c)) == "nan"


def ranged_id(c: Column, pattern: str, lo: int, hi: int, name: str) -> list[Column]:
    number = F.regexp_extract(c, pattern, 1).try_cast("bigint")
    return [say(c.isNull(), f"{name} missing"), say(c.isNotNull() & ~c.rlike(pattern), f"{name} format"), say(c.rlike(pattern) & ~known(number.between(lo, hi)), f"{name} range")]


def whole_in(c: Column, lo: int | None, hi: int | None, name: str) -> list[Column]:
    n = whole(c)
    out = (n < lo) if lo is not None else F.lit(False)
    out = out | (n > hi) if hi is not None else out
    return [say(c.isNull(), f"{name} missing"), say(c.isNotNull() & n.isNull(), f"{name} not an integer"), say(known(out), f"{name} range")]


@rule("v01_scene_id")
def _():
    return issues(*ranged_id(F.col("scene_id"), r"^DB_[A-Z]+_(?:DVD|VD|RFI)_(\d{1,4})$", 1, 9999, "Scene_ID"))


@rule("v01b_flood_scene_id")
def _():
    c, pattern = F.col("flood_id"), r"^FD_(\d{1,3})_(\d{1,5})$"
    a, b = (F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2))
    return issues(say(c.isNull(), "Scene_ID missing"), say(c.isNotNull() & ~c.rlike(pattern), "Scene_ID format"), say(c.rlike(pattern) & ~(known(a.between(0, 100)) & known(b.between(1, 60000))), "Scene_ID range"))


@rule("v02_date_version")
def _():
    case = F.col("case_study")
    return issues(*whole_in(F.col("date"), 20000101, 20251231, "Date"), *whole_in(F.col("version"), 0, None, "Version"), say(~known(case == "DarkVesselDetection"), "CaseStudy"))


@rule("v03_series_id")
def _():
    scene, series = F.regexp_extract("flood_id", r"^FD_(\d+)_", 1), F.regexp_extract("series_id", r"^TS_(\d+)$", 1)
    return issues(say((series == "") | (scene != series), "TimeSeries_ID"))


@rule("v04_mission_times")
def _():
    a, b = parse_stamp(F.col("start")), parse_stamp(F.col("stop"))
    lo, hi = F.lit("2014-04-03").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")
    return issues(say(~known(F.col("mission").isin("S1A", "S1B", "S1C")), "SAR_Mission"), say(a.isNull(), "Start format"), say(b.isNull(), "Stop format"), say(known((a < lo) | (b > hi)), "Time range"), say(known(a >= b), "Start after Stop"))


@rule("v05_product_name")
def _():
    stamp = lambda c: F.replace(F.col(c), F.lit("_"), F.lit("T"))
    head = F.concat("mission", F.lit("_IW_SLC__1SDV_"), stamp("start"), F.lit("_"), stamp("stop"), F.lit("_"))
    return issues(say(~known(F.col("product").startswith(head)), "SARProduct prefix"), say(~known(F.col("product").rlike(r"_\d{6}_[0-9A-F]{6}_[0-9A-F]{4}\.SAFE$")), "SARProduct suffix"))


@rule("v06_swath")
def _():
    return issues(*whole_in(F.col("swath"), 1, 3, "SLCSwath"))


def series_of(c: str, count: int, lo: float, hi: float, integral: bool = False) -> list[Column]:
    """Exactly ``count`` numbers in [lo, hi]; NaN is out of range."""
    parts = F.filter(F.split(F.trim(F.col(c)), r"\s+"), lambda x: x != "")
    values = F.transform(parts, lambda x: whole(x).cast("double") if integral else x.try_cast("double"))
    sized = F.size(parts) == count
    typed = ~F.exists(values, lambda v: v.isNull())
    return [say(F.col(c).isNull(), f"{c} missing"), say(F.col(c).isNotNull() & ~sized, f"{c} count"), say(known(sized & ~typed), f"{c} format"), say(known(sized & typed & ~F.forall(values, lambda v: (v >= lo) & (v <= hi) & ~F.isnan(v))), f"{c} range")]


@rule("v07_corners")
def _():
    s, n = (F.split(F.trim(F.col(c)), r"\s+") for c in ("scene_sample", "scene_line"))
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    return issues(*series_of("latitude", 4, -90, 90), *series_of("longitude", 4, -180, 180), *series_of("scene_sample", 4, 0, 2000, True), *series_of("scene_line", 4, 0, 2000, True), say(known((F.size(s) == 4) & ~((at(s, 1) == at(s, 4)) & (at(s, 2) == at(s, 3)))), "scene_sample pairs"), say(known((F.size(n) == 4) & ~((at(n, 1) == at(n, 2)) & (at(n, 3) == at(n, 4)))), "scene_line pairs"))


@rule("v07b_closed_corners")
def _():
    parts = F.split(F.trim(F.col("ring")), r"\s+")
    return issues(*series_of("ring", 5, -90, 90), say(known((F.size(parts) == 5) & (F.element_at(parts, 1) != F.element_at(parts, -1))), "ring not closed"))


def ranged_float(c: str, lo: float, hi: float | None) -> tuple[list[Column], Column]:
    """(errors, warning): NaN is neither."""
    v = F.when(~nan(F.col(c)), F.col(c).try_cast("double"))
    out = (v < lo) | (v > hi) if hi is not None else v < lo
    return [say(F.col(c).isNull(), f"{c} missing"), say(F.col(c).isNotNull() & ~nan(F.col(c)) & v.isNull(), f"{c} not a number")], say(known(out), f"{c} range")


@rule("v08_wind")
def _():
    (a, wa), (b, wb) = ranged_float("wind_direction", 0, 360), ranged_float("wind_speed", 0, None)
    return issues(*a, *b, warnings=(wa, wb))


@rule("v09_ship_count")
def _():
    n = whole(F.col("n_ships"))
    return issues(say(n.isNull(), "Number_of_ships"), say(known(n < 0), "Number_of_ships negative"), say(known(n != F.size("ships")), "Number_of_ships differs"))


@rule("v10_ship_names")
def _():
    names = F.transform("ships", lambda s: s["name"])
    right = F.transform("ships", lambda s, i: s["name"] == F.concat(F.lit("Ship_"), (i + 1).cast("string")))
    return issues(say(~F.forall(right, lambda x: x), "Ship names"), say(F.size(F.array_distinct(names)) != F.size(names), "Ship names repeat"))


def each_ship(bad, text: str) -> Column:
    """One issue for each ship for which ``bad`` holds."""
    return F.transform(F.filter(F.transform("ships", lambda s, i: F.when(known(bad(s)), F.concat(F.lit(f"{text} "), (i + 1).cast("string")))), lambda x: x.isNotNull()), lambda x: x)


@rule("v11_centroids")
def _():
    bad = lambda f: lambda s: ~nan(s[f]) & ~known(s[f].try_cast("double").between(1, 512))
    found = F.concat(each_ship(bad("x"), "x"), each_ship(bad("y"), "y"), F.array_compact(F.array(say(known(whole(F.col("n_ships")) != F.size("ships")), "count"))))
    return F.struct(found.alias("missing"), F.array().cast("array<string>").alias("warnings"))


@rule("v12_boxes")
def _():
    out = lambda f: lambda s: s[f].isNull() | (~nan(s[f]) & ~known(whole(s[f]).between(1, 512)))
    order = lambda a, b: lambda s: whole(s[a]) > whole(s[b])
    found = F.concat(*[each_ship(out(f), f) for f in ("top", "left", "bottom", "right")], each_ship(order("top", "bottom"), "top>bottom"), each_ship(order("left", "right"), "left>right"))
    return F.struct(found.alias("missing"), F.array().cast("array<string>").alias("warnings"))


@rule("v13_sizes")
def _():
    number = lambda s: F.when(~nan(s["size"]), s["size"].try_cast("double"))
    bad = each_ship(lambda s: ~nan(s["size"]) & number(s).isNull(), "size")
    warn = each_ship(lambda s: ~number(s).between(1, 1000), "size range")
    return F.struct(bad.alias("missing"), warn.alias("warnings"))


@rule("v14_rfi_flag")
def _():
    return issues(*whole_in(F.col("rfi"), 0, 1, "RFIDetection"))


@rule("v15_event_count")
def _():
    n = whole(F.col("n_events"))
    return issues(say(n.isNull(), "Number_of_events"), say(known(n != F.coalesce(F.size("events"), F.lit(0))), "Number_of_events differs"), say(known((n > 0) & F.col("events").isNull()), "List_of_events missing"))


@rule("v16_event_series")
def _():
    values = lambda e, f: F.transform(F.split(F.trim(e[f]), r"\s+"), lambda x: x.try_cast("double"))
    bad = lambda f, most: lambda e: F.exists(values(e, f), lambda v: v.isNull() | (~F.isnan(v) & (F.abs(v) > most)))
    differs = lambda e: F.size(values(e, "lat")) != F.size(values(e, "lon"))
    count = lambda f: F.coalesce(F.size(F.filter("events", lambda e: known(f(e)))), F.lit(0))
    return issues(say(count(bad("lat", 90.0)) > 0, "lat"), say(count(bad("lon", 180.0)) > 0, "lon"), say(count(differs) > 0, "lengths differ"))


@rule("v17_event_names")
def _():
    return issues(say(~known(F.coalesce(F.forall("events", lambda e: e["name"].rlike(r"^(FloodEvent|WaterBody)_\d+$")), F.lit(True))), "names"))


@rule("v18_file_name")
def _():
    name, number = F.col("name"), F.regexp_extract("name", r"_(\d+)(?:_scaled)?\.[a-z]+$", 1).try_cast("bigint")
    return issues(say(~name.rlike(r"^s1a-iw-(raw-s-v[vh]|slc)-\d{8}t\d{6}-\d{8}t\d{6}-\d{6}-[0-9a-f]{6}-IW[1-3]-(RFI|VD)_\d+"), "convention"), say(~known(number.between(1, 9999)), "number"))


@rule("v19_image_size")
def _():
    fits = (F.abs(F.col("width") - 512) <= 1) & (F.abs(F.col("height") - 512) <= 1)
    return issues(say((F.col("kind") == "slc") & ~known(fits), "size"))


@rule("v20_product_token")
def _():
    return issues(say(~F.upper("name").rlike("SLC|GRD"), "token"))


@rule("v21_raw_extension")
def _():
    return issues(say(F.col("name").contains("-raw-") & ~F.col("name").endswith(".dat"), "extension"), say(polarisation(F.col("name")).eqNullSafe("unknown") & F.col("name").contains("-raw-"), "polarisation"))


def missing_inputs(required, inventory):
    """(scene, missing): required paths of a scene that the inventory lacks, reported together."""
    absent = required.join(inventory.select("path").distinct(), "path", "left_anti")
    return absent.groupBy("scene").agg(F.array_sort(F.collect_list("path")).alias("missing"))
