"""Projections, filters and predicates over truth tables, ships, tiles and file names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least, finite, product_parts

TRUE_WORDS = ("true", "1", "yes", "y", "t")


def as_flag(text: Column) -> Column:
    return F.lower(F.trim(text.cast("string"))).isin(*TRUE_WORDS)


def clean_text(x: Column) -> Column:
    """Trimmed, quotes off, upper case; the words nan and none are blanks."""
    t = F.regexp_replace(F.trim(x.cast("string")), r"^[\"']+|[\"']+$", "")
    return F.when(F.lower(t).isin("nan", "none") | t.isNull(), "").otherwise(F.upper(F.trim(t)))


def clean_truth(df: DataFrame) -> DataFrame:
    """Typed ground truth (scene, swath, lat, lon, is_vessel): rows that miss one of the first four go, swath is rounded half-even and must be 1 to 3."""
    number = lambda c: F.col(c).try_cast("double")
    typed = df.select(*[c for c in df.columns if c not in ("scene", "swath", "lat", "lon", "is_vessel")], clean_text(F.col("scene")).alias("scene"), F.rint(number("swath")).alias("swath"), number("lat").alias("lat"), number("lon").alias("lon"), as_flag(F.col("is_vessel")).alias("is_vessel"))
    return typed.where((F.col("scene") != "") & finite(F.col("swath")) & finite(F.col("lat")) & finite(F.col("lon")) & F.col("swath").between(1, 3)).withColumn("swath", F.col("swath").cast("int"))


def filter_ships(ships: DataFrame, threshold: float | None = None, metric: str = "xview", is_vessel: bool | None = None) -> DataFrame:
    """Ships by vessel flag and distance from shore by ``xview``, ``global`` or ``both``; null and NaN distances go when a threshold is given."""
    if metric not in ("xview", "global", "both"):
        raise ValueError(f"unknown metric {metric}")
    if is_vessel is not None:
        ships = ships.where(F.col("is_vessel") == is_vessel)
    if threshold is not None:
        for name in {"xview": ["xview_km"], "global": ["global_km"], "both": ["xview_km", "global_km"]}[metric]:
            ships = ships.where(at_least(F.col(name), threshold))
    return ships


def skip_reason(box: dict[str, Column]) -> Column:
    """Why a ship without a usable box is skipped; null for a usable one."""
    missing = [c.isNull() for c in box.values()]
    nan = [F.isnan(c.cast("double")) for c in box.values()]
    return F.when(reduce(or_, missing), "missing_box").when(reduce(or_, nan), "nan_box")


def keep_tiles(tiles: DataFrame, width: Column, height: Column, size: int) -> DataFrame:
    """Tiles (x0, y0, zeros) that fit in the image and hold at most a quarter of zero pixels."""
    fits = (F.col("x0") + size <= width) & (F.col("y0") + size <= height)
    return tiles.where(fits & (F.col("zeros") <= size * size / 4))


def drop_weak_starts(df: DataFrame, amplitude: float = 10, line: int = 20) -> DataFrame:
    """Detections that are weak (amp) and close to a burst start (local_line) go; one alone is no reason."""
    return df.where(~((F.col("amp") < amplitude) & (F.col("local_line") < line)))


def parse_selection(spec: str) -> list[int]:
    """``3, 7-5, 3`` to [3, 7, 6, 5]: ranges run in either direction, first seen first."""
    found: dict[int, None] = {}
    for part in filter(None, (x.strip() for x in spec.split(","))):
        lo, dash, hi = part.partition("-")
        a, b = int(lo), int(hi if dash else lo)
        found.update(dict.fromkeys(range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)))
    return list(found)


def select_ordered(df: DataFrame, key: str, spec: str) -> DataFrame:
    """Rows of the selection with their place in it (``pos``, from 0)."""
    wanted = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(parse_selection(spec))], f"{key} bigint, pos int")
    return df.join(wanted, key)  # as many rows as the specification lists


def filter_allowed(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files (name, split) whose label is in ``allowed`` (label): an id without polarisation stands for both, an ``_augN`` ending is ignored."""
    ids = allowed.select(F.explode(F.when(F.upper("label").rlike("(^|_)(VV|VH)_"), F.array("label")).otherwise(F.array(F.concat(F.lit("VV_"), "label"), F.concat(F.lit("VH_"), "label")))).alias("id")).distinct()
    keyed = files.withColumn("id", F.regexp_replace("name", r"_aug\d+$", ""))
    return keyed.join(ids, "id", "left_semi").drop("id")


def traceable(outputs: DataFrame) -> DataFrame:
    """One row: names, names without a traceable id, verdict."""
    bad = ~F.col("name").rlike(r"RFI_\d+_|VD_\d+")
    return outputs.agg(F.count("*").alias("n"), F.count_if(bad).alias("offenders")).withColumn("verdict", F.when(F.col("offenders") == 0, "PASS").otherwise("FAIL"))


def valid_pixels(df: DataFrame, ignore: int = 255) -> DataFrame:
    return df.where(F.col("valid") & (F.col("label") != ignore))


def blank_worklist(labels: DataFrame) -> DataFrame:
    """Labels without interference (rfi = 0) that need an all-zero mask."""
    return labels.where(F.col("rfi") == 0).select("file_id")


def requirement_rows(df: DataFrame, columns: tuple[str, str, str], applies: str = "DS") -> DataFrame:
    a, b, c = columns
    return df.select(a, b, c).where(F.trim(F.col(c)) == applies).dropna()


def parsed_names(files: DataFrame) -> DataFrame:
    return files.withColumns(product_parts(F.col("name")))
