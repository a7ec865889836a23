"""Every bound query at the smallest scale: the same rows as its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from swathframe.plans.bindings import TABLES
from swathframe.plans.bound import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):  # pandas turns nullable whole numbers into floats
        return int(v) if v.is_integer() else round(v, 9)
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([plain(v) for v in r]) for r in frame.values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


THETA = ["j03_interval_match", "j04_nearest_wind", "j07_nearest_burst", "j08_prefix_match", "j18_prefix_groups", "r16_sinc_resample"]


@pytest.mark.parametrize("name", THETA)
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_nested_loops_on_pixels_and_polygons(spark):
    from swathframe.operators import joins, raster

    pixels = spark.range(64).selectExpr("id % 3 AS tile_id", "int(id div 8) AS r", "int(id % 8) AS c", "id AS power")
    points = spark.range(9).selectExpr("id % 3 AS k", "double(id) AS px", "double(id) AS py")
    corners = spark.range(4).selectExpr("id % 3 AS k", "id AS ord", "double(id * 3 % 7) AS px", "double(id * 5 % 7) AS py")
    for df in (raster.background_ring(pixels.where("r < 2").withColumn("region", pixels.tile_id), pixels), joins.points_in_polygons(points, corners, "k")):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
