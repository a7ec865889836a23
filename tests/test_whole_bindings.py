"""Queries that do the whole job beside a bound one whose SQL has a cut: the same rows as brute force."""

import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from swathframe.operators import raster
from swathframe.plans.bound import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_windows_from_first_to_last_order(spark):
    orders, customers = pd.read_parquet(f"{SF}/orders.parquet"), pd.read_parquet(f"{SF}/customer.parquet")
    start = pd.to_datetime(orders.o_orderdate)
    own = start[orders.o_custkey.isin(customers.c_custkey)].groupby(orders.o_custkey).agg(["min", "max"])
    want = {(int(k), int(p)) for k, w in own.iterrows() for p in orders.o_orderkey[(w["min"] <= start) & (start + pd.Timedelta(seconds=30) <= w["max"])]}
    late = QUERIES["j03_interval_match"](spark, SF).count()
    for name in ("j03_interval_match_whole", "s10_match_table_whole"):
        df = QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert set(map(tuple, df.select("target_id", "product_id").toPandas().values.tolist())) == want and len(want) > late
    got = QUERIES["j05_grid_distance_whole"](spark, SF).sample(0.01, seed=1).toPandas()
    for k, p, d in got[["target_id", "product_id", "min_distance_deg"]].values.tolist():
        lat, lon = p % 150 - 75 + np.arange(6), p * 3 % 340 - 170 + np.arange(6)
        assert (int(k), int(p)) in want and abs(np.hypot(k % 180 - 90 - lat[:, None], k * 7 % 360 - 180 - lon[None, :]).min() - d) < 1e-6


def part(name, n, tmp_path):
    """A folder with the first rows of a table."""
    pq.write_table(pq.read_table(f"{SF}/{name}.parquet").slice(0, n), tmp_path / f"{name}.parquet", coerce_timestamps="us")
    return str(tmp_path)


def test_every_pixel_centre_is_rasterised(spark, tmp_path):
    got = {r.patch_id: (r.n, r.mark) for r in QUERIES["r11_rasterise"](spark, part("orders", 20, tmp_path)).collect()}
    keys = pd.read_parquet(tmp_path / "orders.parquet").o_orderkey
    assert set(got) == set(keys)
    y, x = np.mgrid[:32, :32] + 0.5
    for k in keys.tolist():
        m = k % 16
        p, odd = [(16 + m, 16), (480, 48 + m), (496, 496 - m), (32, 464)], np.zeros((32, 32), bool)
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1]):
            odd ^= ((y1 / 16 > y) != (y2 / 16 > y)) & (x < (x2 - x1) / 16 * (y - y1 / 16) / ((y2 - y1) / 16) + x1 / 16)
        r, c = np.nonzero(odd)
        assert got[k] == (len(r), (r * 100 + c).sum())
    assert raster.rasterise(spark.createDataFrame([(1, 0, 5.0, 5.0), (1, 1, 7.0, 5.0), (1, 2, 7.0, 7.0), (1, 3, 5.0, 7.0)], "k int, ord int, px double, py double"), "k", 32).count() == 4


def test_rings_of_mask_regions(spark, tmp_path):
    sf = part("embeddings", 2, tmp_path)
    tiles = QUERIES["r05_regions"](spark, sf).toPandas()
    rings = QUERIES["r07_background_ring"](spark, sf).toPandas().set_index(["tile_id", "region"])
    contrast = QUERIES["r08_region_contrast"](spark, sf).toPandas().set_index(["tile_id", "region"])
    r, c = np.mgrid[:32, :32]
    seen = 0
    for tile in sorted(tiles.tile_id.unique()):
        power, own = (r * c + tile) % 101 + 1, tiles[tiles.tile_id == tile]
        mask = ((r * 7 + c * 3 + tile) % 11) < 4
        for region, px in own.groupby("region"):
            d = np.min([abs(r - a) + abs(c - b) for a, b in zip(px.r, px.c)], axis=0)
            ring = (d > 3) & (d <= 12) & ~mask
            want = (int(ring.sum()), int(power[ring].sum()))
            assert want[0] == 0 and (tile, region) not in rings.index or tuple(rings.loc[(tile, region)]) == want
            if want[0]:
                db = 10 * np.log10(power[px.r, px.c].mean() / np.median(power[ring]))
                assert abs(contrast.loc[(tile, region)].db - db) < 1e-5
                seen += 1
    assert seen
