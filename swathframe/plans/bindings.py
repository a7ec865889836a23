"""Domain relations over the driver's tables, in SQL that Spark and DuckDB read alike.

Only whole-number arithmetic, ``floor``, ``concat`` and ``md5`` are used, so both engines
derive identical rows. Ordinals are per group: no relation needs a total order.
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CTE = {
    "patch": "SELECT o_orderkey AS patch_id, concat('S1A_', CAST(o_custkey % 97 AS VARCHAR(9))) AS scene, CAST(o_orderkey % 3 + 1 AS INT) AS swath, o_orderdate AS start_ts, o_orderdate + INTERVAL 30 SECONDS AS stop_ts, CAST(o_orderkey * 37 % 20000 AS BIGINT) AS x0, CAST(o_orderkey * 53 % 1500 AS BIGINT) AS y0, o_totalprice AS price, o_custkey AS area FROM orders",
    "patch_polygon": "SELECT patch_id, v.ord AS ord, CAST(CASE v.ord WHEN 0 THEN 16 + patch_id % 16 WHEN 1 THEN 480 WHEN 2 THEN 496 ELSE 32 END AS DOUBLE) AS px, CAST(CASE v.ord WHEN 0 THEN 16 WHEN 1 THEN 48 + patch_id % 16 WHEN 2 THEN 496 - patch_id % 16 ELSE 464 END AS DOUBLE) AS py FROM patch CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(ord)",
    "ship": "SELECT l_orderkey AS patch_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS ship_no, l_quantity * 8 AS size_m, CAST(l_partkey * 7 % 512 + 1 AS INT) AS x, CAST(l_suppkey * 11 % 512 + 1 AS INT) AS y, CAST(l_linenumber * 6 AS INT) AS w, CAST(l_linenumber * 4 AS INT) AS h, l_returnflag = 'N' AS is_vessel, CASE WHEN l_partkey % 31 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_partkey % 60 AS DOUBLE) END AS xview_km, CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE CAST(l_suppkey % 80 AS DOUBLE) END AS global_km, l_linestatus AS confidence, l_shipdate AS seen_ts FROM lineitem",
    "target": "SELECT c_custkey AS target_id, CAST(c_custkey % 180 - 90 AS DOUBLE) AS lat, CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS lon, min(o_orderdate) AS start_ts, min(o_orderdate) + INTERVAL 3 DAYS AS stop_ts FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "product": "SELECT o_orderkey AS product_id, o_orderdate AS start_ts, o_orderdate + INTERVAL 30 SECONDS AS stop_ts, concat('S1A_IW_SLC__1SDV_', CAST(o_orderkey AS VARCHAR(20)), '.SAFE') AS filename, o_custkey % 7 AS orbit FROM orders",
    "grid_point": "SELECT product_id, a.g AS gx, b.g AS gy, CAST(product_id % 150 - 75 + a.g AS DOUBLE) AS lat, CAST(product_id * 3 % 340 - 170 + b.g AS DOUBLE) AS lon FROM product CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS a(g) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS b(g)",
    "wind_cell": "SELECT s_suppkey AS cell, CAST(s_suppkey * 13 % 160 - 80 AS DOUBLE) AS lat, CAST(s_suppkey * 29 % 340 - 170 AS DOUBLE) AS lon, CAST(s_suppkey * 17 % 360 AS DOUBLE) AS direction, s_acctbal / 400 AS speed FROM supplier",
    "centre": "SELECT o_orderkey AS patch_id, CAST(o_orderkey * 11 % 150 - 75 AS DOUBLE) + 0.25 AS lat, CAST(o_orderkey * 19 % 330 - 165 AS DOUBLE) + 0.25 AS lon FROM orders",
    "pulse": "SELECT event_id AS seq, ts, user_id % 4 AS stream, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'IW1' ELSE 'IW2' END AS swath, value FROM events",
    "tile": "SELECT vec_id AS tile_id, label AS scene, embedding FROM embeddings",
    "pixel_mask": "SELECT vec_id AS tile_id, a.r * 8 + b.r AS r, c.r * 8 + d.r AS c, ((a.r * 8 + b.r) * 7 + (c.r * 8 + d.r) * 3 + vec_id) % 11 < 4 AS is_mask, CAST((a.r * 8 + b.r) * (c.r * 8 + d.r) + vec_id AS BIGINT) % 101 + 1 AS power FROM embeddings CROSS JOIN (VALUES (0), (1), (2), (3)) AS a(r) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS b(r) CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(r) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS d(r)",
    "prediction": "SELECT l_orderkey AS image_id, l_linenumber AS px, CAST(l_partkey % 100 AS DOUBLE) / 100 AS prob, l_returnflag = 'R' AS gt, l_linestatus = 'F' AS valid, l_suppkey AS model FROM lineitem",
    "odd_prediction": "SELECT image_id, px, CASE WHEN image_id % 41 = 7 THEN CAST('NaN' AS DOUBLE) ELSE prob END AS prob, gt, valid, model FROM prediction",
    "odd_detection": "SELECT image_id, det_no, CASE WHEN image_id % 41 = 7 THEN CAST('NaN' AS DOUBLE) ELSE conf END AS conf FROM detection",
    "gt_box": "SELECT patch_id AS image_id, ship_no AS gt_no, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM ship WHERE ship_no % 4 <> 0",
    "detection": "SELECT patch_id AS image_id, ship_no AS det_no, CAST(x + ship_no % 3 AS DOUBLE) AS x, CAST(y - ship_no % 2 AS DOUBLE) AS y, CAST(w + ship_no % 2 AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST((patch_id * 7 + ship_no * 13) % 1000 AS DOUBLE) / 1000 AS conf FROM ship WHERE ship_no % 5 <> 0",
    "file": "SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 's1a-iw-raw-s-vv-' WHEN 1 THEN 's1a-iw-raw-s-vh-' ELSE 's1a-iw-slc-' END, '20200407t052956-20200407t053029-0', CAST(32000 + doc_id % 9 AS VARCHAR(9)), '-03b2e2-IW', CAST(doc_id % 3 + 1 AS VARCHAR(2)), CASE WHEN doc_id % 5 = 0 THEN '-VD_' ELSE '-RFI_' END, CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.dat' WHEN 1 THEN '_scaled.npy' WHEN 2 THEN '.xml' ELSE '.tiff' END) AS name, CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, source AS folder, n_chars AS bytes FROM documents",
    "tile_file": "SELECT doc_id, concat('DB_SAR_', CASE WHEN doc_id % 2 = 0 THEN 'VH_' ELSE 'VV_' END, CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR(20))) AS stem, CAST(floor(doc_id / 2) AS BIGINT) AS base, CASE WHEN doc_id % 2 = 0 THEN 'vh' ELSE 'vv' END AS pol, CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, concat(source, '/', CAST(doc_id AS VARCHAR(20))) AS path, source FROM documents",
    "mask_file": "SELECT doc_id, CAST(floor(doc_id / 2) AS BIGINT) AS base, quality, toxic, CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, concat('masks/', CAST(doc_id AS VARCHAR(20)), '.png') AS path FROM labels",
}
