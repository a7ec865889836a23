"""S, ST and X: file formats, streams and plug-in points over data made of the driver's tables."""

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import masks
from ..sources import files as S
from ..sources import png, tiles
from ..streaming import jobs, keyed
from .bound_joins import whole_targets
from .registry import ORACLE, bound


@bound("s01_scene_mapping", "SELECT CAST(o_orderkey AS VARCHAR) AS num, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('GRD_', o_custkey) END AS grd, concat('SLC_', o_orderkey) AS slc FROM orders WHERE o_orderkey % 10 <> 0")
def _(t):
    path = S.scratch(t.spark, "mapping")
    blank = F.col("o_orderkey") % 10 == 0
    line = F.when(blank, F.lit(' ;"";')).otherwise(F.concat(F.lit(' "'), "o_orderkey", F.lit('";'), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("GRD_"), "o_custkey")), F.lit("; 'SLC_"), "o_orderkey", F.lit("'")))
    t.orders.select(line.alias("num;grd;slc")).write.csv(path, header=True, sep="\x01", quote="", escapeQuotes=False)
    return S.read_mapping(t.spark, path)


@bound("s02_vessel_truth", "SELECT CAST(patch_id AS VARCHAR) AS scene, CAST(x AS VARCHAR) AS x, CAST(NULL AS VARCHAR) AS source, confidence FROM ship")
def _(t):
    path = S.scratch(t.spark, "truth")
    t.ship.select(F.col("patch_id").alias("scene"), "x", "confidence").write.csv(path, header=True)
    return S.read_truth(t.spark, path, ["scene", "x"]).select("scene", "x", "source", "confidence")


@bound("s03_targets", "SELECT start_ts, stop_ts, lat, lon FROM target")
def _(t):
    path = S.scratch(t.spark, "targets")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c.replace("_ts", "_time"))
    t.target.select(stamp("start_ts"), stamp("stop_ts"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).write.csv(path, header=True)
    return S.read_targets(t.spark, path)


def enclosed(batches):
    """Each file's rows inside one root element."""
    tag = lambda text: pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["value"])
    yield tag("<products>")
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["value"])
    yield tag("</products>")


def annotations(t):
    """Annotation files of three bursts, two grid points and two state vectors a patch, read back."""
    path = S.scratch(t.spark, "annotations")
    own, text = F.col("patch_id"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    burst = F.array_join(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: text("<burst><azimuthTime>t</azimuthTime><line>", k * 10 + own, "</line></burst>")), "")
    point = F.array_join(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: text("<point><line>", k * 100, "</line><pixel>", own % 7 + k, "</pixel><latitude>", own % 90 + k * 0.5, "</latitude><longitude>", own % 180, "</longitude></point>")), "")
    orbit = F.array_join(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: text("<orbit><time>2020-04-07T05:29:", F.lpad((k * 10 + 5).cast("string"), 2, "0"), ".25</time><position><x>", own + k, "</x><y>-2.5</y><z>", k, "</z></position><velocity><x>7.5</x><y>", own % 11, "</y><z>0</z></velocity></orbit>")), "")
    product = text("<product><header><start>s", own, "</start><stop>e", own, "</stop></header><burstList>", burst, "</burstList><grid>", point, "</grid><generalAnnotation><orbitList>", orbit, "</orbitList></generalAnnotation></product>")
    t.patch.select(product.alias("value")).mapInArrow(enclosed, "value string").write.text(path)
    return S.read_annotations(t.spark, path)


STEPS = "(SELECT unnest([0, 1]) AS k)"


@bound("s04_annotations", "SELECT concat('s', patch_id) AS start, (k - 1)::INT AS burst, (k * 10 + patch_id)::INT AS line FROM patch, (SELECT unnest([1, 2, 3]) AS k)")
def _(t):
    return annotations(t)["burst"].select("start", "burst", "line")


@bound("s04b_annotation_headers", "SELECT concat('s', patch_id) AS start, concat('e', patch_id) AS stop FROM patch")
def _(t):
    return annotations(t)["header"].select("start", "stop")


@bound("s04c_annotation_grids", f"SELECT concat('s', patch_id) AS start, (k * 100)::INT AS line, (patch_id % 7 + k)::INT AS pixel, (patch_id % 90 + k * 0.5)::DOUBLE AS latitude, (patch_id % 180)::DOUBLE AS longitude FROM patch, {STEPS}")
def _(t):
    return annotations(t)["grid"].select("start", "line", "pixel", "latitude", "longitude")


@bound("s04d_annotation_orbits", f"SELECT concat('s', patch_id) AS start, k::INT AS orbit, (k * 10)::DOUBLE AS t, (patch_id + k)::DOUBLE AS x, -2.5::DOUBLE AS y, k::DOUBLE AS z, 7.5::DOUBLE AS vx, (patch_id % 11)::DOUBLE AS vy, 0::DOUBLE AS vz FROM patch, {STEPS}")
def _(t):
    return annotations(t)["orbit"].drop("file")


LABEL = "concat('<label><Scene_ID>DB_', patch_id, '</Scene_ID><SARProduct> S1A_', patch_id, '.SAFE </SARProduct><Number_of_ships>', count(*), '</Number_of_ships><List_of_ships>', string_agg(concat('<Ship><Name>Ship_', ship_no, '</Name><Size>', x, '</Size></Ship>'), '' ORDER BY ship_no), '</List_of_ships></label>')"


def label_xml(t):
    ship = F.concat(F.lit("<Ship><Name>Ship_"), "ship_no", F.lit("</Name><Size>"), "x", F.lit("</Size></Ship>"))
    own = t.ship.groupBy("patch_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ship_no", ship.alias("s")))).alias("s"))
    text = F.concat(F.lit("<label><Scene_ID>DB_"), "patch_id", F.lit("</Scene_ID><SARProduct> S1A_"), "patch_id", F.lit(".SAFE </SARProduct><Number_of_ships>"), "n", F.lit("</Number_of_ships><List_of_ships>"), F.array_join("s.s", ""), F.lit("</List_of_ships></label>"))
    return own.select("patch_id", text.alias("text"))


@bound("s05_label_ships", "SELECT patch_id, concat('DB_', patch_id) AS scene_id, ship_no - 1 AS pos, concat('Ship_', ship_no) AS name, CAST(x AS VARCHAR) AS size FROM ship")
def _(t):
    own = S.ships_of(S.parse_labels(label_xml(t)))
    return own.select("patch_id", F.col("label.Scene_ID").alias("scene_id"), F.col("ship_pos").alias("pos"), F.col("ship.Name").alias("name"), F.col("ship.Size").alias("size"))


@bound("s06_scene_of_content", "SELECT DISTINCT patch_id, concat('S1A_', patch_id, '.SAFE') AS scene FROM ship")
def _(t):
    return label_xml(t).select("patch_id", S.scene_of_content(F.encode("text", "UTF-8")).alias("scene"))


def touch_files(batches, folder):
    """Files of one byte with the given names in ``folder``; the scan passes over empty ones."""
    system, path = tiles.opened(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            system.create_dir(f"{path}/{name}".rpartition("/")[0])
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(b"\0")
        yield batch


@bound("s07_file_inventory", "SELECT concat('SAR_', CASE WHEN s_suppkey % 2 = 0 THEN 'VH_' ELSE 'VV_' END, s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '_raw' ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN '.npy' ELSE '.png' END) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'npy' ELSE 'png' END AS ext, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END::BIGINT AS file_id FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 1")
def _(t):
    folder = S.scratch(t.spark, "inventory")
    k = F.col("s_suppkey")
    ext = F.when(k % 3 == 0, ".npy").when(k % 3 == 1, ".dat").otherwise(".png")
    name = F.concat("s_nationkey", F.lit("/SAR_"), F.when(k % 2 == 0, "VH_").otherwise("VV_"), k, F.when(k % 5 == 0, "_raw").otherwise(""), ext)
    t.supplier.select(name.alias("name")).mapInArrow(lambda batches: touch_files(batches, folder), "name string").write.format("noop").mode("overwrite").save()
    return S.file_inventory(t.spark, folder, ["npy", "png"], ["_VH_"]).select("name", "ext", "file_id")


def encode(kind):
    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                iq = np.array(v, "<f4")
                if kind == "l0":
                    out.append(np.array([4, 8], "<u4").tobytes() + np.stack([iq[:32], iq[32:]], axis=1).tobytes())
                else:
                    np.save(held := io.BytesIO(), (iq[:32] + 1j * iq[32:]).astype(np.complex64).reshape(4, 8))
                    out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return run


IQ = "SELECT vec_id AS k, (p // 8)::INT AS r, (p % 8)::INT AS c, embedding[p + 1] AS i, embedding[p + 33] AS q FROM embeddings, (SELECT unnest(range(0, 32)) AS p)"


def contents(t, kind):
    return t.embeddings.select(F.col("vec_id").alias("path"), "embedding").mapInArrow(encode(kind), "path bigint, content binary")


@bound("s08_l0_tiles", IQ)
def _(t):
    return S.tile_pixels(S.read_l0(contents(t, "l0"))).withColumnRenamed("key", "k")


@bound("s09_npy_tiles", IQ)
def _(t):
    return S.tile_pixels(S.read_npy(contents(t, "npy"))).withColumnRenamed("key", "k")


def mask_images(batches):
    """(path, embedding) to PNG masks of 4 x 8, white where the first half is positive; each row has another line filter."""
    for batch in batches:
        images = [png.encode_mask(255 * (np.array(v[:32], np.float64).reshape(4, 8) > 0), [(k + r) % 5 for r in range(4)]) for k, v in enumerate(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["path", "content"])


@bound("s09b_masked_tiles", "SELECT vec_id AS k, (p // 8)::INT AS r, (p % 8)::INT AS c, embedding[p + 1] AS i, embedding[p + 33] AS q, (embedding[p + 1] > 0)::INT AS label FROM embeddings, (SELECT unnest(range(0, 32)) AS p)")
def _(t):
    images = t.embeddings.select(F.col("vec_id").alias("path"), "embedding").mapInArrow(mask_images, "path bigint, content binary")
    labels = png.read_masks(images).where("error IS NULL").select("key", F.posexplode("label").alias("p", "label"), "w").select("key", F.expr("p div w").cast("int").alias("r"), (F.col("p") % F.col("w")).alias("c"), "label")
    return S.tile_pixels(S.read_npy(contents(t, "npy"))).join(labels, ["key", "r", "c"]).withColumnRenamed("key", "k")


def write_files(batches, folder):
    """(file, rows of embeddings in order) to patch files of ``folder``."""
    system, path = tiles.opened(folder)
    for batch in batches:
        for name, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            iq = np.array(rows, "<f4").reshape(len(rows), 2, 32).transpose(0, 2, 1)
            with system.open_output_stream(f"{path}/tiles_{name}.dat") as out:
                out.write(np.array([len(rows), 32], "<u4").tobytes() + np.ascontiguousarray(iq).tobytes())
        yield batch.select(["file"])


@bound("s08b_tile_windows", "SELECT vec_id AS k, (5 + p)::INT AS c, embedding[6 + p] AS i, embedding[38 + p] AS q FROM embeddings, (SELECT unnest(range(0, 12)) AS p) WHERE vec_id % 64 >= 10 AND vec_id % 64 < 50")
def _(t):
    tiles.register(t.spark)
    folder = S.scratch(t.spark, "tile-files")
    system, path = tiles.opened(folder)
    system.create_dir(path)
    files = t.embeddings.groupBy(F.expr("vec_id div 64").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("rows"))
    files.mapInArrow(lambda batches: write_files(batches, folder), "file bigint").write.format("noop").mode("overwrite").save()
    lines = t.spark.read.format("patch_tiles").options(path=folder, row=10, rows=40, col=5, cols=12, split=8000).load()
    k = F.regexp_extract("path", r"tiles_(\d+)\.dat$", 1).cast("bigint") * 64 + F.col("row")
    return lines.select(k.alias("k"), "col", F.posexplode(F.arrays_zip("i", "q")).alias("p", "v")).select("k", (F.col("col") + F.col("p")).alias("c"), F.col("v.i").alias("i"), F.col("v.q").alias("q"))


def listed_matches(targets, products):
    text = lambda c: F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))).alias(c)
    return J.window_rectangles(targets, products, "target_id", "product_id", tall=64).select(text("keys"), text("values"))


@bound("s10_match_table", "SELECT target_id, product_id FROM target t JOIN product p ON t.start_ts <= p.start_ts AND t.stop_ts >= p.stop_ts")
def _(t):
    path = S.scratch(t.spark, "matches")
    S.write_packed_matches(listed_matches(t.target, t.product), path)
    return S.read_matches(t.spark, path)


@bound("s10_match_table_whole")
def _(t):
    path = S.scratch(t.spark, "matches-whole")
    S.write_packed_matches(listed_matches(whole_targets(t), t.product), path)
    return S.read_matches(t.spark, path)


@bound("s11_legend", "SELECT scene, p.patch_id, (count(ship_no) > 0)::INT AS has_ship, swath FROM patch p LEFT JOIN ship s ON p.patch_id = s.patch_id GROUP BY ALL")
def _(t):
    path = S.scratch(t.spark, "legend")
    S.write_legend(A.ships_per_patch(t.patch, t.ship).join(t.patch.select("patch_id", "scene", "swath"), "patch_id"), path)
    return t.spark.read.csv(path, header=True, schema="patch_id bigint, has_ship int, swath int, scene string")


@bound("s13_statistics", "SELECT round(avg(value), 6) AS mean, count(*) AS n, 'events' AS source FROM events")
def _(t):
    path = S.scratch(t.spark, "stats")
    S.write_stats(t.events.agg(F.avg("value").alias("mean"), F.count("*").alias("n")), path, "events")
    return t.spark.read.json(path).select(F.round("mean", 6).alias("mean"), "n", "source")


@bound("s14_flat_metadata", "SELECT patch_id, ship_no, global_km FROM ship")
def _(t):
    path = S.scratch(t.spark, "flat")
    S.write_flat(t.ship.select("patch_id", "ship_no", "global_km"), path)
    return t.spark.read.csv(path, header=True, schema="patch_id bigint, ship_no int, global_km double")


@bound("s16_keep_decisions", "SELECT patch_id, CASE WHEN price > 200000 THEN 'keep' ELSE 'reject' END AS decision, concat('swath', swath) AS filter_mode FROM patch")
def _(t):
    path = S.scratch(t.spark, "decisions")
    own = t.patch.select("patch_id", F.when(F.col("price") > 200000, "keep").otherwise("reject").alias("decision"), F.concat(F.lit("swath"), "swath").alias("filter_mode"))
    S.write_decisions(own, path)
    return t.spark.read.csv(path, header=True, schema="patch_id bigint, decision string, filter_mode string")


@bound("st1_resumable_stage", "SELECT scene, CASE WHEN count(*) FILTER (swath = 3) = 0 THEN 'failed' ELSE 'done' END AS status, count(*) AS n FROM patch GROUP BY scene")
def _(t):
    base = S.scratch(t.spark, "stage")
    scenes = t.patch.groupBy("scene").agg(F.count("*").alias("n"), F.count_if(F.col("swath") == 3).alias("last"))

    def stage(batch):
        return batch.select("scene", F.when(F.col("last") == 0, "failed").otherwise("done").alias("status"), "n")

    for part in range(2):  # the second run only sees what the first has not
        scenes.where(F.pmod(F.hash("scene"), F.lit(2)) == part).write.mode("append").parquet(f"{base}/in")
        jobs.run_stage(t.spark, f"{base}/in", "scene string, n bigint, last bigint", f"{base}/checkpoint", f"{base}/status", stage)
    return t.spark.read.parquet(f"{base}/status").select("scene", "status", "n")


@bound("st2_burst_stream", "WITH m AS (SELECT *, CASE WHEN lag(swath) OVER (PARTITION BY stream ORDER BY ts, seq) <> swath THEN 1 ELSE 0 END AS c FROM pulse), r AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM m), g AS (SELECT stream, swath, run, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS stop_us, count(*) AS n FROM r GROUP BY ALL) SELECT stream, swath, row_number() OVER (PARTITION BY stream, swath ORDER BY run)::INT AS burst, start_us, stop_us, n FROM g")
def _(t):
    base = S.scratch(t.spark, "bursts")
    pulses = t.pulse.select("stream", "seq", "ts", "swath")
    middle = pulses.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("m")).first().m
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pulses.schema)
    for part in (pulses.where(early), pulses.where(~early)):
        part.write.mode("append").parquet(f"{base}/in")
        jobs.run_bursts(t.spark, f"{base}/in", schema, f"{base}/checkpoint", f"{base}/out")
    return jobs.latest_bursts(t.spark.read.parquet(f"{base}/out/updates").drop("batch"))


@bound("st2b_keyed_bursts", ORACLE["st2_burst_stream"])
def _(t):
    base = S.scratch(t.spark, "keyed-bursts")
    pulses = t.pulse.select("stream", "seq", "ts", "swath", F.lit(False).alias("ends"))
    middle = pulses.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("m")).first().m
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    marks = pulses.select("stream").distinct().select("stream", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast(pulses.schema["ts"].dataType).alias("ts"), F.lit(None).cast("string").alias("swath"), F.lit(True).alias("ends"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pulses.schema)
    for part in (pulses.where(early), pulses.where(~early), marks):
        part.write.mode("append").parquet(f"{base}/in")
        keyed.start_keyed_bursts(t.spark, f"{base}/in", schema, f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return t.spark.read.schema(keyed.OUT).parquet(f"{base}/out").where("NOT late").drop("late")


@bound("x02_mask_resolver", "SELECT f.doc_id, m.path FROM tile_file f LEFT JOIN mask_file m ON m.doc_id = f.doc_id")
def _(t):
    return masks.resolve_masks(t.tile_file, t.mask_file, "by_id").select("doc_id", F.col("mask").alias("path"))


# tiles in and outside of split folders, with and without a number; masks of either spelling or of none
FOLDER = "CASE doc_id % 10 WHEN 8 THEN '/d/val' WHEN 9 THEN '/d/Train/x/test2' WHEN 7 THEN '/d/other' ELSE '/d/Train' END"
RC_TILES = f"SELECT doc_id, concat({FOLDER}, '/rc/', source, '/s1a-iw-raw-s-vv-IW1-', CASE WHEN doc_id % 11 = 0 THEN 'VD_' ELSE 'RFI_' END, CAST(doc_id AS VARCHAR(20)), '_scaled.npy') AS path FROM documents"
RC_MASKS = f"SELECT doc_id, concat({FOLDER}, '/mask/', CASE WHEN doc_id % 3 = 0 THEN concat('DB_OPENSAR_RFI_', CAST(doc_id AS VARCHAR(20)), '_MASK.png') ELSE concat('db_opensar_rfi_', CAST(doc_id AS VARCHAR(20)), '_mask.png') END) AS path FROM labels WHERE doc_id % 5 <> 1"


@bound("x02b_split_folder_masks", f"SELECT t.doc_id, CASE WHEN t.doc_id % 10 <> 7 AND t.doc_id % 11 <> 0 THEN m.path END AS mask, t.doc_id % 10 = 7 OR t.doc_id % 11 = 0 AS without_candidate FROM ({RC_TILES}) t LEFT JOIN ({RC_MASKS}) m ON m.doc_id = t.doc_id")
def _(t):
    found = masks.resolve_masks(t.sql(RC_TILES), t.sql(RC_MASKS), "split_folder")
    return found.select("doc_id", "mask", F.coalesce(F.col("reason") == "no candidate", F.lit(False)).alias("without_candidate"))


@bound("x04_binary_decoder", "SELECT vec_id AS k, 4 AS h, 8 AS w, 32 AS n FROM embeddings")
def _(t):
    return S.read_l0(contents(t, "l0")).select(F.col("key").alias("k"), "h", "w", F.size("i").alias("n"))


@bound("x04b_tile_pixels", IQ)
def _(t):
    tiles.register(t.spark)
    contents(t, "l0").createOrReplaceTempView("tile_contents")
    return t.spark.sql("SELECT path AS k, p.* FROM tile_contents, LATERAL tile_pixels(content) AS p")
