"""PNG masks against another encoder, windows of patch files by the bytes they read, and bursts with keyed state."""

import random
import struct
import time

import numpy as np
import pytest

from swathframe.sources import files, png, tiles
from swathframe.streaming import jobs, keyed


def images(spark, rows):
    return spark.createDataFrame(rows, "path bigint, content binary")


def java_png(spark, kind, pixels, interlaced=False):
    """Written by Java's encoder. kind: a BufferedImage type; pixels: values of its raster."""
    jvm = spark._jvm
    h, w = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, getattr(jvm.java.awt.image.BufferedImage, kind))
    raster = image.getRaster()
    for y in range(h):
        for x in range(w):
            raster.setSample(x, y, 0, int(pixels[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("png").next()
    param = writer.getDefaultWriteParam()
    if interlaced:
        param.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def test_masks_of_another_encoder(spark):
    rng = np.random.default_rng(4)
    smooth = np.add.outer(np.arange(19), np.arange(23)) * 5 % 251
    cases = [
        ("TYPE_BYTE_GRAY", smooth, False, smooth), ("TYPE_BYTE_GRAY", smooth, True, smooth), ("TYPE_BYTE_GRAY", 255 * (smooth > 90), False, smooth > 90),
        ("TYPE_USHORT_GRAY", smooth * 257, False, smooth * 257), ("TYPE_BYTE_BINARY", rng.integers(0, 2, (5, 13)), False, None), ("TYPE_BYTE_BINARY", rng.integers(0, 2, (9, 9)), True, None),
        ("TYPE_BYTE_INDEXED", rng.integers(0, 200, (7, 6)), False, None), ("TYPE_BYTE_GRAY", np.array([[7]]), True, None),
    ]
    found = {r.key: r for r in png.read_masks(images(spark, [(k, java_png(spark, kind, x, inter)) for k, (kind, x, inter, _) in enumerate(cases)])).collect()}
    for k, (_, x, _, want) in enumerate(cases):
        assert found[k].error is None and (found[k].h, found[k].w) == x.shape
        assert found[k].label == (x if want is None else np.asarray(want)).astype(int).ravel().tolist(), cases[k][0]


def test_masks_of_all_line_filters(spark):
    x = np.random.default_rng(1).integers(0, 256, (40, 31))
    rows = [(k, png.encode_mask(x, [k] * 40)) for k in range(5)] + [(5, png.encode_mask(255 * (x > 100), [y % 5 for y in range(40)]))]
    found = {r.key: r.label for r in png.read_masks(images(spark, rows)).collect()}
    assert all(found[k] == x.ravel().tolist() for k in range(5)) and found[5] == (x > 100).astype(int).ravel().tolist()


def test_damaged_masks_are_error_rows(spark):
    good = png.encode_mask(np.eye(8, dtype=int))
    flipped = bytearray(good)
    flipped[45] ^= 1
    colour = java_png(spark, "TYPE_3BYTE_BGR", np.zeros((3, 3)))
    rows = [(0, good), (1, None), (2, b""), (3, b"no png"), (4, good[:-20]), (5, bytes(flipped)), (6, colour), (7, good[:33])]
    found = {r.key: r for r in png.read_masks(images(spark, rows)).collect()}
    assert found[0].error is None and sum(found[0].label) == 8
    assert all(found[k].error and found[k].label is None and found[k].h is None for k in range(1, 8))
    assert png.read_masks(images(spark, [])).count() == 0


def test_damaged_npy_tiles_are_error_rows(spark):
    found = files.read_npy(images(spark, [(1, None), (2, b""), (3, b"\x93NUMPY junk")])).collect()
    assert {r.key for r in found} == {1, 2, 3} and all(r.h is None and r.i is None for r in found)


# -------------------------------------------------------------- patch files
def tile_file(path, h, w, cut=0):
    iq = np.stack([np.arange(h * w), -np.arange(h * w)], axis=-1).astype("<f4").reshape(h, w, 2)
    raw = struct.pack("<II", h, w) + iq.tobytes()
    path.write_bytes(raw[: len(raw) - cut])
    return iq


class Counted:
    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.read += n
        return self.raw[at : at + n]


def test_a_window_reads_its_own_bytes(tmp_path):
    iq = tile_file(tmp_path / "a.dat", 300, 400)
    file = Counted((tmp_path / "a.dat").read_bytes())
    assert tiles.header(file) == (300, 400)
    assert (tiles.read_rows(file, 400, 20, 25, 100, 110) == iq[20:25, 100:110]).all()
    assert file.read == 8 + 5 * 10 * 8
    assert (tiles.read_rows(file, 400, 7, 9, 0, 400) == iq[7:9]).all() and file.read == 8 + 400 + 2 * 400 * 8


@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_windows_of_files(spark, tmp_path, split):
    tiles.register(spark)
    whole = {f"t{k}.dat": tile_file(tmp_path / f"t{k}.dat", h, w) for k, (h, w) in enumerate([(50, 20), (3, 20), (50, 4), (1, 1)])}
    tile_file(tmp_path / "short.dat", 9, 9, cut=4)
    (tmp_path / "empty.dat").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    read = spark.read.format("patch_tiles").options(path=str(tmp_path), split=split)
    options = {"row": "2", "rows": "30", "col": "3", "cols": "9"}
    for lines, rows, cols in ((read.load(), slice(None), slice(None)), (read.options(**options).load(), slice(2, 32), slice(3, 12))):
        found: dict = {}
        for r in lines.collect():
            found.setdefault(r.path.rpartition("/")[2], []).append(r)
        assert all(len(found[x]) == 1 and found[x][0].h is None for x in ("short.dat", "empty.dat")) and "_hidden" not in found
        for name, iq in whole.items():
            own = sorted(found.get(name, []), key=lambda r: r.row)
            part = iq[rows, cols]
            assert [r.row for r in own] == list(range(iq.shape[0]))[rows] * bool(part.size)
            assert [r.i for r in own] == (part[..., 0].tolist() if part.size else []) and [r.q for r in own] == (part[..., 1].tolist() if part.size else [])
    parts = tiles.TileReader({"path": str(tmp_path), "split": split}).partitions()
    assert (len(parts) > 5) == (split == 1000) and all(p.end is None or p.end - p.first < 50 for p in parts)


def test_tile_pixels(spark):
    tiles.register(spark)
    content = struct.pack("<II", 2, 3) + np.arange(12, dtype="<f4").tobytes()
    images(spark, [(1, content), (2, content[:-1]), (3, None), (4, b"")]).createOrReplaceTempView("contents_of_test")
    found = spark.sql("SELECT path, p.* FROM contents_of_test, LATERAL tile_pixels(content) AS p").collect()
    assert sorted(map(tuple, found)) == [(1, k // 3, k % 3, 2.0 * k, 2.0 * k + 1) for k in range(6)]


# ------------------------------------------------------------------- bursts
SCHEMA = "stream bigint, seq bigint, swath string, ts timestamp, ends boolean"


def runs(pulses):
    told, last, count = [], None, {}
    for stream, seq, swath, us in sorted(pulses, key=lambda p: (p[0], p[3], p[1])):
        if last and last[:2] == [stream, swath]:
            last[4:] = [us, last[5] + 1]
            continue
        count[stream, swath] = count.get((stream, swath), 0) + 1
        last = [stream, swath, count[stream, swath], us, us, 1]
        told.append(last)
    return sorted(map(tuple, told))


def put(spark, folder, rows):
    spark.createDataFrame(rows, "stream bigint, seq bigint, swath string, us bigint, ends boolean").selectExpr("stream", "seq", "swath", "timestamp_micros(us) AS ts", "ends").coalesce(1).write.mode("append").parquet(folder)


def bursts(spark, folder):
    told = spark.read.schema(keyed.OUT).parquet(folder).collect()
    return sorted(tuple(r)[:6] for r in told if not r.late), [r for r in told if r.late]


def test_keyed_bursts_equal_the_batch(spark, tmp_path):
    rng, base = random.Random(2), str(tmp_path)
    pulses = [(s, k, rng.choice(["IW1", "IW2", "IW3"]), 1000 * (k // 2)) for s in (1, 2) for k in range(120)]
    late = (1, 999, "IW1", 5)
    jittered = sorted(pulses, key=lambda p: p[3] + rng.randint(0, 5000))  # overtaken by less than the delay
    for k in range(4):  # each start goes on from the checkpoint
        part = [(*p, False) for p in jittered[60 * k : 60 * k + 60]]
        part += [(*late, False)] if k == 2 else [(s, None, None, None, True) for s in (1, 2)] if k == 3 else []
        rng.shuffle(part)
        put(spark, f"{base}/in", part)
        keyed.start_keyed_bursts(spark, f"{base}/in", SCHEMA, f"{base}/checkpoint", f"{base}/out", delay_us=10_000).awaitTermination()
    told, behind = bursts(spark, f"{base}/out")
    assert told == runs(pulses) and [(r.stream, r.swath, r.start_us) for r in behind] == [(1, "IW1", 5)]
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{base}/checkpoint")
    open_bursts = spark.read.format("statestore").option("stateVarName", "open").load(f"{base}/checkpoint")
    assert held.count() == 0 and open_bursts.count() == 0


def test_idle_streams_are_flushed(spark, tmp_path):
    base = str(tmp_path)
    put(spark, f"{base}/in", [(7, 1, "IW1", 10, False), (7, 2, "IW2", 20, False), (7, 3, "IW2", 30, False)])
    query = keyed.start_keyed_bursts(spark, f"{base}/in", SCHEMA, f"{base}/checkpoint", f"{base}/out", delay_us=1000, idle_ms=1500)
    try:
        until, told = time.time() + 60, []
        while len(told) < 2 and time.time() < until:
            time.sleep(1)
            told = bursts(spark, f"{base}/out")[0]
    finally:
        query.stop()
    assert told == [(7, "IW1", 1, 10, 10, 1), (7, "IW2", 1, 20, 30, 2)]


def test_bursts_by_ranges_equal_keyed_ones(spark, tmp_path):
    pulses = [(1, k, "IW1" if k % 7 < 4 else "IW2", 10 * k) for k in range(50)]
    put(spark, f"{tmp_path}/in", [(*p, False) for p in pulses])
    jobs.run_bursts(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    told = jobs.latest_bursts(spark.read.parquet(f"{tmp_path}/out/updates").drop("batch")).select("stream", "swath", "burst", "start_us", "stop_us", "n").collect()
    assert sorted(map(tuple, told)) == runs(pulses)


# -------------------------------------------------------------------- masks
def test_mask_strategies(spark):
    from swathframe.operators import masks

    tiles = spark.createDataFrame([(1, "/a/train/x/RFI_7_scaled.npy"), (2, "/train/val/rc/rfi_8.npy"), (3, "/a/other/RFI_9.npy"), (4, "/a/val/none.npy"), (5, "/a/test2/RFI_5.npy"), (6, None)], "doc_id int, path string")
    known = [(1, "/a/train/mask/DB_OPENSAR_RFI_7_MASK.png"), (1, "/a/train/mask/db_opensar_rfi_7_mask.png"), (2, "/train/val/mask/db_opensar_rfi_8_mask.png"), (2, "/train/mask/DB_OPENSAR_RFI_8_MASK.png"), (3, "/a/other/mask/DB_OPENSAR_RFI_9_MASK.png")]
    found = {r.doc_id: r for r in masks.resolve_masks(tiles, spark.createDataFrame(known, "doc_id int, path string"), "split_folder").collect()}
    assert len(found) == 6 and (found[1].mask, found[2].mask) == (known[0][1], known[2][1])
    assert all(found[k].mask is None for k in (3, 4, 5, 6)) and found[3].reason == found[4].reason == found[6].reason == "no candidate" and found[5].reason.startswith("not found: /a/test2/mask/DB_OPENSAR_RFI_5_MASK.png, ")
    own = masks.resolve_masks(tiles, tiles, lambda t, m: t.withColumnRenamed("path", "mask"))
    assert own.columns == ["doc_id", "mask"]
    with pytest.raises(ValueError, match="unknown strategy"):
        masks.resolve_masks(tiles, tiles, "other")
