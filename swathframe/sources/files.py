"""Readers and writers of the dataset's file formats: CSV tables, label and annotation XML, binary tiles, JSON statistics."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path as scratch
from .tiles import opened


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c.lower() not in {x.lower() for x in df.columns}]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def round_trip_csv(df: DataFrame, sep: str = ",") -> DataFrame:
    """Written as CSV with a header and read back under the same schema."""
    path = scratch(df.sparkSession, "csv")
    df.write.csv(path, header=True, sep=sep, emptyValue="", nullValue="")
    return df.sparkSession.read.csv(path, header=True, sep=sep, schema=df.schema)


def read_mapping(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Scene mapping as strings: quotes and blanks off, rows without any value go."""
    raw = spark.read.csv(path, header=True, sep=sep, quote="", mode="PERMISSIVE")
    clean = raw.select(*[F.nullif(F.trim(F.regexp_replace(F.trim(F.col(f"`{c}`")), r"^[\"']+|[\"']+$", "")), F.lit("")).alias(c.strip(" \"'")) for c in raw.columns])
    return clean.dropna(how="all")


OPTIONAL_TRUTH = ["global_km", "xview_km", "confidence", "source"]


def read_truth(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Ground truth with its required columns; optional ones that a file lacks are null."""
    df = require_columns(spark.read.csv(path, header=True), required)
    for c in OPTIONAL_TRUTH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


TARGET_SCHEMA = "start_time timestamp, stop_time timestamp, latitude double, longitude double"


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TARGET_SCHEMA).withColumnsRenamed({"start_time": "start_ts", "stop_time": "stop_ts", "latitude": "lat", "longitude": "lon"})


LABEL_SCHEMA = "Scene_ID string, SARProduct string, Number_of_ships string, List_of_ships struct<Ship:array<struct<Name:string,Size:string,is_vessel:string,Is_Vessel_Alt:string>>>"
ANNOTATION_SCHEMA = "header struct<start:string,stop:string>, burstList struct<burst:array<struct<azimuthTime:string,line:int>>>, grid struct<point:array<struct<line:int,pixel:int,latitude:double,longitude:double>>>, generalAnnotation struct<orbitList:struct<orbit:array<struct<time:string,position:struct<x:double,y:double,z:double>,velocity:struct<x:double,y:double,z:double>>>>>"


def parse_labels(texts: DataFrame, column: str = "text") -> DataFrame:
    """Nested label of each text; a single ship is an array of one, as the schema says."""
    return texts.withColumn("label", F.from_xml(F.col(column), LABEL_SCHEMA, {"rowTag": "label", "mode": "PERMISSIVE"}))


def ships_of(labels: DataFrame) -> DataFrame:
    return labels.select("*", F.posexplode_outer("label.List_of_ships.Ship").alias("ship_pos", "ship"))


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Header, burst, grid and orbit tables of a tree of annotation files, keyed by file and start of the product.

    orbit: state vectors with their seconds since the first of the product.
    """
    product = spark.read.format("xml").option("rowTag", "product").schema(ANNOTATION_SCHEMA).load(path).select(F.col("_metadata.file_name").alias("file"), "*")
    key = ["file", F.col("header.start").alias("start")]
    vectors = F.col("generalAnnotation.orbitList.orbit")
    time = lambda c: F.unix_micros(F.to_timestamp(c))
    orbit = product.select(*key, vectors[0]["time"].alias("t0"), F.posexplode(vectors).alias("orbit", "o"))
    return {
        "header": product.select("file", "header.*"),
        "burst": product.select(*key, F.posexplode("burstList.burst").alias("burst", "b")).select("file", "start", "burst", "b.*"),
        "grid": product.select(*key, F.explode("grid.point").alias("g")).select("file", "start", "g.*"),
        "orbit": orbit.select("file", "start", "orbit", ((time(F.col("o.time")) - time(F.col("t0"))) / 1e6).alias("t"), "o.position.*", *[F.col(f"o.velocity.{c}").alias(f"v{c}") for c in "xyz"]),
    }


def scene_of_content(content, limit: int = 131072):
    """SARProduct from the first bytes of a file; from the whole where they do not hold it."""
    pattern = r"(?is)<SARProduct>\s*([^<]*?)\s*</SARProduct>"
    first = F.regexp_extract(F.decode(F.substring(content, 1, limit), "UTF-8"), pattern, 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.regexp_extract(F.decode(content, "UTF-8"), pattern, 1), F.lit("")))


def file_inventory(spark: SparkSession, root: str, extensions: list[str], tokens: list[str] | None = None) -> DataFrame:
    """(path, name, ext, file_id): names only; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root).select("path")
    named = listed.withColumn("name", F.substring_index("path", "/", -1)).withColumn("ext", F.substring_index("name", ".", -1))
    for token in tokens or []:
        named = named.where(F.col("name").contains(token))
    return named.withColumn("file_id", F.regexp_extract("name", r"_(\d+)[^_]*$", 1).try_cast("bigint"))


def decode_l0(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content) to (key, h, w, i, q): ``<II`` rows and columns, then pairs of float32; a short file is an error row with h null."""
    for batch in batches:
        rows = {"key": batch.column(0), "h": [], "w": [], "i": [], "q": []}
        for raw in batch.column(1).to_pylist():
            h = w = i = q = None
            if raw is not None and len(raw) >= 8:
                h, w = struct.unpack_from("<II", raw)
                if len(raw) >= 8 + 8 * h * w:
                    iq = np.frombuffer(raw, "<f4", 2 * h * w, 8)
                    i, q = iq[0::2], iq[1::2]
                else:
                    h = w = None
            for k, v in (("h", h), ("w", w), ("i", i), ("q", q)):
                rows[k].append(v)
        yield pa.RecordBatch.from_arrays([rows["key"], pa.array(rows["h"], pa.int32()), pa.array(rows["w"], pa.int32()), pa.array(rows["i"], pa.list_(pa.float32())), pa.array(rows["q"], pa.list_(pa.float32()))], list(rows))


def read_l0(contents: DataFrame, key: str = "path") -> DataFrame:
    """Tiles of a table (key, content), such as the binaryFile source gives."""
    kind = contents.schema[key].dataType.simpleString()
    return contents.select(F.col(key).alias("key"), "content").mapInArrow(decode_l0, f"key {kind}, h int, w int, i array<float>, q array<float>")


def iq_of(a: np.ndarray) -> list[np.ndarray]:
    """Finite (h, w) parts of a complex, (h, w, 2) or (2, h, w) array."""
    if np.iscomplexobj(a) and a.ndim == 2:
        parts = a.real, a.imag
    elif a.ndim == 3 and a.shape[-1] == 2:
        parts = a[..., 0], a[..., 1]
    elif a.ndim == 3 and a.shape[0] == 2:
        parts = a[0], a[1]
    else:
        raise ValueError(f"no tile: shape {a.shape}")
    return [np.nan_to_num(x.astype(np.float32), nan=0, posinf=0, neginf=0) for x in parts]


def decode_npy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content) of .npy tiles: complex, (H, W, 2) or (2, H, W); NaN and infinities become 0. What is no tile, damaged or null is an error row with h null."""
    for batch in batches:
        keys, out = [], {"h": [], "w": [], "i": [], "q": []}
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                i, q = iq_of(np.load(io.BytesIO(raw or b""), allow_pickle=False))
                found = (i.shape[0], i.shape[1], i.ravel(), q.ravel())
            except (ValueError, EOFError, OSError):
                found = (None, None, None, None)
            keys.append(key)
            for k, v in zip(out, found):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(out["h"], pa.int32()), pa.array(out["w"], pa.int32()), pa.array(out["i"], pa.list_(pa.float32())), pa.array(out["q"], pa.list_(pa.float32()))], ["key", *out])


def read_npy(contents: DataFrame, key: str = "path") -> DataFrame:
    kind = contents.schema[key].dataType.simpleString()
    return contents.select(F.col(key).alias("key"), "content").mapInArrow(decode_npy, f"key {kind}, h int, w int, i array<float>, q array<float>")


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """(key, r, c, i, q): a row a pixel of row-major tiles."""
    pairs = F.arrays_zip("i", "q")
    return tiles.select("key", "w", F.posexplode(pairs).alias("p", "v")).select("key", F.expr("p div w").cast("int").alias("r"), (F.col("p") % F.col("w")).alias("c"), F.col("v.i").alias("i"), F.col("v.q").alias("q"))


# sinks


def write_matches(matches: DataFrame, path: str) -> None:
    matches.drop("min_distance_deg").write.csv(path, header=True)


def write_listed_matches(lists: DataFrame, path: str, compression: str = "none") -> None:
    """The match table of ``write_matches`` from rows (target_id, product_ids: strings without null): the lines of a row are joined at once, in files that end in .txt."""
    own, header = "coalesce(CAST(target_id AS STRING), '')", "target_id,product_id"
    lines = F.expr(f"concat({own}, ',', array_join(product_ids, concat('\n', {own}, ',')))")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of a file
    lists.select(F.concat(F.when(first, F.lit(header + "\n")).otherwise(""), lines).alias("value")).write.options(maxRecordsPerFile=0, compression=compression).text(path)
    if lists.sparkSession.read.text(path).isEmpty():
        lists.sparkSession.createDataFrame([(header,)], "value string").write.mode("append").option("compression", compression).text(path)


def number_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(path) of CSV files to their rows of whole numbers, read piece by piece."""
    kinds = csv.ConvertOptions(column_types={c: pa.int64() for c in names}, include_columns=names)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, inner = opened(path)
            with system.open_input_stream(inner) as file:
                yield from csv.open_csv(file, csv.ReadOptions(use_threads=False), convert_options=kinds)


def packed_lines(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes rows (keys, values: strings without null), a line for each of ``keys`` with each of ``values``, to one hidden file of ``folder`` and hands on its name.

    Ids go by length and size, as lines that change little from one to the next are packed closer.
    """
    system, path = opened(folder)
    order = lambda x: (len(x), x)
    name, out = f"part-{uuid.uuid4().hex}.csv.zst", None
    for batch in batches:
        for keys, values in zip(batch.column("keys").to_pylist(), batch.column("values").to_pylist()):
            out, values = out or started(system, f"{path}/.{name}"), sorted(values, key=order)
            for key in sorted(keys, key=order):
                out.write(f"{key},{f'\n{key},'.join(values)}\n".encode())
    if out:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])


def started(system: fs.FileSystem, path: str) -> pa.NativeFile:
    """A new compressed match table, with its header."""
    out = system.open_output_stream(path, compression="zstd", buffer_size=1 << 20)
    out.write(b"target_id,product_id\n")
    return out


def write_packed_matches(matches: DataFrame, path: str) -> None:
    """The match table of ``write_matches`` from rows (keys, values) as in ``packed_lines``: every pair is a line, of files that end in .csv.zst.

    Files are hidden until their tasks have ended well, so that nothing of a failed attempt is
    read. Where Arrow has no access to the path, Spark writes the lines, compressed by gzip.
    """
    try:
        system, inner = opened(path)
    except (pa.ArrowException, OSError):
        return write_listed_matches(matches.select(F.explode("keys").alias("target_id"), F.col("values").alias("product_ids")), path, "gzip")
    system.create_dir(inner)
    names = [r.name for r in matches.select("keys", "values").mapInArrow(lambda batches: packed_lines(batches, path), "name string").collect()]  # one a task
    if not names:
        names = ["part-none.csv.zst"]
        started(system, f"{inner}/.{names[0]}").close()
    for name in names:
        system.move(f"{inner}/.{name}", f"{inner}/{name}")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, product_id) of a match table; a file is a task's, or split by Spark's own reader where Arrow has no access to the path."""
    schema = "target_id bigint, product_id bigint"
    try:
        opened(path)
    except (pa.ArrowException, OSError):
        return spark.read.csv(path, header=True, schema=schema)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    return files.mapInArrow(lambda batches: number_batches(batches, ["target_id", "product_id"]), schema)


def write_legend(patches: DataFrame, path: str) -> None:
    """patch_id, has_ship, swath: a folder a scene."""
    patches.select("scene", "patch_id", F.col("has_ship").cast("int").alias("has_ship"), "swath").write.partitionBy("scene").csv(path, header=True)


def write_results(results: DataFrame, path: str) -> None:
    results.withColumn("missing", F.array_join("missing", "; ")).withColumn("warnings", F.array_join("warnings", "; ")).write.csv(path, header=True)


def write_stats(stats: DataFrame, path: str, source: str) -> None:
    """A row of statistics with where it comes from."""
    stats.withColumn("source", F.lit(source)).coalesce(1).write.json(path)


def write_flat(rows: DataFrame, path: str) -> None:
    """Blanks for nulls."""
    rows.write.csv(path, header=True, emptyValue="", nullValue="")


def write_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.partitionBy("filter_mode").csv(path, header=True)
