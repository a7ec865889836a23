"""Which mask belongs to a tile: strategies by name, or any function of (tiles, masks).

A strategy gives every tile once, with ``mask``, the path of its mask or null. New ones are
registered under a name; most are a list of paths to try, as columns over the tile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Strategy = Callable[[DataFrame, DataFrame], DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    def register(found: Strategy) -> Strategy:
        STRATEGIES[name] = found
        return found

    return register


def resolve_masks(tiles: DataFrame, masks: DataFrame, by: str | Strategy) -> DataFrame:
    """``tiles`` with ``mask`` under a strategy."""
    if isinstance(by, str) and by not in STRATEGIES:
        raise ValueError(f"unknown strategy {by}; known: {', '.join(sorted(STRATEGIES))}")
    return (STRATEGIES[by] if isinstance(by, str) else by)(tiles, masks)


def first_existing(tiles: DataFrame, masks: DataFrame, candidates: Column, path: str = "path") -> DataFrame:
    """``tiles`` with ``mask``, the first of an array of candidate paths that ``masks`` has, and ``reason`` where there is none.

    Tiles are told apart by their path; each candidate meets the paths of masks in an
    equality join. Null candidates are skipped.
    """
    tried = tiles.select(path, candidates.alias("tried")).dropDuplicates([path]).select(path, F.posexplode("tried").alias("rank", "mask")).where("mask IS NOT NULL")
    known = masks.select(F.col("path").alias("mask")).distinct()
    found = tried.join(known, "mask").groupBy(path).agg(F.min_by("mask", "rank").alias("mask"))
    joined = tiles.join(found, path, "left")
    sought = F.array_compact(F.coalesce(candidates, F.array().cast("array<string>")))
    reason = F.when(F.col("mask").isNotNull(), F.lit(None)).when(F.size(sought) == 0, "no candidate").otherwise(F.concat(F.lit("not found: "), F.array_join(sought, ", ")))
    return joined.withColumn("reason", reason)


@strategy("by_id")
def by_id(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """The mask with the tile's ``doc_id``, the smallest path of several."""
    return tiles.join(masks.groupBy("doc_id").agg(F.min("path").alias("mask")), "doc_id", "left")


#: Folders that mark a split, and names of masks with the number in place of {}.
SPLIT_FOLDERS = ("train", "val", "test2")
MASK_NAMES = ("DB_OPENSAR_RFI_{}_MASK.png", "db_opensar_rfi_{}_mask.png")


@strategy("split_folder")
def in_split_folder(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """The mask in folder ``mask`` of the nearest split folder above the tile that has the number after RFI_ in the tile's name."""
    folder = F.regexp_extract("path", rf"(?i)^((?:.*/)?(?:{'|'.join(SPLIT_FOLDERS)}))/", 1)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    number = F.regexp_extract(name, r"(?i)RFI_(\d+)", 1)
    paths = F.array(*[F.concat(folder, F.lit("/mask/"), F.replace(F.lit(n), F.lit("{}"), number)) for n in MASK_NAMES])
    return first_existing(tiles, masks, F.when((folder != "") & (number != ""), paths))
