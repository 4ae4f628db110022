"""The clustered layout on disk, and reads that touch only what they need.

A dataset is a folder: features/ (Parquet by type and chunk_id, sorted by key and value order inside, so that row-group
statistics stand in for jump tables), tiles/, rules/, chunks/ (the index) and header/.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geochunk.config import Options, default_rules, rules_table
from geochunk.operators.tiling import envelope
from geochunk.schema import TYPES
from geochunk.session import broadcast_checked

#: Rows a file of a chunk should hold; larger chunks get more files, so that no task writes a hot chunk alone.
FILE_ROWS = 2_000_000

VERSION = 1


def chunk_index(features: DataFrame, tiles: DataFrame) -> DataFrame:
    """(type, chunk_id, n_features, minlon, minlat, maxlon, maxlat); no bounds for the chunk after the last tile."""
    counts = features.groupBy("type", "chunk_id").agg(F.count("*").alias("n_features"))
    t = tiles.select(F.col("tile_id").alias("chunk_id"), "minlon", "minlat", "maxlon", "maxlat")
    return counts.join(broadcast_checked(t), "chunk_id", "left").select("type", "chunk_id", "n_features", "minlon", "minlat", "maxlon", "maxlat")


def clustered(features: DataFrame, index: DataFrame) -> DataFrame:
    """Features in write order: one or more shuffle partitions per (type, chunk), sorted by key, value, id."""
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    files = index.select("type", "chunk_id", F.ceil(F.col("n_features") / FILE_ROWS).cast("int").alias("files"))
    f = features.join(broadcast_checked(files), ["type", "chunk_id"])
    f = f.withColumn("part", F.pmod(F.xxhash64("id"), F.col("files"))).withColumn("type_ord", order)
    return f.repartition("type", "chunk_id", "part").sortWithinPartitions("type_ord", "chunk_id", "part", "key_ord", "value_ord", "id").drop("files", "part", "type_ord")


def write(features: DataFrame, tiles: DataFrame, path: str, options: Options = Options()) -> None:
    """Write a dataset; an existing path raises."""
    spark = features.sparkSession
    index = chunk_index(features, tiles)
    index.write.parquet(f"{path}/chunks")
    index = spark.read.parquet(f"{path}/chunks")
    clustered(features, index).write.option("compression", options.compression).partitionBy("type", "chunk_id").parquet(f"{path}/features")
    tiles.write.parquet(f"{path}/tiles")
    rules_table(spark, default_rules(options.rules)).write.parquet(f"{path}/rules")
    head = (VERSION, options.feature_bits, options.compression, list(options.preserve))
    spark.createDataFrame([head], "version int, features int, compression string, preserved array<string>").write.json(f"{path}/header")


def read_features(
    spark: SparkSession,
    path: str,
    box: tuple[int, int, int, int] | None = None,
    types: Sequence[str] | None = None,
    key: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """Features of some types, key and value whose envelope meets a box (minlon, minlat, maxlon, maxlat).

    Types and chunks prune folders, key and value row groups; the envelope is tested on the rows left. The chunk after
    the last tile (no bounds) is always read: its lines may cross anything. Without a box collections come too.
    """
    f = spark.read.parquet(f"{path}/features")
    if types:
        f = f.where(F.col("type").isin(*types))
    if key is not None:
        f = f.where(F.col("block_key") == key)
    if value is not None:
        f = f.where(F.col("slice_value") == value)
    if box:
        x0, y0, x1, y1 = box
        index = spark.read.parquet(f"{path}/chunks")
        meets = (F.col("maxlon") >= x0) & (F.col("minlon") <= x1) & (F.col("maxlat") >= y0) & (F.col("minlat") <= y1)
        ids = [r[0] for r in index.where(F.col("minlon").isNull() | meets).select("chunk_id").distinct().collect()]  # at most the number of tiles
        a = envelope(F.col("pts"))
        f = f.where(F.col("chunk_id").isin(*ids)).where((a[2] >= x0) & (a[0] <= x1) & (a[3] >= y0) & (a[1] <= y1))
    return f
