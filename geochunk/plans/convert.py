"""From element tables to the clustered feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geochunk.config import Grid, Options, default_rules, default_tiles
from geochunk.functions.geometry import oriented
from geochunk.operators.classify import classify
from geochunk.operators.resolve import all_elements
from geochunk.operators.tags import clean, preserve
from geochunk.operators.tiling import assign_tiles, bbox, useful_tiles
from geochunk.session import materialize
from geochunk.sources.read import Dataset


def data_tiles(spark: SparkSession, nodes: DataFrame, grids: list[Grid]) -> DataFrame:
    """Rectangles meeting the envelope of the nodes (one row visits the driver), or all without any node."""
    b = bbox(nodes).collect()[0]
    return useful_tiles(spark, grids, None if b["minlon"] is None else tuple(b))


def staged(data: Dataset) -> Dataset:
    """The same tables, each written once: whatever made them (versions resolved, tags cleaned) isn't done again by every
    branch that reads them, and a branch reads the columns it needs."""
    return Dataset(*(materialize(t, n) for t, n in zip((data.nodes, data.ways, data.relations), ("nodes", "ways", "relations"))))


def convert(data: Dataset, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(features, tiles). Features are elements by type, chunk_id, block_key and slice_value, areas oriented."""
    spark = data.nodes.sparkSession
    grids = default_tiles(options.tiles)
    data = staged(Dataset(*(preserve(clean(t), options.preserve) for t in (data.nodes, data.ways, data.relations))))
    tiles = materialize(data_tiles(spark, data.nodes, grids), "tiles")
    placed = materialize(assign_tiles(all_elements(data.nodes, data.ways, data.relations), grids, tiles), "elements")  # each type is read apart below
    rows = classify(placed, default_rules(options.rules), options.one_element)
    shell, holes = oriented(F.col("pts"), F.col("holes"), options.orientation == "exact")
    is_area = F.col("type") == "A"
    rows = rows.withColumns({"pts": F.when(is_area, shell).otherwise(F.col("pts")), "holes": F.when(is_area, holes).otherwise(F.col("holes"))})
    return rows, tiles
