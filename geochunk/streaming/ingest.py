"""The same transforms on a stream of delivered element versions.

The batch engine has no streaming counterpart to match; here the stateless part of the pipeline (cleaning, tiling,
classification of nodes) runs on each micro-batch, with late deliveries dropped by watermark and repeated ones by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geochunk.config import Grid, Rules
from geochunk.functions.geometry import point
from geochunk.operators.classify import classify
from geochunk.operators.elements import is_located
from geochunk.operators.tags import clean
from geochunk.operators.tiling import assign_tiles


def distinct_deliveries(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each (id, version) once, its repeats within ``late`` of the newest loaded_at dropped with bounded state."""
    return stream.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["id", "version"])


def classify_nodes(nodes: DataFrame, grids: list[Grid], tiles: DataFrame, rules: Rules) -> DataFrame:
    """Visible located nodes by chunk_id, block_key and slice_value; works on any batch of rows."""
    n = clean(nodes.where(F.col("visible") & is_located(F.col("lon"), F.col("lat"))))
    holes = F.array().cast("array<array<struct<lon:int,lat:int>>>")
    e = n.select(F.lit("N").alias("type"), "id", "version", "loaded_at", F.array(point(F.col("lon"), F.col("lat"))).alias("pts"), holes.alias("holes"), "tags")
    return classify(assign_tiles(e, grids, tiles), rules)


def stream_nodes(stream: DataFrame, grids: list[Grid], tiles: DataFrame, rules: Rules, path: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Append classified nodes to a Parquet folder by chunk; each micro-batch is written under its number, so that one
    repeated after a failure replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        classify_nodes(batch, grids, tiles, rules).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return distinct_deliveries(stream, late).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Deliveries and deletions per hour of loaded_at: a tumbling window with a watermark."""
    w = stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", "1 hour"))
    return w.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("visible")).alias("n_deleted")).select(F.col("window.start").alias("hour"), "n_rows", "n_deleted")
