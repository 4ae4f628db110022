"""Reading an extract of any format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geochunk.session import materialize
from geochunk.sources.files import input_files, open_file
from geochunk.sources.o5m import O5mSource
from geochunk.sources.pbf import PbfSource
from geochunk.sources.xml import read_xml

#: First bytes of the formats.
O5M_MAGIC, PBF_MAGIC = b"\xff\xe0\x04o5m2", b"\x0a\x09OSM"


@dataclass(frozen=True)
class Dataset:
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


def sniff(path: str) -> str:
    """``o5m``, ``pbf`` or ``xml`` by a file's first bytes, whatever its name; a file shorter than them raises EOFError."""
    with open_file(input_files(path)[0]) as f:
        head = f.read(9)
    if len(head) < 9:
        raise EOFError(f"{path} is too short")
    return "o5m" if head.startswith(O5M_MAGIC) else "pbf" if head[4:9] == PBF_MAGIC else "xml"


def read(spark: SparkSession, path: str, format: str | None = None, exact: bool = False) -> Dataset:
    """The three tables of an extract. A binary one is decoded once, whatever is asked for later: its elements are written
    to the work folder by kind, from which each table is read."""
    format = format or sniff(path)
    kinds = ("node", "way", "relation")
    if format == "xml":
        return Dataset(*(read_xml(spark, path, k, exact) for k in kinds))
    spark.dataSource.register(O5mSource if format == "o5m" else PbfSource)
    every = spark.read.format("o5m" if format == "o5m" else "osmpbf").option("kind", "any").load(path)
    every = materialize(every, "extract", ("kind",))
    meta = ("id", "version", "timestamp", "changeset", "uid", "user")
    own = {"node": ("lon", "lat"), "way": ("nds",), "relation": ("members",)}
    return Dataset(*(every.where(F.col("kind") == k).select(*meta, *own[k], "tags") for k in kinds))
