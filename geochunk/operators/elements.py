"""Element tables: current rows of versioned deliveries, live and located elements, and the terms of their tags."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tag keys that carry no information on the mapped thing and are left out of every element.
DISCARDABLE = (
    "created_by", "converted_by", "geobase:datasetName", "geobase:uuid", "gnis:import_uuid", "import_uuid",
    "KSJ2:ADS", "KSJ2:ARE", "KSJ2:AdminArea", "KSJ2:COP_label", "KSJ2:DFD", "KSJ2:INT", "KSJ2:INT_label", "KSJ2:LOC",
    "KSJ2:LPN", "KSJ2:OPC", "KSJ2:PubFacAdmin", "KSJ2:RAC", "KSJ2:RAC_label", "KSJ2:RIC", "KSJ2:RIN", "KSJ2:WSC",
    "KSJ2:coordinate", "KSJ2:curve_id", "KSJ2:curve_type", "KSJ2:filename", "KSJ2:lake_id", "KSJ2:lat", "KSJ2:long",
    "KSJ2:river_id", "odbl", "odbl:note", "osmarender:nameDirection", "osmarender:renderName", "osmarender:renderRef",
    "osmarender:rendernames", "SK53_bulk:load", "sub_sea:type", "tiger:upload_uuid", "tiger:tlid", "tiger:source",
    "tiger:separated", "yh:LINE_NAME", "yh:LINE_NUM", "yh:STRUCTURE", "yh:TOTYUMONO", "yh:TYPE", "yh:WIDTH",
    "yh:WIDTH_RANK",
)

MAX_LON, MAX_LAT = 1_800_000_000, 900_000_000

#: Cut at both ends of a term: blank, tab, no-break space.
_EDGE = " \t\u00a0"


def current_rows(df: DataFrame, cols: Sequence[str], earliest: bool = False) -> DataFrame:
    """One row per id: of its highest version the delivery loaded first, with ``id``, ``visible``, ``loaded_at`` and ``cols``.

    With ``earliest`` also ``first_loaded``, the smallest loaded_at of all rows of the id. Rows without id are no
    elements and are left out; a null version or loaded_at ranks last; rows equal in both are told apart by visible,
    timestamp, changeset and uid where present, so repeated deliveries give one row. Columns beyond those named may
    exist under any name. ``max_by`` combines map-side, so an id delivered millions of times is no hot group.
    """
    # an aggregate function can't take a map as its value here; entries keep order and null values
    cols = [c for c in cols if c not in ("id", "visible", "loaded_at")]
    tie = [F.col(c) for c in ("visible", "timestamp", "changeset", "uid") if c in df.columns]
    order = F.struct(F.col("version"), -F.unix_micros("loaded_at"), *tie)
    aggs = [F.max_by(F.struct("visible", "loaded_at", *cols), order).alias("r")]
    if earliest:
        aggs.append(F.min("loaded_at").alias("first_loaded"))
    out = df.where(F.col("id").isNotNull()).groupBy("id").agg(*aggs)
    return out.select("id", "r.*", *(["first_loaded"] if earliest else []))


def live(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Current rows that are visible; a null ``visible`` counts as not visible."""
    return current_rows(df, cols).where("visible").drop("visible")


def is_located(lon: Column, lat: Column) -> Column:
    """Whether a position is possible: both axes non-null, in range, and not both 0."""
    return F.coalesce(
        lon.between(-MAX_LON, MAX_LON) & lat.between(-MAX_LAT, MAX_LAT) & ~((lon == 0) & (lat == 0)), F.lit(False)
    )


def located(nodes: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """Live nodes with a possible position: id, lon, lat and ``cols``."""
    n = live(nodes, ["lon", "lat", *cols])
    return n.where(is_located(F.col("lon"), F.col("lat"))).select("id", "lon", "lat", *cols)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda a: None if a is None else [None if x is None else unicodedata.normalize("NFC", x) for x in a])


#: Marked so that the optimizer neither repeats it nor moves it into a generator, where Python can't be evaluated.
_nfc = _nfc.asNondeterministic()


def with_terms(df: DataFrame, tags: str = "tags", out: str = "terms") -> DataFrame:
    """Adds ``out``: array<struct<tag_key,term>>, one entry per occurrence, in map order.

    A term is a tag key with a piece of its value: values are split at ``;``, pieces brought to NFC, trimmed and
    lowered; empty pieces, null values and discardable keys give none. Null or empty tags give an empty array.
    Only values with a character from U+0300 on can change under NFC, so only those elements' pieces travel to Python.
    """
    entries = F.filter(F.map_entries(tags), lambda e: e["value"].isNotNull() & ~e["key"].isin(*DISCARDABLE))
    pairs = F.flatten(
        F.transform(
            entries, lambda e: F.transform(F.split(e["value"], ";"), lambda p: F.struct(e["key"].alias("k"), p.alias("p")))
        )
    )
    df = df.withColumn("_pairs", F.coalesce(pairs, F.array().cast("array<struct<k:string,p:string>>")))
    hard = F.exists("_pairs", lambda x: x["p"].rlike("[^\\x{0}-\\x{2FF}]"))
    df = df.withColumn("_nfc", _nfc(F.when(hard, F.transform("_pairs", lambda x: x["p"]))))
    piece = lambda x, i: F.coalesce(F.get("_nfc", i), x["p"])
    norm = lambda p: F.lower(F.trim(p, F.lit(_EDGE)))
    terms = F.transform("_pairs", lambda x, i: F.struct(x["k"].alias("tag_key"), norm(piece(x, i)).alias("term")))
    return df.withColumn(out, F.filter(terms, lambda t: t["term"] != "")).drop("_pairs", "_nfc")


def all_live_tags(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """UNION ALL of the live elements of three tables: kind, id, tags. Ids overlap between kinds."""
    parts = [live(t, ["tags"]).select(F.lit(k).alias("kind"), "id", "tags") for k, t in (("n", nodes), ("w", ways), ("r", relations))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
