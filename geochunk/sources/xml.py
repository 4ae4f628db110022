"""XML extracts, by Spark's own XML source: one scan per element kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_META = "_id bigint, _version int, _timestamp string, _changeset bigint, _uid int, _user string"
_TAG = "tag array<struct<_k:string,_v:string>>"
_ROWS = {
    "node": f"{_META}, _lat double, _lon double, {_TAG}",
    "way": f"{_META}, nd array<struct<_ref:bigint>>, {_TAG}",
    "relation": f"{_META}, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}",
}


def coordinate(degrees: Column, exact: bool = False) -> Column:
    """Degrees to units of 1e-7. By default half a unit is added and the rest cut toward zero, as layouts made that way
    expect (negative coordinates come out one unit higher); ``exact`` rounds half away from zero."""
    units = degrees * 10_000_000
    return (F.round(units) if exact else F.lit(0.5) + units).cast("int")


def read_xml(spark: SparkSession, path: str, kind: str, exact: bool = False) -> DataFrame:
    """Nodes, ways or relations of an XML file or folder, in the columns of geochunk.schema.

    Missing metadata are 0 or ''; a missing position is null; of a repeated tag key the last value counts; roles are ''
    where missing. Elements of other kinds, and bounds, are skipped.
    """
    raw = spark.read.format("xml").option("rowTag", kind).schema(_ROWS[kind]).load(path)
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    seconds = F.coalesce(F.unix_timestamp(F.try_to_timestamp("_timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))), F.lit(0))
    meta = [
        zero("_id", "bigint").alias("id"), zero("_version", "int").alias("version"), seconds.cast("bigint").alias("timestamp"),
        zero("_changeset", "bigint").alias("changeset"), zero("_uid", "int").alias("uid"), F.coalesce("_user", F.lit("")).alias("user"),
    ]
    tag = F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>"))
    n = F.size(tag)
    last = F.filter(tag, lambda t, i: t["_k"].isNotNull() & (F.size(F.filter(F.slice(tag, i + 2, n), lambda u: u["_k"] == t["_k"])) == 0))
    tags = F.map_from_entries(F.transform(last, lambda t: F.struct(t["_k"], F.coalesce(t["_v"], F.lit("")))))
    if kind == "node":
        own = [coordinate(F.col("_lon"), exact).alias("lon"), coordinate(F.col("_lat"), exact).alias("lat")]
    elif kind == "way":
        own = [F.coalesce(F.transform("nd", lambda x: x["_ref"]), F.array().cast("array<bigint>")).alias("nds")]
    else:
        m = F.transform("member", lambda x: F.struct(x["_type"].alias("type"), x["_ref"].alias("ref"), F.coalesce(x["_role"], F.lit("")).alias("role")))
        own = [F.coalesce(m, F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members")]
    return raw.select(*meta, *own, tags.alias("tags"))


def write_xml(df: DataFrame, kind: str, path: str) -> None:
    """One folder of XML files of one kind of element (the inverse of ``read_xml`` with exact coordinates)."""
    time = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = [F.col("id").alias("_id"), F.col("version").alias("_version"), F.when(F.col("timestamp") != 0, time).alias("_timestamp"), F.col("changeset").alias("_changeset"), F.col("uid").alias("_uid"), F.col("user").alias("_user")]
    tags = F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v"))).alias("tag")
    if kind == "node":
        degrees = lambda c: F.format_string("%.7f", F.col(c) / 1e7)
        own = [degrees("lat").alias("_lat"), degrees("lon").alias("_lon")]
    elif kind == "way":
        own = [F.transform("nds", lambda x: F.struct(x.alias("_ref"))).alias("nd")]
    else:
        own = [F.transform("members", lambda m: F.struct(m["type"].alias("_type"), m["ref"].alias("_ref"), m["role"].alias("_role"))).alias("member")]
    df.select(*meta, *own, tags).write.format("xml").option("rowTag", kind).option("rootTag", "osm").save(path)
