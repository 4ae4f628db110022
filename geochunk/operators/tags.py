"""Tags and metadata of elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geochunk.operators.elements import DISCARDABLE
from geochunk.schema import META


def without_discardable(tags: Column | str) -> Column:
    """The tags but for discardable keys; null becomes an empty map, null values become empty texts."""
    tags = F.coalesce(F.col(tags) if isinstance(tags, str) else tags, F.create_map().cast("map<string,string>"))
    return F.transform_values(F.map_filter(tags, lambda k, v: ~k.isin(*DISCARDABLE)), lambda k, v: F.coalesce(v, F.lit("")))


def clean(df: DataFrame) -> DataFrame:
    """Elements with discardable tags removed."""
    return df.withColumn("tags", without_discardable("tags"))


def discarded(df: DataFrame) -> Column:
    """How many tags ``clean`` removes, as an aggregate."""
    return F.sum(F.size(F.filter(F.map_keys("tags"), lambda k: k.isin(*DISCARDABLE))))


def preserve(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Metadata not in ``keep`` become 0 or '' (user goes with uid); null values too."""
    keep = {*keep, *(["uid"] if "user" in keep else [])}
    zero = {"user": F.lit("")}
    for c in META:
        z = zero.get(c, F.lit(0))
        df = df.withColumn(c, (F.coalesce(F.col(c), z) if c in keep else z).cast(df.schema[c].dataType))
    return df
