"""Frequency of every distinct term: global integer dictionary, encoded postings, count arrays per block of records,
arrays summed by identifier range."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geochunk.session import materialize

#: Identifiers per count array.
RANGE = 4096
#: Blocks of records that count apart from each other, so that a term held by a third of all records is spread.
BLOCKS = 32

_PID = 33  # monotonically_increasing_id keeps the partition above this bit


def dictionary(terms: DataFrame) -> DataFrame:
    """Dense integer identifiers 0..n-1 for the distinct rows of ``terms``: its columns and ``term_no``.

    Terms are numbered inside their hash partition and moved up by the sizes of the partitions before it; only these
    sizes (one number per partition) visit the driver.
    """
    cols = terms.columns
    d = terms.distinct().sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id())
    d = materialize(d, "dictionary")
    part = F.shiftright("_m", _PID)
    sizes = sorted(d.groupBy(part.alias("p")).count().collect())
    starts, at = {}, 0
    for p, n in sizes:
        starts[p], at = at, at + n
    offsets = d.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_p long, _start long")
    local = F.col("_m").bitwiseAND((1 << _PID) - 1)
    return d.join(F.broadcast(offsets), part == F.col("_p")).select(*cols, (F.col("_start") + local).alias("term_no"))


def _sum_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by identifier range; one pair of count arrays is held at a time."""
    now, occ, has = None, None, None

    def flush() -> pd.DataFrame:
        at = np.flatnonzero(has)
        return pd.DataFrame({"term_no": now * RANGE + at, "n_occurrences": occ[at], "n_elements": has[at]})

    for b in batches:
        r, off = b["rng"].to_numpy(), b["off"].to_numpy()
        o, h = b["occ"].to_numpy(), b["has"].to_numpy()
        cuts = np.flatnonzero(np.diff(r)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(r)]):
            if lo == hi:
                continue
            if now != r[lo]:
                if now is not None:
                    yield flush()
                now, occ, has = int(r[lo]), np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)
            np.add.at(occ, off[lo:hi], o[lo:hi])
            np.add.at(has, off[lo:hi], h[lo:hi])
    if now is not None:
        yield flush()


def term_frequencies(records: DataFrame, terms: str = "terms", min_records: int = 3, max_share: float = 0.05) -> DataFrame:
    """Occurrences and records of every distinct term, with a mark: ``rare`` below ``min_records`` records, ``common``
    above ``max_share`` of the records that have any term, else ``kept`` (rare wins where both hold).

    records: ``id`` (any type, only hashed into a block) and ``terms`` array<struct<...>>, one entry per occurrence.
    Result: the struct's fields, term_no, n_occurrences, n_elements, share, mark. Null or empty arrays hold no term and
    do not count as records with one; null fields inside a term are values like any other; repeated rows count as
    records of their own; an empty table gives no rows. Further columns are ignored.
    """
    fields = [f.name for f in records.schema[terms].dataType.elementType.fields]
    block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")
    held = records.select(block.alias("blk"), F.col(terms).alias("t")).where(F.size("t") > 0)
    # inside one record equal terms stand side by side, the first of them marked; the extra null entry counts the record
    held = held.withColumn("s", F.array_sort("t"))
    marked = F.transform("s", lambda x, i: F.struct(x.alias("d"), ((i == 0) | ~F.get("s", i - 1).eqNullSafe(x)).cast("long").alias("first")))
    none = F.array(F.struct(F.lit(None).cast(records.schema[terms].dataType.elementType).alias("d"), F.lit(1).cast("long").alias("first")))
    rows = held.select("blk", F.explode(F.concat(marked, none)).alias("e")).select(
        "blk", F.col("e.d").isNull().alias("total"), *(F.col(f"e.d.{f}").alias(f) for f in fields), F.col("e.first").alias("first")
    )
    partial = materialize(
        rows.groupBy("blk", "total", *fields).agg(F.count("*").alias("occ"), F.sum("first").alias("has")), "term-blocks"
    )
    n = partial.where("total").agg(F.sum("has")).collect()[0][0] or 0
    partial = partial.where("not total")
    words = materialize(dictionary(partial.select(*fields)), "terms")
    same = [partial[f].eqNullSafe(words[f]) for f in fields]
    on = same[0]
    for c in same[1:]:
        on &= c
    encoded = partial.join(words, on).select(
        (F.col("term_no") / RANGE).cast("long").alias("rng"), F.pmod("term_no", F.lit(RANGE)).cast("int").alias("off"), "occ", "has"
    )
    arrays = encoded.repartition("rng").sortWithinPartitions("rng")
    totals = arrays.mapInPandas(_sum_arrays, "term_no long, n_occurrences long, n_elements long")
    most = F.lit(Decimal(str(max_share)) * n)  # exact, so a term at the very share is no common one
    mark = F.when(F.col("n_elements") < min_records, "rare").when(F.col("n_elements") > most, "common").otherwise("kept")
    return words.join(totals, "term_no").select(
        *fields, "term_no", "n_occurrences", "n_elements", (F.col("n_elements") / F.lit(float(max(n, 1)))).alias("share"), mark.alias("mark")
    )
