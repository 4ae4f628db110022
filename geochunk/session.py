"""Session helpers: shared work folder, lineage cuts, size-checked broadcasts.

All intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``; where that is unset a local folder
is chosen if the session runs on one machine, and else an error is raised.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000

_RUN = uuid.uuid4().hex
_used: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder of this run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="geochunk-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/geochunk-{_RUN}"
    _used.setdefault(path, spark)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables made so far. To be called when the results that were asked for are written: frames
    not worked out yet may read them. Whatever is left is deleted when the process ends."""
    _delete(spark, work_dir(spark))


def _cleanup() -> None:
    for path, spark in _used.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now
            pass


atexit.register(_cleanup)


def materialize(df: DataFrame, name: str = "t", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, a lost executor costs no recomputation
    of what lies before, and the planner knows the true size of the result. ``by``: columns to keep folders apart by."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if a count proves it to hold at most ``max_rows`` rows, else ``df`` (a shuffle join with AQE
    skew handling follows)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def apart(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle, never broadcast: it grows with the data, however small its compressed file looks
    to the planner."""
    return df.hint("shuffle_merge")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='geochunk-code-')}/geochunk", "zip", package.parent, package.name))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the session time zone is set to UTC, which all timestamp arithmetic assumes."""
    ship_code(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
