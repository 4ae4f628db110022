"""Command line: ``python -m geochunk.cli [options] input [output]``."""

from __future__ import annotations

import argparse
import logging
import time
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

from pyspark.sql import SparkSession

from geochunk.config import Options, parse_preserve
from geochunk.operators.tiling import bbox
from geochunk.plans.convert import convert
from geochunk.sources import container, sink
from geochunk.sources.read import read

#: Letters of large numbers, each a thousand times the one before.
LETTERS = "KMGTE"


def readable(n: int) -> str:
    """Numbers from 1000 on in three digits and a letter, rounded half up: 1.23K, 12.3M, 123G."""
    if n < 1000:
        return str(n)
    group, place = divmod(len(str(n)) - 1, 3)
    shown = Decimal(repr(n / 1000**group)).quantize(Decimal(1).scaleb(place - 2), ROUND_HALF_UP)
    return f"{shown}{LETTERS[group - 1]}"


def from_readable(text: str) -> int:
    """The inverse: digits, or digits and a letter; a single character is no number here."""
    text = text.strip()
    if len(text) < 2:
        raise ValueError(f"no number: {text!r}")
    if text[-1].upper() in LETTERS:
        return int(text[:-1]) * 1000 ** (LETTERS.index(text[-1].upper()) + 1)
    return int(text)


def replace_extension(path: str, extension: str) -> str:
    """The path with another extension, or with one added where it has none."""
    p = Path(path)
    return str(p.with_name((p.name.rpartition(".")[0] or p.name) + "." + extension))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geochunk", description=__doc__)
    p.add_argument("input", help="XML, O5M or PBF extract, a file or a folder")
    p.add_argument("output", nargs="?", help="folder, or a file when it ends in .gch")
    p.add_argument("-b", "--tiles", help="file with tile grids")
    p.add_argument("-t", "--rules", help="file with tag rules")
    p.add_argument("-p", "--preserve", type=parse_preserve, default=(), help="id,version,timestamp,changeset,user, all or none")
    p.add_argument("-0", "--uncompressed", action="store_true")
    p.add_argument("-1", "--one-element", action="store_true", help="only the first matching key of each element")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-s", "--silent", action="store_true")
    p.add_argument("-c", "--shuffle-partitions", type=from_readable, help="chunks worked on apart")
    p.add_argument("-m", "--memory", help="driver memory, as Spark has it")
    p.add_argument("-tmp", "--temp", help="folder for intermediate tables, shared by all executors")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.ERROR if a.silent else logging.INFO if a.verbose else logging.WARNING, format="%(message)s")
    conf = {"spark.sql.session.timeZone": "UTC"}
    if a.shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(a.shuffle_partitions)
    if a.memory:
        conf["spark.driver.memory"] = a.memory
    if a.temp:
        conf["spark.checkpoint.dir"] = a.temp
    spark = SparkSession.builder.appName("geochunk").config(map=conf).getOrCreate()
    began = time.time()
    options = Options(tiles=a.tiles, rules=a.rules, preserve=a.preserve, one_element=a.one_element, compression="none" if a.uncompressed else "zstd")
    out = a.output or replace_extension(a.input, "gch")
    data = read(spark, a.input)
    features, tiles = convert(data, options)
    if out.endswith(".gch"):
        b = bbox(data.nodes).collect()[0]
        container.write_container(features, tiles, out, options, container.NO_BOUNDS if b[0] is None else tuple(b))
    else:
        sink.write(features, tiles, out, options)
    logging.info("%s written in %.0f s", out, time.time() - began)


if __name__ == "__main__":
    main()
