"""Queries of problems 1, 2, 8, 9 and 10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geochunk.llm.encoding import fit, garbled_documents
from geochunk.llm.mixing import BLOCK, mix_sources, shares_reached
from geochunk.llm.packing import fill_containers
from geochunk.llm.pairs import cooccurrence
from geochunk.llm.terms import term_frequencies
from geochunk.llm.tokens import token_counts
from geochunk.operators.elements import all_live_tags, with_terms
from geochunk.session import load, materialize


def _live_terms(spark: SparkSession, d: str) -> DataFrame:
    e = all_live_tags(load(spark, d, "nodes"), load(spark, d, "ways"), load(spark, d, "relations"))
    return with_terms(e.where(F.size("tags") > 0))


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    items = F.transform("terms", lambda t: F.concat(t["tag_key"], F.lit("="), t["term"]))
    return _live_terms(spark, d).select(items.alias("items"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare (fewer than 3 live elements) or too common (more than 5 %)."""
    return term_frequencies(_live_terms(spark, d)).where("mark <> 'kept'").select("tag_key", "term", "mark")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, elements and mark."""
    return term_frequencies(_live_terms(spark, d)).select("tag_key", "term", "n_occurrences", "n_elements", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of terms in at least 5 elements and at least 10 times as often as chance."""
    return cooccurrence(_baskets(spark, d), min_count=5, min_lift=10.0).select(
        F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b")
    )


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of terms with its counts and lift."""
    return cooccurrence(_baskets(spark, d)).select(
        F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"), "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift")
    )


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or piece of one, for each container size."""
    return fill_containers(token_counts(load(spark, d, "documents")), load(spark, d, "containers"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per container size: containers used, the least that could do, and the share of room used."""
    c = p8_containers(spark, d).groupBy("capacity_tokens").agg(F.sum("n_tokens").alias("n_tokens"), (F.max("container_no") + 1).alias("n_containers"))
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return c.select("capacity_tokens", "n_tokens", "n_containers", least.alias("least"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing, per container size: documents packed, and how many of them are not there whole and
    once or are split though they would fit; containers overfull; and whether at most one container isn't over half full."""
    sizes = materialize(token_counts(load(spark, d, "documents")), "sized")
    packed = materialize(fill_containers(sizes, load(spark, d, "containers")), "packed")
    docs = packed.groupBy("capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("n"), F.countDistinct("piece_no").alias("pieces"))
    docs = docs.join(sizes.withColumnRenamed("n_tokens", "size"), "doc_id", "full")
    c = F.col("capacity_tokens")
    wrong = F.coalesce((F.col("got") != F.col("size")) | (F.col("n") != F.col("pieces")), F.lit(True))
    split = (F.col("size") <= c) & (F.col("n") > 1)
    a = docs.groupBy(c).agg(F.count("*").alias("n_documents"), F.count_if(wrong).alias("n_wrong"), F.count_if(split).alias("n_split"))
    full = packed.where("container_no is not null").groupBy(c, "container_no").agg(F.sum("n_tokens").alias("filled"))
    b = full.groupBy(c).agg(F.count_if(F.col("filled") > c).alias("n_overfull"), (F.count_if(2 * F.col("filled") <= c) <= 1).alias("tight"))
    return a.join(b, "capacity_tokens")


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(token_counts(load(spark, d, "documents"), ("doc_id", "source")), load(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, by slot."""
    return _mixture(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return shares_reached(_mixture(spark, d), load(spark, d, "mix_targets"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture, per source wanted: whether it takes part (it has text), whether its documents are
    its own and none comes more often than allowed, and whether its share is met within a few blocks or long documents."""
    sizes = materialize(token_counts(load(spark, d, "documents"), ("doc_id", "source")), "sized")
    targets = load(spark, d, "mix_targets")
    mix = materialize(mix_sources(sizes, targets), "mixture")
    own = sizes.select("doc_id", F.col("source").alias("true_source"), F.col("n_tokens").alias("size"))
    times = mix.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("n_tokens").alias("n_tokens")).join(own, "doc_id")
    rows = times.groupBy("source").agg(F.max("n").alias("most"), F.bool_and((F.col("source") == F.col("true_source")) & (F.col("size") == F.col("n_tokens"))).alias("own"), F.max("size").alias("longest"))
    j = shares_reached(mix, targets).join(targets.groupBy("source").agg(F.max("max_repeat").alias("max_repeat")), "source").join(rows, "source", "left")
    part = F.col("n_tokens") > 0
    alone = j.agg(F.sum("n_tokens").alias("total"), F.sum(F.when(part, F.col("target_share"))).alias("weight"))  # one row
    j = j.join(F.broadcast(alone))
    off = F.abs(F.col("n_tokens") - F.col("total") * F.col("target_share") / F.col("weight"))
    met = ~part | (off <= 3 * F.greatest(F.col("longest"), F.lit(BLOCK)) + F.col("total") * 0.01)
    return j.select("source", part.alias("takes_part"), (~part | F.col("own") & (F.col("most") <= F.col("max_repeat"))).alias("sound"), met.alias("met"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents some of whose text was decoded wrongly."""
    docs = load(spark, d, "documents")
    return garbled_documents(docs, fit(docs), restore=False).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those documents with their encoding pairs and the text as far as it can be had back."""
    docs = load(spark, d, "documents")
    return garbled_documents(docs, fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_frequencies": p1_frequencies,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_checks": p8_checks,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
