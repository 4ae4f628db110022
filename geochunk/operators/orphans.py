"""References to records that do not exist: direct orphans, and the fixpoint cascade to what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geochunk.operators.elements import current_rows
from geochunk.session import apart, materialize

REF_TYPES = ("node", "way", "relation")


def targets(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(ref_type, ref_id, live, first_loaded): one row per id of each table, whatever its state."""
    parts = []
    for kind, t in zip(REF_TYPES, (nodes, ways, relations)):
        t = current_rows(t.select("id", "version", "loaded_at", "visible"), [], earliest=True)
        live = F.coalesce("visible", F.lit(False))
        parts.append(t.select(F.lit(kind).alias("ref_type"), F.col("id").alias("ref_id"), live.alias("live"), "first_loaded"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def references(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct references of live rows: src_table, src_id, loaded_at (of the referring current row), ref_type, ref_id.

    Null references, and members whose type is not exactly one of REF_TYPES, are no references. Repeats inside one row
    are dropped in that row, before any shuffle.
    """
    w = current_rows(ways, ["nds"]).where("visible")
    nds = F.array_distinct(F.filter("nds", lambda x: x.isNotNull()))
    w = w.select(F.lit("ways").alias("src_table"), F.col("id").alias("src_id"), "loaded_at", F.lit("node").alias("ref_type"), F.explode(nds).alias("ref_id"))
    r = current_rows(relations, ["members"]).where("visible")
    good = F.filter("members", lambda m: m["ref"].isNotNull() & m["type"].isin(*REF_TYPES))
    both = F.array_distinct(F.transform(good, lambda m: F.struct(m["type"].alias("ref_type"), m["ref"].alias("ref_id"))))
    r = r.select(F.lit("relations").alias("src_table"), F.col("id").alias("src_id"), "loaded_at", F.inline(both))
    return w.unionByName(r)


def orphan_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References whose target is ``missing``, ``deleted`` or ``late`` (loaded first after the referring row).

    First the distinct targets are made from all references, combined map-side with their earliest referring time, and
    joined with ``known``: both sides have unique keys, so a target named by a third of all rows is one row there. Only
    targets that are bad for some reference (few, at any size) then meet the references again, by a shuffle join whose
    hot partitions AQE splits. A null loaded_at is never late.
    """
    named = refs.groupBy("ref_type", "ref_id").agg(F.min("loaded_at").alias("named_at"))
    j = named.join(apart(known), ["ref_type", "ref_id"], "left")
    state = F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted").when(F.col("first_loaded") > F.col("named_at"), "late")
    bad = materialize(j.withColumn("ref_state", state).where("ref_state is not null").select("ref_type", "ref_id", "ref_state", "first_loaded"), "bad-targets")
    hit = refs.join(apart(bad), ["ref_type", "ref_id"])
    return hit.where((F.col("ref_state") != "late") | (F.col("first_loaded") > F.col("loaded_at"))).drop("first_loaded")


class OrphanCascade:
    """Orphaned references of live rows, level by level; each level is worked out when it is asked for.

    ``direct`` (level 0): the target is missing, deleted or late. ``inherited``: the target exists but is itself a row
    with an orphaned reference; ref_state is then ``inherited`` and level the number of links down to the nearest direct
    orphan. ``rows``: both. Columns: src_table, month_key (YYYY-MM of the referring current row's loaded_at, null where
    that is null), src_id, ref_type, ref_id, ref_state, orphan, level. Empty tables give no rows; further columns are
    ignored.
    """

    def __init__(self, nodes: DataFrame, ways: DataFrame, relations: DataFrame):
        self._refs = materialize(references(ways, relations), "references")
        self._direct = orphan_references(self._refs, targets(nodes, ways, relations))

    @staticmethod
    def _shown(df: DataFrame) -> DataFrame:
        month = F.date_format("loaded_at", "yyyy-MM")
        return df.select("src_table", month.alias("month_key"), "src_id", "ref_type", "ref_id", "ref_state", "orphan", "level")

    def direct(self) -> DataFrame:
        return self._shown(self._direct.withColumn("orphan", F.lit("direct")).withColumn("level", F.lit(0)))

    def inherited(self) -> DataFrame:
        """The fixpoint: one semi-join a round goes up the reference graph until no row is new. A round handles only
        rows found in the one before, so circular references end it too; there are as many as references nest."""
        self._direct = materialize(self._direct, "direct")
        source = F.when(F.col("src_table") == "ways", "way").otherwise("relation")
        as_target = lambda d: d.select(source.alias("ref_type"), F.col("src_id").alias("ref_id")).distinct()
        bad = self._direct.select("src_table", "src_id", "ref_type", "ref_id")
        # only relations name ways or relations, so only those references can carry a state upward
        upward = self._refs.where("ref_type <> 'node'").join(apart(bad), ["src_table", "src_id", "ref_type", "ref_id"], "left_anti")
        upward = materialize(upward, "upward")
        frontier = materialize(as_target(self._direct).withColumn("level", F.lit(0)), "frontier-0")
        seen, level = frontier, 0
        while not frontier.isEmpty():
            level += 1
            hit = upward.join(apart(frontier.select("ref_type", "ref_id")), ["ref_type", "ref_id"], "left_semi")
            new = as_target(hit).join(apart(seen.select("ref_type", "ref_id")), ["ref_type", "ref_id"], "left_anti")
            frontier = materialize(new.withColumn("level", F.lit(level)), f"frontier-{level}")
            seen = seen.unionByName(frontier)
            if level % 8 == 0:  # keeps the plan small however deep the references nest
                seen = materialize(seen, f"seen-{level}")
        # a row found in round n passes its state on to whatever names it
        out = upward.join(apart(seen), ["ref_type", "ref_id"]).withColumn("level", F.col("level") + 1)
        return self._shown(out.withColumn("ref_state", F.lit("inherited")).withColumn("orphan", F.lit("inherited")))

    def rows(self) -> DataFrame:
        inherited = self.inherited()
        return self.direct().unionByName(inherited)


def orphan_cascade(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """All rows of the cascade, direct and inherited (see OrphanCascade)."""
    return OrphanCascade(nodes, ways, relations).rows()
