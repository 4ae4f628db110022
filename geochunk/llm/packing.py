"""Filling containers of fixed capacity: Martello-Toth dominance reduction, then best fit, on the histogram of sizes.

Sizes are whole numbers up to the capacity, so an instance of any number of items is a histogram of at most ``capacity``
entries. It is solved once, with multiplicities: a solution is a list of container patterns and how often each is used.
Items then find their container by their rank among the items of their size, in parallel.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geochunk.session import broadcast_checked, materialize

#: Parts into which the items of one size are split for ranking.
BUCKETS = 128

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((size, items a container), ...), containers


class _Stock:
    """Counts of the sizes still to be packed."""

    def __init__(self, histogram: dict[int, int]):
        self.sizes = sorted(s for s, n in histogram.items() if n > 0)
        self.n = {s: histogram[s] for s in self.sizes}

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def largest(self, room: int, *but: int) -> int | None:
        """The largest size that fits, one item of each size in ``but`` being spoken for."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0:
            if self.n[self.sizes[i]] > but.count(self.sizes[i]):
                return self.sizes[i]
            i -= 1
        return None

    def two_above(self, size: int, but: int) -> int:
        """The least sum of two items larger than ``size``, one of size ``but`` being spoken for; endless if there are none."""
        out: list[int] = []
        for s in self.sizes[bisect.bisect_right(self.sizes, size) :]:
            out += [s] * min(2 - len(out), self.n[s] - (s == but))
            if len(out) == 2:
                return sum(out)
        return 1 << 62

    def smallest(self, k: int, but: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - (s == but))
            if len(out) >= k:
                break
        return out

    def best_pair(self, room: int, but: int) -> int:
        """The largest sum of two sizes that fits (taken from distinct sizes or one held twice); 0 if none."""
        a = np.array(self.sizes[: bisect.bisect_right(self.sizes, room)])
        if not len(a):
            return 0
        i = np.searchsorted(a, room - a, "right") - 1
        best = 0
        for x, j in zip(a.tolist(), i.tolist()):
            while j >= 0:
                y = int(a[j])
                need = Counter((x, y, but))
                if all(self.n[s] >= c for s, c in need.items()):
                    best = max(best, x + y)
                    break
                j -= 1
        return best


def reduce_dominated(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello and Toth's reduction: (fixed patterns, remaining histogram).

    Largest size first, with residual room r: it stays alone if nothing fits; it is joined with the largest fitting
    item if that fills the container, or if no two further items fit, or if at most two fit and no two of them weigh
    more than that item. If at most two fit and the largest fitting item, with the largest that still fits beside it, is
    the heaviest such pair, and no two items larger than its second one fit, the three are fixed. Each set so fixed
    dominates every other container of the item, so some optimal packing has it.
    All items of a size are treated at once: fixing one set leaves the reason for the next of its kind standing.
    """
    stock = _Stock(histogram)
    fixed: list[Pattern] = []
    for w in sorted(stock.sizes, reverse=True):
        while stock.n.get(w, 0):
            room = capacity - w
            k = stock.largest(room, w)
            if k is None:
                n = stock.n[w] if 2 * w > capacity or stock.n[w] == 1 else 1
                fixed.append((((w, 1),), n))
                stock.take(w, n)
                continue
            small = stock.smallest(3, w)
            chosen = (w, k) if k == room or len(small) < 2 or small[0] + small[1] > room else ()
            if not chosen and (len(small) < 3 or sum(small) > room):
                pair, second = stock.best_pair(room, w), stock.largest(room - k, w, k)
                if k >= pair:
                    chosen = (w, k)
                elif second is not None and k + second == pair and stock.two_above(second, w) > room:
                    chosen = (w, k, second)
            if not chosen:
                break
            each = Counter(chosen)
            n = min(stock.n[s] // c for s, c in each.items())
            fixed.append((tuple(each.items()), n))
            for s, c in each.items():
                stock.take(s, c * n)
    return fixed, dict(stock.n)


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in order of falling size, each item into the fullest container that has room, by groups of equal containers."""
    rooms: list[int] = []  # sorted distinct free rooms
    groups: dict[int, list[list]] = {}  # room -> [contents, containers]

    def add(room: int, contents: tuple, n: int) -> None:
        if n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append([contents, n])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                contents, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    del rooms[i]
            else:
                room, contents = capacity, ()
                bins = -(-left // (capacity // size))
            each = room // size
            full = min(bins, left // each)
            add(room - each * size, (*contents, (size, each)), full)
            left -= full * each
            bins -= full
            if bins and left:  # fewer than ``each`` are left: one container takes them all
                add(room - left * size, (*contents, (size, left)), 1)
                left, bins = 0, bins - 1
            if contents:
                add(room, contents, bins)
    return [(tuple(c), n) for g in groups.values() for c, n in g]


def solve(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that pack the histogram; sizes are 1..capacity."""
    fixed, rest = reduce_dominated(histogram, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, rank after the last, first container, items a container) for every size of every pattern."""
    out, at, rank = [], 0, Counter()
    for contents, n in patterns:
        for size, each in contents:
            out.append((size, rank[size], rank[size] + n * each, at, each))
            rank[size] += n * each
        at += n
    return out


def fill_containers(items: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: str = "capacity_tokens") -> DataFrame:
    """(capacity, key, piece_no, n_tokens, container_no): every item's container, for each capacity.

    An item larger than the capacity is cut into full pieces and a rest, piece_no counting from 0; no other is split.
    Items of size 0 or null take no room: piece 0, n_tokens 0 and a null container_no. Containers of one capacity are
    numbered from 0 without gaps. Repeated rows are items of their own; null keys are kept; null, non-positive and
    repeated capacities are ignored; empty tables give no rows; further columns are ignored.
    """
    caps = sorted({int(r[0]) for r in capacities.select(capacity).distinct().limit(1001).collect() if r[0] is not None and r[0] > 0})
    if len(caps) > 1000:
        raise ValueError("more than 1000 capacities")
    spark = items.sparkSession
    sized = items.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    caps_col = F.explode(F.array(*map(F.lit, caps)).cast("array<int>")) if caps else F.lit(0)
    each = sized.withColumn("cap", caps_col) if caps else sized.limit(0).withColumn("cap", caps_col)
    c = F.col("cap").cast("long")
    full = F.struct(c.alias("size"), F.floor(F.col("n") / c).cast("long").alias("pieces"), F.lit(0).cast("long").alias("first"))
    rest = F.struct((F.col("n") % c).alias("size"), F.lit(1).cast("long").alias("pieces"), F.floor(F.col("n") / c).cast("long").alias("first"))
    parts = F.filter(F.array(full, rest), lambda x: (x["pieces"] > 0) & ((x["size"] > 0) | (F.col("n") == 0)))
    bucket = F.pmod(F.xxhash64("k"), F.lit(BUCKETS)).cast("int")
    pieces = materialize(each.select("cap", "k", bucket.alias("bucket"), F.inline(parts)).where("size is not null"), "pieces")

    by_bucket = materialize(pieces.where("size > 0").groupBy("cap", "size", "bucket").agg(F.sum("pieces").alias("m")), "sizes")
    histogram = by_bucket.groupBy("cap", "size").agg(F.sum("m").alias("m")).collect()  # at most the sum of the capacities
    rows = []
    for cap in caps:
        patterns = solve({r["size"]: r["m"] for r in histogram if r["cap"] == cap}, cap)
        rows += [(cap, *s) for s in slots(patterns)]
    table = spark.createDataFrame(rows, "cap int, size long, lo long, hi long, start long, each long")
    table = broadcast_checked(table)

    before = Window.partitionBy("cap", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("cap", "size", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("cap", "size", "bucket").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("pieces").over(inside), F.lit(0))
    ranked = pieces.where("size > 0").withColumn("local", local).join(broadcast_checked(offsets), ["cap", "size", "bucket"])
    one = ranked.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    one = one.select("cap", "k", "size", (F.col("first") + F.col("i")).alias("piece"), (F.col("offset") + F.col("local") + F.col("i")).alias("rank"))
    t = table.alias("t")
    put = one.alias("o").join(t, (F.col("o.cap") == F.col("t.cap")) & (F.col("o.size") == F.col("t.size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    container = F.col("start") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")).cast("long")
    names = lambda df: df.toDF(capacity, key, "piece_no", "n_tokens", "container_no")
    put = names(put.select("o.cap", "o.k", F.col("piece").cast("int"), "o.size", container))
    none = names(pieces.where("size = 0").select("cap", "k", F.lit(0), "size", F.lit(None).cast("long")))
    return put.unionByName(none)
