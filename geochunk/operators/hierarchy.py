"""Parent-child links to full hierarchies, by deterministic hash splitters.

1. Splitters are the nodes with other than one parent, and every ``every``-th of the rest by hash. A node between has
   one parent: its walk up to the next splitter is a pointer chain, followed by pointer doubling.
2. Links into splitters, with those walks, are the reduced graph. Its cycles are found there: stretches of nodes with one
   link in are contracted by pointer doubling, again and again, since a link from what is known to lie on no cycle counts
   no more; what is left, nodes all with several links from unknown ones, is trimmed and coloured. A cycle without any
   splitter shows as a walk that meets itself and is handled on its own.
3. Paths from the roots are solved on the reduced graph by path doubling and expanded by the walks.
All rounds are joins on tables; nothing is gathered in one task or on the driver. Doubling takes as many rounds as the
logarithm of the longest stretch. Only the last resort of 2 takes a round per layer: layers of nodes that all have several
links from nodes on, or below, cycles. (Above none, such layers double the number of paths, so they are few.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geochunk.session import materialize


def _walks(graph: DataFrame, splitters: DataFrame, rounds: list[str]) -> tuple[DataFrame, DataFrame]:
    """For nodes with one parent that are no splitters: (node, top, path) with path from below the splitter ``top`` down
    to the node; and (node, loop) for nodes on a cycle without splitter. Nodes that hang below such a cycle are in neither.
    """
    only = graph.join(splitters, graph["child"] == splitters["s"], "left_anti")
    state = only.join(splitters, only["parent"] == splitters["s"], "left").select(
        F.col("child").alias("node"), F.col("parent").alias("top"), F.array("child").alias("path"), F.col("s").isNotNull().alias("done")
    )
    state = materialize(state.withColumn("loop", F.col("top") == F.col("node")), "walk")
    finished, loops = [state.where("done").select("node", "top", "path")], [state.where("loop").select("node", "path")]
    active = state.where("not done and not loop")
    ready = state.where("not loop")
    while not active.isEmpty():
        rounds.append("walk")
        up = ready.select(F.col("node").alias("u"), F.col("top").alias("t2"), F.col("path").alias("p2"), F.col("done").alias("d2"))
        j = active.join(up, active["top"] == up["u"]).select("node", F.col("t2").alias("top"), F.concat("p2", "path").alias("path"), F.col("d2").alias("done"))
        again = F.size(F.array_distinct("path")) < F.size("path")
        j = j.withColumn("loop", ~F.col("done") & ((F.col("top") == F.col("node")) | F.array_contains(F.slice("path", 1, F.size("path") - 1), F.col("node"))))
        j = materialize(j.withColumn("lost", ~F.col("done") & ~F.col("loop") & (again | F.array_contains("path", F.col("top")))), "walk")
        finished.append(j.where("done").select("node", "top", "path"))
        loops.append(j.where("loop").select("node", "path"))
        active = j.where("not done and not loop and not lost")
        # a node may be asked for in a later round, whether it is done or still on its way; its longest walk serves
        ready = materialize(ready.join(j.select(F.col("node").alias("u")), F.col("node") == F.col("u"), "left_anti").unionByName(j.where("not loop and not lost").select("node", "top", "path", "done", "loop")), "ready")
    walks, on = finished[0], loops[0]
    for w in finished[1:]:
        walks = walks.unionByName(w)
    for x in loops[1:]:
        on = on.unionByName(x)
    return materialize(walks, "walks"), materialize(on, "loops")


def _trim(edges: DataFrame, rounds: list[str]) -> DataFrame:
    """Edges (s, t) among nodes that have links in and out, recursively; self links stay."""
    n = edges.count()
    while n:
        rounds.append("trim")
        ins, outs = edges.select(F.col("s").alias("k")).distinct(), edges.select(F.col("t").alias("k")).distinct()
        edges = edges.join(outs, edges["s"] == outs["k"], "left_semi").join(ins, edges["t"] == ins["k"], "left_semi")
        edges = materialize(edges, "trim")
        m = edges.count()
        if m == n:
            break
        n = m
    return edges


def _core(edges: DataFrame, rounds: list[str]) -> DataFrame:
    """(node, scc) of all nodes on cycles of the links s -> t, scc being the smallest node of the component.

    Trimming, then colouring: every node takes the smallest node that reaches it; those of one colour that reach its origin back are a
    component. What is found is removed, the rest trimmed and coloured again.
    """
    found = edges.select(F.col("s").alias("node"), F.col("s").alias("scc")).limit(0)
    edges = _trim(edges, rounds)
    while not edges.isEmpty():
        nodes = edges.select(F.col("s").alias("node")).union(edges.select("t")).distinct()
        color = materialize(nodes.withColumn("c", F.col("node")), "color")
        while True:
            rounds.append("color")
            pushed = edges.join(color, edges["s"] == color["node"]).groupBy("t").agg(F.min("c").alias("m"))
            new = color.join(pushed, color["node"] == pushed["t"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved"))
            new = materialize(new, "color")
            moved = not new.where("moved").isEmpty()
            color = new.drop("moved")
            if not moved:
                break
        cs, ct = color.select(F.col("node").alias("s"), F.col("c").alias("cs")), color.select(F.col("node").alias("t"), F.col("c").alias("ct"))
        same = materialize(edges.join(cs, "s").join(ct, "t").where("cs = ct").select("s", "t", F.col("cs").alias("c")), "same")
        inside = materialize(color.where("node = c"), "back")
        frontier = inside
        while not frontier.isEmpty():
            rounds.append("back")
            f = frontier.select(F.col("node").alias("fn"), F.col("c").alias("fc"))
            up = same.join(f, (same["t"] == F.col("fn")) & (same["c"] == F.col("fc"))).select(F.col("s").alias("node"), "c").distinct()
            frontier = materialize(up.join(inside, ["node", "c"], "left_anti"), "back")
            inside = inside.unionByName(frontier)
        inside = materialize(inside, "inside")
        loops = same.where("s = t").select(F.col("s").alias("node")).distinct()
        size = inside.groupBy("c").agg(F.count("*").alias("n"))
        scc = inside.join(size, "c").join(loops.withColumn("self", F.lit(True)), "node", "left").where("n > 1 or self").select("node", F.col("c").alias("scc"))
        found = materialize(found.unionByName(scc), "scc")
        gone = inside.select(F.col("node").alias("k"))
        edges = edges.join(gone, edges["s"] == gone["k"], "left_anti").join(gone, edges["t"] == gone["k"], "left_anti")
        edges = _trim(materialize(edges, "rest"), rounds)
    return found


def _cyclic(edges: DataFrame, rounds: list[str]) -> DataFrame:
    """(node, scc) of all nodes on cycles of the distinct links s -> t (a written table); nodes of one cycle, or of cycles
    that meet, share scc, which is one of them.

    Nodes with one link in are stretches: doubled pointers lead up to a root (no cycle then), to a node with several
    links in, or for ever round (a cycle, all of whose nodes have one link in; after more steps than there are nodes,
    every pointer stands on it). Between nodes with several links in, each stretch counts as one link; links from roots,
    and from cycles already found, lie on no further cycle and are dropped. So fewer links are left, treated the same way.
    """
    ins = materialize(edges.groupBy("t").agg(F.count("*").alias("n"), F.min("s").alias("up")), "links-in")
    one = ins.where("n = 1").select(F.col("t").alias("node"), "up")
    is_one = one.select(F.col("node").alias("o"))
    start = one.join(is_one, one["up"] == F.col("o"), "left").select("node", "up", F.col("node").alias("low"), F.col("o").isNull().alias("done"))
    state = materialize(start, "stretch")
    jumps, steps = [], 1
    active = state.where("not done")
    n_active = active.count()
    while n_active and steps <= 2 * n_active:
        rounds.append("stretch")
        jumps.append(active.select(F.col("node").alias("k"), "up"))
        above = state.select(F.col("node").alias("a"), F.col("up").alias("up2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        moved = active.join(above, active["up"] == above["a"]).select("node", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
        state = materialize(state.where("done").unionByName(moved), "stretch")
        active, steps = state.where("not done"), steps * 2
        n_active = active.count()
    round_ = active.select(F.col("up").alias("k")).distinct()
    found = active.join(round_, active["node"] == round_["k"]).select("node", F.col("low").alias("scc"))

    many = ins.where("n > 1").select(F.col("t").alias("m"))
    into = edges.join(many, edges["t"] == many["m"]).select("s", "t")
    tops = state.where("done").select("node", "up")
    through = into.join(tops, into["s"] == tops["node"], "left").select(F.coalesce("up", "s").alias("s"), "t", F.when(F.col("node").isNotNull(), F.col("s")).alias("via"))
    through = materialize(through.join(many.withColumnRenamed("m", "m2"), F.col("s") == F.col("m2"), "left_semi"), "through")
    rest = materialize(through.select("s", "t").distinct(), "rest")
    n_rest = rest.count()
    if not n_rest:
        return found
    sub = materialize((_cyclic if 10 * n_rest < 9 * edges.count() else _core)(rest, rounds), "scc")
    a, b = sub.select(F.col("node").alias("s"), F.col("scc").alias("cs")), sub.select(F.col("node").alias("t"), F.col("scc").alias("ct"))
    on = through.where("via is not null").join(a, "s").join(b, "t").where("cs = ct").select(F.col("via").alias("node"), F.col("cs").alias("scc")).distinct()
    on = materialize(on, "on")
    if not on.isEmpty():
        for j in jumps:  # a stretch lies on the cycle from its link down up to its top
            rounds.append("mark")
            on = materialize(on.unionByName(on.join(j, on["node"] == j["k"]).select(F.col("up").alias("node"), "scc")).distinct(), "on")
    return found.unionByName(sub).unionByName(on)


def hierarchies(links: DataFrame, parent: str = "parent", child: str = "child", every: int = 8, rounds: list[str] | None = None) -> DataFrame:
    """(kind, root_id, node_id, depth, path) of all nodes that have a link.

    kind ``path``: a root is a node with links down and none up, not on a cycle; one row per downward path from it to
    itself (depth 0) and to each node below; path is the array of ids from the root. Paths never enter a node on a
    cycle; a node reached by several paths has a row for each. kind ``cycle``: each node that can reach itself;
    root_id is the smallest id it can reach and be reached from, depth -1, path empty.
    Repeated links are one link; links with a null end are none; empty input gives no rows; further columns are ignored.
    Each round of joins adds its name to ``rounds``.
    """
    rounds = [] if rounds is None else rounds
    g = links.select(F.col(parent).alias("parent"), F.col(child).alias("child")).dropna().distinct()
    g = materialize(g, "links")
    if g.isEmpty():
        return g.select(F.lit("path").alias("kind"), F.col("parent").alias("root_id"), F.col("child").alias("node_id"), F.lit(0).alias("depth"), F.array("parent").alias("path"))
    parents = g.groupBy("child").agg(F.count("*").alias("n"))
    nodes = g.select(F.col("parent").alias("s")).union(g.select("child")).distinct().join(parents, F.col("s") == F.col("child"), "left")
    chosen = F.col("n").isNull() | (F.col("n") > 1) | (F.pmod(F.xxhash64("s"), F.lit(every)) == 0)
    marked = materialize(nodes.where(chosen).select("s", F.col("n").isNull().alias("root")), "splitters")
    splitters = marked.select("s")
    walks, loops = _walks(g, splitters, rounds)

    # the reduced graph: child splitter s, parent splitter t, path from below t down to s
    into = g.join(splitters, g["child"] == splitters["s"]).select("s", "parent")
    through = into.join(walks, into["parent"] == walks["node"], "left")
    through = through.join(splitters.select(F.col("s").alias("direct")), F.col("parent") == F.col("direct"), "left")
    reduced = through.select(
        "s", F.coalesce("direct", "top").alias("t"), F.when(F.col("direct").isNotNull(), F.array("s")).otherwise(F.concat("path", F.array("s"))).alias("path")
    ).where("t is not null")
    reduced = materialize(reduced, "reduced")

    scc = materialize(_cyclic(materialize(reduced.select("t", "s").toDF("s", "t").distinct(), "edges"), rounds), "scc")
    a, b = scc.select(F.col("node").alias("s"), F.col("scc").alias("cs")), scc.select(F.col("node").alias("t"), F.col("scc").alias("ct"))
    between = reduced.join(a, "s").join(b, "t").where("cs = ct").select(F.explode("path").alias("node"), F.col("cs").alias("scc"))
    cyclic = scc.unionByName(between).distinct()
    smallest = cyclic.groupBy("scc").agg(F.min("node").alias("root_id"))
    cycles = cyclic.join(smallest, "scc").select("root_id", F.col("node").alias("node_id"))
    cycles = cycles.unionByName(loops.select(F.array_min("path").alias("root_id"), F.col("node").alias("node_id")))

    # complete paths of the splitters, root first: doubling until every open top is a root
    bad = scc.select(F.col("node").alias("k"))
    clean = reduced.join(bad, reduced["s"] == bad["k"], "left_anti").join(bad, reduced["t"] == bad["k"], "left_anti")
    roots = marked.where("root").select(F.col("s").alias("r"))
    state = clean.join(roots, clean["t"] == roots["r"], "left").select("s", "t", "path", F.col("r").isNotNull().alias("done"))
    state = materialize(state, "paths")
    done = [state.where("done").select("s", "t", "path")]
    active = state.where("not done")
    while not active.isEmpty():
        rounds.append("path")
        up = state.select(F.col("s").alias("u"), F.col("t").alias("t2"), F.col("path").alias("p2"), F.col("done").alias("d2"))
        new = active.join(up, active["t"] == up["u"]).select("s", F.col("t2").alias("t"), F.concat("p2", "path").alias("path"), F.col("d2").alias("done"))
        new = materialize(new, "paths")
        done.append(new.where("done").select("s", "t", "path"))
        active = new.where("not done")
        state = state.where("done").unionByName(new)
    full = roots.select(F.col("r").alias("s"), F.array("r").alias("path"))
    for d in done:
        full = full.unionByName(d.select("s", F.concat(F.array("t"), "path").alias("path")))
    full = materialize(full, "full")
    below = full.select("s", F.col("path").alias("head")).join(walks, F.col("s") == F.col("top")).select(F.col("node").alias("s"), F.concat("head", "path").alias("path"))
    paths = full.unionByName(below).select(
        F.lit("path").alias("kind"), F.get("path", F.lit(0)).alias("root_id"), F.col("s").alias("node_id"), (F.size("path") - 1).alias("depth"), "path"
    )
    # a root's own children being cyclic, it still is a root; a splitter on a cycle has no complete path
    empty = F.array().cast(full.schema["path"].dataType)
    return paths.unionByName(cycles.select(F.lit("cycle").alias("kind"), "root_id", "node_id", F.lit(-1).alias("depth"), empty.alias("path")))
