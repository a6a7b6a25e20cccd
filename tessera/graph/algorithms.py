"""Graph algorithms over an ``edges`` frame (src depends on dst), as joins to a fixed point.

Each round joins a frontier with the edges and removes what is known by an anti join
(semi-naive evaluation).  Rounds are cut off from their lineage in the shared checkpoint
folder.  Edges are repartitioned by their join key once, so a round shuffles its frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from .ranks import ranked


class CycleError(ValueError):
    """The graph has a cycle where an order or a longest path was asked for."""


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def resolved(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Only edges both ends of which are module paths."""
    p = modules.select("path")
    return edges.join(p, edges.src == p.path, "left_semi").join(p, edges.dst == p.path, "left_semi")


def closure(edges: DataFrame, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): every node reachable from a root by one edge or more, at its least depth.

    Roots are the ``path`` values of ``sources``, or all sources of edges.  A root on a cycle
    reaches itself.  Unknown roots reach nothing.
    """
    e = cut(edges.select("src", "dst").distinct())
    front = e.select(F.col("src").alias("root"), F.col("dst").alias("node"))
    if sources is not None:
        front = front.join(sources.select(F.col("path").alias("root")).distinct(), "root", "left_semi")
    front = cut(front.distinct().withColumn("depth", F.lit(1).cast("long")))
    rounds, depth = [front], 1
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        step = front.join(e, front.node == e.src).select("root", F.col("dst").alias("node")).distinct()
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        front = cut(step.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        rounds.append(front)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def reachable(edges: DataFrame, shares: int = 64, group: int = 64, limit: int = 200_000) -> DataFrame:
    """(root, node) of ``closure``, without depths: as many rows, but rounds over the condensed graph alone.

    The members of a component form lists of about ``group``, by hash, and pairs are spread out list by
    list, so that those of one large component do not meet in one task.  The roots of a list follow
    each other for each node: files then hold a node once for a list, and the same turn of roots again.
    Beyond ``limit`` nodes the lists are shuffled instead of broadcast.
    """
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    owner = cut(components(e, held=True))
    between = closure(_contracted(e, owner)).select("root", "node")
    turning = cyclic(owner, e).select(F.col("component").alias("root"), F.col("component").alias("node")).distinct()
    pairs = cut(between.unionByName(turning))
    size, counts = owner.count(), owner.groupBy("component").agg(F.count(F.lit(1)).alias("__n"))
    number = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("__n") / group)), F.lit(0))
    many = broadcast_if_small(counts.where(F.col("__n") > group), size // group)
    listed = cut(owner.join(many, "component", "left").select("component", number.alias("__list"), "node"))
    first = listed.select(F.col("component").alias("root"), "__list")
    if size <= limit:
        both = pairs.join(counts.toDF("root", "__a"), "root").join(counts.toDF("node", "__b"), "node")
        found = both.agg(F.sum(F.col("__a") * F.col("__b"))).first()[0] or 0
        rows = first.distinct().join(pairs, "root").select(F.col("root").alias("__of"), "__list", F.col("node").alias("component"))
        met = rows.repartition(max(shares, found >> 24)).join(F.broadcast(listed.select("component", "node")), "component").select("__of", "__list", "node")
        return met.join(F.broadcast(listed.toDF("__of", "__list", "root")), ["__of", "__list"]).select("root", "node")
    lists = cut(listed.groupBy("component", "__list").agg(F.array_sort(F.collect_set("node")).alias("__nodes")).select("component", "__nodes"))
    rows = lists.toDF("root", "__roots").join(pairs, "root").select("__roots", F.col("node").alias("component"), F.pmod(F.xxhash64("__roots"), F.lit(shares)).cast("int").alias("__share"))
    copies = lists.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    met = rows.join(copies, ["component", "__share"]).select("__roots", F.explode("__nodes").alias("node"))
    return met.select(F.explode("__roots").alias("root"), "node")


def transitive_dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(root, node, depth) without the root itself."""
    return closure(edges, sources).where("root <> node")


def transitive_dependents(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return transitive_dependencies(reverse(edges), sources)


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, path array) for each reachable pair; among equals, read from the end, the least.

    A pair of one node has the path of that node alone.  A search from all sources at once keeps
    one row for a source and a node it meets, with the least node before it, and ends when every
    pair is met or nothing new is.  The pairs then walk back along those nodes together.
    """
    e = cut(edges.select("src", "dst"))
    p = cut(pairs.select("src", "dst").distinct())
    front = cut(p.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hops")))
    met, left, hops = front, p, 0
    while True:
        ends = front.select(F.col("root").alias("src"), F.col("node").alias("dst"))
        left = cut(left.join(ends, ["src", "dst"], "left_anti"))
        size = front.count()
        if not size or left.isEmpty():
            break
        hops += 1
        # A short frontier goes to the edges, which then need not move.
        step = e.join(broadcast_if_small(front, size), e.src == F.col("node")).groupBy("root", F.col("dst").alias("node")).agg(F.min("node").alias("parent")).withColumn("hops", F.lit(hops))
        front = cut(step.join(met, ["root", "node"], "left_anti"))
        met = cut(met.unionByName(front))
    back = met.select(F.col("root").alias("src"), F.col("node").alias("at"), "parent", "hops")
    walk = cut(p.join(back, (p.src == back.src) & (p.dst == back["at"])).select(p.src, p.dst, F.col("parent").alias("at"), "hops", F.array("at").alias("path")))
    out = walk.where("hops = 0").select("src", "dst", "path")
    for n in range(hops, 0, -1):
        # Those that are n hops from their source take a step; the shorter ones join in later.
        here = walk.where(F.col("hops") == n).join(back.drop("hops"), ["src", "at"]).select("src", "dst", F.col("parent").alias("at"), (F.col("hops") - 1).alias("hops"), F.concat(F.array("at"), "path").alias("path"))
        walk = cut(walk.where(F.col("hops") < n).unionByName(here))
        if n == 1:
            out = walk.where("hops = 0").select("src", "dst", "path")
    return out


def _colours(e: DataFrame, once: bool = False) -> DataFrame | None:
    """(node, component) of the strongly connected components with several members of ``e``, which is cut.

    Nodes off all cycles are trimmed first; then colours flow forward to a fixed point, and
    the nodes that reach their colour's root again, found backwards within the colour, form
    its component.  Rounds repeat on the rest.  A round sends on only the colours that were new.
    With ``once`` nothing is trimmed or repeated: all that is found is right, but some may be missing.
    """
    found = None
    while True:
        n = 0 if once else e.count()
        while n:  # trim: a node without an edge in or out is a component of its own
            e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            was, n = n, e.count()
            if n == was:
                break
        if n == 0 and not once:
            return found
        front = colour = cut(e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while not front.isEmpty():
            pushed = e.join(front, e.src == front.node).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("came"))
            moved = colour.join(pushed, "node", "left").select("node", F.least("colour", "came").alias("colour"), (F.col("came") < F.col("colour")).alias("new"))
            moved = cut(moved)
            front, colour = moved.where("new").select("node", "colour"), moved.select("node", "colour")
        a, b = colour.toDF("src", "cs"), colour.toDF("dst", "cd")
        inner = cut(e.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        front = cut(colour.where("node = colour"))
        members = front
        while not front.isEmpty():
            ends = front.toDF("dst", "colour")
            step = ends.join(inner, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = cut(step.join(members, ["node", "colour"], "left_anti"))
            members = cut(members.unionByName(front))
        done = members.select("node", F.col("colour").alias("component"))
        if once:
            return done
        found = done if found is None else found.unionByName(done)
        gone = members.select("node")
        e = cut(e.join(gone, e.src == gone.node, "left_anti").join(gone, e.dst == gone.node, "left_anti"))


def _contracted(e: DataFrame, owner: DataFrame) -> DataFrame:
    """The edges between components; a node that ``owner`` does not list stands for itself."""
    for end in ("src", "dst"):
        e = e.join(owner.select(F.col("node").alias(end), F.col("component").alias("__c")), end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    return e.where("src <> dst").select("src", "dst").distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None, dense: int = 12, held: bool = False) -> DataFrame:
    """(node, component): strongly connected components, named by their least member.

    ``held`` says that ``edges`` are cut already, and saves another copy of them.

    A graph with more than ``dense`` edges a node is contracted first: cycles in any part of its edges lie
    within its components, so eight edges a node, by their hash, find most of them in smaller
    rounds.  All edges then go between what was contracted, of which few are left to look at.
    """
    given = edges.select("src", "dst")
    e, owner = given.where("src <> dst"), None
    e = e if held else cut(e)
    rows, ends = e.agg(F.count(F.lit(1)), F.approx_count_distinct("src")).first()
    if rows > dense * ends:
        few = cut(e.where(F.pmod(F.xxhash64("src", "dst"), F.lit(rows)) < 8 * ends))
        owner = cut(_colours(few, once=True))
        e = cut(_contracted(e, owner))
    else:
        e = cut(e.distinct())
    found = _colours(e)
    if found is not None:
        owner = cut(found) if owner is None else _renamed(owner, cut(found))
    every = given.select(F.explode(F.array("src", "dst")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col("path").alias("node")))
    every = every.distinct()
    if owner is None:
        return every.withColumn("component", F.col("node"))
    return every.join(owner, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _renamed(owner: DataFrame, found: DataFrame) -> DataFrame:
    """``owner`` after its components were themselves grouped by ``found``."""
    later = found.select(F.col("node").alias("component"), F.col("component").alias("__c"))
    moved = owner.join(later, "component", "left").select("node", F.coalesce("__c", "component").alias("component"))
    return moved.unionByName(found.join(owner.select("node"), "node", "left_anti"))


def cyclic(owner: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of components with more than one member, and of self loops."""
    many = owner.groupBy("component").count().where("count > 1").select("component")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    return owner.join(many, "component", "left_semi").select("node", "component").unionByName(owner.join(loops, "node", "left_semi").select("node", "component")).distinct()


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node, component) of components with more than one member, and of self loops."""
    e = cut(edges.select("src", "dst"))
    return cyclic(cut(components(e)), e)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): 0 for nodes that depend on nothing, else one more than their deepest dependency.

    The level is the length of the longest dependency path, so it is also the dependency
    depth.  Raises CycleError if nodes remain that wait for each other.
    """
    e = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select(F.col("path").alias("node")).distinct())
    out, level = None, 0
    while not left.isEmpty():
        free = cut(left.join(e, left.node == e.src, "left_anti").withColumn("level", F.lit(level).cast("long")))
        if free.isEmpty():
            raise CycleError("the graph has a cycle")
        out = free if out is None else out.unionByName(free)
        done = free.select("node")
        left = cut(left.join(done, "node", "left_anti"))
        e = cut(e.join(done, e.dst == done.node, "left_anti"))
        level += 1
    return out if out is not None else left.withColumn("level", F.lit(0).cast("long"))


def topological_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level, position): dependencies first; the order of a queue that starts with the
    free nodes by name and takes in the nodes that each of its members sets free by name.

    Within a level nodes stand by the position of their last dependency, then by name; the places
    come from ranges of that order, so that no level meets in one task.
    """
    lv = cut(levels(edges, nodes))
    e = edges.select("src", "dst").distinct()
    top = lv.agg(F.max("level")).first()[0]
    placed, base = None, 0
    for level in range((top if top is not None else -1) + 1):
        here = lv.where(F.col("level") == level)
        if placed is None:
            keyed = here.withColumn("after", F.lit(-1).cast("long"))
        else:
            last = e.join(placed, e.dst == placed.node).groupBy("src").agg(F.max("position").alias("after"))
            keyed = here.join(last, here.node == last.src).select("node", "level", "after")
        step = cut(ranked(keyed, "after", "node").select("node", "level", (F.col("rank") + base).alias("position")))
        base += step.count()
        placed = step if placed is None else cut(placed.unionByName(step))
    return placed if placed is not None else lv.withColumn("position", F.lit(0).cast("long"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, out_degree, in_degree) for every module."""
    o = edges.groupBy(F.col("src").alias("path")).agg(F.count_distinct("dst").alias("out_degree"))
    i = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("in_degree"))
    z = F.lit(0).cast("long")
    return nodes.select("path").join(o, "path", "left").join(i, "path", "left").select("path", F.coalesce("out_degree", z).alias("out_degree"), F.coalesce("in_degree", z).alias("in_degree"))


def has_cycle_through(edges: DataFrame, path: str) -> bool:
    """Whether ``path`` reaches itself."""
    one = edges.sparkSession.createDataFrame([(path,)], "path string")
    return not closure(edges, one).where("root = node").isEmpty()
