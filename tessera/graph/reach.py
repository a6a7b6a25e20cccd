"""How many nodes depend on each node, without listing the pairs.

Exactly, by bits: trees are folded and cycles condensed, what is left is numbered, 64 to a word,
and each node holds the words of those that reach it.  Words flow along the edges of the condensed graph until nothing new arrives; a
round moves at most one row for an edge and a word.  Blocks of numbers are taken one after
the other, which bounds what a round holds.

Nearly, by sketches: each node holds a HyperLogLog sketch of those that reach it, and sketches
are merged along the edges until they settle: one row for an edge in a round, whatever the size
of the sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .algorithms import _contracted, components
from .ranks import ranked


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, word, bits): what reaches each node of an acyclic graph, itself included.

    Each round sends on only the bits that were new to their node in the round before.
    """
    known, front = start, start
    while True:
        step = front.join(edges, front.node == edges.src).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("came"))
        step = step.join(known, ["node", "word"], "left").select("node", "word", F.col("came").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("bits"))
        front = cut(step.where("bits <> 0"))
        if front.isEmpty():
            return known
        known = cut(known.unionByName(front).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))


def _folded(edges: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, users, edges left): nodes without a user and with one dependency, taken into that dependency.

    What reaches such a node reaches its dependency too, and by no other way, so that a
    weight stands for it there: (node, weight) of the nodes that are left, itself and all it took
    in; (node, users) of those that went.  Rounds end when one takes in less than a ``least``-th of
    the nodes that have a dependency: long chains are left to the words.
    """
    e, spark = edges, edges.sparkSession
    weights = spark.createDataFrame([], "node string, weight long")
    users = spark.createDataFrame([], "node string, users long")
    while True:
        single = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("dst"))
        used = e.select(F.col("dst").alias("src")).distinct()
        marked = single.join(used.withColumn("used", F.lit(True)), "src", "left")
        marked = cut(marked.select("src", "dst", ((F.col("n") == 1) & F.col("used").isNull()).alias("goes")))
        all_of, going = marked.agg(F.count(F.lit(1)), F.count_if("goes")).first()
        if not going or going * least < all_of:
            return weights, users, e
        gone = marked.where("goes").join(weights.withColumnRenamed("node", "src"), "src", "left").select("src", "dst", F.coalesce("weight", F.lit(1)).alias("weight"))
        gone = cut(gone)
        users = users.unionByName(gone.select(F.col("src").alias("node"), (F.col("weight") - 1).alias("users")))
        # A weight holds its node once: what comes in is added to it.
        came = gone.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("more"))
        kept = weights.join(gone.select(F.col("src").alias("node")), "node", "left_anti")
        weights = cut(kept.join(came, "node", "full").select("node", (F.coalesce("weight", F.lit(1)) + F.coalesce("more", F.lit(0))).alias("weight")))
        e = cut(e.join(gone.select("src"), "src", "left_anti"))


def count_users(edges: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(node, users): the number of other nodes that reach each node; nodes without an edge are not listed.

    Trees that hang on the rest are folded into it first, and cycles are condensed: members of a
    strongly connected component reach each other.  Each component left is one bit with a weight.
    Self links and repeats do not matter.  ``block`` components are counted at a time.
    """
    given = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    weights, folded, e = _folded(cut(given.where("src <> dst").distinct()))
    left = _nodes(given).join(folded.select("node"), "node", "left_anti")
    weighed = left.join(weights, "node", "left").select("node", F.coalesce("weight", F.lit(1)).alias("weight"))
    if e.isEmpty():
        return weighed.select("node", (F.col("weight") - 1).alias("users")).unionByName(folded)
    owner = cut(weighed.join(components(e), "node", "left").select("node", F.coalesce("component", "node").alias("component"), "weight"))
    inner = cut(_contracted(e, owner.select("node", "component")))
    size = cut(owner.groupBy("component").agg(F.sum("weight").alias("weight")))
    # Only what has an edge out of its component can be counted elsewhere.
    number = cut(ranked(size.join(inner.select(F.col("src").alias("component")).distinct(), "component", "left_semi"), "component"))
    total = number.count()
    sums = None
    for low in range(0, total, block):
        mine = number.where((F.col("rank") >= low) & (F.col("rank") < low + block)).withColumn("word", F.expr("rank div 64")).withColumn("bit", F.expr("cast(rank % 64 as int)"))
        start = cut(mine.select(F.col("component").alias("node"), "word", F.expr("shiftleft(1L, bit)").alias("bits"), "bit", "weight"))
        heavy = start.where("weight > 1").groupBy("word").agg(F.collect_list(F.struct("bit", (F.col("weight") - 1).alias("more"))).alias("heavy"))
        words = _spread(start.select("node", "word", "bits"), inner).join(heavy, "word", "left")
        more = F.aggregate("heavy", F.lit(0).cast("long"), lambda n, x: n + F.when(F.getbit("bits", x["bit"]) == 1, x["more"]).otherwise(0))
        part = words.groupBy("node").agg(F.sum(F.bit_count("bits") + F.coalesce(more, F.lit(0))).alias("n"))
        part = part.join(start.select("node", F.col("weight").alias("own")), "node", "left").select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))
        sums = part if sums is None else sums.unionByName(part)
    out = owner.select("node", "component").join(size.select("component", (F.col("weight") - 1).alias("beside")), "component")
    if sums is not None:
        out = out.join(sums.groupBy(F.col("node").alias("component")).agg(F.sum("n").alias("n")), "component", "left")
    else:
        out = out.withColumn("n", F.lit(0))
    return out.select("node", (F.col("beside") + F.coalesce("n", F.lit(0))).cast("long").alias("users")).unionByName(folded)


def sketch_users(edges: DataFrame, precision: int = 12) -> DataFrame:
    """(node, users) as ``count_users``, estimated by sketches of 2 ** ``precision`` cells.

    The standard error is about 1.04 / sqrt(2 ** ``precision``): 1.6 % for 12.  Rounds end when no
    estimate moves; there are as many as the longest shortest path has edges.  Nodes that nothing
    depends on have no users and no sketch.
    """
    given = cut(edges.select("src", "dst").where("src <> dst").distinct())
    used = cut(given.select(F.col("dst").alias("node")).distinct())
    # A first sketch holds the node and its direct users.
    direct = given.select(F.col("dst").alias("node"), F.col("src").alias("item")).unionByName(used.select("node", F.col("node").alias("item")))
    known = cut(direct.groupBy("node").agg(F.hll_sketch_agg("item", F.lit(precision)).alias("sketch")).withColumn("users", F.hll_sketch_estimate("sketch")))
    e = cut(given.join(used.withColumnRenamed("node", "src"), "src", "left_semi"))
    front = known
    while not front.isEmpty():
        came = front.join(e, front.node == e.src).select(F.col("dst").alias("node"), "sketch")
        touched = came.groupBy("node").agg(F.hll_union_agg("sketch").alias("came"))
        merged = known.join(touched, "node", "left").withColumn("both", F.when(F.col("came").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "came")))
        merged = cut(merged.select("node", F.col("both").alias("sketch"), F.when(F.col("came").isNull(), F.col("users")).otherwise(F.hll_sketch_estimate("both")).alias("users"), F.col("users").alias("was")))
        front = merged.where("users <> was").select("node", "sketch")
        known = merged.drop("was")
    rest = _nodes(given).join(used, "node", "left_anti").withColumn("users", F.lit(0).cast("long"))
    return known.select("node", (F.col("users") - 1).alias("users")).unionByName(rest)
