"""What a change of a module reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph.algorithms import closure, reverse, shortest_paths
from ..graph.ranks import ranked


def _points(value: Column, ladder: list[tuple[float, int]]) -> Column:
    out = F.lit(0)
    for above, points in sorted(ladder):
        out = F.when(value > above, points).otherwise(out)
    return out


def risk_points(direct: Column, impacted: Column, percentage: Column, layers: Column, depth: Column) -> Column:
    return (
        _points(direct, [(10, 3), (5, 2), (0, 1)]) + _points(impacted, [(20, 3), (10, 2), (0, 1)]) + _points(percentage, [(30, 2), (15, 1)]) + _points(layers, [(3, 2), (1, 1)]) + _points(depth, [(4, 1)])
    )


def risk_level(points: Column) -> Column:
    return F.when(points >= 8, "CRITICAL").when(points >= 5, "HIGH").when(points >= 3, "MEDIUM").otherwise("LOW")


def impacted(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, path, depth): all that depends on each target, targets themselves left out."""
    return closure(reverse(edges), targets).where("root <> node").select(F.col("root").alias("target"), F.col("node").alias("path"), "depth")


def impact_by_layer(edges: DataFrame, modules: DataFrame, targets: DataFrame) -> DataFrame:
    layer = F.coalesce(F.nullif(F.col("layer"), F.lit("")), F.lit("unknown"))
    return impacted(edges, targets).join(modules.select("path", layer.alias("layer")), "path").groupBy("target", "layer").agg(F.count(F.lit(1)).alias("n"))


def impact(edges: DataFrame, modules: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: direct, dependencies, impacted, layers, max_depth, percentage, points, risk, breaking."""
    total = modules.count()
    t = targets.select(F.col("path").alias("target")).distinct()
    far = impacted(edges, targets).join(modules.select("path", F.coalesce(F.nullif(F.col("layer"), F.lit("")), F.lit("unknown")).alias("layer")), "path", "left")
    reach = far.groupBy("target").agg(F.count(F.lit(1)).alias("impacted"), F.count_distinct("layer").alias("layers"), F.max("depth").alias("max_depth"))
    users = edges.groupBy(F.col("dst").alias("target")).agg(F.count_distinct("src").alias("direct"))
    needs = edges.groupBy(F.col("src").alias("target")).agg(F.count_distinct("dst").alias("dependencies"))
    z = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("impacted", "layers", "max_depth", "direct", "dependencies")}
    r = t.join(reach, "target", "left").join(users, "target", "left").join(needs, "target", "left").withColumns(z)
    r = r.withColumn("percentage", F.round(F.col("impacted") / max(total, 1) * 100, 6))
    r = r.withColumn("points", risk_points(F.col("direct"), F.col("impacted"), F.col("percentage"), F.col("layers"), F.col("max_depth")).cast("long"))
    return r.withColumn("risk", risk_level(F.col("points"))).withColumn("breaking", F.col("risk").isin("CRITICAL", "HIGH"))


def critical_paths(edges: DataFrame, target: str, users: int = 3, most: int = 5) -> DataFrame:
    """(src, dst, path): the way from dependents that are used much themselves, first five by path: a report."""
    one = edges.sparkSession.createDataFrame([(target,)], "path string")
    busy = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("n")).where(F.col("n") >= users)
    pairs = impacted(edges, one).join(busy, "path").orderBy("path").limit(most).select(F.col("path").alias("src"), F.lit(target).alias("dst"))
    return shortest_paths(edges, pairs)


def combined(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, depth): all that depends on any target, at its least depth."""
    return impacted(edges, targets).groupBy("path").agg(F.min("depth").alias("depth"))


def combined_impact(edges: DataFrame, modules: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for a change of all targets together: targets, direct, dependencies, impacted, layers,
    max_depth, percentage, points, risk, breaking.

    Direct dependents and dependencies are those of any target; what several targets reach counts
    once, at its least depth.  A target that depends on another one counts as impacted.
    """
    total = modules.count()
    t = targets.select(F.col("path").alias("target")).distinct()
    far = combined(edges, targets).join(modules.select("path", F.coalesce(F.nullif(F.col("layer"), F.lit("")), F.lit("unknown")).alias("layer")), "path", "left")
    reach = far.agg(F.count(F.lit(1)).alias("impacted"), F.count_distinct("layer").alias("layers"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))
    users = edges.join(t, edges.dst == t.target, "left_semi").agg(F.count_distinct("src").alias("direct"))
    needs = edges.join(t, edges.src == t.target, "left_semi").agg(F.count_distinct("dst").alias("dependencies"))
    # Four frames of one row each.
    r = t.agg(F.count(F.lit(1)).alias("targets")).crossJoin(users).crossJoin(needs).crossJoin(reach)
    r = r.withColumn("percentage", F.round(F.col("impacted") / max(total, 1) * 100, 6))
    r = r.withColumn("points", risk_points(F.col("direct"), F.col("impacted"), F.col("percentage"), F.col("layers"), F.col("max_depth")).cast("long"))
    return r.withColumn("risk", risk_level(F.col("points"))).withColumn("breaking", F.col("risk").isin("CRITICAL", "HIGH"))


def ranking(impacts: DataFrame) -> DataFrame:
    """The impacts with their ``rank``, from 1: those that reach the most modules first, equal ones by target."""
    out = ranked(impacts.withColumn("__less", -F.col("impacted")), "__less", "target")
    return out.withColumn("rank", F.col("rank") + 1).drop("__less")


ADVICE = {
    "CRITICAL": ["Split the change into steps", "Announce it to all dependents", "Keep the old behaviour during the move", "Test every dependent layer", "Plan a way back"],
    "HIGH": ["Review with the owners of dependents", "Test the direct dependents", "Release behind a switch", "Watch the release", "Write down what changes"],
    "MEDIUM": ["Run the tests of direct dependents", "Tell the owners of dependents", "Review the public interface", "Update the documentation"],
    "LOW": ["Run the module's own tests", "Review as usual", "Update the documentation"],
}


def recommendations(impacts: DataFrame, critical: DataFrame | None = None) -> DataFrame:
    """(target, nth, advice) by risk level; more than two layers add one, and so do critical paths,
    given as (target, n)."""
    known = F.create_map(*[x for k, v in ADVICE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    more = F.when(F.col("layers") > 2, F.array(F.lit("Test across layers"))).otherwise(none)
    if critical is not None:
        impacts = impacts.join(critical.select("target", F.col("n").alias("__critical")), "target", "left")
        more = F.concat(more, F.when(F.col("__critical") > 0, F.array(F.concat(F.lit("Walk through "), F.col("__critical").cast("string"), F.lit(" critical paths")))).otherwise(none))
    return impacts.select("target", F.posexplode(F.concat(known[F.col("risk")], more)).alias("nth", "advice"))


def critical_counts(edges: DataFrame, targets: DataFrame, users: int = 3, most: int = 5) -> DataFrame:
    """(target, n): how many critical paths a target's report holds, ``most`` at most."""
    busy = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("n")).where(F.col("n") >= users)
    return impacted(edges, targets).join(busy.select("path"), "path", "left_semi").groupBy("target").agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("long").alias("n"))
