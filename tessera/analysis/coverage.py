"""How much each module is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph.algorithms import degrees
from ..graph.ranks import ranked
from ..graph.reach import count_users, sketch_users
from ..session import cut


def coverage(edges: DataFrame, modules: DataFrame, exact: bool = True) -> DataFrame:
    """(path, in_degree, out_degree, users, score, is_entry, is_dead, band).

    score = 0 without users, else in/n * 0.5 + transitive users/n * 0.3 + 0.2 with exports, at
    most 1.  A module that exports main or init is an entry point; one without users that is
    none is dead.  band is high from 0.7 and low under 0.3 for modules that are no entry.  The users
    are counted exactly, or estimated by sketches.
    """
    users = (count_users(edges) if exact else sketch_users(edges)).withColumnRenamed("node", "path")
    total = modules.count()
    d = degrees(edges, modules).join(users, "path", "left").join(modules.select("path", "exports"), "path").withColumn("users", F.coalesce("users", F.lit(0)).cast("long"))
    raw = F.col("in_degree") / total * 0.5 + F.col("users") / total * 0.3 + F.when(F.size("exports") > 0, 0.2).otherwise(0.0)
    names = F.transform("exports", lambda x: F.regexp_replace(x, "^#", ""))
    entry = F.arrays_overlap(names, F.array(F.lit("main"), F.lit("init")))
    c = d.withColumn("score", F.when(F.col("in_degree") == 0, 0.0).otherwise(F.least(raw, F.lit(1.0)))).withColumn("is_entry", entry).withColumn("is_dead", (F.col("in_degree") == 0) & ~entry)
    band = F.when(F.col("score") >= 0.7, "high").when((F.col("score") < 0.3) & ~F.col("is_entry"), "low").otherwise("middle")
    return c.select("path", "in_degree", "out_degree", "users", F.round("score", 9).alias("score"), "is_entry", "is_dead", band.alias("band"))


def decile(scored: DataFrame, column: str = "score", lowest: bool = False) -> DataFrame:
    """The tenth of the rows (one at least) with the highest or lowest value, ties by path, from ranges of that order."""
    scored = cut(scored)
    k = max(1, scored.count() // 10)
    order = F.asc(column) if lowest else F.desc(column)
    return ranked(scored, order, "path", out="__place").where(F.col("__place") < k).drop("__place")
