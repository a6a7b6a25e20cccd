"""Modules that nothing depends on, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_contains, base_name, dir_name, matches_glob

# Words that speak for registration, reflection and unfinished work.
REGISTRATION = ["cmd_", "command", "handler", "route", "plugin", "middleware"]
REFLECTION = ["reflect", "plugin", "rpc", "api", "handler"]
EXPERIMENTAL = ["experimental", "wip", "draft", "prototype", "poc"]
MAINS = ["main.go", "server.go", "app.go"]

LINES = 50


def _any_tag(words: list[str]) -> Column:
    return F.coalesce(F.exists("tags", lambda t: any_contains(t, words)), F.lit(False))


def is_entry(path: Column) -> Column:
    base, names = base_name(path), F.transform("exports", lambda x: F.regexp_replace(x, "^#", ""))
    registered = F.lit(False)
    for w in REGISTRATION:
        registered = registered | base.contains(w)
    return (
        (base_name(dir_name(path)) == "main") | path.contains("/cmd/") | F.coalesce(F.arrays_overlap(names, F.array(F.lit("main"), F.lit("init"))), F.lit(False)) | base.isin(MAINS) | registered | _any_tag(REGISTRATION)
    )


def confidence(path: Column, description: Column, aggressive: bool = False) -> Column:
    """In hundredths, so that thresholds are met exactly."""
    internal = path.contains("/internal/") | path.startswith("internal/")
    none = F.coalesce(F.size("exports"), F.lit(0)) <= 0
    reflected = _any_tag(REFLECTION) | (~none & ~internal)
    unfinished = _any_tag(EXPERIMENTAL) | any_contains(path, EXPERIMENTAL) | any_contains(F.coalesce(description, F.lit("")), EXPERIMENTAL)
    add = lambda c, n: F.when(c, n).otherwise(0)
    points = F.lit(80) + add(internal, 10) + add(none, 5) - add(reflected, 30) - add(unfinished, 40) + (10 if aggressive else 0)
    return F.greatest(F.least(points, F.lit(100)), F.lit(0))


def dead_modules(edges: DataFrame, modules: DataFrame, minimum: float = 0.5, exclude: list[str] | None = None, aggressive: bool = False) -> DataFrame:
    """(path, confidence, safe, action, risk, lines) of unused modules that are no entry point or test."""
    p = F.col("path")
    m = modules.where(~is_entry(p) & ~p.endswith("_test.go"))
    for g in exclude or []:
        m = m.where(~matches_glob(p, g))
    used = edges.select(F.col("dst").alias("path")).distinct()
    m = m.join(used, "path", "left_anti").withColumn("hundredths", confidence(p, F.col("description"), aggressive))
    m = m.where(F.col("hundredths") >= round((minimum or 0.5) * 100)).withColumn("confidence", F.col("hundredths") / 100).withColumn("safe", F.col("hundredths") >= 80)
    risk = F.when(F.col("safe"), "low").when(F.col("hundredths") >= 60, "medium").otherwise("high")
    return m.select("path", "confidence", "safe", F.when(F.col("safe"), "remove").otherwise("review").alias("action"), risk.alias("risk"), F.lit(LINES).cast("long").alias("lines"))


def summary(dead: DataFrame) -> DataFrame:
    return dead.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.coalesce(F.sum(F.when(F.col("safe"), F.col("lines"))), F.lit(0)).alias("deletable_lines"))


def cleanup_script(dead: DataFrame) -> DataFrame:
    """(nth, line) of a shell script that removes what is safe; it is text and never run here."""
    remove = dead.where("safe").select(F.concat(F.lit("git rm -- '"), F.regexp_replace("path", "'", "'\\\\''"), F.lit("'")).alias("line"), F.lit(1).alias("part"))
    review = dead.where("NOT safe").select(F.concat(F.lit("# review: "), F.col("path")).alias("line"), F.lit(2).alias("part"))
    head = dead.sparkSession.createDataFrame([("#!/bin/sh", 0), ("set -e", 0)], "line string, part int")
    return head.unionByName(remove).unionByName(review).orderBy("part", "line").select("line")
