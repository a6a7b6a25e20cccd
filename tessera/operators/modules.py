"""Filters, searches, pages, samples and counts over module rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cursor, dir_name


def where(modules: DataFrame, language: str | None = None, layer: str | None = None, tags: list[str] | None = None, fold: bool = False) -> DataFrame:
    """Exact filters joined by and; ``fold`` ignores case; of several tags one must fit."""
    f = F.lower if fold else (lambda c: c)
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    for c, v in (("language", language), ("layer", layer)):
        if v is not None:
            modules = modules.where(f(F.col(c)) == low(v))
    if tags:
        modules = modules.where(F.arrays_overlap(F.transform("tags", lambda x: f(x)), F.array(*[F.lit(low(t)) for t in tags])))
    return modules


def search(modules: DataFrame, text: str, columns: tuple[str, ...] = ("description", "name", "path")) -> DataFrame:
    """Case-insensitive substring of one of the columns or of a tag."""
    q = text.lower()
    hit = F.exists("tags", lambda t: F.lower(t).contains(q))
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return modules.where(F.coalesce(hit, F.lit(False)))


def identify(modules: DataFrame, key: str) -> DataFrame:
    """The modules whose URI, path or name is ``key``."""
    return modules.where((F.col("uri") == key) | (F.col("path") == key) | (F.col("name") == key))


def exports_like(modules: DataFrame, text: str) -> DataFrame:
    """(export, path), one row for each export that holds ``text``."""
    return modules.select(F.explode("exports").alias("export"), "path").where(F.col("export").contains(text))


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) by a total order: a top-k of number * size rows, then an offset."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def cursor_page(modules: DataFrame, first: int, after: int = -1) -> DataFrame:
    """(path, cursor, has_next) of ``first`` modules by path behind position ``after``.

    Only one row beyond the page is read to tell whether more follow.
    """
    rows = modules.select("path").orderBy("path").offset(after + 1).limit(first + 1)
    nth = F.row_number().over(Window.orderBy("path"))
    numbered = rows.withColumn("position", (nth + after).cast("long")).withColumn("has_next", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > first)
    return numbered.where(nth_at(after, first)).select("path", cursor(F.col("position")).alias("cursor"), "has_next")


def nth_at(after: int, first: int) -> Column:
    return F.col("position") <= after + first


def sample_hash(df: DataFrame, n: int, seed: int = 0, key: str = "path") -> DataFrame:
    """n rows in the order of a seeded hash: a top-k that partitions do not change."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), key).limit(n)


def sample_recent(df: DataFrame, n: int, time: str = "mtime", key: str = "path") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(time), key).limit(n)


def stratified_quota(df: DataFrame, n: int, directory: Column | None = None, key: str = "path") -> DataFrame:
    """(dir, size, quota): n shared out by directory size, one at least, the last takes the rest."""
    d = directory if directory is not None else dir_name(F.col(key))
    sizes = df.groupBy(d.alias("dir")).agg(F.count(F.lit(1)).alias("size"))
    total = df.count()
    whole = Window.orderBy("dir")
    share = F.least(F.greatest(F.floor(F.lit(n) * F.col("size") / max(total, 1)), F.lit(1)), F.col("size"))
    s = sizes.withColumn("share", share).withColumn("before", F.coalesce(F.sum("share").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.lead("dir").over(whole).isNull()
    left = F.greatest(F.lit(n) - F.col("before"), F.lit(0))
    return s.select("dir", "size", F.when(last, F.least(left, "size")).otherwise(F.least("share", left)).cast("long").alias("quota"))


def sample_stratified(df: DataFrame, n: int, seed: int = 0, directory: Column | None = None, key: str = "path") -> DataFrame:
    d = directory if directory is not None else dir_name(F.col(key))
    ranked = df.withColumn("dir", d).withColumn("nth", F.row_number().over(Window.partitionBy("dir").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), key)))
    # No folder's quota is above n: the limit is a constant, so each task sends on no more than n rows of a folder.
    ranked = ranked.where(F.col("nth") <= n)
    return ranked.join(stratified_quota(df, n, directory, key).select("dir", "quota"), "dir").where("nth <= quota").drop("nth", "quota")


def counts(modules: DataFrame, column: str) -> DataFrame:
    """(column, n), empty values left out."""
    return modules.where(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def list_counts(modules: DataFrame, column: str, name: str) -> DataFrame:
    return modules.select(F.explode(column).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def statistics(modules: DataFrame, edges: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: totals, the most frequent language and layer (the least of equals), mean dependencies."""
    def top(c: str) -> Column:
        return F.mode(c, deterministic=True).alias(f"top_{c}")

    m = modules.agg(F.count(F.lit(1)).alias("modules"), F.sum(F.size("exports")).cast("long").alias("exports"), top("language"), top("layer"))
    tags = modules.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("tags"))
    e, t = edges.agg(F.count(F.lit(1)).alias("dependencies")), triples.agg(F.count(F.lit(1)).alias("triples"))
    return m.crossJoin(tags).crossJoin(e).crossJoin(t).withColumn("mean_dependencies", F.try_divide("dependencies", "modules"))


def relationships(modules: DataFrame) -> DataFrame:
    """One row: dependencies and calls of all modules, and their sum."""
    many = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0)).cast("long")
    return modules.agg(many("dependencies").alias("dependencies"), many("calls").alias("calls")).withColumn("relationships", F.col("dependencies") + F.col("calls"))


def sample_statistics(df: DataFrame, sample: DataFrame, directory: Column | None = None, key: str = "path") -> DataFrame:
    """(dir, files, sampled): how many files of each folder a sample holds."""
    d = directory if directory is not None else dir_name(F.col(key))
    n = df.groupBy(d.alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    s = sample.groupBy(d.alias("dir")).agg(F.count(F.lit(1)).alias("sampled"))
    return n.join(s, "dir", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))


def duplicates(modules: DataFrame, column: str = "uri") -> DataFrame:
    """(path, column) of values that several paths share."""
    many = modules.groupBy(column).agg(F.count_distinct("path").alias("n")).where("n > 1").select(column)
    return modules.join(many, column, "left_semi").select("path", column)
