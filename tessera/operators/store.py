"""Triple store operations: each takes and returns DataFrames of (subject, predicate, object)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["subject", "predicate", "object"]


def add(triples: DataFrame, more: DataFrame) -> DataFrame:
    """Set union."""
    return triples.select(COLUMNS).unionByName(more.select(COLUMNS)).distinct()


def find(triples: DataFrame, subject: str = "", predicate: str = "", object: str = "") -> DataFrame:
    """Triples that fit; an empty text fits all.  The conditions reach the scan."""
    for c, v in zip(COLUMNS, (subject, predicate, object)):
        if v:
            triples = triples.where(F.col(c) == v)
    return triples


def delete(triples: DataFrame, subject: str = "", predicate: str = "", object: str = "") -> DataFrame:
    """Triples that do not fit; without any text nothing is left."""
    keep = F.lit(False)
    for c, v in zip(COLUMNS, (subject, predicate, object)):
        if v:
            keep = keep | (F.col(c) != v)
    return triples.where(keep)


def clear(triples: DataFrame) -> DataFrame:
    return triples.limit(0)


def properties(triples: DataFrame, subject: str) -> DataFrame:
    """(predicate, objects) of one node."""
    return find(triples, subject).groupBy("predicate").agg(F.array_sort(F.collect_set("object")).alias("objects"))


def distinct_terms(triples: DataFrame, column: str) -> DataFrame:
    return triples.select(column).distinct()


def stats(triples: DataFrame, column: str) -> DataFrame:
    return triples.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def exists(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` triples that the store holds."""
    return wanted.join(triples, COLUMNS, "left_semi")


def save(triples: DataFrame, path: str, buckets: int | None = None) -> None:
    """Parquet partitioned by predicate and sorted by subject, so that a pattern reads its predicate
    alone and, with a constant subject, few row groups of it.

    A predicate is written by several tasks: ``buckets`` ranges of the hash of the subject,
    as many as there are shuffle partitions unless named.
    """
    n = buckets or int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = triples.select(COLUMNS).repartition(n, F.pmod(F.xxhash64("subject"), F.lit(n))).sortWithinPartitions("predicate", "subject")
    cols.write.mode("overwrite").partitionBy("predicate").parquet(path)


def load(spark, path: str) -> DataFrame:
    """The stored triples; a constant predicate, or one that a join brings, prunes the folders read."""
    return spark.read.schema("subject string, predicate string, object string").parquet(path).select(COLUMNS)
