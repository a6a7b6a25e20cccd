"""The index of metadata entries by tag, concept, language and layer, kept up to date by deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .shadow import index


class PostingIndex:
    """(kind, key, path) postings as a base and deltas.

    A change of an entry writes its new postings and a mark that ends all earlier ones of its
    path.  A reader leaves out the postings that a later mark ends.  ``compact`` makes one base,
    sorted by kind and key, so that a lookup reads few row groups.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.versions = Versions(spark, root)

    def postings(self, where: Column | None = None, version: int | None = None) -> DataFrame | None:
        """The postings of a version; ``where`` over kind and key reaches the scans."""
        all_, ended = self.versions.read("posting", version), self.versions.read("ended", version)
        if all_ is None:
            return None
        rows = all_ if where is None else all_.where(where)
        if ended is not None:
            last = ended.groupBy("path").agg(F.max("seq").alias("until"))
            rows = rows.join(last, "path", "left").where("until IS NULL OR seq >= until")
        return rows.select("kind", "key", "path")

    def add(self, entries: DataFrame) -> int:
        """Adds entries, or replaces those of the same path.  Returns the new version."""
        return self.versions.commit([("posting", index(entries)), ("ended", entries.select("path").distinct())])

    def remove(self, paths: DataFrame) -> int:
        return self.versions.commit([("ended", paths.select("path").distinct())])

    def lookup(self, kind: str, key: str) -> DataFrame | None:
        """(path) of the entries with a tag, concept, language or layer."""
        found = self.postings((F.col("kind") == kind) & (F.col("key") == key))
        return None if found is None else found.select("path")

    def compact(self) -> int:
        base = self.versions.latest()
        rows = self.postings(version=base)
        return self.versions.commit([("posting", rows.repartitionByRange("kind", "key", "path").sortWithinPartitions("kind", "key", "path"))] if rows is not None else [], keep=False, base=base)
