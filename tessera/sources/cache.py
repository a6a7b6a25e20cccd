"""Parsed modules kept from one build to the next, in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions


class ModuleCache:
    """Rows by ``path`` with the ``hash`` and ``mtime`` of the file they were parsed from.

    A row counts only for a file with the same hash and the same mtime.  Every change makes a
    version; older ones can still be read.  Later rows and removals of a path override earlier
    ones when read; ``compact`` writes what is left as one part.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.versions = Versions(spark, root)

    def as_of(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None for an empty one."""
        put, gone = self.versions.read("put", version), self.versions.read("gone", version)
        if put is None:
            return None
        row = [c for c in put.columns if c != "seq"]
        newest = put.groupBy("path").agg(F.max_by(F.struct(*row), "seq").alias("row"), F.max("seq").alias("seq"))
        if gone is not None:
            removed = gone.groupBy("path").agg(F.max("seq").alias("removed"))
            newest = newest.join(removed, "path", "left").where("removed IS NULL OR removed < seq")
        return newest.select("row.*")

    def get(self, files: DataFrame, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(cached rows of unchanged files, files to parse): ``files`` has path, hash and mtime."""
        known = self.as_of(version)
        if known is None:
            return files.limit(0), files
        return known.join(files.select("path", "hash", "mtime"), ["path", "hash", "mtime"], "left_semi"), files.join(known.select("path", "hash", "mtime"), ["path", "hash", "mtime"], "left_anti")

    def set(self, rows: DataFrame) -> int:
        """Adds or replaces rows; of several of a path one stays.  Returns the new version."""
        return self.versions.commit([("put", rows.dropDuplicates(["path"]))])

    def invalidate(self, paths: DataFrame) -> int:
        return self.versions.commit([("gone", paths.select("path").distinct())])

    def clear(self) -> int:
        """An empty version; the older ones stay readable."""
        return self.versions.commit([], keep=False)

    def compact(self) -> int:
        """The same rows as one part."""
        base = self.versions.latest()
        rows = self.as_of(base)
        return self.versions.commit([("put", rows)] if rows is not None else [], keep=False, base=base)

    def refresh(self, files: DataFrame, parse) -> int:
        """Parses what changed, drops what is gone from ``files``, and returns the new version.

        ``parse`` takes the changed files and returns rows with path, hash and mtime.
        """
        base = self.versions.latest()
        known = self.as_of(base)
        _, changed = self.get(files, base)
        changes = [("put", parse(changed).dropDuplicates(["path"]))]
        if known is not None:
            changes.append(("gone", known.select("path").join(files.select("path"), "path", "left_anti")))
        return self.versions.commit(changes, base=base)
