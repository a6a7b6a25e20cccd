"""Tables kept in versions: Parquet parts, and a manifest for each version that lists its parts.

A writer puts new parts beside the old ones and then renames a manifest into place.  The rename
fails where another writer was first, so a version is seen whole or not at all, and readers of
older versions are never disturbed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConflictError(RuntimeError):
    """Another writer made the version first."""


class Versions:
    """The versions of one table below ``root``, a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = hadoop.fs.FileContext.getFileContext(self._path(self._fs.makeQualified(self._path(self.root)).toString()).toUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def _manifest(self, version: int):
        return self._path(f"{self.root}/versions/{version:012d}.json")

    def latest(self) -> int:
        """The number of the newest version; 0 where there is none."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)

    def parts(self, version: int | None = None) -> list[dict]:
        """The parts of a version, oldest first: kind, folder and the version that brought it."""
        version = self.latest() if version is None else version
        if version == 0:
            return []
        if not self._fs.exists(self._manifest(version)):
            raise ValueError(f"there is no version {version}")
        with_lines = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(self._fs.open(self._manifest(version))))
        try:
            return json.loads(with_lines.readLine())
        finally:
            with_lines.close()

    def commit(self, changes: list[tuple[str, DataFrame]], keep: bool = True, base: int | None = None) -> int:
        """A new version: the parts of ``base`` (if ``keep``) and ``changes``, (kind, frame) each."""
        base = self.latest() if base is None else base
        parts = self.parts(base) if keep else []
        for kind, df in changes:
            folder = f"data/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            parts.append({"kind": kind, "folder": folder, "seq": base + 1})
        draft = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        try:
            none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            self._files.rename(draft, self._manifest(base + 1), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._manifest(base + 1)):
                raise ConflictError(f"version {base + 1} was made by another writer") from e
            raise
        return base + 1

    def read(self, kind: str, version: int | None = None) -> DataFrame | None:
        """All rows of a kind with ``seq``, the version that brought them; None without any."""
        mine = [p for p in self.parts(version) if p["kind"] == kind]
        out = None
        for p in mine:
            df = self.spark.read.parquet(f"{self.root}/{p['folder']}").withColumn("seq", F.lit(p["seq"]).cast("long"))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def vacuum(self, oldest: int) -> int:
        """Deletes the versions before ``oldest`` and the parts that only they list; returns how many parts."""
        live = {p["folder"] for v in range(oldest, self.latest() + 1) for p in self.parts(v)}
        gone = {p["folder"] for v in range(1, oldest) if self._fs.exists(self._manifest(v)) for p in self.parts(v)} - live
        for v in range(1, oldest):
            self._fs.delete(self._manifest(v), False)
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return len(gone)
