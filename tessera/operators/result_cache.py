"""Results kept for a while, so that a question asked again is read instead of computed."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Statistics:
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    entries: int = 0


class ResultCache:
    """At most ``entries`` results, each for ``seconds``, as Parquet below ``root``.

    A key is the text of a query and the version of what it was asked of: a new version of the
    store makes new keys.  The result used longest ago goes first.  Expired and evicted results
    are deleted at the next call that meets them, so a frame that was handed out should be used
    within ``seconds``.
    """

    def __init__(self, spark: SparkSession, root: str, entries: int = 100, seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.spark, self.root, self.most, self.seconds, self.clock = spark, root.rstrip("/"), entries, seconds, clock
        self._held: OrderedDict[str, tuple[str, float]] = OrderedDict()
        self._counts = Statistics()

    @staticmethod
    def key(text: str, version: object = 0) -> str:
        return hashlib.sha256(f"{version}\n{' '.join(text.split())}".encode()).hexdigest()

    def _drop(self, key: str) -> None:
        folder, _ = self._held.pop(key)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def get(self, text: str, version: object = 0) -> DataFrame | None:
        key = self.key(text, version)
        if key in self._held and self._held[key][1] <= self.clock():
            self._drop(key)
        if key not in self._held:
            self._counts.misses += 1
            return None
        self._counts.hits += 1
        self._held.move_to_end(key)
        return self.spark.read.parquet(self._held[key][0])

    def set(self, text: str, result: DataFrame, version: object = 0) -> DataFrame:
        """Keeps a result, in place of an older one, and returns it as read from where it is kept."""
        key, folder = self.key(text, version), f"{self.root}/{uuid.uuid4().hex}"
        result.write.parquet(folder)
        if key in self._held:
            self._drop(key)
        while len(self._held) >= self.most:
            self._drop(next(iter(self._held)))
            self._counts.evictions += 1
        self._held[key] = (folder, self.clock() + self.seconds)
        return self.spark.read.parquet(folder)

    def ask(self, text: str, make: Callable[[str], DataFrame], version: object = 0) -> DataFrame:
        """The kept result of ``text``, or that of ``make(text)``, kept from now on."""
        found = self.get(text, version)
        return self.set(text, make(text), version) if found is None else found

    def clear(self) -> None:
        for key in list(self._held):
            self._drop(key)

    def statistics(self) -> Statistics:
        return Statistics(self._counts.hits, self._counts.misses, self._counts.evictions, len(self._held))
