"""Settings of scans and queries from YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from .plans.compiler import sparql
from .sources.tree import scan_tree


@dataclass
class Scan:
    # What is scanned unless a file says otherwise.
    include: list[str] = field(default_factory=lambda: ["**/*.go", "**/*.py", "**/*.js", "**/*.ts"])
    exclude: list[str] = field(default_factory=lambda: ["**/node_modules/**", "**/vendor/**", "**/.git/**"])
    max_file_size: int = 1 << 20


@dataclass
class Query:
    default_limit: int = 100
    timeout: float = 30.0


@dataclass
class Config:
    version: int = 1
    scan: Scan = field(default_factory=Scan)
    query: Query = field(default_factory=Query)

    def files(self, spark: SparkSession, root: str, **how) -> DataFrame:
        """The files below ``root`` as the settings choose them; a folder whose name ends a pattern is not opened."""
        names = [p.removeprefix("**/").removesuffix("/**") if p.startswith("**/") and p.endswith("/**") else p for p in self.scan.exclude]
        return scan_tree(spark, root, ignore=names, focus=self.scan.include, max_size=self.scan.max_file_size, **how)

    def ask(self, triples: DataFrame, text: str) -> DataFrame:
        """The solutions of a query, no more than the default limit where it names none."""
        return sparql(triples, text, limit=self.query.default_limit or None)


def _seconds(value) -> float:
    """Seconds from a number, or from a text such as 1m30s or 500ms."""
    import re

    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    parts = re.findall(r"([0-9.]+)(ms|h|m|s)", str(value))
    if not parts or "".join(a + b for a, b in parts) != str(value):
        raise ValueError(f"no duration: {value}")
    return sum(float(a) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[b] for a, b in parts)


def parse_config(text: str) -> Config:
    """Settings from YAML; what is not named keeps its default, unknown names and wrong kinds are errors."""
    import yaml

    data = yaml.safe_load(text) or {}
    out = Config()

    def fill(target, values, where: str):
        if not isinstance(values, dict):
            raise ValueError(f"{where} must hold names and values")
        known = {f.name for f in fields(target)}
        if values.keys() - known:
            raise ValueError(f"{where} has no {sorted(values.keys() - known)}")
        for k, v in values.items():
            old = getattr(target, k)
            if hasattr(old, "__dataclass_fields__"):
                fill(old, v or {}, k)
            elif k == "timeout":
                target.timeout = _seconds(v)
            elif isinstance(old, list) and isinstance(v, list) and all(isinstance(x, str) for x in v) or type(old) is type(v):
                setattr(target, k, v)
            else:
                raise ValueError(f"{where}.{k} is of the wrong kind")

    fill(out, data, "the file")
    if out.version != 1 or out.scan.max_file_size < 0 or out.query.default_limit < 0:
        raise ValueError("unknown version, or a negative size or limit")
    return out


def load_config(path: str) -> Config:
    """Settings from a file; the defaults where there is none."""
    if not os.path.exists(path):
        return Config()
    with open(path) as f:
        return parse_config(f.read())
