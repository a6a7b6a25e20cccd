"""Column functions on paths, globs and labels; no user-defined functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """All before the last slash; '.' for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """The last dot and what follows it in the base name, lower-cased; else ''."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def clean_path(path: Column) -> Column:
    """Folds '.', '..' and empty parts; a leading '..' that nothing precedes stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))


def resolve_path(base_dir: Column, target: Column) -> Column:
    """``target`` seen from ``base_dir`` if it is relative (holds '..' or starts with './')."""
    return F.when(target.contains("..") | target.startswith("./"), clean_path(F.concat_ws("/", base_dir, target))).otherwise(target)


def glob_regex(glob: str) -> str:
    """The regex of a glob: ** crosses slashes, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    """A glob without a slash also fits the base name."""
    hit = path.rlike(glob_regex(glob))
    return hit if "/" in glob else hit | base_name(path).rlike(glob_regex(glob))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def cursor(position: Column) -> Column:
    return F.base64(F.concat(F.lit("cursor:"), position.cast("string")))


def cursor_position(c: Column) -> Column:
    return F.regexp_extract(F.unbase64(c).cast("string"), "^cursor:([0-9]+)$", 1).try_cast("long")


def node_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def escape_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([\\\\\"])", r"\\\\$1"), "\n", r"\\\\n")


def any_contains(c: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of ``words``."""
    low, out = F.lower(c), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))
