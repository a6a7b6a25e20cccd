"""Source trees as DataFrames: files, languages, ignore and focus filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, glob_regex, matches_glob

# Language and its extensions.
_EXTENSIONS = {
    "Go": [".go"], "Python": [".py", ".pyw"], "JavaScript": [".js", ".mjs", ".cjs"], "TypeScript": [".ts", ".tsx"], "Java": [".java"], "Rust": [".rs"], "C": [".c", ".h"],
    "C++": [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".h++"], "C#": [".cs"], "Ruby": [".rb"], "PHP": [".php"], "Swift": [".swift"], "Kotlin": [".kt", ".kts"], "Scala": [".scala"],
}
LANGUAGES = {e: name for name, many in _EXTENSIONS.items() for e in many}

# What a scan ignores by default.
IGNORED = [
    ".git", ".svn", ".hg", ".bzr", "node_modules", "vendor", "target", "dist", "build", "out", "bin", ".idea", ".vscode", ".vs",
    "*.swp", "*.swo", "*~", ".DS_Store", "Thumbs.db", "*.exe", "*.dll", "*.so", "*.dylib", "*.o", "*.a", "*.class", "*.pyc", "__pycache__",
]

#: Comment markers around the metadata block of a source file.
START, END = r"<!-- (?!End )(?:\w+ )?RDF -->", r"<!-- End (?:\w+ )?RDF -->"


def language_of(path: Column, languages: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in (languages or LANGUAGES).items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Git-like: a plain name fits any path part, ``dir/`` what lies below, a glob the path or its base name."""
    out = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            hit = path.startswith(p) | path.contains(f"/{p}")
        elif "*" in p or "?" in p:
            hit = matches_glob(path, p)
        elif "/" in p:
            hit = (path == p) | path.startswith(f"{p}/")
        else:
            hit = F.array_contains(F.split(path, "/"), p)
        out = out | hit
    return out


def parse_ignore(text: str) -> list[str]:
    """One pattern a line; blank lines, comments and negations are passed over."""
    return [x for x in (line.strip() for line in text.splitlines()) if x and x[0] not in "#!"]


def in_focus(path: Column, patterns: list[str]) -> Column:
    out = F.lit(not patterns)
    for p in patterns:
        out = out | matches_glob(path, p)
    return out


def focus_reason(path: Column, patterns: list[str]) -> Column:
    """The first pattern that fits, null if none does."""
    return F.coalesce(*[F.when(matches_glob(path, p), p) for p in patterns]) if patterns else F.lit(None).cast("string")


def focus_statistics(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, n): files that each pattern fits first; a null pattern counts those that none fits."""
    return files.groupBy(focus_reason(F.col("path"), patterns).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def scan(
    spark: SparkSession, root: str, ignore: list[str] | None = None, focus: list[str] | None = None, max_size: int = 1 << 20, languages: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(files, errors) below ``root``: path, language, size, mtime, content, has_doc.

    Paths are relative to the root.  Ignored files, files of unknown language and files above
    ``max_size`` are left out; unreadable metadata blocks are listed as errors.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + glob_regex(root.removeprefix("file:").strip("/"))[1:-1] + "/", "")
    f = raw.where(F.col("length") <= max_size).select(inside.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    f = f.withColumn("language", language_of(F.col("path"), languages)).where(F.col("language") != "unknown")
    f = f.where(~is_ignored(F.col("path"), IGNORED if ignore is None else ignore))
    if focus:
        f = f.where(in_focus(F.col("path"), focus))
    f = f.withColumn("content", F.decode("content", "UTF-8"))
    f = f.withColumn("has_doc", F.col("content").rlike(START)).withColumn("hash", F.sha2("content", 256))
    errors = f.where("has_doc").select("path", block_error(F.col("content")).alias("error")).where("error IS NOT NULL")
    return f.select("path", "language", "size", "mtime", "has_doc", "hash", "content"), errors


def block(content: Column) -> Column:
    """What stands between the first pair of markers, trimmed; null without one."""
    inner = F.regexp_extract(content, f"(?s){START}(.*?){END}", 1)
    return F.when(content.rlike(f"(?s){START}.*?{END}"), F.trim(F.regexp_replace(inner, r"^\s+|\s+$", "")))


def block_error(content: Column) -> Column:
    start, end = F.regexp_instr(content, F.lit(START)), F.regexp_instr(content, F.lit(END))
    return F.when((start > 0) & (end == 0), "the metadata block is not closed").when((start > 0) & (end < start), "the end marker comes before the start")


def changed_since(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not among ``known``: what a cached build must parse again."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def only_listed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files named in a list of changes, such as a diff gives."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")
