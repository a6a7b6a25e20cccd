"""Source trees as a data source that prunes while it lists.

The driver lists only as many folders, breadth first, as it takes to fill the partitions; each
task walks the folders it was given.  An ignored folder is never opened, a file that its name,
size or time rules out is never read.  Filters on path, language, size and mtime reach the
source.  What cannot be listed or read is a row with its error; in strict mode it ends the scan.

The same source as a stream gives one whole listing whenever the tree has changed.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from ..functions.text import glob_regex
from ..operators.modules import sample_hash, sample_recent, sample_stratified
from .files import END, IGNORED, LANGUAGES, START

LISTING = "path string, language string, size long, mtime timestamp, has_doc boolean, hash string, content string, error string"
SEEN = "path string, size long, mtime timestamp, seen timestamp"


@dataclass(frozen=True)
class Rules:
    """What of a tree is wanted; paths are relative to its root."""

    ignore: tuple[str, ...] = tuple(IGNORED)
    focus: tuple[str, ...] = ()
    max_size: int = 1 << 20
    since: float | None = None

    @staticmethod
    def _glob(path: str, pattern: str) -> bool:
        fits = re.match(glob_regex(pattern), path)
        return bool(fits or "/" not in pattern and re.match(glob_regex(pattern), path.rsplit("/", 1)[-1]))

    def ignored(self, path: str, folder: bool) -> bool:
        """Git-like, as ``files.is_ignored``; a folder is ignored if all below it would be."""
        for p in self.ignore:
            if p.endswith("/"):
                if folder and f"/{path}/".endswith(f"/{p}") or f"/{p}" in f"/{path}":
                    return True
            elif "*" in p or "?" in p:
                if self._glob(path, p):
                    return True
            elif "/" in p:
                if path == p or path.startswith(f"{p}/"):
                    return True
            elif p in path.split("/"):
                return True
        return False

    def focused(self, path: str) -> bool:
        return not self.focus or any(self._glob(path, p) for p in self.focus)

    def may_focus(self, folder: str) -> bool:
        """Whether a focused file can lie below a folder: by the fixed front of each pattern."""
        for p in self.focus:
            front = re.split(r"[*?\[]", p, maxsplit=1)[0].rpartition("/")[0]
            if "/" not in p or not front or f"{front}/".startswith(f"{folder}/") or folder.startswith(f"{front}/"):
                return True
        return not self.focus


def language(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get("." + name.rsplit(".", 1)[-1].lower(), "unknown") if "." in name else "unknown"


class Tree:
    """Listing and reading below a root, on any file system that pyarrow knows by its URI."""

    def __init__(self, root: str, rules: Rules, strict: bool = False):
        self.root, self.rules, self.strict = root, rules, strict

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else self.root.removeprefix("file:"))

    def entries(self, folder: str) -> tuple[list[str], list, str | None]:
        """(folders, files, error) of one folder, pruned by name."""
        from pyarrow import fs

        system, base = self._open()
        base = base.rstrip("/")
        try:
            infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
        except OSError as e:
            if self.strict:
                raise
            return [], [], str(e)
        folders, files = [], []
        for i in sorted(infos, key=lambda i: i.path):
            path = i.path[len(base) + 1 :]
            is_folder = i.type == fs.FileType.Directory
            if self.rules.ignored(path, is_folder):
                continue
            if is_folder:
                if self.rules.may_focus(path):
                    folders.append(path)
            elif i.type == fs.FileType.File:
                files.append((path, i.size or 0, i.mtime))
        return folders, files, None

    def wanted(self, path: str, size: int, mtime: datetime.datetime | None) -> bool:
        r = self.rules
        recent = r.since is None or mtime is not None and mtime.timestamp() > r.since
        return size <= r.max_size and recent and r.focused(path) and language(path) != "unknown"

    def walk(self, folder: str, deep: bool) -> Iterator[tuple]:
        """(path, size, mtime, error) of the wanted files of a folder, and below it if ``deep``."""
        todo = [folder]
        while todo:
            at = todo.pop()
            folders, files, error = self.entries(at)
            if error:
                yield at, None, None, error
            for f in files:
                if self.wanted(*f):
                    yield *f, None
            if deep:
                todo.extend(reversed(folders))

    def read(self, path: str) -> bytes:
        system, base = self._open()
        with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
            return f.read()


@dataclass
class Folders(InputPartition):
    folders: list[tuple[str, bool]]

    def __init__(self, folders):
        self.folders = folders


def _split(tree: Tree, least: int, per: int = 16) -> list[Folders]:
    """Folders for the tasks: the tree is opened breadth first until ``least`` subtrees stand side by side."""
    shallow, front = [], [""]
    while front and len(front) < least:
        deeper = []
        for f in front:
            deeper += tree.entries(f)[0]
            shallow.append((f, False))
        front = deeper
    work = [(f, True) for f in front] + shallow
    size = max(1, min(per, len(work) // least))
    return [Folders(work[k : k + size]) for k in range(0, len(work), size)]


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree, contents: bool, tasks: int):
        self.tree, self.contents, self.tasks, self.tests = tree, contents, tasks, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of single columns that a listing can decide; the rest go back to Spark."""
        import operator

        compare = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, many: x in many, StringStartsWith: str.startswith}
        for f in filters:
            names = getattr(f, "attribute", None)
            if type(f) in compare and names in (("path",), ("language",), ("size",)):
                self.tests.append((names[0], compare[type(f)], f.value))
                if type(f) is StringStartsWith and names == ("path",) and not self.tree.rules.focus and not re.search(r"[*?\[]", f.value):
                    self.tree.rules = replace(self.tree.rules, focus=(f"{f.value}**",))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return _split(self.tree, self.tasks)

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder, deep in partition.folders:
            for path, size, mtime, error in self.tree.walk(folder, deep):
                facts = {"path": path, "language": language(path), "size": size}
                if any(facts[c] is None or not test(facts[c], value) for c, test, value in self.tests):
                    continue
                if error or not self.contents:
                    yield path, None if error else facts["language"], size, mtime, None, None, None, error
                    continue
                try:
                    raw = self.tree.read(path)
                except OSError as e:
                    if self.tree.strict:
                        raise
                    yield path, facts["language"], size, mtime, None, None, None, str(e)
                    continue
                text = raw.decode("utf-8", "replace")
                start, end = re.search(START, text), re.search(END, text)
                fault = "the metadata block is not closed" if start and not end else "the end marker comes before the start" if start and end and end.start() < start.start() else None
                yield path, facts["language"], size, mtime, bool(start), hashlib.sha256(raw).hexdigest(), text, fault


class TreeStream(DataSourceStreamReader):
    """A whole listing each time the tree's listing differs from the last."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def _listing(self) -> list[tuple]:
        return sorted((p, s, m) for p, s, m, error in self.tree.walk("", True) if not error)

    def initialOffset(self) -> dict:
        return {"mark": ""}

    def latestOffset(self) -> dict:
        return {"mark": hashlib.sha256(repr(self._listing()).encode()).hexdigest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = datetime.datetime.now(datetime.timezone.utc)
        parts = _split(self.tree, 4)
        for p in parts:
            p.seen = self.seen
        return parts

    def read(self, partition: Folders) -> Iterator[tuple]:
        # A row of the root tells the listing's time even where no file is left.
        yield "", -1, partition.seen, partition.seen
        for folder, deep in partition.folders:
            for path, size, mtime, error in self.tree.walk(folder, deep):
                if not error:
                    yield path, size, mtime, partition.seen


class TreeSource(DataSource):
    """Options: path, ignore and focus (patterns by line), maxSize, since (epoch seconds), mode
    (permissive or strict), contents (true or false), tasks."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SEEN if self.options.get("listing") == "true" else LISTING

    def _tree(self) -> Tree:
        o = self.options
        lines = lambda k, d: tuple(x for x in o[k].split("\n") if x) if k in o else d
        rules = Rules(lines("ignore", tuple(IGNORED)), lines("focus", ()), int(o.get("maxsize", o.get("maxSize", 1 << 20))), float(o["since"]) if "since" in o else None)
        return Tree(o["path"], rules, o.get("mode", "permissive") == "strict")

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self._tree(), self.options.get("contents", "true") == "true", int(self.options.get("tasks", 32)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TreeStream(self._tree())


def _reader(spark: SparkSession, reader, root: str, ignore, focus, **options):
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    named = {"ignore": "\n".join(ignore)} if ignore is not None else {}
    named |= {"focus": "\n".join(focus)} if focus else {}
    return reader.format("source_tree").options(path=root, **named, **{k: str(v) for k, v in options.items() if v is not None})


def scan_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, focus: list[str] | None = None, since: float | None = None, strict: bool = False, contents: bool = True, max_size: int = 1 << 20) -> DataFrame:
    """path, language, size, mtime, has_doc, hash, content and error of the wanted files below ``root``.

    A file of unknown language, an ignored one, one above ``max_size`` or not newer than ``since``
    is left out and not read.  A row with an error is a folder or file that could not be read, or
    a file whose metadata block is broken; ``strict`` raises on the first that cannot be read.
    """
    return _reader(spark, spark.read, root, ignore, focus, since=since, mode="strict" if strict else None, contents=str(contents).lower(), maxSize=max_size).load()


def listings(spark: SparkSession, root: str, ignore: list[str] | None = None, focus: list[str] | None = None) -> DataFrame:
    """A stream of (path, size, mtime, seen): all wanted files whenever something has changed."""
    return _reader(spark, spark.readStream, root, ignore, focus, listing="true").load()


def _contents(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for p in b.column(0).to_pylist():
            try:
                texts.append(tree.read(p).decode("utf-8", "replace"))
            except OSError:
                texts.append(None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "content"])


def contents(paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (path first) with the content of each file, null where it is gone: read by the tasks."""
    tree = Tree(root, Rules())
    return paths.mapInArrow(lambda x: _contents(x, tree), StructType([*paths.schema, *StructType.fromDDL("content string")]))


def choose(files: DataFrame, changed: DataFrame | None = None, focus: list[str] | None = None, sample: int | None = None, strategy: str = "random", seed: int = 0) -> DataFrame:
    """The files of a build: those among ``changed`` paths, then in focus, then a sample of at most ``sample``.

    Strategies are random, stratified (by folder) and recent; where fewer files are left, all stay.
    """
    from .files import in_focus, only_listed

    if changed is not None:
        files = only_listed(files, changed)
    if focus:
        files = files.where(in_focus(F.col("path"), focus))
    if not sample or sample <= 0:
        return files
    if strategy not in ("random", "stratified", "recent"):
        raise ValueError(f"unknown strategy {strategy}")
    take = {"random": lambda: sample_hash(files, sample, seed), "recent": lambda: sample_recent(files, sample), "stratified": lambda: sample_stratified(files, sample, seed).drop("dir")}
    return take[strategy]()
