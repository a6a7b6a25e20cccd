"""Turtle blocks to triples: a tokenizer and parser in Python, run over Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dir_name, resolve_path
from ..schema import NS, RDF_TYPE
from ..session import cut
from .files import block

_TOKEN = re.compile(r"""\s+|\#[^\n<]*(?=\n|$)|(?P<iri><[^<>\s]*>)|(?P<long>\"{3}.*?\"{3})|(?P<string>"(?:[^"\\]|\\.)*")(?:@[\w-]+|\^\^(?:<[^>]*>|[\w:]+))?|(?P<prefix>@prefix)|(?P<mark>[;,\[\]]|\.(?=\s|$))|(?P<word>[^\s;,\[\]"<>]+?(?=\.?(?:[\s;,\[\]]|$)))""", re.S | re.X)


class TurtleError(ValueError):
    pass


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise TurtleError(f"cannot read {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Turtle:
    """parse() gives (subject, predicate, object, object_type) rows; a blank node is named by its content."""

    def __init__(self, text: str):
        self.tokens, self.at, self.rows = tokenize(text), 0, []
        self.prefixes = {"rdf": RDF_TYPE[: -len("type")], "code": NS}

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TurtleError("the block ends within a statement")
        self.at += 1
        return self.tokens[self.at - 1]

    def mark(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" else ""

    def term(self) -> tuple[str, str]:
        kind, v = self.take()
        if kind == "iri":
            return v[1:-1], "uri"
        if kind in ("string", "long"):
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[3:-3] if kind == "long" else v[1:-1]), "literal"
        if v == "[":
            rows, self.rows = self.rows, []
            pairs = self.predicates("", "]")
            self.take()
            name = "_:" + hashlib.md5(repr(sorted(pairs)).encode()).hexdigest()[:12]
            inner, self.rows = self.rows, rows
            self.rows += inner + [(name, p, o, t) for p, o, t in pairs]
            return name, "bnode"
        if kind == "word" and v == "a":
            return RDF_TYPE, "uri"
        if kind == "word" and ":" in v:
            prefix, local = v.split(":", 1)
            return (self.prefixes[prefix] + local, "uri") if prefix in self.prefixes else (v, "uri")
        if kind == "word":
            return v, "literal"
        raise TurtleError(f"unexpected {v!r}")

    def predicates(self, subject: str, end: str) -> list[tuple[str, str, str]]:
        out = []
        while self.mark() != end:
            p = self.term()[0]
            while True:
                o, kind = self.term()
                out.append((p, o, kind))
                if self.mark() != ",":
                    break
                self.at += 1
            while self.mark() == ";":
                self.at += 1
            if self.at >= len(self.tokens):
                if end == "]":
                    raise TurtleError("a blank node is not closed")
                break
        return out

    def parse(self) -> list[tuple[str, str, str, str]]:
        while self.at < len(self.tokens):
            if self.tokens[self.at][0] == "prefix":
                self.at += 1
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = self.take()[1][1:-1]
                if self.mark() == ".":
                    self.at += 1
                continue
            s = self.term()[0]
            self.rows += [(s, p, o, k) for p, o, k in self.predicates(s, ".")]
            if self.mark() == ".":
                self.at += 1
        return self.rows


def parse_turtle(text: str) -> list[tuple[str, str, str, str]]:
    return Turtle(text).parse()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["subject", "predicate", "object", "object_type", "file", "error"]
    for b in batches:
        rows = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                rows += [(*r, path, None) for r in parse_turtle(text)]
            except (TurtleError, KeyError, IndexError) as e:
                rows.append((None, None, None, None, path, str(e)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(6)], names=names)


def parse_files(files: DataFrame) -> DataFrame:
    """(subject, predicate, object, object_type, file, error) of the first block of each file.

    A block that cannot be read gives one row with an error; files without a block give none.
    Texts are dealt out first, since a table of few bytes comes as few partitions, however many files it makes.
    """
    shares = 4 * files.sparkSession.sparkContext.defaultParallelism
    docs = files.select("path", block(F.col("content")).alias("text")).where("text IS NOT NULL").repartition(shares, "path")
    return docs.mapInArrow(_parse, "subject string, predicate string, object string, object_type string, file string, error string")


def triples_of(parsed: DataFrame) -> DataFrame:
    """The set of triples without errors; subjects that are file fragments become file paths."""
    t = cut(parsed.where("error IS NULL"))  # read twice below, parsed once
    typed = t.where((F.col("predicate") == RDF_TYPE) & F.col("object").contains("Module")).groupBy("file").agg(F.min("subject").alias("main"))
    t = t.join(typed, "file", "left")
    target = F.when(F.col("predicate").endswith("linksTo"), resolve_path(dir_name(F.col("file")), F.col("object"))).otherwise(F.col("object"))
    subject = F.when(F.col("subject") == F.col("main"), F.col("file")).otherwise(F.col("subject"))
    return t.select(subject.alias("subject"), "predicate", F.regexp_replace(target, r"^\./", "").alias("object"), "object_type", "file").distinct()


def resolve_edges(triples: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, resolved): link targets looked up as a path, then a URI, then a name, then a path's end.

    Where several modules fit a step, the least path is taken.
    """
    e = triples.where(F.col("predicate").endswith("linksTo")).select(F.col("subject").alias("src"), F.col("object").alias("target")).distinct()
    e = cut(e)
    by = lambda key, name: modules.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("target")).agg(F.min("path").alias(name))
    e = e.join(by("path", "p1"), "target", "left").join(by("uri", "p2"), "target", "left").join(by("name", "p3"), "target", "left")
    # A target may be any end of a path: paths are cut to the lengths that targets have, so that
    # the last step is an equi-join too.  There are no more lengths than the longest path has characters.
    longest = modules.agg(F.max(F.length("path"))).first()[0] or 0
    lengths = [r[0] for r in e.where("p1 IS NULL AND p2 IS NULL AND p3 IS NULL").select(F.length("target").alias("n")).where(F.col("n").between(1, longest)).distinct().collect()]
    cut_at = F.array(*map(F.lit, sorted(lengths))).cast("array<int>")
    ends = modules.select("path", F.explode(F.filter(cut_at, lambda n: n <= F.length("path"))).alias("n")).select("path", F.expr("right(path, n)").alias("target"))
    e = e.join(ends.groupBy("target").agg(F.min("path").alias("p4")), "target", "left")
    found = F.coalesce("p1", "p2", "p3", "p4")
    return e.select("src", F.coalesce(found, "target").alias("dst"), found.isNotNull().alias("resolved"))
