"""Metadata entries kept beside sources: merge, search, statistics, upkeep.

An entry is a row: path, uri, name, language, layer, tags, concepts, exports, source (auto,
manual or mixed), triples (an array of subject, predicate, object, source), relations (of type,
target, direction in or out, and source; a frame may lack the column), annotations and
properties (text maps), hash, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, uri string, name string, language string, layer string, tags array<string>, concepts array<string>, exports array<string>, source string,"
    " triples array<struct<subject:string,predicate:string,object:string,source:string>>, relations array<struct<type:string,target:string,direction:string,source:string>>, annotations map<string,string>, properties map<string,string>, hash string, updated_at timestamp"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON side files, one a file, below ``path``."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def save(entries: DataFrame, path: str) -> None:
    """JSON lines.  Entries without a path or of an unknown source are refused."""
    bad = entries.where(F.col("path").isNull() | ~F.col("source").isin("auto", "manual", "mixed"))
    if not bad.isEmpty():
        raise ValueError("an entry lacks its path or has an unknown source")
    entries.write.mode("overwrite").json(path)


def has_manual() -> Column:
    """Whether a person has added something."""
    manual = F.exists("triples", lambda t: t["source"] == "manual")
    return F.col("source").isin("manual", "mixed") | F.coalesce(manual, F.lit(False)) | (F.coalesce(F.size("annotations"), F.lit(0)) > 0)


def search(entries: DataFrame, language: str | None = None, layer: str | None = None, tags: list[str] | None = None, concepts: list[str] | None = None, text: str | None = None, source: str | None = None, manual: bool | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Entries that fit all that is asked, by path."""
    e = entries
    for c, v in (("language", language), ("layer", layer), ("source", source)):
        if v is not None:
            e = e.where(F.col(c) == v)
    for c, values in (("tags", tags), ("concepts", concepts)):
        for v in values or []:
            e = e.where(F.array_contains(c, v))
    if text:
        q = text.lower()
        e = e.where(F.lower("path").contains(q) | F.coalesce(F.lower("name").contains(q), F.lit(False)) | F.coalesce(F.lower("uri").contains(q), F.lit(False)))
    if manual is not None:
        e = e.where(has_manual() == manual)
    e = e.orderBy("path").offset(offset)
    return e if limit is None else e.limit(limit)


def index(entries: DataFrame) -> DataFrame:
    """(kind, key, path): the inverted index by tag, concept, language and layer, in one pass."""
    def many(c: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    def one(c: str) -> Column:
        return F.filter(F.array(F.struct(F.lit(c).alias("kind"), F.col(c).alias("key"))), lambda x: F.coalesce(x["key"], F.lit("")) != "")

    keys = F.concat(many("tags", "tag"), many("concepts", "concept"), one("language"), one("layer"))
    return entries.select("path", F.explode(F.array_distinct(keys)).alias("k")).select("k.kind", "k.key", "path")


def statistics(entries: DataFrame) -> DataFrame:
    """(kind, key, n): entries in all, by source, and by each key of the index."""
    totals = entries.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("kind"), F.col("source").alias("key"), "n")
    every = entries.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("kind"), F.lit("").alias("key"), "n")
    return every.unionByName(totals).unionByName(index(entries).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")))


def totals(entries: DataFrame) -> DataFrame:
    """One row: entries, manual (a person has added something), automatic, and triples in all."""
    m = F.coalesce(has_manual(), F.lit(False))
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(m).alias("manual"), F.count_if(~m).alias("automatic"), F.coalesce(F.sum(F.coalesce(F.size("triples"), F.lit(0))), F.lit(0)).cast("long").alias("triples"))


_RELATIONS = "array<struct<type:string,target:string,direction:string,source:string>>"


def merge(old: DataFrame, new: DataFrame, preserve_manual: bool = True, by_time: bool = False) -> DataFrame:
    """Entries of both sides by path.

    Where both have one, the new scalars win if given, lists are united, the old annotations
    stay, new properties override, manual triples of the old side are kept if
    ``preserve_manual``, and the source becomes mixed.  Triples are a set by content.  Relations
    are a set by direction, type and target; of two the new one stays, but for a manual old one if
    ``preserve_manual``.  With ``by_time`` the entry updated last is the new one, whichever side it
    is on; ``new`` where times are equal or missing.
    """
    sides = [d if "relations" in d.columns else d.withColumn("relations", F.lit(None).cast(_RELATIONS)) for d in (old, new)]
    columns = [c for c in sides[1].columns if c in sides[0].columns]
    a, b = (d.select(F.col("path").alias("__path"), F.struct(*columns).alias(tag)) for d, tag in zip(sides, ("a", "b")))
    j = a.join(b, "__path", "full_outer")
    swap = F.coalesce(F.col("a.updated_at") > F.col("b.updated_at"), F.lit(False)) if by_time else F.lit(False)
    j = j.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("o"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("n"))
    o, n = lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")
    both = o("path").isNotNull() & n("path").isNotNull()
    out = [F.coalesce(n("path"), o("path")).alias("path")]
    out += [F.coalesce(F.nullif(n(c), F.lit("")), o(c)).alias(c) for c in ("uri", "name", "language", "layer")]
    blank = F.array().cast("array<string>")
    out += [F.array_union(F.coalesce(o(c), blank), F.coalesce(n(c), blank)).alias(c) for c in ("tags", "concepts", "exports")]
    out.append(F.when(both, "mixed").otherwise(F.coalesce(n("source"), o("source"))).alias("source"))
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string,source:string>>")
    kept = F.filter(F.coalesce(o("triples"), none), lambda t: t["source"] == "manual") if preserve_manual else none
    fresh = F.coalesce(n("triples"), none)
    lone = F.filter(kept, lambda t: ~F.exists(fresh, lambda x: (x["subject"] == t["subject"]) & (x["predicate"] == t["predicate"]) & (x["object"] == t["object"])))
    out.append(F.when(both, F.concat(lone, fresh)).otherwise(F.coalesce(n("triples"), o("triples"), none)).alias("triples"))
    bare = F.array().cast(_RELATIONS)
    was, now = F.coalesce(o("relations"), bare), F.coalesce(n("relations"), bare)
    same = lambda x, y: (x["direction"] == y["direction"]) & (x["type"] == y["type"]) & (x["target"] == y["target"])
    stays = (lambda x: (x["source"] == "manual")) if preserve_manual else (lambda x: F.lit(False))
    rest = F.filter(was, lambda x: stays(x) | ~F.exists(now, lambda y: same(x, y)))
    come = F.filter(now, lambda y: ~F.exists(was, lambda x: stays(x) & same(x, y)))
    out.append(F.concat(rest, come).alias("relations"))
    void = F.expr("map()").cast("map<string,string>")
    out.append(F.when(both, F.coalesce(o("annotations"), void)).otherwise(F.coalesce(n("annotations"), o("annotations"), void)).alias("annotations"))
    over = F.coalesce(n("properties"), void)
    out.append(F.map_concat(F.map_filter(F.coalesce(o("properties"), void), lambda k, v: ~F.map_contains_key(over, k)), over).alias("properties"))
    out += [F.coalesce(n(c), o(c)).alias(c) for c in ("hash", "updated_at")]
    return j.select(out)


def sync(entries: DataFrame, files: DataFrame, parsed: DataFrame, force: bool = False, preserve_manual: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, status): entries brought up to date with ``files``, and what became of each path.

    ``parsed`` holds fresh entries of the files.  Entries of unchanged files stay as they are (skipped),
    those with manual data are merged, others replaced (updated) or added (new); entries of files
    that are gone are dropped (orphan).
    """
    status = build_status(entries, files, force).unionByName(orphans(entries, files).select("path", F.lit("orphan").alias("status")))
    of = lambda df, *which: df.join(status.where(F.col("status").isin(*which)).select("path"), "path", "left_semi")
    merged = merge(of(entries, "merged"), of(parsed, "merged"), preserve_manual)
    fresh = of(parsed, "new", "updated")
    out = of(entries, "skipped").unionByName(fresh, allowMissingColumns=True).unionByName(merged, allowMissingColumns=True)
    return out, status


def build_status(entries: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """(path, status) of scanned files: new, skipped (same hash), updated or merged (manual data)."""
    known = entries.select("path", F.col("hash").alias("known"), has_manual().alias("manual"))
    j = files.select("path", "hash").join(known, "path", "left")
    changed = F.when(F.col("manual"), "merged").otherwise("updated")
    status = F.when(F.col("known").isNull() & F.col("manual").isNull(), "new").when((F.col("known") == F.col("hash")) & F.lit(not force), "skipped").otherwise(changed)
    return j.select("path", status.alias("status"))


def orphans(entries: DataFrame, files: DataFrame) -> DataFrame:
    return entries.join(files.select("path"), "path", "left_anti")


def clean(entries: DataFrame, files: DataFrame) -> DataFrame:
    return entries.join(files.select("path"), "path", "left_semi")


def annotate(entries: DataFrame, path: str, key: str, value: str) -> DataFrame:
    """Sets an annotation of one entry, in place of an older one of the key."""
    void = F.expr("map()").cast("map<string,string>")
    others = F.map_filter(F.coalesce("annotations", void), lambda k, v: k != key)
    return entries.withColumn("annotations", F.when(F.col("path") == path, F.map_concat(others, F.create_map(F.lit(key), F.lit(value)))).otherwise(F.col("annotations")))


def add_to(entries: DataFrame, path: str, column: str, value: str) -> DataFrame:
    """Adds to a list column of one entry what is not in it yet."""
    return entries.withColumn(column, F.when(F.col("path") == path, F.array_union(F.coalesce(column, F.array().cast("array<string>")), F.array(F.lit(value)))).otherwise(F.col(column)))


def triples_by(entries: DataFrame, field: str, value: str) -> DataFrame:
    """(path, subject, predicate, object, source) of nested triples whose ``field`` is ``value``."""
    return entries.select("path", F.explode(F.filter("triples", lambda t: t[field] == value)).alias("t")).select("path", "t.*")


def relate(entries: DataFrame, path: str, type: str, target: str, direction: str = "out", source: str = "manual") -> DataFrame:
    """Adds a relation to one entry unless it has one of the direction, type and target."""
    if "relations" not in entries.columns:
        entries = entries.withColumn("relations", F.lit(None).cast(_RELATIONS))
    held = F.coalesce("relations", F.array().cast(_RELATIONS))
    known = F.exists(held, lambda x: (x["type"] == type) & (x["target"] == target) & (x["direction"] == direction))
    one = F.array(F.struct(F.lit(type).alias("type"), F.lit(target).alias("target"), F.lit(direction).alias("direction"), F.lit(source).alias("source")))
    return entries.withColumn("relations", F.when((F.col("path") == path) & ~known, F.concat(held, one)).otherwise(F.col("relations")))
