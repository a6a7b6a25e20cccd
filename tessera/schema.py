"""Shapes of the data model, and IRI canonicalisation.

triples  subject, predicate, object: strings, a set.
modules  one row a node: scalars, string lists, a property map.
edges    src depends on dst, both module paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
NS = "urn:code:"

_LIST = T.ArrayType(T.StringType())
TRIPLES = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "predicate", "object", "object_type", "file")])
MODULES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("path", "uri", "name", "description", "language", "layer")]
    + [T.StructField(c, _LIST) for c in ("tags", "exports", "calls", "dependencies")]
    + [T.StructField("properties", T.MapType(T.StringType(), _LIST))]
)
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])


def bare_iri(c: Column) -> Column:
    """Without enclosing angle brackets, so that a node is one string as subject and as object."""
    return F.regexp_replace(c, "^<(.*)>$", "$1")


def canonical(triples: DataFrame) -> DataFrame:
    return triples.withColumns({c: bare_iri(F.col(c)) for c in ("subject", "predicate", "object")})


def modules_of(triples: DataFrame) -> DataFrame:
    """Module rows from triples: one aggregate over subjects that are typed as a module.

    A predicate is known by its last part: name, description, language and layer set a
    scalar (the greatest value where several are given), tags, exports, calls and linksTo
    fill lists, all others the property map.
    """
    t = triples.withColumn("key", F.regexp_extract("predicate", "([^/#:]+)$", 1))
    typed = t.where((F.col("predicate") == RDF_TYPE) & F.col("object").contains("Module")).select("subject").distinct()
    known = ["name", "description", "language", "layer"]
    lists = {"tags": "tags", "exports": "exports", "calls": "calls", "linksTo": "dependencies"}
    rest = t.where(~F.col("key").isin([*known, *lists]) & (F.col("predicate") != RDF_TYPE))
    maps = rest.groupBy("subject", "predicate").agg(F.array_sort(F.collect_set("object")).alias("values"))
    maps = maps.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "values")))).alias("properties"))
    scalars = [F.max(F.when(F.col("key") == k, F.col("object"))).alias(k) for k in known]
    many = [F.array_sort(F.collect_set(F.when(F.col("key") == k, F.col("object")))).alias(a) for k, a in lists.items()]
    path = F.first("file", ignorenulls=True) if "file" in triples.columns else F.first("subject")
    nodes = t.join(typed, "subject", "left_semi").groupBy("subject").agg(path.alias("path"), *scalars, *many)
    nodes = nodes.join(maps, "subject", "left").withColumnRenamed("subject", "uri")
    return nodes.select([F.col(f.name).cast(f.dataType) for f in MODULES])
