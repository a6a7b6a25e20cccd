"""Graphs projected from star-schema tables.

The projections are plain SQL that Spark and DuckDB read alike, so that a query and its
check start from the same rows.  Lists travel as text joined by ``|``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NS, RDF_TYPE

MODULES_SQL = """
SELECT concat('region/', CAST(r_regionkey AS STRING)) AS path, r_name AS name, CAST(NULL AS STRING) AS description, 'geo' AS language, 'region' AS layer,
       'public|world' AS tag_text, concat(r_name, '|main') AS export_text FROM region
UNION ALL SELECT concat('nation/', CAST(n_nationkey AS STRING)), n_name, concat('nation of region ', CAST(n_regionkey AS STRING)), 'geo', 'nation', 'internal', n_name FROM nation
UNION ALL SELECT concat('supplier/', CAST(s_suppkey AS STRING)), s_name, CASE WHEN s_acctbal > 5000 THEN 'rich supplier' END, 'trade', 'supplier',
       CASE WHEN s_acctbal < 0 THEN 'admin|debt' ELSE 'trusted' END, CASE WHEN s_acctbal >= 0 THEN s_name ELSE '' END FROM supplier
UNION ALL SELECT concat('customer/', CAST(c_custkey AS STRING)), c_name, CASE WHEN c_acctbal > 0 THEN concat('buys ', c_mktsegment) END, c_mktsegment, 'customer',
       CASE WHEN c_acctbal < 0 THEN concat('data|', c_mktsegment) ELSE c_mktsegment END, CASE WHEN c_acctbal > 9000 THEN c_name ELSE '' END FROM customer
UNION ALL SELECT concat('orders/', CAST(o_orderkey AS STRING)), concat('order ', CAST(o_orderkey AS STRING)), '', o_orderstatus, 'orders', o_orderpriority, '' FROM orders"""

EDGES_SQL = """
SELECT concat('nation/', CAST(n_nationkey AS STRING)) AS src, concat('region/', CAST(n_regionkey AS STRING)) AS dst FROM nation
UNION ALL SELECT concat('supplier/', CAST(s_suppkey AS STRING)), concat('nation/', CAST(s_nationkey AS STRING)) FROM supplier
UNION ALL SELECT concat('customer/', CAST(c_custkey AS STRING)), concat('nation/', CAST(c_nationkey AS STRING)) FROM customer
UNION ALL SELECT concat('orders/', CAST(o_orderkey AS STRING)), concat('customer/', CAST(o_custkey AS STRING)) FROM orders"""

#: A cyclic graph: consecutive parts of an order.
PART_EDGES_SQL = """
SELECT DISTINCT concat('part/', CAST(a AS STRING)) AS src, concat('part/', CAST(b AS STRING)) AS dst FROM (
  SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem
) WHERE a <> b"""

_TABLES = ("region", "nation", "supplier", "customer", "orders", "lineitem")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the tables of ``sf_dir``, without leaving views behind."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t}" in text}
    for t, df in frames.items():
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(text, **frames)


def split_list(column: str):
    return F.filter(F.split(column, "\\|"), lambda x: x != "")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _sql(spark, sf_dir, MODULES_SQL)
    return m.select("path", F.concat(F.lit("#"), "path").alias("uri"), "name", "description", "language", "layer", split_list("tag_text").alias("tags"), split_list("export_text").alias("exports"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EDGES_SQL)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PART_EDGES_SQL)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules and edges as triples: one scan of each table, unpivoted by ``explode``."""
    m, e = modules(spark, sf_dir), edges(spark, sf_dir)
    one = [F.struct(F.lit(RDF_TYPE).alias("predicate"), F.lit(f"{NS}Module").alias("object"))]
    one += [F.struct(F.lit(NS + c).alias("predicate"), F.col(c).alias("object")) for c in ("name", "description", "language", "layer")]

    def listed(column: str):
        return F.transform(column, lambda x: F.struct(F.lit(NS + column).alias("predicate"), x.alias("object")))

    lists = [listed(c) for c in ("tags", "exports")]
    pairs = F.explode(F.concat(F.array(*one), *lists)).alias("po")
    nodes = m.select(F.col("path").alias("subject"), pairs).select("subject", "po.predicate", "po.object").where("object IS NOT NULL")
    return nodes.unionByName(e.select(F.col("src").alias("subject"), F.lit(f"{NS}linksTo").alias("predicate"), F.col("dst").alias("object")))


def by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same triples, one branch for each predicate.

    A pattern with a constant predicate leaves all other branches out when it is planned, and
    its constants and columns go through to the scans: a layer keeps the table of that layer alone.
    ``triples`` reads each table once and suits what asks for all predicates.
    """
    m, e = modules(spark, sf_dir), edges(spark, sf_dir)

    def branch(predicate: str, subject, object_) -> DataFrame:
        return m.select(F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object"))

    out = branch(RDF_TYPE, "path", F.lit(f"{NS}Module"))
    for c in ("name", "description", "language", "layer"):
        out = out.unionByName(branch(NS + c, "path", F.col(c)).where("object IS NOT NULL"))
    for c in ("tags", "exports"):
        out = out.unionByName(branch(NS + c, "path", F.explode(c)))
    return out.unionByName(e.select(F.col("src").alias("subject"), F.lit(f"{NS}linksTo").alias("predicate"), F.col("dst").alias("object")))


def counts(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Rows by predicate, as far as the tables' numbers of rows tell: a list counts as one row a module."""
    many, links = modules(spark, sf_dir).count(), edges(spark, sf_dir).count()
    return dict.fromkeys([RDF_TYPE, *(NS + c for c in ("name", "description", "language", "layer", "tags", "exports"))], many) | {f"{NS}linksTo": links}


#: The same triples for DuckDB.
TRIPLES_SQL = f"""
SELECT path AS subject, '{RDF_TYPE}' AS predicate, '{NS}Module' AS object FROM m
UNION ALL SELECT path, '{NS}name', name FROM m UNION ALL SELECT path, '{NS}description', description FROM m WHERE description IS NOT NULL
UNION ALL SELECT path, '{NS}language', language FROM m UNION ALL SELECT path, '{NS}layer', layer FROM m
UNION ALL SELECT path, '{NS}tags', tag FROM tg UNION ALL SELECT path, '{NS}exports', export FROM ex UNION ALL SELECT src, '{NS}linksTo', dst FROM e"""

PRELUDE = f"""m AS ({MODULES_SQL}), e AS ({EDGES_SQL}), pe AS ({PART_EDGES_SQL}),
tg AS (SELECT path, layer, language, tag FROM (SELECT path, layer, language, unnest(string_split(tag_text, '|')) AS tag FROM m) WHERE tag <> ''),
ex AS (SELECT path, layer, language, export FROM (SELECT path, layer, language, unnest(string_split(export_text, '|')) AS export FROM m) WHERE export <> ''),
t AS ({TRIPLES_SQL})"""
