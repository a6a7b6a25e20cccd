"""The registered queries of the graph engine over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import checks, coverage, deadcode, impact, security, shadow
from .analysis.postings import PostingIndex
from .functions import text
from .graph import algorithms as g
from .graph import reach
from .operators import modules as ops
from .operators import pages, store
from .plans.compiler import predicate_counts, sparql
from .plans.templates import Templates
from .schema import NS, RDF_TYPE, modules_of
from .session import shared_folder
from .sinks import diagrams, results
from .sources import files, turtle
from .sources.cache import ModuleCache
from .sources.tables import PRELUDE, by_predicate, counts, edges, modules, part_edges, triples
from .streaming.watch import bursts, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, make: Query, sql: str | None = None, prelude: bool = True) -> None:
    QUERIES[name] = make
    if sql:
        with_ = f"WITH RECURSIVE {PRELUDE}" if prelude else ""
        ORACLES[name] = (with_ + (", " if sql.startswith("+") and prelude else " ") + sql.lstrip("+")).strip()


def _p(name: str) -> str:
    return f"'{NS}{name}'"


def _counted(spark: SparkSession, d: str, query: str) -> dict[str, int] | None:
    """Rows by predicate for a query that asks what there is not: such joins are dealt out by them."""
    return counts(spark, d) if "EXISTS" in query or "MINUS" in query else None


# --- SPARQL: patterns, filters, modifiers
def _sparql(name: str, query: str, sql: str) -> None:
    register(name, lambda spark, d: sparql(by_predicate(spark, d), query, _counted(spark, d, query)), sql)


def _pat(alias: str, predicate: str) -> str:
    return f"(SELECT subject AS {alias}, object AS {alias}_o FROM t WHERE predicate = {_p(predicate)})"


_sparql("bgp_single", 'SELECT ?m ?n WHERE { ?m code:name ?n }', f"SELECT subject AS m, object AS n FROM t WHERE predicate = {_p('name')}")
_sparql("bgp_star3", 'SELECT ?m ?n ?g WHERE { ?m code:language "BUILDING" . ?m code:layer "customer" . ?m code:exports ?g . ?m code:name ?n }',
        "SELECT m.path AS m, m.name AS n, export AS g FROM m JOIN ex ON ex.path = m.path WHERE m.language = 'BUILDING' AND m.layer = 'customer'")
_sparql("bgp_link_join", "SELECT ?a ?b WHERE { ?a code:linksTo ?b . ?a code:layer ?l . ?b code:layer ?l }", "SELECT src AS a, dst AS b FROM e JOIN m x ON x.path = src JOIN m y ON y.path = dst WHERE x.layer = y.layer")
_sparql("bgp_link_join_rows", "SELECT ?a ?b WHERE { ?a code:linksTo ?b . ?a code:language ?l . ?b code:language ?l }", "SELECT src AS a, dst AS b FROM e JOIN m x ON x.path = src JOIN m y ON y.path = dst WHERE x.language = y.language")
_sparql("not_exists_rows", 'SELECT ?m WHERE { ?m code:layer "customer" FILTER NOT EXISTS { ?o code:linksTo ?m ; code:language "P" } }', "SELECT path AS m FROM m WHERE layer = 'customer' AND path NOT IN (SELECT dst FROM e JOIN m o ON o.path = src WHERE o.language = 'P')")
_sparql("optional_two_shared", 'SELECT ?m ?d ?t WHERE { ?m code:layer "supplier" OPTIONAL { ?m code:description ?d } OPTIONAL { ?m code:exports ?t } OPTIONAL { ?x code:description ?d ; code:exports ?t ; code:layer "supplier" } }',
        "WITH a AS (SELECT m.path AS m, description AS d, export AS t FROM m LEFT JOIN ex ON ex.path = m.path WHERE m.layer = 'supplier'), b AS (SELECT description AS d, export AS t FROM m JOIN ex ON ex.path = m.path WHERE m.layer = 'supplier' AND description IS NOT NULL) SELECT m, coalesce(a.d, b.d) AS d, coalesce(a.t, b.t) AS t FROM a LEFT JOIN b ON (a.d IS NULL OR a.d = b.d) AND (a.t IS NULL OR a.t = b.t)".replace("WITH a AS", "+a AS", 1))
_sparql("bgp_path2", "SELECT ?a ?c WHERE { ?a code:linksTo/code:linksTo ?c . ?a code:layer ?l FILTER(?l != \"orders\") }", "SELECT a.src AS a, b.dst AS c FROM e a JOIN e b ON a.dst = b.src JOIN m ON m.path = a.src WHERE layer <> 'orders'")
_sparql("bgp_cartesian", 'SELECT ?r ?n WHERE { ?r code:layer "region" . ?n code:layer "nation" }', "SELECT a.path AS r, b.path AS n FROM m a, m b WHERE a.layer = 'region' AND b.layer = 'nation'")
_sparql("bgp_var_predicate", "SELECT ?p ?o WHERE { <nation/3> ?p ?o }", "SELECT predicate AS p, object AS o FROM t WHERE subject = 'nation/3'")
_sparql("bgp_existence", 'SELECT ?r WHERE { ?r code:layer "region" . <nation/0> code:layer "nation" }', "SELECT path AS r FROM m WHERE layer = 'region' AND EXISTS (SELECT 1 FROM t WHERE subject = 'nation/0' AND object = 'nation')")
_sparql("bgp_repeated_var", "SELECT ?m WHERE { ?m code:name ?x . ?m code:exports ?x }", "SELECT m.path AS m FROM m JOIN ex ON ex.path = m.path AND ex.export = m.name")
_sparql("bgp_same_var", "SELECT ?m ?p WHERE { ?m ?p ?m }", "SELECT subject AS m, predicate AS p FROM t WHERE subject = object")
_sparql("optional_outer_filter", 'SELECT ?m ?u WHERE { ?m code:layer "nation" ; code:name ?n OPTIONAL { ?u code:linksTo ?m ; code:layer ?l FILTER(?l = "supplier" && STRSTARTS(?n, "A")) } }',
        "SELECT m.path AS m, u.src AS u FROM m LEFT JOIN (SELECT src, dst FROM e JOIN m x ON x.path = src WHERE x.layer = 'supplier') u ON u.dst = m.path AND starts_with(m.name, 'A') WHERE m.layer = 'nation'")
_sparql("not_exists_outer_filter", 'SELECT ?m WHERE { ?m code:layer "customer" ; code:name ?n FILTER NOT EXISTS { ?o code:linksTo ?m ; code:name ?k FILTER(STRLEN(?k) < STRLEN(?n) - 7) } }',
        "SELECT path AS m FROM m WHERE layer = 'customer' AND NOT EXISTS (SELECT 1 FROM e JOIN m k ON k.path = e.src WHERE e.dst = m.path AND length(k.name) < length(m.name) - 7)")
_sparql("optional_shared", 'SELECT ?m ?d WHERE { ?m code:layer "supplier" OPTIONAL { ?m code:description ?d } OPTIONAL { ?m code:exports ?d } }',
        "SELECT m.path AS m, coalesce(description, export) AS d FROM m LEFT JOIN ex ON ex.path = m.path AND (description IS NULL OR description = export) WHERE m.layer = 'supplier'")
_sparql("bgp_object_list", 'SELECT ?m WHERE { ?m a code:Module ; code:tags "admin", "debt" . }', "SELECT a.path AS m FROM tg a JOIN tg b ON a.path = b.path WHERE a.tag = 'admin' AND b.tag = 'debt'")
_sparql("filter_regex", 'SELECT ?m ?n WHERE { ?m code:name ?n FILTER(REGEX(?n, "^customer#0+1[0-9]$", "i")) }', f"SELECT subject AS m, object AS n FROM t WHERE predicate = {_p('name')} AND regexp_matches(object, '(?i)^customer#0+1[0-9]$')")
_sparql("filter_contains", 'SELECT ?m ?d WHERE { ?m code:description ?d FILTER(CONTAINS(?d, "MACH")) }', f"SELECT subject AS m, object AS d FROM t WHERE predicate = {_p('description')} AND contains(object, 'MACH')")
_sparql("filter_eq", 'SELECT ?m WHERE { ?m code:layer ?l FILTER(?l = "supplier") }', "SELECT path AS m FROM m WHERE layer = 'supplier'")
_sparql("filter_neq", 'SELECT ?m ?l WHERE { ?m code:layer ?l FILTER(?l != "orders") }', "SELECT path AS m, layer AS l FROM m WHERE layer <> 'orders'")
_sparql("filter_and_or", 'SELECT ?m WHERE { ?m code:layer ?l ; code:name ?n FILTER((?l = "nation" || ?l = "region") && !STRENDS(?n, "A") && STRLEN(?n) > 5) }', "SELECT path AS m FROM m WHERE layer IN ('nation', 'region') AND NOT ends_with(name, 'A') AND length(name) > 5")
_sparql("filter_in", 'SELECT ?m WHERE { ?m code:layer ?l FILTER(?l IN ("nation", "region")) FILTER(?m NOT IN ("nation/1")) }', "SELECT path AS m FROM m WHERE layer IN ('nation', 'region') AND path <> 'nation/1'")
_sparql("order_limit_topk", 'SELECT ?n ?l WHERE { ?m a code:Module . ?m code:name ?n . ?m code:layer ?l . FILTER(CONTAINS(?n, "1")) } ORDER BY DESC(?n) LIMIT 25', "SELECT name AS n, layer AS l FROM m WHERE contains(name, '1') ORDER BY name DESC LIMIT 25")
_sparql("offset_page", "SELECT ?m WHERE { ?m a code:Module } ORDER BY ?m LIMIT 20 OFFSET 40", "SELECT path AS m FROM m ORDER BY path LIMIT 20 OFFSET 40")
_sparql("distinct_vars", "SELECT DISTINCT ?l ?g WHERE { ?m code:layer ?l ; code:language ?g }", "SELECT DISTINCT layer AS l, language AS g FROM m")
_sparql("select_star", 'SELECT * WHERE { ?m code:layer "nation" ; code:name ?n }', "SELECT path AS m, name AS n FROM m WHERE layer = 'nation'")
_sparql("optional_left", 'SELECT ?m ?d WHERE { ?m code:layer "supplier" OPTIONAL { ?m code:description ?d } }', "SELECT path AS m, description AS d FROM m WHERE layer = 'supplier'")
_sparql("union_all", 'SELECT ?m WHERE { { ?m code:layer "nation" } UNION { ?m code:tags "internal" } }', "SELECT path AS m FROM m WHERE layer = 'nation' UNION ALL SELECT path FROM tg WHERE tag = 'internal'")
_sparql("minus_anti", "SELECT ?m WHERE { ?m a code:Module MINUS { ?u code:linksTo ?m } }", "SELECT path AS m FROM m WHERE path NOT IN (SELECT dst FROM e)")
_sparql("not_exists", "SELECT ?m WHERE { ?m code:layer \"customer\" FILTER NOT EXISTS { ?u code:linksTo ?m } }", "SELECT path AS m FROM m WHERE layer = 'customer' AND path NOT IN (SELECT dst FROM e)")
_sparql("exists_semi", "SELECT ?m WHERE { ?m code:layer \"customer\" FILTER EXISTS { ?u code:linksTo ?m } }", "SELECT path AS m FROM m WHERE layer = 'customer' AND path IN (SELECT dst FROM e)")
_sparql("bind_values", 'SELECT ?m ?u WHERE { VALUES ?l { "region" "nation" } ?m code:layer ?l ; code:name ?n BIND(CONCAT(LCASE(?n), "-", ?l) AS ?u) }', "SELECT path AS m, lower(name) || '-' || layer AS u FROM m WHERE layer IN ('region', 'nation')")
_sparql("group_having", "SELECT ?b (COUNT(?a) AS ?n) WHERE { ?a code:linksTo ?b } GROUP BY ?b HAVING (COUNT(?a) > 12)", "SELECT dst AS b, count(*) AS n FROM e GROUP BY dst HAVING count(*) > 12")
_sparql("count_distinct", "SELECT ?l (COUNT(DISTINCT ?g) AS ?n) (COUNT(*) AS ?k) (MIN(?m) AS ?first) (MAX(?m) AS ?last) WHERE { ?m code:layer ?l ; code:language ?g } GROUP BY ?l", "SELECT layer AS l, count(DISTINCT language) AS n, count(*) AS k, min(path) AS first, max(path) AS last FROM m GROUP BY layer")
_sparql("group_concat", 'SELECT ?b (GROUP_CONCAT(?a ; SEPARATOR=",") AS ?all) WHERE { ?a code:linksTo ?b . ?b code:layer "region" } GROUP BY ?b', "SELECT dst AS b, string_agg(src, ',' ORDER BY src) AS all FROM e JOIN m ON m.path = dst WHERE layer = 'region' GROUP BY dst".replace("AS all", 'AS "all"'))
_sparql("property_path_plus", "SELECT ?x WHERE { <orders/1> code:linksTo+ ?x }", "+r AS (SELECT dst FROM e WHERE src = 'orders/1' UNION SELECT e.dst FROM e JOIN r ON e.src = r.dst) SELECT dst AS x FROM r")
_sparql("property_path_back", 'SELECT ?x WHERE { <region/1> ^code:linksTo ?x }', "SELECT src AS x FROM e WHERE dst = 'region/1'")
_sparql("property_path_alt", "SELECT ?v WHERE { <nation/2> (code:name|code:layer) ?v }", f"SELECT object AS v FROM t WHERE subject = 'nation/2' AND predicate IN ({_p('name')}, {_p('layer')})")



def _trades(s: SparkSession, d: str) -> DataFrame:
    """Which nation's suppliers sell to which nation's customers, as triples."""
    t = lambda name, *cols: s.read.parquet(f"{d}/{name}.parquet").select(*cols)
    sold = t("lineitem", "l_orderkey", "l_suppkey").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(t("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    nation = lambda c: F.concat(F.lit("nation/"), F.col(c).cast("string"))
    return sold.select(nation("s_nationkey").alias("subject"), F.lit(f"{NS}sellsTo").alias("predicate"), nation("c_nationkey").alias("object")).distinct()


register("bgp_same_var_rows", lambda s, d: sparql(_trades(s, d), "SELECT ?m ?p WHERE { ?m ?p ?m }"), f"SELECT DISTINCT concat('nation/', s_nationkey) AS m, {_p('sellsTo')} AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey = c_nationkey", False)

# --- templates
_T = {
    "find-dependencies": ({"module": "orders/7"}, "SELECT dst AS dependency FROM e WHERE src = 'orders/7'"),
    "find-usages": ({"module": "nation/3"}, "SELECT src AS user FROM e WHERE dst = 'nation/3'".replace("AS user", 'AS "user"')),
    "dependency-tree": ({"module": "customer/5"}, "+r AS (SELECT dst FROM e WHERE src = 'customer/5' UNION SELECT e.dst FROM e JOIN r ON e.src = r.dst) SELECT dst AS dependency FROM r"),
    "security-violations": ({"trusted": "nation"}, 'SELECT src AS "from", dst AS "to", a.layer AS "fromZone", b.layer AS "toZone" FROM e JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE a.layer <> b.layer AND b.layer = \'nation\''),
    "zone-crossings": ({}, 'SELECT src AS "from", dst AS "to", a.layer AS "fromZone", b.layer AS "toZone" FROM e JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE a.layer <> b.layer'),
    "trust-boundaries": ({"tag": "internal"}, "SELECT path AS trusted, src AS importer FROM tg JOIN e ON dst = path WHERE tag = 'internal'"),
    "unused-exports": ({}, "SELECT path AS module, export FROM ex WHERE path NOT IN (SELECT dst FROM e)"),
    "dead-code": ({"entry": "orders"}, "SELECT path AS module, layer FROM m WHERE path NOT IN (SELECT dst FROM e) AND layer <> 'orders'"),
    "complex-modules": ({"threshold": "0"}, "SELECT src AS module, count(*) AS dependencies FROM e GROUP BY src HAVING count(*) > 0"),
    "hot-paths": ({"limit": "10"}, "SELECT dst AS module, count(*) AS users FROM e GROUP BY dst ORDER BY users DESC, module LIMIT 10"),
    "layer-violations": ({"from": "supplier", "to": "nation"}, 'SELECT src AS "from", dst AS "to", a.layer AS "fromLayer", b.layer AS "toLayer" FROM e JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE a.layer = \'supplier\' AND b.layer = \'nation\''),
    "layer-dependencies": ({}, 'SELECT x.layer AS "fromLayer", y.layer AS "toLayer", count(*) AS "count" FROM e JOIN m x ON x.path = src JOIN m y ON y.path = dst WHERE x.layer <> y.layer GROUP BY ALL'),
    "layer-stats": ({}, 'SELECT layer, count(*) AS "moduleCount" FROM m GROUP BY layer'),
    "change-impact": ({"module": "region/2"}, '+r AS (SELECT src FROM e WHERE dst = \'region/2\' UNION SELECT e.src FROM e JOIN r ON e.dst = r.src) SELECT src AS "user" FROM r'),
    "undocumented-modules": ({}, "SELECT path AS module FROM m WHERE description IS NULL"),
    "missing-exports": ({}, "SELECT path AS module FROM m WHERE path NOT IN (SELECT path FROM ex)"),
    "api-surface": ({"layer": "supplier"}, "SELECT path AS module, export FROM ex WHERE layer = 'supplier'"),
}
for _name, (_values, _sql) in _T.items():
    register(f"tpl_{_name.replace('-', '_')}", lambda spark, d, n=_name, v=_values: Templates().run(n, by_predicate(spark, d), _counted(spark, d, Templates().get(n).text), **v), _sql)


def _part_triples(spark: SparkSession, d: str) -> DataFrame:
    return part_edges(spark, d).select(F.col("src").alias("subject"), F.lit(f"{NS}linksTo").alias("predicate"), F.col("dst").alias("object"))


register("tpl_circular_deps", lambda spark, d: Templates().run("circular-deps", _part_triples(spark, d)), "SELECT DISTINCT a.src AS a, a.dst AS b FROM pe a JOIN pe b ON a.dst = b.src AND b.dst = a.src")

# --- store
register("store_find", lambda s, d: store.find(triples(s, d), predicate=f"{NS}layer", object="nation"), f"SELECT * FROM t WHERE predicate = {_p('layer')} AND object = 'nation'")
register("store_delete", lambda s, d: store.delete(triples(s, d), predicate=f"{NS}tags"), f"SELECT * FROM t WHERE predicate <> {_p('tags')}")
register("store_add", lambda s, d: store.add(triples(s, d), triples(s, d)), "SELECT DISTINCT * FROM t")
register("store_stats_s", lambda s, d: store.stats(triples(s, d), "subject"), "SELECT subject, count(*) AS n FROM t GROUP BY subject")
register("store_stats_p", lambda s, d: store.stats(triples(s, d), "predicate"), "SELECT predicate, count(*) AS n FROM t GROUP BY predicate")
register("store_stats_o", lambda s, d: store.stats(triples(s, d), "object"), "SELECT object, count(*) AS n FROM t GROUP BY object")
register("store_subjects", lambda s, d: store.distinct_terms(triples(s, d), "subject"), "SELECT DISTINCT subject FROM t")
register("store_count", lambda s, d: triples(s, d).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM t")
register("node_properties", lambda s, d: store.properties(triples(s, d), "customer/1").select("predicate", F.array_join("objects", "|").alias("objects")), "SELECT predicate, string_agg(object, '|' ORDER BY object) AS objects FROM t WHERE subject = 'customer/1' GROUP BY predicate")

# --- modules
_COLS = ["path", "name", "language", "layer"]
register("module_filter", lambda s, d: ops.where(modules(s, d), language="building", layer="CUSTOMER", tags=["BUILDING"], fold=True).select(_COLS), "SELECT DISTINCT m.path, name, m.language, m.layer FROM m JOIN tg ON tg.path = m.path WHERE lower(m.language) = 'building' AND lower(m.layer) = 'customer' AND lower(tag) = 'building'")
register("search_text", lambda s, d: ops.search(modules(s, d), "mach").select("path"), "SELECT DISTINCT path FROM m WHERE contains(lower(coalesce(description, '')), 'mach') OR contains(lower(name), 'mach') OR contains(lower(path), 'mach') OR path IN (SELECT path FROM tg WHERE contains(lower(tag), 'mach'))")
register("identify", lambda s, d: ops.identify(modules(s, d), "#nation/4").select(_COLS), "SELECT path, name, language, layer FROM m WHERE path = 'nation/4'")
register("export_search", lambda s, d: ops.exports_like(modules(s, d), "00001"), "SELECT export, path FROM ex WHERE contains(export, '00001')")
register("page_modules", lambda s, d: ops.page(modules(s, d), ["path"], 3, 25).select("path"), "SELECT path FROM m ORDER BY path LIMIT 25 OFFSET 50")
register("page_cursor", lambda s, d: ops.cursor_page(modules(s, d), 20, 9), "SELECT path, to_base64(encode('cursor:' || (10 + row_number() OVER (ORDER BY path) - 1))) AS cursor, true AS has_next FROM (SELECT path FROM m ORDER BY path LIMIT 20 OFFSET 10)")


def _third_page(s: SparkSession, d: str) -> DataFrame:
    """The third page by keys, reached forward from the first, then back from the fourth."""
    m, token = modules(s, d).select("layer", "path"), None
    for way in ("next", "next", "next", "previous"):
        page = pages.keyset_page(m, ["layer", "path"], 40, token)
        token = getattr(page, way)
    return pages.keyset_page(m, ["layer", "path"], 40, token).frame(s, m.schema)


register("page_numbered", lambda s, d: pages.numbered_page(modules(s, d).select("path", "name"), ["path"], 7, 30).frame(s, "path string, name string"), "SELECT path, name, (SELECT count(*) FROM m) AS total, true AS has_previous, (SELECT count(*) > 210 FROM m) AS has_next FROM m ORDER BY path LIMIT 30 OFFSET 180")
register("page_keyset", _third_page, "SELECT layer, path, (SELECT count(*) FROM m) AS total, true AS has_previous, (SELECT count(*) > 120 FROM m) AS has_next FROM m ORDER BY layer, path LIMIT 40 OFFSET 80")
register("lang_counts", lambda s, d: ops.counts(modules(s, d), "language"), "SELECT language, count(*) AS n FROM m WHERE language <> '' GROUP BY language")
register("layer_counts", lambda s, d: ops.counts(modules(s, d), "layer"), "SELECT layer, count(*) AS n FROM m WHERE layer <> '' GROUP BY layer")
register("tag_counts", lambda s, d: ops.list_counts(modules(s, d), "tags", "tag"), "SELECT tag, count(*) AS n FROM tg GROUP BY tag")
register("graph_stats", lambda s, d: ops.statistics(modules(s, d), edges(s, d), triples(s, d)).withColumn("mean_dependencies", F.round("mean_dependencies", 9)),
         "SELECT (SELECT count(*) FROM m) AS modules, (SELECT count(*) FROM ex) AS exports, (SELECT language FROM m GROUP BY language ORDER BY count(*) DESC, language LIMIT 1) AS top_language, (SELECT layer FROM m GROUP BY layer ORDER BY count(*) DESC, layer LIMIT 1) AS top_layer, (SELECT count(DISTINCT tag) FROM tg) AS tags, (SELECT count(*) FROM e) AS dependencies, (SELECT count(*) FROM t) AS triples, round((SELECT count(*) FROM e) / (SELECT count(*) FROM m), 9) AS mean_dependencies")
register("dup_name", lambda s, d: ops.duplicates(modules(s, d), "language"), "SELECT path, language FROM m WHERE language IN (SELECT language FROM m GROUP BY language HAVING count(DISTINCT path) > 1)")
register("sample_hash", lambda s, d: ops.sample_hash(modules(s, d), 50, 3).select("path"), "SELECT path FROM m ORDER BY md5('3|' || path), path LIMIT 50")
register("sample_stratified", lambda s, d: ops.sample_stratified(modules(s, d), 200, 5).select("path", "dir"),
         "+q AS (SELECT dir, size, least(greatest(floor(200 * size / (SELECT count(*) FROM m)), 1), size) AS share FROM (SELECT layer AS dir, count(*) AS size FROM m GROUP BY layer)), q2 AS (SELECT *, coalesce(sum(share) OVER (ORDER BY dir ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lead(dir) OVER (ORDER BY dir) IS NULL AS last FROM q), q3 AS (SELECT dir, CASE WHEN last THEN least(greatest(200 - before, 0), size) ELSE least(share, greatest(200 - before, 0)) END AS quota FROM q2), k AS (SELECT path, layer AS dir, row_number() OVER (PARTITION BY layer ORDER BY md5('5|' || path), path) AS nth FROM m) SELECT path, dir FROM k JOIN q3 USING (dir) WHERE nth <= quota")
register("sample_recent", lambda s, d: ops.sample_recent(s.read.parquet(f"{d}/orders.parquet"), 30, "o_orderdate", "o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30", False)
register("sample_dirs", lambda s, d: ops.sample_statistics(modules(s, d), ops.sample_stratified(modules(s, d), 200, 5)), "SELECT layer AS dir, count(*) AS files, coalesce(max(q), 0) AS sampled FROM m JOIN (SELECT layer AS l, greatest(floor(200 * count(*) / (SELECT count(*) FROM m)), 1)::BIGINT AS f, count(*) AS n FROM m GROUP BY layer) ON l = layer JOIN (SELECT layer AS k, CASE WHEN layer = 'supplier' THEN 200 - sum(CASE WHEN layer <> 'supplier' THEN g END) OVER () ELSE g END AS q FROM (SELECT layer, least(greatest(floor(200 * count(*) / (SELECT count(*) FROM m)), 1), count(*))::BIGINT AS g FROM m GROUP BY layer)) ON k = layer GROUP BY layer")
register("focus_counts", lambda s, d: files.focus_statistics(modules(s, d), ["nation/*", "customer/1?"]), "SELECT CASE WHEN path LIKE 'nation/%' THEN 'nation/*' WHEN regexp_matches(path, '^customer/1.$') THEN 'customer/1?' END AS pattern, count(*) AS n FROM m GROUP BY ALL")
register("relationship_count", lambda s, d: ops.relationships(modules(s, d).withColumn("calls", F.col("tags")).join(edges(s, d).groupBy(F.col("src").alias("path")).agg(F.collect_set("dst").alias("dependencies")), "path", "left")), "SELECT (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e))::BIGINT AS dependencies, (SELECT count(*) FROM tg)::BIGINT AS calls, ((SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e)) + (SELECT count(*) FROM tg))::BIGINT AS relationships")
register("default_limit", lambda s, d: sparql(by_predicate(s, d), "SELECT ?m WHERE { ?m a code:Module } ORDER BY ?m", limit=15, offset=30).unionByName(sparql(by_predicate(s, d), "SELECT ?m WHERE { ?m a code:Module } ORDER BY ?m LIMIT 3", limit=15)), "SELECT m FROM (SELECT path AS m FROM m ORDER BY path LIMIT 15 OFFSET 30) UNION ALL SELECT m FROM (SELECT path AS m FROM m ORDER BY path LIMIT 3)")
register("focus_filter", lambda s, d: modules(s, d).where(files.in_focus(F.col("path"), ["nation/*", "customer/1?"])).select("path", files.focus_reason(F.col("path"), ["nation/*", "customer/1?"]).alias("reason")), "SELECT path, CASE WHEN path LIKE 'nation/%' THEN 'nation/*' ELSE 'customer/1?' END AS reason FROM m WHERE path LIKE 'nation/%' OR regexp_matches(path, '^customer/1.$')")
register("ignore_filter", lambda s, d: modules(s, d).where(~files.is_ignored(F.col("path"), ["orders", "customer/", "*/1*"])).select("path"), "SELECT path FROM m WHERE layer NOT IN ('orders', 'customer') AND NOT regexp_matches(path, '^[^/]*/1[^/]*$')")
register("scan_documents", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))).alias("path"), "n_chars").where(~files.is_ignored(F.col("path"), ["src0"])).groupBy(text.extension(F.col("path")).alias("ext"), text.dir_name(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")),
         "SELECT '.' || lang AS ext, source AS dir, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE source <> 'src0' GROUP BY ALL", False)
register("marker_extract", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), text.content_hash(F.col("html")).alias("hash")), "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, sha256(html) AS hash FROM pages", False)
def _blocks(s: SparkSession, d: str) -> DataFrame:
    """Pages with their title in a metadata block; every third block is not closed, every third is the wrong way round."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    a, b = F.lit("<!-- Linked RDF -->\n  "), F.lit("\n<!-- End Linked RDF -->")
    kind = F.col("page_id") % 3
    content = F.when(kind == 0, F.concat(F.lit("x\n"), a, title, b, a, b)).when(kind == 1, F.concat(a, title)).otherwise(F.concat(b, title, a))
    p = s.read.parquet(f"{d}/pages.parquet").select("page_id", content.alias("content"))
    return p.select("page_id", files.block(F.col("content")).alias("block"), files.block_error(F.col("content")).alias("error"))


register("marker_block", _blocks, "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), chr(32) || chr(9) || chr(10) || chr(13)) END AS block, CASE WHEN page_id % 3 = 1 THEN 'the metadata block is not closed' WHEN page_id % 3 = 2 THEN 'the end marker comes before the start' END AS error FROM pages", False)
def _aims():
    return F.element_at(F.array(*map(F.lit, ("../x", "./y", "plain", "../../../z", "a/./b/../c", "./../w//v"))), (F.col("n_nationkey") % 6 + 1).cast("int"))


register("path_resolve_rows", lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", text.resolve_path(F.concat(F.lit("a/"), F.col("n_name")), _aims()).alias("path")), "SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'a/x' WHEN 1 THEN 'a/' || n_name || '/y' WHEN 2 THEN 'plain' WHEN 3 THEN '../z' WHEN 4 THEN 'a/' || n_name || '/a/c' ELSE 'a/w/v' END AS path FROM nation", False)
register("path_resolve", lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", text.resolve_path(F.lit("a/b"), F.concat(F.lit("../x/./"), F.col("n_name"), F.lit("/../y"))).alias("path")), "SELECT n_nationkey, 'a/x/y' AS path FROM nation", False)

# --- graph
_CLOSE = "+r AS (SELECT src AS root, dst AS node, 1 AS depth FROM {e} UNION SELECT r.root, {e}.dst, r.depth + 1 FROM r JOIN {e} ON {e}.src = r.node WHERE r.depth < {n})"
_REACH = "+r AS (SELECT src AS root, dst AS node FROM pe UNION SELECT r.root, pe.dst FROM r JOIN pe ON pe.src = r.node)"


def _one(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


def _hops(pe: DataFrame) -> DataFrame:
    pairs = pe.select("src").distinct().select(F.lit("part/1").alias("src"), F.col("src").alias("dst"))
    return g.shortest_paths(pe, pairs).select("src", "dst", (F.size("path") - 1).cast("long").alias("hops"))


def _ways(pe: DataFrame) -> DataFrame:
    pairs = pe.select("src").distinct().select(F.lit("part/1").alias("src"), F.col("src").alias("dst"))
    return g.shortest_paths(pe, pairs).select("src", "dst", F.array_join("path", ">").alias("way"))


register("closure_deps", lambda s, d: g.transitive_dependencies(edges(s, d), modules(s, d)), _CLOSE.format(e="e", n=9) + " SELECT root, node, min(depth)::BIGINT AS depth FROM r WHERE root <> node GROUP BY ALL")
register("closure_dependents", lambda s, d: g.transitive_dependents(edges(s, d), _one(s, "nation/3", "region/1")), "+r AS (SELECT dst AS root, src AS node, 1 AS depth FROM e WHERE dst IN ('nation/3', 'region/1') UNION SELECT r.root, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node) SELECT root, node, min(depth)::BIGINT AS depth FROM r GROUP BY ALL")
# All pairs of the cyclic graph, four million at the smallest size: a small fixture holds them instead of SQL.
register("closure_cyclic", lambda s, d: g.reachable(part_edges(s, d)))
register("shortest_path_len", lambda s, d: _hops(part_edges(s, d)),
         "+b AS (SELECT 'part/1' AS node, 0 AS hops UNION SELECT pe.dst, b.hops + 1 FROM b JOIN pe ON pe.src = b.node WHERE b.hops < 15) SELECT 'part/1' AS src, node AS dst, min(hops)::BIGINT AS hops FROM b WHERE node IN (SELECT src FROM pe) GROUP BY node")
register("shortest_path_nodes", lambda s, d: _ways(part_edges(s, d)),
         "+b AS (SELECT 'part/1' AS node, 0 AS hops UNION SELECT pe.dst, b.hops + 1 FROM b JOIN pe ON pe.src = b.node WHERE b.hops < 15), h AS (SELECT node, min(hops) AS hops FROM b GROUP BY node), up AS (SELECT y.node, min(x.node) AS parent FROM h x JOIN pe ON pe.src = x.node JOIN h y ON y.node = pe.dst AND y.hops = x.hops + 1 GROUP BY y.node), w AS (SELECT node AS dst, node AS at_, node AS way, hops FROM h WHERE node IN (SELECT src FROM pe) UNION ALL SELECT dst, parent, parent || '>' || way, hops - 1 FROM w JOIN up ON up.node = at_ WHERE hops > 0) SELECT 'part/1' AS src, dst, way FROM w WHERE hops = 0")
register("scc_label", lambda s, d: g.components(part_edges(s, d)), _REACH + ", n AS (SELECT src AS node FROM pe UNION SELECT dst FROM pe), mutual AS (SELECT a.root AS node, a.node AS other FROM r a JOIN r b ON a.root = b.node AND a.node = b.root) SELECT n.node, least(n.node, coalesce(min(other), n.node)) AS component FROM n LEFT JOIN mutual ON mutual.node = n.node GROUP BY n.node")
register("cyclic_nodes", lambda s, d: g.cyclic_nodes(part_edges(s, d)).select("node"), _REACH + " SELECT DISTINCT root AS node FROM r WHERE root = node")
register("topo_level", lambda s, d: g.levels(edges(s, d), modules(s, d)), _CLOSE.format(e="e", n=9) + " SELECT path AS node, coalesce(max(depth), 0)::BIGINT AS level FROM m LEFT JOIN r ON r.root = path GROUP BY path")
register("topo_order", lambda s, d: g.topological_order(edges(s, d), modules(s, d)).select("node", "position"),
         "+p0 AS (SELECT path AS node, row_number() OVER (ORDER BY path) - 1 AS position FROM m WHERE layer = 'region')" + "".join(
             f", p{k} AS (SELECT path AS node, (SELECT max(position) FROM p{k - 1}) + row_number() OVER (ORDER BY p{k - 1}.position, path) AS position FROM m JOIN e ON e.src = path JOIN p{k - 1} ON p{k - 1}.node = e.dst WHERE layer IN ({layers}))"
             for k, layers in ((1, "'nation'"), (2, "'supplier', 'customer'"), (3, "'orders'"))) + " SELECT node, position::BIGINT AS position FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)")
register("degrees", lambda s, d: g.degrees(edges(s, d), modules(s, d)), "SELECT path, (SELECT count(DISTINCT dst) FROM e WHERE src = path) AS out_degree, (SELECT count(DISTINCT src) FROM e WHERE dst = path) AS in_degree FROM m")
_COVERAGE = "+se AS (SELECT * FROM e), sm AS (SELECT * FROM m), r AS (SELECT dst AS root, src AS node FROM se UNION SELECT r.root, se.src FROM r JOIN se ON se.dst = r.node), c AS (SELECT path, (SELECT count(*) FROM se WHERE dst = path) AS i, (SELECT count(*) FROM se WHERE src = path) AS o, (SELECT count(*) FROM r WHERE root = path) AS u, (path IN (SELECT path FROM ex)) AS has, (path IN (SELECT path FROM ex WHERE export IN ('main', 'init'))) AS entry, (SELECT count(*) FROM sm) AS n FROM sm), k AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE least(i / n * 0.5 + u / n * 0.3 + CASE WHEN has THEN 0.2 ELSE 0 END, 1) END AS raw FROM c)"


register("coverage_score", lambda s, d: coverage.coverage(edges(s, d), modules(s, d)), _COVERAGE + " SELECT path, i AS in_degree, o AS out_degree, u AS users, round(raw, 9)::DOUBLE AS score, entry AS is_entry, i = 0 AND NOT entry AS is_dead, CASE WHEN raw >= 0.7 THEN 'high' WHEN raw < 0.3 AND NOT entry THEN 'low' ELSE 'middle' END AS band FROM k")
register("coverage_decile", lambda s, d: coverage.decile(coverage.coverage(edges(s, d), modules(s, d))).select("path"), _COVERAGE + " SELECT path FROM k ORDER BY round(raw, 9) DESC, path LIMIT (SELECT greatest(1, count(*) // 10) FROM k)")



def _sketch_error(s: SparkSession, d: str) -> DataFrame:
    """Whether the estimate lies within five standard errors, and one, of the true count."""
    both = reach.count_users(edges(s, d)).join(reach.sketch_users(edges(s, d)).withColumnRenamed("users", "guess"), "node")
    return both.select("node", "users", (F.abs(F.col("guess") - F.col("users")) <= F.ceil(F.col("users") * 0.08) + 1).alias("close"))


register("coverage_sketch", _sketch_error, "+r AS (SELECT dst AS root, src AS node FROM e UNION SELECT r.root, e.src FROM r JOIN e ON e.dst = r.node), c AS (SELECT root, count(*) AS n FROM r GROUP BY root) SELECT node, coalesce(n, 0)::BIGINT AS users, true AS close FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN c ON root = node")
register("users_cyclic", lambda s, d: reach.count_users(part_edges(s, d)), _REACH + ", n AS (SELECT src AS node FROM pe UNION SELECT dst FROM pe) SELECT n.node, count(DISTINCT CASE WHEN r.root <> r.node THEN r.root END)::BIGINT AS users FROM n LEFT JOIN r ON r.node = n.node GROUP BY n.node")

# --- analyses
_TARGETS = "('nation/3', 'region/1', 'customer/7', 'orders/7')"
_FAR = "+r AS (SELECT dst AS target, src AS path, 1 AS depth FROM e WHERE dst IN " + _TARGETS + " UNION SELECT r.target, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.path), far AS (SELECT target, path, min(depth) AS depth FROM r GROUP BY ALL)"
_IMPACT = _FAR + ", i AS (SELECT m.path AS target, (SELECT count(DISTINCT src) FROM e WHERE dst = m.path) AS direct, (SELECT count(DISTINCT dst) FROM e WHERE src = m.path) AS dependencies, (SELECT count(*) FROM far WHERE target = m.path) AS impacted, (SELECT count(DISTINCT layer) FROM far JOIN m x ON x.path = far.path WHERE target = m.path) AS layers, (SELECT coalesce(max(depth), 0) FROM far WHERE target = m.path)::BIGINT AS max_depth, round((SELECT count(*) FROM far WHERE target = m.path) / (SELECT count(*) FROM m) * 100, 6) AS percentage FROM m WHERE path IN " + _TARGETS + "), p AS (SELECT *, (CASE WHEN direct > 10 THEN 3 WHEN direct > 5 THEN 2 WHEN direct > 0 THEN 1 ELSE 0 END + CASE WHEN impacted > 20 THEN 3 WHEN impacted > 10 THEN 2 WHEN impacted > 0 THEN 1 ELSE 0 END + CASE WHEN percentage > 30 THEN 2 WHEN percentage > 15 THEN 1 ELSE 0 END + CASE WHEN layers > 3 THEN 2 WHEN layers > 1 THEN 1 ELSE 0 END + CASE WHEN max_depth > 4 THEN 1 ELSE 0 END)::BIGINT AS points FROM i)"


def _targets(s: SparkSession) -> DataFrame:
    return _one(s, "nation/3", "region/1", "customer/7", "orders/7")


register("impact_summary", lambda s, d: impact.impact(edges(s, d), modules(s, d), _targets(s)), _IMPACT + " SELECT *, CASE WHEN points >= 8 THEN 'CRITICAL' WHEN points >= 5 THEN 'HIGH' WHEN points >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, points >= 5 AS breaking FROM p")
register("impact_by_layer", lambda s, d: impact.impact_by_layer(edges(s, d), modules(s, d), _targets(s)), _FAR + " SELECT target, layer, count(*) AS n FROM far JOIN m ON m.path = far.path GROUP BY ALL")
register("impact_combined", lambda s, d: impact.combined(edges(s, d), _targets(s)), _FAR + " SELECT path, min(depth)::BIGINT AS depth FROM far GROUP BY path")
register("critical_modules", lambda s, d: impact.critical_paths(edges(s, d), "region/1").select("src", "dst", F.array_join("path", ">").alias("path")), "+r AS (SELECT src AS path, 'region/1' AS way FROM e WHERE dst = 'region/1' UNION SELECT e.src, r.path || '>' || r.way FROM r JOIN e ON e.dst = r.path), busy AS (SELECT dst FROM e GROUP BY dst HAVING count(DISTINCT src) >= 3) SELECT path AS src, 'region/1' AS dst, path || '>' || way AS path FROM r WHERE path IN (SELECT dst FROM busy) ORDER BY src LIMIT 5")

def _advice(s: SparkSession, d: str) -> DataFrame:
    e, t = edges(s, d), _targets(s)
    return impact.recommendations(impact.impact(e, modules(s, d), t), impact.critical_counts(e, t)).select("target", F.col("nth").cast("long").alias("nth"), "advice")


def _texts(known: dict[str, list[str]]) -> str:
    return ", ".join(f"('{k}', {n}, '{x.replace(chr(39), chr(39) * 2)}')" for k, v in known.items() for n, x in enumerate(v))


_LEVEL = "CASE WHEN points >= 8 THEN 'CRITICAL' WHEN points >= 5 THEN 'HIGH' WHEN points >= 3 THEN 'MEDIUM' ELSE 'LOW' END"
_POINTS = "(CASE WHEN direct > 10 THEN 3 WHEN direct > 5 THEN 2 WHEN direct > 0 THEN 1 ELSE 0 END + CASE WHEN impacted > 20 THEN 3 WHEN impacted > 10 THEN 2 WHEN impacted > 0 THEN 1 ELSE 0 END + CASE WHEN percentage > 30 THEN 2 WHEN percentage > 15 THEN 1 ELSE 0 END + CASE WHEN layers > 3 THEN 2 WHEN layers > 1 THEN 1 ELSE 0 END + CASE WHEN max_depth > 4 THEN 1 ELSE 0 END)::BIGINT"
register("impact_advice", _advice, _IMPACT + f", v AS (SELECT * FROM (VALUES {_texts(impact.ADVICE)}) x(risk, nth, advice)), k AS (SELECT *, {_LEVEL} AS risk FROM p), busy AS (SELECT dst FROM e GROUP BY dst HAVING count(DISTINCT src) >= 3), c AS (SELECT target, least(count(*), 5) AS n FROM far WHERE path IN (SELECT dst FROM busy) GROUP BY target), size AS (SELECT risk, count(*) AS n FROM v GROUP BY risk)"
         " SELECT target, nth::BIGINT AS nth, advice FROM k JOIN v USING (risk) UNION ALL SELECT target, size.n, 'Test across layers' FROM k JOIN size USING (risk) WHERE layers > 2 UNION ALL SELECT target, size.n + CASE WHEN layers > 2 THEN 1 ELSE 0 END, 'Walk through ' || c.n || ' critical paths' FROM k JOIN size USING (risk) JOIN c USING (target)")
register("impact_together", lambda s, d: impact.combined_impact(edges(s, d), modules(s, d), _targets(s)), _FAR + f", one AS (SELECT path, min(depth) AS depth FROM far GROUP BY path), i AS (SELECT 4::BIGINT AS targets, (SELECT count(DISTINCT src) FROM e WHERE dst IN {_TARGETS}) AS direct, (SELECT count(DISTINCT dst) FROM e WHERE src IN {_TARGETS}) AS dependencies, (SELECT count(*) FROM one) AS impacted, (SELECT count(DISTINCT layer) FROM one JOIN m ON m.path = one.path) AS layers, (SELECT max(depth) FROM one)::BIGINT AS max_depth, round((SELECT count(*) FROM one) / (SELECT count(*) FROM m) * 100, 6) AS percentage), p AS (SELECT *, {_POINTS} AS points FROM i) SELECT *, {_LEVEL} AS risk, points >= 5 AS breaking FROM p")
register("impact_ranking", lambda s, d: impact.ranking(impact.impact(edges(s, d), modules(s, d), modules(s, d).where("layer IN ('region', 'nation')"))).select("target", "impacted", "rank"), "+r AS (SELECT dst AS target, src AS path FROM e WHERE dst IN (SELECT path FROM m WHERE layer IN ('region', 'nation')) UNION SELECT r.target, e.src FROM r JOIN e ON e.dst = r.path), k AS (SELECT m.path AS target, count(r.path) AS impacted FROM m LEFT JOIN r ON r.target = m.path WHERE layer IN ('region', 'nation') GROUP BY m.path) SELECT target, impacted, row_number() OVER (ORDER BY impacted DESC, target) AS rank FROM k")
_DEAD = "+u AS (SELECT m.*, path IN (SELECT path FROM ex) AS has FROM m WHERE path NOT IN (SELECT dst FROM e) AND path NOT IN (SELECT path FROM ex WHERE export IN ('main', 'init'))), h AS (SELECT path, least(greatest(80 + CASE WHEN NOT has THEN 5 ELSE 0 END - CASE WHEN has THEN 30 ELSE 0 END, 0), 100) AS x FROM u)"
register("dead_confidence", lambda s, d: deadcode.dead_modules(edges(s, d), modules(s, d)), _DEAD + " SELECT path, x / 100 AS confidence, x >= 80 AS safe, CASE WHEN x >= 80 THEN 'remove' ELSE 'review' END AS action, CASE WHEN x >= 80 THEN 'low' WHEN x >= 60 THEN 'medium' ELSE 'high' END AS risk, 50::BIGINT AS lines FROM h WHERE x >= 50")
register("dead_summary", lambda s, d: deadcode.summary(deadcode.dead_modules(edges(s, d), modules(s, d))), _DEAD + " SELECT count(*) AS n, round(avg(x / 100), 6) AS mean_confidence, coalesce(sum(CASE WHEN x >= 80 THEN 50 END), 0)::BIGINT AS deletable_lines FROM h WHERE x >= 50")
_ZONE = "+zt AS (SELECT path, CASE WHEN tag LIKE '%public%' THEN 'public' WHEN tag LIKE '%admin%' THEN 'admin' WHEN tag LIKE '%internal%' THEN 'internal' END AS z FROM tg), z AS (SELECT m.path, coalesce((SELECT min(z) FROM zt WHERE zt.path = m.path AND z IS NOT NULL), 'unknown') AS zone FROM m), c AS (SELECT src, dst, a.zone AS src_zone, b.zone AS dst_zone FROM e JOIN z a ON a.path = src JOIN z b ON b.path = dst WHERE a.zone <> b.zone)"
_RISK = "CASE WHEN src_zone = 'internal' AND dst_zone = 'public' THEN 'MEDIUM' ELSE 'LOW' END"
_MAY = "(src_zone || '>' || dst_zone) IN ('internal>public', 'admin>internal', 'public>internal')"


def _zoned(s: SparkSession, d: str) -> DataFrame:
    return security.crossings(edges(s, d), security.classify(modules(s, d)))


register("zone_classify", lambda s, d: security.classify(modules(s, d)).select("path", "zone"), _ZONE + " SELECT path, zone FROM z")
register("zone_crossings", _zoned, _ZONE + f" SELECT src, dst, src_zone, dst_zone, {_RISK} AS risk, {_MAY} AS allowed FROM c")
register("zone_boundaries", lambda s, d: security.boundaries(_zoned(s, d)), _ZONE + " SELECT src_zone, dst_zone, count(*) AS n FROM c GROUP BY ALL")
register("zone_violations", lambda s, d: security.violations(_zoned(s, d), strict=True), _ZONE + f" SELECT src, dst, src_zone, dst_zone, {_RISK} AS risk, 'unauthorized' AS kind FROM c WHERE NOT {_MAY}")
register("zone_risk", lambda s, d: security.risk_score(security.violations(_zoned(s, d))), _ZONE + f" SELECT count(*) AS violations, 0::BIGINT AS critical, 0::BIGINT AS high, round(least(coalesce(avg(CASE {_RISK} WHEN 'MEDIUM' THEN 4 ELSE 2 END), 0), 10), 6) AS score FROM c WHERE NOT {_MAY}")
register("zone_advice", lambda s, d: security.recommendations(security.violations(_zoned(s, d))).select(F.col("nth").cast("long").alias("nth"), "advice"), "SELECT nth::BIGINT AS nth, advice FROM (VALUES (0, 'Check who calls at every boundary'), (1, 'Check what comes in at every boundary'), (2, 'Log what crosses a boundary')) v(nth, advice)")


def _faulty(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph with a fault for each check."""
    at = lambda *paths: F.col("path").isin(*paths)
    m = modules(s, d).withColumn("name", F.when(at("nation/3"), "").otherwise(F.col("name"))).withColumn("language", F.when(at("nation/2"), None).otherwise(F.col("language")))
    m = m.withColumn("uri", F.when(at("nation/1"), None).when(at("supplier/1", "supplier/2"), "<#same>").when(F.col("layer") == "orders", F.concat(F.lit("<"), "uri", F.lit(">"))).otherwise(F.col("uri")))
    m = m.withColumn("tags", F.when(at("nation/4"), F.array().cast("array<string>")).otherwise(F.col("tags")))
    more = [("nation/5", "missing/x"), ("nation/5", "gion/nowhere"), ("nation/6", "ASIA"), ("nation/7", "#region/1"), ("nation/8", "ion/2"), ("region/0", "nation/0"), *[("nation/9", f"customer/{k}") for k in range(1, 12)]]
    return m, edges(s, d).unionByName(s.createDataFrame(more, "src string, dst string"))


register("validate_all", lambda s, d: checks.validate(*_faulty(s, d), brackets=True),
         "SELECT 'warning' AS severity, 'missing-description' AS \"check\", path, 'the description is missing' AS message FROM m WHERE coalesce(description, '') = '' UNION ALL SELECT 'warning', 'no-exports', path, 'there are no exports' FROM m WHERE path NOT IN (SELECT path FROM ex) UNION ALL SELECT 'warning', 'bare-uri', path, 'the URI stands without angle brackets' FROM m WHERE layer <> 'orders' AND path NOT IN ('nation/1', 'supplier/1', 'supplier/2')"
         " UNION ALL SELECT * FROM (VALUES ('error', 'missing-name', 'nation/3', 'the name is missing'), ('error', 'missing-uri', 'nation/1', 'the URI is missing'), ('warning', 'missing-language', 'nation/2', 'the language is missing'), ('warning', 'no-tags', 'nation/4', 'there are no tags'), ('warning', 'unknown-dependency', 'nation/5', 'no module fits missing/x'), ('warning', 'unknown-dependency', 'nation/5', 'no module fits gion/nowhere'), ('warning', 'many-dependencies', 'nation/9', '12 dependencies'), ('error', 'duplicate-uri', 'supplier/1', 'several modules have the URI <#same>'), ('error', 'duplicate-uri', 'supplier/2', 'several modules have the URI <#same>'), ('error', 'cycle', 'region/0', 'in the cycle of nation/0'), ('error', 'cycle', 'nation/0', 'in the cycle of nation/0')) v")
register("validate_graph", lambda s, d: checks.validate(modules(s, d), edges(s, d)).select("severity", "check", "path"), "SELECT 'warning' AS severity, 'missing-description' AS \"check\", path FROM m WHERE coalesce(description, '') = '' UNION ALL SELECT 'warning', 'no-exports', path FROM m WHERE path NOT IN (SELECT path FROM ex)")


def _checked(s: SparkSession, d: str, rules: list[checks.Rule], **how) -> checks.Report:
    return checks.check_rules(triples(s, d), rules, counts=counts(s, d), **how)


_RULES = "SELECT * FROM (VALUES ('no-circular-dependencies', 'error', 0), ('exports-documented', 'warning', (SELECT count(*) FROM m JOIN ex ON ex.path = m.path WHERE description IS NULL)), ('modules-have-layer', 'warning', 0), ('modules-have-tags', 'info', 0)) v(rule, severity, found)"
register("rule_summary", lambda s, d: _checked(s, d, checks.BUILT_IN).summary.select("rule", "severity", F.col("found").cast("long").alias("found"), "passed"), "+v AS (" + _RULES + ") SELECT rule, severity, found::BIGINT AS found, found = 0 AS passed FROM v")
register("rule_violations", lambda s, d: _checked(s, d, checks.BUILT_IN).violations.select("rule", "severity", "module"), "SELECT 'exports-documented' AS rule, 'warning' AS severity, m.path AS module FROM m JOIN ex ON ex.path = m.path WHERE description IS NULL")

_MORE_RULES = [
    checks.Rule(f"star-{k}", "star", f'SELECT ?m WHERE {{ ?m code:layer "{layer}" ; code:tags ?t FILTER NOT EXISTS {{ ?m code:exports ?e }} }}', "info") for k, layer in enumerate(("region", "nation", "supplier", "customer", "orders"))
] + [checks.Rule("linked-twice", "path", "SELECT DISTINCT ?module ?far WHERE { ?module code:linksTo ?mid . ?mid code:linksTo ?far . ?far code:layer \"region\" }", "info")]
register("rules_in_one_pass", lambda s, d: _checked(s, d, [*checks.BUILT_IN, *_MORE_RULES]).summary.select("rule", F.col("found").cast("long").alias("found")),
         "+v AS (" + _RULES + ") SELECT rule, found::BIGINT AS found FROM v UNION ALL SELECT 'star-' || k, (SELECT count(*) FROM m JOIN tg ON tg.path = m.path WHERE m.layer = l AND m.path NOT IN (SELECT path FROM ex)) FROM (VALUES (0, 'region'), (1, 'nation'), (2, 'supplier'), (3, 'customer'), (4, 'orders')) x(k, l) UNION ALL SELECT 'linked-twice', (SELECT count(DISTINCT a.src || '>' || b.dst) FROM e a JOIN e b ON a.dst = b.src JOIN m ON m.path = b.dst WHERE layer = 'region')")
register("rule_severities", lambda s, d: checks.by_severity(_checked(s, d, checks.BUILT_IN)), "+v AS (" + _RULES + ") SELECT severity, count(*) AS rules, count_if(found > 0) AS failed, sum(found)::BIGINT AS found FROM v GROUP BY severity")
register("rule_located", lambda s, d: checks.located(_checked(s, d, checks.BUILT_IN).violations.select("rule", F.concat(F.lit("#"), "module").alias("module")), modules(s, d)), "SELECT 'exports-documented' AS rule, '#' || m.path AS module, m.path AS path FROM m JOIN ex ON ex.path = m.path WHERE description IS NULL")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Orders before a date against all orders, some customers moved."""
    m, e = modules(s, d), edges(s, d)
    old = s.read.parquet(f"{d}/orders.parquet").where("o_orderdate < '1998-04-25'").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"))
    was = m.where("layer <> 'orders'").unionByName(m.join(old, "path", "left_semi"))
    moved = e.where("NOT (src LIKE 'customer/%' AND src LIKE '%7')")
    return checks.diff(was, m.where("path <> 'supplier/1'"), e, moved)


_DIFF = "+f AS (SELECT m.path, CASE WHEN m.path = 'supplier/1' THEN 'removed' WHEN m.layer = 'orders' AND o.o_orderdate >= TIMESTAMP '1998-04-25' THEN 'added' WHEN m.layer = 'customer' AND m.path LIKE '%7' THEN 'modified' ELSE 'unchanged' END AS status FROM m LEFT JOIN orders o ON m.path = concat('orders/', CAST(o_orderkey AS STRING)))"
register("diff_status", lambda s, d: _snapshots(s, d).select("path", "status"), _DIFF + " SELECT * FROM f")
register("diff_stats", lambda s, d: checks.diff_stats(_snapshots(s, d)), _DIFF + " SELECT status, count(*) AS n FROM f GROUP BY status")
register("diff_deps_removed", lambda s, d: _snapshots(s, d).where("status = 'modified'").select("path", F.explode("removed_deps").alias("dst")), "SELECT src AS path, dst FROM e WHERE src LIKE 'customer/%' AND src LIKE '%7'")


# --- metadata entries: customers as automatic entries, labels as the manual side
def _entries(s: SparkSession, d: str, manual: bool) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    none = F.array().cast("array<string>")
    if manual:
        docs = docs.join(s.read.parquet(f"{d}/labels.parquet"), "doc_id")
    made = "manual" if manual else "auto"
    tags = F.array(F.concat(F.lit("q"), F.col("quality").cast("string"))) if manual else F.array("lang")
    row = F.array(F.struct(F.col("doc_id").cast("string").alias("subject"), F.lit("size").alias("predicate"), F.col("n_chars").cast("string").alias("object"), F.lit(made).alias("source")))
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), F.concat(F.lit("#"), path).alias("uri"), F.lit(None if manual else "doc").alias("name"), F.col("lang").alias("language"), F.lit("" if manual else "text").alias("layer"), tags.alias("tags"), none.alias("concepts"), none.alias("exports"), F.lit(made).alias("source"), row.alias("triples"), F.expr("map()").cast("map<string,string>").alias("annotations"), F.expr("map()").cast("map<string,string>").alias("properties"), F.md5(F.col("n_chars").cast("string")).alias("hash"), F.lit(None).cast("timestamp").alias("updated_at"))


_SHADOW = "WITH x AS (SELECT concat(source, '/', doc_id::VARCHAR) AS path, lang, source AS dir, quality FROM documents LEFT JOIN labels USING (doc_id))"
register("shadow_merge", lambda s, d: shadow.merge(_entries(s, d, True), _entries(s, d, False)).select("path", "name", "layer", "source", F.array_join(F.array_sort("tags"), ",").alias("tags"), F.size("triples").cast("long").alias("triples")),
         _SHADOW + " SELECT path, 'doc' AS name, 'text' AS layer, CASE WHEN quality IS NULL THEN 'auto' ELSE 'mixed' END AS source, CASE WHEN quality IS NULL THEN lang ELSE lang || ',q' || quality END AS tags, 1::BIGINT AS triples FROM x", False)
register("shadow_search", lambda s, d: shadow.search(_entries(s, d, True), language="en", tags=["q1"], text="SRC1", manual=True, offset=5, limit=20).select("path"), _SHADOW + " SELECT path FROM x WHERE lang = 'en' AND quality = 1 AND contains(lower(path), 'src1') ORDER BY path LIMIT 20 OFFSET 5", False)
register("shadow_stats", lambda s, d: shadow.statistics(_entries(s, d, True)), _SHADOW + ", y AS (SELECT * FROM x WHERE quality IS NOT NULL) SELECT 'all' AS kind, '' AS key, count(*) AS n FROM y UNION ALL SELECT 'source', 'manual', count(*) FROM y UNION ALL SELECT 'tag', 'q' || quality, count(*) FROM y GROUP BY quality UNION ALL SELECT 'language', lang, count(*) FROM y GROUP BY lang", False)
register("shadow_status", lambda s, d: shadow.build_status(_entries(s, d, True), _entries(s, d, False)), _SHADOW + " SELECT path, CASE WHEN quality IS NULL THEN 'new' ELSE 'skipped' END AS status FROM x", False)


def _synced(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Automatic entries merged with the manual ones, against documents of which two are edited, one is new and one is gone."""
    held = shadow.merge(_entries(s, d, True), _entries(s, d, False).where("path NOT LIKE '%/7'"))
    now = _entries(s, d, False).where("path NOT LIKE '%/9'").withColumn("hash", F.when(F.col("path").rlike("/(1|2)$"), "edited").otherwise(F.col("hash")))
    return shadow.sync(held, now, now.withColumn("name", F.lit("fresh")))


def _related(s: SparkSession, d: str) -> DataFrame:
    link = lambda df, target, source, time: df.withColumn("relations", F.array(F.struct(F.lit("linksTo").alias("type"), F.lit(target).alias("target"), F.lit("out").alias("direction"), F.lit(source).alias("source")))).withColumn("updated_at", F.lit(time).cast("timestamp"))
    a, b = _entries(s, d, True), _entries(s, d, False)
    out = shadow.merge(link(a, "x", "manual", 2), link(b, "x", "auto", 1).unionByName(link(b.where("path LIKE 'src2/%'"), "y", "auto", 3)).groupBy("path").agg(*[F.max_by(c, "updated_at").alias(c) for c in (*[x for x in b.columns if x not in ("path", "updated_at")], "relations")], F.max("updated_at").alias("updated_at")), by_time=True)
    return out.select("path", "name", F.transform("relations", lambda x: F.concat_ws("/", x["target"], x["source"])).alias("relations")).select("path", "name", F.array_join(F.array_sort("relations"), ",").alias("relations"))


_NUMBER = "regexp_extract(path, '[0-9]+$')::BIGINT"
register("shadow_sync", lambda s, d: _synced(s, d)[1], _SHADOW + f", y AS (SELECT path, quality, {_NUMBER} AS k FROM x) SELECT path, CASE WHEN k = 9 THEN 'orphan' WHEN k = 7 AND quality IS NULL THEN 'new' WHEN k IN (1, 2) AND quality IS NOT NULL THEN 'merged' WHEN k IN (1, 2) THEN 'updated' ELSE 'skipped' END AS status FROM y", False)
register("shadow_synced", lambda s, d: _synced(s, d)[0].select("path", "name", "source"), _SHADOW + f", y AS (SELECT path, quality, {_NUMBER} AS k FROM x) SELECT path, CASE WHEN k IN (1, 2) OR (k = 7 AND quality IS NULL) THEN 'fresh' WHEN k = 7 THEN NULL ELSE 'doc' END AS name, CASE WHEN quality IS NULL THEN 'auto' WHEN k = 7 THEN 'manual' ELSE 'mixed' END AS source FROM y WHERE k <> 9", False)
register("shadow_relations", _related, _SHADOW + " SELECT path, 'doc' AS name, CASE WHEN quality IS NULL THEN CASE WHEN dir = 'src2' THEN 'y/auto' ELSE 'x/auto' END WHEN dir = 'src2' THEN 'x/manual,y/auto' ELSE 'x/manual' END AS relations FROM x", False)
register("shadow_totals", lambda s, d: shadow.totals(shadow.merge(_entries(s, d, True), _entries(s, d, False))), _SHADOW + " SELECT count(*) AS entries, count(quality) AS manual, count(*) - count(quality) AS automatic, count(*)::BIGINT AS triples FROM x", False)
register("shadow_orphans", lambda s, d: shadow.orphans(_entries(s, d, False), _entries(s, d, True)).select("path"), _SHADOW + " SELECT path FROM x WHERE quality IS NULL", False)


# --- kept in versions: parsed documents, and the index of entries
def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _doc_files(s: SparkSession, d: str, edited: bool) -> DataFrame:
    """Documents as files; an edit appends to two, touches a third and drops a fourth."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    if edited:
        docs = docs.where("doc_id <> 5").withColumn("text", F.when(F.col("doc_id") < 2, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    stamp = F.when((F.col("doc_id") == 3) & F.lit(edited), 2).otherwise(1).cast("timestamp")
    return docs.select("path", F.sha2("text", 256).alias("hash"), stamp.alias("mtime"), "text")


def _parsed(build: int):
    return lambda files: files.select("path", "hash", "mtime", F.length("text").cast("long").alias("size"), F.lit(build).alias("build"))


def _rebuilt(s: SparkSession, d: str) -> ModuleCache:
    cache = ModuleCache(s, _folder(s, "modules"))
    cache.refresh(_doc_files(s, d, False), _parsed(1))
    cache.refresh(_doc_files(s, d, True), _parsed(2))
    return cache


def _cache_diff(s: SparkSession, d: str) -> DataFrame:
    cache = _rebuilt(s, d)
    was, now = (cache.as_of(v).select("path", F.col("hash").alias(h)) for v, h in ((1, "old"), (2, "new")))
    status = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return was.join(now, "path", "full_outer").select("path", status.alias("status"))


_FILES = "WITH x AS (SELECT doc_id, concat(source, '/', doc_id::VARCHAR) AS path, text FROM documents)"
register("cache_rebuild", lambda s, d: _rebuilt(s, d).as_of().select("path", "hash", "size", "build"), _FILES + " SELECT path, sha256(CASE WHEN doc_id < 2 THEN text || ' edited' ELSE text END) AS hash, (length(text) + CASE WHEN doc_id < 2 THEN 7 ELSE 0 END)::BIGINT AS size, CASE WHEN doc_id < 2 OR doc_id = 3 THEN 2 ELSE 1 END AS build FROM x WHERE doc_id <> 5", False)
register("cache_diff", _cache_diff, _FILES + " SELECT path, CASE WHEN doc_id < 2 THEN 'modified' WHEN doc_id = 5 THEN 'removed' ELSE 'unchanged' END AS status FROM x", False)


def _updated_index(s: SparkSession, d: str) -> PostingIndex:
    """All documents as entries, the labelled ones replaced by manual entries, those of src1 removed."""
    found = PostingIndex(s, _folder(s, "postings"))
    found.add(_entries(s, d, False))
    found.add(_entries(s, d, True))
    found.remove(_entries(s, d, False).where("path LIKE 'src1/%'"))
    return found


_LEFT = _SHADOW + ", y AS (SELECT * FROM x WHERE dir <> 'src1')"
register("shadow_index_deltas", lambda s, d: _updated_index(s, d).postings(), _LEFT + " SELECT 'tag' AS kind, CASE WHEN quality IS NULL THEN lang ELSE 'q' || quality END AS key, path FROM y UNION ALL SELECT 'language', lang, path FROM y UNION ALL SELECT 'layer', 'text', path FROM y WHERE quality IS NULL", False)
register("shadow_index_lookup", lambda s, d: _updated_index(s, d).lookup("tag", "q1"), _LEFT + " SELECT path FROM y WHERE quality = 1", False)

# --- sinks as line frames, and streams in batch form
register("result_csv", lambda s, d: results.csv_lines(modules(s, d).where("layer = 'nation'").select("path", "name")), "SELECT path || ',' || name AS value FROM m WHERE layer = 'nation'")
register("result_xml", lambda s, d: results.xml_results(modules(s, d).where("layer = 'region'").select("path", "name")), "SELECT '<result><binding name=\"path\"><literal>' || path || '</literal></binding><binding name=\"name\"><literal>' || name || '</literal></binding></result>' AS value FROM m WHERE layer = 'region'")
register("result_json", lambda s, d: results.json_bindings(modules(s, d).where("layer = 'region'").select("path")), "SELECT '{\"path\":{\"type\":\"literal\",\"value\":\"' || path || '\"}}' AS value FROM m WHERE layer = 'region'")
register("diagram_dot", lambda s, d: diagrams.dot(modules(s, d).where("layer IN ('region', 'nation')"), edges(s, d)),
         "SELECT * FROM (VALUES ('digraph \"dependencies\" {'), ('  rankdir=LR;'), ('  node [shape=box];'), ('}')) v(value) UNION ALL SELECT '  \"' || path || '\" [label=\"' || name || '\"];' FROM m WHERE layer IN ('region', 'nation') UNION ALL SELECT '  \"' || src || '\" -> \"' || dst || '\";' FROM e WHERE src LIKE 'nation/%'")


def _change(s: SparkSession, d: str) -> tuple:
    return modules(s, d), edges(s, d), impact.impacted(edges(s, d), _one(s, "nation/3")), "nation/3"


_REACHED = "+f AS (SELECT src AS path, 'direct' AS ring FROM e WHERE dst = 'nation/3' UNION ALL SELECT e.src, 'indirect' FROM e JOIN e x ON x.src = e.dst WHERE x.dst = 'nation/3'), k AS (SELECT path, name, 'target' AS ring FROM m WHERE path = 'nation/3' UNION ALL SELECT f.path, name, ring FROM f JOIN m ON m.path = f.path), l AS (SELECT src, dst FROM e WHERE src IN (SELECT path FROM k) AND dst IN (SELECT path FROM k))"
_LINK = "'  \"' || src || '\" -> \"' || dst || '\"'"
register("diagram_impact_dot", lambda s, d: diagrams.dot_impact(*_change(s, d)), _REACHED + f" SELECT * FROM (VALUES ('digraph \"impact\" {{'), ('  rankdir=LR;'), ('  node [shape=box];'), ('}}')) v(value) UNION ALL SELECT '  \"' || path || '\" [label=\"' || name || '\", style=filled, fillcolor=\"' || CASE ring WHEN 'target' THEN 'tomato' WHEN 'direct' THEN 'orange' ELSE 'khaki' END || '\"];' FROM k UNION ALL SELECT {_LINK} || ';' FROM l")
register("diagram_impact_mermaid", lambda s, d: diagrams.mermaid_impact(*_change(s, d)), _REACHED + " SELECT * FROM (VALUES ('flowchart LR'), ('  classDef target fill:tomato;'), ('  classDef direct fill:orange;'), ('  classDef indirect fill:khaki;')) v(value) UNION ALL SELECT '  ' || replace(path, '/', '_') || '[\"' || name || '\"]:::' || ring FROM k UNION ALL SELECT '  ' || replace(src, '/', '_') || ' --> ' || replace(dst, '/', '_') FROM l")
_BOX = "'  subgraph \"cluster_' || g || '\" {{ label=\"' || {title} || '\"; style=filled; fillcolor=\"' || {fill} || '\";'"
register("diagram_layers", lambda s, d: diagrams.dot_layers(modules(s, d), edges(s, d)), f"+g AS (SELECT DISTINCT layer AS g FROM m) SELECT * FROM (VALUES ('digraph \"layers\" {{'), ('}}')) v(value) UNION ALL SELECT {_BOX.format(title=chr(39) + 'Layer: ' + chr(39) + ' || g', fill=chr(39) + 'whitesmoke' + chr(39))} FROM g UNION ALL SELECT '  }}' FROM g UNION ALL SELECT '    \"' || path || '\" [label=\"' || name || '\"];' FROM m UNION ALL SELECT DISTINCT {_LINK} || ';' FROM e")
register("diagram_zones", lambda s, d: diagrams.dot_security(security.classify(modules(s, d)), edges(s, d), security.violations(_zoned(s, d))), _ZONE + f", g AS (SELECT DISTINCT zone AS g FROM z) SELECT * FROM (VALUES ('digraph \"zones\" {{'), ('}}')) v(value) UNION ALL SELECT {_BOX.format(title='upper(g[1]) || g[2:] || ' + chr(39) + ' zone' + chr(39), fill='CASE g ' + ' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in diagrams.COLOURS.items()) + ' END')} FROM g UNION ALL SELECT '  }}' FROM g UNION ALL SELECT '    \"' || path || '\" [label=\"' || name || '\"];' FROM m UNION ALL SELECT DISTINCT {_LINK} || CASE WHEN (e.src, e.dst) IN (SELECT (src, dst) FROM c WHERE NOT {_MAY}) THEN ' [color=red, style=dashed, label=\"violation\"]' ELSE '' END || ';' FROM e")
register("diagram_mermaid", lambda s, d: diagrams.mermaid(modules(s, d).where("layer = 'region'"), edges(s, d).where("src LIKE 'nation/%'")), "SELECT 'flowchart LR' AS value UNION ALL SELECT '  ' || replace(path, '/', '_') || '[\"' || name || '\"]' FROM m WHERE layer = 'region' UNION ALL SELECT DISTINCT '  ' || replace(src, '/', '_') || ' --> ' || replace(dst, '/', '_') FROM e WHERE src LIKE 'nation/%'")
_PAGES = """+d AS (SELECT src AS path, string_agg('- ' || dst, chr(10) ORDER BY dst) AS deps FROM (SELECT DISTINCT src, dst FROM e) GROUP BY src), w AS (SELECT dst AS path, string_agg('- ' || src, chr(10) ORDER BY src) AS users FROM (SELECT DISTINCT src, dst FROM e) GROUP BY dst),
l AS (SELECT *, list_filter(string_split(tag_text, '|'), lambda x: x <> '') AS tl, list_filter(string_split(export_text, '|'), lambda x: x <> '') AS xl FROM m),
page AS (SELECT l.path, name, language, layer, tl, concat_ws(chr(10), '# ' || name, '', description, concat_ws(chr(10), '- language: ' || language, '- layer: ' || layer, CASE WHEN len(tl) > 0 THEN '- tags: ' || array_to_string(tl, ', ') END),
  CASE WHEN len(xl) > 0 THEN chr(10) || '## Exports' || chr(10) || chr(10) || '- ' || array_to_string(xl, chr(10) || '- ') END, chr(10) || '## Dependencies' || chr(10) || chr(10) || deps, chr(10) || '## Used by' || chr(10) || chr(10) || users) || chr(10) AS text
  FROM l LEFT JOIN d ON d.path = l.path LEFT JOIN w ON w.path = l.path)"""
register("docs_markdown", lambda s, d: diagrams.markdown(modules(s, d), edges(s, d)).select("path", F.md5("text").alias("md5")), _PAGES + " SELECT path, md5(text) AS md5 FROM page")
register("docs_front_matter", lambda s, d: diagrams.with_front_matter(diagrams.markdown(modules(s, d), edges(s, d)), modules(s, d)).select("path", F.md5("text").alias("md5")), _PAGES + """ SELECT path, md5(concat_ws(chr(10), '---', 'title: "' || name || '"', 'path: "' || path || '"', 'language: "' || language || '"', 'layer: "' || layer || '"', CASE WHEN len(tl) > 0 THEN 'tags: ["' || array_to_string(tl, '","') || '"]' END, '---', '') || text) AS md5 FROM page""")
register("docs_overview", lambda s, d: diagrams.overview(modules(s, d), edges(s, d)), "SELECT * FROM (VALUES ('# Overview'), (''), (''), ('## By layer'), (''), ('| layer | modules |'), ('| --- | --- |'), (''), ('## By language'), (''), ('| language | modules |'), ('| --- | --- |')) v(value) UNION ALL SELECT '- modules: ' || count(*) FROM m UNION ALL SELECT '- links: ' || count(*) FROM (SELECT DISTINCT src, dst FROM e) UNION ALL SELECT '| ' || layer || ' | ' || count(*) || ' |' FROM m GROUP BY layer UNION ALL SELECT '| ' || language || ' | ' || count(*) || ' |' FROM m GROUP BY language")
register("docs_single", lambda s, d: diagrams.single_document(modules(s, d), edges(s, d)), _PAGES + " SELECT * FROM (VALUES ('# Modules'), ('')) v(value) UNION ALL SELECT '- [' || name || '](#' || regexp_replace(lower(name), '[^A-Za-z0-9_]', '_', 'g') || ')' FROM m UNION ALL SELECT unnest(string_split(regexp_replace(text, '(?m)^#', '##', 'g'), chr(10))) FROM page")
register("graph_document", lambda s, d: diagrams.graph_document(modules(s, d).select("path", "name", "layer", "exports"), edges(s, d), triples(s, d), "/graph"), """+d AS (SELECT src AS path, '"' || string_agg(dst, '","' ORDER BY dst) || '"' AS deps FROM (SELECT DISTINCT src, dst FROM e) GROUP BY src), x AS (SELECT *, list_filter(string_split(export_text, '|'), lambda x: x <> '') AS xl FROM m) SELECT ']}' AS value UNION ALL SELECT '{"root": "/graph", "statistics": {"modules":' || (SELECT count(*) FROM m) || ',"relationships":' || (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e)) || ',"triples":' || (SELECT count(*) FROM t) || '}, "modules": ['
  UNION ALL SELECT CASE WHEN x.path = (SELECT min(path) FROM m) THEN '' ELSE ',' END || '{"path":"' || x.path || '","name":"' || name || '","layer":"' || layer || '","exports":[' || CASE WHEN len(xl) > 0 THEN '"' || array_to_string(xl, '","') || '"' ELSE '' END || '],"dependencies":[' || coalesce(deps, '') || ']}' FROM x LEFT JOIN d ON d.path = x.path""")


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


register("session_debounce", lambda s, d: bursts(_events(s, d), gap="30 minutes", key="event_type", by=["user_id"]).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n", F.array_join("keys", "|").alias("keys")),
         "WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM o) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS keys FROM g GROUP BY user_id, burst", False)
register("windowed_changes", lambda s, d: windowed_counts(_events(s, d), width="1 hour", by=["event_type"]).select("event_type", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n"), "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start, count(*) AS n FROM events GROUP BY ALL", False)


# --- customers as source files with a metadata block, parsed back
def _sources(s: SparkSession, d: str) -> DataFrame:
    """Every tenth block is cut off within a text; marks stand inside texts, lists and blank nodes are used."""
    key, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    head = F.concat(F.lit("package x\n<!-- RDF -->\n@prefix ex: <http://ex.org/> .\n<#"), key, F.lit('> a code:Module ;\n  code:name "'), F.col("c_name"), F.lit('" ;\n  code:description "a; b, c. <'))
    rest = F.concat(seg, F.lit('>" ;\n  code:tags "'), seg, F.lit('", "t2" ;\n  code:linksTo <../nation/'), F.col("c_nationkey").cast("string"), F.lit('> ;\n  ex:made [ code:layer "'), seg, F.lit('" ; ex:by [ ex:who "w" ] ] .'))
    text = F.concat(head, F.when(F.col("c_custkey") % 10 != 0, rest).otherwise(""), F.lit("\n<!-- End RDF -->\n"))
    return s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("customer/"), key).alias("path"), text.alias("content"))


def _parsed_triples(s: SparkSession, d: str) -> DataFrame:
    return turtle.triples_of(turtle.parse_files(_sources(s, d)))


_WHOLE = "WITH c AS (SELECT 'customer/' || c_custkey AS path, c_custkey % 10 = 0 AS broken, c_name, c_mktsegment AS seg, 'nation/' || c_nationkey AS nation FROM customer)"
register("turtle_triples", lambda s, d: _parsed_triples(s, d).select(*[F.regexp_replace(c, "^_:.*", "_:").alias(c) for c in ("subject", "predicate", "object")], "object_type"),
         _WHOLE + f" SELECT path AS subject, p AS predicate, o AS object, k AS object_type FROM (SELECT *, unnest([{{'p': '{RDF_TYPE}', 'o': '{NS}Module', 'k': 'uri'}}, {{'p': {_p('name')}, 'o': c_name, 'k': 'literal'}}, {{'p': {_p('description')}, 'o': 'a; b, c. <' || seg || '>', 'k': 'literal'}}, {{'p': {_p('tags')}, 'o': seg, 'k': 'literal'}}, {{'p': {_p('tags')}, 'o': 't2', 'k': 'literal'}}, {{'p': {_p('linksTo')}, 'o': nation, 'k': 'uri'}}, {{'p': 'http://ex.org/made', 'o': '_:', 'k': 'bnode'}}], recursive := true) FROM c WHERE NOT broken)"
         f" UNION ALL SELECT '_:', {_p('layer')}, seg, 'literal' FROM c WHERE NOT broken UNION ALL SELECT '_:', 'http://ex.org/by', '_:', 'bnode' FROM c WHERE NOT broken UNION ALL SELECT '_:', 'http://ex.org/who', 'w', 'literal' FROM c WHERE NOT broken", False)
register("turtle_errors", lambda s, d: turtle.parse_files(_sources(s, d)).where("error IS NOT NULL").select(F.col("file").alias("path")), _WHOLE + " SELECT path FROM c WHERE broken", False)
register("turtle_modules", lambda s, d: modules_of(_parsed_triples(s, d)).select("path", "name", "description", F.array_join("tags", ",").alias("tags"), F.array_join("dependencies", ",").alias("dependencies")), _WHOLE + " SELECT path, c_name AS name, 'a; b, c. <' || seg || '>' AS description, least(seg, 't2') || ',' || greatest(seg, 't2') AS tags, nation AS dependencies FROM c WHERE NOT broken", False)
register("turtle_edges", lambda s, d: turtle.resolve_edges(_parsed_triples(s, d), modules(s, d).where("layer = 'nation' AND path <> 'nation/3'").select(F.concat(F.lit("deep/"), "path").alias("path"), "uri", "name")), _WHOLE + " SELECT path AS src, CASE WHEN nation = 'nation/3' THEN nation ELSE 'deep/' || nation END AS dst, nation <> 'nation/3' AS resolved FROM c WHERE NOT broken", False)

# --- further paths, prefixes, lookups and reports
_sparql("property_path_star", "SELECT ?x WHERE { <orders/1> code:linksTo* ?x }", "+r AS (SELECT 'orders/1' AS dst UNION SELECT e.dst FROM e JOIN r ON e.src = r.dst) SELECT dst AS x FROM r")
_sparql("property_path_opt", "SELECT ?x WHERE { <orders/1> code:linksTo? ?x }", "SELECT 'orders/1' AS x UNION SELECT dst FROM e WHERE src = 'orders/1'")
_sparql("prefix_names", f'PREFIX c: <{NS}> PREFIX r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> SELECT ?m WHERE {{ ?m r:type c:Module ; c:layer "nation" }}', "SELECT path AS m FROM m WHERE layer = 'nation'")
register("search_columns", lambda s, d: ops.search(modules(s, d), "00012", ("name", "uri")).select("path"), "SELECT DISTINCT path FROM m WHERE contains(lower(name), '00012') OR contains('#' || lower(path), '00012') OR path IN (SELECT path FROM tg WHERE contains(lower(tag), '00012'))")
register("store_exists", lambda s, d: store.exists(triples(s, d), edges(s, d).select("src", F.lit(f"{NS}linksTo").alias("predicate"), F.regexp_replace("dst", "^nation/1$", "nation/none").alias("object")).withColumnRenamed("src", "subject")), f"SELECT src AS subject, {_p('linksTo')} AS predicate, dst AS object FROM e WHERE dst <> 'nation/1'")
register("diagram_chosen", lambda s, d: diagrams.chosen(modules(s, d), ["Customer", "NATION"], ["building", "Internal"]).select("path"), "SELECT DISTINCT path FROM tg WHERE (layer = 'customer' AND lower(tag) = 'building') OR (layer = 'nation' AND tag = 'internal')")
register("shadow_triples_by", lambda s, d: shadow.triples_by(_entries(s, d, True), "predicate", "size"), _SHADOW + " SELECT path, doc_id::VARCHAR AS subject, 'size' AS predicate, n_chars::VARCHAR AS object, 'manual' AS source FROM x JOIN documents ON path = concat(documents.source, '/', doc_id::VARCHAR) WHERE quality IS NOT NULL", False)
register("result_tsv", lambda s, d: results.tsv_lines(modules(s, d).where("layer = 'nation'").select("path", "name", F.concat("name", F.lit("\t\\")).alias("odd"))), "SELECT path || chr(9) || name || chr(9) || name || '\\t\\\\' AS value FROM m WHERE layer = 'nation'")
register("impact_bounded", lambda s, d: g.closure(g.reverse(edges(s, d)), _one(s, "region/1"), 2).select("node", "depth"), "SELECT src AS node, 1::BIGINT AS depth FROM e WHERE dst = 'region/1' UNION ALL SELECT DISTINCT a.src, 2::BIGINT FROM e a JOIN e b ON a.dst = b.src WHERE b.dst = 'region/1'")
register("zone_summary", lambda s, d: security.classify(modules(s, d)).groupBy("zone").agg(F.count(F.lit(1)).alias("n")).join(security.zone_info(s), "zone"), _ZONE + ", v AS (SELECT * FROM (VALUES " + ", ".join(f"('{z}', {r})" for z, r in security.ZONE_RISK.items()) + ") x(zone, risk)) SELECT z.zone, count(*) AS n, risk::BIGINT AS risk FROM z JOIN v ON v.zone = z.zone GROUP BY ALL")
register("rules_by_severity", lambda s, d: _checked(s, d, checks.BUILT_IN, least="warning", tags={"documentation"}).summary.select("rule", F.col("found").cast("long").alias("found")), "+v AS (" + _RULES + ") SELECT rule, found::BIGINT AS found FROM v WHERE rule = 'exports-documented'")


def _backwards(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    return checks.diff(modules(s, d), modules(s, d), e.where("NOT (src LIKE 'customer/%' AND src LIKE '%7')"), e).where("status = 'modified'").select("path", F.explode("added_deps").alias("dst"))


register("diff_deps_added", _backwards, "SELECT src AS path, dst FROM e WHERE src LIKE 'customer/%' AND src LIKE '%7'")


def _ordered(s: SparkSession, d: str) -> DataFrame:
    """A star whose patterns are joined rarest first, by the counts of their predicates."""
    t = by_predicate(s, d)
    return sparql(t, 'SELECT ?m ?t WHERE { ?m a code:Module ; code:name ?n ; code:tags ?t ; code:exports ?n }', predicate_counts(t))


register("bgp_ordered", _ordered, "SELECT m.path AS m, tag AS t FROM m JOIN tg ON tg.path = m.path JOIN ex ON ex.path = m.path AND ex.export = m.name")


def _old_code(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as source files of all kinds: internal, tests, commands, entry points, unfinished, excluded, used."""
    k, pr = F.col("o_orderkey"), F.col("o_orderpriority")
    name = lambda front, back=".go": F.concat(F.lit(front), k.cast("string"), F.lit(back))
    kinds = [name("pkg/internal/o"), name("lib/o", "_test.go"), name("lib/cmd_"), name("skip/o"), name("main/o"), name("wip/o"), name("lib/o")]
    path = F.element_at(F.array(*kinds), (k % 7 + 1).cast("int"))
    words = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    m = s.read.parquet(f"{d}/orders.parquet").select(
        path.alias("path"), k.alias("k"), F.when(pr == "1-URGENT", "A PoC of it").alias("description"),
        F.when(pr == "2-HIGH", words("rpc")).when(pr == "3-MEDIUM", words("Middleware")).otherwise(words()).alias("tags"),
        F.when(k % 11 == 0, words("#init")).when(k % 3 == 0, words("E")).otherwise(words()).alias("exports"),
    )
    return m.where("k % 13 = 0").select(F.lit("x").alias("src"), F.col("path").alias("dst")), m


register("dead_kinds", lambda s, d: deadcode.dead_modules(*_old_code(s, d), exclude=["skip/*"], aggressive=True).select("path", "confidence", "action", "risk"),
         "WITH c AS (SELECT o_orderkey AS k, o_orderpriority AS pr FROM orders WHERE o_orderkey % 7 IN (0, 5, 6) AND o_orderpriority <> '3-MEDIUM' AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0), h AS (SELECT CASE k % 7 WHEN 0 THEN 'pkg/internal/o' WHEN 5 THEN 'wip/o' ELSE 'lib/o' END || k || '.go' AS path, least(90 + CASE WHEN k % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 3 <> 0 THEN 5 ELSE 0 END - CASE WHEN pr = '2-HIGH' OR (k % 3 = 0 AND k % 7 <> 0) THEN 30 ELSE 0 END - CASE WHEN k % 7 = 5 OR pr = '1-URGENT' THEN 40 ELSE 0 END, 100) AS x FROM c) SELECT path, x / 100 AS confidence, CASE WHEN x >= 80 THEN 'remove' ELSE 'review' END AS action, CASE WHEN x >= 80 THEN 'low' WHEN x >= 60 THEN 'medium' ELSE 'high' END AS risk FROM h WHERE x >= 50", False)
