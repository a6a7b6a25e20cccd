"""Fixtures with exact results: stores, queries, graphs, analyses, sources, sinks, streams."""

import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.analysis import checks, deadcode, impact, security, shadow
from tessera.functions import text
from tessera.graph import algorithms as g
from tessera.operators import modules as ops
from tessera.operators import store
from tessera.plans.compiler import Compiler, predicate_counts, sparql
from tessera.plans.parser import SparqlError, parse
from tessera.plans.templates import Template, Templates
from tessera.schema import NS, RDF_TYPE, canonical, modules_of
from tessera.sinks import diagrams, results
from tessera.sources import files, turtle
from tessera.streaming import watch


def edges_of(spark, text_):
    return spark.createDataFrame([tuple(x.split(">")) for x in text_.split()], "src string, dst string")


def nodes_of(spark, text_):
    return spark.createDataFrame([(x,) for x in text_.split()], "path string")


@pytest.fixture(scope="module")
def seven(spark):
    rows = [("main", RDF_TYPE, f"{NS}Module"), ("main", f"{NS}name", "main.go"), ("main", f"{NS}linksTo", "utils"), ("main", f"{NS}exports", "main"), ("utils", RDF_TYPE, f"{NS}Module"), ("utils", f"{NS}name", "utils.go"), ("utils", f"{NS}exports", "Helper")]
    return spark.createDataFrame(rows, "subject string, predicate string, object string")


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    "query,rows",
    [
        ("SELECT ?m WHERE { ?m a code:Module }", [("main",), ("utils",)]),
        ('SELECT ?m WHERE { ?m code:name "main.go" }', [("main",)]),
        ("SELECT DISTINCT ?s WHERE { ?s ?p ?o }", [("main",), ("utils",)]),
        ('SELECT ?n WHERE { ?m code:name ?n FILTER(REGEX(?n, "main")) }', [("main.go",)]),
        ("SELECT ?o WHERE { <main> code:unknown ?o }", []),
        ("PREFIX c: <urn:code:> SELECT ?x ?n WHERE { ?x c:linksTo ?y . ?y c:name ?n . }", [("main", "utils.go")]),
        ("SELECT ?m ?d WHERE { ?m a code:Module OPTIONAL { ?m code:linksTo ?d } }", [("main", "utils"), ("utils", None)]),
        ("SELECT ?m WHERE { ?m a code:Module FILTER(!BOUND(?nothing)) FILTER NOT EXISTS { ?m code:linksTo ?x } }", [("utils",)]),
        ("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", [(7,)]),
        ("SELECT ?m WHERE { ?m code:name ?n FILTER(STRLEN(?n) * 2 >= 16 && ?n != \"main.go\") }", [("utils",)]),
        ("SELECT ?x WHERE { <main> code:linksTo* ?x }", [("main",), ("utils",)]),
        ("SELECT ?x WHERE { ?x ^code:linksTo <main> }", [("utils",)]),
        ('SELECT ?m ?k WHERE { VALUES (?m ?k) { ("main" "a") ("gone" "b") } ?m a code:Module }', [("main", "a")]),
        ("SELECT ?a ?b WHERE { { ?a code:linksTo ?b } UNION { ?b code:linksTo ?a } }", [("main", "utils"), ("utils", "main")]),
        ("SELECT ?n WHERE { ?m code:name ?n } ORDER BY DESC(?n) LIMIT 1", [("utils.go",)]),
        ("SELECT ?m (COUNT(?p) AS ?n) WHERE { ?m ?p ?o } GROUP BY ?m HAVING (COUNT(?p) > 3) ORDER BY ?m", [("main", 4)]),
    ],
)
def test_sparql(seven, query, rows):
    assert values(sparql(seven, query)) == sorted(rows, key=repr)


def test_sparql_scope(seven):
    ran = lambda q: values(sparql(seven, q))
    assert ran('SELECT ?m ?e WHERE { ?m code:name ?n OPTIONAL { ?m code:exports ?e FILTER(?n = "main.go") } }') == [("main", "main"), ("utils", None)]
    assert ran("SELECT ?m WHERE { ?m code:name ?n FILTER EXISTS { ?x code:exports ?e FILTER(STRSTARTS(?n, ?e)) } }") == [("main",)]
    assert ran("SELECT ?m WHERE { ?m code:name ?n FILTER NOT EXISTS { ?x code:exports ?e FILTER(STRSTARTS(?n, ?e)) } }") == [("utils",)]
    assert ran("SELECT ?m ?x WHERE { ?m a code:Module OPTIONAL { ?m code:linksTo ?x } OPTIONAL { ?m code:exports ?x } }") == [("main", "utils"), ("utils", "Helper")]
    assert ran("SELECT ?m ?x ?k WHERE { ?m a code:Module OPTIONAL { ?m code:linksTo ?x } ?x code:name ?k }") == [("main", "utils", "utils.go"), ("utils", "main", "main.go"), ("utils", "utils", "utils.go")]
    assert ran("SELECT ?m WHERE { ?m code:linksTo ?m }") == []


def test_zone_defaults(spark):
    want = {
        "internal/x.go": ("internal", 0.6), "cmd/a.go": ("internal", 0.55), "pkg/server/rest/a.go": ("public", 0.65), "pkg/server/my_handler.go": ("public", 0.65), "pkg/server/run.go": ("trusted", 0.55),
        "pkg/schema/graphql/a.go": ("public", 0.6), "pkg/storex/a.go": ("data", 0.55), "pkg/a.go": ("internal", 0.5), "examples/a/models/m.go": ("internal", 0.45), "examples/a/utils/u.go": ("internal", 0.45),
        "examples/a/services/s.go": ("trusted", 0.45), "examples/a.go": ("public", 0.4), "x_test.go": ("internal", 0.4), "x.go": ("unknown", 0.0), "a/api/b.go": ("public", 0.75),
    }
    df = spark.createDataFrame([(p, "", []) for p in want], "path string, layer string, tags array<string>")
    assert {r.path: (r.zone, r.confidence) for r in security.classify(df).collect()} == want


def test_a_self_link_is_no_cycle_of_two(spark):
    links = spark.createDataFrame([("a", f"{NS}linksTo", "a"), ("b", f"{NS}linksTo", "c"), ("c", f"{NS}linksTo", "b")], "subject string, predicate string, object string")
    got = checks.check_rules(links, checks.BUILT_IN[:1]).violations.collect()
    assert sorted(r.module for r in got) == ["b", "c"] and got[0].rule == "no-circular-dependencies"


def test_sparql_pages_and_errors(seven):
    assert sparql(seven, "SELECT * WHERE { ?s ?p ?o } LIMIT 3").columns == ["o", "p", "s"]
    assert sparql(seven, "SELECT ?s WHERE { ?s ?p ?o } OFFSET 3").count() == 4
    for bad in ("SELECT ?x", "SELECT ?x WHERE { ?x nope:y ?z }", "SELECT ?x WHERE { ?x a code:Module FILTER(FROB(?x)) }", "SELECT ?x WHERE { ?x a code:Module FILTER(?y = 1) }", "ASK { }"):
        with pytest.raises(SparqlError):
            sparql(seven, bad)


def test_patterns_are_ordered_rarest_and_connected_first(seven):
    c = Compiler(seven, {f"{NS}exports": 10, f"{NS}language": 50, RDF_TYPE: 100, f"{NS}tags": 1, f"{NS}name": 100})
    q = parse('SELECT ?m WHERE { ?m a code:Module . ?m code:language "go" . ?m code:exports ?e . ?z code:tags ?t . ?z code:name ?m }')
    got = [t.p.iri for t in c.order(q.where.elements[0][1])]
    assert got[0] == f"{NS}tags" and got.index(f"{NS}exports") < got.index(RDF_TYPE)
    assert predicate_counts(seven)[f"{NS}exports"] == 2


def test_templates(seven, tmp_path):
    t = Templates()
    assert len(t.list()) == 18 and "impact" in t.categories()
    assert values(t.run("find-dependencies", seven, module="main")) == [("utils",)]
    with pytest.raises(ValueError):
        t.get("find-usages").render()
    t.save(Template("mine", "own", "", "SELECT ?m WHERE { ?m code:name ?n }"))
    t.export("mine", str(tmp_path))
    (tmp_path / "bad.json").write_text("{")
    assert Templates().load(str(tmp_path)) == 1


def test_store(seven):
    assert store.find(seven, predicate=f"{NS}name").count() == 2 and store.find(seven).count() == 7
    assert store.delete(seven, subject="main").count() == 3 and store.delete(seven).count() == 0
    assert store.add(seven, seven).count() == 7 and store.clear(seven).count() == 0
    assert store.exists(seven, seven.limit(2)).count() == 2
    m = {r.uri: r for r in modules_of(canonical(seven)).collect()}
    assert m["main"]["name"] == "main.go" and m["main"].dependencies == ["utils"] and m["utils"].exports == ["Helper"]


def test_graphs(spark):
    dag, nodes = edges_of(spark, "A>B A>C B>D C>D"), nodes_of(spark, "A B C D E")
    assert [r.node for r in g.topological_order(dag, nodes).orderBy("position").collect()] == ["D", "E", "B", "C", "A"]
    cycle = edges_of(spark, "A>B B>C C>A D>D")
    with pytest.raises(g.CycleError):
        g.levels(cycle, nodes)
    assert values(g.components(cycle, nodes_of(spark, "E"))) == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "E")]
    assert [r.node for r in g.cyclic_nodes(cycle).orderBy("node").collect()] == ["A", "B", "C", "D"]
    assert values(g.transitive_dependencies(cycle, nodes_of(spark, "A"))) == [("A", "B", 1), ("A", "C", 2)]
    tail = edges_of(spark, "A>B A>C B>D C>D D>E")
    assert {r.node: r.level for r in g.levels(tail, nodes).collect()}["A"] == 3
    assert values(g.transitive_dependencies(tail, nodes_of(spark, "A"))) == [("A", "B", 1), ("A", "C", 1), ("A", "D", 2), ("A", "E", 3)]
    paths = g.shortest_paths(tail, edges_of(spark, "A>E B>B E>A"))
    assert values(paths) == [("A", "E", ["A", "B", "D", "E"]), ("B", "B", ["B"])]
    assert g.has_cycle_through(cycle, "A") and not g.has_cycle_through(tail, "A")


def module_rows(spark, rows):
    return spark.createDataFrame([(p, "#" + p, p, d, "go", layer, t, x) for p, layer, t, x, d in rows], "path string, uri string, name string, description string, language string, layer string, tags array<string>, exports array<string>")


def test_impact(spark):
    e = edges_of(spark, "api>sa api>sb sa>ua sb>ub ua>core ub>core")
    m = module_rows(spark, [("api", "handlers", [], [], ""), ("sa", "services", [], [], ""), ("sb", "services", [], [], ""), ("ua", "utils", [], [], ""), ("ub", "utils", [], [], ""), ("core", "core", [], [], ""), ("lone", "", [], [], "")])
    r = impact.impact(e, m, nodes_of(spark, "core lone")).orderBy("target").collect()
    assert (r[0].direct, r[0].impacted, r[0].max_depth, round(r[0].percentage, 1), r[0].points, r[0].risk, r[0].breaking) == (2, 5, 3, 71.4, 5, "HIGH", True)
    assert (r[1].risk, r[1].impacted) == ("LOW", 0)
    assert impact.recommendations(impact.impact(e, m, nodes_of(spark, "core"))).count() == 6
    assert values(impact.critical_paths(e, "core", users=1)) == [("sa", "core", ["sa", "ua", "core"]), ("sb", "core", ["sb", "ub", "core"]), ("ua", "core", ["ua", "core"]), ("ub", "core", ["ub", "core"])]


def test_dead_code(spark):
    e = edges_of(spark, "a/cmd/x.go>auth.go auth.go>crypto.go")
    rows = [("a/cmd/x.go", "", [], [], ""), ("auth.go", "", [], [], ""), ("crypto.go", "", [], [], ""), ("legacy/helper.go", "", [], ["Help"], ""), ("internal/new.go", "", ["experimental"], [], ""), ("old/plugin.go", "", [], [], ""), ("u_test.go", "", [], [], ""), ("internal/gone.go", "", [], [], "")]
    got = {r.path: (r.confidence, r.safe, r.action) for r in deadcode.dead_modules(e, module_rows(spark, rows)).collect()}
    assert got == {"legacy/helper.go": (0.5, False, "review"), "internal/new.go": (0.55, False, "review"), "internal/gone.go": (0.95, True, "remove")}
    script = [r.line for r in deadcode.cleanup_script(deadcode.dead_modules(e, module_rows(spark, rows))).collect()]
    assert script[0] == "#!/bin/sh" and "git rm -- 'internal/gone.go'" in script


def test_security(spark):
    rows = [("api.go", "", ["api"], [], ""), ("auth.go", "services", [], [], ""), ("admin.go", "", ["admin"], [], ""), ("x/store/user.go", "", [], [], ""), ("pkg/y.go", "", [], [], "")]
    z = security.classify(module_rows(spark, rows))
    assert {r.path: r.zone for r in z.collect()} == {"api.go": "public", "auth.go": "trusted", "admin.go": "admin", "x/store/user.go": "data", "pkg/y.go": "internal"}
    c = security.crossings(edges_of(spark, "api.go>auth.go api.go>admin.go auth.go>x/store/user.go admin.go>x/store/user.go"), z)
    v = security.violations(c)
    assert [(r.src, r.dst, r.risk) for r in v.collect()] == [("api.go", "admin.go", "CRITICAL")]
    assert security.risk_score(v).first().score == 10 and security.boundaries(c).count() == 4


def test_validation_rules_and_diff(spark, seven):
    m = module_rows(spark, [("a", "x", ["t"], ["A"], "d"), ("b", "x", [], [], "")])
    found = {(r.check, r.path) for r in checks.validate(m, edges_of(spark, "a>b b>a a>zzz")).collect()}
    assert found == {("missing-description", "b"), ("no-tags", "b"), ("no-exports", "b"), ("unknown-dependency", "a"), ("cycle", "a"), ("cycle", "b")}
    report = checks.check_rules(seven, checks.BUILT_IN)
    assert {r.rule: (r.found, r.passed) for r in report.summary.collect()} == {"no-circular-dependencies": (0, True), "exports-documented": (2, False), "modules-have-layer": (2, False), "modules-have-tags": (2, False)}
    rules = checks.parse_rules("version: 1\nrules:\n- {id: a, name: A, pattern: 'SELECT ?m WHERE { ?m a code:Module }', expect: 2}\n- {id: b, name: B, pattern: 'SELECT ?m WHERE { ?m code:name \"none\" }', expect: 1, severity: warning}\n- {id: c, name: C, pattern: 'SELECT ?m WHERE { ?m ?p ?o }', enabled: false}\n")
    report = checks.check_rules(seven, rules)
    assert [(r.rule, r.message) for r in report.violations.collect()] == [("b", "expected 1 results")] and report.skipped == ["c"]
    with pytest.raises(ValueError):
        checks.parse_rules("version: 1\nrules: [{id: a, name: A, pattern: x, severity: odd}]")
    new = module_rows(spark, [("b", "y", [], [], ""), ("c", "x", [], [], "")])
    d = {r.path: r for r in checks.diff(m, new, edges_of(spark, "b>a"), edges_of(spark, "b>c")).collect()}
    assert {p: r.status for p, r in d.items()} == {"a": "removed", "b": "modified", "c": "added"}
    assert d["b"].added_deps == ["c"] and d["b"].removed_deps == ["a"]


SOURCE = '''// <!-- RDF -->
@prefix code: <urn:code:> .
<#auth.go> a code:Module ;
  code:name "auth.go" ;
  code:description "a module, with code:words; and a dot." ;
  code:tags "security", "auth" ;
  code:linksTo <../utils/crypto.go>, <./user.go> ;
  code:info [ code:kind "x" ; code:deep [ code:level "2" ] ] .
// <!-- End RDF -->
<!-- RDF --> second block is not read <!-- End RDF -->'''


def test_turtle_and_scan(spark, tmp_path):
    rows = turtle.parse_turtle(SOURCE.split("-->", 1)[1].split("//")[0])
    assert ("#auth.go", f"{NS}description", "a module, with code:words; and a dot.", "literal") in rows
    assert sum(p == f"{NS}tags" for _, p, _, _ in rows) == 2 and sum(k == "bnode" for *_, k in rows) == 2
    for bad in ('<a> <b> "open', "<a> <b> [ <c> <d> "):
        with pytest.raises(turtle.TurtleError):
            turtle.parse_turtle(bad)
    for name, body in {"svc/auth.go": SOURCE, "svc/user.go": "x", "utils/crypto.go": SOURCE.replace("auth.go", "crypto.go").replace("../utils/crypto.go", "#x"), "vendor/v.go": "x", "notes.txt": "x", "open.py": "<!-- RDF --> never closed"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body.replace("// <!--", "<!--"))
    found, errors = files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == ["open.py", "svc/auth.go", "svc/user.go", "utils/crypto.go"]
    assert [r.path for r in errors.collect()] == ["open.py"]
    t = turtle.triples_of(turtle.parse_files(found))
    m = modules_of(t)
    assert sorted(r.path for r in m.collect()) == ["svc/auth.go", "utils/crypto.go"]
    e = {(r.src, r.dst, r.resolved) for r in turtle.resolve_edges(t, m).collect()}
    assert ("svc/auth.go", "utils/crypto.go", True) in e and ("svc/auth.go", "svc/user.go", False) in e
    assert files.changed_since(found, found.limit(1)).count() == 3


def test_paths_filters_and_samples(spark):
    df = spark.createDataFrame([(p,) for p in ("a/../b", "./x/./y", "../up/z", "/a//b/", "a/b/../../..", "q")], "path string")
    assert [r[0] for r in df.select(text.clean_path(F.col("path"))).collect()] == ["b", "x/y", "../up/z", "/a/b", "..", "q"]
    p = spark.createDataFrame([("out/a.go",), ("src/layout.go",), ("src/x/y.swp",), ("src/x/z.go",)], "path string")
    assert [r.path for r in p.where(~files.is_ignored(F.col("path"), files.IGNORED)).collect()] == ["src/layout.go", "src/x/z.go"]
    assert [r.path for r in p.where(files.in_focus(F.col("path"), ["src/**/*.go"])).collect()] == ["src/layout.go", "src/x/z.go"]
    assert files.parse_ignore("# c\n\n!no\nyes\n") == ["yes"]
    m = spark.createDataFrame([(f"{'ab'[k > 6]}/{k}", k) for k in range(10)], "path string, mtime int")
    assert ops.sample_stratified(m, 4).groupBy("dir").count().orderBy("dir").collect()[0][1] == 2
    assert [r.path for r in ops.sample_recent(m, 2).collect()] == ["b/9", "b/8"] and ops.sample_hash(m, 3, 1).count() == 3
    page = ops.cursor_page(m, 4, 3).collect()
    assert [r.path for r in page] == ["a/4", "a/5", "a/6", "b/7"] and page[0].has_next
    assert spark.createDataFrame([(page[0].cursor,)], "c string").select(text.cursor_position(F.col("c"))).first()[0] == 4


def entry(path, source, **more):
    base = {"path": path, "uri": None, "name": None, "language": "go", "layer": None, "tags": [], "concepts": [], "exports": [], "source": source, "triples": [], "annotations": {}, "properties": {}, "hash": "h", "updated_at": None}
    return base | more


def test_shadow(spark, tmp_path):
    old = spark.createDataFrame([entry("a", "manual", tags=["x"], triples=[("s", "p", "o", "manual"), ("s", "p", "2", "auto")], annotations={"k": "v"}, properties={"one": "1", "two": "2"}), entry("b", "auto")], shadow.SCHEMA)
    new = spark.createDataFrame([entry("a", "auto", name="A", tags=["y"], triples=[("s", "p", "3", "auto")], properties={"two": "3"}), entry("c", "auto", layer="api", hash="n")], shadow.SCHEMA)
    m = {r.path: r for r in shadow.merge(old, new).collect()}
    assert m["a"].source == "mixed" and m["a"].tags == ["x", "y"] and [t.object for t in m["a"].triples] == ["o", "3"] and m["a"].annotations == {"k": "v"} and m["a"].properties == {"one": "1", "two": "3"} and set(m) == {"a", "b", "c"}
    assert [t.object for t in shadow.merge(old, new, False).where("path = 'a'").first().triples] == ["3"]
    shadow.save(old, str(tmp_path / "s"))
    back = shadow.read(spark, str(tmp_path / "s"))
    assert back.count() == 2 and [r.path for r in shadow.search(old, tags=["x"], manual=True).collect()] == ["a"]
    assert {r.path: r.status for r in shadow.build_status(old, new).collect()} == {"a": "skipped", "c": "new"}
    assert {r.path: r.status for r in shadow.build_status(old, new, force=True).collect()} == {"a": "merged", "c": "new"}
    assert shadow.annotate(old, "a", "k", "w").where("path = 'a'").first().annotations == {"k": "w"}
    assert [r.path for r in shadow.orphans(old, new).collect()] == ["b"] and shadow.triples_by(old, "object", "o").count() == 1
    assert {(r.kind, r.key): r.n for r in shadow.statistics(new).collect()}[("layer", "api")] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([('a"b', "x,y"), ("<t>", None)], "v string, w string")
    assert results.to_csv(df) == 'v,w\r\n"a""b","x,y"\r\n<t>,\r\n'
    assert results.to_tsv(df).splitlines()[0] == "?v\t?w"
    assert '"vars": ["v", "w"]' in results.sparql_json(df) and "&lt;t&gt;" in results.sparql_xml(df)
    assert results.to_table(df.limit(0)) == "No results" and [r["v"] for r in results.stream(df)] == ['a"b', "<t>"]
    for kind in ("parquet", "json", "csv", "tsv", "xml", "orc"):
        results.write(df, str(tmp_path / kind), kind)
    m = module_rows(spark, [("a/x.go", "api", ["t"], ["X"], "About"), ("b.go", "data", [], [], "")])
    e = edges_of(spark, "a/x.go>b.go")
    dot = [r.value for r in diagrams.dot(m, e, cluster=True).collect()]
    assert dot[0].startswith("digraph") and '  "a/x.go" -> "b.go";' in dot and dot[-1] == "}"
    assert [r.value for r in diagrams.mermaid(m, e).collect()] == ["flowchart LR", '  a_x_go["a/x.go"]', '  b_go["b.go"]', "  a_x_go --> b_go"]
    page = diagrams.markdown(m, e).where("path = 'b.go'").first().text
    assert page.startswith("# b.go") and "## Used by" in page and diagrams.markdown_index(m).count() == 2
    assert "type Module" in diagrams.graphql_schema(m) and diagrams.mermaid_classes(m, e).count() == 4
    bad = spark.createDataFrame([("error", "r1", "a"), ("info", "r2", "b")], "severity string, rule string, path string")
    assert "error (1)" in diagrams.report(bad) and diagrams.report(bad, "junit").count("<testcase") == 2 and '"count": 2' in diagrams.report(bad, "json")


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:01", "b"), ("2024-01-01 00:00:09", "a"), ("2024-01-01 01:00:00", "z")]
    batch = spark.createDataFrame(rows, "ts string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.n, list(r["keys"])) for r in watch.bursts(batch, gap="5 seconds").orderBy("start").collect()]
    assert got == [(2, ["a", "b"]), (1, ["a"]), (1, ["z"])]
    batch.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = watch.bursts(live, gap="5 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("bursts").collect()) in ([1, 2], [1, 1, 2])
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a.go").write_text("x")
    seen = []
    watch.watch(spark, f"{tmp_path}/tree", f"{tmp_path}/check", lambda df, n: seen.extend(r.content for r in df.collect())).awaitTermination()
    assert seen == ["x"]
    old = spark.createDataFrame([("a", "p", "1", "f1"), ("b", "p", "1", "f2")], "subject string, predicate string, object string, file string")
    new = spark.createDataFrame([("a", "p", "2", "f1")], old.schema)
    assert {tuple(r)[:3] for r in watch.upsert(old, new).collect()} == {("a", "p", "2"), ("b", "p", "1")}


def test_entry_without_optional_folders(spark):
    import __spark_entry__ as entry_module

    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).columns == ["n", "l"]


def test_part_graph_holds_all_parts(spark, tmp_path):
    """Parts 1 > 500 > 900 > 1 in a ring and 900 > 901."""
    rows = [(1, 1, 1), (1, 2, 500), (1, 3, 900), (1, 4, 1), (2, 1, 900), (2, 2, 901), (3, 1, 500), (3, 2, 500)]
    spark.createDataFrame([(o, n, p, 1) for o, n, p in rows], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    links = {(f"part/{a}", f"part/{b}") for (o, _, a), (x, _, b) in zip(rows, rows[1:]) if o == x and a != b}
    reach = set(links)
    while more := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
        reach |= more
    ran = lambda name: set(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert ran("closure_cyclic") == reach
    ring = {"part/1", "part/500", "part/900"}
    assert ran("scc_label") == {(n, "part/1" if n in ring else n) for n in ring | {"part/901"}}
    assert ran("cyclic_nodes") == {(n,) for n in ring}
    assert ran("shortest_path_len") == {("part/1", "part/1", 0), ("part/1", "part/500", 1), ("part/1", "part/900", 2)}
    assert ran("tpl_circular_deps") == {(a, b) for a, b in links if (b, a) in links}


def test_queries_hold_the_orders(spark, tmp_path):
    one = {"region": "0 AS r_regionkey, 'R' AS r_name", "nation": "0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey", "supplier": "0 AS s_suppkey, 'S' AS s_name, 1.0 AS s_acctbal, 0 AS s_nationkey",
           "customer": "0 AS c_custkey, 'C' AS c_name, 9500.0 AS c_acctbal, 'M' AS c_mktsegment, 0 AS c_nationkey"}
    for table, row in one.items():
        spark.sql(f"SELECT {row}").write.parquet(f"{tmp_path}/{table}.parquet")
    spark.sql("SELECT id AS o_orderkey, 'O' AS o_orderstatus, 'P' AS o_orderpriority, 0 AS o_custkey FROM range(2)").write.parquet(f"{tmp_path}/orders.parquet")
    ran = lambda name: [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    assert [n for n, _ in sorted(ran("topo_order"), key=lambda r: r[1])] == ["region/0", "nation/0", "customer/0", "supplier/0", "orders/0", "orders/1"]
    assert {p for p, _ in ran("docs_markdown")} == {"region/0", "nation/0", "customer/0", "supplier/0", "orders/0", "orders/1"}
    score = {r[0]: r[1:] for r in ran("coverage_score")}
    assert score["customer/0"] == (2, 1, 2, round(2 / 6 * 0.5 + 2 / 6 * 0.3 + 0.2, 9), False, False, "middle") and score["region/0"][2] == 5 and len(score) == 6
    assert ran("coverage_decile") == [("nation/0",)] and score["nation/0"][:3] == (2, 1, 4)
    assert {r for r in ran("closure_deps") if r[0] == "orders/1"} == {("orders/1", "customer/0", 1), ("orders/1", "nation/0", 2), ("orders/1", "region/0", 3)}
    assert set(ran("dup_name")) == {("orders/0", "O"), ("orders/1", "O"), ("region/0", "geo"), ("nation/0", "geo")}


def test_dead_code_is_dealt_out_by_counts(spark, monkeypatch):
    """The template's test of users goes to as many tasks as its rows need, and stays behind the join with the layers."""
    from tessera.plans import compiler

    monkeypatch.setattr(compiler, "ROWS", 20)
    rows = [(f"n{k:02d}", p, o) for k in range(50) for p, o in ((RDF_TYPE, f"{NS}Module"), (f"{NS}layer", "cli" if k % 5 == 0 else "api"), (f"{NS}linksTo", f"n{k // 2:02d}"))]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    counts = predicate_counts(t)
    df = Templates().run("dead-code", t, counts)
    assert values(df) == [(f"n{k:02d}", "api") for k in range(25, 50) if k % 5]
    assert df.rdd.getNumPartitions() == 5
