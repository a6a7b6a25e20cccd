"""Reports, documents, shadow sync, validator and rule internals on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.analysis import checks, impact, security, shadow
from tessera.operators import modules as ops
from tessera.operators import pages, store
from tessera.plans.compiler import predicates_of, sparql
from tessera.plans.parser import parse
from tessera.sinks import diagrams, results
from tessera.sources import files

NS = "urn:code:"


def triples(spark, rows):
    return spark.createDataFrame([(s, p if "/" in p or p.startswith("http") else NS + p, o) for s, p, o in rows], "subject string, predicate string, object string")


def modules(spark, rows):
    return spark.createDataFrame(rows, "path string, uri string, name string, description string, language string, layer string, tags array<string>, exports array<string>")


@pytest.fixture(scope="module")
def chain(spark):
    m = modules(spark, [(p, f"#{p}", p.upper(), "", "go", layer, [], []) for p, layer in zip("abcdef", ["x", "x", "y", "", "z", "z"])])
    return m, spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("e", "b"), ("f", "e")], "src string, dst string")


def test_combined_impact_and_ranking(spark, chain):
    m, e = chain
    t = spark.createDataFrame([("a",), ("e",)], "path string")
    r = impact.combined_impact(e, m, t).first()
    assert (r.targets, r.direct, r.dependencies, r.impacted, r.layers, r.max_depth, r.percentage) == (2, 2, 1, 5, 4, 2, 83.333333)
    each = impact.impact(e, m, m)
    assert [(x.target, x.impacted, x["rank"]) for x in impact.ranking(each).orderBy("rank").collect()] == [("a", 5, 1), ("b", 4, 2), ("e", 1, 3), ("c", 0, 4), ("d", 0, 5), ("f", 0, 6)]
    n = impact.critical_counts(e, t)
    assert [(x.target, x.n) for x in n.collect()] == [("a", 1)]
    said = [x.advice for x in impact.recommendations(each.where("target IN ('a', 'e')"), n).collect()]
    assert "Walk through 1 critical paths" in said and said.count("Test across layers") == 1
    none = impact.combined_impact(e, m, t.limit(0)).first()
    assert (none.targets, none.impacted, none.risk) == (0, 0, "LOW")


def test_security_advice(spark):
    v = spark.createDataFrame([("a", "b", "CRITICAL"), ("a", "c", "HIGH"), ("a", "d", "LOW")], "src string, dst string, risk string")
    assert [x.advice for x in security.recommendations(v).orderBy("nth").collect()][:2] == ["Mend 1 critical crossings first", "Mend 1 crossings of high risk"]
    assert [x.advice for x in security.recommendations(v.limit(0)).collect()] == ["No crossing is out of order"]


def test_star_rules_share_an_aggregate(spark):
    t = triples(spark, [("m1", "layer", "api"), ("m1", "tags", "x"), ("m1", "tags", "y"), ("m2", "layer", "api"), ("m2", "exports", "E"), ("m2", "tags", "x"), ("m3", "layer", "db"), ("m1", "linksTo", "m2"), ("m2", "linksTo", "m1")])
    star = lambda id, text, **more: checks.Rule(id, id, text, "info", **more)
    texts = {
        "one": 'SELECT ?m WHERE { ?m code:layer "api" ; code:tags ?t FILTER NOT EXISTS { ?m code:exports ?e } }', "two": "SELECT ?m WHERE { ?m code:tags ?t ; code:layer ?l }", "none": 'SELECT ?m WHERE { ?m code:layer "no" }',
        "distinct": "SELECT DISTINCT ?m WHERE { ?m code:tags ?t }", "join": "SELECT ?m WHERE { ?m code:linksTo ?o . ?o code:exports ?e }", "same": "SELECT ?m WHERE { ?m code:tags ?t ; code:exports ?t }", "any": "SELECT ?m WHERE { ?m ?p \"x\" }",
    }
    stars = {k: checks._star(parse(x)) is not None for k, x in texts.items()}
    assert stars == {"one": True, "two": True, "none": True, "distinct": False, "join": False, "same": False, "any": False}
    report = checks.check_rules(t, [star(k, x) for k, x in texts.items()])
    alone = {k: sparql(t, x).count() for k, x in texts.items()}
    assert {r.rule: r.found for r in report.summary.collect()} == alone and alone["one"] == 2 and alone["two"] == 3
    assert sorted((r.rule, r.module) for r in report.violations.where("rule IN ('one', 'join')").collect()) == [("join", "m1"), ("one", "m1"), ("one", "m1")]
    assert json.loads(report.violations.where("rule = 'one'").first().details) == {"m": "m1"}
    fused = checks._stars(t, {k: checks._star(parse(texts[k])) for k in ("one", "two", "none")})
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert [(r.severity, r.rules, r.failed) for r in checks.by_severity(report).collect()] == [("info", 7, 5)]


def test_predicates_of_a_query():
    of = lambda text: predicates_of(parse(text).where)
    assert of("SELECT ?a WHERE { ?a code:x/code:y ?b OPTIONAL { ?b ^code:z ?c } FILTER NOT EXISTS { ?a code:w+ ?d } { ?a code:u ?e } UNION { ?a code:v ?e } }") == {NS + x for x in "xyzwuv"}
    assert of("SELECT ?a WHERE { ?a ?p ?b }") is None and of("SELECT ?a WHERE { ?a code:x* ?b }") is None
    assert of("SELECT ?a WHERE { ?a code:x ?b FILTER EXISTS { ?a ?p ?b } }") is None


def test_stored_triples_are_pruned_by_predicate(spark, tmp_path):
    rows = [(f"m{k}", p, str(k % 5)) for k in range(50) for p in ("name", "layer", "tags")] + [("m1", "http://x/#a b", "é")]
    t = triples(spark, rows)
    store.save(t, str(tmp_path / "s"), 3)
    back = store.load(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    star = sparql(back, 'SELECT ?m WHERE { ?m code:name "1" ; code:layer ?l }')
    assert star.count() == 10
    plan = star._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(predicate") == 2, "each pattern reads its own predicate"


def test_patterns_read_their_own_branch(spark):
    from tessera.sources.tables import by_predicate

    sf = "/root/testdata/sf0.001"
    star = sparql(by_predicate(spark, sf), 'SELECT ?m ?n WHERE { ?m code:language "BUILDING" ; code:layer "customer" ; code:name ?n }')
    plan = star._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 0, "no list is unpivoted for a scalar"
    assert "supplier" not in plan.split("c_mktsegment")[0] or plan.count("o_orderstatus") <= 2


def test_numbered_pages(spark):
    df = spark.range(95).repartition(4)
    p = pages.numbered_page(df, ["id"], 3, 40)
    assert ([r.id for r in p.rows], p.total, p.before, p.next, p.previous) == (list(range(80, 95)), 95, 80, None, 2)
    assert pages.numbered_page(spark.range(95), ["id"], 1, 10).total == 95, "a sorted input is counted to its end"
    p = pages.numbered_page(df, ["id"], 9, 40)
    assert (p.rows, p.total, p.next) == ([], 95, None)
    p = pages.numbered_page(df.where("id < 0"), ["id"])
    assert (p.rows, p.total, p.before, p.next, p.previous) == ([], 0, 0, None, None)
    with pytest.raises(ValueError):
        pages.numbered_page(df, ["id"], 1, 0)


def test_keyset_pages(spark):
    df = spark.createDataFrame([(k % 3, f"k{k:02d}") for k in range(31)], "a long, b string").repartition(3)
    want = sorted((k % 3, f"k{k:02d}") for k in range(31))
    token, met, walked = None, [], []
    while True:
        p = pages.keyset_page(df, ["a", "b"], 7, token)
        assert p.total == 31 and p.before == len(met)
        met += [tuple(r) for r in p.rows]
        walked.append(p)
        if p.next is None:
            break
        token = p.next
    assert met == want and walked[0].previous is None
    back = pages.keyset_page(df, ["a", "b"], 7, walked[3].previous)
    assert back.rows == walked[2].rows and back.before == 14
    first = pages.keyset_page(df, ["a", "b"], 7, walked[1].previous)
    assert first.rows == walked[0].rows and first.previous is None and first.before == 0
    assert pages.keyset_page(df.limit(0), ["a", "b"]).total == 0
    for bad in ("x", walked[0].next[:-6]):
        with pytest.raises(ValueError):
            pages.keyset_page(df, ["a", "b"], 7, bad)
    with pytest.raises(ValueError):
        pages.keyset_page(df, ["a"], 7, walked[0].next)
    shown = p.frame(spark, df.schema)
    assert shown.columns == ["a", "b", "total", "has_previous", "has_next"] and shown.first().has_previous


def side(path, source, **more):
    base = dict.fromkeys(("uri", "name", "language", "layer", "hash", "updated_at")) | {"path": path, "source": source, "tags": [], "concepts": [], "exports": [], "triples": [], "relations": None, "annotations": {}, "properties": {}}
    return base | more


def test_shadow_relations_by_time_and_sync(spark):
    import datetime

    at = lambda n: datetime.datetime(2024, 1, n)
    old = spark.createDataFrame([side("a", "manual", name="old", updated_at=at(2), relations=[("linksTo", "x", "out", "manual"), ("linksTo", "y", "out", "auto"), ("calls", "x", "out", "auto")]), side("b", "auto")], shadow.SCHEMA)
    new = spark.createDataFrame([side("a", "auto", name="new", updated_at=at(1), relations=[("linksTo", "x", "out", "auto"), ("linksTo", "y", "out", "manual"), ("linksTo", "x", "in", "auto")])], shadow.SCHEMA)
    rel = lambda df: sorted(tuple(x) for x in df.where("path = 'a'").first().relations)
    plain = shadow.merge(old, new)
    assert plain.where("path = 'a'").first().name == "new"
    assert rel(plain) == [("calls", "x", "out", "auto"), ("linksTo", "x", "in", "auto"), ("linksTo", "x", "out", "manual"), ("linksTo", "y", "out", "manual")]
    assert rel(shadow.merge(old, new, preserve_manual=False))[2] == ("linksTo", "x", "out", "auto")
    timed = shadow.merge(old, new, by_time=True)
    assert timed.where("path = 'a'").first().name == "old" and timed.where("path = 'b'").count() == 1
    more = shadow.relate(shadow.relate(old, "b", "uses", "z"), "b", "uses", "z")
    assert [tuple(x) for x in more.where("path = 'b'").first().relations] == [("uses", "z", "out", "manual")]
    held = spark.createDataFrame([side("same", "auto", hash="1"), side("changed", "auto", hash="1", name="was"), side("mixed", "manual", hash="1", name="was", annotations={"k": "v"}), side("gone", "auto", hash="1")], shadow.SCHEMA)
    now = spark.createDataFrame([side(p, "auto", hash=h, name="fresh") for p, h in (("same", "1"), ("changed", "2"), ("mixed", "2"), ("born", "1"))], shadow.SCHEMA)
    out, status = shadow.sync(held, now.select("path", "hash"), now)
    assert {r.path: r.status for r in status.collect()} == {"same": "skipped", "changed": "updated", "mixed": "merged", "born": "new", "gone": "orphan"}
    assert {r.path: (r.name, r.source, r.annotations) for r in out.collect()} == {"same": (None, "auto", {}), "changed": ("fresh", "auto", {}), "mixed": ("fresh", "mixed", {"k": "v"}), "born": ("fresh", "auto", {})}
    again, status = shadow.sync(out, now.select("path", "hash"), now)
    assert {r.status for r in status.collect()} == {"skipped"}
    t = shadow.totals(held).first()
    assert (t.entries, t.manual, t.automatic, t.triples) == (4, 1, 3, 0)


def test_diagrams_and_documents(spark, chain):
    m, e = chain
    lines = [r.value for r in diagrams.dot_impact(m, e, impact.impacted(e, spark.createDataFrame([("b",)], "path string")), "b").collect()]
    assert lines[0] == 'digraph "impact" {' and lines[-1] == "}" and '  "b" [label="B", style=filled, fillcolor="tomato"];' in lines and '  "f" -> "e";' in lines and not any('"a"' in x for x in lines)
    lines = [r.value for r in diagrams.dot_layers(m, e).collect()]
    assert lines[1:4] == ['  subgraph "cluster_unknown" { label="Layer: unknown"; style=filled; fillcolor="whitesmoke";', '    "d" [label="D"];', "  }"] and lines[-1] == "}"
    zoned = m.withColumn("zone", F.when(F.col("path") < "c", "public").otherwise("admin"))
    bad = spark.createDataFrame([("c", "b", "HIGH")], "src string, dst string, risk string")
    lines = [r.value for r in diagrams.dot_security(zoned, e, bad).collect()]
    assert '  "c" -> "b" [color=red, style=dashed, label="violation"];' in lines and '  "d" -> "b";' in lines
    odd = m.withColumn("name", F.when(F.col("path") == "a", 'say "hi" \\ [x]').otherwise(F.col("name")))
    page = {r.path: r.text for r in diagrams.with_front_matter(diagrams.markdown(odd, e), odd).collect()}
    head = page["a"].split("---\n")[1]
    assert json.loads(head.split("\n")[0].removeprefix("title: ")) == 'say "hi" \\ [x]' and "layer" not in page["d"].split("---\n")[1]
    text = "\n".join(r.value for r in diagrams.single_document(m, e).collect())
    assert text.index("- [F](#f)") < text.index("## A\n") < text.index("## F\n") and "### Used by" in text
    doc = json.loads("\n".join(r.value for r in diagrams.graph_document(odd, e, triples(spark, [("a", "x", "1")]), 'C:\\"dir"').collect()))
    assert doc["root"] == 'C:\\"dir"' and doc["statistics"] == {"modules": 6, "relationships": 5, "triples": 1} and [x["path"] for x in doc["modules"]] == list("abcdef") and doc["modules"][1]["dependencies"] == ["a"]
    assert json.loads("".join(r.value for r in diagrams.graph_document(m.limit(0), e, triples(spark, []), "r").collect() or [type("R", (), {"value": "null"})])) is not None


def test_counts_and_limits(spark, chain):
    m, e = chain
    with_calls = m.withColumn("calls", F.array(F.lit("x"))).join(e.groupBy(F.col("src").alias("path")).agg(F.collect_list("dst").alias("dependencies")), "path", "left")
    assert tuple(ops.relationships(with_calls).first()) == (5, 6, 11) and tuple(ops.relationships(with_calls.limit(0)).first()) == (0, 0, 0)
    df = spark.createDataFrame([(f"{d}/{k}",) for d in "ab" for k in range(5)], "path string")
    assert sorted(map(tuple, ops.sample_statistics(df, df.where("path < 'a/2'")).collect())) == [("a", 5, 2), ("b", 5, 0)]
    assert sorted(map(tuple, files.focus_statistics(df, ["a/1", "a/*"]).collect()), key=str) == [("a/*", 4), ("a/1", 1), (None, 5)]
    t = triples(spark, [(f"m{k}", "name", str(k)) for k in range(9)])
    ask = "SELECT ?m WHERE { ?m code:name ?n } ORDER BY ?m"
    assert [r.m for r in sparql(t, ask, limit=2, offset=3).collect()] == ["m3", "m4"]
    assert sparql(t, ask + " LIMIT 5", limit=2).count() == 5 and sparql(t, ask).count() == 9


def test_a_hot_folder_is_cut_before_it_moves(spark):
    df = spark.range(3000).select(F.concat(F.lit("hot/"), F.col("id").cast("string")).alias("path")).unionByName(spark.createDataFrame([("cold/1",)], "path string"))
    out = ops.sample_stratified(df, 40, 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 40 and out.where("dir = 'cold'").count() == 1
    assert json.loads(results.to_json(spark.createDataFrame([("a", None), ('"', 2)], "x string, y long"))) == [{"x": "a", "y": None}, {"x": '"', "y": 2}]
    assert json.loads(results.to_json(df.limit(0))) == []


def test_validator_names_every_fault(spark):
    m = modules(spark, [("p/a", "<a>", "A", "d", "go", "x", ["t"], ["e"]), ("p/b", "b", "", "", "", "", [], []), ("p/c", None, "C", "d", "go", "x", ["t"], ["e"]), ("p/d", "<a>", "D", "d", "go", "x", ["t"], ["e"])])
    e = spark.createDataFrame([("p/a", "D"), ("p/a", "/c"), ("p/a", "nope"), ("p/c", "p/d"), ("p/d", "p/c"), *[("p/b", f"p/{x}") for x in "acd"]], "src string, dst string")
    got = {(r.check, r.path) for r in checks.validate(m, e, many=2, brackets=True).collect()}
    assert got == {
        ("missing-name", "p/b"), ("missing-uri", "p/c"), ("missing-description", "p/b"), ("missing-language", "p/b"), ("no-tags", "p/b"), ("no-exports", "p/b"), ("bare-uri", "p/b"),
        ("unknown-dependency", "p/a"), ("many-dependencies", "p/a"), ("many-dependencies", "p/b"), ("duplicate-uri", "p/a"), ("duplicate-uri", "p/d"), ("cycle", "p/c"), ("cycle", "p/d"),
    }
    assert not checks.validate(m, e).where("check = 'bare-uri'").count()
    found = checks.located(spark.createDataFrame([("p/a",), ("#b",), ("C",), ("lost",)], "module string"), m)
    assert {r.module: r.path for r in found.collect()} == {"p/a": "p/a", "#b": "p/b", "C": "p/c", "lost": None}


def test_a_shared_uri_is_told_once_a_path(spark):
    """A path whose row is repeated is one module still; alone it shares its URI with nobody."""
    rows = [(p, p, u, "d", "go", ["t"], ["x"]) for p, u in [("a", "<same>"), ("a", "<same>"), ("b", "<same>"), ("c", "<own>"), ("c", "<own>")]]
    m = spark.createDataFrame(rows, "path string, name string, uri string, description string, language string, tags array<string>, exports array<string>")
    e = spark.createDataFrame([], "src string, dst string")
    assert sorted((r.check, r.path) for r in checks.validate(m, e).collect()) == [("duplicate-uri", "a"), ("duplicate-uri", "b")]


def test_rules_are_dealt_out_by_counts(spark, monkeypatch):
    """With counts the nodes go to as many tasks as the rows need; results, and the message of a rule that finds nothing, stay."""
    from tessera.plans import compiler
    from tessera.schema import NS, RDF_TYPE

    monkeypatch.setattr(compiler, "ROWS", 20)
    rows = [(f"n{k:02d}", RDF_TYPE, f"{NS}Module") for k in range(60)] + [(f"n{k:02d}", f"{NS}tags", f"t{x}") for k in range(0, 60, 2) for x in range(2)]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    rules = [checks.Rule("untagged", "x", "SELECT ?m WHERE { ?m a code:Module . FILTER NOT EXISTS { ?m code:tags ?t } }"), checks.Rule("wanted", "x", "SELECT ?m WHERE { ?m code:exports ?e }", "info", expect=2)]
    counts = {RDF_TYPE: 60, f"{NS}tags": 60}
    for how in (None, counts):
        got = sorted((r.rule, r.severity, r.module or "", r.message) for r in checks.check_rules(t, rules, counts=how).violations.collect())
        assert got == [("untagged", "error", f"n{k:02d}", "") for k in range(1, 60, 2)] + [("wanted", "info", "", "expected 2 results")]
    stars = {r.id: checks._star(parse(r.pattern)) for r in rules}
    assert checks._stars(t, stars, counts).rdd.getNumPartitions() == 6
