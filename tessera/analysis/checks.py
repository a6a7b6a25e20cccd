"""Validation of graphs, rules over triples, and differences between snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph.algorithms import cyclic_nodes
from ..operators import store
from ..operators.modules import duplicates
from ..plans.ast import Const, Group, Path, Select, Var
from ..plans.compiler import predicates_of, shares, sparql
from ..plans.parser import parse
from ..session import shared_folder
from ..sources.turtle import resolve_edges


def validate(modules: DataFrame, edges: DataFrame, many: int = 10, brackets: bool = False) -> DataFrame:
    """(severity, check, path, message): errors and warnings.

    One pass over the modules makes the checks of single modules.  A dependency is known if it is
    the path, URI or name of a module or the end of a path; each unknown one is a row.  URIs are
    held bare here; ``brackets`` warns of them for sources that should keep their angle brackets.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    single = [("error", "missing-name", empty("name")), ("error", "missing-uri", empty("uri")), ("warning", "missing-description", empty("description")), ("warning", "missing-language", empty("language")), ("warning", "no-tags", none("tags")), ("warning", "no-exports", none("exports"))]
    if brackets:
        single.append(("warning", "bare-uri", ~empty("uri") & ~F.coalesce(F.col("uri").rlike("^<.*>$"), F.lit(False))))
    said = {"missing-name": "the name is missing", "missing-uri": "the URI is missing", "missing-description": "the description is missing", "missing-language": "the language is missing", "no-tags": "there are no tags", "no-exports": "there are no exports", "bare-uri": "the URI stands without angle brackets"}
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("check"), F.lit(said[n]).alias("message"))) for s, n, c in single]), lambda x: x.isNotNull())
    out = modules.select("path", F.explode(found).alias("f")).select("f.severity", "f.check", "path", "f.message")
    e = edges.select("src", "dst").distinct()
    links = e.select(F.col("src").alias("subject"), F.lit("linksTo").alias("predicate"), F.col("dst").alias("object"))
    lost = resolve_edges(links, modules).where("NOT resolved").select(F.col("src").alias("path"), F.concat(F.lit("no module fits "), F.col("dst")).alias("message"))
    parts = [("warning", "unknown-dependency", lost)]
    busy = e.groupBy(F.col("src").alias("path")).count().where(F.col("count") > many)
    parts.append(("warning", "many-dependencies", busy.select("path", F.concat(F.col("count").cast("string"), F.lit(" dependencies")).alias("message"))))
    # A path is one module, however many rows it has.
    shared = duplicates(modules.where(~empty("uri"))).distinct().select("path", F.concat(F.lit("several modules have the URI "), F.col("uri")).alias("message"))
    parts.append(("error", "duplicate-uri", shared))
    parts.append(("error", "cycle", cyclic_nodes(edges).select(F.col("node").alias("path"), F.concat(F.lit("in the cycle of "), F.col("component")).alias("message"))))
    for severity, check, df in parts:
        out = out.unionByName(df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), "path", "message"))
    return out


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    severity: str = "error"
    expect: int = 0
    enabled: bool = True
    tags: tuple[str, ...] = ()
    description: str = ""
    suggestion: str = ""


SEVERITIES = ["info", "warning", "error"]

# The ids of the built-in rules.
BUILT_IN = [
    Rule("no-circular-dependencies", "No two modules depend on each other", "SELECT ?module1 ?module2 WHERE { ?module1 code:linksTo ?module2 . ?module2 code:linksTo ?module1 FILTER(?module1 != ?module2) }", tags=("architecture",)),
    Rule("exports-documented", "Modules with exports have a description", "SELECT ?module WHERE { ?module code:exports ?export . FILTER NOT EXISTS { ?module code:description ?text } }", "warning", tags=("documentation",)),
    Rule("modules-have-layer", "Modules have a layer", "SELECT ?module WHERE { ?module a code:Module . FILTER NOT EXISTS { ?module code:layer ?layer } }", "warning", tags=("architecture",)),
    Rule("modules-have-tags", "Modules have tags", "SELECT ?module WHERE { ?module a code:Module . FILTER NOT EXISTS { ?module code:tags ?tag } }", "info", tags=("documentation",)),
]


def parse_rules(text: str) -> list[Rule]:
    """Rules from YAML: a version, one rule at least, unique ids, known severities; patterns must parse."""
    import yaml

    data = yaml.safe_load(text) or {}
    if not data.get("version") or not data.get("rules"):
        raise ValueError("a rule file needs a version and rules")
    out = []
    for r in data["rules"]:
        missing = [k for k in ("id", "name", "pattern") if not r.get(k)]
        if missing:
            raise ValueError(f"a rule lacks {missing}")
        rule = Rule(r["id"], r["name"], r["pattern"], r.get("severity", "error"), int(r.get("expect", 0)), bool(r.get("enabled", True)), tuple(r.get("tags") or ()), r.get("description", ""), r.get("suggestion", ""))
        if rule.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {rule.severity}")
        parse(rule.pattern)
        out.append(rule)
    if len({r.id for r in out}) < len(out):
        raise ValueError("rule ids repeat")
    return out


@dataclass
class Report:
    summary: DataFrame
    violations: DataFrame
    skipped: list[str] = field(default_factory=list)


def _star(q: Select) -> tuple[list, list] | None:
    """The (predicate, object or None) pairs that a node must have, and those it must not, where a
    query asks for nothing else and returns the node alone; None for other queries."""
    if len(q.variables) != 1 or q.variables[0][1] is not None or q.distinct or q.group_by or q.having or q.order_by or q.limit is not None or q.offset is not None:
        return None
    node, met = q.variables[0][0], set()

    def keys(group: Group) -> list | None:
        out = []
        for kind, *rest in group.elements:
            for t in rest[0] if kind == "triples" else []:
                if t.s != Var(node) or not isinstance(t.p, Path) or t.p.op != "link" or isinstance(t.o, Var) and (t.o.name in met or t.o.name == node):
                    return None
                met.update([t.o.name] if isinstance(t.o, Var) else [])
                out.append((t.p.iri, t.o.value if isinstance(t.o, Const) else None))
        return out

    has, lacks = keys(q.where), []
    for kind, *rest in q.where.elements:
        if kind == "triples":
            continue
        e = rest[0]
        if kind != "filter" or e.op != "!" or e.args[0].op != "exists" or any(x[0] != "triples" for x in e.args[0].args[0].elements):
            return None
        none = keys(e.args[0].args[0])
        if none is None or len(none) != 1:
            return None
        lacks += none
    return (has, lacks) if has else None


def _stars(triples: DataFrame, stars: dict[str, tuple[list, list]], counts: dict[str, int] | None = None) -> DataFrame:
    """(rule, module, n) of all star rules: one scan, and one aggregate of a node's matches by pattern.

    Where ``counts`` tell of many rows, these are dealt out by node first, so that neither the reading
    tasks nor those of the aggregate gather more nodes as the input grows.
    """
    patterns = sorted({k for has, lacks in stars.values() for k in [*has, *lacks]}, key=str)
    name = {k: f"__{i}" for i, k in enumerate(patterns)}
    fits = {k: (F.col("predicate") == k[0]) & (F.lit(True) if k[1] is None else F.col("object") == k[1]) for k in patterns}
    named = sorted({k[0] for k in patterns})
    seen = triples.where(F.col("predicate").isin(named)).select("subject", *[c.alias(name[k]) for k, c in fits.items()])
    if n := shares(sum((counts or {}).get(p, 0) for p in named)):
        seen = seen.repartition(n, "subject")
    seen = seen.groupBy("subject").agg(*[F.count_if(c).alias(c) for c in name.values()])
    rows = []
    for rule, (has, lacks) in stars.items():
        n = F.lit(1).cast("long")
        for k in has:
            n = n * F.col(name[k])
        for k in lacks:
            n = F.when(F.col(name[k]) == 0, n).otherwise(0)
        rows.append(F.struct(F.lit(rule).alias("rule"), n.alias("n")))
    return seen.select(F.col("subject").alias("module"), F.explode(F.filter(F.array(*rows), lambda x: x["n"] > 0)).alias("x")).select("x.rule", "module", "x.n")


def check_rules(triples: DataFrame, rules: list[Rule], least: str = "info", tags: set[str] | None = None, counts: dict[str, int] | None = None) -> Report:
    """Results of all rules: (rule, severity, found, expect, passed), and one violation a row that a
    failed rule found, or one message where it found none but expected some.

    Rules about single nodes share one scan and one aggregate, however many they are.  Where several
    others are left, the predicates that they name are written once, parted by predicate, and each
    rule reads only its own.
    """
    chosen = [r for r in rules if r.enabled and SEVERITIES.index(r.severity) >= SEVERITIES.index(least) and (not tags or tags & set(r.tags))]
    spark, found = triples.sparkSession, None
    parsed = {r.id: parse(r.pattern) for r in chosen}
    stars = {k: s for k, q in parsed.items() if (s := _star(q))}
    others = [r for r in chosen if r.id not in stars]
    if stars:
        node = F.create_map(*[F.lit(x) for k in stars for x in (k, parsed[k].variables[0][0])])
        each = _stars(triples, stars, counts).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        found = each.select("rule", "module", F.to_json(F.map_from_arrays(F.array(node[F.col("rule")]), F.array("module"))).alias("details"))
    if len(others) > 1:
        named = [predicates_of(parsed[r.id].where) for r in others]
        mine = triples if None in named else triples.where(F.col("predicate").isin(sorted(set().union(*named))))
        folder = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
        store.save(mine, folder)
        triples = store.load(spark, folder)
    for r in others:
        rows = sparql(triples, r.pattern, counts)
        module = next((c for c in rows.columns if "module" in c.lower() or "source" in c.lower()), rows.columns[0])
        rows = rows.select(F.lit(r.id).alias("rule"), F.col(module).cast("string").alias("module"), F.to_json(F.struct(*rows.columns)).alias("details"))
        found = rows if found is None else found.unionByName(rows)
    meta = spark.createDataFrame([(r.id, r.severity, r.expect, r.suggestion) for r in chosen], "rule string, severity string, expect long, suggestion string")
    if found is None:
        found = spark.createDataFrame([], "rule string, module string, details string")
    n = found.groupBy("rule").agg(F.count(F.lit(1)).alias("found"))
    summary = meta.join(n, "rule", "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("passed", F.col("found") == F.col("expect"))
    failed = summary.where("NOT passed").select("rule", "severity", "suggestion", "found", "expect")
    # The few failed rules go to what was found: the violations of a rule stay where they are.
    rows = found.join(F.broadcast(failed), "rule").unionByName(failed.where("found = 0"), allowMissingColumns=True)
    message = F.when(F.col("module").isNull(), F.concat(F.lit("expected "), F.col("expect"), F.lit(" results"))).otherwise("")
    return Report(summary.select("rule", "severity", "found", "expect", "passed"), rows.select("rule", "severity", "module", message.alias("message"), "suggestion", "details"), [r.id for r in rules if r not in chosen])


def by_severity(report: Report) -> DataFrame:
    """(severity, rules, failed, found) of the rules that ran."""
    return report.summary.groupBy("severity").agg(F.count(F.lit(1)).alias("rules"), F.count_if(~F.col("passed")).alias("failed"), F.sum("found").cast("long").alias("found"))


def located(rows: DataFrame, modules: DataFrame, key: str = "module") -> DataFrame:
    """``rows`` with the ``path`` of the module that ``key`` names: its path, else its URI, else its name.

    A URI matches with or without its leading ``#``.  The least path is taken of several, null if none fits.
    """
    bare = lambda c: F.regexp_replace(c, "^#", "")
    by = lambda c, name: modules.where(c != "").groupBy(c.alias("__key")).agg(F.min("path").alias(name))
    out = rows.withColumn("__key", F.col(key))
    out = out.join(by(F.col("path"), "__p"), "__key", "left").withColumn("__bare", bare(F.col("__key")))
    out = out.join(by(bare(F.col("uri")), "__u").withColumnRenamed("__key", "__bare"), "__bare", "left").join(by(F.col("name"), "__n"), "__key", "left")
    return out.withColumn("path", F.coalesce("__p", "__u", "__n")).drop("__key", "__bare", "__p", "__u", "__n")


def diff(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(path, status, added and removed dependencies and exports, old_layer, new_layer) by path.

    Modified means other dependencies, exports or layer; other columns do not count.
    """
    def side(m: DataFrame, e: DataFrame, tag: str) -> DataFrame:
        deps = e.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
        empty = F.array().cast("array<string>")
        return m.select("path", "layer", "exports").join(deps, "path", "left").select("path", F.struct(F.coalesce("layer", F.lit("")).alias("layer"), F.array_sort(F.array_distinct(F.coalesce("exports", empty))).alias("exports"), F.coalesce("deps", empty).alias("deps")).alias(tag))

    j = side(old, old_edges, "a").join(side(new, new_edges, "b"), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    less = lambda x, y, c: F.array_except(F.coalesce(F.col(f"{x}.{c}"), F.array().cast("array<string>")), F.coalesce(F.col(f"{y}.{c}"), F.array().cast("array<string>")))
    return j.select(
        "path", status.alias("status"), less("b", "a", "deps").alias("added_deps"), less("a", "b", "deps").alias("removed_deps"),
        less("b", "a", "exports").alias("added_exports"), less("a", "b", "exports").alias("removed_exports"), F.col("a.layer").alias("old_layer"), F.col("b.layer").alias("new_layer"),
    )


def diff_stats(d: DataFrame) -> DataFrame:
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
