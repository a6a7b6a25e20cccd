"""DOT and Mermaid diagrams, and Markdown pages, as frames of lines in order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, dir_name, escape_label, node_id

COLOURS = {"public": "lightcoral", "admin": "orange", "data": "lightblue", "internal": "lightgrey", "trusted": "lightgreen", "unknown": "white"}
RISK_COLOURS = {"CRITICAL": "red", "HIGH": "orange", "MEDIUM": "gold", "LOW": "green"}


def _lines(spark, *parts: tuple[int, DataFrame | list[str]]) -> DataFrame:
    """(value) in the order of the parts, each part sorted by its text or kept as listed."""
    out = None
    for at, part in parts:
        if isinstance(part, list):
            df = spark.createDataFrame([(at, n, x) for n, x in enumerate(part)], "part int, nth int, value string")
        else:
            df = part.select(F.lit(at).alias("part"), F.lit(0).alias("nth"), "value")
        out = df if out is None else out.unionByName(df)
    return out.orderBy("part", "nth", "value").select("value")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), escape_label(c), F.lit('"'))


def chosen(modules: DataFrame, layers: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Modules of some layers and tags, whatever the case."""
    if layers:
        modules = modules.where(F.lower("layer").isin([x.lower() for x in layers]))
    if tags:
        modules = modules.where(F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*[F.lit(t.lower()) for t in tags])))
    return modules


def dot(modules: DataFrame, edges: DataFrame, colour: Column | None = None, cluster: bool = False, title: str = "dependencies") -> DataFrame:
    """A digraph of modules and the links between them; ``cluster`` draws a box around each layer."""
    fill = F.concat(F.lit(', style=filled, fillcolor="'), colour, F.lit('"')) if colour is not None else F.lit("")
    node = F.concat(F.lit("  "), _quoted(F.col("path")), F.lit(" [label="), _quoted(F.coalesce("name", "path")), fill, F.lit("];"))
    known = modules.select("path")
    link = edges.join(known, edges.src == known.path, "left_semi").join(known, edges.dst == known.path, "left_semi")
    link = link.select(F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(";")).alias("value")).distinct()
    parts = [(0, [f'digraph "{title}" {{', "  rankdir=LR;", "  node [shape=box];"]), (1, modules.select(node.alias("value"))), (3, link), (4, ["}"])]
    if cluster:
        box = modules.groupBy("layer").agg(F.array_join(F.array_sort(F.collect_list(_quoted(F.col("path")))), "; ").alias("nodes"))
        boxed = F.concat(F.lit("  subgraph "), _quoted(F.concat(F.lit("cluster_"), node_id(F.coalesce("layer", F.lit("none"))))), F.lit(" { label="), _quoted(F.coalesce("layer", F.lit("none"))), F.lit("; "), F.col("nodes"), F.lit("; }"))
        parts.append((2, box.select(boxed.alias("value"))))
    return _lines(modules.sparkSession, *parts)


def _links(edges: DataFrame, within: DataFrame, style: Column | None = None) -> DataFrame:
    """Lines of the links between modules of ``within``."""
    both = edges.join(within.select(F.col("path").alias("src")), "src", "left_semi").join(within.select(F.col("path").alias("dst")), "dst", "left_semi")
    return both.select(F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), style if style is not None else F.lit(""), F.lit(";")).alias("value")).distinct()


def _ring(target: Column, depth: Column) -> Column:
    return F.when(target, "target").when(depth == 1, "direct").otherwise("indirect")


#: How a change's target and what it reaches are filled.
RINGS = {"target": "tomato", "direct": "orange", "indirect": "khaki"}


def _reached(modules: DataFrame, far: DataFrame, target: str) -> DataFrame:
    """(path, name, ring) of a target and all that depends on it; ``far`` holds (path, depth)."""
    near = far.groupBy("path").agg(F.min("depth").alias("depth"))
    j = modules.select("path", "name").join(near, "path", "left").where((F.col("path") == target) | F.col("depth").isNotNull())
    return j.select("path", F.coalesce("name", "path").alias("name"), _ring(F.col("path") == target, F.col("depth")).alias("ring"))


def dot_impact(modules: DataFrame, edges: DataFrame, far: DataFrame, target: str) -> DataFrame:
    """A digraph of a change: the target, its direct and its indirect dependents, by colour."""
    r = _reached(modules, far, target)
    fill = F.create_map(*[F.lit(x) for kv in RINGS.items() for x in kv])[F.col("ring")]
    node = F.concat(F.lit("  "), _quoted(F.col("path")), F.lit(" [label="), _quoted(F.col("name")), F.lit(', style=filled, fillcolor="'), fill, F.lit('"];'))
    return _lines(modules.sparkSession, (0, ['digraph "impact" {', "  rankdir=LR;", "  node [shape=box];"]), (1, r.select(node.alias("value"))), (2, _links(edges, r)), (3, ["}"]))


def mermaid_impact(modules: DataFrame, edges: DataFrame, far: DataFrame, target: str) -> DataFrame:
    """The same as a flowchart, with a class for each ring."""
    r = _reached(modules, far, target)
    node = F.concat(F.lit("  "), node_id(F.col("path")), F.lit('["'), F.replace(F.col("name"), F.lit('"'), F.lit("#quot;")), F.lit('"]:::'), F.col("ring"))
    inside = edges.join(r.select(F.col("path").alias("src")), "src", "left_semi").join(r.select(F.col("path").alias("dst")), "dst", "left_semi")
    link = inside.select(F.concat(F.lit("  "), node_id(F.col("src")), F.lit(" --> "), node_id(F.col("dst"))).alias("value")).distinct()
    return _lines(modules.sparkSession, (0, ["flowchart LR"]), (1, r.select(node.alias("value"))), (2, link), (3, [f"  classDef {k} fill:{v};" for k, v in RINGS.items()]))


def _clusters(modules: DataFrame, group: Column, title: Column, fill: Column) -> DataFrame:
    """(value): the opening, the nodes and the end of a box for each group, in order of the groups."""
    m = modules.select(F.coalesce(F.nullif(group, F.lit("")), F.lit("unknown")).alias("g"), "path", F.coalesce("name", "path").alias("name"), title.alias("title"), fill.alias("fill"))
    head = m.groupBy("g").agg(F.min("title").alias("title"), F.min("fill").alias("fill")).select("g", F.lit(0).alias("at"), F.lit("").alias("path"), F.concat(F.lit("  subgraph "), _quoted(F.concat(F.lit("cluster_"), node_id(F.col("g")))), F.lit(" { label="), _quoted(F.col("title")), F.lit("; style=filled; fillcolor="), _quoted(F.col("fill")), F.lit(";")).alias("value"))
    body = m.select("g", F.lit(1).alias("at"), "path", F.concat(F.lit("    "), _quoted(F.col("path")), F.lit(" [label="), _quoted(F.col("name")), F.lit("];")).alias("value"))
    tail = head.select("g", F.lit(2).alias("at"), "path", F.lit("  }").alias("value"))
    return head.unionByName(body).unionByName(tail)


def _boxed(title: str, boxes: DataFrame, links: DataFrame) -> DataFrame:
    spark = boxes.sparkSession
    fixed = spark.createDataFrame([(0, f'digraph "{title}" {{'), (3, "}")], "part int, value string")
    none = lambda df, part: df.select(F.lit(part).alias("part"), F.lit("").alias("g"), F.lit(0).alias("at"), F.lit("").alias("path"), "value")
    out = boxes.select(F.lit(1).alias("part"), "g", "at", "path", "value").unionByName(none(links, 2))
    out = out.unionByName(fixed.select("part", F.lit("").alias("g"), F.lit(0).alias("at"), F.lit("").alias("path"), "value"))
    return out.orderBy("part", "g", "at", "path", "value").select("value")


def dot_layers(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """A digraph with a box for each layer, its modules inside."""
    layer = F.coalesce(F.nullif(F.col("layer"), F.lit("")), F.lit("unknown"))
    return _boxed("layers", _clusters(modules, layer, F.concat(F.lit("Layer: "), layer), F.lit("whitesmoke")), _links(edges, modules))


def dot_security(zoned: DataFrame, edges: DataFrame, violated: DataFrame) -> DataFrame:
    """A digraph with a box for each zone; links that break the rules are red and dashed."""
    e = edges.select("src", "dst").distinct().join(violated.select("src", "dst", F.lit(True).alias("bad")).distinct(), ["src", "dst"], "left")
    style = F.when(F.col("bad"), ' [color=red, style=dashed, label="violation"]').otherwise("")
    return _boxed("zones", _clusters(zoned, F.col("zone"), F.concat(F.initcap("zone"), F.lit(" zone")), zone_colour()), _links(e, zoned, style))


def zone_colour() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), F.col("zone")), F.lit("white"))


def mermaid(modules: DataFrame, edges: DataFrame, kind: str = "flowchart LR", fence: bool = False) -> DataFrame:
    node = F.concat(F.lit("  "), node_id(F.col("path")), F.lit('["'), F.replace(F.coalesce("name", "path"), F.lit('"'), F.lit("#quot;")), F.lit('"]'))
    link = F.concat(F.lit("  "), node_id(F.col("src")), F.lit(" --> "), node_id(F.col("dst")))
    head, tail = ([*(["```mermaid"] if fence else []), kind], ["```"] if fence else [])
    parts = [(0, head), (1, modules.select(node.alias("value"))), (2, edges.select(link.alias("value")).distinct())]
    return _lines(modules.sparkSession, *parts, *([(3, tail)] if tail else []))


def mermaid_classes(modules: DataFrame, edges: DataFrame) -> DataFrame:
    members = F.concat_ws("\n", F.concat(F.lit("  class "), node_id(F.col("path")), F.lit(" {")), F.array_join(F.transform("exports", lambda x: F.concat(F.lit("    +"), x)), "\n"), F.lit("  }"))
    link = F.concat(F.lit("  "), node_id(F.col("src")), F.lit(" ..> "), node_id(F.col("dst")))
    return _lines(modules.sparkSession, (0, ["classDiagram"]), (1, modules.select(members.alias("value"))), (2, edges.select(link.alias("value")).distinct()))


def markdown(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, text): a page for each module, dependents looked up by path."""
    deps = edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    users = edges.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("users"))
    empty = F.array().cast("array<string>")
    m = modules.join(deps, "path", "left").join(users, "path", "left")
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    facts = F.concat_ws("\n", *[F.concat(F.lit(f"- {c}: "), F.col(c)) for c in ("language", "layer")], F.when(F.size("tags") > 0, F.concat(F.lit("- tags: "), F.array_join("tags", ", "))))
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("name", "path")), F.lit(""), F.col("description"), facts, part("Exports", F.col("exports")), part("Dependencies", F.coalesce("deps", empty)), part("Used by", F.coalesce("users", empty)))
    return m.select("path", F.concat(text, F.lit("\n")).alias("text"))


def with_front_matter(pages: DataFrame, modules: DataFrame) -> DataFrame:
    """Pages of ``markdown`` with a block of title, path, language, layer and tags in front."""
    # A quoted text is what JSON makes of an array of it, without the brackets.
    line = lambda k, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{k}: "), F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.to_json("tags")))
    head = F.concat_ws("\n", F.lit("---"), line("title", F.coalesce("name", "path")), line("path", F.col("path")), line("language", F.col("language")), line("layer", F.col("layer")), tags, F.lit("---"), F.lit(""))
    return pages.join(modules.select("path", head.alias("__head")), "path").select("path", F.concat("__head", "text").alias("text"))


def overview(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): lines with the number of modules and links, and the modules of each layer and language."""
    count = lambda df, label: df.agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(f"- {label}: "), F.col("n").cast("string")).alias("value"))
    by = lambda c: modules.groupBy(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("| "), F.col("k"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("value"))
    head = lambda c: ["", f"## By {c}", "", f"| {c} | modules |", "| --- | --- |"]
    return _lines(modules.sparkSession, (0, ["# Overview", ""]), (1, count(modules, "modules")), (2, count(edges.select("src", "dst").distinct(), "links")), (3, head("layer")), (4, by("layer")), (5, head("language")), (6, by("language")))


def single_document(modules: DataFrame, edges: DataFrame, title: str = "Modules") -> DataFrame:
    """(value): the whole documentation as lines in order: a table of contents, then every module by path.

    Headings of the pages move one level down.  The lines stay distributed; ``write`` saves them.
    """
    spark = modules.sparkSession
    pages = markdown(modules, edges)
    body = pages.select(F.lit(2).alias("part"), "path", F.posexplode(F.split(F.regexp_replace("text", "(?m)^#", "##"), "\n")).alias("nth", "value"))
    toc = modules.select(F.lit(1).alias("part"), "path", F.lit(0).alias("nth"), F.concat(F.lit("- ["), F.coalesce("name", "path"), F.lit("](#"), node_id(F.lower(F.coalesce("name", "path"))), F.lit(")")).alias("value"))
    head = spark.createDataFrame([(0, "", n, x) for n, x in enumerate([f"# {title}", ""])], "part int, path string, nth int, value string")
    return head.unionByName(toc).unionByName(body).orderBy("part", "path", "nth").select("value")


def graph_document(modules: DataFrame, edges: DataFrame, triples: DataFrame, root: str) -> DataFrame:
    """(value): lines of one JSON document: root, statistics, and the modules by path, one a line."""
    links = edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))
    empty = F.array().cast("array<string>")
    m = modules.join(links, "path", "left").withColumn("dependencies", F.coalesce("dependencies", empty))
    numbers = m.agg(F.count(F.lit(1)).alias("modules"), F.coalesce(F.sum(F.size("dependencies")), F.lit(0)).alias("relationships"), F.min("path").alias("__least"))
    numbers = numbers.crossJoin(triples.agg(F.count(F.lit(1)).alias("triples")))
    head = numbers.select(F.lit(0).alias("part"), F.lit("").alias("path"), F.concat(F.lit(f'{{"root": {json.dumps(root)}, "statistics": '), F.to_json(F.struct("modules", "relationships", "triples")), F.lit(', "modules": [')).alias("value"))
    row = F.to_json(F.struct(*[c for c in ("path", "uri", "name", "description", "language", "layer", "tags", "exports", "dependencies") if c in m.columns]))
    body = m.crossJoin(F.broadcast(numbers.select("__least"))).select(F.lit(1).alias("part"), "path", F.concat(F.when(F.col("path") == F.col("__least"), "").otherwise(","), row).alias("value"))
    tail = head.select(F.lit(2).alias("part"), "path", F.lit("]}").alias("value"))
    return head.unionByName(body).unionByName(tail).orderBy("part", "path").select("value")


def markdown_index(modules: DataFrame) -> DataFrame:
    """(dir, text): a table of contents for each directory."""
    item = F.concat(F.lit("- ["), F.coalesce("name", "path"), F.lit("]("), base_name(F.col("path")), F.lit(".md)"))
    return modules.groupBy(dir_name(F.col("path")).alias("dir")).agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("items")).select("dir", F.concat(F.lit("# "), F.col("dir"), F.lit("\n\n"), F.col("items"), F.lit("\n")).alias("text"))


def graphql_schema(df: DataFrame, name: str = "Module") -> str:
    """A type, its query and a connection, from the columns of a frame."""
    kinds = {"string": "String", "bigint": "Int", "int": "Int", "double": "Float", "boolean": "Boolean", "array<string>": "[String!]!"}
    fields = "\n".join(f"  {c}: {kinds.get(t, 'String')}" for c, t in df.dtypes)
    return (
        f"type {name} {{\n{fields}\n}}\n\ntype {name}Connection {{\n  nodes: [{name}!]!\n  totalCount: Int!\n  hasNextPage: Boolean!\n  endCursor: String\n}}\n\n"
        f"type Query {{\n  {name.lower()}(path: String!): {name}\n  {name.lower()}s(first: Int, after: String): {name}Connection!\n  search(text: String!): [{name}!]!\n}}\n"
    )


def report(df: DataFrame, format: str = "text", title: str = "report") -> str:
    """Violations or differences as text, JSON, Markdown or JUnit XML, by severity or status."""
    key = next(c for c in ("severity", "status", "risk", "rule", df.columns[0]) if c in df.columns)
    rows = [r.asDict(recursive=True) for r in df.orderBy(key, *[c for c in df.columns if c in ("rule", "path", "module")]).toLocalIterator()]
    if format == "json":
        return json.dumps({"title": title, "count": len(rows), "rows": rows}, default=str)
    if format == "junit":
        from xml.sax.saxutils import escape, quoteattr

        cases = "".join(f"<testcase name={quoteattr(str(r.get('rule') or r.get('path')))}><failure type={quoteattr(str(r[key]))}>{escape(str(r))}</failure></testcase>" for r in rows)
        return f'<testsuite name={quoteattr(title)} tests="{len(rows)}" failures="{len(rows)}">{cases}</testsuite>'
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(str(r[key]), []).append(r)
    mark = ("## ", "- ") if format == "markdown" else ("", "  ")
    out = [("# " if format == "markdown" else "") + title]
    for k, rs in groups.items():
        out += [f"{mark[0]}{k} ({len(rs)})", *(mark[1] + ", ".join(f"{c}={v}" for c, v in r.items() if c != key and v not in (None, "", [])) for r in rs)]
    return "\n".join(out) + "\n"
