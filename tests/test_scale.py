"""Counts without pairs, ranks without a window, versioned tables, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.analysis import shadow
from tessera.analysis.postings import PostingIndex
from tessera.graph import algorithms as g
from tessera.graph.ranks import ranked
from tessera.graph.reach import count_users, sketch_users
from tessera.sources.cache import ModuleCache
from tessera.sources.versions import ConflictError, Versions


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def reach(edges):
    users = {n: set() for e in edges for n in e}
    for root in users:
        todo = [root]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b != root and root not in users[b]:
                    users[b].add(root)
                    todo.append(b)
    return {n: len(s) for n, s in users.items()}


@pytest.mark.parametrize("seed,nodes,links,block", [(1, 30, 35, 1 << 16), (2, 90, 70, 64), (3, 25, 60, 7)])
def test_users_are_counted_exactly(spark, seed, nodes, links, block):
    """Cyclic and acyclic parts, self links, repeats, and several blocks of numbers."""
    r = random.Random(seed)
    edges = [(f"n{r.randrange(nodes):02d}", f"n{r.randrange(nodes):02d}") for _ in range(links)] + [("n01", "n01"), ("z", "n01"), ("z", "n01")]
    assert {x.node: x.users for x in count_users(frame(spark, edges), block).collect()} == reach(sorted(set(edges)))


def test_users_of_a_wide_graph_and_of_nothing(spark):
    edges = [(f"u{k}", "hub") for k in range(3000)] + [("hub", "root")]
    exact = {x.node: x.users for x in count_users(frame(spark, edges)).collect()}
    assert (exact["hub"], exact["root"], exact["u7"]) == (3000, 3001, 0)
    near = {x.node: x.users for x in sketch_users(frame(spark, edges)).collect()}
    assert abs(near["hub"] / 3000 - 1) < 0.08 and abs(near["root"] / 3001 - 1) < 0.08 and near["u7"] == 0 and near.keys() == exact.keys()
    assert count_users(frame(spark, [])).count() == 0 and sketch_users(frame(spark, [])).count() == 0


def test_ranks_need_no_window_over_all_rows(spark):
    rows = [(k * 7919 % 5000, k) for k in range(5000)]
    out = ranked(spark.createDataFrame(rows, "a long, b long"), "a", out="place")
    assert [x.place for x in out.orderBy("a").collect()] == list(range(5000))
    assert ranked(spark.createDataFrame([], "a long"), "a").count() == 0


def test_topological_order_is_that_of_a_queue(spark):
    edges = [("a", "c"), ("b", "c"), ("d", "a"), ("e", "b"), ("f", "a"), ("f", "e"), ("g", "g2")]
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"] + [("g2",)], "path string")
    got = [(x.node, x.level) for x in g.topological_order(frame(spark, edges), nodes).orderBy("position").collect()]
    assert got == [("c", 0), ("g2", 0), ("a", 1), ("b", 1), ("g", 1), ("d", 2), ("e", 2), ("f", 3)]


def test_shortest_paths_of_many_pairs(spark):
    r = random.Random(6)
    edges = sorted({(f"n{r.randrange(25):02d}", f"n{r.randrange(25):02d}") for _ in range(50)})
    pairs = [(f"n{a:02d}", f"n{b:02d}") for a in range(0, 25, 4) for b in range(25)] + [("n00", "lost"), ("lost", "n00")]

    def brute(a, b):
        level, parent = {a: 0}, {}
        front = [a]
        while front:
            step = sorted((y, x) for x, y in edges if x in front and y not in level)
            for y, x in step:
                parent[y] = min(x, parent.get(y, x))
                level[y] = 1
            front = sorted({y for y, _ in step})
        if b not in level:
            return None
        out = [b]
        while out[0] != a:
            out.insert(0, parent[out[0]])
        return out

    got = {(x.src, x.dst): x.path for x in g.shortest_paths(frame(spark, edges), frame(spark, pairs)).collect()}
    assert got == {p: brute(*p) for p in pairs if brute(*p)}
    assert g.shortest_paths(frame(spark, edges), frame(spark, [])).count() == 0


def test_versions_are_whole_and_conflicts_are_told(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.latest() == 0 and v.read("a") is None
    one = spark.createDataFrame([(1,)], "x long")
    assert v.commit([("a", one)]) == 1 and v.commit([("a", one), ("b", one)]) == 2
    assert v.read("a").count() == 2 and v.read("a", 1).count() == 1 and v.read("b", 1) is None
    with pytest.raises(ConflictError):
        v.commit([("a", one)], base=1)
    assert v.latest() == 2 and v.read("a").count() == 2
    with pytest.raises(ValueError):
        v.read("a", 9)
    assert v.commit([("a", one)], keep=False) == 3 and v.vacuum(3) == 3
    assert v.read("a").count() == 1


def test_module_cache(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame([(p, h, t) for p, h, t in rows], "path string, hash string, mtime long")
    parsed = []

    def parse(changed):
        rows = changed.collect()
        parsed.append(sorted(r.path for r in rows))
        return spark.createDataFrame([(*r, f"parsed {r.path}") for r in rows], "path string, hash string, mtime long, name string")

    cache = ModuleCache(spark, str(tmp_path / "cache"))
    assert cache.as_of() is None and cache.get(files(("a", "1", 1)))[1].count() == 1
    cache.refresh(files(("a", "1", 1), ("b", "1", 1), ("c", "1", 1)), parse)
    cache.refresh(files(("a", "2", 1), ("b", "1", 2), ("c", "1", 1), ("d", "1", 1)), parse)
    cache.refresh(files(("a", "2", 1), ("c", "1", 1), ("d", "1", 1)), parse)
    assert parsed == [["a", "b", "c"], ["a", "b", "d"], []]
    assert sorted(r.path for r in cache.as_of().collect()) == ["a", "c", "d"]
    assert sorted((r.path, r.hash) for r in cache.as_of(1).collect()) == [("a", "1"), ("b", "1"), ("c", "1")]
    hits, misses = cache.get(files(("a", "2", 1), ("c", "1", 9)))
    assert [r.path for r in hits.collect()] == ["a"] and [r.path for r in misses.collect()] == ["c"]
    cache.invalidate(spark.createDataFrame([("c",), ("unknown",)], "path string"))
    cache.compact()
    assert sorted(r.path for r in cache.as_of().collect()) == ["a", "d"]
    cache.clear()
    assert cache.as_of() is None and cache.as_of(3).count() == 3
    cache.set(spark.createDataFrame([("a", "5", 5, "n"), ("a", "5", 5, "n")], "path string, hash string, mtime long, name string"))
    assert cache.as_of().count() == 1


def test_posting_index_equals_a_rebuild(spark, tmp_path):
    """After many adds and removes, before and after compaction."""
    r = random.Random(4)

    def entries(paths):
        rows = [(p, p, None, r.choice(["go", "py", None]), r.choice(["api", ""]), r.sample(["a", "b", "c"], r.randrange(3)), r.choice([None, ["x"]]), None, "auto", None, None, None, None, None) for p in paths]
        return spark.createDataFrame(rows, shadow.SCHEMA)

    held, found = {}, PostingIndex(spark, str(tmp_path / "index"))
    assert found.lookup("tag", "a") is None
    for step in range(6):
        df = entries(r.sample([f"p{k}" for k in range(40)], 20)).cache()
        found.add(df)
        held |= {x.path: x for x in df.collect()}
        gone = r.sample(sorted(held), 5)
        found.remove(spark.createDataFrame([(p,) for p in gone], "path string"))
        held = {p: x for p, x in held.items() if p not in gone}
        if step == 3:
            found.compact()
    want = sorted(tuple(x) for x in shadow.index(spark.createDataFrame(list(held.values()), shadow.SCHEMA)).collect())
    assert sorted(tuple(x) for x in found.postings().collect()) == want
    found.compact()
    assert sorted(tuple(x) for x in found.postings().collect()) == want
    assert sorted(x.path for x in found.lookup("tag", "b").collect()) == sorted(p for k, key, p in want if (k, key) == ("tag", "b"))


def test_trees_are_folded_before_users_are_counted(spark):
    """Trees that hang on cycles and on nodes with two ways on, chains, and weights in one word."""
    from tessera.graph.reach import _folded

    tree = [(f"o{k}", f"c{k % 40}") for k in range(300)] + [(f"c{k}", f"n{k % 5}") for k in range(40)] + [(f"n{k}", f"r{k % 2}") for k in range(5)]
    weights, users, left = _folded(frame(spark, tree))
    assert left.count() == 0 and weights.count() == 2 and users.count() == 345
    edges = tree + [("r0", "x"), ("r0", "y"), ("x", "z"), ("y", "z"), ("r1", "s"), ("s", "t"), ("t", "s"), ("t", "z"), *[(f"k{n}", f"k{n + 1}") for n in range(6)]]
    assert {x.node: x.users for x in count_users(frame(spark, edges)).collect()} == reach(edges)
    near = {x.node: x.users for x in sketch_users(frame(spark, edges)).collect()}
    assert near.keys() == reach(edges).keys() and all(abs(near[n] - v) <= 1 + v * 0.08 for n, v in reach(edges).items())


def test_dense_graphs_are_contracted_and_pairs_come_from_components(spark):
    """Three dense components, one way between two of them, nodes beside; names, pairs and loops are those of brute force."""
    r = random.Random(8)
    edges = sorted({(f"{c}{r.randrange(20):02d}", f"{c}{r.randrange(20):02d}") for c in "abc" for _ in range(700)} | {("a03", "b01"), ("z", "a00"), ("b05", "y"), ("l", "l")})
    far = {n: set() for e in edges for n in e}
    for root in far:
        todo = [root]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b not in far[root]:
                    far[root].add(b)
                    todo.append(b)
    want = {n: min([n, *(m for m in s if n in far[m])]) for n, s in far.items()}
    assert {x.node: x.component for x in g.components(frame(spark, edges)).collect()} == want
    pairs = sorted((x.root, x.node) for x in g.reachable(frame(spark, edges), shares=3).collect())
    assert pairs == sorted((a, b) for a, s in far.items() for b in s)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_pairs_of_a_component_come_list_by_list(spark, limit):
    """Broadcast and shuffled lists hold all pairs once, and a node stands for a run of roots."""
    names = [f"n{k:03d}" for k in range(300)]
    edges = [e for n in names[1:] for e in ((names[0], n), (n, names[0]))] + [("x", "n005"), ("n007", "y"), ("l", "l")]
    rows = [tuple(x) for x in g.reachable(frame(spark, edges), shares=3, group=20, limit=limit).collect()]
    assert sorted(rows) == sorted([(a, b) for a in [*names, "x"] for b in [*names, "y"]] + [("l", "l")])
    assert sum(a[1] != b[1] for a, b in zip(rows, rows[1:])) < len(rows) / 5


def test_blocks_are_dealt_out_and_parsed_once(spark, tmp_path):
    """Files of one partition are parsed by many tasks, and each once, however often its triples are read."""
    from tessera.sources import turtle

    rows = [(f"d/{k}", f'<!-- RDF -->\n<#{k}> a code:Module ; code:linksTo <../e/{k % 3}> .\n<!-- End RDF -->') for k in range(40)]
    parsed = turtle.parse_files(spark.createDataFrame(rows, "path string, content string").coalesce(1))
    assert parsed.rdd.getNumPartitions() > 1
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    triples = turtle.triples_of(parsed.mapInArrow(count, parsed.schema))
    modules = spark.createDataFrame([("e/0", "u", "n"), ("x/e/1", "v", "m")], "path string, uri string, name string")
    got = {x.src: (x.dst, x.resolved) for x in turtle.resolve_edges(triples, modules).collect()}
    assert got == {f"d/{k}": (("e/0", True), ("x/e/1", True), ("e/2", False))[k % 3] for k in range(40)}
    assert seen.value == 80


def test_semi_and_anti_joins_are_dealt_out_by_counts(spark, monkeypatch):
    """With counts both sides go to as many tasks as their rows need, also over a union; results stay."""
    from tessera.plans import compiler

    monkeypatch.setattr(compiler, "ROWS", 20)
    nodes, links = [f"n{k:03d}" for k in range(120)], [(f"n{k:03d}", f"n{k * k % 40:03d}") for k in range(120)]
    t = spark.createDataFrame([(n, "type", "Module") for n in nodes[:60]], "subject string, predicate string, object string").unionByName(spark.createDataFrame([(n, "type", "Module") for n in nodes[60:]], "subject string, predicate string, object string"))
    t = t.unionByName(spark.createDataFrame([(a, "linksTo", b) for a, b in links], "subject string, predicate string, object string"))
    used, counts = {b for _, b in links}, {"type": 120, "linksTo": 120}
    for test, keep in (("FILTER NOT EXISTS", False), ("FILTER EXISTS", True), ("MINUS", False)):
        query = f"SELECT ?m WHERE {{ ?m <type> <Module> {test} {{ ?u <linksTo> ?m }} }}"
        df = compiler.sparql(t, query, counts)
        want = [n for n in nodes if (n in used) == keep]
        assert sorted(r.m for r in df.collect()) == want == sorted(r.m for r in compiler.sparql(t, query).collect())
        assert df.rdd.getNumPartitions() == 12
    both = compiler.sparql(t, "SELECT ?a ?b WHERE { ?a <linksTo> ?b . ?b <linksTo> ?a }", counts)
    assert sorted(map(tuple, both.collect())) == sorted((a, b) for a, b in links if (b, a) in links)
    assert both.rdd.getNumPartitions() == 12


def test_counts_of_the_tables(spark):
    from tessera.plans.compiler import predicate_counts
    from tessera.sources import tables

    d = "/root/testdata/sf0.001"
    told, held = tables.counts(spark, d), predicate_counts(tables.triples(spark, d))
    assert told.keys() == held.keys()
    assert all(told[p] == n for p, n in held.items() if p.endswith(("linksTo", "type", "layer", "name", "language")))
