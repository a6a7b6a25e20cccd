"""Scans that prune, and a watcher that keeps a cache up to date."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators.modules import sample_hash
from tessera.sources import files, tree, turtle
from tessera.sources.cache import ModuleCache
from tessera.streaming import watch

DOC = '<!-- RDF -->\n@prefix code: <urn:code:> .\n<#{0}> a code:Module ; code:name "{0}" .\n<!-- End RDF -->\n'


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "tree"
    for path, text in {
        "main.py": "plain", "src/a.py": "x = 1\n", "src/deep/b.go": "package b", "src/deep/more/c.ts": "", "src/notes.txt": "unknown language", "node_modules/lib/x.js": "ignored",
        "src/big.py": "#" * 5000, "src/open.py": "<!-- RDF -->", "build/out.py": "ignored", "docs/d.py": "<!-- End RDF --> <!-- RDF -->", "src/.git/h.py": "ignored",
    }.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    os.utime(top / "src/a.py", (1000, 1000))
    return top


def test_scan_prunes_and_tells_errors(spark, root):
    for p in ("node_modules", "build", "src/.git"):
        os.chmod(root / p, 0)  # for a user that is not root, opening one of these would be an error
    out = tree.scan_tree(spark, str(root), max_size=4000)
    rows = {r.path: r for r in out.collect()}
    assert sorted(rows) == ["docs/d.py", "main.py", "src/a.py", "src/deep/b.go", "src/deep/more/c.ts", "src/open.py"]
    assert rows["src/deep/b.go"].language == "Go" and rows["main.py"].content == "plain" and rows["src/deep/more/c.ts"].content == ""
    assert {p: r.error for p, r in rows.items() if r.error} == {"src/open.py": "the metadata block is not closed", "docs/d.py": "the end marker comes before the start"}
    assert sorted(r.path for r in tree.scan_tree(spark, str(root), focus=["src/deep/**"]).collect()) == ["src/deep/b.go", "src/deep/more/c.ts"]
    assert sorted(r.path for r in tree.scan_tree(spark, str(root), since=2000.0, focus=["src/*.py"]).collect()) == ["src/big.py", "src/open.py"]
    assert tree.scan_tree(spark, str(root / "docs"), ignore=["*.py"]).count() == 0


def test_ignored_folders_are_never_opened(root, monkeypatch):
    opened = []
    t = tree.Tree(str(root), tree.Rules())
    real = t.entries
    monkeypatch.setattr(t, "entries", lambda folder: opened.append(folder) or real(folder))
    assert sorted(p for p, *_ in t.walk("", True)) == ["docs/d.py", "main.py", "src/a.py", "src/big.py", "src/deep/b.go", "src/deep/more/c.ts", "src/open.py"]
    assert sorted(opened) == ["", "docs", "src", "src/deep", "src/deep/more"]
    focused, opened[:] = tree.Tree(str(root), tree.Rules(focus=("src/deep/*.go",))), []
    real2 = focused.entries
    focused.entries = lambda folder: opened.append(folder) or real2(folder)
    assert [p for p, *_ in focused.walk("", True)] == ["src/deep/b.go"]
    assert "docs" not in opened
    every = {(f, deep) for part in tree._split(t, 3, 1) for f, deep in part.folders}
    assert sorted(p for f, deep in every for p, *_ in t.walk(f, deep)) == sorted(p for p, *_ in t.walk("", True))


def test_filters_reach_the_source_and_rules_agree_with_columns(spark, root):
    out = tree.scan_tree(spark, str(root)).where("language = 'Python' AND path LIKE 'src/%' AND size > 5")
    assert sorted(r.path for r in out.collect()) == ["src/a.py", "src/big.py", "src/open.py"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(language" in plan and not any(x in plan for x in ("= Python", "StartsWith", "> 5"))
    names = [f"{a}{b}" for a in ("", "x/", "bin/", "a/bin/", "docs/") for b in ("bin", "a.o", "z.py", "bins/q.c", "docs/y.js", "k~")]
    for patterns in (files.IGNORED, ["docs/", "*/z.py", "bins", "a/bin", "?.o"]):
        got = {r.path for r in spark.createDataFrame([(n,) for n in names], "path string").where(~files.is_ignored(F.col("path"), patterns)).collect()}
        assert got == {n for n in names if not tree.Rules(ignore=tuple(patterns)).ignored(n, False)}


def test_strict_scans_end_at_an_error(spark, root, monkeypatch):
    lost = str(root / "nowhere")
    assert [bool(r.error) for r in tree.scan_tree(spark, lost).collect()] == [True]
    with pytest.raises(Exception):
        tree.scan_tree(spark, lost, strict=True).collect()


def test_choice_is_changed_then_focus_then_sample(spark):
    df = spark.createDataFrame([(f"d{k % 3}/f{k:02d}.py", k) for k in range(60)], "path string, mtime long")
    changed = df.where("mtime % 2 = 0").select("path")
    left = df.where("mtime % 2 = 0 AND path LIKE 'd1/%'")
    got = tree.choose(df, changed, ["d1/*"], 4, "random", 7)
    assert {r.path for r in got.collect()} == {r.path for r in sample_hash(left, 4, 7).collect()}
    assert tree.choose(df, changed, ["d1/*"], 400).count() == left.count() and tree.choose(df, sample=0).count() == 60
    assert sorted(r.mtime for r in tree.choose(df, sample=3, strategy="recent").collect()) == [57, 58, 59]
    assert tree.choose(df, sample=9, strategy="stratified").columns == df.columns
    with pytest.raises(ValueError):
        tree.choose(df, sample=1, strategy="odd")


def test_any_path_end_resolves_a_link(spark):
    m = spark.createDataFrame([("src/util/text.py", "#t", "text"), ("src/b.py", "#b", "b"), ("lib/b.py", "#c", "c")], "path string, uri string, name string")
    t = spark.createDataFrame([(f"s{k}", "urn:code:linksTo", o) for k, o in enumerate(["src/b.py", "#t", "c", "xt.py", "/b.py", "l/text.py", "none", "a very long target that no path can end in"])], "subject string, predicate string, object string")
    got = {r.src: (r.dst, r.resolved) for r in turtle.resolve_edges(t, m).collect()}
    assert got == {"s0": ("src/b.py", True), "s1": ("src/util/text.py", True), "s2": ("lib/b.py", True), "s3": ("src/util/text.py", True), "s4": ("lib/b.py", True), "s5": ("src/util/text.py", True), "s6": ("none", False), "s7": ("a very long target that no path can end in", False)}


def _rows(changed):
    """Cache rows with the triples of a file's block."""
    parsed = turtle.triples_of(turtle.parse_files(changed.select("path", "content")))
    held = parsed.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("subject", "predicate", "object"))).alias("triples"))
    return changed.select("path", "mtime", F.sha2("content", 256).alias("hash")).join(held, "path", "left")


def test_watcher_sees_changed_deleted_and_ignored_files(spark, tmp_path):
    top = tmp_path / "live"
    (top / "pkg").mkdir(parents=True)
    (top / "node_modules").mkdir()
    write = lambda p, name: (top / p).write_text(DOC.format(name))
    write("a.py", "a"), write("pkg/b.py", "b"), write("node_modules/n.js", "n")
    cache, seen = ModuleCache(spark, str(tmp_path / "cache")), []
    kept = lambda: sorted((r.path, tuple(map(tuple, r.triples))) for r in cache.as_of().collect())

    def rebuilt():
        all_ = tree.scan_tree(spark, str(top)).select("path", "mtime", "content")
        return sorted((r.path, tuple(map(tuple, r.triples))) for r in _rows(all_).collect())

    def until(path, change):
        for _ in range(300):
            if (path, change) in seen:
                return
            if q.exception():
                raise q.exception()
            time.sleep(0.2)
        raise AssertionError(f"{path} {change} not seen in {seen}")

    q = watch.watch_tree(spark, str(top), str(tmp_path / "check"), cache, _rows, on_batch=lambda b, n: seen.extend((r.path, r.change) for r in b.collect()), every="200 milliseconds")
    try:
        until("pkg/b.py", "added")
        assert kept() == rebuilt() and len(kept()) == 2
        write("pkg/c.py", "c"), write("a.py", "renamed")
        until("a.py", "changed"), until("pkg/c.py", "added")
        write("node_modules/m.js", "m")
        (top / "pkg/b.py").unlink()
        until("pkg/b.py", "deleted")
        assert kept() == rebuilt() and [p for p, _ in kept()] == ["a.py", "pkg/c.py"]
        assert not [p for p, _ in seen if "node_modules" in p] and seen.count(("a.py", "added")) == 1
    finally:
        q.stop()
