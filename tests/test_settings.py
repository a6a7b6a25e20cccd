"""Settings from YAML, and kept results."""

import os

import pytest

from tessera.config import Config, load_config, parse_config
from tessera.operators.result_cache import ResultCache, Statistics


def test_settings(spark, tmp_path):
    assert load_config(str(tmp_path / "none.yaml")) == Config()
    c = parse_config("version: 1\nscan:\n  include: ['**/*.py']\n  exclude: ['**/skip/**', '*.gen.py']\n  max_file_size: 50\nquery: {default_limit: 2, timeout: 1m30s}\n")
    assert c.query.timeout == 90 and c.scan.max_file_size == 50
    for bad in ("nope: 1", "scan: {include: 5}", "query: {timeout: soon}", "version: 2", "scan: [1]", "query: {default_limit: -1}"):
        with pytest.raises(ValueError):
            parse_config(bad)
    for p, text in {"a.py": "x", "skip/b.py": "x", "d/skip/e.py": "x", "d/f.gen.py": "x", "d/g.go": "x", "d/h.py": "y" * 60, "d/i.py": "z"}.items():
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text(text)
    assert sorted(r.path for r in c.files(spark, str(tmp_path / "t")).collect()) == ["a.py", "d/i.py"]
    t = spark.createDataFrame([(f"s{k}", "urn:code:name", str(k)) for k in range(5)], "subject string, predicate string, object string")
    ask = "SELECT ?s WHERE { ?s code:name ?n } ORDER BY ?s"
    assert [r.s for r in c.ask(t, ask).collect()] == ["s0", "s1"] and c.ask(t, ask + " LIMIT 4").count() == 4


def test_results_are_kept_for_a_while(spark, tmp_path):
    now, made = [0.0], []

    def make(text):
        made.append(text)
        return spark.range(len(text))

    cache = ResultCache(spark, str(tmp_path), entries=2, seconds=10, clock=lambda: now[0])
    assert cache.ask("abc", make).count() == 3 and cache.ask(" abc ", make).count() == 3 and made == ["abc"]
    assert cache.ask("abc", make, version=2).count() == 3 and len(made) == 2
    cache.ask("abc", make)
    cache.ask("abcd", make)  # the result of version 2 was used longest ago
    assert cache.get("abc") is not None and cache.get("abc", 2) is None and len(os.listdir(tmp_path)) == 2
    now[0] = 10.0
    assert cache.get("abc") is None and cache.ask("abc", make).count() == 3 and made.count("abc") == 3
    assert cache.statistics() == Statistics(hits=3, misses=6, evictions=1, entries=2)
    cache.clear()
    assert os.listdir(tmp_path) == [] and cache.get("abcd") is None
