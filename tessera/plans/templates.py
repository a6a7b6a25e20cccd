"""Named, parameterised queries over modules and edges."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from .compiler import sparql


@dataclass(frozen=True)
class Template:
    name: str
    category: str
    description: str
    text: str
    variables: dict[str, str | None] = field(default_factory=dict)  # None: required

    def render(self, **values: str) -> str:
        unknown = set(values) - set(self.variables)
        if unknown:
            raise ValueError(f"{self.name} has no variables {sorted(unknown)}")
        out = self.text
        for k, default in self.variables.items():
            v = values.get(k, default)
            if v is None:
                raise ValueError(f"{self.name} needs {k}")
            if not re.fullmatch(r"[^<>\"{}\\\n]*", str(v)):
                raise ValueError(f"{k} holds characters that a query cannot")
            out = out.replace("{{" + k + "}}", str(v))
        return out


def _t(name: str, category: str, description: str, text: str, **variables: str | None) -> Template:
    return Template(name, category, description, text, variables)


BUILT_IN = [
    _t("find-dependencies", "dependencies", "What a module depends on", "SELECT ?dependency WHERE { <{{module}}> code:linksTo ?dependency }", module=None),
    _t("find-usages", "dependencies", "What depends on a module", "SELECT ?user WHERE { ?user code:linksTo <{{module}}> }", module=None),
    _t("circular-deps", "dependencies", "Pairs that depend on each other", "SELECT DISTINCT ?a ?b WHERE { ?a code:linksTo ?b . ?b code:linksTo ?a }"),
    _t("dependency-tree", "dependencies", "All that a module depends on", "SELECT DISTINCT ?dependency WHERE { <{{module}}> code:linksTo+ ?dependency }", module=None),
    _t("security-violations", "security", "Other layers reaching a trusted one", 'SELECT ?from ?to ?fromZone ?toZone WHERE { ?from code:linksTo ?to ; code:layer ?fromZone . ?to code:layer ?toZone . FILTER(?fromZone != ?toZone && ?toZone = "{{trusted}}") }', trusted="trusted"),
    _t("zone-crossings", "security", "Links between layers", "SELECT ?from ?to ?fromZone ?toZone WHERE { ?from code:linksTo ?to ; code:layer ?fromZone . ?to code:layer ?toZone . FILTER(?fromZone != ?toZone) }"),
    _t("trust-boundaries", "security", "Modules with a tag and what imports them", 'SELECT ?trusted ?importer WHERE { ?trusted code:tags "{{tag}}" . ?importer code:linksTo ?trusted }', tag="public"),
    _t("unused-exports", "analysis", "Exports of modules that nothing uses", "SELECT ?module ?export WHERE { ?module code:exports ?export . FILTER NOT EXISTS { ?user code:linksTo ?module } }"),
    _t("dead-code", "analysis", "Modules that nothing uses, outside a layer", 'SELECT ?module ?layer WHERE { ?module a code:Module ; code:layer ?layer . FILTER NOT EXISTS { ?user code:linksTo ?module } FILTER(?layer != "{{entry}}") }', entry="cli"),
    _t("complex-modules", "analysis", "Modules with many dependencies", "SELECT ?module (COUNT(?to) AS ?dependencies) WHERE { ?module code:linksTo ?to } GROUP BY ?module HAVING (COUNT(?to) > {{threshold}}) ORDER BY DESC(?dependencies) ?module", threshold="10"),
    _t("hot-paths", "analysis", "The most used modules", "SELECT ?module (COUNT(?user) AS ?users) WHERE { ?user code:linksTo ?module } GROUP BY ?module ORDER BY DESC(?users) ?module LIMIT {{limit}}", limit="10"),
    _t("layer-violations", "layers", "Links from one layer to another", 'SELECT ?from ?to ?fromLayer ?toLayer WHERE { ?from code:linksTo ?to ; code:layer ?fromLayer . ?to code:layer ?toLayer . FILTER(?fromLayer = "{{from}}" && ?toLayer = "{{to}}") }', **{"from": "data", "to": "cli"}),
    _t("layer-dependencies", "layers", "Links counted by pair of layers", "SELECT ?fromLayer ?toLayer (COUNT(*) AS ?count) WHERE { ?from code:linksTo ?to ; code:layer ?fromLayer . ?to code:layer ?toLayer . FILTER(?fromLayer != ?toLayer) } GROUP BY ?fromLayer ?toLayer ORDER BY DESC(?count)"),
    _t("layer-stats", "layers", "Modules counted by layer", "SELECT ?layer (COUNT(?module) AS ?moduleCount) WHERE { ?module code:layer ?layer } GROUP BY ?layer ORDER BY DESC(?moduleCount)"),
    _t("change-impact", "impact", "All that depends on a module", "SELECT DISTINCT ?user WHERE { ?user code:linksTo+ <{{module}}> }", module=None),
    _t("undocumented-modules", "documentation", "Modules without a description", "SELECT ?module WHERE { ?module a code:Module . FILTER NOT EXISTS { ?module code:description ?text } }"),
    _t("missing-exports", "documentation", "Modules without exports", "SELECT ?module WHERE { ?module a code:Module . FILTER NOT EXISTS { ?module code:exports ?export } }"),
    _t("api-surface", "documentation", "Exports of a layer", 'SELECT ?module ?export WHERE { ?module code:layer "{{layer}}" ; code:exports ?export } ORDER BY ?module ?export', layer="api"),
]


class Templates:
    def __init__(self, templates: list[Template] | None = None):
        self.by_name = {t.name: t for t in templates or BUILT_IN}

    def get(self, name: str) -> Template:
        return self.by_name[name]

    def list(self, category: str | None = None) -> list[Template]:
        return sorted((t for t in self.by_name.values() if category in (None, t.category)), key=lambda t: t.name)

    def categories(self) -> list[str]:
        return sorted({t.category for t in self.by_name.values()})

    def save(self, t: Template) -> None:
        self.by_name[t.name] = t

    def export(self, name: str, folder: str) -> str:
        t, path = self.get(name), Path(folder) / f"{name}.json"
        path.write_text(json.dumps(t.__dict__, indent=2))
        return str(path)

    def load(self, folder: str) -> int:
        """Adds the templates of a folder's JSON files; files that are none are passed over."""
        n = 0
        for p in sorted(Path(folder).glob("*.json")):
            try:
                t = Template(**json.loads(p.read_text()))
            except (ValueError, TypeError):
                continue
            self.save(t)
            n += 1
        return n

    def run(self, name: str, triples: DataFrame, counts: dict[str, int] | None = None, **values: str) -> DataFrame:
        return sparql(triples, self.get(name).render(**values), counts)
