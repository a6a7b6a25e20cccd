"""The syntax tree of a SELECT query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: str
    kind: str = "iri"  # iri, literal, number


@dataclass(frozen=True)
class Path:
    """op: link (one predicate), seq, alt, inv, plus, star, opt."""

    op: str
    parts: tuple = ()
    iri: str = ""


@dataclass(frozen=True)
class Triple:
    s: Var | Const
    p: Var | Path
    o: Var | Const


@dataclass(frozen=True)
class Expr:
    """op: var, const, call, or an operator; args are expressions, Group for exists."""

    op: str
    args: tuple = ()
    name: str = ""
    distinct: bool = False


@dataclass
class Group:
    """Elements in order: ('triples', [Triple]), ('filter', Expr), ('optional'|'minus'|'group', Group),
    ('union', [Group]), ('bind', Expr, name), ('values', names, rows)."""

    elements: list = field(default_factory=list)


@dataclass
class Select:
    variables: list  # (name, Expr or None); empty for *
    where: Group
    distinct: bool = False
    group_by: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (Expr, ascending)
    limit: int | None = None
    offset: int | None = None
