"""SPARQL SELECT text to a syntax tree: a tokenizer and a recursive-descent parser."""

from __future__ import annotations

import re

from ..schema import NS, RDF_TYPE
from .ast import Const, Expr, Group, Path, Select, Triple, Var

PREFIXES = {"rdf": RDF_TYPE[: -len("type")], "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "code": NS}
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
FUNCTIONS = {"REGEX", "CONTAINS", "STRSTARTS", "STRENDS", "STRLEN", "LCASE", "UCASE", "STR", "BOUND", "CONCAT", "REPLACE", "SUBSTR", "STRBEFORE", "STRAFTER", "IF", "COALESCE", "ABS", "CEIL", "FLOOR", "ROUND", "XSD:INTEGER"}

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|\w*:\w+))?
    |(?P<var>[?$]\w+)|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w.#-]*[\w#-]|[A-Za-z_][\w-]*:|:[\w-]+|[A-Za-z_]\w*)|(?P<mark>&&|\|\||!=|<=|>=|[{}().;,=<>!+*/|^?-])""",
    re.X,
)


class SparqlError(ValueError):
    """The query text cannot be read."""


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"cannot read {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s[1:-1])


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.prefixes = tokenize(text), 0, dict(PREFIXES)

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def word(self, *names: str) -> bool:
        kind, value = self.peek()
        return kind == "name" and value.upper() in names

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or value is not None and got.upper() != value.upper():
            raise SparqlError(f"expected {value or 'more'}, got {got or 'the end'}")
        self.at += 1
        return got

    def accept(self, value: str) -> bool:
        kind, got = self.peek()
        if kind not in ("string", "iri", "end") and got.upper() == value.upper():
            self.at += 1
            return True
        return False

    def iri(self) -> str:
        kind, v = self.peek()
        self.at += 1
        if kind == "iri":
            return v[1:-1]
        if kind == "name" and v == "a":
            return RDF_TYPE
        if kind == "name" and ":" in v:
            prefix, local = v.split(":", 1)
            if prefix not in self.prefixes:
                raise SparqlError(f"prefix {prefix}: is not declared")
            return self.prefixes[prefix] + local
        raise SparqlError(f"expected an IRI, got {v!r}")

    def query(self) -> Select:
        while self.accept("PREFIX"):
            name = self.take()
            self.prefixes[name.rstrip(":")] = self.take()[1:-1]
        self.take("SELECT")
        distinct = self.accept("DISTINCT")
        variables: list = []
        if not self.accept("*"):
            while self.peek()[0] == "var" or self.peek()[1] == "(" or self.word(*AGGREGATES):
                if self.peek()[0] == "var":
                    variables.append((self.take()[1:], None))
                elif self.accept("("):
                    e = self.expression()
                    self.take("AS")
                    variables.append((self.take()[1:], e))
                    self.take(")")
                else:
                    e = self.primary()
                    self.take("AS")
                    variables.append((self.take()[1:], e))
            if not variables:
                raise SparqlError("SELECT names no variables")
        self.accept("WHERE")
        q = Select(variables, self.group(), distinct)
        if self.accept("GROUP"):
            self.take("BY")
            while self.peek()[0] == "var":
                q.group_by.append(self.take()[1:])
        if self.accept("HAVING"):
            while self.peek()[1] == "(":
                q.having.append(self.primary())
        if self.accept("ORDER"):
            self.take("BY")
            while True:
                if self.word("ASC", "DESC"):
                    up = self.take().upper() == "ASC"
                    q.order_by.append((self.primary(), up))
                elif self.peek()[0] == "var" or self.peek()[1] == "(":
                    q.order_by.append((self.primary(), True))
                else:
                    break
        while self.word("LIMIT", "OFFSET"):
            what = self.take().upper()
            n = int(self.take())
            if what == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.peek()[0] != "end":
            raise SparqlError(f"cannot read {self.peek()[1]!r}")
        return q

    def group(self) -> Group:
        self.take("{")
        g = Group()
        while not self.accept("}"):
            if self.accept("FILTER"):
                g.elements.append(("filter", self.primary()))
            elif self.accept("OPTIONAL"):
                g.elements.append(("optional", self.group()))
            elif self.accept("MINUS"):
                g.elements.append(("minus", self.group()))
            elif self.accept("BIND"):
                self.take("(")
                e = self.expression()
                self.take("AS")
                g.elements.append(("bind", e, self.take()[1:]))
                self.take(")")
            elif self.accept("VALUES"):
                g.elements.append(self.values())
            elif self.peek()[1] == "{":
                parts = [self.group()]
                while self.accept("UNION"):
                    parts.append(self.group())
                g.elements.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            elif not self.accept("."):
                triples = self.triples()
                if g.elements and g.elements[-1][0] == "triples":
                    g.elements[-1][1].extend(triples)
                else:
                    g.elements.append(("triples", triples))
        return g

    def values(self) -> tuple:
        names = []
        many = self.accept("(")
        while self.peek()[0] == "var":
            names.append(self.take()[1:])
        if many:
            self.take(")")
        self.take("{")
        rows = []
        while not self.accept("}"):
            if many:
                self.take("(")
                rows.append(tuple(self.value() for _ in names))
                self.take(")")
            else:
                rows.append((self.value(),))
        return ("values", names, rows)

    def value(self) -> str | None:
        if self.accept("UNDEF"):
            return None
        return self.node().value

    def node(self) -> Var | Const:
        kind, v = self.peek()
        if kind == "var":
            self.at += 1
            return Var(v[1:])
        if kind == "string":
            self.at += 1
            return Const(_unquote(v), "literal")
        if kind == "number":
            self.at += 1
            return Const(v, "number")
        if kind == "name" and v in ("true", "false"):
            self.at += 1
            return Const(v, "literal")
        return Const(self.iri())

    def triples(self) -> list[Triple]:
        out, s = [], self.node()
        while True:
            if self.peek()[0] == "var":
                p: Var | Path = Var(self.take()[1:])
            else:
                p = self.path()
            out.append(Triple(s, p, self.node()))
            while self.accept(","):
                out.append(Triple(s, p, self.node()))
            if not self.accept(";"):
                return out
            if self.peek()[1] in (".", "}"):
                return out

    def path(self) -> Path:
        parts = [self.sequence()]
        while self.accept("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def sequence(self) -> Path:
        parts = [self.step()]
        while self.accept("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def step(self) -> Path:
        if self.accept("^"):
            return Path("inv", (self.step(),))
        if self.accept("("):
            p = self.path()
            self.take(")")
        else:
            p = Path("link", iri=self.iri())
        for mark, op in (("+", "plus"), ("*", "star"), ("?", "opt")):
            if self.accept(mark):
                return Path(op, (p,))
        return p

    def expression(self) -> Expr:
        e = self.conjunction()
        while self.accept("||"):
            e = Expr("||", (e, self.conjunction()))
        return e

    def conjunction(self) -> Expr:
        e = self.comparison()
        while self.accept("&&"):
            e = Expr("&&", (e, self.comparison()))
        return e

    def comparison(self) -> Expr:
        e = self.sum()
        for op in ("!=", "<=", ">=", "=", "<", ">"):
            if self.accept(op):
                return Expr(op, (e, self.sum()))
        negated = self.word("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.at += 1
        if self.accept("IN"):
            self.take("(")
            items = [self.expression()]
            while self.accept(","):
                items.append(self.expression())
            self.take(")")
            found = Expr("in", (e, *items))
            return Expr("!", (found,)) if negated else found
        return e

    def sum(self) -> Expr:
        e = self.product()
        while self.peek()[1] in ("+", "-") and self.peek()[0] == "mark":
            e = Expr(self.take(), (e, self.product()))
        return e

    def product(self) -> Expr:
        e = self.primary()
        while self.peek()[1] in ("*", "/") and self.peek()[0] == "mark":
            e = Expr(self.take(), (e, self.primary()))
        return e

    def primary(self) -> Expr:
        if self.accept("!"):
            return Expr("!", (self.primary(),))
        if self.accept("-"):
            return Expr("-", (Expr("const", (Const("0", "number"),)), self.primary()))
        if self.accept("("):
            e = self.expression()
            self.take(")")
            return e
        if self.word("NOT") and self.peek(1)[1].upper() == "EXISTS":
            self.at += 2
            return Expr("!", (Expr("exists", (self.group(),)),))
        if self.accept("EXISTS"):
            return Expr("exists", (self.group(),))
        kind, v = self.peek()
        if kind == "name" and v.upper() in AGGREGATES | FUNCTIONS and self.peek(1)[1] == "(":
            name = v.upper()
            self.at += 2
            distinct = self.accept("DISTINCT")
            args: list = []
            if name == "COUNT" and self.accept("*"):
                args.append(Expr("star"))
            else:
                while self.peek()[1] != ")":
                    if self.accept("SEPARATOR"):
                        self.take("=")
                    args.append(self.expression())
                    if not (self.accept(",") or self.accept(";")):
                        break
            self.take(")")
            return Expr("call", tuple(args), name, distinct)
        if kind == "name" and self.peek(1)[1] == "(":
            raise SparqlError(f"unknown function {v}")
        n = self.node()
        return Expr("var", (), n.name) if isinstance(n, Var) else Expr("const", (n,))


def parse(text: str) -> Select:
    return Parser(text).query()
