"""From a syntax tree to a DataFrame plan.

The only intermediate is a solution: a DataFrame with one string column per variable, and the
variables that are bound in each of its rows.  A basic graph pattern becomes natural joins,
ordered here (connected first, rarest first), since a self-join of one triples table gives
Catalyst nothing to order by; join strategies, pushdown and pruning are Catalyst's.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph.algorithms import closure
from .ast import Const, Expr, Group, Path, Select, Triple, Var
from .parser import AGGREGATES, SparqlError, parse


#: Rows that a task gets where the sides of a join are dealt out by count.
ROWS = 250_000


def shares(rows: int) -> int:
    """Tasks for ``rows`` rows that are to meet by a key; 0, which leaves it to Spark, where few would do."""
    return -(-rows // ROWS) if rows > 2 * ROWS else 0


@dataclass(frozen=True)
class Solution:
    df: DataFrame
    bound: frozenset
    maybe: frozenset = frozenset()
    rows: int = 0  # at most about so many, by the counts of predicates; 0: not known

    @property
    def all(self) -> frozenset:
        return self.bound | self.maybe


def predicates_of(g: Group) -> set[str] | None:
    """The constant predicates that a group's patterns name, in all its parts; None if one may be any."""
    out: set[str] = set()

    def of_path(p: Path) -> bool:
        # A path that a node may pass by reaches all nodes, whatever their predicates.
        if p.op in ("star", "opt"):
            return False
        out.update([p.iri] if p.op == "link" else [])
        return all(of_path(x) for x in p.parts)

    def of_expr(e) -> bool:
        return of_group(e) if isinstance(e, Group) else not isinstance(e, Expr) or all(of_expr(x) for x in e.args)

    def of_group(g: Group) -> bool:
        for kind, *rest in g.elements:
            if kind == "triples":
                ok = all(isinstance(t.p, Path) and of_path(t.p) for t in rest[0])
            elif kind == "union":
                ok = all(of_group(x) for x in rest[0])
            else:
                ok = all(of_expr(x) for x in rest)
            if not ok:
                return False
        return True

    return out if of_group(g) else None


def predicate_counts(triples: DataFrame) -> dict[str, int]:
    """Rows by predicate: one small row for each predicate, for the ordering of patterns."""
    return {r[0]: r[1] for r in triples.groupBy("predicate").count().collect()}


class Compiler:
    def __init__(self, triples: DataFrame, counts: dict[str, int] | None = None):
        self.triples, self.counts = triples.select("subject", "predicate", "object"), counts or {}
        self.spark = triples.sparkSession

    # --- patterns

    def weight(self, t: Triple) -> float:
        """Estimated rows: the predicate's, less for each constant end; a predicate without rows comes first.

        A constant object halves them only: a type or a layer may be that of most nodes.
        """
        total = sum(self.counts.values()) or 1_000_000
        n = float(self.counts.get(t.p.iri, 0 if self.counts else total)) if isinstance(t.p, Path) and t.p.op == "link" else float(total * 2)
        return n * (0.001 if isinstance(t.s, Const) else 1) * (0.5 if isinstance(t.o, Const) else 1)

    @staticmethod
    def names(t: Triple) -> set[str]:
        return {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}

    def order(self, triples: list[Triple]) -> list[Triple]:
        left, out, seen = list(triples), [], set()
        while left:
            linked = [t for t in left if not out or self.names(t) & seen or not self.names(t)] or left
            best = min(linked, key=self.weight)
            left.remove(best)
            out.append(best)
            seen |= self.names(best)
        return out

    def pairs(self, p: Path) -> DataFrame:
        """(s, o) of a property path, as a set for closures and alternatives of one triple."""
        t = self.triples
        if p.op == "link":
            return t.where(F.col("predicate") == p.iri).select(F.col("subject").alias("s"), F.col("object").alias("o"))
        if p.op == "inv":
            return self.pairs(p.parts[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if p.op == "alt":
            out = self.pairs(p.parts[0])
            for x in p.parts[1:]:
                out = out.unionByName(self.pairs(x))
            return out
        if p.op == "seq":
            out = self.pairs(p.parts[0])
            for x in p.parts[1:]:
                nxt = self.pairs(x).select(F.col("s").alias("mid"), F.col("o").alias("end"))
                out = out.join(nxt, out.o == nxt.mid).select("s", F.col("end").alias("o"))
            return out
        inner = self.pairs(p.parts[0])
        if p.op == "plus":
            return closure(inner.select(F.col("s").alias("src"), F.col("o").alias("dst"))).select(F.col("root").alias("s"), F.col("node").alias("o"))
        nodes = t.select(F.col("subject").alias("s")).unionByName(t.select(F.col("object").alias("s"))).distinct()
        same = nodes.select("s", F.col("s").alias("o"))
        more = self.pairs(Path("plus", p.parts)) if p.op == "star" else inner
        return same.unionByName(more).distinct()

    def pattern(self, t: Triple) -> Solution:
        if isinstance(t.p, Var):
            df, cols = self.triples, [(t.s, "subject"), (t.p, "predicate"), (t.o, "object")]
        elif t.p.op == "plus" and isinstance(t.s, Const) != isinstance(t.o, Const):
            # One constant end: search from it instead of closing the whole graph.
            back = isinstance(t.o, Const)
            inner = self.pairs(Path("inv", t.p.parts) if back else t.p.parts[0])
            one = self.spark.createDataFrame([((t.o if back else t.s).value,)], "path string")
            far = closure(inner.select(F.col("s").alias("src"), F.col("o").alias("dst")), one)
            df = far.select(F.col("node" if back else "root").alias("s"), F.col("root" if back else "node").alias("o"))
            cols = [(t.s, "s"), (t.o, "o")]
        else:
            df, cols = self.pairs(t.p), [(t.s, "s"), (t.o, "o")]
        first: dict[str, str] = {}
        for x, c in cols:
            if isinstance(x, Const):
                df = df.where(F.col(c) == x.value)
            elif x.name in first:
                df = df.where(F.col(c) == F.col(first[x.name]))
            else:
                first[x.name] = c
        rows = self.counts.get(t.p.iri, 0) if isinstance(t.p, Path) and t.p.op == "link" else 0
        return Solution(df.select(*[F.col(c).alias(v) for v, c in first.items()]) if first else df.select(F.lit(1).alias("__one")), frozenset(first), rows=rows)

    # --- joins

    def join(self, a: Solution | None, b: Solution, how: str = "inner", conditions: tuple[Expr, ...] = ()) -> Solution:
        if a is None:
            return b
        shared = a.all & b.all
        if conditions or shared & (a.maybe | b.maybe):
            return self.join_on(a, b, how, conditions)
        if not b.all:  # an existence test
            one = b.df.limit(1)
            return replace(a, df=a.df.join(one, F.lit(True), "left_semi" if how == "inner" else "left_anti"))
        left, right = a.df.drop("__one"), b.df.drop("__one")
        if not a.all:
            right = right.join(a.df.limit(1), F.lit(True), "left_semi")
            return replace(b, df=right)
        if how == "inner":
            # Two sides of the same variables are sets of the same rows: no key of them is common.
            if shared and a.all == b.all and min(a.rows, b.rows) and (n := shares(a.rows + b.rows)):
                left, right = left.repartition(n, *sorted(shared)), right.repartition(n, *sorted(shared))
            df = left.join(right, sorted(shared)) if shared else left.crossJoin(right)
            return Solution(df, a.bound | b.bound, a.maybe | b.maybe, max(a.rows, b.rows) if a.rows and b.rows else 0)
        if how == "left":
            df = left.join(right, sorted(shared), "left") if shared else left.join(right, F.lit(True), "left")
            return Solution(df, a.bound, a.maybe | (b.all - a.bound))
        if not shared:
            return a if how == "left_anti" else replace(a, df=left.join(right.limit(1), F.lit(True), how))
        if (n := shares(a.rows + b.rows)) and b.rows > ROWS:
            return replace(a, df=self.dealt(left, right.select(*sorted(shared)), sorted(shared), how, n))
        return replace(a, df=left.join(right.select(*sorted(shared)).distinct(), sorted(shared), how))

    @staticmethod
    def dealt(left: DataFrame, right: DataFrame, keys: list[str], how: str, n: int) -> DataFrame:
        """A semi or anti join in ``n`` tasks, so that a task's memory does not grow with the input.

        Both sides are dealt out by the keys before anything is gathered: no task gathers the keys of a large
        piece of a file.  An outer join with a mark stays behind that; Spark would send a semi or anti join
        ahead of it, and into each branch of a union with the whole right side.
        """
        marked = right.repartition(n, *keys).distinct().withColumn("__met", F.lit(True))
        met = left.repartition(n, *keys).join(marked, keys, "left")
        return met.where(F.col("__met").isNull() if how == "left_anti" else F.col("__met").isNotNull()).drop("__met")

    def join_on(self, a: Solution, b: Solution, how: str, conditions: tuple[Expr, ...]) -> Solution:
        """A join under conditions over both sides, or on variables that a row may leave unbound: those fit anything."""
        shared = sorted(a.all & b.all)
        left, right = a.df.drop("__one"), b.df.drop("__one").withColumnsRenamed({v: f"__r_{v}" for v in shared})
        fits = lambda v: F.col(v) == F.col(f"__r_{v}")
        over = [self.column(c, Solution(left, a.bound | b.bound, a.maybe | b.maybe)) for c in conditions]
        loose = [v for v in shared if v not in a.bound & b.bound]
        sure = [fits(v) for v in shared if v not in loose] + over
        if loose and len(loose) <= 2 and how in ("inner", "left"):
            df = self.join_by_nulls(left, right, sure, {v: (v in a.bound, v in b.bound) for v in loose}, how)
        else:
            on = sure + [fits(v) | F.col(v).isNull() | F.col(f"__r_{v}").isNull() for v in loose]
            df = left.join(right, reduce(lambda x, y: x & y, on), how)
        if how in ("left_semi", "left_anti"):
            return replace(a, df=df)
        df = df.withColumns({v: F.coalesce(v, f"__r_{v}") for v in shared if v in a.maybe}).drop(*[f"__r_{v}" for v in shared])
        bound = a.bound | b.bound if how == "inner" else a.bound
        return Solution(df, bound, (a.all | b.all) - bound)

    @staticmethod
    def join_by_nulls(left: DataFrame, right: DataFrame, sure: list[Column], loose: dict[str, tuple[bool, bool]], how: str) -> DataFrame:
        """A join on variables that either side may leave unbound, as equi-joins: both sides are parted by
        which of them are bound, and each two parts are joined on what both have.

        Two parts that share no bound variable are compared row by row, as their meaning asks.
        """
        def parts(df: DataFrame, side: int, prefix: str) -> list[tuple[dict[str, bool], DataFrame]]:
            out = []
            for bound in product((True, False), repeat=len(loose)):
                if all(b or not loose[v][side] for v, b in zip(loose, bound)):
                    tests = [F.col(prefix + v).isNotNull() if b else F.col(prefix + v).isNull() for v, b in zip(loose, bound) if not loose[v][side]]
                    out.append((dict(zip(loose, bound)), df.where(reduce(lambda x, y: x & y, tests)) if tests else df))
            return out

        found = []
        for mine, rows in parts(left, 0, ""):
            alone = rows
            for theirs, others in parts(right, 1, "__r_"):
                on = sure + [F.col(v) == F.col(f"__r_{v}") for v in loose if mine[v] and theirs[v]]
                on = reduce(lambda x, y: x & y, on) if on else F.lit(True)
                found.append(rows.join(others, on))
                alone = alone.join(others, on, "left_anti")
            if how == "left":
                found.append(alone.select("*", *[F.lit(None).cast(t).alias(c) for c, t in right.dtypes]))
        return reduce(DataFrame.unionByName, found)

    @staticmethod
    def used(e: Expr) -> set[str]:
        """The variables of an expression outside its own groups."""
        return ({e.name} if e.op == "var" else set()).union(*(Compiler.used(x) for x in e.args if isinstance(x, Expr)))

    def inner(self, g: Group, outer: frozenset) -> tuple[Solution, tuple[Expr, ...]]:
        """The solution of a group within another, and those of its filters that name variables of the outer one."""
        body = self.group(Group([x for x in g.elements if x[0] != "filter"]))
        over = []
        for x in g.elements:
            if x[0] == "filter":
                if (self.used(x[1]) - body.all) & outer:
                    over.append(x[1])
                else:
                    body = self.filter(body, x[1])
        return body, tuple(over)

    def group(self, g: Group) -> Solution:
        out: Solution | None = None
        filters: list[Expr] = []
        for kind, *rest in g.elements:
            if kind == "triples":
                for t in self.order(rest[0]):
                    out = self.join(out, self.pattern(t))
            elif kind == "filter":
                filters.append(rest[0])
            elif kind == "group":
                out = self.join(out, self.group(rest[0]))
            elif kind == "optional":
                b, over = self.inner(rest[0], out.all if out else frozenset())
                out = b if out is None else self.join(out, b, "left", over)
            elif kind == "minus":
                b = self.group(rest[0])
                out = out if out is None or not (out.all & b.all) else self.join(out, b, "left_anti")
            elif kind == "union":
                parts = [self.group(x) for x in rest[0]]
                names = sorted(frozenset().union(*(p.all for p in parts)))
                df = None
                for p in parts:
                    x = p.df.select(*[F.col(v) if v in p.all else F.lit(None).cast("string").alias(v) for v in names])
                    df = x if df is None else df.unionByName(x)
                bound = frozenset.intersection(*(p.bound for p in parts))
                out = self.join(out, Solution(df, bound, frozenset(names) - bound))
            elif kind == "bind":
                e, name = rest
                out = out or Solution(self.spark.range(1).select(F.lit(1).alias("__one")), frozenset())
                out = Solution(out.df.withColumn(name, self.column(e, out)), out.bound | {name}, out.maybe)
            elif kind == "values":
                names, rows = rest
                df = self.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
                gaps = frozenset(n for k, n in enumerate(names) if any(r[k] is None for r in rows))
                out = self.join(out, Solution(df, frozenset(names) - gaps, gaps))
        out = out or Solution(self.spark.range(1).select(F.lit(1).alias("__one")), frozenset())
        for e in filters:
            out = self.filter(out, e)
        return out

    def filter(self, s: Solution, e: Expr) -> Solution:
        if e.op == "&&":
            return self.filter(self.filter(s, e.args[0]), e.args[1])
        negated = e.op == "!" and e.args[0].op == "exists"
        if negated or e.op == "exists":
            inner, over = self.inner((e.args[0] if negated else e).args[0], s.all)
            return self.join(s, inner, "left_anti" if negated else "left_semi", over)
        return replace(s, df=s.df.where(self.column(e, s)))

    # --- expressions

    def column(self, e: Expr, s: Solution) -> Column:
        if e.op == "var":
            if e.name not in s.all:
                raise SparqlError(f"?{e.name} is not bound here")
            return F.col(e.name)
        if e.op == "const":
            c = e.args[0]
            return F.lit(float(c.value)) if c.kind == "number" else F.lit(c.value)
        if e.op == "exists":
            raise SparqlError("EXISTS can only stand as a filter or in a conjunction of filters")
        if e.op == "call":
            return self.call(e, s)
        if e.op == "!":
            return ~self.column(e.args[0], s)
        a = [self.column(x, s) for x in e.args]
        if e.op in ("&&", "||"):
            return a[0] & a[1] if e.op == "&&" else a[0] | a[1]
        if e.op == "in":
            return a[0].isin(*a[1:])
        if e.op in ("+", "-", "*", "/") or any(self.numeric(x) for x in e.args):
            a = [x if self.numeric(y) else x.try_cast("double") for x, y in zip(a, e.args)]
        ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y}
        return ops[e.op](*a)

    @staticmethod
    def numeric(e: Expr) -> bool:
        return e.op in ("+", "-", "*", "/") or e.op == "const" and e.args[0].kind == "number" or e.op == "call" and e.name in {"COUNT", "SUM", "AVG", "STRLEN", "ABS", "CEIL", "FLOOR", "ROUND", "XSD:INTEGER"}

    def call(self, e: Expr, s: Solution) -> Column:
        if e.name in AGGREGATES:
            return self.aggregate(e, s)
        if e.name == "BOUND":
            return F.col(e.args[0].name).isNotNull() if e.args[0].name in s.all else F.lit(False)
        a = [self.column(x, s) for x in e.args]
        text = [x.cast("string") for x in a]
        if e.name == "REGEX":
            flags = e.args[2].args[0].value if len(a) > 2 else ""
            return F.regexp_like(text[0], F.concat(F.lit(f"(?{flags})" if flags else ""), text[1]))
        make = {
            "CONTAINS": lambda: text[0].contains(text[1]), "STRSTARTS": lambda: text[0].startswith(text[1]), "STRENDS": lambda: text[0].endswith(text[1]),
            "STRLEN": lambda: F.length(text[0]), "LCASE": lambda: F.lower(text[0]), "UCASE": lambda: F.upper(text[0]), "STR": lambda: text[0],
            "CONCAT": lambda: F.concat(*text), "REPLACE": lambda: F.regexp_replace(text[0], text[1], text[2]),
            "SUBSTR": lambda: F.substr(text[0], a[1].cast("int"), *([a[2].cast("int")] if len(a) > 2 else [])),
            "STRBEFORE": lambda: F.when(text[0].contains(text[1]), F.substring_index(text[0], e.args[1].args[0].value, 1)).otherwise(""),
            "STRAFTER": lambda: F.when(text[0].contains(text[1]), F.substr(text[0], F.instr(text[0], e.args[1].args[0].value) + F.length(text[1]))).otherwise(""),
            "IF": lambda: F.when(a[0], a[1]).otherwise(a[2]), "COALESCE": lambda: F.coalesce(*a), "ABS": lambda: F.abs(a[0].cast("double")),
            "CEIL": lambda: F.ceil(a[0].cast("double")), "FLOOR": lambda: F.floor(a[0].cast("double")), "ROUND": lambda: F.round(a[0].cast("double")), "XSD:INTEGER": lambda: text[0].try_cast("long"),
        }
        return make[e.name]()

    def aggregate(self, e: Expr, s: Solution) -> Column:
        if e.args and e.args[0].op == "star":
            return F.count_distinct(*sorted(s.all)) if e.distinct else F.count(F.lit(1))
        x = self.column(e.args[0], s)
        number = x if self.numeric(e.args[0]) else x.try_cast("double")
        if e.name == "COUNT":
            return F.count_distinct(x) if e.distinct else F.count(x)
        if e.name in ("SUM", "AVG"):
            return {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda c: F.sum_distinct(c) / F.count_distinct(c)}[e.name, e.distinct](number)
        if e.name == "GROUP_CONCAT":
            sep = e.args[1].args[0].value if len(e.args) > 1 else " "
            return F.array_join(F.array_sort(F.collect_set(x) if e.distinct else F.collect_list(x)), sep)
        return {"MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[e.name](x)

    # --- whole queries

    def select(self, q: Select) -> DataFrame:
        s = self.group(q.where)
        grouped = q.group_by or q.having or any(self.has_aggregate(e) for _, e in q.variables if e)
        if grouped:
            loose = [v for v, e in q.variables if e is None and v not in q.group_by]
            if loose:
                raise SparqlError(f"not grouped: {loose}")
            hidden = [(f"__h{k}", e) for k, e in enumerate(q.having)] + [(f"__o{k}", e) for k, (e, _) in enumerate(q.order_by) if self.has_aggregate(e)]
            computed = [self.column(e, s).alias(v) for v, e in [*q.variables, *hidden] if e]
            df = s.df.groupBy(*q.group_by).agg(*computed) if computed else s.df.select(*q.group_by).distinct()
            for k in range(len(q.having)):
                df = df.where(F.col(f"__h{k}"))
            s = Solution(df, frozenset(df.columns))
        else:
            df = s.df
            for v, e in q.variables:
                if e:
                    df = df.withColumn(v, self.column(e, s))
            s = Solution(df, s.bound | {v for v, e in q.variables if e}, s.maybe)
        names = [v for v, _ in q.variables] or sorted(s.all)
        missing = [v for v in names if v not in s.df.columns]
        df = s.df.withColumns({v: F.lit(None).cast("string") for v in missing}) if missing else s.df
        keys = []
        for k, (e, up) in enumerate(q.order_by):
            c = F.col(f"__o{k}") if grouped and self.has_aggregate(e) else self.column(e, Solution(df, frozenset(df.columns)))
            keys.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        if q.distinct:
            if keys and not all(e.op == "var" and e.name in names for e, _ in q.order_by):
                raise SparqlError("ORDER BY of a DISTINCT query needs selected variables")
            df = df.select(*names).distinct()
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*names)

    def has_aggregate(self, e: Expr | None) -> bool:
        return isinstance(e, Expr) and (e.op == "call" and e.name in AGGREGATES or any(self.has_aggregate(x) for x in e.args if isinstance(x, Expr)))


def sparql(triples: DataFrame, text: str, counts: dict[str, int] | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """The solutions of a SELECT query over (subject, predicate, object) rows, a set of triples.

    Constants may be bracketed IRIs, prefixed names or literals; ``code:`` and ``rdf:`` are
    known.  A variable that an OPTIONAL leaves unbound fits any value where it is joined on later.
    """
    q = parse(text)
    # The caller's limit and offset stand in where the query names none of its own.
    q.limit = limit if q.limit is None else q.limit
    q.offset = offset if q.offset is None else q.offset
    return Compiler(triples, counts).select(q)
