"""Bound queries to DataFrames.

Columns of a bound variable are named ``var.key`` (with U+00B7 for the dot), so scopes go by name and never by
position. Catalyst prunes columns, pushes filters and picks joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import DST, SRC, Catalog, Table
from ..functions.typed import Typed, same
from ..operators.paths import oriented, paths_from, reachable, shortest_paths
from .expressions import Compiler, has_aggregate, is_aggregate
from .parser import Body, NodePattern, Path, QueryError, RelPattern

SEP = "·"


def column(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Binding:
    kind: str  # "node", "rel", "value"
    type: T.DataType | None = None
    col: str | None = None  # of a value
    props: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)
    label: str | None = None
    key: str | None = None  # column that identifies a node, and that a matched relationship has
    tables: tuple[str, ...] = ()  # of a relationship, by its types
    ends: tuple[str, str] | None = None  # columns of a relationship's stored ends, however it was walked
    kind_col: str | None = None  # column that names the table, where there are several

    def columns(self) -> list[str]:
        """All columns that the variable has."""
        if self.kind == "value":
            return [self.col]
        return list(dict.fromkeys([*[c for c, _ in self.props.values()], *([self.key] if self.key else []), *(self.ends or ()), *([self.kind_col] if self.kind_col else [])]))

    def identity(self) -> list[str]:
        """Columns that tell one from another: a node's key; a relationship's stored ends, type and properties
        (relationships that agree in all of them can't be told apart by any pattern)."""
        if self.kind == "value":
            return [self.col]
        if self.kind == "node":
            return [self.key]
        return [*self.ends, *([self.kind_col] if self.kind_col else []), *[c for c, t in self.props.values() if not isinstance(t, T.MapType)]]


class Scope(dict):
    def find(self, name: str) -> tuple[str, Binding] | None:
        return next(((k, b) for k, b in self.items() if k.lower() == name.lower()), None)


@dataclass
class State:
    df: DataFrame
    scope: Scope


class QueryCompiler:
    def __init__(self, session, params: dict, env: dict):
        self.session, self.catalog, self.params, self.env = session, session.catalog, params, env
        self.anonymous = 0

    @property
    def _catalog(self) -> Catalog:
        return self.catalog

    def fresh(self, stem: str = "_") -> str:
        self.anonymous += 1
        return f"{stem}{self.anonymous}"

    # -- expressions in a scope ------------------------------------------------
    def compiler(self, scope: Scope) -> Compiler:
        def lookup(name: str) -> Typed | None:
            got = scope.find(name)
            return self.whole(*got) if got else None

        def prop(name: str, key: str) -> Typed | None:
            got = scope.find(name)
            if not got or got[1].kind == "value":
                return None
            hit = got[1].props.get(key.lower())
            if hit is None:
                raise QueryError(f"{name} has no property {key}")
            return Typed(column(hit[0]), hit[1])

        def labels(name: str) -> list[str]:
            got = scope.find(name)
            return [got[1].label] if got and got[1].label else []

        return Compiler(lookup, prop, self.params, self.env, labels, self.session.macros)

    def whole(self, name: str, b: Binding) -> Typed:
        """The value of a variable; a node or relationship is the struct of its properties."""
        if b.kind == "value":
            return Typed(column(b.col), b.type)
        fields = [T.StructField(c.split(SEP)[-1], t) for c, t in b.props.values()]
        value = F.struct(*[column(c).alias(f.name) for (c, _), f in zip(b.props.values(), fields)]) if fields else F.struct(F.lit(1).alias("_"))
        return Typed(F.when(column(b.key).isNotNull(), value) if b.key else value, T.StructType(fields))

    # -- clauses -----------------------------------------------------------------
    def query(self, parts: list[tuple]) -> DataFrame:
        out = None
        for how, clauses in parts:
            df = self.clauses(clauses)
            if out is None:
                out = df
            else:
                if [c.lower() for c in out.columns] != [c.lower() for c in df.columns]:
                    raise QueryError("the parts of a UNION need the same columns")
                out = out.union(df)
                if how == "union":
                    out = out.distinct()
        return out

    def start(self) -> State:
        return State(self.session.spark.range(1).select(), Scope())

    def reading(self, clauses: list[tuple]) -> State:
        """Runs MATCH, UNWIND, WITH and CALL clauses."""
        state = self.start()
        for c in clauses:
            state = self.step(state, c)
        return state

    def step(self, state: State, c: tuple) -> State:
        if c[0] == "match":
            return self.match(state, c[2], c[3], c[1])
        if c[0] == "unwind":
            return self.unwind(state, c[1], c[2])
        if c[0] == "with":
            return self.project(state, c[1], final=False)
        if c[0] == "call":
            return self.call(state, c)
        raise QueryError(f"{c[0].upper()} isn't allowed here")

    def clauses(self, clauses: list[tuple]) -> DataFrame:
        if clauses[-1][0] != "return" or any(c[0] == "return" for c in clauses[:-1]):
            raise QueryError("a query ends with its only RETURN")
        return self.project(self.reading(clauses[:-1]), clauses[-1][1], final=True).df

    def unwind(self, state: State, e: tuple, name: str) -> State:
        """One row for each element; none for NULL and empty lists; one for what is no list."""
        x = self.compiler(state.scope)(e)
        col = self.fresh("u")
        if isinstance(x.type, T.ArrayType):
            kind = T.StringType() if isinstance(x.type.elementType, T.NullType) else x.type.elementType
            df = state.df.withColumn(col, F.explode(x.col.cast(T.ArrayType(kind)) if kind != x.type.elementType else x.col))
        else:
            kind = x.type
            df = state.df.withColumn(col, x.col).filter(column(col).isNotNull())
        return State(df, Scope({**state.scope, name: Binding("value", kind, col)}))

    def call(self, state: State, c: tuple) -> State:
        out = self.session.run_call(c, self.params, self.env)
        names = c[4] or [(f, f) for f in out.columns]
        taken = {a: self.fresh("y") for _, a in names}
        right = out.select(*[F.col(f).alias(taken[a]) for f, a in names])
        scope = Scope(state.scope)
        for f, a in names:
            scope[a] = Binding("value", out.schema[f].dataType, taken[a])
        return State(right if not state.scope else state.df.crossJoin(right), scope)

    # -- MATCH -------------------------------------------------------------------
    def match(self, state: State, paths: list[Path], where: tuple | None, optional: bool = False) -> State:
        if not optional:
            pending = _conjuncts(where)
            return self.filtered(self.patterns(state, paths, pending), pending)
        base, keys = self._outer(state, paths, where)
        kept = base.scope
        pending = _conjuncts(where)
        sub = self.filtered(self.patterns(base, paths, pending), pending)
        new = Scope({k: b for k, b in sub.scope.items() if k not in kept})
        fresh_cols = list(dict.fromkeys(c for b in new.values() for c in b.columns()))
        renamed = {k: self.fresh("o") for k in keys}
        right = sub.df.select(*map(column, fresh_cols), *[column(k).alias(r) for k, r in renamed.items()])
        on = [column(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
        df = state.df.join(right, reduce(lambda a, b: a & b, on) if on else F.lit(True), "left").drop(*renamed.values())
        return State(df, Scope({**state.scope, **new}))

    def filtered(self, state: State, where: list[tuple] | tuple | None) -> State:
        for e in where if isinstance(where, list) else _conjuncts(where):
            negated, inner = (True, e[1]) if e[0] == "not" else (False, e)
            if inner[0] == "exists":
                state = self.semi(state, inner[1], inner[2], negated)
            else:
                scope = state.scope
                state, e = self.subqueries(state, e)
                state = State(state.df.filter(self.compiler(state.scope).boolean(e)), scope)
        return state

    def subqueries(self, state: State, e: object) -> tuple[State, object]:
        """``e`` with the EXISTS { } and COUNT { } in it put into value variables, so they may stand anywhere in an expression."""
        if _is_subquery(e):
            name = self.fresh("c")
            state = self.counted(state, e, name)
            return state, ("cmp", ">", ("var", name), ("lit", 0)) if e[0] == "exists" else ("var", name)
        if isinstance(e, (tuple, list)):
            out = []
            for x in e:
                state, x = self.subqueries(state, x)
                out.append(x)
            return state, type(e)(out)
        return state, e

    def early(self, state: State, pending: list[tuple]) -> State:
        """Apply those conjuncts whose variables are all bound, before any further join or search; subqueries wait."""
        for e in list(pending):
            used = _variables(e)
            if used and not _has_subquery(e) and all(state.scope.find(x) for x in used):
                pending.remove(e)
                state = State(state.df.filter(self.compiler(state.scope).boolean(e)), state.scope)
        return state

    def _outer(self, state: State, paths: list[Path], where: tuple | None) -> tuple[State, list[str]]:
        """The distinct values of the outer variables that a subquery uses, and the columns that tell them apart."""
        used = {x for x in _variables(paths) | _variables(where) if state.scope.find(x)}
        kept = Scope({k: b for k, b in state.scope.items() if any(k.lower() == u.lower() for u in used)})
        keys = list(dict.fromkeys(c for b in kept.values() for c in b.identity()))
        cols = list(dict.fromkeys(c for b in kept.values() for c in b.columns()))
        return (State(state.df.select(*map(column, cols)).dropDuplicates(keys), kept) if keys else self.start()), keys

    def _sub(self, state: State, paths: list[Path], where: tuple | None) -> tuple[State, list[str]]:
        base, keys = self._outer(state, paths, where)
        if not keys:
            raise QueryError("a subquery needs a variable from outside")
        pending = _conjuncts(where)
        return self.filtered(self.patterns(base, paths, pending), pending), keys

    def semi(self, state: State, paths: list[Path], where: tuple | None, negated: bool) -> State:
        sub, keys = self._sub(state, paths, where)
        names = {k: self.fresh("s") for k in keys}
        right = sub.df.select(*[column(k).alias(n) for k, n in names.items()])
        on = reduce(lambda a, b: a & b, [column(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        return State(state.df.join(right, on, "left_anti" if negated else "left_semi"), state.scope)

    def counted(self, state: State, e: tuple, name: str) -> State:
        """COUNT { } as a value variable."""
        sub, keys = self._sub(state, e[1], e[2])
        names, col = {k: self.fresh("s") for k in keys}, self.fresh("n")
        right = sub.df.groupBy(*[column(k).alias(n) for k, n in names.items()]).agg(F.count(F.lit(1)).alias(col))
        on = reduce(lambda a, b: a & b, [column(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        df = state.df.join(right, on, "left").withColumn(col, F.coalesce(F.col(col), F.lit(0).cast("bigint"))).drop(*names.values())
        return State(df, Scope({**state.scope, name: Binding("value", T.LongType(), col)}))

    def patterns(self, state: State, paths: list[Path], pending: list[tuple] | None = None) -> State:
        """``pending`` conjuncts that were applied on the way are taken out of it."""
        # a path that shares a variable with what is bound comes first, so that it is joined and not crossed
        left, pending = list(paths), [] if pending is None else pending
        while left:
            k = next((i for i, p in enumerate(left) if any(n.var and state.scope.find(n.var) for n in p.nodes)), 0)
            state = self.early(self.path(state, left.pop(k), pending), pending)
        return state

    def node_table(self, n: NodePattern, ends: list[str]) -> Table:
        if n.labels:
            for label in n.labels[1:]:  # the first names the table; the others have to exist
                self.catalog.need(label, True)
            return self.catalog.need(n.labels[0], True)
        if len(set(x.lower() for x in ends)) == 1:
            return self.catalog.need(ends[0], True)
        raise QueryError(f"node ({n.var or ''}) needs a label")

    def scan(self, name: str, t: Table) -> tuple[DataFrame, Binding]:
        props = {f.name.lower(): (f"{name}{SEP}{f.name}", f.dataType) for f in t.columns}
        df = t.df.select(*[column(f.name).alias(f"{name}{SEP}{f.name}") for f in t.columns])
        return df, Binding("node", props=props, label=t.name, key=f"{name}{SEP}{t.column(t.key).name}")

    def inline(self, state: State, name: str, props: list[tuple[str, tuple]], df: DataFrame | None = None) -> DataFrame:
        out = df if df is not None else state.df
        compile_ = self.compiler(state.scope)
        for key, value in props:
            out = out.filter(compile_.boolean(("cmp", "=", ("prop", ("var", name), key), value)))
        return out

    def ends_of(self, r: RelPattern) -> list[Table]:
        if not r.types:
            tables = self.catalog.rels()
            if len(tables) != 1:
                raise QueryError("a relationship needs a type")
            return tables
        return [self.catalog.need(x, False) for x in r.types]

    def path(self, state: State, p: Path, pending: list[tuple]) -> State:
        names = [n.var or self.fresh("a") for n in p.nodes]
        hints: list[list[str]] = [[] for _ in names]
        rels = [self.ends_of(r) for r in p.rels]
        for i, (r, tables) in enumerate(zip(p.rels, rels)):
            for t in tables:
                a, b = (t.source, t.target) if r.direction != "<-" else (t.target, t.source)
                hints[i].append(a)
                hints[i + 1].append(b)
                if r.direction == "--":
                    hints[i].append(b)
                    hints[i + 1].append(a)
        if p.shortest:
            return self.shortest(state, p, names, hints, rels, pending)
        first = next((i for i, n in enumerate(names) if state.scope.find(n)), 0)
        state = self.early(self.bind_node(state, p.nodes[first], names[first], hints[first]), pending)
        steps = [(i, i + 1, p.rels[i].direction) for i in range(first, len(p.rels))]
        turn = {"->": "<-", "<-": "->", "--": "--"}
        steps += [(i + 1, i, turn[p.rels[i].direction]) for i in range(first - 1, -1, -1)]
        for a, b, direction in steps:
            k = min(a, b)
            state = self.early(self.hop(state, names[a], p.nodes[b], names[b], p.rels[k], rels[k], direction, hints[b]), pending)
        if p.var:
            keys = [state.scope.find(n)[1].key for n in names]
            kind = state.df.schema[keys[0]].dataType
            col = self.fresh("p")
            state = State(state.df.withColumn(col, F.array(*[column(k).cast(kind) for k in keys])), Scope({**state.scope, p.var: Binding("value", T.ArrayType(kind), col)}))
        return state

    def bind_node(self, state: State, n: NodePattern, name: str, ends: list[str]) -> State:
        got = state.scope.find(name)
        if got:
            if got[1].kind != "node":
                raise QueryError(f"{name} is no node")
            return State(self.inline(state, name, n.props), state.scope)
        df, b = self.scan(name, self.node_table(n, ends))
        scope = Scope({**state.scope, name: b})
        if not state.scope:
            return State(self.inline(State(df, scope), name, n.props), scope)
        return State(self.inline(State(state.df.crossJoin(df), scope), name, n.props), scope)

    def edges(self, r: RelPattern, tables: list[Table], name: str, direction: str) -> tuple[DataFrame, Binding, str, str]:
        """Edges of all alternatives, as walked: (frame, binding, column of the near end, of the far end)."""
        fields: dict[str, T.StructField] = {}
        for t in tables:
            for f in t.columns:
                fields.setdefault(f.name.lower(), f)
        frames, kind = [], f"{name}{SEP}_type" if len({t.name for t in tables}) > 1 else None
        ends = (f"{name}{SEP}_from", f"{name}{SEP}_to")
        for t in tables:
            cols = [(column(t.column(k).name) if t.column(k) else F.lit(None)).cast(f.dataType).alias(f"{name}{SEP}{f.name}") for k, f in fields.items()]
            cols += [F.col(SRC).alias(ends[0]), F.col(DST).alias(ends[1])] + ([F.lit(t.name).alias(kind)] if kind else [])
            df = t.df.select(SRC, DST, *cols)
            frames.append(oriented(df, direction, *[f"`{c}`" for c in df.columns[2:]]))
        df = reduce(lambda a, b: a.unionByName(b), frames)
        near, far = f"{name}{SEP}{SRC}", f"{name}{SEP}{DST}"
        df = df.withColumnsRenamed({SRC: near, DST: far})
        b = Binding("rel", props={k: (f"{name}{SEP}{f.name}", f.dataType) for k, f in fields.items()}, label=tables[0].name, key=near, tables=tuple(dict.fromkeys(t.name for t in tables)), ends=ends, kind_col=kind)
        return df, b, near, far

    def hop(self, state: State, at: str, n: NodePattern, name: str, r: RelPattern, tables: list[Table], direction: str, ends: list[str]) -> State:
        key = state.scope.find(at)[1].key
        if r.var and state.scope.find(r.var):
            raise QueryError(f"{r.var} is bound twice")
        rname = r.var or self.fresh("r")
        if r.hops:
            if r.var:
                raise QueryError("a relationship of many hops can't be named")
            sources = state.df.select(column(key).alias(SRC))
            plain = reduce(lambda a, b: a.unionByName(b), [t.df.select(SRC, DST) for t in tables])
            found = reachable(plain, sources, r.hops[0], r.hops[1], direction)
            near, far = f"{rname}{SEP}{SRC}", f"{rname}{SEP}{DST}"
            df, rel = found.select(F.col(SRC).alias(near), F.col(DST).alias(far)), None
        else:
            df, rel, near, far = self.edges(r, tables, rname, direction)
            if r.props:
                df = self.inline(State(df, Scope({**state.scope, rname: rel})), rname, r.props, df)
        scope = Scope({**state.scope, rname: rel} if rel and r.var else state.scope)
        got = scope.find(name)
        on = column(key) == column(near)
        if got:
            return State(self.inline(State(state.df.join(df, on & (column(got[1].key) == column(far))), scope), name, n.props), scope)
        out = state.df.join(df, on)
        ndf, b = self.scan(name, self.node_table(n, ends))
        ndf = self.inline(State(ndf, Scope({**scope, name: b})), name, n.props, ndf) if not _uses_outside(n.props) else ndf
        out = out.join(ndf, column(far) == column(b.key))
        scope = Scope({**scope, name: b})
        if _uses_outside(n.props):
            out = self.inline(State(out, scope), name, n.props, out)
        return State(out, scope)

    def shortest(self, state: State, p: Path, names: list[str], hints: list[list[str]], rels: list[list[Table]], pending: list[tuple]) -> State:
        """Where both ends are bound, their pairs are searched. Else the search runs from the sources that are left after
        their conditions, and what it reaches is joined with the targets: no pair is made that has no path."""
        if len(p.rels) != 1:
            raise QueryError("shortestPath takes one relationship")
        edges = reduce(lambda x, y: x.unionByName(y), [t.df.select(SRC, DST) for t in rels[0]])
        high, direction = p.rels[0].hops[1] if p.rels[0].hops else 1, p.rels[0].direction
        known = state.scope.find(names[1])
        if known and state.scope.find(names[0]) or _uses_outside(p.nodes[1].props):
            state = self.early(self.bind_node(state, p.nodes[0], names[0], hints[0]), pending)
            state = self.early(self.bind_node(state, p.nodes[1], names[1], hints[1]), pending)
            a, b = (state.scope.find(n)[1].key for n in names)
            found = shortest_paths(edges, state.df.select(column(a).alias(SRC), column(b).alias(DST)), high, direction)
            found = found.filter(F.size("_path") > 1)
            other = None
        else:
            near, far = (0, 1) if not known else (1, 0)  # the search starts from the end that is bound
            state = self.early(self.bind_node(state, p.nodes[near], names[near], hints[near]), pending)
            other = self.early(self.bind_node(self.start(), p.nodes[far], names[far], hints[far]), pending)
            turn = {"->": "<-", "<-": "->", "--": "--"}
            sources = state.df.select(column(state.scope.find(names[near])[1].key).alias(SRC))
            targets = other.df.select(column(other.scope.find(names[far])[1].key).alias(DST))
            found = paths_from(edges, sources, targets, high, direction if near == 0 else turn[direction], backwards=near == 1)
            a, b = ((state if i == near else other).scope.find(names[i])[1].key for i in (0, 1))
        col = self.fresh("p")
        kind = found.schema["_path"].dataType
        found = found.select(F.col(SRC).alias("_f"), F.col(DST).alias("_t"), F.col("_path").alias(col))
        if other is None:
            df, scope = state.df.join(found, (column(a) == F.col("_f")) & (column(b) == F.col("_t"))), Scope(state.scope)
        elif a in state.df.columns:
            df, scope = state.df.join(found, column(a) == F.col("_f")).join(other.df, F.col("_t") == column(b)), Scope({**state.scope, **other.scope})
        else:
            df, scope = state.df.join(found, column(b) == F.col("_t")).join(other.df, F.col("_f") == column(a)), Scope({**state.scope, **other.scope})
        df = df.drop("_f", "_t")
        if p.var:
            scope[p.var] = Binding("value", kind, col)
        return State(df, scope)

    # -- WITH and RETURN -----------------------------------------------------------
    def project(self, state: State, body: Body, final: bool) -> State:
        items: list[tuple[tuple, str]] = []
        if body.star:
            items += [(("var", k), k) for k in state.scope]
        for e, alias in body.items:
            if _has_subquery(e):
                alias = alias or (e[0] if _is_subquery(e) else "expr")
                state, e = self.subqueries(state, e)
            items.append((e, alias or _default_name(e)))
        if final and not items:
            raise QueryError("RETURN * needs a variable")
        order = [(next((i for i, a in items if e == ("var", a)), e) if not state.scope.find(e[1] if e[0] == "var" else "") else e, up) for e, up in body.order]
        bindings: dict[str, Binding] = {}
        if any(has_aggregate(e) for e, _ in items) or any(has_aggregate(e) for e, _ in order):
            df, out, order_cols = self.aggregated(state, items, order)
        else:
            compile_ = self.compiler(state.scope)
            out, df = [], state.df
            for e, alias in items:
                got = state.scope.find(e[1]) if e[0] == "var" and not final else None
                if got and got[1].kind != "value":
                    bindings[alias] = got[1]
                    out.append((alias, None))
                else:
                    out.append((alias, compile_(e)))
            order_cols = [(compile_(e), up) for e, up in order]
        cols, scope, named = [], Scope(), []
        for alias, x in out:
            if x is None:
                b = bindings[alias]
                cols += b.columns()
                scope[alias] = b
            else:
                name = self.fresh("w")
                df = df.withColumn(name, x.col)
                cols.append(name)
                named.append(column(name).alias(alias))
                scope[alias] = Binding("value", x.type, name)
        cols = list(dict.fromkeys(cols))
        keys = []
        for x, up in order_cols:
            name = self.fresh("k")
            df = df.withColumn(name, x.col)
            keys.append((name, up))
        if body.distinct:
            df = df.select(*map(column, cols), *[F.col(k) for k, _ in keys]).dropDuplicates(cols)
        if keys:  # NULLs last going up and first going down
            df = df.orderBy(*[F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_first() for k, up in keys])
        if body.skip is not None:
            df = df.offset(self.number(body.skip))
        if body.limit is not None:
            df = df.limit(self.number(body.limit))
        df = df.select(*map(column, cols))
        state = State(df, scope)
        if not final:
            return self.filtered(state, body.where)
        return State(df.select(*named), scope)

    def number(self, e: tuple) -> int:
        """A constant number of rows."""
        if e[0] == "param":
            e = ("lit", self.params.get(e[1]))
        if e[0] == "lit" and isinstance(e[1], int) and not isinstance(e[1], bool):
            value = e[1]
        else:
            value = self.session.spark.range(1).select(self.compiler(Scope())(e).col).first()[0]
        if not isinstance(value, int) or value < 0:
            raise QueryError("SKIP and LIMIT need a constant number of rows")
        return value

    def aggregated(self, state: State, items: list[tuple[tuple, str]], order: list[tuple[tuple, bool]]):
        """Groups by the items without aggregates; aggregates may stand within expressions."""
        compile_ = self.compiler(state.scope)
        keys = [(e, self.fresh("g"), compile_(e)) for e, _ in items if not has_aggregate(e)]
        calls: dict[str, tuple[str, Typed]] = {}

        def collect(e: object) -> None:
            if isinstance(e, tuple) and len(e) > 1 and isinstance(e[0], str) and is_aggregate(e):
                if repr(e) not in calls:
                    calls[repr(e)] = (self.fresh("x"), compile_.aggregate(*e[1:]))
            elif isinstance(e, (tuple, list)):
                for x in e:
                    collect(x)

        for e, _ in [*items, *order]:
            collect(e)
        grouped = state.df.select("*", *[x.col.alias(n) for _, n, x in keys])
        aggs = [x.col.alias(n) for n, x in calls.values()]
        df = grouped.groupBy(*[n for _, n, _ in keys]).agg(*aggs) if aggs else grouped.select(*[n for _, n, _ in keys]).distinct()
        after = self.compiler(Scope())
        after.replaced = {repr(e): Typed(F.col(n), x.type) for e, n, x in keys} | {k: Typed(F.col(n), x.type) for k, (n, x) in calls.items()}
        return df, [(alias, after(e)) for e, alias in items], [(after(e), up) for e, up in order]


def _conjuncts(e: tuple | None) -> list[tuple]:
    if e is None:
        return []
    return [*_conjuncts(e[2]), *_conjuncts(e[3])] if e[0] == "bin" and e[1] == "and" else [e]


def _variables(e: object) -> set[str]:
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "var":
        return {e[1]}
    if isinstance(e, Path):
        return {x.var for x in (*e.nodes, *e.rels) if x.var} | _variables([v for x in (*e.nodes, *e.rels) for _, v in x.props])
    if isinstance(e, (tuple, list)):
        return set().union(*map(_variables, e)) if e else set()
    return set()


def _is_subquery(e: object) -> bool:
    return isinstance(e, tuple) and len(e) == 3 and e[0] in ("exists", "count") and isinstance(e[1], list) and bool(e[1]) and isinstance(e[1][0], Path)


def _has_subquery(e: object) -> bool:
    return _is_subquery(e) or isinstance(e, (tuple, list)) and any(map(_has_subquery, e))


def _uses_outside(props: list[tuple[str, tuple]]) -> bool:
    return any(_variables(v) for _, v in props)


def _default_name(e: tuple) -> str:
    """Names of items without AS: the property, the variable, the function, ``count(*)`` or ``expr``."""
    if e[0] == "prop":
        return e[2]
    if e[0] == "var":
        return e[1]
    if e[0] == "call":
        return "count(*)" if e[4] else e[1]
    return "expr"


__all__ = ["QueryCompiler", "State", "Scope", "Binding", "column", "SEP", "same"]
