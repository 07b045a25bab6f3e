"""CREATE, SET, DELETE and MERGE: every change is one keyed join for all matched rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import DST, SRC, Table
from ..functions.typed import literal
from ..plans.compiler import Binding, QueryCompiler, Scope, State, column
from ..plans.parser import Path, QueryError
from ..runtime import materialize


class Mutator:
    def __init__(self, session, params: dict, env: dict):
        self.session, self.compiler = session, QueryCompiler(session, params, env)

    def run(self, clauses: list[tuple]) -> DataFrame | str:
        state = self.compiler.start()
        for i, c in enumerate(clauses):
            if c[0] in ("create", "set", "delete", "merge"):
                state = getattr(self, "_" + c[0])(state, *c[1:])
            elif c[0] == "return":
                return self.compiler.project(state, c[1], final=True).df
            else:
                state = self.compiler.step(state, c)
        return "ok"

    # -- helpers -------------------------------------------------------------------
    def values(self, state: State, t: Table, props: list[tuple[str, tuple]], keys: dict | None = None) -> DataFrame:
        """New rows of ``t``: given properties, then defaults, then NULL."""
        compile_ = self.compiler.compiler(state.scope)
        given = {}
        for k, e in props:
            col = t.column(k)
            if col is None:
                raise QueryError(f"{t.name} has no property {k}")
            given[col.name] = compile_(e).cast(col.dataType).col
        cols = []
        for f in t.df.schema.fields:
            value = given.get(f.name, (keys or {}).get(f.name))
            cols.append((literal(t.defaults.get(f.name)).col if value is None else value).cast(f.dataType).alias(f.name))
        return state.df.select(*cols)

    def _create(self, state: State, paths: list[Path]) -> State:
        for p in paths:
            for n in p.nodes:
                if n.var and state.scope.find(n.var):
                    continue
                if not n.labels:
                    raise QueryError("a new node needs a label")
                t = self.session.catalog.need(n.labels[0], True)
                if p.rels and not state.scope:
                    raise QueryError("relationships are created between matched nodes")
                rows = self.values(state, t, n.props)
                if t.key.lower() not in [k.lower() for k, _ in n.props]:
                    raise QueryError(f"a new {t.name} needs {t.key}")
                if not t.df.join(rows.select(F.col(t.key).alias("_k")), F.col(t.key) == F.col("_k"), "left_semi").isEmpty():
                    raise QueryError(f"{t.name} has a row with this {t.key}")
                self.session.change(t, t.df.unionByName(rows))
                if n.var:
                    name = n.var
                    props = {f.name.lower(): (f"{name}·{f.name}", f.dataType) for f in t.columns}
                    compile_ = self.compiler.compiler(state.scope)
                    given = {k.lower(): compile_(e) for k, e in n.props}
                    df = state.df
                    for f in t.columns:
                        value = given[f.name.lower()].cast(f.dataType).col if f.name.lower() in given else literal(t.defaults.get(f.name)).col.cast(f.dataType)
                        df = df.withColumn(f"{name}·{f.name}", value)
                    state = State(df, Scope({**state.scope, name: Binding("node", props=props, label=t.name, key=f"{name}·{t.key}")}))
            for i, r in enumerate(p.rels):
                if len(r.types) != 1 or r.hops:
                    raise QueryError("a new relationship needs one type")
                t = self.session.catalog.need(r.types[0], False)
                a, b = (state.scope.find(p.nodes[k].var or "") for k in ((i, i + 1) if r.direction != "<-" else (i + 1, i)))
                if not a or not b:
                    raise QueryError("a new relationship needs two bound nodes")
                for end, want in ((a, t.source), (b, t.target)):
                    if (end[1].label or "").lower() != want.lower():
                        raise QueryError(f"{t.name} goes from {t.source} to {t.target}")
                rows = self.values(state, t, r.props, {SRC: column(a[1].key), DST: column(b[1].key)})
                self.session.change(t, t.df.unionByName(rows))
        return state

    def _set(self, state: State, sets: list[tuple[str, str, tuple]]) -> State:
        compile_ = self.compiler.compiler(state.scope)
        by: dict[str, list] = {}
        for var, prop, e in sets:
            got = state.scope.find(var)
            if not got or got[1].kind == "value":
                raise QueryError(f"{var} can't be set")
            by.setdefault(got[0], []).append((prop, e))
        for var, changes in by.items():
            b = state.scope[var]
            tables = [self.session.catalog.need(x) for x in (b.tables or (b.label,))]
            for prop, _ in changes:
                if prop.lower() not in b.props:
                    raise QueryError(f"{var} has no property {prop}")
            values = {prop.lower(): compile_(e).cast(b.props[prop.lower()][1]).col for prop, e in changes}
            for t in tables:
                new = {t.column(k).name: v.cast(t.column(k).dataType) for k, v in values.items() if t.column(k)}
                if t.key in new:
                    raise QueryError("a primary key can't be set")
                rows = self.rows_of(state, b, t)
                keys = self.identity(b, t)
                found = rows.select(*[column(c).alias(f"_k{i}") for i, c in enumerate(keys.values())], *[v.alias(f"_new_{n}") for n, v in new.items()], F.lit(True).alias("_hit"))
                found = found.dropDuplicates([f"_k{i}" for i in range(len(keys))])
                joined = t.df.join(found, [t.df[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate(keys)], "left")
                out = [F.when(F.col("_hit"), F.col(f"_new_{f.name}")).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in t.df.schema.fields]
                self.session.change(t, joined.select(*out))
            df = state.df
            for k, v in values.items():
                df = df.withColumn(f"_v_{k}", v)
            for k in values:
                name = b.props[k][0]
                df = df.drop(name).withColumnRenamed(f"_v_{k}", name)
            state = State(df, state.scope)
            compile_ = self.compiler.compiler(state.scope)
        return state

    @staticmethod
    def identity(b: Binding, t: Table) -> dict[str, str]:
        """Columns of ``t`` by those of the matched rows that tell which row was matched."""
        if t.is_node:
            return {t.key: b.key}
        props = {f.name: b.props[f.name.lower()][0] for f in t.columns if not isinstance(f.dataType, T.MapType)}
        return {SRC: b.ends[0], DST: b.ends[1], **props}

    @staticmethod
    def rows_of(state: State, b: Binding, t: Table) -> DataFrame:
        return state.df.filter(column(b.kind_col) == F.lit(t.name)) if b.kind_col else state.df

    def _delete(self, state: State, detach: bool, names: list[str]) -> State:
        for var in names:
            got = state.scope.find(var)
            if not got or got[1].kind == "value":
                raise QueryError(f"{var} can't be deleted")
            b = got[1]
            if b.kind == "rel":
                for t in [self.session.catalog.need(x, False) for x in b.tables]:
                    keys = self.identity(b, t)
                    gone = self.rows_of(state, b, t).select(*[column(c).alias(f"_k{i}") for i, c in enumerate(keys.values())]).distinct()
                    self.session.change(t, t.df.join(gone, [t.df[k].eqNullSafe(gone[f"_k{i}"]) for i, k in enumerate(keys)], "left_anti"))
                continue
            t = self.session.catalog.need(b.label)
            gone = state.df.select(column(b.key).alias("_k")).distinct()
            for r in self.session.catalog.rels(t.name):
                for end, col in ((r.source, SRC), (r.target, DST)):
                    if end.lower() == t.name.lower():
                        r = self.session.catalog.need(r.name)
                        if detach:
                            self.session.change(r, r.df.join(gone, r.df[col] == gone["_k"], "left_anti"))
                        elif not r.df.join(gone, r.df[col] == gone["_k"], "left_semi").isEmpty():
                            raise QueryError(f"{t.name} rows have {r.name} relationships; use DETACH DELETE")
            self.session.change(t, t.df.join(gone, t.df[t.key] == gone["_k"], "left_anti"))
        return state

    def _merge(self, state: State, path: Path, on: dict[str, list]) -> State:
        """Match the pattern for each row; create it where there is none."""
        if not path.rels:
            n = path.nodes[0]
            if not n.labels:
                raise QueryError("MERGE needs a label")
            var = n.var or self.compiler.fresh("m")
            n.var = var
            t = self.session.catalog.need(n.labels[0], True)
            compile_ = self.compiler.compiler(state.scope)
            given = {t.column(k).name: compile_(e).cast(t.column(k).dataType).col for k, e in n.props}
            if t.key not in given:
                raise QueryError(f"MERGE needs {t.key}")
            wanted = state.df.select(*[v.alias(f"_w_{k}") for k, v in given.items()]).distinct()
            same = [t.df[k].eqNullSafe(wanted[f"_w_{k}"]) for k in given]
            missing = wanted.join(t.df, same, "left_anti")
            key = f"_w_{t.key}"
            if not missing.join(t.df, t.df[t.key] == missing[key], "left_semi").isEmpty() or not missing.groupBy(key).count().filter(F.col("count") > 1).isEmpty():
                raise QueryError(f"{t.name} has a row with this {t.key} and other properties")
            if not missing.filter(F.col(key).isNull()).isEmpty():
                raise QueryError(f"a new {t.name} needs {t.key}")
            rows = missing.select(*[(F.col(f"_w_{f.name}") if f.name in given else literal(t.defaults.get(f.name)).col.cast(f.dataType)).alias(f.name) for f in t.df.schema.fields])
            old = t.df.join(wanted, same, "left_semi")
            for part, how in ((rows, "create"), (old, "match")):
                for v, prop, e in on[how]:
                    if v.lower() != var.lower():
                        raise QueryError(f"{v} isn't the merged variable")
                    scope = Scope({v: Binding("node", props={f.name.lower(): (f.name, f.dataType) for f in t.columns}, label=t.name, key=t.key)})
                    part = part.withColumn(t.column(prop).name, self.compiler.compiler(scope)(e).cast(t.column(prop).dataType).col)
                if how == "create":
                    rows = part
                else:
                    old = part
            rest = t.df.join(wanted, same, "left_anti")
            self.session.change(t, materialize(rest.unionByName(old).unionByName(rows)))
            return self.compiler.match(state, [path], None)
        if len(path.rels) != 1 or len(path.rels[0].types) != 1:
            raise QueryError("MERGE takes one node or one relationship between bound nodes")
        r = path.rels[0]
        t = self.session.catalog.need(r.types[0], False)
        ends = [state.scope.find(x.var or "") for x in path.nodes]
        if not all(ends):
            raise QueryError("MERGE of a relationship needs two bound nodes")
        a, b = (ends if r.direction != "<-" else ends[::-1])
        compile_ = self.compiler.compiler(state.scope)
        given = {t.column(k).name: compile_(e).cast(t.column(k).dataType).col for k, e in r.props}
        wanted = state.df.select(column(a[1].key).alias("_w_" + SRC), column(b[1].key).alias("_w_" + DST), *[v.alias(f"_w_{k}") for k, v in given.items()]).distinct()
        same = [t.df[k].eqNullSafe(wanted[f"_w_{k}"]) for k in (SRC, DST, *given)]
        missing = wanted.join(t.df, same, "left_anti")
        rows = missing.select(*[(F.col(f"_w_{f.name}") if f.name in (SRC, DST, *given) else literal(t.defaults.get(f.name)).col.cast(f.dataType)).alias(f.name) for f in t.df.schema.fields])
        old = t.df.join(wanted, same, "left_semi")
        scope = Scope({r.var or "_": Binding("rel", props={f.name.lower(): (f.name, f.dataType) for f in t.columns}, label=t.name, key=SRC, tables=(t.name,), ends=(SRC, DST))})
        for how in ("create", "match"):
            for _, prop, e in on[how]:
                col, value = t.column(prop), self.compiler.compiler(scope)(e)
                if how == "create":
                    rows = rows.withColumn(col.name, value.cast(col.dataType).col)
                else:
                    old = old.withColumn(col.name, value.cast(col.dataType).col)
        self.session.change(t, materialize(t.df.join(wanted, same, "left_anti").unionByName(old).unionByName(rows)))
        return state

