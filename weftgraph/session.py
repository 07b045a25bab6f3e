"""GraphSession: statements in, DataFrames out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import DST, SRC, Catalog, Lazy, Table
from .functions import scalar
from .functions.typed import literal
from .operators import algo, fts, vector
from .operators.dml import Mutator
from .plans.compiler import QueryCompiler, Scope
from .plans.parser import QueryError, parse
from .runtime import child_folders, ensure_importable, materialize
from .sources import rdf, readers
from .types import parse_type, type_name

#: Statements that change data cut their tables' lineage after so many changes.
CHECKPOINT_EVERY = 16


class GraphSession:
    """A property graph over Spark: a catalog of node and relationship tables and the statements on them.

    Tables are immutable frames; a change swaps the catalog's entry. ``execute`` returns the result as a lazy DataFrame.
    """

    def __init__(self, spark: SparkSession, env: dict[str, str] | None = None):
        ensure_importable(spark)
        self.spark, self.catalog, self.env = spark, Catalog(), dict(env or {})
        self.macros: dict[str, tuple[list[str], tuple]] = {}
        self.procedures: dict[str, Callable[..., DataFrame]] = {}
        self.texts = fts.TextIndex(spark)
        self.vectors = vector.VectorIndex(spark)
        self._snapshot: dict[str, Table] | None = None
        self._changes: dict[str, int] = {}
        algo.register(self)
        fts.register(self)
        vector.register(self)
        rdf.register(self)

    # -- tables ------------------------------------------------------------------
    def node_table(self, name: str, df: DataFrame, key: str) -> GraphSession:
        """Use a DataFrame as a node table."""
        if key.lower() not in [c.lower() for c in df.columns]:
            raise QueryError(f"{name} has no column {key}")
        self.catalog.put(Table(name, df, key=key))
        return self

    def rel_table(self, name: str, df: DataFrame, source: str, target: str, src: str = SRC, dst: str = DST) -> GraphSession:
        """Use a DataFrame as a relationship table; ``src`` and ``dst`` are cast to the end tables' keys."""
        a, b = (self.catalog.need(t, True) for t in (source, target))
        rest = [c for c in df.columns if c not in (src, dst)]
        kinds = [t.column(t.key).dataType for t in (a, b)]
        df = df.select(F.col(src).cast(kinds[0]).alias(SRC), F.col(dst).cast(kinds[1]).alias(DST), *rest)
        self.catalog.put(Table(name, df, source=a.name, target=b.name))
        return self

    def lazy_node_table(self, name: str, load: Callable[[], DataFrame], key: str) -> GraphSession:
        """Like ``node_table``, with the frame made when it is first used."""
        self.catalog.put(Lazy(name, lambda: Table(name, load(), key=key), key=key))
        return self

    def lazy_rel_table(self, name: str, load: Callable[[], DataFrame], source: str, target: str, kinds: tuple[str, str] = ("bigint", "bigint")) -> GraphSession:
        """Like ``rel_table``, with the frame made when it is first used; its first two columns are the ends, cast to ``kinds``."""

        def table() -> Table:
            df = load()
            ends = [F.col(df.columns[i]).cast(kinds[i]).alias(c) for i, c in enumerate((SRC, DST))]
            return Table(name, df.select(*ends, *df.columns[2:]), source=source, target=target)

        self.catalog.put(Lazy(name, table, source=source, target=target))
        return self

    def fork(self) -> GraphSession:
        """A session of its own on the same tables: what it changes, the other doesn't see."""
        out = GraphSession(self.spark, self.env)
        out.catalog.tables, out.macros = dict(self.catalog.tables), dict(self.macros)
        return out

    def change(self, table: Table, df: DataFrame) -> None:
        """Swap a table's rows. After a number of changes the lineage is cut."""
        n = self._changes.get(table.name.lower(), 0) + 1
        if n % CHECKPOINT_EVERY == 0:
            df = materialize(df)
        self._changes[table.name.lower()] = n
        self.catalog.put(table.with_df(df))

    def insert_row(self, table: str, values: list | dict) -> None:
        t = self.catalog.need(table)
        fields = t.df.schema.fields
        row = [values.get(f.name) for f in fields] if isinstance(values, dict) else [*values, *[None] * (len(fields) - len(values))]
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        self.change(t, t.df.unionByName(self.spark.createDataFrame([tuple(row)], schema)))

    def update_cell(self, table: str, key: object, column: str, value: object) -> None:
        t = self.catalog.need(table, True)
        col = t.column(column)
        new = F.when(F.col(t.key) == F.lit(key), literal(value).col.cast(col.dataType)).otherwise(F.col(col.name))
        self.change(t, t.df.withColumn(col.name, new))

    def delete_row(self, table: str, key: object) -> None:
        t = self.catalog.need(table, True)
        self.change(t, t.df.filter(~F.col(t.key).eqNullSafe(F.lit(key))))

    # -- statements ----------------------------------------------------------------
    def execute(self, text: str, params: dict | None = None, env: dict[str, str] | None = None) -> DataFrame:
        return self.run(parse(text), params or {}, {**self.env, **(env or {})})

    query = execute

    def perform(self, text: str, params: dict | None = None, env: dict[str, str] | None = None) -> DataFrame | None:
        """Like ``execute``, with None where a statement has no result."""
        done = self._statement(parse(text), params or {}, {**self.env, **(env or {})})
        return done if isinstance(done, DataFrame) else None

    def call(self, name: str, *args, **named) -> DataFrame:
        """Run a procedure: ``call("algo.pageRank", 0.85, 20, 1e-6, rel="KNOWS")``."""
        fn = next((f for k, f in self.procedures.items() if k.lower() == name.lower()), None)
        if fn is None:
            raise QueryError(f"no procedure {name}")
        return fn(self, *args, **named)

    def register_procedure(self, name: str, fn: Callable[..., DataFrame]) -> None:
        """``fn(session, *args, **named)`` becomes ``CALL name(...)``."""
        self.procedures[name] = fn

    register_function = staticmethod(scalar.register_function)

    def run(self, s: tuple, params: dict, env: dict[str, str]) -> DataFrame:
        done = self._statement(s, params, env)
        return done if isinstance(done, DataFrame) else self.spark.range(1).select(F.lit(done or "ok").alias("status"))

    def constant(self, e: tuple, params: dict, env: dict[str, str]) -> object:
        """Value of an expression without variables."""
        if e[0] == "lit":
            return e[1]
        if e[0] == "param" and e[1] in params:
            return params[e[1]]
        if e[0] == "list":
            return [self.constant(x, params, env) for x in e[1]]
        return self.spark.range(1).select(QueryCompiler(self, params, env).compiler(Scope())(e).col).first()[0]

    def run_call(self, c: tuple, params: dict, env: dict[str, str]) -> DataFrame:
        named = {k: self.constant(v, params, env) for k, v in c[3].items()}
        return self.call(c[1], *[self.constant(a, params, env) for a in c[2]], **named)

    def _statement(self, s: tuple, params: dict, env: dict[str, str]) -> DataFrame | str | None:
        kind = s[0]
        if kind == "query":
            if any(c[0] in ("create", "set", "delete", "merge") for _, clauses in s[1] for c in clauses):
                if len(s[1]) > 1:
                    raise QueryError("UNION takes reading queries")
                return Mutator(self, params, env).run(s[1][0][1])
            return QueryCompiler(self, params, env).query(s[1])
        if kind == "call":
            out = self.run_call(s, params, env)
            return out.select(*[F.col(c).alias(a) for c, a in s[4]]) if s[4] else out
        if kind in ("explain", "profile"):
            df = self.run(s[1], params, env)
            if kind == "profile":
                rows = df.count()
            plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            lines = plan.split("\n") + ([f"rows: {rows}"] if kind == "profile" else [])
            return self.spark.createDataFrame([(x,) for x in lines], "plan string")
        return getattr(self, "_do_" + kind)(*s[1:], params=params, env=env)

    def _schema(self, cols: list[tuple]) -> T.StructType:
        names = [c[0].lower() for c in cols]
        if len(set(names)) < len(names):
            raise QueryError("a column is named twice")
        return T.StructType([T.StructField(n, parse_type(k), True) for n, k, _ in cols])

    def _new(self, name: str, quiet: bool) -> bool:
        if self.catalog.get(name):
            if quiet:
                return False
            raise QueryError(f"table {name} exists")
        return True

    def _do_node_table(self, quiet, name, cols, key, params, env):
        if self._new(name, quiet):
            schema = self._schema(cols)
            found = next((f.name for f in schema.fields if f.name.lower() == key.lower()), None)
            if found is None:
                raise QueryError(f"no column {key}")
            defaults = {n: self.constant(d, params, env) for n, _, d in cols if d is not None}
            self.catalog.put(Table(name, self.spark.createDataFrame([], schema), key=found, defaults=defaults))

    def _do_rel_table(self, quiet, name, a, b, cols, params, env):
        if self._new(name, quiet):
            ends = [self.catalog.need(t, True) for t in (a, b)]
            fields = [T.StructField(c, t.column(t.key).dataType, True) for c, t in zip((SRC, DST), ends)]
            schema = T.StructType([*fields, *self._schema(cols).fields])
            defaults = {n: self.constant(d, params, env) for n, _, d in cols if d is not None}
            self.catalog.put(Table(name, self.spark.createDataFrame([], schema), source=ends[0].name, target=ends[1].name, defaults=defaults))

    def _do_drop(self, quiet, name, params, env):
        if not self.catalog.get(name):
            if quiet:
                return
            raise QueryError(f"no table {name}")
        self.catalog.drop(name)

    def _do_alter(self, name, what, *args, params, env):
        t = self.catalog.need(name)
        if what == "add":
            if t.column(args[0]):
                raise QueryError(f"{name} has a column {args[0]}")
            value = self.constant(args[2], params, env) if args[2] is not None else None
            self.catalog.put(t.with_df(t.df.withColumn(args[0], literal(value).col.cast(parse_type(args[1])))))
        elif what == "rename_table":
            self._new(args[0], False)
            del self.catalog.tables[name.lower()]
            self.catalog.put(replace(t, name=args[0]))
            for r in self.catalog.rels(name):
                ends = {k: args[0] for k in ("source", "target") if getattr(r, k).lower() == name.lower()}
                if ends:
                    self.catalog.put(replace(r, **ends))
        elif what == "comment":
            self.catalog.put(replace(t, comment=str(args[0])))
        else:
            col = t.column(args[0])
            if col is None:
                raise QueryError(f"{name} has no column {args[0]}")
            if what == "drop":
                if t.key and col.name == t.key:
                    raise QueryError("a primary key can't be dropped")
                self.catalog.put(t.with_df(t.df.drop(col.name)))
            else:
                if t.column(args[1]):
                    raise QueryError(f"{name} has a column {args[1]}")
                self.catalog.put(replace(t, df=t.df.withColumnRenamed(col.name, args[1]), key=args[1] if t.key == col.name else t.key))

    def _do_copy(self, name, path, options, params, env):
        t = self.catalog.need(name)
        new = readers.read(self.spark, self.constant(path, params, env), t.df.schema, {k: self.constant(v, params, env) for k, v in options.items()})
        if t.is_node and options.get("check"):
            both = t.df.select(t.key).unionByName(new.select(t.key))
            if not both.groupBy(t.key).count().filter("count > 1").isEmpty():
                raise QueryError(f"{name} would hold a key twice")
        self.change(t, new if t.df.isEmpty() else t.df.unionByName(new))

    def _do_copy_to(self, what, path, options, params, env):
        df = self.run(what, params, env) if isinstance(what, tuple) else self.catalog.need(what).df
        readers.write(df, path, {k: self.constant(v, params, env) for k, v in options.items()})

    def _do_load(self, path, params, env):
        rdf.load(self, self.constant(path, params, env))

    def _do_macro(self, name, args, body, params, env):
        self.macros[name.lower()] = (args, body)

    def _do_checkpoint(self, params, env):
        for t in self.catalog.all():
            self.catalog.put(t.with_df(materialize(t.df)))

    def _do_export(self, path, params, env):
        self.save(path)

    def _do_import(self, path, params, env):
        self.load(path)

    def _do_begin(self, params, env):
        if self._snapshot is not None:
            raise QueryError("a transaction is open")
        self._snapshot = dict(self.catalog.tables)

    def _do_commit(self, params, env):
        if self._snapshot is None:
            raise QueryError("no transaction is open")
        self._snapshot = None

    def _do_rollback(self, params, env):
        if self._snapshot is None:
            raise QueryError("no transaction is open")
        self.catalog.tables, self._snapshot = self._snapshot, None

    # -- persistence -----------------------------------------------------------------
    def save(self, path: str) -> None:
        """A new version in ``path``, on any file system that Spark writes: a Parquet folder for each table, then the catalog (JSON lines).
        A version counts from when its catalog is written, so tables that come from an earlier one can be saved, and a failure loses nothing."""
        n, rows = 1 + max(_versions(self.spark, path), default=0), []
        for t in self.catalog.all():
            t.df.write.mode("overwrite").parquet(f"{path}/tables/{n}/{t.name}")
            rows.append(json.dumps({"name": t.name, "key": t.key, "source": t.source, "target": t.target, "defaults": t.defaults, "comment": t.comment, "schema": json.loads(t.df.schema.json())}))
        self.spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog/{n}")

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> GraphSession:
        out = cls(spark, **options)
        out.load(path)
        return out

    def load(self, path: str) -> None:
        """Put the tables of the last version in ``path`` into the catalog; none of them may be there."""
        versions = _versions(self.spark, path)
        if not versions:
            raise QueryError(f"no database in {path}")
        found = [json.loads(row[0]) for row in self.spark.read.text(f"{path}/catalog/{max(versions)}").collect()]
        for t in found:
            self._new(t["name"], False)
        for t in found:
            df = self.spark.read.schema(T.StructType.fromJson(t.pop("schema"))).parquet(f"{path}/tables/{max(versions)}/{t['name']}")
            self.catalog.put(Table(df=df, **t))

    def apply_delta(self, batch) -> dict:
        """Apply a batch of upserts and deletes; see ``streaming.delta``."""
        from .streaming.delta import apply

        return apply(self, batch)

    def tables(self) -> list[dict]:
        return [{"name": t.name, "kind": "node" if t.is_node else "rel", "columns": [(f.name, type_name(f.dataType)) for f in t.columns]} for t in self.catalog.all()]


class QueryResult:
    """A collected result, as the command-line and notebook users of the engine know it."""

    def __init__(self, df: DataFrame):
        self.column_names = df.columns
        self._rows = [list(r) for r in df.collect()]
        self.num_rows, self.num_columns = len(self._rows), len(self.column_names)

    def to_list(self) -> list[list]:
        return self._rows

    def __iter__(self):
        return iter(self._rows)

    def __len__(self) -> int:
        return self.num_rows


class Database:
    """A graph that is kept in a folder, or in memory only where none is named; connections share it."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.path = path
        self.session = GraphSession.open(spark, path) if path and _versions(spark, path) else GraphSession(spark)

    def connect(self) -> Connection:
        return Connection(self.session)

    def save(self) -> None:
        if not self.path:
            raise QueryError("a database in memory has no folder")
        self.session.save(self.path)


class Connection:
    """``query`` for results, ``execute`` for statements whose result doesn't matter; many share one session."""

    def __init__(self, session: GraphSession):
        self.session = session

    def query(self, text: str, params: dict | None = None, env: dict | None = None) -> QueryResult:
        return QueryResult(self.session.execute(text, params, env))

    def execute(self, text: str, params: dict | None = None, env: dict | None = None) -> None:
        self.session.execute(text, params, env)

    def to_arrow(self, text: str, params: dict | None = None):
        """The result as an Arrow table."""
        return self.session.execute(text, params).toArrow()


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in child_folders(spark, f"{path}/catalog") if n.isdigit()]
