"""Keyed upserts and deletes, applied as one join for each table."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import DST, SRC, Table
from ..plans.parser import QueryError
from ..runtime import child_folders


@dataclass(frozen=True)
class UpsertNode:
    label: str
    key: str
    props: dict = field(default_factory=dict)
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class UpsertEdge:
    source: str
    type: str
    target: str
    props: dict = field(default_factory=dict)


@dataclass(frozen=True)
class DeleteNode:
    label: str
    key: str


@dataclass(frozen=True)
class DeleteEdge:
    source: str
    type: str
    target: str


class VectorClock:
    """Logical times by writer."""

    def __init__(self, times: dict[str, int] | None = None):
        self.times = dict(times or {})

    def get(self, who: str) -> int:
        return self.times.get(who, 0)

    def set(self, who: str, at: int) -> None:
        self.times[who] = at

    def tick(self, who: str) -> int:
        self.times[who] = self.get(who) + 1
        return self.times[who]

    def merge(self, other: VectorClock) -> VectorClock:
        self.times = {k: max(self.get(k), other.get(k)) for k in {*self.times, *other.times}}
        return self

    def happens_before(self, other: VectorClock) -> bool:
        """No later anywhere, and earlier somewhere."""
        who = {*self.times, *other.times}
        return all(self.get(k) <= other.get(k) for k in who) and any(self.get(k) < other.get(k) for k in who)


@dataclass
class DeltaBatch:
    """Changes in order. ``timestamp`` and ``clock`` are kept; batches are ordered by the one who applies them."""

    ops: list = field(default_factory=list)
    timestamp: int = 0
    clock: VectorClock | None = None

    def upsert_node(self, label, key, **props) -> DeltaBatch:
        self.ops.append(UpsertNode(label, str(key), props))
        return self

    def upsert_edge(self, source, type, target, **props) -> DeltaBatch:
        self.ops.append(UpsertEdge(str(source), type, str(target), props))
        return self

    def delete_node(self, label, key) -> DeltaBatch:
        self.ops.append(DeleteNode(label, str(key)))
        return self

    def delete_edge(self, source, type, target) -> DeltaBatch:
        self.ops.append(DeleteEdge(str(source), type, str(target)))
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def counts(self) -> dict[str, int]:
        return {k.__name__: sum(isinstance(o, k) for o in self.ops) for k in (UpsertNode, UpsertEdge, DeleteNode, DeleteEdge)}

    def labels(self) -> list[str]:
        return sorted({o.label for o in self.ops if hasattr(o, "label")})

    def types(self) -> list[str]:
        return sorted({o.type for o in self.ops if hasattr(o, "type")})


def merge(table: DataFrame, keys: list[str], changes: DataFrame, counts: bool = True) -> tuple[DataFrame, dict]:
    """Fold ``changes`` into ``table``. With ``counts`` a job counts what was created, updated and deleted.

    ``changes`` has the keys, ``_op`` ("upsert" or "delete"), ``_at`` (their order), and for each other column c
    of the table ``c`` and ``_has_c`` (whether the change names it). Changes of a key are folded first: after its
    last delete, each column's last named value; then one full outer join. A property that isn't named stays.
    """
    rest = [c for c in table.columns if c not in keys]
    w = Window.partitionBy(*keys)
    cut = changes.withColumn("_dead", F.max(F.when(F.col("_op") == "delete", F.col("_at"))).over(w))
    live = (F.col("_op") == "upsert") & (F.col("_at") > F.coalesce("_dead", F.lit(-1)))
    folded = cut.groupBy(*keys).agg(
        F.first("_dead").alias("_dead"),
        F.count(F.when(live, 1)).alias("_ups"),
        F.count(F.when(F.col("_op") == "upsert", 1)).alias("_all"),
        *[F.max(F.when(live & F.col(f"_has_{c}"), F.struct("_at", F.col(f"`{c}`").alias("v")))).alias(f"_new_{c}") for c in rest],
    )
    folded = folded.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"`_k_{k}`") for k in keys])
    both = table.withColumn("_old", F.lit(True)).join(folded, on, "full_outer")
    had, hit = F.coalesce("_old", F.lit(False)), F.col("_ups").isNotNull()
    keep = ~hit | (F.col("_ups") > 0) | (F.col("_dead").isNull() & had)
    cols = [F.coalesce(F.col(f"`{k}`"), F.col(f"`_k_{k}`")).alias(k) for k in keys]
    for c in rest:
        old = F.when(F.col("_dead").isNull(), F.col(f"`{c}`"))
        cols.append(F.when(~hit, F.col(f"`{c}`")).when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v")).otherwise(old).alias(c))
    out = both.filter(keep).select(*cols).select(*table.columns)
    if not counts:
        return out, {}
    n = both.filter(hit).agg(
        F.count(F.when(~had & (F.col("_all") > 0), 1)).alias("created"),
        F.count(F.when(had & (F.col("_ups") > 0), 1)).alias("updated"),
        F.count(F.when((had | (F.col("_all") > 0)) & (F.col("_ups") == 0) & F.col("_dead").isNotNull(), 1)).alias("deleted"),
    ).first()
    return out, n.asDict()


def _changes(session, t: Table, keys: list[tuple[str, T.DataType]], rows: list[tuple]) -> DataFrame:
    rest = [f for f in t.df.schema.fields if f.name not in [k for k, _ in keys]]
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k, _ in keys], T.StructField("_op", T.StringType()), T.StructField("_at", T.LongType()), *[x for f in rest for x in (T.StructField(f.name, f.dataType), T.StructField(f"_has_{f.name}", T.BooleanType()))]])
    data = []
    for at, op, key, props in rows:
        low = {k.lower(): v for k, v in props.items()}
        data.append((*key, op, at, *[x for f in rest for x in (_fit(low.get(f.name.lower()), f.dataType), f.name.lower() in low)]))
    df = session.spark.createDataFrame(data, schema)
    return df.select(*[F.col(k).cast(kind).alias(k) for k, kind in keys], *[F.col(f"`{c}`") for c in schema.names[len(keys) :]])


def _fit(value, kind: T.DataType):
    if isinstance(value, int) and isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    return value


def apply(session, batch: DeltaBatch) -> dict:
    """Applies a batch in the order of its ops. Properties that a table lacks are left out; edges'
    ends need not exist; deleting a node takes its edges along. Gives counts by kind, the total and the time."""
    began = time.time()
    nodes: dict[str, list] = {}
    edges: dict[str, list] = {}
    for at, op in enumerate(batch.ops):
        if isinstance(op, (UpsertNode, DeleteNode)):
            t = session.catalog.need(op.label, True)
            if t.column(t.key).dataType.typeName() not in ("byte", "short", "integer", "long", "string"):
                raise QueryError(f"{t.name}'s key can't be told by text")
            nodes.setdefault(t.name, []).append((at, "upsert" if isinstance(op, UpsertNode) else "delete", (op.key,), getattr(op, "props", {})))
        else:
            t = session.catalog.need(op.type, False)
            edges.setdefault(t.name, []).append((at, "upsert" if isinstance(op, UpsertEdge) else "delete", (op.source, op.target), getattr(op, "props", {})))
    stats = {f"{k}_{d}": 0 for k in ("nodes", "edges") for d in ("created", "updated", "deleted")}
    # the last delete of each node of the batch, by table and key
    gone: dict[str, dict[str, int]] = {}
    for name, rows in nodes.items():
        for at, op, key, _ in rows:
            if op == "delete":
                gone.setdefault(name.lower(), {})[key[0]] = at
    for r in session.catalog.rels():
        ends = [(i, gone[x.lower()], col) for i, (x, col) in enumerate(((r.source, SRC), (r.target, DST))) if x.lower() in gone]
        if not ends:
            continue
        # edges from before the batch go; those that the batch makes before the delete are deleted with it, later ones stay
        t = session.catalog.need(r.name)
        kept = t.df
        for _, dead, col in ends:
            ids = session.spark.createDataFrame([(k,) for k in dead], "_k string").select(F.col("_k").cast(t.df.schema[col].dataType).alias("_k")).distinct()
            kept = kept.join(ids, kept[col] == ids["_k"], "left_anti")
        session.change(t, kept)
        mine = edges.get(t.name, [])
        mine += [(dead[key[i]], "delete", key, {}) for i, dead, _ in ends for key in {row[2] for row in mine} if key[i] in dead]
    for kind, groups in (("edges", edges), ("nodes", nodes)):
        for name, rows in groups.items():
            t = session.catalog.need(name)
            keys = [(t.key, t.column(t.key).dataType)] if t.is_node else [(c, t.df.schema[c].dataType) for c in (SRC, DST)]
            out, n = merge(t.df, [k for k, _ in keys], _changes(session, t, keys, rows))
            session.change(t, out)
            for d, v in n.items():
                stats[f"{kind}_{d}"] += v
    return {**stats, "total_deltas": len(batch.ops), "elapsed": time.time() - began}


#: Batches after which the log of a streamed table is folded into a new version of all its rows.
COMPACT_EVERY = 16


def stream_into(session, table: str, stream: DataFrame, checkpoint: str):
    """Upserts every micro-batch of ``stream`` (columns of the table; a row's columns that are NULL stay as they
    are) until the source has no more. Of a key's rows in a batch the last by ``_at`` (or any) counts.

    A batch is written to a log beside the checkpoint, under its number, so its cost follows the batch and not the table; the table
    is its last whole version with the log folded in. After ``COMPACT_EVERY`` batches a new whole version is written. Called again with the
    same checkpoint, also in a new session, the table takes up the versions and the log; a batch that is run again replaces its own entry."""
    spark, root = session.spark, f"{checkpoint.rstrip('/')}/weft-table-{table.lower()}"
    begin = session.catalog.need(table)
    keys = [begin.key] if begin.is_node else [SRC, DST]
    rest = [c for c in begin.df.columns if c not in keys]
    kinds = {f.name: f.dataType for f in begin.df.schema.fields}

    def numbers(kind: str) -> list[int]:
        return sorted(int(n) for n in child_folders(spark, f"{root}/{kind}") if n.isdigit())

    def current() -> DataFrame:
        whole = numbers("whole")
        df = spark.read.schema(begin.df.schema).parquet(f"{root}/whole/{whole[-1]}") if whole else begin.df
        log = [f"{root}/log/{n}" for n in numbers("log") if not whole or n > whole[-1]]
        return merge(df, keys, spark.read.parquet(*log), counts=False)[0] if log else df

    def fold(batch: DataFrame, number: int) -> None:
        have = {c.lower(): c for c in batch.columns}
        at = F.col("_at") if "_at" in batch.columns else F.monotonically_increasing_id()
        given = lambda c: F.col(f"`{have[c.lower()]}`").cast(kinds[c])
        rows = batch.select(*[given(k).alias(k) for k in keys], at.cast("long").alias("_n"), *[(given(c) if c.lower() in have else F.lit(None).cast(kinds[c])).alias(c) for c in rest])
        last = rows.groupBy(*keys).agg(*[F.max(F.when(F.col(f"`{c}`").isNotNull(), F.struct("_n", F.col(f"`{c}`").alias("v")))).alias(c) for c in rest], F.count("*").alias("_rows"))
        log = last.select(*keys, F.lit("upsert").alias("_op"), F.lit(number).cast("long").alias("_at"), *[x for c in rest for x in (F.col(f"`{c}`.v").alias(c), F.col(f"`{c}`").isNotNull().alias(f"_has_{c}"))])
        log.write.mode("overwrite").parquet(f"{root}/log/{number}")
        if (number + 1) % COMPACT_EVERY == 0:
            current().write.mode("overwrite").parquet(f"{root}/whole/{number}")
        session.catalog.put(session.catalog.need(table).with_df(current()))

    session.catalog.put(begin.with_df(current()))
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
