"""An Arrow Flight endpoint: statements as tickets, results as streams of record batches."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import flight
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .plans.parser import QueryError
from .session import GraphSession


def batches(df: DataFrame, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of ``df`` in its order. Executors make them; of a result of any size one partition at a time is here."""

    def pack(frames: Iterator) -> Iterator:
        for batch in frames:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])

    for row in df.mapInArrow(pack, "packed binary").toLocalIterator():
        for batch in pa.ipc.open_stream(row["packed"]):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)


class GraphServer(flight.FlightServerBase):
    """Serves one session to all clients. ``do_get`` takes a statement (UTF-8) as ticket and streams its result, ``ok`` = true where it has
    none; the action ``query`` runs a statement and answers OK. Statements are planned one at a time, their results stream side by side.
    Errors of a statement are told to the client; whatever else Flight has is not implemented."""

    def __init__(self, session: GraphSession, location: str = "grpc://127.0.0.1:0"):
        super().__init__(location)
        self._session, self._lock = session, threading.Lock()

    def _perform(self, statement: bytes) -> DataFrame | None:
        try:
            with self._lock:
                return self._session.perform(statement.decode())
        except (QueryError, ValueError) as e:
            raise pa.ArrowInvalid(str(e)) from e

    def do_get(self, context, ticket):
        df = self._perform(ticket.ticket)
        if df is None:
            return flight.RecordBatchStream(pa.table({"ok": [True]}))
        schema = to_arrow_schema(df.schema)
        return flight.GeneratorStream(schema, batches(df, schema))

    def do_action(self, context, action):
        if action.type != "query":
            raise pa.ArrowInvalid(f"unknown action {action.type}")
        self._perform(action.body.to_pybytes())
        return [b"OK"]

    def list_actions(self, context):
        return [("query", "run a statement")]
