"""A prompt for statements: ``python -m weftgraph.cli [FOLDER]``; with ``--flight HOST:PORT`` an Arrow Flight server instead."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable

from .session import Database, GraphSession

HELP = """statements end with ;
:tables          names and kinds of tables
:schema          their columns
:stats           their numbers of rows
:param name = v  set a parameter (JSON, or text)
:params          show parameters
:env name = v    set a value for env()
:help  :quit"""
#: Rows of a result that are shown; the result itself is whole.
SHOWN = 100


class Shell:
    """Reads lines and tells results; keeps the parameters and env() values that are set on the way."""

    def __init__(self, session: GraphSession, tell: Callable[[str], None] = print):
        self.session, self.tell = session, tell
        self.params: dict[str, object] = {}
        self.env: dict[str, str] = {}
        self.pending: list[str] = []

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            if not self.line(line):
                return

    def line(self, line: str) -> bool:
        """Takes a line; false when it ends the session."""
        text = line.strip()
        if not self.pending and text.startswith(":"):
            return self.meta(text)
        if text:
            self.pending.append(line.rstrip("\n"))
        if text.endswith(";"):
            statement, self.pending = "\n".join(self.pending), []
            try:
                self.show(self.session.execute(statement, self.params, self.env))
            except Exception as e:  # what went wrong is told, and the prompt goes on
                self.tell(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        return True

    def show(self, df) -> None:
        rows = df.limit(SHOWN + 1).collect()
        self.tell(" | ".join(df.columns))
        for r in rows[:SHOWN]:
            self.tell(" | ".join("" if v is None else str(v) for v in r))
        if len(rows) > SHOWN:
            self.tell(f"... more than {SHOWN} rows")

    def meta(self, text: str) -> bool:
        name, _, rest = text.partition(" ")
        if name in (":quit", ":exit", ":q"):
            return False
        if name in (":help", ":h"):
            self.tell(HELP)
        elif name in (":tables", ":schema"):
            for t in self.session.tables():
                cols = "" if name == ":tables" else " (" + ", ".join(f"{c} {k}" for c, k in t["columns"]) + ")"
                self.tell(f"{t['kind']} {t['name']}{cols}")
        elif name == ":stats":
            for t in self.session.catalog.all():
                self.tell(f"{t.name}: {t.df.count()} rows")
        elif name == ":params":
            for k, v in sorted(self.params.items()):
                self.tell(f"{k} = {json.dumps(v)}")
        elif name in (":param", ":env"):
            key, eq, value = rest.partition("=")
            key, value = key.strip().lstrip("$"), value.strip()
            if not key or not eq:
                self.tell(f"usage: {name} name = value")
            elif name == ":env":
                self.env[key] = value
            else:
                try:
                    self.params[key] = json.loads(value)
                except ValueError:
                    self.params[key] = value.strip("'\"")
        else:
            self.tell(f"unknown command {name}; :help lists them")
        return True


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    args = sys.argv[1:]
    address = args.pop(args.index("--flight") + 1) if "--flight" in args[:-1] else None
    args = [a for a in args if a != "--flight"]
    path = args[0] if args else None
    db = Database(spark, path)
    if address:
        from .flight import GraphServer

        with GraphServer(db.session, f"grpc://{address}") as server:
            try:
                server.serve()
            except KeyboardInterrupt:  # the way to end it
                pass
    else:
        shell = Shell(db.session)

        def lines():
            while True:
                try:
                    yield input("... " if shell.pending else "> ")
                except EOFError:
                    return

        shell.run(lines())
    if path:
        db.save()


if __name__ == "__main__":
    main()
