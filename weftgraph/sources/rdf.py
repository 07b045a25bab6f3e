"""RDF: N-Triples and N-Quads by line, Turtle and RDF/XML by file; schema inference into node and relationship tables."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import DST, SRC, Table
from ..types import parse_type

SCHEMA = "s string, p string, o_uri string, o_lit string, o_dt string, o_lang string"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: XSD types of INT64; others stand below.
INTEGER_TYPES = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
_LINE = r"""^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:[^\s.]+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([\w-]+))?)\s*(?:<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$"""
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<uri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}.*?\"{3}|'{3}.*?'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<dir>@prefix|@base|PREFIX\b|BASE\b)|(?P<lang>@[a-zA-Z]+(?:-\w+)*)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<bnode>_:[\w.-]*\w)|(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%-]+(?:\.[\w%-]+)*)?|true\b|false\b|a(?=[\s<\[]))|(?P<op>[;,.\[\]()])""",
    re.S | re.I,
)


def _unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[3], m[3]), text, flags=re.S)


def _unescaped(text: Column) -> Column:
    """``_unescape`` as a Spark expression, in one pass: the text is split into escapes and what stands between them."""
    code = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    signs = F.create_map(*[F.lit(x) for x in ("n", "\n", "t", "\t", "r", "\r", "b", "\b", "f", "\f")])

    def one(x: Column) -> Column:
        hexed = x.rlike(r"^\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})$")
        sign = F.substring(x, 2, 1)
        return F.when(~F.startswith(x, F.lit("\\")), x).when(hexed, code(F.substring(x, 3, 8))).otherwise(F.coalesce(F.try_element_at(signs, sign), sign))

    parts = F.regexp_extract_all(text, F.lit(r"(?s)[^\\]+|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\."), 0)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def turtle(text: str) -> list[tuple]:
    """Triples of a Turtle text."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"Turtle: unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    out, prefixes, base, blank, i = [], {}, "", 0, 0

    def uri(tok: tuple[str, str]) -> str:
        kind, v = tok
        if kind == "uri":
            v = _unescape(v[1:-1])
            return v if re.match(r"[a-zA-Z][\w+.-]*:", v) else base + v
        if kind == "bnode":
            return v
        if kind == "name" and ":" in v:
            p, local = v.split(":", 1)
            if p not in prefixes:
                raise ValueError(f"Turtle: prefix {p}: isn't declared")
            return prefixes[p] + local
        raise ValueError(f"Turtle: expected a name, found {v!r}")

    def node():
        """(uri, literal, datatype, language)"""
        nonlocal i, blank
        kind, v = tokens[i]
        i += 1
        if kind == "op" and v == "[":
            blank += 1
            me = f"_:b{blank}"
            if tokens[i] != ("op", "]"):
                predicates(me)
            i += 1
            return me, None, None, None
        if kind == "op" and v == "(":
            items = []
            while tokens[i] != ("op", ")"):
                items.append(node())
            i += 1
            head = RDF + "nil"
            for item in reversed(items):
                blank += 1
                cell = f"_:b{blank}"
                out.append((cell, RDF + "first", *item))
                out.append((cell, RDF + "rest", head, None, None, None))
                head = cell
            return head, None, None, None
        if kind in ("str", "long"):
            value = _unescape(v[3:-3] if kind == "long" else v[1:-1])
            if i < len(tokens) and tokens[i][0] == "dt":
                i += 2
                dt = uri(tokens[i - 1])
                return None, value, None if dt == XSD + "string" else dt, None
            if i < len(tokens) and tokens[i][0] == "lang":
                i += 1
                return None, value, None, tokens[i - 1][1][1:]
            return None, value, None, None
        if kind == "num":
            return None, v, XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), None
        if kind == "name" and v.lower() in ("true", "false"):
            return None, v.lower(), XSD + "boolean", None
        return uri((kind, v)), None, None, None

    def predicates(s: str) -> None:
        nonlocal i
        while True:
            p = TYPE if tokens[i] == ("name", "a") else uri(tokens[i])
            i += 1
            while True:
                out.append((s, p, *node()))
                if tokens[i] != ("op", ","):
                    break
                i += 1
            if tokens[i] != ("op", ";"):
                return
            while tokens[i] == ("op", ";"):
                i += 1
            if tokens[i] in (("op", "."), ("op", "]")):
                return

    while i < len(tokens):
        kind, v = tokens[i]
        if kind == "dir":
            if "base" in v.lower():
                base = tokens[i + 1][1][1:-1]
                i += 2
            else:
                prefixes[tokens[i + 1][1].rstrip(":")] = uri(tokens[i + 2])
                i += 3
            if v.startswith("@") and i < len(tokens) and tokens[i] == ("op", "."):
                i += 1
            continue
        start = i
        s = node()[0]
        if not (tokens[start] == ("op", "[") and tokens[i] == ("op", ".")):
            predicates(s)
        if i >= len(tokens) or tokens[i] != ("op", "."):
            raise ValueError("Turtle: a statement doesn't end with a full stop")
        i += 1
    return out


def rdf_xml(text: str) -> list[tuple]:
    """Triples of an RDF/XML text: typed nodes, property elements and attributes, resources, literals, nested nodes."""
    out: list[tuple] = []
    blank = [0]
    name = lambda tag: tag[1:].replace("}", "") if tag.startswith("{") else tag

    def node(e: ET.Element) -> str:
        me = e.get(f"{{{RDF}}}about") or (f"#{e.get(f'{{{RDF}}}ID')}" if e.get(f"{{{RDF}}}ID") else None)
        if me is None:
            if e.get(f"{{{RDF}}}nodeID"):
                me = "_:" + e.get(f"{{{RDF}}}nodeID")
            else:
                blank[0] += 1
                me = f"_:b{blank[0]}"
        if name(e.tag) != RDF + "Description":
            out.append((me, TYPE, name(e.tag), None, None, None))
        for k, v in e.attrib.items():
            if not k.startswith(f"{{{RDF}}}") and "XML/1998" not in k:
                out.append((me, name(k), None, v, None, None))
        for c in e:
            p, dt = name(c.tag), c.get(f"{{{RDF}}}datatype")
            if c.get(f"{{{RDF}}}resource") is not None:
                out.append((me, p, c.get(f"{{{RDF}}}resource"), None, None, None))
            elif c.get(f"{{{RDF}}}nodeID"):
                out.append((me, p, "_:" + c.get(f"{{{RDF}}}nodeID"), None, None, None))
            elif len(c):
                out.append((me, p, node(c[0]), None, None, None))
            else:
                out.append((me, p, None, c.text or "", None if dt == XSD + "string" else dt, c.get("{http://www.w3.org/XML/1998/namespace}lang")))
        return me

    root = ET.fromstring(text)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return out


def triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o_uri, o_lit, o_dt, o_lang of a file or folder; the ending tells the format, Turtle if it is unknown."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("nt", "nq"):
        lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
        part = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
        bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
        checked = F.when(F.col("value").rlike(_LINE), bare(part(1))).otherwise(F.raise_error(F.concat(F.lit("no triple: "), "value")))
        plain = _unescaped(F.regexp_extract("value", _LINE, 4))
        dt = part(5)
        return lines.select(checked.alias("s"), part(2).alias("p"), bare(part(3)).alias("o_uri"), F.when(part(3).isNull(), plain).alias("o_lit"), F.when(dt != XSD + "string", dt).alias("o_dt"), part(6).alias("o_lang"))
    read = rdf_xml if kind in ("rdf", "owl", "xml") else turtle

    def decode(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rows = read(bytes(blob).decode())
                yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.string()) for i, k in enumerate(("s", "p", "o_uri", "o_lit", "o_dt", "o_lang"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, SCHEMA)


def local_name(uri):
    return F.regexp_extract(uri, r"([^#/]*)$", 1) if not isinstance(uri, str) else re.split(r"[#/]", uri)[-1]


def column_type(dt: str | None) -> str:
    name = (dt or "").removeprefix(XSD)
    return "INT64" if name in INTEGER_TYPES else {"float": "FLOAT", "double": "DOUBLE", "decimal": "DOUBLE", "boolean": "BOOL"}.get(name, "STRING")


def infer(t: DataFrame) -> dict[str, DataFrame | tuple]:
    """Node tables {name: (frame with uri)} and relationship tables {name: (frame, from, to)}.

    A node's table is its rdf:type's local name (the last by URI, if several), ``Resource`` without
    one. A property's type is that of its least datatype name; what doesn't fit is NULL.
    """
    t = t.distinct()
    typed = t.filter((F.col("p") == TYPE) & F.col("o_uri").isNotNull()).groupBy("s").agg(F.max(F.struct(local_name(F.col("o_uri")).alias("n"))).alias("x")).select("s", F.col("x.n").alias("table"))
    links = t.filter((F.col("p") != TYPE) & F.col("o_uri").isNotNull())
    literals = t.filter(F.col("o_uri").isNull()).withColumn("prop", local_name(F.col("p")))
    named = links.select("s").union(links.select("o_uri")).union(literals.select("s")).union(typed.select("s")).distinct()
    nodes = named.join(typed, "s", "left").select("s", F.coalesce("table", F.lit("Resource")).alias("table"))
    props = literals.join(nodes, "s").groupBy("table", "prop").agg(F.min("o_dt").alias("dt"), F.count(F.when(F.col("o_dt").isNull(), 1)).alias("plain")).collect()
    values = literals.join(nodes, "s").groupBy("table", "s", "prop").agg(F.max("o_lit").alias("v"))
    out: dict[str, DataFrame | tuple] = {}
    for name in sorted(r[0] for r in nodes.select("table").distinct().collect()):
        mine = sorted((r["prop"], column_type(None if r["plain"] else r["dt"])) for r in props if r["table"] == name)
        wide = nodes.filter(F.col("table") == name).select("s")
        if mine:
            pivot = values.filter(F.col("table") == name).groupBy("s").pivot("prop", [p for p, _ in mine]).agg(F.first("v"))
            wide = wide.join(pivot, "s", "left")
        out[name] = wide.select(F.col("s").alias("uri"), *[F.col(f"`{p}`").try_cast(parse_type(k)).alias(p) for p, k in mine])
    ends = links.join(nodes.withColumnsRenamed({"table": "a"}), "s").join(nodes.select(F.col("s").alias("o_uri"), F.col("table").alias("b")), "o_uri").select(local_name(F.col("p")).alias("rel"), "a", "b", F.col("s").alias(SRC), F.col("o_uri").alias(DST))
    kinds = sorted(tuple(r) for r in ends.select("rel", "a", "b").distinct().collect())
    for rel, a, b in kinds:
        name = rel if sum(k[0] == rel for k in kinds) == 1 and rel not in out else f"{rel}_{a}_{b}"
        out[name] = (ends.filter((F.col("rel") == rel) & (F.col("a") == a) & (F.col("b") == b)).select(SRC, DST), a, b)
    return out


def load(session, path: str) -> None:
    """LOAD FROM: infer tables and put them into the catalog."""
    register_tables(session, infer(triples(session.spark, path)))


def register_tables(session, found: dict[str, DataFrame | tuple]) -> None:
    """Put inferred tables into the catalog; none may be there already."""
    from ..plans.parser import QueryError

    for name in found:
        if session.catalog.get(name):
            raise QueryError(f"table {name} exists")
    for name, x in found.items():
        if isinstance(x, DataFrame):
            session.catalog.put(Table(name, x, key="uri"))
    for name, x in found.items():
        if not isinstance(x, DataFrame):
            session.catalog.put(Table(name, x[0], source=x[1], target=x[2]))


def stats(spark: SparkSession, path: str) -> DataFrame:
    t = triples(spark, path)
    return t.agg(F.count("*").alias("triple_count"), F.count_distinct("s").alias("subject_count"), F.count_distinct("p").alias("predicate_count"), F.count(F.when(F.col("p") == TYPE, 1)).alias("type_count"))


def prefixes(spark: SparkSession, path: str) -> DataFrame:
    pattern = r"(?i)^\s*@?prefix\s+([\w.-]*):\s*<([^>]*)>"
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("prefix"), F.regexp_extract("value", pattern, 2).alias("namespace")).distinct()


def types(spark: SparkSession, path: str) -> DataFrame:
    t = triples(spark, path).filter((F.col("p") == TYPE) & F.col("o_uri").isNotNull())
    return t.groupBy(F.col("o_uri").alias("type_uri")).agg(F.count("*").alias("count")).select("type_uri", local_name(F.col("type_uri")).alias("local_name"), "count").orderBy(F.desc("count"), "type_uri")


def register(session) -> None:
    session.register_procedure("rdf.stats", lambda s, path: stats(s.spark, path))
    session.register_procedure("rdf.prefixes", lambda s, path: prefixes(s.spark, path))
    session.register_procedure("rdf.types", lambda s, path: types(s.spark, path))


