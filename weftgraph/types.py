"""Type names of the query language and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: DDL names and what they stand for.
NAMES: dict[str, T.DataType] = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "INT8": T.ByteType(), "TINYINT": T.ByteType(), "INT16": T.ShortType(), "SMALLINT": T.ShortType(),
    "INT32": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT64": T.LongType(), "BIGINT": T.LongType(), "SERIAL": T.LongType(),
    "INT128": T.DecimalType(38, 0), "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0),
    "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_SEC": T.TimestampNTZType(), "TIMESTAMP_MS": T.TimestampNTZType(), "TIMESTAMP_NS": T.TimestampNTZType(), "TIMESTAMP_TZ": T.TimestampType(),
    "INTERVAL": T.CalendarIntervalType() if hasattr(T, "CalendarIntervalType") else T.DayTimeIntervalType(),
    "STRING": T.StringType(), "VARCHAR": T.StringType(), "BLOB": T.BinaryType(), "BYTEA": T.BinaryType(), "UUID": T.StringType(),
    "INTERNAL_ID": T.StructType([T.StructField("table", T.LongType()), T.StructField("offset", T.LongType())]), "ANY": T.NullType(),
}


def _split(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]]]


def parse_type(name: str) -> T.DataType:
    """``INT64``, ``STRING[]``, ``FLOAT[3]``, ``LIST(T)``, ``MAP(K, V)``, ``STRUCT(f T, ...)``, ``UNION(f T, ...)``, ``DECIMAL(p, s)``."""
    text = name.strip()
    if m := re.fullmatch(r"(.+)\[\d*\]", text):
        return T.ArrayType(parse_type(m[1]))
    if m := re.fullmatch(r"(\w+)\s*\((.*)\)", text, re.S):
        kind, inner = m[1].upper(), _split(m[2])
        if kind == "DECIMAL":
            return T.DecimalType(*map(int, inner))
        if kind in ("LIST", "ARRAY"):
            return T.ArrayType(parse_type(inner[0]))
        if kind == "MAP":
            return T.MapType(parse_type(inner[0]), parse_type(inner[1]))
        if kind in ("STRUCT", "UNION"):
            fields = [T.StructField((p := x.split(None, 1))[0], parse_type(p[1])) for x in inner]
            return T.StructType(([T.StructField("tag", T.StringType())] if kind == "UNION" else []) + fields)
    if text.upper() in NAMES:
        return NAMES[text.upper()]
    raise ValueError(f"unknown type {name!r}")


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


def is_int(t: T.DataType) -> bool:
    return isinstance(t, INTEGERS) or isinstance(t, T.DecimalType) and t.scale == 0


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (*INTEGERS, *FLOATS, T.DecimalType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def common(*kinds: T.DataType) -> T.DataType:
    """The type that all can be cast to without asking: numbers widen, anything else meets in STRING."""
    known = [k for k in kinds if not is_null(k)]
    if not known:
        return T.NullType()
    if all(k == known[0] for k in known):
        return known[0]
    if all(is_number(k) for k in known):
        if any(isinstance(k, FLOATS) for k in known):
            return T.FloatType() if all(isinstance(k, T.FloatType) for k in known) else T.DoubleType()
        decimals = [k for k in known if isinstance(k, T.DecimalType)]
        return max(decimals, key=lambda d: d.precision) if decimals else max(known, key=lambda k: INTEGERS.index(type(k)))
    if all(isinstance(k, T.ArrayType) for k in known):
        return T.ArrayType(common(*(k.elementType for k in known)))
    return T.StringType()


def type_name(t: T.DataType) -> str:
    """Upper-case engine name of a type, as ``typeof`` tells it."""
    simple = {T.BooleanType: "BOOL", T.ByteType: "INT8", T.ShortType: "INT16", T.IntegerType: "INT32", T.LongType: "INT64", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "STRING", T.DateType: "DATE", T.TimestampType: "TIMESTAMP_TZ", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "BLOB", T.ArrayType: "LIST", T.MapType: "MAP", T.StructType: "STRUCT", T.DecimalType: "DECIMAL", T.NullType: "NULL"}
    return next((v for k, v in simple.items() if isinstance(t, k)), t.simpleString().upper())
