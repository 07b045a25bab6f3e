"""A Spark column together with its type, as the binder knows it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import common, is_int, is_null


@dataclass(frozen=True)
class Typed:
    col: Column
    type: T.DataType

    def cast(self, to: T.DataType) -> Typed:
        if self.type == to:
            return self
        if isinstance(to, T.StringType) and not is_null(self.type):
            return Typed(text_of(self), to)
        return Typed(self.col.cast(to), to)


def literal(value: object) -> Typed:
    """A Python value as a typed literal: int is INT64, float DOUBLE, list LIST, dict STRUCT, None NULL."""
    if value is None:
        return Typed(F.lit(None), T.NullType())
    if isinstance(value, bool):
        return Typed(F.lit(value), T.BooleanType())
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), T.LongType()) if abs(value) < 1 << 63 else Typed(F.lit(value).cast("decimal(38,0)"), T.DecimalType(38, 0))
    if isinstance(value, float):
        return Typed(F.lit(value), T.DoubleType())
    if isinstance(value, (list, tuple)):
        return array([literal(x) for x in value])
    if isinstance(value, dict):
        items = {k: literal(v) for k, v in value.items()}
        return Typed(F.struct(*[v.col.alias(k) for k, v in items.items()]), T.StructType([T.StructField(k, v.type) for k, v in items.items()]))
    return Typed(F.lit(str(value)) if not isinstance(value, str) else F.lit(value), T.StringType())


def array(items: list[Typed]) -> Typed:
    kind = common(*(x.type for x in items))
    if not items:
        return Typed(F.array(), T.ArrayType(T.NullType()))
    return Typed(F.array(*[x.cast(kind).col for x in items]), T.ArrayType(kind))


def text_of(x: Typed) -> Column:
    """Text form: whole DOUBLEs without ``.0``, lists as ``[1,2]``, true/false."""
    t = x.type
    if isinstance(t, T.StringType):
        return x.col
    if isinstance(t, (T.FloatType, T.DoubleType)):
        whole = (F.abs(x.col) < 1e15) & (x.col == F.floor(x.col))
        return F.when(whole, x.col.cast("bigint").cast("string")).otherwise(F.regexp_replace(x.col.cast("string"), r"\.0$", ""))
    if isinstance(t, T.ArrayType):
        inner = F.transform(x.col, lambda v: F.coalesce(text_of(Typed(v, t.elementType)), F.lit("NULL")))
        return F.when(x.col.isNotNull(), F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")))
    return x.col.cast("string")


def same(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Both columns in their common type."""
    kind = common(a.type, b.type)
    if is_null(kind) or is_int(a.type) and is_int(b.type):
        return a.col, b.col
    return a.cast(kind).col, b.cast(kind).col
