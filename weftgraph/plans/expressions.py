"""Expression trees to typed Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.typed import Typed, array, literal, same, text_of
from ..types import common, is_int, is_null, is_number, is_string
from .parser import QueryError

BOOL, LONG, DOUBLE, STRING = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "collect"))


def is_aggregate(e: tuple) -> bool:
    return e[0] == "call" and e[1] in AGGREGATES


def has_aggregate(e: object) -> bool:
    if isinstance(e, tuple):
        return bool(e) and (isinstance(e[0], str) and is_aggregate(e) if len(e) > 1 else False) or any(has_aggregate(x) for x in e)
    return isinstance(e, list) and any(has_aggregate(x) for x in e)


class Compiler:
    """Compiles expressions in one scope.

    ``lookup(name)`` gives the Typed of a variable or None, ``prop(var, key)`` that of a
    property; ``params`` and ``env`` are bound as literals.
    """

    def __init__(self, lookup: Callable[[str], Typed | None], prop: Callable[[str, str], Typed | None], params: dict, env: dict, labels: Callable[[str], list[str]] = lambda v: [], macros: dict | None = None):
        self.lookup, self.prop, self.params, self.env, self.labels, self.macros = lookup, prop, params, env, labels, macros or {}
        self.local: dict[str, Typed] = {}
        self.replaced: dict[str, Typed] = {}

    def __call__(self, e: tuple) -> Typed:
        key = repr(e)
        if key in self.replaced:
            return self.replaced[key]
        return getattr(self, "_" + e[0])(*e[1:])

    def boolean(self, e: tuple) -> Column:
        x = self(e)
        return x.col.cast("boolean") if not isinstance(x.type, T.BooleanType) else x.col

    def _lit(self, value):
        return literal(value)

    def _param(self, name):
        if name not in self.params:
            raise QueryError(f"parameter ${name} isn't given")
        return literal(self.params[name])

    def _var(self, name):
        if name in self.local:
            return self.local[name]
        got = self.lookup(name)
        if got is None:
            raise QueryError(f"unknown variable {name}")
        return got

    def _prop(self, of, key):
        if of[0] == "var" and of[1] not in self.local:
            got = self.prop(of[1], key)
            if got is not None:
                return got
        x = self(of)
        if isinstance(x.type, T.StructType):
            field = next((f for f in x.type.fields if f.name.lower() == key.lower()), None)
            if field is None:
                raise QueryError(f"no property {key}")
            return Typed(x.col[field.name], field.dataType)
        if isinstance(x.type, T.MapType):
            return Typed(F.try_element_at(x.col, F.lit(key)), x.type.valueType)
        raise QueryError(f"{of} has no properties")

    def _call(self, name, args, distinct, star):
        if name == "env":
            if len(args) != 1 or args[0][0] != "lit":
                raise QueryError("env takes one text")
            value = self.env.get(args[0][1])
            return Typed(F.lit(value), STRING) if value is not None else literal(None)
        if name in AGGREGATES:
            raise QueryError(f"{name}() isn't allowed here")
        if name in self.macros:
            names, body = self.macros[name]
            if len(names) != len(args):
                raise QueryError(f"{name} takes {len(names)} arguments")
            saved, self.local = self.local, {**self.local, **dict(zip(names, map(self, args)))}
            try:
                return self(body)
            finally:
                self.local = saved
        return scalar.call(name, [self(a) for a in args])

    def aggregate(self, name: str, args: list, distinct: bool, star: bool) -> Typed:
        """NULLs are skipped by all but collect; a sum of nothing is 0."""
        if star or name == "count" and not args:
            return Typed(F.count(F.lit(1)), LONG)
        x = self(args[0])
        col, kind = x.col, x.type
        if name == "count":
            return Typed(F.count_distinct(col) if distinct else F.count(col), LONG)
        if name == "collect":
            if distinct:
                return Typed(F.collect_set(col), T.ArrayType(kind))
            return Typed(F.transform(F.collect_list(F.struct(col.alias("x"))), lambda s: s.x), T.ArrayType(kind))
        if name in ("min", "max"):
            return Typed(F.min(col) if name == "min" else F.max(col), kind)
        if not (is_number(kind) or is_null(kind)):
            raise QueryError(f"{name} needs numbers")
        if name == "avg":
            return Typed(F.avg(F.when(F.lit(True), col.cast("double"))) if not distinct else F.expr("1") * F.sum_distinct(col.cast("double")) / F.count_distinct(col), DOUBLE)
        kind = LONG if is_int(kind) or is_null(kind) else DOUBLE
        col = col.cast(kind)
        return Typed(F.coalesce(F.sum_distinct(col) if distinct else F.sum(col), F.lit(0).cast(kind)), kind)

    def _not(self, e):
        return Typed(~self.boolean(e), BOOL)

    def _bin(self, op, a, b):
        if op in ("and", "or", "xor"):
            x, y = self.boolean(a), self.boolean(b)
            return Typed(x & y if op == "and" else x | y if op == "or" else x != y, BOOL)
        x, y = self(a), self(b)
        if op == "||" or op == "+" and (is_string(x.type) or is_string(y.type)):
            if isinstance(x.type, T.ArrayType):
                return Typed(F.concat(x.col, y.col), x.type)
            return Typed(F.concat(text_of(x) if not is_null(x.type) else F.lit(None).cast("string"), text_of(y) if not is_null(y.type) else F.lit(None).cast("string")), STRING)
        if op == "+" and isinstance(x.type, T.ArrayType):
            return Typed(F.concat(x.col, y.col if isinstance(y.type, T.ArrayType) else F.array(y.col)), x.type)
        for z in (x, y):
            if not (is_number(z.type) or is_null(z.type)):
                raise QueryError(f"{op} needs numbers")
        if op in ("&", "|", "<<", ">>"):
            p, q = x.col.cast("bigint"), y.col.cast("bigint")
            if op in "&|":
                return Typed(p.bitwiseAND(q) if op == "&" else p.bitwiseOR(q), LONG)
            return Typed(F.call_function("shiftleft" if op == "<<" else "shiftright", p, q.cast("int")), LONG)
        if op == "^":
            return Typed(F.pow(x.col.cast("double"), y.col.cast("double")), DOUBLE)
        kind = common(x.type, y.type)
        kind = LONG if is_null(kind) or is_int(kind) and not isinstance(kind, T.DecimalType) else kind
        p, q = x.cast(kind).col, y.cast(kind).col
        if op == "/":
            return Typed(F.call_function("div", p, q) if is_int(kind) else p / q, kind)
        return Typed({"+": lambda: p + q, "-": lambda: p - q, "*": lambda: p * q, "%": lambda: p % q}[op](), kind)

    def _un(self, op, e):
        x = self(e)
        return Typed(-x.col, x.type) if op == "-" else Typed(F.bitwise_not(x.col.cast("bigint")), LONG)

    def _cmp(self, op, a, b):
        x, y = self(a), self(b)
        if op == "=~":
            return Typed(F.rlike(x.cast(STRING).col, F.concat(F.lit("^(?:"), y.cast(STRING).col, F.lit(")$"))), BOOL)
        p, q = same(x, y)
        return Typed({"=": lambda: p == q, "<>": lambda: p != q, "<": lambda: p < q, "<=": lambda: p <= q, ">": lambda: p > q, ">=": lambda: p >= q}[op](), BOOL)

    def _strop(self, op, a, b):
        x, y = self(a).cast(STRING).col, self(b).cast(STRING).col
        return Typed({"starts": x.startswith, "ends": x.endswith, "contains": x.contains}[op](y), BOOL)

    def _in(self, e, over):
        x = self(e)
        if over[0] == "list":
            items = [self(i) for i in over[1]]
            if not items:
                return Typed(F.lit(False), BOOL)
            kind = common(x.type, *(i.type for i in items))
            return Typed(x.cast(kind).col.isin(*[i.cast(kind).col for i in items]), BOOL)
        y = self(over)
        if is_null(y.type):
            return Typed(F.lit(None).cast("boolean"), BOOL)
        kind = common(x.type, y.type.elementType)
        return Typed(F.array_contains(y.cast(T.ArrayType(kind)).col, x.cast(kind).col), BOOL)

    def _isnull(self, e, negated):
        col = self(e).col
        return Typed(col.isNotNull() if negated else col.isNull(), BOOL)

    def _label(self, e, labels):
        have = {x.lower() for x in self.labels(e[1])}
        return Typed(F.lit(all(x.lower() in have for x in labels)), BOOL)

    def _case(self, subject, whens, other):
        results = [self(r) for _, r in whens] + [self(other)]
        kind = common(*(r.type for r in results))
        out = None
        s = self(subject) if subject is not None else None
        for (c, _), r in zip(whens, results):
            if s is None:
                cond = self.boolean(c)
            else:
                p, q = same(s, self(c))
                cond = p.eqNullSafe(q)
            value = r.cast(kind).col
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return Typed(out.otherwise(results[-1].cast(kind).col), kind)

    def _list(self, items):
        return array([self(i) for i in items])

    def _map(self, pairs):
        values = [self(v) for _, v in pairs]
        kind = common(*(v.type for v in values))
        if not pairs:
            return Typed(F.create_map().cast("map<string,string>"), T.MapType(STRING, STRING))
        return Typed(F.create_map(*[x for (k, _), v in zip(pairs, values) for x in (F.lit(k), v.cast(kind).col)]), T.MapType(STRING, kind))

    def _index(self, e, i):
        x, k = self(e), self(i)
        if isinstance(x.type, T.MapType):
            return Typed(F.try_element_at(x.col, k.cast(STRING).col), x.type.valueType)
        if isinstance(x.type, T.StructType) and i[0] == "lit":
            return self._prop(e, str(i[1]))
        return Typed(F.when(k.col >= 1, F.try_element_at(x.col, F.greatest(k.col, F.lit(1)).cast("int"))), x.type.elementType)

    def _slice(self, e, a, b):
        x = self(e)
        start = F.greatest(self(a).col, F.lit(1)).cast("int") if a is not None else F.lit(1)
        end = F.least(self(b).col, F.size(x.col)).cast("int") if b is not None else F.size(x.col)
        return Typed(F.when(start <= end, F.slice(x.col, start, end - start + 1)).when(x.col.isNotNull(), F.slice(x.col, F.lit(1), F.lit(0))), x.type)

    def _bound(self, var: str, kind: T.DataType, e: tuple) -> Callable[[Column], Typed]:
        def build(v: Column) -> Typed:
            saved, self.local = self.local, {**self.local, var: Typed(v, kind)}
            try:
                return self(e)
            finally:
                self.local = saved

        return build

    def _comp(self, var, over, where, said):
        x = self(over)
        col, kind = x.col, x.type.elementType
        if where is not None:
            keep = self._bound(var, kind, where)
            col = F.filter(col, lambda v: keep(v).col)
        if said is None:
            return Typed(col, x.type)
        build, seen = self._bound(var, kind, said), []

        def run(v: Column) -> Column:
            t = build(v)
            seen.append(t.type)
            return t.col

        col = F.transform(col, run)
        return Typed(col, T.ArrayType(seen[-1]))

    def _quant(self, kind, var, over, pred):
        x = self(over)
        test = self._bound(var, x.type.elementType, pred)
        if kind == "all":
            return Typed(F.forall(x.col, lambda v: test(v).col), BOOL)
        if kind in ("any", "none"):
            out = F.exists(x.col, lambda v: test(v).col)
            return Typed(~out if kind == "none" else out, BOOL)
        return Typed(F.when(x.col.isNotNull(), F.size(F.filter(x.col, lambda v: test(v).col)) == 1), BOOL)

    def _exists(self, *_):
        raise QueryError("EXISTS { } is allowed as a conjunct of WHERE only")

    def _count(self, *_):
        raise QueryError("COUNT { } is allowed in WITH and RETURN items and WHERE conjuncts only")
