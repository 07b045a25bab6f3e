"""Scalar functions: each builds one Spark expression. NULL in, NULL out, unless said otherwise."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import common, is_null, is_number, type_name
from .typed import Typed, text_of

LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


class FunctionError(ValueError):
    """Wrong name, number or types of arguments."""


_registry: dict[str, tuple[int, int, Callable[..., Typed]]] = {}


def function(name: str, least: int, most: int | None = None):
    def put(build: Callable[..., Typed]):
        for n in name.split():
            _registry[n] = (least, most if most is not None else least, build)
        return build

    return put


def register_function(name: str, build: Callable[..., Column], returns: T.DataType | None = None, args: int | None = None) -> None:
    """Make ``name(...)`` callable from queries; ``build`` gets Spark columns. A superset of the built-in list."""
    _registry[name.lower()] = (args or 0, args if args is not None else 99, lambda *a: Typed(build(*[x.col for x in a]), returns or (a[0].type if a else STRING)))


def call(name: str, args: list[Typed]) -> Typed:
    if name not in _registry:
        raise FunctionError(f"unknown function {name}")
    least, most, build = _registry[name]
    if not least <= len(args) <= most:
        raise FunctionError(f"{name} takes {least if least == most else f'{least} to {most}'} arguments, not {len(args)}")
    return build(*args)


def known(name: str) -> bool:
    return name in _registry


def _double(x: Typed) -> Column:
    if not (is_number(x.type) or is_null(x.type)):
        raise FunctionError(f"a number is needed, not {type_name(x.type)}")
    return x.col.cast("double")


def _text(x: Typed) -> Column:
    return F.lit(None).cast("string") if is_null(x.type) else text_of(x)


# -- numbers ---------------------------------------------------------------
@function("abs", 1)
def _abs(x):
    return Typed(F.abs(x.col), x.type if is_number(x.type) else LONG)


for _name, _f in {"floor": F.floor, "ceil": F.ceil, "round": F.round, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan}.items():
    function(_name, 1)(lambda x, f=_f: Typed(f(_double(x)).cast("double"), DOUBLE))
for _name, _f in {"log": F.log, "log2": F.log2, "log10": F.log10}.items():
    # the logarithm of 0 is -inf and of less NaN, as for IEEE numbers
    function(_name, 1)(lambda x, f=_f: Typed(F.when(_double(x) == 0, float("-inf")).when(_double(x) < 0, float("nan")).otherwise(f(_double(x))), DOUBLE))
function("ln", 1)(lambda x: call("log", [x]))


@function("sign", 1)
def _sign(x):
    return Typed(F.signum(_double(x)).cast("bigint"), LONG)


def _extreme(f):
    def build(*args: Typed) -> Typed:
        kind = common(*(a.type for a in args))
        cols = [a.cast(kind).col for a in args]
        return Typed(f(*cols) if len(cols) > 1 else cols[0], kind)

    return build


function("greatest", 1, 99)(_extreme(F.greatest))
function("least", 1, 99)(_extreme(F.least))

# -- strings ---------------------------------------------------------------
for _name, _f in {"lower tolower": F.lower, "upper toupper": F.upper}.items():
    function(_name, 1)(lambda s, f=_f: Typed(f(_text(s)), STRING))


@function("length size", 1)
def _length(x):
    """UTF-8 bytes of a string, elements of a list."""
    if isinstance(x.type, (T.ArrayType, T.MapType)):
        return Typed(F.when(x.col.isNotNull(), F.size(x.col)).cast("bigint"), LONG)
    return Typed(F.octet_length(_text(x)).cast("bigint"), LONG)


for _name, _p in {"trim": r"(?U)^\s+|\s+$", "ltrim": r"(?U)^\s+", "rtrim": r"(?U)\s+$"}.items():
    function(_name, 1)(lambda s, p=_p: Typed(F.regexp_replace(_text(s), p, ""), STRING))


@function("reverse", 1)
def _reverse(x):
    return Typed(F.reverse(x.col), x.type) if isinstance(x.type, T.ArrayType) else Typed(F.reverse(_text(x)), STRING)


@function("substring", 2, 3)
def _substring(s, start, size=None):
    """From ``start`` (1 is the first; 0 counts as 1; less gives an empty text)."""
    n = size.col.cast("int") if size else F.char_length(_text(s))
    out = F.when(start.col < 0, F.lit("")).otherwise(F.substr(_text(s), F.greatest(start.col.cast("int"), F.lit(1)), F.greatest(n, F.lit(0))))
    return Typed(F.when(_text(s).isNotNull() & start.col.isNotNull() & n.isNotNull(), out), STRING)


function("left", 2)(lambda s, n: Typed(F.left(_text(s), n.col.cast("int")), STRING))
function("right", 2)(lambda s, n: Typed(F.right(_text(s), n.col.cast("int")), STRING))
function("replace", 3)(lambda s, a, b: Typed(F.replace(_text(s), _text(a), _text(b)), STRING))
function("concat", 1, 99)(lambda *a: Typed(F.concat(*[_text(x) for x in a]), STRING))


def _pad(left: bool):
    def build(s: Typed, size: Typed, pad: Typed) -> Typed:
        """To ``size`` bytes; never cuts; whole pads first, part of one outermost. An empty pad changes nothing."""
        text, n, p = _text(s), size.col.cast("bigint"), _text(pad)
        gap = n - F.octet_length(text)
        whole = F.repeat(p, F.floor(gap / F.char_length(p)).cast("int"))
        part = F.left(p, (gap % F.char_length(p)).cast("int"))
        filled = F.concat(part, whole, text) if left else F.concat(text, whole, part)
        out = F.when((gap <= 0) | (F.char_length(p) == 0), text).otherwise(filled)
        return Typed(F.when(text.isNotNull() & n.isNotNull() & p.isNotNull(), out), STRING)

    return build


function("lpad", 3)(_pad(True))
function("rpad", 3)(_pad(False))

# -- conversions -----------------------------------------------------------
function("tostring", 1)(lambda x: Typed(_text(x), STRING))


@function("tointeger", 1)
def _tointeger(x):
    """DOUBLE is cut off, BOOL is 0 or 1, other text than an integer is an error."""
    if isinstance(x.type, T.StringType):
        fine = x.col.rlike(r"^\s*[+-]?\d+\s*$")
        return Typed(F.when(x.col.isNull() | fine, x.col).otherwise(F.raise_error(F.concat(F.lit("not an integer: "), x.col))).cast("bigint"), LONG)
    return Typed(x.col.cast("bigint"), LONG)


@function("tofloat todouble", 1)
def _tofloat(x):
    if isinstance(x.type, T.BooleanType):
        raise FunctionError("tofloat doesn't take BOOL")
    return Typed(x.col.cast("double"), DOUBLE)


@function("toboolean", 1)
def _toboolean(x):
    if is_number(x.type):
        return Typed(x.col != 0, BOOL)
    if isinstance(x.type, T.BooleanType):
        return x
    low = F.lower(_text(x))
    return Typed(F.when(low == "true", True).when(low == "false", False).when(low.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), _text(x))).cast("boolean")), BOOL)


@function("coalesce", 1, 99)
def _coalesce(*args):
    kind = common(*(a.type for a in args))
    return Typed(F.coalesce(*[a.cast(kind).col for a in args]), kind)


function("typeof", 1)(lambda x: Typed(F.when(x.col.isNull(), "NULL").otherwise(type_name(x.type)), STRING))
function("hash", 1)(lambda x: Typed(F.when(x.col.isNotNull(), F.xxhash64(x.col)), LONG))


@function("range", 2)
def _range(a, b):
    """Inclusive and ascending; empty if a > b."""
    out = F.when(a.col <= b.col, F.sequence(a.col.cast("bigint"), b.col.cast("bigint"))).when(a.col > b.col, F.array().cast("array<bigint>"))
    return Typed(out, T.ArrayType(LONG))


# -- JSON (of the text of a value) -------------------------------------------
def _path(p: Typed) -> Column:
    """``a.b``, ``$.a.b``, ``.1`` and ``.[1]`` as Spark's ``$.a.b[1]``."""
    s = F.regexp_replace(_text(p), r"^\$?\.?", "")
    s = F.regexp_replace(F.concat(F.lit("."), s), r"\.\[?(\d+)\]?(?=\.|$)", "[$1]")
    return F.when(s == ".", "$").otherwise(F.concat(F.lit("$"), s))


def _json(s: Typed) -> Column:
    text = _text(s)
    return F.when(text.isNull() | F.try_parse_json(text).isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), text)))


function("json_extract", 2)(lambda s, p: Typed(F.call_function("get_json_object", _json(s), _path(p)), STRING))
function("json_valid", 1)(lambda s: Typed(F.when(_text(s).isNotNull(), (F.try_parse_json(_text(s)).isNotNull()) & (F.trim(_text(s)) != "")), BOOL))


@function("json_type", 1)
def _json_type(s):
    text = F.ltrim(_json(s))
    first = F.left(text, F.lit(1))
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first == "n", "null").when(first.isin("t", "f"), "boolean").when(text.isNotNull(), "number")
    return Typed(kind, STRING)


function("json_keys", 1)(lambda s: Typed(F.json_object_keys(_json(s)), T.ArrayType(STRING)))
function("json_array_length", 1)(lambda s: Typed(F.json_array_length(_json(s)).cast("bigint"), LONG))
function("json_contains", 2)(lambda s, p: Typed(F.when(_text(s).isNotNull(), F.call_function("try_variant_get", F.parse_json(_json(s)), _path(p), F.lit("variant")).isNotNull()), BOOL))


def _set_in(doc: str | None, path: str | None, value: str | None) -> str | None:
    if doc is None or path is None or value is None:
        return None
    root = json.loads(doc)
    try:
        new = json.loads(value)
    except ValueError:
        new = value
    steps = [x.strip("[]") for x in re.sub(r"^\$?\.?", "", path).split(".") if x]
    if not steps:
        return json.dumps(new, separators=(",", ":"), ensure_ascii=False)
    at = root
    for i, key in enumerate(steps):
        last = i == len(steps) - 1
        if isinstance(at, list) and key.isdigit() and int(key) < len(at):
            key = int(key)
        elif not isinstance(at, dict) or not last and key not in at:
            raise ValueError(f"no place {path} in {doc}")
        if last:
            at[key] = new
        else:
            at = at[key]
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


@function("json_set", 3)
def _json_set(s, p, v):
    """No Spark function changes a JSON text, so this one is an Arrow-batched Python function."""
    import pandas as pd

    def put(doc, path, value):
        return pd.Series([_set_in(*x) for x in zip(doc, path, value)], dtype=object)

    put.__annotations__ = {"doc": pd.Series, "path": pd.Series, "value": pd.Series, "return": pd.Series}
    return Typed(F.pandas_udf(put, STRING)(_text(s), _text(p), _text(v)), STRING)


def scalar_names() -> list[str]:
    return sorted(_registry)
