"""Encoders made of Spark's own functions, for text encodings of types whose parts have such a form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import wide
from ..plans.types import INTEGERS, Maybe, develop
from .base import Codec
from .csvtext import Csv
from .sexpr import Sexpr


class NoForm(Exception):
    """A part that only Python can encode."""


def text_column(value: Column, made: Codec) -> Column | None:
    """The encoded text of a column, or None where Spark's functions cannot tell it: then Python does, in batches."""
    write = {Sexpr: _s_expr, Csv: _csv}.get(type(made))
    if write is None:
        return None
    try:
        return write(value, made.m, made, False)
    except NoForm:
        return None


def _scalar(v: Column, kind: str, inside: bool, true: str, false: str, quoted) -> Column:
    """inside: within a lambda, where nothing may run in Python."""
    n = INTEGERS.get(kind)
    if n and n < 128 or kind == "size":
        return v.cast("string")
    if kind == "bool":
        return F.when(v, true).when(~v, false)
    if kind in ("string", "char"):
        return quoted(v)
    if inside or kind not in (*INTEGERS, "float"):
        raise NoForm
    return wide.float_text(v, False) if kind == "float" else wide.to_text(kind == "i128", v)


def _parts(v: Column, t) -> list[tuple[Column, Maybe]]:
    if t.kind == "vec":
        return [(F.get(v, F.lit(i)), t.items[0]) for i in range(int(t.extra))]
    names = t.names or [f"_{i}" for i in range(1, len(t.items) + 1)]
    return [(v.getField(n), k) for n, k in zip(names, t.items)]


def _alternatives(v: Column, t, write) -> Column:
    out = F
    for i, (n, k) in enumerate(zip(t.names, t.items)):
        text = F.lit("") if k.typ.kind == "void" else write(v.getField(n), k)
        out = out.when(v["tag"] == i, text)
    return out.otherwise(F.lit(None).cast("string"))


def _s_expr(v: Column, m: Maybe, made: Sexpr, inside: bool) -> Column:
    if m.typ.kind == "this":
        raise NoForm
    t = develop(m.typ)
    again = lambda x, k, deep=inside: _s_expr(x, k, made, deep)
    match t.kind:
        case "tup" | "rec" | "vec":
            text = F.concat(F.lit("("), F.concat_ws(" ", *[again(x, k) for x, k in _parts(v, t)]), F.lit(")"))
        case "arr" | "lst" | "set":
            body = F.concat(F.lit("("), F.array_join(F.transform(v, lambda x: again(x, t.items[0], True)), " "), F.lit(")"))
            text = F.concat(F.size(v).cast("string"), F.lit(" "), body) if made.counts else body
        case "sum":
            text = F.concat(F.lit("("), v["tag"].cast("string"), F.lit(" "), _alternatives(v, t, again), F.lit(")"))
        case _:
            escaped = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')) if made.strict else x
            text = _scalar(v, t.kind, inside, "T", "F", lambda x: F.concat(F.lit('"'), escaped(x), F.lit('"')))
    return F.when(v.isNull(), F.lit("null")).otherwise(text)


def _csv(v: Column, m: Maybe, made: Csv, inside: bool) -> Column:
    t = develop(m.typ)
    if m.typ.kind == "this" or made._joined(t):
        raise NoForm
    again = lambda x, k, deep=inside: _csv(x, k, made, deep)
    sep, q = F.lit(made.sep), made.quote
    match t.kind:
        case "tup" | "rec" | "vec":
            text = F.concat_ws(made.sep, *[again(x, k) for x, k in _parts(v, t)])
        case "arr" | "lst" | "set":
            text = F.concat(F.size(v).cast("string"), F.array_join(F.transform(v, lambda x: F.concat(sep, again(x, t.items[0], True))), ""))
        case "sum":
            if any(k.typ.kind == "void" for k in t.items):
                raise NoForm
            text = F.concat(v["tag"].cast("string"), sep, _alternatives(v, t, again))
        case _:
            quoted = lambda x: x if not q else F.concat(F.lit(q), F.replace(x, F.lit(q), F.lit(q + q)) if made.strict else x, F.lit(q))
            text = _scalar(v, t.kind, inside, made.true, made.false, quoted)
    return F.when(v.isNull(), F.lit(made.null)).otherwise(text)
