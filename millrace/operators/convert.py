"""Structural conversion of a typed column to another type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network, numbers, strings, wide
from ..plans import compile as C
from ..plans.compile import Lambda, TypeProblem, Value, build_sum, is_signed, to_int, wide_kind
from ..plans.types import INTEGERS, Maybe, Type, develop, equal, to_spark


def convert(v: Value, m: Maybe) -> Value:
    """A NULL that must not be is "NULL" in a string and "?" in a char, and an error elsewhere."""
    if v.mn.nullable and not m.nullable:
        inner = convert(Value(v.col, Maybe(v.mn.typ)), m)
        kind = develop(m.typ).kind
        if kind in ("string", "char"):
            return Value(F.when(v.col.isNull(), "NULL" if kind == "string" else "?").otherwise(inner.col), m)
        return Value(F.when(v.col.isNull(), F.raise_error(F.lit("a NULL is converted to a value")).cast(to_spark(m))).otherwise(inner.col), m)
    if v.mn.nullable:
        inner = convert(Value(v.col, Maybe(v.mn.typ)), Maybe(m.typ, True))
        return Value(F.when(v.col.isNotNull(), inner.col), m)
    if equal(v.mn.typ, m.typ):
        return Value(v.col, m)
    col, nullable = _convert(v, m.typ)
    if nullable and not m.nullable:
        col = F.coalesce(col, F.raise_error(F.lit(f"a value is no {m.typ}")).cast(to_spark(m)))
    return Value(col, m)


def _convert(v: Value, t: Type) -> tuple[Column, bool]:
    a, b = develop(v.mn.typ), develop(t)
    x = v.col
    number = a.kind in INTEGERS or a.kind in ("float", "size")
    if b.kind == "string":
        return text(v), False
    if b.kind == "bool" and number:
        return to_int(v, "u8") != 0, False
    if b.kind == "bool" and a.kind == "string":
        return F.octet_length(x) > 0, False
    if a.kind == "string":
        if b.kind == "float":
            return numbers.parse_float(x), True
        if b.kind in INTEGERS:
            return (wide.of_text(is_signed(b.kind), x) if wide_kind(b.kind) else numbers.parse_int(x, b.kind)), True
        if b.kind == "char":
            return strings.nth_char(F.lit(0), x), True
        if b.kind == "bytes":
            return F.encode(x, "utf-8"), False
    if b.kind in INTEGERS and (number or a.kind in ("bool", "char")):
        return to_int(v, b.kind), False
    if b.kind == "float" and number:
        return C.OPS["to-float"](v).col, False
    if b.kind == "float" and a.kind == "bool":
        return x.cast("double"), False
    if b.kind == "char" and a.kind == "u8":
        return C.OPS["char-of-u8"](v).col, False
    if b.kind == "sum":
        for i, alt in enumerate(b.items):
            if equal(alt.typ, v.mn.typ):
                return build_sum(b, i, x), False
    if a.kind == "vec" and a.extra == 1 and b.kind not in C.CONTAINERS:
        return convert(Value(x[0], a.items[0]), Maybe(t)).col, False
    if b.kind in ("vec", "arr") and a.kind not in (*C.CONTAINERS, "tup") and (b.kind == "arr" or b.extra == 1):
        return F.array(convert(v, b.items[0]).col), False
    if a.kind in C.CONTAINERS and b.kind in C.CONTAINERS:
        if b.kind in (a.kind, "arr") and (b.kind != "vec" or a.extra == b.extra):
            return F.transform(x, lambda i: convert(Value(i, a.items[0]), b.items[0]).col), False
    if a.kind == "tup" and (b.kind in ("tup", "arr") or b.kind == "vec" and b.extra == len(a.items)):
        parts = [Value(x.getField(f"_{i}"), m) for i, m in enumerate(a.items, 1)]
        if b.kind == "tup" and len(a.items) == len(b.items):
            return F.struct(*[convert(p, m).col.alias(f"_{i}") for i, (p, m) in enumerate(zip(parts, b.items), 1)]), False
        if b.kind != "tup":
            return F.array(*[convert(p, b.items[0]).col for p in parts]), False
    if a.kind == b.kind == "rec" and set(a.names) == set(b.names):
        return F.struct(*[convert(Value(x.getField(n), a.items[a.names.index(n)]), m).col.alias(n) for n, m in zip(b.names, b.items)]), False
    raise TypeProblem(f"no conversion of {v.mn} to {t}")


def text(v: Value) -> Column:
    """The text of a value; items of vectors and arrays in brackets, of tuples in parentheses, after semicolons."""
    t, x = develop(v.mn.typ), v.col
    name = v.mn.typ.extra if v.mn.typ.kind == "usr" else None
    if name in ("Ip4", "Ip6", "Ip"):
        return C.OPS["string-of-ip"](v).col
    if name in ("Cidr4", "Cidr6"):
        ip = network.ip4_text(x["ip"]) if name == "Cidr4" else wide.ip6_text(x["ip"])
        return F.concat(ip, F.lit("/"), x["mask"].cast("string"))
    inside = lambda i, m: text(Value(i, Maybe(m.typ))) if not m.nullable else F.when(i.isNull(), "NULL").otherwise(text(Value(i, Maybe(m.typ))))
    if t.kind in INTEGERS:
        return C.OPS["string-of-int"](v).col
    match t.kind:
        case "string" | "char":
            return x
        case "bytes":
            return F.decode(x, "utf-8")
        case "float":
            return wide.float_text(x, False)
        case "bool":
            return F.when(x, "true").otherwise("false")
        case "size":
            return x.cast("string")
        case "vec" | "arr" | "lst" | "set":
            if t.kind in ("vec", "arr") and t.items[0].typ.kind == "char" and not t.items[0].nullable:
                return F.array_join(x, "")
            return F.concat(F.lit("["), F.array_join(F.transform(x, lambda i: inside(i, t.items[0])), ";"), F.lit("]"))
        case "tup":
            return F.concat(F.lit("("), F.concat_ws(";", *[inside(x.getField(f"_{k}"), m) for k, m in enumerate(t.items, 1)]), F.lit(")"))
        case "vec":
            return text(Value(x[0], t.items[0]))
    raise TypeProblem(f"no text of {v.mn}")


def transform(df: DataFrame, m: Maybe, functions: dict[str, str]) -> tuple[DataFrame, Maybe]:
    """Apply functions (expression texts) to the scalars at paths such as /0, /2/1 or /name of each row."""
    t = develop(m.typ)
    columns = t.kind in ("rec", "tup")
    made = {path: C.compile_text(f) for path, f in functions.items()}
    for path, f in made.items():
        if not isinstance(f, Lambda):
            raise TypeProblem(f"{path}: a function is expected")
        at(m, path)
    if not columns:
        got = _rebuild(Value(F.col("value"), m), "", made)
        return df.select(got.col.alias("value")), got.mn
    names = t.names or [f"_{i}" for i in range(1, len(t.items) + 1)]
    parts = [_rebuild(Value(F.col(f"`{n}`"), x), f"/{i}", made, f"/{n}") for i, (n, x) in enumerate(zip(names, t.items))]
    return df.select(*[p.col.alias(n) for n, p in zip(names, parts)]), Maybe(Type(t.kind, tuple(p.mn for p in parts), t.names), m.nullable)


def at(m: Maybe, path: str) -> Maybe:
    """The type at a path; an error where there is none."""
    for step in path.strip("/").split("/") if path.strip("/") else []:
        t = develop(m.typ)
        if t.kind in C.CONTAINERS and step.isdigit():
            m = t.items[0]
        elif step in t.names:
            m = t.items[t.names.index(step)]
        elif step.isdigit() and int(step) < len(t.items):
            m = t.items[int(step)]
        else:
            raise TypeProblem(f"{m} has nothing at {step}")
    return m


def _rebuild(v: Value, path: str, made: dict[str, Lambda], alias: str | None = None) -> Value:
    f = made.get(path) or (made.get(alias) if alias else None)
    if f is not None:
        if v.mn.nullable and not f.params[0].nullable:
            inner = f(Value(v.col, Maybe(v.mn.typ)))
            return Value(F.when(v.col.isNotNull(), inner.col), Maybe(inner.mn.typ, True))
        return f(v)
    if not any(p.startswith(path + "/") or alias and p.startswith(alias + "/") for p in made):
        return v
    if alias:
        made = {path + p[len(alias) :] if p.startswith(alias + "/") else p: g for p, g in made.items()}
    t = develop(v.mn.typ)
    if t.kind in ("rec", "tup"):
        names = t.names or [f"_{i}" for i in range(1, len(t.items) + 1)]
        parts = [_rebuild(Value(v.col.getField(n), x), f"{path}/{i}", made, f"{path}/{n}") for i, (n, x) in enumerate(zip(names, t.items))]
        col = F.struct(*[p.col.alias(n) for n, p in zip(names, parts)])
        m = Maybe(Type(t.kind, tuple(p.mn for p in parts), t.names), v.mn.nullable)
    elif t.kind in C.CONTAINERS:
        if t.kind == "vec":
            parts = [_rebuild(Value(v.col[i], t.items[0]), f"{path}/{i}", made) for i in range(t.extra)]
            col, m = F.array(*[p.col for p in parts]), Maybe(Type("vec", (parts[0].mn,), (), t.extra), v.mn.nullable)
        else:
            seen = {}

            def item(x):
                seen["mn"] = (got := _rebuild(Value(x, t.items[0]), f"{path}/0", made)).mn
                return got.col

            col = F.transform(v.col, item)
            m = Maybe(Type(t.kind, (seen["mn"],), (), t.extra), v.mn.nullable)
    else:
        raise TypeProblem(f"nothing is inside of {v.mn}")
    return Value(F.when(v.col.isNotNull(), col) if v.mn.nullable else col, m)
