"""Field masks: which parts of a value are kept, dropped, nulled, replaced or inserted.

X copies, _ drops, N makes NULL, (...) goes inside, [e] replaces by an expression, {e} inserts one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import compile as C
from ..plans.compile import Value
from ..plans.types import Maybe, Type, develop, equal, to_spark


class MaskProblem(ValueError):
    """A mask that is ill-formed or does not fit a type."""


@dataclass(frozen=True)
class Mask:
    """action: copy, skip, null, recurse, replace, insert."""

    action: str
    parts: tuple["Mask", ...] = ()
    expression: str = ""

    def __str__(self) -> str:
        match self.action:
            case "recurse":
                return f"({''.join(map(str, self.parts))})"
            case "replace":
                return f"[{self.expression}]"
            case "insert":
                return f"{{{self.expression}}}"
        return {"copy": "X", "skip": "_", "null": "N"}[self.action]


COPY, SKIP, NULL = Mask("copy"), Mask("skip"), Mask("null")


def parse(text: str) -> Mask:
    """A mask of only copies is a copy; an empty text copies."""
    if not text:
        return COPY
    mask, end = _parse(text, 0)
    if end < len(text):
        raise MaskProblem(f"{text[end:]!r} is left over")
    return mask


def _parse(text: str, i: int) -> tuple[Mask, int]:
    if i >= len(text):
        raise MaskProblem("a mask has no end")
    c = text[i]
    if c in "xX_nN":
        return {"x": COPY, "_": SKIP, "n": NULL}[c.lower()], i + 1
    if c == "(":
        parts, i = [], i + 1
        while i < len(text) and text[i] != ")":
            part, i = _parse(text, i)
            parts.append(part)
        if i >= len(text):
            raise MaskProblem("a parenthesis has no end")
        return (COPY if all(p == COPY for p in parts) else Mask("recurse", tuple(parts))), i + 1
    if c in "[{":
        close, depth, j, quoted = {"[": "]", "{": "}"}[c], 1, i + 1, False
        while j < len(text) and depth:
            if text[j] == '"':
                quoted = not quoted
            elif not quoted:
                depth += (text[j] == c) - (text[j] == close)
            j += 1
        if depth:
            raise MaskProblem(f"{close} is missing")
        return Mask("replace" if c == "[" else "insert", (), text[i + 1 : j - 1].strip()), j
    raise MaskProblem(f"{c!r} is no mask")


def apply(v: Value, mask: Mask, extend: bool = False) -> Value:
    """The masked value. A mask shorter than its type drops the rest (``extend``: its last action goes on); a longer
    one is an error, as are a dropped, nulled or inserted top and a NULL where none may be.
    """
    match mask.action:
        case "copy":
            return v
        case "replace":
            return C.compile_text(mask.expression, C.Env({}, [v]))
        case "null":
            return _null(v.mn)
        case "skip" | "insert":
            raise MaskProblem(f"a value cannot be {'dropped' if mask.action == 'skip' else 'inserted'} here")
    t = develop(v.mn.typ)
    if t.kind in C.CONTAINERS:
        return _container(v, t, mask, extend)
    if t.kind == "sum":
        return _sum(v, t, mask, extend)
    if t.kind not in ("tup", "rec"):
        raise MaskProblem(f"{v.mn} has no parts")
    names = t.names or [f"_{i}" for i in range(1, len(t.items) + 1)]
    made = _parts([(n, Value(v.col.getField(n), m)) for n, m in zip(names, t.items)], mask, extend)
    return _collect(made, t, v.mn.nullable, v.col)


def _null(m: Maybe) -> Value:
    if not m.nullable:
        raise MaskProblem(f"{m} may not be NULL")
    return Value(F.lit(None).cast(to_spark(m)), m)


def _parts(fields: list[tuple[str, Value]], mask: Mask, extend: bool) -> list[tuple[str, Value]]:
    out: list[tuple[str, Value]] = []
    k = 0
    for number, part in enumerate(mask.parts):
        if part.action == "insert":
            got = C.compile_text(part.expression)
            out.append((f"inserted_{number}", got))
            continue
        if k >= len(fields):
            raise MaskProblem(f"the mask is too long: {mask}")
        name, value = fields[k]
        k += 1
        if part.action != "skip" and not _empties(value.mn, part):
            out.append((name, apply(value, part, extend)))
    if extend and mask.parts and k < len(fields):
        last = mask.parts[-1]
        if last.action not in ("skip", "insert"):
            out += [(n, apply(x, last, extend)) for n, x in fields[k:]]
    return out


def _empties(m: Maybe, mask: Mask) -> bool:
    """Does a mask leave nothing of a tuple or record?"""
    t = develop(m.typ)
    return mask.action == "recurse" and t.kind in ("tup", "rec") and all(p.action == "skip" or p.action == "recurse" and i < len(t.items) and _empties(t.items[i], p) for i, p in enumerate(mask.parts))


def _collect(made: list[tuple[str, Value]], t: Type, nullable: bool, whole) -> Value:
    if not made:
        raise MaskProblem("nothing is left")
    if len(made) == 1 and t.kind == "tup":
        got = made[0][1]
        return Value(F.when(whole.isNotNull(), got.col), Maybe(got.mn.typ, True)) if nullable else got
    names = [n for n, _ in made] if t.kind == "rec" else [f"_{i}" for i in range(1, len(made) + 1)]
    col = F.struct(*[x.col.alias(n) for n, (_, x) in zip(names, made)])
    kind = Type(t.kind, tuple(x.mn for _, x in made), tuple(names) if t.kind == "rec" else ())
    return Value(F.when(whole.isNotNull(), col) if nullable else col, Maybe(kind, nullable))


def _container(v: Value, t: Type, mask: Mask, extend: bool) -> Value:
    if t.kind == "vec":
        made = _parts([(str(i), Value(v.col[i], t.items[0])) for i in range(t.extra)], mask, extend)
        if not made or not all(equal(x.mn.typ, made[0][1].mn.typ) for _, x in made):
            raise MaskProblem(f"items of {v.mn} would differ")
        return Value(F.array(*[x.col for _, x in made]), Maybe(Type("vec", (made[0][1].mn,), (), len(made)), v.mn.nullable))
    if len(mask.parts) != 1:
        raise MaskProblem(f"one mask holds for all items of {v.mn}")
    seen = {}

    def item(x):
        seen["mn"] = (got := apply(Value(x, t.items[0]), mask.parts[0], extend)).mn
        return got.col

    col = F.transform(v.col, item)
    return Value(col, Maybe(Type(t.kind, (seen["mn"],), (), t.extra), v.mn.nullable))


def _sum(v: Value, t: Type, mask: Mask, extend: bool) -> Value:
    if len(mask.parts) > len(t.items):
        raise MaskProblem(f"the mask is too long: {mask}")
    parts = list(mask.parts) + [COPY] * (len(t.items) - len(mask.parts))
    made = [apply(Value(v.col.getField(n), m), p, extend) for n, m, p in zip(t.names, t.items, parts)]
    col = F.struct(v.col.getField("tag").alias("tag"), *[x.col.alias(n) for n, x in zip(t.names, made)])
    return Value(col, Maybe(Type("sum", tuple(x.mn for x in made), t.names), v.mn.nullable))


def project(m: Maybe, mask: Mask | str, extend: bool = False) -> Maybe:
    """The type of masked values."""
    mask = parse(mask) if isinstance(mask, str) else mask
    return apply(Value(F.lit(None).cast(to_spark(m)), m), mask, extend).mn


def select(df: DataFrame, m: Maybe, mask: Mask | str, extend: bool = False) -> tuple[DataFrame, Maybe]:
    """The masked rows of a table whose columns are the fields of ``m``: a plain selection, so unused columns are
    never read.
    """
    mask = parse(mask) if isinstance(mask, str) else mask
    t = develop(m.typ)
    if mask.action == "copy":
        return df, m
    if t.kind not in ("rec", "tup") or mask.action != "recurse":
        got = apply(Value(F.col("value"), m), mask, extend)
        return df.select(got.col.alias("value")), got.mn
    names = t.names or [f"_{i}" for i in range(1, len(t.items) + 1)]
    made = _parts([(n, Value(F.col(f"`{n}`"), x)) for n, x in zip(names, t.items)], mask, extend)
    if not made:
        raise MaskProblem("nothing is left")
    if t.kind == "tup":
        made = [(f"_{i}", x) for i, (_, x) in enumerate(made, 1)]
    out = Maybe(made[0][1].mn.typ, made[0][1].mn.nullable) if len(made) == 1 and t.kind == "tup" else Maybe(Type(t.kind, tuple(x.mn for _, x in made), tuple(n for n, _ in made) if t.kind == "rec" else ()))
    return df.select(*[x.col.alias(n if len(made) > 1 or t.kind == "rec" else "value") for n, x in made]), out
