"""Logical types: a compact grammar, equality, zero values, and the Spark types that hold them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import types as S


class SchemaError(ValueError):
    """A type text or a type that makes no sense."""


#: Bits of the integer types.
SIGNED = {"i8": 8, "i16": 16, "i24": 24, "i32": 32, "i40": 40, "i48": 48, "i56": 56, "i64": 64, "i128": 128}
UNSIGNED = {"u8": 8, "u16": 16, "u24": 24, "u32": 32, "u40": 40, "u48": 48, "u56": 56, "u64": 64, "u128": 128}
INTEGERS = {**SIGNED, **UNSIGNED}
PLAIN = {"void", "bool", "char", "float", "string", "bytes", "ptr", "size", "address", "mask", *INTEGERS}
SETS = ("simple", "sliding", "tumbling", "sampling", "hashtable", "heap", "top")


@dataclass(frozen=True)
class Type:
    """kind: a plain name or vec, arr, lst, set, tup, rec, sum, map, fun, ext, usr, this.

    items: the types inside; names: of fields or alternatives; extra: a dimension, a set's flavour, or a name.
    """

    kind: str
    items: tuple["Maybe", ...] = ()
    names: tuple[str, ...] = ()
    extra: object = None

    def __str__(self) -> str:
        return text_of(self)


@dataclass(frozen=True)
class Maybe:
    """A type that may be nullable and may have a default (the text of an expression)."""

    typ: Type
    nullable: bool = False
    default: str | None = None

    def __str__(self) -> str:
        out = text_of(self.typ) + "?" * self.nullable
        return out + (f" default {self.default}" if self.default is not None else "")


def plain(kind: str, nullable: bool = False) -> Maybe:
    return Maybe(Type(kind), nullable)


def named(kind: str, definition: Maybe) -> Type:
    return Type("usr", (definition,), (), kind)


def _cidr(kind: str, ip: str) -> Type:
    return named(kind, Maybe(Type("rec", (Maybe(USER[ip]), plain("u8")), ("ip", "mask"))))


USER: dict[str, Type] = {}
USER["date"] = named("Date", plain("float"))
USER["eth"] = named("Eth", plain("u48"))
USER["ip4"] = named("Ip4", plain("u32"))
USER["ip6"] = named("Ip6", plain("u128"))
USER["ip"] = named("Ip", Maybe(Type("sum", (Maybe(USER["ip4"]), Maybe(USER["ip6"])), ("v4", "v6"))))
USER["cidr4"] = _cidr("Cidr4", "ip4")
USER["cidr6"] = _cidr("Cidr6", "ip6")
USER["cidr"] = named("Cidr", Maybe(Type("sum", (Maybe(USER["cidr4"]), Maybe(USER["cidr6"])), ("v4", "v6"))))
USER["globals_map"] = named("globals_map", Maybe(Type("map", (plain("string"), plain("string")))))


def text_of(t: Type) -> str:
    it = [str(x) for x in t.items]
    match t.kind:
        case "vec":
            return f"{it[0]}[{t.extra}]"
        case "arr":
            return f"{it[0]}[]"
        case "lst":
            return f"{it[0]}[[]]"
        case "set":
            return f"{it[0]}{{{'' if t.extra == 'simple' else t.extra}}}"
        case "map":
            return f"{it[1]}[{it[0]}]"
        case "tup":
            return f"({'; '.join(it)})"
        case "rec":
            return "{" + "; ".join(f"{n}: {x}" for n, x in zip(t.names, it)) + "}"
        case "sum":
            return "[" + " | ".join(n if x.typ.kind == "void" else f"{n} {x}" for n, x in zip(t.names, t.items)) + "]"
        case "fun":
            return f"({' -> '.join(it)})"
        case "ext":
            return f"${t.extra}"
        case "usr":
            return str(t.extra)
        case "this":
            return str(t.extra[0] if isinstance(t.extra, tuple) else t.extra)
    return t.kind.upper()


_TOKEN = re.compile(r"\s+|//[^\n]*|->|[A-Za-z_][A-Za-z0-9_'-]*|\d+|\$[A-Za-z_][A-Za-z0-9_]*|`[^`]*`|.", re.S)


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text) if not m.group().isspace() and not m.group().startswith("//")]
        self.at = 0
        self.names: list[str] = []
        self.named: dict[str, Maybe] = {}

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def next(self) -> str:
        token = self.peek()
        if not token:
            raise SchemaError(f"the type ends too early: {self.text!r}")
        self.at += 1
        return token

    def expect(self, token: str) -> None:
        if (got := self.next()) != token:
            raise SchemaError(f"{token!r} is missing before {got!r} in {self.text!r}")

    def maybe(self) -> Maybe:
        if self.peek(1).lower() == "as" and self.peek() not in "([{":
            name = self.next()
            self.next()
            if name in self.names:
                raise SchemaError(f"{name} is defined twice")
            self.names.append(name)
            self.named[name] = got = self.maybe()
            return got
        if self.peek() == "&":
            self.next()
            return Maybe(Type("vec", (self.maybe(),), (), 1))
        typ, nullable = self.base(), False
        while True:
            token = self.peek()
            if token == "?":
                self.next()
                nullable = True
            elif token == "[":
                typ, nullable = self.bracket(Maybe(typ, nullable)), False
            elif token == "{":
                self.next()
                flavour = "simple" if self.peek() == "}" else self.next().lower()
                self.expect("}")
                if flavour not in SETS:
                    raise SchemaError(f"no set is called {flavour}")
                typ, nullable = Type("set", (Maybe(typ, nullable),), (), flavour), False
            elif token.lower() == "default":
                self.next()
                return Maybe(typ, nullable, self.expression())
            else:
                return Maybe(typ, nullable)

    def bracket(self, item: Maybe) -> Type:
        self.expect("[")
        token = self.peek()
        if token == "]":
            self.next()
            return Type("arr", (item,))
        if token == "[" and self.peek(1) == "]":
            self.at += 2
            self.expect("]")
            return Type("lst", (item,))
        if token.isdigit() and self.peek(1) == "]":
            self.at += 2
            if not int(token):
                raise SchemaError("a vector has one item at least")
            return Type("vec", (item,), (), int(token))
        key = self.maybe()
        self.expect("]")
        return Type("map", (key, item))

    def expression(self) -> str:
        """The text of one s-expression, as it stands."""
        start = self.tokens[self.at][1]
        i, depth, quoted = start, 0, False
        while i < len(self.text):
            c = self.text[i]
            if quoted:
                quoted = c != '"' or self.text[i - 1] == "\\"
            elif c == '"':
                quoted = True
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                if not depth:
                    break
                depth -= 1
                if not depth and self.text[start] in "([{":
                    i += 1
                    break
            elif c in ";|" and not depth:
                break
            i += 1
        while self.at < len(self.tokens) and self.tokens[self.at][1] < i:
            self.at += 1
        return self.text[start:i].strip()

    def base(self) -> Type:
        token = self.next()
        low = token.lower()
        if token == "(":
            first = self.maybe()
            items = [first]
            if self.peek() == "->":
                while self.peek() == "->":
                    self.next()
                    items.append(self.maybe())
                self.expect(")")
                return Type("fun", tuple(items))
            while self.peek() == ";":
                self.next()
                if self.peek() != ")":
                    items.append(self.maybe())
            self.expect(")")
            if len(items) == 1:
                return Type("paren", (first,)) if first.nullable else first.typ
            return Type("tup", tuple(items))
        if token == "{":
            names, items = [], []
            while self.peek() != "}":
                names.append(self.next())
                self.expect(":")
                items.append(self.maybe())
                if self.peek() == ";":
                    self.next()
            self.expect("}")
            if not names or len(set(names)) < len(names):
                raise SchemaError(f"fields are empty or repeated: {names}")
            return Type("rec", tuple(items), tuple(names))
        if token == "[":
            names, items = [], []
            while True:
                names.append(self.next())
                items.append(plain("void") if self.peek() in ("|", "]") else self.maybe())
                if self.next() == "]":
                    break
            if len(set(names)) < len(names):
                raise SchemaError(f"alternatives are repeated: {names}")
            return Type("sum", tuple(items), tuple(names))
        if token[0] == "$":
            return Type("ext", (), (), token[1:])
        if low in PLAIN:
            return Type(low)
        if low in USER:
            return USER[low]
        if low == "this" or token in self.names:
            return Type("this", (), (), "THIS" if low == "this" else token)
        raise SchemaError(f"no type is called {token!r}")


def _no_parens(m: Maybe) -> Maybe:
    t = m.typ
    if t.kind == "paren":
        inner = _no_parens(t.items[0])
        return replace(inner, nullable=inner.nullable or m.nullable, default=m.default)
    if t.kind == "usr":
        return m
    return Maybe(replace(t, items=tuple(_no_parens(x) for x in t.items)), m.nullable, m.default)


#: Names of column types in headers of the other syntax.
COLUMNS = {
    "UInt8": "u8", "UInt16": "u16", "UInt32": "u32", "UInt64": "u64", "UInt128": "u128", "Int8": "i8", "Int16": "i16", "Int32": "i32", "Int64": "i64", "Int128": "i128",
    "Float32": "float", "Float64": "float", "String": "string", "Boolean": "bool", "Bool": "bool", "UUID": "u128", "DateTime": "u32", "Date": "u16", "Decimal32": "i32", "Decimal64": "i64", "Decimal128": "i128", "IPv4": "u32", "IPv6": "u128",
}


def _header(text: str) -> Maybe | None:
    """A record from a header of backquoted names and column types; None if the text is no such header."""
    rows = re.findall(r"`([^`]+)`\s+([^`]+)", text)
    if not rows or re.sub(r"`[^`]+`\s+[^`]+", "", text).strip():
        return None

    def column(t: str) -> Maybe:
        t = t.strip().rstrip(",;").strip()
        if m := re.fullmatch(r"(\w+)\((.*)\)", t, re.S):
            if m[1] == "Array":
                return Maybe(Type("arr", (column(m[2]),)))
            if m[1] == "Nullable":
                return replace(column(m[2]), nullable=True)
            if m[1] == "LowCardinality":
                return column(m[2])
            if m[1] == "FixedString":
                return Maybe(Type("vec", (plain("char"),), (), int(m[2])))
            t = m[1]
        if t not in COLUMNS:
            raise SchemaError(f"no column type is called {t!r}")
        return plain(COLUMNS[t])

    return Maybe(Type("rec", tuple(column(t) for _, t in rows), tuple(n for n, _ in rows)))


def parse(text: str) -> Maybe:
    """A type from either syntax."""
    if (got := _header(text)) is not None:
        return got
    p = _Parser(text)
    out = p.maybe()
    if p.peek():
        raise SchemaError(f"{p.peek()!r} is left over in {text!r}")
    names = {"THIS": _no_parens(out), **{n: _no_parens(m) for n, m in p.named.items()}}
    for n, m in names.items():
        if _recursive(names["THIS"]):
            DEFINITIONS[n, text] = _tied(m, names, text)
    return _tied(names["THIS"], names, text)


#: What recursive types refer to, by name and the text that they stand in. Codecs carry it to where they work.
DEFINITIONS: dict[tuple[str, str], Maybe] = {}


def _recursive(m: Maybe) -> bool:
    return m.typ.kind == "this" or m.typ.kind != "usr" and any(map(_recursive, m.typ.items))


def _tied(m: Maybe, names: dict[str, Maybe], text: str) -> Maybe:
    """References know the text in which their definition stands."""
    t = m.typ
    if t.kind == "this" and t.extra in names:
        return replace(m, typ=replace(t, extra=(t.extra, text)))
    return m if t.kind == "usr" else replace(m, typ=replace(t, items=tuple(_tied(x, names, text) for x in t.items)))


def develop(t: Type) -> Type:
    """The definition of a user type, and what a recursive type refers to."""
    while t.kind in ("usr", "this"):
        if t.kind == "this":
            if t.extra not in DEFINITIONS:
                raise SchemaError(f"{t} refers to nothing")
            t = DEFINITIONS[t.extra].typ
        else:
            t = t.items[0].typ
    return t


def equal(a: Type, b: Type) -> bool:
    """Equality through definitions; the order of record fields doesn't count."""
    if a.kind == b.kind == "this":
        return a.extra == b.extra
    a, b = develop(a), develop(b)
    if (a.kind, a.extra, len(a.items)) != (b.kind, b.extra, len(b.items)):
        return False
    x, y = list(zip(a.names or range(len(a.items)), a.items)), list(zip(b.names or range(len(b.items)), b.items))
    if a.kind == "rec":
        x, y = sorted(x, key=lambda p: p[0]), sorted(y, key=lambda p: p[0])
    return all(n == m and p.nullable == q.nullable and equal(p.typ, q.typ) for (n, p), (m, q) in zip(x, y))


def depth(t: Type) -> int:
    return 0 if not t.items or t.kind == "usr" else 1 + max(depth(x.typ) for x in t.items)


def bits(t: Type) -> int | None:
    return INTEGERS.get(develop(t).kind)


def is_wide(t: Type) -> bool:
    return develop(t).kind in ("u128", "i128")


def to_spark(m: Maybe | Type) -> S.DataType:
    """The Spark type of a column that holds the values. Where a type refers to itself, the value stands as JSON text
    (parse_json makes a VARIANT of it).
    """
    t = m.typ if isinstance(m, Maybe) else m
    if t.kind == "this":
        return S.StringType()
    t = develop(t)
    n = INTEGERS.get(t.kind)
    if n:
        if n == 128:
            return S.BinaryType()
        if t.kind == "u64":
            return S.DecimalType(20, 0)
        need = n + (t.kind[0] == "u")
        return S.ByteType() if need <= 8 else S.ShortType() if need <= 16 else S.IntegerType() if need <= 32 else S.LongType()
    match t.kind:
        case "bool":
            return S.BooleanType()
        case "float":
            return S.DoubleType()
        case "string" | "char":
            return S.StringType()
        case "bytes":
            return S.BinaryType()
        case "size":
            return S.LongType()
        case "address":
            return S.DecimalType(20, 0)
        case "mask":
            return S.StringType()
        case "ptr":
            return S.StructType([S.StructField("data", S.BinaryType(), True), S.StructField("at", S.LongType(), True), S.StructField("stop", S.LongType(), True)])
        case "void":
            return S.NullType()
        case "vec" | "arr" | "lst" | "set":
            return S.ArrayType(to_spark(t.items[0]), True)
        case "map":
            return S.MapType(to_spark(t.items[0]), to_spark(t.items[1]), True)
        case "tup":
            return S.StructType([S.StructField(f"_{i}", to_spark(x), True) for i, x in enumerate(t.items, 1)])
        case "rec":
            return S.StructType([S.StructField(n, to_spark(x), True) for n, x in zip(t.names, t.items)])
        case "sum":
            return S.StructType([S.StructField("tag", S.ShortType(), True), *[S.StructField(n, to_spark(x), True) for n, x in zip(t.names, t.items) if x.typ.kind != "void"]])
    raise SchemaError(f"no Spark type for {t}")


def to_schema(m: Maybe) -> S.StructType:
    """Columns of a table of such values: the fields of a record or tuple, else one column ``value``."""
    kind = to_spark(m)
    return kind if isinstance(kind, S.StructType) and develop(m.typ).kind in ("rec", "tup") else S.StructType([S.StructField("value", kind, True)])


def from_spark(kind: S.DataType, nullable: bool = True) -> Maybe:
    """The type whose values a Spark column holds."""
    simple = {"boolean": "bool", "tinyint": "i8", "smallint": "i16", "int": "i32", "bigint": "i64", "double": "float", "float": "float", "string": "string", "binary": "bytes", "decimal(20,0)": "u64"}
    if isinstance(kind, S.ArrayType):
        return Maybe(Type("arr", (from_spark(kind.elementType, kind.containsNull),)), nullable)
    if isinstance(kind, S.StructType):
        return Maybe(Type("rec", tuple(from_spark(f.dataType, f.nullable) for f in kind), tuple(f.name for f in kind)), nullable)
    if kind.simpleString() not in simple:
        raise SchemaError(f"no type for {kind.simpleString()}")
    return plain(simple[kind.simpleString()], nullable)


def zero(m: Maybe):
    """The value of a field without a default: NULL, 0, "", false, the first alternative, nothing."""
    if m.default is not None:
        from .compile import constant

        return constant(m.default, m)
    if m.nullable:
        return None
    t = develop(m.typ)
    if t.kind in INTEGERS or t.kind in ("size", "address", "ptr"):
        return 0
    match t.kind:
        case "bool":
            return False
        case "float":
            return 0.0
        case "string":
            return ""
        case "char":
            return "\0"
        case "bytes":
            return b""
        case "vec":
            return [zero(t.items[0])] * int(t.extra)
        case "arr" | "lst" | "set":
            return []
        case "tup":
            return tuple(zero(x) for x in t.items)
        case "rec":
            return {n: zero(x) for n, x in zip(t.names, t.items)}
        case "sum":
            return (0, zero(t.items[0]))
        case "void":
            return None
    raise SchemaError(f"no zero value for {t}")
