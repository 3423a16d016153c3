"""Separated values: compound values are flattened, arrays after their count, sums after their label."""

from __future__ import annotations

from ..functions.wide import hex_float
from ..plans.types import INTEGERS, Maybe, SchemaError, develop
from .base import Codec, DecodeProblem, in_width, register


@register
class Csv(Codec):
    """sep, null, quote, true, false, newline: texts; clickhouse: are arrays one field, [1,2]? strict: are quotes doubled?"""

    name = "csv"
    framed = True

    def __init__(self, m, sep=",", null="\\N", quote: str | None = '"', true="T", false="F", newline: str | None = "\n", clickhouse: bool = False, strict: bool = False, **options):
        super().__init__(m, **options)
        self.sep, self.null, self.quote, self.true, self.false, self.newline, self.clickhouse, self.strict = sep, null, quote, true, false, newline, clickhouse, strict
        self.check(self.m)

    def check(self, m: Maybe, top: bool = True) -> None:
        """A nullable compound is told from its first field, which then must not be nullable itself."""
        if m.typ.kind == "this":  # checked where it is defined
            return
        t = develop(m.typ)
        first = None
        if t.kind in ("tup", "rec", "vec") and not self._joined(t):
            first = t.items[0]
            for x in t.items:
                self.check(x, False)
        elif t.kind in ("arr", "lst", "set", "sum"):
            for x in t.items:
                self.check(x, False)
        if m.nullable and first is not None and self._null_first(first):
            raise SchemaError(f"{m} cannot be told from a NULL in its first field")

    def _null_first(self, m: Maybe) -> bool:
        t = develop(m.typ)
        return m.nullable or t.kind in ("tup", "rec", "vec") and not self._joined(t) and self._null_first(t.items[0])

    def _joined(self, t) -> bool:
        """Is the container one field?"""
        if t.kind in ("vec", "arr") and t.items[0].typ.kind == "char" and not t.items[0].nullable and t.kind == "vec":
            return True
        return self.clickhouse and t.kind in ("vec", "arr", "lst", "set")

    # writing

    def encode(self, value) -> bytes:
        return self.sep.join(self._fields(value, self.m)).encode("utf-8", "surrogateescape")

    def _quoted(self, s: str) -> str:
        q = self.quote
        if not q:
            return s
        return q + (s.replace(q, q + q) if self.strict else s) + q

    def _fields(self, v, m: Maybe) -> list[str]:
        t = develop(m.typ)
        if v is None and t.kind != "void":
            return [self.null]
        if self._joined(t):
            if t.items[0].typ.kind == "char" and t.kind == "vec":
                return [self._quoted("".join(v))]
            inner = ",".join(self._inner(x, t.items[0]) for x in v)
            return [self._quoted(f"[{inner}]")]
        match t.kind:
            case "bool":
                return [self.true if v else self.false]
            case "float":
                return [hex_float(v)]
            case "string" | "char":
                return [self._quoted(v)]
            case "bytes":
                return [self._quoted(v.decode("utf-8", "surrogateescape"))]
            case "tup":
                return [f for x, k in zip(v, t.items) for f in self._fields(x, k)]
            case "rec":
                return [f for n, k in zip(t.names, t.items) for f in self._fields(v[n], k)]
            case "vec":
                return [f for x in v for f in self._fields(x, t.items[0])]
            case "arr" | "lst" | "set":
                return [str(len(v)), *[f for x in v for f in self._fields(x, t.items[0])]]
            case "sum":
                return [str(v[0]), *self._fields(v[1], t.items[v[0]])]
            case "void":
                return []
        return [str(v)]

    def _inner(self, v, m: Maybe) -> str:
        if v is None:
            return self.null
        if develop(m.typ).kind in ("string", "char"):
            return f"'{v}'"
        return self._fields(v, m)[0]

    # reading

    def skip(self, data: bytes, at: int) -> int:
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        return at

    def decode(self, data: bytes, at: int = 0):
        # a line at most, unless a quoted field holds newlines
        stop = data.find(self.newline.encode(), at) if self.newline else -1
        part = data[at : stop + len(self.newline.encode())] if stop >= 0 else data[at:]
        if stop >= 0 and self.quote and part.count(self.quote.encode()) % 2:
            part = data[at:]
        text = part.decode("utf-8", "surrogateescape")
        fields, end = self._split(text, self.newline)
        value, used = self._value(fields, 0, self.m)
        if used != len(fields):
            raise DecodeProblem(f"{len(fields)} fields, {used} are expected")
        return value, at + len(text[:end].encode("utf-8", "surrogateescape"))

    def _split(self, text: str, newline: str | None) -> tuple[list[tuple[str, bool]], int]:
        """The fields of a line, with whether each was quoted, and where the line ends."""
        fields, i, n = [], 0, len(text)
        q = self.quote
        while True:
            if q and text.startswith(q, i):
                j, out = i + len(q), []
                while j < n and not text.startswith(q, j):
                    out.append(text[j])
                    j += 1
                    if self.strict and text.startswith(q + q, j):
                        out.append(q)
                        j += 2 * len(q)
                if j >= n:
                    raise DecodeProblem("a quoted field has no end")
                j += len(q)
                while self.strict and text.startswith(q, j):
                    out.append(q)
                    k = text.index(q, j + len(q))
                    out.append(text[j + len(q) : k])
                    j = k + len(q)
                fields.append(("".join(out), True))
            else:
                j = i
                while j < n and not text.startswith(self.sep, j) and not (newline and text.startswith(newline, j)):
                    j += 1
                fields.append((text[i:j], False))
            if text.startswith(self.sep, j) and j < n:
                i = j + len(self.sep)
                continue
            return fields, j + (len(newline) if newline and text.startswith(newline, j) and j < n else 0)

    def _value(self, fields, at: int, m: Maybe):
        t = develop(m.typ)
        if t.kind == "void":
            return None, at
        if at >= len(fields):
            raise DecodeProblem(f"a field is missing for {m}")
        text, quoted = fields[at]
        if m.nullable and not quoted and text == self.null:
            return None, at + 1
        if self._joined(t):
            if t.items[0].typ.kind == "char" and t.kind == "vec":
                if len(text) != t.extra:
                    raise DecodeProblem(f"{text!r} is no {m}")
                return list(text), at + 1
            return self._list(text, t, m), at + 1
        match t.kind:
            case "tup" | "rec" | "vec":
                out = []
                for k in t.items if t.kind != "vec" else t.items * t.extra:
                    x, at = self._value(fields, at, k)
                    out.append(x)
                return (tuple(out) if t.kind == "tup" else out if t.kind == "vec" else dict(zip(t.names, out))), at
            case "arr" | "lst" | "set":
                n, at, out = int(text), at + 1, []
                for _ in range(n):
                    x, at = self._value(fields, at, t.items[0])
                    out.append(x)
                return out, at
            case "sum":
                x, at = self._value(fields, at + 1, t.items[int(text)])
                return (int(text), x), at
        return self._scalar(text, t, m), at + 1

    def _scalar(self, text: str, t, m: Maybe):
        try:
            if t.kind in INTEGERS or t.kind == "size":
                return in_width(int(text), m)
            match t.kind:
                case "bool":
                    return text[:1] == self.true[:1]
                case "float":
                    return float.fromhex(text) if "x" in text.lower() else float(text)
                case "bytes":
                    return text.encode("utf-8", "surrogateescape")
        except DecodeProblem:
            raise
        except ValueError:
            raise DecodeProblem(f"{text!r} is no {m}") from None
        return text

    def _list(self, text: str, t, m: Maybe) -> list:
        if text[:1] != "[" or text[-1:] != "]":
            raise DecodeProblem(f"{text!r} is no {m}")
        out, inside = [], False
        body = text[1:-1].strip()
        if not body:
            return []
        item, was = "", False
        for c in body + ",":
            if c == "'":
                inside, was = not inside, True
            elif c == "," and not inside:
                plain = item if was else item.strip()
                out.append(None if not was and plain == self.null and t.items[0].nullable else self._scalar(plain, develop(t.items[0].typ), t.items[0]))
                item, was = "", False
            elif inside or not c.isspace():
                item += c
        if t.kind == "vec" and len(out) != t.extra:
            raise DecodeProblem(f"{text!r} is no {m}")
        return out
