"""JSON, one value after another: fields in any order, missing ones default, trailing commas pass."""

from __future__ import annotations

import json

from ..functions.wide import short_float
from ..plans.types import INTEGERS, Maybe, develop, zero
from .base import Codec, DecodeProblem, in_width, register

_BLANK = b" \t\r\n"
_ESCAPE = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


@register
class Json(Codec):
    name = "json"

    def skip(self, data: bytes, at: int) -> int:
        while at < len(data) and data[at] in _BLANK:
            at += 1
        return at

    # reading: any JSON first, then its shape by the type

    def decode(self, data: bytes, at: int = 0):
        raw, end = self._any(data, at)
        return self._shape(raw, self.m), end

    def _any(self, data: bytes, at: int):
        at = self.skip(data, at)
        c = data[at : at + 1]
        if c == b"{":
            out, at = {}, self.skip(data, at + 1)
            while data[at : at + 1] != b"}":
                key, at = self._string(data, at)
                at = self.skip(data, at)
                if data[at : at + 1] != b":":
                    raise DecodeProblem(f"':' is missing at byte {at}")
                out[key], at = self._any(data, at + 1)
                at = self._comma(data, at, b"}")
            return out, at + 1
        if c == b"[":
            items, at = [], self.skip(data, at + 1)
            while data[at : at + 1] != b"]":
                x, at = self._any(data, at)
                items.append(x)
                at = self._comma(data, at, b"]")
            return items, at + 1
        if c == b'"':
            return self._string(data, at)
        end = at
        while end < len(data) and data[end] not in b" \t\r\n,]}:":
            end += 1
        word = data[at:end].decode("utf-8", "replace")
        if word in ("null", "true", "false"):
            return {"null": None, "true": True, "false": False}[word], end
        try:
            return (int(word) if word.lstrip("-").isdigit() else float(word)), end
        except ValueError:
            raise DecodeProblem(f"{word!r} at byte {at} is no JSON") from None

    def _comma(self, data: bytes, at: int, close: bytes) -> int:
        at = self.skip(data, at)
        if data[at : at + 1] == b",":
            return self.skip(data, at + 1)
        if data[at : at + 1] != close:
            raise DecodeProblem(f"{close.decode()!r} is missing at byte {at}")
        return at

    def _string(self, data: bytes, at: int) -> tuple[str, int]:
        if data[at : at + 1] != b'"':
            raise DecodeProblem(f"a string is missing at byte {at}")
        end = at + 1
        while end < len(data) and data[end] != 0x22:
            end += 2 if data[end] == 0x5C else 1
        if end >= len(data):
            raise DecodeProblem("a string has no end")
        raw = data[at + 1 : end].decode("utf-8", "surrogateescape")
        if "\\" not in raw:
            return raw, end + 1
        out, i = [], 0
        while i < len(raw):
            if raw[i] != "\\":
                out.append(raw[i])
                i += 1
            elif raw[i + 1] == "u":
                unit = int(raw[i + 2 : i + 6], 16)
                i += 6
                if 0xD800 <= unit < 0xDC00 and raw[i : i + 2] == "\\u":
                    unit = 0x10000 + ((unit - 0xD800) << 10) + int(raw[i + 2 : i + 6], 16) - 0xDC00
                    i += 6
                out.append(chr(unit))
            else:
                out.append(_ESCAPE.get(raw[i + 1], raw[i + 1]))
                i += 2
        return "".join(out), end + 1

    def _shape(self, raw, m: Maybe):
        t = develop(m.typ)
        if raw is None:
            if not m.nullable and t.kind != "void":
                raise DecodeProblem(f"null is no {m}")
            return None
        wrong = DecodeProblem(f"{raw!r} is no {m}")
        if t.kind in INTEGERS or t.kind == "size":
            if isinstance(raw, bool) or not isinstance(raw, (int, float)) or isinstance(raw, float) and not raw.is_integer():
                raise wrong
            return in_width(int(raw), m)
        match t.kind:
            case "bool":
                if not isinstance(raw, bool):
                    raise wrong
                return raw
            case "float":
                if isinstance(raw, bool) or not isinstance(raw, (int, float)):
                    raise wrong
                try:
                    return float(raw)
                except OverflowError:
                    raise wrong from None
            case "string" | "char":
                if not isinstance(raw, str):
                    raise wrong
                return raw
            case "bytes":
                return raw.encode("utf-8", "surrogateescape")
            case "vec" | "arr" | "lst" | "set" | "tup":
                kinds = t.items if t.kind == "tup" else t.items * (t.extra if t.kind == "vec" else len(raw))
                if not isinstance(raw, list) or len(raw) != len(kinds):
                    raise wrong
                out = [self._shape(x, k) for x, k in zip(raw, kinds)]
                return tuple(out) if t.kind == "tup" else out
            case "rec":
                if not isinstance(raw, dict):
                    raise wrong
                return {n: self._shape(raw[n], k) if n in raw and not (raw[n] is None and k.default is not None and not k.nullable) else zero(k) for n, k in zip(t.names, t.items)}
            case "sum":
                if isinstance(raw, str) and raw in t.names:
                    return (t.names.index(raw), None)
                if not isinstance(raw, dict) or len(raw) != 1 or next(iter(raw)) not in t.names:
                    raise wrong
                i = t.names.index(next(iter(raw)))
                return (i, self._shape(next(iter(raw.values())), t.items[i]))
        raise wrong

    # writing

    def encode(self, value) -> bytes:
        return self._text(value, self.m).encode("utf-8", "surrogateescape")

    @staticmethod
    def quote(s: str) -> str:
        return json.dumps(s).replace("/", "\\/")

    def _text(self, v, m: Maybe) -> str:
        if v is None:
            return "null"
        t = develop(m.typ)
        if t.kind in INTEGERS or t.kind == "size":
            return str(v)
        match t.kind:
            case "bool":
                return "true" if v else "false"
            case "float":
                return short_float(v)
            case "string" | "char":
                return self.quote(v)
            case "bytes":
                return self.quote(v.decode("utf-8", "surrogateescape"))
            case "vec" | "arr" | "lst" | "set":
                return f"[{','.join(self._text(x, t.items[0]) for x in v)}]"
            case "tup":
                return f"[{','.join(self._text(x, k) for x, k in zip(v, t.items))}]"
            case "rec":
                return "{" + ",".join(f"{self.quote(n)}:{self._text(v[n], k)}" for n, k in zip(t.names, t.items)) + "}"
            case "sum":
                name = self.quote(t.names[v[0]])
                return name if t.items[v[0]].typ.kind == "void" else f"{{{name}:{self._text(v[1], t.items[v[0]])}}}"
        raise DecodeProblem(f"no JSON of {m}")
