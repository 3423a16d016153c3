"""Two binary encodings of rows."""

from __future__ import annotations

import struct

from ..plans.types import INTEGERS, Maybe, SchemaError, develop
from .base import Codec, DecodeProblem, register


def _read(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise DecodeProblem(f"{n} bytes are missing at byte {at}")
    return data[at : at + n], at + n


def _stored(bits: int) -> int:
    """Bytes that an integer takes: 3 become 4, and 5 to 7 become 8."""
    n = bits // 8
    return n if n in (1, 2, 4, 8, 16) else 4 if n < 4 else 8


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n, shift = 0, 0
    while True:
        b, at = _read(data, at, 1)
        n |= (b[0] & 127) << shift
        if b[0] < 128:
            return n, at
        shift += 7
        if shift > 70:
            raise DecodeProblem(f"a length has no end at byte {at}")


@register
class RowBinary(Codec):
    """Little-endian numbers; lengths of strings and arrays in base 128; a byte 1 or 0 before nullable values (1 is
    NULL); vectors without a length; sums after a 16-bit label.
    """

    name = "row-binary"

    def encode(self, value) -> bytes:
        out = bytearray()
        self._put(out, value, self.m)
        return bytes(out)

    def _put(self, out: bytearray, v, m: Maybe) -> None:
        t = develop(m.typ)
        if m.nullable:
            out.append(v is None)
            if v is None:
                return
        if t.kind in INTEGERS:
            out += (v % (1 << 8 * (n := _stored(INTEGERS[t.kind])))).to_bytes(n, "little")
            return
        match t.kind:
            case "bool":
                out.append(bool(v))
            case "float":
                out += struct.pack("<d", v)
            case "char":
                out += v.encode("latin-1")
            case "string" | "bytes":
                b = v if isinstance(v, bytes) else v.encode("utf-8", "surrogateescape")
                out += varint(len(b)) + b
            case "tup":
                for x, k in zip(v, t.items):
                    self._put(out, x, k)
            case "rec":
                for n, k in zip(t.names, t.items):
                    self._put(out, v[n], k)
            case "vec" | "arr" | "lst" | "set":
                if t.kind != "vec":
                    out += varint(len(v))
                for x in v:
                    self._put(out, x, t.items[0])
            case "sum":
                out += struct.pack("<H", v[0])
                self._put(out, v[1], t.items[v[0]])
            case "void":
                pass
            case _:
                raise SchemaError(f"no bytes of {m}")

    def decode(self, data: bytes, at: int = 0):
        return self._get(data, at, self.m)

    def _get(self, data: bytes, at: int, m: Maybe):
        t = develop(m.typ)
        if m.nullable:
            b, at = _read(data, at, 1)
            if b[0]:
                return None, at
        if t.kind in INTEGERS:
            b, at = _read(data, at, _stored(INTEGERS[t.kind]))
            return int.from_bytes(b, "little", signed=t.kind[0] == "i"), at
        match t.kind:
            case "bool":
                b, at = _read(data, at, 1)
                return b[0] != 0, at
            case "float":
                b, at = _read(data, at, 8)
                return struct.unpack("<d", b)[0], at
            case "char":
                b, at = _read(data, at, 1)
                return b.decode("latin-1"), at
            case "string" | "bytes":
                n, at = read_varint(data, at)
                b, at = _read(data, at, n)
                return (b if t.kind == "bytes" else b.decode("utf-8", "surrogateescape")), at
            case "tup" | "rec":
                out = []
                for k in t.items:
                    x, at = self._get(data, at, k)
                    out.append(x)
                return (tuple(out) if t.kind == "tup" else dict(zip(t.names, out))), at
            case "vec" | "arr" | "lst" | "set":
                n = t.extra
                if t.kind != "vec":
                    n, at = read_varint(data, at)
                out = []
                for _ in range(n):
                    x, at = self._get(data, at, t.items[0])
                    out.append(x)
                return out, at
            case "sum":
                b, at = _read(data, at, 2)
                i = struct.unpack("<H", b)[0]
                if i >= len(t.items):
                    raise DecodeProblem(f"{m} has no alternative {i}")
                x, at = self._get(data, at, t.items[i])
                return (i, x), at
            case "void":
                return None, at
        raise SchemaError(f"no value of {m}")


def _has_bit(m: Maybe) -> bool:
    return m.nullable or m.default is not None


class _Frame:
    """A bit mask under way: bit i says that the i-th item that may be missing is."""

    def __init__(self, bits: int):
        self.bits = bits
        self.mask = 0
        self.next = 0

    def take(self, missing: bool) -> None:
        self.mask |= missing << self.next
        self.next += 1

    def bytes(self) -> bytes:
        words = -(-(8 + self.bits) // 32)
        return bytes([words]) + self.mask.to_bytes(4 * words - 1, "little")


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


@register
class RingBuffer(Codec):
    """Words of four bytes. A mask (its length in words in the first byte, then one bit for each item that is nullable
    or has a default) stands before tuples and records, before vectors and after the count of arrays of such items,
    and before a nullable value at the top; items whose bit is set are not written. Sums have a header of two 16-bit
    numbers, mask and label. A nullable field with a default that is not NULL cannot be told apart and is refused.
    """

    name = "ringbuf"

    def __init__(self, m, **options):
        super().__init__(m, **options)
        self._check(self.m)

    def _check(self, m: Maybe) -> None:
        if m.nullable and m.default is not None and not m.default.strip("() ").lower().startswith("null"):
            raise SchemaError(f"{m} has a default that is not NULL")
        for x in () if m.typ.kind == "this" else develop(m.typ).items:  # what it refers to is checked where it stands
            self._check(x)

    def encode(self, value) -> bytes:
        if not _has_bit(self.m):
            return self._put(value, self.m)
        f = _Frame(1)
        f.take(value is None)
        return f.bytes() + (b"" if value is None else self._put(value, self.m))

    def _items(self, values, kinds) -> bytes:
        f = _Frame(sum(map(_has_bit, kinds)))
        out = bytearray()
        for x, k in zip(values, kinds):
            if _has_bit(k):
                f.take(x is None)
            if x is not None or develop(k.typ).kind == "void":
                out += self._put(x, k)
        return f.bytes() + bytes(out)

    def _put(self, v, m: Maybe) -> bytes:
        t = develop(m.typ)
        if t.kind in INTEGERS:
            n = _stored(INTEGERS[t.kind])
            return _pad((v % (1 << 8 * n)).to_bytes(n, "little"))
        match t.kind:
            case "bool":
                return _pad(bytes([bool(v)]))
            case "char":
                return _pad(v.encode("latin-1"))
            case "float":
                return struct.pack("<d", v)
            case "string" | "bytes":
                b = v if isinstance(v, bytes) else v.encode("utf-8", "surrogateescape")
                return struct.pack("<I", len(b)) + _pad(b)
            case "tup":
                return self._items(v, t.items)
            case "rec":
                return self._items([v[n] for n in t.names], t.items)
            case "vec" | "arr" | "lst" | "set":
                head = b"" if t.kind == "vec" else struct.pack("<I", len(v))
                if _has_bit(t.items[0]):
                    return head + self._items(v, t.items * len(v))
                return head + b"".join(self._put(x, t.items[0]) for x in v)
            case "sum":
                k = t.items[v[0]]
                missing = v[1] is None and k.typ.kind != "void"
                return struct.pack("<HH", missing, v[0]) + (b"" if v[1] is None else self._put(v[1], k))
            case "void":
                return b""
        raise SchemaError(f"no bytes of {m}")

    def decode(self, data: bytes, at: int = 0):
        if _has_bit(self.m):
            (missing,), at = self._mask(data, at, 1)
            if missing:
                return self._absent(self.m), at
        return self._get(data, at, self.m)

    def _absent(self, m: Maybe):
        from ..plans.types import zero

        return None if m.nullable else zero(m)

    def _mask(self, data: bytes, at: int, bits: int) -> tuple[list[bool], int]:
        b, _ = _read(data, at, 1)
        raw, at = _read(data, at, 4 * max(1, b[0]))
        n = int.from_bytes(raw[1:], "little")
        return [bool(n >> i & 1) for i in range(bits)], at

    def _parts(self, data: bytes, at: int, kinds) -> tuple[list, int]:
        flags, at = self._mask(data, at, sum(map(_has_bit, kinds)))
        out, k = [], 0
        for m in kinds:
            missing = False
            if _has_bit(m):
                missing, k = flags[k], k + 1
            if missing:
                out.append(self._absent(m))
            else:
                x, at = self._get(data, at, m)
                out.append(x)
        return out, at

    def _get(self, data: bytes, at: int, m: Maybe):
        t = develop(m.typ)
        if t.kind in INTEGERS:
            n = _stored(INTEGERS[t.kind])
            b, at = _read(data, at, -(-n // 4) * 4)
            return int.from_bytes(b[:n], "little", signed=t.kind[0] == "i"), at
        match t.kind:
            case "bool":
                b, at = _read(data, at, 4)
                return b[0] != 0, at
            case "char":
                b, at = _read(data, at, 4)
                return b[:1].decode("latin-1"), at
            case "float":
                b, at = _read(data, at, 8)
                return struct.unpack("<d", b)[0], at
            case "string" | "bytes":
                b, at = _read(data, at, 4)
                n = struct.unpack("<I", b)[0]
                b, at = _read(data, at, n + -n % 4)
                return (b[:n] if t.kind == "bytes" else b[:n].decode("utf-8", "surrogateescape")), at
            case "tup":
                x, at = self._parts(data, at, t.items)
                return tuple(x), at
            case "rec":
                x, at = self._parts(data, at, t.items)
                return dict(zip(t.names, x)), at
            case "vec" | "arr" | "lst" | "set":
                n = t.extra
                if t.kind != "vec":
                    b, at = _read(data, at, 4)
                    n = struct.unpack("<I", b)[0]
                    if n > len(data) * 8:
                        raise DecodeProblem(f"{n} items are more than there can be")
                if _has_bit(t.items[0]):
                    return self._parts(data, at, t.items * n)
                out = []
                for _ in range(n):
                    x, at = self._get(data, at, t.items[0])
                    out.append(x)
                return out, at
            case "sum":
                b, at = _read(data, at, 4)
                missing, i = struct.unpack("<HH", b)
                if i >= len(t.items):
                    raise DecodeProblem(f"{m} has no alternative {i}")
                if missing & 1:
                    return (i, None), at
                x, at = self._get(data, at, t.items[i])
                return (i, x), at
            case "void":
                return None, at
        raise SchemaError(f"no value of {m}")


__all__ = ["RingBuffer", "RowBinary"]
