"""What built-in functions cannot express: 128-bit integers, float texts and bits. Arrow batches, never single rows."""

from __future__ import annotations

import ipaddress
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(x: int, signed: bool) -> bytes:
    """16 bytes whose order is that of the numbers: big-endian, the sign bit of signed ones turned."""
    return ((x + (1 << 127 if signed else 0)) % (1 << 128)).to_bytes(16, "big")


def unpack(b: bytes, signed: bool) -> int:
    return int.from_bytes(b, "big") - (1 << 127 if signed else 0)


def _wrap(x: int, signed: bool) -> int:
    return (x + (1 << 127)) % (1 << 128) - (1 << 127) if signed else x % (1 << 128)


def _quotient(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: None if b == 0 else _quotient(a, b),
    "rem": lambda a, b: None if b == 0 else a - b * _quotient(a, b),
    "pow": lambda a, b: None if b < 0 else pow(a, b, 1 << 128),
    "bit-and": lambda a, b: a & b,
    "bit-or": lambda a, b: a | b,
    "bit-xor": lambda a, b: a ^ b,
    "left-shift": lambda a, b: a << b if b < 128 else 0,
    "right-shift": lambda a, b: (a % (1 << 128)) >> b if b < 128 else 0,
}


def binary(op: str, signed: bool, a: Column, b: Column, shift: bool = False) -> Column:
    """Arithmetic of two 128-bit columns; for shifts the second is a small number."""
    f = BINARY[op]

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            if p is None or q is None or q != q:
                out.append(None)
                continue
            r = f(unpack(p, signed), int(q) if shift else unpack(q, signed))
            out.append(None if r is None else pack(_wrap(r, signed), signed))
        return pd.Series(out, dtype=object)

    return run(a, b)


def negate(signed: bool, a: Column, absolute: bool = False) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else pack(_wrap(abs(n) if absolute else -n, signed), signed) for p in x for n in [unpack(p, signed) if p is not None else 0]], dtype=object)

    return run(a)


def invert(a: Column) -> Column:
    """The bits of 16 bytes turned, but for the order bit's meaning, which stays: not x is the largest minus x."""
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else bytes(255 - c for c in p) for p in x], dtype=object)

    return run(a)


def of_text(signed: bool, s: Column) -> Column:
    """A 128-bit number from its whole text (decimal or 0x), null otherwise or out of range."""
    low, high = (-(1 << 127), (1 << 127) - 1) if signed else (0, (1 << 128) - 1)

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for p in x:
            n = None
            try:
                n = int(p, 0 if p[:2].lower() in ("0x", "0o", "0b") else 10) if p is not None and p.strip() == p and "_" not in p else None
            except ValueError:
                pass
            out.append(pack(n, signed) if n is not None and low <= n <= high else None)
        return pd.Series(out, dtype=object)

    return run(s)


def to_text(signed: bool, a: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else str(unpack(p, signed)) for p in x], dtype=object)

    return run(a)


def of_number(signed: bool, a: Column) -> Column:
    """From the text of a whole number of any sign, wrapped."""
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else pack(_wrap(int(p), signed), signed) for p in x], dtype=object)

    return run(a.cast("decimal(38,0)").cast("string"))


def convert(from_signed: bool, to_signed: bool, a: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else pack(_wrap(unpack(p, from_signed), to_signed), to_signed) for p in x], dtype=object)

    return run(a)


def low_text(signed: bool, a: Column, bits: int, to_signed: bool) -> Column:
    """The low bits as decimal text, for a cast to a smaller integer."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for p in x:
            if p is None:
                out.append(None)
                continue
            n = unpack(p, signed) % (1 << bits)
            out.append(str(n - (1 << bits) if to_signed and n >> (bits - 1) else n))
        return pd.Series(out, dtype=object)

    return run(a)


def hex_float(x: float) -> str:
    """Hexadecimal text without trailing zeros: 0x1.8p+1, 0x0p+0, inf, nan."""
    if x != x:
        return "nan"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    mantissa, exponent = float.hex(x).split("p")
    if "." in mantissa:
        mantissa = mantissa.rstrip("0").rstrip(".")
    return f"{mantissa}p{exponent}"


def short_float(x: float) -> str:
    """Decimal text of twelve digits, of seventeen where twelve don't suffice, without trailing zeros or point."""
    if x != x:
        return "nan"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    s = f"{x:.12g}"
    if float(s) != x:
        s = f"{x:.17g}"
    if "." in s and "e" not in s:
        s = s.rstrip("0").rstrip(".")
    return s


def float_text(a: Column, decimal: bool) -> Column:
    f = short_float if decimal else hex_float

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([f(p) for p in x], dtype=object)

    return F.when(a.isNotNull(), run(F.coalesce(a, F.lit(0.0))))


def bits_of_float(a: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([str(struct.unpack("<Q", struct.pack("<d", p))[0]) for p in x], dtype=object)

    return F.when(a.isNotNull(), run(F.coalesce(a, F.lit(0.0))).cast("decimal(20,0)"))


def float_of_bits(a: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else struct.unpack("<d", struct.pack("<Q", int(p)))[0] for p in x], dtype=float)

    return F.when(a.isNotNull(), run(F.coalesce(a, F.lit(0).cast("decimal(20,0)")).cast("string")))


def ip6_text(a: Column) -> Column:
    """Compressed text of 16 bytes: the longest run of zero groups becomes ::."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else spell_ip6(int.from_bytes(p, "big")) for p in x], dtype=object)

    return run(a)


def spell_ip6(n: int) -> str:
    text = str(ipaddress.IPv6Address(n))
    # never with a dotted tail
    return text if "." not in text else ":".join(f"{n >> s & 0xFFFF:x}" for s in range(112, -1, -16))


def last_of_ip6(ip: Column, mask: Column, first: bool) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for p, k in zip(x, m):
            host = (1 << (128 - int(k))) - 1
            n = int.from_bytes(p, "big")
            out.append(((n & ~host) if first else (n | host)).to_bytes(16, "big"))
        return pd.Series(out, dtype=object)

    return run(ip, mask)
