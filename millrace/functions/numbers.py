"""Integers of any width with wrap-around, and partial float functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.types import INTEGERS, SIGNED, Type, to_spark

BIG = "decimal(38,0)"
INF = float("inf")


def storage(kind: str) -> str:
    """The Spark type of an integer type."""
    return to_spark(Type(kind)).simpleString()


def _const(n: int) -> Column:
    return F.lit(str(n)).cast(BIG)


def _over(x: Column, m: Column) -> Column:
    """The floor of a quotient of whole decimals; a plain quotient could round up."""
    return ((x - F.pmod(x, m)) / m).cast(BIG)


def once(f, *args: Column) -> Column:
    """A function of columns that mentions them several times. Long ones become variables of a lambda, so that nested
    calls don't multiply, as do random ones, which each mention would draw anew; others stay plain, for generated code.
    """
    texts = [str(a) for a in args]
    if sum(map(len, texts)) < 300 and not any("rand(" in t for t in texts):
        return f(*args)
    packed = F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)])
    return F.get(F.transform(F.array(packed), lambda s: f(*[s[f"a{i}"] for i in range(len(args))])), F.lit(0))


LOW = (1 << 32) - 1


def to_bits(x: Column, kind: str) -> Column:
    """An integer as the long that has its low 64 bits. A U64 is a decimal; all others are that long already."""
    if kind != "u64":
        return x.cast("long")
    return F.when(x >= _const(1 << 63), (x.cast(BIG) - _const(1 << 64)).cast("long")).otherwise(x.cast("long"))


def of_bits(x: Column, kind: str) -> Column:
    """A long cut to the width of ``kind``: by masks and shifts, which never overflow."""
    n = INTEGERS[kind]
    if kind == "u64":
        return F.when(x < 0, x.cast(BIG) + _const(1 << 64)).otherwise(x.cast(BIG)).cast(storage(kind))
    if n < 64:
        x = F.shiftright(F.shiftleft(x, 64 - n), 64 - n) if kind in SIGNED else x.bitwiseAND(F.lit((1 << n) - 1))
    return x.cast(storage(kind))


def _joined(high: Column, low: Column) -> Column:
    """High and low 32 bits; what exceeds them in ``low`` (a borrow is negative) goes on to the high ones."""
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def _add64(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b or a - b of longs, wrapped: plain additions of longs raise where they overflow."""
    other = (lambda x, y: x + y) if sign > 0 else (lambda x, y: x - y)
    return _joined(other(F.shiftright(a, 32), F.shiftright(b, 32)), other(a.bitwiseAND(F.lit(LOW)), b.bitwiseAND(F.lit(LOW))))


def _mul64(a: Column, b: Column) -> Column:
    """The low 64 bits of a product of longs, from products of fewer than 63 bits."""
    a0, b0 = a.bitwiseAND(F.lit(LOW)), b.bitwiseAND(F.lit(LOW))
    first = _add64(a0.bitwiseAND(F.lit(0xFFFF)) * b0, F.shiftleft(F.shiftright(a0, 16) * b0, 16))
    cross = (F.shiftright(a, 32) * b0).bitwiseAND(F.lit(LOW)) + (a0 * F.shiftright(b, 32)).bitwiseAND(F.lit(LOW))
    return _add64(first, F.shiftleft(cross, 32))


def wrap(x: Column, kind: str, wide: bool = True) -> Column:
    """An integer column (``wide``: a decimal, else a long that has not overflowed) modulo the width of ``kind``."""
    if not wide:
        return of_bits(x.cast("long"), kind)
    n = INTEGERS[kind]
    half = 1 << (n - 1) if kind in SIGNED else 0
    y = F.pmod(x.cast(BIG) + _const(half), _const(1 << n)) if half else F.pmod(x.cast(BIG), _const(1 << n))
    return (y - _const(half) if half else y).cast(storage(kind))


def in_range(kind: str) -> tuple[int, int]:
    n = INTEGERS[kind]
    return (-(1 << (n - 1)), (1 << (n - 1)) - 1) if kind in SIGNED else (0, (1 << n) - 1)


def from_float(x: Column, kind: str) -> Column:
    """A float without its fraction, wrapped; NaN, infinities and what no 37 digits hold (1e37 and beyond) give 0."""
    whole = F.when(F.isnan(x) | (F.abs(x) == INF), F.lit(0.0)).otherwise(F.when(x < 0, F.ceil(F.lit(0.0) + x).cast("double")).otherwise(F.floor(x).cast("double")))
    # above 2**53 a float has no fraction, and floor would saturate
    whole = F.when(F.abs(x) >= float(1 << 53), x).otherwise(whole)
    return wrap(F.when(F.abs(whole) < 1e37, whole).otherwise(F.lit(0.0)).cast(BIG), kind)


def add(a: Column, b: Column, kind: str) -> Column:
    if INTEGERS[kind] <= 56:
        return wrap(a.cast("long") + b.cast("long"), kind, False)
    return of_bits(_add64(to_bits(a, kind), to_bits(b, kind)), kind)


def sub(a: Column, b: Column, kind: str) -> Column:
    if INTEGERS[kind] <= 56:
        return wrap(a.cast("long") - b.cast("long"), kind, False)
    return of_bits(_add64(to_bits(a, kind), to_bits(b, kind), -1), kind)


def mul(a: Column, b: Column, kind: str) -> Column:
    if INTEGERS[kind] <= 24 or kind == "i32":  # the product is a long
        return wrap(a.cast("long") * b.cast("long"), kind, False)
    return of_bits(_mul64(to_bits(a, kind), to_bits(b, kind)), kind)


def neg(a: Column, kind: str) -> Column:
    return sub(F.lit(0), a, kind)


def absolute(a: Column, kind: str) -> Column:
    return F.when(a < 0, neg(a, kind)).otherwise(a)


def div(a: Column, b: Column, kind: str) -> Column:
    """Towards zero; null for a zero divisor; the least integer over -1 wraps."""
    if kind == "u64":
        return wrap(_over(a.cast(BIG), F.when(b != 0, b).cast(BIG)), kind)
    over = F.call_function("div", a.cast("long"), F.when((b != 0) & (b != -1), b).cast("long"))
    return F.when(b == -1, neg(a, kind)).otherwise(over.cast(storage(kind))) if kind in SIGNED else over.cast(storage(kind))


def rem(a: Column, b: Column, kind: str) -> Column:
    """Of the dividend's sign; null for a zero divisor."""
    y = F.when(b != 0, b)
    return F.when(y.isNotNull(), a.cast(BIG) % y.cast(BIG)).cast(storage(kind)) if storage(kind) == "decimal(20,0)" else F.when(y.isNotNull(), a % y).cast(storage(kind))


def nan_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def float_div(a: Column, b: Column) -> Column:
    """IEEE quotient: infinities for zero divisors, NaN for 0/0."""
    negative_zero = F.hex(b.cast("string").cast("binary")) == F.hex(F.lit("-0.0").cast("binary"))
    over_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when((a < 0) != negative_zero, -INF).otherwise(INF)
    return F.when(F.isnan(a) | F.isnan(b), float("nan")).when(b == 0, over_zero).otherwise(a / F.when(b != 0, b))


def float_rem(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INF), float("nan")).when(F.abs(b) == INF, a).otherwise(a % F.when(b != 0, b))


def log(x: Column, base10: bool = False) -> Column:
    """With -inf at 0 and NaN below."""
    f = F.log10 if base10 else F.ln
    return F.when(F.isnan(x) | (x < 0), float("nan")).when(x == 0, -INF).otherwise(f(F.when(x > 0, x)))


def whole(x: Column, f) -> Column:
    """ceil or floor that stays a float, also where it exceeds a long."""
    return F.when(F.isnan(x) | (F.abs(x) >= float(1 << 53)), x).otherwise(f(x).cast("double"))


def half_away(x: Column) -> Column:
    up = F.floor(F.abs(x) + 0.5).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= float(1 << 52)), x).otherwise(F.when(x < 0, -up).otherwise(up))


def bits(a: Column, b: Column | None, kind: str, op: str) -> Column:
    """and, or, xor, not at the width of ``kind``."""
    if op == "not":
        return of_bits(F.bitwise_not(to_bits(a, kind)), kind)
    return of_bits(_bit(to_bits(a, kind), to_bits(b, kind), op), kind)


def _bit(a: Column, b: Column, op: str) -> Column:
    return {"and": a.bitwiseAND, "or": a.bitwiseOR, "xor": a.bitwiseXOR}[op](b)


def _shifted(name: str, a: Column, n: Column, kind: str) -> Column:
    size = INTEGERS[kind]
    moved = of_bits(F.call_function(name, a, F.when(n < size, n).otherwise(0).cast("int")), kind)
    return F.when(n >= size, F.lit(0).cast(storage(kind))).otherwise(moved)


def shift_left(a: Column, n: Column, kind: str) -> Column:
    return _shifted("shiftleft", to_bits(a, kind), n, kind)


def shift_right(a: Column, n: Column, kind: str) -> Column:
    """Logical, at the declared width."""
    size = INTEGERS[kind]
    plain = to_bits(a, kind) if size == 64 else a.cast("long").bitwiseAND(F.lit((1 << size) - 1))
    return _shifted("shiftrightunsigned", plain, n, kind)


def power(a: Column, b: Column, kind: str) -> Column:
    """Whole powers by squaring, one step for each bit of the exponent; null for a negative exponent."""
    start = F.struct(F.lit(1).cast(storage(kind)).alias("out"), a.alias("base"), F.when(b >= 0, b).cast("long").alias("left"))

    def step(s, _):
        out = F.when(s["left"].bitwiseAND(F.lit(1)) == 1, mul(s["out"], s["base"], kind)).otherwise(s["out"])
        return F.struct(out.alias("out"), mul(s["base"], s["base"], kind).alias("base"), F.shiftright(s["left"], 1).alias("left"))

    bits = F.length(F.bin(F.when(b >= 0, b).otherwise(0).cast("long")))
    return F.when(b >= 0, F.aggregate(F.sequence(F.lit(1), bits), start, step, lambda s: s["out"]))


def parse_int(s: Column, kind: str) -> Column:
    """The whole text as an integer (decimal, 0x, 0o or 0b), null otherwise or out of range."""
    low, high = in_range(kind)
    text = F.when(s.rlike(r"^-?[0-9]{1,37}$"), s.cast(BIG))
    for prefix, digits, base in (("0[xX]", "[0-9a-fA-F]{1,16}", 16), ("0[oO]", "[0-7]{1,21}", 8), ("0[bB]", "[01]{1,64}", 2)):
        text = text.when(s.rlike(f"^{prefix}{digits}$"), F.conv(F.substring(s, 3, 99), base, 10).cast(BIG))
    return F.when(text.between(_const(low), _const(high)), text).cast(storage(kind))


def parse_float(s: Column) -> Column:
    good = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F]+(\.[0-9a-fA-F]*)?[pP][+-]?[0-9]+|nan|inf|infinity)$"
    t = F.lower(s)
    special = F.when(t.rlike("^[+-]?nan$"), float("nan")).when(t.rlike(r"^\+?inf(inity)?$"), INF).when(t.rlike("^-inf(inity)?$"), -INF)
    return special.when(t.rlike(good), s.try_cast("double"))
