"""Cursors over bytes, masks as values, loops without assignment, and sets as values.

A cursor is a value: its bytes, a place in them and where they stop. Nothing is changed in place: what writes gives a
new cursor, and what reads gives a pair of the value and the cursor after it. Reading or writing beyond the stop, and
text that is no number of the type, raise. Memory cannot be addressed: addresses are numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers, wide
from .compile import OPS, SPECIAL, Lambda, TypeProblem, Value, _const_int, _label, _make_tup, compile_tree, expect, integer, is_signed, item_of, need, numeric, of, op, special, type_text, wide_kind
from .types import INTEGERS, Maybe, Type, develop, equal, plain, to_spark

ENDS = ("little-endian", "big-endian")


def raised(ok: Column, col: Column, kind, message: str) -> Column:
    return F.when(ok, col).otherwise(F.raise_error(F.lit(message)).cast(kind))


def cursor(data: Column, at: Column, stop: Column) -> Value:
    return of("ptr", F.struct(data.alias("data"), at.cast("long").alias("at"), stop.cast("long").alias("stop")))


class Parts:
    """The fields of a cursor."""

    def __init__(self, col: Column):
        self.data, self.at, self.stop = col["data"], col["at"], col["stop"]

    def inside(self, begin: Column, n: Column) -> Column:
        return (n >= 0) & (begin >= 0) & (begin + n <= self.stop)

    def slice(self, begin: Column, n: Column) -> Column:
        return raised(self.inside(begin, n), F.substring(self.data, (begin + 1).cast("int"), n.cast("int")), "binary", "bytes beyond the cursor's stop")

    def moved(self, n: Column) -> Value:
        return cursor(self.data, raised(self.inside(self.at, n), self.at + n, "long", "a cursor beyond its stop"), self.stop)

    def filled(self, new: Column, n: Column, after: Column) -> Value:
        """A cursor whose ``n`` bytes at its place are ``new``, and which then stands at ``after``."""
        tail = F.substring(self.data, (self.at + n + 1).cast("int"), F.octet_length(self.data))
        data = F.concat(F.substring(self.data, F.lit(1), self.at.cast("int")), new, tail)
        return cursor(raised(self.inside(self.at, n), data, "binary", "no room for what is written"), after, self.stop)


def on_cursor(f):
    """An operator on a cursor and other values. The cursor is a variable of a lambda, so that a chain of operators
    is written out once for each, not once for each mention.
    """

    def run(p, *args):
        expect(p, "ptr")
        made = {}

        def body(c):
            made["mn"] = (got := f(Parts(c), *args)).mn
            return got.col

        col = F.get(F.transform(F.array(p.col), body), F.lit(0))
        return Value(col, made["mn"])

    return run


def cursor_op(name: str):
    def add(f):
        OPS[name] = on_cursor(f)
        return f

    return add


# --- cursors and addresses -------------------------------------------------------------------------------------

OPS["ptr-of-string"] = lambda s: cursor(F.encode(expect(s, "string").col, "utf-8"), F.lit(0), F.octet_length(s.col))
OPS["ptr-of-buffer"] = lambda n: cursor(F.unhex(F.repeat(F.lit("00"), expect(n, "size").col.cast("int"))), F.lit(0), n.col)
OPS["offset"] = on_cursor(lambda x: of("size", x.at))
OPS["rem-size"] = on_cursor(lambda x: of("size", x.stop - x.at))
OPS["ptr-add"] = on_cursor(lambda x, n: x.moved(expect(n, "size").col))
OPS["address-of-u64"] = lambda v: of("address", expect(v, "u64").col)
OPS["u64-of-address"] = lambda v: of("u64", expect(v, "address").col)


@op("ptr-of-address")
def _ptr_of_address(address, n):
    expect(address, "address"), expect(n, "size")
    return of("ptr", F.raise_error(F.lit("memory cannot be addressed")).cast(to_spark(plain("ptr"))))


@cursor_op("ptr-of-ptr")
def _ptr_of_ptr(x, start, stop):
    a, b = expect(start, "size").col, expect(stop, "size").col
    ok = (a >= 0) & (a <= b) & (b <= x.stop)
    return cursor(x.data, raised(ok, a, "long", "a part beyond the cursor's stop"), b)


@cursor_op("rewind")
def _rewind(x, n):
    n = expect(n, "size").col
    return cursor(x.data, raised((n >= 0) & (n <= x.at), x.at - n, "long", "a cursor before its bytes"), x.stop)


@cursor_op("ptr-sub")
def _ptr_sub(x, q):
    y = Parts(expect(q, "ptr").col)
    return of("size", raised((x.data == y.data) & (x.at >= y.at), x.at - y.at, "long", "cursors of other bytes, or in the other order"))


# --- bytes and words -------------------------------------------------------------------------------------------


def _turned(text: Column) -> Column:
    """Hexadecimal text with its bytes in the other order."""
    return F.regexp_replace(F.reverse(text), "(.)(.)", "$2$1")


def _number(data: Column, kind: str, little: bool) -> Column:
    """So many bytes as an unsigned integer."""
    text = _turned(F.hex(data)) if little else F.hex(data)
    return F.unhex(text) if wide_kind(kind) else F.conv(text, 16, 10).cast(numbers.storage(kind))


def _bytes(v: Value, little: bool) -> Column:
    n = INTEGERS[v.kind] // 8
    text = F.hex(v.col) if wide_kind(v.kind) else F.lpad(F.conv(v.col.cast("string"), 10, 16), 2 * n, "0")
    return F.unhex(_turned(text) if little else text)


def _word(kind: str):
    size = INTEGERS[kind] // 8

    def split(tree, env) -> tuple[bool, list]:
        at = 1
        if kind != "u8":
            need(len(tree) > 1 and tree[1] in ENDS, f"{' or '.join(ENDS)} is expected")
            at = 2
        return tree[1] == "little-endian", [compile_tree(x, env) for x in tree[at:]]

    def arguments(tree, env, count: int) -> tuple[bool, list]:
        little, args = split(tree, env)
        need(len(args) == count, f"{tree[0]} takes a cursor{' and a value' * (count > 1)}")
        return little, args

    def read(tree, env):
        little, (p,) = arguments(tree, env, 1)
        return on_cursor(lambda x: _make_tup(of(kind, _number(x.slice(x.at, F.lit(size)), kind, little)), x.moved(F.lit(size))))(p)

    def peek(tree, env):
        little, (p, at) = arguments(tree, env, 2)
        return on_cursor(lambda x: of(kind, _number(x.slice(x.at + expect(at, "size").col, F.lit(size)), kind, little)))(p)

    def write(tree, env):
        little, (p, v) = arguments(tree, env, 2)
        return on_cursor(lambda x: x.filled(_bytes(expect(v, kind), little), F.lit(size), x.at + size))(p)

    return read, peek, write


for _k in ("u8", "u16", "u32", "u64", "u128"):
    SPECIAL[f"read-{_k}"], SPECIAL[f"peek-{_k}"], SPECIAL[f"write-{_k}"] = _word(_k)


@cursor_op("read-bytes")
def _read_bytes(x, n):
    n = expect(n, "size").col
    return _make_tup(of("bytes", x.slice(x.at, n)), x.moved(n))


@cursor_op("write-bytes")
def _write_bytes(x, v):
    n = F.octet_length(expect(v, "bytes").col)
    return x.filled(v.col, n, x.at + n)


@cursor_op("poke-u8")
def _poke(x, v):
    return x.filled(_bytes(expect(v, "u8"), False), F.lit(1), x.at)


@cursor_op("blit-byte")
def _blit(x, v, n):
    n = expect(n, "size").col
    return x.filled(F.unhex(F.repeat(F.hex(_bytes(expect(v, "u8"), False)), n.cast("int"))), n, x.at + n)


def _bit_of(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (i % 8).cast("int") + 1).cast("long")


@cursor_op("get-bit")
def _get_bit(x, i):
    i = expect(i, "size").col
    byte = _number(x.slice(x.at + F.floor(i / 8), F.lit(1)), "u8", False).cast("long")
    return of("bool", byte.bitwiseAND(_bit_of(i)) != 0)


@cursor_op("set-bit")
def _set_bit(x, i, on):
    """The cursor with one bit of its bytes set or cleared; it stays where it is."""
    i = expect(i, "size").col
    there = Parts(cursor(x.data, x.at + F.floor(i / 8), x.stop).col)
    byte, bit = _number(there.slice(there.at, F.lit(1)), "u8", False).cast("long"), _bit_of(i)
    new = F.when(expect(on, "bool").col, byte.bitwiseOR(bit)).otherwise(byte.bitwiseAND(F.lit(255) - bit))
    return there.filled(F.unhex(F.lpad(F.hex(new), 2, "0")), F.lit(1), x.at)


# --- numbers spelled at a cursor -------------------------------------------------------------------------------

INTEGER = r"^([+-]?0[xX][0-9a-fA-F]+|[+-]?0[oO][0-7]+|[+-]?0[bB][01]+|[+-]?[0-9]+)"
FLOAT = r"^ *([+-]?(?:0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?[0-9]+)?|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|nan|inf(?:inity)?))"


def _text(x: Parts) -> Column:
    """What is left, a character for each byte."""
    return F.decode(F.substring(x.data, (x.at + 1).cast("int"), (x.stop - x.at).cast("int")), "ISO-8859-1")


def _spelled(kind: str):
    def build(x):
        found = F.regexp_extract(_text(x), INTEGER, 1)
        plus = F.regexp_replace(found, r"^\+", "")
        value = wide.of_text(is_signed(kind), plus) if wide_kind(kind) else numbers.parse_int(plus, kind)
        value = F.coalesce(value, F.raise_error(F.lit(f"no {kind} begins at the cursor")).cast(numbers.storage(kind)))
        return _make_tup(of(kind, value), x.moved(F.length(found).cast("long")))

    return build


for _k in INTEGERS:
    # Arrow functions, of which those of 128 bits are made, can't stand in a lambda
    OPS[f"{_k}-of-ptr"] = (lambda p, f=_spelled(_k): f(Parts(expect(p, "ptr").col))) if wide_kind(_k) else on_cursor(_spelled(_k))


@cursor_op("float-of-ptr")
def _float_of_ptr(x):
    """NaN, and the cursor where it was, if no number begins there."""
    text = _text(x)
    found = F.regexp_extract(text, f"(?i){FLOAT}", 1)
    plain_hex = F.when(found.rlike("^[+-]?0[xX][^pP]*$"), F.concat(found, F.lit("p0"))).otherwise(found)
    value = F.coalesce(F.when(found != "", numbers.parse_float(plain_hex)), F.lit(float("nan")))
    return _make_tup(of("float", value), x.moved(F.when(found == "", 0).otherwise(F.length(F.regexp_extract(text, f"(?i){FLOAT}", 0))).cast("long")))


@cursor_op("char-of-ptr")
def _char_of_ptr(x):
    return _make_tup(of("char", F.decode(x.slice(x.at, F.lit(1)), "ISO-8859-1")), x.moved(F.lit(1)))


# --- masks as values -------------------------------------------------------------------------------------------


def _mask(m) -> Value:
    return Value(F.lit(str(m)), plain("mask"), m)


@special("mask")
def _mask_text(tree, env):
    """(mask "(X_N)"): masks are constants, known when the expression is compiled."""
    from ..operators import masks

    return _mask(masks.parse(_label(tree[1])))


@special("copy-field", "skip-field", "set-field-null")
def _mask_action(tree, env):
    from ..operators import masks

    return _mask({"copy-field": masks.COPY, "skip-field": masks.SKIP, "set-field-null": masks.NULL}[tree if isinstance(tree, str) else tree[0]])


@special("mask-get")
def _mask_get(tree, env):
    """The mask of the i-th part: copies, drops and NULLs go on inside."""
    i, m = _const_int(tree[1]), expect(compile_tree(tree[2], env), "mask").literal
    if m.action in ("copy", "skip", "null"):
        return _mask(m)
    need(m.action == "recurse" and 0 <= i < len(m.parts), f"the mask {m} has no part {i}")
    return _mask(m.parts[i])


@special("apply-mask")
def _apply_mask(tree, env):
    from ..operators import masks

    m = expect(compile_tree(tree[1], env), "mask").literal
    return masks.apply(compile_tree(tree[2], env), m)


# --- loops -----------------------------------------------------------------------------------------------------


@special("while")
def _while(tree, env):
    """(while most init (fun (T) condition) (fun (T) step)): steps from ``init`` as long as the condition holds.

    A value has no assignment, so the state goes round instead. ``most`` is a constant bound of the steps; a loop that
    has not ended by then raises.
    """
    need(len(tree) == 5, "(while most init condition step) is expected")
    most, init, going, step = (compile_tree(x, env) for x in tree[1:])
    need(isinstance(most.literal, int) and most.literal > 0, "the most steps of a loop are a constant")
    need(isinstance(going, Lambda) and isinstance(step, Lambda), "condition and step are functions of the state")
    on = lambda s: expect(going(Value(s, init.mn)), "bool").col
    need(equal(step(init).mn.typ, init.mn.typ), f"a step makes {step(init).mn} of {init.mn}")
    last = F.aggregate(F.sequence(F.lit(1), F.lit(most.literal)), init.col, lambda s, _: F.when(on(s), step(Value(s, init.mn)).col).otherwise(s))
    return Value(raised(~on(last), last, to_spark(init.mn), f"a loop goes on after {most.literal} steps"), init.mn)


@special("for-each")
def _for_each(tree, env):
    """(for-each name container body): a void body, checked for each item (each character of a string)."""
    name, v = _label(tree[1]), compile_tree(tree[2], env)
    if v.kind in ("string", "bytes"):
        chars = F.split(v.col, "") if v.kind == "string" else F.transform(F.sequence(F.lit(1), F.octet_length(v.col)), lambda k: F.conv(F.hex(F.substring(v.col, k, F.lit(1))), 16, 10).cast("short"))
        v = Value(F.when(F.octet_length(v.col) == 0, F.slice(chars, 1, 0)).otherwise(chars), Maybe(Type("arr", (plain("char" if v.kind == "string" else "u8"),))))
    item = item_of(v)

    def body(x):
        got = compile_tree(tree[3], env.bind(name, Value(x, item)))
        need(got.kind == "void", f"the body of a loop is void, not {got.mn}")
        return F.lit(True) if got.col is None else got.col.isNull()

    return Value(F.when(~F.forall(v.col, body), F.lit(1)), plain("void"))


# --- sets as values --------------------------------------------------------------------------------------------

FLAVOURS = {"sliding-window": "sliding", "tumbling-window": "tumbling", "sampling": "sampling", "hash-table": "hashtable", "heap": "heap", "top": "top"}


@special(*FLAVOURS)
def _empty_set(tree, env):
    """(sliding-window type size ...): an empty set. Sizes count where rows are aggregated; as values, sliding and tumbling windows, hash tables and heaps take insertions."""
    m = type_text(tree[1])
    size = _const_int(tree[2]) if len(tree) > 2 else None
    return Value(F.array().cast(to_spark(Type("arr", (m,)))), Maybe(Type("set", (m,), (), FLAVOURS[tree[0]])), size)


@op("insert")
def _insert(v, x):
    """The set with one item more: at the end of a list or window, once in a hash table, in order in a heap."""
    item, flavour = item_of(expect(v, "set")), develop(v.mn.typ).extra
    need(equal(item.typ, x.mn.typ) and (item.nullable or not x.mn.nullable), f"{x.mn} into {v.mn}")
    longer = F.array_append(v.col, x.col)
    if flavour == "hashtable":
        longer = F.array_distinct(longer)
    elif flavour == "heap":
        longer = F.array_sort(longer)
    elif flavour in ("sliding", "tumbling"):
        need(isinstance(v.literal, int), f"the size of {v.mn} is not known here")
        full = F.size(v.col) >= v.literal
        longer = F.when(full, F.slice(longer, 2, v.literal) if flavour == "sliding" else F.array(x.col)).otherwise(longer)
    else:
        need(flavour == "simple", f"{v.mn} takes insertions only where rows are aggregated")
    return Value(longer, v.mn, v.literal)


@op("del-min")
def _del_min(v, n):
    """The set without its ``n`` least items."""
    expect(v, "set")
    integer(n)
    least = F.array_sort(v.col)
    return Value(F.slice(least, n.col.cast("int") + 1, F.greatest(F.size(least) - n.col.cast("int"), F.lit(0))), v.mn, v.literal)


__all__ = ["Parts", "TypeProblem", "cursor", "numeric"]
