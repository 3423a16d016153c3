"""From expressions to Columns, with static types.

Each operator has a function that checks the types of its arguments and builds a Column. Integers wrap at their
declared width, comparisons are total on nullable values (NULL is the least, and equal to itself), partial functions
give NULL, and strings are bytes. Evaluation order and sharing are left to the optimizer.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, network, numbers, strings, wide
from .text import Quoted, read, read_all
from .types import INTEGERS, SIGNED, Maybe, SchemaError, Type, develop, equal, parse, plain, text_of, to_spark, zero


class TypeProblem(TypeError):
    """An expression whose types don't fit."""


@dataclass(frozen=True)
class Value:
    """A typed column. ``literal`` holds a constant's Python value."""

    col: Column | None
    mn: Maybe
    literal: object = None

    @property
    def kind(self) -> str:
        return develop(self.mn.typ).kind


#: How deep ``myself`` may call itself: a Column has no recursion, so calls are written out.
RECURSION = 16


class TooDeep(TypeProblem):
    """A recursion that is not written out further; a condition that leads there raises when it holds."""


@dataclass(frozen=True)
class Lambda:
    """A function value: it has its parameters and the definitions outside of functions, nothing else."""

    params: tuple[Maybe, ...]
    body: object
    outer: "Env"
    depth: int = 0

    def __call__(self, *args: Value) -> Value:
        if self.depth > RECURSION:
            raise TooDeep(f"a function calls itself more than {RECURSION} times")
        if len(args) != len(self.params):
            raise TypeProblem(f"{len(self.params)} arguments are expected, not {len(args)}")
        for a, p in zip(args, self.params):
            if not isinstance(a, Lambda) and not (equal(a.mn.typ, p.typ) and (p.nullable or not a.mn.nullable)):
                raise TypeProblem(f"an argument is {a.mn}, not {p}")
        return compile_tree(self.body, Env(self.outer.names, list(args), self.outer.externals, self))


@dataclass
class Env:
    names: dict[str, object] = field(default_factory=dict)
    params: list = field(default_factory=list)
    externals: dict[str, Callable] = field(default_factory=dict)
    me: Lambda | None = None

    def bind(self, name: str, value) -> "Env":
        if name in self.names:
            raise TypeProblem(f"{name} is bound already")
        return Env({**self.names, name: value}, self.params, self.externals, self.me)


#: Functions from typed columns to a typed column, known to every expression by name (and objects that have such).
EXTERNALS: dict[str, object] = {}
OPS: dict[str, Callable] = {}
SPECIAL: dict[str, Callable] = {}
#: Other spellings of operators.
ALIASES = {"+": "add", "-": "sub", "*": "mul", "/": "div", "%": "rem", "^": "pow", ">": "gt", ">=": "ge", "=": "eq", "<": "lt", "<=": "le", "<>": "ne", "mem": "member", "split-by": "split-on"}


def op(*names: str):
    def add(f):
        for n in names:
            OPS[n] = f
        return f

    return add


def special(*names: str):
    def add(f):
        for n in names:
            SPECIAL[n] = f
        return f

    return add


def of(kind: str, col: Column, nullable: bool = False, literal=None) -> Value:
    return Value(col, plain(kind, nullable), literal)


def need(ok: bool, what: str) -> None:
    if not ok:
        raise TypeProblem(what)


def numeric(v: Value, nullable: bool = False) -> str:
    need(isinstance(v, Value) and (v.kind in INTEGERS or v.kind in ("float", "size")), f"a number is expected, not {getattr(v, 'mn', 'a function')}")
    need(nullable or not v.mn.nullable, f"{v.mn} may be NULL here; force it or map it")
    return "i64" if v.kind == "size" else v.kind


def expect(v: Value, *kinds: str, nullable: bool = False) -> Value:
    need(isinstance(v, Value) and v.kind in kinds, f"{' or '.join(kinds)} is expected, not {getattr(v, 'mn', 'a function')}")
    need(nullable or not v.mn.nullable, f"{v.mn} may be NULL here; force it or map it")
    return v


def integer(v: Value) -> str:
    kind = numeric(v)
    need(kind != "float", "an integer is expected")
    return kind


def is_signed(kind: str) -> bool:
    return kind in SIGNED


def wide_kind(kind: str) -> bool:
    return kind in ("u128", "i128")


def literal(kind: str, value) -> Value:
    """A constant of a scalar type."""
    if kind in INTEGERS:
        low, high = numbers.in_range(kind)
        need(low <= value <= high, f"{value} is no {kind}")
        col = F.lit(wide.pack(value, is_signed(kind))) if wide_kind(kind) else F.lit(str(value)).cast(numbers.storage(kind))
        return of(kind, col, literal=value)
    if kind == "float":
        return of(kind, F.lit(float(value)), literal=float(value))
    if kind in ("size", "address"):
        return of(kind, F.lit(str(int(value))).cast(to_spark(Type(kind))), literal=int(value))
    if kind == "bool":
        return of(kind, F.lit(bool(value)), literal=bool(value))
    if kind == "bytes":
        return of(kind, F.lit(value if isinstance(value, bytes) else value.encode()), literal=value)
    return of(kind, F.lit(value), literal=value)


def constant(text: str, m: Maybe):
    """The Python value of a constant expression of type ``m`` (a default in a type)."""
    tree = read(text)
    return _constant(tree, m)


def _constant(tree, m: Maybe):
    t = develop(m.typ)
    if isinstance(tree, Quoted):
        return tree.value
    if isinstance(tree, str):
        low = tree.lower()
        if low == "null":
            return None
        if t.kind == "bool":
            return low in ("true", "t", "1")
        if t.kind == "float":
            return float.fromhex(tree) if "x" in low else float(tree)
        if tree in ("[]", "[[]]", "{}"):
            return []
        return int(tree, 0)
    head = tree[0] if tree else ""
    if head == "null":
        return None
    if head in ("make-vec", "make-arr", "make-lst"):
        items = tree[1:] if head == "make-vec" else [x for x in tree[1:] if not isinstance(x, Quoted)]
        return [_constant(x, t.items[0]) for x in items]
    if head == "make-tup":
        return tuple(_constant(x, i) for x, i in zip(tree[1:], t.items))
    if head == "make-rec":
        return {n: _constant(x, t.items[t.names.index(n)]) for k, x in zip(tree[1::2], tree[2::2]) for n in [k.value if isinstance(k, Quoted) else k]}
    if head == "construct":
        i = int(tree[2])
        return (i, _constant(tree[3], t.items[i]))
    if head in ("end-of-list", "empty-set"):
        return []
    if head == "void":
        return None
    if isinstance(head, str) and len(tree) == 2:
        return _constant(tree[1], m)
    raise SchemaError(f"{tree} is no constant")


def value_column(v, m: Maybe) -> Column:
    """A Python value (as codecs make them) as a literal of a type."""
    t, kind = develop(m.typ), to_spark(m)
    if v is None:
        return F.lit(None).cast(kind)
    if t.kind in INTEGERS:
        return literal(t.kind, v).col
    match t.kind:
        case "vec" | "arr" | "lst" | "set":
            return (F.array(*[value_column(x, t.items[0]) for x in v]) if v else F.array()).cast(kind)
        case "tup":
            return F.struct(*[value_column(x, i).alias(f"_{k}") for k, (x, i) in enumerate(zip(v, t.items), 1)])
        case "rec":
            return F.struct(*[value_column(v[n], i).alias(n) for n, i in zip(t.names, t.items)])
        case "sum":
            return build_sum(t, v[0], value_column(v[1], t.items[v[0]]) if t.items[v[0]].typ.kind != "void" else None)
    return literal(t.kind, v).col


def build_sum(t: Type, i: int, payload: Column | None) -> Column:
    fields = [F.lit(i).cast("short").alias("tag")]
    for k, (n, x) in enumerate(zip(t.names, t.items)):
        if x.typ.kind != "void":
            fields.append((payload if k == i else F.lit(None).cast(to_spark(x))).alias(n))
    return F.struct(*fields)


def type_text(tree) -> Maybe:
    return parse(tree.value if isinstance(tree, Quoted) else tree)


def compile_text(text: str, env: Env | None = None):
    """The typed column (or function) of an expression's text."""
    return compile_tree(read(text), env or Env())


def definitions(text: str, env: Env) -> Env:
    """Bind every (define name expression) of a text."""
    for tree in read_all(text):
        need(isinstance(tree, list) and len(tree) == 3 and tree[0] == "define", "(define name expression) is expected")
        env = env.bind(tree[1].value if isinstance(tree[1], Quoted) else tree[1], compile_tree(tree[2], env))
    return env


def compile_tree(tree, env: Env):
    if isinstance(tree, Quoted):
        return literal("string", tree.value)
    if isinstance(tree, str):
        return _atom(tree, env)
    need(bool(tree), "an expression is empty")
    head = tree[0].value if isinstance(tree[0], Quoted) else tree[0]
    if isinstance(head, list):
        return compile_tree(["apply", *tree], env)
    head = ALIASES.get(head, head)
    if head in SPECIAL:
        return SPECIAL[head](tree, env)
    if head in OPS:
        return OPS[head](*[compile_tree(x, env) for x in tree[1:]])
    if head in env.names:
        return compile_tree(["apply", head, *tree[1:]], env)
    raise TypeProblem(f"no operator is called {head}")


def _atom(token: str, env: Env):
    if token in env.names:
        return env.names[token]
    low = token.lower()
    if low in ("true", "false"):
        return literal("bool", low == "true")
    if low in ("now", "random-float", "random-u8", "random-u32", "random-u64", "random-u128", "copy-field", "skip-field", "set-field-null"):
        return SPECIAL[low]([token], env)
    if low == "myself":
        need(env.me is not None, "myself stands outside of a function")
        return replace(env.me, depth=env.me.depth + 1)
    digits = low.lstrip("+-")
    if digits[:1].isdigit():
        if "." in low or ("e" in low and "x" not in low) or "p" in low:
            return literal("float", float.fromhex(token) if "x" in low else float(token))
        n = int(token, 0)
        for kind in ("u8", "i8", "u16", "i16", "u24", "i24", "u32", "i32", "u40", "i40", "u48", "i48", "u56", "i56", "u64", "i64", "u128", "i128"):
            if numbers.in_range(kind)[0] <= n <= numbers.in_range(kind)[1]:
                return literal(kind, n)
    if low == "nan" or low in ("inf", "-inf", "+inf"):
        return literal("float", float(low))
    raise TypeProblem(f"{token} is not bound")


# --- literals, parameters, names -------------------------------------------------------------------------------


def _scalar(kind: str):
    def build(tree, env):
        x = tree[1]
        if isinstance(x, Quoted):
            return literal(kind, x.value)
        if kind == "bool":
            return literal(kind, x.lower() in ("true", "1"))
        if kind == "float":
            return literal(kind, float.fromhex(x) if "x" in x.lower() else float(x))
        return literal(kind, int(x, 0))

    return build


for _k in (*INTEGERS, "float", "bool", "char", "string", "bytes", "size", "address"):
    SPECIAL[_k] = _scalar(_k)


@special("null")
def _null(tree, env):
    m = type_text(tree[1])
    return Value(F.lit(None).cast(to_spark(m)), Maybe(m.typ, True))


@special("param")
def _param(tree, env):
    n = int(tree[-1])
    need(n < len(env.params), f"no parameter {n} is bound")
    return env.params[n]


@special("identifier")
def _identifier(tree, env):
    return _atom(tree[1].value if isinstance(tree[1], Quoted) else tree[1], env)


@special("ext-identifier")
def _external(tree, env):
    names = [x.value if isinstance(x, Quoted) else x for x in tree[1:]]
    known = EXTERNALS | env.externals
    need(names[0] in known, f"no function is registered as {names[0]}")
    return known[names[0]] if len(names) == 1 else getattr(known[names[0]], names[1])


@special("myself")
def _myself(tree, env):
    f = _atom("myself", env)
    return f(*[compile_tree(x, env) for x in tree[1:]]) if len(tree) > 1 else f


@special("now")
def _now(tree, env):
    return of("float", F.unix_micros(F.current_timestamp()) / 1e6)


@special("random-float")
def _random_float(tree, env):
    return of("float", F.rand())


def _draw(n: int) -> Column:
    return F.floor(F.rand() * float(1 << n)).cast("long")


for _k, _n in (("u8", 8), ("u32", 32)):
    SPECIAL[f"random-{_k}"] = lambda tree, env, k=_k, n=_n: of(k, _draw(n).cast(numbers.storage(k)))
SPECIAL["random-u64"] = lambda tree, env: of("u64", (_draw(32).cast("decimal(20,0)") * F.lit(str(1 << 32)).cast("decimal(11,0)") + _draw(32).cast("decimal(20,0)")).cast("decimal(20,0)"))
SPECIAL["random-u128"] = lambda tree, env: of("u128", F.concat(*[F.unhex(F.lpad(F.hex(_draw(32)), 8, "0")) for _ in range(4)]))


@special("end-of-list")
def _end_of_list(tree, env):
    return Value(F.array().cast(to_spark(Type("arr", (type_text(tree[1]),)))), Maybe(Type("lst", (type_text(tree[1]),))))


@special("empty-set")
def _empty_set(tree, env):
    return Value(F.array().cast(to_spark(Type("arr", (type_text(tree[1]),)))), Maybe(Type("set", (type_text(tree[1]),), (), "simple")))


@special("no-return")
def _no_return(tree, env):
    m = type_text(tree[1]) if len(tree) > 1 else plain("void")
    return Value(F.raise_error(F.lit("a value that must not be needed")).cast(to_spark(m)), m)


# --- structure -------------------------------------------------------------------------------------------------


@special("seq")
def _seq(tree, env):
    got = [compile_tree(x, env) for x in tree[1:]]
    need(bool(got), "a sequence is empty")
    for g in got[:-1]:
        need(g.kind == "void", "all but the last of a sequence must be void")
    checks = [g.col for g in got[:-1] if g.col is not None]
    last = got[-1]
    for c in checks:  # a check that holds is NULL
        last = Value(F.when(c.isNull(), last.col), last.mn)
    return last


def _same(items: list[Value], what: str) -> Maybe:
    first = items[0].mn
    for x in items[1:]:
        need(equal(x.mn.typ, first.typ), f"{what} of {first} and {x.mn}")
    return Maybe(first.typ, any(x.mn.nullable for x in items))


@op("make-vec")
def _make_vec(*items):
    need(bool(items), "a vector has one item at least")
    return Value(F.array(*[x.col for x in items]), Maybe(Type("vec", (_same(list(items), "a vector"),), (), len(items))))


@special("make-arr", "make-lst")
def _make_arr(tree, env):
    m = type_text(tree[1])
    items = [compile_tree(x, env) for x in tree[2:]]
    for x in items:
        need(equal(x.mn.typ, m.typ) and (m.nullable or not x.mn.nullable), f"an item of {m} is {x.mn}")
    kind = Type("arr" if tree[0] == "make-arr" else "lst", (m,))
    return Value((F.array(*[x.col for x in items]) if items else F.array()).cast(to_spark(kind)), Maybe(kind))


@op("make-tup")
def _make_tup(*items):
    need(len(items) > 1, "a tuple has two items at least")
    return Value(F.struct(*[x.col.alias(f"_{i}") for i, x in enumerate(items, 1)]), Maybe(Type("tup", tuple(x.mn for x in items))))


def _label(x) -> str:
    return x.value if isinstance(x, Quoted) else x


@special("make-rec")
def _make_rec(tree, env):
    need(len(tree) % 2 == 1 and len(tree) > 1, "a record has names and values in turn")
    names = [_label(x) for x in tree[1::2]]
    need(len(set(names)) == len(names), f"fields are repeated: {names}")
    items = [compile_tree(x, env) for x in tree[2::2]]
    return Value(F.struct(*[x.col.alias(n) for n, x in zip(names, items)]), Maybe(Type("rec", tuple(x.mn for x in items), tuple(names))))


@special("make-usr")
def _make_usr(tree, env):
    from .types import USER

    t = USER.get(_label(tree[1]).lower())
    need(t is not None, f"no type is called {_label(tree[1])}")
    items = [compile_tree(x, env) for x in tree[2:]]
    d = develop(t)
    if d.kind == "rec":
        need(len(items) == len(d.items), f"{t} has {len(d.items)} parts")
        return Value(F.struct(*[x.col.alias(n) for x, n in zip(items, d.names)]), Maybe(t))
    need(len(items) == 1, f"{t} is made of one value")
    if d.kind == "sum":
        for i, x in enumerate(d.items):
            if equal(x.typ, items[0].mn.typ):
                return Value(build_sum(d, i, items[0].col), Maybe(t))
        raise TypeProblem(f"{t} is not made of {items[0].mn}")
    need(equal(d, items[0].mn.typ), f"{t} is not made of {items[0].mn}")
    return Value(items[0].col, Maybe(t))


@special("verbatim")
def _verbatim(tree, env):
    """(verbatim "SQL template with %1, %2" type e...): a Spark expression of a stated type."""
    args = [compile_tree(x, env) for x in tree[3:]]
    text = _label(tree[1])
    if not args:
        return Value(F.expr(text), type_text(tree[2]))
    for i in range(len(args), 0, -1):
        text = text.replace(f"%{i}", f"({str(args[i - 1].col)[len(PRINTED) : -2]})")
    return Value(F.expr(text), type_text(tree[2]))


#: How a column prints its expression.
PRINTED = "Column<'"


@special("fun")
def _fun(tree, env):
    types = tree[1] if isinstance(tree[1], list) else [tree[1]]
    return Lambda(tuple(type_text(x) for x in types), tree[2], Env({k: v for k, v in env.names.items()}, [], env.externals))


@special("apply")
def _apply(tree, env):
    f = compile_tree(tree[1], env)
    args = [compile_tree(x, env) for x in tree[2:]]
    if isinstance(f, Lambda):
        return f(*args)
    need(callable(f), "only functions can be applied")
    return f(*args)


@special("comment")
def _comment(tree, env):
    return compile_tree(tree[2], env)


def _const_int(tree) -> int:
    while isinstance(tree, list):
        tree = tree[1]
    return int(tree)


@special("get-item", "fst", "snd")
def _get_item(tree, env):
    n, at = {"fst": (0, 1), "snd": (1, 1)}.get(tree[0], (None, 2))
    n = _const_int(tree[1]) if n is None else n
    v = compile_tree(tree[at], env)
    expect(v, "tup")
    t = develop(v.mn.typ)
    need(0 <= n < len(t.items), f"{v.mn} has no item {n}")
    return Value(v.col.getField(f"_{n + 1}"), t.items[n])


@special("get-field")
def _get_field(tree, env):
    v = expect(compile_tree(tree[2], env), "rec")
    t, n = develop(v.mn.typ), _label(tree[1])
    need(n in t.names, f"{v.mn} has no field {n}")
    return Value(v.col.getField(n), t.items[t.names.index(n)])


@special("get-alt")
def _get_alt(tree, env):
    v = expect(compile_tree(tree[2], env), "sum")
    t, n = develop(v.mn.typ), _label(tree[1])
    need(n in t.names, f"{v.mn} has no alternative {n}")
    return Value(v.col.getField(n), t.items[t.names.index(n)])


@special("construct")
def _construct(tree, env):
    m = type_text(tree[1])
    t, i = develop(m.typ), _const_int(tree[2])
    need(t.kind == "sum" and i < len(t.items), f"{m} has no alternative {i}")
    e = compile_tree(tree[3], env) if len(tree) > 3 else None
    need(e is None or equal(e.mn.typ, t.items[i].typ), f"alternative {i} of {m} is not {e and e.mn}")
    return Value(build_sum(t, i, e.col if e else None), Maybe(m.typ))


@op("void")
def _void():
    return Value(None, plain("void"))


@op("dump", "ignore")
def _ignore(e):
    return Value(None, plain("void"))


@op("identity")
def _identity(e):
    return e


@op("label-of")
def _label_of(v):
    expect(v, "sum")
    return of("u16", v.col.getField("tag").cast("int"))


@special("copy-rec")
def _copy_rec(tree, env):
    v = expect(compile_tree(tree[1], env), "rec")
    t = develop(v.mn.typ)
    new = {_label(n): compile_tree(e, env) for n, e in zip(tree[2::2], tree[3::2])}
    need(set(new) <= set(t.names), f"{v.mn} has no field {sorted(set(new) - set(t.names))}")
    parts = [new.get(n) or Value(v.col.getField(n), x) for n, x in zip(t.names, t.items)]
    return Value(F.struct(*[p.col.alias(n) for n, p in zip(t.names, parts)]), Maybe(Type("rec", tuple(p.mn for p in parts), t.names)))


@special("copy-tup")
def _copy_tup(tree, env):
    v = expect(compile_tree(tree[1], env), "tup")
    t = develop(v.mn.typ)
    new = {_const_int(n): compile_tree(e, env) for n, e in zip(tree[2::2], tree[3::2])}
    need(all(0 <= n < len(t.items) for n in new), f"{v.mn} lacks one of the items {sorted(new)}")
    parts = [new.get(i) or Value(v.col.getField(f"_{i + 1}"), x) for i, x in enumerate(t.items)]
    return _make_tup(*parts)


@special("let")
def _let(tree, env):
    return compile_tree(tree[3], env.bind(_label(tree[1]), compile_tree(tree[2], env)))


@special("let-pair")
def _let_pair(tree, env):
    v = compile_tree(tree[3], env)
    t = develop(v.mn.typ)
    need(t.kind == "tup" and len(t.items) == 2, f"a pair is expected, not {v.mn}")
    env = env.bind(_label(tree[1]), Value(v.col.getField("_1"), t.items[0]))
    return compile_tree(tree[4], env.bind(_label(tree[2]), Value(v.col.getField("_2"), t.items[1])))


def _branch(tree, env) -> Value | None:
    try:
        return compile_tree(tree, env)
    except TooDeep:
        return None


@special("if")
def _if(tree, env):
    c = expect(compile_tree(tree[1], env), "bool")
    a, b = _branch(tree[2], env), _branch(tree[3], env)
    if a is None or b is None:
        if a is b:
            raise TooDeep(f"a function calls itself more than {RECURSION} times")
        known = a or b
        deep = F.raise_error(F.lit(f"a function calls itself more than {RECURSION} times")).cast(to_spark(known.mn))
        return Value(F.when(c.col, a.col if a else deep).otherwise(b.col if b else deep), known.mn)
    need(equal(a.mn.typ, b.mn.typ), f"branches are {a.mn} and {b.mn}")
    return Value(F.when(c.col, a.col).otherwise(b.col), Maybe(a.mn.typ, a.mn.nullable or b.mn.nullable))


@special("null-map", "map-nullable")
def _null_map(tree, env):
    x = compile_tree(tree[2], env)
    body = compile_tree(tree[3], env.bind(_label(tree[1]), Value(x.col, Maybe(x.mn.typ))))
    return Value(F.when(x.col.isNotNull(), body.col), Maybe(body.mn.typ, True))


@op("is-null")
def _is_null(v):
    return of("bool", v.col.isNull() if v.mn.nullable else F.lit(False))


@op("not-null")
def _not_null(v):
    need(not v.mn.nullable, f"{v.mn} is nullable already")
    return Value(v.col, Maybe(v.mn.typ, True))


@special("force")
def _force(tree, env):
    message = tree[1].value if len(tree) > 2 and isinstance(tree[1], Quoted) else "a value is NULL"
    v = compile_tree(tree[-1], env)
    need(v.mn.nullable, f"{v.mn} is never NULL")
    return Value(F.coalesce(v.col, F.raise_error(F.lit(message)).cast(to_spark(v.mn))), Maybe(v.mn.typ))


@op("assert")
def _assert(c):
    expect(c, "bool")
    return Value(F.assert_true(c.col), plain("void"))


@special("getenv")
def _getenv(tree, env):
    value = os.environ.get(_label(tree[1]))
    return of("string", F.lit(value).cast("string"), True)


@op("coalesce")
def _coalesce(*items):
    m, used = items[0].mn, []
    for x in items:
        need(equal(x.mn.typ, m.typ), f"coalesce of {m} and {x.mn}")
        used.append(x)
        if not x.mn.nullable:
            break
    return Value(F.coalesce(*[x.col for x in used]), Maybe(m.typ, used[-1].mn.nullable))


# --- numbers ---------------------------------------------------------------------------------------------------


def _pair(a: Value, b: Value) -> str:
    x, y = numeric(a), numeric(b)
    need(x == y, f"numbers differ: {a.mn} and {b.mn}")
    return x


def _arith(name: str, ints, floats, partial: bool = False):
    def build(a, b):
        kind = _pair(a, b)
        if kind == "float":
            col = floats(a.col, b.col)
            return Value(numbers.nan_null(col) if partial else col, Maybe(a.mn.typ, partial))
        col = wide.binary(name, is_signed(kind), a.col, b.col) if wide_kind(kind) else numbers.once(lambda x, y: ints(x, y, kind), a.col, b.col)
        return Value(col, Maybe(a.mn.typ, partial))

    return build


OPS["add"] = _arith("add", numbers.add, lambda a, b: a + b)
OPS["sub"] = _arith("sub", numbers.sub, lambda a, b: a - b)
OPS["mul"] = _arith("mul", numbers.mul, lambda a, b: a * b)
OPS["div"] = _arith("div", numbers.div, numbers.float_div, True)
OPS["rem"] = _arith("rem", numbers.rem, numbers.float_rem, True)
OPS["pow"] = _arith("pow", numbers.power, lambda a, b: F.pow(a, b), True)


def _unsafe(name: str):
    def build(a, b):
        kind = _pair(a, b)
        if kind == "float":
            return Value({"div": numbers.float_div, "rem": numbers.float_rem, "pow": F.pow}[name](a.col, b.col), Maybe(a.mn.typ))
        got = OPS[name](a, b)
        return Value(F.coalesce(got.col, F.raise_error(F.lit(f"{name} has no result")).cast(to_spark(a.mn))), Maybe(a.mn.typ))

    return build


for _n in ("div", "rem", "pow"):
    OPS[f"unsafe-{_n}"] = _unsafe(_n)


@op("neg")
def _neg(a):
    kind = numeric(a)
    return Value(-a.col if kind == "float" else wide.negate(is_signed(kind), a.col) if wide_kind(kind) else numbers.once(lambda x: numbers.neg(x, kind), a.col), a.mn)


@op("abs")
def _abs(a):
    kind = numeric(a)
    if kind == "float" or not is_signed(kind):
        return Value(F.abs(a.col) if kind == "float" else a.col, a.mn)
    return Value(wide.negate(True, a.col, True) if wide_kind(kind) else numbers.once(lambda x: numbers.absolute(x, kind), a.col), a.mn)


def _bitop(name: str):
    def build(a, b):
        kind = _pair(a, b)
        need(kind != "float", "bits are of integers")
        return Value(wide.binary(f"bit-{name}", is_signed(kind), a.col, b.col) if wide_kind(kind) else numbers.once(lambda x, y: numbers.bits(x, y, kind, name), a.col, b.col), a.mn)

    return build


for _n in ("and", "or", "xor"):
    OPS[f"bit-{_n}"] = _bitop(_n)


@op("bit-not")
def _bit_not(a):
    kind = integer(a)
    return Value(wide.invert(a.col) if wide_kind(kind) else numbers.bits(a.col, None, kind, "not"), a.mn)


def _shift(name: str, f):
    def build(a, n):
        kind = integer(a)
        need(n.kind == "u8" and not n.mn.nullable, f"a shift is a U8, not {n.mn}")
        return Value(wide.binary(name, is_signed(kind), a.col, n.col, True) if wide_kind(kind) else numbers.once(lambda x, y: f(x, y, kind), a.col, n.col), a.mn)

    return build


OPS["left-shift"] = _shift("left-shift", numbers.shift_left)
OPS["right-shift"] = _shift("right-shift", numbers.shift_right)


def to_int(v: Value, kind: str) -> Column:
    """Any number, char or boolean as an integer type, wrapped."""
    src = v.kind
    if src == "bool":
        v, src = of("u8", v.col.cast("int")), "u8"
    if src == "char":
        v, src = of("u8", F.ascii(v.col)), "u8"
    if wide_kind(kind):
        if wide_kind(src):
            return wide.convert(is_signed(src), is_signed(kind), v.col)
        return wide.of_number(is_signed(kind), numbers.from_float(v.col, "i64") if src == "float" else v.col)
    if wide_kind(src):
        return wide.low_text(is_signed(src), v.col, INTEGERS[kind], is_signed(kind)).cast(numbers.storage(kind))
    if src == "float":
        return numbers.from_float(v.col, kind)
    # no wrap where the value always fits
    if src in INTEGERS:
        (a, b), (c, d) = numbers.in_range(src), numbers.in_range(kind)
        if c <= a and b <= d:
            return v.col.cast(numbers.storage(kind))
    return numbers.once(lambda x: numbers.of_bits(numbers.to_bits(x, src), kind), v.col)


def _to(kind: str):
    def build(v):
        need(isinstance(v, Value) and not v.mn.nullable and (v.kind in INTEGERS or v.kind in ("float", "size", "bool", "char")), "a number is expected")
        return of(kind, to_int(v, kind))

    return build


for _k in INTEGERS:
    OPS[f"to-{_k}"] = _to(_k)
    OPS[f"{_k}-of-string"] = lambda v, k=_k: of(k, wide.of_text(is_signed(k), expect(v, "string").col) if wide_kind(k) else numbers.parse_int(expect(v, "string").col, k), True)


@op("to-float")
def _to_float(v):
    kind = numeric(v)
    return of("float", wide.to_text(is_signed(kind), v.col).cast("double") if wide_kind(kind) else v.col.cast("double"))


def _float1(name: str, f, nullable: bool = False):
    OPS[name] = lambda v: of("float", f(expect(v, "float").col), nullable)


_float1("exp", F.exp)
_float1("log", lambda x: numbers.nan_null(numbers.log(x)), True)
_float1("unsafe-log", numbers.log)
_float1("log10", lambda x: numbers.nan_null(numbers.log(x, True)), True)
_float1("unsafe-log10", lambda x: numbers.log(x, True))
_float1("sqrt", lambda x: numbers.nan_null(F.sqrt(x)), True)
_float1("unsafe-sqrt", F.sqrt)
_float1("ceil", lambda x: numbers.whole(x, F.ceil))
_float1("floor", lambda x: numbers.whole(x, F.floor))
_float1("round", numbers.half_away)
for _n in ("cos", "sin", "atan", "cosh", "sinh", "tanh"):
    _float1(_n, getattr(F, _n))
for _n in ("tan", "acos", "asin"):
    _float1(_n, lambda x, f=getattr(F, _n): numbers.nan_null(f(x)), True)

OPS["float-of-string"] = lambda v: of("float", numbers.parse_float(expect(v, "string").col), True)
OPS["string-of-float"] = lambda v: of("string", wide.float_text(expect(v, "float").col, False))
OPS["decimal-string-of-float"] = lambda v: of("string", wide.float_text(expect(v, "float").col, True))
OPS["float-of-u64"] = lambda v: of("float", wide.float_of_bits(expect(v, "u64").col))
OPS["u64-of-float"] = lambda v: of("u64", wide.bits_of_float(expect(v, "float").col))
OPS["u8-of-char"] = lambda v: of("u8", F.ascii(expect(v, "char").col).cast("short"))
OPS["char-of-u8"] = lambda v: of("char", F.when(expect(v, "u8").col == 0, F.decode(F.lit(b"\0"), "utf-8")).otherwise(F.chr(v.col.cast("long"))))
OPS["string-of-char"] = lambda v: of("string", expect(v, "char").col)
OPS["size-of-u32"] = lambda v: of("size", expect(v, "u32").col)
OPS["u32-of-size"] = lambda v: of("u32", numbers.of_bits(expect(v, "size").col, "u32"))
OPS["u8-of-bool"] = lambda v: of("u8", expect(v, "bool").col.cast("int").cast("short"))
OPS["bool-of-u8"] = lambda v: of("bool", expect(v, "u8").col != 0)


@op("string-of-int")
def _string_of_int(v):
    kind = integer(v)
    return of("string", wide.to_text(is_signed(kind), v.col) if wide_kind(kind) else v.col.cast("string"))


@op("string-of-ip")
def _string_of_ip(v):
    t = develop(v.mn.typ)
    if t.kind == "u32":
        return of("string", network.ip4_text(v.col))
    if t.kind == "u128":
        return of("string", wide.ip6_text(v.col))
    need(t.kind == "sum", f"an address is expected, not {v.mn}")
    return of("string", F.when(v.col.getField("tag") == 0, network.ip4_text(v.col.getField(t.names[0]))).otherwise(wide.ip6_text(v.col.getField(t.names[1]))))


# --- comparison and logic --------------------------------------------------------------------------------------


def _ordered(a: Value, b: Value) -> None:
    need(equal(a.mn.typ, b.mn.typ), f"{a.mn} and {b.mn} don't compare")


def _nan(v: Value) -> Column:
    return F.coalesce(F.isnan(v.col), F.lit(False))


def greater(a: Value, b: Value, or_equal: bool) -> Column:
    plain_test = F.coalesce((a.col >= b.col) if or_equal else (a.col > b.col), F.lit(False))
    if a.mn.nullable or b.mn.nullable:
        plain_test = F.when(b.col.isNull(), F.lit(True) if or_equal else a.col.isNotNull()).otherwise(plain_test)
    return plain_test & ~_nan(a) & ~_nan(b) if a.kind == "float" else plain_test


@op("gt")
def _gt(a, b):
    _ordered(a, b)
    return of("bool", greater(a, b, False))


@op("ge")
def _ge(a, b):
    _ordered(a, b)
    return of("bool", greater(a, b, True))


OPS["lt"] = lambda a, b: OPS["gt"](b, a)
OPS["le"] = lambda a, b: OPS["ge"](b, a)


@op("eq")
def _eq(a, b):
    _ordered(a, b)
    same = a.col.eqNullSafe(b.col)
    return of("bool", same & ~_nan(a) if a.kind == "float" else same)


OPS["ne"] = lambda a, b: of("bool", ~OPS["eq"](a, b).col)
OPS["not"] = lambda a: of("bool", ~expect(a, "bool").col)
OPS["and"] = lambda *xs: of("bool", _fold(xs, lambda p, q: p & q))
OPS["or"] = lambda *xs: of("bool", _fold(xs, lambda p, q: p | q))


def _fold(xs, f):
    need(len(xs) >= 2, "two booleans at least")
    out = expect(xs[0], "bool").col
    for x in xs[1:]:
        out = f(out, expect(x, "bool").col)
    return out


@op("min")
def _min(a, b):
    _ordered(a, b)
    low = F.least(a.col, b.col)
    if a.mn.nullable or b.mn.nullable:
        low = F.when(a.col.isNotNull() & b.col.isNotNull(), low)
    return Value(low, Maybe(a.mn.typ, a.mn.nullable or b.mn.nullable))


@op("max")
def _max(a, b):
    _ordered(a, b)
    return Value(F.greatest(a.col, b.col), Maybe(a.mn.typ, a.mn.nullable and b.mn.nullable))


@op("hash")
def _hash(v):
    return of("u64", numbers.of_bits(F.xxhash64(v.col), "u64"))


# --- strings and bytes -----------------------------------------------------------------------------------------

OPS["string-length"] = lambda v: of("u32", strings.length(expect(v, "string").col))
OPS["bytes-length"] = lambda v: of("size", strings.length(expect(v, "bytes").col))
OPS["string-of-bytes"] = lambda v: of("string", F.decode(expect(v, "bytes").col, "utf-8"))
OPS["bytes-of-string"] = lambda v: of("bytes", F.encode(expect(v, "string").col, "utf-8"))
OPS["lower"] = lambda v: of("string", strings.lower(expect(v, "string").col))
OPS["upper"] = lambda v: of("string", strings.upper(expect(v, "string").col))
OPS["append-string"] = lambda a, b: of("string", F.concat(expect(a, "string").col, expect(b, "string").col))
OPS["append-bytes"] = lambda a, b: of("bytes", F.concat(expect(a, "bytes").col, expect(b, "bytes").col))
OPS["append-byte"] = lambda a, b: of("bytes", F.concat(expect(a, "bytes").col, F.unhex(F.lpad(F.hex(expect(b, "u8").col.cast("long")), 2, "0"))))
OPS["starts-with"] = lambda s, p: of("bool", F.startswith(expect(s, "string").col, expect(p, "string").col))
OPS["ends-with"] = lambda s, p: of("bool", F.endswith(expect(s, "string").col, expect(p, "string").col))
OPS["index"] = lambda c, s: of("u32", strings.index(expect(c, "char").col, expect(s, "string").col), True)
OPS["split-on"] = lambda sep, s: Value(strings.split_on(expect(sep, "string").col, expect(s, "string").col), Maybe(Type("arr", (plain("string"),))))


@op("join")
def _join(sep, xs):
    expect(sep, "string")
    need(item_of(xs).typ.kind == "string", f"strings are joined, not {xs.mn}")
    return of("string", F.concat_ws("", F.transform(xs.col, lambda x, i: F.when(i > 0, F.concat(sep.col, x)).otherwise(x))))


@op("substring")
def _substring(s, a, b):
    integer(a), integer(b)
    return of("string", strings.substring(expect(s, "string").col, a.col, b.col))


@op("split-at")
def _split_at(n, s):
    integer(n)
    return Value(strings.split_at(n.col, expect(s, "string").col), Maybe(Type("tup", (plain("string"), plain("string")))))


@op("find-substring")
def _find_substring(from_start, needle, hay):
    return of("u24", strings.find(expect(from_start, "bool").col, expect(needle, "string").col, expect(hay, "string").col), True)


@special("strftime")
def _strftime(tree, env):
    fmt, t = compile_tree(tree[1], env), compile_tree(tree[2], env)
    need(isinstance(fmt.literal, str), "a time format is a constant")
    numeric(t)
    return of("string", dates.strftime(fmt.literal, t.col))


# --- containers ------------------------------------------------------------------------------------------------

CONTAINERS = ("vec", "arr", "lst", "set")


def item_of(v: Value) -> Maybe:
    expect(v, *CONTAINERS)
    return develop(v.mn.typ).items[0]


@op("cardinality")
def _cardinality(v):
    item_of(v)
    return of("u32", F.size(v.col).cast("long"))


@op("nth")
def _nth(i, v):
    integer(i)
    if v.kind == "string":
        return of("char", strings.nth_char(i.col, v.col), True)
    item = item_of(v)
    inside = (i.col >= 0) & (i.col < F.size(v.col))
    return Value(F.get(v.col, F.when(inside, i.col).otherwise(-1).cast("int")), Maybe(item.typ, True))


@op("unsafe-nth")
def _unsafe_nth(i, v):
    integer(i)
    if v.kind == "string":
        return of("char", strings.nth_char(i.col, v.col))
    return Value(v.col[i.col.cast("int")], item_of(v))


@op("head")
def _head(v):
    return Value(F.get(v.col, F.lit(0)), Maybe(item_of(v).typ, True))


@op("tail")
def _tail(v):
    item_of(v)
    return Value(F.when(F.size(v.col) > 0, F.slice(v.col, F.lit(2), F.greatest(F.size(v.col) - 1, F.lit(0)))), Maybe(v.mn.typ, True))


@op("cons")
def _cons(x, v):
    need(equal(x.mn.typ, item_of(v).typ), f"{x.mn} before {v.mn}")
    return Value(F.array_prepend(v.col, x.col), v.mn)


def _as(kind: str, reverse: bool, *sources: str):
    def build(v):
        expect(v, *sources)
        return Value(F.reverse(v.col) if reverse else v.col, Maybe(Type(kind, develop(v.mn.typ).items, (), "simple" if kind == "set" else None)))

    return build


OPS["arr-of-lst"] = _as("arr", False, "lst")
OPS["arr-of-lst-rev"] = _as("arr", True, "lst")
OPS["set-of-lst"] = _as("set", True, "lst")
OPS["arr-of-vec"] = _as("arr", False, "vec")
OPS["arr-of-set"] = _as("arr", False, "set")


@special("alloc-vec", "alloc-arr")
def _alloc(tree, env):
    n, x = compile_tree(tree[1], env), compile_tree(tree[2], env)
    integer(n)
    if tree[0] == "alloc-arr":
        return Value(F.array_repeat(x.col, n.col.cast("int")), Maybe(Type("arr", (x.mn,))))
    need(isinstance(n.literal, int) and n.literal > 0, "the size of a vector is a constant")
    return Value(F.array_repeat(x.col, n.literal), Maybe(Type("vec", (x.mn,), (), n.literal)))


@special("truncate")
def _truncate(tree, env):
    o, n, v = _const_int(tree[1]), _const_int(tree[2]), compile_tree(tree[3], env)
    expect(v, "vec")
    need(o >= 0 and n > 0 and o + n <= develop(v.mn.typ).extra, f"{v.mn} has no items {o} to {o + n}")
    return Value(F.slice(v.col, o + 1, n), Maybe(Type("vec", develop(v.mn.typ).items, (), n)))


@op("chop-begin")
def _chop_begin(v, n):
    integer(n)
    expect(v, "arr")
    return Value(F.slice(v.col, n.col.cast("int") + 1, F.greatest(F.size(v.col) - n.col.cast("int"), F.lit(0))), v.mn)


@op("chop-end")
def _chop_end(v, n):
    integer(n)
    expect(v, "arr")
    return Value(F.slice(v.col, F.lit(1), F.greatest(F.size(v.col) - n.col.cast("int"), F.lit(0))), v.mn)


@op("set-vec")
def _set_vec(i, v, x):
    integer(i)
    need(equal(x.mn.typ, item_of(v).typ), f"{x.mn} into {v.mn}")
    return Value(F.transform(v.col, lambda old, k: F.when(k == i.col, x.col).otherwise(old)), v.mn)


@op("member")
def _member(x, v):
    item = item_of(v)
    need(equal(x.mn.typ, item.typ), f"{x.mn} in {v.mn}")
    if x.mn.nullable or item.nullable:
        return of("bool", F.exists(v.col, lambda y: y.eqNullSafe(x.col)))
    return of("bool", F.coalesce(F.array_contains(v.col, x.col), F.lit(False)))


@op("get-min")
def _get_min(v):
    return Value(F.array_min(v.col), item_of(v))


@op("partial-sort")
def _partial_sort(v, ranks):
    expect(v, "vec", "arr")
    return Value(F.array_sort(v.col), v.mn)


@special("map")
def _map(tree, env):
    init, f, v = (compile_tree(x, env) for x in tree[1:4])
    item, seen = item_of(v), {}

    def body(x):
        seen["mn"] = (got := f(init, Value(x, item))).mn
        return got.col

    col = F.transform(v.col, body)
    t = develop(v.mn.typ)
    return Value(col, Maybe(Type(t.kind, (seen["mn"],), (), t.extra)))


@special("exists")
def _exists(tree, env):
    v, f = compile_tree(tree[1], env), compile_tree(tree[2], env)
    item = item_of(v)
    return of("bool", F.exists(v.col, lambda x: f(Value(x, item)).col))


@special("fold")
def _fold_items(tree, env):
    """(fold init (fun (state item) body) container): what a loop over the items would make of a state."""
    init, f, v = (compile_tree(x, env) for x in tree[1:4])
    item = item_of(v)
    return Value(F.aggregate(v.col, init.col, lambda a, x: f(Value(a, init.mn), Value(x, item)).col), init.mn)


@special("convert")
def _convert(tree, env):
    from ..operators.convert import convert

    return convert(compile_tree(tree[2], env), type_text(tree[1]))


@special("is-in")
def _is_in(tree, env):
    from ..functions.library import is_in

    return is_in(compile_tree(tree[1], env), compile_tree(tree[2], env))


@special("is-empty")
def _is_empty(tree, env):
    from ..functions.library import is_empty

    return is_empty(compile_tree(tree[1], env))


@special("default")
def _default(tree, env):
    m = type_text(tree[1])
    return Value(value_column(zero(m), m), m)


@special("percentiles")
def _percentiles(tree, env):
    from ..functions.library import percentiles

    v = compile_tree(tree[1], env)
    ps = [float(x) for x in tree[2:]]
    return Value(percentiles(v.col, ps), Maybe(Type("vec", (Maybe(item_of(v).typ, True),), (), len(ps))))


def typed(col: Column | str, kind: str | Maybe) -> Value:
    """A column with its type, for use as a parameter."""
    return Value(F.col(col) if isinstance(col, str) else col, parse(kind) if isinstance(kind, str) else kind)


def evaluate(text: str, *params: Value, **names: Value) -> Column:
    """The Column of an expression; a function is applied to the parameters."""
    got = compile_text(text, Env(dict(names), list(params)))
    return got(*params).col if isinstance(got, Lambda) else got.col


from . import cursors  # noqa: E402, F401  its operators join those above

__all__ = ["Env", "Lambda", "TypeProblem", "Value", "compile_text", "evaluate", "text_of", "typed"]
