"""Aggregation by init, update and finalize expressions.

Updates of known shapes become Spark's own aggregates with partial results: components of a vector or tuple that add,
take the least or greatest, or count; and insertions into sets. Any other update is a fold over the group's rows in a
stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..plans import compile as C
from ..plans.compile import Env, Lambda, Value, compile_tree, need
from ..plans.text import read
from ..plans.types import INTEGERS, Maybe, Type, develop, equal
from . import accumulators

#: Constructors of sets, and the flavour of each.
SETS = {"sliding-window": "sliding", "tumbling-window": "tumbling", "sampling": "sampling", "hash-table": "hashtable", "heap": "heap", "top": "top", "empty-set": "simple"}


def row_value(df: DataFrame, m: Maybe | None) -> Value:
    """The row of a table as one typed value."""
    from ..plans.types import from_spark

    if m is None:
        m = from_spark(df.schema, False)
    t = develop(m.typ)
    if t.kind in ("rec", "tup"):
        names = t.names or [f"_{i}" for i in range(1, len(t.items) + 1)]
        return Value(F.struct(*[F.col(f"`{n}`").alias(n) for n in names]), m)
    return Value(F.col("value"), m)


def aggregate(df: DataFrame, m: Maybe | None, init: str, update: str, finalize: str, keys: list[str] | None = None, order=None, into: str = "value") -> tuple[DataFrame, Maybe]:
    """One row for each group of ``keys`` (one row in all without keys): the keys and ``into``."""
    keys = list(keys or [])
    row = row_value(df, m)
    start, last = read(init), compile_tree(read(finalize), Env())
    need(isinstance(last, Lambda) and len(last.params) == 1, "finalize is a function of the state")
    tree = read(update)
    need(isinstance(tree, list) and tree[0] == "fun", "update is a function of state and row")
    types = [C.type_text(x) for x in (tree[1] if isinstance(tree[1], list) else [tree[1]])]
    need(len(types) == 2, "update has two parameters, state and row")
    need(equal(types[1].typ, row.mn.typ), f"rows are {row.mn}, not {types[1]}")
    if isinstance(start, list) and start and start[0] in SETS:
        return _set(df, keys, order, start, tree, types, row, last, into)
    state = compile_tree(start, Env())
    need(equal(state.mn.typ, types[0].typ), f"the state is {state.mn}, not {types[0]}")
    parts = _parts(tree[2], state, row)
    if parts is not None:
        made = {f"_s{i}": agg for i, agg in parts.items()}
        out = df.groupBy(*keys).agg(*[a.alias(n) for n, a in made.items()]) if made else df.groupBy(*keys).agg(F.count("*").alias("_s"))
        got = last(_merged(state, parts))
    else:
        need(order is not None, "an update that cannot be split needs an order of the rows")
        cols = [F.col(o) if isinstance(o, str) else o for o in ([order] if isinstance(order, (str, Column)) else order)]
        packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)], row.col.alias("row"))
        out = df.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("_rows"))

        def step(acc, x):
            got = compile_tree(tree[2], Env({}, [Value(acc, state.mn), Value(x["row"], row.mn)]))
            need(equal(got.mn.typ, state.mn.typ), f"update makes {got.mn} of {state.mn}")
            return got.col

        got = last(Value(F.aggregate("_rows", state.col, step), state.mn))
    return out.select(*keys, got.col.alias(into)), got.mn


def _const(tree) -> int | None:
    while isinstance(tree, list) and len(tree) == 2:
        tree = tree[1]
    return int(tree) if isinstance(tree, str) and tree.lstrip("-").isdigit() else None


def _is_state(tree) -> bool:
    return isinstance(tree, list) and tree[0] == "param" and _const(tree) == 0


def _mentions_state(tree) -> bool:
    return _is_state(tree) or isinstance(tree, list) and any(map(_mentions_state, tree))


def _reads(tree, i: int) -> bool:
    """Is this component i of the state?"""
    return isinstance(tree, list) and len(tree) == 3 and tree[0] in ("unsafe-nth", "nth", "get-item") and _const(tree[1]) == i and _is_state(tree[2])


def _parts(body, state: Value, row: Value) -> dict[int, Column] | None:
    """The aggregate of each component that an update changes, or None for another shape."""
    t = develop(state.mn.typ)
    if t.kind not in ("vec", "tup"):
        return None
    steps = body[1:] if isinstance(body, list) and body and body[0] == "seq" else [body]
    out: dict[int, Column] = {}
    for s in steps:
        if isinstance(s, list) and len(s) == 4 and s[0] == "set-vec" and _is_state(s[2]):
            i, e = _const(s[1]), s[3]
        elif isinstance(s, list) and len(s) == 4 and s[0] == "copy-tup" and _is_state(s[1]):
            i, e = _const(s[2]), s[3]
        else:
            return None
        if i is None or i in out or not isinstance(e, list) or len(e) != 3 or e[0] not in ("add", "+", "min", "max"):
            return None
        other = e[2] if _reads(e[1], i) else e[1] if _reads(e[2], i) else None
        if other is None or _mentions_state(other):
            return None
        item = t.items[0] if t.kind == "vec" else t.items[i]
        v = compile_tree(other, Env({}, [state, row]))
        need(equal(v.mn.typ, item.typ) and not v.mn.nullable, f"component {i} is {item}, not {v.mn}")
        first = state.col[i] if t.kind == "vec" else state.col.getField(f"_{i + 1}")
        kind = develop(item.typ).kind
        if e[0] in ("add", "+"):
            if kind == "float":
                out[i] = F.first(first) + F.coalesce(F.sum(v.col), F.lit(0.0))
            elif kind in INTEGERS and INTEGERS[kind] < 128:
                # sums wrap as single additions do
                total = F.coalesce(F.sum(v.col.cast("decimal(20,0)")).cast(numbers.BIG), F.lit(0).cast(numbers.BIG))
                out[i] = numbers.wrap(F.any_value(first).cast(numbers.BIG) + total, kind)
            else:
                return None
        else:
            f, g = (F.min, F.least) if e[0] == "min" else (F.max, F.greatest)
            out[i] = g(F.any_value(first), f(v.col))
    return out


def _merged(state: Value, parts: dict[int, Column]) -> Value:
    t = develop(state.mn.typ)
    get = lambda i, old: F.coalesce(F.col(f"_s{i}"), old) if i in parts else old
    if t.kind == "vec":
        return Value(F.array(*[get(i, state.col[i]) for i in range(t.extra)]), state.mn)
    return Value(F.struct(*[get(i, state.col.getField(f"_{i + 1}")).alias(f"_{i + 1}") for i in range(len(t.items))]), state.mn)


def _number(tree, default: float = 0.0) -> float:
    while isinstance(tree, list):
        tree = tree[-1]
    return float(tree) if tree is not None else default


def _set(df, keys, order, start, tree, types, row: Value, last: Lambda, into: str):
    flavour = SETS[start[0]]
    body = tree[2]
    factor = None
    if isinstance(body, list) and len(body) == 3 and body[0] == "seq" and isinstance(body[1], list) and body[1][0] == "scale-weights" and _is_state(body[1][1]):
        factor, body = compile_tree(body[1][2], Env()).literal, body[2]
        need(isinstance(factor, (int, float)) and order is not None, "weights are scaled by a constant, in a stated order of the rows")
    need(isinstance(body, list) and body[0] in ("insert", "insert-weighted") and _is_state(body[1]), "a set is updated by an insertion")
    weighted = body[0] == "insert-weighted"
    item_tree = body[3 if weighted else 2]
    item = compile_tree(item_tree, Env({}, [Value(None, types[0]), row]))
    kind = develop(types[0].typ)
    need(kind.kind == "set" and kind.extra == flavour and equal(kind.items[0].typ, item.mn.typ), f"{types[0]} is no {flavour} set of {item.mn}")
    rows = df.select(*keys, item.col.alias("_item"), *([compile_tree(body[2], Env({}, [Value(None, types[0]), row])).col.alias("_w")] if weighted else []), *_order(order))
    names = [f"_o{i}" for i in range(len(_order(order)))]
    if factor is not None:
        need(weighted, "only weights are scaled")
        rows = accumulators.scaled_by_rows(rows, keys, names, "_w", factor)
    if flavour == "simple":
        need(bool(names), "a list in order needs an order of the rows")
        packed = F.struct(*[F.col(n) for n in names], "_item")
        out = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["_item"]).alias("_set"))
    elif flavour in ("sliding", "tumbling"):
        need(bool(names), "a window needs an order of the rows")
        n = int(_number(start[2]))
        if flavour == "tumbling":
            marked = accumulators.tumbling(rows, keys, names, n)
            w = marked.groupBy(*keys).agg(F.max("bucket").alias("_last"))
            rows = (marked.join(w, keys) if keys else marked.crossJoin(F.broadcast(w))).where("bucket = _last")
        out = accumulators.sliding_lists(rows, keys, names, n, "_item", "_set")
    elif flavour == "sampling":
        out = accumulators.sampling(rows, keys, int(_number(start[2]))).groupBy(*keys).agg(F.collect_list("_item").alias("_set"))
    elif flavour == "hashtable":
        out = accumulators.hash_set(rows, keys, "_item", "_set")
    elif flavour == "heap":
        out = accumulators.heap(rows, keys, "_item", into="_set")
    else:
        need(weighted, "a top set takes weights")
        size, sigmas = int(_number(start[2])), _number(start[4]) if len(start) > 4 else 0.0
        best = accumulators.top(rows, keys, "_item", "_w", size, sigmas)
        out = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_item"))), lambda x: x["_item"]).alias("_set"))
    got = last(Value(F.col("_set"), Maybe(Type("set", (item.mn,), (), flavour))))
    return out.select(*keys, got.col.alias(into)), got.mn


def _order(order) -> list[Column]:
    if order is None:
        return []
    cols = [F.col(o) if isinstance(o, str) else o for o in ([order] if isinstance(order, (str, Column)) else order)]
    return [c.alias(f"_o{i}") for i, c in enumerate(cols)]


__all__ = ["aggregate", "row_value"]
