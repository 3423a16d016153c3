"""One query for each class of operators of the expression language, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import library
from .operators import accumulators, rows
from .operators.aggregate import aggregate
from .plans.compile import Env, compile_text, typed
from .plans.types import INTEGERS, SIGNED, parse
from .queries import ev, query, table
from .sources import codec, encode_column
from .sources.base import packed


def text(expression: str) -> str:
    """Integers of all widths compare as text."""
    return f"(string-of-int {expression})"


@query("""
SELECT o_orderkey, NOT (o_orderkey > o_custkey) AS neither, o_orderkey > o_custkey AND o_custkey >= 100 AND o_orderstatus = 'O' AS all_hold, o_orderkey <= o_custkey OR o_orderstatus = 'F' AS some_hold,
 o_custkey % 3 = 0 AS none, coalesce(nullif(o_custkey % 3, 0) = 1, false) AS is_one, o_orderkey < o_custkey AS lt, o_orderkey <= o_custkey AS le, o_orderstatus <> 'O' AS ne, o_orderkey >= o_custkey AS ge,
 CASE WHEN o_orderkey > o_custkey AND NOT o_orderstatus = 'O' THEN 'a' ELSE 'b' END AS pick, CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE o_custkey % 3 END AS or_seven FROM orders""")
def q_logic(spark, sf):
    e = lambda t: ev(t, k=("o_orderkey", "i64"), c=("o_custkey", "i64"), s=("o_orderstatus", "string"), n=(F.nullif(F.col("o_custkey") % 3, F.lit(0)), "i64?"))
    return table(spark, sf, "orders").select(
        "o_orderkey", e("(not (gt k c))").alias("neither"), e('(and (gt k c) (ge c (i64 100)) (eq s "O"))').alias("all_hold"), e('(or (le k c) (eq s "F"))').alias("some_hold"), e("(is-null n)").alias("none"),
        e("(eq n (not-null (i64 1)))").alias("is_one"), e("(lt k c)").alias("lt"), e("(le k c)").alias("le"), e('(ne s "O")').alias("ne"), e("(ge k c)").alias("ge"), e('(if (and (gt k c) (not (eq s "O"))) "a" "b")').alias("pick"),
        e("(if (is-null n) (i64 7) (force n))").alias("or_seven"),
    )


def _modulo(n: int, signed: bool, x: str) -> str:
    m = f"CAST({1 << n} AS HUGEINT)"
    low = f"((({x}) % {m}) + {m}) % {m}"
    return f"CAST(({low} + {1 << (n - 1)}) % {m} - {1 << (n - 1)} AS VARCHAR)" if signed else f"CAST({low} AS VARCHAR)"


NARROW = [k for k, n in INTEGERS.items() if n < 128]
KEY = "(l_orderkey * 1000003 - 2500000000) * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 4099 END)"


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_modulo(INTEGERS[k], k in SIGNED, f'CAST({KEY} AS HUGEINT)')} AS {k}" for k in NARROW) + f", CAST(CAST({KEY} AS HUGEINT) AS VARCHAR) AS i128, CASE WHEN {KEY} < 0 THEN CAST(340282366920938463463374607431768211455 - CAST(-({KEY}) - 1 AS UHUGEINT) AS VARCHAR) ELSE CAST({KEY} AS VARCHAR) END AS u128 FROM lineitem")
def q_casts(spark, sf):
    """to-u8 to to-i128: one number at every width."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(KEY).cast("long").alias("x"))
    return lines.select("l_orderkey", "l_linenumber", *[ev(text(f"(to-{k} x)"), x=("x", "i64")).alias(k) for k in [*NARROW, "i128", "u128"]])


SPELLED = "(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END) * CAST(p_partkey AS HUGEINT) * {}"
TENS = "(CASE p_size % 12 " + " ".join(f"WHEN {i} THEN CAST({10**i} AS HUGEINT)" for i in range(11)) + f" ELSE CAST({10**15} AS HUGEINT) END)"


def _bounds(k: str) -> tuple[int, int]:
    n = INTEGERS[k]
    return (-(1 << (n - 1)), (1 << (n - 1)) - 1) if k in SIGNED else (0, (1 << n) - 1)


@query(f"WITH t AS (SELECT p_partkey, {SPELLED.format(TENS)} AS x FROM part) SELECT p_partkey, " + ", ".join(f"CASE WHEN x BETWEEN CAST({max(_bounds(k)[0], -(10**37))} AS HUGEINT) AND CAST({min(_bounds(k)[1], 10**37)} AS HUGEINT) THEN CAST(x AS VARCHAR) END AS {k}" for k in INTEGERS) + " FROM t")
def q_parses(spark, sf):
    """u8-of-string to i128-of-string: NULL out of range."""
    tens = F.element_at(F.array(*[F.lit(str(10**i)).cast("decimal(20,0)") for i in range(11)], F.lit(str(10**15)).cast("decimal(20,0)")), (F.col("p_size") % 12 + 1).cast("int"))
    spelled = (F.when(F.col("p_partkey") % 3 == 0, -1).otherwise(1) * F.col("p_partkey") * tens).cast("decimal(38,0)").cast("string")
    parts = table(spark, sf, "part").select("p_partkey", spelled.alias("s"))
    return parts.select("p_partkey", *[ev(f'(null-map "v" ({k}-of-string s) {text("v")})', s=("s", "string")).alias(k) for k in INTEGERS])


#: A literal of each scalar type, and what it is.
LITERALS = {"u8": 200, "u16": 60000, "u24": 15134052, "u32": 4000000007, "u40": 1099511627775, "u48": 281474976710655, "u56": 72057594037927935, "u64": 18446744073709551615, "u128": 170141183460469231731687303715884105728, "i8": -128, "i16": -32768, "i24": -8388608, "i32": -2147483648, "i40": -161920788051, "i48": -140737488355328, "i56": -36028797018963967, "i64": -9223372036854775807, "i128": -1213949874624120272}


@query("SELECT r_regionkey, " + ", ".join(f"'{v}' AS {k}" for k, v in LITERALS.items()) + ", 1.5 :: DOUBLE AS f, 'foo' AS s, true AS b, 'x' AS c, '666F6F' AS raw, 77 :: BIGINT AS size, 99 :: DOUBLE AS address, CAST(NULL AS VARCHAR) AS none, 0 :: BIGINT AS no_items, 0 :: BIGINT AS no_members, 0 :: SMALLINT AS zero, '' AS empty FROM region")
def q_literals(spark, sf):
    e = lambda t: ev(t)
    return table(spark, sf, "region").select(
        "r_regionkey", *[e(text(f"({k} {v})")).alias(k) for k, v in LITERALS.items()], e("(float 1.5)").alias("f"), e('(string "foo")').alias("s"), e("(bool true)").alias("b"), e('(char "x")').alias("c"), F.hex(e('(bytes "foo")')).alias("raw"), e("(size 77)").alias("size"),
        e("(address 99)").cast("double").alias("address"), e('(null "string")').alias("none"), e('(cardinality (end-of-list "u8"))').alias("no_items"), e('(cardinality (empty-set "string"))').alias("no_members"), e('(default "u8")').alias("zero"), e('(default "string")').alias("empty"),
    )


def _doubled(v):
    return compile_text('(fun ("i32") (mul (param 0) (i32 2)))')(v)


@query("""
SELECT n_nationkey, n_nationkey + 1 AS applied, 2 * n_nationkey AS bound, n_nationkey + n_nationkey * 3 AS pair, n_nationkey AS same, n_nationkey AS commented, n_nationkey AS after_checks, n_nationkey * 2 + 1 AS spelled, 2 * n_nationkey AS outside, 2 * n_nationkey AS dotted,
 n_nationkey + 0 AS named, CAST((n_nationkey % 6) * (n_nationkey % 6 + 1) // 2 AS BIGINT) AS recursive, CAST(NULL AS VARCHAR) AS unset, n_nationkey AS unreached, n_name AS one_of FROM nation""")
def q_control(spark, sf):
    """Functions, names, sequences, recursion, checks."""
    scope = {"n": typed("n_nationkey", "i32"), "s": typed("n_name", "string")}
    outer = type("Module", (), {"double": staticmethod(_doubled)})
    e = lambda t: compile_text(t, Env(scope, [], {"double": _doubled, "module": outer})).col
    sums = '((fun ("i64") (if (gt (i64 1) (param 0)) (i64 0) (add (param 0) (myself (sub (param 0) (i64 1)))))) (to-i64 (unsafe-rem n (i32 6))))'
    return table(spark, sf, "nation").select(
        "n_nationkey", e('(apply (fun ("i32") (add (param 0) (i32 1))) n)').alias("applied"), e('(let "x" n (add x x))').alias("bound"), e('(let-pair "a" "b" (make-tup n (mul n (i32 3))) (add a b))').alias("pair"), e("(identity n)").alias("same"), e('(comment "a note" n)').alias("commented"),
        e("(seq (ignore n) (dump n) (assert (ge n (i32 0))) n)").alias("after_checks"), e('(verbatim "%1 * 2 + 1" "i32" n)').alias("spelled"), e("(apply (ext-identifier double) n)").alias("outside"), e("(apply (ext-identifier module double) n)").alias("dotted"), e("(add (identifier n) (i32 0))").alias("named"),
        e(sums).alias("recursive"), e('(getenv "MILLRACE_NOT_SET")').alias("unset"), e('(if (ge n (i32 0)) n (no-return "i32"))').alias("unreached"), e('(get-field "a" (make-rec a s b n))').alias("one_of"),
    )


@query("""
SELECT l_orderkey, l_linenumber, round(tan(l_discount), 8) AS tan, round(asin(l_discount), 8) AS asin, round(cosh(l_discount), 8) AS cosh, round(tanh(l_discount), 8) AS tanh, round(log10(l_quantity), 8) AS log10, round(ln(l_quantity), 8) AS log, round(log10(l_quantity), 8) AS log10_too,
 round(sqrt(l_quantity), 8) AS root, floor(l_extendedprice / l_quantity) AS ratio, l_orderkey // l_linenumber AS whole, round(pow(l_quantity, 2), 6) AS square, l_linenumber * l_linenumber AS square_too, l_orderkey % l_linenumber AS rest, CAST(l_partkey AS DOUBLE) AS f FROM lineitem""")
def q_math_more(spark, sf):
    e = lambda t: ev(t, price=("l_extendedprice", "float"), disc=("l_discount", "float"), qty=("l_quantity", "float"), key=("l_orderkey", "i64"), line=("l_linenumber", "i32"), part=("l_partkey", "i64"))
    r = lambda t, n=8: F.round(e(t), n)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r("(force (tan disc))").alias("tan"), r("(force (asin disc))").alias("asin"), r("(cosh disc)").alias("cosh"), r("(tanh disc)").alias("tanh"), r("(force (log10 qty))").alias("log10"), r("(unsafe-log qty)").alias("log"), r("(unsafe-log10 qty)").alias("log10_too"),
        r("(unsafe-sqrt qty)").alias("root"), e("(floor (unsafe-div price qty))").alias("ratio"), e("(unsafe-div key (to-i64 line))").alias("whole"), r("(unsafe-pow qty (float 2.0))", 6).alias("square"), e("(unsafe-pow line (i32 2))").alias("square_too"), e("(unsafe-rem key (to-i64 line))").alias("rest"), e("(to-float part)").alias("f"),
    )


@query("""
SELECT c_custkey, CAST(ascii(substr(c_name, 2, 1)) AS SMALLINT) AS code, chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS letter, substr(c_name, 1, 1) AS first, CAST(CASE WHEN c_nationkey > 9 THEN 1 ELSE 0 END AS SMALLINT) AS flag, c_custkey % 256 <> 0 AS truth,
 c_custkey % 4294967296 AS size, c_custkey % 4294967296 AS back, CAST(instr(c_name, '#') - 1 AS DOUBLE) AS place, instr(c_mktsegment, 'I') > 0 AS has_i FROM customer""")
def q_chars(spark, sf):
    e = lambda t: ev(t, s=("c_name", "string"), k=("c_custkey", "i64"), n=("c_nationkey", "i32"), m=("c_mktsegment", "string"))
    return table(spark, sf, "customer").select(
        "c_custkey", e("(u8-of-char (force (nth (u8 1) s)))").alias("code"), e("(string-of-char (char-of-u8 (add (u8 65) (to-u8 (unsafe-rem k (i64 26))))))").alias("letter"), e("(string-of-char (unsafe-nth (u8 0) s))").alias("first"), e("(u8-of-bool (gt n (i32 9)))").alias("flag"), e("(bool-of-u8 (to-u8 k))").alias("truth"),
        e("(size-of-u32 (to-u32 k))").alias("size"), e("(u32-of-size (size-of-u32 (to-u32 k)))").alias("back"), e('(index (char "#") s)').cast("double").alias("place"), e('(not (is-null (index (char "I") m)))').alias("has_i"),
    )


@query("""
SELECT n_nationkey, CAST(CAST(1023 + n_nationkey AS HUGEINT) * 4503599627370496 AS VARCHAR) AS bits, pow(2, n_nationkey) AS again, '0x1p+' || n_nationkey AS hexed, CAST(CAST(pow(2, n_nationkey) AS BIGINT) AS VARCHAR) AS plain, CAST(n_nationkey + 0.5 AS DOUBLE) AS read,
 CASE WHEN n_nationkey = 0 THEN '0x1p-1' ELSE '0x1p-' || (n_nationkey + 1) END AS small FROM nation""")
def q_float_text(spark, sf):
    e = lambda t: ev(t, n=("n_nationkey", "i32"))
    two = "(unsafe-pow (float 2.0) (to-float n))"
    return table(spark, sf, "nation").select(
        "n_nationkey", e(text(f"(u64-of-float {two})")).alias("bits"), e(f"(float-of-u64 (u64-of-float {two}))").alias("again"), e(f"(string-of-float {two})").alias("hexed"), e(f"(decimal-string-of-float {two})").alias("plain"), e('(force (float-of-string (append-string (string-of-int n) ".5")))').alias("read"),
        e("(string-of-float (unsafe-pow (float 0.5) (to-float (add n (i32 1)))))").alias("small"),
    )


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS e FROM embeddings), w AS (SELECT vec_id, e, e[1] AS a, e[2] AS b, e[3] AS c FROM v)
SELECT vec_id, [a, b, c] AS listed, [c, b, a] AS turned, [a, b] AS of_vec, CAST(3 AS BIGINT) AS members, e[1] AS head, CAST(len(e) - 1 AS BIGINT) AS rest, [c, a, b] AS longer, [a, a, a] AS filled, CAST(len(e) AS BIGINT) AS filled_n, [b, c] AS part, a = b OR a = c AS known,
 [a, b, c] AS inserted, list_sort([a, b, c])[2:] AS without_least, CASE WHEN a = b THEN [a] ELSE [a, b] END AS once, [b, c] AS last_two, [c] AS bucket, least(a, b, c) AS low, len(list_filter(e, lambda x: x > 0)) > 0 AS some, e[1:2] AS kept FROM w""")
def q_lists(spark, sf):
    e0 = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    e = lambda t: ev(t, e=("e", "i32[]"), a=("a", "i32"), b=("b", "i32"), c=("c", "i32"))
    lst = '(cons a (cons b (cons c (end-of-list "i32"))))'
    vectors = table(spark, sf, "embeddings").select("vec_id", e0.alias("e")).select("vec_id", "e", *[F.get("e", F.lit(i)).alias(n) for i, n in enumerate("abc")])
    added = lambda empty: f"(insert (insert (insert {empty} a) b) c)"
    return vectors.select(
        "vec_id", e(f"(arr-of-lst {lst})").alias("listed"), e(f"(arr-of-lst-rev {lst})").alias("turned"), e("(arr-of-vec (make-vec a b))").alias("of_vec"), e(f"(cardinality (set-of-lst {lst}))").alias("members"), e(f"(force (head {lst}))").alias("head"), e('(cardinality (chop-begin e (u8 1)))').alias("rest"),
        e('(arr-of-lst (cons c (cons a (force (tail (cons c (cons b (end-of-list "i32"))))))))').alias("longer"), e("(alloc-vec (u8 3) a)").alias("filled"), e("(cardinality (alloc-arr (cardinality e) a))").alias("filled_n"), e("(truncate 1 2 (make-vec a b c))").alias("part"), e("(mem a (make-vec b c))").alias("known"),
        e(f'(arr-of-set {added("(empty-set " + chr(34) + "i32" + chr(34) + ")")})').alias("inserted"), e(f'(arr-of-set (del-min {added("(heap " + chr(34) + "i32" + chr(34) + ")")} (u8 1)))').alias("without_least"), e('(arr-of-set (insert (insert (hash-table "i32" (u8 9)) a) b))').alias("once"),
        e(f'(arr-of-set {added("(sliding-window " + chr(34) + "i32" + chr(34) + " (u8 2))")})').alias("last_two"), e(f'(arr-of-set {added("(tumbling-window " + chr(34) + "i32" + chr(34) + " (u8 2))")})').alias("bucket"), e("(get-min (make-vec a b c))").alias("low"), e('(exists e (fun ("i32") (gt (param 0) (i32 0))))').alias("some"),
        e("(chop-end e (sub (cardinality e) (u32 2)))").alias("kept"),
    )


@query("""
SELECT p_partkey, CAST(octet_length(encode(p_name)) AS BIGINT) AS n, p_name AS back, hex(encode(p_name)) AS raw, hex(encode(p_name || p_brand)) AS joined, hex(encode(p_name)) || '07' AS longer, left(p_name, 3) AS before, substr(p_name, 4) AS after FROM part""")
def q_bytes(spark, sf):
    e = lambda t: ev(t, s=("p_name", "string"), b=("p_brand", "string"))
    return table(spark, sf, "part").select(
        "p_partkey", e("(bytes-length (bytes-of-string s))").alias("n"), e("(string-of-bytes (bytes-of-string s))").alias("back"), F.hex(e("(bytes-of-string s)")).alias("raw"), F.hex(e("(append-bytes (bytes-of-string s) (bytes-of-string b))")).alias("joined"),
        F.hex(e("(append-byte (bytes-of-string s) (u8 7))")).alias("longer"), e("(fst (split-at (u8 3) s))").alias("before"), e("(snd (split-at (u8 3) s))").alias("after"),
    )


def _spell(n: int, begin: int, little: bool, kind: str = "HUGEINT") -> str:
    """The number that so many characters of c_name are, in SQL."""
    at = range(begin, begin + n)
    terms = [f"CAST(ascii(substr(c_name, {p + 1}, 1)) AS {kind}) * CAST({1 << 8 * (k if little else n - 1 - k)} AS {kind})" for k, p in enumerate(at)]
    return f"CAST({' + '.join(terms)} AS VARCHAR)"


WORDS = (("u8", 1), ("u16", 2), ("u32", 4), ("u64", 8), ("u128", 16))


@query("SELECT c_custkey, " + ", ".join(f"{_spell(n, 0, little, 'UHUGEINT')} AS read_{k}_{'le' if little else 'be'}, {_spell(n, 2, little, 'UHUGEINT')} AS peek_{k}_{'le' if little else 'be'}, '0' || hex(encode(substr(c_name, 1, {n}))) || '00' AS write_{k}_{'le' if little else 'be'}" for k, n in WORDS for little in ((False,) if n == 1 else (False, True))) + " FROM customer")
def q_words(spark, sf):
    """read, peek and write of words: what is read is written again, and one byte of the buffer stays."""
    e = lambda t: ev(t, s=("c_name", "string"))
    out = []
    for k, n in WORDS:
        for end in ("",) if n == 1 else (" big-endian", " little-endian"):
            name = f"{k}_{'le' if 'little' in end else 'be'}"
            read = f"(read-{k}{end} (ptr-of-string s))"
            out += [e(text(f"(get-item 0 {read})")).alias(f"read_{name}"), e(text(f"(peek-{k}{end} (ptr-of-string s) (size 2))")).alias(f"peek_{name}")]
            again = f"(get-item 0 (read-bytes (rewind (write-{k}{end} (ptr-of-buffer (size {n + 1})) (get-item 0 {read})) (size {n})) (size {n + 1})))"
            out.append(F.concat(F.lit("0"), F.hex(e(again))).alias(f"write_{name}"))
    return table(spark, sf, "customer").select("c_custkey", *out)


@query("""
SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS rest, CAST(length(c_name) - 5 AS BIGINT) AS rest_after, CAST(5 AS BIGINT) AS at, CAST(3 AS BIGINT) AS apart, CAST(2 AS BIGINT) AS rewound, CAST(4 AS BIGINT) AS part_rest, substr(c_name, 3, 4) AS part, hex(encode(substr(c_name, 1, 3))) || '0000' AS copied,
 hex(encode('x' || substr(c_name, 2))) AS poked, '2A2A2A' AS filled, (ascii(substr(c_name, 2, 1)) // 4) % 2 = 1 AS bit, hex(encode(chr(CAST(ascii(substr(c_name, 1, 1)) | 1 AS INTEGER)) || substr(c_name, 2))) AS bit_set, hex(encode(chr(CAST(ascii(substr(c_name, 1, 1)) & 254 AS INTEGER)) || substr(c_name, 2))) AS bit_cleared,
 CAST(c_custkey AS VARCHAR) AS address FROM customer""")
def q_cursors(spark, sf):
    e = lambda t: ev(t, s=("c_name", "string"), k=("c_custkey", "i64"))
    p = "(ptr-of-string s)"
    whole = lambda c: f"(get-item 0 (read-bytes {c} (rem-size {c})))"
    return table(spark, sf, "customer").select(
        "c_custkey", e(f"(rem-size {p})").alias("rest"), e(f"(rem-size (ptr-add {p} (size 5)))").alias("rest_after"), e(f"(offset (ptr-add {p} (size 5)))").alias("at"), e(f"(ptr-sub (ptr-add {p} (size 5)) (ptr-add {p} (size 2)))").alias("apart"), e(f"(offset (rewind (ptr-add {p} (size 5)) (size 3)))").alias("rewound"),
        e(f"(rem-size (ptr-of-ptr {p} (size 2) (size 6)))").alias("part_rest"), e(f"(string-of-bytes (get-item 0 (read-bytes (ptr-of-ptr {p} (size 2) (size 6)) (size 4))))").alias("part"), F.hex(e(whole("(rewind (write-bytes (ptr-of-buffer (size 5)) (get-item 0 (read-bytes (ptr-of-string s) (size 3)))) (size 3))"))).alias("copied"),
        F.hex(e(whole(f"(poke-u8 {p} (u8 120))"))).alias("poked"), F.hex(e(whole("(rewind (blit-byte (ptr-of-buffer (size 3)) (u8 42) (size 3)) (size 3))"))).alias("filled"), e(f"(get-bit {p} (size 10))").alias("bit"), F.hex(e(whole(f"(set-bit {p} (size 0) true)"))).alias("bit_set"),
        F.hex(e(whole(f"(set-bit {p} (size 0) false)"))).alias("bit_cleared"), e(text("(u64-of-address (address-of-u64 (to-u64 k)))")).alias("address"),
    )


SMALL = {k: (1 << (n - (k in SIGNED) - 1)) if n < 128 else 10**30 for k, n in INTEGERS.items()}


@query("SELECT r_regionkey, " + ", ".join(f"CAST(CAST({v - 5} AS HUGEINT) + r_regionkey AS VARCHAR) AS {k}, CAST({len(str(v - 5))} AS BIGINT) AS {k}_end" for k, v in SMALL.items() if len(str(v - 5)) == len(str(v - 1))) + ", CAST(r_regionkey + 0.25 AS DOUBLE) AS f, CAST(5 AS BIGINT) AS f_end, substr(r_name, 1, 1) AS c FROM region")
def q_spelled_at_cursors(spark, sf):
    """u8-of-ptr to i128-of-ptr, float-of-ptr and char-of-ptr: the number at a cursor, and where it ends."""
    regions = table(spark, sf, "region")
    number = lambda v: F.concat((F.lit(str(v - 5)).cast("decimal(38,0)") + F.col("r_regionkey")).cast("decimal(38,0)").cast("string"), F.lit(";9"))
    out = []
    for k, v in SMALL.items():
        got = lambda t, v=v: ev(t, s=(number(v), "string"))
        out += [got(text(f"(get-item 0 ({k}-of-ptr (ptr-of-string s)))")).alias(k), got(f"(offset (get-item 1 ({k}-of-ptr (ptr-of-string s))))").alias(f"{k}_end")]
    f = F.concat(F.lit(" "), F.col("r_regionkey").cast("string"), F.lit(".25,"))
    return regions.select("r_regionkey", *out, ev("(get-item 0 (float-of-ptr (ptr-of-string s)))", s=(f, "string")).alias("f"), ev("(offset (get-item 1 (float-of-ptr (ptr-of-string s))))", s=(f, "string")).alias("f_end"), ev("(string-of-char (get-item 0 (char-of-ptr (ptr-of-string s))))", s=("r_name", "string")).alias("c"))


@query("SELECT o_orderkey, o_custkey AS inner_kept, o_orderstatus AS copied, CAST(NULL AS VARCHAR) AS nulled FROM orders")
def q_mask_values(spark, sf):
    e = lambda t: ev(t, k=("o_orderkey", "i64"), c=("o_custkey", "i64"), s=("o_orderstatus", "string"), p=("o_orderpriority", "string?"))
    return table(spark, sf, "orders").select("o_orderkey", e('(apply-mask (mask-get 1 (mask "(X(_X))")) (make-tup k c))').alias("inner_kept"), e("(apply-mask copy-field s)").alias("copied"), e("(apply-mask (mask-get 3 set-field-null) p)").alias("nulled"))


@query("""
SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 1 ELSE pow(2, ceil(log2(n_nationkey + 1))) END AS BIGINT) AS next_power, n_nationkey AS checked, length(n_name) * 1 AS letters FROM nation""")
def q_loops(spark, sf):
    e = lambda t: ev(t, n=("n_nationkey", "i32"), s=("n_name", "string"))
    power = '(fst (while 9 (make-tup (i64 1) (to-i64 n)) (fun ("(i64; i64)") (ge (snd (param 0)) (fst (param 0)))) (fun ("(i64; i64)") (make-tup (mul (fst (param 0)) (i64 2)) (snd (param 0))))))'
    return table(spark, sf, "nation").select(
        "n_nationkey", e(power).alias("next_power"), e('(seq (for-each "x" (make-vec n (add n (i32 1))) (assert (ge x n))) n)').alias("checked"), e('(seq (for-each "c" s (assert (ge c (char " ")))) (to-i64 (string-length s)))').alias("letters"),
    )


@query("""
SELECT n_nationkey, 'ab' || repeat('-', n_nationkey % 4) AS repeated, CASE WHEN n_nationkey > 20 THEN 'high' WHEN n_nationkey > 10 THEN 'mid' ELSE 'low' END AS cased, n_name = '' AS is_empty, lower(to_hex(n_nationkey % 16)) AS digit, CAST(n_nationkey % 16 AS SMALLINT) AS of_digit, contains('AEIOU', substr(n_name, 1, 1)) AS vowel,
 n_regionkey = 2 AS in_itself, false AS in_nothing, '20010DB80000000000000000000000' || lpad(upper(to_hex(n_nationkey - n_nationkey % 16)), 2, '0') AS low6, '20010DB80000000000000000000000' || lpad(upper(to_hex(n_nationkey - n_nationkey % 16 + 15)), 2, '0') AS high6, n_nationkey < 16 AS inside6, n_nationkey < 8 AS inside_any FROM nation""")
def q_library(spark, sf):
    nations = table(spark, sf, "nation").withColumn("ip6", F.unhex(F.concat(F.lit("20010DB80000000000000000000000"), F.lpad(F.hex("n_nationkey"), 2, "0")))).withColumn("ip4", (F.lit(0x0A000000) + F.col("n_nationkey")).cast("long"))
    e = lambda t: ev(t, n=("n_nationkey", "i32"), r=("n_regionkey", "i32"), s=("n_name", "string"), ip6=("ip6", "u128"), ip4=("ip4", "u32"))
    net = F.struct(F.col("ip6").alias("ip"), F.lit(124).cast("short").alias("mask"))
    base = 0x20010DB8 << 96
    cased = library.cases((F.col("n_nationkey") > 20, F.lit("high")), (F.col("n_nationkey") > 10, F.lit("mid")), otherwise=F.lit("low"))
    return nations.select(
        "n_nationkey", library.repeat(0, F.col("n_nationkey") % 4, F.lit("ab"), lambda a, i: F.concat(a, F.lit("-"))).alias("repeated"), cased.alias("cased"), e("(is-empty s)").alias("is_empty"), library.hex_digit(F.col("n_nationkey") % 16).alias("digit"), library.of_hex_digit(library.hex_digit(F.col("n_nationkey") % 16)).alias("of_digit"),
        e('(is-in (force (nth (u8 0) s)) "AEIOU")').alias("vowel"), e("(is-in r (i32 2))").alias("in_itself"), e('(is-in r (make-arr "i32"))').alias("in_nothing"), F.hex(library.first_ip6(net)).alias("low6"), F.hex(library.last_ip6(net)).alias("high6"), e(f'(is-in ip6 (make-usr "Cidr6" (u128 {base}) (u8 124)))').alias("inside6"),
        e('(is-in ip4 (make-usr "Cidr" (make-usr "Cidr4" (u32 167772160) (u8 29))))').alias("inside_any"),
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_returnflag <> 'N'")
def q_where(spark, sf):
    t = "{l_quantity: float; l_discount: float; l_returnflag: string}"
    f = f'(fun ("{t}") (and (gt (get-field "l_quantity" (param 0)) (float 30.0)) (le (get-field "l_discount" (param 0)) (float 0.05)) (ne (get-field "l_returnflag" (param 0)) "N")))'
    return rows.where(table(spark, sf, "lineitem"), parse(t), f).select("l_orderkey", "l_linenumber")


@query("""
WITH c AS (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS ip FROM customer), nets AS (SELECT DISTINCT (s_suppkey * 40503 * 65536) % 4294967296 AS a, 12 + s_suppkey % 15 AS m FROM supplier),
r AS (SELECT DISTINCT a - a % CAST(pow(2, 32 - m) AS BIGINT) AS lo, a - a % CAST(pow(2, 32 - m) AS BIGINT) + CAST(pow(2, 32 - m) AS BIGINT) - 1 AS hi FROM nets)
SELECT c_custkey FROM c WHERE EXISTS (SELECT 1 FROM r WHERE ip BETWEEN lo AND hi)""")
def q_is_in_nets(spark, sf):
    """Addresses in a table of networks: a range join."""
    customers = table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") * 2654435761) % 4294967296).alias("ip"))
    nets = table(spark, sf, "supplier").select(F.struct(((F.col("s_suppkey") * 40503 * 65536) % 4294967296).alias("ip"), (F.lit(12) + F.col("s_suppkey") % 15).cast("int").alias("mask")).alias("net"))
    return accumulators.members_of_nets(customers, "ip", nets, "net").select("c_custkey")


@query("""
WITH e AS (SELECT event_type, user_id % 10 AS item, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS later FROM events), w AS (SELECT event_type, item, sum(pow(0.5, later)) AS w FROM e GROUP BY ALL)
SELECT event_type, list(item ORDER BY k) AS value FROM (SELECT event_type, item, row_number() OVER (PARTITION BY event_type ORDER BY w DESC, item) AS k FROM w) WHERE k <= 3 GROUP BY event_type""")
def q_top_scaled(spark, sf):
    """Each new row halves the weights before it."""
    events = table(spark, sf, "events").select("event_type", "event_id", (F.col("user_id") % 10).alias("value"))
    update = '(fun ("i64{top}" "i64") (seq (scale-weights (param 0) (float 0.5)) (insert-weighted (param 0) (float 1.0) (param 1))))'
    return aggregate(events, parse("i64"), '(top "i64" (u8 3) (u8 99))', update, '(fun ("i64{top}") (arr-of-set (param 0)))', ["event_type"], order="event_id")[0]


@query("SELECT event_id, list(event_id) OVER (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS items FROM events")
def q_win_running_all(spark, sf):
    return accumulators.running(table(spark, sf, "events").select("event_id", "ts"), [], ["ts", "event_id"], 5, "event_id").select("event_id", "items")


@query("SELECT list(l_orderkey ORDER BY l_orderkey) AS items FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS k FROM lineitem) WHERE k > 3 AND k <= 20")
def q_heap_all(spark, sf):
    return accumulators.heap(table(spark, sf, "lineitem"), [], "l_orderkey", 3, 17)


@query("SELECT user_id, list(event_id ORDER BY event_id) AS value FROM events GROUP BY user_id")
def q_set_in_order(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.col("event_id").alias("value"))
    return aggregate(events, parse("i64"), '(empty-set "i64")', '(fun ("i64{}" "i64") (insert (param 0) (param 1)))', '(fun ("i64{}") (arr-of-set (param 0)))', ["user_id"], order="value")[0]


NATION = "{n_nationkey: i32; n_name: string; n_regionkey: u8}"


def _wire(name: str, **options):
    """The bytes of each nation in an encoding, as hexadecimal text."""

    def run(spark, sf):
        m = parse(NATION)
        nations = table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("short").alias("n_regionkey"))
        return nations.select("n_nationkey", F.hex(encode_column(packed(nations, m), codec(name, m, **options))).alias("bytes"))

    return run


def _little(x: str, n: int) -> str:
    return " || ".join(f"lpad(upper(to_hex(({x} // {1 << 8 * k}) % 256)), 2, '0')" for k in range(n))


NAME = "hex(encode(n_name))"
SIZE = "octet_length(encode(n_name))"

#: The bytes of a nation in each encoding, in SQL.
WIRES = {
    "s_expr": "hex(encode('(' || n_nationkey || ' \"' || n_name || '\" ' || n_regionkey || ')'))",
    "json": "hex(encode('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}'))",
    "csv": "hex(encode(n_nationkey || ',\"' || n_name || '\",' || n_regionkey))",
    "row_binary": f"{_little('n_nationkey', 4)} || {_little(SIZE, 1)} || {NAME} || {_little('n_regionkey', 1)}",
    "ringbuf": f"'01000000' || {_little('n_nationkey', 4)} || {_little(SIZE, 4)} || {NAME} || repeat('00', CAST((4 - {SIZE} % 4) % 4 AS INTEGER)) || {_little('n_regionkey', 4)}",
}
for _name, _sql in WIRES.items():
    _run = _wire(_name.replace("_", "-"))
    _run.__name__ = f"q_wire_{_name}"
    query(f"SELECT n_nationkey, {_sql} AS bytes FROM nation")(_run)


@query("SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ']' AS as_json, '(' || n_nationkey || ' ' || n_regionkey || ')' AS as_s_expr, n_nationkey || '|' || n_regionkey AS as_csv, '2 (' || n_nationkey || ' ' || n_regionkey || ')' AS counted, CASE WHEN n_regionkey = 0 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END AS nullable FROM nation")
def q_wire_texts(spark, sf):
    """Containers, options and NULL in text encodings."""
    text_of = lambda c, name, t, **o: F.decode(encode_column(c, codec(name, t, **o)), "utf-8")
    pair, both = F.struct(F.col("n_nationkey").alias("_1"), F.col("n_regionkey").alias("_2")), F.array("n_nationkey", "n_regionkey")
    return table(spark, sf, "nation").select(
        "n_nationkey", text_of(pair, "json", "(i32; i32)").alias("as_json"), text_of(both, "s-expr", "i32[2]").alias("as_s_expr"), text_of(pair, "csv", "(i32; i32)", sep="|").alias("as_csv"), text_of(both, "s-expr", "i32[]").alias("counted"), text_of(F.nullif("n_regionkey", F.lit(0)), "s-expr", "i32?").alias("nullable"),
    )


@query("SELECT n_nationkey, true AS float_in, true AS u8_in, true AS u32_in, true AS u64_in, CAST(16 AS INTEGER) AS u128_bytes, true AS later, true AS stable, true AS told_apart FROM nation")
def q_random_ranges(spark, sf):
    """What random numbers, the time and hashes keep to, whatever they are."""
    e = lambda t: ev(t, k=("n_nationkey", "i32"))
    nations = table(spark, sf, "nation")
    drawn = nations.select("n_nationkey", e("(random-float)").alias("f"), e("(random-u8)").alias("a"), e("(random-u32)").alias("b"), e("(random-u64)").alias("c"), e("(random-u128)").alias("d"), e("(now)").alias("t"), e("(hash k)").alias("h"), e("(hash k)").alias("h2"), e("(hash (add k (i32 1)))").alias("other"))
    return drawn.select(
        "n_nationkey", F.expr("f >= 0 and f < 1").alias("float_in"), F.expr("a between 0 and 255").alias("u8_in"), F.expr("b between 0 and 4294967295").alias("u32_in"), F.expr("c between 0 and 18446744073709551615").alias("u64_in"), F.octet_length("d").alias("u128_bytes"), F.expr("t > 1700000000").alias("later"),
        F.expr("h = h2").alias("stable"), F.expr("h <> other").alias("told_apart"),
    )


@query("""
SELECT n_nationkey, n_nationkey AS same, CAST(n_nationkey AS BIGINT) AS number, n_name <> '' AS truth, '0x1p+' || n_nationkey AS hexed, CAST(ascii(n_name) AS SMALLINT) AS code, chr(CAST(65 + n_nationkey % 26 AS INTEGER)) AS letter, substr(n_name, 1, 1) AS first, CASE WHEN n_regionkey > 1 THEN 1 ELSE 0 END AS of_bool, [n_nationkey] AS alone,
 substr(n_name, 1, 2) AS letters, CASE WHEN n_regionkey > 1 THEN 'true' ELSE 'false' END AS bool_text, '10.0.0.' || n_nationkey AS ip, '10.0.0.' || n_nationkey || '/24' AS cidr, [CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT)] AS items, CAST(n_nationkey AS BIGINT) AS left_part, CAST(n_regionkey AS DOUBLE) AS right_part,
 [n_nationkey, n_regionkey] AS of_tuple, CAST(n_nationkey AS BIGINT) AS by_name, CASE WHEN n_regionkey = 0 THEN 'NULL' ELSE CAST(n_regionkey AS VARCHAR) END AS null_text, n_regionkey AS forced, CAST(n_nationkey AS DOUBLE) AS user_type FROM nation""")
def q_convert_more(spark, sf):
    nations = table(spark, sf, "nation").withColumn("ip", (F.lit(0x0A000000) + F.col("n_nationkey")).cast("long"))
    e = lambda t: ev(t, n=("n_nationkey", "i32"), r=("n_regionkey", "i32"), s=("n_name", "string"), ip=("ip", "u32"), z=(F.nullif("n_regionkey", F.lit(0)), "i32?"), some=("n_regionkey", "i32?"))
    two, chars = "(unsafe-pow (float 2.0) (to-float n))", "(make-vec (force (nth (u8 0) s)) (force (nth (u8 1) s)))"
    pair = '(convert "(i64; float)" (make-tup n r))'
    return nations.select(
        "n_nationkey", e('(convert "i32" n)').alias("same"), e('(force (convert "i64?" (string-of-int n)))').alias("number"), e('(convert "bool" s)').alias("truth"), e(f'(convert "string" {two})').alias("hexed"), e('(convert "u8" (force (nth (u8 0) s)))').alias("code"), e('(convert "char" (add (u8 65) (to-u8 (unsafe-rem n (i32 26)))))').alias("letter"),
        e('(force (convert "char?" s))').alias("first"), e('(convert "i32" (gt r (i32 1)))').alias("of_bool"), e('(convert "i32[1]" n)').alias("alone"), e(f'(convert "string" {chars})').alias("letters"), e('(convert "string" (gt r (i32 1)))').alias("bool_text"), e('(convert "string" (make-usr "Ip4" ip))').alias("ip"),
        e('(convert "string" (make-usr "Cidr4" ip (u8 24)))').alias("cidr"), e('(convert "i64[]" (make-vec n r))').alias("items"), e(f"(fst {pair})").alias("left_part"), e(f"(snd {pair})").alias("right_part"), e('(convert "i32[2]" (make-tup n r))').alias("of_tuple"), e('(get-field "b" (convert "{b: i64; a: string}" (make-rec a s b n)))').alias("by_name"),
        e('(convert "string" z)').alias("null_text"), e('(convert "i32" some)').alias("forced"), e('(convert "Date" (to-float n))').alias("user_type"),
    )
