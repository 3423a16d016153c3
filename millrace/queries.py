"""Queries over the test tables through the engine's operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import library
from .operators import accumulators, keyvalue, masks
from .operators.aggregate import aggregate
from .operators.convert import transform
from .plans.compile import evaluate, typed
from .plans.types import Maybe, parse, to_schema
from .sources import codec, decode_column, encode_column
from .sources.base import packed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ev(text: str, **names: tuple[str | Column, str]) -> Column:
    """An expression over named, typed columns."""
    return evaluate(text, **{n: typed(c, t) for n, (c, t) in names.items()})


LINE = {"price": ("l_extendedprice", "float"), "disc": ("l_discount", "float"), "qty": ("l_quantity", "float"), "key": ("l_orderkey", "i64"), "part": ("l_partkey", "i64"), "supp": ("l_suppkey", "i64"), "line": ("l_linenumber", "i32")}


@query("""
WITH s AS (SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, min(l_extendedprice) AS low, max(l_extendedprice) AS high, list_sort(list(l_quantity)) AS xs FROM lineitem GROUP BY l_returnflag),
r AS (SELECT l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(CAST(round(l_quantity) AS BIGINT)) DESC, l_suppkey) AS k FROM lineitem GROUP BY l_returnflag, l_suppkey)
SELECT s.l_returnflag, n AS n_lines, CAST(q AS DOUBLE) AS sum_qty, low, high, xs[CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT) + 1] AS p50, xs[CAST(floor(0.9 * (n - 1) + 0.5) AS BIGINT) + 1] AS p90, r.l_suppkey AS top_supplier
FROM s JOIN r ON s.l_returnflag = r.l_returnflag AND r.k = 1""")
def q_flagship(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    stats = line.groupBy("l_returnflag").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    ps = library.grouped_percentiles(line, ["l_returnflag"], "l_quantity", [50, 90]).withColumnsRenamed({"p_50": "p50", "p_90": "p90"})
    best = accumulators.top(line, ["l_returnflag"], "l_suppkey", F.round("l_quantity").cast("long"), 1).select("l_returnflag", F.col("l_suppkey").alias("top_supplier"))
    return stats.join(ps, "l_returnflag").join(best, "l_returnflag")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return q_flagship(spark, sf)


@query("""
SELECT l_orderkey, l_linenumber, CAST((l_partkey % 256 + 200) % 256 AS SMALLINT) AS u8_add, CAST(((l_linenumber - 5) % 256 + 256) % 256 AS SMALLINT) AS u8_sub,
 CAST((((l_partkey * 7919) % 65536 + 65536 + 32768) % 65536) - 32768 AS SMALLINT) AS i16_mul,
 CAST((CAST(l_orderkey AS HUGEINT) * 4000000007) % 4294967296 AS BIGINT) AS u32_mul,
 CAST(((CAST(l_orderkey AS HUGEINT) * 1234567890123456789 + 9223372036854775808) % 18446744073709551616) - 9223372036854775808 AS BIGINT) AS i64_mul,
 CAST((18446744073709551615 - CAST(l_orderkey AS HUGEINT)) AS VARCHAR) AS u64_sub, CAST(-l_linenumber AS INTEGER) AS i32_neg, CAST((256 - l_linenumber) % 256 AS SMALLINT) AS u8_neg
FROM lineitem""")
def q_arith_wrap(spark, sf):
    e = lambda t: ev(t, **LINE)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", e("(add (to-u8 part) (u8 200))").alias("u8_add"), e("(sub (to-u8 line) (u8 5))").alias("u8_sub"), e("(mul (to-i16 part) (to-i16 (i32 7919)))").alias("i16_mul"), e("(mul (to-u32 key) (u32 4000000007))").alias("u32_mul"),
        e("(mul key (i64 1234567890123456789))").alias("i64_mul"), e("(string-of-int (sub (u64 18446744073709551615) (to-u64 key)))").alias("u64_sub"), e("(neg line)").alias("i32_neg"), e("(neg (to-u8 line))").alias("u8_neg"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_orderkey // (l_linenumber - 3) END AS DOUBLE) AS i_div, CAST(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_orderkey % (l_linenumber - 3) END AS DOUBLE) AS i_rem,
 CASE WHEN l_discount = 0 THEN 'Infinity' ELSE CAST(round(l_extendedprice / l_discount, 4) AS VARCHAR) END = 'Infinity' AS is_inf,
 CASE WHEN l_discount - 0.05 < 0 THEN NULL ELSE round(sqrt(l_discount - 0.05), 6) END AS root, CASE WHEN l_discount = 0 THEN true ELSE false END AS log_is_low, l_linenumber * l_linenumber * l_linenumber AS cube
FROM lineitem""")
def q_arith_partial(spark, sf):
    e = lambda t: ev(t, **LINE)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", e("(div key (sub (to-i64 line) (i64 3)))").cast("double").alias("i_div"), e("(rem key (sub (to-i64 line) (i64 3)))").cast("double").alias("i_rem"), e("(eq (div price disc) (not-null (float inf)))").alias("is_inf"),
        F.round(e("(sqrt (sub disc (float 0.05)))"), 6).alias("root"), e("(eq (log disc) (not-null (float -inf)))").alias("log_is_low"), e("(force (pow line (i32 3)))").alias("cube"),
    )


@query("""
WITH e AS (SELECT event_id, nullif(user_id % 7, 0) AS a, nullif(event_id % 5, 0) AS b FROM events)
SELECT event_id, CASE WHEN b IS NULL THEN a IS NOT NULL WHEN a IS NULL THEN false ELSE a > b END AS gt, CASE WHEN b IS NULL THEN true WHEN a IS NULL THEN false ELSE a >= b END AS ge, a IS NOT DISTINCT FROM b AS eq,
 CAST(CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b) END AS DOUBLE) AS low, CAST(greatest(a, b) AS DOUBLE) AS high FROM e""")
def q_compare_null(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.nullif(F.col("user_id") % 7, F.lit(0)).alias("a"), F.nullif(F.col("event_id") % 5, F.lit(0)).alias("b"))
    e = lambda op: ev(f"({op} a b)", a=("a", "i64?"), b=("b", "i64?"))
    return rows.select("event_id", e("gt").alias("gt"), e("ge").alias("ge"), e("eq").alias("eq"), e("min").cast("double").alias("low"), e("max").cast("double").alias("high"))


@query("""
SELECT o_orderkey, CAST((o_orderkey & 255) & (o_custkey & 255) AS SMALLINT) AS b_and, CAST((o_orderkey & 255) | (o_custkey & 255) AS SMALLINT) AS b_or, CAST(xor(o_orderkey & 255, o_custkey & 255) AS SMALLINT) AS b_xor, CAST(255 - (o_orderkey & 255) AS SMALLINT) AS b_not,
 CAST(((o_orderkey & 255) * 8) % 256 AS SMALLINT) AS b_shl, CAST((o_orderkey & 255) // 4 AS SMALLINT) AS b_shr, CAST(((4294967296 - o_orderkey) % 4294967296) // 16 AS BIGINT) AS neg_shr FROM orders""")
def q_bits(spark, sf):
    e = lambda t: ev(t, k=("o_orderkey", "i64"), c=("o_custkey", "i64"))
    return table(spark, sf, "orders").select(
        "o_orderkey", e("(bit-and (to-u8 k) (to-u8 c))").alias("b_and"), e("(bit-or (to-u8 k) (to-u8 c))").alias("b_or"), e("(bit-xor (to-u8 k) (to-u8 c))").alias("b_xor"), e("(bit-not (to-u8 k))").alias("b_not"),
        e("(left-shift (to-u8 k) (u8 3))").alias("b_shl"), e("(right-shift (to-u8 k) (u8 2))").alias("b_shr"), e("(to-i64 (right-shift (to-u32 (neg (to-i32 k))) (u8 4)))").alias("neg_shr"),
    )


@query("""
SELECT l_orderkey, l_linenumber, ceil(l_extendedprice) AS up, floor(l_extendedprice) AS down, CASE WHEN l_discount < 0 THEN -floor(abs(l_extendedprice) + 0.5) ELSE floor(l_extendedprice + 0.5) END AS near,
 round(exp(l_discount), 8) AS e, round(sin(l_quantity), 8) AS s, round(cos(l_quantity), 8) AS c, round(atan(l_quantity), 8) AS at, round(acos(l_discount), 8) AS ac, round(sinh(l_discount), 8) AS sh, abs(l_discount - 0.05) > 0.02 AS far FROM lineitem""")
def q_math(spark, sf):
    e = lambda t: ev(t, **LINE)
    r = lambda t: F.round(e(t), 8)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", e("(ceil price)").alias("up"), e("(floor price)").alias("down"), e("(round price)").alias("near"), r("(exp disc)").alias("e"), r("(sin qty)").alias("s"), r("(cos qty)").alias("c"), r("(atan qty)").alias("at"),
        r("(force (acos disc))").alias("ac"), r("(sinh disc)").alias("sh"), e("(gt (abs (sub disc (float 0.05))) (float 0.02))").alias("far"),
    )


@query("""
SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS high, CAST(octet_length(encode(p_name)) AS BIGINT) AS n, substr(p_name, 3, 4) AS mid, right(p_name, 2) AS tail, starts_with(p_type, 'S') AS s, ends_with(p_type, 'L') AS t,
 CASE WHEN instr(p_name, 'r') = 0 THEN NULL ELSE CAST(instr(p_name, 'r') - 1 AS DOUBLE) END AS first_r, array_to_string(string_split(p_type, ' '), '-') AS joined, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS parts, p_brand || '/' || p_name AS both_names FROM part""")
def q_string(spark, sf):
    e = lambda t: ev(t, n=("p_name", "string"), t=("p_type", "string"), b=("p_brand", "string"))
    return table(spark, sf, "part").select(
        "p_partkey", e("(lower n)").alias("low"), e("(upper n)").alias("high"), e("(string-length n)").alias("n"), e("(substring n (u8 2) (u8 6))").alias("mid"), e('(substring n (i8 -2) (string-length n))').alias("tail"), e('(starts-with t "S")').alias("s"), e('(ends-with t "L")').alias("t"),
        e('(find-substring true "r" n)').cast("double").alias("first_r"), e('(join "-" (split-on " " t))').alias("joined"), e('(cardinality (split-on " " t))').alias("parts"), e('(append-string (append-string b "/") n)').alias("both_names"),
    )


@query("""
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up,
 CASE WHEN instr(text, 'é') = 0 THEN NULL ELSE CAST(octet_length(encode(substr(text, 1, instr(text, 'é') - 1))) AS DOUBLE) END AS at, CAST(len(string_split(text, '.')) AS BIGINT) AS parts FROM documents""")
def q_string_bytes(spark, sf):
    e = lambda t: ev(t, t=("text", "string"), s=("source", "string"))
    return table(spark, sf, "documents").select("doc_id", e("(string-length t)").alias("n_bytes"), e("(upper s)").alias("up"), e('(find-substring true "é" t)').cast("double").alias("at"), e('(cardinality (split-on "." t))').alias("parts"))


@query("""
WITH p AS (SELECT p_partkey, p_name || '' AS n, CAST(p_size * 37 AS VARCHAR) AS s, CAST(p_partkey % 400 AS VARCHAR) AS k FROM part)
SELECT p_partkey, TRY_CAST(s AS INTEGER) AS i, CASE WHEN CAST(k AS INTEGER) <= 255 THEN CAST(k AS DOUBLE) END AS u8, CAST(NULL AS DOUBLE) AS bad, CAST(s AS DOUBLE) AS f, s || '!' AS t FROM p""")
def q_string_parse(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_size") * 37).alias("s"), (F.col("p_partkey") % 400).alias("k"))
    e = lambda t: ev(t, n=("p_name", "string"), s=("s", "i32"), k=("k", "i64"))
    return rows.select("p_partkey", e("(i32-of-string (string-of-int s))").alias("i"), e("(u8-of-string (string-of-int k))").cast("double").alias("u8"), e('(float-of-string (append-string "x" n))').alias("bad"), e("(float-of-string (string-of-int s))").alias("f"), e('(append-string (string-of-int s) "!")').alias("t"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CAST(dayofyear(ts) - 1 AS VARCHAR) || ' ' || CAST(dayofweek(ts) + 1 AS VARCHAR) || ' ' || strftime(ts, '%a %b') || ' ' || lpad(CAST(hour(ts) % 12 AS VARCHAR), 2, '0') || CASE WHEN hour(ts) < 12 THEN 'a.m.' ELSE 'p.m.' END AS t FROM events""")
def q_strftime(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return rows.select("event_id", ev('(strftime "%Y-%m-%d %H:%M:%S %j %u %a %b %I%p" s)', s=("s", "float")).alias("t"))


@query("SELECT c_custkey, c_name AS a, c_acctbal + 1 AS b, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS label, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS DOUBLE) END AS x, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS y FROM customer")
def q_struct(spark, sf):
    e = lambda t: ev(t, k=("c_custkey", "i64"), n=("c_name", "string"), bal=("c_acctbal", "float"), nat=("c_nationkey", "i32"), seg=("c_mktsegment", "string"))
    rec = "(copy-rec (make-rec a n b bal) b (add bal (float 1.0)))"
    alt = '(if (eq (rem k (i64 2)) (not-null (i64 0))) (construct "[x i32 | y string]" 0 nat) (construct "[x i32 | y string]" 1 seg))'
    return table(spark, sf, "customer").select("c_custkey", e(f'(get-field "a" {rec})').alias("a"), e(f'(get-field "b" {rec})').alias("b"), e(f"(label-of {alt})").alias("label"), e(f'(get-alt "x" {alt})').cast("double").alias("x"), e(f'(get-alt "y" {alt})').alias("y"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS e FROM embeddings)
SELECT vec_id, CAST(len(e) AS BIGINT) AS n, e[1] AS first_item, e[len(e) + 1] AS beyond, list_min(e) AS low, list_sort(e)[3] AS third, CAST(list_sum(list_transform(e[2:], lambda x: x + 1)) AS BIGINT) AS total, list_contains(e, 0) AS has_zero, e[1:len(e)-60] AS cut FROM v""")
def q_array(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int")).alias("e"))
    e = lambda t: ev(t, e=("e", "i32[]"))
    return rows.select(
        "vec_id", e("(cardinality e)").alias("n"), e("(nth (u8 0) e)").alias("first_item"), e("(nth (cardinality e) e)").alias("beyond"), e("(get-min e)").alias("low"), e("(nth (u8 2) (partial-sort e (make-vec (u32 2))))").alias("third"),
        e('(fold (i64 0) (fun ("i64" "i32") (add (param 0) (to-i64 (param 1)))) (map (i32 1) (fun ("i32" "i32") (add (param 0) (param 1))) (chop-begin e (u8 1))))').alias("total"), e("(member (i32 0) e)").alias("has_zero"), e("(chop-end e (u8 60))").alias("cut"),
    )


@query("""
SELECT n_nationkey, contains(n_name, 'AN') AS sub, n_regionkey IN (1, 3) AS listed, n_nationkey % 256 BETWEEN 0 AND 15 AS in_range FROM nation""")
def q_is_in(spark, sf):
    rows = table(spark, sf, "nation").withColumn("ip", (F.lit(0x0A000000) + F.col("n_nationkey")).cast("long"))
    e = lambda t: ev(t, n=("n_name", "string"), r=("n_regionkey", "i32"), ip=("ip", "u32"))
    return rows.select("n_nationkey", e('(is-in "AN" n)').alias("sub"), e('(is-in r (make-arr "i32" (i32 1) (i32 3)))').alias("listed"), e('(is-in ip (make-usr "Cidr4" (u32 0x0A000000) (u8 28)))').alias("in_range"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_is_in_table(spark, sf):
    building = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return accumulators.members(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", building, "c_custkey")


ORDER = "{o_orderkey: i64; o_custkey: i64; o_orderstatus: string; o_totalprice: float; o_orderdate: float; o_orderpriority: string?}"


def _orders(spark, sf) -> tuple[DataFrame, Maybe]:
    rows = table(spark, sf, "orders").withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)
    return rows, parse(ORDER)


@query("SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders")
def q_mask_project(spark, sf):
    return masks.select(*_orders(spark, sf), "(X__X_N)")[0]


@query("SELECT o_orderkey + 1 AS o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice * 2 AS o_totalprice, epoch_us(o_orderdate) / 1e6 AS o_orderdate, o_orderpriority FROM orders")
def q_transform(spark, sf):
    return transform(*_orders(spark, sf), {"/o_orderkey": '(fun ("i64") (add (param 0) (i64 1)))', "/2": '(fun ("string") (lower (param 0)))', "/o_totalprice": '(fun ("float") (mul (param 0) (float 2.0)))'})[0]


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS t, l_linenumber % 256 <> 0 AS b, CAST(l_quantity AS INTEGER) AS i, CAST(l_linenumber AS DOUBLE) AS f, '[' || l_linenumber || ';' || l_suppkey || ']' AS list, '(' || l_partkey || ';true)' AS pair FROM lineitem""")
def q_convert(spark, sf):
    e = lambda t: ev(t, **LINE)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", e('(convert "string" part)').alias("t"), e('(convert "bool" line)').alias("b"), e('(convert "i32" qty)').alias("i"), e('(convert "float" line)').alias("f"), e('(convert "string" (make-vec (to-i64 line) supp))').alias("list"), e('(convert "string" (make-tup part true))').alias("pair"),
    )


@query("SELECT l_returnflag, l_linestatus, CAST(((sum(CAST(l_partkey AS HUGEINT)) + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS value FROM lineitem GROUP BY 1, 2")
def q_agg_sum(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_partkey").cast("int").alias("value"))
    update = '(fun ("i32[1]" "i32") (set-vec (u8 0) (param 0) (add (unsafe-nth (u8 0) (param 0)) (param 1))))'
    return aggregate(rows, parse("i32"), "(make-vec (i32 0))", update, '(fun ("i32[1]") (unsafe-nth (u8 0) (param 0)))', ["l_returnflag", "l_linestatus"])[0]


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(min(l_orderkey) AS BIGINT) AS low, CAST(max(l_orderkey) AS BIGINT) AS high FROM lineitem GROUP BY 1")
def q_agg_parts(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("value"))
    t = "(i64; i64; i64)"
    update = f'(fun ("{t}" "i64") (seq (copy-tup (param 0) 0 (add (get-item 0 (param 0)) (i64 1))) (copy-tup (param 0) 1 (min (get-item 1 (param 0)) (param 1))) (copy-tup (param 0) 2 (max (get-item 2 (param 0)) (param 1)))))'
    got, _ = aggregate(rows, parse("i64"), "(make-tup (i64 0) (i64 9223372036854775807) (i64 0))", update, f'(fun ("{t}") (param 0))', ["l_returnflag"])
    return got.select("l_returnflag", F.col("value._1").alias("n"), F.col("value._2").alias("low"), F.col("value._3").alias("high"))


@query("SELECT user_id, list_reduce(list(event_id ORDER BY event_id), lambda a, x: (a * 31 + x) % 1000003, 0) AS value FROM events GROUP BY user_id")
def q_agg_fold(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("value"))
    step = '(set-vec (u8 0) (param 0) (unsafe-rem (add (mul (unsafe-nth (u8 0) (param 0)) (i64 31)) (param 1)) (i64 1000003)))'
    return aggregate(rows, parse("i64"), "(make-vec (i64 0))", f'(fun ("i64[1]" "i64") {step})', '(fun ("i64[1]") (unsafe-nth (u8 0) (param 0)))', ["user_id"], order="value")[0]


@query("SELECT l_suppkey, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM lineitem GROUP BY 1")
def q_agg_kahan(spark, sf):
    got = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(library.kahan_sum(F.array_sort(F.collect_list("l_extendedprice"))).alias("t"))
    return got.select("l_suppkey", F.round("t", 2).alias("total"))


@query("""
WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS x, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, x[CAST(floor(50 * 0.01 * (n - 1) + 0.5) AS BIGINT) + 1] AS p_50, x[CAST(floor(90 * 0.01 * (n - 1) + 0.5) AS BIGINT) + 1] AS p_90, x[CAST(floor(99 * 0.01 * (n - 1) + 0.5) AS BIGINT) + 1] AS p_99 FROM s""")
def q_percentiles(spark, sf):
    return library.grouped_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [50, 90, 99])


@query("SELECT user_id, list(event_id ORDER BY ts, event_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3 GROUP BY user_id")
def q_win_sliding(spark, sf):
    return accumulators.sliding_lists(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 3, "event_id")


@query("SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS items FROM events")
def q_win_running(spark, sf):
    return accumulators.running(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 3, "event_id").select("event_id", "items")


@query("SELECT b AS bucket, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 100) AS BIGINT) AS b FROM events) GROUP BY b")
def q_win_tumbling_count(spark, sf):
    rows = accumulators.tumbling(table(spark, sf, "events").select("event_id", "ts"), [], ["ts", "event_id"], 100)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts)) AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_win_tumbling_time(spark, sf):
    got = accumulators.tumbling_time(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "ts", "1 hour", F.count("*").alias("n"))
    return got.select((F.unix_micros("start") / 1e6).alias("start_s"), "event_type", "n")


@query("SELECT o_custkey, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS weight, CAST(row_number() OVER (ORDER BY sum(CAST(round(o_totalprice) AS BIGINT)) DESC, o_custkey) AS INTEGER) AS rank FROM orders GROUP BY 1 ORDER BY 3 LIMIT 10")
def q_top(spark, sf):
    return accumulators.top(table(spark, sf, "orders"), [], "o_custkey", F.round("o_totalprice").cast("long"), 10)


@query("SELECT l_returnflag, list(l_orderkey ORDER BY l_orderkey) AS items FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) AS k FROM lineitem) WHERE k > 2 AND k <= 12 GROUP BY 1")
def q_heap(spark, sf):
    return accumulators.heap(table(spark, sf, "lineitem"), ["l_returnflag"], "l_orderkey", 2, 10)


@query("SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS items FROM orders GROUP BY 1")
def q_hashset(spark, sf):
    return accumulators.hash_set(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority")


@query("SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey || '|' || l_linenumber || '|7') DESC) AS k FROM lineitem) WHERE k <= 100")
def q_sampling(spark, sf):
    return accumulators.sampling(table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_returnflag"], 100, 7, ["l_orderkey", "l_linenumber"])


CUSTOMER = "{c_custkey: i64; c_name: string; c_nationkey: i32; c_acctbal: float; c_mktsegment: string?}"


def _round_trip(name: str, **options):
    def run(spark, sf):
        m = parse(CUSTOMER)
        made = codec(name, m, **options)
        rows = spark.createDataFrame([], to_schema(m)).union(table(spark, sf, "customer").select(*[f.name for f in to_schema(m)]))
        return rows.select(decode_column(encode_column(packed(rows, m), made), made).alias("v")).select("v.*")

    return run


for _name in ("s-expr", "json", "csv", "row-binary", "ringbuf"):
    QUERIES[f"q_codec_{_name.replace('-', '_')}"] = _round_trip(_name)
    SQL[f"q_codec_{_name.replace('-', '_')}"] = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_kv_last_wins(spark, sf):
    return keyvalue.last_wins(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("""
WITH c AS (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS ip FROM customer)
SELECT c_custkey, (ip // 16777216) || '.' || ((ip // 65536) % 256) || '.' || ((ip // 256) % 256) || '.' || (ip % 256) AS t, ip - ip % 65536 AS low, ip - ip % 65536 + 65535 AS high, ip BETWEEN 2147483648 AND 3221225471 AS inside FROM c""")
def q_ip_cidr(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") * 2654435761) % 4294967296).alias("ip"))
    e = lambda t: ev(t, ip=("ip", "u32"))
    net = F.struct(F.col("ip"), F.lit(16).alias("mask"))
    return rows.select("c_custkey", e("(string-of-ip ip)").alias("t"), library.first_ip4(net).alias("low"), library.last_ip4(net).alias("high"), e('(is-in ip (make-usr "Cidr4" (u32 2147483648) (u8 2)))').alias("inside"))


@query("""
SELECT event_id, coalesce(nullif(user_id % 3, 0), nullif(event_id % 2, 0), 99) AS c, CAST(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 + 1 END AS DOUBLE) AS m FROM events""")
def q_coalesce(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.nullif(F.col("user_id") % 3, F.lit(0)).alias("a"), F.nullif(F.col("event_id") % 2, F.lit(0)).alias("b"))
    e = lambda t: ev(t, a=("a", "i64?"), b=("b", "i64?"))
    return rows.select("event_id", e("(coalesce a b (i64 99))").alias("c"), e('(null-map "x" a (add x (i64 1)))').cast("double").alias("m"))


@query("SELECT c_custkey, CAST(CAST(c_custkey AS HUGEINT) * 170141183460469231731687303715 AS VARCHAR) AS big, CAST(CAST(c_custkey AS HUGEINT) - 5000 AS VARCHAR) AS small FROM customer")
def q_wide_integers(spark, sf):
    e = lambda t: ev(t, k=("c_custkey", "i64"))
    return table(spark, sf, "customer").select("c_custkey", e("(string-of-int (mul (to-u128 k) (u128 170141183460469231731687303715)))").alias("big"), e("(string-of-int (sub (to-i128 k) (i128 5000)))").alias("small"))


@query()
def q_random(spark, sf):
    e = lambda t: ev(t, k=("n_nationkey", "i32"))
    return table(spark, sf, "nation").select("n_nationkey", e("(random-float)").alias("f"), e("(random-u8)").alias("u8"), e("(random-u64)").alias("u64"), e("(hash k)").alias("h"), e("(now)").alias("now"))


from . import operator_queries  # noqa: E402, F401  its queries join those above
