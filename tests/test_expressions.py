import math

import pytest

from millrace.functions import wide
from millrace.plans.compile import TypeProblem, compile_text, evaluate


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda text: one.select(evaluate(text).alias("x")).first()[0]


CASES = [
    ("(add (u8 250) (u8 10))", 4), ("(sub (u8 1) (u8 2))", 255), ("(mul (i8 100) (i8 3))", 44), ("(neg (u16 1))", 65535), ("(abs (i8 -128))", -128),
    ("(add (i64 9223372036854775807) (i64 1))", -(2**63)), ("(mul (i64 9223372036854775807) (i64 3))", 9223372036854775805), ("(mul (i64 -5) (i64 7))", -35),
    ("(div (i32 -7) (i32 2))", -3), ("(div (i64 -9223372036854775808) (i64 -1))", -(2**63)), ("(div (i32 7) (i32 0))", None), ("(rem (i32 -7) (i32 2))", -1),
    ("(div (float 1.0) (float 0.0))", math.inf), ("(div (float 0.0) (float 0.0))", None), ("(div (float 1.0) (float -0.0))", -math.inf), ("(rem (float 7.5) (float 2.0))", 1.5),
    ("(pow (i32 3) (i32 4))", 81), ("(pow (i32 3) (i32 -1))", None), ("(pow (float 2.0) (float 0.5))", math.sqrt(2)),
    ("(log (float 0.0))", -math.inf), ("(log (float -1.0))", None), ("(sqrt (float -1.0))", None), ("(round (float -2.5))", -3.0), ("(ceil (float 1e300))", 1e300), ("(floor (float -1.5))", -2.0),
    ("(bit-not (u8 5))", 250), ("(bit-not (i8 5))", -6), ("(left-shift (u8 129) (u8 1))", 2), ("(right-shift (i8 -8) (u8 1))", 124), ("(left-shift (i64 1) (u8 63))", -(2**63)), ("(bit-xor (u32 5) (u32 3))", 6),
    ("(to-u8 (i32 -1))", 255), ("(to-i8 (u16 200))", -56), ("(to-u8 (float -1.5))", 255), ("(to-float (u64 18446744073709551615))", 1.8446744073709552e19), ("(to-i24 (i32 8388608))", -8388608),
    ("(gt (null \"u8\") (not-null (u8 1)))", False), ("(ge (null \"u8\") (null \"u8\"))", True), ("(eq (null \"u8\") (null \"u8\"))", True), ("(gt (not-null (u8 0)) (null \"u8\"))", True), ("(min (null \"u8\") (not-null (u8 1)))", None), ("(max (null \"u8\") (not-null (u8 1)))", 1),
    ("(eq (float nan) (float nan))", False), ("(gt (cardinality (make-vec (char \"f\") (char \"o\") (char \"o\"))) (u32 2))", True),
    ('(float-of-string "POISON")', None), ('(float-of-string "0x1.8p1")', 3.0), ('(float-of-string "1d")', None), ('(u8-of-string "256")', None), ('(u8-of-string " 12")', None), ('(i8-of-string "-128")', -128), ('(u16-of-string "0x1F")', 31),
    ('(substring "hello" (u8 1) (u8 3))', "el"), ('(substring "hello" (i8 -3) (i8 -1))', "ll"), ('(substring "" (u8 0) (u8 5))', ""), ('(find-substring true "o" "foo boo")', 1), ('(find-substring false "o" "foo boo")', 6), ('(find-substring true "" "ab")', 0), ('(find-substring false "" "ab")', 2), ('(find-substring true "x" "ab")', None),
    ('(index (char "b") "aéb")', 3), ('(string-length "é")', 2), ('(lower "ÀB")', "Àb"), ('(split-on "." "a.b..c")', ["a", "b", "", "c"]), ('(split-on "" "abc")', []), ('(join "-" (make-arr "string" "a" "b"))', "a-b"), ('(starts-with "abc" "ab")', True), ('(nth (u8 9) "abc")', None),
    ("(nth (u8 1) (make-vec (u8 1) (u8 2)))", 2), ("(nth (u8 5) (make-vec (u8 1) (u8 2)))", None), ("(chop-begin (make-arr \"u8\" (u8 1) (u8 2)) (u8 9))", []), ("(head (end-of-list \"u8\"))", None), ("(tail (cons (u8 1) (end-of-list \"u8\")))", []), ("(set-vec (u8 1) (make-vec (u8 1) (u8 2)) (u8 9))", [1, 9]), ("(alloc-vec (u8 2) (u8 7))", [7, 7]), ("(member (u8 2) (make-vec (u8 1) (u8 2)))", True), ("(truncate 1 2 (make-vec (u8 1) (u8 2) (u8 3)))", [2, 3]),
    ("(map (u8 10) (fun (\"u8\" \"u8\") (add (param 0) (param 1))) (make-vec (u8 1) (u8 2)))", [11, 12]),
    ("(let \"x\" (u8 1) (add x x))", 2), ("(let-pair \"a\" \"b\" (make-tup (u8 1) (u8 2)) (add (add a b) (add a b)))", 6), ("((fun (\"u8\") (add (param 0) (u8 1))) (u8 4))", 5), ("(if true (u8 1) (u8 2))", 1),
    ("(null-map \"x\" (null \"u8\") (add x (u8 1)))", None), ("(coalesce (null \"u8\") (u8 49))", 49), ("(get-field \"b\" (make-rec a (u8 1) b \"x\"))", "x"), ("(get-field \"a\" (copy-rec (make-rec a (u8 1) b \"x\") a (u8 7)))", 7), ("(get-item 1 (copy-tup (make-tup (u8 1) (u8 2)) 1 \"z\"))", "z"),
    ("(label-of (construct \"[a u8 | b string]\" 1 \"q\"))", 1), ("(get-alt \"b\" (construct \"[a u8 | b string]\" 1 \"q\"))", "q"),
    ("(string-of-ip (u32 0x7B2D4359))", "123.45.67.89"), ("(string-of-ip (u128 0x20010DB8000000000000FF0000428329))", "2001:db8::ff00:42:8329"), ("(string-of-ip (u128 0x00010023045600000000000700000008))", "1:23:456::7:0:8"), ("(string-of-ip (u128 0x2001))", "::2001"),
    ("(string-of-float (float 0.5))", "0x1p-1"), ("(decimal-string-of-float (float 31536000.0))", "31536000"), ("(decimal-string-of-float (float 2972.98300573))", "2972.98300573"), ("(float-of-u64 (u64-of-float (float 1.25)))", 1.25),
    ("(string-of-int (add (u128 340282366920938463463374607431768211455) (u128 2)))", "1"), ("(string-of-int (mul (i128 -3) (i128 5)))", "-15"), ("(string-of-int (force (i128-of-string \"-1234\")))", "-1234"), ("(gt (i128 -1) (i128 -2))", True), ("(to-u8 (u128 257))", 1), ("(string-of-int (to-u128 (i8 -1)))", str(2**128 - 1)), ("(string-of-int (bit-not (i128 5)))", "-6"),
    ('(convert "string" (make-vec (u8 1) (u8 2)))', "[1;2]"), ('(convert "bool" (u16 256))', False), ('(convert "string" (make-tup (u8 1) true))', "(1;true)"), ('(convert "u8[]" (u8 3))', [3]), ('(convert "string" (null "u8"))', "NULL"), ('(convert "u8?" "12")', 12), ('(convert "string" (make-vec (char "a") (char "b")))', "ab"), ('(convert "float" true)', 1.0),
    ('(is-in (u8 1) (make-arr "u8"))', False), ('(is-in (null "u8") (make-arr "u8" (u8 1)))', None), ('(is-in "ell" "hello")', True), ('(is-in (u32 0x0A000005) (make-usr "Cidr4" (u32 0x0A000000) (u8 24)))', True), ('(is-in (u32 0x0A000105) (make-usr "Cidr4" (u32 0x0A000000) (u8 24)))', False), ('(is-empty "")', True),
    ('(percentiles (make-arr "u8" (u8 1) (u8 2) (u8 3) (u8 4)) 0 50 100)', [1, 3, 4]), ('(strftime "%Y-%m-%d %H:%M:%S %j %u %I %p" (float 86399.0))', "1970-01-01 23:59:59 0 5 11 p.m."), ('(verbatim "%1 * 2 + %2" "u8" (u8 4) (u8 1))', 9),
    ('(append-byte (bytes "a") (u8 255))', bytearray(b"a\xff")), ('(get-min (make-vec (u8 3) (u8 2)))', 2), ('(random-u128)', None), ("(hash \"x\")", None), ("(seq (assert true) (u8 3))", 3), ("(fold (u8 0) (fun (\"u8\" \"u8\") (add (param 0) (param 1))) (make-vec (u8 1) (u8 2)))", 3),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0][:40] for c in CASES])
def test_values(value, text, want):
    got = value(text)
    if "random" in text or "hash" in text:
        assert got is not None
    elif isinstance(want, float) and math.isfinite(want):
        assert got == pytest.approx(want)
    else:
        assert got == want or (want is not None and int(got) == want)


BAD = [
    "(get-item 2 (make-tup (u8 1) (u8 2)))", '(get-alt "pejh" (random-float))', '(apply (string "blabla") (bool false))', '(get-field "z" (make-rec a (u8 1)))', '(copy-rec (make-rec a (u8 1)) z (u8 1))', "(add (u8 1) (u16 1))", '(add (null "u8") (u8 1))', "(make-tup (u8 1))", "(make-vec)",
    "(make-rec a)", "(if true (u8 1) \"x\")", "(left-shift (u8 1) (u16 1))", "(let \"x\" (u8 1) (let \"x\" (u8 2) x))", "(truncate 1 9 (make-vec (u8 1)))", "(u8 256)", "(nonsense 1)", "(param 3)", "(force (u8 1))", "(seq (u8 1) (u8 2))", "x",
]


@pytest.mark.parametrize("text", BAD)
def test_rejected(text):
    with pytest.raises((TypeProblem, TypeError)):
        compile_text(text)


def test_force_aborts(spark):
    with pytest.raises(Exception, match="no value here"):
        spark.range(1).select(evaluate('(force "no value here" (null "u8"))')).collect()


def test_float_texts():
    for x in (0.2, 1 / 3, -1 / 7, 1.234, 0.0, 1e22, 5e-324):
        assert float(wide.short_float(x)) == x and float.fromhex(wide.hex_float(x)) == x
    assert [wide.short_float(x) for x in (1.234, 1.001, 1.0, 0.0)] == ["1.234", "1.001", "1", "0"]


def test_random_values(spark):
    from millrace.functions.library import random_value
    from millrace.plans.types import parse

    rows = spark.range(50).select(random_value(parse("{a: u8; b: string?; c: i16[3]; d: [x bool | y float]; e: u64[]}"), 3).alias("r")).collect()
    assert {r.r["b"] is None for r in rows} == {True, False} and all(0 <= r.r["a"] < 256 and len(r.r["c"]) == 3 for r in rows)


CURSORS = [
    ('(get-item 0 (read-u16 little-endian (ptr-of-string "AB")))', 16961), ('(get-item 0 (read-u64 big-endian (ptr-of-string "ABCDEFGHI")))', 0x4142434445464748), ('(peek-u8 (ptr-of-string "hello") (size 4))', 111),
    ('(get-item 0 (read-bytes (rewind (write-u64 little-endian (ptr-of-buffer (size 8)) (u64 18446744073709551614)) (size 8)) (size 8)))', b"\xfe" + b"\xff" * 7), ('(get-item 0 (read-bytes (set-bit (ptr-of-buffer (size 2)) (size 9) true) (size 2)))', b"\0\2"),
    ('(get-item 0 (float-of-ptr (ptr-of-string " 0x1.8p1,2")))', 3.0), ('(offset (get-item 1 (i32-of-ptr (ptr-of-string "-42;7"))))', 3), ('(rem-size (ptr-of-ptr (ptr-of-string "hello") (size 1) (size 3)))', 2), ('(get-item 0 (char-of-ptr (ptr-of-string "x")))', "x"),
    ('(while 20 (u8 1) (fun ("u8") (gt (u8 100) (param 0))) (fun ("u8") (mul (param 0) (u8 2))))', 128), ('(seq (for-each "c" "" (assert false)) (u8 5))', 5), ('(insert (insert (insert (sliding-window "u8" (u8 2)) (u8 3)) (u8 1)) (u8 9))', [1, 9]), ('(del-min (insert (insert (heap "u8") (u8 3)) (u8 1)) (u8 1))', [3]),
    ('((fun ("i64") (if (gt (i64 2) (param 0)) (i64 1) (mul (param 0) (myself (sub (param 0) (i64 1)))))) (i64 10))', 3628800), ('(apply-mask (mask-get 1 (mask "(X(_X))")) (make-tup (u8 1) (u8 2)))', 2), ("(pow (i64 3) (i64 41))", (3**41 + 2**63) % 2**64 - 2**63), ("(pow (u8 3) (u8 200))", pow(3, 200, 256)),
    ("(mul (i64 -9223372036854775808) (i64 -9223372036854775808))", 0), ("(sub (i64 -9223372036854775808) (i64 1))", 2**63 - 1), ("(mul (u64 18446744073709551615) (u64 18446744073709551615))", 1), ("(add (u64 18446744073709551615) (u64 2))", 1), ("(left-shift (u64 3) (u8 63))", 2**63), ("(right-shift (u64 18446744073709551615) (u8 63))", 1), ("(mul (i56 -36028797018963967) (i56 3))", (-36028797018963967 * 3 + 2**55) % 2**56 - 2**55),
]


@pytest.mark.parametrize("text,want", CURSORS, ids=[c[0][:40] for c in CURSORS])
def test_cursors_loops_and_words(value, text, want):
    got = value(text)
    assert bytes(got) == want if isinstance(want, bytes) else got == want


@pytest.mark.parametrize("text", [
    '(get-item 0 (read-u16 big-endian (ptr-of-string "A")))', '(while 3 (u8 1) (fun ("u8") true) (fun ("u8") (param 0)))', "(write-u8 (ptr-of-buffer (size 0)) (u8 1))", '(rewind (ptr-of-string "a") (size 1))', '(get-item 0 (u8-of-ptr (ptr-of-string "300")))', "(ptr-of-address (address 1) (size 1))",
    '(seq (for-each "x" (make-vec (u8 1) (u8 0)) (assert (gt x (u8 0)))) (u8 5))', '((fun ("i64") (if (gt (i64 0) (param 0)) (i64 1) (myself (param 0)))) (i64 10))',
])
def test_beyond_the_end(value, text):
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        value(text)


def test_random_numbers_are_drawn_once(spark):
    """A sum that mentions its parts several times has one draw of each."""
    rows = spark.range(200).select(evaluate("(let \"x\" (random-u64) (sub x x))").cast("string").alias("other"), evaluate("(to-u64 (to-i128 (random-u64)))").cast("string").alias("x")).collect()
    assert len({r.x for r in rows}) == 200 and all(0 <= int(r.x) < 2**64 for r in rows)
