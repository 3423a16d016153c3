import math
import random
import string
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.plans.types import SchemaError, parse
from millrace.sources import DecodeProblem, codec


def text(name, schema, data, counts=True, **options):
    m = parse(schema)
    return codec("s-expr", m, counts=counts).encode(codec(name, m, **options).one(data.encode() if isinstance(data, str) else data)).decode()


OPTIONAL = "{foo: string?; bar: {baz: i32?[]?; glop: bool}?[]?}"
LOOSE = "{foo: string?; bar: {baz: i32?[]?; glop: bool?}?[]?}"
SIMPLE = "{foo: float default 3.14; bar: {baz: i32?[] default (make-arr \"i32?\"); glop: bool}?; zap: i8[2][[]]?}?"

JSON = [
    ("cidr", '{"v4":{"ip":1234,"mask":24}}', "(0 (1234 24))"),
    ("{cxgpze: U40?; hrmehj: U32?; ydmea: Cidr?}?[2]", '[{"cxgpze":123,"ydmea":{"v4":{"ip":1234,"mask":24}}}, null]', "((123 null (0 (1234 24))) null)"),
    ("{foo: u8[[]]}", '{"foo":[]}', "(())"),
    (LOOSE, "{}", "(null null)"), (LOOSE, '{"foo":""}', '("" null)'), (LOOSE, '{"foo":"X\\/\\\\\\tX"}', '("X/\\\tX" null)'), (LOOSE, '{"foo":null,"bar":[ {} , null, {"baz":[-1,-2,null,],},],}', "(null ((null null) null ((-1 -2 null) null)))"),
    ("[a | b | c string]", '{"c":"glop"}', '(2 "glop")'), ("[a | b | c string]", '"a"', "(0 )"),
    ("float", "1.", "0x1p+0"), ("u32", "123", "123"), ("bool[]?", "[true,false]", "(T F)"), ("bool[]?", "null", "null"), ("i8?{}", "[1,2,3,null]", "(1 2 3 null)"),
    (SIMPLE, "null", "null"), (SIMPLE, '{"foo":3.,"bar":null}', "(0x1.8p+1 null null)"), (SIMPLE, '{"zap":[[1,2],[3,4]],"x":1}', "(0x1.91eb851eb851fp+1 null ((1 2) (3 4)))"), ("string", '"X\\/\\tX"', '"X/\tX"'), ("string", '"\\u00e9"', '"é"'),
    ("{glop: u8; pas_glop: [foo | bar | baz string]}", '{"glop":1,"pas_glop":{"baz":"lol"}}', '(1 (2 "lol"))'),
]


@pytest.mark.parametrize("schema,data,want", JSON)
def test_json(schema, data, want):
    assert text("json", schema, data, counts=False) == want


def test_broken_json_ends():
    for bad in ('{"foo":[X', '{"foo":', '{"foo', "[1", ""):
        with pytest.raises((DecodeProblem, IndexError)):
            codec("json", "{foo: u8[[]]}").one(bad.encode())


PLAIN = "{u:U8; b:BOOL; name:STRING?}"
PIPE = {"sep": "|", "null": "", "quote": None, "true": "true", "false": "false"}
HOUSE = {"sep": ",", "true": "1", "false": "0", "clickhouse": True}
TABS = {"sep": "\t", "quote": None, "clickhouse": True}
CSV = [
    (PLAIN, "1|false|", "(1 F null)", PIPE), (PLAIN, '1,true,"one"', '(1 T "one")', {"null": "", "true": "true", "false": "false"}), (PLAIN, "3,false,", "(3 F null)", {"null": "", "true": "true", "false": "false"}),
    ("{u:U8[3]; b:BOOL; name:STRING?}", '"[1,2,3]",0,\\N', "((1 2 3) F null)", HOUSE), ("char[3]", '"abc"', '("a" "b" "c")', {}), ("char[3]", "abc", '("a" "b" "c")', {}),
    ("(u16[]; u64?)", "[]\t\\N", "(() null)", TABS), ("(u16[]?; u64?)", "\\N\t\\N", "(null null)", TABS), ("(u16?[]; u64?)", "[42,\\N,44]\t\\N", "((42 null 44) null)", TABS), ("(u16[3]; u64?)", "[42,43,44]\t\\N", "((42 43 44) null)", TABS),
    ("{from: string?; to: string[]}", "\\N\t['a', 'b']", '(null ("a" "b"))', TABS),
]


@pytest.mark.parametrize("schema,data,want,options", CSV)
def test_csv(schema, data, want, options):
    assert text("csv", schema, data, counts=False, **options) == want


def test_csv_refuses_what_it_cannot_tell():
    with pytest.raises(SchemaError):
        codec("csv", "(u8?; u8)?")


RING = [
    ("u8", 42, "2a000000"), ("u8?", 42, "010000002a000000"), ("(u8; i8)", (42, 58), "010000002a0000003a000000"), ("(u8?; i8)", (42, 58), "010000002a0000003a000000"), ("(u8?; i8?)?", (42, 58), "01000000010000002a0000003a000000"),
    ("[small u8 | big u16]", (0, 42), "000000002a000000"), ("[small u8 | big u16]?", (0, 42), "01000000000000002a000000"), ("(u8?; i8?)", (None, 58), "010100003a000000"),
]


@pytest.mark.parametrize("schema,value,want", RING)
def test_ring_buffer_bytes(schema, value, want):
    c = codec("ringbuf", schema)
    assert c.encode(value).hex() == want and c.one(bytes.fromhex(want)) == value


def test_other_bytes():
    assert codec("csv", "[small u8? | big u16]").encode((0, 42)) == b"0,42"
    assert codec("row-binary", "u8").encode(42) == b"*"
    with pytest.raises(SchemaError):
        codec("ringbuf", "{a: u8? default (u8 3)}")
    wide = "(string; u64; u64; u8; string; u8; string; u32?; u32?; u64; u64; u32; u32; u32?; string?; u32?; string?; u32?; string?; u16; u16; u8; u8; u32?; u32?; u32; string; u64; u64; u64; u64; u64; u64; string?)"
    assert len(parse(wide).typ.items) == 34


SEXPR = [("u8?", "1"), ("u24", "15134052"), ("I8[]", "1 (2)"), ("(I8?; I40?)[]", "1 ((2 1))"), ("i40", "-161920788051"), ("{bajg: CHAR; bqgbef: U32?; eibho: U24?; gvrh: U16?}[]", '1 (("+" 3545637917 null 14235))'), ("float", "0x1.79c428d047e73p-16"), ("float", "-0x1.79c428d047e73p-16"), ("[Foo (float; u32; string)]", '(0 (0x1.79c428d047e73p-16 1234 ""))')]


@pytest.mark.parametrize("schema,data", SEXPR)
def test_sexpr(schema, data):
    assert text("s-expr", schema, data) == data


SCALARS = ["u8", "u16", "u24", "u32", "u40", "u48", "u56", "u64", "u128", "i8", "i16", "i24", "i32", "i40", "i48", "i56", "i64", "i128", "bool", "char", "float", "string"]


def random_type(rng, depth):
    if depth == 0 or rng.random() < 0.4:
        t = rng.choice(SCALARS)
    else:
        k = rng.choice(["vec", "arr", "set", "tup", "rec", "sum"])
        some = [random_type(rng, depth - 1) for _ in range(rng.randrange(2, 4))]
        t = {"vec": f"{some[0]}[{rng.randrange(1, 4)}]", "arr": f"{some[0]}[]", "set": f"{some[0]}{{}}", "tup": f"({'; '.join(some)})", "rec": "{" + "; ".join(f"f{i}: {x}" for i, x in enumerate(some)) + "}", "sum": "[" + " | ".join(f"c{i} {x}" for i, x in enumerate(some)) + "]"}[k]
    return t + "?" * (rng.random() < 0.4)


def random_value(rng, m):
    from millrace.plans.types import INTEGERS, SIGNED

    t = m.typ
    if m.nullable and rng.random() < 0.5:
        return None
    if t.kind in INTEGERS:
        n = rng.getrandbits(INTEGERS[t.kind])
        return n - (1 << INTEGERS[t.kind] - 1) if t.kind in SIGNED else n
    match t.kind:
        case "bool":
            return rng.random() < 0.5
        case "char":
            return rng.choice(string.ascii_letters)
        case "float":
            return rng.choice([0.0, -1.5, math.pi, 1e300, rng.random()])
        case "string":
            return "".join(rng.choice(string.ascii_letters + " é_-") for _ in range(rng.randrange(3, 15)))
        case "vec" | "arr" | "set":
            return [random_value(rng, t.items[0]) for _ in range(t.extra if t.kind == "vec" else rng.randrange(4))]
        case "tup":
            return tuple(random_value(rng, x) for x in t.items)
        case "rec":
            return {n: random_value(rng, x) for n, x in zip(t.names, t.items)}
        case "sum":
            i = rng.randrange(len(t.items))
            return (i, random_value(rng, t.items[i]))


@pytest.mark.parametrize("name", ["s-expr", "json", "csv", "row-binary", "ringbuf"])
def test_random_round_trips(name):
    rng, tried = random.Random(name), 0
    while tried < 60:
        m = parse(random_type(rng, 3))
        try:
            c = codec(name, m)
        except SchemaError:
            continue
        tried += 1
        for _ in range(10):
            v = random_value(rng, m)
            assert c.one(c.encode(v)) == v, (str(m), v, c.encode(v))


def test_columns_and_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from millrace.sources import decode_column, encode_column, read, write
    from millrace.sources.base import packed, sizes

    m = parse("{a: u8; b: string?; c: i16[]; d: [x u64 | y]; e: u128}")
    from millrace.plans.types import to_schema

    rows = [{"a": 1, "b": "x", "c": [1, -2], "d": {"tag": 0, "x": Decimal(7)}, "e": b"\0" * 15 + b"\5"}, {"a": 2, "b": None, "c": [], "d": {"tag": 1, "x": None}, "e": b"\xff" * 16}]
    df = spark.createDataFrame(rows, to_schema(m))
    want = sorted(map(str, df.collect()))
    for name in ("s-expr", "json", "csv", "row-binary", "ringbuf"):
        made = codec(name, m)
        back = df.select(decode_column(encode_column(packed(df, m), made), made).alias("v")).select("v.*")
        assert sorted(map(str, back.collect())) == want, name
        assert df.select(sizes(df, name, m).alias("n")).where("n > 0").count() == 2
    for name in ("s-expr", "json", "csv"):
        write(df, str(tmp_path / name), name, m)
        assert sorted(map(str, read(spark, str(tmp_path / name), name, m, "\n").collect())) == want
    (tmp_path / "rows.bin").write_bytes(b"".join(codec("row-binary", "u16").encode(i) for i in range(1000)))
    assert read(spark, str(tmp_path / "rows.bin"), "row-binary", "u16").agg(F.sum("value")).first()[0] == 499500
    write(df, "", "null", m)


@pytest.mark.parametrize("name,options", [("s-expr", {}), ("s-expr", {"counts": False}), ("s-expr", {"strict": True}), ("csv", {}), ("csv", {"sep": "|", "quote": None}), ("csv", {"strict": True, "null": ""})])
def test_encoders_of_columns_are_those_of_python(spark, name, options):
    from millrace.functions.library import random_value
    from millrace.plans.types import parse
    from millrace.sources import codec, encode_column
    from millrace.sources.base import from_row
    from millrace.sources.columns import text_column

    m = parse("{a: u8; b: string?; c: i16[3]; d: [x bool | y i32]; e: u32[]; f: (string; bool); g: float; h: u64; j: i40?[]}")
    made = codec(name, m, **options)
    rows = spark.range(60).select(random_value(m, 5).alias("v")).cache()
    assert text_column(rows["v"], made) is not None
    got = rows.select("v", encode_column(rows["v"], made).alias("x")).collect()
    assert [bytes(r["x"]) for r in got] == [made.encode(from_row(r["v"].asDict(True), m)) for r in got]


@pytest.mark.parametrize("name,text", [("json", b"300"), ("json", b"-1"), ("json", b"1e999"), ("csv", b"300"), ("csv", b"-1"), ("s-expr", b"300"), ("s-expr", b"-1")])
def test_integers_beyond_their_width_are_no_values(name, text):
    from millrace.sources import DecodeProblem, codec

    with pytest.raises(DecodeProblem):
        codec(name, "u8").one(text)


TREE = "{v: u8; left: THIS?; right: THIS?; tag: [a | b THIS]}"


@pytest.mark.parametrize("name", ["s-expr", "json", "csv", "row-binary", "ringbuf"])
def test_recursive_types(spark, name):
    from millrace.plans.types import equal, parse, to_spark
    from millrace.sources import codec, decode_column, encode_column

    m = parse(TREE)
    leaf = {"v": 7, "left": None, "right": None, "tag": (0, None)}
    value = {"v": 1, "left": {**leaf, "v": 2}, "right": {**leaf, "left": leaf}, "tag": (1, leaf)}
    made = codec(name, m)
    data = made.encode(value)
    assert made.one(data) == value
    assert str(m) == "{v: U8; left: THIS?; right: THIS?; tag: [a | b THIS]}" and equal(m.typ, parse(TREE).typ)
    assert to_spark(m).simpleString() == "struct<v:smallint,left:string,right:string,tag:struct<tag:smallint,b:string>>"
    rows = spark.createDataFrame([(data,)], "x binary").select(decode_column(F.col("x"), made).alias("v"))
    got = rows.select("v.v", F.get_json_object("v.right", "$.left.v").alias("deep"), encode_column(F.col("v"), made).alias("x")).first()
    assert (got.v, got.deep, bytes(got.x)) == (1, "7", data)


def test_recursive_lists_and_names():
    from millrace.plans.types import parse
    from millrace.sources import codec

    for text, value in (("[leaf string | branch THIS[]]", (1, [(0, "x"), (1, [])])), ("{head: node as [end | next node]; n: u8}", {"head": (1, (1, (0, None))), "n": 3})):
        for name in ("s-expr", "json", "row-binary"):
            made = codec(name, parse(text))
            assert made.one(made.encode(value)) == value
