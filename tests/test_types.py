import pytest

from millrace.plans.types import SchemaError, equal, parse, to_spark, zero


@pytest.mark.parametrize("text", ["u8", "u8?", "u8[3]", "u8?[3]", "u8[3]?", "u8[]?[3]", "u8?[3][]?", "{f1: Bool; f2: U8?}", "[c1 Bool | c2 U8?]", "(u8; bool[string])[]?[string?[u8?]]", "i8?{}", "i32{sliding}", "[eugp Ip4 | jjbi BOOL | bejlu I24? | bfid FLOAT][[]]", "(u8 -> bool)", "&u8", "cidr?"])
def test_print_and_parse(text):
    m = parse(text)
    assert parse(str(m)) == m or equal(parse(str(m)).typ, m.typ)


def test_meanings():
    assert str(parse("(U8)")) == "U8" and str(parse("(foo as U8)")) == "U8"
    assert parse("(bar as U8)[]").typ.kind == "arr"
    assert str(parse("`thing` UInt16")) == "{thing: U16}" and str(parse("`thing` Array(UInt16)")) == "{thing: U16[]}"
    assert str(parse("`a` Nullable(String) `b` DateTime")) == "{a: STRING?; b: U32}"
    m = parse('{a: u8 default (u8 42); b: u8? default (null "u8"); c: i8[3] default (make-vec (i8 1) (i8 2) (i8 3))}')
    assert zero(m) == {"a": 42, "b": None, "c": [1, 2, 3]}
    assert parse("{a: u8; // one\n b: u8;}").typ.names == ("a", "b")
    assert equal(parse("{a: u8; b: bool}").typ, parse("{b: bool; a: u8}").typ) and equal(parse("ip4").typ, parse("u32").typ)


@pytest.mark.parametrize("text,kind", [("u8", "smallint"), ("u16", "int"), ("i24", "int"), ("u32", "bigint"), ("u64", "decimal(20,0)"), ("u128", "binary"), ("float", "double"), ("[a u8 | b]", "struct<tag:smallint,a:smallint>"), ("(u8; string)", "struct<_1:smallint,_2:string>")])
def test_spark_types(text, kind):
    assert to_spark(parse(text)).simpleString() == kind


@pytest.mark.parametrize("text", ["u9", "u8[0]", "(u8", "{a: u8; a: u8}", "[a | a]", "u8 u8", "{}", "u8{blue}"])
def test_nonsense(text):
    with pytest.raises(SchemaError):
        parse(text)
