import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions import library
from millrace.operators import accumulators, keyvalue, masks
from millrace.operators.aggregate import aggregate
from millrace.operators.convert import transform
from millrace.plans.compile import TypeProblem
from millrace.plans.types import parse


@pytest.fixture(scope="module")
def ten(spark):
    return spark.range(1, 11).select(F.col("id").cast("int").alias("value")).repartition(4)


SUM = ("(make-vec (i32 0))", '(fun ("i32[1]" "i32") (set-vec (u8 0) (param 0) (add (unsafe-nth (u8 0) (param 0)) (param 1))))', '(fun ("i32[1]") (unsafe-nth (u8 0) (param 0)))')


def test_sum(ten):
    df, m = aggregate(ten, parse("i32"), *SUM)
    assert df.first()[0] == 55 and str(m) == "I32"
    assert "HashAggregate" in df._jdf.queryExecution().toString() and "collect_list" not in df._jdf.queryExecution().toString()


def test_sum_wraps(spark):
    df = spark.createDataFrame([(2**31 - 1,), (1,)], "value int")
    assert aggregate(df, parse("i32"), *SUM)[0].first()[0] == -(2**31)


def test_several_parts(ten):
    update = '(fun ("(i32; i32; i32)" "i32") (seq (copy-tup (param 0) 0 (add (get-item 0 (param 0)) (i32 1))) (copy-tup (param 0) 1 (min (get-item 1 (param 0)) (param 1))) (copy-tup (param 0) 2 (max (get-item 2 (param 0)) (param 1)))))'
    df, _ = aggregate(ten, parse("i32"), "(make-tup (i32 0) (i32 99) (i32 0))", update, '(fun ("(i32; i32; i32)") (param 0))')
    assert tuple(df.first()[0]) == (10, 1, 10)


def test_ordered_fold(ten):
    # digits pushed one after another depend on the order
    update = '(fun ("i64[1]" "i32") (set-vec (u8 0) (param 0) (add (mul (unsafe-nth (u8 0) (param 0)) (i64 10)) (to-i64 (param 1)))))'
    args = (ten.where("value < 6"), parse("i32"), "(make-vec (i64 0))", update, '(fun ("i64[1]") (unsafe-nth (u8 0) (param 0)))')
    assert aggregate(*args, order="value")[0].first()[0] == 12345
    with pytest.raises(TypeProblem):
        aggregate(*args)


@pytest.mark.parametrize("init,flavour,want", [('(sliding-window "i32" (u8 3))', "sliding", [8, 9, 10]), ('(tumbling-window "i32" (u8 4))', "tumbling", [9, 10]), ('(hash-table "i32" (u8 10))', "hashtable", list(range(1, 11))), ('(empty-set "i32")', "simple", list(range(1, 11))), ('(heap "i32")', "heap", list(range(1, 11)))])
def test_sets(ten, init, flavour, want):
    df, _ = aggregate(ten, parse("i32"), init, f'(fun ("i32{{{"" if flavour == "simple" else flavour}}}" "i32") (insert (param 0) (param 1)))', f'(fun ("i32{{{"" if flavour == "simple" else flavour}}}") (param 0))', order="value")
    assert df.first()[0] == want


def test_top_and_sampling(spark, ten):
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("a", 3.0), ("c", 5.0), ("d", 0.0)], "i string, w double")
    got, _ = aggregate(df, None, '(top "string" (u8 2) (u8 9))', '(fun ("string?{top}" "{i: string?; w: float?}") (insert-weighted (param 0) (get-field "w" (param 1)) (get-field "i" (param 1))))', '(fun ("string?{top}") (param 0))')
    assert got.first()[0] == ["b", "c"]
    assert [tuple(r) for r in accumulators.top(df, [], "i", "w", 3).orderBy("rank").collect()] == [("b", 5.0, 1), ("c", 5.0, 2), ("a", 4.0, 3)]
    assert [r["i"] for r in accumulators.top(df, [], "i", "w", 9, 0.5).orderBy("rank").collect()] == ["b", "c"]
    assert accumulators.sampling(ten, [], 4, 1).distinct().count() == 4
    assert accumulators.top_sketch(df, "i", 1, 10).first()["item"] == "a"


def test_windows(spark):
    df = spark.range(20).select(F.col("id").alias("t"), (F.col("id") % 2).alias("k"))
    got = {r["k"]: r["items"] for r in accumulators.sliding_lists(df, ["k"], "t", 3, "t").collect()}
    assert got == {0: [14, 16, 18], 1: [15, 17, 19]}
    assert [r["n"] for r in accumulators.numbered(df, F.col("t").desc()).orderBy("t").collect()] == list(range(19, -1, -1))
    assert accumulators.numbered(df.where("false"), "t").count() == 0
    assert accumulators.tumbling(df, [], "t", 8).groupBy("bucket").count().orderBy("bucket").collect()[2]["count"] == 4
    assert [r["items"] for r in accumulators.running(df.where("k = 0"), ["k"], "t", 2, "t").orderBy("t").limit(2).collect()] == [[0], [0, 2]]
    assert accumulators.heap(df, ["k"], "t", 1, 2).orderBy("k").first()["items"] == [2, 4]
    other = spark.createDataFrame([(3,), (3,), (None,)], "x long")
    assert [r["t"] for r in accumulators.members(df, "t", other, "x").collect()] == [3] and accumulators.members(df, "t", other, "x", False).count() == 19


def test_sums_and_percentiles(spark):
    df = spark.createDataFrame([(1e16,), (1.0,), (-1e16,), (1.0,)], "x double").coalesce(1)
    assert df.agg(library.kahan_sum(F.collect_list("x"))).first()[0] == 2.0
    nums = spark.createDataFrame([("a", i) for i in (4, 1, 3, 2)] + [("b", None), ("b", 9)], "k string, x int")
    got = {r["k"]: (r["p_0"], r["p_50"], r["p_100"]) for r in library.grouped_percentiles(nums, ["k"], "x", [0, 50, 100]).collect()}
    assert got == {"a": (1, 3, 4), "b": (9, 9, 9)}
    assert spark.range(1).select(library.repeat(0, 5, F.lit(0), lambda a, i: a + i)).first()[0] == 10


def test_masks(spark):
    assert str(masks.parse("(x_x)")) == "(X_X)" and masks.parse("(xxx)") == masks.COPY and str(masks.parse('(X(_{(null "u8")}X))')) == '(X(_{(null "u8")}X))' and str(masks.parse("(X(_NX))")) == "(X(_NX))"
    for bad in ("(x", "z", "xx", "[a", "{b"):
        with pytest.raises(masks.MaskProblem):
            masks.parse(bad)
    show = lambda t, m: str(masks.project(parse(t), m))
    assert show("(string; u8?; char)", "(_X_)") == "U8?"
    assert show("(string; {foo: u8?; bar: u8}; char)", "(X(__)X)") == "(STRING; CHAR)"
    assert show("(string; string)", '(X{(char "c")}_)') == "(STRING; CHAR)"
    assert show("{foo: u8; bar: char?}", '(X[(not-null (char "c"))])') == "{foo: U8; bar: CHAR?}"
    with pytest.raises(masks.MaskProblem):
        masks.project(parse("(u8; u8)"), "(XXX_)")
    with pytest.raises(masks.MaskProblem):
        masks.project(parse("(u8; u8)"), "(NX)")
    df = spark.createDataFrame([(1, "x", (2, 3))], "a int, b string, c struct<d:int,e:int>")
    got, m = masks.select(df, parse("{a: i32; b: string?; c: {d: i32; e: i32}}"), "(XN(_X))")
    assert got.columns == ["a", "b", "c"] and got.first().asDict(True) == {"a": 1, "b": None, "c": {"e": 3}} and str(m) == "{a: I32; b: STRING?; c: {e: I32}}"
    assert masks.select(df, parse("{a: i32; b: string?; c: {d: i32; e: i32}}"), "(_X)")[0].columns == ["b"]
    assert masks.select(df, parse("{a: i32; b: string?; c: {d: i32; e: i32}}"), "(_X)", extend=True)[0].columns == ["b", "c"]


def test_transform(spark):
    df = spark.createDataFrame([(42, 0.0, "foo", [(1, "x")])], "_1 int, _2 double, _3 string, _4 array<struct<p:int,q:string>>")
    m = parse("(i32; float; string; {p: i32; q: string}[])")
    got, _ = transform(df, m, {"/0": '(fun ("i32") (add (i32 1) (param 0)))', "/2": '(fun ("string") (upper (param 0)))', "/3/0/p": '(fun ("i32") (neg (param 0)))'})
    assert str(got.first()) == "Row(_1=43, _2=0.0, _3='FOO', _4=[Row(p=-1, q='x')])"
    with pytest.raises(TypeProblem):
        transform(df, m, {"/9": '(fun ("i32") (param 0))'})


def test_commands(spark, tmp_path):
    (tmp_path / "in.txt").write_text('(42 0 "foo")\n')
    args = ["converter", "--schema", "(i32;float;string)", "-i", str(tmp_path / "in.txt"), "-e", '/0:(fun ("i32") (add (i32 1) (param 0)))', "-e", '/1:(fun ("float") (add (float 0.5) (param 0)))', "-e", '/2:(fun ("string") (upper (param 0)))']
    assert cli.run(spark, args) == ['(43 0x1p-1 "FOO")']
    (tmp_path / "n.csv").write_text("".join(f"{i}\n" for i in range(1, 11)))
    common = ["aggregator", "--schema", "i32", "-i", str(tmp_path / "n.csv"), "--input-enc", "csv"]
    assert cli.run(spark, [*common, "--output-enc", "csv", "--init", SUM[0], "--update", SUM[1], "--finalize", SUM[2]]) == ["55"]
    sliding = ["--init", '(sliding-window "i32" (u8 3))', "--update", '(fun ("i32{sliding}" "i32") (insert (param 0) (param 1)))', "--finalize", '(fun ("i32{sliding}") (param 0))']
    assert cli.run(spark, [*common, *sliding]) == ["3 (8 9 10)"]
    (tmp_path / "kv.txt").write_text('17:"old"\n42:"glop"\n17:"pas glop"\n')
    schemas = ["--key-schema", "u32", "--value-schema", "string", "-k", ":"]
    cli.run(spark, ["load", "-i", str(tmp_path / "kv.txt"), "-o", str(tmp_path / "kv"), *schemas])
    assert sorted(cli.run(spark, ["dump", "-i", str(tmp_path / "kv"), *schemas])) == ['17:"pas glop"', '42:"glop"']
    assert cli.run(spark, ["query", "-i", str(tmp_path / "kv"), "--key", "42", *schemas]) == ['42:"glop"']


def test_alternate_entries(spark, tmp_path):
    (tmp_path / "kv.txt").write_text('1\n"a"\n2\n"b"\n1\n"c"\n')
    got = keyvalue.load(spark, str(tmp_path / "kv.txt"), "u32", "string")
    assert sorted(map(tuple, got.collect())) == [(1, "c"), (2, "b")]


def test_streams(spark, tmp_path):
    from millrace.streaming import windows

    rows = [(f"2024-01-01 00:00:{s:02d}", s % 2, s) for s in range(0, 40, 4)]
    spark.createDataFrame(rows, "t string, k int, v int").selectExpr("cast(t as timestamp) t", "k", "v").coalesce(1).write.parquet(str(tmp_path / "s"))
    source = lambda: spark.readStream.schema("t timestamp, k int, v int").parquet(str(tmp_path / "s"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{mode}{df.columns}")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("out").collect()

    got = run(windows.tumbling(source(), [], "t", "20 seconds", "10 seconds", F.sum("v").alias("s")), "complete")
    assert sorted(r["s"] for r in got) == [40, 140]
    assert len(run(windows.sessions(source(), ["k"], "t", "5 seconds", "10 seconds", F.count("*").alias("n")), "complete")) == 1
    assert sum(r["n"] for r in run(windows.hopping(source(), [], "t", "20 seconds", "10 seconds", "10 seconds", F.count("*").alias("n")), "complete")) == 20
    got = run(windows.last_n(source(), "k", "t", "v", 3), "update")
    assert [list(r["items"]) for r in got] == [[28, 32, 36]]


def test_rows_and_nets(spark):
    from millrace.operators import rows

    df = spark.createDataFrame([(1, "a", None), (5, "b", 2), (9, "c", 3)], "x int, s string, n int")
    t = parse("{x: i32; s: string; n: i32?}")
    assert [r.x for r in rows.where(df, t, '(fun ("{x: i32; s: string; n: i32?}") (and (gt (get-field "x" (param 0)) (i32 1)) (ne (get-field "s" (param 0)) "c")))').collect()] == [5]
    with pytest.raises(TypeProblem):
        rows.where(df, t, '(fun ("{x: i32; s: string; n: i32?}") (get-field "x" (param 0)))')
    nets = spark.createDataFrame([((0x0A000000, 8),), ((0x0A010000, 16),), ((0xC0A80100, 24),), (None,)], "net struct<ip:long,mask:int>")
    ips = spark.createDataFrame([(0x0A0B0C0D,), (0x0B000000,), (0xC0A801FF,), (0xC0A80200,), (None,)], "ip long")
    assert sorted(r.ip for r in accumulators.members_of_nets(ips, "ip", nets, "net").collect()) == [0x0A0B0C0D, 0xC0A801FF]
    assert accumulators.members_of_nets(ips, "ip", nets, "net", inside=False).count() == 3
    six = spark.createDataFrame([((bytes.fromhex("20010db8" + "00" * 12), 32),)], "net struct<ip:binary,mask:int>")
    ip6 = spark.createDataFrame([(bytes.fromhex("20010db8" + "ff" * 12),), (bytes.fromhex("20010db9" + "00" * 12),)], "ip binary")
    assert accumulators.members_of_nets(ip6, "ip", six, "net", wide=True).count() == 1


def test_whole_tables_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(accumulators, "PIECE", 7)
    df = spark.range(40).select((F.col("id") * 13 % 40).alias("t")).repartition(5)
    got = {r.t: r["items"] for r in accumulators.running(df, [], "t", 4, "t").collect()}
    assert got == {i: list(range(max(0, i - 3), i + 1)) for i in range(40)}
    assert {r.t: r["items"] for r in accumulators.running(df, [], "t", 1, "t").collect()} == {i: [i] for i in range(40)}
    assert accumulators.heap(df, [], "t", 3, 4).first()["items"] == [3, 4, 5, 6]
    sample = lambda n: {r.t for r in accumulators.sampling(df.repartition(n), [], 9, 1).collect()}
    assert sample(1) == sample(7) and len(sample(1)) == 9


def test_scaled_weights_without_keys(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)], "at int, value string")
    update = '(fun ("string{top}" "string") (seq (scale-weights (param 0) (float 0.1)) (insert-weighted (param 0) (float 1.0) (param 1))))'
    got, _ = aggregate(df, parse("string"), '(top "string" (u8 2) (u8 9))', update, '(fun ("string{top}") (param 0))', order="at")
    assert got.first()[0] == ["a", "b"]


def test_commands_see_files_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("".join(f"{10 * k + i}\n" for i in range(5 * (3 - k))))
    args = ["aggregator", "--schema", "i32", "-i", str(tmp_path), "--input-enc", "csv", "-w", '(fun ("i32") (ne (param 0) (i32 24)))', "--init", '(sliding-window "i32" (u8 3))', "--update", '(fun ("i32{sliding}" "i32") (insert (param 0) (param 1)))', "--finalize", '(fun ("i32{sliding}") (param 0))']
    assert cli.run(spark, args) == ["3 (21 22 23)"]


def test_external_functions(spark, tmp_path):
    (tmp_path / "in.txt").write_text("(4 2)\n")
    args = ["converter", "--schema", "(i32;i32)", "-i", str(tmp_path / "in.txt"), "-x", "twice=tests.test_operators:twice", "-e", '/0:(fun ("i32") (apply (ext-identifier twice) (param 0)))']
    assert cli.run(spark, args) == ["(8 2)"]


def twice(v):
    from millrace.plans.compile import OPS

    return OPS["add"](v, v)


def test_convert_to_char_and_maps(spark):
    from millrace.plans.compile import evaluate
    from millrace.plans.types import to_spark

    assert spark.range(1).select(evaluate('(convert "char?" "xyz")'), evaluate('(convert "char?" "")')).first()[:] == ("x", None)
    assert to_spark(parse("globals_map")).simpleString() == "map<string,string>"


def test_turns_over_the_parts_of_files(spark, tmp_path):
    for f in range(2):
        (tmp_path / f"{f}.txt").write_text("".join(f"{k % 7 + 10 * f}\n\"v{k}\"\n" for k in range(300)) + "99\n" * f)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = keyvalue.load(spark, str(tmp_path), "u32", "string")
        assert sorted(map(tuple, got.collect())) == sorted((k % 7 + 10 * f, f"v{k}") for f in range(2) for k in range(293, 300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
