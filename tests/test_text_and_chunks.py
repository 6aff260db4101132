from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import chunking


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def test_token_estimates(spark):
    for text, floor, ceil in (("", 0, 0), ("a", 0, 1), ("abcd", 1, 1), ("abcde", 1, 2), (None, 0, 0)):
        df = spark.createDataFrame([(text,)], "t string")
        assert tuple(df.select(T.floor_tokens(F.col("t")), T.ceil_tokens(F.col("t"))).first()) == (floor, ceil)


def test_snippets_and_slices(spark):
    text = "a\nb\nc\nd"
    for line, want in ((3, "c\nd"), (4, "d"), (0, ""), (-1, ""), (9, "")):
        assert one(spark, T.snippet(F.col("t"), F.lit(line)), t=text) == want
    assert one(spark, T.content_slice(F.col("t"), F.lit(2), F.lit(99)), t=text) == "b\nc\nd"


def test_names_and_paths(spark):
    for path, want in (("a/b.EX", ".ex"), ("x/.env", ""), ("a.b/c", ""), ("a.tar.gz", ".gz")):
        assert one(spark, T.extension(F.col("p")), p=path) == want
    name, n = T.arity(F.col("n"))
    df = spark.createDataFrame([("Foo.bar/2",), ("Foo.bar",), ("a/b2",)], "n string")
    assert [tuple(r) for r in df.select(name, n).collect()] == [("Foo.bar", 2), ("Foo.bar", None), ("a/b2", None)]
    assert one(spark, T.answer_text(F.col("a")), a='{"content": " hi "}') == "hi"
    assert one(spark, T.answer_text(F.col("a")), a="  ") is None
    assert one(spark, T.human_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, T.human_duration(F.col("n")), n=90_000) == "1.5 min"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.l2_normalize(F.col("a")).alias("n"), V.of_dimension(F.col("a"), 3).alias("d")).collect()
    assert abs(rows[0].c - 0.96) < 1e-12 and rows[0].n == [0.6, 0.8] and rows[0].d is None
    assert rows[1].c is None and rows[1].n is None
    a, b = spark.createDataFrame([("x y",), ("y x",)], "t string").select(V.hash_embed(F.col("t")).alias("v")).collect()
    assert a.v == b.v and len(a.v) == 64


def test_windows(spark):
    df = spark.createDataFrame([(1, "ab\n" * 1500), (2, ""), (3, None), (4, "é" * 2048)], "id int, content string")
    rows = chunking.windows(df).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index) for r in rows] == [(1, 0), (1, 1), (1, 2), (4, 0), (4, 1)]
    assert rows[0].content == ("ab\n" * 1500)[:2048] and rows[1].content == ("ab\n" * 1500)[1792:3840]
    assert rows[0].line_start == 1 and rows[1].line_start == 598 and rows[0].token_count == 512
    raw = chunking.windows(df, mode="bytes").filter("id = 4").orderBy("chunk_index").collect()
    assert [len(r.content) for r in raw] == [1024, 1024, 256]
    plain = chunking.plain_windows(df).filter("id = 1").orderBy("chunk_index").collect()
    assert "".join(r.content for r in plain) == "ab\n" * 1500


def test_byte_windows_repair_tails(spark):
    df = spark.createDataFrame([(1, "a" + "é" * 2000)], "id int, content string")
    rows = chunking.windows(df, mode="bytes").orderBy("chunk_index").collect()
    assert rows[0].content == "a" + "é" * 1023  # the split character is dropped
    assert rows[1].content == ""  # begins within a character


def test_line_windows(spark):
    df = spark.createDataFrame([(1, "\n".join(map(str, range(100)))), (2, "x")], "id int, content string")
    rows = chunking.line_windows(df).orderBy("chunk_index").collect()
    assert [(r.line_start, r.line_end) for r in rows] == [(1, 51), (42, 92)]
    assert chunking.line_windows(df, keep_tail=True).count() == 4
    assert {r.id for r in chunking.symbol_chunks(df).collect()} == {1, 2}
