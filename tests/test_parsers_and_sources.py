from pyspark.sql import functions as F

from corvane.operators import graph, parsers
from corvane.sources import files as sources
from corvane.sources.tables import latest


def names(df):
    return [(r.kind, r.name, r.visibility) for r in df.orderBy("line_no").collect()]


def src(spark, text, language="unknown"):
    return spark.createDataFrame([("f", language, text)], "path string, language string, content string")


def test_languages(spark):
    want = {"a.ex": "elixir", "a.tsx": "tsx", "a.h": "c", "a.tf": "terraform", "a.json": "config", "a.md": "unknown", "A.PY": "python"}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.l for r in df.select("p", parsers.language(F.col("p")).alias("l")).collect()} == want


def test_line_rules(spark):
    assert names(parsers.line_symbols(src(spark, "pub fn run() {\n  struct Inner;\nimpl<T> Foo {\n", "rust"))) == [("function", "run", "public"), ("struct", "Inner", "private"), ("impl", "Foo", "public")]
    assert names(parsers.line_symbols(src(spark, "func (s *T) Go(a int) {\nfunc low() {\ntype X struct {\n", "go"))) == [("function", "Go", "public"), ("function", "low", "private"), ("struct", "X", "public")]
    assert names(parsers.line_symbols(src(spark, "async def _a(x):\nclass B(C):\n@dec.x\n", "python"))) == [("function", "_a", "private"), ("class", "B", "public"), ("decorator", "dec.x", "public")]
    tf = parsers.line_symbols(src(spark, 'resource "aws_x" "my-name" {\nlocals {\n', "terraform")).orderBy("line_no").collect()
    assert [(r.kind, r.qualified_name) for r in tf] == [("resource", "aws_x.my-name"), ("locals", "locals")]
    ex = names(parsers.line_symbols(src(spark, "defmodule A.B do\n  def go(x), do: x\n  defp hid(x), do: x\n", "elixir")))
    assert ex == [("module", "A.B", "public"), ("function", "go", "public"), ("function", "hid", "private")]
    assert names(parsers.line_symbols(src(spark, "function f() {\nclass G {\n", "lua"))) == [("function", "f", "public"), ("class", "G", "public")]


def test_yaml(spark):
    k8s = "apiVersion: v1\nkind: Service\nmetadata:\n  name: web\n---\nkind: Pod\nmetadata:\n  name: db\n"
    compose = "services:\n  web:\n    image: x\n  db:\n    image: y\nvolumes:\n  data:\n"
    flow = "name: CI\njobs:\n  test:\n    runs-on: x\n  steps:\n"
    df = spark.createDataFrame([("a.yaml", k8s), ("b.yml", compose), (".github/workflows/c.yml", flow), ("values.yaml", "a: 1\nb:\n"), ("d.yaml", None)], "path string, content string")
    rows = parsers.yaml_symbols(df).collect()
    got = {p: [(r.kind, r.qualified_name) for r in sorted((r for r in rows if r.path == p), key=lambda r: r.line_no)] for p in ("a.yaml", "b.yml", ".github/workflows/c.yml", "values.yaml")}
    assert got["a.yaml"] == [("resource", "Service/web"), ("resource", "Pod/db")]
    assert got["b.yml"] == [("service", "web"), ("service", "db"), ("volume", "data")]
    assert got[".github/workflows/c.yml"] == [("workflow", "CI"), ("job", "test")]
    assert got["values.yaml"] == [("config", "a"), ("config", "b")]


def test_imports_docs_and_todos(spark):
    ts = src(spark, 'import a from "./x"\nconst y = require("y")\nimport b from "@s/z"')
    assert ts.select(parsers.imports(F.col("content"), "typescript").alias("m")).first().m == ["./x", "y"]
    py = src(spark, "from a.b import c\nimport d\n")
    assert sorted(py.select(parsers.imports(F.col("content"), "python").alias("m")).first().m) == ["a.b", "d"]
    doc = src(spark, "/**\n * Says what it does\n */\n/** x */")
    assert doc.select(parsers.doc_comments(F.col("content"), "generic").alias("d")).first().d == ["Says what it does"]
    assert [(r.line_no, r.todo) for r in parsers.todo_lines(src(spark, "a\n // todo: b \nTODOS")).collect()] == [(2, "// todo: b")]


def test_nearest_note_above(spark):
    df = spark.createDataFrame([(1, "n", "doc1"), (2, "f", "a"), (9, "f", "b"), (9, "n", "late")], "line int, t string, text string").withColumn("k", F.lit(1))
    got = {r.text: r.note for r in parsers.nearest_above(df, ["k"], "line", F.col("t") == "n", F.col("text")).collect()}
    assert got == {"a": "doc1", "b": "doc1"}
    got = {r.text: r.note for r in parsers.nearest_above(df, ["k"], "line", F.col("t") == "n", F.col("text"), 3).collect()}
    assert got == {"a": "doc1", "b": None}


def test_gitignore_and_dot(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("*.log",), ("**/tmp/",), ("/build/out",), ("dist",)], "value string")
    assert {r.folder for r in parsers.gitignore_folders(lines).collect()} == {"tmp", "build", "dist"}
    dot = spark.createDataFrame([('  "a.ex" -> "b.ex" [label=x]',), ("digraph {",)], "value string")
    assert [tuple(r) for r in graph.parse_dot(dot).collect()] == [("a.ex", "b.ex")]


def test_scan(spark, tmp_path):
    for name, text in (("lib/foo.ex", "a\nb\n"), ("lib/bar.ex", "c"), ("README.md", "x"), ("node_modules/m.js", "y"), ("mix.exs", "z")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = sources.check_root(str(tmp_path))
    rows = {r.path: r for r in sources.scan(spark, str(root), "p").collect()}
    assert set(rows) == {"lib/foo.ex", "lib/bar.ex", "mix.exs"} and rows["lib/foo.ex"].line_count == 3 and rows["lib/foo.ex"].language == "elixir"
    parsed = parsers.parse(sources.scan(spark, str(root), "p"))
    assert parsed.count() == 0
    (tmp_path / "log").write_text("\x01c1\x02a@x\nlib/foo.ex\nlib/bar.ex\n\x01c2\x02b@x\nlib/foo.ex\n")
    assert sources.git_log(spark, str(tmp_path / "log")).count() == 3
    try:
        sources.check_root("/etc")
        raise AssertionError
    except PermissionError:
        pass


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None), (2, "c", None)], "id int, v string, updated_at int")
    assert sorted((r.id, r.v) for r in latest(df).collect()) == [(1, "b"), (2, "c")]
