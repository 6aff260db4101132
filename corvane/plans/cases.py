"""Queries over small written-out inputs in which every rule fires, with the answers written out in SQL.

The test tables hold little of what these operators look for, so a query over
them alone could not tell right from wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking, frameworks, graph, incremental, metrics, parsers, retrieval
from corvane.plans import sql as S
from corvane.plans.queries import _query, _Tables
from corvane.sources import files as sources


def _rows(names: str, *rows: tuple) -> str:
    """SQL of rows written out."""
    say = lambda v: "NULL" if v is None else S.text(v) if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + f") AS t({names})"


def _frame(t: _Tables, schema: str, *rows: tuple) -> DataFrame:
    return t.spark.createDataFrame(list(rows), schema)


@_query(
    _rows(
        "n, framework",
        (1, "using Phoenix LiveView"), (2, "using Phoenix Framework"), (3, "using Phoenix with Ecto schema"), (4, "in an Elixir umbrella app"), (5, "using Ecto schema (database layer)"), (6, "implementing a GenServer OTP process"), (7, "in Elixir/OTP"),
        (8, "using Angular (component)"), (9, "in TypeScript/Node.js"), (10, "using NestJS REST controller"), (11, "using React (functional component with hooks)"), (12, "using Vue 3 Composition API"), (13, "using Express.js"), (14, "using Prisma ORM"), (15, "using Next.js"),
        (16, "using Flask web framework"), (17, "using Django ORM model"), (18, "using Django REST Framework"), (19, "using Django"), (20, "using Celery for async tasks"), (21, "in a machine learning module"), (22, "in Python"),
        (23, "using Ruby on Rails (controller)"), (24, "using Sidekiq for background jobs"), (25, "using Laravel Eloquent ORM"), (26, "using Laravel controller"), (27, "using Spring Data repository"), (28, "using Android Fragment"), (29, "using Kotlin coroutines"),
        (30, "using Flutter StatefulWidget"), (31, "using Flutter Riverpod state management"), (32, "using SwiftUI View"), (33, "in Swift"), (34, "using Actix-web"), (35, "using SQLx"), (36, "using Gin web framework"), (37, "using gRPC"),
        (38, "using ASP.NET Core Web API"), (39, "using ASP.NET MVC Controller"), (40, "in xUnit/NUnit test"), (41, "defining Terraform infrastructure (IaC)"), (42, "defining Kubernetes manifest"), (43, "defining GitLab CI pipeline"), (44, "in YAML configuration"), (45, None), (46, "in Go"),
    )
)
def parser28_framework_rules(t: _Tables) -> DataFrame:
    """The rules of every language, where they fire, in order and joined."""
    told = {1: {"framework": "phoenix"}, 4: {"umbrella": "true"}}
    texts = [
        ("elixir", "use Phoenix.LiveView"), ("Elixir", "use Phoenix"), ("elixir", "use Phoenix\nuse Ecto\nschema \"x\""), ("elixir", "use GenServer"), ("elixir", "use Ecto.Schema"), ("elixir", "use GenServer\nuse Task"), ("elixir", "def x"),
        ("typescript", "@Component({selector: 'x'})"), ("typescript", "@Component({})"), ("javascript", "@Get('/')"), ("typescript", "useEffect()"), ("typescript", "ref(1)"), ("javascript", "express()"), ("typescript", "prisma"), ("typescript", "next/link"),
        ("python", "@app.route('/')"), ("python", "from django.db import models\nclass A(models.Model)"), ("python", "Django APIView"), ("python", "from django"), ("python", "celery pytest"), ("python", "import torch"), ("python", "x = 1"),
        ("ruby", "class A < ApplicationController"), ("ruby", "Sidekiq"), ("php", "Eloquent"), ("php", "extends Controller Route::"), ("java", "@Repository @Entity"), ("java", "extends Fragment"), ("kotlin", "suspend fun @RestController"),
        ("dart", "extends State<A>"), ("dart", "ref.watch"), ("swift", "struct A: View {"), ("swift", "View {"), ("rust", "#[get(\"/\")]"), ("rust", "sqlx"), ("go", "gin.Context"), ("go", "grpc.Dial"),
        ("csharp", "class A : ControllerBase"), ("csharp", "class A : Controller"), ("csharp", "[Fact]"), ("terraform", None), ("config", "apiVersion: v1"), ("config", "stages:\nscript:"), ("config", "stages:"), ("cobol", "x"), ("go", None),
    ]
    df = _frame(t, "n int, language string, content string, metadata map<string,string>", *[(i, a, b, told.get(i, {})) for i, (a, b) in enumerate(texts, 1)])
    return df.select("n", frameworks.framework(F.col("language"), F.col("content"), F.col("metadata")).alias("framework"))


_YAML = {
    "deploy/app.yml": "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: web\nspec:\n  x: 1\n---\napiVersion: v1\nkind: Service\nmetadata:\n  name: web\n",
    ".github/workflows/ci.yml": "name: Checks\non: push\njobs:\n  build:\n    runs-on: linux\n    steps:\n  test:\n    runs-on: linux\n",
    ".gitlab-ci.yml": "stages:\n  - a\nvariables:\n  X: 1\nbuild_app:\n  script:\n    - make\ndeploy-it:\n  script:\n    - ship\n",
    "docker-compose.yml": "services:\n  web:\n    image: x\n  db:\n    image: y\nvolumes:\n  data:\nnetworks:\n  front:\n",
    "chart/values.yaml": "replicas: 2\nimage:\n  tag: a\n",
    "conf/app.yaml": "server:\n  port: 1\nplain: 2\nlogging:\n  level: info\n",
}


@_query(
    _rows(
        "path, yaml_type, line_no, kind, name, qualified_name",
        ("deploy/app.yml", "kubernetes", 4, "resource", "web", "Deployment/web"), ("deploy/app.yml", "kubernetes", 11, "resource", "web", "Service/web"),
        (".github/workflows/ci.yml", "github_actions", 1, "workflow", "Checks", "Checks"), (".github/workflows/ci.yml", "github_actions", 4, "job", "build", "build"), (".github/workflows/ci.yml", "github_actions", 7, "job", "test", "test"),
        (".gitlab-ci.yml", "gitlab_ci", 5, "job", "build_app", "build_app"), (".gitlab-ci.yml", "gitlab_ci", 8, "job", "deploy-it", "deploy-it"),
        ("docker-compose.yml", "docker_compose", 2, "service", "web", "web"), ("docker-compose.yml", "docker_compose", 4, "service", "db", "db"), ("docker-compose.yml", "docker_compose", 7, "volume", "data", "data"), ("docker-compose.yml", "docker_compose", 9, "network", "front", "front"),
        ("chart/values.yaml", "helm", 1, "config", "replicas", "replicas"), ("chart/values.yaml", "helm", 2, "config", "image", "image"),
        ("conf/app.yaml", "generic", 1, "config", "server", "server"), ("conf/app.yaml", "generic", 4, "config", "logging", "logging"),
    )
)
def parser10_yaml_rules(t: _Tables) -> DataFrame:
    """The symbols of every type of YAML file."""
    return parsers.yaml_symbols(_frame(t, "path string, content string", *_YAML.items()))


@_query(
    _rows(
        "language, line_no, kind, name, visibility",
        ("rust", 1, "function", "open", "public"), ("rust", 2, "function", "shut", "private"), ("rust", 3, "struct", "Gate", "public"), ("rust", 4, "enum", "State", "private"), ("rust", 5, "trait", "Lock", "public"), ("rust", 6, "impl", "Gate", "public"),
        ("go", 1, "function", "Run", "public"), ("go", 2, "function", "run", "private"), ("go", 3, "struct", "gate", "public"), ("go", 4, "interface", "Lock", "public"), ("go", 5, "type", "ids", "public"),
        ("python", 1, "function", "go", "public"), ("python", 2, "function", "_go", "private"), ("python", 3, "class", "A", "public"), ("python", 4, "decorator", "app.task", "public"),
        ("typescript", 1, "class", "A", "public"), ("typescript", 2, "function", "f", "public"), ("typescript", 3, "function", "g", "private"), ("typescript", 4, "function", "h", "public"), ("typescript", 5, "interface", "I", "public"), ("typescript", 6, "type", "T", "public"), ("typescript", 7, "enum", "E", "public"), ("typescript", 8, "decorator", "Input", "public"),
        ("dart", 1, "class", "_Page", "public"), ("dart", 2, "mixin", "M", "public"), ("dart", 3, "extension", "X", "public"), ("dart", 4, "enum", "E", "public"), ("dart", 5, "type", "F", "public"), ("dart", 6, "function", "_load", "private"), ("dart", 7, "function", "Page", "public"),
        ("terraform", 1, "resource", "web", "public"), ("terraform", 2, "module", "net", "public"), ("terraform", 3, "variable", "size", "public"), ("terraform", 4, "output", "id", "public"), ("terraform", 5, "provider", "aws", "public"), ("terraform", 6, "data", "own", "public"), ("terraform", 7, "locals", "locals", "public"), ("terraform", 8, "terraform", "terraform", "public"),
        ("cobol", 1, "function", "f", "public"), ("cobol", 2, "class", "K", "public"),
    )
)
def parser2_line_rules(t: _Tables) -> DataFrame:
    """One line for each rule of the published families and of the fallback."""
    texts = {
        "rust": "pub fn open() {}\n  async fn shut() {}\npub struct Gate {}\nenum State {}\npub trait Lock {}\nimpl<T> Gate {}", "go": "func (g *Gate) Run() {}\nfunc run() {}\ntype gate struct {\ntype Lock interface {\ntype ids []int",
        "python": "async def go():\ndef _go(x):\nclass A(B):\n@app.task", "typescript": "export abstract class A {\nexport async function f() {\nfunction g() {\nexport const h = (x) => 1\ninterface I {\ntype T = A\nconst enum E {\n@Input()",
        "dart": "class _Page extends StatelessWidget {\nmixin M {\nextension X on String {\nenum E { a }\ntypedef F = int;\nFuture<int> _load(x) async {\nfactory Page.of(x)", "cobol": "def f\nstruct K",
        "terraform": 'resource "vm" "web" {\nmodule "net" {\nvariable "size" {\noutput "id" {\nprovider "aws" {\ndata "image" "own" {\nlocals {\nterraform {',
    }
    return parsers.line_symbols(_frame(t, "language string, content string", *texts.items())).select("language", "line_no", "kind", "name", "visibility")


@_query(
    _rows(
        "path, line_no, line_end, kind, qualified_name, widget",
        ("a.py", 1, 6, "class", "A", None), ("a.py", 2, 3, "function", "A.one", None), ("a.py", 4, 5, "class", "A.B", None), ("a.py", 5, 5, "function", "A.B.two", None), ("a.py", 6, 6, "function", "A.three", None), ("a.py", 7, None, "function", "four", None),
        ("b.ex", 1, None, "module", "Shop.Cart", None), ("b.ex", 2, 3, "function", "Shop.Cart.add", None), ("b.ex", 4, None, "function", "Shop.Cart.sum", None),
        ("c.dart", 1, 1, "class", "Home", "stateless_widget"), ("c.dart", 2, None, "class", "Note", "provider_notifier"), ("d.kt", 2, None, "class", "Thing", None), ("e.py", 3, None, "function", "odd", None),
    )
)
def parser17_nested_symbols(t: _Tables) -> DataFrame:
    """Symbols with their containers, ends and metadata; the last files fall back to the plain rules."""
    files = _frame(
        t, "path string, content string",
        ("a.py", "class A(X):\n    def one(self):\n        pass\n    class B(Y):\n        def two(self): pass\n    def three(self): pass\ndef four():\n    pass"), ("b.ex", "defmodule Shop.Cart do\n  def add(x) do\n  end\n  defp sum(x), do: x\nend"),
        ("c.dart", "class Home extends StatelessWidget {}\nclass Note with ChangeNotifier {}"), ("d.kt", "// " + "nothing of its own language stands here " * 2 + "\nstruct Thing"), ("e.py", "# " + "nothing the rules of its language know " * 2 + "\n\nfunction odd"), ("f.py", "function odd"), ("g.png", "class No"),
    )
    return parsers.parse(files).select("path", "line_no", "line_end", "kind", "qualified_name", F.try_element_at("metadata", F.lit("widget_type")).alias("widget"))


@_query(_rows("family, line_no, todo", ("default", 1, "// todo: a"), ("default", 3, "-- DEBT c"), ("generic", 1, "// todo: a"), ("elixir", 2, "x # BUG b"), ("terraform", 4, "# HACK d"), ("default", 4, "# HACK d"), ("generic", 4, "# HACK d"), ("elixir", 4, "# HACK d"), ("python", 4, "# HACK d"), ("typescript", 1, "// todo: a"), ("dart", 1, "// todo: a")))
def parser22_todo_families(t: _Tables) -> DataFrame:
    """Which markers count in which family: only in comments."""
    text = _frame(t, "content string", ("// todo: a\n  x # BUG b\n-- DEBT c\n# HACK d\nTODO e\n// TODOS f",))
    out = None
    for family in parsers.TODOS:
        part = parsers.todo_lines(text, family).select(F.lit(family).alias("family"), "line_no", "todo")
        out = part if out is None else out.unionByName(part)
    return out


@_query(_rows("id, chunk_index, content, line_start, token_count", ("a", 0, "aé\n", 1, 0), ("a", 1, "bü", 2, 0), ("b", 0, "日", 1, 0), ("b", 1, "", 1, 0)))
def c2_repaired_windows(t: _Tables) -> DataFrame:
    """Windows of four bytes, whose ends fall within characters."""
    texts = _frame(t, "id string, content string", ("a", "aé\nbü"), ("b", "日本"))
    cut = chunking.windows(texts, tokens=1, overlap=0, mode="bytes")
    return cut.select("id", "chunk_index", "content", "line_start", "token_count")


@_query(_rows("project_id, path, risk_score, rank", ("p", "c", 9.5, 1), ("p", "a", 7.0, 2), ("p", "b", 7.0, 3), ("q", "d", 5.5, 1)))
def m3_hotspot_rules(t: _Tables) -> DataFrame:
    """The riskiest files, ties by path, above 5 only."""
    files = _frame(t, "id string, project_id string, path string, risk_score double", ("1", "p", "a", 7.0), ("2", "p", "b", 7.0), ("3", "p", "c", 9.5), ("4", "q", "d", 5.5), ("5", "q", "e", 5.0), ("6", "q", "f", None), ("7", "p", "z", 6.0))
    return metrics.hotspots(files, most=3)


@_query(_rows("path, risky", ("a", "true"), ("b", "false"), ("c", "false")))
def m8_risky_files(t: _Tables) -> DataFrame:
    """The mark of risky files."""
    files = _frame(t, "project_id string, path string, language string, line_count int, risk_score double", ("p", "a", "go", 1, 10.5), ("p", "b", "go", 1, 10.0), ("p", "c", "go", 1, None))
    return metrics.file_listing(files).select("path", F.col("risky").cast("string").alias("risky"))


@_query(_rows("id", ("bare2",), ("full",), ("other",), ("none",)))
def j8_stale_symbol_rules(t: _Tables) -> DataFrame:
    """A bare name goes where a qualified twin stands in the same file."""
    symbols = _frame(t, "id string, file_id string, qualified_name string", ("bare", "f", "run"), ("full", "f", "App.run"), ("bare2", "g", "run"), ("other", "f", "rerun"), ("none", "f", None))
    return incremental.without_stale_symbols(symbols).select("id")


@_query(_rows("path", ("changed",), ("new",), ("nowhash",), ("lost",)))
def j10_changed_file_rules(t: _Tables) -> DataFrame:
    """Files whose hash differs from the stored one, null being a value of its own."""
    schema = "project_id string, path string, content_hash string"
    new = _frame(t, schema, ("p", "same", "1"), ("p", "changed", "2"), ("p", "new", "1"), ("p", "nowhash", "1"), ("p", "lost", None), ("p", "never", None))
    old = _frame(t, schema, ("p", "same", "1"), ("p", "changed", "1"), ("q", "new", "1"), ("p", "nowhash", None), ("p", "lost", "1"), ("p", "never", None))
    return incremental.changed_files(new, old).select("path")


@_query(_rows("id", ("missing",), ("old",), ("nohash",)))
def d10_summary_rules(t: _Tables) -> DataFrame:
    """Symbols whose summary is missing or old."""
    symbols = _frame(t, "id string, content string, summary string, summary_hash string", ("fresh", "abc", "s", "900150983CD24FB0D6963F7D28E17F72"), ("lower", "abc", "s", "900150983cd24fb0d6963f7d28e17f72"), ("missing", "abc", None, "900150983CD24FB0D6963F7D28E17F72"), ("old", "abd", "s", "900150983CD24FB0D6963F7D28E17F72"), ("nohash", "abc", "s", None))
    return incremental.needs_summary(symbols).select("id")


_EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "x"), ("g", "a")]


@_query(_rows("id, component", ("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")))
def g6_component_rules(t: _Tables) -> DataFrame:
    """Two cycles that hang together, a loop and two tails."""
    return graph.components(_frame(t, "src string, dst string", *_EDGES))


@_query(_rows("project_id, path, instability", ("p", "one", 0.25), ("p", "two", 0.5)))
def g7_cycle_report(t: _Tables) -> DataFrame:
    """Files with a symbol in a cycle."""
    symbols = _frame(t, "id string, file_id string", ("a", "f1"), ("b", "f1"), ("c", "f2"), ("f", "f3"))
    found = _frame(t, "file_id string, project_id string, instability double", ("f1", "p", 0.25), ("f2", "p", 0.5), ("f3", "p", 1.0))
    files = _frame(t, "id string, path string", ("f1", "one"), ("f2", "two"), ("f3", "three"))
    return metrics.cycle_report(found, files, symbols, graph.components(_frame(t, "src string, dst string", *_EDGES)))


@_query(_rows("src, dst, kind", ("a", "b", "imports"), ("c", "d", "imports"), ("x", "a", "imports")))
def g2_rebuilt_edges(t: _Tables) -> DataFrame:
    """Edges after one file changed: its old ones go, the new ones come."""
    schema = "src string, dst string, kind string"
    old = _frame(t, schema, ("a", "b", "imports"), ("x", "b", "imports"), ("b", "x", "imports"))
    return graph.rebuilt(old, _frame(t, schema, ("x", "a", "imports"), ("c", "d", "imports")), _frame(t, "id string", ("x",)))


@_query(_rows("project_id, src, dst", ("p", "1", "2"), ("p", "1", "3"), ("p", "3", "4"), ("p", "5", "6"), ("p", "7", "2")))
def g1_import_rules(t: _Tables) -> DataFrame:
    """Imports by relative, dotted and plain path."""
    files = [("1", "src/app/main.ts"), ("2", "src/lib/util.ts"), ("3", "src/app/page.ts"), ("4", "src/app/sub/a.ts"), ("5", "tool/run.py"), ("6", "tool/parts/load.py"), ("7", "src/x/y/z/deep.ts")]
    texts = {"1": 'import {a} from "../lib/util"\nimport b from "./page"\nimport x from "@scope/x"', "3": 'const s = require("./sub/a.ts")', "5": "from tool.parts.load import x\nimport os", "7": 'import u from "../../../lib/util"'}
    of = {"ts": "typescript", "py": "python"}
    made = _frame(t, "project_id string, path string, language string, content string", *[("p", path, of[path[-2:]], texts.get(i, "")) for i, path in files])
    return graph.import_edges(made, _frame(t, "id string, project_id string, path string", *[(i, "p", path) for i, path in files]))


@_query(
    "WITH l(engine, id, rank, w) AS (VALUES ('vector', 'a', 1, 0.55), ('vector', 'b', 2, 0.55), ('vector', 'c', 3, 0.55), ('bm25', 'b', 1, 0.25), ('bm25', 'd', 2, 0.25), ('graph', 'd', 1, 0.20), ('graph', 'b', 2, 0.20), ('graph', 'e', 3, 0.20)), "
    "s AS (SELECT id, sum(CAST(w AS DOUBLE) / (60 + rank)) AS total, string_agg(engine, ',' ORDER BY engine) AS engines FROM l GROUP BY id) SELECT 'q' AS query, id, CAST(row_number() OVER (ORDER BY total DESC, id) AS INTEGER) AS rank, round(total, 4) AS combined_score, engines FROM s QUALIFY rank <= 4"
)
def r5_fusion_rules(t: _Tables) -> DataFrame:
    """Three engines' lists that overlap, fused."""
    of = lambda *rows: _frame(t, "query string, id string, score double", *[("q", i, s) for i, s in rows])
    return retrieval.fuse({"vector": of(("a", 0.9), ("b", 0.8), ("c", 0.7)), "bm25": of(("d", 3.0), ("b", 5.0)), "graph": of(("e", 0.3), ("d", 0.9), ("b", 0.6))}, k=4)


@_query(_rows("query, id, score", ("q1", "b", 0.9), ("q1", "c", 0.9), ("q1", "d", 0.6), ("q1", "e", 0.3), ("q2", "b", 0.6), ("q2", "d", 0.9), ("q2", "a", 0.3)))
def r4_graph_rules(t: _Tables) -> DataFrame:
    """What stands near the shortest name that contains a text, by steps; a text that none contains gives nothing."""
    symbols = _frame(t, "id string, name string, qualified_name string", ("a", "CacheX", None), ("z", "long_cache", None), ("b", "x", None), ("c", "y", None), ("d", "w", None), ("e", "v", "M.Queue"), ("f", "u", None))
    edge = _frame(t, "src string, dst string, kind string", ("a", "b", "calls"), ("c", "a", "calls"), ("b", "d", "calls"), ("d", "e", "calls"), ("e", "d", "uses"), ("f", "f", "calls"))
    return retrieval.graph_search([("q1", "cache"), ("q2", "queue"), ("q3", "none")], symbols, edge)


_RESULTS = [("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q1", "d", 6), ("q2", "x", 1), ("q2", "y", 2)]
_JUDGED = [("q1", "b"), ("q1", "d"), ("q1", "z"), ("q3", "m")]


@_query(_rows("query, precision_at_k, recall_at_k, mrr", ("q1", 0.2, 0.333333, 0.5), ("q2", 0.0, 0.0, 0.0), ("q3", 0.0, 0.0, 0.0)))
def r12_evaluation_rules(t: _Tables) -> DataFrame:
    """A query with hits below and above the cut, one without relevant results, one without results."""
    per = retrieval.evaluate(_frame(t, "query string, id string, rank int", *_RESULTS), _frame(t, "query string, id string", *_JUDGED))
    return per.select("query", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr")])


@_query("SELECT 0.067 AS precision_at_k, 0.111 AS recall_at_k, 0.167 AS mrr")
def a13_averages(t: _Tables) -> DataFrame:
    """Their means, three decimals."""
    return retrieval.averages(retrieval.evaluate(_frame(t, "query string, id string, rank int", *_RESULTS), _frame(t, "query string, id string", *_JUDGED)))


@_query(_rows("project_id, namespace, symbols", ("p", "App", 2), ("p", "Lib", 1), ("q", "App", 1)))
def g10_namespace_rules(t: _Tables) -> DataFrame:
    """Symbols by the first part of their names."""
    return graph.module_tree(_frame(t, "project_id string, qualified_name string", ("p", "App.A"), ("p", "App"), ("p", "Lib.x.y"), ("q", "App.z"), ("q", None)))


@_query(_rows("n, name, arity, answer, fresh", (1, "run", 2, "Hello", "true"), (2, "a/b", None, "plain text", "false"), (3, "x/y", 10, None, "false"), (4, "plain", None, None, "false")))
def x16_scalar_rules(t: _Tables) -> DataFrame:
    """Arities, answers and freshness."""
    rows = _frame(t, "n int, name string, response string, age int", (1, "run/2", '{"content": " Hello "}', 10), (2, "a/b", "  plain text ", 60), (3, "x/y/10", '{"other": 1}', -5), (4, "plain", "  ", 3600))
    name, number = T.arity(F.col("name"))
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    return rows.select("n", name.alias("name"), number.alias("arity"), T.answer_text(F.col("response")).alias("answer"), T.fresh(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("age")), now).cast("string").alias("fresh"))


@_query(_rows("table_name, key, value, kept", ("upsert", "a", 2, 7), ("upsert", "b", 1, 8), ("upsert", "c", 3, 9), ("insert", "a", 1, 7), ("insert", "b", 1, 8), ("insert", "c", 3, 9), ("without", "a", 1, 7)))
def d4_write_rules(t: _Tables) -> DataFrame:
    """Writing over with a kept column, inserting what is new, and deleting a project."""
    schema = "project_id string, key string, value int, kept int"
    old = _frame(t, schema, ("p", "a", 1, 7), ("q", "b", 1, 8))
    new = _frame(t, schema, ("p", "a", 2, 99), ("p", "c", 3, 9))
    out = None
    for name, df in (("upsert", incremental.upsert(old, new, ["project_id", "key"], ["kept"])), ("insert", incremental.insert_new(old, new, ["project_id", "key"])), ("without", incremental.without_project(old, "q"))):
        part = df.select(F.lit(name).alias("table_name"), "key", "value", "kept")
        out = part if out is None else out.unionByName(part)
    return out


@_query(_rows("folder", ("node_modules",), ("out",), ("logs",), ("cache",)))
def s4_ignored_folders(t: _Tables) -> DataFrame:
    """What a .gitignore excludes."""
    return parsers.gitignore_folders(_frame(t, "value string", ("# x",), ("",), ("*.log",), ("node_modules/",), ("**/out",), ("/logs/",), ("!keep",), ("cache/tmp/x",), ("out",)))


@_query(_rows("path, language, supported, is_binary, ignored", ("a/b.TS", "typescript", "true", "false", "false"), ("deps/x.go", "go", "true", "false", "true"), ("logo.png", "unknown", "false", "true", "false"), ("x/yarn.lock", "unknown", "false", "false", "true"), ("Makefile", "unknown", "false", "false", "false"), (".env", "unknown", "false", "false", "false")))
def s6_path_rules(t: _Tables) -> DataFrame:
    """What paths tell."""
    rows = _frame(t, "path string", ("a/b.TS",), ("deps/x.go",), ("logo.png",), ("x/yarn.lock",), ("Makefile",), (".env",))
    path = F.col("path")
    return rows.select("path", parsers.language(path).alias("language"), *[f(path).cast("string").alias(n) for n, f in (("supported", parsers.supported), ("is_binary", parsers.binary), ("ignored", sources.ignored))])
