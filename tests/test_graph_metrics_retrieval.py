import itertools

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, incremental, metrics, retrieval, tools
from corvane.streaming import watch


def edge(spark, *pairs):
    return spark.createDataFrame([(a, b, "imports") for a, b in pairs], "src string, dst string, kind string")


def test_impact_and_cycles(spark):
    e = edge(spark, "ab", "bc", "ca", "cd")
    seed = spark.createDataFrame([("a",)], "seed string")
    assert {r.id for r in graph.impact(e, seed, 3).collect()} == {"b", "c", "d"}
    assert {r.id for r in graph.impact(e, seed, 3, "in").collect()} == {"b", "c"}
    assert {(r.id, r.hop) for r in graph.expand(e, seed, 1).collect()} == {("b", 1), ("c", 1)}
    assert {(r.id, r.component) for r in graph.components(e).collect()} == {(x, "a") for x in "abc"}
    assert graph.components(edge(spark, "ab", "bc")).count() == 0
    two = edge(spark, "ab", "ba", "bc", "cd", "dc", "xx")
    assert {(r.id, r.component) for r in graph.components(two).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}


def test_coupling(spark):
    files = spark.createDataFrame([("f", "p", 10), ("g", "p", None), ("h", "p", 5)], "id string, project_id string, line_count int")
    symbols = spark.createDataFrame([("a", "f", "TODO"), ("b", "f", "x"), ("c", "g", None)], "id string, file_id string, content string")
    rows = {r.file_id: r for r in metrics.coupling(files, symbols, edge(spark, "ac", "bc", "ab")).collect()}
    assert (rows["f"].afferent, rows["f"].efferent, rows["f"].todos, rows["f"].complexity) == (1, 2, 1, 5.0)
    assert (rows["g"].afferent, rows["g"].efferent, rows["g"].instability, rows["g"].debt) == (2, 0, 0.0, 2.0)
    assert (rows["h"].symbols, rows["h"].complexity) == (0, 5.0)
    assert {r.file_id: r.efferent for r in metrics.coupling(files, symbols, edge(spark, "ac", "bc", "ab"), exclude_intra_file=True).collect()}["f"] == 1
    assert {r.file_id: r.todos for r in metrics.coupling(files, symbols, edge(spark, "ac"), strict=True).collect()}["f"] == 2


def test_usage_golden(spark):
    calls = spark.createDataFrame([("p", "search", "success", "x" * 40, 25), ("p", "search", "error", None, 15), ("p", "search", "timeout", None, 30_000), ("q", "search", "odd", "", -5)], "project_id string, tool_name string, status string, response string, duration_ms bigint")
    kb = spark.createDataFrame([("p", 100)], "project_id string, kb_tokens bigint")
    events = metrics.record_calls(calls, kb).withColumn("inserted_at", F.current_timestamp())
    r = {x.project_id: x for x in metrics.usage_snapshot(events).collect()}["p"]
    assert (r.calls, r.success, r.error, r.timeout, r.response_tokens, r.saved_tokens, r.total_ms, r.max_ms, r.success_rate) == (3, 1, 1, 1, 10, 90, 30_040, 30_000, 33.3)
    q = {x.project_id: x for x in metrics.usage_snapshot(events).collect()}["q"]
    assert (q.error, q.total_ms, q.saved_tokens) == (1, 0, 0)


def test_fusion(spark):
    make = lambda *rows: spark.createDataFrame(list(rows) or [], "query string, id string, score double")
    v, b, g = make(("q", "a", 0.9), ("q", "b", 0.8)), make(("q", "a", 3.0)), make(("q", "c", 0.9))
    rows = retrieval.fuse({"vector": v, "bm25": b, "graph": g}).orderBy("rank").collect()
    assert rows[0].id == "a" and rows[0].combined_score == 0.0131 and rows[0].engines == "bm25,vector" and len(rows) == 3
    assert retrieval.fuse({"vector": make(), "bm25": make()}).count() == 0


def test_vector_search_is_exact_and_tolerant(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [1.0]), (503, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(5)], "query string, vector array<double>")
    got = retrieval.vector_search(asked, df, 4, size=8).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(5):
        want = sorted(range(200), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:4]
        assert [r.id for r in sorted((r for r in got if r.query == f"q{i}"), key=lambda r: (-r.score, r.id))] == want
    assert retrieval.vector_search(asked.limit(0), df, 4, size=8).count() == 0


def test_bm25(spark):
    df = spark.createDataFrame([("1", "cache", "store", "cache lookup table"), ("2", "x", "y", "lookup of a cached value"), ("3", "z", None, None)], "id string, name string, qualified_name string, content string")
    got = retrieval.bm25_search([("q", "Cache lookup!"), ("none", "?!")], df, ["name", "qualified_name", "content"], ["name", "content"])
    rows = got.collect()
    assert [r.id for r in sorted(rows, key=lambda r: -r.score)] == ["1", "2"] and all(r.score > 0 for r in rows)
    assert retrieval.bm25_search([("q", "")], df, ["name"], ["name"]).count() == 0


def test_evaluation(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("n", "x", 1)], "query string, id string, rank int")
    relevant = spark.createDataFrame([("q", "c"), ("n", "y")], "query string, id string")
    r = {x.query: x for x in retrieval.evaluate(results, relevant, 3).collect()}
    assert abs(r["q"].precision_at_k - 1 / 3) < 1e-9 and abs(r["q"].mrr - 1 / 3) < 1e-9 and r["q"].recall_at_k == 1.0
    assert (r["n"].precision_at_k, r["n"].mrr) == (0.0, 0.0)


def test_incremental(spark):
    old = spark.createDataFrame([("p", "a", "h1", 1), ("p", "b", None, 1)], "project_id string, path string, content_hash string, updated_at int")
    new = spark.createDataFrame([("p", "a", "h1", 2), ("p", "b", "h2", 2), ("p", "c", None, 2), ("p", "c", None, 3)], old.schema)
    assert sorted(r.path for r in incremental.changed_files(new, old).collect()) == ["b", "c", "c"]
    up = {(r.path, r.updated_at) for r in incremental.upsert(old, new, ["project_id", "path"]).collect()}
    assert up == {("a", 2), ("b", 2), ("c", 3)}
    keep = {r.path: r.content_hash for r in incremental.upsert(old, new, ["project_id", "path"], ["content_hash"]).collect()}
    assert keep == {"a": "h1", "b": "h2", "c": None}
    assert incremental.insert_new(old, new, ["project_id", "path"]).count() == 3
    assert incremental.without_project(old, "p").count() == 0
    good, bad = incremental.validate(new, ["content_hash"], {"path": ["a", "b"]}, ["updated_at"])
    assert good.count() == 2 and {tuple(r.reasons) for r in bad.collect()} == {("content_hash is missing", "path is not allowed")}


def test_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",), (None,)], "text string")
    empty = spark.createDataFrame([], "content_hash string, embedding array<float>, cached_at timestamp")
    filled = incremental.fill_cache(texts, empty, lambda batch: [None if t == "d" else [1.0] for t in batch])
    assert filled.count() == 3
    assert tuple(incremental.cache_stats(incremental.cache_lookup(texts, filled)).first()) == (6, 4, 2)


def test_streams(spark, tmp_path):
    rows = [("p", "a.ex", "modified", "2024-01-01 00:00:00"), ("p", "a.ex", "modified", "2024-01-01 00:00:01"), ("p", "b.ex", "created", "2024-01-01 00:00:05"), ("p", "x.png", "modified", "2024-01-01 00:00:05"), ("p", "a.ex", "modified", "2024-01-01 01:00:00")]
    events = spark.createDataFrame(rows, "project_id string, path string, event string, ts string").withColumn("ts", F.to_timestamp("ts"))
    quiet = watch.debounce(watch.relevant(events), ["project_id", "path"])
    assert sorted((r.path, r.events) for r in quiet.collect()) == [("a.ex", 1), ("a.ex", 2), ("b.ex", 1)]
    got = watch.batches(watch.relevant(events), gap="10 seconds", by=["project_id"]).collect()
    assert sorted(r.paths for r in got) == [["a.ex"], ["a.ex", "b.ex"]]
    events.write.parquet(str(tmp_path / "in"))
    stream = watch.debounce(watch.relevant(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), ["project_id", "path"])
    q = stream.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.path, r.events) for r in spark.table("quiet").collect()) == [("a.ex", 2), ("b.ex", 1)]  # the last period is still open
    kept, dropped = watch.shed(events, 2)
    assert (kept.count(), dropped.count()) == (2, 3)


def test_guards():
    for bad in ("", " ", "x" * 201):
        with pytest.raises(ValueError):
            tools.checked_query(bad)
    for bad in ("/a", "a/../b"):
        with pytest.raises(ValueError):
            tools.checked_path(bad)


def test_components_by_brute_force(spark):
    import random

    rng = random.Random(3)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    e = spark.createDataFrame([(a, b, "k") for a, b in pairs], "src int, dst int, kind string")
    reach = {(a, b) for a, b in pairs}
    for _ in range(6):
        reach |= {(a, d) for (a, b), (c, d) in itertools.product(reach, reach) if b == c}
    want = {(a, min(b for b in range(30) if (a, b) in reach and (b, a) in reach)) for a in range(30) if any((a, b) in reach and (b, a) in reach and a != b for b in range(30))}
    assert {(r.id, r.component) for r in graph.components(e).collect()} == {(a, min(a, c)) for a, c in want}


def test_import_graph(spark):
    files = spark.createDataFrame([("1", "p", "src/app/main.ts"), ("2", "p", "src/lib/util.ts"), ("3", "p", "pkg/tool/run.py"), ("4", "p", "pkg/other.py"), ("5", "q", "src/lib/util.ts")], "id string, project_id string, path string")
    sources = spark.createDataFrame([("p", "src/app/main.ts", "typescript", 'import x from "../lib/util"'), ("p", "pkg/other.py", "python", "from tool.run import go\nimport pkg.other"), ("p", "pkg/tool/run.py", None, None)], "project_id string, path string, language string, content string")
    assert {(r.src, r.dst) for r in graph.import_edges(sources, files).collect()} == {("1", "2"), ("4", "3")}


def test_import_graph_of_deep_trees(spark):
    deep = "/".join(f"d{i}" for i in range(10))
    files = spark.createDataFrame([("1", "p", "src/main/java/com/acme/shop/core/data/model/base/Order.java"), ("2", "p", "src/main/java/App.java"), ("3", "p", f"{deep}/a.ts"), ("4", "p", "util.ts"), ("5", "p", ".hid/b.ts")], "id string, project_id string, path string")
    sources = spark.createDataFrame([("p", "src/main/java/App.java", "python", "import com.acme.shop.core.data.model.base.Order"), ("p", f"{deep}/a.ts", "typescript", f'import x from "{"../" * 10}util"'), ("p", ".hid/b.ts", "typescript", 'import x from "../util"')], "project_id string, path string, language string, content string")
    assert {(r.src, r.dst) for r in graph.import_edges(sources, files).collect()} == {("2", "1"), ("3", "4"), ("5", "4")}


def test_project_frameworks(spark):
    from corvane.operators import parsers

    rows = [("a", "mix.exs", "{:phoenix}"), ("b", "package.json", "{}"), ("c", "requirements.txt", "flask"), ("d", "x.py", "django"), ("e", "Gemfile", None)]
    got = {r.project_id: r.framework for r in parsers.project_frameworks(spark.createDataFrame(rows, "project_id string, path string, content string")).collect()}
    assert got == {"a": "Elixir/Phoenix", "b": "Node.js/TypeScript", "c": "Python/Flask", "e": "Ruby"}


def test_approximate_search(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *(x[:60] + rng.standard_normal((60, 64)) * 0.2)])] + [(999, None)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "query int, vector array<double>")
    want = {(r.query, r.id) for r in retrieval.vector_search(asked, df, 10).filter("score >= 0.9").collect()}
    got = {(r.query, r.id) for r in retrieval.approximate_search(asked, df).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_recall_counts_all_relevant_symbols(spark, tmp_path):
    from corvane.plans import queries

    rows = [(f"s{i:02d}", f"queue{i}", f"m.queue{i}", "f()", "queue", "queue", 1, 1) for i in range(40)] + [("none", "other", "m.other", "f()", "x", "x", 1, 1)]
    columns = "id string, name string, qualified_name string, signature string, docstring string, content string, updated_at int, inserted_at int"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/symbols.parquet")
    got = {r.query: r for r in queries.queries()["r11_evaluation"](spark, str(tmp_path)).collect()}
    assert got["q4"].recall_at_k == 5 / 40 and got["q4"].precision_at_k == 1 and got["q4"].mrr == 1


def test_project_audit_counts_cycles(spark, tmp_path):
    from corvane.plans import queries

    symbols = spark.createDataFrame([(x, "p" if x in "abc" else "q", "function", "x", 1, 1) for x in "abcd"], "id string, project_id string, kind string, content string, updated_at int, inserted_at int")
    symbols.selectExpr("*", "cast(null as array<float>) as embedding", "cast(null as string) as summary").write.parquet(f"{tmp_path}/symbols.parquet")
    edges = [(f"e{i}", a, b, None, None, "calls", 1, 1) for i, (a, b) in enumerate(["ab", "ba", "bc", "cd"])]
    spark.createDataFrame(edges, "id string, from_id string, to_id string, from_file_id string, to_file_id string, kind string, updated_at int, inserted_at int").write.parquet(f"{tmp_path}/relationships.parquet")
    assert {r.project_id: r.in_cycle for r in queries.queries()["m4_project_audit"](spark, str(tmp_path)).collect()} == {"p": 2, "q": 0}
