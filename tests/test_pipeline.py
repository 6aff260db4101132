import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.plans import lineage, pipeline
from corvane.sources import files as sources
from corvane.streaming import watch


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "lib").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "mix.exs").write_text("defmodule Shop.MixProject do\nend\n")
    (root / "lib/cart.ex").write_text("defmodule Shop.Cart do\n  def add(x) do\n    x\n  end\nend\n")
    (root / "lib/pay.py").write_text("class Pay:\n    def go(self):\n        return 1\n" + "# filler\n" * 400)
    (root / "node_modules/x.js").write_text("function x() {}")
    return root


def test_only_changes_are_written(spark, tree, tmp_path):
    store = pipeline.Store(spark, str(tmp_path / "store"))
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    assert pipeline.index_tree(spark, str(tree), "p", store, provider) == {"changed": 3, "deleted": 0}
    names = {(r.path, r.qualified_name, r.line_start, r.line_end) for r in store.current("symbols").collect()}
    assert ("lib/cart.ex", "Shop.Cart.add", 2, 6) in names and ("lib/pay.py", "Pay.go", 2, 404) in names and not any("node_modules" in n[0] for n in names)
    chunks = store.current("chunks")
    assert chunks.filter("path = 'lib/pay.py'").count() == 3 and chunks.filter("embedding is null").count() == 0
    first, before = asked.value, {n: store.read(n).count() for n in pipeline.TABLES}

    assert pipeline.index_tree(spark, str(tree), "p", store, provider) == {"changed": 0, "deleted": 0}
    assert asked.value == first and {n: store.read(n).count() for n in pipeline.TABLES} == before  # nothing was written

    (tree / "lib/cart.ex").write_text("defmodule Shop.Cart do\n  def take(x) do\n    x\n  end\nend\n")
    assert pipeline.index_tree(spark, str(tree), "p", store, provider) == {"changed": 1, "deleted": 0}
    assert store.read("chunks").count() == before["chunks"] + 1 and store.read("files").count() == before["files"] + 1
    own = {r.qualified_name for r in store.current("symbols").filter("path = 'lib/cart.ex'").collect()}
    assert own == {"Shop.Cart", "Shop.Cart.take"}

    (tree / "lib/pay.py").unlink()
    assert pipeline.index_tree(spark, str(tree), "p", store, provider) == {"changed": 0, "deleted": 1}
    assert {r.path for r in store.files().collect()} == {"mix.exs", "lib/cart.ex"} == {r.path for r in store.current("chunks").collect()}
    small = pipeline.compacted(store, str(tmp_path / "small"))
    assert {r.qualified_name for r in small.current("symbols").collect()} == {r.qualified_name for r in store.current("symbols").collect()}
    assert small.read("files").count() == 2 and small.read("chunks").count() == 2
    lineage.drop_written()


def test_limits_of_a_scan_tell_what_they_leave_out(spark, tree):
    everything = sources.scan(spark, str(tree), "p").collect()
    assert {r.path for r in everything} == {"mix.exs", "lib/cart.ex", "lib/pay.py"} and not any(r.left_out for r in everything)
    told = {r.path: r.left_out for r in sources.scan(spark, str(tree), "p", max_depth=1, max_bytes=10**6).collect()}
    assert told == {"mix.exs": None, "lib/cart.ex": "too deep", "lib/pay.py": "too deep"}
    told = {r.path: (r.left_out, r.content is None) for r in sources.scan(spark, str(tree), "p", max_files=1, max_bytes=1000).collect()}
    assert told == {"lib/cart.ex": (None, False), "mix.exs": ("too many", True), "lib/pay.py": ("too large", True)}


def test_events_are_indexed_as_they_come(spark, tree, tmp_path):
    store = pipeline.Store(spark, str(tmp_path / "store"))
    pipeline.index_tree(spark, str(tree), "p", store)
    events, seen = tmp_path / "events", tmp_path / "checkpoint"
    events.mkdir()
    say = lambda name, *rows: (events / name).write_text("".join(json.dumps({"project_id": "p", "path": p, "event": e, "ts": t}) + "\n" for p, e, t in rows))
    (tree / "lib/cart.ex").write_text("defmodule Shop.Cart do\n  def drop(x), do: x\nend\n")
    say("1.json", ("lib/cart.ex", "modified", "2026-01-01T00:00:00Z"), ("lib/cart.ex", "modified", "2026-01-01T00:00:01Z"), ("node_modules/x.js", "modified", "2026-01-01T00:00:01Z"), ("lib/pay.py", "opened", "2026-01-01T00:00:01Z"))
    say("2.json", ("lib/pay.py", "modified", "2026-01-01T01:00:00Z"))  # later events let the watermark pass
    say("3.json", ("mix.exs", "modified", "2026-01-01T02:00:00Z"))

    def run():
        watch.re_index(watch.events_of(spark, str(events), 1), {"p": str(tree)}, store, str(seen)).awaitTermination()

    run()
    assert {r.qualified_name for r in store.current("symbols").filter("path = 'lib/cart.ex'").collect()} == {"Shop.Cart", "Shop.Cart.drop"}
    written = store.read("files").count()
    (tree / "lib/pay.py").unlink()
    say("4.json", ("lib/pay.py", "modified", "2026-01-01T03:00:00Z"))
    say("5.json", ("mix.exs", "modified", "2026-01-01T04:00:00Z"))
    run()
    assert "lib/pay.py" not in {r.path for r in store.files().collect()} and store.read("files").count() == written + 1
    lineage.drop_written()


def test_shedding_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "path string, ts int")
    kept, dropped = watch.shed(df, 2)
    assert [r.path for r in kept.collect()] == ["b", "c"] and [r.path for r in dropped.collect()] == ["a"]


def test_a_long_chain_of_cycles(spark):
    edges = [(f"n{i:02}", f"n{i ^ 1:02}") for i in range(24)] + [(f"n{i:02}", f"n{i + 2:02}") for i in range(0, 22, 2)]
    got = {(r.id, r.component) for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {(f"n{i:02}", f"n{i // 2 * 2:02}") for i in range(24)}


def test_forbidden_and_sensitive_places(tmp_path, monkeypatch):
    for place in ("/etc", "/proc/1", "/var", "/"):
        with pytest.raises(PermissionError):
            sources.check_root(place, force=True)
    monkeypatch.setenv("HOME", str(tmp_path))
    (tmp_path / ".ssh/x").mkdir(parents=True)
    (tmp_path / "app").mkdir()
    with pytest.raises(PermissionError):
        sources.check_root(str(tmp_path / ".ssh/x"), force=True)
    with pytest.raises(ValueError):
        sources.check_root(str(tmp_path / "app"))
    assert sources.check_root(str(tmp_path / "app"), force=True) == tmp_path / "app"
    (tmp_path / "app/go.mod").write_text("")
    assert sources.check_root(str(tmp_path / "app")) == tmp_path / "app"


def test_a_provider_parses_what_it_can(spark):
    from corvane.operators import parsers

    files = spark.createDataFrame([("a.py", "def one(): pass"), ("b.py", "def two(): pass")], "path string, content string")
    own = lambda lang, text: [{"line_no": 1, "line_end": 1, "kind": "function", "name": "own", "qualified_name": "M.own", "visibility": "public"}] if "one" in text else None
    got = {(r.path, r.qualified_name) for r in parsers.parse(files, provider=own).collect()}
    assert got == {("a.py", "M.own"), ("b.py", "two")}
    assert parsers.parse(files.limit(0)).count() == 0 and parsers.parse(files.filter(F.lit(False)), provider=own).count() == 0
