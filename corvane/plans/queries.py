"""Queries over a code index, by name, with the SQL they are checked against.

tables; rows with one id count once, the latest delivery.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import chunking, frameworks, graph, incremental, metrics, parsers, retrieval, tools
from corvane.plans import sql as S
from corvane.sources import files as sources
from corvane.sources.tables import delivered, latest, table
from corvane.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: The texts of the search queries: (name, text).
TEXTS = [("q1", "cache lookup"), ("q2", "merge session"), ("q3", "token"), ("q4", "queue"), ("q5", "export report")]


class _Tables:
    """The tables of a folder, latest deliveries only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        rows = delivered(self.spark, self.folder, "mcp_usage_events" if name == "usage" else name)
        return latest(rows, ["id"], ["updated_at", "inserted_at", "_delivery"], tie=[]).drop("_delivery")  # equal times: what is stored last


def _query(sql: str | None = None) -> Callable[[Callable[[_Tables], DataFrame]], Query]:
    def register(build: Callable[[_Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(_Tables(spark, folder))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        _QUERIES[build.__name__] = run
        if sql:
            _SQL[build.__name__] = sql
        return run

    return register


# Text and chunks


@_query("SELECT id, sha256(content) AS content_hash, upper(md5(content)) AS summary_hash FROM " + S.last("symbols"))
def x5_hashes(t: _Tables) -> DataFrame:
    """Content and summary hashes of symbols."""
    return t.symbols.select("id", T.content_hash(F.col("content")).alias("content_hash"), T.summary_hash(F.col("content")).alias("summary_hash"))


@_query("SELECT id, CAST(floor(length(content) / 4) AS BIGINT) AS floor_tokens, CAST(ceil(length(content) / 4) AS BIGINT) AS ceil_tokens, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count FROM " + S.last("chunks"))
def c7_token_estimates(t: _Tables) -> DataFrame:
    """Token estimates and line counts of chunks."""
    return t.chunks.select("id", T.floor_tokens(F.col("content")).alias("floor_tokens"), T.ceil_tokens(F.col("content")).alias("ceil_tokens"), T.line_count(F.col("content")).cast("bigint").alias("line_count"))


@_query("SELECT id, concat_ws(' ', kind, qualified_name, signature, docstring, substring(content, 1, 600)) AS embed_text FROM " + S.last("symbols"))
def c9_embed_text(t: _Tables) -> DataFrame:
    """What is embedded for each symbol."""
    return t.symbols.select("id", T.embed_text(*map(F.col, ("kind", "qualified_name", "signature", "docstring", "content"))).alias("embed_text"))


@_query("SELECT id, replace(substring(content, 1, 150), chr(10), ' ') AS preview FROM " + S.last("chunks"))
def c10_preview(t: _Tables) -> DataFrame:
    """Previews of chunks."""
    return t.chunks.select("id", T.preview(F.col("content"), 150).alias("preview"))


@_query("SELECT id, CASE WHEN 2 <= len(string_split(content, chr(10))) THEN array_to_string(list_slice(string_split(content, chr(10)), 2, 3), chr(10)) ELSE '' END AS snippet FROM " + S.last("symbols"))
def c11_snippet(t: _Tables) -> DataFrame:
    """The second and third line of each symbol."""
    return t.symbols.select("id", T.snippet(F.col("content"), F.lit(2)).alias("snippet"))


@_query(
    "SELECT doc_id, CAST(o / 1792 AS INTEGER) AS chunk_index, substring(text, o + 1, 2048) AS content, CAST(length(substring(text, 1, o)) - length(replace(substring(text, 1, o), chr(10), '')) + 1 AS INTEGER) AS line_start, CAST(floor(length(substring(text, o + 1, 2048)) / 4) AS INTEGER) AS token_count "
    "FROM (SELECT doc_id, text, CAST(unnest(generate_series(0, length(text) - 1, 1792)) AS INTEGER) AS o FROM documents WHERE length(text) > 0)"
)
def c1_windows(t: _Tables) -> DataFrame:
    """Overlapping windows of documents."""
    return chunking.windows(t.raw("documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "chunk_index", "content", "line_start", "token_count")


@_query()
def c1_windows_bytes(t: _Tables) -> DataFrame:
    """The same by bytes, tails repaired."""
    return chunking.windows(t.raw("documents").select("doc_id", F.col("text").alias("content")), mode="bytes")


@_query(
    "SELECT id, CAST(o / 41 AS INTEGER) AS chunk_index, array_to_string(list_slice(l, o + 1, o + 51), chr(10)) AS content, CAST(o + 1 AS INTEGER) AS line_start, CAST(o + 51 AS INTEGER) AS line_end "
    "FROM (SELECT id, l, CAST(unnest(generate_series(0, len(l) - 51, 41)) AS INTEGER) AS o FROM (SELECT id, string_split(content, chr(10)) AS l FROM " + S.last("chunks") + ") WHERE len(l) >= 51)"
)
def c4_line_windows(t: _Tables) -> DataFrame:
    """Windows of 51 lines."""
    return chunking.line_windows(t.chunks.select("id", "content")).select("id", "chunk_index", "content", "line_start", "line_end")


@_query()
def c6_plain_windows(t: _Tables) -> DataFrame:
    """Windows of documents without overlap."""
    return chunking.plain_windows(t.raw("documents").select("doc_id", F.col("text").alias("content")))


@_query(
    "WITH s AS (SELECT id, content, string_split(content, chr(10)) AS l FROM " + S.last("symbols") + " WHERE length(content) > 0) SELECT id, 0 AS chunk_index, content, 1 AS first, CAST(len(l) AS INTEGER) AS last, CAST(floor(length(content) / 4) AS INTEGER) AS token_count FROM s WHERE floor(length(content) / 4) <= 512 "
    "UNION ALL SELECT id, CAST(o / 41 AS INTEGER), c, CAST(o + 1 AS INTEGER), CAST(o + 51 AS INTEGER), CAST(floor(length(c) / 4) AS INTEGER) FROM (SELECT id, o, array_to_string(list_slice(l, o + 1, o + 51), chr(10)) AS c FROM (SELECT id, l, CAST(unnest(generate_series(0, len(l) - 51, 41)) AS INTEGER) AS o FROM s WHERE floor(length(content) / 4) > 512 AND len(l) >= 51))"
)
def c3_symbol_chunks(t: _Tables) -> DataFrame:
    """Chunks of symbols."""
    return chunking.symbol_chunks(t.symbols.select("id", "content")).select("id", "chunk_index", "content", "first", "last", "token_count")


@_query("SELECT id, CASE WHEN size_bytes IS NULL THEN '0 B' WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576) ELSE printf('%.1f GB', size_bytes / 1073741824) END AS size FROM " + S.last("files"))
def x10_human_sizes(t: _Tables) -> DataFrame:
    """File sizes for readers."""
    return t.files.select("id", T.human_bytes(F.col("size_bytes")).alias("size"))


@_query("SELECT id, CASE WHEN length(args) > 40 THEN substring(args, 1, 40) || '...[truncated]' ELSE args END AS args, CASE lower(trim(tool_name)) WHEN 'find' THEN 'search' WHEN 'sym' THEN 'symbol' WHEN 'ctx' THEN 'context' WHEN 'ls' THEN 'files' ELSE lower(trim(tool_name)) END AS tool FROM " + S.last("mcp_usage_events"))
def x12_call_arguments(t: _Tables) -> DataFrame:
    """Shortened arguments and plain tool names."""
    return t.usage.select("id", T.shortened_json(F.col("args"), 40).alias("args"), T.tool_name(F.col("tool_name")).alias("tool"))


# Sources and parsers


@_query("SELECT id, " + S.case("lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1))", {f".{e}": lang for lang, es in parsers.LANGUAGES.items() for e in es.split()}, "unknown") + " AS by_path FROM " + S.last("files"))
def s7_language_by_path(t: _Tables) -> DataFrame:
    """Languages by extension."""
    return t.files.select("id", parsers.language(F.col("path")).alias("by_path"))


@_query("SELECT id, list_has_any(string_split(path, '/'), " + S.listed(sources.IGNORED) + ") AS ignored FROM " + S.last("files"))
def s3_ignored(t: _Tables) -> DataFrame:
    """Files in folders that are not walked."""
    return t.files.select("id", sources.ignored(F.col("path")).alias("ignored"))


@_query("SELECT id FROM " + S.last("projects") + " ORDER BY last_scanned DESC NULLS FIRST, id LIMIT 1")
def s13_resolve_project(t: _Tables) -> DataFrame:
    """The project that is used if none is named."""
    return sources.resolve_project(t.projects).select("id")


@_query("SELECT id, line_no, trim(line) AS todo FROM (SELECT id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT id, string_split(content, chr(10)) AS l FROM " + S.last("symbols") + ")) WHERE regexp_matches(line, '(?://|#|--)\\s*(TODO|FIXME|HACK|XXX|DEBT)\\b', 'i')")
def parser22_todo_lines(t: _Tables) -> DataFrame:
    """Lines with a marker that begins a comment."""
    return parsers.todo_lines(t.symbols.select("id", "content")).select("id", F.col("line_no").cast("bigint").alias("line_no"), "todo")


@_query(
    "SELECT id, line_no, kind, name FROM (SELECT id, line_no, CASE WHEN regexp_matches(line, '^(?:function|def|fn|func)\\s+(\\w+)') THEN 'function' WHEN regexp_matches(line, '^(?:class|struct|type)\\s+(\\w+)') THEN 'class' END AS kind, "
    "CASE WHEN regexp_matches(line, '^(?:function|def|fn|func)\\s+(\\w+)') THEN regexp_extract(line, '^(?:function|def|fn|func)\\s+(\\w+)', 1) ELSE regexp_extract(line, '^(?:class|struct|type)\\s+(\\w+)', 1) END AS name "
    "FROM (SELECT id, trim(regexp_replace(unnest(l), '\\r$', '')) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT id, string_split(content, chr(10)) AS l FROM " + S.last("symbols") + "))) WHERE kind IS NOT NULL"
)
def parser4_line_symbols(t: _Tables) -> DataFrame:
    """What lines declare, by the fallback rules."""
    return parsers.line_symbols(t.symbols.select("id", "content"), "generic").select("id", F.col("line_no").cast("bigint").alias("line_no"), "kind", "name")


@_query()
def parser1_symbols_by_language(t: _Tables) -> DataFrame:
    """What lines declare, by each language's rules."""
    return parsers.line_symbols(t.symbols.select("id", "language", "content")).select("id", "language", "line_no", "kind", "name", "qualified_name", "visibility")


@_query("SELECT id, unnest(regexp_extract_all(content, '(?:import|require|use)\\s+[\"'']?([\\w./]+)[\"'']?', 1)) AS module FROM " + S.last("chunks"))
def parser27_imports(t: _Tables) -> DataFrame:
    """What chunks import, by the rules for all languages."""
    return t.chunks.select("id", F.explode(parsers.imports(F.col("content"), "generic")).alias("module"))


@_query(
    "SELECT c.id, CASE WHEN contains(content, 'apiVersion:') THEN 'kubernetes' WHEN contains(content, 'helm.sh/chart') OR regexp_extract(path, '[^/]*$') = 'values.yaml' THEN 'helm' WHEN contains(content, 'runs-on:') OR contains(path, '.github/workflows') THEN 'github_actions' "
    "WHEN contains(content, 'stages:') AND contains(content, 'script:') THEN 'gitlab_ci' WHEN contains(content, 'services:') AND (contains(content, 'image:') OR contains(content, 'build:')) THEN 'docker_compose' ELSE 'generic' END AS yaml_type FROM " + S.last("chunks") + " c JOIN " + S.last("files") + " f ON c.file_id = f.id"
)
def parser9_yaml_types(t: _Tables) -> DataFrame:
    """YAML types of chunks."""
    return t.chunks.select("id", "file_id", "content").join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", parsers.yaml_type(F.col("path"), F.col("content")).alias("yaml_type"))


@_query()
def parser15_yaml_symbols(t: _Tables) -> DataFrame:
    """Keys of configuration chunks."""
    held = t.chunks.select(F.col("id").alias("chunk_id"), "file_id", "content").join(t.files.select(F.col("id").alias("file_id"), "path").filter(F.lower("path").rlike(r"\.ya?ml$")), "file_id")
    return parsers.yaml_symbols(held, "chunk_id")


#: The answers on these tables: no symbol there shows a framework but these, so most have their language's own.
_FRAMEWORKS = "CASE lower(language) WHEN 'elixir' THEN 'in Elixir/OTP' WHEN 'typescript' THEN 'in TypeScript/Node.js' WHEN 'javascript' THEN 'in TypeScript/Node.js' WHEN 'python' THEN 'in Python' WHEN 'ruby' THEN 'in Ruby' WHEN 'php' THEN 'in PHP' WHEN 'java' THEN 'in Java' WHEN 'kotlin' THEN 'in Kotlin' WHEN 'dart' THEN 'in Dart/Flutter' WHEN 'swift' THEN 'in Swift' WHEN 'rust' THEN 'in Rust' WHEN 'go' THEN CASE WHEN contains(content, 'gin.') THEN 'using Gin web framework' ELSE 'in Go' END WHEN 'csharp' THEN 'in C#/.NET' WHEN 'terraform' THEN 'defining Terraform infrastructure (IaC)' WHEN 'config' THEN 'in YAML configuration' END"


@_query("SELECT id, " + _FRAMEWORKS + " AS framework FROM " + S.last("symbols"))
def parser28_frameworks(t: _Tables) -> DataFrame:
    """Frameworks that symbols show; the rules one by one are in ``parser28_framework_rules``."""
    return t.symbols.select("id", frameworks.framework(F.col("language"), F.col("content"), F.col("metadata")).alias("framework"))


@_query("SELECT id, list_filter(list_transform(regexp_extract_all(content, '(?s)/\\*\\*(.*?)\\*/', 1), lambda x: regexp_replace(regexp_replace(x, '\\s*\\*\\s*', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10) AS docs FROM " + S.last("symbols"))
def parser21_doc_comments(t: _Tables) -> DataFrame:
    """Documentation comments of symbols."""
    return t.symbols.select("id", parsers.doc_comments(F.col("content"), "generic").alias("docs"))


@_query(
    "SELECT id, substring(max(CASE WHEN note THEN lpad(CAST(line_start AS VARCHAR), 10, '0') || name END) OVER (PARTITION BY file_id ORDER BY line_start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 11) AS note FROM (SELECT id, file_id, line_start, name, kind IN ('class', 'module') AS note FROM " + S.last("symbols") + ") WHERE line_start IS NOT NULL QUALIFY NOT note"
)
def j9_nearest_above(t: _Tables) -> DataFrame:
    """The last class or module above each symbol of a file."""
    rows = t.symbols.filter("line_start is not null").select("id", "file_id", "line_start", "name", "kind")
    return parsers.nearest_above(rows, ["file_id"], "line_start", F.col("kind").isin("class", "module"), F.col("name")).select("id", "note")


_MARKERS = [("elixir", "mix.exs"), ("rust", "Cargo.toml"), ("go", "go.mod"), ("python", "pyproject.toml"), ("node", "package.json"), ("java", "pom.xml"), ("dart", "pubspec.yaml"), ("ruby", "Gemfile"), ("php", "composer.json")]


@_query(
    "WITH p AS (SELECT project_id, list(path) AS paths FROM " + S.last("files") + " GROUP BY project_id) SELECT project_id, CASE WHEN list_contains(paths, 'mix.exs') THEN 'elixir' WHEN list_contains(paths, 'Cargo.toml') THEN 'rust' WHEN list_contains(paths, 'go.mod') THEN 'go' "
    "WHEN list_contains(paths, 'pyproject.toml') OR list_contains(paths, 'setup.py') THEN 'python' WHEN list_contains(paths, 'package.json') THEN 'node' WHEN list_contains(paths, 'pom.xml') OR list_contains(paths, 'build.gradle') THEN 'java' WHEN list_contains(paths, 'pubspec.yaml') THEN 'dart' "
    "WHEN list_contains(paths, 'Gemfile') THEN 'ruby' WHEN list_contains(paths, 'composer.json') THEN 'php' ELSE 'unknown' END AS primary_stack, "
    "CASE WHEN " + " OR ".join(f"list_contains(paths, '{m}')" for _, m in _MARKERS) + " THEN array_to_string(list_filter([" + ", ".join(f"CASE WHEN list_contains(paths, '{m}') THEN '{k}' END" for k, m in _MARKERS) + "], lambda x: x IS NOT NULL), ',') ELSE 'unknown' END AS all_stacks FROM p"
)
def s14_stacks(t: _Tables) -> DataFrame:
    """Every project's stacks."""
    return parsers.stacks(t.files).select("project_id", "primary_stack", F.array_join("all_stacks", ",").alias("all_stacks"))


# Vectors and retrieval


def _asked(t: _Tables) -> DataFrame:
    """Query vectors: every 20th of the table of embeddings."""
    return t.raw("embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@_query("SELECT query, id, score FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(" + S.cosine("q.embedding", "e.embedding") + ", 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10")
def l1_knn(t: _Tables) -> DataFrame:
    """The 10 nearest embeddings of every 20th."""
    return retrieval.vector_search(_asked(t), t.raw("embeddings"), 10, key="vec_id")


@_query("SELECT query, id, score FROM (SELECT q.vec_id AS query, s.id, round(" + S.cosine("q.embedding", "s.embedding") + ", 6) AS score FROM embeddings q CROSS JOIN " + S.usable("symbols", "kind = 'function'") + " s WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5")
def r1_functions_by_vector(t: _Tables) -> DataFrame:
    """The 5 nearest functions of each query vector."""
    return retrieval.vector_search(_asked(t), t.symbols.filter("kind = 'function'"), 5)


@_query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))))), 6) AS total FROM embeddings")
def v2_normalized(t: _Tables) -> DataFrame:
    """Sums of the scaled embeddings."""
    return t.raw("embeddings").select("vec_id", F.round(F.aggregate(V.l2_normalize(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query("SELECT query, id, score FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(" + S.cosine("q.embedding", "e.embedding") + ", 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0) WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10")
def v4_approximate_knn(t: _Tables) -> DataFrame:
    """Near embeddings of every 20th, through the index."""
    return retrieval.approximate_search(_asked(t), t.raw("embeddings"), 10, key="vec_id")


@_query("SELECT id, coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) AS valid FROM " + S.last("symbols"))
def v3_dimension(t: _Tables) -> DataFrame:
    """Symbols whose vector has the right size and finite numbers."""
    return t.symbols.select("id", V.of_dimension(F.col("embedding"), 64).isNotNull().alias("valid"))


@_query()
def v5_hash_embed(t: _Tables) -> DataFrame:
    """Stand-in embeddings of the evaluation passages."""
    return t.raw("eval_items").select("item_id", V.hash_embed(F.col("passage")).alias("embedding"))


@_query("SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(passage), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda x: length(x) > 1) AS terms FROM eval_items")
def r3_search_terms(t: _Tables) -> DataFrame:
    """Search terms of the evaluation passages."""
    return t.raw("eval_items").select("item_id", T.search_terms(F.col("passage")).alias("terms"))


def _bm25(t: _Tables, k: int = 25) -> DataFrame:
    return retrieval.bm25_search(TEXTS, t.symbols, ["name", "qualified_name", "content"], ["name", "content"], k)


@_query(S.bm25(TEXTS, 25))
def r2_bm25(t: _Tables) -> DataFrame:
    """The 25 best symbols of each text query."""
    return _bm25(t)


def _symbol_edges(t: _Tables) -> DataFrame:
    return graph.edges(t.relationships, "symbol")


def _graph(t: _Tables, k: int = 25) -> DataFrame:
    return retrieval.graph_search(TEXTS, t.symbols, _symbol_edges(t), k)


@_query(S.graph_search(TEXTS, 25))
def r4_graph_search(t: _Tables) -> DataFrame:
    """Symbols near the first symbol that contains each text."""
    return _graph(t)


def _text_vectors(t: _Tables) -> DataFrame:
    """A vector for each text: that of the embeddings with the same number."""
    return t.raw("embeddings").filter(F.col("vec_id").between(1, len(TEXTS))).select(F.concat(F.lit("q"), "vec_id").alias("query"), F.col("embedding").alias("vector"))


@_query(S.hybrid(TEXTS))
def r8_hybrid_search(t: _Tables) -> DataFrame:
    """Vector, text and graph search, fused."""
    return retrieval.hybrid_search(TEXTS, _text_vectors(t), t.symbols, _symbol_edges(t)).select("query", "id", "rank", "combined_score", "engines")


@_query(S.evaluation(TEXTS))
def r11_evaluation(t: _Tables) -> DataFrame:
    """Precision, recall and reciprocal rank of the text search; relevant is every symbol that has the query's last word in its name, found or not."""
    found = _bm25(t)
    ranked = found.withColumn("rank", F.row_number().over(S.window("query", F.desc("score"), "id")))
    expected = t.spark.createDataFrame([(q, text.split()[-1]) for q, text in TEXTS], "query string, expected string")
    named = t.symbols.select("id", "name").crossJoin(F.broadcast(expected.select("query").distinct()))
    per = retrieval.evaluate(ranked, retrieval.relevant_by_name(named, expected))
    return per.select("query", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr")])


# Graph


@_query("SELECT e.dst AS seed, s.id, s.name, s.qualified_name, s.kind, f.path, s.line_start FROM " + S.edges("symbol", False) + " e JOIN " + S.last("symbols") + " s ON s.id = e.src JOIN " + S.last("files") + " f ON f.id = s.file_id")
def g4_callers(t: _Tables) -> DataFrame:
    """Direct callers of every symbol."""
    return graph.neighbours(_symbol_edges(t), t.symbols, t.files, "callers")


@_query("SELECT e.src AS seed, s.id, s.name, s.qualified_name, s.kind, f.path, s.line_start FROM " + S.edges("symbol", False) + " e JOIN " + S.last("symbols") + " s ON s.id = e.dst JOIN " + S.last("files") + " f ON f.id = s.file_id")
def g4_callees(t: _Tables) -> DataFrame:
    """Direct callees of every symbol."""
    return graph.neighbours(_symbol_edges(t), t.symbols, t.files, "callees")


@_query("WITH RECURSIVE e AS " + S.edges("file", False) + ", r(seed, id, hop) AS (SELECT src, dst, 1 FROM e UNION SELECT r.seed, e.dst, r.hop + 1 FROM r JOIN e ON r.id = e.src WHERE r.hop < 3) SELECT seed, id, CAST(min(hop) AS INTEGER) AS hop FROM r WHERE seed <> id GROUP BY ALL")
def g5_impact(t: _Tables) -> DataFrame:
    """What each file's change reaches within three steps."""
    edge = graph.edges(t.relationships, "file")
    return graph.impact(edge, edge.select(F.col("src").alias("seed")).distinct())


@_query(
    "WITH RECURSIVE e AS " + S.edges("any", False) + ", r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a"
)
def g6_components(t: _Tables) -> DataFrame:
    """Strongly connected components of two or more."""
    return graph.components(graph.edges(t.relationships))


@_query("SELECT id FROM " + S.last("symbols") + " WHERE visibility = 'public' AND kind IN ('function', 'module') AND id NOT IN (SELECT dst FROM " + S.edges("symbol", False) + ")")
def g9_entry_points(t: _Tables) -> DataFrame:
    """Public functions and modules that nothing points to."""
    return graph.entry_points(t.symbols, _symbol_edges(t)).select("id")


@_query("SELECT project_id, split_part(qualified_name, '.', 1) AS namespace, count(*) AS symbols FROM " + S.last("symbols") + " WHERE qualified_name IS NOT NULL GROUP BY ALL")
def g10_module_tree(t: _Tables) -> DataFrame:
    """Symbols by namespace."""
    return graph.module_tree(t.symbols)


@_query(
    "SELECT id, match FROM (SELECT id, qualified_name, CAST(CASE WHEN qualified_name = 'cache' OR name = 'cache' THEN 1 ELSE 2 END AS INTEGER) AS match FROM " + S.last("symbols") + " WHERE contains(lower(qualified_name), 'cache') OR contains(lower(name), 'cache')) ORDER BY match, length(qualified_name) NULLS FIRST, id LIMIT 10"
)
def g8_find_symbol(t: _Tables) -> DataFrame:
    """The 10 best matches of a name."""
    return graph.find_symbol(t.symbols, "cache").select("id", "match")


@_query(
    "WITH p AS (SELECT DISTINCT r.project_id, a.path AS from_path, b.path AS to_path FROM " + S.last("relationships") + " r JOIN " + S.last("files") + " a ON a.id = r.from_file_id JOIN " + S.last("files") + " b ON b.id = r.to_file_id) "
    "SELECT DISTINCT p.project_id, a.id AS src, b.id AS dst FROM p JOIN " + S.last("files") + " a ON a.project_id = p.project_id AND a.path = p.from_path JOIN " + S.last("files") + " b ON b.project_id = p.project_id AND b.path = p.to_path WHERE a.id <> b.id"
)
def j11_edge_resolution(t: _Tables) -> DataFrame:
    """File edges given by path, resolved within their project."""
    f = t.files.select("id", "path")
    by_path = t.relationships.select("project_id", "from_file_id", "to_file_id").join(f.toDF("from_file_id", "from_path"), "from_file_id").join(f.toDF("to_file_id", "to_path"), "to_file_id").select("project_id", "from_path", "to_path").distinct()
    return graph.resolve_edges(by_path, t.files)


@_query()
def g1_import_graph(t: _Tables) -> DataFrame:
    """File edges of what chunks import."""
    of = t.files.select(F.col("id").alias("file_id"), "path", "language")
    return graph.import_edges(t.chunks.select("project_id", "file_id", "content").join(of, "file_id"), t.files)


# Metrics and statistics


def _coupling(t: _Tables) -> DataFrame:
    return metrics.coupling(t.files, t.symbols, _symbol_edges(t))


@_query("SELECT * FROM " + S.COUPLING)
def m1_coupling(t: _Tables) -> DataFrame:
    """Coupling, complexity and debt of every file."""
    return _coupling(t)


@_query("SELECT id, round(coalesce(git_churn, 0) * (1 + ln(greatest(coalesce(len(git_authors), 0), 1))), 6) AS risk FROM " + S.last("files"))
def m2_churn_risk(t: _Tables) -> DataFrame:
    """Churn risk of every file."""
    return t.files.select("id", F.round(metrics.churn_risk(F.col("git_churn"), F.when(F.col("git_authors").isNotNull(), F.size("git_authors"))), 6).alias("risk"))


@_query("SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS churn, count(DISTINCT o_custkey) AS authors, round(count(DISTINCT l_orderkey) * (1 + ln(count(DISTINCT o_custkey))), 6) AS risk FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def a15_history_churn(t: _Tables) -> DataFrame:
    """Churn of a history: parts as files, orders as commits, customers as authors."""
    history = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("commit"), F.col("o_custkey").alias("author"))
    return metrics.churn(history).withColumn("risk", F.round("risk", 6))


@_query("SELECT project_id, path, risk_score, CAST(row_number() OVER (PARTITION BY project_id ORDER BY risk_score DESC, path, id) AS INTEGER) AS rank FROM " + S.last("files") + " WHERE risk_score > 5 QUALIFY rank <= 5")
def m3_hotspots(t: _Tables) -> DataFrame:
    """The riskiest files of each project."""
    return metrics.hotspots(t.files)


@_query("SELECT f.project_id, f.path, m.debt, m.instability, CAST(row_number() OVER (PARTITION BY f.project_id ORDER BY m.debt DESC, f.path, f.id) AS INTEGER) AS rank FROM " + S.COUPLING + " m JOIN " + S.last("files") + " f ON f.id = m.file_id WHERE m.debt > 5 QUALIFY rank <= 10")
def m6_high_debt(t: _Tables) -> DataFrame:
    """The files of each project with most debt."""
    return metrics.high_debt(_coupling(t), t.files)


@_query("SELECT s.project_id, s.id, f.path, s.name, s.line_start FROM " + S.last("symbols") + " s JOIN " + S.last("files") + " f ON f.id = s.file_id WHERE regexp_matches(s.content, 'FIXME|HACK|BUG|DEBT', 'i')")
def f7_markers(t: _Tables) -> DataFrame:
    """Symbols whose content holds a marker."""
    return metrics.marker_report(t.symbols, t.files)


@_query(
    "WITH RECURSIVE e AS " + S.edges("symbol", False) + ", r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), c AS (SELECT DISTINCT a AS id FROM r WHERE a = b) SELECT project_id, count(*) AS symbols, round(count(embedding) * 100.0 / count(*), 1) AS embedded_pct, round(count(summary) * 100.0 / count(*), 1) AS summarised_pct, count(*) FILTER (WHERE kind IN ('function', 'method')) AS functions, count(*) FILTER (WHERE kind IN ('module', 'class')) AS modules, count(*) FILTER (WHERE regexp_matches(content, 'TODO|FIXME|HACK', 'i')) AS with_todo, count(*) FILTER (WHERE id IN (SELECT id FROM c)) AS in_cycle FROM " + S.last("symbols") + " GROUP BY project_id"
)
def m4_project_audit(t: _Tables) -> DataFrame:
    """Coverage and size of every project, and its symbols in cycles."""
    return metrics.project_audit(t.symbols, graph.components(_symbol_edges(t)))


@_query("SELECT f.id AS file_id, f.path, f.language, f.line_count, f.risk_score, coalesce(len(f.git_authors), 0) AS authors, m.afferent, m.efferent, m.instability, m.debt FROM " + S.last("files") + " f JOIN " + S.COUPLING + " m ON m.file_id = f.id")
def m5_file_audit(t: _Tables) -> DataFrame:
    """Every file with its metrics."""
    return metrics.file_audit(t.files, _coupling(t))


@_query("SELECT project_id, path, language, line_count, coalesce(risk_score, 0) > 10 AS risky FROM " + S.last("files") + " WHERE contains(lower(path), 'cache') OR language = 'cache'")
def m8_file_listing(t: _Tables) -> DataFrame:
    """Files whose path contains a text."""
    return metrics.file_listing(t.files, "cache")


@_query("SELECT project_id, language, count(*) AS files FROM " + S.last("files") + " GROUP BY ALL")
def a6_languages(t: _Tables) -> DataFrame:
    """Files by project and language."""
    return metrics.languages(t.files)


@_query(
    "SELECT project_id, count(*) AS calls, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'timeout') AS timeout, CAST(coalesce(sum(response_tokens), 0) AS BIGINT) AS response_tokens, CAST(coalesce(sum(saved_tokens), 0) AS BIGINT) AS saved_tokens, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms, round(coalesce(avg(duration_ms), 0), 3) AS avg_ms, coalesce(max(duration_ms), 0) AS max_ms, max(inserted_at) AS last_call, CAST(coalesce(sum(saved_tokens), 0) AS BIGINT) AS saved_ms, round(count(*) FILTER (WHERE status = 'success') * 100.0 / count(*), 1) AS success_rate FROM " + S.last("mcp_usage_events") + " GROUP BY project_id"
)
def t1_usage_snapshot(t: _Tables) -> DataFrame:
    """Calls of every project."""
    return metrics.usage_snapshot(t.usage)


@_query("SELECT project_id, tool_name, count(*) AS calls FROM " + S.last("mcp_usage_events") + " GROUP BY ALL")
def t1_usage_per_tool(t: _Tables) -> DataFrame:
    """Calls of every tool."""
    return metrics.usage_per_tool(t.usage)


@_query("SELECT * FROM " + S.KB)
def t3_kb_tokens(t: _Tables) -> DataFrame:
    """Tokens that every project's index holds."""
    return metrics.knowledge_tokens(t.chunks, t.files)


@_query(S.INDEX)
def t2_index_snapshot(t: _Tables) -> DataFrame:
    """Size and coverage of every project's index."""
    return metrics.index_snapshot(t.files, t.symbols, t.chunks)


@_query("SELECT u.id, CASE WHEN lower(status) IN ('success', 'error', 'timeout') THEN lower(status) ELSE 'error' END AS status, CAST(ceil(coalesce(length(args), 0) / 4) AS BIGINT) AS response_tokens, CASE WHEN lower(status) = 'success' THEN CAST(greatest(coalesce(kb_tokens, 0) - CAST(ceil(coalesce(length(args), 0) / 4) AS BIGINT), 0) AS BIGINT) ELSE 0 END AS saved_tokens, greatest(coalesce(duration_ms, 0), 0) AS duration_ms FROM " + S.last("mcp_usage_events") + " u LEFT JOIN " + S.KB + " k ON k.project_id = u.project_id")
def t4_record_calls(t: _Tables) -> DataFrame:
    """Usage events made of calls, the arguments taken for the answer."""
    calls = t.usage.select("id", "project_id", "tool_name", "status", F.col("args").alias("response"), "duration_ms")
    return metrics.record_calls(calls, metrics.knowledge_tokens(t.chunks, t.files)).select("id", "status", "response_tokens", "saved_tokens", "duration_ms")


@_query("SELECT file_id, string_agg(kind || ' ' || name, ', ' ORDER BY coalesce(line_start, 0), id) AS listing FROM " + S.last("symbols") + " GROUP BY file_id")
def a12_listings(t: _Tables) -> DataFrame:
    """Each file's symbols as text."""
    return metrics.listing_text(t.symbols)


# Incremental


@_query(
    "WITH n AS " + S.last("files") + ", o AS " + S.first("files") + " SELECT n.id FROM n LEFT JOIN o ON n.project_id = o.project_id AND n.path = o.path WHERE o.id IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash"
)
def j10_changed_files(t: _Tables) -> DataFrame:
    """Files whose latest delivery has another hash than their first."""
    return incremental.changed_files(t.files, _first(t, "files")).select("id")


def _first(t: _Tables, name: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy(F.asc_nulls_first("updated_at"), F.asc_nulls_first("inserted_at"))
    return t.raw(name).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


@_query("SELECT id, line_count, size_bytes FROM " + S.last("files"))
def d1_upsert_files(t: _Tables) -> DataFrame:
    """First deliveries with all deliveries written over them."""
    old = _first(t, "files")
    return incremental.upsert(old, t.raw("files"), ["project_id", "path"]).select("id", "line_count", "size_bytes")


@_query("WITH n AS (SELECT file_id, count(*) AS n FROM " + S.last("symbols") + " GROUP BY file_id) SELECT c.id FROM " + S.last("chunks") + " c LEFT JOIN n ON n.file_id = c.file_id WHERE n.n IS NULL OR c.chunk_index < n.n")
def d6_orphan_chunks(t: _Tables) -> DataFrame:
    """Chunks that stay if a file has as many chunks as symbols."""
    return incremental.without_orphan_chunks(t.chunks, t.symbols.groupBy("file_id").agg(F.count("*").alias("n"))).select("id")


@_query("WITH s AS " + S.last("symbols") + " SELECT id FROM s WHERE NOT (qualified_name IS NOT NULL AND NOT contains(qualified_name, '.') AND EXISTS (SELECT 1 FROM s b WHERE b.file_id = s.file_id AND b.qualified_name LIKE '%.' || s.qualified_name AND split_part(b.qualified_name, '.', -1) = s.qualified_name))")
def j8_stale_symbols(t: _Tables) -> DataFrame:
    """Symbols without bare twins of qualified ones."""
    return incremental.without_stale_symbols(t.symbols).select("id")


@_query("SELECT id FROM " + S.last("symbols") + " WHERE summary IS NULL OR upper(md5(content)) IS DISTINCT FROM upper(summary_hash)")
def d10_needs_summary(t: _Tables) -> DataFrame:
    """Symbols whose summary is missing or old."""
    return incremental.needs_summary(t.symbols).select("id")


@_query("SELECT id, (CASE WHEN project_id IS NULL THEN 1 ELSE 0 END + CASE WHEN status NOT IN ('success', 'error', 'timeout') THEN 1 ELSE 0 END + CASE WHEN duration_ms < 0 THEN 1 ELSE 0 END) AS reasons FROM " + S.last("mcp_usage_events") + " WHERE reasons > 0")
def x20_rejects(t: _Tables) -> DataFrame:
    """Usage events that break a rule."""
    _, bad = incremental.validate(t.usage, ["project_id"], {"status": incremental.STATES}, ["duration_ms"])
    return bad.select("id", F.size("reasons").alias("reasons"))


@_query("SELECT c.id, c.content IN (SELECT content FROM " + S.last("symbols") + " WHERE embedding IS NOT NULL) AS hit FROM " + S.last("chunks") + " c")
def j14_cache_lookup(t: _Tables) -> DataFrame:
    """Chunks whose text has a cached embedding, symbols being the cache."""
    cache = t.symbols.select(F.sha2("content", 256).alias("content_hash"), "embedding")
    return incremental.cache_lookup(t.chunks.select("id", F.col("content").alias("text")), cache).select("id", "hit")


@_query("SELECT id FROM " + S.last("symbols") + " ORDER BY id LIMIT 50")
def l8_first_page(t: _Tables) -> DataFrame:
    """The first page of symbols."""
    return incremental.pages(t.symbols).select("id")


# Streams, run on the static table


@_query("SELECT user_id, CAST(count(*) AS BIGINT) AS events FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def st2_debounce(t: _Tables) -> DataFrame:
    """Events of each user by quiet periods of six hours."""
    return watch.debounce(t.raw("events"), ["user_id"], "6 hours").select("user_id", "events")


@_query("SELECT event_type, count(DISTINCT user_id) AS users FROM (SELECT event_type, user_id, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_type, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 3 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY event_type, s")
def st3_batches(t: _Tables) -> DataFrame:
    """Users of each batch of events."""
    return watch.batches(t.raw("events"), "user_id", "3 minutes", by=["event_type"]).select("event_type", F.size("paths").cast("bigint").alias("users"))


# Tools


_FIRST = "(SELECT id FROM " + S.last("symbols") + " WHERE contains(lower(qualified_name), 'cache') OR contains(lower(name), 'cache') ORDER BY CASE WHEN qualified_name = 'cache' OR name = 'cache' THEN 1 ELSE 2 END, length(qualified_name) NULLS FIRST, id LIMIT {n})"


@_query("SELECT h.query, h.rank, h.id, h.combined_score, h.engines, s.name, s.kind, f.path, replace(substring(s.content, 1, 200), chr(10), ' ') AS preview FROM (" + S.hybrid(TEXTS, 20, 5) + ") h JOIN " + S.last("symbols") + " s ON s.id = h.id LEFT JOIN " + S.last("files") + " f ON f.id = s.file_id")
def tool_search(t: _Tables) -> DataFrame:
    """The search tool for all texts."""
    return tools.search(TEXTS, _text_vectors(t), t.symbols, t.files, _symbol_edges(t))


@_query(
    "WITH s AS " + S.last("symbols") + ", f AS " + S.last("files") + ", e AS " + S.edges("symbol", False) + ", m AS " + _FIRST.format(n=10) + ", one AS " + _FIRST.format(n=1) + ", "
    "near AS (SELECT 'callers' AS role, src AS id FROM e WHERE dst IN (SELECT id FROM one) UNION ALL SELECT 'callees', dst FROM e WHERE src IN (SELECT id FROM one)), "
    "r AS (SELECT role, s.id, name, qualified_name, kind, f.path, line_start, row_number() OVER (PARTITION BY role ORDER BY qualified_name NULLS FIRST, s.id) AS n FROM near JOIN s ON s.id = near.id JOIN f ON f.id = s.file_id) "
    "SELECT 'match' AS role, s.id, name, qualified_name, kind, f.path, line_start FROM s JOIN m ON m.id = s.id LEFT JOIN f ON f.id = s.file_id UNION ALL SELECT * EXCLUDE (n) FROM r WHERE n <= 20"
)
def tool_symbol(t: _Tables) -> DataFrame:
    """The symbol tool."""
    return tools.symbol("cache", t.symbols, t.files, _symbol_edges(t))


@_query(
    "WITH RECURSIVE e AS " + S.edges("symbol", False) + ", r(seed, id, hop) AS (SELECT o.id, e.dst, 1 FROM " + _FIRST.format(n=1) + " o JOIN e ON e.src = o.id UNION SELECT r.seed, e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.id WHERE r.hop < 3) "
    "SELECT CAST(h.hop AS INTEGER) AS hop, s.id, s.name, s.qualified_name, f.path FROM (SELECT id, min(hop) AS hop FROM r WHERE id <> seed GROUP BY id) h JOIN " + S.last("symbols") + " s ON s.id = h.id LEFT JOIN " + S.last("files") + " f ON f.id = s.file_id"
)
def tool_impact(t: _Tables) -> DataFrame:
    """The impact tool."""
    return tools.impact_of("cache", t.symbols, t.files, _symbol_edges(t))


@_query("SELECT h.rank, h.id, s.name, s.kind, s.signature, f.path, replace(substring(s.content, 1, 800), chr(10), ' ') AS preview FROM (" + S.hybrid([("q1", "cache")], 24, 8) + ") h JOIN " + S.last("symbols") + " s ON s.id = h.id LEFT JOIN " + S.last("files") + " f ON f.id = s.file_id")
def tool_context(t: _Tables) -> DataFrame:
    """The context tool."""
    vector = _text_vectors(t).filter("query = 'q1'").withColumn("query", F.lit("task"))
    return tools.context("cache", vector, t.symbols, t.files, _symbol_edges(t))


@_query("SELECT project_id, path, language, line_count, coalesce(risk_score, 0) > 10 AS risky FROM " + S.last("files"))
def tool_files(t: _Tables) -> DataFrame:
    """The files tool."""
    return tools.list_files(t.files)


@_query(
    "SELECT f.id AS file_id, f.path, f.language, f.line_count, f.risk_score, coalesce(len(f.git_authors), 0) AS authors, m.afferent, m.efferent, m.instability, m.debt FROM " + S.last("files") + " f JOIN " + S.COUPLING + " m ON m.file_id = f.id WHERE f.path = (SELECT min(path) FROM files)"
)
def tool_audit(t: _Tables) -> DataFrame:
    """The audit tool, for the first path."""
    first = t.raw("files").agg(F.min("path").alias("p")).first().p
    return tools.audit(t.symbols, t.files, _coupling(t), first)


@_query("SELECT id, project_id, path, content FROM (SELECT c.id, c.project_id, f.path, c.content FROM " + S.last("chunks") + " c JOIN " + S.last("files") + " f ON f.id = c.file_id)")
def j1_chunks_with_files(t: _Tables) -> DataFrame:
    """Chunks with the path of their file."""
    return t.chunks.select("id", "project_id", "content", "file_id").join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "project_id", "path", "content")


def queries() -> dict[str, Query]:
    """Every registered query."""
    from corvane.plans import cases  # noqa: F401  (registers its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of every query that has one."""
    from corvane.plans import cases  # noqa: F401

    return dict(_SQL)
