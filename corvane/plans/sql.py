"""Pieces of the SQL that queries are checked against, and of their windows."""

from __future__ import annotations

from pyspark.sql import Window


def window(partition: str, *order):
    """A window by one column in an order."""
    return Window.partitionBy(partition).orderBy(*order)


def last(name: str) -> str:
    """The latest delivery of each id."""
    return f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, inserted_at DESC NULLS LAST) AS _rn FROM {name}) WHERE _rn = 1)"


def first(name: str) -> str:
    """The first delivery of each id."""
    return f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at ASC NULLS FIRST, inserted_at ASC NULLS FIRST) AS _rn FROM {name}) WHERE _rn = 1)"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    """A list of string literals."""
    return "[" + ", ".join(map(text, values)) + "]"


def case(value: str, table: dict[str, str], other: str) -> str:
    """A value looked up."""
    return f"CASE {value} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items()) + f" ELSE {text(other)} END"


def cosine(a: str, b: str) -> str:
    """Cosine of two vectors in double precision."""
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def usable(name: str, where: str = "true") -> str:
    """Latest rows with a usable vector."""
    return f"(SELECT * FROM {last(name)} WHERE {where} AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


def edges(level: str, kind: bool = True) -> str:
    """Distinct edges."""
    a, b = {"symbol": ("from_id", "to_id"), "file": ("from_file_id", "to_file_id")}.get(level, ("coalesce(from_id, from_file_id)", "coalesce(to_id, to_file_id)"))
    return f"(SELECT DISTINCT {a} AS src, {b} AS dst{', kind' if kind else ''} FROM {last('relationships')} WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b})"


def _tokens(columns: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({columns}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda x: length(x) > 0)"


def _bm25(texts: list[tuple[str, str]], k: int) -> str:
    """CTE bodies that end with bm25(query, id, score)."""
    rows = ", ".join(f"({text(q)}, {text(t)})" for q, words in texts for t in dict.fromkeys(words.lower().split()))
    return (
        f"terms(query, term) AS (VALUES {rows}), docs AS (SELECT id, {_tokens(chr(39).join(['concat_ws(', ' ', ', name, qualified_name, content)']))} AS m, {_tokens(chr(39).join(['concat_ws(', ' ', ', name, content)']))} AS r FROM {last('symbols')}), "
        "n AS (SELECT count(*) AS n, avg(len(r)) AS avgdl FROM docs), "
        "tf AS (SELECT t.term, d.id, len(d.r) AS dl, len(list_filter(d.r, lambda x: starts_with(x, t.term))) AS tf, len(list_filter(d.m, lambda x: starts_with(x, t.term))) AS hit FROM docs d CROSS JOIN (SELECT DISTINCT term FROM terms) t), "
        "df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term), "
        "scored AS (SELECT q.query, tf.id, count(*) AS c, count(*) FILTER (WHERE hit > 0) AS h, sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.dl / n.avgdl))) AS s FROM terms q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term CROSS JOIN n GROUP BY q.query, tf.id), "
        f"bm25 AS (SELECT query, id, round(s, 6) AS score FROM scored WHERE h = c QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(s, 6) DESC, id) <= {k})"
    )


def bm25(texts: list[tuple[str, str]], k: int) -> str:
    """Text search."""
    return f"WITH {_bm25(texts, k)} SELECT * FROM bm25"


def _graph(texts: list[tuple[str, str]], k: int) -> str:
    seeds = " UNION ALL ".join(f"(SELECT {text(q)} AS query, id AS seed FROM {last('symbols')} WHERE contains(lower(name), {text(t)}) OR contains(lower(qualified_name), {text(t)}) ORDER BY length(name), name, id LIMIT 1)" for q, t in texts)
    return (
        f"e AS {edges('symbol', False)}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), seeds AS ({seeds}), "
        "walk(seed, id, hop) AS (SELECT s.seed, u.dst, 1 FROM (SELECT DISTINCT seed FROM seeds) s JOIN u ON u.src = s.seed UNION SELECT w.seed, u.dst, w.hop + 1 FROM walk w JOIN u ON u.src = w.id WHERE w.hop < 3), "
        "hops AS (SELECT seed, id, min(hop) AS hop FROM walk WHERE id <> seed GROUP BY ALL), "
        f"graph AS (SELECT DISTINCT query, id, CAST(CASE hop WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS score FROM seeds JOIN hops USING (seed) QUALIFY row_number() OVER (PARTITION BY query ORDER BY CASE hop WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE 0.3 END DESC, id) <= {k})"
    )


def graph_search(texts: list[tuple[str, str]], k: int) -> str:
    """Graph search."""
    return f"WITH RECURSIVE {_graph(texts, k)} SELECT query, id, score FROM graph"


def hybrid(texts: list[tuple[str, str]], k: int = 25, final: int = 7) -> str:
    """Hybrid search."""
    return (
        f"WITH RECURSIVE {_bm25(texts, k)}, {_graph(texts, k)}, vector AS (SELECT query, id, score FROM (SELECT 'q' || q.vec_id AS query, s.id, round({cosine('q.embedding', 's.embedding')}, 6) AS score FROM embeddings q CROSS JOIN {usable('symbols')} s WHERE q.vec_id BETWEEN 1 AND {len(texts)}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= {k}), "
        "lists AS (SELECT *, 'vector' AS engine, 0.55 AS w FROM vector UNION ALL SELECT *, 'bm25', 0.25 FROM bm25 UNION ALL SELECT query, id, score, 'graph', 0.20 FROM graph), "
        "parts AS (SELECT query, id, engine, CAST(w AS DOUBLE) / (60 + row_number() OVER (PARTITION BY engine, query ORDER BY score DESC, id)) AS part FROM lists), "
        "total AS (SELECT query, id, sum(part) AS total, string_agg(engine, ',' ORDER BY engine) AS engines FROM parts GROUP BY query, id) "
        f"SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY round(total, 12) DESC, id) AS INTEGER) AS rank, round(total, 4) AS combined_score, engines FROM total QUALIFY rank <= {final}"
    )


def evaluation(texts: list[tuple[str, str]], k: int = 5) -> str:
    """Precision, recall and reciprocal rank of the text search; recall over all relevant symbols, found or not."""
    wanted = ", ".join(f"({text(q)}, {text(t.split()[-1])})" for q, t in texts)
    return (
        f"WITH {_bm25(texts, 25)}, wanted(query, expected) AS (VALUES {wanted}), relevant AS (SELECT w.query, s.id FROM wanted w JOIN {last('symbols')} s ON contains(lower(s.name), w.expected)), "
        "ranked AS (SELECT b.query, b.id, row_number() OVER (PARTITION BY b.query ORDER BY score DESC, b.id) AS rank FROM bm25 b), hits AS (SELECT query, min(rank) AS first, count(*) FILTER (WHERE rank <= {k}) AS found FROM ranked JOIN relevant USING (query, id) GROUP BY query), "
        "total AS (SELECT query, count(*) AS n FROM relevant GROUP BY query), asked AS (SELECT query FROM ranked UNION SELECT query FROM relevant) "
        "SELECT query, round(coalesce(found, 0) / {k}.0, 6) AS precision_at_k, round(coalesce(found / CAST(n AS DOUBLE), 0), 6) AS recall_at_k, round(coalesce(1.0 / first, 0), 6) AS mrr FROM asked LEFT JOIN hits USING (query) LEFT JOIN total USING (query)"
    ).replace("{k}", str(k))


#: Coupling of every file.
COUPLING = (
    f"(WITH e AS {edges('symbol', False)}, s AS {last('symbols')}, p AS (SELECT e.src, e.dst, a.file_id AS src_file, b.file_id AS dst_file FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst), "
    "ca AS (SELECT dst_file AS file_id, count(DISTINCT src) AS ca FROM p GROUP BY 1), ce AS (SELECT src_file AS file_id, count(DISTINCT dst) AS ce FROM p GROUP BY 1), "
    "n AS (SELECT file_id, count(*) AS symbols, count(*) FILTER (WHERE regexp_matches(content, 'TODO|FIXME|HACK|BUG|DEBT', 'i')) AS todos FROM s GROUP BY 1), "
    f"j AS (SELECT f.id AS file_id, f.project_id, coalesce(f.line_count, 0) AS lines, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, coalesce(symbols, 0) AS symbols, coalesce(todos, 0) AS todos FROM {last('files')} f LEFT JOIN ca ON ca.file_id = f.id LEFT JOIN ce ON ce.file_id = f.id LEFT JOIN n ON n.file_id = f.id) "
    "SELECT file_id, project_id, ca AS afferent, ce AS efferent, round(CASE WHEN ca + ce = 0 THEN 0 ELSE ce / CAST(ca + ce AS DOUBLE) END, 6) AS instability, round(lines / CAST(greatest(symbols, 1) AS DOUBLE), 6) AS complexity, CAST(ca + ce + CASE WHEN ca + ce > 0 AND ce / CAST(ca + ce AS DOUBLE) > 0.7 THEN 5 ELSE 0 END + 2 * todos AS DOUBLE) AS debt, symbols, todos FROM j)"
)
#: Tokens of every project's index.
KB = (
    f"(SELECT coalesce(t.project_id, s.project_id) AS project_id, CASE WHEN coalesce(t.t, 0) > 0 THEN t.t ELSE CAST(ceil(coalesce(s.b, 0) / 4) AS BIGINT) END AS kb_tokens FROM (SELECT project_id, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS t FROM {last('chunks')} GROUP BY 1) t FULL JOIN (SELECT project_id, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS b FROM {last('files')} GROUP BY 1) s ON s.project_id = t.project_id)"
)
#: Size and coverage of every project's index.
INDEX = (
    f"WITH f AS (SELECT project_id, count(*) AS files, CAST(coalesce(sum(line_count), 0) AS BIGINT) AS lines, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, max(last_indexed) AS last_indexed FROM {last('files')} GROUP BY 1), s AS (SELECT project_id, count(*) AS symbols, count(embedding) AS embedded, count(summary) AS summarised FROM {last('symbols')} GROUP BY 1), c AS (SELECT project_id, count(*) AS chunks FROM {last('chunks')} GROUP BY 1), k AS {KB}, "
    "p AS (SELECT project_id FROM f UNION SELECT project_id FROM s UNION SELECT project_id FROM c) "
    "SELECT p.project_id, coalesce(files, 0) AS files, coalesce(lines, 0) AS lines, coalesce(bytes, 0) AS bytes, last_indexed, coalesce(symbols, 0) AS symbols, coalesce(embedded, 0) AS embedded, coalesce(summarised, 0) AS summarised, coalesce(chunks, 0) AS chunks, coalesce(kb_tokens, 0) AS kb_tokens, CASE WHEN coalesce(symbols, 0) = 0 THEN 0 ELSE round(embedded * 100.0 / symbols, 1) END AS embedded_pct, CASE WHEN coalesce(symbols, 0) = 0 THEN 0 ELSE round(summarised * 100.0 / symbols, 1) END AS summarised_pct FROM p LEFT JOIN f USING (project_id) LEFT JOIN s USING (project_id) LEFT JOIN c USING (project_id) LEFT JOIN k USING (project_id)"
)
