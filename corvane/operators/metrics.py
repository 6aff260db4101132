"""Coupling, churn, audits and statistics, each in one pass over its tables and for all projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ceil_tokens, clamped, percentage

#: Markers of work to be done, by report.
MARKERS = {"coupling": "TODO|FIXME|HACK|BUG|DEBT", "audit": "FIXME|HACK|BUG|DEBT", "agents": "TODO|FIXME|HACK"}


def has_marker(text: Column, report: str = "audit") -> Column:
    """Whether a text holds one of a report's markers, whatever the case."""
    return F.coalesce(text.rlike(f"(?i)({MARKERS[report]})"), F.lit(False))


def coupling(files: DataFrame, symbols: DataFrame, edge: DataFrame, exclude_intra_file: bool = False, strict: bool = False) -> DataFrame:
    """(file_id, project_id, afferent, efferent, instability, complexity, debt, symbols, todos) of every file.

    Afferent: distinct symbols that point to the file's; efferent: distinct symbols the
    file's point to. ``strict`` counts every symbol with content as a marker.
    """
    owner = symbols.select(F.col("id"), "file_id")
    placed = edge.select("src", "dst").join(owner.toDF("src", "src_file"), "src").join(owner.toDF("dst", "dst_file"), "dst")
    if exclude_intra_file:
        placed = placed.filter("src_file <> dst_file")
    ca = placed.groupBy(F.col("dst_file").alias("file_id")).agg(F.countDistinct("src").alias("ca"))
    ce = placed.groupBy(F.col("src_file").alias("file_id")).agg(F.countDistinct("dst").alias("ce"))
    todo = F.col("content").isNotNull() if strict else has_marker(F.col("content"), "coupling")
    per = symbols.groupBy("file_id").agg(F.count("*").alias("symbols"), F.count_if(todo).alias("todos"))
    joined = files.select(F.col("id").alias("file_id"), "project_id", "line_count").join(ca, "file_id", "left").join(ce, "file_id", "left").join(per, "file_id", "left")
    joined = joined.fillna(0, ["ca", "ce", "symbols", "todos", "line_count"])
    instability = F.coalesce(F.try_divide(F.col("ce").cast("double"), F.col("ca") + F.col("ce")), F.lit(0.0))
    debt = F.col("ca") + F.col("ce") + F.when(F.col("instability") > 0.7, 5).otherwise(0) + 2 * F.col("todos")
    return joined.withColumn("instability", instability).select(
        "file_id", "project_id", F.col("ca").alias("afferent"), F.col("ce").alias("efferent"), F.round("instability", 6).alias("instability"),
        F.round(F.col("line_count") / F.greatest(F.col("symbols"), F.lit(1)), 6).alias("complexity"), debt.cast("double").alias("debt"), "symbols", "todos",
    )


def churn(commits: DataFrame) -> DataFrame:
    """(path, churn, authors, risk) of a history (path, commit, author): distinct commits and authors, risk = churn (1 + ln authors)."""
    per = commits.groupBy("path").agg(F.countDistinct("commit").alias("churn"), F.countDistinct("author").alias("authors"))
    return per.withColumn("risk", churn_risk(F.col("churn"), F.col("authors")))


def churn_risk(commits: Column, authors: Column) -> Column:
    """commits (1 + ln(max(authors, 1)))."""
    return F.coalesce(commits, F.lit(0)) * (1 + F.ln(F.greatest(F.coalesce(authors, F.lit(0)), F.lit(1)).cast("double")))


def top_per_project(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each project in a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).filter(F.col("rank") <= most)


def hotspots(files: DataFrame, above: float = 5, most: int = 5) -> DataFrame:
    """(project_id, path, risk_score, rank): the riskiest files of each project."""
    return top_per_project(files.filter(F.col("risk_score") > above), [F.desc("risk_score"), F.asc("path"), F.asc("id")], most).select("project_id", "path", "risk_score", "rank")


def high_debt(metrics: DataFrame, files: DataFrame, above: float = 5, most: int = 10) -> DataFrame:
    """(project_id, path, debt, instability, rank): the files of each project with most debt."""
    joined = metrics.drop("project_id").join(files.select(F.col("id").alias("file_id"), "project_id", "path"), "file_id").filter(F.col("debt") > above)
    return top_per_project(joined, [F.desc("debt"), F.asc("path"), F.asc("file_id")], most).select("project_id", "path", "debt", "instability", "rank")


def cycle_report(metrics: DataFrame, files: DataFrame, symbols: DataFrame, component: DataFrame) -> DataFrame:
    """(project_id, path, instability): files with a symbol in a cycle, to be ordered by instability."""
    inside = symbols.join(component.select("id").distinct(), "id", "left_semi").select("file_id").distinct()
    return metrics.join(inside, "file_id", "left_semi").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("project_id", "path", "instability")


def marker_report(symbols: DataFrame, files: DataFrame, report: str = "audit") -> DataFrame:
    """(project_id, path, name, line_start) of symbols whose content holds a marker."""
    marked = symbols.filter(has_marker(F.col("content"), report)).select("id", "project_id", "file_id", "name", "line_start")
    return marked.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("project_id", "id", "path", "name", "line_start")


def project_audit(symbols: DataFrame, cyclic: DataFrame | None = None) -> DataFrame:
    """(project_id, symbols, embedded_pct, summarised_pct, functions, modules, with_todo, in_cycle) of every project, in one pass."""
    base = symbols
    if cyclic is not None:
        base = base.join(cyclic.select("id").distinct().withColumn("_c", F.lit(1)), "id", "left")
    else:
        base = base.withColumn("_c", F.lit(None).cast("int"))
    per = base.groupBy("project_id").agg(
        F.count("*").alias("symbols"), F.count("embedding").alias("embedded"), F.count("summary").alias("summarised"),
        F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind").isin("module", "class")).alias("modules"),
        F.count_if(has_marker(F.col("content"), "agents")).alias("with_todo"), F.count("_c").alias("in_cycle"),
    )
    return per.select("project_id", "symbols", percentage(F.col("embedded"), F.col("symbols")).alias("embedded_pct"), percentage(F.col("summarised"), F.col("symbols")).alias("summarised_pct"), "functions", "modules", "with_todo", "in_cycle")


def file_audit(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every file with its metrics (0 without) and its number of authors."""
    m = metrics.select("file_id", "afferent", "efferent", "instability", "debt")
    return files.join(m, files.id == m.file_id, "left").select(
        F.col("id").alias("file_id"), "path", "language", "line_count", "risk_score", F.coalesce(F.size("git_authors"), F.lit(0)).alias("authors"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("afferent", "efferent", "instability", "debt")],
    )


def file_listing(files: DataFrame, text: str = "") -> DataFrame:
    """(project_id, path, language, line_count, risky): files whose path contains ``text`` or whose language is it."""
    wanted = files.filter(F.lower("path").contains(text.lower()) | (F.col("language") == text)) if text else files
    return wanted.select("project_id", "path", "language", "line_count", (F.coalesce("risk_score", F.lit(0.0)) > 10).alias("risky"))


def languages(files: DataFrame) -> DataFrame:
    """(project_id, language, files), the null language included."""
    return files.groupBy("project_id", "language").agg(F.count("*").alias("files"))


def usage_snapshot(events: DataFrame) -> DataFrame:
    """Calls of every project (null is one): counts by status, tokens, time, success rate."""
    per = events.groupBy("project_id").agg(
        F.count("*").alias("calls"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "error", "timeout")],
        F.coalesce(F.sum("response_tokens"), F.lit(0)).alias("response_tokens"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 3).alias("avg_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0)).alias("max_ms"), F.max("inserted_at").alias("last_call"),
    )
    return per.withColumn("success_rate", percentage(F.col("success"), F.col("calls"))).withColumn("saved_ms", F.col("saved_tokens"))


def usage_per_tool(events: DataFrame) -> DataFrame:
    """(project_id, tool_name, calls)."""
    return events.groupBy("project_id", "tool_name").agg(F.count("*").alias("calls"))


def knowledge_tokens(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, kb_tokens): the sum of the chunks' tokens, or a quarter of the files' bytes, rounded up, where that is 0."""
    tokens = chunks.groupBy("project_id").agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("t"))
    size = files.groupBy("project_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"))
    joined = tokens.join(size, "project_id", "full")
    return joined.select("project_id", F.when(F.coalesce("t", F.lit(0)) > 0, F.col("t")).otherwise(F.ceil(F.coalesce("b", F.lit(0)) / 4)).cast("bigint").alias("kb_tokens"))


def index_snapshot(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Size and coverage of every project's index."""
    f = files.groupBy("project_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.max("last_indexed").alias("last_indexed"))
    s = symbols.groupBy("project_id").agg(F.count("*").alias("symbols"), F.count("embedding").alias("embedded"), F.count("summary").alias("summarised"))
    c = chunks.groupBy("project_id").agg(F.count("*").alias("chunks"))
    joined = f.join(s, "project_id", "full").join(c, "project_id", "full").join(knowledge_tokens(chunks, files), "project_id", "full")
    joined = joined.fillna(0, ["files", "lines", "bytes", "symbols", "embedded", "summarised", "chunks", "kb_tokens"])
    return joined.withColumn("embedded_pct", percentage(F.col("embedded"), F.col("symbols"))).withColumn("summarised_pct", percentage(F.col("summarised"), F.col("symbols")))


def record_calls(calls: DataFrame, kb: DataFrame) -> DataFrame:
    """Usage events of raw calls (project_id, tool_name, status, response, duration_ms): unknown states are errors, saved tokens count on success only."""
    status = F.when(F.lower("status").isin("success", "error", "timeout"), F.lower("status")).otherwise("error")
    joined = calls.join(kb, "project_id", "left").withColumn("status", status).withColumn("response_tokens", ceil_tokens(F.col("response")))
    saved = F.when(F.col("status") == "success", F.greatest(F.coalesce("kb_tokens", F.lit(0)) - F.col("response_tokens"), F.lit(0))).otherwise(0).cast("bigint")
    return joined.withColumn("saved_tokens", saved).withColumn("duration_ms", clamped(F.col("duration_ms"))).drop("kb_tokens", "response")


def with_place(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's path and language; symbols of unknown files keep nulls."""
    return symbols.join(files.select(F.col("id").alias("file_id"), "path", F.col("language").alias("file_language")), "file_id", "left")


def listing_text(symbols: DataFrame) -> DataFrame:
    """(file_id, listing): ``kind name`` of a file's symbols in order of their lines, joined by commas."""
    rows = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("line_start", F.lit(0)).alias("l"), "id", F.concat_ws(" ", "kind", "name").alias("t")))).alias("s"))
    return rows.select("file_id", F.array_join(F.transform("s", lambda x: x["t"]), ", ").alias("listing"))
