"""The serving tools, each a lazy frame; turning rows into text is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import preview
from corvane.operators.graph import find_symbol, impact, neighbours
from corvane.operators.metrics import file_audit, file_listing, project_audit, with_place
from corvane.operators.retrieval import hybrid_search, related


def checked_query(text: str, most: int = 200) -> str:
    """The query, if it is neither blank nor too long."""
    if not text or not text.strip() or len(text) > most:
        raise ValueError(f"a query has 1 to {most} characters")
    return text


def checked_path(path: str) -> str:
    """The path, if it is relative and stays within the project."""
    if path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError("a path is relative to the project and has no ..")
    return path


def search(texts: list[tuple[str, str]], vectors: DataFrame, symbols: DataFrame, files: DataFrame, edge: DataFrame, limit: int = 5) -> DataFrame:
    """(query, rank, id, combined_score, engines, name, kind, path, preview) of a hybrid search."""
    for _, text in texts:
        checked_query(text)
    found = hybrid_search(texts, vectors, symbols, edge, limit * 4, limit)
    placed = with_place(symbols.select("id", "file_id", "name", "kind", "content"), files).select("id", "name", "kind", "path", preview(F.col("content"), 200).alias("preview"))
    return found.join(placed, "id").select("query", "rank", "id", "combined_score", "engines", "name", "kind", "path", "preview")


def context(task: str, vectors: DataFrame, symbols: DataFrame, files: DataFrame, edge: DataFrame, max_symbols: int = 8) -> DataFrame:
    """The symbols that matter for a task, with more of their text."""
    found = hybrid_search([("task", checked_query(task))], vectors, symbols, edge, max_symbols * 3, max_symbols)
    placed = with_place(symbols.select("id", "file_id", "name", "kind", "signature", "content"), files)
    return found.join(placed, "id", "left").select("rank", "id", "name", "kind", "signature", "path", preview(F.col("content"), 800).alias("preview"))


def symbol(name: str, symbols: DataFrame, files: DataFrame, edge: DataFrame, each: int = 20) -> DataFrame:
    """(role, id, name, qualified_name, kind, path, line_start): a symbol's matches, callers and callees, at most ``each`` of the latter, in order of qualified name."""
    own = find_symbol(symbols, checked_query(name))
    matches = with_place(own, files).select(F.lit("match").alias("role"), "id", "name", "qualified_name", "kind", "path", "line_start")
    first = own.orderBy("match", F.length("qualified_name"), "id").limit(1).select(F.col("id").alias("seed"))
    out = matches
    for role in ("callers", "callees"):
        near = neighbours(edge, symbols, files, role).join(first, "seed").withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy("qualified_name", "id"))).filter(F.col("_r") <= each)
        out = out.unionByName(near.select(F.lit(role).alias("role"), "id", "name", "qualified_name", "kind", "path", "line_start"))
    return out


def impact_of(name: str, symbols: DataFrame, files: DataFrame, edge: DataFrame, depth: int = 3, direction: str = "out") -> DataFrame:
    """(hop, id, name, qualified_name, path) of what a symbol's change reaches."""
    first = find_symbol(symbols, checked_query(name), 1).select(F.col("id").alias("seed"))
    return impact(edge, first, depth, direction).join(with_place(symbols, files), "id").select("hop", "id", "name", "qualified_name", "path")


def audit(symbols: DataFrame, files: DataFrame, metrics: DataFrame, path: str | None = None) -> DataFrame:
    """A project's or one file's audit."""
    return project_audit(symbols) if path is None else file_audit(files, metrics).filter(F.col("path") == checked_path(path))


def list_files(files: DataFrame, text: str = "") -> DataFrame:
    """Files in order of their path."""
    return file_listing(files, text).orderBy("path")


def similar_symbols(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """Nearest symbols of the symbols in ``ids`` (id), without themselves."""
    asked = symbols.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    return related(symbols, asked)
