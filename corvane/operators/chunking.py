"""Cutting texts into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import floor_tokens, line_count


def repaired(window: Column) -> Column:
    """A window of bytes as text: up to three bytes are dropped from its end until it is valid UTF-8; empty if none is."""
    tries = [F.substring(window, F.lit(1), F.octet_length(window) - n) for n in range(4)]
    texts = [F.when(F.octet_length(window) >= n, F.try_validate_utf8(t.cast("string"))) for n, t in enumerate(tries)]
    return F.coalesce(*texts, F.lit(""))


def windows(files: DataFrame, text: str = "content", tokens: int = 512, overlap: int = 64, mode: str = "characters") -> DataFrame:
    """Overlapping windows of 4 ``tokens`` characters, one row each, with chunk_index, content, line_start, line_end, token_count.

    Mode ``bytes`` counts bytes, repairs the tail of a window that ends within a
    character and gives the empty text for one that begins within one. Empty
    and null texts give no window; other columns are kept.
    """
    size, stride = tokens * 4, (tokens - overlap) * 4
    whole = F.col(text)
    length = F.length(whole) if mode == "characters" else F.octet_length(whole)
    at = F.explode(F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(stride))))
    cut = files.withColumn("_at", at).withColumn("chunk_index", (F.col("_at") / stride).cast("int"))
    if mode == "characters":
        piece, before = F.substring(whole, F.col("_at") + 1, F.lit(size)), F.substring(whole, F.lit(1), F.col("_at"))
    else:
        raw = F.encode(whole, "UTF-8")
        piece, before = repaired(F.substring(raw, F.col("_at") + 1, F.lit(size))), F.decode(F.substring(raw, F.lit(1), F.col("_at")), "ISO-8859-1")
    out = cut.withColumn("_piece", piece).withColumn("line_start", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int"))
    out = out.withColumn("line_end", (F.col("line_start") + line_count(F.col("_piece"))).cast("int")).withColumn("token_count", floor_tokens(F.col("_piece")).cast("int"))
    return out.drop(text, "_at").withColumnRenamed("_piece", text)


def plain_windows(files: DataFrame, text: str = "content", size: int = 2048) -> DataFrame:
    """Windows without overlap, of ``size`` bytes; a byte that is part of no character there is dropped. line_start is 0."""
    raw = F.encode(F.col(text), "UTF-8")
    cut = files.withColumn("_at", F.explode(F.when(F.octet_length(text) > 0, F.sequence(F.lit(0), F.octet_length(text) - 1, F.lit(size)))))
    piece = F.make_valid_utf8(F.substring(raw, F.col("_at") + 1, F.lit(size)).cast("string"))
    out = cut.withColumn("chunk_index", (F.col("_at") / size).cast("int")).withColumn("_piece", piece)
    count = F.floor(F.least(F.lit(size), F.octet_length(text) - F.col("_at")) / 4).cast("int")
    return out.withColumn("token_count", count).withColumn("line_start", F.lit(0)).drop(text, "_at").withColumnRenamed("_piece", text)


def line_windows(records: DataFrame, text: str = "content", lines: int = 51, stride: int = 41, keep_tail: bool = False) -> DataFrame:
    """Windows of whole lines; incomplete ones at the end are left out unless ``keep_tail``. line_start counts from 1, line_end is inclusive."""
    split = F.split(F.col(text), "\n")
    last = F.size(split) - 1 if keep_tail else F.size(split) - lines
    cut = records.filter(F.length(text) > 0).withColumn("_lines", split).withColumn("_at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))))
    piece = F.slice("_lines", F.col("_at") + 1, F.lit(lines))
    out = cut.withColumn("chunk_index", (F.col("_at") / stride).cast("int")).withColumn("line_start", F.col("_at") + 1).withColumn("line_end", F.col("_at") + F.size(piece))
    return out.withColumn("_piece", F.array_join(piece, "\n")).withColumn("token_count", floor_tokens(F.col("_piece")).cast("int")).drop(text, "_lines", "_at").withColumnRenamed("_piece", text)


def symbol_chunks(symbols: DataFrame, text: str = "content", tokens: int = 512) -> DataFrame:
    """A symbol's content as one chunk if it has at most ``tokens``, else as line windows."""
    small = symbols.filter((F.length(text) > 0) & (floor_tokens(F.col(text)) <= tokens))
    whole = small.select("*", F.lit(0).alias("chunk_index"), F.lit(1).alias("first"), line_count(F.col(text)).cast("int").alias("last"), floor_tokens(F.col(text)).cast("int").alias("token_count"))
    large = symbols.filter(floor_tokens(F.col(text)) > tokens).drop("line_start", "line_end", "chunk_index", "token_count")
    cut = line_windows(large, text).withColumnsRenamed({"line_start": "first", "line_end": "last"})
    keep = [c for c in whole.columns if c in cut.columns]
    return whole.select(keep).unionByName(cut.select(keep))
