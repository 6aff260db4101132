"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is not part of a search term.
NOT_A_TERM = r"[^\p{L}\p{N}_\s]"


def floor_tokens(text: Column) -> Column:
    """Estimated tokens of a chunk: a quarter of its characters, rounded down; null gives 0."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("bigint")


def ceil_tokens(text: Column) -> Column:
    """Estimated tokens of an answer: a quarter of its characters, rounded up; null and empty give 0."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("bigint")


def line_count(text: Column) -> Column:
    """Pieces between line feeds; null gives null."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def preview(text: Column, size: int) -> Column:
    """The first ``size`` characters on one line."""
    return F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" "))


def snippet(text: Column, line: Column) -> Column:
    """Lines ``line`` and ``line`` + 1 (from 1); empty if there is no such line."""
    lines = F.split(text, "\n")
    there = (line > 0) & (line <= F.size(lines))
    return F.when(there, F.array_join(F.slice(lines, F.greatest(line, F.lit(1)), 2), "\n")).otherwise("")


def content_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, clamped to the text) joined by line feeds."""
    lines = F.split(text, "\n")
    first = F.least(F.greatest(start, F.lit(1)), F.size(lines))
    last = F.least(F.greatest(end, first), F.size(lines))
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def embed_text(kind: Column, qualified_name: Column, signature: Column, docstring: Column, content: Column) -> Column:
    """What is embedded for a symbol: its parts, nulls left out, joined by spaces; of the content the first 600 characters."""
    return F.concat_ws(" ", kind, qualified_name, signature, docstring, F.substring(content, 1, 600))


def search_terms(query: Column) -> Column:
    """Terms of a query: lower case, other characters than letters, digits and _ removed, one-character terms left out."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), NOT_A_TERM, ""), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 1)


def tokens(text: Column) -> Column:
    """Tokens of a searched text, cut as queries are."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_A_TERM, ""), r"\s+"), lambda w: F.length(w) > 0)


def content_hash(content: Column, most: int = 50 * 1024 * 1024) -> Column:
    """SHA-256 in lower-case hex; null for content of over ``most`` bytes."""
    return F.when(F.octet_length(content) <= most, F.sha2(content, 256))


def summary_hash(content: Column) -> Column:
    """MD5 in upper-case hex."""
    return F.upper(F.md5(content))


def extension(path: Column) -> Column:
    """The last extension of a path with its dot, in lower case; empty if it has none or only a leading dot."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def arity(name: Column) -> tuple[Column, Column]:
    """(name, arity) of ``name/2``; the arity is null unless all that follows the last slash is a number."""
    number = F.regexp_extract(name, r"^(.+)/(\d{1,9})$", 2)
    return F.when(number != "", F.regexp_extract(name, r"^(.+)/(\d{1,9})$", 1)).otherwise(name), F.when(number != "", number.try_cast("int"))


def tool_name(name: Column, prefix: str = "corvane", aliases: dict[str, str] | None = None) -> Column:
    """A tool's plain name: a repeated ``prefix_`` removed, then short names resolved."""
    plain = F.regexp_replace(F.lower(F.trim(name)), rf"^(?:{prefix}[_.-])+", "")
    for short, full in (aliases or {"find": "search", "sym": "symbol", "ctx": "context", "ls": "files"}).items():
        plain = F.when(plain == short, full).otherwise(plain)
    return plain


def shortened_json(value: Column, most: int = 100_000) -> Column:
    """JSON text of at most ``most`` characters, with a mark where it was cut."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("...[truncated]"))).otherwise(value)


def answer_text(response: Column) -> Column:
    """The text of a model's answer: a JSON object's ``content`` or the text itself, trimmed; null if blank."""
    inner = F.when(F.ltrim(response).startswith("{"), F.coalesce(F.get_json_object(response, "$.content"), F.lit(""))).otherwise(response)
    return F.nullif(F.trim(inner), F.lit(""))


def human_bytes(n: Column) -> Column:
    """Bytes with a unit, one decimal from KB on."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.1f GB", n / 1024**3))
    )


def human_duration(ms: Column) -> Column:
    """Milliseconds as ms, s, min or h."""
    ms = F.coalesce(ms, F.lit(0)).cast("double")
    return (
        F.when(ms < 1000, F.format_string("%d ms", ms.cast("bigint"))).when(ms < 60_000, F.format_string("%.1f s", ms / 1000))
        .when(ms < 3_600_000, F.format_string("%.1f min", ms / 60_000)).otherwise(F.format_string("%.1f h", ms / 3_600_000))
    )


def percentage(part: Column, whole: Column) -> Column:
    """100 part / whole with one decimal; 0 if the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 1))


def clamped(value: Column) -> Column:
    """A whole number of at least 0; null gives 0."""
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("bigint")


def fresh(at: Column, now: Column, seconds: int = 60) -> Column:
    """Whether ``at`` lies less than ``seconds`` before ``now``, and not after it."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return (age >= 0) & (age < seconds)
