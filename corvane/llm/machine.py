"""Files that nobody wrote by hand.

Five kinds of evidence: recurrence, what tools call their output and where
third-party copies lie (path), sizes that no hand-written file has, a notice in
the comment that opens a part of the file, and tables of numbers. Recurrence is
measured by winnowing: the normalised token stream is hashed in k-grams, the
least hash of each window is a fingerprint, and a file is a vendored copy if
most of its fingerprints stand in files of many unrelated repositories, which
are those of different owners. Numbers are one token there, so all tables of
numbers are alike; k-grams of numbers alone are no fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.rolling import Substrings, code_points, mix
from corvane.plans.lineage import cut
from corvane.sources.tables import current, latest

GRAM, WINDOW = 8, 8
_BATCH = 1_500_000
#: A file is a copy if this share of its fingerprints stands in so many projects or more.
SHARE, PROJECTS = 0.8, 16
#: A file is a table of numbers if this share of its words are numbers.
NUMBERS = 0.8
#: Sizes that no hand-written file reaches.
MOST_LINES, BYTES_PER_LINE = 8000, 200
#: Folders of third-party copies, anywhere in a path.
VENDOR_FOLDERS = "node_modules bower_components jspm_packages site-packages dist-packages pods carthage vendor _vendor third_party third-party thirdparty godeps .yarn .bundle".split()
#: Folders of tools' output, anywhere in a path.
OUTPUT_FOLDERS = "generated __generated__ autogenerated auto-generated codegen autogen .dart_tool __pycache__".split()
#: Folders that are such only at the top of a project.
TOP_FOLDERS = "deps dist build out target .next .nuxt coverage venv .venv".split()
#: Files in which package managers keep what they resolved.
LOCK_FILES = "package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock composer.lock gemfile.lock cargo.lock poetry.lock pipfile.lock pdm.lock uv.lock mix.lock rebar.lock go.sum pubspec.lock podfile.lock packages.lock.json bun.lock bun.lockb flake.lock gradle.lockfile .terraform.lock.hcl".split()
#: Endings that generators and bundlers give their files.
_OUTPUT_NAME = (
    r"\.(?:pb\.(?:go|cc|h|rb|swift|dart)|pb\.gw\.go|g\.(?:dart|cs|cpp|h)|g\.i\.cs|freezed\.dart|gr\.dart|mocks\.dart|designer\.(?:cs|vb)|generated\.\w+|gen\.\w+|auto\.\w+|tab\.(?:c|h|cc|cpp)|yy\.(?:c|cc)|deepcopy\.go|pbobjc\.[hm])$"
    r"|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:js|ts|rb)$|_grpc_pb\.js$|(?:^|[_.])zz_generated\b|_generated\.\w+$|^lex\.yy\.c$|^moc_\w+\.cpp$|^ui_\w+\.h$|^qrc_\w+\.cpp$"
    r"|[.-]min\.(?:js|mjs|cjs|css)$|\.(?:bundle|chunk|packed)\.(?:js|mjs|css)$|\.[0-9a-f]{8,}\.(?:\w+\.)?(?:js|mjs|css)$|\.map$"
    r"|[-.]v?\d+\.\d+(?:\.\d+)?(?:[-.](?:min|slim|pack|prod|umd|esm))*\.(?:js|mjs|css)$"
)
#: Notices of generators and of third-party code.
_NOTICE = (
    r"(?i)^\W*(?:@generated\b|.*\b(?:code generated|auto-?generated|automatically generated|machine[- ]generated|generated (?:by|from|using|with)\b.*(?:\bdo not\b|\d|tool|compiler|generator)|(?:do not|don't|never) (?:edit|modify|change)(?: (?:this|by|it|manually)\b)|(?:changes|edits|modifications)\b.{0,40}\bwill be (?:lost|overwritten|discarded)|this file (?:is|was) (?:auto)?-?generated)"
    r"|.*\bsee (?:the )?(?:accompanying )?(?:notice|license|copying)(?:\.\w+)? (?:file )?for (?:\w+ )?(?:terms|details|conditions)|.*\b(?:vendored|bundled|copied) from\b|! ?\w[\w.-]* v?\d+\.\d+)"
)

#: What a text with a notice holds in lower case, by which texts without one are told apart; every word of a row.
_NOTICE_WORDS = [("generated",), ("do not", "edit"), ("do not", "modify"), ("do not", "change"), ("don't", "edit"), ("don't", "modify"), ("don't", "change"), ("never", "edit"), ("never", "modify"), ("never", "change"), ("will be lost",), ("will be overwritten",), ("will be discarded",), ("see", "notice"), ("see", "license"), ("see", "copying"), ("vendored from",), ("bundled from",), ("copied from",)]
#: The blank lines and comments that open a text.
_OPENING = r"^(?:[ \t]*(?:(?:#|//|/\*|\*|--|;|%|<!--|[\"]{3}|'{3}|\{-|\(\*|REM\b|!)[^\n]*)?(?:\n|\z))+"


def has_notice(content: Column) -> Column:
    """Whether a line of the comment that opens a text, or its first line, is a notice of a generator or of third-party code."""
    low = F.lower(content)
    every = lambda words: reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])
    maybe = reduce(lambda a, b: a | b, map(every, _NOTICE_WORDS)) | F.regexp_replace(F.substring(content, 1, 40), r"\s", "").rlike(r"^\W*!")
    top = F.concat_ws("\n", F.substring_index(F.ltrim(content), "\n", 1), F.regexp_extract(F.replace(content, F.lit("\r"), F.lit("")), _OPENING, 0))
    return F.coalesce(F.when(maybe, F.regexp_replace(top, "\r", "").rlike("(?m)" + _NOTICE)).otherwise(False), F.lit(False))


def machine_path(path: Column) -> Column:
    """Whether a path alone tells a tool's output or a third-party copy; words inside names are none."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    parts = F.split(F.regexp_replace(low, "^[./]+", ""), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    inside = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in (*VENDOR_FOLDERS, *OUTPUT_FOLDERS)]))
    top = (F.size(parts) > 1) & F.get(parts, F.lit(0)).isin(*TOP_FOLDERS)
    return F.coalesce(inside | top | name.isin(*LOCK_FILES) | name.rlike(_OUTPUT_NAME), F.lit(False))


def _winnowed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, fingerprint) of the winnowed hashes of each text's normalised token stream, and how many words and numbers each text has."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low])
    codes = code_points("\n".join(low) + "\n")
    digit = (codes >= 48) & (codes <= 57)
    word = digit | ((codes >= 97) & (codes <= 122)) | (codes == 95) | (codes > 127)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    record = np.searchsorted(np.cumsum(sizes), begin, "right")
    name = Substrings(codes)(begin, end)
    number = digit[begin]
    name[number] = 1  # all numbers are one token
    words, numbers = np.bincount(record, minlength=len(texts)), np.bincount(record[number], minlength=len(texts))
    n = len(name) - GRAM + 1
    if n < 1:
        return np.zeros(0, int), np.zeros(0, np.uint64), words, numbers
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = mix(h * np.uint64(0xA24BAED4963EE407) + name[i : i + n])
    before = np.concatenate([[0], np.cumsum(number)])
    whole = (record[:n] == record[GRAM - 1 : GRAM - 1 + n]) & (before[GRAM:] - before[:-GRAM] < GRAM)
    h, record = h[whole], record[:n][whole]
    if not len(h):
        return record, h, words, numbers
    least = h.copy()
    for i in range(1, min(WINDOW, len(h))):  # the least of each window that stays within its text
        same = record[i:] == record[: len(record) - i]
        least[: len(h) - i] = np.where(same, np.minimum(least[: len(h) - i], h[i:]), least[: len(h) - i])
    pick = np.append(True, (least[1:] != least[:-1]) | (record[1:] != record[:-1]))
    return record[pick], least[pick], words, numbers


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, fingerprint): the winnowed hashes of each text's normalised token stream."""
    return _winnowed(texts)[:2]


def owners(projects: DataFrame) -> DataFrame:
    """(project_id, owner): the remote without its last part, as all copies and forks within one owner's repositories are related; a project without a remote is its own owner."""
    remote = F.lower(F.regexp_replace(F.regexp_replace("git_remote", r"^[a-z+]+://(?:[^/@]*@)?|^[^/@:]*@", ""), r"(?:\.git)?/*$", ""))
    whose = F.regexp_extract(remote, r"^(.+)[/:][^/:]+$", 1)
    return current(projects, "git_remote").select(F.col("id").alias("project_id"), F.when(whose != "", whose).otherwise(F.col("id")).alias("owner"))


def _latest(chunks: DataFrame, *columns: str) -> DataFrame:
    """The columns of the latest deliveries; chunks without ids are all different."""
    return current(chunks, *columns).drop("id") if "id" in chunks.columns else chunks.select(*columns)


def copied_files(chunks: DataFrame, share: float = SHARE, projects: int = PROJECTS, of: DataFrame | None = None) -> DataFrame:
    """(file_id, copied, numbers): whether most of a file's fingerprints stand in the files of ``projects`` owners or more, and whether most of its words are numbers; files that are neither give no row.

    ``of`` tells each project's owner (project_id, owner); without it every
    project is an owner. Fingerprints are made once and written; (fingerprint,
    owner) pairs are made distinct within each task before they are shuffled,
    and only fingerprints that are common meet the files' own again.
    """

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, held = batch.column("content").to_pylist(), 0, 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held > _BATCH or i + 1 == len(texts):
                    record, h, words, numbers = _winnowed([x or "" for x in texts[begin : i + 1]])
                    count = len(words)
                    edge = np.searchsorted(record, np.arange(count + 1))
                    prints = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(h.view(np.int64)))
                    kept = [batch.column(c).slice(begin, count) for c in columns]
                    yield pa.RecordBatch.from_arrays([*kept, prints, pa.array(words, pa.int64()), pa.array(numbers, pa.int64())], names=[*columns, "prints", "words", "numbers"])
                    begin, held = i + 1, 0

    columns = ["file_id", "project_id", *[c for c in ("id", "updated_at", "inserted_at") if c in chunks.columns]]
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in columns)
    counted = chunks.select(*columns, "content").mapInArrow(winnow, f"{kinds}, prints array<bigint>, words bigint, numbers bigint")
    made = cut(_latest(counted, "file_id", "project_id", "prints", "words", "numbers"))
    owned = made if of is None else made.join(of, "project_id", "left")
    owner = F.col("project_id") if of is None else F.coalesce("owner", "project_id")
    spread = owned.select(owner.alias("owner"), F.explode("prints").alias("print")).distinct().groupBy("print").agg(F.count("*").alias("n")).filter(F.col("n") >= projects).select("print")
    common = made.select("file_id", F.explode("prints").alias("print")).join(spread, "print").groupBy("file_id").agg(F.count("*").alias("common"))
    totals = made.groupBy("file_id").agg(F.sum(F.size("prints")).alias("prints"), F.sum("words").alias("words"), F.sum("numbers").alias("numbers"))
    return totals.join(common, "file_id", "left").select(
        "file_id", F.coalesce((F.col("prints") > 0) & (F.col("common") >= share * F.col("prints")), F.lit(False)).alias("copied"),
        F.coalesce((F.col("words") >= GRAM) & (F.col("numbers") >= NUMBERS * F.col("words")), F.lit(False)).alias("numbers"),
    ).filter("copied or numbers")


def machine_made(files: DataFrame, chunks: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(file_id, by_path, by_size, by_notice, by_copies, by_numbers) of every file that is not hand-written.

    A null size is judged by the file's chunks, if they hold code; null languages
    and line counts are judged by the rest. Of several deliveries of a file the
    latest counts. Chunks of no file and files without chunks are fine.
    """
    order = [c for c in ("updated_at", "last_indexed", "inserted_at") if c in files.columns]
    own = latest(files.select("id", "path", "size_bytes", "line_count", *order), ["id"], order)
    spaces = F.length("content") - F.length(F.regexp_replace("content", "[ \\t]", ""))
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    figures = {"notice": has_notice(F.col("content")), "bytes": F.octet_length("content"), "chars": F.length("content"), "lines": lines, "spaces": spaces}
    part = _latest(chunks.withColumns(figures), "file_id", *figures)
    seen = part.groupBy("file_id").agg(
        F.max("notice").alias("notice"), (F.sum("bytes") / F.sum("lines")).alias("per_line"), F.try_divide(F.sum("spaces"), F.sum("chars")).alias("loose"), F.try_divide(F.sum("bytes"), F.sum("chars")).alias("width"),
    )
    joined = own.withColumnRenamed("id", "file_id").join(seen, "file_id", "left").join(copied_files(chunks, of=of), "file_id", "left")
    dense = (F.col("per_line") >= BYTES_PER_LINE) & (F.col("loose") < 0.08) & (F.col("width") < 1.2)  # code without line breaks, not prose of other scripts
    by_size = (F.col("line_count") >= MOST_LINES) | F.when(F.col("size_bytes").isNotNull() & (F.col("line_count") > 0), F.col("size_bytes") / F.col("line_count") >= BYTES_PER_LINE).otherwise(dense)
    out = joined.select(
        "file_id", machine_path(F.col("path")).alias("by_path"), F.coalesce(by_size, F.lit(False)).alias("by_size"),
        F.coalesce("notice", F.lit(False)).alias("by_notice"), F.coalesce("copied", F.lit(False)).alias("by_copies"), F.coalesce("numbers", F.lit(False)).alias("by_numbers"),
    )
    return out.filter("by_path or by_size or by_notice or by_copies or by_numbers")
