"""Sources that are files: source trees, version history, dependency graphs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import content_hash, line_count
from corvane.operators.parsers import language, supported

#: Folders that are not walked.
IGNORED = "_build deps node_modules target .git dist coverage __pycache__ .elixir_ls .dart_tool vendor Pods .gradle .venv build pubspec.lock package-lock.json yarn.lock tmp".split()
#: Places that are never indexed, those that are only with a project's marker or by force, and the markers.
FORBIDDEN = "/etc /var /proc /sys ~/.ssh ~/.aws ~/.kube ~/.gnupg ~/.config/gh".split()
SENSITIVE = "~ /home /root /Users".split()
MARKERS = "mix.exs package.json pyproject.toml Cargo.toml go.mod pom.xml build.gradle project.clj rebar3.config".split()


def ignored(relative: Column, folders: list[str] | None = None) -> Column:
    """Whether any part of a project-relative path is an ignored name."""
    return F.arrays_overlap(F.split(relative, "/"), F.array(*[F.lit(x) for x in (folders or IGNORED)]))


def _under(path: Path, places: list[str]) -> bool:
    return any(path.is_relative_to(Path(p).expanduser()) for p in places)


def check_root(path: str, force: bool = False) -> Path:
    """The folder, if it may be indexed: it exists, is in no forbidden place, and in a sensitive one has a project's marker unless ``force``."""
    root = Path(path).expanduser().resolve()
    if str(root) == root.anchor or _under(root, FORBIDDEN):
        raise PermissionError(f"{root} is not to be indexed")
    if not root.is_dir():
        raise NotADirectoryError(str(root))
    if not force and _under(root, SENSITIVE) and not any((root / m).is_file() for m in MARKERS):
        raise ValueError(f"{root} has no project marker")
    return root


def scan(spark: SparkSession, root: str, project_id: str, folders: list[str] | None = None, max_depth: int | None = None, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Source files below ``root`` as (project_id, path, language, size_bytes, line_count, content_hash, last_modified, content, left_out).

    The path filter needs only names; contents are read for what remains.
    Nothing is left out unless the caller sets a limit: then files that are
    deeper, larger or, in order of paths, beyond the number come without
    content and with the reason in ``left_out``, which is null for all others.
    """
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace("path", rf"^(?:file:)?/*{re.escape(base.replace('file:', '').lstrip('/'))}", "")
    kept = found.withColumn("path", relative).filter(supported(F.col("path")) & ~ignored(F.col("path"), folders))
    reasons = []
    if max_depth is not None:
        reasons.append(F.when(F.size(F.split("path", "/")) > max_depth, "too deep"))
    if max_bytes is not None:
        reasons.append(F.when(F.col("length") > max_bytes, "too large"))
    kept = kept.withColumn("left_out", F.coalesce(*reasons, F.lit(None).cast("string")))
    if max_files is not None:
        first = kept.filter("left_out is null").select("path").orderBy("path").limit(max_files).withColumn("_in", F.lit(True))
        kept = kept.join(first, "path", "left").withColumn("left_out", F.coalesce("left_out", F.when(F.col("_in").isNull(), "too many"))).drop("_in")
    raw = F.when(F.col("left_out").isNull(), F.col("content"))
    text = F.decode(F.col("content"), "UTF-8")
    kept = kept.withColumn("content", raw)
    return kept.select(F.lit(project_id).alias("project_id"), "path", language(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), line_count(text).cast("int").alias("line_count"), content_hash(F.col("content")).alias("content_hash"), F.col("modificationTime").alias("last_modified"), text.alias("content"), "left_out")


def read_paths(paths: DataFrame, root: str, project_id: str) -> DataFrame:
    """What :func:`scan` gives, of given paths (path, relative to ``root``) only; the executors read them from the shared file system, and what is gone has no content."""
    base = root.removeprefix("file://").rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                file = Path(base, name)
                inside = ".." not in Path(name).parts and not Path(name).is_absolute()
                found.append((file.read_bytes(), file.stat().st_mtime_ns // 1000) if inside and file.is_file() else (None, None))
            raw = pa.array([x[0] for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array([x[1] for x in found], pa.timestamp("us", "UTC"))], names=["path", "raw", "last_modified"])

    text = F.decode("raw", "UTF-8")
    got = paths.select("path").mapInArrow(read, "path string, raw binary, last_modified timestamp")
    return got.select(
        F.lit(project_id).alias("project_id"), "path", language(F.col("path")).alias("language"), F.octet_length("raw").cast("bigint").alias("size_bytes"), line_count(text).cast("int").alias("line_count"),
        content_hash(F.col("raw")).alias("content_hash"), "last_modified", text.alias("content"), F.lit(None).cast("string").alias("left_out"),
    )


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, author, path) of a history written by ``git log --no-merges --name-only --format=%x01%H%x02%ae``."""
    raw = spark.read.option("lineSep", "\x01").text(path).filter(F.trim("value") != "")
    head = F.split(F.substring_index("value", "\n", 1), "\x02")
    body = F.split(F.expr("substring(value, position('\n' in value) + 1)"), "\n")
    return raw.select(F.get(head, F.lit(0)).alias("commit"), F.get(head, F.lit(1)).alias("author"), F.explode(body).alias("path")).filter(F.trim("path") != "")


def resolve_project(projects: DataFrame, id: str | None = None, path: str | None = None) -> DataFrame:  # noqa: A002
    """The project of an id, else of a path, else that scanned last (never scanned ones come first, then the smallest id)."""
    if id is not None:
        return projects.filter(F.col("id") == id).limit(1)
    if path is not None:
        return projects.filter(F.col("path") == path).limit(1)
    return projects.orderBy(F.desc_nulls_first("last_scanned"), "id").limit(1)
