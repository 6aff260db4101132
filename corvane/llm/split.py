"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method: agglomerative merging. A text is cut into atomic segments at every
blank line, line end and sentence end; adjacent pairs wait in a heap, and the
pair with the weakest boundary between its members is merged first while the
merged size plus the overlap fits the limit. What is left of the boundaries
are the strongest cuts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.tables import latest

LIMIT, OVERLAP = 2048, 256

#: Ends of a blank line (3), of a line (2), of a sentence (1).
_BOUNDARY = re.compile(r"(?P<blank>(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+)|(?P<line>\r\n|\n|\r)|(?P<sentence>[.!?。！？…؟।][\"')\]”’»]*(?:\s|(?<=[。！？।])))")
_STRENGTH = {"blank": 3, "line": 2, "sentence": 1}
_BREAK = 0


def boundaries(text: str, first: int) -> list[tuple[int, int]]:
    """(position, strength) of every natural boundary at ``first`` or later, in order."""
    found = [(m.end(), _STRENGTH[m.lastgroup]) for m in _BOUNDARY.finditer(text)]
    return [(at, s) for at, s in found if first <= at < len(text)]


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Where each piece's own part begins, the first at 0; one point if the text fits the limit."""
    if len(text) <= limit:
        return [0]
    room = limit - overlap
    atoms: list[tuple[int, int, int]] = []  # begin, end, strength of the boundary before it
    at, strength = 0, 9
    for end, after in [*boundaries(text, overlap), (len(text), 9)]:
        while end - at > (limit if at == 0 else room):  # no boundary in reach: the last white space, else anywhere
            most = limit if at == 0 else room
            space = max(text.rfind(" ", at + most // 2, at + most), text.rfind("\t", at + most // 2, at + most))
            stop = space + 1 if space > 0 and space + 1 >= overlap else at + most
            atoms.append((at, stop, strength))
            at, strength = stop, _BREAK
        atoms.append((at, end, strength))
        at, strength = end, after
    begin, end = [a[0] for a in atoms], [a[1] for a in atoms]
    left, right, alive = list(range(-1, len(atoms) - 1)), list(range(1, len(atoms) + 1)), [True] * len(atoms)
    heap = [(atoms[i][2], end[i] - begin[i - 1], i - 1, i) for i in range(1, len(atoms))]
    heapq.heapify(heap)
    while heap:
        s, size, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b or end[b] - begin[a] != size or size > (limit if begin[a] == 0 else room):
            continue
        alive[b], end[a], right[a] = False, end[b], right[b]
        if right[a] < len(atoms):
            left[right[a]] = a
            heapq.heappush(heap, (atoms[right[a]][2], end[right[a]] - begin[a], a, right[a]))
        if left[a] >= 0:
            heapq.heappush(heap, (atoms[a][2], end[a] - begin[left[a]], left[a], a))
    return [begin[i] for i in range(len(atoms)) if alive[i]]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of each piece; every piece but the first begins ``overlap`` characters before its own part."""
    starts = cut_points(text, limit, overlap)
    return [(max(0, s - overlap) if i else 0, e) for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True))]


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk whose content has more than ``limit`` code points.

    Input: id, file_id, content, line_start, chunk_index; other columns are
    ignored. Output: chunk_id, file_id, piece, pieces, content, line_start,
    line_end, chunk_index, token_count. Dropping the first ``overlap``
    characters of every piece but the first gives the content back.

    ``line_start`` counts from the chunk's own (1 where that is null or 0);
    ``chunk_index`` is the chunk's own, moved on by the pieces that earlier
    oversized chunks of the file gained; ``token_count`` is a quarter of the
    characters, rounded down. Null, empty and fitting contents give no row;
    of several deliveries of an id the latest counts. Only oversized contents are
    shuffled or leave the JVM.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("the overlap must not exceed half the limit")
    order = [c for c in ("updated_at", "inserted_at") if c in chunks.columns]
    short = F.when(F.length("content") > limit, F.col("content"))  # a later delivery that fits still counts, but need not be moved
    wide = latest(chunks.select("id", "file_id", short.alias("content"), "line_start", "chunk_index", *order), ["id"], order).filter("content is not null").drop(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                first = int(r.line_start) if pd.notna(r.line_start) and r.line_start > 0 else 1
                index = int(r.chunk_index) if pd.notna(r.chunk_index) else None
                spans = pieces(r.content, limit, overlap)
                for k, (a, b) in enumerate(spans):
                    at, text = first + r.content.count("\n", 0, a), r.content[a:b]
                    rows.append((r.id, r.file_id, k, len(spans), text, at, at + text.count("\n"), index, len(text) // 4))
            yield pd.DataFrame(rows, columns=["chunk_id", "file_id", "piece", "pieces", "content", "line_start", "line_end", "chunk_index", "token_count"]).astype({"chunk_index": "Int32"})

    out = wide.mapInPandas(cut, "chunk_id string, file_id string, piece int, pieces int, content string, line_start int, line_end int, chunk_index int, token_count int")
    gained = Window.partitionBy("file_id").orderBy("chunk_index", "chunk_id", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("chunk_index", (F.col("chunk_index") + F.sum((F.col("piece") > 0).cast("int")).over(gained)).cast("int"))


def with_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All chunks, those over ``limit`` as their pieces: chunk_id, file_id, content, line_start, chunk_index, token_count.

    ``chunk_index`` is numbered on within each file, so that pieces and the
    chunks after them keep apart; the rest is as in :func:`split_oversized`,
    and chunks that fit keep their line_start and token_count. Null and empty
    contents count as fitting.
    """
    pieces = split_oversized(chunks, limit, overlap)
    order = [c for c in ("updated_at", "inserted_at") if c in chunks.columns]
    own = latest(chunks.select("id", "file_id", "content", "line_start", "chunk_index", "token_count", *order), ["id"], order).drop(*order)
    gained = pieces.groupBy("chunk_id").agg((F.first("pieces") - 1).alias("more"))
    sized = own.select(F.col("id").alias("chunk_id"), "file_id", "chunk_index").join(gained, "chunk_id", "left")
    before = Window.partitionBy("file_id").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    moved = sized.select("chunk_id", (F.col("chunk_index") + F.coalesce(F.sum(F.coalesce("more", F.lit(0))).over(before), F.lit(0))).cast("int").alias("at"))
    fits = own.filter(F.coalesce(F.length("content"), F.lit(0)) <= limit).withColumnRenamed("id", "chunk_id").join(moved, "chunk_id")
    cut = pieces.join(moved, "chunk_id").withColumn("at", F.col("at") + F.col("piece"))
    columns = ["chunk_id", "file_id", "content", "line_start", F.col("at").cast("int").alias("chunk_index"), F.col("token_count").cast("int").alias("token_count")]
    return fits.select(columns).unionByName(cut.select(columns))
