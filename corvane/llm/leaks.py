"""Passages of held-out material that stand, fully or partly, in a corpus.

Method: q-gram lemma filtering. Texts are reduced to their words, in lower
case and joined by one space. Character q-grams that begin at a word are looked up
in an index of the passages; hits are counted in overlapping diagonal bands;
a band is retained if it holds as many q-grams as a stretch of ``least`` words
with at most ``edits`` changed, missing or added words must keep; retained
regions are verified by an alignment of the words within the band.

The passages are the stated query set: they are sent to the executors in
blocks of at most ``BLOCK`` characters, and every block meets all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm.rolling import Substrings, code_points

#: Characters of passages in a block, which bounds what is broadcast and what the driver holds at once.
BLOCK = 16_000_000
_BATCH = 2_000_000
#: A word: the longest run of Unicode letters and digits.
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case."""
    return WORD.findall((text or "").lower())


def aligned(passage: list[str], words: list[str], at: int, to: int, least: int, edits: int) -> int:
    """Most passage words that align with a stretch of ``words`` with at most ``edits`` edits, on diagonals ``at``..``to`` (document minus passage).

    Furthest-reaching points: for each diagonal and number of edits, the
    longest stretch that ends there; cells outside the band are not computed.
    """
    best = 0
    n, m = len(passage), len(words)
    # length[e][d]: passage words covered by the best alignment ending at (i, i + d) with e edits, for the row i
    length = np.full((edits + 1, to - at + 1), 0)
    for i in range(n):
        row = np.zeros_like(length)
        for e in range(edits + 1):
            for x in range(to - at, -1, -1):
                j = i + at + x
                if not 0 <= j < m:
                    continue
                if passage[i] == words[j]:
                    row[e, x] = length[e, x] + 1
                elif e:
                    changed = length[e - 1, x]
                    missing = length[e - 1, x + 1] if x < to - at else 0
                    row[e, x] = max(changed, missing) + 1 if max(changed, missing) else 0
                if e and x and row[e - 1, x - 1]:
                    row[e, x] = max(row[e, x], row[e - 1, x - 1])
        length = row
        best = max(best, int(length.max(initial=0)))
        if best >= n:
            break
    return best


class Index:
    """Q-grams of a block of passages."""

    def __init__(self, items: list[tuple[int, str | None]], least: int, edits: int):
        self.items = [(k, w) for k, t in items if len(w := words_of(t)) >= least]
        spans = [sum(map(len, w[i : i + least])) + least - 1 for _, w in self.items for i in range(len(w) - least + 1)]
        # One edit destroys the q-grams that reach into its word; with q this short, enough are left.
        self.q = max(4, min(48, (min(spans) if spans else 48) // (2 * (edits + 1))))
        self.width = 2 * edits + 1
        joined = " ".join(" ".join(w) for _, w in self.items)
        codes = code_points(joined)
        starts = np.flatnonzero(np.append(True, codes[:-1] == 32)) if len(codes) else np.zeros(0, int)
        number = np.repeat(np.arange(len(self.items)), [len(w) for _, w in self.items])
        word = np.concatenate([np.arange(len(w)) for _, w in self.items]) if self.items else np.zeros(0, int)
        ends = np.zeros(len(self.items), int)
        size = np.diff(np.append(starts, len(codes) + 1)) - 1
        np.maximum.at(ends, number, starts + size)
        fits = starts + self.q <= ends[number] if len(starts) else np.zeros(0, bool)
        self.keep = self._kept(least, edits)
        gram = Substrings(codes)(starts[fits], starts[fits] + self.q)
        order = np.argsort(gram, kind="stable")
        self.gram, self.number, self.word = gram[order], number[fits][order], word[fits][order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.gram & np.uint64((1 << 22) - 1)] = True

    def _kept(self, least: int, edits: int) -> int:
        """The fewest q-grams at word starts that a stretch of ``least`` words keeps after ``edits`` edits."""
        fewest = least
        for _, w in self.items:
            size = np.array([len(x) + 1 for x in w])
            begin = np.append(0, np.cumsum(size))
            for i in range(len(w) - least + 1):
                inside = int((begin[i : i + least] + self.q <= begin[i + least] - 1).sum())
                fewest = min(fewest, inside)
        reach = 1 + max((int(np.searchsorted(np.cumsum([len(x) + 1 for x in w]), self.q)) for _, w in self.items), default=0)
        return max(1, fewest - edits * (reach + 1))

    def found(self, texts: list[str | None], least: int, edits: int) -> list[tuple[int, int, int]]:
        """(text's number, passage's key, passage words covered) of every leak."""
        words = [words_of(t) for t in texts]
        count = np.array([len(w) for w in words])
        if not self.items or not count.sum():
            return []
        codes = code_points(" ".join(" ".join(w) for w in words if w))
        starts = np.flatnonzero(np.append(True, codes[:-1] == 32))
        number = np.repeat(np.arange(len(words)), count)
        word = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
        fits = np.flatnonzero(starts + self.q <= len(codes))
        gram = Substrings(codes)(starts[fits], starts[fits] + self.q)
        maybe = self.sieve[gram & np.uint64((1 << 22) - 1)]
        fits, gram = fits[maybe], gram[maybe]
        low, high = np.searchsorted(self.gram, gram, "left"), np.searchsorted(self.gram, gram, "right")
        times = high - low
        if not times.sum():
            return []
        hit = np.repeat(fits, times)
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        text, item, diagonal = number[hit], self.number[at], word[hit] - self.word[at]
        # Bands of twice the width, each beginning a width after the one before: any width diagonals lie in one of them.
        band = np.floor_divide(diagonal, self.width)
        if edits:
            text, item, band = np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1])
        keys, n = np.unique(np.stack([text, item, band]), axis=1, return_counts=True)
        best: dict[tuple[int, int], int] = {}
        for t, i, b in keys[:, n >= self.keep].T.tolist():
            to = b * self.width + (2 * self.width - 1 if edits else 0)
            got = aligned(self.items[i][1], words[t], b * self.width, to, least, edits)
            if got >= least:
                best[t, i] = max(got, best.get((t, i), 0))
        return [(t, self.items[i][0], n) for (t, i), n in best.items()]


def leaked(docs: DataFrame, items: DataFrame, least: int = 16, edits: int = 0, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """(``key``, ``item``, words): each document that contains ``least`` consecutive words of a passage, and the longest stretch of passage words found.

    ``edits`` words of the stretch may be changed, missing or added. Null and
    empty texts, and passages of fewer than ``least`` words, give no row; rows
    repeated in either table give one.
    """
    sized = items.agg(F.coalesce(F.sum(F.length(passage) + 64), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-sized // BLOCK))
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}, words int"
    named = docs.filter(F.length(text) > 0).select(F.col(key), F.col(text).alias("_text"))
    spark = docs.sparkSession

    def block(b: int) -> DataFrame:
        rows = items.select(item, passage).distinct().filter(F.pmod(F.xxhash64(item, passage), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in rows], least, edits))
        item_arrow = to_arrow_type(items.schema[item].dataType)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                begin, held = 0, 0
                for i, t in enumerate(texts):
                    held += len(t)
                    if held > _BATCH or i + 1 == len(texts):
                        found = index.value.found(texts[begin : i + 1], least, edits)
                        if found:
                            which, item_keys, n = zip(*found, strict=True)
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array([begin + x for x in which])), pa.array(item_keys, item_arrow), pa.array(n, pa.int32())], names=[key, item, "words"])
                        begin, held = i + 1, 0

        return named.mapInArrow(search, kinds)

    found = reduce(DataFrame.unionByName, [block(b) for b in range(blocks)])
    return found.groupBy(key, item).agg(F.max("words").alias("words"))
