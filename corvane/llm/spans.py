"""Long stretches of text that stand verbatim in more than one record.

Method: recompression. A text is a sequence of tokens; in every round, runs of
one symbol get a name made of the symbol and the run's length, then adjacent
pairs whose members fall into opposite halves of the alphabet get a name made
of both. Names are hashes of what they stand for, so they are global without a
dictionary and without moving data, and a round decides by a symbol's direct
neighbours only: two equal stretches get equal symbols but for a few at their
ends. A symbol that stands for ``GRAIN`` characters is complete and takes part
in no further round, so every long enough stretch holds complete symbols in
its interior, and it reaches at least (least - size) / 2 characters beyond one
of them on one side. Each symbol is therefore emitted with that much context,
once on the left and once on the right; records that share such a key are the
candidates, and each candidate pair is verified on the texts.

Equal texts are one class, told apart by 128 bits of hash; each class takes part
once, so a text with many copies costs no more than one without. Keys of one
class are left out, and a key that very many share (boilerplate) is spread over
pairs of blocks, see :mod:`corvane.llm.pairs`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import pairs
from corvane.llm.rolling import Substrings, code_points, mix
from corvane.plans.lineage import cut
from corvane.sources.tables import hash128

#: Characters from which a symbol is complete; it stands for fewer than twice as many.
GRAIN = 64
_TOKEN, _ROUNDS, _BATCH = 32, 64, 1_500_000


def complete_symbols(codes: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, name) of the complete symbols; ``record`` tells which text each code point belongs to."""
    n = len(codes)
    word = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    starts = np.ones(n, bool)
    starts[1:] = ~(word[1:] & word[:-1]) | (record[1:] != record[:-1])
    begin = np.flatnonzero(starts)
    size = np.diff(np.append(begin, n))
    if (long := size > _TOKEN).any():  # such a token goes character by character
        at = np.repeat(long, size)
        starts |= at
        begin = np.flatnonzero(starts)
        size = np.diff(np.append(begin, n))
    name = Substrings(codes)(begin, begin + size)
    at = record[begin]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in range(_ROUNDS):
        # Runs of one symbol, cut into blocks of just enough copies to be complete.
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1]) | (size[1:] >= GRAIN)
        if not fresh.all():
            run = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            within = np.arange(len(name)) - first[run]
            fresh |= within % np.maximum(1, -(-GRAIN // size)) == 0
            first = np.flatnonzero(fresh)
            copies = np.diff(np.append(first, len(name)))
            total = np.add.reduceat(size, first)
            name = np.where(copies > 1, mix(name[first] + np.uint64(0xD6E8FEB86659FD93) * copies.astype(np.uint64)), name[first])
            begin, size, at = begin[first], total, at[first]
        # Pairs whose first member is in one half of the alphabet and second in the other.
        right = (mix(name + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        open_ = size < GRAIN
        pair = np.flatnonzero(~right[:-1] & right[1:] & open_[:-1] & open_[1:] & (at[:-1] == at[1:]))
        if len(pair):
            name[pair] = mix(name[pair] * np.uint64(0xA24BAED4963EE407) + name[pair + 1])
            size[pair] += size[pair + 1]
            keep = np.ones(len(name), bool)
            keep[pair + 1] = False
            begin, size, name, at = begin[keep], size[keep], name[keep], at[keep]
        # What is complete, or alone between such and ends, leaves the rounds; groups of open symbols go on.
        open_ = size < GRAIN
        full = ~open_
        done.append((begin[full], size[full], name[full]))
        near = np.zeros(len(name), bool)
        near[:-1] |= open_[1:] & (at[1:] == at[:-1])
        near[1:] |= open_[:-1] & (at[1:] == at[:-1])
        on = open_ & near
        if not on.any():
            break
        # A barrier between groups that are no longer adjacent: each group counts as a record of its own.
        group = np.cumsum(np.append(True, ~on[:-1] | (at[1:] != at[:-1])))
        begin, size, name, at = begin[on], size[on], name[on], group[on]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def keys_of(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, key) of every complete symbol with its context on one side."""
    sizes = np.array([len(t) for t in texts])
    codes, end = code_points("".join(texts)), np.cumsum(sizes)
    record = np.repeat(np.arange(len(texts)), sizes)
    begin, size, name = complete_symbols(codes, record)
    held, hashed = record[begin], Substrings(codes)
    reach = np.maximum(0, (least - size) // 2)
    out = []
    for side, a, b in ((1, begin, begin + size + reach), (2, begin - reach, begin + size)):
        fits = (a >= (end - sizes)[held]) & (b <= end[held])
        key = mix(hashed(a[fits], b[fits]) ^ mix(name[fits] + np.uint64(side)))
        out.append((held[fits], key))
    held, key = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((key, held))
    held, key = held[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (held[1:] != held[:-1])
    return held[first], key[first]


def common(a: str, b: str, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the maximal stretches of ``a`` made of windows of ``least`` characters that stand in ``b``."""
    x, y = code_points(a), code_points(b)
    if min(len(x), len(y)) < least:
        return []
    i, j = np.arange(len(x) - least + 1), np.arange(len(y) - least + 1)
    at = np.flatnonzero(np.isin(Substrings(x)(i, i + least), Substrings(y)(j, j + least)))
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > least)
    found = zip(at[np.append(0, breaks + 1)].tolist(), (at[np.append(breaks, len(at) - 1)] + least).tolist(), strict=True)
    return [(i, j) for i, j in found if a[i : i + least] in b]


def _shares(a: str, b: str, least: int) -> bool:
    """Whether two texts have a stretch of ``least`` characters in common: any such stretch of ``a`` holds one of its blocks of half that size. Where blocks stand in ``b`` over and over, all windows are compared instead."""
    half, met = least // 2, 0
    for at in range(0, len(a) - half + 1, half) if half else ():
        block, place = a[at : at + half], -1
        while (place := b.find(block, place + 1)) >= 0:
            if (met := met + 1) > 200:
                return bool(common(a, b, least))
            i, j = at, place
            while i and j and i + least > at and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            size = at + half - i
            while size < least and i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size]:
                size += 1
            if size >= least:
                return True
    return False


def _keyed(texts: DataFrame, least: int) -> DataFrame:
    """(class, key) of the complete symbols of texts (class, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, held = batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held > _BATCH or i + 1 == len(texts):
                    number, key = keys_of(texts[begin : i + 1], least)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number + begin)), pa.array(key.view(np.int64))], names=["class", "key"])
                    begin, held = i + 1, 0

    return texts.mapInArrow(emit, "class bigint, key bigint")


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400, spans: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members and links of the texts that share a verbatim stretch of ``least`` characters or more.

    Members: (``key``, class, size), one row per record whose text has at least
    ``least`` characters; equal texts share their class. Links: (class_a,
    class_b, spans_a, spans_b) with class_a < class_b, one row per pair of
    different texts; the spans are arrays of (begin, end), null without
    ``spans``. Null, empty and shorter texts are in neither.
    """
    held = docs.filter(F.length(text) >= least).select(F.col(key).alias(key), F.col(text).alias("text"), hash128(F.col(text)).alias("hash"))
    texts = cut(held.groupBy("hash").agg(F.first("text").alias("text")).withColumn("class", F.monotonically_increasing_id()))  # fixed by being written
    keyed = cut(_keyed(texts.select("class", "text"), least))  # made once: counting the keys and both sides of the pairs read it
    met = pairs.sharing(keyed, "key", "class")
    texts_of = lambda side: texts.select(F.col("class").alias(side), F.col("text").alias(f"text_{side}"))
    both = met.join(texts_of("a"), "a").join(texts_of("b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        as_rows = lambda found: [{"begin": x, "end": y} for x, y in found]
        for batch in batches:
            ids, out_a, out_b = [], [], []
            for i, (x, y) in enumerate(zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
                if not spans:
                    ids += [i] if _shares(x, y, least) else []
                elif found := common(x, y, least):
                    ids.append(i)
                    out_a.append(as_rows(found))
                    out_b.append(as_rows(common(y, x, least)))
            took = pa.array(ids, pa.int64())
            sides = [pa.array(out, span) if spans else pa.nulls(len(ids), span) for out in (out_a, out_b)]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(took), batch.column("b").take(took), *sides], names=["class_a", "class_b", "spans_a", "spans_b"])

    span = "array<struct<begin:int,end:int>>"
    links = both.select("a", "b", "text_a", "text_b").mapInArrow(verify, f"class_a bigint, class_b bigint, spans_a {span}, spans_b {span}")
    members = held.select(key, "hash", F.length("text").alias("size")).join(texts.select("hash", "class"), "hash")
    return members.select(key, "class", "size"), links


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400) -> DataFrame:
    """(a, b), a < b: every pair of records whose texts share a stretch of ``least`` characters, copies included."""
    members, links = shared_spans(docs, key, text, least, spans=False)
    members = members.select(F.col(key).alias("_k"), "class")
    x, y = members.toDF("x", "class_a"), members.toDF("y", "class_b")
    different = links.select("class_a", "class_b").join(x, "class_a").join(y, "class_b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    copies = members.toDF("a", "class").join(members.toDF("b", "class"), "class").filter("a < b").select("a", "b")
    return different.unionByName(copies).distinct()


def shared_amounts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400) -> DataFrame:
    """(``key``, shared_chars, partners) of every record that shares something: its characters that also stand elsewhere, and how many other classes of texts hold some of them; copies share all."""
    members, links = shared_spans(docs, key, text, least)
    links = cut(links)
    spans = links.select(F.col("class_a").alias("class"), F.col("class_b").alias("other"), F.explode("spans_a").alias("s")).unionByName(links.select(F.col("class_b").alias("class"), F.col("class_a").alias("other"), F.explode("spans_b").alias("s")))
    before = Window.partitionBy("class").orderBy("s.begin", "s.end", "other").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("s.end") - F.greatest(F.col("s.begin"), F.coalesce(F.max("s.end").over(before), F.lit(0))))
    per_class = spans.withColumn("fresh", fresh).groupBy("class").agg(F.sum("fresh").alias("fresh"), F.countDistinct("other").alias("partners"))
    copies = members.groupBy("class").agg(F.count("*").alias("n"))
    joined = members.join(copies, "class").join(per_class, "class", "left").filter("n > 1 or fresh is not null")
    return joined.select(key, F.when(F.col("n") > 1, F.col("size")).otherwise(F.col("fresh")).cast("bigint").alias("shared_chars"), F.coalesce("partners", F.lit(0)).alias("partners"))
