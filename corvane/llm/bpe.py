"""Encoding texts with a byte-level BPE vocabulary.

Method: distinct words are turned into arrays of bytes and folded by Spark's
higher-order functions: each step merges the adjacent pair with the lowest
rank, looked up in a literal rank map. A byte is held as the character of the
same number (ISO-8859-1), so a run of bytes is a string.

Each text is cut into words once. A word that is a token as a whole has its
rank as its id; of the others, each batch of ``BATCH`` characters of documents
(or what a task has of them) keeps the distinct ones, which are folded within
the same task, and their ids are put in their places. So nothing is shuffled,
counted, collected or broadcast, the work is proportional to the corpus, and a
lost task is simply run again. Words of over ``LONG`` bytes, on which the fold
would be quadratic, take the same merges from a heap.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Folder of the vocabularies; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that cuts a text into words before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of ASCII characters only, whose words the plain module finds three times faster.
_ASCII = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Longest word in bytes that is folded, and characters of documents whose distinct words are folded together.
LONG, BATCH = 64, 16_000_000


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """The rank of every token's bytes in a rank file (base64, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _class(prop: str) -> str:
    """The characters up to U+FFFF that have a property, as ranges for a set of the plain module."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    return "".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(rf"(?:{prop})+", every) for m in _runs(m))


def _runs(text: str) -> Iterator[str]:
    """The parts of a text of rising characters that have no gap (the surrogates are one)."""
    begin = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or ord(text[i]) != ord(text[i - 1]) + 1:
            yield text[begin:i]
            begin = i


@cache
def cutter() -> Callable[[str], list[str]]:
    """A function that cuts a text into words; the plain module, which is faster, takes all texts without characters above U+FFFF."""
    every, plain = regex.compile(PATTERN).findall, re.compile(_ASCII).findall
    letter, number, space = map(_class, (r"\p{L}", r"\p{N}", r"\s"))
    basic = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def cut(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        return basic(text) if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else every(text)

    return cut


class Words(dict[str, int]):
    """Ids of the words that are tokens; any other word of at most ``LONG`` bytes gets -1 - its place among ``new`` when it is first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__((t, r) for k, r in ranks.items() if (t := k.decode("utf-8", "ignore")) and t.encode() == k)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        if len(word) > LONG or len(word.encode()) > LONG:
            raise KeyError(word)
        self.new.append(word)
        place = self[word] = -len(self.new)
        return place

    def forget(self) -> None:
        """Leave only the tokens."""
        for word in self.new:
            del self[word]
        self.new = []


class LiteralMap:
    """A constant map from the tokens to their ranks, usable inside lambdas.

    Spark searches a map's keys one by one, and a large literal of maps is slow
    to ship. So this is two literal arrays: the tokens by rank, and a cuckoo
    table of ranks in which a key's rank stands in one of two slots. What
    stands there is compared with the key itself.
    """

    def __init__(self, entries: dict[str, int]):
        import xxhash

        bits = max(5, (2 * len(entries)).bit_length())
        hashes = {k: xxhash.xxh64_intdigest(k.encode(), 42) for k in entries}
        while (slots := self._fill(entries, hashes, 1 << bits)) is None:
            bits += 1
        self.mask = len(slots) - 1
        tokens = [""] * (max(entries.values(), default=0) + 1)
        for token, r in entries.items():
            tokens[r] = token
        literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")
        self.col = F.struct(literal(slots, "int").alias("slots"), literal(tokens, "string").alias("tokens"))

    @staticmethod
    def _fill(entries: dict[str, int], hashes: dict[str, int], n: int) -> list[int] | None:
        held: list[str | None] = [None] * n
        for key in entries:
            at = hashes[key] & (n - 1)
            for _ in range(200):
                key, held[at] = held[at], key
                if key is None:
                    break
                h = hashes[key]
                at = (h >> 32) & (n - 1) if at == h & (n - 1) else h & (n - 1)
            else:
                return None
        return [-1 if k is None else entries[k] for k in held]

    def use(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``body`` of a look-up function; the literal stands in the plan once, however often that is called."""
        mask = F.lit(self.mask)

        def look_up(table: Column, key: Column) -> Column:
            slot = lambda h: F.get(table["slots"], h.bitwiseAND(mask).cast("int"))
            mine = lambda k, h: F.filter(F.array(slot(h), slot(F.shiftrightunsigned(h, 32))), lambda r: F.get(table["tokens"], r) == k)
            return _let(key, lambda k: _let(F.xxhash64(k), lambda h: F.get(mine(k, h), F.lit(0))))

        return _let(self.col, lambda table: body(lambda key: look_up(table, key)))


def as_bytes(word: Column) -> Column:
    """The UTF-8 bytes of a string, one character each."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(word: Column, rank: Callable[[Column], Column]) -> Column:
    """The ids of one word, given as :func:`as_bytes` gives it; all ids are ranks."""

    def pair_ranks(parts: Column) -> Column:
        pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: rank(F.concat(a, b)))
        return F.when(F.size(parts) > 1, pairs).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<int>")

    def merge(state: Column, at: Column, both: Column) -> Column:
        parts, r = state["parts"], state["r"]
        before = F.when(at > 1, F.array(rank(F.concat(F.get(parts, at - 2), both)))).otherwise(none)
        after = F.when(at + 1 < F.size(parts), F.array(rank(F.concat(both, F.get(parts, at + 1))))).otherwise(none)
        return F.struct(
            F.concat(F.slice(parts, F.lit(1), at - 1), F.array(both), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
            F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(r, at + 2, F.size(parts))).alias("r"),
        )

    def step(state: Column, _: Column) -> Column:
        best = F.array_position(state["r"], F.array_min(state["r"]))
        merged = _let(best.cast("int"), lambda at: _let(F.concat(F.get(state["parts"], at - 1), F.get(state["parts"], at)), lambda both: merge(state, at, both)))
        return F.when(F.array_min(state["r"]).isNull(), state).otherwise(merged)

    split = F.split(word, "(?!^)(?=.|\\n|\\r|\\x{85})")
    start = _let(split, lambda parts: F.struct(parts.alias("parts"), pair_ranks(parts).alias("r")))
    folded = F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)
    return F.transform(folded["parts"], lambda p: rank(p))


def heap_merges(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, in O(n log n): (rank, position) of each adjacent pair in a heap."""
    n = len(word)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = right[a]
        if not alive[a] or b >= n or end[b] != stop:
            continue
        alive[b], end[a], right[a] = 0, stop, right[b]
        if right[a] < n:
            left[right[a]] = a
            if (r := rank.get(word[a : end[right[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[right[a]]))
        if (p := left[a]) >= 0 and (r := rank.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [rank[word[i : end[i]]] for i in range(n) if alive[i]]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", batch: int = BATCH) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row: its text in the vocabulary, without special tokens.

    Null and empty texts give an empty list; text that looks like a special
    token is ordinary text; rows are kept as they are, repeated keys too.
    """
    rank = LiteralMap({k.decode("latin-1"): v for k, v in ranks_of(vocabulary).items()})
    kind, key_arrow = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per batch of documents: their keys, the number of words of each, every word's rank or -1 - its place among ``words``."""
        cut, ranks = cutter(), ranks_of(vocabulary)
        known = Words(ranks)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(key_arrow)), pa.array([sizes.tobytes()]), pa.array([codes.tobytes()]), pa.array([known.new], pa.list_(pa.string()))], names=["keys", "sizes", "codes", "words"])

        keys, sizes, codes, held = [], array("i"), array("i"), 0
        for rows in batches:
            for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                begin = len(codes)
                words = cut(t or "")
                try:
                    codes.extend(map(known.__getitem__, words))
                except KeyError:  # a long word is among them
                    del codes[begin:]
                    for w in words:
                        if len(w) <= LONG and len(w.encode()) <= LONG or w in known:
                            codes.append(known[w])
                        else:
                            codes.extend(heap_merges(w.encode(), ranks))
                keys.append(k)
                sizes.append(len(codes) - begin)
                held += len(t or "")
                if held >= batch:
                    yield row()
                    known.forget()
                    keys, sizes, codes, held = [], array("i"), array("i"), 0
        if keys:
            yield row()

    def put_in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                sizes, codes = (np.frombuffer(rows.column(c)[i].as_buffer(), np.int32) for c in (1, 2))
                folded = rows.column(3).slice(i, 1).flatten()
                edge, ids = folded.offsets.to_numpy().astype(np.int64), folded.values.to_numpy()
                word = np.flatnonzero(codes < 0)
                place = -1 - codes[word].astype(np.int64)
                width = np.ones(len(codes), np.int64)
                width[word] = edge[place + 1] - edge[place]
                end = np.cumsum(width)
                out = np.empty(int(end[-1]) if len(end) else 0, np.int32)
                out[end[codes >= 0] - 1] = codes[codes >= 0]
                many = width[word]
                inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                out[np.repeat(end[word] - many, many) + inner] = ids[np.repeat(edge[place], many) + inner]
                offsets = np.append(0, end)[np.append(0, np.cumsum(sizes))]
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(i, 1).flatten(), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))], names=[key, "ids"])

    named = docs.select(F.col(key), F.col(text).alias("_text"))
    rows = named.mapInArrow(cut_texts, f"keys array<{kind}>, sizes binary, codes binary, words array<string>")
    folded = rank.use(lambda r: F.transform("words", lambda w: fold_merges(as_bytes(w), r)))
    return rows.select("keys", "sizes", "codes", folded.alias("ids")).mapInArrow(put_in_place, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, spark: SparkSession | None = None, ids: str = "ids", out: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``encoded`` with ``out``: the binary pieces of the ids, concatenated and read as UTF-8; ids that are no tokens are left out."""
    by_rank = sorted((r, b.decode("latin-1")) for b, r in ranks_of(vocabulary).items())
    pieces = [""] * (by_rank[-1][0] + 1)
    for r, b in by_rank:
        pieces[r] = b
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.concat_ws("", F.transform(F.col(ids), lambda i: F.get(table, i)))
    return encoded.withColumn(out, F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8"))
