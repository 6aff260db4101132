"""Groups of records that differ by small edits, insertions or moved lines.

Method: BagMinHash. A record is a bag of shingles (sequences of consecutive
tokens). Each shingle carries Poisson processes over its discretised weight:
one for the level (0, 1], then one for each dyadic range (2^(i-1), 2^i] of
levels, whose points are resolved to a level only if they come early enough. A point
falls into one of the signature's registers, which keeps the earliest; a
shingle is left as soon as its next point comes later than every register's.
Registers of two records agree with the probability of their weighted Jaccard
similarity. Registers are banded; records that share a band are verified on
their exact bags.

Records with equal bags are one class, told apart by 128 bits of hash; each
class is banded and verified once. A band of over ``HOT`` classes says little
(they share what is common, such as a licence): its classes do not meet there,
but where they share one of their rarest shingles. A class of n shingles keeps
n - ceil(least n) + 1 of them, and two classes that are similar enough share one
that both keep (prefix filtering), so nothing is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import pairs
from corvane.llm.rolling import Substrings, code_points, mix
from corvane.plans.lineage import cut
from corvane.sources.tables import current, hash128

#: Registers of a signature; bands times registers in each. A pair of similarity 0.7 shares a band with probability 0.9998.
REGISTERS, BANDS = 128, 32
#: Classes of a band that meet there.
HOT = 200
_BATCH = 1_500_000
_HASH = "struct<a:bigint,b:bigint>"


def bags(texts: list[str], shingle: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, shingle's hash, weight), sorted by both; weights are counts, or 1 for plain sets."""
    joined = "\n".join(texts).lower() if all(len(t.lower()) == len(t) for t in texts if not t.isascii()) else None
    parts = None if joined is not None else [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in (parts or texts)])
    codes = code_points((joined if joined is not None else "\n".join(parts)) + "\n")
    word = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122)) | (codes == 95)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    record = np.searchsorted(np.cumsum(sizes), begin, "right")
    name = Substrings(codes)(begin, end)
    n = max(0, len(name) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(shingle):
        h = mix(h * np.uint64(0xA24BAED4963EE407) + name[i : i + n])
    whole = record[:n] == record[shingle - 1 : shingle - 1 + n]
    record, h = record[:n][whole], h[whole]
    order = np.lexsort((h, record))
    record, h = record[order], h[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (record[1:] != record[:-1]))) if len(h) else np.zeros(0, int)
    weight = np.diff(np.append(first, len(h))) if weighted else np.ones(len(first), int)
    return record[first], h[first], weight


def signatures(record: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The BagMinHash signature (n x registers, 64-bit) of each of ``n`` bags; records without shingles have unset registers."""
    top = int(weight.max(initial=1) - 1).bit_length()
    level = [np.flatnonzero(weight > (1 << (b - 1) if b else 0)) for b in range(top + 1)]
    at = np.concatenate(level)
    block = np.concatenate([np.full(len(x), b) for b, x in enumerate(level)])
    record, h, weight = record[at], mix(h[at] + np.uint64(0x632BE59BD9B4E019) * block.astype(np.uint64)), weight[at]
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    rate = np.maximum(low, 1)
    signature = np.full(n * registers, np.inf)
    latest = np.full(n, np.inf)
    time = np.zeros(len(h))
    on, k = np.arange(len(h)), 0
    while len(on):
        k += 1
        u = mix(h[on] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        v = mix(u + np.uint64(0xD6E8FEB86659FD93))
        time[on] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[on]
        early = time[on] <= latest[record[on]]
        on, v = on[early], v[early]
        within = low[on] + ((v >> np.uint64(32)) * rate[on].astype(np.uint64) >> np.uint64(32)).astype(np.int64) < weight[on]
        np.minimum.at(signature, record[on][within] * registers + (v[within] % np.uint64(registers)).astype(np.int64), time[on][within])
        if k % 4 == 0 or k < 4:
            latest = signature.reshape(n, registers).max(axis=1)
    return signature.reshape(n, registers).view(np.uint64)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands keys: equal where all registers of the band are."""
    n, m = signature.shape
    parts = signature.reshape(n, bands, m // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(m // bands):
        key = mix(key * np.uint64(0xA24BAED4963EE407) + parts[:, :, i])
    return key.view(np.int64)


def overlap(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags with sorted shingles."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    return both / (wa.sum() + wb.sum() - both)


def _unpacked(column: pa.Array) -> list[str]:
    """Texts that were packed one by one, so that less is written and shuffled."""
    return [zlib.decompress(x).decode() for x in column.to_pylist()]


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of parts of bounded size."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > _BATCH or i + 1 == len(texts):
            yield begin, texts[begin : i + 1]
            begin, held = i + 1, 0


def near_records(records: DataFrame, key: str | list[str] = "id", text: str = "content", shingle: int = 3, least: float = 0.7, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members and links of near-duplicate records.

    Members: (``key``, class), one row per record with at least one shingle;
    equal bags share their class. Links: (class_a, class_b, similarity) with class_a <
    class_b for different bags of similarity ``least`` or more. Tokens are the
    longest runs of ASCII letters, digits and underscores in lower case. Null
    and short texts are in neither; of several deliveries of a key the latest counts.
    """
    keys = [key] if isinstance(key, str) else key

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _slices(batch.column(1).to_pylist()):
                record, h, weight = bags(texts, shingle, weighted)
                n = len(texts)
                held = np.bincount(record, minlength=n) > 0
                total = np.zeros((2, n), np.uint64)
                for side, salt in enumerate((0x632BE59BD9B4E019, 0x9E3779B97F4A7C15)):
                    np.add.at(total[side], record, mix(mix(h + np.uint64(salt)) + weight.astype(np.uint64) * np.uint64(salt)))
                band = band_keys(signatures(record, h, weight, n))[held]
                table = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(band) + 1, BANDS), pa.int32()), pa.array(band.reshape(-1)))
                of = pa.StructArray.from_arrays([pa.array(mix(x)[held].view(np.int64)) for x in total], ["a", "b"])
                own = batch.slice(begin, n).filter(pa.array(held))
                packed = pa.array([zlib.compress(t.encode(), 1) for t in own.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), packed, of, table], names=["text", "value", "bag", "bands"])

    hashed = records.withColumn("_text", F.when(F.length(text) >= 2 * shingle - 1, hash128(F.col(text))))
    distinct = hashed.filter("_text is not null").groupBy(F.col("_text").alias("text")).agg(F.first(text).alias("value"))
    signed = distinct.mapInArrow(sign, f"text {_HASH}, value binary, bag {_HASH}, bands array<bigint>")
    signed = cut(signed.withColumn("number", F.monotonically_increasing_id()))  # fixed by being written
    named = cut(signed.select("text", "number", "bag").join(signed.groupBy("bag").agg(F.min("number").alias("class")), "bag").select("text", "number", "class"))
    others = cut(named.filter("number <> class").select("number"))  # written, so that its size is known and bands move only if it is large
    classes = signed.join(others, "number", "left_anti").withColumnRenamed("number", "class")
    banded = classes.select("class", F.explode("bands").alias("band"))
    sizes = cut(pairs.sized(banded, "band"))
    met = pairs.sharing(banded, "band", "class", sizes=sizes.filter(F.col("n") <= HOT))
    texts = signed.select(F.col("number").alias("class"), "value")
    crowd = cut(banded.join(sizes.filter(F.col("n") > HOT).select("band"), "band").select("class").distinct()).join(texts, "class")
    met = met.unionByName(_by_rare_shingles(crowd, shingle, least, weighted)).distinct()
    both = met.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            places: dict[str, int] = {}
            at = [[places.setdefault(t, len(places)) for t in _unpacked(batch.column(c))] for c in ("text_a", "text_b")]
            record, h, weight = bags(list(places), shingle, weighted) if n else (np.zeros(0, int),) * 3
            edge = np.searchsorted(record, np.arange(len(places) + 1))
            value = np.array([overlap(h[edge[a] : edge[a + 1]], weight[edge[a] : edge[a + 1]], h[edge[b] : edge[b + 1]], weight[edge[b] : edge[b + 1]]) for a, b in zip(*at, strict=True)])
            took = pa.array(np.flatnonzero(value >= least) if n else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(took), batch.column("b").take(took), pa.array(value, pa.float64()).take(took)], names=["class_a", "class_b", "similarity"])

    links = both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "class_a bigint, class_b bigint, similarity double")
    members = current(hashed, "_text", key=keys).join(named.select(F.col("text").alias("_text"), "class"), "_text").select(*keys, "class")
    return members, links


def _by_rare_shingles(classes: DataFrame, shingle: int, least: float, weighted: bool) -> DataFrame:
    """(a, b): the pairs of classes (class, value) that share a shingle which is among the rarest of both, and differ in size no more than ``least`` allows. The n-th time that a shingle stands in a bag counts as a shingle of its own."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _slices(_unpacked(batch.column(1))):
                record, h, weight = bags(texts, shingle, weighted)
                time = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                h, record = mix(np.repeat(h, weight) + time.astype(np.uint64)), np.repeat(record, weight)
                size = np.bincount(record, minlength=len(texts))[record]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(record + begin)), pa.array(h.view(np.int64)), pa.array(size)], names=["class", "shingle", "size"])

    made = classes.mapInArrow(cut_up, "class bigint, shingle bigint, size bigint")
    often = pairs.sized(made, "shingle")
    order = Window.partitionBy("class").orderBy("n", "shingle")
    kept = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    ranked = made.join(often, "shingle", "left").withColumn("r", F.row_number().over(order)).filter((F.col("r") <= kept) & F.col("n").isNotNull())
    sizes = ranked.select("class", "size").distinct()
    met = pairs.sharing(ranked.select("shingle", "class"), "shingle", "class")
    sized = met.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    return sized.filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9).select("a", "b")


def near_pairs(records: DataFrame, key: str = "id", text: str = "content", shingle: int = 3, least: float = 0.7, within: str | None = None, weighted: bool = False) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of near-duplicate records, those with equal bags included; if ``within`` is given, a first column of that name, the same in both records. Keys are unique within it."""
    members, links = near_records(records, [within, key] if within else key, text, shingle, least, weighted)
    own = [within] if within else []
    members = cut(members.select(*own, F.col(key).alias("_k"), "class"))
    x, y = members.toDF(*own, "x", "class_a"), members.toDF(*own, "y", "class_b")
    different = links.join(x, "class_a").join(y, ["class_b", *own]).select(*own, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    equal = members.toDF(*own, "id_a", "class").join(members.toDF(*own, "id_b", "class"), ["class", *own]).filter("id_a < id_b").select(*own, "id_a", "id_b")
    return different.unionByName(equal).filter("id_a < id_b")
