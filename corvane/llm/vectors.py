"""The most similar vectors of every vector.

Method: block matrix join. Vectors are scaled to length 1 and quantised to
int8; tiles of vectors are multiplied as integers, which gives every pair's
cosine up to a bound known from the two quantisation errors. A pair survives
if its upper bound reaches both the asked similarity and the k-th best lower
bound of one of its ends; survivors are recomputed in floating point and
merged into the k best of each vector.

Which blocks meet is decided by an index over all vectors: ``tables`` times,
vectors are put into cells by the signs of random projections, as many that a
cell holds about ``CELL`` vectors, and a tile is a cell. The number of tables follows from
the asked similarity and recall, so the work grows little faster than the
collection. A cell of over ``TILE`` vectors is spread over tasks as pairs of
blocks.

Of vectors with the same direction only the k + 1 first by id are indexed:
no other can be among anybody's k best (ties go to the smaller id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.rolling import mix
from corvane.plans.lineage import cut
from corvane.sources.tables import current

CELL, TILE, SEED = 64, 2048, 20240229


def usable(vector: Column, size: int) -> Column:
    """Not null, ``size`` numbers, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def tables_for(n: int, least: float, recall: float) -> tuple[int, int]:
    """(projections per table, tables) so that a pair of similarity ``least`` shares a cell with probability ``recall``."""
    bits = max(1, math.ceil(math.log2(max(2, n / CELL))))
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999999, agree**bits)))


def quantised(unit: np.ndarray) -> np.ndarray:
    """Rows of bytes: the int8 codes, then scale and error as float32."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    error = np.linalg.norm(unit - codes * scale, axis=1, keepdims=True) + 1e-6
    return np.hstack([codes.astype(np.int8).view(np.uint8), scale.astype(np.float32).view(np.uint8), error.astype(np.float32).view(np.uint8)])


def _tile(x: np.ndarray, y: np.ndarray, same: bool, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of two blocks of packed vectors that may be among the k best of one end and reach ``least``."""
    size = x.shape[1] - 8
    part = lambda p: (p[:, :size].view(np.int8).astype(np.float32), p[:, size : size + 4].copy().view(np.float32)[:, 0], p[:, size + 4 :].copy().view(np.float32)[:, 0])
    (ca, sa, ea), (cb, sb, eb) = part(x), part(y)
    score = (ca @ cb.T) * sa[:, None] * sb  # sums of int8 products are exact in float32
    bound = ea[:, None] + eb + ea[:, None] * eb
    if same:
        np.fill_diagonal(score, -9)
    may = score + bound >= least
    if may.sum(axis=1).max(initial=0) > k or may.sum(axis=0).max(initial=0) > k:
        lower = np.where(may, score - bound, -9)
        rows = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(lower), -9)
        cols = np.partition(lower, -k, axis=0)[-k] if lower.shape[0] > k else np.full(lower.shape[1], -9)
        may &= (score + bound >= rows[:, None]) | (score + bound >= cols)
    i, j = np.nonzero(np.triu(may, 1) if same else may)
    return i, j


_OUT = "a bigint, b bigint, cell bigint, block int, packed binary"


def _pairs(ids_a: np.ndarray, ids_b: np.ndarray) -> pa.RecordBatch:
    n = len(ids_a)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids_a, ids_b)), pa.array(np.maximum(ids_a, ids_b)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["a", "b", "cell", "block", "packed"])


def _matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Runs of rows with equal keys, as sorted; a run longer than TILE comes in parts, all but the last marked True."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a), False
        rest = batch.slice(edges[-1])
        while rest.num_rows > 2 * TILE:
            yield rest.slice(0, TILE), True
            rest = rest.slice(TILE)
    if rest is not None and rest.num_rows:
        yield rest, False


def similar_pairs(vectors: DataFrame, k: int = 10, least: float = 0.9, size: int = 64, recall: float = 0.97, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: pairs of cosine ``least`` or more where one is among the ``k`` most similar of the other.

    Unusable vectors (null, of another size, not finite, all zero) are in no
    pair; of several deliveries of an id the latest counts; ties go to the smaller
    id. ``recall`` is the least probability with which a pair at ``least`` is
    found; closer pairs are found more often.
    """
    kept = current(vectors, vector, key=key).filter(usable(F.col(vector), size)).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, size)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            same = mix(np.rint(x * 1e5).astype(np.int64).view(np.uint64))
            total = np.zeros(len(x), np.uint64)
            for i in range(size):
                total = mix(total * np.uint64(0xA24BAED4963EE407) + same[:, i])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(x) + 1, size), pa.int32()), pa.array(x.astype(np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(total.view(np.int64))], names=["id", "v", "direction"])

    unit = cut(kept.select("id", "v").mapInArrow(prepare, "id string, v array<float>, direction bigint").withColumn("h", F.xxhash64("id")))
    n = unit.count()
    bits, tables = tables_for(n, least, recall)
    first = Window.partitionBy("direction").orderBy("id")
    indexed = unit.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((size, bits * tables)).astype(np.float32)
        powers = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                x = np.asarray(part.column(1).flatten(), np.float32).reshape(-1, size)
                sign = (x @ planes > 0).reshape(len(x), tables, bits)
                cell = (sign @ powers) + (np.arange(tables, dtype=np.int64) << 40)
                packed = np.repeat(quantised(x.astype(np.float64)), tables, axis=0)
                width = packed.shape[1]
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                ids = np.repeat(np.asarray(part.column(0)), tables)
                yield pa.RecordBatch.from_arrays([pa.array(mix(cell.reshape(-1).view(np.uint64)).view(np.int64)), pa.array(ids), data], names=["cell", "h", "packed"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = {}
        for group, more in _groups(batches, ["cell"]):
            cell, ids = group.column(0)[0].as_py(), group.column(1).to_numpy()
            number = part.get(cell, 0)
            if more or number or len(ids) > TILE:  # too many for one task: blocks for the second stage
                for a in range(0, group.num_rows, TILE):
                    g = group.slice(a, TILE)
                    yield pa.RecordBatch.from_arrays([g.column(1), pa.nulls(g.num_rows, pa.int64()), g.column(0), pa.array(np.full(g.num_rows, number), pa.int32()), g.column(2)], names=["a", "b", "cell", "block", "packed"])
                    number += 1
                part = {cell: number}
            elif len(ids) > 1:
                x = _matrix(group.column(2))
                i, j = _tile(x, x, True, k, least)
                yield _pairs(ids[i], ids[j])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _ in _groups(batches, ["cell", "low", "high"]):
            x, ids, block = _matrix(group.column("packed")), group.column("a").to_numpy(), group.column("block").to_numpy()
            low, high = block == group.column("low")[0].as_py(), block == group.column("high")[0].as_py()
            i, j = _tile(x[low], x[high], bool((low == high).all()), k, least)
            yield _pairs(ids[low][i], ids[high][j])

    placed = indexed.select("h", "v").mapInArrow(cells, "cell bigint, h bigint, packed binary")
    met = cut(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(within, _OUT))
    hot = met.filter("b is null")
    blocks = hot.groupBy("cell").agg((F.max("block") + 1).alias("n"))
    spread = hot.join(blocks, "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "a", "packed")
    crossed = spread.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high").mapInArrow(across, _OUT)
    pairs = met.filter("b is not null").select("a", "b").unionByName(crossed.select("a", "b")).distinct()
    one = unit.select(F.col("h").alias("a"), F.col("id").alias("id_a"), F.col("v").alias("v_a"))
    two = unit.select(F.col("h").alias("b"), F.col("id").alias("id_b"), F.col("v").alias("v_b"))
    cosine = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.join(one, "a").join(two, "b").select("id_a", "id_b", cosine.alias("cosine")).filter((F.col("cosine") >= least) & (F.col("id_a") != F.col("id_b")))
    crowded = unit.groupBy("direction").count().filter(F.col("count") > k + 1).select("direction")
    firsts = indexed.filter(F.col("r") <= k).join(crowded, "direction").select("direction", F.col("id").alias("id_b"))
    copies = unit.join(crowded, "direction").select("direction", F.col("id").alias("id_a")).join(firsts, "direction").filter("id_a != id_b").select("id_a", "id_b", F.lit(1.0).alias("cosine"))
    both = exact.unionByName(exact.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "cosine")).unionByName(copies)
    best = Window.partitionBy("id_a").orderBy(F.desc("cosine"), "id_b")
    ranked = both.distinct().withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    return ranked.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.max("cosine").alias("cosine"))
