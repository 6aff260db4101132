"""Vector search, text search, graph search, their fusion and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.text import search_terms, tokens
from corvane.functions.vectors import cosine
from corvane.operators.graph import expand
from corvane.plans.lineage import cut

#: Most bytes of query vectors that are sent to the executors at once; more are searched in further blocks.
QUERY_BYTES = 64_000_000
WEIGHTS = {"vector": 0.55, "bm25": 0.25, "graph": 0.20}
SCORES = {1: 0.9, 2: 0.6, 3: 0.3}


def vector_search(queries: DataFrame, rows: DataFrame, k: int = 25, vector: str = "embedding", key: str = "id", size: int = 64) -> DataFrame:
    """(query, id, score): the ``k`` rows of greatest cosine for each query vector (columns query, vector); ties go to the smaller id.

    Exact block search: queries are held in blocks of bounded size, each batch of rows is
    multiplied with a block and only its k best per query leave the task, so the
    final ranking shuffles at most k rows per query and task. Unusable vectors
    and queries (null, of another size, not finite, zero) are left out.
    """
    spark = rows.sparkSession
    query_arrow = to_arrow_type(queries.schema["query"].dataType)
    id_type, query_type = rows.schema[key].dataType.simpleString(), queries.schema["query"].dataType.simpleString()

    def good(v: str) -> Column:
        return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))

    asked = queries.filter(good("vector")).select("query", F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-asked.count() * size * 8 // QUERY_BYTES))
    held = rows.filter(good(vector)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    out = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toArrow()  # at most about QUERY_BYTES
        if not block.num_rows:
            continue
        vectors = np.asarray(block.column("vector").combine_chunks().flatten()).reshape(-1, size)
        sent = spark.sparkContext.broadcast((block.column("query").to_pylist(), vectors))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            names = pa.array(names, query_arrow)
            for batch in batches:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, size)
                scores = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                take = min(k, len(x))
                cut = np.partition(scores, len(x) - take, axis=1)[:, len(x) - take]
                i, j = np.nonzero(scores >= cut[:, None] - 1e-9)  # ties stay in
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), batch.column(0).take(pa.array(j)), pa.array(scores[i, j])], names=["query", "id", "score"])

        part = held.mapInArrow(best, f"query {query_type}, id {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.select("query").limit(0).crossJoin(rows.select(F.col(key).alias("id")).limit(0)).withColumn("score", F.lit(0.0))
    return out.withColumn("score", F.round("score", 6)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def approximate_search(queries: DataFrame, rows: DataFrame, k: int = 10, least: float = 0.9, recall: float = 0.95, vector: str = "embedding", key: str = "id", size: int = 64, cell: int = 64, seed: int = 11) -> DataFrame:
    """(query, id, score): approximate :func:`vector_search` for rows of cosine ``least`` or more, through an index of signs of random projections.

    All rows are indexed; the numbers of projections and of tables follow from
    the number of rows, ``least`` and the asked ``recall``. Queries and rows
    that share a cell of a table are compared exactly.
    """
    import math

    held = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("v")).filter((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    bits = max(1, math.ceil(math.log2(max(2, held.count() / cell))))
    agree = 1 - math.acos(least) / math.pi
    tables = math.ceil(math.log(1 - recall) / math.log(1 - min(0.999999, agree**bits)))

    def placed(df: DataFrame, name: str) -> DataFrame:
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.random.default_rng(seed).standard_normal((size, bits * tables))
            powers = (1 << np.arange(bits)).astype(np.int64)
            for batch in batches:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, size)
                keys = ((x @ planes > 0).reshape(len(x), tables, bits) @ powers) + (np.arange(tables, dtype=np.int64) << 40)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[name, "cells"])

        return df.select(name, "v").mapInArrow(cells, f"{name} {df.schema[name].dataType.simpleString()}, cells array<bigint>").select(name, F.explode("cells").alias("cell"))

    pairs = placed(asked, "query").join(placed(held, "id"), "cell").select("query", "id").distinct()
    scored = pairs.join(asked.withColumnRenamed("v", "q"), "query").join(held, "id").select("query", "id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score")).filter(F.col("score") >= least)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def bm25_search(queries: list[tuple[str, str]], rows: DataFrame, match: list[str], rank: list[str], k: int = 25, k1: float = 1.2, b: float = 0.75, key: str = "id") -> DataFrame:
    """(query, id, score): Okapi BM25 over the ``rank`` columns of the rows that match every term of a query as a prefix of a token of the ``match`` columns.

    A query is (name, text). The queries' terms are parameters, so one scan
    counts the prefixes of all of them and no posting is shuffled; ties go to the
    smaller id. A query without terms matches nothing.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame(queries, "query string, text string").select("query", F.array_distinct(search_terms(F.col("text"))).alias("terms"))
    terms = {r.query: r.terms for r in asked.collect() if r.terms}
    every = sorted({t for ts in terms.values() for t in ts})
    if not every:
        return rows.select(F.lit("").alias("query"), F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    text = lambda columns: F.concat_ws(" ", *[F.col(c) for c in columns])
    cut = rows.select(F.col(key).alias("id"), tokens(text(match)).alias("m"), tokens(text(rank)).alias("r"))
    count = lambda side, t: F.size(F.filter(side, lambda w: w.startswith(t)))
    counted = cut.select("id", F.size("r").alias("dl"), *[count("r", t).alias(f"tf{i}") for i, t in enumerate(every)], *[(count("m", t) > 0).alias(f"in{i}") for i, t in enumerate(every)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(every))]).first()
    number = {t: i for i, t in enumerate(every)}

    def score(query_terms: list[str]) -> Column:
        total = F.lit(0.0)
        for t in query_terms:
            i = number[t]
            idf = F.ln(F.lit(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
            tf = F.col(f"tf{i}").cast("double")
            total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(float(stats["avgdl"] or 1))))
        return total

    def all_in(query_terms: list[str]) -> Column:
        out = F.lit(True)
        for t in query_terms:
            out = out & F.col(f"in{number[t]}")
        return out

    hits = F.array(*[F.when(all_in(ts), F.struct(F.lit(q).alias("query"), score(ts).alias("score"))) for q, ts in terms.items()])
    found = counted.select("id", F.explode(F.array_compact(hits)).alias("hit")).select("hit.query", "id", F.round("hit.score", 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def graph_search(queries: list[tuple[str, str]], symbols: DataFrame, edge: DataFrame, k: int = 25, hops: int = 3) -> DataFrame:
    """(query, id, score): symbols within ``hops`` edges of the first symbol whose name or qualified name contains the query's text, scored by hop."""
    spark = symbols.sparkSession
    if not queries:
        return spark.createDataFrame([], f"query string, id {symbols.schema['id'].dataType.simpleString()}, score double")
    like = lambda text: F.lower("name").contains(text.lower()) | F.lower("qualified_name").contains(text.lower())
    best = [F.min(F.when(like(text), F.struct(F.length("name").alias("n"), "name", "id"))).alias(f"q{i}") for i, (_, text) in enumerate(queries)]
    firsts = F.array(*[F.struct(F.lit(name).alias("query"), F.col(f"q{i}.id").alias("seed")) for i, (name, _) in enumerate(queries)])
    seeds = cut(symbols.agg(*best).select(F.inline(firsts)).filter("seed is not null"))  # one scan for all queries
    found = expand(edge, seeds, hops)
    score = F.coalesce(*[F.when(F.col("hop") == h, F.lit(s)) for h, s in SCORES.items()], F.lit(0.1))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    scored = seeds.join(found, "seed").select("query", "id", score.alias("score")).distinct()
    return scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def fuse(engines: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 7, constant: int = 60) -> DataFrame:
    """(query, id, combined_score, engines): weighted reciprocal rank fusion of ranked lists (query, id, score); ties go to the smaller id. Missing and empty engines are fine."""
    weights = weights or WEIGHTS
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    parts = [df.select(F.col("query").cast("string"), F.col("id").cast("string"), F.lit(e).alias("engine"), (F.lit(weights.get(e, 0.0)) / (constant + F.row_number().over(order))).alias("part")) for e, df in engines.items()]
    lists = parts[0]
    for p in parts[1:]:
        lists = lists.unionByName(p)
    summed = lists.groupBy("query", "id").agg(F.sum("part").alias("total"), F.array_sort(F.collect_set("engine")).alias("engines"))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("total", 12)), "id")
    ranked = summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query", "id", "rank", F.round("total", 4).alias("combined_score"), F.array_join("engines", ",").alias("engines"))


def hybrid_search(texts: list[tuple[str, str]], vectors: DataFrame, symbols: DataFrame, edge: DataFrame, k: int = 25, final_k: int = 7, weights: dict[str, float] | None = None) -> DataFrame:
    """Fusion of vector, text and graph search over symbols; ``vectors`` has (query, vector) for the names in ``texts``."""
    engines = {
        "vector": vector_search(vectors, symbols, k),
        "bm25": bm25_search(texts, symbols, ["name", "qualified_name", "content"], ["name", "content"], k),
        "graph": graph_search(texts, symbols, edge, k),
    }
    return fuse(engines, weights, final_k)


def related(rows: DataFrame, queries: DataFrame, k: int = 5, most: int = 4) -> DataFrame:
    """(query, id, score): nearest rows of each queried row without itself; ``queries`` has (query, vector), query being a row's id."""
    found = vector_search(queries, rows, k).filter(F.col("query") != F.col("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def evaluate(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query, precision_at_k, recall_at_k, mrr) of ranked results (query, id, rank) against judgements (query, id); a query without results has zeros."""
    judged = relevant.select("query", "id").distinct()
    hits = results.select("query", "id", "rank").join(judged.withColumn("rel", F.lit(1)), ["query", "id"], "left")
    per = hits.groupBy("query").agg(F.count_if((F.col("rank") <= k) & (F.col("rel") == 1)).alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    wanted = judged.groupBy("query").agg(F.count("*").alias("wanted"))
    joined = wanted.join(per, "query", "full")
    return joined.select(
        "query",
        (F.coalesce("found", F.lit(0)) / F.lit(max(k, 1))).alias("precision_at_k"),
        F.coalesce(F.try_divide(F.coalesce("found", F.lit(0)), F.col("wanted")), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def relevant_by_name(results: DataFrame, expected: DataFrame, name: str = "name") -> DataFrame:
    """(query, id) of results whose name contains an expected text (query, expected), whatever the case. ``expected`` is a list of judgements per query."""
    lists = expected.groupBy("query").agg(F.collect_set(F.lower("expected")).alias("wanted"))
    return results.join(lists, "query").filter(F.exists("wanted", lambda w: F.contains(F.lower(name), w))).select("query", "id").distinct()


def averages(per_query: DataFrame) -> DataFrame:
    """Means of an evaluation, three decimals."""
    return per_query.agg(*[F.round(F.avg(c), 3).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr")])
