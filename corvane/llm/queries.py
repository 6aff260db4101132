"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, docs, leaks, machine, near, secrets, spans, split, vectors
from corvane.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody wrote by hand."""
    return machine.machine_made(table(spark, d, "files"), table(spark, d, "chunks"), machine.owners(table(spark, d, "projects"))).select("file_id")


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    """Files most of whose fingerprints stand in the repositories of three owners or more."""
    return machine.copied_files(table(spark, d, "chunks"), projects=3, of=machine.owners(table(spark, d, "projects"))).filter("copied").select("file_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that have to be cut."""
    return split.split_oversized(table(spark, d, "chunks")).filter("pieces > 1").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of those chunks."""
    return split.split_oversized(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods with meaningful documentation."""
    return docs.documented(table(spark, d, "symbols")).select("symbol_id").distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Those functions with their documentation."""
    return docs.documented(table(spark, d, "symbols")).distinct()


def _both(spark: SparkSession, d: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return operator(table(spark, d, "symbols")).withColumn("record_type", F.lit("symbol")).unionByName(operator(table(spark, d, "chunks")).withColumn("record_type", F.lit("chunk")))


def _records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Symbols and chunks as one table."""
    of = lambda name, kind: table(spark, d, name).select(F.lit(kind).alias("record_type"), "id", *columns, "updated_at", "inserted_at")
    return of("symbols", "symbol").unionByName(of("chunks", "chunk"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a literal credential begins."""
    found = secrets.credentials(_records(spark, d, "content"), ["record_type", "id"])
    return found.select("record_type", F.col("id").alias("record_id"), F.explode("lines").alias("line_no"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The records with credentials, masked."""
    return secrets.credentials(_records(spark, d, "content"), ["record_type", "id"]).select("record_type", "id", "redacted")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate symbols, and of near-duplicate chunks."""
    return near.near_pairs(_records(spark, d, "content"), within="record_type")


def p5_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of symbols whose bags of five words, counted as often as they stand, have a weighted similarity of 0.8 or more."""
    return near.near_pairs(table(spark, d, "symbols"), shingle=5, least=0.8, weighted=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of symbols, and of chunks, whose vectors are among each other's nearest."""
    return _both(spark, d, vectors.similar_pairs).select("record_type", "id_a", "id_b")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's token ids."""
    return bpe.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, back from its token ids."""
    return bpe.decode(bpe.encode(table(spark, d, "documents"))).select("doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a verbatim stretch in common."""
    return spans.shared_pairs(table(spark, d, "documents")).toDF("doc_a", "doc_b")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    return spans.shared_amounts(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    """Every query of this subpackage."""
    return {f.__name__: f for f in (p1_found, p1_copies, p2_found, p2_pieces, p3_found, p3_pairs, p4_found, p4_redacted, p5_found, p5_weighted, p6_found, p7_ids, p7_decoded, p8_found, p9_found, p9_shared)}


def _last(name: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, inserted_at DESC NULLS LAST) AS _rn FROM {name}) WHERE _rn = 1)"


_RECORDS = f"SELECT 'symbol' AS record_type, id, content, embedding FROM {_last('symbols')} UNION ALL SELECT 'chunk', id, content, embedding FROM {_last('chunks')}"


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can state on whole tables; the others are tested against brute force."""
    return {
        "p2_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > 2048",
        "p5_found": f"WITH w AS (SELECT record_type, id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM ({_RECORDS})), "
        "g AS (SELECT DISTINCT record_type, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT record_type, id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)), "
        "n AS (SELECT record_type, id, count(*) AS n FROM g GROUP BY ALL), "
        "s AS (SELECT a.record_type, a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.record_type = b.record_type AND a.g = b.g AND a.id < b.id GROUP BY ALL) "
        "SELECT s.record_type, id_a, id_b FROM s JOIN n a ON a.record_type = s.record_type AND a.id = id_a JOIN n b ON b.record_type = s.record_type AND b.id = id_b WHERE 10 * c >= 7 * (a.n + b.n - c)",
        "p5_weighted": f"WITH w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM {_last('symbols')}), "
        "g AS (SELECT id, array_to_string(w[i:i + 4], ' ') AS g, count(*) AS n FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5) GROUP BY ALL), "
        "t AS (SELECT id, sum(n) AS t FROM g GROUP BY id), "
        "s AS (SELECT a.id AS id_a, b.id AS id_b, sum(least(a.n, b.n)) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL) "
        "SELECT id_a, id_b FROM s JOIN t a ON a.id = id_a JOIN t b ON b.id = id_b WHERE 10 * c >= 8 * (a.t + b.t - c)",
        "p6_found": f"WITH v AS (SELECT record_type, id, CAST(embedding AS DOUBLE[]) AS v FROM ({_RECORDS}) WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
        "c AS (SELECT a.record_type, a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.record_type = b.record_type AND a.id <> b.id), "
        "t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY record_type, x ORDER BY c DESC, y) <= 10) "
        "SELECT DISTINCT record_type, least(x, y) AS id_a, greatest(x, y) AS id_b FROM t WHERE c >= 0.9",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_found": "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE length(text) > 0), e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items), "
        "dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 15], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 14)) AS i FROM d)), eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 15], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 14)) AS i FROM e)) "
        "SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)",
        "p9_found": "WITH s AS (SELECT DISTINCT doc_id, hash(substring(text, i, 400)) AS h FROM (SELECT doc_id, text, CAST(unnest(range(1, length(text) - 398)) AS BIGINT) AS i FROM documents WHERE length(text) >= 400)) "
        "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id",
    }
