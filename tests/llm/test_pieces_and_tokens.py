import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, split

VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


def texts_for_splitting():
    rng = random.Random(1)
    words = "alpha beta gamma delta".split()
    yield "x" * 5000
    yield "\n" * 3000
    yield " ".join(rng.choice(words) for _ in range(2000))
    yield "".join(rng.choice(words) + rng.choice([" ", ". ", "\n", "\r\n", "\n\n"]) for _ in range(3000))
    yield "短い文。" * 900
    yield "a\n" + "b" * 2046 + "\n" + "c" * 10
    yield ("é" * 300 + "\n") * 9


def test_round_trip_and_limits():
    for text in texts_for_splitting():
        spans = split.pieces(text)
        assert len(spans) > 1 and all(0 < b - a <= 2048 for a, b in spans)
        assert text[spans[0][0] : spans[0][1]] + "".join(text[a + 256 : b] for a, b in spans[1:]) == text
        assert all(end - begin == 256 for (_, end), (begin, _) in zip(spans, spans[1:], strict=False))
    assert split.pieces("x" * 2048) == [(0, 2048)] and split.pieces("") == [(0, 0)]


def test_cuts_at_the_strongest_boundaries():
    text = ("word " * 60 + ".\n") * 3 + "\n" + ("word " * 60 + ".\n") * 5
    assert any(text[a + 256 - 2 : a + 256] == "\n\n" for a, _ in split.pieces(text)[1:])


def test_split_frame(spark):
    rows = [("a", "f", "l\n" * 1500, None, 0, 1), ("b", "f", "short", 5, 1, 1), ("c", "f", "m" * 3000, 7, 2, 1), ("c", "f", "n" * 3000, 7, 2, 2), ("d", "f", None, 1, 3, 1)]
    df = spark.createDataFrame(rows, "id string, file_id string, content string, line_start int, chunk_index int, updated_at int").withColumn("piece", F.lit("clash"))
    out = split.split_oversized(df).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in out] == ["a", "a", "c", "c"] and [r.chunk_index for r in out] == [0, 1, 3, 4]
    assert out[0].line_start == 1 and out[1].line_start == 1 + ("l\n" * 1500)[: len(out[0].content) - 256].count("\n") and "n" in out[2].content
    assert split.split_oversized(df.limit(0)).count() == 0
    later = df.filter("id = 'a'").withColumns({"content": F.lit("short"), "updated_at": F.lit(9)})
    assert split.split_oversized(df.unionByName(later)).filter("chunk_id = 'a'").count() == 0


def test_pieces_among_their_chunks(spark):
    rows = [("a", "f", "x" * 3000, 1, 0), ("b", "f", "short", 9, 1), ("c", "f", "y" * 5000, 12, 2), ("d", "f", None, None, 3), ("e", "g", "z", 1, 0)]
    df = spark.createDataFrame(rows, "id string, file_id string, content string, line_start int, chunk_index int").withColumn("token_count", F.lit(7))
    got = sorted((r.file_id, r.chunk_index, r.chunk_id) for r in split.with_pieces(df.unionByName(df.limit(2))).collect())
    assert got == [("f", 0, "a"), ("f", 1, "a"), ("f", 2, "b"), ("f", 3, "c"), ("f", 4, "c"), ("f", 5, "c"), ("f", 6, "d"), ("g", 0, "e")]
    assert split.with_pieces(df.limit(0)).count() == 0


TEXTS = ["", None, " ", "Hello world", "don't  stop\n\n  now\t", "naïve café 日本語 🎉👩‍👩‍👧 <|endoftext|>", "á ​ x　y\x00\x85z᠎", "x" * 500, "ab" * 200 + "é" * 90, "1234567890 12,5 ½²Ⅷ", "\r\n\r\n  \r", "Ünïcödé’s it's I'LL we'll"]


def expected(text):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = bpe.PATTERN
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks_of(VOCABULARY), special_tokens={}).encode_ordinary(text or "")


def test_encoding(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    for batch in (bpe.BATCH, 3):  # however many documents share the words they fold
        got = {r.doc_id: list(r.ids) for r in bpe.encode(df, batch=batch).collect()}
        assert got == {i: expected(t) for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(df.limit(0)).count() == 0


def test_heap_merges_equal_the_plain_rule():
    ranks, rng = bpe.ranks_of(VOCABULARY), random.Random(2)
    for _ in range(60):
        word = bytes(rng.choice(b"abcdeehiinnoorsstt ") for _ in range(rng.randint(1, 40)))
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.heap_merges(word, ranks) == [ranks[p] for p in parts]


def test_any_script_is_cut_alike():
    rng, every = random.Random(5), bpe.regex.compile(bpe.PATTERN).findall
    signs = "".join(map(chr, (*range(0x20, 0x3000, 7), 0x85, 0xA0, 0x1C, 0x2028, 0x3000, 0x20BB7, 0x1F600, 0xFE0F)))
    for _ in range(3000):
        text = "".join(rng.choice(signs) if rng.random() < 0.7 else rng.choice(" \n'sé٣") for _ in range(rng.randint(0, 25)))
        assert bpe.cutter()(text) == every(text)
    whole = "".join(chr(i) + rng.choice(" a1\n-") for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    assert all(bpe.cutter()(part) == every(part) for part in (whole[i : i + 4000] for i in range(0, len(whole), 4000)))


def test_the_literal_map_knows_only_its_keys(spark):
    held = {f"k{i}": i for i in range(500)}
    words = spark.createDataFrame([(k,) for k in [*held, "k500", "", "x"]], "k string")
    got = {r.k: r.v for r in words.select("k", bpe.LiteralMap(held).use(lambda r: r(F.col("k"))).alias("v")).collect()}
    assert got == held | {"k500": None, "": None, "x": None}


def test_the_ascii_pattern_cuts_alike():
    rng, every = random.Random(3), bpe.regex.compile(bpe.PATTERN).findall
    for _ in range(3000):
        text = "".join(rng.choice(" \t\n\r\x0b\x1c\x1f\x00aZ09'_-.stlve") for _ in range(rng.randint(0, 25)))
        assert bpe.cutter()(text) == every(text)
