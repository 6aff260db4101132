import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import leaks, near, pairs, spans, vectors


def brute_common(a, b, n):
    grams = {b[i : i + n] for i in range(len(b) - n + 1)}
    return any(a[i : i + n] in grams for i in range(len(a) - n + 1))


def test_shared_pairs_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(400)
    docs = [text(150) for _ in range(10)]
    docs += [text(60) + base[200 : 200 + n] + text(60) for n in (399, 400, 401, 650)]
    docs += [base, base, "-" * 1000, "x" + "-" * 450, "-" * 399, "ab" * 300 + text(10), "é" * 420, "é" * 500, "", None, "日本語" * 150]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class", F.lit("clash"))
    got = {(r.a, r.b) for r in spans.shared_pairs(df).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if a and b and brute_common(a, b, 400)}
    assert got == want
    shared = {r.doc_id: r.shared_chars for r in spans.shared_amounts(df).collect()}
    assert set(shared) == {x for p in want for x in p} and shared[14] == len(base) and 400 <= shared[11] <= len(docs[11])
    assert spans.shared_pairs(df.limit(0)).count() == 0


def test_keys_of_a_text_are_made_once(spark):
    d = spark.createDataFrame([(1, "ab" * 300), (2, "x" + "ab" * 300), (3, None)], "doc_id bigint, text string")
    _, links = spans.shared_spans(d, spans=False)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the verification; the keys are read from what was written
    assert links.count() == 1


def test_a_stretch_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 5)
    rng = random.Random(15)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    licence = text(80)
    rows = [(i, text(20) + licence + text(20)) for i in range(40)] + [(100 + i, text(60)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.a, r.b) for r in spans.shared_pairs(df).collect())
    assert got == list(itertools.combinations(range(40), 2))
    assert {r.doc_id: r.partners for r in spans.shared_amounts(df).collect()} == dict.fromkeys(range(40), 39)


def test_sharing_by_brute_force():
    rng = random.Random(16)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert spans._shares(a, b, 10) == brute_common(a, b, 10)


def test_symbols_do_not_depend_on_place():
    rng = random.Random(8)
    middle = "".join(rng.choice("abc def.\n") for _ in range(900))
    found = []
    for before in ("", "x" * 77, "some other words "):
        codes = spans.code_points(before + middle + before)
        _, size, name = spans.complete_symbols(codes, np.zeros(len(codes), int))
        assert size.max() < 2 * spans.GRAIN
        found.append(set(name.tolist()))
    assert len(found[0] & found[1] & found[2]) >= 6


def test_leaks_by_brute_force(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(80)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    docs = []
    for n in (15, 16, 17, 40):
        p = passages[rng.randrange(12)].split()
        at = rng.randrange(40 - n + 1)
        docs.append("intro -- " + " ,\n".join(w.upper() for w in p[at : at + n]) + "! outro")
    docs += ["", None, "nothing here", passages[3] * 2]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    items = spark.createDataFrame([*enumerate(passages), (90, None), (91, "short one")], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(d, items).collect()}
    want = set()
    for (i, t), (k, p) in itertools.product(enumerate(docs), enumerate(passages)):
        a, b = leaks.words_of(p), leaks.words_of(t)
        grams = {tuple(b[j : j + 16]) for j in range(len(b) - 15)}
        if any(tuple(a[j : j + 16]) in grams for j in range(len(a) - 15)):
            want.add((i, k))
    assert got == want and len(got) >= 4
    assert leaks.leaked(d.limit(0), items).count() == 0 and leaks.leaked(d, items.limit(0)).count() == 0


def test_leaks_with_edits():
    passage = [f"w{i}" for i in range(30)]
    changed = passage[:10] + ["other"] + passage[11:25]
    assert leaks.aligned(passage, changed, 0, 0, 16, 0) < 16 <= leaks.aligned(passage, changed, -2, 2, 16, 1)


def test_near_pairs_by_brute_force(spark):
    rng = random.Random(7)
    words = [f"t{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(base))
        for share in (0.02, 0.05, 0.12):
            texts.append(" ; ".join(rng.choice(words) if rng.random() < share else w for w in base))
    texts += [texts[0], texts[0].upper(), "a b", "a b c", "a b c", "", None, "x y z x y z x y z"]
    rows = [(f"id{i:03}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("class", F.lit(1))
    got = {(r.id_a, r.id_b) for r in near.near_pairs(df.unionByName(df.limit(5))).collect()}

    def grams(t):
        w = "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in (t or "").lower()).split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = {k: grams(t) for k, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == want
    assert near.near_pairs(df.limit(0)).count() == 0


def test_hot_bands_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near, "HOT", 2)
    monkeypatch.setattr(pairs, "BLOCK", 4)
    rng = random.Random(17)
    base = [f"c{i}" for i in range(60)]
    texts = [" ".join(base[:n] + [f"u{i}x{j}" for j in range(60 - n)]) for i, n in enumerate([20, 30, 40, 50, 54, 56, 57, 58] * 4)]
    texts += [" ".join(rng.choice(["lic", "ence", *base[:6]]) for _ in range(40)) for _ in range(12)] + [" ".join(base) + " tail" * i for i in range(6)]
    rows = [(f"r{i:02}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string")
    for weighted in (False, True):
        got = {(r.id_a, r.id_b) for r in near.near_pairs(df, weighted=weighted).collect()}
        want = set()
        for (a, x), (b, y) in itertools.combinations(rows, 2):
            g, h = (Counter(zip(w, w[1:], w[2:], strict=False)) for w in (x.split(), y.split()))
            if not weighted:
                g, h = Counter(set(g)), Counter(set(h))
            if (g & h).total() >= 0.7 * (g | h).total():
                want.add((a, b))
        assert got == want and len(want) > 20


def test_twenty_thousand_records_in_one_band(spark, monkeypatch):
    licence = " ".join(f"w{i}" for i in range(60))
    rows = [(f"r{i:05}", licence + "".join(f" u{i}x{j}" for j in range(40))) for i in range(20_000)]
    rows += [(f"s{i:05}", rows[i * 7][1] + " end") for i in range(50)]
    got = {(r.id_a, r.id_b) for r in near.near_pairs(spark.createDataFrame(rows, "id string, content string").repartition(8)).collect()}
    assert got == {(f"r{i * 7:05}", f"s{i:05}") for i in range(50)}


def test_pairs_of_a_hot_key(spark):
    rows = [(k, i) for i in range(60) for k in ("hot", f"own{i}", f"two{i // 2}")] + [("half", i) for i in range(0, 60, 2)]
    keyed = spark.createDataFrame(rows, "key string, item int")
    got = [(r.a, r.b) for r in pairs.sharing(keyed, "key", "item", 7).collect()]
    assert sorted(got) == list(itertools.combinations(range(60), 2))
    assert pairs.sharing(keyed.limit(0), "key", "item").count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    n, m = 300, 4096
    h = rng.integers(0, 2**63, n).astype(np.uint64)
    wa, wb = rng.integers(1, 20, n), rng.integers(1, 20, n)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    s = near.signatures(np.repeat([0, 1], n), np.concatenate([h, h]), np.concatenate([wa, wb]), 2, m)
    assert abs((s[0] == s[1]).mean() - want) < 0.035


def test_similar_pairs_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 64))
    near_by = [x[i] * s + rng.standard_normal(64) * 0.15 for i in range(40) for s in (1.0, 7.0)]
    rows = [(f"v{i:04}", v.tolist()) for i, v in enumerate([*x, *near_by])]
    rows += [("n0", None), ("n1", [0.0] * 64), ("n2", [1.0] * 63), ("n3", [float("nan")] * 64), ("n4", [float("inf")] + [0.0] * 63)]
    same = [(f"c{i:02}", [1.0] * 64) for i in range(30)]
    df = spark.createDataFrame(rows + same, "id string, embedding array<double>")
    got = {(r.id_a, r.id_b) for r in vectors.similar_pairs(df).collect()}
    ids = [k for k, _ in rows[:680]]
    u = np.array([v for _, v in rows[:680]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -1)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(680) for j in np.argsort(-g[i])[:10] if g[i, j] >= 0.9}
    plain = {p for p in got if p[0][0] == "v"}
    assert plain <= want and len(plain) >= 0.97 * len(want)
    copies = {p for p in got if p[0][0] == "c"}
    assert len(copies) == 10 * 9 // 2 + 10 + 19 * 10 and not any(p[0][0] == "n" or p[1][0] == "n" for p in got)
    assert vectors.similar_pairs(df.limit(0)).count() == 0
    pair = df.filter("id in ('v0600', 'v0601')").withColumn("updated_at", F.lit(1))
    zero = pair.filter("id = 'v0600'").withColumns({"embedding": F.expr("array_repeat(0.0D, 64)"), "updated_at": F.lit(2)})
    assert vectors.similar_pairs(pair).count() == 1 and vectors.similar_pairs(pair.unionByName(zero)).count() == 0


def test_hot_cells_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(64)
    df = spark.createDataFrame([(f"v{i:03}", (base + rng.standard_normal(64) * 0.02).tolist()) for i in range(120)], "id string, embedding array<double>")
    got = vectors.similar_pairs(df).collect()
    u = np.array([r.embedding for r in df.orderBy("id").collect()])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -1)
    want = {tuple(sorted((i, int(j)))) for i in range(120) for j in np.argsort(-g[i])[:10]}
    found = {(int(r.id_a[1:]), int(r.id_b[1:])) for r in got}
    assert len(found & want) >= 0.99 * len(want)


def test_tile_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = vectors._tile(vectors.quantised(x), vectors.quantised(x), True, 50, 0.1)
    g = x @ x.T
    assert {(a, b) for a in range(50) for b in range(a + 1, 50) if g[a, b] >= 0.1} <= set(zip(i.tolist(), j.tolist(), strict=True))
