"""Operators 1, 6 and 7 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import check
from tessergraph.llm import buckets, common, components, queries
from tessergraph.llm.components import connected_components
from tessergraph.llm.embed_dedup import embedding_near_dedup, embedding_pairs
from tessergraph.llm.lz_fingerprint import NEAR, lz_fingerprints, lz_similar_documents, lz_similar_pairs, phrase_lengths
from tessergraph.llm.ngram_join import depth_needed, drop_near_duplicates, ngram_jaccard_join, ngram_jaccard_pairs


def grams(text, n=3):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(x, y):
    g, h = grams(x), grams(y)
    return len(g & h) / len(g | h)


def brute_jaccard(rows, t=0.5):
    """Pairs of unequal ids, each by its most similar texts."""
    out = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if a is None or b is None or a == b or not x or not y or not x.split() or not y.split():
                continue
            if jaccard(x, y) >= t:
                key = (min(a, b), max(a, b))
                out[key] = max(out.get(key, 0), jaccard(x, y))
    return out


def brute_classes(rows, linked):
    """{id: (class, links)} of records, which are distinct (id, text) that ``linked`` compares."""
    records = sorted({(i, t) for i, t in rows if i is not None}, key=str)
    root, links = {i: i for i, _ in records}, dict.fromkeys((i for i, _ in records), 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(records):
        for b, y in records[k + 1 :]:
            if linked(x, y):
                links[a], links[b] = links[a] + 1, links[b] + 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (find(i), links[i]) for i in root}


def classes(df):
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in df.collect()}
    assert len(got) == df.count()
    return got


def similar_words(x, y):
    return bool(x and y and x.split() and y.split()) and jaccard(x, y) >= 0.5


def families(seed, count, most):
    """Texts with near copies of several degrees."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for _ in range(count):
        base = [word() for _ in range(rng.randint(2, 60))]
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.fixture(params=["whole", "blocks", "buckets"])
def layout(request, monkeypatch):
    """Components in one cell, cut into blocks, and spread by bucket; with hot keys in the last."""
    if request.param != "whole":
        monkeypatch.setattr(buckets, "CELL", 3)
    if request.param == "buckets":
        monkeypatch.setattr(buckets, "BLOCKS", 1)
        monkeypatch.setattr(common, "HOT", 3)
        monkeypatch.setattr(components, "HOT", 3)


def test_jaccard_join_equals_brute_force(spark, layout):
    rows = families(3, 40, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members = ngram_jaccard_pairs(docs, brute=16, recall=0.9999)
    of = {r["doc_id"]: r["representative"] for r in members.collect()}
    found = pairs.collect()
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in found}
    want = {(a, b): v for (a, b), v in brute_jaccard(rows).items() if of[a] == a and of[b] == b and of[a] != of[b]}
    assert len(found) == len(got) and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    assert classes(ngram_jaccard_join(docs, brute=16, recall=0.9999)) == brute_classes(rows, similar_words)


def test_jaccard_recall_at_the_default(spark):
    rows = families(5, 40, 9)
    pairs, members = ngram_jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), brute=16)
    of = {r["doc_id"]: r["representative"] for r in members.collect()}
    want = {(a, b) for a, b in brute_jaccard(rows) if of[a] == a and of[b] == b and of[a] != of[b]}
    assert pairs.count() >= 0.97 * len(want) > 0
    assert [depth_needed(n) for n in (0, 250_000, 10**7, 10**10)] == [3, 3, 4, 6]


def test_jaccard_join_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    equal_words = lambda x, y: similar_words(x, y)
    words = [(i, " ".join(t.lower().split()) if t else t) for i, t in rows]
    assert classes(ngram_jaccard_join(odd)) == brute_classes(words, equal_words)
    assert ngram_jaccard_join(empty).count() == 0 and ngram_jaccard_pairs(empty)[0].count() == 0
    long = spark.createDataFrame([(1, "a b c d " * 60_000), (2, "a b c d " * 60_000 + "e")], "doc_id long, text string")
    assert classes(ngram_jaccard_join(long)) == {1: (1, 1), 2: (1, 1)}


def test_jaccard_right_at_the_threshold(spark):
    # 3 of 6 three-grams in common
    docs = spark.createDataFrame([(1, "a b c d e x"), (2, "a b c d e f g"), (3, "a b c d e f q r")], "doc_id long, text string")
    assert jaccard("a b c d e x", "a b c d e f g") == 0.5
    got = classes(ngram_jaccard_join(docs, recall=0.999999))
    assert got == brute_classes([tuple(r) for r in docs.collect()], similar_words)


def test_near_duplicates_keep_one_of_each_group(spark, odd, empty):
    got = drop_near_duplicates(odd)
    assert got.columns == odd.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in got.collect())
    assert [i for i, _ in ids] == sorted([1, -1, 4, -1, 5, 6, 7, 9, 10, 10, 11])
    assert drop_near_duplicates(empty).count() == 0
    long = spark.createDataFrame([(2, "a b c d " * 60_000), (1, "a b c d " * 60_000 + "e")], "doc_id long, text string")
    assert [r["doc_id"] for r in drop_near_duplicates(long).select("doc_id").collect()] == [1]


def test_jaccard_query_equals_sql(spark, sf):
    check(spark, queries.queries()["op1_ngram_jaccard_join"], queries.oracle_sql()["op1_ngram_jaccard_join"], sf)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (50, 49)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 49: 49, 50: 49}


def test_embedding_pairs_equal_brute_force(spark, layout):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.05, 0.2, 0.3, 0.4)] + [base[:3]] * 2)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos, first = u @ u.T, {i: i if i < 123 else i - 3 for i in range(len(x))}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= 0.9 and first[i] == i and first[j] == j}
    pairs, members = embedding_pairs(v, bits=4, recall=0.9999)
    found = pairs.collect()
    got = {(r["a"], r["b"]): r["cosine"] for r in found}
    assert set(got) == want and len(found) == len(got)
    assert all(got[a, b] == pytest.approx(cos[a, b]) for a, b in got)
    assert {r["id"]: r["representative"] for r in members.collect()} == first
    got = {r["vec_id"]: (r["component"], r["links"]) for r in embedding_near_dedup(v.toDF("vec_id", "embedding"), bits=4, recall=0.9999).collect()}
    assert got == brute_classes([(i, i) for i in range(len(x))], lambda i, j: cos[i, j] >= 0.9)


def test_embeddings_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [1.0], "x"), (6, [None, 1.0], "x"), (7, [float("nan"), 1.0], "x"), (None, [1.0, 0.0], "x"), (8, [0.0, 1.0], "x"), (9, [], "x"), (10, [1e200, 0.0], "x"), (11, [float("inf"), 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    got = {r["vec_id"]: (r["component"], r["size"], r["links"], r["kept"]) for r in embedding_near_dedup(df).collect()}
    assert got == {1: (1, 3, 2, True), 2: (1, 3, 2, False), 10: (1, 3, 2, False), **{i: (i, 1, 0, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)}}
    assert embedding_near_dedup(df.limit(0)).count() == 0
    assert embedding_near_dedup(df.filter("vec_id = 3")).collect()[0]["component"] == 3
    wide = spark.createDataFrame([(1, [1.0] * 50_000), (2, [1.0] * 49_999 + [1.1])], "vec_id long, embedding array<double>")
    assert {r["component"] for r in embedding_near_dedup(wide, bits=2).collect()} == {1}


def test_embedding_query_equals_sql(spark, sf):
    check(spark, queries.queries()["op6_embedding_near_dedup"], queries.oracle_sql()["op6_embedding_near_dedup"], sf)


def phrases(text):
    raw, seen, at = text.encode(), set(), 0
    while at < len(raw):
        n = 1
        while at + n <= len(raw) and raw[at : at + n] in seen:
            n += 1
        seen.add(raw[at : at + n])
        at += n
    return seen


def test_phrases():
    assert phrase_lengths("abababa") == [1, 1, 2, 3] and phrase_lengths("") == []
    for text in ("aaaaaa", "abracadabra", "x"):
        assert len(phrase_lengths(text)) == len(phrases(text))


def test_lz_pairs_equal_brute_force(spark, layout):
    rows = [(i, t) for i, t in families(8, 25, 6) if len(t) > 60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r["doc_id"]: np.frombuffer(r["signature"], np.uint32).astype(np.uint16) for r in lz_fingerprints(docs).collect()}
    pairs, members = lz_similar_pairs(docs, recall=0.9999)
    of, found = {r["doc_id"]: r["representative"] for r in members.collect()}, pairs.collect()
    want = {(a, b) for a in prints for b in prints if a < b and (prints[a] == prints[b]).mean() >= 0.85 and of[a] == a and of[b] == b}
    got = {(r["doc_a"], r["doc_b"]) for r in found}
    assert len(found) == len(got) and got == want and want
    text = dict(rows)
    alike = {(text[a], text[b]) for a, b in want}
    linked = lambda x, y: x == y or (x, y) in alike or (y, x) in alike
    assert classes(lz_similar_documents(docs, recall=0.9999)) == brute_classes(rows, linked)
    sets = {i: phrases(t) for i, t in rows}
    for a in list(prints)[:20]:
        for b in list(prints)[:20]:
            assert abs((prints[a] == prints[b]).mean() - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 0.2


def test_lz_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    prints = {t: np.frombuffer(r["signature"], np.uint32).astype(np.uint16) for t in {t for _, t in rows if t} for r in lz_fingerprints(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()}
    linked = lambda x, y: bool(x and y) and (prints[x] == prints[y]).mean() >= 0.85
    assert classes(lz_similar_documents(odd, recall=0.9999)) == brute_classes(rows, linked)
    assert lz_similar_documents(empty).count() == 0 and lz_fingerprints(odd.filter(F.col("text") == "")).count() == 0
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 30_000), (2, "lorem ipsum dolor " * 30_000 + "sit"), (3, "x")], "doc_id long, text string")
    assert classes(lz_similar_documents(long)) == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_full_buckets_are_cut_into_small_tasks(spark):
    """20,000 sets of one bucket: no cell has more than CELL of them, and each two meet in one."""
    rows = spark.range(20_000).select(F.lit(5).cast("long").alias("bucket"), F.col("id").alias("g"), *[F.lit(0).cast("long").alias(c) for c in buckets.NIBBLES], F.lit(20_000).alias("n"))
    got = buckets.cells(rows, buckets.CELL)
    per = got.groupBy("bucket").count().agg(F.max("count").alias("m"), F.count("*").alias("cells")).first()
    assert per["m"] < 1.3 * buckets.CELL and per["cells"] == 20 * 21 / 2
    some = got.filter("g in (1, 2, 17, 19999)").select("bucket", "g", "side").collect()
    for a in (1, 2, 17, 19999):
        for b in (1, 2, 17, 19999):
            met = [x["bucket"] for x in some for y in some if x["g"] == a and y["g"] == b and x["bucket"] == y["bucket"] and a < b and (x["side"] == 0 or x["side"] != y["side"])]
            assert len(met) == (a < b)


def test_lz_finds_near_copies_of_texts(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs = queries.documents(spark, big)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    near = {(r["doc_a"], r["doc_b"]) for r in ngram_jaccard_pairs(docs)[0].collect()}
    pairs, members = lz_similar_pairs(docs, NEAR, perms=384)
    of, got = {r["doc_id"]: r["representative"] for r in members.collect()}, {(r["doc_a"], r["doc_b"]) for r in pairs.collect()}
    at = {tuple(sorted((of[a], of[b]))) for a, b in near if of[a] != of[b]}
    assert len(at & got) >= 0.95 * len(at) > 0
    unlike = [(a, b) for a, b in got if len(grams(texts[a]) & grams(texts[b])) <= 5 and min(len(texts[a]), len(texts[b])) > 300]
    assert not unlike


def test_lz_similarity_does_not_follow_the_number_of_documents(spark):
    rows = [(i, t) for i, t in families(8, 25, 6) if len(t) > 60]
    other = [(1000 + i, "".join(random.Random(i).choices("ijklmnopqrst", k=30))) for i in range(3_000)]
    some = {tuple(r) for r in lz_similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.6, 0.9999)[0].collect()}
    many = {tuple(r) for r in lz_similar_pairs(spark.createDataFrame(rows + other, "doc_id long, text string"), 0.6, 0.9999)[0].collect() if r["doc_b"] < 1000}
    value = {(a, b): s for a, b, s in some}
    assert some and all(value.get((a, b), s) == s for a, b, s in many) and len({x[:2] for x in many} & set(value)) >= 0.9 * len(some)


def test_lz_keeps_no_signatures_of_texts_without_a_likely_pair(spark, tmp_path, monkeypatch):
    """Of long texts without near copies, less is written for each than its signature of 2 * perms bytes."""
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1500))) for i in range(600)]
    rows += [(600 + i, t[:700] + "x" + t[700:]) for i, t in rows[:5]]
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    got = classes(lz_similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), NEAR, perms=384))
    assert got == {i: (i - 600, 1) if i >= 600 else (i, int(i < 5)) for i, _ in rows}
    assert sum(p.stat().st_size for p in tmp_path.rglob("prints-*/*.parquet")) < 768 * len(rows) / 2


@pytest.mark.parametrize("words", [1 << 20, 1])
def test_sifted_rows_lack_no_handle(spark, monkeypatch, words):
    monkeypatch.setattr(buckets, "BITMAP_WORDS", words)
    rows, handles = spark.range(-2_000, 2_000).select(F.col("id").alias("k"), F.lit("x").alias("v")), spark.range(-100, 100).select((F.col("id") * 20).alias("handle"))
    got = buckets.sifted(rows, "k", handles, 200)
    kept = {r["k"] for r in got.collect()}
    assert got.columns == ["k", "v"] and got.count() == len(kept) and kept >= set(range(-2_000, 2_000, 20))
    assert len(kept) < (700 if words > 1 else 4_001)
    assert buckets.sifted(rows, "k", handles.limit(0), 0).count() == 0


def test_parse_may_end_early():
    assert phrase_lengths("abababa", 2) == [1, 1] and phrase_lengths("abababa", 9) == [1, 1, 2, 3]
