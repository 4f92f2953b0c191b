"""The corpus pipeline: each stage against a plain version of it on the same input."""

from collections import Counter

import pytest
import tiktoken

import corpus_pipeline as p
from tessergraph.llm.bpe import PATTERN, VOCABULARY, parse_ranks, read_vocabulary
from tessergraph.llm.pii import find_pii, mask
from tessergraph.llm.toxicity import fit_toxicity
from test_joins import brute_jaccard
from test_texts import plain_score, slow_pii


def by_id(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_in_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "pii", "packing"]


def test_each_stage_equals_its_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = p.toxicity(spark, docs, sf)
    assert kept.columns == docs.columns
    want = Counter(tuple(r) for r in docs.collect() if r["text"] is None or plain_score(model, r["text"]) <= model.threshold)
    assert by_id(kept) == want

    once = p.near_duplicates(spark, kept, sf)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_jaccard(rows):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {r["doc_id"] for r in once.collect()} == {i for i in root if find(i) == i}

    masked = p.personal_data(spark, once, sf)
    assert masked.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    for r in once.collect():
        spans = find_pii(r["text"])
        found = {x[:2] for x in spans}
        assert all(any(lo <= x[0] and x[1] <= hi for lo, hi in found) for x in slow_pii(r["text"]))
        assert got[r["doc_id"]] == ((mask(r["text"], spans), len(mask(r["text"], spans))) if spans else (r["text"], r["n_chars"]))

    words = Counter()
    for w in p.packing(spark, masked, sf).collect():
        assert sum(w["lengths"]) == w["n_tokens"] <= 2048
        for i, n in zip(w["doc_ids"], w["lengths"]):
            words[i] += n
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=parse_ranks(read_vocabulary(VOCABULARY)), special_tokens={})
    assert words == Counter({i: len(plain.encode_ordinary(t)) for i, (t, _) in got.items() if t})


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_stages_take_odd_and_empty_tables(spark, sf, odd, empty, name):
    stage = dict(p.STAGES)[name]
    assert stage(spark, empty, sf).count() == 0
    out = stage(spark, odd, sf)
    assert out.count() > 0 and (name == "packing" or out.columns == odd.columns)


def test_run_is_its_stages(spark, sf):
    a = p.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
    assert by_id(a.selectExpr("n_tokens", "cast(doc_ids as string)")) == by_id(docs.selectExpr("n_tokens", "cast(doc_ids as string)"))
