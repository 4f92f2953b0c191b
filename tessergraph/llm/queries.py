"""Registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessergraph.llm import embed_dedup, url_filter
from tessergraph.llm.bpe import bpe_round_trip
from tessergraph.llm.common import documents
from tessergraph.llm.lz_fingerprint import NEAR, lz_similar_documents
from tessergraph.llm.ngram_join import ngram_jaccard_join
from tessergraph.llm.packing import pack_documents
from tessergraph.llm.pii import scan_pii
from tessergraph.llm.secret_scan import scan_secrets
from tessergraph.llm.token_counts import token_counts
from tessergraph.llm.toxicity import toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))


_OP1_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\f\r\v]+'), lambda x: x <> '') as w
  from documents where doc_id is not null
), r as materialized (
  select doc_id, row_number() over () as r, array_to_string(w, ' ') as s, w from (select distinct doc_id, w from w where len(w) > 0)
), g as materialized (
  select distinct r, unnest(case
    when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) else [s] end) as g
  from r
), s as (select r, count(*) as n from g group by r),
o as (select a.r as a, b.r as b, count(*) as c from g a join g b on a.g = b.g and a.r <> b.r group by 1, 2),
p as materialized (
  select ra.doc_id as a, rb.doc_id as b from o join s x on x.r = o.a join s y on y.r = o.b join r ra on ra.r = o.a join r rb on rb.r = o.b
  where c / (x.n + y.n - c)::double >= 0.5
), walk(id, other) as (
  select distinct doc_id, doc_id from w union select walk.id, p.b from walk join p on p.a = walk.other
), c as (select id, min(other) as class_id from walk group by id),
l as (select a, count(*) as links from p group by a)
select id as doc_id, class_id, coalesce(links, 0) as links from c left join l on a = id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": _op1,
        "op2_url_filter": url_filter.url_filter_query,
        "op3_bpe": lambda spark, sf_dir: bpe_round_trip(documents(spark, sf_dir)),
        "op4_pii": lambda spark, sf_dir: scan_pii(documents(spark, sf_dir)),
        "op5_toxicity": lambda spark, sf_dir: toxicity(documents(spark, sf_dir), _labels(spark, sf_dir)),
        "op6_embedding_near_dedup": lambda spark, sf_dir: embed_dedup.embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op7_lz_fingerprint": lambda spark, sf_dir: lz_similar_documents(documents(spark, sf_dir), NEAR, perms=384),
        "op8_packing": lambda spark, sf_dir: pack_documents(documents(spark, sf_dir)),
        "op9_secret_scan": lambda spark, sf_dir: scan_secrets(documents(spark, sf_dir)),
        "op10_token_counts": lambda spark, sf_dir: token_counts(documents(spark, sf_dir)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _OP1_SQL, "op2_url_filter": url_filter.ORACLE, "op6_embedding_near_dedup": embed_dedup.ORACLE}
