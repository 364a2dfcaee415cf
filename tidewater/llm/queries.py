"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import ann, bpe, jaccard, minhash, mixing, secrets, sharding, suffix_dedup, toxicity, wavelet


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs, [3, 1, 2], 1.5).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Shingles by list functions, links by a join on shingles, components by a recursive query.
JACCARD_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
links as (
  select p.x, p.y from (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2) p
  join n nx on nx.doc_id = p.x join n ny on ny.doc_id = p.y where 100 * p.c >= 85 * (nx.n + ny.n - p.c)),
reach as (select x as doc_id, x as other from links union select r.doc_id, l.y from reach r join links l on l.x = r.other)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least(d.doc_id, r.low), d.doc_id)::bigint as component_id
from documents d left join n using (doc_id) left join (select doc_id, min(other) as low from reach group by 1) r using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_jaccard_join": JACCARD_SQL}
