"""The registered queries opN_<name>: every operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginloom.llm import ann, bpe, line_dedup, merkle, near_dedup, packing, pii, quality_rules, ranked_search, sharding, toxicity, url_filters, warc
from marginloom.llm.oracles import merkle_sql, ranked_search_sql
from marginloom.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_table(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged_urls(read_table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(read_table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_table(read_table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(read_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_groups(read_table(spark, sf_dir, "documents"), width=4)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_table(read_table(spark, sf_dir, "documents"))


ALL = [
    op1_line_dedup,
    op2_quality_rules,
    op3_best_fit_packing,
    op4_url_filters,
    op5_bpe,
    op6_warc,
    op7_pii,
    op8_ann,
    op9_sharding,
    op10_minhash_near_dedup,
    op11_toxicity,
    op12_ranked_search,
    op13_merkle_manifest,
]
QUERIES: dict[str, Query] = {q.__name__: q for q in ALL}

ORACLE_SQL: dict[str, str] = {
    "op12_ranked_search": ranked_search_sql(),
    "op13_merkle_manifest": merkle_sql(),
    "op1_line_dedup": """
        with texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from texts),
        keys as (
            select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines),
        common as (
            select key, max(doc_id) as holder from keys where length(key) >= 20
            group by key having count(distinct doc_id) >= 3),
        judged as (
            select doc_id, place, line, holder is not null and holder <> doc_id as lost
            from keys left join common using (key))
        select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not lost), '')) as kept_sha256
        from judged group by doc_id
    """,
}
