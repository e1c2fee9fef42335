"""The queries of this subpackage: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import exact_dedup, filter_audit, jaccard_join, mixing, quality_rules, suffix_dedup, warc
from pluvia.llm.alignment import alignment_report
from pluvia.llm.common import stored, table
from pluvia.llm.exact_dedup import copies_report
from pluvia.llm.filter_audit import interaction_audit
from pluvia.llm.image_copies import find_copies, rendered
from pluvia.llm.jaccard_join import jaccard_components
from pluvia.llm.language_id import languages
from pluvia.llm.line_crf import quality_scores
from pluvia.llm.mixing import mixture_report
from pluvia.llm.packing import packed_documents
from pluvia.llm.quality_rules import rules_report
from pluvia.llm.suffix_dedup import substring_report
from pluvia.llm.toxicity import toxicity_scores
from pluvia.llm.warc import capture_report


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_report(table(spark, sf_dir, "documents"))


def op2_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"), length=400)


def op3_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = stored(rendered(table(spark, sf_dir, "embeddings")), "images")
    return find_copies(images, images.where("image_id % 100 = 0")).withColumn("turn", F.round("turn", 6)).withColumn("scale", F.round("scale", 6))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(table(spark, sf_dir, "documents"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_report(table(spark, sf_dir, "pages"))


def op7_bloom_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op8_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op10_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_heavy_hitter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_report(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_divergence_rules, op2_suffix_family, op3_local_descriptors, op4_poisson_mix, op5_line_crf, op6_warc_transactions, op7_bloom_languages, op8_token_group_join, op9_linear_grouping, op10_noisy_or, op11_heavy_hitter_split, op12_filter_audit, op13_segment_alignment)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_divergence_rules": quality_rules.ORACLE, "op2_suffix_family": suffix_dedup.ORACLE, "op4_poisson_mix": mixing.ORACLE,
        "op6_warc_transactions": warc.ORACLE, "op8_token_group_join": jaccard_join.ORACLE,
        "op11_heavy_hitter_split": exact_dedup.ORACLE, "op12_filter_audit": filter_audit.ORACLE,
    }
