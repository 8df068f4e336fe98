"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import posteriors

    return posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import tokens

    return tokens(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "removed")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import removed_spans

    return removed_spans(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 50 == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import report

    return report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from . import embeddings, licenses, middle, negatives, secrets

    return {"op9_secrets": secrets.oracle(), "op10_licenses": licenses.oracle(), "op11_embeddings": embeddings.oracle(), "op12_hard_negatives": negatives.oracle(), "op13_fill_in_middle": middle.oracle()}
