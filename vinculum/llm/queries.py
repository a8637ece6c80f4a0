"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.best_fit_packing import best_fit_packing
from vinculum.llm.language_id import language_id
from vinculum.llm.line_dedup import line_dedup
from vinculum.llm.lm_scoring import lm_scoring
from vinculum.llm.mixing import mix_sources, word_count
from vinculum.llm.nearest_neighbours import nearest_neighbours
from vinculum.llm.ngram_join import ngram_join
from vinculum.llm.quality_rules import quality_rules
from vinculum.llm.secret_scans import _count, secret_scans
from vinculum.llm.sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_broken", F.round("host_rate", 9).alias("host_rate"), "host_verdict",
    )


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scans(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans",
        *[_count("found", "status", k).alias(f"n_{k}") for k in ("example", "live")],
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix_sources(sized, size_col="size")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    from vinculum.llm.license_scans import op7_license_scans

    own = [
        op1_line_dedup, op2_best_fit_packing, op3_quality_rules, op4_secret_scans, op5_nearest_neighbours, op6_ngram_join,
        op7_license_scans, op8_language_id, op9_lm_scoring, op10_mix_sources,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
