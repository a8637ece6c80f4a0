"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All stages but the last return the columns of
``documents``.  The stages cannot be put as SQL: the language model and the shingle join are
trained or iterated, so tests/llm/test_pipeline.py holds them against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm.best_fit_packing import best_fit_packing
from vinculum.llm.common import materialize
from vinculum.llm.language_id import language_id
from vinculum.llm.line_dedup import line_dedup
from vinculum.llm.mixing import mix_sources
from vinculum.llm.ngram_join import ngram_join
from vinculum.llm.queries import tokenizer_path


#: Below this the model is about as sure of another language; clean documents score 0.5 and more.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on; those without a letter, ``und``, and those of a score below ``LEAST_SCORE`` go.

    Null and empty texts have no letter and go.  Where nothing can be learned from (no labelled
    row), every text with a letter goes on.  Rows are judged one by one: null and repeated ids
    and repeated rows stay as they are.  An empty table stays empty.
    """
    out = language_id(docs)
    if not out._learned:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the text; n_chars follows the text.

    No row goes: a text that loses all lines stays, empty.  Null text becomes ''.  Rows of equal
    ids count as one document, null ids as none (they lose every line that repeats).
    """
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least id (null ids last), of equal ids one.

    Rows are told apart by a key of their own, so null and repeated ids lose or keep nothing
    else.  Texts without a word are in no group and all stay.  An empty table stays empty.
    """
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = ngram_join(keyed.select("_row", "text"), id_col="_row").select("_row", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    keep = found.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first"))
    return keyed.join(keep.select(F.col("first._row").alias("_row")), "_row").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it, up to three times; one not taken goes.

    Texts without a word cost nothing and are taken by the same lot; a null source is a source;
    rows of equal or null ids are taken one by one.  An empty table stays empty.
    """
    out = mix_sources(docs).filter("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; the last stage, with columns of its own.

    Null and empty texts are the end id alone; each row, repeated or not, is packed by itself.
    """
    return best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_near),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL: the first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
