"""From raw documents to token ids: five stages, each of which works on all that the one before kept.

1. language ID: documents without a language (no letter at all) go; a missing lang becomes the predicted one.
2. line dedup: lines found in ten documents or more lose all their copies; texts shrink, rows stay.
3. near-dedup: of each class of near copies the document with the least id stays.
4. decontamination: documents that hold a benchmark item within its edit budget go.
5. encoding: the ids of the best segmentation, the scores of the best three, and whether decoding gives
   the text again.

Every stage but the last returns the columns of its input. A text shortened by line dedup gets its new
length in n_chars, where the input has that column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, language, line_dedup, near_dedup, nbest
from lattica.session import cut

#: Column names that no table of documents has.
MARK = "corpus_pipeline_mark"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    samples = language.fit(docs)
    marked = docs.withColumn(MARK, language.predict(F.col("text"), spark, samples)["lang"])
    named = marked.withColumn("lang", F.coalesce(F.nullif("lang", F.lit("")), MARK)) if "lang" in docs.columns else marked
    return named.filter(F.col(MARK) != language.UNDETERMINED).drop(MARK)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = line_dedup.line_dedup(docs, MARK)
    text = F.when(F.col("text").isNotNull(), F.col(f"{MARK}.kept"))
    changed = {"text": text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return marked.withColumns(changed).drop(MARK)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_matches(docs, benchmark, MARK).filter(F.size(MARK) == 0).drop(MARK)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbest.encode(docs)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_common_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: Language ID, weighted sampling, edit matching and segmentation have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
