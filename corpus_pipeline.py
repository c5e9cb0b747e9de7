"""The training-data pipeline over the driver's documents, counted as part of the subpackage llm.

Toxic documents go, lines that repeat across documents go, of near duplicates one stays, documents
that hold benchmark passages go, and what is left is mixed by source.  Each stage takes all rows
that the stage before it kept, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprloom.llm import decontam, lines, mixing, simhash, toxicity
from exprloom.llm.common import materialise, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    The model learns from the labelled rows of ``docs`` that are not held out.  Null and empty texts stay; repeated rows go or
    stay together; of rows with the same id, or none, each is judged by its own text.  Other columns pass through, whatever
    their names.  An empty table, or one without labels of both kinds, stays as it is."""
    score = unused(docs, "score")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, model, to=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller id holds; ``n_chars`` follows the text.

    Null and empty texts stay as they are; rows of one id count as one document, rows without id as the last one."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, a similarity of 0.8 or more, found by SimHash fingerprints of parts of the
    shingle set, pigeonhole blocks that miss no such pair, Hamming checks and components.

    The row with the smallest id stays, null ids last, ties by a hash of the text; of rows that repeat one stays.  Null, empty
    and blank texts are one group.  Rows with the same id, or none, and unlike texts all stay.  Other columns pass through."""
    return simhash.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts stay; each row is judged by its own text.  Other columns pass through; an empty benchmark drops
    nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of what is left: how many words of each document are taken, and where.

    Null text has no words and is never taken; null is a source of its own; repeated rows are documents of their own."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity model and components of near duplicates are beyond SQL; tests/llm/test_pipeline.py holds a brute-force version
#: of every stage and of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
