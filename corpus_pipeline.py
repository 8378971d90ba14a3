"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet into the shared folder and rereads them for the
next one.

Defined results: null texts are empty texts to every stage and stay null; rows
without a doc_id stay through all stages, each as a document of its own; of
repeated rows of a doc_id one stays (stage ``near_dedup``); ties go to the
smaller doc_id; an empty table gives an empty result; columns beside doc_id,
text, lang, source and n_chars are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import decontaminate, neardup, packing, pii, quality
from docweft.llm.common import fresh_dir, table
from docweft.llm.queries import tokenizer_path


#: Rows of whole texts that are read, or handed to Python, at once.
BATCH_ROWS = 1000
#: Parts of words that a Python worker remembers in either generation: what stays of the last stage counts when the first one runs again.
PARTS = 100_000


def lean(spark: SparkSession) -> None:
    """Texts are read and handed to Python in batches of ``BATCH_ROWS`` or less: of long texts, Spark's own sizes hold a whole split at once.

    It holds for the session from then on, as plans are run later; no result depends on it.
    """
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    lean(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8 or more."""
    lean(spark)
    return neardup.keep_one(docs, width=5, percent=80)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    lean(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by typed placeholders."""
    lean(spark)
    return pii.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    lean(spark)
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, entries=PARTS)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("pii", redacted_documents),
    ("packing", packed_sequences),
]

#: Model fitting, MinHash and a tokenizer can't be said in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    where = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
