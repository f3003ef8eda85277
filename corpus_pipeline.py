"""From raw documents to token ids: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.

* toxicity: documents that the classifier rejects at the threshold of their language go.
* near_duplicates: of each group of documents with similar sets of five-word shingles
  (Jaccard 0.8 or more, over any chain of links) the one with the smallest id stays.
* decontamination: documents with a ten-word window of a benchmark item go.
* secrets: secrets are replaced by ``[SECRET]``; every document stays.
* sentencepiece: texts become piece ids, which must decode to the text.

Nulls in any column, empty texts, repeated rows and empty tables pass through as the operators'
docstrings say: a null or empty text is neither toxic nor a copy nor contaminated for want of
words, and rows that repeat an id share the fate of their group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import decontaminate, dedup, pieces, secrets, toxicity
from paddock.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pieces.encode_and_check(docs)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("sentencepiece", tokenize)]

#: SQL can express neither the classifier nor merge-dropout; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
