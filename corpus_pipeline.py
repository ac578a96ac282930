"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, leaked benchmarks go, the rest is encoded.

All stages but the last return the columns of their documents, in order and type, whatever further columns are called;
those come along unread. Rows are judged one by one where a stage looks at the text alone, and by ``doc_id`` elsewhere:
rows that repeat an id share its fate, rows without an id are kept. Texts are read whole, however long. A null
text is as an empty one and stays null. Of no documents nothing is left, in the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm import byte_bpe, decontaminate, ngram_join, substrings, toxicity
from recspark.session import materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; the model learns from the labelled ones among them.

    Equal texts have equal scores, so repeated rows go or stay together. Texts that are null or empty have the score of a
    text without toxic words. Without labels of both classes nothing can be learned: the score of every text is the share of
    toxic labels, so no labels at all keep every row, and toxic labels alone keep none.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(F.col("text"), model, spark) < 0.5)


#: Words of a shingle and least similarity in percent of near copies; those of op6_ngram_join alone are stricter.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    A group is all that links reach, so its members needn't all be near each other. Texts without words link with nothing and
    stay; a text of fewer than ``NEAR_SIZE`` words links with equal ones (A-Z lower-cased). Rows that repeat an id are one
    document: a link of any of them counts for all.
    """
    groups = ngram_join.near_duplicate_groups(docs, size=NEAR_SIZE, percent=NEAR_PERCENT)
    copies = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a text that loses nothing stays as it is.

    Earlier is the smaller id. Every row is kept, even one that loses all of its words; a text that loses some has its other words joined by
    one space, and ``n_chars`` follows it. Rows that repeat an id aren't earlier than each other, and rows without an
    id neither lose words nor take them from others.
    """
    cut = substrings.drop_repeated(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
    new = {"text": text.alias("text"), "n_chars": length.cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns])


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Items without id or words are in no document, so without a benchmark all rows are kept. A document that matches several
    items, or one of them several times, goes once; rows that repeat its id go with it.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = materialize(decontaminate.contaminated(docs, benchmark).select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text, encoded and decoded again.

    One row per row, repeated ones and those without an id too; a null text has no tokens, as an empty one.
    """
    return byte_bpe.round_trip(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_leaks),
    ("byte_bpe", encoded),
]

#: No SQL twin: the classifier and the encoder can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
