"""From raw documents to sampled token ids. Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.

A stage works on all rows it gets. All but the last return the columns of documents; n_chars follows where a stage changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import line_dedup, ngram_join, quality, source_mixing, subword_sampling
from docaudit.llm.common import SharedTable, held_out
from docaudit.llm.queries import MODEL, table

#: Score from which a document is kept.
GOOD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of the rows that the registered query learns from."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), held_out(F.col("k"), 5, 0))
    return docs.filter(quality.score_column(spark, model, F.col("text")) >= GOOD)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more have."""
    left = line_dedup.drop_lines(docs, line_dedup.line_bitmaps(docs))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal texts, the one with the smallest doc_id. Documents without words are linked with nothing and stay;
    so do documents without doc_id, and rows that repeat the one that stays. A document is a doc_id with a text: where rows of one doc_id
    have different texts, only those go whose own text has a near copy of a smaller doc_id."""
    others = ngram_join.near_duplicates(docs, digest="_digest").filter("component <> doc_id").select(F.col("doc_id").alias("_id"), "_digest").distinct()
    return docs.join(others.hint("shuffle_hash"), (docs["doc_id"] == others["_id"]) & (ngram_join.text_digest(docs["text"]) == others["_digest"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mixing.mix(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document; copies that the mix made have equal ones."""
    return subword_sampling.encode(docs, MODEL, samples=2)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sample_pieces),
]

#: None: the first stage is a trained model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; tables between stages lie in the shared folder, all but the last's input only until read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        written = SharedTable(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = written.read(), written
    return STAGES[-1][1](spark, docs, sf_dir)
