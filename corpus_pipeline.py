"""From documents to token ids: five stages, each written as Parquet and read by the next one.

Documents that the quality network rejects go; of each group of near duplicates the document with
the smallest id stays; passages of 50 words that stand in an earlier document go, and documents
that lose nothing keep their text as it was; sources are mixed to target weights, so documents are
left out or repeated as whole rows; what is left is encoded.

Defined results: rows without doc_id are judged, kept as they are by both duplicate stages, mixed and
encoded. A document whose whole text is a repeated passage stays with an empty text until the mix,
which takes no empty documents. Columns beyond those of documents are passed through. Empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import jaccard_join, mixing, pieces, quality_cnn, substring
from lakewarden.llm.queries import PIECES, quality_learns, table, tokenizer_path
from lakewarden.llm.shipping import ship
from lakewarden.session import fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network accepts."""
    ship(spark)
    return quality_cnn.accepted(docs, table(spark, sf_dir, "labels"), quality_learns(),
                                fresh_path(spark, "pipeline-quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    found = jaccard_join.near_duplicates(docs, fresh_path(spark, "pipeline-near-duplicates"))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    ship(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    numbered = [f"other_{i}" for i in range(len(others))]
    given = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in
                                            zip(others, numbered, strict=True)])
    found = substring.without_repeats(given, keep=tuple(numbered), as_is=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    for name, number in zip(others, numbered, strict=True):
        columns[name] = F.col(number)
        if name == "n_chars":
            columns[name] = F.when(F.col("n_removed") == 0, F.col(number)).otherwise(
                F.length("kept_text")).cast(docs.schema[name].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with digests of the ids and of the decoded text."""
    ship(spark)
    return pieces.encoded(docs, tokenizer_path(PIECES), with_pieces=False)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]

# The network, the class search and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
