"""A corpus pipeline: language ID, line dedup, near dedup, mixing and packing, one after the other.

Each stage gets the documents that the one before has written and gives the columns of documents, the last
one the pieces of packed sequences. Columns of any name stay; an empty table goes through all stages and gives
no piece.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import language_id, line_dedup, mixing, near_dedup, packing
from corvane.functions.storage import shared_folder
from corvane.llm.common import table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model has learned, mixed ones too.

    Null and empty texts, those without a letter, and all if no row has a text and a lang, have none and go.
    Repeated rows stay or go together; a null id counts as a text of its own when rows are held out.
    """
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    named = language_id.identify(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs["text"].alias("_text")), model, text_col="_text")
    return named.where(F.col("lang_pred") != language_id.UNKNOWN).select("_row.*")


def lines_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has. n_chars counts what is left.

    A null text comes out empty. Rows without an id keep all lines; rows of one id are one document.
    """
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("_row")))
    text = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*(text.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Rows of one id stay or go together, repeated rows too. Texts without words and rows without an id have no
    copies and stay.
    """
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    A null source is one source, the last. Repeated rows are documents of their own. Texts without words stay
    once where the mix comes by them.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. A null text is an empty one; every row is packed, repeated ones too."""
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", identified), ("line_dedup", lines_deduped), ("near_dedup", near_deduped), ("mixing", mixed), ("packing", packed)]

#: The first stage learns a model and the last one tokenizes, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
