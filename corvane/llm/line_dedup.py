"""Line dedup: lines that several documents share stay only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, ascii_lower, join_summed, let, named_apart


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _shared(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes that at least min_docs documents hold, each with the smallest of their ids."""
    if min_docs <= 2:  # two different ids are there if the least and the greatest differ: one shuffle of partial results
        held = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        return held.where(F.col("_first") < F.col("_last")).drop("_last")
    per_doc = lines.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
    held = per_doc.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("_one").alias("_docs"))
    return held.where(F.col("_docs") >= min_docs).drop("_docs")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each text's shared lines dropped, and the columns n_lines and n_dropped (long).

    Lines are what lies between \\n; a null or empty text is one empty line. A line's key (line_key) of at
    least min_chars code points that occurs in at least min_docs documents loses all its lines but those of
    the smallest id holding it. Other lines stay in order, joined by \\n; a text of which nothing is left is
    empty. Keys are compared by 128 bits of hash.

    Nulls and ties: rows without an id share with nobody and keep all lines. Rows of one id are one document,
    so that a repeated row keeps what its twin keeps. Columns of docs that are named n_lines or n_dropped are
    replaced; all others stay.

    Only hashes are shuffled to find shared lines; a hash that very many documents hold is summed up before
    its shuffle, and Spark splits it in the join. Each text is shuffled once, to meet the positions it loses.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.split(text, "\n")
    version = F.xxhash64(text)  # tells rows of one id with different texts apart
    key = line_key(F.col("_line"))
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), version.alias("_version"), F.posexplode(split).alias("_at", "_line"))
        .select("_id", "_version", "_at", key.alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_version", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )
    lost = (
        join_summed(lines, _shared(lines, min_docs), ["_h1", "_h2"])
        .where(F.col("_id") != F.col("_first"))
        .groupBy("_id", "_version")
        .agg(F.sort_array(F.collect_set("_at")).alias("_lost"))
    )
    own = named_apart(docs.columns, "_id", "_version", "_lost")
    lost = lost.toDF(*own)
    joined = docs.withColumns({own[0]: F.col(id_col), own[1]: version}).join(lost, own[:2], "left")
    gone = F.coalesce(own[2], F.array().cast("array<int>"))

    def kept(all_lines: Column) -> Column:
        """Lines between two dropped positions, for each pair of them: linear in lines and positions."""
        starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
        ends = F.concat(gone, F.array(F.size(all_lines)))
        spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))
        return F.array_join(F.flatten(F.transform(spans, lambda z: F.slice(all_lines, z["s"] + 1, z["e"] - z["s"]))), "\n")

    return joined.withColumns(
        {
            text_col: F.when(F.size(gone) == 0, text).otherwise(let(split, kept)),
            "n_lines": (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dropped": F.size(gone).cast("long"),
        }
    ).drop(*own)
