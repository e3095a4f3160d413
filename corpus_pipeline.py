"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next stage's docs.
All columns of documents pass through all stages but the last; other columns do too, whatever their names. A table without
rows gives one without rows. Stages work on rows: a doc_id may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import discard, read, scratch, staged
from foliospark.llm.decontaminate import contamination
from foliospark.llm.line_dedup import dedup_lines
from foliospark.llm.near_copies import near_copies, row_key
from foliospark.llm.packing import pack
from foliospark.llm.quality import fit_ranking, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are predicted to be of low quality; none where labels lack a class, as nothing was learned.

    Null and empty texts are scored like any other; repeated rows share a score and so their fate. Labels without a quality, or of a
    document that is not there, are not used; rows without doc_id have no labels but are judged.
    """
    model = fit_ranking(docs, read(spark, sf_dir, "labels"))
    return docs if model is None else score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that three documents or more hold, except in the last of them.

    A null text becomes ''; n_chars is that of what is left. Rows that share a doc_id count as one document; rows without one don't
    count and keep their lines.
    """
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard similarity 0.8 or more) one row stays, that of the smallest doc_id.

    Ids that several rows share are no key: rows are told apart by doc_id and text. Rows without a doc_id come last; of rows
    that share both, the first by their other columns stays. Null and empty texts, and those of white space, are copies of each other.
    """
    first = F.min_by("k", F.struct(F.col("doc_id").isNull(), "doc_id", "k"))
    stay = near_copies(docs).groupBy("component").agg(first.alias("__stay"))
    kept = docs.withColumn("__k", row_key()).join(stay, F.col("__k") == F.col("__stay"), "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return kept.withColumn("__nth", F.row_number().over(Window.partitionBy("__k").orderBy("text", *others))).where("__nth = 1").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item.

    Null and empty texts hold none, and neither do items without words count. Rows are judged each by their own text, whether or not
    they share or lack a doc_id. An empty benchmark keeps all.
    """
    return contamination(docs, read(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null or empty text is its end id alone, repeated rows are packed each, a null doc_id stays null."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near), ("decontamination", decontaminate), ("packing", packing)]

#: Quality scores and token ids have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as made:  # a stage's own tables go when its result is written, and with them its input
            out = staged(stage(spark, docs, sf_dir), name)
            made.remove(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
