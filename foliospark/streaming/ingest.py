"""The document operators over streams of files and texts, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.functions.text import match_count
from foliospark.operators.relational import newest_wins
from foliospark.sources import pdf

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of (doc_id, modified, content) of the files that come to a folder."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_a_batch).load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("modificationTime").alias("modified"), "content")


def search_stream(texts: DataFrame, query: str) -> DataFrame:
    """(doc_id, n_matches) of the texts of a stream that hold a query; stateless."""
    return texts.withColumn("n_matches", match_count(F.col("text"), query)).where("n_matches > 0").select("doc_id", "n_matches")


def first_versions(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream without files that come again within the delay; the watermark bounds the state."""
    return files.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["doc_id"])


def extract_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the text of each batch of files as Parquet, a folder a batch, so that a batch that runs again replaces its own rows. Of several versions of a file in a batch the newest is read."""

    def write(batch: DataFrame, number: int) -> None:
        newest = newest_wins(batch, ["doc_id"], "modified")
        pdf.extract_text(newest.select("doc_id", "content")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
