"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import read

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1-, 2- and 3-grams of a text's words, each word between spaces. A code packs 21 bits a character."""
    found = LETTERS.findall((text or "").lower())
    if not any(w.isalpha() or any(c.isalpha() for c in w) for w in found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    first = at << 42
    second = first[:-1] | (at[1:] << 21)
    third = second[:-1] | at[2:]
    return np.unique(np.concatenate([first[at != 32], second, third]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent codes, most frequent first; ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Each language's codes in sorted order with their ranks."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.names, self.tables = size, sorted(profiles), []
        for name in self.names:
            codes = np.array(profiles[name], np.int64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def nearest(self, text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        places, distances = np.arange(len(own)), []
        for codes, ranks in self.tables:
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            distances.append(int(np.where(codes[at] == own, np.abs(ranks[at] - places), self.size).sum()))
        best = int(np.argmin(distances))
        return self.names[best], 1.0 - distances[best] / (self.size * len(own))


def train_profiles(labelled: DataFrame, size: int = 400, max_docs: int = 4000) -> dict[str, list[int]]:
    """The `size` most frequent n-grams of each language of labelled (doc_id, text, lang).

    A language with over max_docs documents is learned from about that many, chosen by a hash of doc_id: the only bound in this
    module. What comes to the driver is a count and `size` codes a language.
    """
    totals = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not totals:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, max_docs / n))))
    picked = labelled.where(F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(grams(text.as_py()))
            for lang, found in by_lang.items():
                codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n)], names=["lang", "code", "n"])

    counts = picked.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("place", place).where(F.col("place") <= size)
    profiles: dict[str, list[int]] = {lang: [] for lang in totals}
    for r in sorted(top.collect(), key=lambda r: r.place):
        profiles[r.lang].append(r.code)
    return {lang: codes for lang, codes in profiles.items() if codes}


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], size: int = 400) -> DataFrame:
    """(doc_id, lang_pred, score), a row per row of docs, from whole texts. score is 1 less the distance in parts of the largest.

    Texts that are null or hold no letter are "und" with score 0, and so is everything if nothing was learned. Ties go to the
    language that sorts first. Equal texts get equal results. Other columns are not read.
    """
    found = Profiles(profiles, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [found.nearest(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    profiles = train_profiles(docs.where(~held_out & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return predict_language(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
