"""Ranked lexical search by a bit-sliced impact index.

What a term adds to a document's score (its impact) is an integer. For a block of documents, bit i of all impacts of a term is a
bitmap; an item's scores are its terms' bitmaps added up slice by slice with carries, for 64 documents a machine word. The
best k of a block are found from the most significant slice down, without reading single scores. Only they leave the task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import LOWER, UPPER, read, staged

#: Bytes as terms hold them: A-Z become a-z, ASCII other than letters and digits separates.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 22  # bytes of a text that are cut into terms at once
QUERY_BYTES = 1 << 22  # items of so many bytes are searched in one pass over the documents, and sent to its tasks
BLOCK = 1 << 14  # documents that are ranked at once
ITEMS = 256  # items whose sums a task holds at once


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number at a time."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        part = raw[at:end].translate(FOLDED)
        while end < len(raw) and (more := raw[end : end + 4096].translate(FOLDED)):
            cut = more.find(b" ")
            part += more if cut < 0 else more[:cut]
            end += len(more) if cut < 0 else cut
            if cut >= 0:
                break
        yield part.split()
        at = end


def term_counts(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, t, tf): a row per row of docs with its number of terms, and number and occurrences of the known ones."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("t", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, times = [], [], []
            for raw in batch.column(1):
                held: Counter = Counter()
                for part in pieces(raw.as_py() or b""):
                    held.update(part)
                found = [(known[w], c) for w, c in held.items() if w in known]
                n.append(held.total())
                terms.append([t for t, _ in found])
                times.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, kinds.field(2).type), pa.array(times, kinds.field(3).type)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n long, t array<int>, tf array<long>")


class Slices:
    """The bit-sliced impacts of a block of documents whose places are in order of preference among equal scores."""

    def __init__(self, place: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((place, term))
        self.place, self.impact, self.words = place[order], impact[order], -(-n_docs // 64)
        self.terms, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))

    def bitmaps(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, slices) of the i-th term that the block holds: words with any bit, and their bits by slice."""
        place, impact = self.place[self.starts[i] : self.ends[i]], self.impact[self.starts[i] : self.ends[i]]
        words, first = np.unique(place >> 6, return_index=True)
        bits = np.arange(int(impact.max()).bit_length())[:, None]
        set_ = ((impact >> bits) & 1).astype(np.uint64) << (place & 63).astype(np.uint64)
        return words, np.bitwise_or.reduceat(set_, first, axis=1)

    def sums(self, items: list[np.ndarray]) -> np.ndarray:
        """Scores of each item (its term numbers) by slice: item x slice x word."""
        where = {int(t): i for i, t in enumerate(self.terms)}
        most = np.maximum.reduceat(self.impact, self.starts) if len(self.terms) else np.zeros(0, np.int64)
        held: dict[int, list[int]] = {}
        top = 0
        for n, item in enumerate(items):
            found = [where[t] for t in item if t in where]
            top = max(top, int(sum(int(most[i]) for i in found)))
            for i in found:
                held.setdefault(i, []).append(n)
        total = np.zeros((len(items), max(top.bit_length(), 1), self.words), np.uint64)
        for i, of in held.items():
            words, slices = self.bitmaps(i)
            for n in of:
                add(total[n], words, slices)
        return total


def add(total: np.ndarray, words: np.ndarray, slices: np.ndarray) -> None:
    """Adds slices, which hold the given words, to total by bitwise carry."""
    part = total[:, words]
    carry = np.zeros(len(words), np.uint64)
    for i in range(len(part)):
        a = part[i]
        if i < len(slices):
            differ = a ^ slices[i]
            part[i], carry = differ ^ carry, (a & slices[i]) | (differ & carry)
        elif carry.any():
            part[i], carry = a ^ carry, a & carry
        else:
            break
    total[:, words] = part


def best(total: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0 (all, if fewer), from the most significant slice down; of equal ones the first places."""
    sure, open_ = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    if np.bitwise_count(open_).sum() > k:
        for bits in total[::-1]:
            larger = open_ & bits
            n = np.bitwise_count(sure | larger).sum()
            if n > k:
                open_ = larger
            else:
                sure, open_ = sure | larger, open_ & ~bits
                if n == k:
                    break
    listed = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    taken = listed(sure)
    return np.concatenate([taken, listed(open_)[: k - len(taken)]])


def score_of(total: np.ndarray, places: np.ndarray) -> np.ndarray:
    bits = (total[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


def ranked(found: DataFrame, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each block of term_counts rows."""

    def rank(ids: np.ndarray, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = 10 + (90 * n * n_docs) // n_terms
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        some = impact > 0
        block = Slices(place[owner][some], term[some], impact[some], len(ids))
        for at in range(0, len(items), ITEMS):
            for i, total in enumerate(block.sums(items[at : at + ITEMS]), at):
                places = best(total, k)
                if len(places):
                    docs = pa.array([None if x == NO_ID else int(x) for x in ids[order[places]]], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), i, np.int32)), docs, pa.array(score_of(total, places))], names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if size + part.num_rows > BLOCK:
                    yield from rank(*gathered(held))
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield from rank(*gathered(held))

    return found.mapInArrow(run, "item int, doc_id long, score long")


NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id, which comes last


def gathered(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Ids and lengths of documents, and of each posting its document, term and occurrences."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, n, t, tf = (table.column(i).combine_chunks() for i in range(4))
    plain = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    sizes = t.value_lengths().to_numpy(zero_copy_only=False)
    return ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), sizes), plain(t).astype(np.int64), plain(tf)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best rows of docs by summed impacts, equal scores by doc_id; rows that score 0 are left out.

    Null and empty texts hold no term: they count for nothing and find nothing. Repeated rows of docs are ranked each; rows without
    doc_id come last among equals. Rows of items that share an item_id (null is one) are one item. Other columns are not read.
    Items go to the tasks in passes of QUERY_BYTES, so their number is not limited; a single item has to fit.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("binary").alias("text"))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // QUERY_BYTES))
    parts = []
    for i in range(passes):
        own: dict = {}
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).collect():  # about QUERY_BYTES
            own.setdefault(row.item_id, set()).update(w for part in pieces(bytes(row.text or b"")) for w in part)
        known = {w: n for n, w in enumerate(sorted(set().union(*own.values())))}
        if not known:
            continue
        found = staged(term_counts(docs, known), "term-counts")
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            continue
        weight = np.zeros(len(known), np.int64)
        for row in found.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # at most a row a known term
            weight[row.t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
        terms = [np.array([known[w] for w in sorted(words)], np.int64) for words in own.values()]
        names = spark.createDataFrame(list(enumerate(own)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best_ = staged(ranked(found, terms, weight, n_docs, n_terms, k), "ranked", [found])
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = best_.withColumn("rank", nth).where(F.col("rank") <= k)
        parts.append(top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not parts:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return reduce(DataFrame.unionAll, parts)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, n_docs),
r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(nth AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS nth FROM r WHERE score > 0) WHERE nth <= 10
"""
