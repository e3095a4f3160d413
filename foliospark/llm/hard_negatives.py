"""Hard-negative mining with a vector-approximation file.

Each dimension is cut into cells, and a row is kept as its cell numbers. For a query, a table holds the least and the most that
a cell of a dimension can add to the inner product, so bounds of a score are sums of looked-up values. Rows whose bounds
cannot enter what is looked for (the best of a label, or the best within a window of scores) are never scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import read, staged
from foliospark.llm.vectors import dimensions, is_finite, matrix, packed, unpacked

CELLS = 64
SAMPLE = 20_000  # rows that the inner cell borders are fitted on
ANCHORS = 4096  # anchors of one pass over the table, about; they go to its tasks
GROUP = 128  # anchors whose tables are looked up at once
ROWS = 2048  # rows that are looked up at once
LARGEST = 2.0**20  # components as large would take scores beyond 64 bits


def borders(rows: DataFrame, width: int) -> np.ndarray:
    """width x (CELLS + 1) whole numbers: cell c of a dimension holds values from border c to border c + 1 less one. The outer ones are the extremes of all rows, the inner ones quantiles of a sample."""
    held = rows.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.min("x"), F.max("x")).collect()  # a row a dimension
    low, high = np.zeros(width), np.zeros(width)
    for d, least, most in held:
        low[d], high[d] = least, most
    sample = rows.orderBy(F.xxhash64("k")).limit(SAMPLE).select("q").toPandas()["q"]
    some = np.array([np.pad(np.asarray(q, np.float64), (0, width - len(q))) for q in sample]).reshape(-1, width)
    inner = np.quantile(some, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0, method="nearest").T if len(some) else np.zeros((width, CELLS - 1))
    short = (some == 0).any()  # vectors that are filled up hold zeros
    out = np.concatenate([np.minimum(low, 0 if short else low)[:, None], inner, np.maximum(high, 0 if short else high)[:, None] + 1], axis=1)
    return np.maximum.accumulate(np.clip(out, out[:, :1], out[:, -1:]), axis=1).astype(np.int64)


def approximated(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """rows (k, vec_id, label, q) with q as bytes and cells, the number of each component's cell."""
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(3), width).astype(np.int64)
            cells = np.empty(q.shape, np.uint8)
            for d in range(width):
                cells[:, d] = np.clip(np.searchsorted(edges[d], q[:, d], side="right") - 1, 0, CELLS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed(q.astype(np.int32)), packed(cells)], names=["k", "vec_id", "label", "q", "cells"])

    return rows.select("k", "vec_id", "label", "q").mapInArrow(run, "k long, vec_id long, label long, q binary, cells binary")


def tables(anchors: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that a cell adds to each anchor's score: dimension x cell x anchor."""
    a, b = anchors.T[:, None, :] * edges[:, :-1, None], anchors.T[:, None, :] * (edges[:, 1:, None] - 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    kind = np.int32 if max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * len(edges) < 2**31 else np.int64
    return low.astype(kind), high.astype(kind)


def bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of scores, row x anchor, by table lookup."""
    least, most = (np.zeros((len(cells), t.shape[2]), t.dtype) for t in (low, high))
    for d in range(cells.shape[1]):
        least += low[d].take(cells[:, d], axis=0)
        most += high[d].take(cells[:, d], axis=0)
    return least, most


def kth(values: np.ndarray, n: int, least: float) -> np.ndarray:
    """The n-th largest value of each column, least where there are fewer."""
    return np.partition(values, len(values) - n, axis=0)[len(values) - n] if len(values) >= n else np.full(values.shape[1], least)


class Best:
    """The n best (score, vec_id, k) of a query so far: highest scores, then smallest ids."""

    __slots__ = ("n", "rows")

    def __init__(self, n: int):
        self.n, self.rows = n, np.zeros((0, 3), np.int64)

    def floor(self) -> float:
        return self.rows[-1, 0] if len(self.rows) == self.n else -np.inf

    def offer(self, score: np.ndarray, vec_id: np.ndarray, k: np.ndarray) -> None:
        both = np.concatenate([self.rows, np.stack([score, vec_id, k], axis=1)])
        self.rows = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[: self.n]]


def scan(table: DataFrame, edges: np.ndarray, held: tuple[np.ndarray, ...], same: bool, n: int, windows: np.ndarray) -> DataFrame:
    """(anchor, slot, k, vec_id, score): of each task's rows, the n best within each window (anchor x slot x (from, to)) of an anchor.

    held: k, label and vector of the anchors. same: rows of the anchor's own label (but itself), else those of other labels.
    """
    own, labels, vectors = held
    width = len(edges)

    def search(at: np.ndarray, rows: tuple, found: list[list[Best]]) -> None:
        k, ids, label, q, cells = rows
        low, high = tables(vectors[at], edges)
        for s in range(0, len(k), ROWS):
            part = slice(s, s + ROWS)
            least, most = bounds(cells[part], low, high)
            open_ = label[part, None] == labels[at][None]
            open_ = open_ & (k[part, None] != own[at][None]) if same else ~open_
            wanted = np.zeros(open_.shape, bool)
            for slot in range(windows.shape[1]):
                begin, end = windows[at, slot, 0], windows[at, slot, 1]
                if not (begin <= end).any():
                    continue
                begin = np.maximum(begin, [found[a][slot].floor() for a in at])
                inside = np.where(open_ & (least >= begin) & (most <= end), least, -np.inf)
                begin = np.maximum(begin, kth(inside, n, -np.inf))
                wanted |= open_ & (most >= begin) & (least <= end)
            r, a = np.nonzero(wanted)
            if not len(r):
                continue
            score = np.einsum("ij,ij->i", q[part][r], vectors[at][a])
            order = np.argsort(a, kind="stable")
            r, a, score = r[order], a[order], score[order]
            for i, one in enumerate(np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1)):
                anchor = at[a[one[0]]]
                for slot in range(windows.shape[1]):
                    begin, end = windows[anchor, slot]
                    fits = one[(score[one] >= max(begin, found[anchor][slot].floor())) & (score[one] <= end)]
                    if len(fits):
                        found[anchor][slot].offer(score[fits], ids[part][r[fits]], k[part][r[fits]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[Best(n) for _ in range(windows.shape[1])] for _ in own]
        for batch in batches:
            k, ids, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            q, cells = unpacked(batch.column(3), "<i4", width).astype(np.int64), unpacked(batch.column(4), "u1", width)
            if same:  # the rows of a label meet its anchors only
                for one in np.unique(label):
                    rows, at = label == one, np.flatnonzero(labels == one)
                    for g in range(0, len(at), GROUP):
                        search(at[g : g + GROUP], (k[rows], ids[rows], label[rows], q[rows], cells[rows]), found)
            else:
                for g in range(0, len(own), GROUP):
                    search(np.arange(g, min(g + GROUP, len(own))), (k, ids, label, q, cells), found)
        out = [(own[a], slot, row[2], row[1], row[0]) for a, slots in enumerate(found) for slot, b in enumerate(slots) for row in b.rows]
        if out:
            columns = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])], names=["anchor", "slot", "k", "vec_id", "score"])

    return table.mapInArrow(run, "anchor long, slot int, k long, vec_id long, score long")


def first(found: DataFrame, n: int) -> DataFrame:
    """The n best of each anchor's slot over all tasks, with their rank."""
    nth = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "k"))
    return found.withColumn("rank", nth).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, embedding).

    Anchors are rows whose vec_id is divisible by `every`; scores are inner products of the components floored at 256 steps a unit.
    An anchor's positives are its best other rows of its label; a positive's negatives are the best rows of other labels from
    low to high hundredths of its score. Rows without id or label, and vectors that are null or hold null, non-finite or (beyond
    64-bit scores) components of 2^20 and more take no part. Shorter vectors count as filled up with zeros. Rows are told apart
    even where ids repeat; a repeated anchor is an anchor each time. Other columns are not read, an empty table gives no rows.
    """
    ok = is_finite(F.col("embedding")) & F.forall(F.coalesce("embedding", F.array().cast("array<double>")), lambda x: F.abs(x) < LARGEST) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    q = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("long"))
    plain = staged(rows.where(ok).select(F.monotonically_increasing_id().alias("k"), F.col("vec_id").cast("long"), F.col("label").cast("long"), q.alias("q")), "floored")
    n, width = plain.count(), dimensions(plain, "q")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not width:  # all scores are 0 then, and no vectors have components
        return rows.sparkSession.createDataFrame([], empty) if not n else zero_width(plain, positives, negatives, every)
    edges = borders(plain, width)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 32768))
    table = staged(approximated(plain.repartition(tasks), edges), "approximations", [plain])
    anchors = table.where(F.pmod("vec_id", F.lit(every)) == 0)
    passes = max(1, -(-anchors.count() // ANCHORS))
    parts = []
    for i in range(passes):
        some = anchors.where(F.pmod(F.xxhash64("k"), F.lit(passes)) == i).select("k", "vec_id", "label", "q").orderBy("k").toPandas()  # about ANCHORS
        if not len(some):
            continue
        own, ids, labels = (some[c].to_numpy(np.int64) for c in ("k", "vec_id", "label"))
        held = own, labels, np.array([np.frombuffer(x, "<i4") for x in some["q"]], np.int64)
        whole = np.tile(np.array([-np.inf, np.inf]), (len(own), 1, 1))
        near = first(scan(table, edges, held, True, positives, whole), positives).select("anchor", "rank", "vec_id", "score").toPandas()  # ANCHORS x positives
        at = np.searchsorted(own, near["anchor"].to_numpy())
        slot, score = near["rank"].to_numpy() - 1, near["score"].to_numpy()
        windows = np.tile(np.array([np.inf, -np.inf]), (len(own), positives, 1))
        windows[at, slot, 0], windows[at, slot, 1] = -((-low * score) // 100), (high * score) // 100
        pairs = rows.sparkSession.createDataFrame([(int(a), int(s), int(ids[j]), int(v), int(x)) for a, s, j, v, x in zip(near["anchor"], slot, at, near["vec_id"], score)], "anchor long, slot int, anchor_id long, positive_id long, positive_score long")
        out = first(staged(scan(table, edges, held, False, negatives, windows), "negatives"), negatives)
        parts.append(out.join(F.broadcast(pairs), ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return reduce(DataFrame.unionAll, parts) if parts else rows.sparkSession.createDataFrame([], empty)


def zero_width(plain: DataFrame, positives: int, negatives: int, every: int) -> DataFrame:
    """All vectors are without components, so every score is 0 and every window is from 0 to 0: one column of zeros says the same."""
    same = plain.select("vec_id", "label", F.array(F.lit(0.0)).alias("embedding"))
    return hard_negatives(same, positives, negatives, every=every)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS nth FROM s WHERE same),
n AS (SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.nth <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
