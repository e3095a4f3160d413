"""NN-descent: a neighbour graph refined by joins of neighbours' neighbours.

The graph starts from rows that lie next to each other in sorted orders of random-hyperplane signs. In each round a node's
neighbours, those that list it among them, are compared with each other; what improves a list enters it. Only pairs with an
edge that is new since the last round are compared. Vectors travel as 8-bit codes: similarities of edges are near ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import discard, staged
from foliospark.llm.vectors import unpacked

RUN = 64  # rows of a sorted order that are compared with each other at first
SLACK = 0.02  # what 8-bit codes may be off
MET = 24  # edges from a node, and to it, that take part in a round
KEPT = 1 << 18  # pairs that a task holds before it keeps the best of them
EDGES = "u long, v long, sim float"


def similarities(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.float32)
    c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-9)
    return c @ c.T


def strongest(u: np.ndarray, v: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs, at most so many a node, the most similar ones."""
    order = np.lexsort((v, u))
    u, v, sim = u[order], v[order], sim[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, sim = u[new], v[new], sim[new]
    order = np.lexsort((-sim, u))
    u, v, sim = u[order], v[order], sim[order]
    nth = np.arange(len(u)) - np.searchsorted(u, u)
    return u[nth < most], v[nth < most], sim[nth < most]


class Pairs:
    """Pairs that a task has found, both ways; the weaker ones of a node go when there are many."""

    def __init__(self, most: int):
        self.most, self.held, self.size = most, [], 0

    def put(self, u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> None:
        other = u != v  # a run may span two orders and hold a node twice
        self.held.append((u[other], v[other], sim[other]))
        self.size += len(u)

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            u, v, sim = strongest(*(np.concatenate(x) for x in zip(*self.held)), self.most)
            self.held, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sim.astype(np.float32))], names=["u", "v", "sim"])


def first_graph(nodes: DataFrame, width: int, orders: int, tasks: int, most: int, seed: int) -> DataFrame:
    """(u, v, sim): pairs of nodes (k, code) that lie within a run of RUN rows in one of the orders. Runs may be dealt to any task, equal signs are told apart by k: no group is large."""
    planes = np.random.default_rng(seed).standard_normal((width, 63 * orders)).astype(np.float32)
    powers = np.left_shift(np.int64(1), np.arange(62, -1, -1, dtype=np.int64))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = (unpacked(batch.column(1), "i1", width).astype(np.float32) @ planes) > 0
            for o in range(orders):
                key = (above[:, 63 * o : 63 * (o + 1)] * powers).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), o, np.int32)), pa.array(key), *batch.columns[:2]], names=["nth", "signs", "k", "code"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rest = Pairs(most), None
        for batch in batches:
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            whole = batch.num_rows - batch.num_rows % RUN
            for at in range(0, whole, RUN):
                compare(batch.slice(at, RUN), out)
                if out.size > KEPT:
                    yield from out.batch()
            rest = batch.slice(whole)
        if rest is not None and rest.num_rows:
            compare(rest, out)
        yield from out.batch()

    def compare(run: pa.RecordBatch, out: Pairs) -> None:
        k = run.column(0).to_numpy(zero_copy_only=False)
        sim = similarities(unpacked(run.column(1), "i1", width))
        np.fill_diagonal(sim, -2)
        n = min(most, len(k) - 1)
        if n > 0:
            top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            u = np.repeat(np.arange(len(k)), n)
            out.put(k[u], k[top.ravel()], sim[u, top.ravel()])

    spread = nodes.select("k", "code").mapInArrow(signs, "nth int, signs long, k long, code binary")
    return spread.repartitionByRange(tasks, "nth", "signs", "k").sortWithinPartitions("nth", "signs", "k").select("k", "code").mapInArrow(pairs, EDGES)


def joined(around: DataFrame, width: int, most: int) -> DataFrame:
    """(u, v, sim): of each node's neighbours (at, k, fresh, code, worst), in order of at, the pairs that improve a list; one of the two has to be fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rest = Pairs(most), None
        for batch in batches:
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            at = batch.column(0).to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(at))
            for begin, end in zip(np.append(0, ends[:-2]), ends[:-1]):
                compare(batch.slice(begin, end - begin), out)
                if out.size > KEPT:
                    yield from out.batch()
            rest = batch.slice(ends[-2]) if len(ends) > 1 else batch
        if rest is not None and rest.num_rows:
            compare(rest, out)
        yield from out.batch()

    def compare(group: pa.RecordBatch, out: Pairs) -> None:
        fresh = group.column(2).to_numpy(zero_copy_only=False).astype(bool)
        if len(fresh) < 2 or not fresh.any():
            return
        k, worst = group.column(1).to_numpy(zero_copy_only=False), group.column(4).to_numpy(zero_copy_only=False)
        sim = similarities(unpacked(group.column(3), "i1", width))
        better = (sim > worst[:, None]) & (fresh[:, None] | fresh[None])
        np.fill_diagonal(better, False)
        u, v = np.nonzero(better)
        if len(u):
            out.put(k[u], k[v], sim[u, v])

    return around.select("at", "k", "fresh", "code", "worst").mapInArrow(run, EDGES)


def kept(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, sim, fresh, added): the most similar edges of each node, as many as its list holds."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"), F.bool_and("added").alias("added"))
    nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return one.join(nodes.select(F.col("k").alias("u"), "room"), "u").withColumn("nth", nth).where("nth <= room").select("u", "v", "sim", "fresh", "added")


def nn_descent(nodes: DataFrame, width: int, wanted: Callable[[DataFrame], DataFrame], room: int = 16, orders: int = 4, rounds: int = 8, least: float = 0.02, seed: int = 7) -> DataFrame:
    """(u, v, sim): the neighbour lists of nodes (k, code and what else wanted needs).

    wanted marks (column wanted) the edges (u, v, sim) that the caller will keep. A list that is full of these is saturated: it
    gets four times the room and is refined further. Lists of others hold `room` neighbours. Rounds end when less than `least`
    of all edges are new, and at the latest after `rounds`, which begin anew whenever lists were enlarged. Of a node's edges, and of
    those that lead to it, MET take part in a round, fresh ones first; the rest wait for later ones. The search is a near one, see
    the caller's audit.
    """
    spark = nodes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-nodes.count() * 32 // 1_000_000))
    nodes = staged(nodes.withColumn("room", F.lit(room)), "nodes")
    start = first_graph(nodes, width, orders, tasks, room, seed).withColumn("fresh", F.lit(True)).withColumn("added", F.lit(True))
    graph, left, largest = staged(kept(start, nodes), "graph"), rounds, room
    while True:
        graph = refined(graph, nodes, width, tasks, largest, left)
        left -= 1
        counts = graph.agg(F.count_if("added"), F.count("*")).first()
        if left and counts[0] > least * counts[1]:
            continue
        full = wanted(graph).groupBy("u").agg(F.count("*").alias("n"), F.bool_and("wanted").alias("all")).where("all")
        full = full.join(nodes.select(F.col("k").alias("u"), "room"), "u").where("n >= room").select("u")
        full = staged(full, "saturated")
        if full.isEmpty():
            break
        more = nodes.join(full.select(F.col("u").alias("k"), F.lit(True).alias("full")), "k", "left").withColumn("room", F.when(F.col("full"), F.col("room") * 4).otherwise(F.col("room"))).drop("full")
        again = graph.join(full.withColumn("full", F.lit(True)), "u", "left").withColumn("fresh", F.col("fresh") | F.col("full").isNotNull()).drop("full")
        nodes, graph, left, largest = staged(more, "nodes", [nodes]), staged(again, "graph", [graph]), rounds, largest * 4
        discard(full)
    discard(nodes)
    return graph.select("u", "v", "sim")


def refined(graph: DataFrame, nodes: DataFrame, width: int, tasks: int, largest: int, nth_round: int) -> DataFrame:
    """One round: the graph after its fresh edges have been joined with others."""
    worst = graph.groupBy(F.col("u").alias("k")).agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    known = nodes.join(worst, "k", "left").select("k", "code", F.when(F.col("n") >= F.col("room"), F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    drawn = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("fresh"), F.xxhash64("u", "v", F.lit(nth_round))))
    ranked = graph.withColumn("nth", drawn("u"))
    back = graph.select("u", "v", "fresh").withColumn("nth", drawn("v")).where(F.col("nth") <= MET)
    around = ranked.where(F.col("nth") <= MET).select(F.col("u").alias("at"), F.col("v").alias("k"), "fresh").unionAll(back.select(F.col("v").alias("at"), F.col("u").alias("k"), "fresh"))
    around = around.groupBy("at", "k").agg(F.bool_or("fresh").alias("fresh")).join(known, "k").repartition(tasks, "at").sortWithinPartitions("at")
    new = joined(around, width, largest).withColumn("fresh", F.lit(True)).withColumn("added", F.lit(True))
    old = ranked.select("u", "v", "sim", (F.col("fresh") & (F.col("nth") > MET)).alias("fresh"), F.lit(False).alias("added"))
    return staged(kept(old.unionByName(new), nodes), "graph", [graph])


def angle(cosine: float) -> float:
    return math.acos(max(-1.0, min(1.0, cosine)))
