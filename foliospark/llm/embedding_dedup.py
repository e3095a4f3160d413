"""Near-duplicate embeddings: NN-descent over balls, threshold edges, audited recall.

Angles are a metric. Vectors within half the threshold's angle of one vector (a ball) are all linked with each other, so that balls
stand for their vectors: of a crowd of near copies one takes part in the neighbour graph, and a pair of balls is linked as a
whole, or not at all, by the angle of their middles and their radii. Only pairs that these leave open are compared one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import discard, read, staged
from foliospark.llm.components import components
from foliospark.llm.neighbours import SLACK, angle, nn_descent
from foliospark.llm.vectors import dimensions, is_finite, matrix, packed, unpacked

SMALL_BYTES = 32 << 20  # tables of so many bytes at most are broadcast
AUDITED = 256  # rows whose links are counted by comparing them with all
SURE = 1e-7  # angles closer to a limit are not decided by balls


def unit_rows(rows: DataFrame, width: int) -> DataFrame:
    """(k, vec_id, unit): unit vectors of doubles as bytes, null for a zero vector. k tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), width)
            x = x / np.maximum(np.abs(x).max(axis=1, initial=0), 5e-324)[:, None] if len(x) else x
            norm = np.sqrt((x * x).sum(axis=1))
            unit = x / np.where(norm > 0, norm, 1)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([u.tobytes() if n > 0 else None for u, n in zip(unit, norm)], pa.binary())], names=["k", "vec_id", "unit"])

    x = F.when(is_finite(F.col("embedding")), F.col("embedding").cast("array<double>")).otherwise(F.array().cast("array<double>"))
    return rows.select(F.monotonically_increasing_id().alias("k"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).mapInArrow(run, "k long, vec_id long, unit binary")


def with_cosine(df: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """df without the unit vectors a and b, but with their cosine."""
    rest = [f for f in df.schema if f.name not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.einsum("ij,ij->i", unpacked(batch.column(0), "<f8", width), unpacked(batch.column(1), "<f8", width))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(cosine)], names=[*(f.name for f in rest), "cosine"])

    return df.select(a, b, *(f.name for f in rest)).mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), "cosine double"]))


def few(df: DataFrame, row_bytes: int) -> DataFrame:
    """df to be joined: broadcast if its counted rows are few enough, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def balls(units: DataFrame, width: int, near: float, rounds: int = 4, seed: int = 11) -> DataFrame:
    """(k, ball, cosine): each row's ball, named by the row in its middle, and the cosine with it (`near` or more).

    Rows are dealt by random-hyperplane signs, which near copies tend to share; the first of a bucket takes in those of it that lie
    near, the others are dealt anew. Rows that no bucket brings to a middle are balls of one: that costs time later, no links.
    """
    pool, n = units.select("k", "unit"), units.count()
    bits = min(20, max(2, n.bit_length() - 3))
    found, owned = [], []
    for i in range(rounds):
        planes = np.random.default_rng(seed + i).standard_normal((width, bits))

        def deal(batches: Iterator[pa.RecordBatch], planes: np.ndarray = planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bucket = ((unpacked(batch.column(1), "<f8", width) @ planes > 0) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int64))], names=["k", "unit", "bucket"])

        dealt = staged(pool.mapInArrow(deal, "k long, unit binary, bucket long"), "dealt")
        firsts = staged(dealt.groupBy("bucket").agg(F.min_by(F.struct("k", "unit"), "k").alias("m")).select("bucket", F.col("m.k").alias("ball"), F.col("m.unit").alias("middle")), "middles")
        met = dealt.join(few(firsts, width * 8 + 24), "bucket").where("k != ball").select("k", "ball", "unit", "middle")
        taken = staged(with_cosine(met, "unit", "middle", width).where(F.col("cosine") >= near), "balls")
        found.append(taken)
        owned.append(taken.select(F.col("ball").alias("k")).distinct())
        gone = staged(taken.select("k").unionAll(owned[-1]), "dealt-out")
        pool = staged(dealt.join(few(gone, 16), "k", "left_anti").select("k", "unit"), "pool", [dealt, firsts, *([pool] if i else [])])
        count = gone.count()
        discard(gone)
        if count < 0.002 * n:
            break
    members = reduce(DataFrame.unionAll, found)
    middles = units.select("k").join(members.select("k"), "k", "left_anti").select("k", F.col("k").alias("ball"), F.lit(1.0).alias("cosine"))
    return staged(members.unionAll(middles), "in-balls", found)


def codes(units: DataFrame, width: int) -> DataFrame:
    """units with an 8-bit code in place of the vector."""
    rest = [f for f in units.schema if f.name != "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unpacked(batch.column(0), "<f8", width)
            u = np.rint(u * (127 / np.maximum(np.abs(u).max(axis=1, initial=0), 1e-9))[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([packed(u), *batch.columns[1:]], names=["code", *(f.name for f in rest)])

    return units.select("unit", *(f.name for f in rest)).mapInArrow(run, ", ".join(["code binary", *(f"{f.name} {f.dataType.simpleString()}" for f in rest)]))


def touching(middles: DataFrame, units: DataFrame, width: int, theta: float, room: int, orders: int, seed: int) -> DataFrame:
    """(a, b, cosine) with a < b: balls (k, size, radius) some of whose vectors may be linked, by NN-descent; cosine is that of the middles."""
    shape = middles.select("k", "radius")

    def may(edges: DataFrame) -> DataFrame:
        both = edges.join(shape.withColumnRenamed("k", "u").withColumnRenamed("radius", "ru"), "u").join(shape.withColumnRenamed("k", "v").withColumnRenamed("radius", "rv"), "v")
        return both.withColumn("wanted", F.col("sim") >= F.cos(F.least(F.lit(theta) + F.col("ru") + F.col("rv"), F.lit(math.pi))) - SLACK)

    coded = codes(units.join(middles.select("k"), "k").select("k", "unit"), width)
    graph = nn_descent(coded, width, may, room, orders, seed=seed)
    pairs = may(graph).where("wanted").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    ua, ub = (units.select(F.col("k").alias(n), F.col("unit").alias(f"u{n}")) for n in "ab")
    size = width * 8 + 16
    return staged(with_cosine(pairs.join(few(ua, size), "a").join(few(ub, size), "b"), "ua", "ub", width), "touching")


def linked(units: DataFrame, width: int, limit: float, room: int = 16, orders: int = 4, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((k, ball, n_links) of each row, (a, b) of linked balls)."""
    theta = angle(limit)
    near = math.cos(theta / 2) + 1e-9  # any two within half the angle of a third are linked
    held = balls(units, width, near)
    sizes = staged(held.groupBy("ball").agg(F.count("*").alias("size"), F.acos(F.least(F.min("cosine"), F.lit(1.0))).alias("radius")).withColumnRenamed("ball", "k"), "ball-sizes")
    met = touching(sizes, units, width, theta, room, orders, seed)
    of = lambda n: sizes.select(F.col("k").alias(n), F.col("size").alias(f"size_{n}"), F.col("radius").alias(f"radius_{n}"))
    both = met.join(of("a"), "a").join(of("b"), "b").withColumn("between", F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))))
    single, reach = (F.col("size_a") == 1) & (F.col("size_b") == 1), F.col("radius_a") + F.col("radius_b")
    whole = F.when(single, F.col("cosine") >= limit).when(F.col("between") + reach <= theta - SURE, True).when(F.col("between") - reach > theta + SURE, False)
    both = staged(both.withColumn("whole", whole), "ball-pairs", [met])
    way = lambda a, b: both.select(F.col(a).alias("from"), F.col(b).alias("to"), F.col(f"size_{b}").alias("size"), F.col(f"radius_{b}").alias("radius"), "whole")
    ways = way("a", "b").unionAll(way("b", "a"))
    sums = ways.where("whole").groupBy(F.col("from").alias("ball")).agg(F.sum("size").alias("more"))
    open_ = staged(ways.where("whole is null").select("from", "to", "size", "radius"), "open-pairs")
    vectors = held.select("k", F.col("ball").alias("from")).join(units.select("k", "unit"), "k")
    middle = units.select(F.col("k").alias("to"), F.col("unit").alias("middle"))
    one = with_cosine(open_.join(vectors, "from").join(middle, "to"), "unit", "middle", width).withColumn("between", F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))))
    alone = F.when(F.col("size") == 1, F.col("cosine") >= limit).when(F.col("between") + F.col("radius") <= theta - SURE, True).when(F.col("between") - F.col("radius") > theta + SURE, False)
    one = staged(one.withColumn("whole", alone).where("whole is null or whole").select("k", "from", "to", "size", "whole"), "open-rows")
    left = one.where("whole is null").select("k", "from", "to").join(units.select("k", "unit"), "k")
    right = held.select(F.col("k").alias("other"), F.col("ball").alias("to")).join(units.select(F.col("k").alias("other"), F.col("unit").alias("with")), "other").drop("other")
    last = with_cosine(left.join(right, "to"), "unit", "with", width).where(F.col("cosine") >= limit).groupBy("k", "from", "to").agg(F.count("*").alias("size"))
    single_links = staged(one.where("whole").select("k", "from", "to", F.col("size").cast("long")).unionAll(last), "row-links", [one, open_])
    own = single_links.groupBy("k").agg(F.sum("size").alias("own"))
    counts = held.join(sizes.select(F.col("k").alias("ball"), "size"), "ball").join(sums, "ball", "left").join(own, "k", "left")
    counts = counts.select("k", "ball", (F.col("size") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links"))
    edges = both.where("whole").select("a", "b").unionAll(single_links.select(F.col("from").alias("a"), F.col("to").alias("b")))
    return staged(counts, "link-counts"), staged(edges.distinct(), "ball-links", [single_links, both])


def audit(units: DataFrame, counts: DataFrame, width: int, limit: float) -> tuple[int, int]:
    """(found, all): links of AUDITED rows in counts, and by comparing these rows with all others. Half of the rows are taken from those with links, so that rare ones are seen."""
    n = AUDITED // 2
    some = counts.where("n_links > 0").orderBy(F.xxhash64("k")).limit(n).unionAll(counts.orderBy(F.xxhash64("k", F.lit(1))).limit(n)).dropDuplicates(["k"])
    rows = some.select("k", "n_links").join(units.select("k", "unit"), "k").collect()  # AUDITED at most
    own = np.array([np.frombuffer(r.unit, "<f8") for r in rows]).reshape(-1, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total += int((unpacked(batch.column(0), "<f8", width) @ own.T >= limit).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    true = units.select("unit").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] - len(rows)
    return sum(r.n_links for r in rows), true


def near_duplicate_vectors(rows: DataFrame, limit: float = 0.9, recall: float = 0.95, tries: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of rows (vec_id, embedding): near duplicates by cosine.

    A link is a pair of cosine `limit` or more (which has to be 0 to 1) in double precision; none below is counted. NN-descent may miss some: links
    of a sample are counted against all rows, and while fewer than `recall` of them were found the search is made again with lists
    twice as long and twice as many first orders, `tries` times at most. Null and zero vectors, and those with null or non-finite
    components, link with nothing; shorter ones count as filled up with zeros. Rows are told apart even where they are equal
    or share a vec_id. A row without vec_id links like any other, but names no component unless all of it lacks one (then
    null) and is not kept. Other columns are not read; an empty table gives no rows.
    """
    width = max(1, dimensions(rows, "embedding"))
    every = staged(unit_rows(rows, width), "unit-rows")
    units = every.where("unit is not null")
    for i in range(tries):
        counts, edges = linked(units, width, limit, 16 << i, 4 << i, seed=7 + i)
        found, true = audit(units, counts, width, limit)
        if found >= recall * true or i == tries - 1:
            break
        discard(counts, edges)
    named = components(edges)
    tops = counts.join(named, F.col("ball") == F.col("node"), "left").select("k", "n_links", F.coalesce("label", "ball").alias("label"))
    tops = staged(tops, "labelled")
    least = tops.join(every.select("k", "vec_id"), "k").groupBy("label").agg(F.min("vec_id").alias("component_id"))
    out = every.select("k", "vec_id").join(tops.join(least, "label"), "k", "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))
