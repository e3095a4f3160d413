"""SimHash near-duplicates by pigeonring filtering.

64-bit fingerprints are cut into m segments on a ring. If two fingerprints differ in at most t bits, there is a segment from which
every chain of l consecutive segments (l = 1..m) holds at most l*t/m differing bits. The chains whose budget is below one bit
must be equal and make the join key; the longer chains prune what the join finds; the full distance is checked last.

Only distinct fingerprints are compared. A bucket with many of them is not paired at all: its fingerprints are linked over the
values at one differing bit from them instead (for t = 2, two fingerprints are within the distance exactly if they share
such a value), which takes 65 rows a fingerprint however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import read, staged
from foliospark.llm.components import components

BITS = 64


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash over word shingles; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(b" ".join(words), seed)]
    else:
        joined, ends, at = b" ".join(words), [], 0
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *ends[: len(words) - size]]
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :])]
    bits = np.zeros(BITS, np.int64)
    whole = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for block in range(0, len(whole), 65536):
        bits += np.unpackbits(whole[block : block + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): a row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), size) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def rotated(fp: Column, bits: int) -> Column:
    if bits % BITS == 0:
        return fp
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, BITS - bits))


def chain_masks(m: int, limit: int) -> list[tuple[int, int]]:
    """(mask, budget) of the chains of 1..m segments from the ring's start, the longest of each budget (it implies the others)."""
    width, out = BITS // m, {}
    for n in range(1, m + 1):
        out[n * limit // m] = (1 << (n * width)) - 1
    return [((mask ^ (1 << 63)) - (1 << 63), budget) for budget, mask in out.items()]


def links(distinct: DataFrame, limit: int = 2, m: int = 16, most: int = 32) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) that connect all that differ in at most `limit` (here 2) bits.

    Buckets of up to `most` fingerprints are paired, which gives every link; larger ones are linked over shared neighbours.
    """
    if limit != 2:
        raise ValueError("larger buckets are linked exactly for a limit of 2 only")
    width = BITS // m
    chains = chain_masks(m, limit)
    key_mask = next(mask for mask, budget in chains if budget == 0)
    ring = F.array(*(rotated(F.col("fp"), i * width) for i in range(m)))
    keyed = distinct.select("fp", F.posexplode(ring).alias("seg", "turned")).withColumn("key", F.col("turned").bitwiseAND(F.lit(key_mask)))
    keyed = staged(keyed, "ring-keys")
    sizes = staged(keyed.groupBy("seg", "key").count().where("count > 1"), "ring-buckets")
    met = keyed.join(sizes, ["seg", "key"])
    x, y = (met.where(F.col("count") <= most).select("seg", "key", F.col("fp").alias(n), F.col("turned").alias(f"t{n}")) for n in "ab")
    pairs = x.join(y, ["seg", "key"]).where("a < b")
    differ = F.col("ta").bitwiseXOR(F.col("tb"))
    for mask, budget in chains:
        pairs = pairs.where(F.bit_count(differ.bitwiseAND(F.lit(mask))) <= budget)
    few = pairs.select("a", "b")
    crowd = met.where(F.col("count") > most).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)))
    shared = staged(crowd.select("fp", F.explode(near).alias("value")), "ring-neighbours")
    firsts = shared.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("value", "a")
    many = shared.join(staged(firsts, "ring-firsts"), "value").where("a < fp").select("a", F.col("fp").alias("b"))
    return reduce(DataFrame.unionAll, [few, many]).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, limit: int = 2, m: int = 16) -> DataFrame:
    """(doc_id, fp, component_id), a row per row of docs: component_id is the smallest doc_id that links of at most `limit` bits reach.

    Null and empty texts have fingerprint 0 and link like any other. Rows whose doc_id is null are linked too but name no
    component unless all of it lacks a doc_id (then null). Repeated rows are copies. Other columns are not read.
    """
    prints = staged(fingerprints(docs, size), "fingerprints")
    firsts = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct-fingerprints")
    labels = components(links(firsts.select("fp"), limit, m))
    owner = firsts.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    owner = staged(owner, "labelled")
    least = owner.groupBy("label").agg(F.min("first").alias("component_id"))
    named = owner.join(least, "label").select(F.col("fp").alias("of"), "component_id")
    return prints.join(staged(named, "components"), F.col("fp") == F.col("of"), "left").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
