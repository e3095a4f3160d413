"""Near copies by SimHash and exact Jaccard similarity of word shingles.

Sets whose SimHash fingerprints differ in two bits at most are found by the pigeonring join of simhash and compared whole. Near copies of
a similarity of 4/5 may differ in many more bits, so the rest is found by an exact way that leaves out what these links have joined:
a prefix-filtered set join whose candidates are pruned by Hamming distance.

Two sets of a similarity of 4/5 or more share a shingle among the first n - ceil(4n/5) + 1 of each, in any order that all sets
are sorted by. Shingles that are frequent in a sample come last, so prefixes are rare ones; the sample moves work, not results.
Each set also has a parity sketch: a bit per bucket of hashes, 1 if the bucket holds an odd number of them. Sets that differ in d
shingles differ in at most d bits, and similar ones in at most (na + nb) / 9, so pairs with more differing bits go before any
text is fetched, and none is lost (of SimHash bits no limit keeps every pair of this similarity). What is left is compared whole.
In each bucket sets are compared with one of them first, the one that meets most others, and only sets that no link has joined
by then are paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import discard, staged
from foliospark.llm.components import components
from foliospark.llm.simhash import links

#: Deals the pairs of a bucket with many sets to tasks, this many sets a block.
BLOCK = 64
#: Words of the short sketch that sets carry into the pairing of a bucket.
FLAT = 8
#: Bytes of words that are hashed at once, and the length from which a word counts by its digest.
CHUNK, LONG_WORD = 1 << 20, 1 << 16
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_tables: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and the powers of the base and of its inverse."""
    if not _tables:
        n = CHUNK + 8 * LONG_WORD
        both = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        _tables.extend([np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1), *both])
    return tuple(_tables)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the word shingles, joined by spaces: sums of bytes times powers of a base, each from differences of one running sum."""
    letters, up, down = powers()
    joined = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[joined] * up[: len(joined)])])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n], ends[min(size, len(words)) - 1 :]
    found = (sums[ends] - sums[starts]) * down[starts]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole text where it has fewer words, none where it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as fingerprint() cuts them
    if not words:
        return np.empty(0, np.int64)
    if max(map(len, words)) >= LONG_WORD:
        words = [b"\xff" + xxhash.xxh64_hexdigest(w).encode() if len(w) >= LONG_WORD else w for w in words]
    found, begin, held = [], 0, 0
    for end, w in enumerate(words, 1):
        held += len(w) + 1
        if held >= CHUNK or end == len(words):
            first = max(0, begin - size + 1)  # shingles that begin in the last chunk and end here
            found.append(shingle_hashes(words[first:end], size))
            begin, held = end, 0
    return np.unique(np.concatenate(found).view(np.int64))


def parity_sketch(found: np.ndarray, bits: int = 0) -> np.ndarray:
    """Words of a bit per bucket: whether it holds an odd number of hashes. Without a number of bits, as many as a power of two of the set's size or more, 64 at least."""
    bits = bits or max(64, 1 << (max(1, len(found)) - 1).bit_length())
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def set_print(found: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes; 0 of the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        part = found[at : at + 65536]
        ones += np.unpackbits(part.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def row_key() -> Column:
    """Digest of doc_id and text."""
    return F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").cast("binary"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(k, shingles) of rows of docs (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(t.as_py(), size) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["k", "shingles"])

    return docs.select("k", "text").mapInArrow(run, "k string, shingles array<long>")


def frequent(docs: DataFrame, size: int, rows: int = 20_000, most: int = 200_000) -> np.ndarray:
    """Shingles of three or more documents of a sample of about `rows`, rarest first (`most` of the most frequent at most)."""
    picked = docs.withColumn("k", row_key()).where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < min(1.0, rows / max(docs.count(), 1)) * 1_000_000)
    counts = _sets(picked, size).select(F.explode("shingles").alias("h")).groupBy("h").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "h").limit(most).collect()
    return np.array([r.h for r in reversed(top)], np.int64)


def prefixes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, k, node, n, print, sketch, flat, prefix) a row per row of docs: node names the set of n shingles, print is its SimHash, flat its sketch in FLAT words, prefix its head in the common order."""
    late = frequent(docs, size)
    by_hash = np.argsort(late, kind="stable")
    known = late[by_hash]

    def head(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        take = len(s) - (4 * len(s) + 4) // 5 + 1
        if not len(known):
            return s[:take]
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        rank = np.where(known[at] == s, by_hash[at] + 1, 0)
        return s[np.argsort(rank, kind="stable")[:take]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(2)]
            nodes = pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64())
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (map(parity_sketch, sets), [parity_sketch(s, 64 * FLAT) for s in sets], map(head, sets))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], nodes, pa.array(map(len, sets), pa.int32()), pa.array(map(set_print, sets), pa.int64()), *longs], names=["doc_id", "k", "node", "n", "print", "sketch", "flat", "prefix"])

    schema = "doc_id long, k string, node long, n int, print long, sketch array<long>, flat array<long>, prefix array<long>"
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("k"), "text").mapInArrow(run, schema)


def _possible() -> Column:
    """Of sets a and b that meet at places pa and pb of their prefixes: whether sizes, and what can follow, leave room for a similarity of 4/5."""
    room = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (9 * F.least("na", "nb") >= 4 * (F.col("na") + F.col("nb"))) & (9 * room >= 4 * (F.col("na") + F.col("nb")))


def folded(sketch: str, words: Column) -> Column:
    """A sketch of twice as many words (or as many) brought to that number: the parity of two buckets together."""
    half = F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.get(F.col(sketch), i).bitwiseXOR(F.get(F.col(sketch), i + words)))
    return F.when(F.size(sketch) > words, half).otherwise(F.col(sketch))


def _alike(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches differ in at most (na + nb) / 9 bits. bits: (node, n, sketch). Sizes of a pair differ by a quarter at most, sketches by a factor of two."""
    for x in "ab":
        pairs = pairs.join(bits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
    words = F.least(F.size("sa"), F.size("sb"))
    differ = F.zip_with(folded("sa", words), folded("sb", words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return pairs.where(9 * F.aggregate(differ, F.lit(0), lambda t, d: t + d) <= F.col("na") + F.col("nb")).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is 4/5 or more, as a staged table. firsts has one row (node, k) a set."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    keys = staged(firsts.join(wanted, "node", "left_semi"), "copy-keys")
    texts = docs.select(row_key().alias("k"), "text").join(keys.select("k"), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    whole = staged(_sets(texts, size).join(keys, "k").select("node", "shingles"), "copy-sets", [keys])
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(whole.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return staged(both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "copy-links", [whole])


def print_pairs(prints: DataFrame) -> DataFrame:
    """(a, b), staged: sets of prints (node, print) to be compared, which connect all whose fingerprints differ in two bits at most.

    Of each fingerprint the least node stands for the others, which are paired with it alone.
    """
    groups = staged(prints.groupBy("print").agg(F.min("node").alias("first"), F.count("*").alias("held")), "print-groups")
    same = prints.join(groups.where("held > 1"), "print").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(groups.select(F.col("print").alias("fp"))).select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    for x in "ab":
        near = near.join(groups.select(F.col("print").alias(f"p{x}"), F.col("first").alias(x)), f"p{x}")
    both = same.unionByName(near.select("a", "b"))
    return staged(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "print-pairs", [groups])


def _sides(met: DataFrame, *more: str) -> list[DataFrame]:
    return [met.select("h", *more, F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("label").alias(f"l{x}"), F.col("flat").alias(f"f{x}"), F.col("mine").alias(f"m{x}")) for x in "ab"]


def _met(one: DataFrame) -> DataFrame:
    """(node, h, n, pos, held, weight), staged: prefix shingles that `held` sets share. weight counts the sets that a set meets, once a bucket."""
    shared = staged(one.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("held")).where("held > 1"), "copy-shared")
    heads = one.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    met = staged(heads.join(shared, "h"), "copy-buckets", [shared])
    return staged(met.join(met.groupBy("node").agg(F.sum("held").alias("weight")), "node"), "copy-weighted", [met])


def _rest(met: DataFrame, labels: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b): possible pairs of sets of different labels, of buckets that hold more than two sets. Pairs of a bucket are dealt to tasks by blocks of sets."""
    part = met.where("held > 2").join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    part = staged(part.select("h", "node", "n", "pos", "held", F.coalesce("label", "node").alias("label")), "copy-parts")
    mixed = part.groupBy(F.col("h").alias("mixed")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("mixed")
    part = staged(part.join(mixed, F.col("h") == F.col("mixed")).join(bits.select("node", "flat"), "node"), "copy-mixed", [part])
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = part.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    a, b = _sides(dealt, "x", "y")
    # each pair meets in the one block pair (x, y) that is made of its two blocks
    own = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.col("x") == F.least("ma", "mb")) & (F.col("y") == F.greatest("ma", "mb"))
    differ = reduce(lambda t, d: t + d, (F.bit_count(F.get("fa", F.lit(i)).bitwiseXOR(F.get("fb", F.lit(i)))) for i in range(FLAT)))
    pairs = a.join(b, ["h", "x", "y"]).where(own & _possible() & (9 * differ <= F.col("na") + F.col("nb")))
    return staged(pairs.select("a", "b").distinct(), "copy-rest", [part])


def near_copies(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, k, component), a row per row of docs (doc_id, text): rows whose shingle sets links of similarity 4/5 or more connect share a component.

    k is row_key(). Texts of equal sets are copies; null and empty texts have the empty set. No rows give no rows.
    """
    all_rows = staged(prefixes(docs, size), "copy-prefixes")
    one = staged(all_rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "print", "sketch", "flat", "prefix"))), "copy-nodes")
    rows = staged(all_rows.select("doc_id", "k", "node"), "copy-rows", [all_rows])
    firsts = staged(rows.groupBy("node").agg(F.min("k").alias("k")), "copy-firsts")  # large groups of copies shrink before the shuffle
    bits = staged(one.select("node", "n", "sketch", "flat"), "copy-sketches")
    close = staged(_alike(print_pairs(one.select("node", "print")), bits), "copy-likely")
    edges = _verified(close, docs, firsts, size)
    known = staged(components(edges), "copy-labels", [close])
    met = _met(one)
    discard(one)
    tops = met.groupBy(F.col("h").alias("of")).agg(F.min(F.struct(-F.col("weight"), "node", "n", "pos")).alias("top"))
    lead = met.join(tops, F.col("h") == F.col("of")).select(F.col("top.node").alias("a"), F.col("top.n").alias("na"), F.col("top.pos").alias("pa"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    lead = lead.where((F.col("a") != F.col("b")) & _possible()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for x in "ab":
        lead = lead.join(known.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
    pairs = staged(lead.where("la is null or lb is null or la != lb").select("a", "b").distinct(), "copy-pairs")
    likely = staged(_alike(pairs, bits), "copy-likely")
    edges = staged(edges.unionAll(_verified(likely, docs, firsts, size)), "copy-links", [edges])
    labels = staged(components(edges), "copy-labels", [likely, known])
    rest = _rest(met, labels, bits)
    discard(met)
    rest = staged(_alike(rest.join(pairs, ["a", "b"], "left_anti"), bits), "copy-likely", [rest, pairs])
    if rest.take(1):
        more = _verified(rest, docs, firsts, size)
        labels = staged(components(edges.unionAll(more)), "copy-labels", [labels])
        discard(more)
    discard(rest, bits, edges, firsts)
    named = labels.withColumnRenamed("node", "of")
    return rows.join(named, F.col("node") == F.col("of"), "left").select("doc_id", "k", F.coalesce("label", "node").alias("component"))
