"""Benchmark decontamination as a prefix-filtered set join.

An item window (10 consecutive words; a shorter item is one window) is a set of word shingles of which a document has to hold
all, so one prefix shingle, the rarest in the corpus, is all that has to be joined. Length and positional bounds then
place the window in the document, and the words themselves are compared there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, hex_sha256, read, staged

#: Fixed value: a word is a run of anything but ASCII other than 0-9 and a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Rows of (hash, count, array of at most 10 short strings) that may be broadcast; larger tables are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Stands behind the last shingle of a document; a shingle with this hash is told apart by its place.
END = 2**62 + 1


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(list_: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array column, by position. The last k-1 hash what is left; matches are verified later."""
    return F.transform(F.col(list_), lambda w, i: F.xxhash64(F.lit(k), w, *(F.get(F.col(list_), i + j) for j in range(1, k))))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, k, items): the distinct windows, the shingle size that fits, and the ids of the items that hold it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    held = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, width))).alias("window"))
    return held.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("k", F.least(F.lit(SHINGLE), F.size("window")))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be joined: broadcast if it is known to hold few rows, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def occurrences(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, row, n, pos, sh): where documents hold any shingle of any window, and a row a document with pos null, for its n words.

    One pass over all texts: the shingles of all sizes and a mark for the end are exploded together.
    """
    known = [windows.where(F.col("k") == k).select(F.explode(F.slice(shingles("window", k), F.lit(1), F.size("window") - k + 1)).alias("known")) for k in sizes]
    wanted = reduce(DataFrame.unionAll, known).unionAll(docs.sparkSession.range(1).select(F.lit(END).alias("known"))).distinct()
    cut = docs.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))
    each = F.concat(*(shingles("w", k) for k in sizes), F.array(F.lit(END)))
    at = cut.select("doc_id", "row", F.size("w").alias("n"), F.posexplode(each).alias("place", "sh"))
    found = at.join(small(wanted, wanted.count()), F.col("sh") == F.col("known"), "left_semi")
    pos = F.when(F.col("place") < F.col("n") * len(sizes), F.pmod("place", F.greatest("n", F.lit(1))))
    return found.select("doc_id", "row", "n", pos.alias("pos"), "sh")


def prefixes(windows: DataFrame, found: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, off, window, items): each window's rarest shingle by corpus frequency, and its place in the window."""
    parts = [windows.where(F.col("k") == k).select("window", "items", F.posexplode(F.slice(shingles("window", k), F.lit(1), F.size("window") - k + 1)).alias("off", "key")) for k in sizes]
    counts = found.groupBy(F.col("sh").alias("key")).agg(F.count("*").alias("times"))
    ordered = reduce(DataFrame.unionAll, parts).join(counts, "key", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    rarest = ordered.groupBy("window").agg(F.min(F.struct("times", "key", "off", "items")).alias("r"))
    return rarest.where("r.times > 0").select("window", "r.key", "r.off", "r.items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs plus n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    A word is hit if it lies in an occurrence of a window of any item. Null and empty texts have no words, in documents as in
    items. A null item_id marks words but is not listed. Repeated rows, and rows that share or lack a doc_id, each get
    their own counts. Own columns with one of the five names are replaced. An empty benchmark finds nothing.
    """
    windows = staged(item_windows(benchmark, width), "item-windows")
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())  # at most 1, 2 and 3
    own = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    kept = [c for c in docs.columns if c not in own]
    rows = docs.select(*kept, F.xxhash64("text").alias("__row"))
    no_ids = F.array().cast("array<string>")
    if sizes:
        found = staged(occurrences(docs.select("doc_id", "text"), windows, sizes), "occurrences")
        at = found.where("pos is not null")
        prefix = staged(prefixes(windows, at, sizes), "prefixes")
        placed = at.join(small(prefix, prefix.count()), F.col("sh") == F.col("key")).withColumn("start", F.col("pos") - F.col("off"))
        placed = placed.where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n")))
        maybe = staged(placed.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "window", "items")).alias("maybe")), "candidates")
        ends = found.where("pos is null").select("doc_id", "row", "n", F.lit(0).alias("hit"), no_ids.alias("ids"))
        marks = ends.unionAll(verified(docs, maybe)).groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__of"))
        marks = marks.agg(F.max("n").alias("__n"), F.max("hit").alias("__hit"), F.max("ids").alias("__ids"))
        rows = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__of")), "left")
    else:
        rows = rows.withColumn("__n", F.size(words(F.col("text")))).withColumn("__hit", F.lit(0)).withColumn("__ids", no_ids)
    own_values = [F.col("__n").cast("long"), F.col("__hit").cast("long"), F.size("__ids").cast("long"), F.col("__ids"), F.col("__hit") > 0]
    return rows.select(*kept, *(x.alias(name) for x, name in zip(own_values, own)))


def verified(docs: DataFrame, maybe: DataFrame) -> DataFrame:
    """(doc_id, row, n, hit, ids) of documents with candidates (doc_id, row, maybe): words hit and ids of items, exactly."""
    texts = docs.select(F.col("doc_id").alias("of"), F.xxhash64("text").alias("of_row"), "text")
    both = texts.join(maybe, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("of_row") == F.col("row"))).select("doc_id", "row", words(F.col("text")).alias("w"), "maybe")
    # w is a lambda's variable, so that the optimizer can't put the cutting of words inside the filter, once a candidate
    held = lambda w: F.filter("maybe", lambda c: F.slice(w, c["start"] + 1, F.size(c["window"])) == c["window"])
    same = F.get(F.transform(F.array("w"), held), F.lit(0))
    hits = both.select("doc_id", "row", F.size("w").alias("n"), same.alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["window"]) - 1))))
    ids = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform("hits", lambda c: F.transform(c["items"], lambda i: i.cast("string")))))))
    return hits.select("doc_id", "row", "n", F.size(covered).alias("hit"), ids.alias("ids"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", hex_sha256(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT * FROM dw SEMI JOIN bw USING (n, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bw USING (n, win)) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
"""
