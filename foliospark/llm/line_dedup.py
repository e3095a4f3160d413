"""Line dedup on levelled sorted runs of line hashes.

The index is a set of runs. A run is a table (h1, h2, n_docs, last_doc), one row per line key, in buckets of the key that are
sorted by it. A batch is aggregated to one row per key, merge-anti-joins the entries that the runs have already settled, run by
run, and is added as a run of level 0: only the batch is shuffled and sorted, the runs are read as they lie. When a level holds
`fanout` runs they are merged two at a time, by a merge join, bucket by bucket into one run of the next level, again without a shuffle. A key is known by two
64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import WHITE, ascii_lower, bucketed, discard, hex_sha256, read, sorted_buckets, staged

KEY = ["h1", "h2"]


class LineRuns:
    """The levelled index. settled: entries found in min_docs documents already. Runs have as many buckets as a shuffle has partitions."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unsettled(self, occurrences: DataFrame) -> DataFrame:
        """Entries of occurrences (h1, h2, doc_id), a row per line, that no run has settled with a later document; neither the verdict
        nor the keeper of the others can change. So hot lines stay out of the newer runs."""
        batch = occurrences.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        for run in self.runs():
            known = run.where(F.col("n_docs") >= self.min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("last_doc").alias("later"))
            batch = batch.join(known.hint("merge"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("later") > F.col("last_doc")), "left_anti")
        return batch

    def add(self, occurrences: DataFrame) -> None:
        self._put(0, self._run(self.unsettled(occurrences), 0))

    def _run(self, entries: DataFrame, level: int) -> DataFrame:
        with sorted_buckets(self.spark):
            return bucketed(entries, KEY, self.buckets, f"line-run-{level}")

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge(full, level + 1))

    def _merge(self, runs: list[DataFrame], level: int) -> DataFrame:
        """One run of several, two at a time; those are deleted."""
        out = runs[0]
        for run in runs[1:]:
            new = self._run(merged(out, run), level)
            discard(out, run)
            out = new
        return out

    def table(self) -> DataFrame:
        """All entries, one row per key, as the only run that is left. n_docs is exact below min_docs and never below min_docs for a settled key."""
        self.levels = [[self._merge(self.runs(), len(self.levels))]]
        return self.levels[0][0]


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """The entries of two runs, merged along their common order."""
    x = other.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
    both = one.join(x.hint("merge"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "full")
    n = F.coalesce("n_docs", F.lit(0).cast("long")) + F.coalesce("more", F.lit(0).cast("long"))
    return both.select(F.coalesce("h1", "k1").alias("h1"), F.coalesce("h2", "k2").alias("h2"), n.alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of each line whose key has min_chars code points. row tells apart rows that share a doc_id."""
    lines = F.split(ascii_lower(F.col("text")), "\n", -1)
    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines).alias("pos", "line"))
    keyed = keyed.select("doc_id", "row", "pos", F.btrim("line", F.lit(WHITE)).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def index_in_batches(spark: SparkSession, keys: DataFrame, batches: int, min_docs: int, fanout: int) -> LineRuns:
    """Adds keys in ranges of doc_id, the latest first, as a crawl that is indexed backwards."""
    index = LineRuns(spark, min_docs, fanout)
    cuts = sorted(set(keys.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    bounds = [None, *map(int, cuts), None]
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = keys
        part = part.where(F.col("doc_id") > low) if low is not None else part
        part = part.where(F.col("doc_id") <= high) if high is not None else part
        index.add(part.select(*KEY, "doc_id"))
    return index


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with text cut to its kept lines, plus n_lines (before) and n_dropped.

    A line's key is the line without [ \\t\\n\\v\\f\\r] at both ends and with A-Z lower-cased. A key of min_chars code points
    found in min_docs distinct doc_ids loses all its lines, but not those in the largest doc_id that holds it.

    Nulls and empty texts count as one empty line and come back as ''. Rows with a null doc_id are no documents: they
    don't count and keep all lines. Rows that share a doc_id count as one document, each row is filtered by its own lines.
    Other columns pass through; an own column named n_lines or n_dropped is replaced. Empty tables give empty tables.
    """
    spark = docs.sparkSession
    keys = staged(line_keys(docs.select("doc_id", "text"), min_chars), "line-keys")
    index = index_in_batches(spark, keys, batches, min_docs, fanout)
    repeated = staged(index.table().where(F.col("n_docs") >= min_docs), "repeated-lines")
    discard(*index.runs())
    lost = keys.join(repeated, KEY).where(F.col("doc_id") < F.col("last_doc"))
    lost = lost.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("__lost"))
    lost = lost.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__of"), "__lost")

    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept_columns, F.xxhash64("text").alias("__row"))
    both = rows.join(lost, (F.col("doc_id") == F.col("__doc")) & (F.col("__row") == F.col("__of")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    both = both.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("__lost"), F.lit(0)).cast("long"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n")
    text = F.when(F.col("__lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
    return both.withColumn("text", text).select(*kept_columns, "n_lines", "n_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("text")).alias("kept_sha256"))


#: Line ends and the white space of a key come in as chr() so that the SQL holds no control characters.
OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < r.last_doc, false) AS lost FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
