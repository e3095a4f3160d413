"""Tables that a job writes for its own later steps."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_lock = threading.Lock()
_scopes = threading.local()
_writers: dict[int, list] = {}  # by session: how many write, and the setting before the first of them


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder, as in tests.

    On a cluster an unset folder is an error: executors would write to disks of their own, and the rows that the driver can't see be lost.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_folio_dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors share (master is {master!r})")
        found = spark._folio_dir = "file://" + tempfile.mkdtemp(prefix="foliospark-")
    return found.rstrip("/")


def _cleaning(spark: SparkSession, on: bool) -> None:
    """Shuffle files go with the job while any thread writes; the last one restores the setting."""
    with _lock:
        held = _writers.setdefault(id(spark), [0, None])
        if on and held[0] == 0:
            held[1] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        held[0] += 1 if on else -1
        if not on and held[0] == 0:
            spark.conf.set(CLEANUP, held[1])


def staged(df: DataFrame, what: str, instead_of: tuple[DataFrame, ...] | list[DataFrame] = ()) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: cuts lineage, and survives lost executors.

    Shuffle files of the job that writes it go when it ends. instead_of: staged tables that nothing reads any more once df is
    written; they are deleted then. What is left goes when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    _cleaning(spark, True)
    try:
        df.write.parquet(path)
    finally:
        _cleaning(spark, False)
    discard(*instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    for scope in getattr(_scopes, "open", ()):
        scope.append(out)
    return out


def relation(df: DataFrame, what: str, instead_of: tuple[DataFrame, ...] | list[DataFrame] = ()) -> DataFrame:
    """staged, for tables that grow with the input: joins shuffle them and never send them to the driver to be broadcast.

    Spark judges a written table by its compressed files; repeated keys and bodies unfold to many times that in the driver.
    """
    made = staged(df, what, instead_of)
    out = made.hint("merge")
    out._folio_path = made._folio_path
    for scope in getattr(_scopes, "open", ()):
        scope[:] = [out if t is made else t for t in scope]
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to four tasks a core, for steps that cost far more than their bytes tell: few row groups make few tasks, and small shuffles are put together."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def bucketed(df: DataFrame, keys: list[str], buckets: int, what: str) -> DataFrame:
    """df as a table in the shared folder whose files are buckets of the keys, sorted by them: joins and aggregates by these keys read it without a shuffle. Where df is dealt out by the keys already, a bucket is one file."""
    spark = df.sparkSession
    name = f"{what}-{uuid.uuid4().hex}"
    path, table = f"{shared_dir(spark)}/{name}", name.replace("-", "_")
    atexit.register(remove, spark, path)
    _cleaning(spark, True)
    try:
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    finally:
        _cleaning(spark, False)
    out = spark.table(table)
    out._folio_path, out._folio_table = path, table
    for scope in getattr(_scopes, "open", ()):
        scope.append(out)
    return out


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans that are made (and run) inside take buckets of one file as sorted, so that merge joins need no sort of them either.

    Join such tables; don't aggregate their union: Spark 4.1 plans that without a shuffle, but a union of columnar scans does not
    keep buckets together, which splits groups.
    """
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables that are staged inside, by this thread, when it ends; take what has to stay out of the list."""
    made: list[DataFrame] = []
    _scopes.open = [*getattr(_scopes, "open", ()), made]
    try:
        yield made
    finally:
        _scopes.open = [s for s in _scopes.open if s is not made]
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables; other DataFrames are left alone."""
    for t in tables:
        if path := getattr(t, "_folio_path", None):
            remove(t.sparkSession, path)
            t._folio_path = None
        if table := getattr(t, "_folio_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            t._folio_table = None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged table; silent when the session has already ended."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is gone
        pass
