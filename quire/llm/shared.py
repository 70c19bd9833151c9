"""What the operators of this subpackage share: scratch tables in the cluster's shared
folder, size-checked broadcasts, salted joins and a few native text expressions."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import operator
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where the session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(LOCAL_SHARED)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, grouped by application."""
    return f"{shared_dir(spark)}/quire/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of a narrow table that are worth a file of their own.
PER_FILE = 20_000


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here, and a lost
    executor costs nothing that was written. Its shuffle files go once it is written. rows: about how
    many it has at most, where that is known of a narrow table; it then has no more files than these need. Child processes were
    seen at many file writes (likely chmod, without Hadoop's native library), so tiny ones are dear."""
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PER_FILE)))
    with setting(df.sparkSession, _CLEAN, "true"):
        df.write.mode("overwrite").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether an execution's shuffle files go at its end. They were seen to outlive two collections of the driver's heap.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def last_only(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, which must read nothing but the last table that it has cut; the tables cut
    before that one are deleted, so that a finished step holds no more disk than its result."""
    outer, mine = _made.get(), []
    token = _made.set(mine)
    try:
        out = make()
    finally:
        _made.reset(token)
    if outer is not None:
        outer += mine[-1:]
    for path in mine[:-1]:
        _delete(spark, path)
    # what other steps have shuffled, as of counts, goes when the driver's heap is next collected
    gc.collect()
    spark._jvm.java.lang.System.gc()
    give_back(spark)
    return out


def give_back(spark: SparkSession) -> None:
    """Executors collect their whole heaps and give what is free back to the system. Joins, sorts and
    aggregates take memory in pages that are large for the collector; to place them it was seen to grow the
    heap to 1500 of 1800 MB with a third of that in use, and to keep it so while Python workers need theirs. One
    short task goes to each executor that is idle; in local mode the driver's own collection does it."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return
    executors = sc._jsc.sc().getExecutorMemoryStatus().size() - 1  # it has the driver too
    if executors > 0:
        spark.range(0, executors, 1, executors).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that cut() gave, which nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that go to a Python worker at once, where rows are long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Actions inside send at most so many rows to a Python worker at once; the session's setting is put
    back after them. A smaller one is left as it is."""
    if 0 < int(spark.conf.get(_BATCH)) <= rows:
        yield
        return
    with setting(spark, _BATCH, str(rows)):
        yield


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Actions inside have this setting; the session's own is put back after them."""
    own = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def frugal(part: Callable) -> Callable:
    """part, after which its worker gives back what it has freed: workers live on between tasks and stages,
    and allocators would keep it."""

    def run(batches: Iterator) -> Iterator:
        yield from part(batches)
        release()

    return run


def release() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def unused(name: str, *frames: DataFrame) -> str:
    """name, or with underscores before it, so that none of the frames has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows; else df, for a shuffled join.
    df is a table already written, so that counting it reads footers only."""
    return F.broadcast(df) if df.count() <= max_rows else df


def salted_left_join(big: DataFrame, small: DataFrame, on: list[str], salt_from: Column, salts: int = 16) -> DataFrame:
    """big LEFT JOIN small USING (on), with null-safe keys. A key with a third of all rows of big is
    dealt over `salts` tasks; small, which has a row for each key, is repeated that often."""
    n = salts
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(n)).cast("int"))
    right = small.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in small.columns],
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_r_salt"),
    )
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(right, same & (F.col("_salt") == F.col("_r_salt")), "left").drop(*[f"_r_{c}" for c in on], "_salt", "_r_salt")


def without(docs: DataFrame, losers: DataFrame, id_col: str, key: Column, max_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows whose (id, key) losers (id_col, _key) has; columns of docs unchanged."""
    return _matching(docs, losers, id_col, key, "left_anti", max_rows)


def within(docs: DataFrame, some: DataFrame, id_col: str, key: Column, max_rows: int = 1_000_000) -> DataFrame:
    """docs with only the rows whose (id, key) some (id_col, _key) has; columns of docs unchanged."""
    return _matching(docs, some, id_col, key, "left_semi", max_rows)


def _matching(docs: DataFrame, named: DataFrame, id_col: str, key: Column, how: str, max_rows: int) -> DataFrame:
    own, theirs, its_id = (unused(c, docs) for c in ("own_key", "their_key", "their_id"))
    named = named.select(F.col(id_col).alias(its_id), F.col("_key").alias(theirs))
    at = docs.withColumn(own, key)
    return at.join(if_small(named, max_rows), F.col(id_col).eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(theirs)), how).drop(own)


def one_of_each(docs: DataFrame, repeated: DataFrame, id_col: str, key: Column) -> DataFrame:
    """docs with one row of all that share an (id, key) which repeated (id_col, _key), a table already
    written, names; columns unchanged."""
    if not repeated.count():
        return docs
    own = unused("own_key", docs)
    more = within(docs, repeated, id_col, key).withColumn(own, key).dropDuplicates([id_col, own]).drop(own)
    return without(docs, repeated, id_col, key).unionByName(more)


def text_key(text: Column) -> Column:
    """64 bits that tell rows with one id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null. lower() does the same where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
