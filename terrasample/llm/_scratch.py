"""Shared-folder scratch tables, bitmaps and small column helpers."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes of an Arrow batch, but for single rows that have more.
BATCH_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``. Only where that is unset and all runs in one process,
    as in tests, a temporary folder is made, and the setting filled in for later calls."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="terrasample-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def arrow_batches(spark: SparkSession, rows: int) -> None:
    """Keep Arrow batches of long texts small enough for a Python worker."""
    for key, most in ((ARROW_ROWS, rows), (ARROW_BYTES, BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_MADE: list[Scratch] = []


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Whatever scratch folders are made meanwhile are removed at the end; what was read from them must be written by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        for scratch in _MADE[before:]:
            remove(scratch.spark, scratch.root)
        del _MADE[before:]


class Scratch:
    """Tables written below the shared folder, so that a lost executor costs no recomputation; ``drop``
    removes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _MADE.append(self)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with setting(self.spark, CLEANUP, "true"):  # what a table was made from is not read again
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def settle(self) -> None:
        settle(self.spark)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, table._scratch_path)


def settle(spark: SparkSession) -> None:
    """Let go of plans and broadcasts of steps whose results are written. Python's references to them go first, then the
    driver's; without it they stay until its heap is full. Then the driver's C allocator gives back what its threads have
    freed, and the executors collect their garbage. Nothing but memory depends on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)
    collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    """A full collection on the executors, by a task for each of their cores: their heaps shrink to what is in use. Else they
    keep the size that the step before had grown them to, mostly with freed pages of its sorts and aggregations."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def trim(spark: SparkSession) -> str | None:
    """What the JVM says of trimming its native heap; None where it has no such command."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    # by the interface's method: the server's own class is closed to reflection
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = new(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return None


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores added until no column of the input has that name (in any case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; a missing one is an error that names it."""
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"column '{c}' is missing; there are {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


# --- bitmaps ------------------------------------------------------------------------------------
#: Bits of a bitmap for a key, least and most bits (64 MiB): what a bitmap broadcasts is bounded. Users of a bitmap are exact
#: whatever it lets through by chance; beyond ``CAPACITY`` keys, where that would be much, they have another way.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29
CAPACITY = MOST_BITS // BITS_PER_KEY
#: Bytes of a bitmap that come to the driver at once, by a job each.
PIECE_BYTES = 4 << 20


@dataclass
class Bitmap:
    """Which 64-bit hashes may be in a set, by their top ``width`` bits."""

    width: int
    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes.view(np.uint64) >> np.uint64(64 - self.width)
        return (self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def any(self) -> bool:
        return bool(self.bits.any())


def bitmap_of(keys: DataFrame, column: str, count: int) -> Bitmap:
    """Bitmap of a column of ``count`` 64-bit hashes; built by Spark, MOST_BITS / 8 bytes at most. Its finished pieces are dealt to
    partitions by their bytes: the iterator runs a job for each, which would else be as many as there are shuffle partitions."""
    width = (min(MOST_BITS, max(LEAST_BITS, count * BITS_PER_KEY)) - 1).bit_length()
    cell = F.shiftrightunsigned(F.col(column), 64 - width).cast("long") + 1
    rows = (
        keys.select(cell.alias("cell"))
        .groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits"))
        .repartition(-(-(1 << width) // (8 * PIECE_BYTES)))
        .toLocalIterator()
    )
    out = np.zeros(max(1 << width, 1 << 20) // 8, dtype=np.uint8)
    for r in rows:
        piece = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(piece)] = piece[: len(out) - at]
    return Bitmap(width, out)
