"""Small shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import vigil
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from vigil.session import checkpoint_dir, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


#: Rows of texts, and bytes of any rows, that go to a Python worker at once.
BATCH, BATCH_BYTES = 1000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Prepare a session for these operators: batches of few rows and bytes, as texts can be long (unless the session sets
    its own), and this package on the executors' Python workers, once per application."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(vigil.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="vigil-package-"), "vigil_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("vigil", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Survives lost executors; the rows are computed once however often they are read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more (it does so when the driver's
    garbage is collected, which may otherwise be long after a step)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read again.

    Takes less disk than a checkpoint; the table is deleted when the application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # nothing else reads this write's shuffle files
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id, n: int):
    """``crc32(text of doc_id) mod n`` as used for held-out folds; null ids get null."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % n


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null reads as empty."""
    return [t or "" for t in column.to_pylist()]


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, StructType]:
    """``keep`` columns of ``docs`` and its text, once; the name of the column that holds the text; the schema of ``keep``.

    ``keep`` must not name a column that the operator adds; ``packed`` puts any columns out of the way."""
    own = "text" in keep and docs.schema["text"].dataType == StringType()
    df = docs.select(*keep) if own else docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return df, "text" if own else "_text", StructType(df.schema.fields[:len(keep)])


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """doc_id, text, the columns that an operator ``read``s and all but the text as one struct ``row``, so that no name
    clashes with what an operator adds."""
    rest = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *read, F.struct("doc_id", *rest).alias("row"))


def unpacked(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """``columns`` of a frame that comes from ``packed``; those in ``new`` are taken from its expressions."""
    return df.select(*(new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns))


def lean(run, *caches):
    """``run`` for ``mapInArrow``, whose worker gives its memory back when the task ends: Spark keeps workers for later
    tasks, beside which what they hold counts."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # no glibc
                ctypes.CDLL(None).malloc_trim(0)

    return task


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds at most ``limit`` bytes (one longer row alone)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        lo = total = 0
        for i, n in enumerate(size):
            if i > lo and total + n > limit:
                yield b.slice(lo, i - lo)
                lo, total = i, 0
            total += n
        yield b.slice(lo)
