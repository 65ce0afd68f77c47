"""Sources and sinks (IO1-IO18).

Readers always take an explicit schema where one is known (no inference pass
over the data), and sinks never overwrite a path that is being read: a
rewrite goes to a new path.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.schema import UNIFIED_COLUMNS, UNIFIED_SCHEMA


def _schema_or_ddl(schema):
    return schema if schema is None or isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def load_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """IO1: Parquet scan; a missing path gives an empty table (with ``schema``)."""
    try:
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], _schema_or_ddl(schema) or T.StructType([]))
        raise


def load_hub(spark: SparkSession, path: str, columns: list | None = None) -> DataFrame:
    """IO2: hub scan keeping only the known columns that exist.

    The projection is pushed into the Parquet scan (``ReadSchema``)."""
    df = load_parquet(spark, path)
    keep = [c for c in (columns or UNIFIED_COLUMNS) if c in df.columns]
    return df.select(*keep)


def read_tsv(spark: SparkSession, path: str, names: list, encoding: str = "UTF-8") -> DataFrame:
    """IO3: tab-separated text, header row replaced by ``names`` (positional),
    every value a string, null -> ''.  ``NA`` stays the text ``NA``."""
    sch = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (spark.read.option("sep", "\t").option("header", True).option("encoding", encoding)
          .schema(sch).csv(path))
    return df.fillna("")


def read_csv_strings(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """IO4/IO5/IO6: CSV with a header, every value a string (no inference).
    A UTF-8 byte-order mark on the header is dropped by the reader.  Large
    files are split; ``multi_line`` (quoted values with line breaks) reads a
    file as a whole and is only for where it is needed."""
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("encoding", encoding).option("multiLine", multi_line).csv(path))


def explode_envelope(df: DataFrame, service: str) -> DataFrame:
    """IO7: rows of ``{service: {row: [...]}, RESULT: {...}}`` pages.

    Missing service key, empty array or a null array give zero rows (explode
    drops them), so a "no data" page contributes nothing."""
    if service not in df.columns:
        return df.limit(0).select(F.lit(None).alias("_empty")).filter(F.lit(False))
    return df.select(F.explode(F.col(service).getField("row")).alias("r")).select("r.*")


def read_envelope(spark: SparkSession, path: str, service: str, row_schema: T.StructType) -> DataFrame:
    """IO7 from landed JSON files (one page per file)."""
    sch = T.StructType([
        T.StructField(service, T.StructType([T.StructField("row", T.ArrayType(row_schema))])),
        T.StructField("RESULT", T.StructType([T.StructField("MSG", T.StringType())])),
    ])
    return explode_envelope(spark.read.schema(sch).option("multiLine", True).json(path), service)


def append(df: DataFrame, path: str, partition_by: list | None = None) -> int:
    """IO13/IO15: append without dedup; returns rows written.

    The row count is taken by an ``observe`` on the written plan, so the data
    is scanned once."""
    from pyspark.sql import Observation

    obs = Observation(f"append_{uuid.uuid4().hex[:8]}")
    w = df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return int(obs.get.get("n", 0))


def rewrite(df: DataFrame, target: str, compression: str = "snappy", partition_by: list | None = None) -> str:
    """IO14: write a table's next state to ``target``, a path of the caller's
    choice that must not exist yet, so what is being read is never overwritten
    and of two writers of one target the second fails.  Which path is current
    is the caller's (or a catalogue table's) business."""
    df.write.mode("errorifexists").option("compression", compression).partitionBy(*partition_by or []).parquet(target)
    return target


class LostRace(RuntimeError):
    """Another writer has published the version first."""


def _files(spark: SparkSession, root: str):
    """(file system, Hadoop path maker) of a table's folder."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def current_version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """IO14: number and data path of the version that readers of the table ``root`` see (0, None before the first).

    Each version has one small pointer file that names its data.  A pointer that is still empty is being
    written or was left by a writer that died: the version before it stays current."""
    fs, path = _files(spark, root)
    pointers = path(root, "versions")
    if not fs.exists(pointers):
        return 0, None
    for status in sorted(fs.listStatus(pointers), key=lambda f: -int(f.getPath().getName())):
        stream = fs.open(status.getPath())
        try:
            name = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if name:
            return int(status.getPath().getName()), f"{root}/data/{name}"
    return 0, None


def read_current(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """IO14: the table's current version; an empty table (with ``schema``) before the first."""
    _, data = current_version(spark, root)
    return load_parquet(spark, data or f"{root}/data/none", schema)


def publish(df: DataFrame, root: str, compression: str = "snappy", partition_by: list | None = None) -> int:
    """IO14: write the table's next version, then swap the pointer to it; returns its number.

    The data goes to a folder of its own first, so a crash before the swap leaves the current version as it was.
    The pointer's number is the one after the version that was current when the call began, and its file is
    created only if there is none: of two writers that began from one version the second gets
    ``LostRace`` and may begin again from what is current then."""
    spark = df.sparkSession
    fs, path = _files(spark, root)
    began, _ = current_version(spark, root)
    name = uuid.uuid4().hex
    rewrite(df, f"{root}/data/{name}", compression, **({"partition_by": partition_by} if partition_by else {}))
    number = began + 1
    while (pointer := path(root, f"versions/{number}")) and fs.exists(pointer) and fs.getFileStatus(pointer).getLen() == 0:
        number += 1  # left by a writer that died; it never becomes current
    try:
        stream = fs.create(pointer, False)
    except Exception as e:
        if fs.exists(pointer):
            raise LostRace(f"version {number} of {root} is there already") from e
        raise
    stream.write(bytearray(name.encode()))
    stream.close()
    return number


def clear_table(spark: SparkSession, target: str, schema: T.StructType = UNIFIED_SCHEMA) -> str:
    """IO18: the empty next state of a table."""
    return rewrite(spark.createDataFrame([], schema), target)


def export_csv_bom(df: DataFrame, path: str, single_file: bool = False) -> None:
    """IO16: CSV for spreadsheets, UTF-8 with a byte-order mark.

    The mark is prepended to the first header name, and Spark writes the
    header into every part file, so every part file starts with the mark and
    opens correctly on its own.  ``single_file=True`` (the dashboard download
    of a display-capped view) coalesces to one part; large exports keep their
    partitioning and are written in parallel."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def run_report(spark: SparkSession, source: str, n_rows: int, run_id: str | None = None) -> DataFrame:
    """IO17: one-row run report (source, rows, run time) to append to a ``runs`` table."""
    return spark.createDataFrame(
        [(run_id or uuid.uuid4().hex, source, int(n_rows))],
        "run_id string, source string, n_rows long",
    ).withColumn("run_at", F.current_timestamp())
