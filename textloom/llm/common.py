"""What several operators of this subpackage share: tables, scratch space, row identity, marks of rows, hashing of ids."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few fixed-width columns that may still be broadcast; beyond it a shuffle join runs.
BROADCAST_ROWS = 500_000
#: Blocks of 1024 rows whose marks may be broadcast, some 200 bytes each: 200 million rows.
BROADCAST_BLOCKS = 200_000
#: Characters that part words in every contract of this package, for use inside a bracket.
SPACE = r"\x20\x09-\x0D"
#: What tells a row apart: the hash of its file's path and its place in the file, the same in every scan.
RID = "struct<file: long, row: long>"

_scratch: dict[str, str] = {}
_paths: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); where none is named, in a temporary
    folder of a local master, and an error on a cluster, whose executors don't share their folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _scratch:
            _scratch[app] = tempfile.mkdtemp(prefix="textloom-")
            atexit.register(shutil.rmtree, _scratch[app], ignore_errors=True)
        base = _scratch[app]
    return f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads neither recompute it nor depend on any executor."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark))
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    _paths.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that no result reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._textloom_path)
        _paths.remove(df._textloom_path)


def settle(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of steps that nothing refers to any more; it learns of them when the driver's JVM
    collects its garbage, first of the plans, then of what only they referred to."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that ``written`` has made; to be called when no result is needed any more."""
    while _paths:
        _delete(spark, _paths.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def stable(docs: DataFrame) -> DataFrame:
    """docs itself if it is a plain scan of Parquet files, whose rows ``rid`` can tell apart, else docs written once."""
    with contextlib.suppress(AnalysisException):
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        node = docs._jdf.queryExecution().optimizedPlan()
        while node.nodeName() in ("Project", "Filter") and node.deterministic():
            node = node.children().head()
        if node.nodeName() == "LogicalRelation":
            roots = node.relation().location().rootPaths()
            if roots.distinct().size() == roots.size():
                return docs
    return written(docs)


def rid(docs: DataFrame) -> Column:
    """RID of each row of a ``stable`` table; it depends neither on splits nor on executors or settings."""
    meta = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"))


def marks(rows: DataFrame, most: int = 1) -> DataFrame:
    """Bitmaps of rows (rid, value long from 0 to ``most``; without the column value each row has 1), by blocks of 1024
    rows of a file: file, block, and 16 words for each bit of the values."""
    value = F.col("value") if "value" in rows.columns else F.lit(1)
    at = rows.select(F.col("rid.file").alias("file"), F.shiftright("rid.row", 10).alias("block"), F.shiftright("rid.row", 6).bitwiseAND(15).alias("word"), F.expr("shiftleft(1L, cast(rid.row & 63 as int))").alias("bit"), value.cast("long").alias("value"))
    words = [F.coalesce(F.bit_or(F.when((F.col("word") == w) & (F.shiftright("value", b).bitwiseAND(1) == 1), F.col("bit"))), F.lit(0)).alias(f"w{b}_{w}") for b in range(most.bit_length()) for w in range(16)]
    return written(at.groupBy("file", "block").agg(*words))


def marked(docs: DataFrame, of: DataFrame, most: int = 1) -> tuple[DataFrame, str, str]:
    """(docs with columns of each row's rid and value, their names). docs: stable; of: what ``marks`` made.

    Marks take a bit or two a row, so whole texts aren't shuffled to meet them up to BROADCAST_BLOCKS; beyond, they are.
    """
    file, block, row, key, name, *own = fresh(docs, "file_", "block_", "row_", "rid_", "value_", *of.columns)
    spelled = of.select(F.col("file").alias(file), F.col("block").alias(block), *[F.col(c).alias(n) for c, n in zip(of.columns[2:], own[2:], strict=True)])
    where = rid(docs)
    placed = docs.withColumns({key: where, file: where["file"], block: F.shiftright(where["row"], 10), row: where["row"]})
    joined = placed.join(small(spelled, BROADCAST_BLOCKS), [file, block], "left")
    planes = range(most.bit_length())
    held = {f"{name}{b}": F.get(F.array(*[F.col(n) for n in own[2 + 16 * b : 18 + 16 * b]]), F.shiftright(F.col(row), 6).bitwiseAND(15).cast("int")) for b in planes}
    joined = joined.withColumns(held)
    value = reduce(lambda x, y: x + y, [F.expr(f"shiftleft(cast(shiftright(coalesce(`{name}{b}`, 0L), cast(`{row}` & 63 as int)) & 1 as long), {b})") for b in planes])
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], key, value.alias(name)), key, name


def kept(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, a stable table, without the rows whose rid ``gone`` has."""
    out, key, value = marked(docs, marks(gone))
    return out.where(F.col(value) == 0).drop(key, value)


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Has workers get rows in batches of so many bytes, for what is written inside; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def slim_batches(spark: SparkSession, size: str = "6m") -> None:
    """Has workers get whole texts in small batches from now on; for results that are computed when the caller asks."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most ``rows`` rows, else as it is, for a shuffle join that AQE can split."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def body(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def remainder(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))
