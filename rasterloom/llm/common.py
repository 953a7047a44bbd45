"""Shared helpers: reading tables, shared scratch tables and small integer hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space in every contract of this package.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()

_OWN_DIR: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is opened by Spark's reader alone, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``, else the context's checkpoint folder. Where neither is
    set, a local master (tests on one machine) gets a temporary folder, and a cluster an error: a folder
    of each machine's own would lose rows.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    return _OWN_DIR[app]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, *, batch: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Lineage ends there: a lost executor costs a read of the table, no recomputation. Values
    which are not functions of the row alone (row numbers) are fixed from then on. Spark deletes the
    shuffle files of the write as it ends. Tables are deleted by ``discard`` as soon as what needs them
    has been written itself, else when the session ends or by ``cleanup``. ``batch`` bounds the rows of the
    Arrow batches that the write's tasks hold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterloom-{name}-{uuid.uuid4().hex}"
    with _set(spark, {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {})):
        df.write.option("compression", "zstd").parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        _TABLES[app] = []
        atexit.register(cleanup, spark)
    _TABLES[app].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def again(table: DataFrame) -> DataFrame:
    """A table of ``materialize`` read anew, with columns of its own, for plans that read it twice."""
    return table.sparkSession.read.schema(table.schema).parquet(table.scratch_path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no plan yet to be run reads."""
    for df in tables:
        spark, path = df.sparkSession, df.scratch_path
        _TABLES[spark.sparkContext.applicationId].remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hash_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """Rows of ``rows`` whose 64-bit hash ``key`` is among the least, with ``__key``: about ``1.2 * most`` different keys.

    The limit comes from an estimate of the number of different keys, so no task sends more than its
    share, and repeated rows don't crowd out others.
    """
    keyed = rows.withColumn("__key", key)
    n = keyed.agg(F.approx_count_distinct("__key", 0.02)).first()[0]
    share = min(1.0, 1.2 * most / max(1, n))
    return keyed.filter(F.col("__key") <= int(-(1 << 63) + share * ((1 << 64) - 1025))) if share < 1 else keyed


def small(table: DataFrame, most: int = 500_000) -> DataFrame:
    """``table`` with a hint to broadcast it if it has at most ``most`` rows, which are to be narrow; else as it is."""
    return F.broadcast(table) if table.count() <= most else table


def with_keys(docs: DataFrame) -> DataFrame:
    """``row``, the whole row as one value, so that no column can clash, and two 64-bit hashes of its id and text."""
    doc = docs["doc_id"].cast("long")
    keys = [F.xxhash64(F.lit(k), doc.isNull(), doc, docs["text"].isNull(), docs["text"]).alias(f"key{k}") for k in (1, 2)]
    return docs.select(F.struct(*docs.columns).alias("row"), *keys)


def without(keyed: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``with_keys`` without those that ``decided(key1, key2, kept)``, a table, lets go.

    ``decided`` has a row for each of the rows that it is about. Of rows with the same keys, one is kept.
    """
    judged = materialize(decided.groupBy("key1", "key2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")).filter("NOT kept OR times > 1"), "judged")
    discard(decided)
    kept = keyed.join(small(judged.select("key1", "key2")), ["key1", "key2"], "left_anti").select("row")
    once = judged.filter("kept").select("key1", "key2")
    if not once.isEmpty():
        kept = kept.union(keyed.join(small(once), ["key1", "key2"]).dropDuplicates(["key1", "key2"]).select("row"))
    return kept.select("row.*")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``counts`` with the largest ``n``, as many as fit in ``most`` without cutting through like counts.

    The limit is found in a histogram of the counts' logarithms, which has some thousands of rows
    at most, so no task sends more than its share of the result.
    """
    level = F.floor(F.log2("n") * 64).cast("int")
    held, least = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote in this session and that are still there."""
    try:
        for path in _TABLES.pop(spark.sparkContext.applicationId, []):
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the shared folder is the cluster's to clear
        return


def tidy() -> None:
    """Give back the memory that an earlier task of this worker process has freed; to be called as a task begins."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    """The named columns of an Arrow batch."""
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def flat_list(values: np.ndarray, lengths: np.ndarray | list[int], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from its flat values and the rows' lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
