"""A cache of tile bytes, one file for each key, on any path that is mounted everywhere tasks run.

Writes go to a temporary name and are renamed, so a reader never sees half a file, and two tasks
that write one key leave one whole file.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequestError


def shared_folder(spark: SparkSession) -> str:
    """A path that is mounted on the driver and wherever tasks run: ``spark.checkpoint.dir``; on a local master a temporary folder will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at and at.startswith(("/", "file:")):
        return "/" + at.removeprefix("file:").strip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise InvalidRequestError("set spark.checkpoint.dir to a folder that is mounted everywhere")
    return tempfile.mkdtemp(prefix="rasterloom-")


def _path(folder: str, key: str) -> Path:
    return Path(folder) / f"{key}.tile"


def read(folder: str, key: str) -> bytes | None:
    """The bytes of a key, or None."""
    try:
        return _path(folder, key).read_bytes() or None
    except FileNotFoundError:
        return None


def write(folder: str, key: str, data: bytes) -> None:
    """Store non-empty bytes."""
    if not data:
        return
    path = _path(folder, key)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_bytes(data)
    os.replace(part, path)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """``cache_key, data`` of all non-empty entries; key and length come without reading bytes that aren't selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tile").load(folder)
    return files.filter("length > 0").select(F.regexp_extract("path", r"([^/]+)\.tile$", 1).alias("cache_key"), F.col("content").alias("data"))


def hits(plan: DataFrame, cached: DataFrame) -> DataFrame:
    """Planned tiles with their cached bytes; an equi-join on the key."""
    return plan.join(cached, "cache_key")


def misses(plan: DataFrame, cached: DataFrame) -> DataFrame:
    """Planned tiles that have to be fetched."""
    return plan.join(cached.select("cache_key"), "cache_key", "left_anti")


def save_tile(data: bytes, success: bool, path: str) -> bool:
    """Write a response's bytes; False for a failed response or an unwritable path, never an exception."""
    if not success:
        return False
    try:
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
        return True
    except OSError:
        return False


def save_tiles(responses: DataFrame, folder: str) -> DataFrame:
    """Write each row (name, data, success) under ``folder`` in the tasks; ``name, saved``."""

    def save(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            done = [save_tile(bytes(r["data"] or b""), bool(r["success"]), f"{folder}/{r['name']}") for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["name"] for r in rows], pa.string()), pa.array(done, pa.bool_())], ["name", "saved"])

    return responses.select("name", "data", "success").mapInArrow(save, "name string, saved boolean")
