"""What several of these operators share: the shared folder, stored intermediate tables, byte-exact words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the control characters 09-0D, on UTF-8 bytes: what bytes.split() gives.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a temporary one only on a local master."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # a local cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayfarer-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: computed once, its lineage cut, safe from lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def forget(*tables: DataFrame) -> None:
    """Removes stored() tables once all that reads them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of df by name, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that df has no column of."""
    lead, taken = "__", {c.lower() for c in df.columns}
    while any(lead + w in taken for w in wanted):
        lead += "_"
    return [lead + w for w in wanted]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    return text_or_empty(name).cast("binary")


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds up to `most` bytes of a text column, or one row: workers hold no more at a time."""
    for batch in batches:
        begin = size = 0
        for k, x in enumerate(batch.column(column)):
            n = x.as_buffer().size if x.is_valid else 0
            if k > begin and size + n > most:
                yield batch.slice(begin, k - begin)
                begin, size = k, 0
            size += n
        if batch.num_rows > begin:
            yield batch.slice(begin)


def freeing(run: Callable) -> Callable:
    """A mapInArrow function that hands its memory back when a task ends: workers live on beside the executor's heap."""

    def freed(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return freed


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 4_000_000) -> Iterator[None]:
    """What runs inside hands workers batches of about `size` bytes, not of 10,000 rows however long their texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers = np.ones(1, np.uint64)


def run_hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of codes, bytes or code points, that begin at starts and follow each other; none is empty."""
    global _powers
    if not len(starts):
        return np.zeros(0, np.uint64)
    if sizes.max() > len(_powers):
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * int(sizes.max()), _BASE, np.uint64))])
    x = (codes.astype(np.uint64) + np.uint64(1)) * _MIX1
    x = (x ^ (x >> np.uint64(31))) * _powers[np.arange(len(codes)) - np.repeat(starts, sizes)]
    x = (np.add.reduceat(x, starts) + sizes.astype(np.uint64)) * _MIX2
    return x ^ (x >> np.uint64(32))
