"""What the text operators share: reading, written tables, Arrow text buffers and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import glob
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text makes a step of its own.
STEP_BYTES = 1 << 19
#: Rows and bytes that Spark sends to Python at once: bounds the worker's memory when texts are long.
ARROW_ROWS, ARROW_BYTES = "400", str(2 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in local mode alone, a local one for tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "/tmp/checkpoints/soldlens"


def stash(df: DataFrame, label: str, by: str | None = None, per_file: int = 0) -> DataFrame:
    """df written as Parquet in the shared folder and reread: cuts lineage, survives lost executors. per_file: rows of a file at most, for large ones."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/soldlens-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).option("maxRecordsPerFile", per_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._soldlens_path = path
    return out


def folder(df: DataFrame) -> str:
    """The folder of a stashed table."""
    return df._soldlens_path


def discard(df: DataFrame) -> None:
    """Deletes the files of a stashed table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(df))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files whose tables are gone: it does so once the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with bounded batches; fn maps an iterator of record batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: _tidy(fn, batches), schema)


def one_blas_thread() -> None:
    """Matrix products in this process take one thread: tasks fill the cores already, and waiting threads would only burn time."""
    for lib in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        loaded = ctypes.CDLL(lib)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            with contextlib.suppress(AttributeError):
                getattr(loaded, name)(1)


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and what one stage took would add up with the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _tidy(fn, batches):
    try:
        yield from fn(batches)
    finally:
        give_back()


def arrow_column(fn, kind: str, *columns: Column) -> Column:
    """A column made from others by fn, which maps an iterator of Arrow arrays (tuples of them for several columns); all else stays in the JVM."""
    if len(columns) == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from _tidy(fn, batches)

        return F.arrow_udf(one, kind)(*columns)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from _tidy(fn, batches)

    return F.arrow_udf(many, kind)(*columns)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that Spark sends to Python by rows and bytes."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def text_of(column: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its UTF-8 bytes and row offsets, without a copy; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text each."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 4096), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_table(separators: set[int]) -> np.ndarray:
    """Byte classes: A-Z lower-cased, separators as a blank, all else itself."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for b in separators:
        t[b] = 32
    return t


#: Words as [^\x20\x09-\x0D]+ and as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
BY_SPACE = word_table({32, *range(9, 14)})
BY_ALNUM = word_table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the rows: bytes by class, begins, ends, and the words before each row (rows + 1)."""
    a = table[data]
    if not len(a):
        z = np.zeros(0, np.int64)
        return a, z, z, np.zeros(len(offsets), np.int64)
    solid = a != 32
    first = np.zeros(len(a) + 1, bool)
    first[offsets] = True
    before = np.empty(len(a), bool)
    before[0] = False
    before[1:] = solid[:-1]
    begins = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(a), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return a, begins, ends, np.searchsorted(begins, offsets)


def hashes(a: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[a] * _power(_R, len(a)), out=total[1:])
    h = (total[ends] - total[begins]) * _power(_R_INV, len(a))[begins]
    return mix(h ^ (ends - begins).astype(np.uint64))
