"""What the operators share: session folders, Arrow text buffers, rolling hashes, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _FALLBACK.setdefault(app, "file://" + tempfile.mkdtemp(prefix="stepweave-"))
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a Parquet table in the shared folder and reads it back: later stages restart from it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stepweave-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of materialize() that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that workers get by bytes: ten thousand long texts do not fit in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # for workers that start elsewhere
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; a null text counts as empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column laid end to end, and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_blocks(column: pa.Array, most: int = 1 << 20):
    """(first, last, bytes, offsets) of runs of texts with about `most` bytes; a longer text is a run of its own."""
    raw, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    trim()


CACHES: dict = {}  # of this worker process: what later tasks of the same operator may use again


def forget() -> None:
    """Drops the worker's caches; an operator that has no use for them calls it before it needs the room."""
    CACHES.clear()
    trim()


def trim() -> None:
    """Gives freed memory back to the system: a worker outlives its tasks, and others need the room."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(int(ODD), -1, 1 << 64))
TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64 for i <= n."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((ODD, _ODD_INV)):
            grown = np.full(max(n + 1, 1 << 16), base, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.cumprod(grown, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """n + 1 sums from which slice_hash() takes the 64-bit hash of any slice; symbols: uint64."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end]; equal slices have equal hashes wherever they lie."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of byte runs other than space and tab to carriage return: hash, start, end, and per text the first word's number (n + 1)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    head[begins] = inside[begins]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    tail[last] = inside[last]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    hashes = slice_hash(prefix_hash(TABLE[_LOWER[raw] if lower else raw]), start, end)
    return hashes, start, end, np.searchsorted(start, at)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] numbers, then the same of the next one."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


class HashCache:
    """Values of 64-bit keys in a direct-mapped table of fixed size; what does not fit is computed again."""

    def __init__(self, bits: int, *dtypes):
        self.shift, self.keys = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64)
        self.values = [np.zeros(1 << bits, d) for d in dtypes]

    def look_up(self, keys: np.ndarray, compute) -> list[np.ndarray]:
        """compute(positions of distinct missing keys) -> a list of value arrays."""
        slot = (keys * np.uint64(0xC2B2AE3D27D4EB4F)) >> self.shift
        miss = np.flatnonzero(self.keys[slot] != keys)
        out = [v[slot] for v in self.values]
        if len(miss):
            unique, first, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
            found = compute(miss[first])
            at = slot[miss[first]]
            self.keys[at] = unique
            for o, v, f in zip(out, self.values, found, strict=True):
                o[miss] = f[inverse]
                v[at] = f
        return out
