"""Shared plumbing: the shared work folder, table materialisation and zero-copy text arrays."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_TABLES: dict = {}
#: Functions that empty caches of other modules, and the operator that this worker process serves.
CACHES: list[Callable[[], None]] = []
_serving: list[str] = [""]
_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the engine's byte-wise lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def work_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local session may do without: one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="chunkloom-"))
        at = _own[0]
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Remove every scratch table written so far."""
    while _written:
        spark, path = _written.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended, and its folder with it
            return


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    free: have the shuffle files of the finished job removed now rather than at the driver's next full collection.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        drop_path(table.sparkSession, path)


#: Bits of a key filter: 8 MB however many keys it holds; fuller filters let more rows through, and none is lost.
FILTER_BITS = 1 << 26
_PER_ROW = 1 << 15


def key_filter(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap over 64-bit keys as a written table of at most FILTER_BITS / 32768 rows of 4 KB."""
    place = F.pmod(key, F.lit(FILTER_BITS))
    placed = keys.select(place.alias("place")).select((F.col("place") / _PER_ROW).cast("long").alias("part"), F.pmod("place", F.lit(_PER_ROW)).alias("bit"))
    return materialize(placed.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")), "key-filter")


def maybe_in(rows: DataFrame, key: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """rows with a column `name`: false where the key is not among the filter's, true where it may be."""
    place = F.pmod(key, F.lit(FILTER_BITS))
    bit = F.pmod(place, F.lit(_PER_ROW)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(bitmap), (place / _PER_ROW).cast("long") == F.col("part"), "left")
    return joined.withColumn(name, F.coalesce(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8))) % 2 == 1, F.lit(False))).drop("part", "bits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the rows that a Python worker is sent at once; Spark by itself counts rows only, and 10,000 texts may be anything.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold BATCH_BYTES, or a single row; a bound that is set already stays.

    Executors buffer a batch in memory outside the heap, and a worker holds it several times over as Python objects.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass
class Texts:
    """UTF-8 bytes of some consecutive rows: row i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def row(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def text_slices(column: pa.Array, max_bytes: int = 2 << 20) -> Iterator[Texts]:
    """Cut an Arrow string column into runs of whole rows of about max_bytes (a longer row stands alone).

    Nulls read as empty. Nothing is copied: the arrays look into the Arrow buffers.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, body = column.buffers()
    offsets = np.frombuffer(offs, np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield Texts(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def trim() -> None:
    """Give freed memory back to the system: a worker process is kept, and serves other stages after this one."""
    if "libc" not in _TABLES:
        try:
            _TABLES["libc"] = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _TABLES["libc"] = lambda _: 0
    _TABLES["libc"](0)


def serve(operator: str) -> None:
    """Called as a task begins: what a kept worker process has cached for another operator goes, its own tables stay."""
    if _serving[0] != operator:
        _serving[0] = operator
        for clear in CACHES:
            clear()
        for key in [k for k in _TABLES if k != "libc"]:
            del _TABLES[key]
        gc.collect()
        trim()


def mix64(z: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the well-known splitmix constants)."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** k mod 2 ** 64 for k < n."""
    have = _TABLES.get(("pow", base))
    if have is None or len(have) < n:
        have = np.ones(1 << max(16, int(n - 1).bit_length()), np.uint64)
        have[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _TABLES[("pow", base)] = have
    return have[:n]


def byte_values(seed: int) -> np.ndarray:
    """256 fixed random 64-bit values for the bytes."""
    key = ("bytes", seed)
    if key not in _TABLES:
        _TABLES[key] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
    return _TABLES[key]


class KeyTable:
    """Open-addressing hash table from non-negative 64-bit keys to their row numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.rows = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.rows[slot[won]] = won
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.rows[slot], -1)
        todo = np.flatnonzero((at != keys) & (at >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.rows[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out


BASE, INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def prefix_hash(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """h with h[i] = sum over k < i of value(data[k]) * BASE ** k, so any substring hash is one subtraction."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(seed)[data] * powers(BASE, len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end] from prefix_hash(data), independent of where it stands."""
    inv = powers(INVERSE, len(h))
    return mix64((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
