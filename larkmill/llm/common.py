"""Helpers shared by the training-data operators.

Rules every operator here keeps:

* Only the columns an operator needs are read; other columns, whatever their
  names, never meet the operator's own.
* A null text counts as empty; an empty table gives an empty result.
* Driver-side state is bounded by a parameter, never by the number of documents.
* Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``.
* Settings of the caller's session stay as they are; batches are cut to size within an operator.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.session import ship

#: Bytes of text that an operator looks at together.
PART_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may have none set: it gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and held.isDefined():
        path = held.get()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="larkmill-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables(spark).append(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._larkmill_path = path
    return back


def again(table: DataFrame) -> DataFrame:
    """A table of :func:`materialize` as another relation, to be met by one made of itself."""
    return table.sparkSession.read.schema(table.schema).parquet(table._larkmill_path)


def _tables(spark: SparkSession) -> list[str]:
    return spark.sparkContext.__dict__.setdefault("_larkmill_tables", [])


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete intermediate tables of :func:`materialize` that nothing lazy is going to read any more."""
    for df in tables:
        if path := getattr(df, "_larkmill_path", None):
            _tables(df.sparkSession).remove(path)
            _delete(df.sparkSession, path)


def discard(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the intermediate tables written after the first ``since``, but for ``keep``; results that were not stored can't be read afterwards."""
    kept = getattr(keep, "_larkmill_path", None)
    held = _tables(spark)
    for path in [p for p in held[since:] if p != kept]:
        held.remove(path)
        _delete(spark, path)


def written(spark: SparkSession) -> int:
    """How many intermediate tables there are."""
    return len(_tables(spark))


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing can read any more, else they stay until the driver's heap is full; give back what the driver has freed."""
    gc.collect()
    _give_back()
    spark.sparkContext._jvm.System.gc()


def prepare(spark: SparkSession) -> None:
    """What every operator needs before its Python code runs on executors."""
    ship(spark)


def _give_back() -> None:
    """Return memory that was freed to the system; allocators keep it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run):
    """``run``, a function over batches, that leaves no freed memory behind when a task ends: its worker stays for other tasks and other operators."""

    def tidy_run(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidy_run


def parts(batches, column: int | str, limit: int = PART_BYTES):
    """Consecutive pieces of batches, each with about ``limit`` bytes in a string or binary column, one row at least."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.binary_length(batch.column(column)).fill_null(0)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
            for a, b in slices(offsets, limit):
                yield batch.slice(a, b - a)


def fold(doc_id: str = "doc_id", modulus: int = 5):
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_bytes(column: pa.Array) -> list[bytes]:
    """Every text as UTF-8 bytes; nulls are empty."""
    data, offsets = text_buffer(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


#: A-Z to a-z, the rest as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over unsigned 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length()) if n else 1 << 12
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run [start, end): polynomial modulo 2**64, finalized."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


#: A prime below 2**31: products of two residues fit 64 bits.
_PRIME = np.uint64((1 << 31) - 1)
_ROOT = 1_402_024_253


def _prime_powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % _PRIME
        done, step = done + more, step * step % int(_PRIME)
    return out


_PRIME_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prime_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """31-bit hash of each run of unsigned values: a polynomial modulo a prime, independent of :func:`run_hashes`."""
    n = len(values)
    size = 1 << max(12, int(n).bit_length())
    if size not in _PRIME_POWERS:
        _PRIME_POWERS.clear()
        _PRIME_POWERS[size] = _prime_powers(size, _ROOT), _prime_powers(size, pow(_ROOT, -1, int(_PRIME)))
    up, down = _PRIME_POWERS[size]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) % _PRIME + np.uint64(1)) * up[:n] % _PRIME, out=sums[1:])
    return (sums[ends] - sums[starts]) % _PRIME * down[starts] % _PRIME


#: From this length on there are known pairs of inputs that a polynomial modulo 2**64 can't tell apart.
_LONG_RUN = 512


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run; of long ones a cryptographic digest, so that no well-known input breaks it."""
    out = run_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts >= _LONG_RUN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_runs(data: np.ndarray, is_word: np.ndarray, offsets: np.ndarray):
    """Maximal runs of word bytes that stay inside one text: starts, ends, and runs before each text."""
    mask = is_word[data].view(np.int8)
    n = len(data)
    step = np.empty(n + 1, np.int8)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    step[0], step[n] = mask[0], -mask[-1]
    np.subtract(mask[1:], mask[:-1], out=step[1:n])
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    joined = inner[(mask[inner] == 1) & (mask[inner - 1] == 1)]  # a word on both sides of a text's end
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    if len(joined):
        starts = np.sort(np.concatenate([starts, joined]))
        ends = np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(starts, offsets)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table: True for bytes outside all the ranges (both ends inclusive)."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: Letters a-z (after lowering), digits and everything beyond ASCII.
WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Everything but blanks.
VISIBLE = byte_class((0x20, 0x20), (0x09, 0x0D))


def slices(offsets: np.ndarray, limit: int):
    """Ranges of consecutive texts of about ``limit`` bytes, one text at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def pack(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)
