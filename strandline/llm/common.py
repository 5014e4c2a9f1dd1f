"""What the operators share: tables, shared storage, word scanning, hashing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the numpy scanners take at once (a longer document goes alone).
CHUNK_BYTES = 1 << 20

_made: dict[str, str] = {}


#: Bytes of an Arrow batch between Spark and its Python workers: what a task holds twice on either side.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch: rows of long texts make large batches else."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != f"{BATCH_BYTES}b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this run's own below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset (tests in local
    mode) a temporary folder is set for the session's lifetime. The folder is
    removed when the driver's process ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _made:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        master = spark.sparkContext.master
        if not root and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not root:
            root = tempfile.mkdtemp(prefix="strandline-")
            spark.sparkContext.setCheckpointDir(root)
        _made[app] = f"{root.rstrip('/')}/strandline-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _made[app])
    return _made[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems; a stopped session is let be."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone when the process ends
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it again: it cuts lineage, survives
    lost executors, and gives later joins true sizes to choose a broadcast by."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what ``written`` stored, once nothing reads it any more."""
    remove(df.sparkSession, df._strandline_path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (Spark compares without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def hot_keys(df: DataFrame, key: str, share: int = 512, least: int = 200) -> list:
    """Keys with over ``1/share`` of the rows and over ``least`` rows: at most ``share`` of them."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    return [r[0] for r in counts.where(F.col("_n") > max(least, total // share)).select(key).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 512, least: int = 200, hot: list | None = None) -> DataFrame:
    """Equi-join of a side with possible hot keys to a side with one row per key.

    Hot keys (at most ``share``, found by counting) are joined by broadcasting
    their few right rows, so that their left rows stay where they are; all
    others go by a shuffle join. Nothing is dropped; null keys match nothing.
    """
    hot = hot_keys(left, key, share, least) if hot is None else hot
    if not hot and how != "left":
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(True))  # nulls, which match nothing, needn't meet in one task
    head = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return head.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def checked_join(df: DataFrame, side: DataFrame, key: str, how: str, most: int = 300_000, hot: list | None = None) -> DataFrame:
    """Equi-join to a side with one row per key: broadcast where it has at most ``most`` rows, else
    by shuffle, with hot keys apart. ``side`` is counted, so it should be a written table."""
    if side.limit(most + 1).count() <= most:
        return df.join(F.broadcast(side), key, how)
    return join_hot(df, side, key, how, hot=hot)


def within(df: DataFrame, ids: DataFrame, key: str, how: str, most: int = 300_000) -> DataFrame:
    """Semi- or anti-join; the ids are broadcast where they are at most ``most`` rows, else shuffled."""
    ids = ids.select(key).distinct()
    return df.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, key, how)


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


# ---------------------------------------------------------------- Arrow and numpy

def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges with about ``limit`` bytes each; a longer row makes a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[0x30:0x3A] = _WORDLIKE[0x61:0x7B] = _WORDLIKE[0x80:] = True
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MI = np.uint64(pow(int(_M), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"m": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, _M if kind == "m" else _MI, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (Steele and others' splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some rows: ASCII letters in lower case, digits, and all beyond ASCII.

    ``data`` are the lower-cased bytes; word k of the rows is
    ``data[start[k]:end[k]]`` and belongs to row ``row[k]``; the words of row r
    are ``first[r]:first[r+1]``.
    """

    def __init__(self, offsets: np.ndarray, raw: np.ndarray):
        base = int(offsets[0])
        self.data = _LOWER[raw[base : int(offsets[-1])]]
        self.offsets = offsets - base
        n = len(self.data)
        inside = _WORDLIKE[self.data]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside
        cut = self.offsets[:-1]
        cut = cut[cut < n]
        joined = before[:n].copy()
        joined[cut] = False
        self.start = np.flatnonzero(inside & ~joined)
        goes_on = np.zeros(n + 1, bool)
        goes_on[:n] = inside & joined
        self.end = np.flatnonzero(before & ~goes_on)
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word: a polynomial in its bytes, spread; so many bytes at once, however long a row is."""
        out = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(out):
            low = int(self.start[a])
            b = max(a + 1, int(np.searchsorted(self.end, low + CHUNK_BYTES, side="right")))
            part = self.data[low : int(self.end[b - 1])]
            begin, end = self.start[a:b] - low, self.end[a:b] - low
            sums = np.zeros(len(part) + 1, np.uint64)
            np.multiply(part.astype(np.uint64) + np.uint64(1), _power("m", len(part)), out=sums[1:])
            np.cumsum(sums, out=sums)
            out[a:b] = (sums[end] - sums[begin]) * _power("i", len(part))[begin] + (end - begin).astype(np.uint64)
            a = b
        return mix(out)

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1, a space between each."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


_K = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` successive words, rows not regarded."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * (_K[k] if k < 64 else np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)))
    return mix(total)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Parts of a batch with a bounded amount of text, each with its offsets and bytes."""
    offsets, raw = strings(batch.column(column))
    for a, b in pieces(offsets, limit):
        yield batch.slice(a, b - a), offsets[a : b + 1], raw


def tidied(run):
    """A function over batches that gives freed memory back to the system when a partition ends: workers live on."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def grouped(batches, key: str):
    """Runs of rows with one key, from batches sorted by it, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
