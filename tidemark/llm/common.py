"""What the corpus operators share: the shared work folder, null-safe document columns and byte-level numpy helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ship

_OWN_ROOT: dict[str, str] = {}
ARROW_BYTES = 8 << 20
SLICE = 1 << 19  # bytes of text worked on at once: 50 to 90 bytes of arrays each, and 32 of powers kept (``span_hashes``)


def work_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "root" not in _OWN_ROOT:
        _OWN_ROOT["root"] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_ROOT["root"]


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Rows go to Python workers at most ``ARROW_BYTES`` at a time (the default of 64 MB is held several times over on both sides)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Workspace:
    """Written tables of one operator call, under the shared folder. They cut lineage: a lost executor costs a re-read, no recomputation.

    Tables stay until ``drop`` or the end of the driver process, since the returned DataFrame may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
        if not _LEFT:
            atexit.register(lambda: [_delete(s, p) for s, p in _LEFT])
        _LEFT.append((spark, self.path))

    def table(self, df: DataFrame, name: str, codec: str = "zstd", partition_by: list[str] | None = None, wide: bool = False) -> DataFrame:
        """``wide``: rows of megabytes. Each is then a row group of its own, since writers buffer at least 100 rows and readers load up to 4,096 of a group at once."""
        path = f"{self.path}/{name}"
        rows = {"parquet.block.row.count.limit": "1"} if wide else {}
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", codec).options(**rows).parquet(path, partitionBy=partition_by)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        _delete(self.spark, f"{self.path}/{name}".rstrip("/"))


_LEFT: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at interpreter exit; leftovers are harmless
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, text string``: null texts are empty, other columns are gone, so none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls as one array, and its offsets (n + 1, from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int):
    """Row ranges (lo, hi) of a batch whose texts have about ``limit`` bytes together; a longer text is a range of its own."""
    if not batch.num_rows:
        return
    offsets = utf8_parts(batch.column(column))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield lo, hi
        lo = hi


class _Named:
    """A name for a run of rows that does not depend on how they were cut into batches."""

    def __init__(self, columns: int):
        self.parts = [xxhash.xxh64() for _ in range(2 * columns)]

    def add(self, columns: list[pa.Array]) -> None:
        for i, column in enumerate(columns):
            data, offsets = utf8_parts(column)
            self.parts[2 * i].update(np.ascontiguousarray(data))
            self.parts[2 * i + 1].update(np.diff(offsets))

    def name(self) -> int:
        return xxhash.xxh64_intdigest(b"".join(p.digest() for p in self.parts)) - (1 << 63)


def row_blocks(batches: Iterator[pa.RecordBatch], limit: int, by: tuple[str, ...] = ("doc_id",)) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, pa.Array]]]]:
    """Blocks of consecutive rows, as many as ``limit`` bytes of text hold (and 64 a row): a name, and slices of rows with their texts (nulls empty).

    The name is a hash of the texts and the columns ``by``, and neither it nor the blocks depend on batches, so two reads of the same rows in
    the same order give the same blocks wherever they run; blocks alike have one name. A longer text is a block of its own.
    """
    held, size, name = [], 0, _Named(1 + len(by))
    for batch in batches:
        text = batch.column("text").cast(pa.string()).fill_null("")
        others = [batch.column(c).cast(pa.string()).fill_null("") for c in by]
        upto = utf8_parts(text)[1] + 64 * np.arange(batch.num_rows + 1)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(upto, upto[lo] + limit - size, "right")) - 1
            if hi <= lo and held:
                yield name.name(), held
                held, size, name = [], 0, _Named(1 + len(by))
                continue
            hi = max(hi, lo + 1)
            held.append((batch.slice(lo, hi - lo), text.slice(lo, hi - lo)))
            name.add([held[-1][1], *(o.slice(lo, hi - lo) for o in others)])
            size += int(upto[hi] - upto[lo])
            lo = hi
    if held:
        yield name.name(), held


def packed_rows(docs: DataFrame, limit: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``block long, blob binary``: the rows of each of ``row_blocks`` as they are, all columns, in Arrow's stream format, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in row_blocks(batches, limit, by):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0][0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                for piece, _ in held:
                    out.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "blob"])
        trim()

    return docs.mapInArrow(run, "block long, blob binary")


def trim() -> None:
    """Gives freed memory of this worker back to the system: it lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words_at(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word at every position of an array of bytes (zeros beyond the end)."""
    raw = data.tobytes() + bytes(8)
    return np.ndarray((len(data),), "<u8", raw, strides=(1,))


_MULT = 0x9E3779B97F4A7C15 | 1
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, from exponent 0 to n."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POW:
        _POW.clear()
        up = np.full(size, _MULT, np.uint64)
        down = np.full(size, pow(_MULT, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POW[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW[size]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once: differences of one polynomial prefix sum, then mixed with the length."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    return mix64(h ^ mix64((end - start).astype(np.uint64) + np.uint64(0x1234567)))
