"""Shared plumbing: tables in the folder all machines see, and byte-bounded Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch from the JVM, unless the session sets its own number.
ARROW_ROWS = 1000
#: Bytes in one Arrow batch from the JVM, unless the session sets its own number.
ARROW_BYTES = 16 << 20
#: Bytes of text worked on at once; a single longer text is still taken whole.
SLICE_BYTES = 1 << 20


_holder: list = ["", None]


def claim(owner: str, release: Callable[[], object] | None = None) -> None:
    """Called in a Python worker before an operator fills memory: what another operator cached there goes.

    Spark reuses workers from stage to stage; without this they would hold the caches of all.
    """
    if _holder[0] != owner:
        if _holder[1]:
            _holder[1]()
        _holder[:] = [owner, release]


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for long texts unless the user chose a size."""
    for key, usual, ours in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", str(64 << 20), ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", usual).removesuffix("b") in (usual, str((1 << 31) - 1)):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(ours))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; unset is an error but where all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        found = tempfile.mkdtemp(prefix="chartmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chartmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def remove_written() -> None:
    """Remove the tables that materialise wrote; results that still read them must be written before."""
    while _written:
        spark, name = _written.pop()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        remove_written()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that each piece holds about `limit` bytes of `column`: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_buffers(batch.column(batch.schema.get_field_index(column)))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b


#: Bits of a bitmap over ids: eight an id, within these bounds. Beyond the larger it passes more rows, never fewer.
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 27


class IdFilter:
    """A bitmap of hashed ids, at most 16 MB: what it lets through holds all rows with one of the ids."""

    def __init__(self, ids: DataFrame):
        spark = ids.sparkSession
        n = 8 * ids.count()
        self.bits = min(max(FEWEST_BITS, 1 << n.bit_length()), MOST_BITS)
        rows = ids.groupBy(F.shiftright(self.slot(), 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {self.bits}) & 63 as int))")).alias("bits")).toArrow()
        filled = np.zeros(self.bits // 64, np.int64)
        filled[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        self.held = spark.sparkContext.broadcast(filled.tobytes())

    def slot(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.bits))

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a batch with a column `slot` that may have one of the ids."""
        words, slot = np.frombuffer(self.held.value, np.int64), batch.column("slot").to_numpy()
        return batch.filter(pa.array((words[slot >> 6] >> (slot & 63)) & 1 == 1))
