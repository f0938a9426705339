"""What several operators of this subpackage share: reading, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of a Python worker holds at a time (one longer text goes alone).
STEP_BYTES = 4 << 20
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; all of them if none is named."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all run on one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectura-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared checkpoint folder."""
    folder = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, written as a table into the shared checkpoint folder."""
    path = f"{shared_dir(df.sparkSession)}/lectura-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches of so few rows that those of long texts fit beside each other."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that `column` (string or binary) holds about `limit` bytes in each part."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i in range(n):
            if held and held + size[i] > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(size[i])
        yield batch.slice(at)
        pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column with "" for null, as large_string (offsets don't overflow) of its own (some kernels ignore where a slice begins)."""
    found = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return found.take(pa.array(range(len(found)), pa.int64()))
