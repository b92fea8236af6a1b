"""What the text operators share: reading a table, the word pattern, Arrow helpers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    """The frame's session, whose Python workers can import this package from where the driver has it (on a cluster
    where it is neither installed nor at the same path, pass it with --py-files)."""
    spark = df.sparkSession
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    # Smaller batches than Spark's own default, which is left alone where it was changed: texts are long.
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")
    return spark


def fold(n: int) -> Column:
    """crc32 of the document's id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def broadcast_few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, which is a staged table of narrow rows, marked for broadcast where it holds `rows` rows at most; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow column with a-z for A-Z, null as empty."""
    return [(t or b"").lower() for t in column.to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose `column` holds about `max_bytes` at most (one row at least), so that a batch of
    very long texts does not multiply in memory."""
    for batch in batches:
        a = batch.column(column)
        if not batch.num_rows:
            continue
        sizes = np.array(pc.fill_null(pc.binary_length(a), 0), dtype=np.int64)
        piece = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()  # workers are used again
