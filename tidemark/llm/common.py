"""Shared helpers: intermediate tables in the cluster's shared folder, row keys, text batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: Bytes of text that a Python worker turns into arrays at a time.
BATCH_BYTES = 4 << 20
#: Largest Arrow batch between the JVM and a Python worker.
ARROW_BYTES = 4 << 20
ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; every call names another one."""
    return f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex[:16]}/{name}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ARROW_BYTES`` (a batch is held several times over, in
    the JVM and in Python); very long texts then travel a few at a time.  A lower setting stays."""
    now = re.match(r"\d+(?=b?$)", spark.conf.get(ARROW_CONF))
    if not now or int(now[0]) > ARROW_BYTES:
        spark.conf.set(ARROW_CONF, str(ARROW_BYTES))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, so a
    lost executor costs a reread and never another run of what made the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(text: str = "text") -> Column:
    """64-bit content key of a text; with ``doc_id`` it names a row, equal rows aside."""
    return F.xxhash64(F.col(text))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id's decimal text (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def text_blocks(texts: list, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive texts with about ``limit`` characters or bytes each."""
    i = n = 0
    for j, t in enumerate(texts):
        n += len(t)
        if n >= limit:
            yield i, j + 1
            i, n = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def as_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def as_text(col: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of a column; null counts as empty."""
    return ["" if x is None else x for x in col.to_pylist()]
