"""Small helpers that several corpus operators share."""

from __future__ import annotations

import base64
import contextlib
import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; bounds the temporary arrays of a batch.
SLICE_BYTES = 1 << 19


#: Spark's own settings while a table is written: shuffle files go when it is there, and tasks hand Python at most so many rows at once.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only a local master, as in tests, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern_checkpoints"
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage by a table in the shared folder: it survives lost executors, unlike a local checkpoint.

    The shuffle files that made it are removed; the table itself stays until discard().
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise() that no later plan reads."""
    for table in tables:
        if path := table.__dict__.pop("_written_to", None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def fold_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the held-out rule of the queries."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(label, text) of at most max_rows labelled documents, drawn by a hash of the id, as a table of its own.

    The bound makes the drawn labels small enough to broadcast, so that no text is shuffled for them.
    """
    marked = plain(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()), id_col, label_col).toDF("doc_id", "label")
    n = marked.count()
    if n > max_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(970_000 * max_rows / n)).limit(max_rows)
    rows = plain(docs, id_col, text_col).toDF("doc_id", "text").join(F.broadcast(marked), "doc_id")
    return materialise(rows.select(F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text")))


@lru_cache(maxsize=1)
def byte_pair_encoding(ranks: str | None = None):
    """A tiktoken encoding from a file of ranks (None: the public one that is installed); one in each worker."""
    import public_tokenizers
    import tiktoken

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about `limit` bytes of text.

    Yields (rows, bytes of all their texts, row offsets into them); a null text has no bytes.
    """
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(start + 1, stop))
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop
    del column, buffers, offsets, data
    give_back()


def texts_of(rows: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts as Python strings, null as the empty one."""
    return [x if x is not None else "" for x in rows.column(rows.schema.get_field_index(name)).to_pylist()]
