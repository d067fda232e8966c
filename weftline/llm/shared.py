"""What the operators share: the shared folder, written tables and word splitting on Arrow arrays."""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import kept

#: Word separators: space and U+0009 to U+000D; a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Spark sends rows to Python in batches of at most this many bytes; its own bound of 64 MB is held several times over.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on batches for Python, if it is above BATCH_BYTES."""
    now = (spark.conf.get(BATCH, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the folder that all executors share (spark.checkpoint.dir)."""
    return kept.shared_folder(spark, what)


def written(df: DataFrame, spark: SparkSession, what: str) -> DataFrame:
    """df as a table in the shared folder, read back: it cuts lineage and outlives executors."""
    small_batches(spark)
    return kept.kept(df, what)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


spread = kept.spread


def tidy(get):
    """get, a function for mapInArrow, after which the worker gives back the memory that it no longer needs."""

    def run(batches):
        try:
            yield from get(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other libraries do without
            if trim:
                trim(0)

    return run


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path in the shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cuts a batch into runs of rows with about `most` bytes of `column`, so that working memory is bounded."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (null: none) in order, and each text's first index among them, with the end."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = parts.flatten(), np.asarray(parts.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    return flat, offsets


def id_remainder(doc_id, n: int):
    """crc32(doc_id as text) mod n as a column; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))), F.lit(n))


def id_remainder_py(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
