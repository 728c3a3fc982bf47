"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than the six ASCII white space bytes
(``[^\\x20\\x09-\\x0D]+``), which is what ``bytes.split()`` returns as well.
Every ``mapInArrow`` function here works on slices of a few megabytes, so a
worker's memory does not depend on the size of a Spark partition.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A scratch folder is made only where the setting is absent and the session
    runs in one local JVM, as in tests; elsewhere the absence is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="shelfcast-llm-")
    spark.sparkContext._conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one stage, not the whole
    chain.  The folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_BYTES``: rows are whole texts, so a row count does not bound a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidied(run), schema)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back the memory that it no longer uses: workers live through all stages of a job, so each would keep the most that any stage took."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return whole


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the decimal text of the id, modulo ``folds``; 0 is held out.  A null id is in fold 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds, F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores added as it takes not to clash with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of ``column`` each (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


class Words(NamedTuple):
    """Word positions of the texts of one slice; byte offsets are into ``data``."""

    data: np.ndarray        # uint8: the texts one after the other
    offsets: np.ndarray     # int64: text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray      # int64: first byte of each word
    ends: np.ndarray        # int64: byte after each word
    first: np.ndarray       # int64: words of text i are first[i]:first[i + 1]


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else pa.binary()
    texts = pc.fill_null(texts.cast(kind), b"")
    width = np.int64 if kind == pa.large_binary() else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=width)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]: off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def split_words(texts: pa.Array) -> Words:
    data, offsets = byte_view(texts)
    n = len(data)
    inside = _WORD_BYTE[data]
    before = np.zeros(n, dtype=bool)
    after = np.zeros(n, dtype=bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        heads = offsets[:-1]
        before[heads[heads < n]] = False
        tails = offsets[1:]
        after[tails[tails > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.empty(0, dtype=np.uint64)     # grows with the longest word; the first power is the base itself


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """One 64-bit hash per word: a polynomial in its bytes and length, mixed."""
    global _POWERS
    if not len(words.starts):
        return np.empty(0, np.uint64)
    lengths = words.ends - words.starts
    longest = int(lengths.max())
    if len(_POWERS) < longest:
        _POWERS = np.cumprod(np.full(max(longest, 256), _BASE, dtype=np.uint64))
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(heads, lengths)
    used = words.data[np.repeat(words.starts, lengths) + within]
    values = (used.astype(np.uint64) + np.uint64(1)) * _POWERS[within]
    return mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
