"""What the operators share: tables in the cluster's shared folder, Arrow text
blocks and vectorised word hashes."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.session import ensure_checkpoint_dir

# The separators of words: space and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"
# A block of texts handed to numpy holds about this many bytes (one longer text
# makes a block of its own).
BLOCK_BYTES = 2 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/baitwatch-{uuid.uuid4().hex}-{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again. A
    later loss of executors loses none of it. ``options`` are those of the writer."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_memo(name: str) -> dict:
    """A dictionary that a reused Python worker keeps between tasks; functions sent
    by value have no module state of their own."""
    return sys.__dict__.setdefault("_baitwatch_memo", {}).setdefault(name, {})


def forget(*kept: str) -> None:
    """Let go of what other steps left in a reused worker: a step that needs much memory
    of its own starts with it. Memos of the names given stay."""
    memos = sys.__dict__.get("_baitwatch_memo", {})
    for name in [n for n in memos if n not in kept]:
        del memos[name]
    pa.default_memory_pool().release_unused()


def utf8_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with null as empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def text_blocks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows of about
    BLOCK_BYTES; offsets count from the block's first byte."""
    texts = utf8_column(batch, name)
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept per worker."""
    memo = worker_memo("powers")
    if n <= BLOCK_BYTES:
        n = BLOCK_BYTES
        if "both" in memo:
            return memo["both"]
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        both.append(np.cumprod(out, dtype=np.uint64))
    if n == BLOCK_BYTES:
        memo["both"] = tuple(both)
    return tuple(both)


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash modulo 2**64 and the inverse powers: the
    hash of ``data[s:e]`` is ``(sums[e] - sums[s]) * inverse[s]``."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums, down


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, ...]:
    """``(start, end, hash, first word of each text)``; words never cross texts."""
    n = len(data)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts_at, ends_at = offsets[:-1], offsets[1:]
    before[starts_at[starts_at < n]] = False
    after[ends_at[ends_at > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    sums, down = prefix_hash(_LOWER[data] if lower else data)
    h = (sums[end] - sums[start]) * down[start]
    return start, end, mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(start, offsets)


def chain(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words, at each first word."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k:k + m])
    return out


# The filter in front of a join has this many bits, whatever the number of keys.
FILTER_BITS = 24


def key_filter(keys: DataFrame, name: str) -> np.ndarray:
    """Bits set for both addresses of every key (a long). Spark combines them to words
    of 64, so 2**FILTER_BITS / 64 rows (2 MB) come to the driver at most. It only
    spares rows a shuffle; the join after it decides."""
    cells = keys.select(F.explode(F.array(
        F.shiftrightunsigned(name, 64 - FILTER_BITS), F.col(name).bitwiseAND((1 << FILTER_BITS) - 1))).alias("cell"))
    words = cells.groupBy(F.shiftright("cell", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).collect()
    out = np.zeros(1 << FILTER_BITS >> 6, np.int64)
    for r in words:
        out[r["w"]] = r["bits"]
    return out.view(np.uint64)


def may_be(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys (uint64) that the filter can't exclude."""
    def there(cell: np.ndarray) -> np.ndarray:
        return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) > 0

    at = np.flatnonzero(there(keys >> np.uint64(64 - FILTER_BITS)))
    return at[there(keys[at] & np.uint64((1 << FILTER_BITS) - 1))]
