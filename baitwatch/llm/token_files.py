"""Token ids in Simple-8b words: a selector in the top four bits says how many ids
share the word's other 60 bits. Ids are packed in blocks of BLOCK, and the payload of
a document names the first word of each block, so blocks decode independently and all
words of one selector at once.

Payload (little-endian): u32 number of ids, u32 words, u32 escapes, u32 per block its
first word, u64 words, u64 escapes. Ids beyond 60 bits are escaped: selector 15, and
the word's rest is a place in the table of escapes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitwatch.llm.common import BLOCK_BYTES, shared_path, utf8_column, worker_memo
from baitwatch.llm.token_pieces import TEXT_BYTES, laid_out, pieces

BLOCK = 128
# Ids per word by selector 1 to 14 (fixed by the format); each gets 60 // n bits.
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
# Bytes of text meant for one shard.
SHARD_BYTES = 32 << 20
_U = np.uint64


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id (uint64): 0 for zero."""
    out = np.zeros(ids.shape, np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= _U(1) << _U(step)
        out += high.astype(np.uint8) * np.uint8(step)
        rest = np.where(high, rest >> _U(step), rest)
    return out + (rest > 0).astype(np.uint8)


def pack(lists: list[np.ndarray]) -> list[bytes]:
    """Payloads of lists of non-negative ids (any integer type up to 64 bits)."""
    sizes = np.array([len(x) for x in lists], np.int64)
    n_blocks = -(-sizes // BLOCK)
    flat = np.concatenate([np.asarray(x).astype(np.uint64) for x in lists]) if len(lists) else np.zeros(0, np.uint64)
    total = int(n_blocks.sum())
    pad = max(COUNTS)
    grid = np.zeros((total, BLOCK + pad), np.uint64)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    # Place of every id in the grid: its block and its place there.
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = np.repeat(first_block[:-1], sizes) + within // BLOCK
    grid[block, within % BLOCK] = flat
    length = np.full(total, BLOCK, np.int64)
    ends = first_block[1:][sizes > 0] - 1
    length[ends] = sizes[sizes > 0] - (n_blocks[sizes > 0] - 1) * BLOCK
    if flat.max(initial=0) < 1 << 16:
        memo = worker_memo("widths")
        if "table" not in memo:
            memo["table"] = _widths(np.arange(1 << 16, dtype=np.uint64))
        width = memo["table"][grid.astype(np.uint16)]
    else:
        width = _widths(grid)
    best = np.where(width[:, :BLOCK] > 60, np.uint8(ESCAPE), np.uint8(1))
    spans = {1: width}
    for p in (2, 4, 8, 16, 32):
        half = spans[p // 2]
        spans[p] = np.maximum(half[:, :-(p // 2)], half[:, p // 2:])
    for selector, n in enumerate(COUNTS[1:], 2):
        p = max(q for q in spans if q <= n)
        top = np.maximum(spans[p][:, :BLOCK], spans[p][:, n - p:n - p + BLOCK])
        best[top <= 60 // n] = selector
    # All blocks advance together, a word each per step.
    taken = np.array([0, *COUNTS, 1], np.int64)
    at, rows, steps = np.zeros(total, np.int64), np.arange(total), []
    while len(rows):
        pos = at[rows]
        selector = best[rows, pos]
        steps.append((rows, pos, selector))
        at[rows] = pos + taken[selector]
        rows = rows[at[rows] < length[rows]]
    words_in = np.zeros(total, np.int64)
    for rows, _, _ in steps:
        words_in[rows] += 1
    first_word = np.concatenate([[0], np.cumsum(words_in)])
    words = np.zeros(int(first_word[-1]), np.uint64)
    if steps:
        where = np.concatenate([first_word[rows] + k for k, (rows, _, _) in enumerate(steps)])
        rows, pos, selector = (np.concatenate([s[i] for s in steps]) for i in range(3))
    else:
        where = rows = pos = np.zeros(0, np.int64)
        selector = np.zeros(0, np.uint8)
    line = grid.reshape(-1)
    base = rows * (BLOCK + pad) + pos
    for s, n in enumerate(COUNTS, 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            word = np.full(len(own), s, np.uint64) << _U(60)
            for k in range(n):
                word |= line[base[own] + k] << _U(k * (60 // n))
            words[where[own]] = word
    escaped = np.flatnonzero(selector == ESCAPE)
    escaped = escaped[np.argsort(where[escaped])]
    values, doc_of = line[base[escaped]], np.searchsorted(first_block, rows[escaped], "right") - 1
    first_escape = np.searchsorted(doc_of, np.arange(len(lists) + 1))
    words[where[escaped]] = (_U(ESCAPE) << _U(60)) | (np.arange(len(escaped)) - first_escape[doc_of]).astype(np.uint64)
    out = []
    for d in range(len(lists)):
        a, b = int(first_block[d]), int(first_block[d + 1])
        w, e = words[first_word[a]:first_word[b]], values[first_escape[d]:first_escape[d + 1]]
        head = np.concatenate([[sizes[d], len(w), len(e)], first_word[a:b] - first_word[a]]).astype("<u4")
        out.append(head.tobytes() + w.astype("<u8").tobytes() + e.astype("<u8").tobytes())
    return out


def unpack(payloads: list[bytes]) -> list[np.ndarray]:
    """Ids (uint64) of each payload."""
    words, blocks, sizes, escapes = [], [], [], []
    n_words = n_escapes = 0
    shift = []
    for p in payloads:
        n, w, e = (int(x) for x in np.frombuffer(p, "<u4", 3))
        b = -(-n // BLOCK)
        blocks.append(np.frombuffer(p, "<u4", b, 12).astype(np.int64) + n_words)
        words.append(np.frombuffer(p, "<u8", w, 12 + 4 * b))
        escapes.append(np.frombuffer(p, "<u8", e, 12 + 4 * b + 8 * w))
        shift.append((w, n_escapes))
        sizes.append(n)
        n_words += w
        n_escapes += e
    if not payloads:
        return []
    word, start, raw = np.concatenate(words), np.concatenate(blocks), np.concatenate(escapes)
    total, pad = len(start), max(COUNTS)
    selector = (word >> _U(60)).astype(np.int64)
    counts = np.array([0, *COUNTS, 1], np.int64)[selector]
    run = np.concatenate([[0], np.cumsum(counts)])
    block = np.searchsorted(start, np.arange(len(word)), "right") - 1
    base = block * (BLOCK + pad) + run[:-1] - run[start[block]] if len(word) else np.zeros(0, np.int64)
    line = np.zeros(total * (BLOCK + pad), np.uint64)
    for s, n in enumerate(COUNTS, 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            bits, mask = 60 // n, _U((1 << (60 // n)) - 1)
            for k in range(n):
                line[base[own] + k] = (word[own] >> _U(k * bits)) & mask
    own = np.flatnonzero(selector == ESCAPE)
    if len(own):
        before = np.repeat([e for _, e in shift], [w for w, _ in shift])
        line[base[own]] = raw[(word[own] & _U((1 << 60) - 1)).astype(np.int64) + before[own]]
    grid, out, first = line.reshape(total, BLOCK + pad)[:, :BLOCK], [], 0
    for n in sizes:
        b = -(-n // BLOCK)
        out.append(grid[first:first + b].reshape(-1)[:n])
        first += b
    return out


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids (uint32) of each text as the tokenizer's library gives them, without added
    special tokens; special strings inside a text as is the library's default."""
    tok = pieces(path)
    whole = [tok.whole(t) for t in texts]
    raw, at = laid_out(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()), f"ids:{path}", tok.encode)
    ids, at = np.frombuffer(raw, np.uint32), (at // 4).tolist()
    return [np.array(tok.library.encode(t, add_special_tokens=False).ids, np.uint32) if w else ids[a:b]
            for t, w, a, b in zip(texts, whole, at, at[1:], strict=False)]


def _runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` in sum."""
    first = 0
    upto = np.cumsum(lengths)
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, "right")))
        yield first, last
        first = last


def _writer(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = utf8_column(batch, "text")
            lengths = np.array([len(x.as_buffer()) for x in texts], np.int64)
            for a, b in _runs(lengths, TEXT_BYTES):
                ids = [np.append(x, np.uint32(end_id)) for x in encode_texts(texts[a:b].to_pylist(), path)]
                n = np.array([len(x) for x in ids], np.int64)
                first = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, shard, np.int32)), batch.column(0)[a:b], pa.array(first), pa.array(n), pa.array(pack(ids), pa.binary())],
                    names=["shard", "doc_id", "first", "n_tokens", "payload"])

    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> str:
    """Encode every text, append ``end_id`` and write the shards of the token file:
    Parquet parts of ``shard, doc_id, first, n_tokens, payload``, a row per document
    in ascending doc_id, ``first`` counting the ids before it in its shard. Shards
    follow each other in doc_id, null first. Rows of one doc_id go by their text. A
    null text is empty and has the end id only. Returns the folder. Documents reach
    their shard in one shuffle; a lost task writes its part again."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # Rows of one id, or of none, may be many: the beginnings of their texts split them.
    ordered = rows.repartitionByRange(n, "doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(tokenizer_path, end_id), "shard int, doc_id long, first long, n_tokens long, payload binary").write.parquet(folder)
    return folder


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column(3).to_numpy(zero_copy_only=False)
        for a, b in _runs(n, BLOCK_BYTES // 4):
            ids = unpack(batch.column(4)[a:b].to_pylist())
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], batch.column(1)[a:b], batch.column(2)[a:b], pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"])


def _stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a token file, and ``of, before``: the ids before each shard. Only one
    row per shard is added up in order."""
    stored = spark.read.schema("shard int, doc_id long, first long, n_tokens long, payload binary").parquet(folder)
    sums = stored.groupBy(F.col("shard").alias("of")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    return stored, sums.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, doc_id, start, payload`` of a token file; ``start`` counts the ids of
    all documents before."""
    stored, starts = _stored(spark, folder)
    return stored.join(starts, F.col("shard") == F.col("of")).select(
        "shard", "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "payload")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, the last two from the decoded ids. Payloads
    are decoded where they are read; what is joined has no payload."""
    stored, starts = _stored(spark, folder)
    decoded = stored.mapInArrow(_reader, "shard int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, F.col("shard") == F.col("of")).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
