"""Removal of bytes covered by long strings that occur elsewhere, by sparse enhanced
suffix arrays.

Winnowing picks anchors (the least of 128 consecutive 73-byte hashes), so every
200-byte string holds an anchor, at the same place in each of its occurrences. The
occurrences of one anchor are the suffixes of one group: sorted by what follows, with
the lengths of common prefixes of neighbours, they are stack-scanned into the
intervals of the common-prefix tree; inside each interval what precedes decides how
far to the left its members agree. An interval whose members differ to the left is a
maximal repeat, and all its members are its occurrences, not just neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitwatch.llm.common import key_filter, may_be, mix, prefix_hash, stage, text_blocks, utf8_column

LENGTH = 200
WINDOW = 128
GRAM = LENGTH - WINDOW + 1
# Distinct contexts of an anchor up to which they are one suffix array in one task;
# the strings of larger groups are counted one by one, spread over all tasks.
GROUP_MOST = 50_000
BATCH_BYTES = 4 << 20


def block_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place in the block, 64-bit hash)`` of the anchors of all texts of a block."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, down = prefix_hash(data)
    m = len(data) - GRAM + 1
    h = mix((sums[GRAM:GRAM + m] - sums[:m]) * down[:m])
    # Hash above, place below: the least is the leftmost of equal ones.
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    span = 1
    while span < WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    text = np.zeros(len(data), np.int32)
    np.add.at(text, offsets[1:-1][offsets[1:-1] < len(data)], 1)
    text = np.cumsum(text)
    inside = text[:n] == text[LENGTH - 1:]
    place = (least[:n][inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(place):
        return place, np.zeros(0, np.uint64)
    place = place[np.flatnonzero(np.diff(place, prepend=-1))]
    return place, h[place]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = batch.column(0).to_numpy(zero_copy_only=False)
        done: set[int] = set()
        for first, last, data, offsets in text_blocks(batch):
            place, h = block_anchors(data, offsets)
            row = np.searchsorted(offsets, place, "right") - 1
            unit = units[first:last]
            fresh = np.array([not (u in done or done.add(u)) for u in unit.tolist()], bool)
            keep = fresh[row]
            place, h, row = place[keep], h[keep], row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(unit[row]), pa.array((place - offsets[row]).astype(np.int32))], names=["f", "u", "at"])


def _filtered(bits: np.ndarray):
    """Rows whose first column, a key, passes the filter."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(may_be(bits, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    return keep


CONTEXT = "f long, u long, at int, k long, before int, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each anchor: up to WINDOW - 1 before and LENGTH from it on."""
    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          names=["f", "u", "at", "k", "before", "context"])

    for batch in batches:
        rows, held = [], 0
        texts = utf8_column(batch, "text")
        for u, text, marks in zip(batch.column(0).to_pylist(), texts, batch.column(2), strict=True):
            raw = memoryview(text.as_buffer())
            for mark in marks.as_py():
                at, before = mark["at"], min(mark["at"], WINDOW - 1)
                context = bytes(raw[at - before:at + LENGTH])
                k = int.from_bytes(hashlib.blake2b(context, digest_size=8, salt=bytes([before])).digest(), "little", signed=True)
                rows.append((mark["f"], u, at, k, before, context))
                held += len(context)
                if held >= BATCH_BYTES:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low = 0
    while low < most - 1:
        mid = (low + most) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            most = mid
    return low if a[low:low + 1] != b[low:low + 1] else low + 1


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(depth, first, last)`` of all intervals of two suffixes or more, inner ones
    first, by one scan with a stack. ``prefixes[i]`` is shared by suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            e, first = stack.pop()
            yield e, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(contexts: list[bytes], before: list[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """For distinct contexts of one anchor, the repeats of LENGTH bytes or more:
    ``(depth, [(context, from, to)])`` with all members of an interval and the largest
    part each shares with another of them. A member that an inner interval has given
    as much to the left is left out: its part here lies within that one."""
    right = [c[b:] for c, b in zip(contexts, before, strict=True)]
    left = [c[:b][::-1] for c, b in zip(contexts, before, strict=True)]
    order = sorted(range(len(contexts)), key=right.__getitem__)
    reach = [-1] * len(contexts)
    shared = [common(right[i], right[j]) for i, j in zip(order, order[1:], strict=False)]
    for depth, first, last in intervals(shared):
        members = sorted(order[first:last + 1], key=left.__getitem__)
        sides = [common(left[i], left[j]) for i, j in zip(members, members[1:], strict=False)]
        found = []
        for n, i in enumerate(members):
            most = max(sides[n - 1] if n else 0, sides[n] if n < len(sides) else 0)
            if most > reach[i]:
                reach[i] = most
                if most + depth >= LENGTH:
                    found.append((i, before[i] - most, before[i] + depth))
        if found:
            yield depth, found


SPANS = "f long, k long, a int, b int"


def _spans_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                       pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["f", "k", "a", "b"])


def _scan_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a group goes on over batches."""
    key, group, rows = None, [], []

    def close() -> None:
        for k, before, context, n in group:
            if n > 1 and len(context) >= LENGTH:
                rows.append((key, k, 0, len(context)))
        if len(group) > 1:
            for _, members in maximal_repeats([g[2] for g in group], [g[1] for g in group]):
                rows.extend((key, group[i][0], a, b) for i, a, b in members)

    for batch in batches:
        for f, k, before, context, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if f != key:
                close()
                key, group = f, []
            group.append((k, before, context, n))
        if len(rows) > 10_000:
            yield _spans_batch(rows)
            rows = []
    close()
    yield _spans_batch(rows)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every LENGTH-byte string of the contexts, by digest and place beside the anchor."""
    for batch in batches:
        rows = []
        for f, k, before, context, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for a in range(len(context) - LENGTH + 1):
                rows.append((f, k, a, a - before, hashlib.blake2b(context[a:a + LENGTH], digest_size=16).digest(), n))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()], strict=True)],
            names=["f", "k", "a", "o", "s", "n"])


def repeat_spans(texts: DataFrame, group_most: int = GROUP_MOST) -> tuple[DataFrame, DataFrame]:
    """For distinct texts ``u, text``: the candidate texts, and the repeats
    ``u, a, b`` in bytes (spans of one text may overlap). A text that stands in
    several rows counts once."""
    anchors = stage(texts.mapInArrow(_anchors, "f long, u long, at int"), "anchors")
    twice = stage(anchors.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "twice")
    likely = anchors.mapInArrow(_filtered(key_filter(twice, "f")), "f long, u long, at int")
    marks = stage(likely.join(twice, "f").distinct(), "marks")
    lists = marks.groupBy("u").agg(F.collect_list(F.struct("f", "at")).alias("marks"))
    # One of each text and its marks, in the same shuffle by u.
    candidates = stage(texts.mapInArrow(_filtered(key_filter(marks.select("u").distinct(), "u")), "u long, text string")
                       .dropDuplicates(["u"]).join(lists, "u").select("u", "text", "marks"), "candidates")
    contexts = stage(candidates.mapInArrow(_contexts, CONTEXT), "contexts")
    groups = stage(contexts.groupBy("f", "k").agg(
        F.max("before").alias("before"), F.max("context").alias("context"), F.count("*").alias("n")), "groups").select(
        "f", "k", "before", "context", "n")
    large = groups.groupBy("f").agg(F.count("*").alias("m")).where(F.col("m") > group_most).select("f")
    small = groups.join(large, "f", "left_anti").select("f", "k", "before", "context", "n").repartition("f").sortWithinPartitions("f")
    strings = groups.join(large, "f", "left_semi").select("f", "k", "before", "context", "n").mapInArrow(
        _strings, "f long, k long, a int, o int, s binary, n long")
    known = strings.groupBy("f", "o", "s").agg(F.sum("n").alias("m")).where("m > 1").select("f", "o", "s")
    spans = small.mapInArrow(_scan_groups, SPANS).union(
        strings.join(known, ["f", "o", "s"]).select("f", "k", "a", (F.col("a") + LENGTH).alias("b")))
    places = contexts.select("f", "k", "u", (F.col("at") - F.col("before")).alias("from"))
    return candidates.select("u", "text"), places.join(spans, ["f", "k"]).select("u", (F.col("from") + F.col("a")).alias("a"), (F.col("from") + F.col("b")).alias("b"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, runs, digests = [], [], []
        for text, spans in zip(utf8_column(batch, "text"), batch.column(2), strict=True):
            raw = memoryview(text.as_buffer())
            kept, last, n, gone = hashlib.sha256(), 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans.as_py()):
                if n and a <= last:
                    if b > last:
                        gone += b - last
                        last = b
                    continue
                kept.update(raw[last:a])
                gone, n, last = gone + b - a, n + 1, b
            kept.update(raw[last:])
            removed.append(gone)
            runs.append(n)
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)],
                                         names=["u", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row. Bytes are
    removed where a LENGTH-byte string covers them that also starts anywhere else, in
    the same text or another row; repeated rows are rows like others, so each loses all
    of a text of LENGTH bytes or more. A null text is empty; shorter texts lose
    nothing. Texts are told apart by a 64-bit hash with their length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text, F.octet_length(text)).alias("u"), text.alias("text"))
    light = stage(rows.select("doc_id", "u", F.octet_length("text").cast("long").alias("n_bytes"),
                              F.sha2(F.col("text").cast("binary"), 256).alias("whole")), "light")
    texts = rows.where(F.octet_length("text") >= LENGTH).select("u", "text")
    candidates, spans = repeat_spans(texts, group_most)
    per_text = spans.groupBy("u").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = candidates.join(per_text, "u").select("u", "text", "spans").mapInArrow(
        _cut, "u long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("u", "v")
    copies = light.where(F.col("n_bytes") >= LENGTH).groupBy(F.col("u").alias("w")).agg(F.count("*").alias("n")).where("n > 1").select("w")
    joined = light.join(copies, F.col("u") == F.col("w"), "left").join(cut, F.col("u") == F.col("v"), "left")
    whole = F.col("w").isNotNull()
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))
