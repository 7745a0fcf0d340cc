"""Ranked lexical search by pair-bound MaxScore.

The index is cut by documents: a shard holds the postings of about SHARD documents,
sorted by term, with the impact of each posting and the largest impact of each term.
For the PAIR_TERMS terms of most documents it also holds, per pair, the largest joint
impact over the intersection of both lists. Shards are written once; a search reads them.
A shard is a row whose postings are one compressed value, in a row group of its own: the
JVM reads one at a time and passes it on as bytes, in batches of bounded bytes.

In a shard an item's terms become units: a term with its largest impact, or two terms
matched as a pair. A document holding one or both of a pair gains at most the largest of
both maxima and the joint maximum, which is below the sum of the maxima, and nothing more
than one of them where the intersection is empty. Units are taken by falling bound until
the bounds of the rest stay below the score of the best K so far; only documents of the
units taken are candidates, and candidates go as soon as their score and the rest's bound
stay below. A task carries the best of its earlier shards on, so bounds tighten."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baitwatch.llm.common import mix, prefix_hash, stage, text_blocks, utf8_column

SHARD = 2048
# Terms of most documents whose pairs have intersection lists: 2,016 pairs.
PAIR_TERMS = 64
# Items searched for in one pass over the index: as many as have this many bytes of text.
ITEM_BYTES = 1 << 20

_TERM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_a:_b] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each term, first term of each text)``: maximal runs of ASCII letters and
    digits and anything beyond ASCII, A-Z lower-cased."""
    inside = _TERM[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts_at, ends_at = offsets[:-1], offsets[1:]
    before[starts_at[starts_at < len(data)]] = False
    after[ends_at[ends_at > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    sums, down = prefix_hash(_FOLD[data])
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(start, offsets)


def _pack(**columns: np.ndarray) -> pa.Buffer:
    """Columns of any lengths as one compressed value: the JVM passes it on as bytes,
    where lists would be decoded and copied number by number."""
    columns = {c: pa.array(x) for c, x in columns.items()}
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3), use_threads=False)
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpack(value: pa.Scalar) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(value.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()
    return {c: batch.column(j).values.to_numpy(zero_copy_only=False) for j, c in enumerate(batch.schema.names)}


def _row(docs: pa.Array, known: pa.Array, *rest) -> list[pa.Array]:
    """A row of an index table: lists of ids, then plain values."""
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, known)] + [
        pa.array([x.to_pybytes() if isinstance(x, pa.Buffer) else x], pa.binary() if isinstance(x, pa.Buffer) else pa.int64()) for x in rest]


_FORWARD = "docs array<long>, known array<boolean>, n_docs long, n_terms long, terms binary, postings binary"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms, about SHARD in a row: ids, numbers of documents and terms,
    the distinct terms with the start of each one's postings, and by term the places of
    its documents with the counts in each."""
    ids, n, terms, docs, size = [], [], [], 0, 0

    def out() -> pa.RecordBatch:
        known, count, term = pa.concat_arrays(ids), np.concatenate(n), np.concatenate(terms)
        place = np.repeat(np.arange(len(count), dtype=np.min_scalar_type(len(count))), count)
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        posting = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] != place[:-1])])
        tf = np.diff(np.r_[posting, len(term)]).astype(np.int32)
        term, place = term[posting], place[posting]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        return pa.RecordBatch.from_arrays(_row(
            known.fill_null(0), known.is_valid(), len(count), int(count.sum()),
            _pack(terms=term[starts], starts=np.r_[starts, len(term)]), _pack(n=count, places=place, tfs=tf)), names=[c.split()[0] for c in _FORWARD.split(", ")])

    for batch in batches:
        for row, _, data, offsets in text_blocks(batch):
            h, first = terms_of(data, offsets)
            count = np.diff(first)
            full = np.flatnonzero(count)
            for k in range(0, len(full), SHARD):
                some = full[k:k + SHARD]
                ids.append(batch.column(0).take(pa.array(row + some)))
                n.append(count[some])
                # Texts between them have no terms.
                terms.append(h[first[some[0]]:first[some[-1] + 1]].view(np.int64))
                docs, size = docs + len(some), size + len(terms[-1])
                if docs >= SHARD or size > 1 << 20:
                    yield out()
                    ids, n, terms, docs, size = [], [], [], 0, 0
    if ids:
        yield out()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, added up over stretches of the input before they are shuffled."""
    terms, counts, size = [], [], 0

    def out() -> pa.RecordBatch:
        distinct, at = np.unique(np.concatenate(terms) if terms else np.zeros(0, np.int64), return_inverse=True)
        df = np.zeros(len(distinct), np.int64)
        np.add.at(df, at, np.concatenate(counts) if counts else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(df)], names=["term", "df"])

    for batch in batches:
        for value in batch.column(0):
            lists = _unpack(value)
            terms.append(lists["terms"])
            counts.append(np.diff(lists["starts"]))
            size += len(terms[-1])
            if size > 1 << 20:
                yield out()
                terms, counts, size = [], [], 0
    yield out()


def weight(n: int, df: int) -> int:
    """floor(1000 ln((2N + 2) / (2df + 1))), in doubles."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term adds, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


_SHARD = "docs array<long>, known array<boolean>, postings binary"


def _shards(n_docs: int, n_terms: int, pair_terms: list[tuple[int, int]]):
    """A shard of each row of a task. ``pair_terms`` are terms with their weights."""
    def shard(docs: pa.Array, known: pa.Array, distinct: np.ndarray, bounds: np.ndarray, n: np.ndarray, place: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        m = 50 + (50 * n * n_docs) // max(n_terms, 1)
        impact = saturation(tf.astype(np.int64), m[place])
        starts, ends = bounds[:-1], bounds[1:]
        highest = np.maximum.reduceat(impact, starts)
        # Joint maxima, in weighted impacts, over the documents that hold both terms.
        there, full = [], []
        for t, w in pair_terms:
            at = int(np.searchsorted(distinct, t))
            if at < len(distinct) and distinct[at] == t:
                column = np.full(len(n), -1, np.int64)
                column[place[starts[at]:ends[at]]] = w * impact[starts[at]:ends[at]]
                there.append(t)
                full.append(column)
        pairs = [(there[i], there[j], int(np.where((full[i] >= 0) & (full[j] >= 0), full[i] + full[j], 0).max()))
                 for i in range(len(there)) for j in range(i + 1, len(there))]
        pair_a, pair_b, joint = (np.array([p[k] for p in pairs], np.int64) for k in range(3))
        # What one term adds is below 1,000,000.
        packed = _pack(terms=distinct, starts=bounds, places=place, impacts=impact.astype(np.int32), highest=highest, pair_a=pair_a, pair_b=pair_b, joint=joint)
        return pa.RecordBatch.from_arrays(_row(docs, known, packed), names=[c.split()[0] for c in _SHARD.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, known, terms, postings in zip(*batch.columns, strict=True):
                lists, found = _unpack(terms), _unpack(postings)
                yield shard(docs.values, known.values, lists["terms"], lists["starts"], found["n"], found["places"], found["tfs"])

    return build


class Index:
    """Shards of all documents with the counts that weights need."""

    def __init__(self, shards: DataFrame, df: DataFrame, n_docs: int) -> None:
        self.shards, self.df, self.n_docs = shards, df, n_docs


def build_index(docs: DataFrame) -> Index:
    """The index of every row of ``docs`` (``doc_id``, ``text``; others are ignored). A
    row is a document, also where its id is null or repeated; a null text has no terms.
    Terms are told apart by 64-bit hashes. What reaches the driver: two counts and the
    PAIR_TERMS terms of most documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A row group for each row: readers hold one at a time, whatever the size of a file.
    one = {"parquet.block.row.count.limit": "1", "compression": "uncompressed"}
    forward = stage(rows.mapInArrow(_forward, _FORWARD), "forward", **one)
    total = forward.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_terms"))).first()
    # Already added up in the tasks: Spark adds behind the shuffle only.
    counts = forward.select("terms").mapInArrow(_document_counts, "term long, df long").repartition("term")
    df = stage(counts.groupBy("term").agg(F.sum("df").alias("df")), "df")
    common = df.orderBy(F.desc("df"), "term").limit(PAIR_TERMS).collect()
    pair_terms = [(r["term"], weight(total["n_docs"], r["df"])) for r in common]
    shards = stage(forward.select("docs", "known", "terms", "postings").mapInArrow(_shards(total["n_docs"], total["n_terms"], pair_terms), _SHARD), "shards", **one)
    return Index(shards, df, total["n_docs"])


class Units:
    """An item's terms in one shard, as units with bounds."""

    def __init__(self, shard: dict, terms: np.ndarray, weights: np.ndarray) -> None:
        at = np.searchsorted(shard["terms"], terms)
        at[at == len(shard["terms"])] = 0
        there = shard["terms"][at] == terms if len(shard["terms"]) else np.zeros(len(terms), bool)
        self.at, self.w, self.terms = at[there], weights[there], terms[there]
        self.bound = self.w * shard["highest"][self.at]

    def matched(self, joint: dict[tuple[int, int], int]) -> list[tuple[int, list[int]]]:
        """``(bound, members)`` of disjoint units, largest bound first. Pairs are taken
        by what they save against both maxima."""
        bound, left = self.bound.tolist(), set(range(len(self.bound)))
        common = [k for k, t in enumerate(self.terms.tolist()) if t in joint["terms"]]
        saved = []
        for x, i in enumerate(common):
            for j in common[x + 1:]:
                a, b = int(self.terms[i]), int(self.terms[j])
                most = max(bound[i], bound[j], joint["pairs"][min(a, b), max(a, b)])
                saved.append((bound[i] + bound[j] - most, i, j, most))
        units = []
        for gain, i, j, most in sorted(saved, reverse=True):
            if gain > 0 and i in left and j in left:
                left -= {i, j}
                units.append((most, [i, j]))
        return sorted(units + [(bound[k], [k]) for k in left], key=lambda u: -u[0])


def search_shard(shard: dict, joint: dict, terms: np.ndarray, weights: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """``(places, scores)`` of all documents of a shard that score at least ``floor``,
    which is 1 or more."""
    units = Units(shard, terms, weights)
    parts = units.matched(joint)
    rest = np.cumsum([b for b, _ in parts][::-1])[::-1].tolist() + [0]
    score = np.zeros(len(shard["docs"]), np.int64)
    starts, places, impacts = shard["starts"], shard["places"], shard["impacts"]
    candidates = None
    for k, (_, members) in enumerate(parts):
        if candidates is None and rest[k] < floor:
            # Whoever holds none of the units so far can't reach the floor.
            candidates = np.flatnonzero(score)
        if candidates is not None:
            candidates = candidates[score[candidates] + rest[k] >= floor]
            if not len(candidates):
                break
        for i in members:
            a, b = starts[units.at[i]], starts[units.at[i] + 1]
            found = places[a:b]
            if candidates is None or len(candidates) * 8 > b - a:
                score[found] += units.w[i] * impacts[a:b]
            else:
                where = np.searchsorted(found, candidates)
                where[where == len(found)] = 0
                hit = found[where] == candidates
                score[candidates[hit]] += units.w[i] * impacts[a + where[hit]]
    at = np.flatnonzero(score >= floor) if candidates is None else candidates[score[candidates] >= floor]
    return at, score[at]


def _searcher(items: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    """The best ``k`` documents of a task's shards for each item."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        floors = [1] * len(items)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("docs", "known")} | _unpack(batch.column("postings")[row])
                a, b = np.minimum(shard["pair_a"], shard["pair_b"]).tolist(), np.maximum(shard["pair_a"], shard["pair_b"]).tolist()
                joint = {"pairs": dict(zip(zip(a, b, strict=True), shard["joint"].tolist(), strict=True)), "terms": {*a, *b}}
                for i, (_, terms, weights) in enumerate(items):
                    at, score = search_shard(shard, joint, terms, weights, floors[i])
                    if not len(at):
                        continue
                    have = best[i]
                    score, ids, known = (np.concatenate(x) for x in zip(have, (score, shard["docs"][at], shard["known"][at]), strict=True))
                    # Without an id last among equals.
                    order = np.lexsort((ids, ~known, -score))[:k]
                    best[i] = score[order], ids[order], known[order]
                    if len(order) == k:
                        floors[i] = max(1, int(best[i][0][-1]))
        item = np.repeat(np.arange(len(items)), [len(b[0]) for b in best])
        score, ids, known = (np.concatenate([b[j] for b in best]) if best else np.zeros(0) for j in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array([items[j][0] for j in item.tolist()], pa.int64()), pa.array(ids, pa.int64(), mask=~known.astype(bool)),
             pa.array(score, pa.int64())], names=["item", "item_id", "doc_id", "score"])

    return search


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.unique(h[a:b]).view(np.int64) for _, _, data, offsets in text_blocks(batch) for h, first in [terms_of(data, offsets)]
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.as_py().encode()) for t in utf8_column(batch, "text")], pa.int64()),
                                          pa.array(rows, pa.list_(pa.int64()))], names=["item_id", "size", "terms"])


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for
    each distinct row of ``item_id, text``; equal scores by doc_id, null last. Items
    without terms find nothing; an item_id with several texts is searched for with each
    of them, ranked on its own. Items come to the driver in blocks of ITEM_BYTES of text
    (one longer item alone), the index is read once per block."""
    asked = stage(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().mapInArrow(
        _item_terms, "item_id long, size long, terms array<long>"), "items")
    block = F.floor(F.sum("size").over(Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)) / ITEM_BYTES)
    # Items are dealt into lots of bounded bytes; only their sizes meet in one task.
    asked = stage(asked.withColumn("lot", F.monotonically_increasing_id()), "lots")
    lots = stage(asked.select("lot", "size").withColumn("block", F.coalesce(block, F.lit(0)).cast("long")).select("lot", "block"), "blocks")
    found = None
    for b in sorted(r["block"] for r in lots.select("block").distinct().collect()):
        mine = asked.join(lots.where(F.col("block") == b), "lot")
        rows = mine.select("item_id", "terms").collect()
        df = {r["term"]: r["df"] for r in mine.select(F.explode("terms").alias("term")).distinct().join(index.df, "term").collect()}
        known = [(r["item_id"], [t for t in r["terms"] if t in df]) for r in rows]
        packed = [(i, np.array(t, np.int64), np.array([weight(index.n_docs, df[x]) for x in t], np.int64)) for i, t in known]
        part = index.shards.mapInArrow(_searcher(packed, k), "item long, item_id long, doc_id long, score long").withColumn("block", F.lit(b))
        found = part if found is None else found.union(part)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = F.desc("score"), F.col("doc_id").asc_nulls_last()
    # First within shares of the tasks, then over the shares.
    share = Window.partitionBy("block", "item", "share").orderBy(*best)
    found = found.withColumn("share", F.spark_partition_id() % 32).withColumn("_r", F.row_number().over(share)).where(F.col("_r") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*best))).where(
        F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
