"""Benchmark decontamination: word n-grams of the test items seed candidate passages of
the training texts, and Smith-Waterman alignment of passage and item scores exact,
edited and paraphrased copies. Every n-gram seeds, common ones too: a partial or edited
copy may hold no other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitwatch.llm.common import chain, key_filter, may_be, stage, text_blocks, utf8_column, words_of

SEED = 3
# An item counts as found from this part of its best possible score.
FOUND = 0.4
MATCH, MISMATCH, GAP = 2, -2, 2


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, data, offsets in text_blocks(batch):
            _, _, h, word = words_of(data, offsets, lower=True)
            seeds, n = chain(h, SEED), np.diff(word)
            own = np.repeat(np.arange(last - first), np.maximum(n - SEED + 1, 0))
            at = np.concatenate([np.arange(a, b - SEED + 1) for a, b in zip(word[:-1], word[1:], strict=True)] or [np.zeros(0, int)])
            yield pa.RecordBatch.from_arrays(
                [ids[first:last].take(pa.array(own)), pa.array(seeds[at].view(np.int64)), pa.array(n[own], pa.int64())],
                names=["item_id", "seed", "n_words"])


def _hits(bits: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Words of a block and the seeds that pass the filter: ``(start, end, first word
    of each text, seed, its first word, its text)``."""
    start, end, h, word = words_of(data, offsets, lower=True)
    seeds = chain(h, SEED)
    at = may_be(bits, seeds)
    text = np.searchsorted(word, at, "right") - 1
    inside = at + SEED <= word[text + 1]
    return start, end, word, seeds[at][inside], at[inside], text[inside]


def _passages(bits: np.ndarray, margin: int):
    """Runs of hits at most ``margin`` words apart, with ``margin`` words around."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, passages, seeds = batch.column(0), [], [], []
            for first, _, data, offsets in text_blocks(batch):
                start, end, word, seed, at, text = _hits(bits, data, offsets)
                if not len(at):
                    continue
                breaks = np.flatnonzero((np.diff(at) > margin) | (np.diff(text) > 0)) + 1
                for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)], strict=True):
                    t = int(text[a])
                    low, high = max(at[a] - margin, word[t]), min(at[b - 1] + SEED + margin, word[t + 1])
                    rows.append(first + t)
                    passages.append(data[start[low]:end[high - 1]].tobytes().decode("utf-8", "replace"))
                    seeds.append(np.unique(seed[a:b]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(passages, pa.string()), pa.array(seeds, pa.list_(pa.int64()))],
                names=["doc_id", "passage", "seeds"])

    return cut


def align(passage: np.ndarray, item: np.ndarray) -> int:
    """Smith-Waterman score of two word sequences (as numbers), a row per item word."""
    slide = GAP * np.arange(len(passage) + 1)
    above, best = np.zeros(len(passage) + 1, np.int64), 0
    for w in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] - GAP)
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + slide) - slide
        best = max(best, int(above.max(initial=0)))
    return best


def _score(found: float):
    """Scores of the pairs that can reach ``found``: no score exceeds the part of the
    item's words that the passage has, so a pair under it needs no alignment."""
    def sequence(text: str) -> np.ndarray:
        raw = text.encode()
        return words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True)[2]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[str, str], float | None] = {}
            rows, scores = [], []
            for k, (p, q) in enumerate(zip(utf8_column(batch, "passage").to_pylist(), utf8_column(batch, "item").to_pylist(), strict=True)):
                if (p, q) not in known:
                    passage, item = sequence(p), sequence(q)
                    most = np.count_nonzero(np.isin(item, passage)) / len(item)
                    known[p, q] = align(passage, item) / (MATCH * len(item)) if most >= found else None
                if known[p, q] is not None:
                    rows.append(k)
                    scores.append(known[p, q])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(scores, pa.float64())],
                                             names=["doc_id", "item_id", "score"])

    return score


def contaminated(docs: DataFrame, benchmark: DataFrame, found: float = FOUND) -> DataFrame:
    """``doc_id, item_id, score`` of every document and test item whose alignment
    reaches ``found`` of the item's best possible score (1.0: the whole item word for
    word, A-Z in either case), if three words in a row are the same. Documents need
    ``doc_id, text``, items ``item_id, text``; null texts are empty, items of under
    three words seed nothing and are not found. Rows of one id are one document: the
    best score counts. Rows with a null doc_id are reported under null."""
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    seeds = stage(items.mapInArrow(_item_seeds, f"item_id {item_type}, seed long, n_words long").distinct(), "seeds")
    texts = items.select("item_id", F.col("text").alias("item")).distinct()
    # Items of about one length (a power of two of words) at a time: a long item widens
    # the passages of no short one. There are as many classes as a length has bits.
    length = F.ceil(F.log2("n_words")).cast("int")
    scored = None
    for r in seeds.select(length.alias("c")).distinct().collect() or [None]:
        mine = seeds if r is None else seeds.where(length == r["c"])
        passages = stage(docs.mapInArrow(_passages(key_filter(mine, "seed"), 1 << (r["c"] if r else 0)), f"doc_id {id_type}, passage string, seeds array<long>").withColumn(
            "p", F.monotonically_increasing_id()), "passages")
        pairs = passages.select("p", F.explode("seeds").alias("seed")).join(mine.select("seed", "item_id"), "seed").select("p", "item_id").distinct()
        part = pairs.join(passages, "p").join(texts, "item_id").select("doc_id", "item_id", "passage", "item").mapInArrow(
            _score(found), f"doc_id {id_type}, item_id {item_type}, score double")
        scored = part if scored is None else scored.union(part)
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score")).where(F.col("score") >= found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, found: float = FOUND) -> DataFrame:
    """Documents in which no item was found, columns as in the input. Each text is judged
    by itself, also those of rows with a null or repeated doc_id."""
    # Named by the columns' own text, so rows need no id.
    name = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    bad = contaminated(docs.select(name.alias("doc_id"), "text"), benchmark, found).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, name == F.col("_bad"), "left_anti").select(docs.columns)
