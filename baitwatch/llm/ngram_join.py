"""Jaccard join of documents on word shingles by a grouped prefix join.

Shingles are 64-bit hashes. Documents of one shingle set make a class, named by a
128-bit digest. One pass over the texts deals all tokens into buckets by their value;
in a bucket the classes of each token are counted exactly, and a token of two classes or
more is reported to each of them. What a class doesn't share can't be in common with
anyone: a class that shares under four fifths of its set links with nothing and is done.

Of the others, tokens stand in order of the number of their classes, those of one class
first. Two sets of a Jaccard of 0.8 have their first common token where enough is left
of both behind it; that decides which tokens are a prefix and which meetings count.
Sets with the same size and prefix form one group; groups meet through prefix tokens,
and are then expanded to their sets, which are compared in full.

Only the components are asked for, so pairs that are already connected are never
compared: groups are first held against one leader per token, then every remaining
pair across components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.llm.common import chain, forget, stage, text_blocks, words_of

SHINGLE = 5
# Rounds in which groups meet one leader per token, before every remaining pair across
# components is held against each other; they save pairs, not results.
ROUNDS = 2
# Tokens that a task sorts at once, and tokens meant for one bucket. An executor holds as
# many of them as it has cores, beside its JVM.
CHUNK_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 20
# In a bucket that overflows, a token of more classes counts as this common: the order
# among such tokens is by value, and their entries need not be held.
COMMON = 1 << 16


def block_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text of a block: distinct runs of ``size`` words,
    A-Z lower-cased; with fewer words the whole sequence; empty without words."""
    _, _, h, first = words_of(data, offsets, lower=True)
    runs = chain(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a:b - size + 1])
        else:
            yield chain(h[a:b], b - a) if b > a else runs[:0]


def packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens (uint64) as the first one and differences of one width."""
    if not len(tokens):
        return b""
    steps = np.diff(tokens)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + tokens[:1].tobytes() + np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[1:, :width] = raw
    out = steps.view(np.uint64).reshape(-1)
    out[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


_DEALT = "dest int, row bigint, n int, digest binary, mark binary, chunk bigint, tokens binary, owner binary"
_NAMES = [c.split()[0] for c in _DEALT.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]


def _rows(**columns) -> pa.RecordBatch:
    """Rows of ``_DEALT``; columns left out are null."""
    n = len(columns["dest"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _deal(buckets: int):
    """Three kinds of rows. Per document its id, size and digest of its set, MD5 of its
    text. Per chunk of classes their digests (``tokens``) and sizes (``owner``). Per chunk
    and bucket the tokens and, of each, the class by its place among those that are there
    (``owner``: their number, eight bytes of each one's digest, its place in the chunk,
    then two bytes per token)."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("powers")
        part = TaskContext.get().partitionId()
        n_chunks, held, size, seen = 0, [], 0, {}

        def chunk() -> pa.RecordBatch:
            nonlocal n_chunks
            number = part << 24 | n_chunks
            n_chunks += 1
            tokens = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(s) for s in held])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            names = np.frombuffer(b"".join(seen), np.uint64).reshape(-1, 2)[:, 0]
            dest, blobs, owners = [number % buckets], [b"".join(seen)], [np.array([len(s) for s in held], np.uint32).tobytes()]
            for b in range(buckets):
                a, e = int(cuts[b]), int(cuts[b + 1])
                if a < e:
                    there, local = np.unique(owner[a:e], return_inverse=True)
                    dest.append(b)
                    blobs.append(packed(tokens[a:e]))
                    owners.append(len(there).to_bytes(4, "little") + names[there].tobytes() + there.tobytes() + local.astype(np.uint16).tobytes())
            return _rows(dest=dest, chunk=[number] * len(dest), tokens=blobs, owner=owners, n=[-1] + [None] * (len(dest) - 1))

        for batch in batches:
            n, digest, mark = [], [], []
            for _, _, data, offsets in text_blocks(batch):
                mark += [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                for s in block_sets(data, offsets):
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    n.append(len(s))
                    digest.append(d)
                    if len(s) and d not in seen:
                        if size + len(s) > CHUNK_TOKENS and held or len(held) == 1 << 16:
                            yield chunk()
                            held, size, seen = [], 0, {}
                        seen[d] = None
                        held.append(s)
                        size += len(s)
            yield _rows(dest=[(part + k) % buckets for k in range(len(n))], row=batch.column(0), n=n, digest=digest, mark=mark)
        if held:
            yield chunk()

    return deal


class Bucket:
    """Tokens with the classes that hold them, of one bucket. An entry is a token, eight
    bytes of its class's digest, by which the classes of a token are told apart, and the
    chunk and place from which it came."""

    def __init__(self) -> None:
        self.tokens, self.names, self.chunks, self.places, self.size, self.limit = [], [], [], [], 0, 2 * BUCKET_TOKENS
        self.numbers: list[int] = []
        self.saturated = np.zeros(0, np.uint64)

    def add(self, chunk: int, tokens: bytes, owner: bytes) -> Iterator[tuple[int, bytes, bytes]]:
        there = int.from_bytes(owner[:4], "little")
        names, places = np.frombuffer(owner, np.uint64, there, 4), np.frombuffer(owner, np.uint16, there, 4 + 8 * there)
        local = np.frombuffer(owner, np.uint16, offset=4 + 10 * there)
        self.tokens.append(unpacked(tokens))
        self.names.append(names[local])
        self.places.append(places[local])
        self.chunks.append(np.full(len(local), len(self.numbers), np.uint32))
        self.numbers.append(chunk)
        self.size += len(local)
        if self.size > self.limit:
            yield from self.fold(False)
            self.limit = max(self.limit, 2 * self.size)

    def _taken(self, name: str) -> np.ndarray:
        """A column as one array; its pieces are let go."""
        out = np.concatenate(getattr(self, name))
        setattr(self, name, [])
        return out

    def fold(self, last: bool) -> Iterator[tuple[int, bytes, bytes]]:
        """``(chunk, tokens, places and counts)`` of reported tokens: in the end all of two
        classes or more, and before, where too many are held, those that are saturated."""
        if not self.tokens:
            return
        # A column at a time, so that no more than one is held twice.
        tokens, names = self._taken("tokens"), self._taken("names")
        order = np.lexsort((names, tokens))
        tokens, names = tokens[order], names[order]
        chunks, places = self._taken("chunks")[order], self._taken("places")[order]
        del order
        new = np.r_[True, tokens[1:] != tokens[:-1]]
        first = np.flatnonzero(new)
        new[1:] |= names[1:] != names[:-1]
        if last:
            del names
        runs, classes = np.diff(np.r_[first, len(tokens)]), np.add.reduceat(new, first, dtype=np.int64)
        full = np.isin(tokens[first], self.saturated) | (classes > COMMON)
        if not last:
            self.saturated = np.union1d(self.saturated, tokens[first][full])
        count = np.repeat(np.where(full, COMMON, classes).astype(np.uint32), runs)
        by = np.flatnonzero(np.repeat(full | (last & (classes > 1)), runs))
        by = by[np.argsort(chunks[by], kind="stable")]
        cuts = np.searchsorted(chunks[by], np.arange(len(self.numbers) + 1))
        for k, number in enumerate(self.numbers):
            at = by[cuts[k]:cuts[k + 1]]
            if len(at):
                yield number, packed(tokens[at]), places[at].tobytes() + count[at].tobytes()
        if last:
            return
        # Equal entries of one class are kept all: each has its own chunk to report to.
        keep = ~np.repeat(full, runs)
        self.tokens, self.names, self.chunks, self.places = [tokens[keep]], [names[keep]], [chunks[keep]], [places[keep]]
        self.size = int(keep.sum())


def _count(buckets: int):
    """Rows of documents and chunks pass; buckets, one after the other, become reports to
    the chunks from which their tokens came."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(reports: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            for chunk, tokens, owner in reports:
                yield _rows(dest=[chunk % buckets], chunk=[chunk], tokens=[tokens], owner=[owner])

        forget()
        bucket, held = None, Bucket()
        for batch in batches:
            dealt = pc.and_(pc.is_valid(batch.column(5)), pc.is_null(batch.column(2)))
            yield batch.filter(pc.invert(dealt))
            for k in np.flatnonzero(dealt.to_numpy(zero_copy_only=False)).tolist():
                dest, chunk, tokens, owner = (batch.column(c)[k].as_py() for c in (0, 5, 6, 7))
                if dest != bucket:
                    yield from sent(held.fold(True))
                    bucket, held = dest, Bucket()
                yield from sent(held.add(chunk, tokens, owner))
        yield from sent(held.fold(True))

    return count


_COUNTED = "row bigint, n int, digest binary, mark binary, toks array<bigint>"


def classes_of(digests: bytes, sizes: bytes, reports: list[tuple[bytes, bytes]]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Digest, size and shared tokens (rarest first) of the classes of a chunk that may
    link: those that share four fifths of their set."""
    n = np.frombuffer(sizes, np.uint32).astype(np.int64)
    tokens, places, counts = [], [], []
    for t, o in reports:
        tokens.append(unpacked(t))
        k = len(tokens[-1])
        places.append(np.frombuffer(o, np.uint16, k))
        counts.append(np.frombuffer(o, np.uint32, k, 2 * k))
    if not tokens:
        return [], n[:0], []
    token, place, count = np.concatenate(tokens), np.concatenate(places), np.concatenate(counts)
    order = np.lexsort((token, count, place))
    token, place = token[order], place[order]
    # A token that left an overflowing bucket may have been reported twice.
    once = np.r_[True, (token[1:] != token[:-1]) | (place[1:] != place[:-1])]
    token, place = token[once], place[once]
    cuts = np.searchsorted(place, np.arange(len(n) + 1))
    keep = np.flatnonzero((np.diff(cuts) * 10 >= n * 8) & (np.diff(cuts) > 0))
    return [digests[16 * k:16 * k + 16] for k in keep.tolist()], n[keep], [token[cuts[k]:cuts[k + 1]].view(np.int64) for k in keep.tolist()]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents pass; of each chunk, one after the other, its classes come out."""
    names = [c.split()[0] for c in _COUNTED.split(", ")]

    def classes() -> pa.RecordBatch:
        digests, n, toks = classes_of(*head, reports)
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.nulls(len(n), pa.binary()),
                                           pa.array(toks, pa.list_(pa.int64()))], names=names)

    forget()
    chunk, head, reports = None, None, []
    for batch in batches:
        rows = batch.filter(pc.is_null(batch.column(5)))
        yield pa.RecordBatch.from_arrays([*rows.columns[1:5], pa.nulls(rows.num_rows, pa.list_(pa.int64()))], names=names)
        for k in np.flatnonzero(pc.is_valid(batch.column(5)).to_numpy(zero_copy_only=False)).tolist():
            n, number, tokens, owner = (batch.column(c)[k].as_py() for c in (2, 5, 6, 7))
            if number != chunk:
                if head:
                    yield classes()
                chunk, head, reports = number, None, []
            if n is not None:
                head = tokens, owner
            else:
                reports.append((tokens, owner))
    if head:
        yield classes()


def _sizes_fit(n: str, m: str) -> Column:
    return (F.col(n) * 100 >= F.col(m) * 80) & (F.col(m) * 100 >= F.col(n) * 80)


def connected(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable through ``a, b`` links, for every
    node that has one. Labels take the least of the neighbours' and then of their own
    label's, so chains halve; each step is a written table."""
    edges = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(
            F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = stage(labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "near")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = stage(step.join(up, "label").select("node", F.least("label", "above").alias("label"), "old"), "labels")
        if not labels.where("label < old").limit(1).count():
            return labels.select("node", "label")


def _signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, n, digest, mark`` of every row (its doc_id, size and digest of its set, MD5
    of its text), and the classes that may
    link: ``c, n, e, toks``, the class, its size, the number of its shared tokens and
    these, rarest first. A chunk of classes is dealt into buckets and each bucket reports
    back to the chunk, so no digest travels with a token."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    # A word and its separator have six bytes or so: a shingle per word.
    buckets = max(8, -(-size // (6 * BUCKET_TOKENS)))
    dealt = docs.mapInArrow(_deal(buckets), _DEALT).repartitionById(buckets, F.col("dest")).sortWithinPartitions("dest")
    counted = dealt.mapInArrow(_count(buckets), _DEALT).repartitionById(buckets, F.col("dest")).sortWithinPartitions("chunk")
    both = stage(counted.mapInArrow(_gather, _COUNTED), "counted")
    # A class of several chunks comes from each of them, the same every time.
    shared = both.where("toks is not null").select(F.col("digest").alias("c"), "n", "toks").dropDuplicates(["c"])
    shared = stage(shared.withColumn("e", F.size("toks")), "shared")
    return both.where("toks is null").select("row", "n", "digest", "mark"), shared


def class_components(shared: DataFrame) -> DataFrame:
    """``node, label`` of the classes that are linked with others."""
    # Behind the token at place p of a set n - p tokens are left with it; to have four
    # fifths of the set in common, p is a fifth at most.
    prefix = F.slice("toks", F.lit(1), F.greatest(F.lit(0), F.floor(F.col("n") / 5).cast("int") + 1 - (F.col("n") - F.col("e"))))
    grouped = shared.withColumn("prefix", prefix).where(F.size("prefix") > 0)
    grouped = stage(grouped.select("c", "n", "e", "prefix", F.sha2(F.concat_ws(",", "n", "e", F.col("prefix").cast("array<string>")), 256).alias("g")), "grouped")
    classes = grouped.select("g", "c")
    index = grouped.groupBy("g").agg(F.first("n").alias("n"), F.first("e").alias("e"), F.first("prefix").alias("prefix"))
    index = stage(index.select("g", "n", "e", F.posexplode("prefix").alias("k", "tok")).withColumn("at", F.col("n") - F.col("e") + F.col("k")).drop("k"), "index")

    def fits(n: str, e: str, at: str, m: str, f: str, to: str) -> Column:
        """Groups whose first common token this may be: enough is shared, and left."""
        need = (F.col(n) + F.col(m)) * 4
        left = F.least(F.col(n) - F.col(at), F.col(m) - F.col(to))
        return _sizes_fit(n, m) & (F.least(F.col(e), F.col(f)) * 9 >= need) & (left * 9 >= need)

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs of classes, compared by all tokens they share with anyone."""
        side = lambda c, n, t: shared.select(F.col("c").alias(c), F.col("n").cast("long").alias(n), F.col("toks").alias(t))
        both = pairs.join(side("a", "n", "s"), "a").join(side("b", "m", "t"), "b")
        common = both.select("a", "b", "n", "m", F.size(F.array_intersect("s", "t")).cast("long").alias("o"))
        return stage(common.select("a", "b", (F.col("o") * 100 >= (F.col("n") + F.col("m") - F.col("o")) * 80).alias("linked")), "verified")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def open_index(sets: DataFrame) -> DataFrame:
        """The index of tokens at which sets of two groups and two components meet. A
        group's part is its component, or the group alone if it has sets of several."""
        of = sets.groupBy("g").agg(F.min("label").alias("l1"), F.max("label").alias("l2"))
        rows = index.join(of, "g")
        open_ = rows.groupBy("tok").agg(F.min("l1").alias("l1"), F.max("l2").alias("l2"), F.min("g").alias("g1"), F.max("g").alias("g2")).where(
            "l1 <> l2 and g1 <> g2").select("tok")
        part = F.when(F.col("l1") == F.col("l2"), F.struct("l1", F.lit("").alias("own"))).otherwise(F.struct("l1", F.col("g").alias("own")))
        return stage(rows.join(open_, "tok", "left_semi").select("tok", "g", "n", "e", "at", part.alias("part")), "open")

    def labelled(labels: DataFrame) -> DataFrame:
        return stage(classes.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").select(
            "g", "c", F.coalesce("label", "c").alias("label")), "sets")

    sets = stage(classes.withColumn("label", F.col("c")), "sets")
    done = links = labels = None
    for _ in range(ROUNDS):
        rows = open_index(sets)
        # The leader is what shares most of itself: of edited copies, the original.
        rank = F.struct((F.col("e") / F.col("n")).alias("r"), "g", "n", "e", "at", "part")
        best = rows.groupBy("tok", "part").agg(F.max(rank).alias("m"))
        lead = best.groupBy("tok").agg(F.max("m").alias("f")).select("tok", *(F.col(f"f.{c}").alias(f"_{c}") for c in ("g", "n", "e", "at", "part")))
        meet = best.select("tok", "m.*").join(lead, "tok").where((F.col("part") != F.col("_part")) & fits("n", "e", "at", "_n", "_e", "_at"))
        meet = meet.select("g", F.col("_g").alias("h")).distinct()
        first = sets.groupBy("g").agg(F.min("c").alias("y"))
        # All sets of a group against the first one of the leading group, and of their own.
        pairs = meet.join(sets.select("g", F.col("c").alias("x")), "g").join(first.withColumnRenamed("g", "h"), "h").select("x", "y").union(
            sets.select("g", F.col("c").alias("x")).join(first, "g").select("x", "y"))
        new = ordered(pairs)
        checked = verify(new if done is None else new.join(done, ["a", "b"], "left_anti"))
        done = checked if done is None else done.union(checked)
        if labels is not None and not checked.where("linked").limit(1).count():
            break
        found = checked.where("linked").select("a", "b")
        links = found if links is None else links.union(found)
        labels = connected(links)
        sets = labelled(labels)

    # Every remaining pair across components. Of each token the part with most groups
    # stands on one side only, so it is never paired within itself.
    rows = open_index(sets)
    most = rows.groupBy("tok", "part").agg(F.count("*").alias("k")).groupBy("tok").agg(
        F.max(F.struct("k", "part")).alias("m")).select("tok", F.col("m.part").alias("main"))
    few = rows.join(most, "tok").where("part <> main")
    other = rows.select("tok", *(F.col(c).alias(f"_{c}") for c in ("g", "n", "e", "at", "part")))
    met = few.join(other, "tok").where(
        (F.col("part") != F.col("_part")) & ((F.col("_part") == F.col("main")) | (F.col("g") < F.col("_g")))
        & fits("n", "e", "at", "_n", "_e", "_at"))
    met = met.select(F.least("g", "_g").alias("g"), F.greatest("g", "_g").alias("h")).distinct()
    left, right = sets.select("g", F.col("c").alias("x"), F.col("label").alias("l")), sets.select(F.col("g").alias("h"), F.col("c").alias("y"), F.col("label").alias("m"))
    several = sets.groupBy("g").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("g", F.col("g").alias("h"))
    rest = met.union(several).join(left, "g").join(right, "h").where("l <> m").select("x", "y")
    last = verify(ordered(rest).join(done, ["a", "b"], "left_anti"))
    return connected(links.union(last.where("linked").select("a", "b"))) if last.where("linked").limit(1).count() else labels


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, n, digest, mark`` of every row and ``digest, node`` of the classes that have one."""
    signed, shared = _signed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return signed, class_components(shared).select(F.col("node").alias("digest"), F.col("label").alias("node"))


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row. A null text is an empty one;
    empty sets are linked with nothing and have their own id. Equal texts always share
    a component. Repeated rows of one doc_id are judged each by its own text. A row with
    a null doc_id links like others; the smallest id of a component is that of a row
    that has one, and null where none has. Needs ``doc_id`` and ``text``; others are
    ignored. A worker holds one text with about 60 bytes of memory per byte of it, or
    a chunk of CHUNK_TOKENS tokens or a bucket, whichever is more."""
    signed, nodes = _joined(docs)
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("c"))
    of = classes.join(nodes, "digest", "left").withColumn("node", F.coalesce("node", "digest"))
    least = of.groupBy("node").agg(F.min("c").alias("component"))
    of = of.join(least, "node").select("digest", "component")
    return signed.join(of, "digest", "left").select(
        F.col("row").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("row")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id (null last; of texts of
    one id that with the smallest digest; of equal rows one); columns as in the input.
    Texts without words stay, equal rows of one id once."""
    signed, nodes = _joined(docs)
    of = signed.join(nodes, "digest", "left").withColumn("node", F.coalesce("node", "digest"))
    first = of.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("row").isNull().alias("none"), "row", "digest", "mark")).alias("f"))
    keys = first.select("f.row", "f.mark").union(of.where("n = 0").select("row", "mark").distinct())
    key = lambda i, m: F.concat(F.coalesce(i.cast("long").cast("string"), F.lit("")), F.lit("|"), m)
    keyed = docs.withColumn("_key", key(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    wanted = keys.select(key(F.col("row"), F.lower(F.hex("mark"))).alias("_key"))
    return keyed.dropDuplicates(["_key"]).join(wanted, "_key", "left_semi").select(docs.columns)
