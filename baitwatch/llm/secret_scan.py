"""Secrets in texts, judged by who else has them: candidate values are hashed, counted
by distinct repositories and owners over the whole corpus, and told apart as widely
copied examples or owner-specific, live-looking credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.llm.common import stage, utf8_column

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "owned")
LEAST = {"assign": 8, "access": 16, "hex": 32}
# Access keys, hex runs and bare credentials all lie in runs of these characters.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORDS = ("passw", "secret", "token", "api")
# A bare run is a candidate from this length, with both cases and digits.
BARE_LEAST = 20
# Values that say themselves that they are none.
PLACEHOLDERS = ("example", "sample", "changeme", "placeholder", "dummy", "redacted", "xxxx", "your", "test", "1234567", "abcdefg")
LEAST_ENTROPY = 3.0
# Owners from which a value is a widely copied example.
WIDE_OWNERS = 3
# Repositories from which a value of one owner is no single credential any more.
WIDE_REPOSITORIES = 100


def looks_live(value: str) -> bool:
    """Varied characters and no placeholder word."""
    low = value.lower()
    if any(w in low for w in PLACEHOLDERS):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= LEAST_ENTROPY


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int, int]]]:
    """Base spans ``(start, kind, end)`` and candidates ``(value, kind, start, end)``,
    the latter with the bare runs beside the base spans."""
    spans, values = [], []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                spans.append((m.start(), 0, m.end()))
                values.append((m[2], 0, m.start(), m.end()))
    bare = []
    for run in RUN.finditer(text):
        a, b = run.span()
        own = False
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(text, a, b):
                if m.end() - m.start() >= LEAST[KINDS[kind]]:
                    spans.append((m.start(), kind, m.end()))
                    values.append((m[0], kind, m.start(), m.end()))
                    own = True
        if not own and b - a >= BARE_LEAST:
            v = run[0]
            if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v):
                bare.append((v, 3, a, b))
    spans.sort()
    # Both lists ascend: of the spans before a run only the one that reaches furthest counts.
    reach, k = 0, 0
    for x in bare:
        while k < len(spans) and spans[k][0] < x[3]:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= x[2]:
            values.append(x)
    return spans, values


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("h", pa.binary()), ("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("live", pa.bool_())])
    for batch in batches:
        counts, digests, candidates = ([], [], []), [], []
        for text in utf8_column(batch, "text"):
            spans, values = find(text.as_py())
            for k, out in enumerate(counts):
                out.append(sum(1 for s in spans if s[1] == k))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())
            candidates.append([{"h": hashlib.blake2b(v.encode(), digest_size=16).digest(), "kind": k, "a": a, "b": b, "live": looks_live(v)}
                               for v, k, a, b in values])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(candidates, pa.list_(item))],
            names=["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"])


def ownership(scanned: DataFrame) -> DataFrame:
    """``h, n_owners, n_repositories`` of each candidate hash. Distinct repositories
    of an owner are counted before owners, each step combined before its shuffle; a
    null owner is the empty one, a null repository one of its own."""
    rows = scanned.select(F.explode(F.array_distinct(F.transform("candidates", lambda c: c["h"]))).alias("h"), F.coalesce("owner", F.lit("")).alias("owner"), "repository")
    pairs = rows.distinct().groupBy("h", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def verdict(n_owners: Column, n_repositories: Column, live: Column) -> Column:
    """Of many owners: an example. Of one owner alone, in few repositories: live if it
    looks so. What one owner has pasted all over is unclear."""
    return F.when(n_owners >= WIDE_OWNERS, "example").when(
        (n_owners == 1) & (n_repositories < WIDE_REPOSITORIES) & live, "live").otherwise("unclear")


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, n_repositories`` (of the value in it that most repositories have). Base
    spans always stay. A bare run of any length becomes an ``owned`` span if it is
    live-looking and one owner alone has its value, in few repositories. A null text is empty; repeated rows
    are scanned each, as one repository where they name one."""
    rows = docs.select(F.col("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scanned = stage(rows.mapInArrow(
        _scan, f"doc_id {id_type}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "candidates array<struct<h:binary,kind:int,a:int,b:int,live:boolean>>").withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = scanned.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).join(
        ownership(scanned).withColumnRenamed("h", "value"), F.col("c.h") == F.col("value"))
    judged = each.select("row", "c", verdict(F.col("n_owners"), F.col("n_repositories"), F.col("c.live")).alias("verdict"), "n_repositories")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = judged.withColumn("span", F.when((F.col("c.kind") < 3) | (F.col("verdict") == "live"), F.struct("c.a", "c.kind", "c.b")))
    found = shown.groupBy(F.col("row").alias("of")).agg(
        F.sort_array(F.collect_list("span")).alias("s"),
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"), F.count(F.when(F.col("verdict") == "example", 1)).alias("n_example"),
        F.max("n_repositories").alias("n_repositories"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["a"], x["b"])), ",")
    return scanned.join(found, F.col("row") == F.col("of"), "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("n_repositories", F.lit(0)).alias("n_repositories"))
