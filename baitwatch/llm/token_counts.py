"""Exact token counts at every prefix of a text, by dynamic programming over the byte
pair encoding: the last token of each prefix is the one that is compatible with the
last token of what stands before it, and the count is one more than there. Budgets and
truncations are answered from these counts, without encoding a prefix again."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitwatch.llm.common import utf8_column, worker_memo
from baitwatch.llm.token_files import _runs
from baitwatch.llm.token_pieces import LATIN_END, TEXT_BYTES, WHITE, WHITES, byte_letters, laid_out, pieces

# The pattern of byte-level BPE (fixed by the tokenizer).
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WHITE_ALL = "".join(sorted(WHITES))


class PrefixCounts:
    """Counts for the pieces of one vocabulary."""

    def __init__(self, spec: dict, pre) -> None:
        self.pre = pre
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {t["content"] for t in spec.get("added_tokens") or []}
        self.ids = {raw(t): k for t, k in spec["model"]["vocab"].items() if t not in special}
        self.bytes = {k: t for t, k in self.ids.items()}
        # Every beginning of a token; -1 where it is none itself.
        self.starts = {t[:k]: -1 for t in self.ids for k in range(1, len(t))} | self.ids
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Of each token the merge that makes it: its rank and its two parts.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made = {k: (-1, k, k) for k in self.bytes}
        for n, (a, b) in enumerate(merges):
            x, y, z = self.ids[raw(a)], self.ids[raw(b)], self.ids[raw(a + b)]
            self.ranks[x, y] = n
            if self.made[z][0] < 0:
                self.made[z] = (n, x, y)
        self.fits: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.longest = max(map(len, self.ids), default=0)
        # The last piece with its counts and the last tokens of its prefixes.
        self.last: tuple[bytes, list[int], list[int]] = (b"", [0], [-1])

    def _stay(self, x: int, y: int) -> bool:
        """True if the two tokens stay as they are when encoded together. The merges
        that made them are undone from the latest on; the pair that meets at the
        border in between must never come before the merge that was undone. Of equal
        ranks the left one comes first, so the border comes before the right token."""
        made, ranks = self.made, self.ranks
        limit = len(ranks)
        while True:
            if ranks.get((x, y), limit) < limit:
                return False
            a, b = made[x], made[y]
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                limit, x = a[0], a[2]
            else:
                limit, y = b[0] + 1, b[1]

    def piece(self, text: bytes) -> list[int]:
        """Tokens of every prefix of a piece, from the empty one on. Prefixes that the
        piece shares with the last one are taken from there: pieces come sorted."""
        n, shared = len(text), 0
        for x, y in zip(text, self.last[0], strict=False):
            if x != y:
                break
            shared += 1
        counts = self.last[1][:shared + 1] + [-1] * (n - shared)
        last = self.last[2][:shared + 1] + [-1] * (n - shared)
        find, fits, stay = self.starts.get, self.fits, self._stay
        for start in range(max(shared + 1 - self.longest, 0), n):
            before, count = last[start], counts[start] + 1
            for end in range(start + 1 if start > shared else shared + 1, n + 1):
                token = find(text[start:end])
                if token is None:
                    break
                if token < 0 or counts[end] >= 0:
                    continue
                if start:
                    key = before << 32 | token
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = stay(before, token)
                    if not fit:
                        continue
                counts[end], last[end] = count, token
        if len(fits) > 1_000_000:
            fits.clear()
        self.last = text, counts, last
        return counts

    def split(self, text: str) -> list[tuple[int, int]]:
        """Places of the pieces: at once for a word, with a mark after it, by the pattern
        for ASCII, else by the library, whose tables of letters and numbers may be of
        another Unicode version than Python's."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha() and max(body) < LATIN_END:
            return [(0, len(text))]
        if body[:-1].isalpha() and body[-1] in ".,;:!?" and max(body) < LATIN_END:
            return [(0, len(text) - 1), (len(text) - 1, len(text))]
        if text.isascii():
            return [m.span() for m in PATTERN.finditer(text)]
        return [at for _, at in self.pre.pre_tokenize_str(text)]

    def steps(self, piece: str) -> list[int]:
        """Tokens at every code point of a piece, from the empty prefix on."""
        known = self.known.get(piece)
        if known is None:
            known = self.piece(piece.encode())
            if not piece.isascii():
                ends = accumulate(1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in piece)
                known = [0, *[known[k] for k in ends]]
            if len(self.known) > 400_000:
                self.known.clear()
            if len(piece) <= 32:
                self.known[piece] = known
        return known

    def part(self, text: str) -> bytes:
        """Differences (int16) of the counts at every code point of a part, white space
        and what is visible after it. A cut in what is visible leaves the pieces before
        it as they are, and of its own piece the beginning: one walk over the pieces is
        enough. Only a contraction of two letters is none yet after the first of them."""
        spans = self.split(text)
        if len(spans) == 1 and text[0] != "'":
            steps = self.steps(text)
            return array("h", map(sub, steps[1:], steps)).tobytes()
        white = len(text) - len(text.lstrip(WHITE_ALL))
        # Leading white space is one piece however it is cut.
        counts, base = list(self.steps(text[:white])[1:]) if white > 1 else [], 0
        for a, b in spans:
            steps = self.steps(text[a:b])
            done = max(len(counts) - a, 0)
            counts += [base + c for c in steps[done + 1:]]
            if text[a:b] in ("'re", "'ve", "'ll"):
                counts[-2] = base + self.steps("'")[-1] + self.steps(text[a + 1])[-1]
            base += steps[-1]
        return array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()


def prefix_counts(texts: list[str], path: str) -> list[np.ndarray]:
    """For each text the token count at each of its prefixes of 1, 2, ... code points.
    Strings of special tokens inside a text are one token, as is the default; a prefix
    that ends inside one holds its letters."""
    tok = pieces(path)
    if not tok.chunked or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in tok.spec.get("added_tokens") or []):
        raise ValueError("prefix counts need a byte-level BPE with plain special tokens")
    state = worker_memo("prefix")
    if path not in state:
        state[path] = PrefixCounts(tok.spec, tok.library.pre_tokenizer)
    counter = state[path]
    cut = regex.compile("|".join(map(regex.escape, tok.specials))) if tok.specials else None
    parts, owner = [], []
    for k, text in enumerate(texts):
        at = 0
        for m in cut.finditer(text) if cut and any(s in text for s in tok.specials) else ():
            parts.append((text[at:m.end() - 1], m.start() - at))
            owner.append(k)
            at = m.end()
        parts.append((text[at:], None))
        owner.append(k)
    raw, at = laid_out(pa.array([t for t, _ in parts], pa.large_string()), f"prefix:{path}", lambda new: [counter.part(p) for p in new])
    steps, at = np.frombuffer(raw, "<i2"), (at // 2).tolist()
    out: list[list[np.ndarray]] = [[] for _ in texts]
    base = [0] * len(texts)
    for (_, inner), a, b, k in zip(parts, at, at[1:], owner, strict=False):
        counts = base[k] + np.cumsum(steps[a:b], dtype=np.int64)
        if inner is not None:
            base[k] = (int(counts[inner - 1]) if inner else base[k]) + 1
            counts = np.append(counts, base[k])
        out[k].append(counts)
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in out]


def _longest(counts: np.ndarray, most: int) -> int:
    """Code points of the longest prefix of at most so many tokens."""
    if not len(counts) or counts[-1] <= most:
        return len(counts)
    kept = np.flatnonzero(counts <= most)
    return int(kept[-1]) + 1 if len(kept) else 0


def _counter(path: str, budgets: list[int], store: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_column(batch, "text")
            lengths = np.array([len(x.as_buffer()) for x in texts], np.int64)
            for a, b in _runs(lengths, TEXT_BYTES):
                counts = prefix_counts(texts[a:b].to_pylist(), path)
                fits = [[_longest(c, most) for most in budgets] for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(lengths[a:b]), pa.array([int(c[-1]) if len(c) else 0 for c in counts], pa.int64()),
                     pa.array(fits, pa.list_(pa.int64())),
                     pa.array([c.astype(np.int32) for c in counts] if store else [None] * (b - a), pa.list_(pa.int32()))],
                    names=["doc_id", "n_bytes", "n_tokens", "fits", "prefix_tokens"])

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, budgets: list[int] = (), store: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, fits, prefix_tokens`` of every row, without begin,
    end or added tokens. ``fits`` has for each budget the longest prefix (in code
    points) of at most so many tokens; ``prefix_tokens`` the count at each prefix if
    ``store`` is set, else null. A null text is empty: 0 bytes, 0 tokens. No shuffle."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counter(tokenizer_path, list(budgets), store),
                           f"doc_id {id_type}, n_bytes long, n_tokens long, fits array<long>, prefix_tokens array<int>")


def within(counts: DataFrame, n_chars: int) -> DataFrame:
    """Tokens of each text cut after ``n_chars`` code points, from stored counts."""
    size = F.size("prefix_tokens")
    return counts.select("doc_id", F.when((size == 0) | F.lit(n_chars <= 0), 0).otherwise(
        F.get("prefix_tokens", F.least(size, F.lit(n_chars)) - 1)).alias("n_tokens"))
