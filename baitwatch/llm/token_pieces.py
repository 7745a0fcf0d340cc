"""Texts cut into parts that a byte-level BPE encodes one by one, so that repeated
parts are encoded once in a worker. Parts are cut and counted as whole columns; only
the distinct ones of a block of texts become Python strings."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from baitwatch.llm.common import worker_memo

# The white space that the tokenizer's pattern knows (fixed by Unicode), as a class of
# a pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Parts that a worker keeps; longer ones are not kept. Workers are reused, so this
# memory stays while other steps run.
PARTS = 800_000
MEMO_CHARS = 64
# Bytes of texts that are cut and looked up at once.
TEXT_BYTES = 4 << 20
# Letters below are the same in all Unicode versions in use.
LATIN_END = "\u0220"
# Parts that are encoded as one text.
JOINED = 500

WHITES = frozenset(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))


def _kinds(n: int) -> np.ndarray:
    """Kinds of the characters of ``n`` bytes, by their bytes as one number: 1 white
    space, 2 a letter below LATIN_END, 3 another character below it, 0 above."""
    out = np.zeros(1 << 8 * min(n, 2), np.uint8)
    for c in map(chr, range(0x80 if n == 1 else 0x800)):
        if len(c.encode()) == n:
            out[int.from_bytes(c.encode(), "big")] = 1 if c in WHITES else 0 if c >= LATIN_END else 2 if c.isalpha() else 3
    return out


_ONE, _TWO = _kinds(1), _kinds(2)
_THREE = [int.from_bytes(c.encode(), "big") for c in sorted(WHITES) if len(c.encode()) == 3]
# First bytes of characters of two bytes, and of white space of three.
_LEAD = np.zeros(256, np.uint8)
_LEAD[0xC2:0xE0] = 2
_LEAD[[c >> 16 for c in _THREE]] = 3


class Pieces:
    """A tokenizer file. ``chunked`` tells whether it may be used chunk by chunk:
    byte-level BPE with the usual pattern and no normaliser. A run of white space and
    the visible run after it make a chunk: no piece of the pattern holds a visible
    character before white space, and its look-ahead stays inside the chunk."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        pre, added = self.spec.get("pre_tokenizer") or {}, self.spec.get("added_tokens") or []
        self.specials = [t["content"] for t in added]
        # Bytes of each token: byte-level vocabularies write one letter per byte.
        self.lengths = np.zeros(max(self.spec["model"]["vocab"].values(), default=0) + 1 if isinstance(self.spec["model"]["vocab"], dict) else 1, np.int64)
        if isinstance(self.spec["model"]["vocab"], dict):
            for token, k in self.spec["model"]["vocab"].items():
                self.lengths[k] = len(token)
        self.chunked = (
            self.spec["model"]["type"] == "BPE" and not self.spec.get("normalizer")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        self.feed = len(self.library.encode("\n", add_special_tokens=False).ids)

    def whole(self, text: str) -> bool:
        """True if the text has to go to the library as a whole."""
        return not self.chunked or any(s in text for s in self.specials)

    def encode(self, parts: list[str]) -> list[bytes]:
        """Ids (uint32) of each part. Parts that end with something visible are encoded
        many at a time, as one text: each begins with white space, or with a line feed
        put before it, so the text has the same pieces, and the bytes of its tokens tell
        where each part ends."""
        out: list[bytes | None] = [None] * len(parts)
        joins = self.chunked and WHITES.isdisjoint("".join(self.specials))
        plain = [k for k, c in enumerate(parts) if joins and c and c[-1] not in WHITES]
        groups = [plain[a:a + JOINED] for a in range(0, len(plain), JOINED)]
        texts = [[c if (c := parts[k])[0] in WHITES else "\n" + c for k in g] for g in groups]
        for group, text, e in zip(groups, texts, self.library.encode_batch_fast(["".join(t) for t in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in text])
            upto = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(upto, ends)
            if cuts[-1] < len(upto) and np.array_equal(upto[cuts], ends):
                raw, a = ids.tobytes(), 0
                for k, c, b in zip(group, text, (4 * cuts + 4).tolist(), strict=True):
                    out[k] = raw[a:b] if c is parts[k] else raw[a + 4 * self.feed:b]
                    a = b
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.library.encode_batch_fast([parts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32).tobytes()
        return out


@lru_cache
def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others for letters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces(path: str) -> Pieces:
    memo = worker_memo("pieces")
    if path not in memo:
        memo[path] = Pieces(path)
    return memo[path]


def _kind_of(raw: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 texts is part of."""
    kind, lead = _ONE[raw], _LEAD[raw]
    at = np.flatnonzero(lead == 2)
    kind[at] = kind[at + 1] = _TWO[raw[at].astype(np.uint16) << 8 | raw[at + 1]]
    at = np.flatnonzero(lead == 3)
    at = at[np.isin(raw[at].astype(np.int32) << 16 | raw[at + 1].astype(np.int32) << 8 | raw[at + 2], _THREE)]
    kind[at] = kind[at + 1] = kind[at + 2] = 1
    return kind


def parts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts (large strings) in order, and the place of the first one
    of each text, the end included. Chunks are cut again after letters that something
    visible but no letter follows, and after a line feed that is all their white space:
    there a piece of the pattern ends whatever stands on the other side. Past LATIN_END
    nothing is cut, since letters differ between Unicode versions."""
    _, where, data = texts.buffers()
    bounds = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    kind = _kind_of(raw)
    white, texts_at = kind == 1, bounds[bounds < len(raw)]
    begins = white.copy()
    begins[1:] &= ~white[:-1]
    begins[texts_at] = True
    feeds = np.flatnonzero(begins[:-1] & (raw[:-1] == 10) & ~white[1:])
    begins[1:] |= (kind[:-1] == 2) & (kind[1:] == 3)
    begins[feeds + 1] = True
    first = np.flatnonzero(begins)
    parts = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.append(first, len(raw))), pa.py_buffer(raw)])
    return parts, np.searchsorted(first, bounds)


def values_of(parts: list[str], name: str, make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """What ``make`` gives for each part. A worker keeps what parts gave, those asked for
    last the longest; ``make`` gets what is lacking, sorted."""
    memo, older = worker_memo(f"parts:{name}"), worker_memo(f"older:{name}")
    if len(memo) > PARTS // 2:
        older.clear()
        older.update(memo)
        memo.clear()
    needed = [p for p in parts if p not in memo]
    memo.update((p, older[p]) for p in needed if p in older)
    needed = sorted(p for p in needed if p not in older)
    memo.update(zip(needed, make(needed), strict=True))
    out = list(map(memo.__getitem__, parts))
    for p in needed:
        if len(p) > MEMO_CHARS:
            del memo[p]
    return out


def laid_out(texts: pa.Array, name: str, make: Callable[[list[str]], list[bytes]]) -> tuple[bytes | pa.Buffer, np.ndarray]:
    """What ``make`` gives for the parts of all texts (large strings), one behind the
    other, and the place of each text's first byte there, the end included. Each
    distinct part of the texts is looked up once."""
    parts, first = parts_of(texts)
    if not len(parts):
        return b"", first
    coded = parts.dictionary_encode()
    line = pa.array(values_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), name, make), pa.large_binary()).take(coded.indices)
    _, where, data = line.buffers()
    return data, np.frombuffer(where, np.int64, len(line) + 1)[first]
