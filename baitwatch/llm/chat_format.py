"""Chat formatting with black-box templates.

A template is any function from a list of ``(role, text)`` turns to a string. Nothing
else about it is known, so each turn is located by rendering: the output for the turns
up to it, less the output for the turns before it, is its span. A turn under the loss
is rendered once more with a mark in place of its text; what stands before and after
the mark frames the text. A template whose output for more turns does not begin with
its output for fewer turns rewrites history; the turn at which this shows is reported
and the conversation is not formatted.

Conversations are cut into blocks of turns, so one of any length is rendered by many
tasks. Every turn is rendered after all turns before it: the cost of a conversation
grows with the square of its turns, spread over its blocks. A template of which more is
known says so by ``looks_back``: then only so many turns before are rendered again, with
the same output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitwatch.llm.common import stage
from baitwatch.llm.turns import numbered

Template = Callable[[list[tuple[str, str]]], str]

BLOCK = 128
# Stands for a turn's text where the text's place is looked for; private use, so that
# templates do not write it themselves.
MARK = "\ue000\ue001"

# Control strings of the marked template, without their first character.
_REST = r"(?:/?s>|/?INST\]|OUT\]|/?SYS\]|/?ROLE\])"
CONTROL = re.compile(rf"([<\[]{_REST})")
_TO_ESCAPE = re.compile(rf"([<\[])(\\*{_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*{_REST})")
_FRAMES = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[OUT]", "</s>")}


def looks_back(n: int) -> Callable[[Template], Template]:
    """Declares of a template that what it writes for a turn depends on nothing but
    that turn and the ``n`` turns before it, and on whether there are ``n``; and that
    its output for more turns begins with that for fewer, or breaks off within ``n``."""

    def declare(template: Template) -> Template:
        template.look = n
        return template

    return declare


def _look(template: Template) -> int | None:
    """Turns that the template looks back at; None: all."""
    return getattr(template, "look", None)


def escape(text: str) -> str:
    """Control strings get one backslash after their first character, also those that
    have some: ``[INST]`` to ``[\\INST]``, ``[\\INST]`` to ``[\\\\INST]``."""
    return _TO_ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@looks_back(1)
def marked(turns: list[tuple[str, str]]) -> str:
    """``<s>``, then every turn between marks of its role; a role without marks of its
    own is named in front of its text."""
    out = ["<s>"] if turns else []
    for role, text in turns:
        head, tail = _FRAMES.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "</s>")
        out += head, escape(text), tail
    return "".join(out)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of marked text, or of a part of it that begins with a turn."""
    heads = {head: role for role, (head, _) in _FRAMES.items()}
    pieces = CONTROL.split(formatted)
    k = 1
    while k < len(pieces):
        control = pieces[k]
        if control in heads:
            yield heads[control], unescape(pieces[k + 1])
            k += 4
        elif control == "[ROLE]":
            yield unescape(pieces[k + 1]), unescape(pieces[k + 3])
            k += 6
        else:
            k += 2


def render_turns(template: Template, turns: list[tuple[str, str]], skip: int, loss: frozenset[str]) -> tuple[list[str], list[tuple[int, int] | None], int | None]:
    """``(piece of each turn, text range inside the piece or None, first turn that
    rewrites history or None)`` for the turns after the first ``skip``, which are only
    looked back at. The text range of a turn under the loss is None where the template
    does not show its text."""
    pieces: list[str] = []
    ranges: list[tuple[int, int] | None] = []
    look = _look(template)
    before = template(turns[0 if look is None else max(0, skip - look):skip])
    for k in range(skip, len(turns)):
        first = 0 if look is None else max(0, k - look)
        if k > skip and first > 0:
            before = template(turns[first:k])
        role = turns[k][0]
        now = template(turns[first:k + 1])
        if not now.startswith(before):
            return pieces, ranges, k
        pieces.append(now[len(before):])
        at = None
        if role in loss:
            probe = template([*turns[first:k], (role, MARK)])
            start = probe.find(MARK, len(before))
            tail = probe[start + len(MARK):]
            if start >= 0 and now.startswith(probe[:start]) and now.endswith(tail) and len(now) - len(tail) >= start:
                at = start - len(before), len(now) - len(tail) - len(before)
        ranges.append(at)
        before = now
    return pieces, ranges, None


_PARTS = ("conv_id long, part long, n_turns long, text string, spans array<struct<pos:long,start:long,end:long>>, "
          "loss array<struct<start:long,end:long>>, rewritten_at long")
_SPAN = pa.list_(pa.struct([("pos", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _part(template: Template, loss: frozenset[str], key: tuple, rows: list[tuple]) -> dict:
    conv, part = key
    skip = sum(pos < part * BLOCK for pos, _, _ in rows)
    pieces, ranges, broken = render_turns(template, [(role, text) for _, role, text in rows], skip, loss)
    spans, masks, end = [], [], 0
    for k, (piece, at) in enumerate(zip(pieces, ranges, strict=True)):
        spans.append({"pos": rows[skip + k][0], "start": end, "end": end + len(piece)})
        if at:
            masks.append({"start": end + at[0], "end": end + at[1]})
        end += len(piece)
    stable = broken is None
    return {"conv_id": conv, "part": part, "n_turns": len(rows) - skip, "text": "".join(pieces) if stable else None,
            "spans": spans if stable else None, "loss": masks if stable else None,
            "rewritten_at": None if stable else rows[broken][0]}


def _renderer(template: Template, loss: frozenset[str]):
    def table(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"conv_id": pa.int64(), "part": pa.int64(), "n_turns": pa.int64(), "text": pa.string(), "spans": _SPAN, "loss": _LOSS,
                 "rewritten_at": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds.items()], names=list(kinds))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, done, size = None, [], [], 0
        for batch in batches:
            for conv, part, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, part) != key:
                    if rows:
                        done.append(_part(template, loss, key, rows))
                        size += len(done[-1]["text"] or "")
                    key, rows = (conv, part), []
                    if size > 1 << 22:
                        yield table(done)
                        done, size = [], 0
                rows.append(tuple(turn))
        if rows:
            done.append(_part(template, loss, key, rows))
        yield table(done)

    return render


def format_chats(conversations: DataFrame, template: Template = marked, loss: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Conversations as training text, one row per part of BLOCK turns: ``conv_id, part,
    n_turns, text``, ``spans`` of turns and ``loss``, the ranges of the texts of the roles
    under the loss, both in code points of the part, and ``rewritten_at``. The text of a
    conversation is that of its parts in order. Where the template rewrites history,
    ``rewritten_at`` is the turn that shows it and text, spans and loss of the part are
    null. Order, ties and nulls are those of ``turns.numbered``; an empty table gives an
    empty one; an empty text has an empty range."""
    rows = numbered(conversations)
    part = F.floor(F.col("pos") / BLOCK)
    look = _look(template)
    if look is None:
        # Every later block looks back at a turn.
        ends = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.floor(F.max("pos") / BLOCK).alias("_last"))
        rows = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")))
        seen_by = F.sequence(part, F.col("_last"))
    else:
        # The last turns of a block are looked back at by the next ones.
        seen_by = F.sequence(part, F.floor((F.col("pos") + look) / BLOCK))
    dealt = rows.select("conv_id", F.explode(seen_by).alias("part"), "pos", "role", "text")
    dealt = dealt.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    # A last block that is full is looked back at by a block without turns.
    return dealt.mapInArrow(_renderer(template, frozenset(loss)), _PARTS).where("n_turns > 0")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests over the parts of each conversation, which come in order; what is kept
    is the state of the two hashes."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_at"]
    done, key, state = [], object(), None

    def close() -> None:
        if state:
            done.append((key, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["at"]))

    def table() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != key:
                close()
                key = row["conv_id"]
                state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "at": None}
            text = row["text"]
            if text is None:
                state["at"] = row["rewritten_at"] if state["at"] is None else state["at"]
                continue
            for role, said in parse(text):
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
            for r in row["loss"]:
                said = unescape(text[r["start"]:r["end"]])
                state["chars"] += len(said)
                state["loss"].update(said.encode())
            state["size"] += len(text)
        if len(done) > 10_000:
            yield table()
            done = []
    close()
    yield table()


def read_chats(formatted: DataFrame) -> DataFrame:
    """What marked text says, one row per conversation: ``n_turns``, ``turns_sha256`` of
    role, line feed, text, line feed of each turn, ``loss_chars`` and ``loss_sha256`` of the
    texts under the loss, unescaped, ``formatted_chars`` and ``rewritten_at``. A digest
    has to meet the parts of a conversation in order, so one task reads them, one part
    at a time."""
    rows = formatted.select("conv_id", "part", "text", "loss", "rewritten_at").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "part").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at long")


def digests(conversations: DataFrame) -> DataFrame:
    """Format with the marked template, write, read back."""
    return read_chats(stage(format_chats(conversations), "chats"))
