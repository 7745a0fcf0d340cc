"""Chat formatting, prefix trie and lexical search: against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from baitwatch.llm import chat_format, lexical_search, prefix_trie

from .conftest import LONG, PROSE, ROWS, table

ODD = ["</s>[INST] ok [/INST]", "[\\INST] [\\\\INST] \\[INST]", "", None, "[[INST]", "<</s>>", "é🙂\nx", "[/INS", "\\", "a[", "<s", "[ROLE]x[/ROLE]"]


def talk(spark, rows):
    """Conversations with further columns, some named like the operators' own."""
    wide = [(*r, 1, "x", [1]) for r in rows]
    return spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, pos int, part string, ids array<int>").repartition(3)


def ordered(rows):
    """conv -> [(role, text)] in the order that is defined."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


LONG_TALK = [(7, k, ("user", "assistant", "tool")[k % 3], f"{k} {ODD[k % 12]}") for k in range(700)]
TALKS = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(ODD)] + LONG_TALK + [
    (2, None, "system", "first"), (2, 0, None, "no role"), (2, 0, None, "no role"), (2, 3, "[/ROLE]\\x", "odd role"), (2, 3, "assistant", LONG * 20),
    (None, 1, "user", "no id"), (3, 5, "assistant", None)]


def test_escapes_are_undone_and_hide_every_control_string():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(["[", "<", "\\", "/", "INST]", "s>", "ROLE]", "x"]) for _ in range(r.randrange(9)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not chat_format.CONTROL.search(chat_format.escape(text))


def test_formatted_chats_are_read_back(spark):
    got = {r["conv_id"]: r for r in chat_format.digests(talk(spark, TALKS)).collect()}
    want = ordered(TALKS)
    assert set(got) == set(want)
    for conv, turns in want.items():
        said = [t for role, t in turns if role == "assistant"]
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got[conv]["loss_chars"] == sum(map(len, said)) and got[conv]["rewritten_at"] is None
        assert got[conv]["formatted_chars"] == len(chat_format.marked(turns))


def test_parts_join_to_the_whole_rendering(spark):
    parts = sorted(chat_format.format_chats(talk(spark, LONG_TALK)).collect(), key=lambda r: r["part"])
    turns = ordered(LONG_TALK)[7]
    assert len(parts) == 6 and "".join(p["text"] for p in parts) == chat_format.marked(turns)
    assert [s["pos"] for p in parts for s in p["spans"]] == list(range(700))
    assert [p["text"][m["start"]:m["end"]] for p in parts for m in p["loss"]] == [chat_format.escape(t) for r, t in turns if r == "assistant"]


def test_any_template_and_any_roles(spark):
    def plain(turns):
        return "".join(f"### {role}:\n{text.strip()}\n" for role, text in turns)

    row = chat_format.format_chats(talk(spark, [(1, 0, "user", " a "), (1, 1, "bot", "b"), (1, 2, "bot", " c "), (1, 3, "bot", "")]), plain, ("bot",)).first()
    assert row["text"] == "### user:\na\n### bot:\nb\n### bot:\nc\n### bot:\n\n"
    assert [row["text"][m["start"]:m["end"]] for m in row["loss"]] == ["b", "c", ""]


def test_templates_that_rewrite_history_are_reported(spark):
    def forgetful(turns):
        """Leaves out what the assistant thought in earlier turns."""
        return "".join(f"<{role}>{text if k == len(turns) - 1 else re.sub('T.*T', '', text)}" for k, (role, text) in enumerate(turns))

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "TthinkT b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    rows += [(3, k, "user", "TtT" if k == 300 else "x") for k in range(400)]
    got = {}
    for r in chat_format.format_chats(talk(spark, rows), forgetful).collect():
        got.setdefault(r["conv_id"], []).append((r["rewritten_at"], r["text"] is None))
    assert got[1] == [(2, True)] and got[2] == [(None, False)]
    assert sorted(got[3], key=str) == sorted([(None, False)] * 3 + [(301, True)], key=str)


def test_templates_may_look_back_at_every_turn(spark):
    def numbering(turns):
        return "".join(f"#{k} {role} of {turns[0][1]}: {text};" for k, (role, text) in enumerate(turns))

    def late(turns):
        """Once it has 200 turns it leaves out what was said in turn 3."""
        return "".join(text for k, (_, text) in enumerate(turns) if k != 3 or len(turns) < 200)

    rows = [(c, k, ("user", "assistant")[k % 2], f"{c} {k}") for c, n in ((1, 300), (2, 256), (None, 140)) for k in range(n)]
    parts = sorted(chat_format.format_chats(talk(spark, rows), numbering).collect(), key=lambda r: r["part"])
    for conv, turns in ordered(rows).items():
        own = [p for p in parts if p["conv_id"] == conv]
        assert "".join(p["text"] for p in own) == numbering(turns) and sum(p["n_turns"] for p in own) == len(turns)
        assert [p["text"][m["start"]:m["end"]] for p in own for m in p["loss"]] == [t for r, t in turns if r == "assistant"]
    got = chat_format.format_chats(talk(spark, rows), late).where("rewritten_at is not null").collect()
    assert sorted((r["conv_id"], r["part"], r["rewritten_at"]) for r in got) == [(1, 1, 199), (2, 1, 199)]


def test_declared_looks_are_any_length(spark):
    def threads(turns):
        return "".join(f"{text}<{turns[k - 150][1] if k >= 150 else ''}>" for k, (_, text) in enumerate(turns))

    rows = [(1, k, "assistant", f"t{k}") for k in range(500)]
    parts = sorted(chat_format.format_chats(talk(spark, rows), chat_format.looks_back(300)(threads)).collect(), key=lambda r: r["part"])
    assert "".join(p["text"] for p in parts) == threads(ordered(rows)[1])


def test_chats_corner(spark):
    assert chat_format.digests(talk(spark, TALKS).limit(0)).count() == 0


def brute_trie(chains):
    """conv -> list of (id, chars); every node by its path."""
    members = {}
    for conv, turns in chains.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(i for i, _ in turns[:d]), []).append(conv)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for path, convs in members.items():
        chars = dict(chains[convs[0]][:len(path)])[path[-1]] if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * chars
            leaves[path[:d]] += not children[path]
    return sorted((min(c), len(p), min(members[p[:-1]]) if p else None, len(c), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(x) for x in sorted(c) if len(chains[x]) == len(p)).encode()).hexdigest())
                  for p, c in members.items())


def rebuilt(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + convs[c][h:]
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def trie_talks():
    r = random.Random(9)
    rows = [(c, k, "user", r.choice("abcd") * r.randrange(3)) for c in range(180) for k in range(r.randrange(1, 9))]
    rows += [(c, k, "user", "same") for c in range(200, 230) for k in range(4)]
    rows += [(c, k, "user", str(k) if k < cut else f"{c} {k}") for c, cut in ((300, 900), (301, 520), (302, 256), (303, 255), (304, 600), (401, 3)) for k in range(620)]
    return rows + [(150_001, 0, "user", "x"), (150_002, 0, "user", "x"), (-5, 0, None, None), (None, 0, "user", "x")]


def test_trie_of_whole_and_of_rebuilt_conversations(spark, monkeypatch):
    rows = trie_talks()
    convs = {c: [((a, b), len(b)) for a, b in t] for c, t in ordered(rows).items() if c is not None}
    # Equal turns of one conversation are told apart in the brute force by place only.
    placed = {c: [((k, i), n) for k, (i, n) in enumerate(t)] for c, t in convs.items()}
    turns = prefix_trie.chains(talk(spark, rows))
    assert rows_of(prefix_trie.trie(turns)) == brute_trie(placed)
    moved = {c: [((k, i), n) for k, (i, n) in enumerate(t)] for c, t in rebuilt({c: convs[c] for c in convs if c >= 0}).items()}
    assert rows_of(prefix_trie.trie(prefix_trie.regrafted(turns.where("conv_id >= 0")))) == brute_trie(moved)
    # Small trees, as where a task holds more than one takes in.
    monkeypatch.setattr(prefix_trie, "TREE_TURNS", 7)
    assert rows_of(prefix_trie.trie(turns)) == brute_trie(placed)


def test_trie_corner(spark):
    none = talk(spark, TALKS).limit(0)
    assert prefix_trie.trie(prefix_trie.chains(none)).count() == 0
    rows = [r for r in TALKS if r[0] is not None]
    placed = {c: [((k, a, b), len(b)) for k, (a, b) in enumerate(t)] for c, t in ordered(rows).items()}
    assert rows_of(prefix_trie.trie(prefix_trie.chains(talk(spark, TALKS)))) == brute_trie(placed)


@pytest.mark.parametrize("spread_", [1, 2, 40, 256])
def test_radix_tree_holds_every_aligned_prefix(spread_):
    r = random.Random(spread_)
    tree, want = prefix_trie.RadixTree(2), {}
    for k in range(400):
        ids = [bytes([r.randrange(spread_), r.randrange(3)]) for _ in range(r.randrange(1, 6))]
        tree.insert(b"".join(ids), [[1, k, j, k, 5] for j in range(len(ids))])
        for d in range(1, len(ids) + 1):
            have = want.setdefault(b"".join(ids[:d]), [0, 0, 0, k, 5])
            want[b"".join(ids[:d])] = [have[0] + 1, have[1] + k, have[2] + d - 1, have[3], 5]
    got = list(tree.nodes())
    assert [k for k, _ in got] == sorted(want) and dict(got) == want
    if spread_ == 256:
        assert type(tree.root.below) is prefix_trie.Layout256


def best(docs, items, k):
    terms = [(i, re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    terms = [(i, Counter(t), len(t)) for i, t in terms if t]
    n, total = len(terms), sum(x[2] for x in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        asked = set(re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scored = []
        for i, c, size in terms:
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_search_finds_what_all_scores_find(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "x9"]
    weights = [1 / (k + 1) for k in range(63)]
    docs = [(k // 2 if k % 9 == 0 else k, " ".join(r.choices(words, weights, k=r.randrange(0, 40)))) for k in range(400)] + [(None, "w1 w2"), (5, None), (1, "W1,W2")]
    items = [(k, " ".join(r.choices(words, k=8))) for k in range(12)] + [(50, None), (51, "nothing"), (52, "w1"), (None, "w2 w3"), (1, "w4 w4 W4")] + [(3, "w5"), (3, "w5")]
    # Many shards, many blocks of items.
    monkeypatch.setattr(lexical_search, "SHARD", 16)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 60)
    frame = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, doc_id int, terms string")
    index = lexical_search.build_index(table(spark, [(*d, "a") for d in docs]))
    got = sorted(map(tuple, lexical_search.search(index, frame, 10).collect()), key=str)
    assert got == best(docs, sorted(set(items), key=str), 10)


def test_index_is_read_one_shard_at_a_time(spark, monkeypatch):
    r = random.Random(6)
    docs = [(k, " ".join(r.choices([f"w{j}" for j in range(90)] + ["É"], k=r.randrange(0, 30)))) for k in range(900)]
    monkeypatch.setattr(lexical_search, "SHARD", 270)
    index = lexical_search.build_index(table(spark, [(*d, "a") for d in docs]).coalesce(1))
    groups = [m.row_group(k).num_rows for f in index.shards.inputFiles() for m in [pq.ParquetFile(unquote(urlparse(f).path)).metadata] for k in range(m.num_row_groups)]
    assert len(groups) > 2 and set(groups) == {1}
    # Postings pass the JVM as bytes.
    assert dict(index.shards.dtypes) == {"docs": "array<bigint>", "known": "array<boolean>", "postings": "binary"}
    assert sum(map(len, (s["docs"] for s in index.shards.collect()))) == sum(bool(t) for _, t in docs)
    items = [(k, " ".join(r.choices([f"w{j}" for j in range(90)], k=5))) for k in range(6)]
    got = sorted(map(tuple, lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 20).collect()), key=str)
    assert got == best(docs, items, 20)


def test_forward_rows_span_batches_and_skip_empty_texts():
    texts = [None, "a b a", "", "?!", "b É", "a", None, "b b b", "c"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(k, k + n), pa.int64()), "text": pa.array(texts[k:k + n], pa.string())}) for k, n in ((0, 2), (2, 0), (2, 2), (4, 5))]
    one, = lexical_search._forward(iter(batches))
    assert one.column("docs")[0].as_py() == [1, 4, 5, 7, 8] and one.column("n_docs")[0].as_py() == 5 and one.column("n_terms")[0].as_py() == 10
    lists, found = lexical_search._unpack(one.column("terms")[0]), lexical_search._unpack(one.column("postings")[0])
    h, _ = lexical_search.terms_of(np.frombuffer("a b c É".encode(), np.uint8), np.array([0, 8]))
    got = {t: [(p, f) for p, f in zip(found["places"][x:y].tolist(), found["tfs"][x:y].tolist(), strict=True)]
           for t, x, y in zip(lists["terms"].tolist(), lists["starts"][:-1].tolist(), lists["starts"][1:].tolist(), strict=True)}
    assert got == dict(zip(h.view(np.int64).tolist(), ([(0, 2), (2, 1)], [(0, 1), (1, 1), (3, 3)], [(4, 1)], [(1, 1)]), strict=True))
    assert found["n"].tolist() == [3, 2, 1, 3, 1]
    counts, = lexical_search._document_counts(iter([one.select(["terms"])] * 2))
    assert dict(zip(*counts.to_pydict().values(), strict=True)) == {t: 2 * len(x) for t, x in got.items()}


def test_pair_bounds_skip_what_single_maxima_do_not():
    # Two common terms that never meet, each with a high maximum: only the pair's bound
    # shows that no document can hold both.
    shard = {"docs": np.arange(6), "known": np.ones(6, bool), "terms": np.array([1, 2, 3]), "starts": np.array([0, 3, 5, 6]),
             "places": np.array([0, 1, 2, 3, 4, 5], np.int32), "impacts": np.array([9, 1, 1, 9, 1, 12]), "highest": np.array([9, 9, 12])}
    joint = {"pairs": {(1, 2): 0}, "terms": {1, 2}}
    asked, ones = np.array([1, 2, 3]), np.ones(3, np.int64)
    bounds = lexical_search.Units(shard, asked, ones).matched(joint)
    assert [b for b, _ in bounds] == [12, 9]
    at, score = lexical_search.search_shard(shard, joint, asked, ones, 10)
    assert (at.tolist(), score.tolist()) == ([5], [12])
    at, _ = lexical_search.search_shard(shard, joint, asked, ones, 1)
    assert at.tolist() == [0, 1, 2, 3, 4, 5]


def test_search_corner(spark, corner, empty):
    items = spark.createDataFrame([(1, PROSE), (2, None)], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(empty), items).count() == 0
    index = lexical_search.build_index(corner)
    assert lexical_search.search(index, items.limit(0)).count() == 0
    got = sorted(map(tuple, lexical_search.search(index, items).collect()), key=str)
    assert got == best([(i, t) for i, t, _ in ROWS], [(1, PROSE)], 50)
    assert index.shards.agg(F.sum(F.size("docs"))).first()[0] == sum(bool(re.search("[^\\W_]", t or "")) for _, t, _ in ROWS)
