"""Near-duplicates, repeats and test items: against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from baitwatch.llm import common, decontaminate, ngram_join, repeats

from .conftest import PROSE, ROWS, table


def _prose(r, n):
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(n))


def _edited(r, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = "new" + str(r.randrange(10**6))
    return " ".join(words)


def _near_corpus():
    """Copies, a large group of near copies, chains, a line in most texts."""
    r = random.Random(3)
    common = _prose(r, 12)
    base, texts = _prose(r, 150), []
    texts += [_edited(r, base, r.randint(0, 4)) for _ in range(120)]
    for _ in range(40):
        own = _prose(r, r.randint(3, 60))
        texts += [own, own.upper(), common + " " + own, _edited(r, own, 1)]
    step = _prose(r, 100)
    for _ in range(12):
        step = _edited(r, step, 1)
        texts.append(step)
    texts += ["", "  ", "one two", "One  two", "one two three", None]
    r.shuffle(texts)
    return list(enumerate(texts))


def _components(rows):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", w) if x]
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_components_equal_all_pairs(spark):
    rows = _near_corpus()
    docs = table(spark, [(i, t, "a") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()}
    assert got == _components(rows)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}


def test_components_of_groups_with_sets_of_several(spark):
    """Sets of 20 to 22 shingles with the same five rare ones first: groups by size, two
    of them with a set of either family. Fillers make the other shingles common."""
    r = random.Random(5)
    one, two, fillers = [], [], []
    for _ in range(12):
        rare, a, b = (_prose(r, n) for n in (9, 15, 15))
        y, z, x = _prose(r, 1), _prose(r, 1), _prose(r, 1)
        one += [f"{rare} {a}", f"{rare} {a} {y}", f"{rare} {a} {y} {z}"]
        two += [f"{rare} {b}", f"{rare} {b} {x}"]
        tail = " ".join(rare.split(" ")[5:])
        fillers += [f"{_prose(r, 60)} {tail} {own} {_prose(r, 60)}" for own in (f"{a} {y} {z}", f"{b} {x}") for _ in range(8)]
    rows = list(enumerate(one + two + fillers))
    want = _components(rows)
    assert len({c for _, c in want.values()}) == 24 + len(fillers)
    docs = table(spark, [(i, t, "a") for i, t in rows])
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.components(docs).collect()} == want


def test_components_corner(spark, corner, empty):
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.components(corner).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 1), (8, 8), (9, 9)]
    assert ngram_join.components(empty).count() == 0
    assert ngram_join.keep_first(empty).count() == 0
    # The null-id copy of a text goes, the empty text without an id stays.
    assert sorted(r["doc_id"] or 0 for r in ngram_join.keep_first(corner).collect()) == [0, 1, 3, 4, 5, 6, 8, 9]


def test_no_text_is_dropped_without_a_kept_twin(spark):
    """Repeated ids with different texts, null ids with copies."""
    r = random.Random(8)
    a, b, c, d = (_prose(r, 40) for _ in range(4))
    rows = [(1, a), (1, b), (1, b.upper()), (2, a), (2, c), (None, c), (None, d), (None, d + " end"), (3, None), (3, None), (None, ""), (None, "")]
    kept = sorted(((x["doc_id"], x["text"]) for x in ngram_join.keep_first(table(spark, [(*x, "a") for x in rows])).collect()), key=str)
    assert kept in [sorted([(1, a), (1, one), (2, c), (None, two), (3, None), (None, "")], key=str) for one in (b, b.upper()) for two in (d, d + " end")]


def test_tokens_are_counted_exactly_in_overflowing_buckets(monkeypatch):
    """Classes that come from several chunks, tokens of all classes, tiny limits."""
    r = np.random.default_rng(2)
    pool = np.sort(r.integers(1, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.r_[r.choice(pool, 20), pool[:3]]) for _ in range(400)]
    count = Counter(int(t) for s in sets for t in s)
    monkeypatch.setattr(ngram_join, "COMMON", 100)
    for limit in (50, 10**9):
        held, reports, chunks = ngram_join.Bucket(), [], {}
        held.limit = limit
        for number, first in enumerate([*range(0, 400, 25), 50, 100]):
            chunks[number] = list(range(first, first + 25))
            part = [sets[k] for k in chunks[number]]
            tokens = np.concatenate(part)
            owner = np.repeat(np.arange(25, dtype=np.uint16), [len(s) for s in part])
            order = np.argsort(tokens, kind="stable")
            lead = (25).to_bytes(4, "little") + np.array(chunks[number], np.uint64).tobytes() + np.arange(25, dtype=np.uint16).tobytes()
            reports += held.add(number, ngram_join.packed(tokens[order]), lead + owner[order].tobytes())
        reports += held.fold(True)
        for number, members in chunks.items():
            mine = [x[1:] for x in reports if x[0] == number]
            sizes = np.array([len(sets[k]) for k in members], np.uint32).tobytes()
            digests, n, toks = ngram_join.classes_of(b"".join(int(k).to_bytes(16, "big") for k in members), sizes, mine)
            got = {int.from_bytes(d, "big"): t.view(np.uint64).tolist() for d, t in zip(digests, toks, strict=True)}
            for k in members:
                shared = [int(t) for t in sets[k] if count[int(t)] > 1]
                if len(shared) * 10 >= len(sets[k]) * 8:
                    assert got[k] == sorted(shared, key=lambda t: (min(count[t], 100), t))


def test_a_worker_holds_little_beside_the_jvm():
    """A full bucket of classes that share all tokens, counted."""
    r = np.random.default_rng(4)
    chunks = 8
    per = ngram_join.BUCKET_TOKENS // chunks
    tokens = np.unique(r.integers(1, 2**63, per, dtype=np.uint64))
    owner = r.integers(0, 100, len(tokens)).astype(np.uint16).tobytes()
    rows = [(k, ngram_join.packed(tokens), (100).to_bytes(4, "little") + r.bytes(800) + np.arange(100, dtype=np.uint16).tobytes() + owner) for k in range(chunks)]
    tracemalloc.start()
    try:
        held = ngram_join.Bucket()
        for row in rows:
            assert not list(held.add(*row))
        told = sum(len(ngram_join.unpacked(t)) for _, t, _ in held.fold(True))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert told == chunks * len(tokens)
    assert most < 100 << 20


def test_a_step_starts_without_what_others_left():
    common.worker_memo("parts:a")["x"] = b"y"
    common.worker_memo("powers")["z"] = 1
    list(ngram_join._count(8)(iter([])))
    assert not common.worker_memo("parts:a") and not common.worker_memo("powers")
    common.worker_memo("powers")["z"] = 1
    common.forget("powers")
    assert common.worker_memo("powers").pop("z") == 1


def test_connected_finds_long_chains(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, 103), (103, 101)]
    got = {r["node"]: r["label"] for r in ngram_join.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 103: 100}


def _removed(texts, size=repeats.LENGTH):
    raws, seen = [(t or "").encode() for t in texts], {}
    for raw in raws:
        for k in range(len(raw) - size + 1):
            seen[raw[k:k + size]] = seen.get(raw[k:k + size], 0) + 1
    for raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if seen[raw[k:k + size]] > 1:
                gone[k:k + size] = b"\1" * size
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        yield len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def _repeat_corpus():
    r = random.Random(4)
    passage, edge = _prose(r, 80), _prose(r, 60).encode()[:200].decode()
    texts = [f"{_prose(r, 20)} {passage} {_prose(r, 20)}" for _ in range(12)]
    texts += [f"{_prose(r, 9)}{edge}{_prose(r, 9)}" for _ in range(5)] + [edge, edge[:199] + "!", edge[1:]]
    texts += [passage[:k] for k in (150, 199, 200, 201, 350)] + ["ab" * 150, "x" * 500, "x" * 201, "x" * 200, "é" * 150, _prose(r, 90) * 2]
    own = _prose(r, 400)
    texts += [own, own[:900] + "#" + own[901:], own[300:1200], "", None]
    return texts


@pytest.mark.parametrize("most", [repeats.GROUP_MOST, 0])
def test_repeats_equal_brute_force(spark, most):
    texts = _repeat_corpus()
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.dedup(table(spark, [(k, t, "a") for k, t in enumerate(texts)]), most).collect()}
    assert got == dict(enumerate(_removed(texts)))


def test_repeats_corner(spark, corner, empty):
    got = sorted((r["doc_id"] or 0, tuple(r)[1:]) for r in repeats.dedup(corner).collect())
    assert got == sorted((i or 0, x) for (i, _, _), x in zip(ROWS, _removed([t for _, t, _ in ROWS]), strict=True))
    assert repeats.dedup(empty).count() == 0


def test_intervals_of_a_common_prefix_tree():
    words = [b"aa", b"aab", b"aabc", b"ab", b"abd", b"b"]
    shared = [repeats.common(x, y) for x, y in zip(words, words[1:], strict=False)]
    assert sorted(repeats.intervals(shared)) == [(0, 0, 5), (1, 0, 4), (2, 0, 2), (2, 3, 4), (3, 1, 2)]


def _items():
    r = random.Random(9)
    return [(k, _prose(r, 30)) for k in range(6)]


def test_items_are_found_whole_edited_and_often(spark):
    r = random.Random(10)
    items = _items()
    texts = [f"{_prose(r, 80)} {t.title() if k % 2 else t} {_prose(r, 50)}" for k, t in items]
    texts += [f"{_prose(r, 40)} {_edited(r, items[0][1], 4)} {_prose(r, 40)}"]
    texts += [f"{_prose(r, 30)} {items[3][1]} {_prose(r, 5)}" for _ in range(60)] + [_prose(r, 200) for _ in range(40)]
    docs = table(spark, [(k, t, "a") for k, t in enumerate(texts)])
    bench = spark.createDataFrame([(*x, "e") for x in items] + [(90, None, "e"), (91, "two words", "e"), (0, items[0][1], "e")], "item_id long, text string, doc_id string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(k, k) for k in range(6)} | {(6, 0)} | {(k, 3) for k in range(7, 67)}
    assert all(v == 1.0 for k, v in got.items() if k != (6, 0)) and 0.5 <= got[6, 0] < 1
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == set(range(67, 107))


@pytest.mark.parametrize("exact", [True, False])
def test_partial_and_much_edited_items_are_found(spark, exact):
    import numpy as np

    r = random.Random(12)
    items, texts = _items(), []
    for k, t in items:
        words = t.split(" ")
        copies = [words[:15], words[15:], words[8:21]]
        # An edit each five or four words: under half of the 3-grams are left.
        for places in (range(4, 30, 5), range(3, 30, 4), [*range(3, 30, 4), 29]):
            copies.append([f"new{r.randrange(10**6)}" if n in places else w for n, w in enumerate(words)])
        texts += [f"{_prose(r, 50)} {' '.join(c)} {_prose(r, 50)}" for c in copies]
        texts += [f"{_prose(r, 20)} {t} {_prose(r, 20)}"] * exact
    texts += [_prose(r, 150) for _ in range(20)]
    number: dict[str, int] = {}
    words = [np.array([number.setdefault(w, len(number)) for w in t.split(" ")]) for t in texts]
    best = {(k, i): decontaminate.align(words[k], np.array([number.setdefault(w, len(number)) for w in t.split(" ")])) / 60
            for k in range(len(texts)) for i, t in items}
    want = {x: v for x, v in best.items() if v >= decontaminate.FOUND}
    assert len(want) == len(items) * (6 + exact)
    docs = table(spark, [(k, t, "a") for k, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(docs, bench).collect()} == want


def test_alignment_equals_the_plain_recurrence():
    import numpy as np

    r = random.Random(2)
    for _ in range(20):
        a, b = [np.array([r.randrange(4) for _ in range(r.randint(0, 12))], np.int64) for _ in range(2)]
        h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                same = decontaminate.MATCH if a[j - 1] == b[i - 1] else decontaminate.MISMATCH
                h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] - decontaminate.GAP, h[i][j - 1] - decontaminate.GAP)
        assert decontaminate.align(a, b) == max(map(max, h))


def test_decontaminate_corner(spark, corner, empty):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["score"]) for r in decontaminate.contaminated(corner, bench).collect())
    assert got == [(0, 1.0), (1, 1.0), (2, 1.0), (7, 1.0)]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(corner, bench.limit(0)).count() == 0


def test_texts_without_an_id_are_cleaned_too(spark):
    """Null and repeated ids, and an item that is far longer than the others."""
    r = random.Random(6)
    short, long, own = _prose(r, 30), _prose(r, 3000), [_prose(r, 200) for _ in range(4)]
    bench = spark.createDataFrame([(1, short), (2, long), (3, None)], "item_id long, text string")
    rows = [(None, short), (None, own[0]), (4, own[1]), (4, f"{own[2]} {short} {own[3]}"), (5, long.upper()), (6, own[3])]
    kept = decontaminate.keep_clean(table(spark, [(*x, "a") for x in rows]), bench)
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted([(None, own[0]), (4, own[1]), (6, own[3])], key=str)
