"""Archives, shards, the mix, and the pipeline."""

import gzip
import hashlib
import zlib
from collections import Counter

import pytest

from baitwatch.llm import mixing, sharding, warc
from baitwatch.llm.common import shared_path, stage

from .conftest import PROSE, ROWS, table

BIG = "<p>" + PROSE * 40 + "</p>"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(2)


@pytest.mark.parametrize("split", [64, 997, 1 << 20])
def test_every_record_is_read_once_however_files_are_split(spark, split):
    rows = [(k, f"http://h/{k}\n", f"{BIG}{k // 3}" if k % 2 else "s" * (k % 7)) for k in range(40)] + [(90, None, None), (91, None, "t" * 99), (92, "", "t" * 99)]
    folder = warc.write_archives(_pages(spark, rows))
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder, split).collect()}
    assert len(got) == len(rows) == warc.read_archives(spark, folder, split).count()
    first = {}
    for i, _, html in sorted(rows):
        if len((html or "").encode()) >= 100:
            first.setdefault(html, i)
    for i, _, html in rows:
        raw, source = (html or "").encode(), first.get(html, i)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if source == i else ("revisit", source))
        assert got[i]["payload"] == (raw if source == i else b"")


def test_a_url_may_have_any_length(spark):
    text = "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(1600))
    urls = {1: "http://h/" + "a" * 100_000, 2: f"http://h/{text}", 3: f"http://h/{text}/2"}
    folder = warc.write_archives(_pages(spark, [(1, urls[1], "x"), (2, urls[2], BIG), (3, urls[3], BIG), (4, "u", "y")]))
    for split in (997, 1 << 20):
        got = {r["page_id"]: (r["url"], r["refers_to"]) for r in warc.read_archives(spark, folder, split).collect()}
        assert got == {1: (urls[1], None), 2: (urls[2], None), 3: (urls[3], 2), 4: ("u", None)}


def test_foreign_bytes_are_passed_over(spark, tmp_path):
    record = warc._record(5, "u", "response", None, 2, "", b"hi")
    junk = b"\x1f\x8b\x08 no member" + gzip.compress(b"not a record" * 50)
    (tmp_path / "a.warc.gz").write_bytes(junk + record + junk + record[:-20])
    (tmp_path / "b.warc.gz").write_bytes(b"")
    got = warc.read_archives(spark, f"file://{tmp_path}", 50).collect()
    assert [(r["page_id"], r["payload"]) for r in got] == [(5, b"hi")]


def test_archives_corner(spark):
    none = warc.write_archives(_pages(spark, [(1, "u", "x")]).limit(0))
    assert warc.read_archives(spark, none).count() == 0
    twice = warc.read_archives(spark, warc.write_archives(_pages(spark, [(1, "u", BIG), (1, "u", BIG)]))).collect()
    assert [(r["page_id"], r["record_type"]) for r in twice] == [(1, "response")] * 2
    rows = [(None, "u", "x"), (None, "u", BIG), (7, "u", BIG), (9, "u", BIG), (None, "u", BIG + "y"), (None, "u", BIG + "y")]
    nameless = warc.read_archives(spark, warc.write_archives(_pages(spark, rows))).collect()
    assert sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in nameless)) == [
        (0, "response", 0), (0, "response", 0), (0, "response", 0), (0, "revisit", 7), (7, "response", 0), (9, "revisit", 7)]


def test_archives_of_other_writers(spark, tmp_path):
    """Names by uuid, HTTP messages, records without pages, missing fields, one gzip
    member per record, as the format's standard has it."""
    def record(fields, body, length=True):
        lines = ["WARC/1.0", *fields, *([f"Content-Length: {len(body)}"] if length else [])]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")

    uuid = "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb{}>".format
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>\r\n\r\nrest"
    records = [
        record(["WARC-Type: warcinfo", f"WARC-Record-ID: {uuid(0)}", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        record(["WARC-Type: request", f"WARC-Record-ID: {uuid(1)}", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        record(["WARC-Type: response", f"WARC-Record-ID: {uuid(2)}", "WARC-Target-URI: http://h/a", "Content-Type: application/http; msgtype=response"], http),
        record(["WARC-Type: metadata", f"WARC-Record-ID: {uuid(3)}"], b"a: b"),
        record(["WARC-Type: revisit", f"WARC-Record-ID: {uuid(4)}", f"WARC-Refers-To: {uuid(2)}", "WARC-Payload-Digest: sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"], b""),
        record(["WARC-Type: resource", "WARC-Target-URI: http://h/b"], b"plain"),
        record(["WARC-Type: response", f"WARC-Record-ID: {uuid(6)}"], b"no length", False),
        record(["WARC-Record-ID: <urn:uuid:x>"], b"no type"), record([], b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    for split in (50, 300, 1 << 20):
        got = sorted(warc.read_archives(spark, f"file://{tmp_path}", split).collect(), key=lambda r: r["record_id"] or "")
        assert [(r["record_id"], r["page_id"], r["record_type"], r["url"], r["payload"]) for r in got] == [
            (None, None, "resource", "http://h/b", b"plain"), (uuid(2), None, "response", "http://h/a", b"<p>one</p>\r\n\r\nrest"),
            (uuid(4), None, "revisit", "", b""), (uuid(6), None, "response", "", b"no length")]
        assert got[1]["payload_digest"] == hashlib.sha256(got[1]["payload"]).hexdigest() and got[2]["refers_to"] is None


def test_shards_match_the_mixture(spark):
    rows = [(k, "x" * (k % 50), "big" if k % 3 == 0 else f"s{k % 5}") for k in range(2000)]
    got = sharding.shard(table(spark, rows), 8).collect()
    counts = Counter(r["shard"] for r in got)
    assert set(counts.values()) == {250}
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(250))
    for source, n in Counter(r["source"] for r in got).items():
        mine = Counter(r["shard"] for r in got if r["source"] == source)
        assert max(mine.values()) - min(mine.values()) <= 2 and sum(mine.values()) == n
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shard(table(spark, rows).repartition(7), 8).collect()))


def test_many_sources_of_one_row_each(spark):
    """All rows have the fraction one half; ranges of the whole order still cut them."""
    rows = [(k, "x" * (k % 5), f"s{k}") for k in range(5000)]
    got = sharding.shard(table(spark, rows), 24).collect()
    assert set(Counter(r["shard"] for r in got).values()) <= {208, 209}
    order = [r["source"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_shards_corner(spark, corner, empty):
    got = sharding.shard(corner, 5).collect()
    assert len(got) == len(ROWS) and set(Counter(r["shard"] for r in got).values()) <= {2, 3}
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert sharding.shard(empty, 5).count() == 0


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    sizes = {"a": 100, "b": 10_000, "c": 10_000, "d": 0, None: 50}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights, left, open_, want = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        part = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx({**want, **part})


def test_the_mix_meets_its_targets(spark):
    rows = [(k, "w " * (1 + k * 37 % 90), f"s{k % 4}" if k % 3 else "hot") for k in range(3000)]
    got = mixing.plan(table(spark, rows)).collect()
    taken, target, largest = Counter(), {}, 90
    for r in got:
        taken[r["row"]["source"]] += r["taken"]
        target[r["row"]["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - t) <= largest for s, t in target.items())
    again = mixing.plan(table(spark, rows).repartition(9)).collect()
    assert sorted((r["row"]["doc_id"], r["copies"]) for r in got) == sorted((r["row"]["doc_id"], r["copies"]) for r in again)


def test_mix_corner(spark, corner, empty):
    got = mixing.plan(corner).collect()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").split()) for _, t, _ in ROWS)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mixed(corner)
    assert mixed.columns == corner.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.plan(empty).count() == 0


def test_pipeline_keeps_columns_and_ends_in_tokens(spark, corner, empty):
    import corpus_pipeline

    for docs, most in ((corner, len(ROWS)), (empty, 0)):
        bench = spark.createDataFrame([(1, "none of this stands anywhere in the texts")], "item_id long, text string")
        folder = shared_path(spark, "bench")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, folder)
            assert out.columns == docs.columns
            docs = stage(out, "test")
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert len(rows) <= 2 * most
        if most:
            # The copy without an id is the same text and goes.
            assert {r["doc_id"] for r in rows} == {1}

