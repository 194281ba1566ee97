"""Archives: round trips, odd pages, records of other writers, damage."""

import gzip
import hashlib

import pytest

from tidemark.llm import warc

PAGE = "page_id long, url string, html string, k long, digest string, copy int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, 7, "d", 9) for i, u, h in rows], PAGE).repartition(3)


LONG, OTHER = "<p>é</p>" * 30, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9
ROWS = [
    (3, "http://a.org/3", LONG), (1, "http://a.org/1", LONG), (2, "http://a.org/2", LONG), (4, "http://a.org/sp ace\r\nX: y", OTHER), (5, None, OTHER), (6, "u", None), (7, "u", ""), (8, "u", "short"), (9, "u", "short"),
    (None, "n", LONG), (None, "n", "alone " * 40), (10, "u", "twice " * 40), (10, "u", "twice " * 40), (11, "u", "twice " * 40), (12, "big", "long " * 400_000),
]


def expected(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, o in rows if (o or "").encode() == b]
        first = min(same, key=lambda j: (j is None, j))
        again = len(b) >= 100 and first != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_pages_come_back_as_captures(spark):
    got = warc.page_captures(pages_of(spark, ROWS))
    assert sorted(((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got.collect()), key=repr) == expected(ROWS)
    assert {x["requests"] for x in got.collect()} == {1}
    assert warc.page_captures(pages_of(spark, [])).collect() == []


def test_archives_hold_the_payloads(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.write_warc(pages_of(spark, ROWS), path, file_bytes=4000)
    rows = warc.read_warc(spark, path, payloads=True).collect()
    assert len({x["file"] for x in rows}) > 3 and len(rows) == 3 * len(ROWS) == len({x["record_id"] for x in rows}) and not any(x["problem"] for x in rows)
    kept = {bytes(x["payload"]) for x in rows if x["type"] == "response"}
    assert kept == {(h or "").encode() for _, _, h in ROWS}
    assert any(x["uri"] == "http://a.org/sp%20ace%0D%0AX:%20y" for x in rows) and all(not x["payload"] for x in rows if x["type"] == "revisit")


def record(kind, name, block, **lines):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, vs in lines.items() for v in (vs if isinstance(vs, list) else [vs]))
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


HTTP = {"Content_Type": "application/http; msgtype=response"}


def test_records_of_other_writers():
    chunked = b"HTTP/1.1 203 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"Wikipedia").digest()).decode()
    parts = [record("warcinfo", "w", b"software: x\r\n"), record("response", "r", chunked, **HTTP, WARC_Payload_Digest=sha1), record("response", "bad", b"HTTP/1.1 200 OK\r\n\r\nabc", **HTTP, WARC_Payload_Digest=sha1)]
    for content in (b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts))):
        got = list(warc.records_of(content))
        assert [x["type"] for x in got] == ["warcinfo", "response", "response"] and got[1]["payload"] == b"Wikipedia" and got[1]["status"] == 203 and got[1]["problem"] is None
        assert got[2]["problem"] == "payload is not what its digest says"


def test_damage_is_told_and_passed_over():
    good = record("resource", "a", b"payload")
    assert [x["problem"] for x in warc.records_of(good + b"noise\r\nmore\r\n" + good)] == [None, "2 lines between records", None]
    assert [x["problem"] for x in warc.records_of(good + good[:-12])] == [None, "cut short"]
    assert [x["problem"] for x in warc.records_of(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n" + good)] == ["no length", None]
    assert [x["problem"] for x in warc.records_of(gzip.compress(good) + gzip.compress(good)[:-20])][-1].startswith("unreadable")
    assert list(warc.records_of(b"")) == []


@pytest.mark.parametrize("direction", ["names", "is named", "through"])
def test_transactions_are_joined_in_any_direction(spark, tmp_path, direction):
    ask, told = {"WARC_Concurrent_To": "<r1>"}, {"WARC_Concurrent_To": "<r1>"}
    own = {}
    if direction == "is named":
        ask, told, own = {}, {}, {"WARC_Concurrent_To": ["<q1>", "<m1>"]}
    if direction == "through":
        told = {"WARC_Concurrent_To": "<q1>"}
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(gzip.compress(record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", **ask)) + gzip.compress(record("response", "r1", body, **HTTP, **own)))
    (tmp_path / "in/b.warc").write_bytes(record("metadata", "m1", b"via: x\r\n", Content_Type="application/warc-fields", **told) + record("response", "r2", body, **HTTP) + record("request", "lost", b"", WARC_Concurrent_To="<gone>"))
    got = {x["capture"]["record_id"]: ([q["record_id"] for q in x["requests"]], [{f["key"]: f["value"] for f in m["fields"]} for m in x["metadata"]]) for x in warc.captures(warc.read_warc(spark, str(tmp_path / "in"))).collect()}
    assert got == {"<r1>": (["<q1>"], [{"via": "x"}]), "<r2>": ([], [])}
