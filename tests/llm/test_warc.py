from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

from sparkloom.llm import warc as W


def record(i: int, body: bytes, compress: bool = True) -> bytes:
    return W.write_record({"WARC-Type": "response", "X-Page-ID": i, "WARC-Payload-Digest": f"sha1:{W.payload_digest(body)}"}, body, compress)


def read(raw: bytes):
    salvage = W.Salvage()
    return list(W.read_records(io.BytesIO(raw), salvage)), salvage.gaps


BODIES = [b"", b"x", b"\r\n\r\nWARC/1.1\r\nfake", b"\x1f\x8b\x08" + b"a" * 50, bytes(range(256)) * 20, b"z" * 3_000_000]


def test_round_trip_of_any_payload():
    for compress in (True, False):
        records, gaps = read(b"".join(record(i, b, compress) for i, b in enumerate(BODIES)))
        assert [r.body for r in records] == BODIES and gaps == []


def test_salvage_finds_every_whole_record_after_damage():
    parts = [record(i, f"page {i} ".encode() * 200, compress=i % 3 > 0) for i in range(60)]
    raw = bytearray(b"".join(parts))
    starts = [sum(map(len, parts[:i])) for i in range(61)]
    random.seed(4)
    hit = sorted(random.sample(range(60), 8))
    for i in hit:
        raw[starts[i] + len(parts[i]) // 2] ^= 0xFF
    records, gaps = read(bytes(raw))
    ids = {int(r.headers["x-page-id"]) for r in records}
    assert ids >= set(range(60)) - set(hit) and not ids & set(hit)
    assert all(any(lo <= starts[i] < hi for lo, hi, _ in gaps) for i in hit)
    assert sum(hi - lo for lo, hi, _ in gaps) == sum(len(parts[i]) for i in hit)


def packed(parts: list[bytes]) -> bytes:
    return gzip.compress(b"".join(parts))


def test_salvage_inside_a_member():
    """Damage before compression: the member is whole, one of its records is not."""
    for hurt in ("body", "length", "line", "header"):
        parts = [record(i, f"page {i} ".encode() * 50, compress=False) for i in range(5)]
        parts[2] = {
            "body": parts[2].replace(b"page 2 page", b"page 9 page", 1),
            "length": parts[2].replace(b"Content-Length: 350", b"Content-Length: 990"),
            "line": parts[2].replace(b"WARC/1.1", b"WARCx1.1"),
            "header": parts[2].replace(b"X-Page-ID: 2", b"X-Page-ID: 7"),
        }[hurt]
        for raw in (b"".join(parts), packed(parts), packed(parts) + record(9, b"next")):
            records, gaps = read(raw)
            assert [int(r.headers["x-page-id"]) for r in records][:4] == [0, 1, 3, 4], hurt
            assert len(gaps) == 1 and (raw[:2] != b"WA" or gaps[0][:2] == (sum(map(len, parts[:2])), sum(map(len, parts[:3]))))


def test_what_precedes_a_cut_is_kept():
    random.seed(7)
    parts = [record(i, random.randbytes(9000), compress=False) for i in range(6)]
    raw = packed(parts)
    records, gaps = read(raw[: len(raw) * 2 // 3])
    assert [int(r.headers["x-page-id"]) for r in records] == [0, 1, 2] and len(gaps) == 1
    hurt = bytearray(raw)
    hurt[len(raw) // 2 + 2000] ^= 0x55  # the bytes of record 3
    records, gaps = read(bytes(hurt) + record(8, b"later"))
    assert {int(r.headers["x-page-id"]) for r in records} >= {0, 1, 2, 8} and 3 not in {int(r.headers["x-page-id"]) for r in records}
    assert gaps and gaps[0][0] == 0


def test_long_members_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(W, "HELD_BYTES", 1 << 12)
    parts = [record(i, f"page {i} ".encode() * 500, compress=False) for i in range(40)]
    records, gaps = read(packed(parts) + record(40, b"one"))
    assert [int(r.headers["x-page-id"]) for r in records] == list(range(41)) and gaps == []


def test_http_messages_are_unwrapped():
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>\r\n\r\n</p>"
    raw = W.write_record({"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{W.payload_digest(b'<p>' + bytes([13, 10, 13, 10]) + b'</p>')}"}, body)
    (one,), gaps = read(raw)
    assert W.payload_of(one) == b"<p>\r\n\r\n</p>" and not gaps


def test_truncated_and_foreign_bytes():
    raw = b"garbage" + record(1, b"one") + b"\x00" * 70_000 + record(2, b"two") + record(3, b"three")[:-10]
    records, gaps = read(raw)
    assert [r.body for r in records] == [b"one", b"two"] and len(gaps) == 3
    assert gaps[0][0] == 0 and gaps[-1][1] == len(raw)
    assert read(b"") == ([], [])


def test_marks_across_window_edges():
    pad = W.WINDOW - 5
    raw = b"\x01" * pad + record(1, b"one") + b"\x01" * (W.WINDOW // 2) + record(2, b"two", compress=False)
    records, _ = read(raw)
    assert [r.body for r in records] == [b"one", b"two"]


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    doubled = pages.unionByName(pages.selectExpr("page_id + 1000 as page_id", "url", "html"))
    got = W.round_trip(doubled).toPandas().set_index("page_id")
    assert len(got) == 2 * pages.count()
    for r in pages.collect():
        raw = r.html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert tuple(got.loc[r.page_id][["payload_bytes", "payload_digest", "record_type"]]) == (len(raw), digest, "response")
        assert got.loc[r.page_id + 1000]["record_type"] == "revisit" and got.loc[r.page_id + 1000]["refers_to"] == r.page_id


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, None, 1), (2, "u\r\nX: y", "", 2), (None, "u", "same", 3), (4, "u", "same", 4), (4, "u", "same", 4), (5, "u", "same", 5)], "page_id long, url string, html string, digest int")
    got = W.round_trip(frame).toPandas()
    assert len(got) == 6
    kinds = {(None if r.page_id != r.page_id else int(r.page_id), r.record_type, None if r.refers_to != r.refers_to else int(r.refers_to)) for r in got.itertuples()}
    assert kinds == {(1, "response", None), (2, "revisit", 1), (None, "response", None), (4, "response", None), (5, "revisit", 4)}
    assert W.round_trip(frame.limit(0)).count() == 0
    small = W.round_trip(frame, min_bytes=3).toPandas()
    assert set(small[small["payload_bytes"] == 0]["record_type"]) == {"response"}
