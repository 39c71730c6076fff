import base64
import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paywarden.llm import warc
from paywarden.llm.common import file_system

PAGES = "page_id long, url string, html string, digest string, ID int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@settings(max_examples=100, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(-2**63, 2**63 - 1) | st.none(), st.text(max_size=30) | st.none(), st.binary(max_size=300), st.booleans()), max_size=8), members=st.booleans())
def test_records_survive_any_gzip(rows, members):
    whole = [warc.record(i, u, p, "A" * 32, 7 if r else None, "2000-01-01T00:00:00Z") for i, u, p, r in rows]
    data = b"".join(map(gzip.compress, whole)) if members else gzip.compress(b"".join(whole))
    found = list(warc.records(warc.inflate(io.BytesIO(data), 7)))
    assert [w for _, w in found] == whole
    for (i, _, p, r), (head, _) in zip(rows, found):
        assert warc.page_of(head["warc-record-id"]) == i and head["warc-type"] == ("revisit" if r else "response")


def test_a_cut_archive_is_an_error():
    data = gzip.compress(warc.record(1, "u", b"payload" * 100, "A" * 32, None, "d"))
    with pytest.raises((ValueError, zlib.error, EOFError)):
        list(warc.records(warc.inflate(io.BytesIO(data[:-20]))))


def test_every_member_stands_alone(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = [(i, f"http://h/{i}", "<p>same</p>" if i % 3 else f"<p>{i}</p>" * 50, "x", 1) for i in range(40)]
    folder = warc.new_folder(spark, "warc-test")
    raw = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(2), f"{folder}/raw")
    found = warc.normalise(raw, folder)
    assert found.count() == raw.count() > 2 and found.agg({"records": "sum"}).first()[0] == 40
    for r in found.collect():
        fs, path = file_system(r.file)
        data = fs.open_input_file(path).read()
        lines = [x.split("\t") for x in fs.open_input_file(file_system(r["index"])[1]).read().decode().splitlines()]
        end = 0
        for offset, length, kind, name in lines:
            member = gzip.decompress(data[int(offset):int(offset) + int(length)])
            assert int(offset) == end and member.startswith(b"WARC/1.1\r\n") and name.encode() in member and kind.encode() in member
            end += int(length)
        assert end == len(data)


def test_revisits_and_edges(spark):
    rows = [(5, "u", "same", "x", 1), (9, None, "same", "x", 1), (2, "a\r\nb", "same", None, None), (3, "u", None, "x", 1), (4, "u", "", "x", 1), (None, "u", "same", "x", 1),
            (None, None, None, None, None), (7, "u", "é" * 100_000, "x", 1), (7, "u", "é" * 100_000, "x", 1), (-8, "u", "only\r\n\r\nonce", "x", 1)]
    got = warc.archive(spark.createDataFrame(rows, PAGES).repartition(3), with_payload=True).collect()
    want = []
    for page_id, _, html, *_ in rows:
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = max(same, default=None)
        revisit = len([r for r in rows if (r[2] or "") == (html or "")]) > 1 and first is not None and first != page_id
        want.append((page_id, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None, None if revisit else (html or "").encode()))
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
    long_only = warc.archive(spark.createDataFrame(rows, PAGES), min_bytes=5).collect()
    assert {r.record_type for r in long_only if r.payload_bytes < 5} == {"response"}
