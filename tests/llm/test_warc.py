import gzip

import pytest
from lodestone.llm import warc

RECORDS = [warc.record(i, f"http://x/{i}", b"body %d " % i * 40) for i in range(6)]


def ids(found):
    return [f.headers["warc-record-id"][len("<urn:page:") : -1] for f in found if f.headers is not None]


def covered(found, n):
    at = 0
    for f in found:
        assert f.offset == at
        at += f.length
    assert at == n


@pytest.mark.parametrize("pack", [lambda r: r, warc.member])
def test_whole_archives(pack):
    data = b"".join(map(pack, RECORDS))
    found = list(warc.salvage(data))
    assert ids(found) == list("012345") and not [f for f in found if f.reason]
    covered(found, len(data))


def test_members_are_plain_gzip_and_end_with_zero():
    data = b"".join(map(warc.member, RECORDS))
    assert gzip.decompress(data) == b"".join(RECORDS) and all(warc.member(r)[-1] == 0 for r in RECORDS)


def test_damage_loses_one_record_and_is_logged():
    parts = [warc.member(r) for r in RECORDS]
    at = len(parts[0]) + len(parts[1]) + 30
    data = bytearray(b"".join(parts))
    data[at] ^= 255
    found = list(warc.salvage(bytes(data)))
    assert ids(found) == list("01345")
    assert [(f.offset, f.length) for f in found if f.reason] == [(len(parts[0]) + len(parts[1]), len(parts[2]))]
    covered(found, len(data))


def test_lost_bytes_in_a_plain_archive():
    data = b"".join(RECORDS)
    cut = data[:200] + data[230:]
    found = list(warc.salvage(cut))
    assert ids(found) == list("12345") and sum(1 for f in found if f.reason) == 1
    covered(found, len(cut))


def test_junk_truncation_and_false_starts():
    data = b"junk" + warc.member(RECORDS[0]) + b"\x1f\x8b\x08zzWARC/1.1\r\nx" + RECORDS[1] + warc.member(RECORDS[2])[:-9]
    found = list(warc.salvage(data))
    assert ids(found) == list("01") and sum(1 for f in found if f.reason) == 3
    covered(found, len(data))
    assert list(warc.salvage(b"")) == []


def test_a_version_line_inside_a_payload_is_payload():
    inner = warc.record(9, "u", b"inner")
    found = list(warc.salvage(warc.record(8, "u", b"x" + inner) + RECORDS[0]))
    assert ids(found) == ["8", "0"]


def test_round_trip(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "a\r\nb", "WARC/1.1\r\n\0é"), (7, "u", "x" * 200000), (None, "u", "zz")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    out = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert out == {5: (4, "revisit", 3), 3: (4, "response", None), 9: (4, "revisit", 3), 1: (0, "response", None), 2: (0, "revisit", 1), 4: (13, "response", None), 7: (200000, "response", None), None: (2, "response", None)}
    assert all(r.refers_to is None for r in warc.round_trip(pages, min_bytes=5).collect())
    assert warc.round_trip(pages.limit(0)).count() == 0
