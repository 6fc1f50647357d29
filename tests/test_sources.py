import io
import zipfile

import pytest
from lodestone.sources import files, listings
from pyspark.sql import functions as F


def test_sockets(spark):
    text = "p10\ncnode\nPTCP\nn127.0.0.1:3000\nn[::1]:3000\np20\nnx:1\ncdb\nPUDP\nny:2\np0\nnz:3"
    out = listings.sockets(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("n").collect()
    assert [(r.pid, r.command, r.protocol, r.address) for r in out] == [(10, "node", "TCP", "127.0.0.1:3000"), (10, "node", "TCP", "[::1]:3000"), (20, "", "TCP", "x:1"), (20, "db", "UDP", "y:2")]
    rows = spark.createDataFrame([tuple(r) for r in out], "source string, pid long, command string, protocol string, address string, n int")
    assert listings.console(rows, "localhost").count() == 2 and listings.console(rows, "3000").count() == 2
    assert listings.console(rows, "NOD").count() == 2 and listings.console(rows, "ports 20").count() == 2 and listings.console(rows, "a b c").count() == 0


def test_attribute_dump(spark):
    text = '/A.app   kMDItemUsedDates = (\n    "2026-07-06 04:00:00 +0000",\n    "bad",\n    "2026-07-07 04:00:00 +0000"\n)\n/B.app   kMDItemUsedDates = (null)\n    "2026-07-06 04:00:00 +0000"'
    out = listings.used_dates(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("at").collect()
    assert [(r.path, r.at) for r in out] == [("/A.app", 1783310400), ("/A.app", 1783396800)]


def test_samples_links_history(spark, tmp_path):
    rows = spark.createDataFrame([('{"ID":"a","Name":"n","CPUPerc":"1.5%","MemUsage":"1.5MiB / 2GB"}',), ("x",)], "json string")
    r = listings.container_samples(rows).first()
    assert (r.cpu, r.memory, r.limit) == (1.5, 1572864.0, 2e9)
    m = spark.createDataFrame([("see http://www.example.org and http://acme.zoom.us/j/1 now",), ("https://notzoom.us/x",)], "t string").select(listings.meeting_link(F.col("t")).alias("u")).collect()
    assert [x.u for x in m] == ["https://acme.zoom.us/j/1", None]
    (tmp_path / "h.jsonl").write_text('{"at":1,"q":"a"}\nbroken\n{"at":2,"q":"b"}\n')
    assert [x.q for x in listings.history(spark, str(tmp_path / "h.jsonl"), "at long, q string", "at").collect()] == ["b", "a"]


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("héllo".encode())
    (tmp_path / "b.md").write_bytes(b"bad \xff")
    (tmp_path / "c.md").write_bytes(b"nul \0")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / ".hidden.md").write_bytes(b"x")
    out = {r.title: (r.body, r.extraction) for r in files.documents(files.files(spark, f"file://{tmp_path}")).collect()}
    assert out == {"a.md": ("héllo", 0), "b.md": ("", 5), "c.md": ("", 5)}
    big = spark.createDataFrame([(bytearray(b"a" * (files.MAX_TEXT - 1) + "é".encode()),)], "content binary")
    assert big.select(F.length(files.decoded(F.col("content"))).alias("n")).first().n == files.MAX_TEXT - 1


def _zip(**members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return data.getvalue()


A = "http://schemas.openxmlformats.org/drawingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def test_office(spark):
    slides = _zip(**{f"ppt__slides__slide{n}_xml": f'<p xmlns:a="{A}"><a:p><a:r><a:t>Slide {n}</a:t></a:r></a:p></p>' for n in (10, 2)})
    assert files.office_text(slides, "pptx") == ("Slide 2\fSlide 10", False)
    sheet = f'<worksheet xmlns="{S}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row></sheetData></worksheet>'
    book = _zip(xl__sharedStrings_xml=f'<sst xmlns="{S}"><si><t>Name</t></si></sst>', xl__worksheets__sheet1_xml=sheet)
    assert files.office_text(book, "xlsx")[0] == "# Sheet 1\n\nSheet 1 · Row 1: A1: Name | B1: 7"
    for bad in (b"not a zip", _zip(**{"ppt__slides__slide1_xml": "<!DOCTYPE x><a/>"}), _zip(**{"..__evil_xml": "x"})):
        with pytest.raises(files.Unreadable):
            files.office_text(bad, "pptx")
    rows = spark.createDataFrame([("/a.pptx", bytearray(slides)), ("/b.pptx", bytearray(b"x"))], "path string, content binary")
    assert {r.path: r.extraction for r in files.extracted(rows).collect()} == {"/a.pptx": 1, "/b.pptx": 5}


def test_rich_and_open_texts():
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0 Caf\'e9 \u8212? and \{braces\}\par next {\b bold} \u-10179?\u-8704?}"
    assert files.office_text(rtf, "rtf") == ("Café — and {braces}\n\nnext bold 😀", False)
    t = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    odt = _zip(content_xml=f'<d xmlns:t="{t}"><t:h>Title</t:h><t:p>One <t:span>two</t:span></t:p><t:p> </t:p></d>')
    assert files.office_text(odt, "odt") == ("Title\n\nOne two", False)
    for bad in (b"plain", rb"{\rtf1 open", rb"{\rtf1 x}}"):
        with pytest.raises(files.Unreadable):
            files.office_text(bad, "rtf")
