"""PDF files made by hand: two pages, compressed objects, maps to Unicode, broken and locked files."""

import zlib

import pytest
from pyspark.sql import functions as F

from newsloom.plans import queries
from newsloom.sources import pdf


def file(*objects, trailer=b"/Root 1 0 R"):
    """objects: (number, body). The cross-reference table is left out, as many broken files have none that holds."""
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects) + b"trailer << " + trailer + b" >>\n%%EOF"


def stream(data, extra=b"", packed=True):
    body = zlib.compress(data) if packed else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if packed else b"", extra, body)


TREE = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 7 0 R >> >> >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>"), (4, b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R 8 0 R] >>"), (7, b"<< /Type /Font /Subtype /Type1 >>")]
FIRST = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(Wor) -20 (ld) -250 (again)] TJ T* (caf\\351) Tj ET"


def test_two_pages():
    data = file(*TREE, (5, stream(FIRST)), (6, stream(b"BT /F1 9 Tf 1 0 0 1 50 50 Tm <5365636F6E64> Tj 1 0 0 1 90 50 Tm (page) Tj", packed=False)), (8, stream(b"(next) ' ET % (no) Tj\n")))
    assert pdf.read(data) == (["Hello (PDF)\nWorld again\ncafé", "Second page\nnext"], None)


def test_compressed_objects_and_maps():
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <D55C> <0002> <AE00 > endbfchar\n1 beginbfchar <0009> <AE00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <D83DDE00>] endbfrange endcmap"
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Contents 5 0 R /Resources 4 0 R >>"), (4, b"<< /Font << /K 7 0 R >> >>"), (7, b"<< /Subtype /Type0 /ToUnicode 8 0 R >>")]
    head, body = b"", b""
    for n, x in inner:
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    packed = stream(head + body, b"/Type /ObjStm /N 5 /First %d" % len(head))
    rows = b"".join(b"\x02" + bytes([i, 0, 0]) for i in range(3))
    xref = stream(rows, b"/Type /XRef /Root 1 0 R /W [1 1 1] /Size 9 /DecodeParms << /Predictor 12 /Columns 3 >>")
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj %s endobj\n" % o for o in ((5, stream(b"BT /K 10 Tf <00010009> Tj 0 -1 TD <001000110012 00200021 00FF> Tj ET")), (8, stream(cmap)), (9, packed), (10, xref)))
    assert pdf.read(data) == (["한글\nABCx😀�"], None)


def test_predictors():
    plain = bytes(range(1, 13))
    assert pdf._unpredict(b"\0" + plain[:4] + b"\x01\x05\x01\x01\x01" + b"\x02\x04\x04\x04\x04", 4, 1) == plain
    assert pdf._unpredict(b"\x03\x02\x03\x04" + b"\x04\x01\x01\x01", 3, 1) == bytes([2, 4, 6, 3, 5, 7])


def test_broken_files():
    good = file(*TREE, (5, stream(FIRST)), (6, stream(b"")), (8, stream(b"")))
    assert pdf.read(b"") == ([], "not a PDF file") == pdf.read(b"<html>") and pdf.read(b"%PDF-1.7\n") == ([], "no pages")
    assert pdf.read(file(*TREE, trailer=b"/Root 1 0 R /Encrypt 9 0 R")) == ([], "encrypted")
    cut = good[: good.index(b"trailer")]
    assert pdf.read(cut) == pdf.read(good)  # the catalogue is found by its type
    for at in range(20, len(good), 37):
        pages, error = pdf.read(good[:at])
        assert error or pages
    bad = file(*TREE, (5, b"<< /Length 4 /Filter /FlateDecode >>\nstream\nnope\nendstream"), (6, stream(b"BT (ok) Tj ET")), (8, stream(b"")))
    pages, error = pdf.read(bad)
    assert pages == ["", "ok"] and error.startswith("page 1: ")
    loop = file((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [2 0 R 2 0 R] >>"))
    assert pdf.read(loop) == ([], "no pages")


def test_wide_ranges_of_a_map_are_not_written_out(spark, monkeypatch):
    cmap = b"1 begincodespacerange <00000000> <FFFFFFFF> endcodespacerange 1 beginbfchar <00000041> <0078> <00010041> <0079> endbfchar 3 beginbfrange <00000000> <FFFFFFFF> <0000> <00000040> <00000042> <0061> <00000100> <00000300> <00410000> endbfrange"
    made = pdf.File(file((1, b"<< /ToUnicode 2 0 R >>"), (2, stream(cmap))))
    font = pdf.Font(made, made.objects[1])
    shown = bytes.fromhex("0000003F 00000041 00000101 00010041 0000D800 FFFFFFFF 00000041")
    assert font.text(shown) == "?bA\x01\U00010041\ufffd\U0010ffffb" and len(font.codes) <= pdf.NARROW
    rows = spark.createDataFrame([(i,) for i in range(5)], "s_suppkey long").withColumn("s_name", F.lit("x")).coalesce(1)
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    monkeypatch.setattr(queries, "FILES", 2)
    got = queries.pdf_files(spark, "")
    assert got.rdd.getNumPartitions() == 3 and got.where("text = '이력서 x\npage\ntwo'").count() == 4


def test_pdf_rows(spark):
    data = file(*TREE, (5, stream(FIRST)), (6, stream(b"BT (two) Tj ET")), (8, stream(b"")))
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"x")), (3, None)], "n int, content binary")
    got = {r.n: (r.pages, r.text, r.error) for r in pdf.pdf_texts(df, F.col("content"), ("n",)).collect()}
    assert got == {1: (["Hello (PDF)\nWorld again\ncafé", "two"], "Hello (PDF)\nWorld again\ncafé\ntwo", None), 2: ([], "", "not a PDF file"), 3: ([], "", "not a PDF file")}


@pytest.mark.parametrize("raw", [b"(a\\\nb)", b"(a\\r\\101\\7)", b"(n(e)st)", b"<41 4>", b"[1 -2.5 .5 true null /N#41 3 0 R]", b"<< /A << /B [<< >>] >> >>"])
def test_values(raw):
    want = {b"(a\\\nb)": b"ab", b"(a\\r\\101\\7)": b"a\rA\x07", b"(n(e)st)": b"n(e)st", b"<41 4>": b"A@", b"[1 -2.5 .5 true null /N#41 3 0 R]": [1, -2.5, 0.5, True, None, "NA", 3], b"<< /A << /B [<< >>] >> >>": {"A": {"B": [{}]}}}
    got, end = pdf.value(raw + b" ", 0)
    assert got == want[raw] and end == len(raw)
