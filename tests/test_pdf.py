import zlib

import pytest

from docengine.sources import pdf, readers


def build(objects, packed=()):
    """A PDF file of numbered objects (number -> bytes), those in `packed` in an object stream."""
    out = bytearray(b"%PDF-1.5\n")
    for n, body in objects.items():
        if n not in packed:
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    if packed:
        heads, bodies = [], b""
        for n in packed:
            heads.append(b"%d %d" % (n, len(bodies)))
            bodies += objects[n] + b" "
        head = b" ".join(heads) + b" "
        out += b"99 0 obj\n" + stream(head + bodies, b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head))) + b"\nendobj\n"
    return bytes(out + b"trailer << /Root 1 0 R >>\n%%EOF")


def stream(data, more=b"", flate=True):
    body = zlib.compress(data) if flate else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if flate else b"", more, body)


CMAP = b"""/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <BCF4> <0002> <C548> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange endcmap"""


def sample(flate=True, packed=()):
    first = b"BT /F1 12 Tf 72 700 Td (Hello) Tj 40 0 Td (wor\\154d \\(one\\)) Tj 0 -14 Td [(sec) -20 (ond) -400 (line)] TJ T* ET"
    second = b"q 1 0 0 1 10 20 cm BT /F2 10 Tf 1 0 0 1 0 500 Tm <00010002> Tj ET Q BT /F2 10 Tf 1 0 0 1 10 600 Tm <001000110012> Tj ET /X1 Do"
    form = b"BT /F1 9 Tf 5 5 Td (in a form) Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 11 0 R] /Count 3 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X1 10 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>",
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 6: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 9 0 R >>",
        7: stream(first, flate=flate), 8: stream(second, flate=flate), 9: stream(CMAP, flate=flate), 10: stream(form, b"/Type /XObject /Subtype /Form", flate), 11: b"<< /Type /Page /Parent 2 0 R >>",
    }
    return build(objects, packed)


@pytest.mark.parametrize("flate,packed", [(True, ()), (False, ()), (True, (1, 2, 3, 4, 5, 6, 11))])
def test_pages(flate, packed):
    got = pdf.pages(sample(flate, packed))
    assert got == [(1, "Hello world (one)\nsecond line"), (2, "보안\nABC\nin a form"), (3, "")]
    assert pdf.pages(sample(flate, packed), ordered=True)[1] == (2, "ABC\n보안\nin a form")


def test_encodings_and_filters():
    page = b"<4142> Tj (x) Tj"
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /quoteleft /uniAC00] >> /FirstChar 65 /Widths [500 600] >>"
    korean = b"<< /Type /Font /Subtype /Type0 /Encoding /KSCms-UHC-H >>"
    content = b"BT /A 10 Tf 0 50 Td " + page + b" /B 10 Tf 0 -20 Td <" + "한글".encode("cp949").hex().encode() + b"> Tj ET"
    hexed = b"<< /Length 1 /Filter [/ASCIIHexDecode] >>\nstream\n" + content.hex().encode() + b">\nendstream"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /A 5 0 R /B 6 0 R >> >> >>", 4: hexed, 5: font, 6: korean}
    assert pdf.pages(build(objects)) == [(1, "‘가x\n한글")]


def test_predictor():
    rows, before, packed = [b"abcd", b"abce", b"zzzz"], bytes(4), b""
    for r in rows:
        packed += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before, strict=True))
        before = r
    file = pdf.File(b"%PDF-1.4")
    got = file.data(pdf.Stream({pdf.Name("Filter"): pdf.Name("FlateDecode"), pdf.Name("DecodeParms"): {pdf.Name("Predictor"): 12, pdf.Name("Columns"): 4}}, zlib.compress(packed)))
    assert got == b"".join(rows)


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4\ntrailer << /Encrypt 3 0 R >>"])
def test_what_cannot_be_read_is_an_error(data):
    with pytest.raises(ValueError):
        pdf.pages(data)


def test_extract(spark):
    rows = [("/a.pdf", "a.pdf", "pdf", sample()), ("/b.pdf", "b.pdf", "pdf", b"broken")]
    got = {r.file_name: r for r in readers.extract(spark.createDataFrame(rows, "path string, file_name string, file_type string, content binary")).collect()}
    assert got["a.pdf"].num_pages == 3 and got["a.pdf"].text.startswith("Hello world") and got["a.pdf"].error is None
    assert got["b.pdf"].error == "ValueError: not a PDF" and got["b.pdf"].text is None
