import sys
import zlib

from test_pdf import build, stream

from docengine.sources import readers, tools

COPY = (sys.executable, "-c", "import sys, pathlib; pathlib.Path(sys.argv[2], 'input.pdf').write_bytes(b'%PDF ' + pathlib.Path(sys.argv[1]).read_bytes())", "{in}", "{out}")
FAILS = (sys.executable, "-c", "import sys; sys.exit('no license')")
SLOW = (sys.executable, "-c", "import time; time.sleep(30)")
READS = (sys.executable, "-c", "import sys; sys.stdout.write('text of ' + str(len(open(sys.argv[1], 'rb').read())) + ' ' + sys.argv[2])", "{in}", "{lang}")
DRAWS = (sys.executable, "-c", "import sys, pathlib; pathlib.Path(sys.argv[2], 'page.png').write_bytes(b'\\x89PNG\\r\\n\\x1a\\n' + sys.argv[1].encode())", "{page}", "{out}")
PNG = b"\x89PNG\r\n\x1a\n....."


def test_to_pdf(spark):
    rows = [("/a b.docx", "가 나.docx", "docx", b"one"), ("/b.pdf", "b.pdf", "pdf", b"as is")]
    files = spark.createDataFrame(rows, "path string, file_name string, file_type string, content binary")
    got = {r.path: r for r in tools.to_pdf(files, COPY).collect()}
    assert (got["/a b.docx"].file_name, got["/a b.docx"].file_type, bytes(got["/a b.docx"].content)) == ("가 나.pdf", "pdf", b"%PDF one") and bytes(got["/b.pdf"].content) == b"as is"
    for command, seconds, error in ((FAILS, 60, "no license"), (SLOW, 0.5, "took more than 0.5 s"), (("no-such-program",), 60, "no-such-program is not installed"), ((sys.executable, "-c", ""), 60, "left no PDF")):
        bad = {r.path: r for r in tools.to_pdf(files, command, seconds).collect()}["/a b.docx"]
        assert error in bad.error and bad.content is None and bad.file_type == "docx"


def test_images():
    assert [tools.image_kind(x) for x in (PNG, b"\xff\xd8\xff\xe0", b"GIF89a", b"BM..", b"text", b"")] == ["png", "jpg", "gif", "bmp", "", ""]
    assert tools.image_text(PNG, READS) == f"text of {len(PNG)} kor+eng" and tools.image_text(PNG, FAILS) == ""


def test_scanned_pages():
    page = lambda n: b"<< /Type /Page /Contents %d 0 R /Resources << /Font << /F 9 0 R >> >> >>" % n
    shown = stream(b"BT /F 10 Tf (" + b"a page with more than forty characters of its own" + b") Tj ET")
    data = build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R 4 0 R] >>", 3: page(5), 4: page(6), 5: shown, 6: stream(b"BT ET"), 9: b"<< /Type /Font /Subtype /Type1 >>"})
    recognise = lambda d, n: tools.page_text(d, n, DRAWS, READS)
    assert tools.pdf_with_ocr(recognise)(data) == [(1, "a page with more than forty characters of its own"), (2, "text of 9 kor+eng")]
    assert tools.pdf_with_ocr(lambda d, n: tools.page_text(d, n, FAILS))(data)[1] == (2, "")


class Ole:
    """The streams of an HWP file, as readers.CompoundFile gives them."""

    def __init__(self, data):
        if data != b"hwp":
            raise ValueError("not a compound file")
        body, squeeze = "본문".encode("utf-16-le"), zlib.compressobj(wbits=-15)
        packed = squeeze.compress(b"BM" + b"x" * 50) + squeeze.flush()
        self.paths = {"FileHeader": bytes(64), "BodyText/Section0": (67 | len(body) << 20).to_bytes(4, "little") + body, "BinData/BIN0001.png": PNG, "BinData/BIN0002.bmp": packed, "BinData/BIN0003.ole": b"zz"}
        self.read = self.paths.get


def test_hwp(monkeypatch):
    monkeypatch.setattr(readers, "CompoundFile", Ole)
    assert [n for n, _ in tools.hwp_images(b"hwp")] == ["BinData/BIN0001.png", "BinData/BIN0002.bmp"]
    assert tools.hwp_pages((FAILS,), lambda x: f"image {len(x)}")(b"hwp") == [(1, "본문"), (2, f"image {len(PNG)}\n\nimage 52")]
    assert tools.hwp_pages((FAILS, READS), lambda x: "")(b"hwp") == [(1, "text of 3 {lang}")]
    assert tools.hwp_pages((FAILS,))(b"other") == []


def test_parsers(spark):
    files = spark.createDataFrame([("/x.hwp", "x.hwp", "hwp", b"12345")], "path string, file_name string, file_type string, content binary")
    row = readers.extract(files, parsers={"hwp": tools.hwp_pages((READS,))}).first()
    assert row.text == "text of 5 {lang}" and row.error is None
