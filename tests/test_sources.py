import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docengine.plans import queries, registry  # noqa: F401  registers its queries
from docengine.sources import readers as R
from docengine.sources import writers as W

DOCX = """<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>제목</w:t></w:r></w:p><w:p><w:r><w:t>본문 </w:t><w:tab/><w:t>글</w:t></w:r></w:p><w:p/>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b  c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>끝</w:t></w:r></w:p></w:body></w:document>"""
HWPX = '<s xmlns:hp="x"><hp:p><hp:t>첫 줄</hp:t></hp:p><hp:p><hp:tbl><hp:tr><hp:tc><hp:p><hp:t>a</hp:t></hp:p></hp:tc><hp:tc><hp:p><hp:t>b</hp:t></hp:p></hp:tc></hp:tr></hp:tbl></hp:p></s>'


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), text)
    return out.getvalue()


def record(tag, payload):
    if len(payload) < 0xFFF:
        return struct.pack("<I", tag | len(payload) << 20) + payload
    return struct.pack("<II", tag | 0xFFF << 20, len(payload)) + payload


def compound(streams):
    """A compound file with 512-byte sectors; streams of 4,096 bytes or more only, and one small one."""
    sectors, fat = [], []

    def put(data):
        first = len(sectors)
        n = max(1, -(-len(data) // 512))
        for i in range(n):
            sectors.append(data[i * 512 : (i + 1) * 512].ljust(512, b"\0"))
            fat.append(first + i + 1 if i + 1 < n else 0xFFFFFFFE)
        return first

    mini, mini_fat, entries = b"", [], []

    def entry(name, kind, left=0xFFFFFFFF, right=0xFFFFFFFF, child=0xFFFFFFFF, start=0, size=0):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    placed = {}
    for name, data in streams.items():
        if len(data) < 4096:
            first = len(mini) // 64
            n = max(1, -(-len(data) // 64))
            mini += data.ljust(n * 64, b"\0")
            mini_fat += [first + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
            placed[name] = (first, len(data))
        else:
            placed[name] = (put(data), len(data))
    mini_at = put(mini)
    names = list(streams)  # FileHeader, then sections in a folder, chained to the right
    entries.append(entry("Root Entry", 5, child=1, start=mini_at, size=len(mini)))
    entries.append(entry("FileHeader", 2, right=2, start=placed["FileHeader"][0], size=placed["FileHeader"][1]))
    entries.append(entry("BodyText", 1, child=3))
    sections = [n for n in names if n != "FileHeader"]
    for i, n in enumerate(sections):
        entries.append(entry(n, 2, right=4 + i if i + 1 < len(sections) else 0xFFFFFFFF, start=placed[n][0], size=placed[n][1]))
    directory = put(b"".join(entries))
    mini_fat_at = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff"))
    fat_at = len(sectors)
    table = fat + [0xFFFFFFFD]
    sectors.append(struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 4096, mini_fat_at, 1, 0xFFFFFFFE, 0)
    return head.ljust(76, b"\0") + struct.pack("<I", fat_at) + b"\xff" * (4 * 108) + b"".join(sectors)


def hwp(packed):
    body = lambda text: record(66, b"xx") + record(67, text.encode("utf-16-le"))
    pack = (lambda b: zlib.compressobj(9, zlib.DEFLATED, -15).compress(b) + b"") if packed else (lambda b: b)
    if packed:
        def pack(b):
            c = zlib.compressobj(0, zlib.DEFLATED, -15)
            return c.compress(b) + c.flush()
    long = "긴 본문 " * 1500
    return compound({"FileHeader": b"HWP Document File".ljust(36, b"\0") + bytes([packed]) + b"\0" * 27, "Section10": pack(body("둘째\r글\x00")), "Section0": pack(body(long))}), long.strip()


@pytest.mark.parametrize("packed", [0, 1])
def test_hwp(packed):
    data, long = hwp(packed)
    got = R.hwp_sections(data)
    assert [n for n, _ in got] == ["BodyText/Section0", "BodyText/Section10"] and got[0][1] == long and got[1][1] == "둘째\n글"
    with pytest.raises(ValueError):
        R.CompoundFile(b"nothing")


def test_docx_and_hwpx():
    data = zipped(word__document_xml=DOCX)
    assert R.docx_blocks(data) == [("paragraph", "Heading1", "제목"), ("paragraph", "", "본문 \t글"), ("table", "", "a | b c"), ("paragraph", "", "끝")]
    assert R.docx_text(data) == "제목\n\n본문 \t글\n[표]\na | b c\n끝"
    assert R.hwpx_pages(zipped(Contents__section1_xml=HWPX, Contents__section0_xml=HWPX)) == [(1, "첫 줄\n| a | b |"), (2, "첫 줄\n| a | b |")]


def test_html():
    html = "<h1>T</h1><p>a  b<br>c</p><script>var x</script><table><tr><th>k</th><th>v|w</th></tr><tr><td>1</td></tr></table>end"
    assert R.html_text(html) == "T\n\na b\nc\nvar x\n\n| k | v\\|w |\n| --- | --- |\n| 1 |  |\n\nend"
    assert "var x" not in R.html_text(html, ("script",)) and R.html_text(None) == ""


def test_html_of_cut_references(spark, tmp_path):
    """Browsers read a reference without a semicolon; the query has it as it is, as its SQL does, and scripts alike."""
    duckdb = pytest.importorskip("duckdb")
    heads = ["R &amp;&amp", "R &amp;&am", "R &", "R &quot;x&quot", "a &lt;b&gt; &copy; c &middot", "\U000f0000 &amp;lt; &amp"]
    pages = [(i, f"<title>{h}</title><style>p{{margin:0}}</style><script>if (a &amp b) t('&lt;');</script><p>x &amp; y</p>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(db.execute(registry.SQL["html_markdown"]).fetchall())
    assert {r.page_id: r.markdown for r in registry.QUERIES["html_markdown"](spark, str(tmp_path)).collect()} == want
    assert want[0] == "R &&ampp{margin:0}if (a &amp b) t('&lt;');\nx & y" and R.html_text(pages[0][1]) == want[0].replace("&ampp", "&p")
    assert R.html_text("<p>&#65;&#x42;&nbsp;&nosuch;&#67 &ampx;</p>", closed=True) == "AB\xa0&nosuch;&#67 &ampx;"


def test_extract_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.docx").write_bytes(zipped(word__document_xml=DOCX))
    (tmp_path / "b.HTML").write_text("<p>x</p>")
    (tmp_path / "c.txt").write_text("가\n나", encoding="utf-8")
    (tmp_path / "d.hwp").write_bytes(b"broken")
    (tmp_path / "e.bin").write_bytes(b"?")
    files = R.read_binary(spark, str(tmp_path))
    got = {r.file_name: r for r in R.extract(files).collect()}
    assert set(got) == {"a.docx", "b.HTML", "c.txt", "d.hwp"} and got["b.HTML"].text == "x" and got["c.txt"].text == "가\n나"
    assert got["d.hwp"].text is None and "compound" in got["d.hwp"].error and got["a.docx"].pages[0].text.startswith("제목")
    done = R.extract(files).where("file_type != 'txt'")
    assert [r.file_name for r in R.only_new(files, done).collect()] == ["c.txt"]
    assert "hwp" in R.suffixes_for("section") and R.suffixes_for("pdf_page") == ("pdf",)


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿공고 번호,사업명,텍스트\n1,"가, ""나""","여러\n줄"\n,다,\n', encoding="utf-8")
    rows = R.read_metadata(spark, str(tmp_path / "m.csv"), {"공고 번호": "doc_id", "사업명": "project_name", "텍스트": "text"}).collect()
    assert [tuple(r) for r in rows] == [("1", '가, "나"', "여러\n줄"), (None, "다", None)]
    (tmp_path / "c.yaml").write_text("a:\n  b: 3\n")
    config = R.read_config(spark, str(tmp_path / "c.yaml"))
    assert R.setting(config, "a.b") == 3 and R.setting(config, "a.x", 7) == 7
    assert R.changed_settings({}, config, ["a.b"]) == ["a.b"] and R.changed_settings({"a": {"b": 3}}, config, ["a.b", "a.c"]) == []
    (tmp_path / "q.json").write_text(json.dumps([{"qid": "1", "gold_ids": ["a"]}, {"qid": "2", "gold_ids": []}]))
    assert R.read_json(spark, str(tmp_path / "q.json"), "qid string, gold_ids array<string>").count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], {"k": "v"}), ("b, \"q\"\nz", None, None)], "t string, l array<string>, m map<string,string>")
    W.write_csv(df, str(tmp_path / "c"))
    back = {r.t: r.l for r in spark.read.csv(str(tmp_path / "c"), header=True, escape='"', multiLine=True).collect()}
    assert back["a"] == '["x","y"]' and 'b, "q"\nz' in back
    W.append_sheet(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"', multiLine=True).count() == 4
    W.write_jsonl(df, str(tmp_path / "j"))
    assert R.read_jsonl(spark, str(tmp_path / "j"), "t string, l array<string>").count() == 2
    W.write_settings(spark, {"a": 1, "ㄱ": [2]}, str(tmp_path / "s"))
    assert W.read_settings(spark, str(tmp_path / "s")) == {"a": 1, "ㄱ": [2]} and W.read_settings(spark, str(tmp_path / "none")) == {}
    flat = df.select(W.flat_metadata(df, ["t", "l"]).alias("m")).collect()
    assert flat[0].m == {"t": "a", "l": "x > y"} and set(flat[1].m) == {"t"}


def test_vector_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "b")], "doc_id long, embedding array<float>, text string")
    store = W.VectorTable(spark, str(tmp_path / "v"), "cosine")
    assert not store.exists()
    store.build(rows, {"model": "m"})
    store.upsert(spark.createDataFrame([(2, [1.0, 1.0], "B"), (3, [-1.0, 0.0], "c")], rows.schema))
    asked = spark.createDataFrame([(9, [0.0, 1.0])], "qid long, embedding array<float>")
    got = store.search(asked, 2).orderBy("rank").collect()
    assert store.exists() and store.settings()["model"] == "m" and [(r.doc_id, r.text) for r in got] == [(2, "B"), (1, "a")] and store.load().count() == 3
    assert store.load().where(F.col("doc_id") == 2).first().text == "B"
