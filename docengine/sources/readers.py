"""Readers: tables of metadata, chunks and questions, and documents in office formats.

Office files and PDF are read as binary rows by Spark and parsed on the workers with the standard library.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.sources import pdf

METADATA = "doc_id string, project_name string, organization string, file_name string, file_type string, budget string, deadline string, summary string, text string"


def read_metadata(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """A CSV with a header (quotes doubled, lines within quotes); names maps its columns to ours."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    return rows.select(*(F.col(f"`{c}`").alias((names or {}).get(c, c)) for c in rows.columns))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON array (or object) per file."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file of settings, by Spark's file systems; empty if it is empty."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None or not text[0].strip():
        return {}
    if path.endswith(".json"):
        import json

        return json.loads(text[0])
    import yaml

    return yaml.safe_load(text[0]) or {}


def setting(config: dict, path: str, default: object = None) -> object:
    """The value at a dotted path."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def changed_settings(saved: dict, current: dict, paths: Sequence[str]) -> list[str]:
    """The paths whose values differ; all of them where nothing was saved."""
    return list(paths) if not saved else [p for p in paths if setting(saved, p) != setting(current, p)]


def read_binary(spark: SparkSession, path: str, suffixes: Sequence[str] = ("pdf", "hwp", "hwpx", "docx", "txt", "md", "html", "htm")) -> DataFrame:
    """path, file_name, file_type, content of the files below a folder with one of the suffixes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "[^/]*$", 0)
    kind = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    return rows.select("path", name.alias("file_name"), kind.alias("file_type"), "content").where(F.col("file_type").isin(*suffixes))


# ---- office formats

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> list[tuple[str, str, str]]:
    """(kind, style, text) of a document's paragraphs and tables in order; table rows are cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")

    def text(node: ElementTree.Element) -> str:
        parts = {f"{WORD}t": lambda x: x.text or "", f"{WORD}tab": lambda x: "\t", f"{WORD}br": lambda x: "\n"}
        return "".join(parts[x.tag](x) for x in node.iter() if x.tag in parts)

    out = []
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p":
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            if value := text(node).strip():
                out.append(("paragraph", "" if style is None else style.get(f"{WORD}val", ""), value))
        elif node.tag == f"{WORD}tbl":
            cells = ([" ".join("\n".join(text(p) for p in c.iter(f"{WORD}p")).split()) for c in r.findall(f"{WORD}tc")] for r in node.findall(f"{WORD}tr"))
            if lines := [" | ".join(filter(None, r)) for r in cells if any(r)]:
                out.append(("table", "", "\n".join(lines)))
    return out


def docx_text(data: bytes) -> str:
    """Headings stand apart, tables begin with a mark."""
    parts = [f"\n{t}\n" if k == "paragraph" and s.lower().startswith("heading") else f"[표]\n{t}" if k == "table" else t for k, s, t in docx_blocks(data)]
    return "\n".join(parts).strip()


class CompoundFile:
    """Streams of an OLE compound file by path."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini = 1 << shift, 1 << mini_shift
        n_fat, first_dir, _, self.cutoff, first_mini, n_mini, first_dif, n_dif = struct.unpack_from("<IIIIIIII", data, 44)
        fat_at = [x for x in struct.unpack_from("<109I", data, 76) if x < 0xFFFFFFFA]
        while n_dif and first_dif < 0xFFFFFFFA:
            part = struct.unpack(f"<{self.size // 4}I", self._sector(first_dif))
            fat_at += [x for x in part[:-1] if x < 0xFFFFFFFA]
            first_dif, n_dif = part[-1], n_dif - 1
        self.fat = [x for s in fat_at[:n_fat] for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.mini_fat = [x for s in self._chain(first_mini) for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))] if n_mini else []
        raw = b"".join(map(self._sector, self._chain(first_dir)))
        self.entries = [raw[i : i + 128] for i in range(0, len(raw), 128)]
        _, _, _, start, length = self._entry(0)
        self.mini_data = b"".join(map(self._sector, self._chain(start)))[:length]
        self.paths: dict[str, int] = {}
        self._walk(struct.unpack_from("<I", self.entries[0], 76)[0], "")

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, n: int, mini: bool = False) -> Iterator[int]:
        table, seen = (self.mini_fat if mini else self.fat), set()
        while n < len(table) and n not in seen:
            seen.add(n)
            yield n
            n = table[n]

    def _entry(self, i: int) -> tuple[str, int, tuple[int, int, int], int, int]:
        e = self.entries[i]
        n = max(0, struct.unpack_from("<H", e, 64)[0] - 2)
        left, right, child = struct.unpack_from("<III", e, 68)
        start, length = struct.unpack_from("<IQ", e, 116)
        return e[:n].decode("utf-16-le", "replace"), e[66], (left, right, child), start, length & 0xFFFFFFFF

    def _walk(self, i: int, above: str) -> None:
        todo, seen = [(i, above)], set()
        while todo:
            i, above = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            name, kind, (left, right, child), _, _ = self._entry(i)
            todo += [(left, above), (right, above)]
            if kind == 2:
                self.paths[above + name] = i
            elif kind == 1:
                todo.append((child, f"{above}{name}/"))

    def read(self, path: str) -> bytes:
        _, _, _, start, length = self._entry(self.paths[path])
        if length < self.cutoff:
            return b"".join(self.mini_data[s * self.mini : (s + 1) * self.mini] for s in self._chain(start, mini=True))[:length]
        return b"".join(map(self._sector, self._chain(start)))[:length]


def hwp_records(section: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, payload): a header has ten bits of tag, ten of level and twelve of size; size 4095 has its own word."""
    at = 0
    while at + 4 <= len(section):
        (head,) = struct.unpack_from("<I", section, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(section):
                return
            (size,) = struct.unpack_from("<I", section, at)
            at += 4
        yield head & 0x3FF, section[at : at + size]
        at += size


def hwp_sections(data: bytes) -> list[tuple[str, str]]:
    """(name, text) of the body sections in the order of their numbers."""
    ole = CompoundFile(data)
    packed = bool(ole.read("FileHeader")[36] & 1)
    out = []
    for path in sorted((p for p in ole.paths if re.fullmatch(r"BodyText/Section\d+", p)), key=lambda p: int(p[16:])):
        raw = ole.read(path)
        if packed:
            try:
                raw = zlib.decompress(raw, -15)
            except zlib.error:
                raw = zlib.decompress(raw)
        text = "\n".join(p.decode("utf-16-le", "ignore") for tag, p in hwp_records(raw) if tag == 67)
        out.append((path, clean_hwp(text)))
    return out


def clean_hwp(text: str) -> str:
    text = text.replace("\x00", "").replace("\r", "\n").replace("�", "")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def hwpx_pages(data: bytes) -> list[tuple[int, str]]:
    """(number, text) of the section files of a zipped document: paragraphs, and tables as lines of cells."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.search(r"section\d+\.xml$", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
        for i, name in enumerate(names, 1):
            local = lambda e: e.tag.rpartition("}")[2]
            words = lambda e: " ".join("".join(t.itertext()).strip() for t in e.iter() if local(t) == "t").strip()
            lines: list[str] = []

            def visit(node: ElementTree.Element, lines: list[str] = lines, local: object = local, words: object = words) -> None:
                for child in node:
                    if local(child) == "tbl":
                        for row in (r for r in child.iter() if local(r) == "tr"):
                            lines.append("| " + " | ".join(words(c) for c in row if local(c) == "tc") + " |")
                    elif local(child) == "p" and not any(local(x) == "tbl" for x in child.iter()):
                        lines.append(words(child))
                    else:
                        visit(child)

            visit(ElementTree.fromstring(z.read(name)))
            out.append((i, "\n".join(x for x in lines if x)))
    return out


def pdf_pages(data: bytes, ordered: bool = False) -> list[tuple[int, str]]:
    """Pages by the optional library pymupdf where it is installed, which knows more fonts, else by the engine's own reader."""
    try:
        import fitz
    except ImportError:
        return pdf.pages(data, ordered)
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [(i, page.get_text("text", sort=ordered)) for i, page in enumerate(doc, 1)]


BREAKS = ("p", "div", "li", "h1", "h2", "h3")  # fixed values: tags that end a line


class _Markdown(HTMLParser):
    def __init__(self, skip: tuple[str, ...]):
        super().__init__()
        self.skip, self.depth = skip, 0
        self.out: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.skip
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        elif tag == "br" or tag in BREAKS:
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.skip and self.depth > 0
        if tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(" ".join(" ".join(self.cell).split()).replace("|", "\\|"))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if any(r)]
            wide = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
            self.out.append("\n\n" + "\n".join([*lines[:1], *["| " + " | ".join(["---"] * wide) + " |"][: len(lines)], *lines[1:]]) + "\n\n")
            self.rows = None
        elif tag in BREAKS:
            self.handle_data("\n")

    def handle_data(self, data: str) -> None:
        if self.depth:
            return
        (self.out if self.cell is None else self.cell).append(data)


REFERENCE = re.compile("&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);|([a-zA-Z][a-zA-Z0-9]*;))?")


def _open_references(html: str) -> tuple[str, str]:
    """The page with a sign that it does not hold in place of every & that begins no reference with a semicolon, and that sign."""
    sign = next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in html)
    return REFERENCE.sub(lambda m: m[0] if len(m[0]) > 1 and (not m[1] or m[1] in html5) else sign + m[0][1:], html), sign


def html_text(html: str | None, skip: tuple[str, ...] = (), closed: bool = False) -> str:
    """Text with line ends at blocks and tables as lines of cells; skip names tags whose contents go.

    References without a semicolon (&amp at a place where a text was cut) are read as browsers do, or stay as they are if only closed ones count.
    """
    page, sign = _open_references(html or "") if closed else (html or "", "&")
    parser = _Markdown(skip)
    parser.feed(page)
    parser.close()
    text = "".join(parser.out).replace(sign, "&").replace("\t", " ")
    text = "\n".join(line.strip() if line.startswith("| ") else re.sub(r" {2,}", " ", line).strip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(html_text)


def with_markdown(pages: DataFrame, column: str = "html", skip: Sequence[str] = (), closed: bool = False) -> DataFrame:
    if not skip and not closed:
        return pages.withColumn("markdown", html_to_markdown(F.col(column)))
    parse = F.pandas_udf(lambda s: s.map(lambda h: html_text(h, tuple(skip), closed)), "string")
    return pages.withColumn("markdown", parse(F.col(column)))


EXTRACTED = "path string, file_name string, file_type string, num_pages int, pages array<struct<page: int, text: string>>, text string, error string"


def extract_one(kind: str, data: bytes, parsers: dict | None = None) -> list[tuple[int, str]]:
    """Pages of one file by its type; parsers (type -> function from bytes to pages) come first, for OCR and the like."""
    if parsers and kind in parsers:
        return parsers[kind](data)
    if kind == "docx":
        return [(1, docx_text(data))]
    if kind == "hwp":
        return [(i, t) for i, (_, t) in enumerate(hwp_sections(data), 1)]
    if kind == "hwpx":
        return hwpx_pages(data)
    if kind == "pdf":
        return pdf_pages(data)
    if kind in ("html", "htm"):
        return [(1, html_text(data.decode("utf-8", "replace")))]
    if kind in ("txt", "md"):
        return [(1, data.decode("utf-8-sig", "replace"))]
    raise ValueError(f"unsupported file type {kind!r}")


def extract(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """Pages and text of binary files; a file that cannot be read has an error and no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, name, kind, data in zip(frame["path"], frame["file_name"], frame["file_type"], frame["content"], strict=True):
                try:
                    pages, error = extract_one(kind, bytes(data), parsers), None
                except Exception as e:  # a broken file must not stop the others
                    pages, error = [], f"{type(e).__name__}: {e}"
                text = None if error else "\n\n".join(t for _, t in pages)
                rows.append((path, name, kind, len(pages), [{"page": p, "text": t} for p, t in pages], text, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("path s", "file_name s", "file_type s", "num_pages i", "pages a", "text s", "error s")])

    return files.select("path", "file_name", "file_type", "content").mapInPandas(run, EXTRACTED)


def only_new(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that are not among the paths done before: a batch that was broken off goes on."""
    return files.join(done.select("path"), "path", "left_anti")


def suffixes_for(strategy: str) -> tuple[str, ...]:
    """The file types that a chunking strategy reads."""
    return ("pdf",) if strategy == "pdf_page" else ("hwp", "hwpx", "pdf", "docx", "txt", "md", "html") if strategy.startswith("markdown") else ("hwp", "hwpx", "pdf", "docx", "txt")


def file_routing(kind: Column, text: Column) -> Column:
    """How well a file can be read: needs_ocr, table, or text."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 40, "needs_ocr").when(F.contains(text, F.lit("|")) & F.contains(text, F.lit("---")), "table").otherwise(F.concat(F.lit("text_"), kind))
