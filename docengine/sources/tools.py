"""External programs on the workers: office files to PDF, text recognition, HWP tools.

Each call works in a temporary folder of its own under ASCII names and has a time limit; the folder is gone
when the call ends, and results travel in rows. A program that is absent, fails or takes too long gives an
error text or no text, never a failed task.
"""

from __future__ import annotations

import re
import subprocess
import tempfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from docengine.sources import readers
from docengine.sources.pdf import pages as pdf_pages

#: {in}, {out}, {page} and {lang} stand for the input file, the output folder or file, a page and the languages.
OFFICE = ("soffice", "--headless", "--convert-to", "pdf", "--outdir", "{out}", "{in}")
OCR = ("tesseract", "{in}", "stdout", "-l", "{lang}")
PAGE_IMAGE = ("pdftoppm", "-r", "300", "-f", "{page}", "-l", "{page}", "-png", "{in}", "{out}/page")
HWP_TOOLS = (("hwp5html", "--html", "{in}"), ("hwp5txt", "{in}"))
LANGUAGES = "kor+eng"
# fixed values: the first bytes of image files, and the fewest characters of a page that is not scanned
MAGIC = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp"))
SCANNED = 40


def run(command: Sequence[str], data: bytes, suffix: str, seconds: float = 180, **values: object) -> tuple[bytes, dict[str, bytes]]:
    """Standard output, and the files that the program left in its output folder; ValueError where it fails."""
    with tempfile.TemporaryDirectory(prefix="tool-") as folder:
        source, out = Path(folder, f"input.{suffix}"), Path(folder, "out")
        source.write_bytes(data)
        out.mkdir()
        words = {"in": str(source), "out": str(out)} | {k: str(v) for k, v in values.items()}
        filled = [re.sub(r"\{(\w+)\}", lambda m: words.get(m[1], m[0]), word) for word in command]
        try:
            done = subprocess.run(filled, capture_output=True, timeout=seconds, cwd=folder, check=False)
        except FileNotFoundError as e:
            raise ValueError(f"{command[0]} is not installed") from e
        except subprocess.TimeoutExpired as e:
            raise ValueError(f"{command[0]} took more than {seconds:g} s") from e
        if done.returncode:
            raise ValueError(f"{command[0]} failed: {done.stderr.decode('utf-8', 'replace')[-300:].strip()}")
        return done.stdout, {p.name: p.read_bytes() for p in sorted(out.iterdir()) if p.is_file()}


def office_pdf(data: bytes, suffix: str, command: Sequence[str] = OFFICE, seconds: float = 240) -> bytes:
    found = [content for name, content in run(command, data, suffix, seconds)[1].items() if name.lower().endswith(".pdf")]
    if not found:
        raise ValueError(f"{command[0]} left no PDF")
    return found[0]


CONVERTED = "path string, file_name string, file_type string, content binary, error string"


def to_pdf(files: DataFrame, command: Sequence[str] = OFFICE, seconds: float = 240) -> DataFrame:
    """Binary files as PDF: file_name ends in .pdf, file_type is pdf; a PDF stays as it is. What could not be converted
    keeps its name and type and has an error and no content, so that it can be tried again."""

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, name, kind, data in zip(frame["path"], frame["file_name"], frame["file_type"], frame["content"], strict=True):
                try:
                    content, error = (data if kind == "pdf" else office_pdf(bytes(data), kind, command, seconds)), None
                    name, kind = re.sub(r"\.[^.]*$", "", name) + ".pdf", "pdf"
                except ValueError as e:
                    content, error = None, str(e)
                rows.append((path, name, kind, content, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONVERTED.split(", ")])

    return files.select("path", "file_name", "file_type", "content").mapInPandas(convert, CONVERTED)


def image_kind(data: bytes) -> str:
    """The type of an image by its first bytes, empty if it is none."""
    return next((kind for magic, kind in MAGIC if data.startswith(magic)), "")


def image_text(image: bytes, command: Sequence[str] = OCR, languages: str = LANGUAGES, seconds: float = 120) -> str:
    """Recognised text, empty where recognition fails."""
    try:
        return run(command, image, image_kind(image) or "png", seconds, lang=languages)[0].decode("utf-8", "replace").strip()
    except ValueError:
        return ""


def page_text(data: bytes, page: int, render: Sequence[str] = PAGE_IMAGE, command: Sequence[str] = OCR, languages: str = LANGUAGES, seconds: float = 120) -> str:
    """Recognised text of one page of a PDF, empty where it cannot be drawn or read."""
    try:
        images = run(render, data, "pdf", seconds, page=page)[1]
    except ValueError:
        return ""
    return "\n".join(filter(None, (image_text(x, command, languages, seconds) for x in images.values())))


def pdf_with_ocr(recognise: Callable[[bytes, int], str] = page_text, shortest: int = SCANNED) -> Callable[[bytes], list[tuple[int, str]]]:
    """A parser for readers.extract: pages with hardly any text and no table are recognised."""

    def parse(data: bytes) -> list[tuple[int, str]]:
        out = []
        for number, text in pdf_pages(data, ordered=True):
            scanned = len(text.strip()) < shortest and not any(line.strip().startswith("|") for line in text.splitlines())
            out.append((number, (recognise(data, number) if scanned else "") or text))
        return out

    return parse


def hwp_images(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of the images in an HWP file; packed ones are unpacked."""
    ole, out = readers.CompoundFile(data), []
    for path in sorted(p for p in ole.paths if p.startswith("BinData/")):
        raw = ole.read(path)
        if not image_kind(raw):
            try:
                raw = zlib.decompress(raw, -15)
            except zlib.error:
                continue
        if image_kind(raw):
            out.append((path, raw))
    return out


def hwp_pages(tools: Sequence[Sequence[str]] = HWP_TOOLS, recognise: Callable[[bytes], str] = image_text, seconds: float = 180) -> Callable[[bytes], list[tuple[int, str]]]:
    """A parser for readers.extract: the first program that gives text, else the file's own records; then the text of its images.

    A file that nothing can read has no pages.
    """

    def parse(data: bytes) -> list[tuple[int, str]]:
        pages: list[tuple[int, str]] = []
        for tool in tools:
            try:
                text = run(tool, data, "hwp", seconds)[0].decode("utf-8", "replace")
            except ValueError:
                continue
            if text := (readers.html_text(text) if "html" in tool[0] else text).strip():
                pages = [(1, text)]
                break
        try:
            pages = pages or [(i, t) for i, (_, t) in enumerate(readers.hwp_sections(data), 1)]
            images = [t for _, x in hwp_images(data) if (t := recognise(x))]
        except (ValueError, KeyError):  # not a compound file, or one without the parts of an HWP
            images = []
        return pages + [(len(pages) + 1, "\n\n".join(images))] * bool(images)

    return parse
