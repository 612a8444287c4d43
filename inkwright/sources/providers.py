"""Where pixels and models plug in: page readers, region readers, layout detectors and PDF readers.

A provider is an object with a name and read_page(content, page) -> text | None, read_region(content, page, box, kind) -> text | None
or detect(image, scale) -> [(kind, x0, y0, x1, y1, score)]. It is made once in each Python worker from a
function that is shipped to it, and called row by row within an Arrow map; the rest of a plan never sees it.
"""

from __future__ import annotations

import base64
import importlib.util
import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PageReader(Protocol):
    name: str

    def read_page(self, content: bytes, page: int) -> str | None: ...

    def read_region(self, content: bytes, page: int, box: tuple[float, float, float, float], kind: str) -> str | None: ...


class LayoutDetector(Protocol):
    name: str

    def detect(self, image, scale: float) -> list[tuple[str, float, float, float, float, float]]: ...


class ChatEndpoint:
    """An endpoint that speaks the chat completions protocol; one question a page, the page's file as data."""

    def __init__(self, url: str, model: str, timeout: float = 240.0, prompt: str = "Transcribe this page as markdown."):
        self.name, self.url, self.timeout, self.prompt = model, url.rstrip("/"), timeout, prompt

    def ask(self, content: bytes, text: str) -> str | None:
        data = "data:application/pdf;base64," + base64.b64encode(content).decode()
        body = {"model": self.name, "temperature": 0, "messages": [{"role": "user", "content": [{"type": "text", "text": text}, {"type": "image_url", "image_url": {"url": data}}]}]}
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"] or None

    def read_page(self, content: bytes, page: int) -> str | None:
        return self.ask(content, f"{self.prompt} Page {page}.")

    def read_region(self, content: bytes, page: int, box, kind: str) -> str | None:
        return self.ask(content, f"Describe the {kind} at {box} of page {page}.")


def parse_address(address: str, model: str) -> dict:
    """kind, target, model and bands of a reader's address: http(s)://..., file:folder or a name, with /bands=n behind it."""
    bands = 1
    if "/bands=" in address:
        address, _, n = address.rpartition("/bands=")
        if not n.isdigit() or not int(n):
            raise ValueError(f"not a number of bands: {n!r}")
        bands = int(n)
    kind = "http" if address.startswith(("http://", "https://")) else "saved" if address.startswith("file:") else "named"
    if not address:
        raise ValueError("a reader needs an address")
    return {"kind": kind, "target": address.removeprefix("file:"), "model": model, "bands": bands}


def read_pages(pages: DataFrame, make: Callable[[], PageReader]) -> DataFrame:
    """pages (file, page, content) as file, page, reader, text, error: one provider a worker, and an error is a row, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    reader = reader or make()
                    rows.append((r.file, r.page, reader.name, reader.read_page(bytes(r.content), r.page), None))
                except Exception as bad:  # any reader's failure is that page's issue
                    rows.append((r.file, r.page, getattr(reader, "name", None), None, f"{type(bad).__name__}: {bad}"))
            yield pd.DataFrame(rows, columns=["file", "page", "reader", "text", "error"])

    return pages.select("file", "page", "content").mapInPandas(run, "file string, page long, reader string, text string, error string")


def read_regions(regions: DataFrame, make: Callable[[], PageReader], most: int = 12) -> DataFrame:
    """regions (file, page, region, kind, score, box, content), the surest `most` of each page, as file, page, region, text, error. The budget is a feature."""
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("file", "page").orderBy(F.desc("score"), "region"))
    asked = regions.withColumn("_n", first).filter(F.col("_n") <= most)

    def run(batches):
        reader = None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    reader = reader or make()
                    rows.append((r.file, r.page, r.region, reader.read_region(bytes(r.content), r.page, (r.x0, r.y0, r.x1, r.y1), r.kind), None))
                except Exception as bad:
                    rows.append((r.file, r.page, r.region, None, f"{type(bad).__name__}: {bad}"))
            yield pd.DataFrame(rows, columns=["file", "page", "region", "text", "error"])

    return asked.select("file", "page", "region", "kind", "content", "x0", "y0", "x1", "y1").mapInPandas(run, "file string, page long, region long, text string, error string")


def detect_layout(images: DataFrame, make: Callable[[], LayoutDetector], scale: float = 1.0) -> DataFrame:
    """images (file, page, image) as regions: file, page, kind, box, score, source."""

    def run(batches):
        detector = None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                detector = detector or make()
                rows += [(r.file, r.page, *found, detector.name) for found in detector.detect(bytes(r.image), scale)]
            yield pd.DataFrame(rows, columns=["file", "page", "kind", "x0", "y0", "x1", "y1", "score", "source"])

    return images.mapInPandas(run, "file string, page long, kind string, x0 double, y0 double, x1 double, y1 double, score double, source string")


def pdf_available() -> bool:
    return importlib.util.find_spec("pypdfium2") is not None


CHARS = "file string, page long, at long, ch string, font string, size double, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, error string"


def pdf_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The characters of a folder's PDF files, a file a task; a row with an error where a file, or the reader itself, is missing.

    The reader is an optional library; without it every file is one row that says so.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    import pypdfium2 as pdfium

                    for n, page in enumerate(pdfium.PdfDocument(bytes(content)), 1):
                        wide, high = page.get_size()
                        text = page.get_textpage()
                        for i in range(text.count_chars()):
                            x0, y0, x1, y1 = text.get_charbox(i)
                            rows.append((path, n, i, text.get_text_range(i, 1), None, y1 - y0, x0, high - y1, x1, high - y0, wide, high, None))
                except ImportError:
                    rows = [(path, *[None] * 11, "stage-unavailable: no PDF reader is installed")]
                except Exception as bad:
                    rows = [(path, *[None] * 11, f"{type(bad).__name__}: {bad}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHARS.split(", ")]).astype({"page": "Int64", "at": "Int64"})

    return files.mapInPandas(run, CHARS)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256, length, modified of a folder's PDF files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), "length", F.col("modificationTime").alias("modified"))
