"""Pages, feeds and PDF files. Fetching is a function the caller passes in: nothing here
touches the network by itself, and tests run on stored answers."""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import segments as S

page_to_text = S.html_to_text  # any page, well-formed or not, in the JVM


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 5000))
    return F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<document"))


def retried(fetch: Callable[[str], str], url: str, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> str | None:
    """fetch(url), tried again after 2, 4, ... seconds; None when all attempts fail."""
    for k in range(attempts):
        try:
            return fetch(url)
        except OSError:
            if k + 1 < attempts:
                wait(2.0 * (k + 1))
    return None


def feed_entries(page: str) -> list[dict]:
    """Entries of an Atom page: title, link, date, summary."""
    ns = {"a": "http://www.w3.org/2005/Atom"}
    out = []
    for e in ET.fromstring(page).findall("a:entry", ns):
        link = e.find("a:link", ns)
        text = lambda tag: (e.findtext(f"a:{tag}", default="", namespaces=ns) or "").strip()  # noqa: E731, B023
        out.append({"title": text("title"), "link": link.get("href", "") if link is not None else "", "date": text("updated")[:10], "summary": text("summary")})
    return out


def feed(spark, fetch: Callable[[str], str], address: Callable[[int], str], pages: int, count: int) -> DataFrame:
    """Entries of `pages` feed pages of `count` entries; a page that cannot be had is skipped.
    Every page is fetched by a task of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                got = retried(fetch, address(int(k) * count))
                rows = feed_entries(got) if got else []
                if rows:
                    yield pd.DataFrame(rows)

    return spark.range(pages).repartition(max(1, pages)).mapInPandas(run, "title string, link string, date string, summary string").dropDuplicates(["link"])


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page, start, text) of `files(path, content)`; needs a PDF library at run time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the pypdf package") from e
        import io

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                at = 0
                for k, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    text = page.extract_text() or ""
                    rows.append((path, k, at, text))
                    at += len(text) + 1
            yield pd.DataFrame(rows, columns=["path", "page", "start", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, start long, text string")
