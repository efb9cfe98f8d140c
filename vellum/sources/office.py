"""Texts of word-processor and page-layout files, from their bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the name space of the elements of a DOCX body.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The stripped paragraphs of the body that aren't blank, a line each. Text of tables is not among them."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        root = ElementTree.fromstring(parts.read("word/document.xml"))
    signs = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    paragraphs = ("".join(x.text or "" if x.tag == f"{W}t" else signs.get(x.tag, "") for x in p.iter()).strip() for p in root.findall(f"{W}body/{W}p"))
    return "\n".join(p for p in paragraphs if p)


def pdf_pages(content: bytes) -> Iterable[Callable[[], str]]:
    """For each page a function that gives its text. Needs the optional package pypdf."""
    try:
        import pypdf
    except ImportError:
        raise ValueError("no reader for pdf") from None
    return [page.extract_text for page in pypdf.PdfReader(io.BytesIO(content)).pages]


def pdf_text(content: bytes, pages: Callable = pdf_pages) -> str:
    """Each page's text under `=== Page n ===`, with a blank line after it; blank and unreadable pages are left out."""
    out = []
    for n, page in enumerate(pages(content), 1):
        try:
            text = page().strip()
        except Exception:  # noqa: BLE001  one bad page doesn't spoil the others
            continue
        out += [f"=== Page {n} ===", text, ""] if text else []
    return "\n".join(out)


def pdf_upload(content: bytes, pages: Callable = pdf_pages) -> str:
    """All page texts, a line end after each, stripped. An unreadable page is an error."""
    return "".join(f"{page()}\n" for page in pages(content)).strip()


def reader(extract: Callable[[bytes], str]):
    """A Pandas UDF bytes -> text; what `extract` can't read is an ERROR text, null stays null."""

    @F.pandas_udf(StringType())
    def read(contents: pd.Series) -> pd.Series:
        def one(content):
            if content is None:
                return None
            try:
                return extract(content)
            except Exception as e:  # noqa: BLE001  the contract: a text that says what failed
                return f"ERROR: {e}"

        return contents.map(one)

    return read
