"""Files of word processors and page layout, and timed calls."""

import asyncio
import zipfile

import pytest

from vellum.sources import office, readers
from vellum.timing import timed

BODY = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    "<w:p><w:r><w:t> First </w:t></w:r><w:r><w:tab/><w:t>half</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>  </w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    "<w:p><w:r><w:t>Second é</w:t></w:r></w:p></w:body></w:document>"
)


def bad():
    raise ValueError("bad page")


def test_docx_and_pdf_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", BODY)
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("other.xml", "<x/>")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    for name in ("f.docx", "g 1.txt", "h%.csv", "_i.txt"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "d.pdf").write_bytes(b"no pdf")
    (tmp_path / "e.json").write_text("[1]")
    rows = readers.documents(spark, str(tmp_path)).collect()
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in rows}
    assert len(rows) == len(got) == 8
    assert got["a.docx"] == "First \thalf\nSecond é"
    assert all(got[f].startswith("ERROR: ") for f in ("b.docx", "c.docx", "d.pdf", "f.docx"))
    assert got["g 1.txt"] == got["h%.csv"] == ""
    assert {r["path"].rsplit("/", 1)[1] for r in rows if r["size"] == 0} == {"f.docx", "g 1.txt", "h%.csv"}
    assert readers.documents(spark, str(tmp_path), "*.txt").count() == 1
    assert got["e.json"] == "[\n  1\n]"
    assert readers.documents(spark, str(tmp_path), "*.none").count() == 0


def test_pdf_pages_are_named():
    pages = lambda _: [lambda: " one ", bad, lambda: "  ", lambda: "four"]
    assert office.pdf_text(b"", pages) == "=== Page 1 ===\none\n\n=== Page 4 ===\nfour\n"
    assert office.pdf_upload(b"", lambda _: [lambda: " one ", lambda: "two"]) == "one \ntwo"
    with pytest.raises(ValueError):
        office.pdf_upload(b"", pages)


def test_timed_calls():
    told = []
    report = lambda name, seconds: told.append((name, seconds >= 0))

    def plain(x):
        return x + 1

    async def later(x):
        return x + 2

    assert timed(plain, report)(1) == 2 and timed(plain).__name__ == "plain"
    assert asyncio.run(timed(later, report)(1)) == 3
    with pytest.raises(ValueError):
        timed(bad, report)()
    assert told == [("plain", True), ("later", True), ("bad", True)]
