"""DOCX files as document elements, read as what they are: a zip archive of XML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TITLE_CHARS = 200


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    """Names of paragraph styles by their id."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    out = {}
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{W}style"):
        name = style.find(f"{W}name")
        if name is not None:
            out[style.get(f"{W}styleId", "")] = name.get(f"{W}val", "")
    return out


def _said(paragraph: ElementTree.Element) -> str:
    """A paragraph's text; tabs and breaks are kept, deleted text isn't there."""
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    parts = []
    for run in paragraph.iter(f"{W}r"):
        for node in run:
            parts.append(node.text or "" if node.tag == f"{W}t" else marks.get(node.tag, ""))
    return "".join(parts).strip()


def parse_docx(name: str, raw: bytes) -> Iterator[tuple[int, str, str, str, str]]:
    """(page, section, subsection, content, type) of each paragraph of the body that holds text; a first-level heading begins a section, a second-level one a subsection."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = _styles(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    section = subsection = ""
    for paragraph in body.findall(f"{W}p") if body is not None else ():
        text = _said(paragraph)
        if not text:
            continue
        style = paragraph.find(f"{W}pPr/{W}pStyle")
        key = style.get(f"{W}val", "") if style is not None else ""
        title = names.get(key, key).title()
        if "Heading 1" in title:
            section, subsection = text[:TITLE_CHARS], ""
        elif "Heading 2" in title:
            subsection = text[:TITLE_CHARS]
        yield 1, section, subsection, text, "heading" if "Heading" in title else "text"
