"""Word documents from `binaryFile` rows: paragraphs as blocks, by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.sources.html import BLOCKS

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes | None, strict: bool = False) -> list[dict]:
    """Empty for what is no Word document, or a ValueError if `strict`."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        if strict:
            raise ValueError("It is no Word document.") from e
        return []
    out = []
    for p in body.iter(f"{_W}p"):
        line = re.sub(r"\s+", " ", "".join(t.text or "" for t in p.iter(f"{_W}t"))).strip()
        if not line:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.search(r"[Hh]eading\s*([1-6])", style.get(f"{_W}val", "")) if style is not None else None
        item = p.find(f"{_W}pPr/{_W}numPr") is not None
        out.append({"type": "heading" if level else "list_item" if item else "paragraph", "level": int(level[1]) if level else None, "list_type": "bulleted" if item and not level else None, "text": line})
    return out


def blocks(content: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def run(files: pd.Series) -> pd.Series:
        return files.map(docx_blocks)

    return run(content)
