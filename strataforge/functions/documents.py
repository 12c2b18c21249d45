"""Text of office documents and notebooks, from their archives' XML and JSON."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree as ET

from . import html

#: Fixed value: larger files are not read.
MOST_BYTES = 10 * 1024 * 1024


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def _run_text(e: ET.Element) -> str:
    return "".join((x.text or "") if _name(x) == "t" else "\t" if _name(x) == "tab" else "\n" if _name(x) == "br" else "" for x in e.iter())


def _rows(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def docx(z: zipfile.ZipFile) -> str:
    body = ET.fromstring(z.read("word/document.xml")).find(".//{*}body")
    out = []
    for e in body if body is not None else []:
        if _name(e) == "p" and (t := _run_text(e).strip()):
            style = next((_attr(x, "val") for x in e.iter() if _name(x) == "pStyle"), "")
            m = re.fullmatch(r"(?:Heading|berschrift|Titre)(\d)", style.replace(" ", "")) or (re.fullmatch("(T)itle", style))
            listed = any(_name(x) == "numPr" for x in e.iter())
            out.append(f"{'#' * (int(m[1]) if m[1].isdigit() else 1)} {t}" if m else f"- {t}" if listed else t)
        elif _name(e) == "tbl":
            rows = [[" ".join(_run_text(c).split()) for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]
            out += [_rows(rows)] if rows else []
    return "\n\n".join(out)


def xlsx(z: zipfile.ZipFile) -> str:
    shared = [_run_text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [_attr(s, "name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _name(s) == "sheet"]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out = []
    for name, f in zip(names, files, strict=False):
        rows = []
        for r in (e for e in ET.fromstring(z.read(f)).iter() if _name(e) == "row"):
            cells: dict[int, str] = {}
            for c in r:
                column = 0
                for ch in re.match(r"[A-Z]*", _attr(c, "r"))[0]:
                    column = column * 26 + ord(ch) - 64
                v = next((x.text or "" for x in c.iter() if _name(x) == "v"), "")
                cells[column or len(cells) + 1] = shared[int(v)] if _attr(c, "t") == "s" and v else _run_text(c) if _attr(c, "t") == "inlineStr" else v
            if any(cells.values()):
                rows.append([cells.get(i, "") for i in range(1, max(cells) + 1)])
        if rows:
            out.append(f"# {name}\n\n{_rows(rows)}")
    return "\n\n".join(out)


def pptx(z: zipfile.ZipFile) -> str:
    files = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    slides = [[t for p in ET.fromstring(z.read(f)).iter() if _name(p) == "p" and (t := _run_text(p).strip())] for f in files]
    return "\n\n".join(f"## Slide {i}\n\n" + "\n\n".join(s) for i, s in enumerate(slides, 1) if s)


def epub(z: zipfile.ZipFile) -> str:
    pages = [html.convert(z.read(n).decode("utf-8", "replace"), "")[1] for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm"))]
    return "\n\n".join(p for p in pages if p)


def open_document(z: zipfile.ZipFile) -> str:
    out = []
    for e in ET.fromstring(z.read("content.xml")).iter():
        if _name(e) in ("h", "p") and (t := "".join(e.itertext()).strip()):
            out.append(f"{'#' * int(_attr(e, 'outline-level') or 1)} {t}" if _name(e) == "h" else t)
    return "\n\n".join(out)


def notebook(content: bytes) -> str:
    nb = json.loads(content)
    language = nb.get("metadata", {}).get("language_info", {}).get("name", "python")
    out = []
    for cell in nb.get("cells", []):
        text = "".join(cell.get("source", []))
        if text.strip():
            out.append(f"```{language}\n{text}\n```" if cell.get("cell_type") == "code" else text)
    return "\n\n".join(out)


READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "epub": epub, "odt": open_document, "odp": open_document, "ods": open_document}


def to_markdown(name: str, content: bytes) -> str | None:
    """Markdown of a document by its file extension; None for kinds that are not read, files over 10 MB, and broken ones."""
    kind = name.lower().rsplit(".", 1)[-1]
    if len(content) > MOST_BYTES:
        return None
    try:
        if kind == "ipynb":
            return notebook(content)
        if kind in READERS:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return READERS[kind](z)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError):
        return None
    return None
