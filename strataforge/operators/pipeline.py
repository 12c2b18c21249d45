"""Content pipelines: each page by its media type to title, text, links and chunks, errors collected."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, splitting, urls
from ..functions.splitting import Chunk

LANGUAGES = {"text/x-python": "python", "text/javascript": "javascript", "text/x-typescript": "typescript", "text/x-jsx": "jsx", "text/x-tsx": "tsx"}
_INLINE = re.compile(r"(?:^|[^!\\])\[[^\]]*\]\(([^)\s]+)[^)]*\)", re.M)
_REFERENCE = re.compile(r"^ {0,3}\[[^\]]+\]:\s+(\S+)", re.M)


def markdown_title(text: str) -> str:
    front = re.match(r"---\s*\n(?:.*\n)*?title:[ \t]*[\"']?([^\"'\n]+)", text)
    head = re.search(r"^#[ \t]+(.+)$", text, re.M)
    return (front and front[1].strip()) or (head and head[1].strip()) or "Untitled"


def process(kind: str, mime: str, url: str, text: str) -> tuple[str, str, list[str], list[Chunk], list[str]]:
    """(title, text, links, chunks, errors) of one page; a failing step leaves its error and the text as it was."""
    try:
        if kind == "json":
            value = json.loads(text) if text.strip() else None
            title = next((str(value[k]) for k in ("title", "name", "displayName", "label") if isinstance(value, dict) and isinstance(value.get(k), str)), "Untitled")
            return title, text, [], splitting.merge_chunks(splitting.split_json(text)), []
        if kind == "code":
            return url.rsplit("/", 1)[-1] or "Untitled", text, [], splitting.split_source(text, LANGUAGES.get(mime, "")), []
        if kind == "html":
            title, text, links, errors = html.convert(text, url)
            return title, text, links, splitting.merge_chunks(splitting.split_markdown(text)), errors
        if kind == "markdown":
            links = list(dict.fromkeys([*_INLINE.findall(text), *_REFERENCE.findall(text)]))
            return markdown_title(text), text, links, splitting.merge_chunks(splitting.split_markdown(text)), []
        parts = splitting.split_text(text) if text.strip() else []
        return "Untitled", text, [], [Chunk(("text",), p) for p in parts], []
    except (ValueError, RecursionError) as e:
        return "Untitled", text, [], [Chunk(("text",), p) for p in splitting.split_text(text)], [f"{type(e).__name__}: {e}"]


def processed(df: DataFrame, item_id: str, url: str, mime: str, text: str) -> DataFrame:
    """item_id, title, text, links, chunks (array of types, level, path, content), errors. Null texts and media types no pipeline takes give no row."""
    kind = dict(df.dtypes)[item_id]
    m = F.lower(F.trim(F.regexp_extract(F.col(mime), r"^([^;]*)", 1)))
    rows = df.select(F.col(item_id).alias("item_id"), F.coalesce(url, F.lit("")).alias("url"), m.alias("mime"), urls.pipeline(m).alias("kind"), F.col(text).alias("text")).where("text is not null and kind in ('json', 'code', 'html', 'markdown', 'text')")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                title, body, links, chunks, errors = process(r.kind, r.mime, r.url, r.text)
                out.append((r.item_id, title, body, links, [{"types": list(c.types), "level": c.level, "path": list(c.path), "content": c.content} for c in chunks], errors))
            yield pd.DataFrame(out, columns=["item_id", "title", "text", "links", "chunks", "errors"])

    return rows.mapInPandas(run, f"item_id {kind}, title string, text string, links array<string>, chunks array<struct<types:array<string>,level:int,path:array<string>,content:string>>, errors array<string>")
