"""Content transforms over DataFrames: HTML to Markdown, titles, links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H


def html_to_markdown(df: DataFrame, html: str, url: str) -> DataFrame:
    """`df` with title, markdown, links, errors, which replace columns of these names; a null page gives 'Untitled' and an empty text."""
    added = ("title", "markdown", "links", "errors")
    df = df.select(*[c for c in df.columns if c not in added or c in (html, url)])
    rest = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            done = [H.convert(h, u or "") for h, u in zip(pdf[html], pdf[url], strict=True)]
            for i, c in enumerate(added):
                pdf[c] = [x[i] for x in done]
            yield pdf

    return df.mapInPandas(run, f"{rest}, title string, markdown string, links array<string>, errors array<string>")


def markdown_title(text: Column) -> Column:
    """`title` of the front matter, else the first top heading, else 'Untitled'."""
    front = F.regexp_extract(text, r"\A---[ \t]*\n(?:[^\n]*\n)*?title:[ \t]*[\"']?([^\"'\n]+)", 1)
    first = F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1))
    return F.when(front != "", F.trim(front)).when(first != "", first).otherwise("Untitled")


LINK = r"(?:^|[^!\\])\[[^\]]*\]\(([^)\s]+)[^)]*\)"


def markdown_links(text: Column) -> Column:
    """Targets of inline links in order, each once; images and escaped brackets are none."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)))


def json_title(text: Column) -> Column:
    """`title`, `name`, `displayName` or `label` of a JSON document; null where it has none or is invalid."""
    v = F.try_parse_json(text)
    named = [F.try_variant_get(v, f"$.{k}", "string") for k in ("title", "name", "displayName", "label")]
    return F.coalesce(*named)


