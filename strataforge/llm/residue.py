"""Template residue, filler, error and script messages in place of content.

Lines and titles are masked (numbers, addresses, dates, the site's own name, quotations, paths, code names), and exact hashes of their forms are grouped across
sources. Widely recurring forms are classified: a page's by cues and by the share of their pages that hold nothing else (`boilerplate.message_forms`), a title's by
cues and by the words messages consist of. Placeholders are told by their form and count wherever they stand outside code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boilerplate, lines
from .boilerplate import FrameParams, Page
from .lines import HOLDER, TEXT
from .messages import has_placeholder, is_message_title, is_missing_value, title_forms


def page_residue(page: Page) -> str | None:
    """'placeholder', 'message' or None."""
    if (page.flags & HOLDER).any():
        return "placeholder"
    return "message" if any(m and not f for m, f, k in zip(page.message, page.frame, page.kinds, strict=True) if k == TEXT) else None


def residue_pages(df: DataFrame, item_id: str, url: str, text: str, frame: FrameParams = FrameParams()) -> DataFrame:
    """(item_id, reason) of pages with an unfilled placeholder outside code, or a message in place of content outside the page frame.

    Null, empty and blank texts give no row; a null URL puts a page on a site of its own; re-delivered ids count once;
    other columns are ignored.
    """

    def out(pdf: pd.DataFrame, pages: list[Page]) -> pd.DataFrame:
        rows = [(i, r) for i, p in zip(pdf["item_id"], pages, strict=True) if (r := page_residue(p))]
        return pd.DataFrame(rows, columns=["item_id", "reason"])

    return boilerplate.read_all(df, item_id, url, text, out, f"item_id {dict(df.dtypes)[item_id]}, reason string", frame).dropDuplicates(["item_id"])


def residue_titles(df: DataFrame, item_id: str, title: str, url: str | None = None, least_sites: int = FrameParams.least_sites) -> DataFrame:
    """(item_id) of titles that are residue; null and blank titles are not, re-delivered ids count once.

    A title with an unfilled placeholder, or that is a printed missing value, is residue by itself. One whose form, whole or without a site's name at its end, consists of the
    words of messages is residue if the form stands on `least_sites` sources (hosts of `url`) and more. Rows without an address are on no source.
    """
    kind = dict(df.dtypes)[item_id]
    host, brand = lines.site_columns(F.col(url)) if url else (F.lit(None).cast("string"), F.lit(None).cast("string"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple[str, str], tuple[bool, list[int]]] = {}
        for pdf in it:
            if len(memo) > 200_000:
                memo.clear()
            out = []
            for i, t, h, b in zip(pdf["item_id"], pdf["title"], pdf["host"], pdf["brand"], strict=True):
                key = (t, b or "")
                if key not in memo:
                    memo[key] = has_placeholder(t) or is_missing_value(t), [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in title_forms(*key) if is_message_title(x)]
                bad, forms = memo[key]
                if bad:
                    out.append((i, True, None, None))
                else:
                    out.extend((i, False, x, h or None) for x in forms)
            yield pd.DataFrame(out, columns=["item_id", "bad", "form", "host"]).astype({"form": "Int64"})

    rows = df.select(F.col(item_id).alias("item_id"), F.col(title).cast("string").alias("title"), host.alias("host"), brand.alias("brand")).where(F.col("title").isNotNull())
    rows = boilerplate.cut_lineage(rows.mapInPandas(run, f"item_id {kind}, bad boolean, form bigint, host string"))
    wide = rows.where("not bad and host is not null").select("form", "host").distinct().groupBy("form").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= least_sites)
    return rows.where("bad").select("item_id").unionByName(rows.where("not bad").join(wide, "form", "left_semi").select("item_id")).dropDuplicates(["item_id"])
