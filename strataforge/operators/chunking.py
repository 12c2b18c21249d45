"""Splitters over DataFrames: one row a chunk, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import splitting
from ..functions.splitting import Chunk

FIELDS = "position int, types array<string>, level int, path array<string>, content string"


def chunked(df: DataFrame, item_id: str, columns: list[str], split: Callable[..., list[Chunk]]) -> DataFrame:
    """item_id, position, types, level, path, content: split(*columns) of each row; a null first column gives no chunk."""
    kind = dict(df.dtypes)[item_id]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for values in pdf.itertuples(index=False):
                rows.extend((values[0], i, list(c.types), c.level, list(c.path), c.content) for i, c in enumerate(split(*values[1:])))
            yield pd.DataFrame(rows, columns=[item_id, "position", "types", "level", "path", "content"])

    return df.where(F.col(columns[0]).isNotNull()).select(item_id, *columns).mapInPandas(run, f"{item_id} {kind}, {FIELDS}")


def markdown_chunks(df: DataFrame, item_id: str, text: str, least: int = splitting.MIN_SIZE, preferred: int = splitting.PREFERRED_SIZE, limit: int = splitting.MAX_SIZE, merge: bool = True) -> DataFrame:
    """Markdown by structure, then small neighbours merged."""
    return chunked(df, item_id, [text], lambda t: splitting.merge_chunks(splitting.split_markdown(t, preferred, limit), least, preferred, limit) if merge else splitting.split_markdown(t, preferred, limit))


def json_chunks(df: DataFrame, item_id: str, text: str) -> DataFrame:
    return chunked(df, item_id, [text], splitting.split_json)


def source_chunks(df: DataFrame, item_id: str, text: str, language: str) -> DataFrame:
    return chunked(df, item_id, [text, language], splitting.split_source)


FENCED = r"(?ms)^(```+|~~~+)[ \t]*([A-Za-z]+)[^\n]*\n(.*?)^\1[ \t]*$"


def fenced_code(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, pos, language, code: the fenced blocks of a text that name a language, by built-in expressions."""
    t = F.col(text)
    rows = df.where(t.contains("```") | t.contains("~~~")).select(item_id, F.regexp_extract_all(t, F.lit(FENCED), F.lit(2)).alias("l"), F.regexp_extract_all(t, F.lit(FENCED), F.lit(3)).alias("c"))
    return rows.select(item_id, F.posexplode(F.arrays_zip("l", "c")).alias("pos", "x")).select(item_id, "pos", F.lower("x.l").alias("language"), F.col("x.c").alias("code"))


def fence_balance(text: Column) -> Column:
    """Whether the number of triple backticks is even."""
    return F.regexp_count(text, F.lit("[`]{3}")) % 2 == 0
