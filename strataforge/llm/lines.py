"""Lines of pages as numbers: every text is parsed once, later passes work on arrays of 64-bit tokens and flags.

A line's words are those of its masked form (numbers, dates, addresses, link targets and the site's own name left out). Its tokens are the whole
line and its outer words, each in its role: first word, first two, last word, last two. Its groups are coarser forms for messages: the whole
line with quotations, paths, file names and code names left out too, its first clause, and its first and last three words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .messages import HOLDER_START, cue, form, has_placeholder, masked

BLANK, CODE, HEADING, TABLE, TEXT = range(5)
#: Flags of a line; cues of `messages.cue` stand above them.
PROSE, QUOTED, BULLET, SHORT, TRAIL, HOLDER, CUES = 1, 2, 4, 8, 16, 32, 6
ROLES = 5  # whole line, first word, first two, last word, last two
GROUPS = 3  # whole form, first clause, outer words
WIDTH = ROLES + GROUPS

_FENCE = re.compile(r"[ >]{0,6}(`{3,}|~{3,})")
_HEADING = re.compile(r"\s{0,3}#{1,6}(\s|$)")
_LINK = re.compile(r"\]\([^)\s]*\)")
_BULLET = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_TRAIL = re.compile(r"\S\s(?:›|>|»|/|→|::|·|\|)\s\S")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?:;…][\"')\]`*_]*\s*$")
_CLAUSE = re.compile(r"[.:!?;…](?:\s|$)")
_BARE = " \t\r-*#_.!…:;"


def site_columns(url: Column) -> tuple[Column, Column]:
    """Host without `www.`, and the site's own name: the first host label that is not a service name."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return host, F.regexp_extract(F.regexp_replace(host, r"^(docs?|wiki|help|api|dev|developer|support)\.", ""), r"^([^.]+)", 1)


def site_pages(df: DataFrame, item_id: str, url: str, text: str) -> DataFrame:
    """(item_id, site, brand, text) of texts that are not blank; a page without a URL is a site of its own.

    Re-delivered rows stay: they change neither which titles a token has nor which tokens share their pages, and results are made
    distinct, which is far less to shuffle than the texts.
    """
    host, brand = site_columns(F.col(url))
    rows = df.select(F.col(item_id).alias("item_id"), F.when(F.coalesce(host, F.lit("")) != "", F.xxhash64(host)).otherwise(F.xxhash64(F.lit("?"), item_id)).alias("site"), F.coalesce(brand, F.lit("")).alias("brand"), F.col(text).cast("string").alias("text"))
    return rows.where(F.col("text").isNotNull() & (F.trim("text") != "") & F.col("item_id").isNotNull())


def line_kinds(lines: list[str]) -> list[int]:
    """CODE, BLANK, HEADING, TABLE or TEXT, by line."""
    out: list[int] = []
    fence = ""
    for x in lines:
        bare = x.strip()
        first = bare[:1]
        if fence:
            out.append(CODE)
            if first in "`~>" and bare and (m := _FENCE.match(x)) and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not bare.strip(" >`~"):
                fence = ""
        elif not bare:
            out.append(BLANK)
        elif first in "`~>" and (m := _FENCE.match(x)):
            fence = m.group(1)
            out.append(CODE)
        elif first == "#" and _HEADING.match(x):
            out.append(HEADING)
        else:
            out.append(TABLE if first == "|" else TEXT)
    return out


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


class Reader:
    """Tokens and flags of one site's lines, remembered, since frame lines recur on most pages."""

    most = 200_000

    def __init__(self, brand: str):
        self.brand = brand
        self.name = re.compile(rf"(?<!\w){re.escape(brand)}(?!\w)") if brand else None
        self.memo: dict[str, tuple[tuple[int, ...], int]] = {}

    def masked(self, line: str) -> str:
        s = line.strip().lower()
        if self.name and self.brand in s:
            s = self.name.sub("§", s)
        if "](" in s:
            s = _LINK.sub("]()", s)
        return masked(s)

    def __call__(self, line: str) -> tuple[tuple[int, ...], int]:
        known = self.memo.get(line)
        if known is None:
            known = self.read(line)
            if len(line) <= 160:  # longer ones hardly recur; the memo only saves time
                if len(self.memo) > self.most:
                    self.memo.clear()
                self.memo[line] = known
        return known

    def read(self, line: str) -> tuple[tuple[int, ...], int]:
        s = self.masked(line)
        parts = s.split()
        n = len(parts)
        outer = (_hash("1" + parts[0]), _hash("2" + parts[0] + " " + parts[1]) if n > 2 else 0, _hash("3" + parts[-1]), _hash("4" + parts[-2] + " " + parts[-1]) if n > 2 else 0) if n > 1 else (0, 0, 0, 0)
        whole = form(s)
        cut = _CLAUSE.search(whole)
        ends = whole.split()
        groups = (_hash(whole.strip(_BARE)), _hash("c" + whole[: cut.start()].strip(_BARE)) if cut and cut.start() > 3 else 0, _hash("e" + " ".join((ends[0], *ends[-3:]))) if len(ends) > 4 else 0)
        words = len(_WORD.findall(_LINK.sub("]", line) if "](" in line else line))
        end = _END.match(line, len(line.rstrip(" \t\r\n\"')]`*_")) - 1) is not None
        trail = not end and _TRAIL.search(line) is not None
        prose = (words >= 9 or (words >= 4 and end)) and not trail
        flags = PROSE * prose | QUOTED * line.lstrip().startswith(">") | BULLET * (_BULLET.match(line) is not None) | SHORT * (words <= 4) | TRAIL * trail | cue(whole) << CUES
        return (_hash(s), *outer, *groups), flags


_READERS: dict[str, Reader] = {}


def reader(brand: str) -> Reader:
    """A reader for each site name; a worker keeps those of a few thousand."""
    if brand not in _READERS:
        if len(_READERS) >= 2_000 or sum(len(r.memo) for r in _READERS.values()) > 1_000_000:
            _READERS.clear()
        _READERS[brand] = Reader(brand)
    return _READERS[brand]


def _parse(pdf: pd.DataFrame) -> pd.DataFrame:
    titles, kinds_out, flags_out, tokens_out = [], [], [], []
    for brand, text in zip(pdf["brand"], pdf["text"], strict=True):
        lines = text.split("\n")
        kinds = line_kinds(lines)
        heading = next((x.lower() for x, k in zip(lines, kinds, strict=True) if k == HEADING), text)
        titles.append(_hash(heading))
        read = reader(brand)
        flags, tokens = np.zeros(len(lines), np.uint16), []
        for i, k in enumerate(kinds):
            if k == TEXT:
                t, flags[i] = read(lines[i])
                tokens.append(t)
        if HOLDER_START.search(text):
            for i, k in enumerate(kinds):
                if k != CODE and k != BLANK and has_placeholder(lines[i]):
                    flags[i] |= HOLDER
        kinds_out.append(bytes(kinds))
        flags_out.append(flags.tobytes())
        tokens_out.append(np.array(tokens, np.int64).tobytes())
    return pd.DataFrame({"item_id": pdf["item_id"], "site": pdf["site"], "title": titles, "kinds": kinds_out, "flags": flags_out, "tokens": tokens_out})


def parsed(pages: DataFrame) -> DataFrame:
    """(item_id, site, title, kinds, flags, tokens) of (item_id, site, brand, text), kept: a byte and two for each line, WIDTH hashes for each text line."""
    kind = dict(pages.dtypes)["item_id"]
    rows = pages.mapInPandas(lambda it: (_parse(x) for x in _small(it)), f"item_id {kind}, site bigint, title bigint, kinds binary, flags binary, tokens binary")
    return cut_lineage(rows)


def _small(it: Iterator[pd.DataFrame], most: int = 4_096) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for lo in range(0, len(pdf), most):
            yield pdf.iloc[lo : lo + most]


class Batch:
    """The lines of a batch of parsed pages laid end to end; `at` are the text lines, each with its row of `tokens` and `groups`."""

    def __init__(self, pdf: pd.DataFrame):
        self.pages = len(pdf)
        self.site, self.title = pdf["site"].to_numpy(np.int64), pdf["title"].to_numpy(np.int64)
        self.lengths = np.array([len(x) for x in pdf["kinds"]], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if self.pages else np.zeros(0, np.int64)
        self.kinds = np.frombuffer(b"".join(pdf["kinds"]), np.uint8)
        self.flags = np.frombuffer(b"".join(pdf["flags"]), np.uint16)
        self.page = np.repeat(np.arange(self.pages), self.lengths)
        self.at = np.flatnonzero(self.kinds == TEXT)
        both = np.frombuffer(b"".join(pdf["tokens"]), np.int64).reshape(-1, WIDTH)
        self.tokens, self.groups = both[:, :ROLES], both[:, ROLES:]

    def first(self, of: np.ndarray) -> np.ndarray:
        """The first line of each page among `of` (line numbers of the batch, ascending), else the page's end."""
        out = self.begin + self.lengths
        page, where = np.unique(self.page[of], return_index=True)
        out[page] = of[where]
        return out

    def last(self, of: np.ndarray) -> np.ndarray:
        """The last such line, else the one before the page's start."""
        out = self.begin - 1
        page, where = np.unique(self.page[of[::-1]], return_index=True)
        out[page] = of[::-1][where]
        return out
