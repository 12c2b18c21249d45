"""Content-defined splitting of oversized texts at natural boundaries.

A gear rolling hash over the UTF-16 code units marks landmarks that depend only on the last 64 units. A cut is taken at
the first landmark past the minimum size, snapped to the strongest natural boundary nearby (blank line, line end,
sentence end, white space). Since both depend on nearby content only, an edit changes the pieces around it and the cuts
then fall into step again. Sizes are UTF-16 code units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_WHITE = np.zeros(65536, bool)
_WHITE[WHITE_SPACE] = True
_LINE_END = np.zeros(65536, bool)
_LINE_END[[10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = True
_STOP = np.zeros(65536, bool)
_STOP[[ord(c) for c in ".!?…。！？"]] = True
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 63, 65536, dtype=np.uint64)

NONE, SPACE, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class PieceParams:
    """Code units. A piece, its overlap included, is at most `max_units`; landmarks come about every 2**landmark_bits."""

    max_units: int = 5000
    min_units: int = 1500
    overlap: int = 200
    landmark_bits: int = 10
    snap: int = 300


def units_of(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def boundaries(u: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each unit (index 0..len); 0 where none."""
    n = len(u)
    white, ends = _WHITE[u], _LINE_END[u]
    rank = np.zeros(n + 1, np.int8)
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:], after[:-1] = white, white
    rank[before | after] = SPACE
    stop = np.zeros(n + 1, bool)
    stop[2:] = _STOP[u[:-1]] & white[1:]
    rank[stop] = SENTENCE
    line = np.zeros(n + 1, bool)
    line[1:] = ends
    line[1:-1] &= ~((u[:-1] == 13) & (u[1:] == 10))  # not between CR and LF
    rank[line] = LINE
    # A paragraph starts at the first non-white unit after white space with two line ends, CRLF counting once.
    single = ends.copy()
    single[:-1] &= ~((u[:-1] == 13) & (u[1:] == 10)) if n > 1 else True
    count = np.concatenate([[0], np.cumsum(single)])
    last_text = np.maximum.accumulate(np.where(~white, np.arange(1, n + 1), 0)) if n else np.zeros(0, np.int64)
    starts = np.nonzero(~white[1:] & white[:-1])[0] + 1 if n > 1 else np.zeros(0, np.int64)
    blank = starts[count[starts] - count[last_text[starts - 1]] >= 2]
    rank[blank] = PARAGRAPH
    rank[0] = rank[n] = PARAGRAPH
    return rank


def landmarks(u: np.ndarray, bits: int) -> np.ndarray:
    """Positions where the gear hash of the preceding 64 units has its top `bits` clear."""
    h = _GEAR[u]
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8, 16, 32):
            shifted = np.zeros_like(h)
            shifted[step:] = h[:-step]
            h = h + (shifted << np.uint64(step))
    return np.nonzero((h >> np.uint64(64 - bits)) == 0)[0] + 1


def cut_points(u: np.ndarray, p: PieceParams) -> list[tuple[int, int, bool]]:
    """(overlap start, end, forced) of each piece; a piece's own text starts where the one before it ended."""
    n = len(u)
    if n <= p.max_units:
        return [(0, n, False)]
    rank, marks = boundaries(u), landmarks(u, p.landmark_bits)
    out: list[tuple[int, int, bool]] = []
    pos = 0
    while pos < n:
        lead = min(p.overlap, pos)
        if n - pos + lead <= p.max_units:
            end, forced = n, False
        else:
            end, forced = _next_cut(u, rank, marks, pos, p)
        reach = max(0, min(lead, p.max_units - (end - pos)))
        out.append((_overlap_start(u, rank, pos, reach), end, forced))
        pos = end
    return out


def _next_cut(u: np.ndarray, rank: np.ndarray, marks: np.ndarray, pos: int, p: PieceParams) -> tuple[int, bool]:
    body = p.max_units - min(p.overlap, pos)
    low, high = pos + p.min_units, min(pos + body, len(u))
    i = int(np.searchsorted(marks, low))
    while i < len(marks) and marks[i] <= high:
        a, b = max(low, int(marks[i]) - p.snap), min(high, int(marks[i]) + p.snap)
        near = rank[a : b + 1]
        if near.max() > NONE:
            at = np.nonzero(near == near.max())[0] + a
            return int(at[np.abs(at - marks[i]).argmin()]), False
        i += 1
    for a, b in ((low, high), (low, min(pos + p.max_units, len(u))), (pos + 1, low - 1)):
        near = rank[a : b + 1]
        if len(near) and near.max() > NONE:
            return int(np.nonzero(near == near.max())[0][-1]) + a, False
    end = min(pos + p.max_units, len(u))
    if end < len(u) and 0xDC00 <= u[end] <= 0xDFFF and end - 1 > pos:
        end -= 1  # not inside a surrogate pair
    return end, True


def _overlap_start(u: np.ndarray, rank: np.ndarray, pos: int, reach: int) -> int:
    """The first boundary within `reach` before pos; else pos - reach itself, off a surrogate pair."""
    if reach <= 0:
        return pos
    near = np.nonzero(rank[pos - reach : pos] > NONE)[0]
    start = pos - reach + (int(near[0]) if len(near) else 0)
    return start + 1 if start < pos and 0xDC00 <= u[start] <= 0xDFFF else start


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")


def heading_marks(text: str) -> list[tuple[int, list[str]]]:
    """(code point offset, heading path from there on), headings inside fences left out."""
    out: list[tuple[int, list[str]]] = []
    stack: list[tuple[int, str]] = []
    fence, at = "", 0
    for line in text.split("\n"):
        if f := _FENCE.match(line):
            mark = f.group(1)
            if not fence:
                fence = mark
            elif mark[0] == fence[0] and len(mark) >= len(fence):
                fence = ""
        elif not fence and (m := _HEADING.match(line)):
            level = len(m.group(1))
            stack = [x for x in stack if x[0] < level] + [(level, m.group(2))]
            out.append((at, [t for _, t in stack]))
        at += len(line) + 1
    return out


def split_oversized(df: DataFrame, item_id: str, text: str, path: str | None = None, params: PieceParams = PieceParams(), only_oversized: bool = False) -> DataFrame:
    """One row a piece: item_id, piece_no from 0, start_unit, end_unit, overlap_units, forced, path, piece.

    `piece` is units [start_unit, end_unit); its first `overlap_units` repeat the end of the piece before, so joining the
    pieces without their overlap gives the text back. Overlap is `params.overlap` units, less only where it snaps to a
    boundary or a natural cut needs the room. `forced` pieces end where no white space was within the maximum. A given
    `path` is kept; without one it is the Markdown heading path at the piece's own start. Null texts give no row; an empty one
    gives one empty piece; re-delivered rows of an id count once; other columns are ignored. Texts within
    the maximum never enter Python. `only_oversized` drops their one-piece rows.
    """
    p = params
    kind = dict(df.dtypes)[item_id]
    given = F.col(path).cast("array<string>") if path else F.lit(None).cast("array<string>")
    rows = df.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"), given.alias("path")).where(F.col("text").isNotNull())
    has_path = path is not None
    schema = f"item_id {kind}, piece_no int, start_unit int, end_unit int, overlap_units int, forced boolean, path array<string>, piece string"

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for item, body, own in zip(pdf["item_id"], pdf["text"], pdf["path"], strict=True):
                u = np.frombuffer(body.encode("utf-16-le", "surrogatepass"), "<u2")
                marks = [] if has_path else heading_marks(body)
                at, own_start = 0, 0
                offsets = [len(body[:o].encode("utf-16-le", "surrogatepass")) // 2 for o, _ in marks] if not body.isascii() else [o for o, _ in marks]
                for no, (start, end, forced) in enumerate(cut_points(u, p)):
                    while at < len(offsets) and offsets[at] <= own_start:
                        at += 1
                    where = own if has_path else (marks[at - 1][1] if at else [])
                    out.append((item, no, start, end, own_start - start, forced, where, u[start:end].tobytes().decode("utf-16-le", "replace")))
                    own_start = end
            yield pd.DataFrame(out, columns=["item_id", "piece_no", "start_unit", "end_unit", "overlap_units", "forced", "path", "piece"])

    n = units_of(F.col("text"))
    pieces = rows.where((F.length("text") > p.max_units // 2) & (n > p.max_units)).dropDuplicates(["item_id"]).mapInPandas(cut, schema)
    if only_oversized:
        return pieces
    whole = rows.where(n <= p.max_units).dropDuplicates(["item_id"])
    return pieces.unionByName(
        whole.select("item_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_unit"), n.alias("end_unit"), F.lit(0).alias("overlap_units"), F.lit(False).alias("forced"), F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.col("text").alias("piece"))
    )
