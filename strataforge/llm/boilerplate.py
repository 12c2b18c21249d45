"""Page frames by equivalence classes of tokens over the pages of a site.

A text line's tokens (`lines`) are the whole masked line and its outer words in their roles. Over a site's pages a token has an occurrence vector, held as a
64-bit exclusive-or over (page, count); tokens with equal vectors form an equivalence class. The same is done over all sites together, where the site's name
is masked, for tokens too thin on one. Classes are then placed on the pages. A class is ordered if its lines stand in one order on all its pages, in one
gap of the enclosing class, the one of two lines and more on most of the site's pages; it nests in the frame if its lines lie there, before a page's first heading or after its last own
line. Whole lines need that for the class, if it is ordered and has several lines, or for themselves. A line that differs from page to page, such as a link to
the next page, is found by its outer words: two of them must be of one class, with the slot between or beside them, and that class must nest almost
always, told by the first of the two. The valid classes are the template. What they leave open is slots: those between frame lines (trails, link lists, neighbour links) belong to the
frame, the one from the first heading or own sentence to the last is the main body, with frame runs inside it cut out.

Messages that stand in place of content are body; they are found as forms that recur across sites on pages without content (`message_forms`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lines import BLANK, BULLET, CODE, CUES, GROUPS, HEADING, HOLDER, PROSE, QUOTED, ROLES, SHORT, TABLE, TEXT, TRAIL, Batch, parsed, site_pages
from .messages import SCRIPT
from .words import mix

#: The site number of classes over all sites.
EVERYWHERE = 0


@dataclass(frozen=True)
class FrameParams:
    """A token must recur under different titles, on a share of its site's pages, and lie in frame zones with a share of its occurrences.

    Lines that read like sentences need more of each than labels, and outer words, which say less, still more. Lines of an ordered class share its occurrences; `frame_share_alone`
    is for labels without one; `frame_share_slots` for outer words. Across sites a token must be on that share of the pages of the sites that have it.
    """

    least_titles: int = 3
    least_titles_prose: int = 5
    least_titles_slots: int = 12
    least_share: float = 0.001
    least_share_prose: float = 0.01
    frame_share: float = 0.05
    frame_share_alone: float = 0.5
    frame_share_prose: float = 0.5
    frame_share_slots: float = 0.9
    least_sites: int = 3
    wide_sites: int = 8  # sites from which a form without a cue may be a message
    alone_share: float = 0.75  # of a message's pages must have no content
    broadcast_tokens: int = 4_000_000  # template tokens sent to every task (17 bytes each); beyond it they are grouped with the pages by site
    pages_per_group: int = 20_000


def _page_tokens(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, token, count, prose, whole) of the distinct tokens of each page."""
    page = np.repeat(b.page[b.at], ROLES)
    token = b.tokens.ravel()
    prose = np.repeat((b.flags[b.at] & PROSE) > 0, ROLES)
    whole = np.tile(np.arange(ROLES) == 0, len(b.at))
    prose |= ~whole
    on = token != 0
    page, token, prose, whole = page[on], token[on], prose[on], whole[on]
    order = np.lexsort((token, page))
    page, token, prose, whole = page[order], token[order], prose[order], whole[order]
    new = np.ones(len(page), bool)
    new[1:] = (page[1:] != page[:-1]) | (token[1:] != token[:-1])
    at = np.flatnonzero(new)
    return page[at], token[at], np.diff(np.append(at, len(page))), prose[at], whole[at]


def _count_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per site and token of a batch: pages, titles as a 64-bit linear counter, and occurrence vector; token 0 counts the site's pages."""
    b = Batch(pdf)
    page, token, count, prose, whole = _page_tokens(b)
    page = np.concatenate([page, np.arange(b.pages)])
    token = np.concatenate([token, np.zeros(b.pages, np.int64)])
    count = np.concatenate([count, np.ones(b.pages, np.int64)])
    prose, whole = np.concatenate([prose, np.zeros(b.pages, bool)]), np.concatenate([whole, np.ones(b.pages, bool)])
    name = pd.util.hash_array(pdf["item_id"].to_numpy().astype(str).astype(object)).astype(np.uint64)
    vector = mix(mix(name, 3)[page] + count.astype(np.uint64), 5)
    bit = np.uint64(1) << (b.title.astype(np.uint64) & np.uint64(63))
    order = np.lexsort((token, b.site[page]))
    page, token = page[order], token[order]
    site = b.site[page]
    new = np.ones(len(page), bool)
    new[1:] = (site[1:] != site[:-1]) | (token[1:] != token[:-1])
    at = np.flatnonzero(new)
    return pd.DataFrame({
        "site": site[at], "token": token[at], "pages": np.diff(np.append(at, len(page))), "titles": np.bitwise_or.reduceat(bit[page], at).view(np.int64), "vector": np.bitwise_xor.reduceat(vector[order], at).view(np.int64),
        "prose": prose[order][at].astype(np.int32), "whole": whole[order][at].astype(np.int32),
    })


def site_token(site: np.ndarray | int, tok: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(np.asarray(site, np.int64).astype(np.uint64), 1) ^ tok.astype(np.uint64)).astype(np.int64)


@dataclass
class Classes:
    """Sorted keys site_token(site, token) with the token's class, or a table (site, token, cls, enclosing) where there are too many to send.

    `enclosing` tells, while templates are deduced, the lines of enclosing classes; in a template, the outer words that lead a line's valid pair.
    """

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cls: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    enclosing: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    table: DataFrame | None = None

    @staticmethod
    def of(rows: pd.DataFrame) -> Classes:
        key = site_token(rows["site"].to_numpy(np.int64), rows["token"].to_numpy(np.int64))
        order = np.argsort(key)
        return Classes(key[order], rows["cls"].to_numpy(np.int64)[order], rows["enclosing"].to_numpy(bool)[order])

    @staticmethod
    def sent(rows: DataFrame, p: FrameParams) -> Classes:
        return Classes(table=rows) if rows.count() > p.broadcast_tokens else Classes.of(rows.toPandas())

    def find(self, site: np.ndarray | int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, place in cls)."""
        if not len(self.keys):
            return np.zeros(tokens.shape, bool), np.zeros(tokens.shape, np.int64)
        key = site_token(site, tokens)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (tokens != 0), at

    def lines(self, b: Batch, site: np.ndarray | int, valid: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(listed, place, slotted, lead) of each text line: whether it is a token as a whole, and where; whether two of its outer words are of one class, and the first of them."""
        whole, at = self.find(site, b.tokens[:, 0])
        outer, place = self.find(site if isinstance(site, int) else site[:, None], b.tokens[:, 1:])
        cls = np.where(outer, self.cls[place] if len(self.cls) else 0, np.arange(1, ROLES))  # no two alike where none is found
        slotted, slot = np.zeros(len(whole), bool), np.zeros(len(whole), np.int64)
        for i, j in ((0, 1), (0, 2), (2, 3), (0, 3), (1, 2), (1, 3)):
            same = outer[:, i] & outer[:, j] & (cls[:, i] == cls[:, j])
            if valid and len(self.cls):
                same &= self.enclosing[place[:, i]]
            slot[same & ~slotted] = b.tokens[same & ~slotted, 1 + i]
            slotted |= same
        return whole, at, slotted, slot


def _zones(b: Batch, unsure: np.ndarray) -> np.ndarray:
    """Whether each text line lies before its page's first heading (own line if it has none) or after its last own line; `unsure` text lines are no own lines.

    A page without an own line below its headings does not tell where its body ends, so nothing below the first heading counts as frame there.
    """
    own = (b.kinds == TABLE) | (b.kinds == CODE)
    own[b.at] = ~unsure & ((b.flags[b.at] & PROSE) > 0)
    sure, heads = np.flatnonzero(own), np.flatnonzero(b.kinds == HEADING)
    first, last, end = b.first(heads), b.last(sure), b.begin + b.lengths
    none = first >= end
    first[none] = b.first(sure)[none]
    last = np.where(last < b.begin, end, np.maximum(last, b.last(heads)))
    page = b.page[b.at]
    return (b.at < first[page]) | (b.at > last[page])


def _place_batch(pdf: pd.DataFrame, known: Classes) -> pd.DataFrame:
    """Per site and candidate of a batch: occurrences, those in frame zones, and the range of its class's place on a page.

    A place is the order of the class's lines and the gap of the enclosing class they stand in, hashed; it is constant if the range is one value.
    Whole lines are reported as kind 0, pairs of outer words by their first as kind 1.
    """
    b = Batch(pdf)
    page = b.page[b.at]
    own_w, own_at, own_s, own_slot = known.lines(b, b.site[page])
    all_w, all_at, all_s, all_slot = known.lines(b, EVERYWHERE)
    whole = own_w | all_w
    zone = _zones(b, whole | own_s | all_s)
    out = []
    if own_w.any():
        rows = np.flatnonzero(own_w)
        pg, cls, enc, tok = page[rows], known.cls[own_at[rows]], known.enclosing[own_at[rows]], b.tokens[rows, 0]
        # Enclosing lines of the page that stand before each line; its own is not counted among its class's gaps.
        before = np.cumsum(enc)
        head = np.searchsorted(pg, pg)
        gap = np.where(enc, 0, before - np.where(head > 0, before[head - 1], 0))
        order = np.lexsort((rows, cls, pg))
        pc = np.stack([pg[order], cls[order]], axis=1)
        new = np.ones(len(order), bool)
        new[1:] = (pc[1:] != pc[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        rank = np.arange(len(order)) - at[run]
        with np.errstate(over="ignore"):
            step = mix(tok[order].astype(np.uint64) + mix(rank.astype(np.uint64) * np.uint64(1024) + gap[order].astype(np.uint64), 11), 13)
            total = np.add.reduceat(step, at)
        place = np.empty(len(order), np.int64)
        place[order] = total[run].view(np.int64)
        out.append(pd.DataFrame({"site": b.site[pg], "kind": 0, "token": tok, "framed": zone[rows], "place": place}))
    rows = np.flatnonzero(all_w)
    out.append(pd.DataFrame({"site": EVERYWHERE, "kind": 0, "token": b.tokens[rows, 0], "framed": zone[rows], "place": 0}))
    for site, s, slot, w in ((b.site[page], own_s, own_slot, own_w), (np.zeros(len(page), np.int64), all_s, all_slot, all_w)):
        rows = np.flatnonzero(s & ~w)
        out.append(pd.DataFrame({"site": site[rows], "kind": 1, "token": slot[rows], "framed": zone[rows], "place": 0}))
    acc = pd.concat(out).groupby(["site", "kind", "token"], sort=False).agg(seen=("framed", "size"), framed=("framed", "sum"), low=("place", "min"), high=("place", "max")).reset_index()
    return acc.astype({"site": "int64", "kind": "int32", "token": "int64", "seen": "int64", "framed": "int64"})


def _apply(known: Classes, pages: DataFrame, run: Callable[[pd.DataFrame, Classes], pd.DataFrame], schema: str, p: FrameParams) -> DataFrame:
    """run(pages, classes) over all parsed pages, by batch, or by site where the classes are not sent to every task."""
    if known.table is None:
        sent = pages.sparkSession.sparkContext.broadcast((known.keys, known.cls, known.enclosing))

        def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = Classes(*sent.value)
            for pdf in it:
                yield run(pdf, mine)

        return pages.mapInPandas(each, schema)
    # Classes over all sites go to the sites that have their tokens, so a group holds what its pages can meet; hot sites are salted.
    spread = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    salts = cut_lineage(pages.groupBy("site").agg(F.ceil(F.count("*") / p.pages_per_group).cast("int").alias("salts")))
    left = pages.join(salts, "site").withColumn("salt", F.pmod(F.xxhash64("item_id"), "salts").cast("int")).drop("salts")

    def tokens(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Batch(pdf)
        site, token = np.repeat(b.site[b.page[b.at]], ROLES), b.tokens.ravel()
        return pd.DataFrame({"at": site, "token": token}).drop_duplicates()

    everywhere = known.table.where(F.col("site") == EVERYWHERE)
    met = pages.mapInPandas(lambda it: (tokens(x) for x in it), "at bigint, token bigint").distinct().join(everywhere, "token")
    rows = known.table.where(F.col("site") != EVERYWHERE).withColumn("at", F.col("site")).unionByName(met)
    right = rows.join(salts.withColumnRenamed("site", "at"), "at").withColumn("salt", spread).drop("salts")

    def group(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return run(a, Classes.of(c))

    return left.groupBy("site", "salt").cogroup(right.groupBy("at", "salt")).applyInPandas(group, schema)


def word_classes(often: DataFrame) -> DataFrame:
    """(site, token, cls, lines, words, enclosing) of (site, token, pages, vector, whole): equivalence classes with their whole lines and all their tokens.

    The class of two lines and more that is on most pages of a site encloses the others. Outer words alone make no line, so a class of one of them is left out.
    """
    classes = often.groupBy("site", "pages", "vector").agg(F.sum("whole").alias("lines"), F.count("*").alias("words"))
    outer = classes.where((F.col("lines") > 1) & (F.col("site") != EVERYWHERE)).groupBy("site").agg(F.max_by("vector", F.struct("pages", "lines", "vector")).alias("outer"))
    rows = often.join(classes, ["site", "pages", "vector"]).where("whole = 1 or words > 1").join(outer, "site", "left")
    return rows.select("site", "token", F.col("vector").alias("cls"), "lines", "words", "prose", "whole", F.coalesce(F.col("vector") == F.col("outer"), F.lit(False)).alias("enclosing"))


def deduce_templates(pages: DataFrame, params: FrameParams = FrameParams()) -> Classes:
    """The template of each site, and the one of all sites (site 0), of parsed pages: valid classes and their tokens."""
    p = params
    counted = pages.mapInPandas(lambda it: (_count_batch(x) for x in it), "site bigint, token bigint, pages bigint, titles bigint, vector bigint, prose int, whole int")
    sums = lambda *more: [F.sum("pages").alias("pages"), F.bit_or("titles").alias("titles"), F.bit_xor("vector").alias("vector"), F.max("prose").alias("prose"), F.max("whole").alias("whole"), *more]
    everything = cut_lineage(counted.groupBy("site", "token").agg(*sums()))
    per, size = everything.where("token <> 0"), everything.where("token = 0").select("site", F.col("pages").alias("n"))
    by_kind = lambda prose, label: F.when(F.col("prose") == 1, prose).otherwise(label)
    titles = F.when(F.col("whole") == 0, p.least_titles_slots).otherwise(by_kind(p.least_titles_prose, p.least_titles))
    enough = (F.col("pages") >= F.col("n") * by_kind(p.least_share_prose, p.least_share)) & (F.bit_count("titles") >= titles)
    columns = ["site", "token", "pages", "vector", "prose", "whole"]
    # The bounds of a site and over all sites differ only in what the share is of.
    own = per.where("pages >= 2").join(size, "site").where(enough).select(columns)
    wide = per.join(size, "site").groupBy("token").agg(*sums(F.sum("n").alias("n"), F.count("*").alias("sites")))
    wide = wide.where((F.col("sites") >= p.least_sites) & (F.col("pages") > p.least_titles) & enough).withColumn("site", F.lit(EVERYWHERE).cast("bigint")).select(columns)
    listed = cut_lineage(word_classes(own.unionByName(wide)))
    candidates = Classes.sent(listed.select("site", "token", "cls", "enclosing"), p)
    placed = _apply(candidates, pages, _place_batch, "site bigint, kind int, token bigint, seen bigint, framed bigint, low bigint, high bigint", p)
    placed = cut_lineage(placed.groupBy("site", "kind", "token").agg(F.sum("seen").alias("s"), F.sum("framed").alias("f"), F.min("low").alias("low"), F.max("high").alias("high")))
    # Validity of whole lines: alone, here or over all sites, or with the ordered class they stand in; of outer words by class.
    nests = F.col("f") >= F.col("s") * by_kind(p.frame_share_prose, p.frame_share_alone)
    lines = placed.where("kind = 0").join(listed.where("whole = 1"), ["site", "token"])
    ordered = lines.where((F.col("lines") > 1) & (F.col("site") != EVERYWHERE)).groupBy("site", "cls").agg(F.sum("s").alias("cs"), F.sum("f").alias("cf"), (F.max("high") == F.min("low")).alias("ordered"))
    ordered = ordered.where(F.col("ordered") & (F.col("cf") >= F.col("cs") * p.frame_share)).select("site", "cls", F.lit(True).alias("together"))
    whole = lines.join(ordered, ["site", "cls"], "left").where(nests | (F.col("together") & (F.col("prose") == 0))).select("site", "token", "cls", "enclosing")
    leads = placed.where("kind = 1").where(F.col("f") >= F.col("s") * p.frame_share_slots).select("site", "token", F.lit(True).alias("leads"))
    marked = listed.where("whole = 0").join(leads, ["site", "token"], "left").select("site", "token", "cls", F.coalesce("leads", F.lit(False)).alias("enclosing"))
    outer = marked.join(marked.where("enclosing").select("site", "cls").distinct(), ["site", "cls"], "left_semi").select("site", "token", "cls", "enclosing")
    return Classes.sent(cut_lineage(whole.unionByName(outer)), p)


def _form_batch(pdf: pd.DataFrame, template: Classes) -> pd.DataFrame:
    """Per site and form of a batch: its pages, those without content, its cues, and whether it is a whole form."""
    b = Batch(pdf)
    known = template_lines(b, template)
    flags = b.flags[b.at]
    page = b.page[b.at]
    # Content is headed sentences, tables or code that is no template; one form alone, however often it stands, may be a message.
    sure = ((flags & (PROSE | QUOTED)) > 0) & ~known
    loose = sure & (flags >> CUES == 0)
    few = pd.DataFrame({"page": page[loose], "form": b.groups[loose, 0]}).groupby("page")["form"].agg(["nunique", "min"])
    distinct, only = np.zeros(b.pages, np.int64), np.zeros(b.pages, np.int64)
    distinct[few.index], only[few.index] = few["nunique"], few["min"]
    solid = np.zeros(b.pages, bool)
    solid[b.page[(b.kinds == TABLE) | (b.kinds == CODE)]] = True
    alone = ~solid[page] & ((distinct[page] == 0) | ((distinct[page] == 1) & (only[page] == b.groups[:, 0])))
    out = pd.DataFrame({"page": np.repeat(page, GROUPS), "form": b.groups.ravel(), "alone": np.repeat(alone, GROUPS), "cues": np.repeat(flags >> CUES, GROUPS), "whole": np.tile(np.arange(GROUPS) == 0, len(page))})
    out = out[out["form"] != 0].drop_duplicates(["page", "form"])
    out["site"] = b.site[out["page"].to_numpy()]
    acc = out.groupby(["site", "form"], sort=False).agg(pages=("page", "size"), alone=("alone", "sum"), cues=("cues", "max"), least=("cues", "min"), whole=("whole", "max")).reset_index()
    return acc.astype({"pages": "int64", "alone": "int64", "cues": "int32", "least": "int32", "whole": "int32"})


@dataclass
class Forms:
    """Sorted hashes of the forms that are messages, and of those that are script notices."""

    messages: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    notices: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def message_forms(pages: DataFrame, template: Classes, params: FrameParams = FrameParams()) -> Forms:
    """The forms that stand on many sites, mostly on pages without content: with a cue from `least_sites` sites on, without one from `wide_sites`.

    What is kept is a set of hashes of wide forms, which grows with the wordings of messages, not with the pages.
    """
    p = params
    per = _apply(template, pages, _form_batch, "site bigint, form bigint, pages bigint, alone bigint, cues int, least int, whole int", p)
    per = per.groupBy("site", "form").agg(F.sum("pages").alias("pages"), F.sum("alone").alias("alone"), F.max("cues").alias("cues"), F.min("least").alias("least"), F.max("whole").alias("whole"))
    wide = per.groupBy("form").agg(F.count("*").alias("sites"), F.sum("pages").alias("pages"), F.sum("alone").alias("alone"), F.max("cues").alias("cues"), F.min("least").alias("least"), F.max("whole").alias("whole"))
    cued = (F.col("sites") >= p.least_sites) & (F.col("least") > 0) & (F.col("alone") >= F.col("pages") * p.alone_share)
    bare = (F.col("sites") >= p.wide_sites) & (F.col("whole") == 1) & (F.col("alone") >= F.col("pages") * p.alone_share)
    notice = (F.col("sites") >= p.least_sites) & (F.col("least").bitwiseAND(SCRIPT) > 0) & (F.col("whole") == 1)
    rows = wide.where(cued | bare | notice).select("form", (cued | bare).alias("message"), notice.alias("notice")).toPandas()
    form = rows["form"].to_numpy(np.int64)
    return Forms(np.sort(form[rows["message"].to_numpy(bool)]), np.sort(form[rows["notice"].to_numpy(bool)]))


def template_lines(b: Batch, template: Classes) -> np.ndarray:
    """Whether each text line is template, as a whole or by a pair of its outer words, on its site or over all."""
    out = np.zeros(len(b.at), bool)
    for site in (b.site[b.page[b.at]], EVERYWHERE):
        whole, _, slotted, _ = template.lines(b, site, valid=True)
        out |= whole | slotted
    return out


@dataclass
class Page:
    kinds: np.ndarray
    flags: np.ndarray
    frame: list[bool]
    message: np.ndarray


def read_pages(pdf: pd.DataFrame, template: Classes, forms: Forms) -> Iterator[Page]:
    """Which lines of each parsed page belong to the frame (blank lines never do), and which are messages."""
    b = Batch(pdf)
    n = len(b.kinds)
    known, message, notice = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    known[b.at] = template_lines(b, template)
    message[b.at] = np.isin(b.groups, forms.messages).any(axis=1)
    notice[b.at] = np.isin(b.groups[:, 0], forms.notices)
    for begin, length in zip(b.begin, b.lengths, strict=True):
        cut = slice(begin, begin + length)
        yield _read(b.kinds[cut], b.flags[cut], known[cut], message[cut], notice[cut])


def _read(kinds: np.ndarray, flags: np.ndarray, known: np.ndarray, message: np.ndarray, notice: np.ndarray) -> Page:
    n = len(kinds)
    text = kinds == TEXT
    own = (kinds == HEADING) | (kinds == TABLE) | (kinds == CODE)
    own |= text & ~known & ~message & ((flags & (PROSE | QUOTED | HOLDER)) > 0)
    if message.any():
        # A notice among the frame of a page with content is frame; without content a message stands in its place.
        content = bool((own & text).any())
        framed = message & content & (known | notice)
        known, own = (known & ~message) | framed, own | (message & ~framed)
        message = message & ~framed
    sure = np.flatnonzero(own)
    if not len(sure):
        rest = text & ~known
        body = rest if rest.sum() == text.sum() else np.zeros(n, bool)
        return Page(kinds, flags, (text & ~body).tolist(), message)
    first, last = int(sure[0]), int(sure[-1])
    heads = sure[kinds[sure] == HEADING]
    if kinds[first] != HEADING and (not len(heads) or first < heads[0]):
        # A first sentence without a heading: a line of its own right above it is its title.
        above = first - 1
        while above >= 0 and kinds[above] == BLANK:
            above -= 1
        if 0 <= above < first - 1 and text[above] and not known[above] and (above == 0 or kinds[above - 1] == BLANK) and not flags[above] & (BULLET | TRAIL):
            first = above
    kind, is_known, is_own, bits = kinds.tolist(), known.tolist(), own.tolist(), flags.tolist()
    frame = [False] * n
    listing = False
    for i in range(n):
        k = kind[i]
        if k == BLANK:
            listing = False
        elif i < first or i > last:
            frame[i] = k == TEXT
        elif k == TEXT and is_known[i]:
            frame[i] = True
            listing = bool(bits[i] & SHORT)
        elif k == TEXT and listing and not is_own[i]:
            frame[i] = True
        else:
            listing = False
    return Page(kinds, flags, frame, message)


def read_all(df: DataFrame, item_id: str, url: str, text: str, out: Callable[[pd.DataFrame, list[Page]], pd.DataFrame], schema: str, params: FrameParams) -> DataFrame:
    """out(parsed pages, their readings) over all pages: parse, deduce templates, find messages, read."""
    pages = parsed(site_pages(df, item_id, url, text))
    template = deduce_templates(pages, params)
    forms = message_forms(pages, template, params)
    return _apply(template, pages, lambda pdf, known: out(pdf, list(read_pages(pdf, known, forms))), schema, params)


def frame_lines(df: DataFrame, item_id: str, url: str, text: str, params: FrameParams = FrameParams()) -> DataFrame:
    """(item_id, line_no): the non-blank lines, numbered from 0 by line feed, that belong to the page frame.

    Null, empty and blank texts give no row; a page without a URL is read without its site's template; re-delivered ids count once; other
    columns are ignored.
    """

    def out(pdf: pd.DataFrame, pages: list[Page]) -> pd.DataFrame:
        at = [np.flatnonzero(p.frame) for p in pages]
        return pd.DataFrame({"item_id": np.repeat(pdf["item_id"].to_numpy(), [len(x) for x in at]), "line_no": np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)})

    return read_all(df, item_id, url, text, out, f"item_id {dict(df.dtypes)[item_id]}, line_no bigint", params).distinct()


def main_bodies(df: DataFrame, item_id: str, url: str, text: str, params: FrameParams = FrameParams()) -> DataFrame:
    """(item_id, body): each page's text without its frame lines, outer blank lines removed; rows as in `frame_lines`."""
    kind = dict(df.dtypes)[item_id]

    def out(pdf: pd.DataFrame, pages: list[Page]) -> pd.DataFrame:
        return pd.DataFrame({"item_id": pdf["item_id"], "frame": [np.array(p.frame, bool).tobytes() for p in pages]})

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            bodies = []
            for text, frame in zip(pdf["text"], pdf["frame"], strict=True):
                kept = "\n".join(x for x, f in zip(text.split("\n"), np.frombuffer(frame, bool), strict=True) if not f)
                bodies.append(re.sub(r"\n{3,}", "\n\n", kept).strip("\n"))
            yield pd.DataFrame({"item_id": pdf["item_id"], "body": bodies})

    # Frames are small, so they travel to the texts by id; a page's frame depends on its own text and site alone, so re-delivered rows agree.
    frames = read_all(df, item_id, url, text, out, f"item_id {kind}, frame binary", params).dropDuplicates(["item_id"])
    texts = site_pages(df, item_id, url, text).select("item_id", "text").dropDuplicates(["item_id"])
    return texts.join(frames, "item_id").mapInPandas(cut, f"item_id {kind}, body string")
