"""HTML to clean Markdown: a tolerant tree, a small selector engine, sanitising, links, and conversion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

# Selectors of what is not content.
REMOVED = [
    "aside",
    "nav",
    "footer",
    "script",
    "style",
    "noscript",
    "svg",
    "link",
    "meta",
    "iframe",
    "header",
    "button",
    "input",
    "textarea",
    "select",
    ".ads",
    ".advertisement",
    ".banner",
    ".cookie-banner",
    ".cookie-consent",
    ".hidden",
    ".hide",
    ".mobile-menu",
    ".mobile-nav",
    ".modal",
    ".nav-bar",
    ".overlay",
    ".popup",
    ".promo",
    ".mw-editsection",
    ".search-bar",
    ".search-form",
    ".side-bar",
    ".sidebar",
    ".social-share",
    ".sticky",
    ".table-of-contents",
    ".toc",
    "#ads",
    "#banner",
    "#cookieBanner",
    "#mobile-menu",
    "#mobile-nav",
    "#modal",
    "#nav",
    "#overlay",
    "#popup",
    "#sidebar",
    "#socialMediaBox",
    "#stickyHeader",
    "#ad-container",
    ".ad-container",
    ".login-form",
    ".signup-form",
    ".tooltip",
    ".dropdown-menu",
    ".breadcrumb",
    ".pagination",
    '[role="banner"]',
    '[role="complementary"]',
    '[role="dialog"]',
    '[role="alertdialog"]',
    '[role="navigation"]',
    '[role="search"]',
    '[role="region"][aria-label*="skip" i]',
    '[aria-modal="true"]',
    ".noprint",
    "a.sr-only",
    "a.skip-link",
    "a.skip-nav",
    "a.screen-reader-only",
    "a.visually-hidden",
    '[aria-label="Breadcrumb" i]',
    '[itemtype*="BreadcrumbList"]',
    "#carbonads",
    ".carbonads",
    ".carbon-wrap",
    ".carbon-text",
    ".carbon-img",
    ".carbon-poweredby",
    'a[href*="srv.carbonads.net"]',
    ".bsa-promotion",
    ".bsa-cpc",
    '[id^="bsap_"]',
    '[id^="bsa-zone_"]',
    'img[src*="buysellads.com"]',
    'img[src*="buysellads.net"]',
    ".ethical-rtd",
    ".ethical-fixedfooter",
    ".ethical-bottom-right",
    "[data-ea-publisher]",
    ".keep-us-sustainable",
    'img[src*="ethicalads.io"]',
    ".adsbygoogle",
    "ins.adsbygoogle",
    '[id^="google_ads_iframe"]',
    'img[src*="googlesyndication.com"]',
    'img[src*="doubleclick.net"]',
    ".OUTBRAIN",
    '[data-widget-id^="OB_"]',
    ".taboola",
    '[id^="taboola-"]',
    'img[src*="bidr.io"]',
    'img[src*="adnxs.com"]',
    'img[src*="adsrvr.org"]',
    'img[src*="analytics.yahoo.com"]',
    ".DocSearch",
    ".DocSearch-Button",
    ".DocSearch-Container",
    ".DocSearch-Modal",
    "#docsearch",
    '[id^="docsearch-"]',
    ".algolia-autocomplete",
    ".algolia-docsearch-suggestion",
    ".md-search-result",
    ".md-search__output",
    "#searchbox",
    "#search-results",
    ".wy-side-search",
    "#st-search-input",
    "#st-results-container",
    ".st-default-search-input",
]
# Hosts of tracking images.
TRACKERS = [
    "adroll.com",
    "doubleclick.net",
    "google-analytics.com",
    "googletagmanager.com",
    "analytics.twitter.com",
    "twitter.com/1/i/adsct",
    "t.co/1/i/adsct",
    "bat.bing.com",
    "pixel.rubiconproject.com",
    "casalemedia.com",
    "tremorhub.com",
    "rlcdn.com",
    "facebook.com/tr",
    "linkedin.com/px",
    "quantserve.com",
    "scorecardresearch.com",
    "hotjar.com",
    "mouseflow.com",
    "crazyegg.com",
    "clarity.ms",
]
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table ul details summary".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs) -> None:
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        if self.stack[-1].tag in shut:
            self.stack.pop()
            if tag == "tr" and self.stack[-1].tag in ("tr",):
                self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < 400:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.stack[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?)=[\"']?([^\"'\]]*)[\"']?( i)?)?\]")


def matches(node: Node, selector: str) -> bool:
    """Whether a compound of tag, .class, #id and [attribute] tests holds of the node; what cannot be read holds of none."""
    at = 0
    for m in _SIMPLE.finditer(selector):
        if m.start() != at:
            return False
        at = m.end()
        tag, cls, ident, attr, op, value, fold = m.groups()
        if tag and node.tag != tag.lower():
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None:
                return False
            if value is not None:
                a, b = (have.lower(), value.lower()) if fold else (have, value)
                if not {"": a == b, "*": b in a, "^": a.startswith(b), "$": a.endswith(b)}[op or ""]:
                    return False
    return at == len(selector) and bool(selector)


def sanitise(root: Node, extra: tuple[str, ...] = ()) -> None:
    """Remove what is not content; if no text would be left, leave the page as it was."""
    selectors = [*extra, *REMOVED]

    def cut(n: Node) -> list[Node | str]:
        out: list[Node | str] = []
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag in ("html", "body") or not any(matches(c, s) for s in selectors):
                out.append(Node(c.tag, c.attrs, cut(c)))
        return out

    kept = Node("#root", {}, cut(root))
    body, after = root.first("body") or root, kept.first("body") or kept
    if after.text().strip() or not body.text().strip():
        root.children = kept.children


def title(root: Node) -> str:
    for n in (root.first("title"), root.first("h1")):
        if n and (t := " ".join(n.text().split())):
            return t
    return "Untitled"


def links(root: Node, url: str) -> list[str]:
    """Absolute http, https and file targets in order, each once; `<base href>` counts."""
    base = next((n.attrs["href"] for n in root.walk() if n.tag == "base" and n.attrs.get("href")), "")
    base = urljoin(url, base)
    out: dict[str, None] = {}
    for n in root.walk():
        if n.tag == "a" and (h := n.attrs.get("href", "").strip()):
            try:
                target = urljoin(base, h)
                if urlsplit(target).scheme in ("http", "https", "file"):
                    out.setdefault(target)
            except ValueError:
                continue
    return list(out)


_ROWS_MOST, _CELLS_MOST, _CHARS_MOST, _ROWS_PART = 500, 1000, 100_000, 100


class _Writer:
    def __init__(self, url: str) -> None:
        self.url = url

    def inline(self, n: Node | str) -> str:
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n)
        if n.tag in ("head", "title", "script", "style", "template"):
            return ""
        inner = lambda: "".join(self.inline(c) for c in n.children)
        if n.tag == "br":
            return "\n"
        if n.tag == "img":
            src = urljoin(self.url, n.attrs.get("src", ""))
            if not n.attrs.get("src") or any(t in src for t in TRACKERS):
                return ""
            return f"![{n.attrs.get('alt', '').strip()}]({src})"
        if n.tag in ("strong", "b", "em", "i", "del", "s"):
            body = inner()
            mark = {"strong": "**", "b": "**", "em": "_", "i": "_"}.get(n.tag, "~~")
            core = body.strip()
            return body.replace(core, f"{mark}{core}{mark}", 1) if core else body
        if n.tag in ("code", "kbd", "samp", "tt"):
            body = n.text()
            return f"`` {body} ``" if "`" in body else f"`{body}`" if body.strip() else body
        if n.tag == "a":
            body, href = inner(), n.attrs.get("href", "").strip()
            target = urljoin(self.url, href) if href else ""
            if not href or href.startswith("#") or not target.startswith(("http://", "https://")) or not body.strip():
                return body
            return f"[{' '.join(body.split())}]({target})"
        return inner()

    def blocks(self, n: Node) -> list[str]:
        out: list[str] = []
        run = ""

        def flush() -> None:
            nonlocal run
            text = "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in run.split("\n")).strip()
            if text:
                out.append(text)
            run = ""

        for c in n.children:
            if isinstance(c, str) or not self._is_block(c):
                run += self.inline(c)
            else:
                flush()
                out.extend(self.block(c))
        flush()
        return out

    def _is_block(self, n: Node) -> bool:
        return n.tag in BLOCK or (n.tag not in ("a", "code", "img", "head") and any(isinstance(c, Node) and self._is_block(c) for c in n.children))

    def block(self, n: Node) -> list[str]:
        if re.fullmatch("h[1-6]", n.tag):
            t = " ".join("".join(self.inline(c) for c in n.children).split())
            return [f"{'#' * int(n.tag[1])} {t}"] if t else []
        if n.tag == "pre":
            return [self.code(n)]
        if n.tag in ("ul", "ol"):
            return ["\n".join(self.items(n))]
        if n.tag == "blockquote":
            body = "\n\n".join(self.blocks(n))
            return ["\n".join(f"> {x}".rstrip() for x in body.split("\n"))] if body else []
        if n.tag == "table":
            return self.table(n)
        if n.tag == "hr":
            return ["---"]
        return self.blocks(n)

    def code(self, n: Node) -> str:
        inner = n.first("code") or n
        marks = " ".join(x.attrs.get("class", "") for x in (n, inner)) + " "
        m = re.search(r"(?:language|lang|highlight-source|brush:)-?\s*([\w+#-]+)", marks)
        lang = m[1] if m else n.attrs.get("data-language") or inner.attrs.get("data-language") or ""

        def body(x: Node | str) -> str:
            if isinstance(x, str):
                return x
            if x.tag == "br":
                return "\n"
            t = "".join(body(c) for c in x.children)
            return t + "\n" if x.tag in ("div", "p", "li") or ("line" in x.attrs.get("class", "").split() and not t.endswith("\n")) else t

        text = body(inner).strip("\n")
        ticks = "`" * max(3, max((len(r) + 1 for r in re.findall("`{3,}", text)), default=0))
        return f"{ticks}{lang}\n{text}\n{ticks}"

    def items(self, n: Node, start: int = 1) -> list[str]:
        out: list[str] = []
        number = int(n.attrs.get("start", "1")) if n.attrs.get("start", "1").isdigit() else start
        for c in n.children:
            if isinstance(c, Node) and c.tag == "li":
                mark = f"{number}. " if n.tag == "ol" else "- "
                number += 1
                parts = self.blocks(c)
                tight = "\n".join(parts) if all("\n" not in p or p.lstrip().startswith(("-", "1")) for p in parts[1:]) else "\n\n".join(parts)
                out.append(mark + tight.replace("\n", "\n" + " " * len(mark)))
        return out

    def table(self, n: Node) -> list[str]:
        rows = [[" ".join("".join(self.inline(c) for c in cell.children).split()).replace("|", "\\|") for cell in r.children if isinstance(cell, Node) and cell.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return []
        width = max(map(len, rows))
        line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
        head = [line(rows[0]), "| " + " | ".join(["---"] * width) + " |"]
        body = [line(r) for r in rows[1:]]
        large = len(body) > _ROWS_MOST or width * len(rows) > _CELLS_MOST or sum(map(len, body)) > _CHARS_MOST
        parts = [body[i : i + _ROWS_PART] for i in range(0, len(body), _ROWS_PART)] if large else [body]
        return ["\n".join([*head, *p]) for p in parts or [[]]]


def to_markdown(root: Node, url: str) -> str:
    return "\n\n".join(b for b in _Writer(url).blocks(root.first("body") or root) if b.strip())


def convert(html: str | None, url: str, excluded: tuple[str, ...] = ()) -> tuple[str, str, list[str], list[str]]:
    """(title, markdown, links, errors) of a page. Links are read before anything is removed; errors are collected, not raised."""
    if not html:
        return "Untitled", "", [], []
    errors: list[str] = []
    try:
        root = parse(html)
        name, out = title(root), links(root, url)
        sanitise(root, excluded)
        return name, to_markdown(root, url), out, errors
    except (ValueError, RecursionError) as e:
        return "Untitled", re.sub(r"<[^>]+>", " ", html), [], [*errors, f"{type(e).__name__}: {e}"]
