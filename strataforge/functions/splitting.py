"""Structure-aware splitting of Markdown, tables, lists, code, JSON and plain text, and the merge of small pieces.

Sizes are UTF-16 code units. Every splitter keeps fenced code whole where it can: no piece ends inside a fence that its text closes later.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field, replace

MIN_SIZE, PREFERRED_SIZE, MAX_SIZE = 500, 1500, 5000


def units(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


@dataclass(frozen=True)
class Chunk:
    types: tuple[str, ...]
    content: str
    level: int = 0
    path: tuple[str, ...] = ()


# --- fences -----------------------------------------------------------------------------------------------------------

_QUOTE = r"[ \t]*(?:>[ \t]*)*"
_OPEN = re.compile(rf"^{_QUOTE}(`{{3,}}|~{{3,}})(.*)$")


@dataclass
class Fence:
    """Reads lines one by one; `mark` is the open fence's delimiter, '' outside."""

    mark: str = ""

    def feed(self, line: str) -> bool:
        """Whether the line belongs to a fence, its delimiters included."""
        if self.mark:
            if re.fullmatch(rf"{_QUOTE}{re.escape(self.mark[0])}{{{len(self.mark)},}}[ \t]*", line):
                self.mark = ""
            return True
        if m := _OPEN.match(line):
            self.mark = m[1]
            return True
        return False


def open_at_end(text: str) -> bool:
    f = Fence()
    for line in text.split("\n"):
        f.feed(line)
    return bool(f.mark)


def balanced(parts: list[str], glue: str = "") -> list[str]:
    """Neighbours joined until none ends inside a fence."""
    out: list[str] = []
    held: list[str] = []
    for p in parts:
        held.append(p)
        if not open_at_end(glue.join(held)):
            out.append(glue.join(held))
            held = []
    return out + ([glue.join(held)] if held else [])


def filled(parts: list[str], limit: int, glue: str = "") -> list[str]:
    """Neighbours joined as long as the result stays within the limit."""
    out: list[str] = []
    for p in parts:
        if out and units(out[-1]) + units(glue) + units(p) <= limit:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


# --- text -------------------------------------------------------------------------------------------------------------

#: Where a piece that nothing else splits is cut, strongest first.
SEPARATORS = ["\n\n", "\n", " ", "\t", ".", ",", ";", ":", "-", "(", ")", "[", "]", "{", "}", ""]


def forced(text: str, limit: int, overlap: int = 0) -> list[str]:
    """Pieces within the limit, cut behind the strongest separator that gives some; at the limit itself as a last resort."""
    if units(text) <= limit:
        return [text] if text else []
    for sep in SEPARATORS[:-1]:
        parts = [p for p in re.split(f"(?<={re.escape(sep)})", text) if p]
        if len(parts) > 1:
            return filled([q for p in parts for q in forced(p, limit, overlap)], limit)
    out, at = [], 0
    while at < len(text):
        n = limit
        while units(text[at : at + n]) > limit:
            n -= max(1, (units(text[at : at + n]) - limit) // 2)
        out.append(text[at : at + n])
        at += n if at + n >= len(text) else max(1, n - overlap)
    return out


def split_text(text: str, limit: int = MAX_SIZE) -> list[str]:
    """By paragraphs if all fit, else by lines filled up, else by words filled up; a word beyond the limit is cut."""
    if units(text) <= limit:
        return [text]
    if max(map(units, text.split()), default=0) > limit:
        return forced(text, limit, min(20, limit // 10))
    paragraphs = balanced(_paragraphs(text))
    if all(units(p) <= limit for p in paragraphs):
        return [p for p in paragraphs if units(p) > 2]
    lines = balanced(text.splitlines(keepends=True))
    if all(units(p) <= limit for p in lines):
        return filled(lines, limit)
    return filled([q for p in lines for q in ([p] if units(p) <= limit else balanced(forced(p, limit)))], limit)


def _paragraphs(text: str) -> list[str]:
    ends = [m.end() for m in re.finditer(r"\n\s*\n", text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if a < b]


def split_code(block: str, limit: int = MAX_SIZE) -> list[str]:
    """A fenced block by lines, every piece fenced again with the block's info string."""
    if units(block) <= limit:
        return [block]
    lines = block.split("\n")
    m = _OPEN.match(lines[0])
    head, mark = (lines[0], m[1]) if m else ("```", "```")
    body = lines[1:] if m else lines
    if m and body and re.fullmatch(rf"\s*{re.escape(mark[0])}{{{len(mark)},}}\s*", body[-1]):
        body = body[:-1]
    room = max(1, limit - units(head) - units(mark) - 2)
    parts = [q for line in body for q in ([line] if units(line) <= room else forced(line, room))]
    return [f"{head}\n{p}\n{mark}" for p in filled(parts, room, "\n")]


def split_table(table: str, limit: int = MAX_SIZE) -> list[str]:
    """A table by rows, the two header rows repeated."""
    if units(table) <= limit:
        return [table]
    lines = table.split("\n")
    if len(lines) < 3 or not re.match(r"^\s*\|?[\s:|-]+\|?\s*$", lines[1]):
        return split_text(table, limit)
    head = "\n".join(lines[:2]) + "\n"
    room = max(1, limit - units(head))
    rows = [q for r in lines[2:] for q in ([r] if units(r) <= room else forced(r, room))]
    return [head + p for p in filled(rows, room, "\n")]


_BULLET = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(\s+|$)")


def split_list(text: str, limit: int = PREFERRED_SIZE) -> list[str]:
    """A list by its top items, filled up; items beyond the limit as text."""
    if units(text) <= limit:
        return [text]
    items: list[list[str]] = []
    fence = Fence()
    for line in text.split("\n"):
        inside = bool(fence.mark)
        fence.feed(line)
        if not items or (not inside and _BULLET.match(line)):
            items.append([line])
        else:
            items[-1].append(line)
    joined = ["\n".join(i) for i in items]
    return filled([q for i in joined for q in ([i] if units(i) <= limit else split_text(i, limit))], limit, "\n")


# --- Markdown ---------------------------------------------------------------------------------------------------------

_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_IMAGE = re.compile(r"^\s*!\[[^\]]*\]\([^)]*\)\s*$")
_FRONT = re.compile(r"\A---[ \t]*\n(.*?\n)---[ \t]*(?:\n|\Z)", re.S)


def plain_heading(text: str) -> str:
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"(\*\*|__|\*|`)(.+?)\1", r"\2", text).strip()


def markdown_blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text): heading, code, table, list, blockquote, media, text; rules are dropped."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[tuple[str, str]] = []
    i, n = 0, len(lines)

    def take(until) -> str:
        nonlocal i
        start = i
        i += 1
        while i < n and not until(lines[i]):
            i += 1
        return "\n".join(lines[start:i]).strip("\n")

    def begins(line: str) -> bool:
        return bool(_OPEN.match(line) or _HEADING.match(line) or _RULE.match(line) or line.lstrip().startswith(">"))

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif _OPEN.match(line) and not line.lstrip().startswith(">"):
            fence = Fence()
            fence.feed(line)
            start = i
            i += 1
            while i < n and fence.mark:
                fence.feed(lines[i])
                i += 1
            out.append(("code", "\n".join(lines[start:i])))
        elif m := _HEADING.match(line):
            out.append(("heading", f"{m[1]} {plain_heading(m[2] or '')}".rstrip()))
            i += 1
        elif _RULE.match(line):
            i += 1
        elif i + 1 < n and re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[i + 1]) and not _BULLET.match(line) and "|" not in line and not line.lstrip().startswith(">"):
            out.append(("heading", ("#" if lines[i + 1].strip()[0] == "=" else "##") + " " + plain_heading(line)))
            i += 2
        elif "|" in line and i + 1 < n and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            out.append(("table", take(lambda x: not x.strip() or "|" not in x)))
        elif line.lstrip().startswith(">"):
            out.append(("blockquote", take(lambda x: not x.strip() or not x.lstrip().startswith(">"))))
        elif _BULLET.match(line):
            start, fence, blank = i, Fence(), False
            fence.feed(line)
            i += 1
            while i < n:
                inside = bool(fence.mark)
                if not inside and not lines[i].strip():
                    blank = True
                elif not inside and not lines[i][:1].isspace() and not _BULLET.match(lines[i]) and (blank or begins(lines[i])):
                    break
                else:
                    blank = False
                fence.feed(lines[i])
                i += 1
            out.append(("list", "\n".join(lines[start:i]).strip("\n")))
        elif _IMAGE.match(line):
            out.append(("media", line.strip()))
            i += 1
        else:
            body = take(lambda x: not x.strip() or begins(x) or _BULLET.match(x))
            out.append(("text", body.strip()))
    return [b for b in out if b[1].strip()]


def split_markdown(text: str, preferred: int = PREFERRED_SIZE, limit: int = MAX_SIZE) -> list[Chunk]:
    """Chunks of a document in order, each with its kind and heading path; front matter comes first, at level 0."""
    out: list[Chunk] = []
    if (m := _FRONT.match(text)) and re.search(r"^[\w-]+\s*:", m[1], re.M):
        out.append(Chunk(("frontmatter",), f"---\n{m[1].rstrip()}\n---"))
        text = text[m.end() :]
    stack: list[tuple[int, str]] = []
    level, path = 0, ()
    for kind, body in markdown_blocks(text):
        if kind == "heading":
            level = len(body) - len(body.lstrip("#"))
            title = body[level:].strip()
            stack = [s for s in stack if s[0] < level] + [(level, title)]
            path = tuple(t for _, t in stack)
        cut = {"code": lambda b: split_code(b, limit), "table": lambda b: split_table(b, limit), "list": lambda b: split_list(b, preferred)}.get(kind, lambda b: split_text(b.strip(), limit))
        out.extend(Chunk((kind,), p, level, path) for p in cut(body))
    return out


def common_prefix(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def related(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Equal paths, or one within the other."""
    return common_prefix(a, b) in (a, b)


def merge_chunks(chunks: list[Chunk], least: int = MIN_SIZE, preferred: int = PREFERRED_SIZE, limit: int = MAX_SIZE) -> list[Chunk]:
    """Small neighbours joined: never beyond the limit, not into a new section of level 1 or 2 once `least` is reached, and not beyond `preferred` if both are of size."""
    out: list[Chunk] = []
    for c in chunks:
        if not out:
            out.append(c)
            continue
        now = out[-1]
        glue = "" if now.content.endswith("\n") else "\n"
        size, both = units(now.content), units(now.content) + len(glue) + units(c.content)
        section = size >= least and c.level in (1, 2) and not related(now.path, c.path)
        if both > limit or section or (both > preferred and size >= least and units(c.content) >= least):
            out.append(c)
            continue
        shared = common_prefix(now.path, c.path)
        path = max(now.path, c.path, key=len) if shared in (now.path, c.path) else shared
        out[-1] = Chunk(tuple(dict.fromkeys(now.types + c.types)), now.content + glue + c.content, min(now.level, c.level), path)
    return out


# --- JSON -------------------------------------------------------------------------------------------------------------


def split_json(text: str, limit: int = MAX_SIZE, deepest: int = 5, most: int = 1000) -> list[Chunk]:
    """A piece for each bracket and property, with paths from `root`; joined they give the document, indented by two. Values below `deepest` stay whole.

    Invalid JSON, and documents of more than `most` pieces, are split as text.
    """
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return [Chunk(("text",), p) for p in split_text(text, limit)]
    out: list[Chunk] = []

    def put(body: str, path: tuple[str, ...]) -> None:
        parts = [body] if units(body) <= limit else forced(body, limit)
        out.extend(Chunk(("code",), p, len(path), path) for p in parts)

    def walk(v, path: tuple[str, ...], lead: str, tail: str, depth: int) -> None:
        if len(out) > most:
            return
        if isinstance(v, (dict, list)) and v and depth < deepest:
            opened, closed = ("{", "}") if isinstance(v, dict) else ("[", "]")
            put(f"{lead}{opened}\n", path)
            items = list(v.items()) if isinstance(v, dict) else [(f"[{i}]", x) for i, x in enumerate(v)]
            pad = "  " * (depth + 1)
            for i, (k, x) in enumerate(items):
                name = f"{pad}{json.dumps(k, ensure_ascii=False)}: " if isinstance(v, dict) else pad
                walk(x, (*path, k), name, ",\n" if i + 1 < len(items) else "\n", depth + 1)
            put(f"{'  ' * depth}{closed}{tail}", path)
        else:
            body = json.dumps(v, indent=2, ensure_ascii=False).replace("\n", "\n" + "  " * depth)
            put(f"{lead}{body}{tail}", path)

    walk(value, ("root",), "", "", 0)
    if len(out) > most:
        return [Chunk(("text",), p) for p in split_text(text, limit)]
    return out


# --- source code ------------------------------------------------------------------------------------------------------


@dataclass
class Boundary:
    start: int  # lines, from 0
    end: int  # exclusive
    name: str
    structural: bool
    parent: Boundary | None = field(default=None, repr=False)

    @property
    def path(self) -> tuple[str, ...]:
        return (*(self.parent.path if self.parent else ()), self.name)


def python_boundaries(text: str) -> list[Boundary]:
    """Classes, import runs and functions not inside functions, with decorators and the comments right above."""
    lines = text.split("\n")
    out: list[Boundary] = []

    def begin(node: ast.stmt) -> int:
        at = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]]) - 1
        while at > 0 and lines[at - 1].strip().startswith("#"):
            at -= 1
        return at

    def walk(body: list[ast.stmt], parent: Boundary | None) -> None:
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                b = Boundary(begin(node), node.end_lineno, node.name, isinstance(node, ast.ClassDef), parent)
                out.append(b)
                if b.structural:
                    walk(node.body, b)
            elif isinstance(node, (ast.Import, ast.ImportFrom)) and parent is None:
                if out and out[-1].name == "imports" and not "".join(lines[out[-1].end : node.lineno - 1]).strip():
                    out[-1].end = node.end_lineno
                else:
                    out.append(Boundary(begin(node), node.end_lineno, "imports", True))

    walk(ast.parse(text).body, None)
    return out


# How declarations of the script languages begin.
_SCRIPT = [
    (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+([\w$]+)"), True),
    (re.compile(r"^\s*(?:export\s+)?(?:declare\s+)?(?:interface|enum|namespace|module)\s+([\w$.]+)"), True),
    (re.compile(r"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+([\w$]+)"), True),
    (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)"), False),
    (re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::\s*[^=]+)?=>"), False),
    (re.compile(r"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?([\w$]+)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{\s*$"), False),
]
_NOT_METHODS = frozenset("if for while switch catch function return else do try with".split())


def script_depths(text: str) -> list[int]:
    """Brace depth at the start of each line; strings, templates, comments and escapes are passed over."""
    depths, depth, mode, i = [0], 0, "", 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if mode == "":
            if two in ("//", "/*"):
                mode, i = two, i + 1
            elif c in "'\"`":
                mode = c
            else:
                depth += (c == "{") - (c == "}")
        elif mode in ("'", '"', "`"):
            if c == "\\":
                i += 1
            elif c == mode or (c == "\n" and mode != "`"):
                mode = ""
        elif mode == "/*" and two == "*/":
            mode, i = "", i + 1
        if i < len(text) and text[i] == "\n":
            if mode == "//":
                mode = ""
            depths.append(depth)
        i += 1
    return depths


def script_boundaries(text: str) -> list[Boundary]:
    """Classes, interfaces, enums, namespaces and import runs; functions, arrows and methods outside other functions; doc comments attached."""
    lines, depths = text.split("\n"), script_depths(text)
    out: list[Boundary] = []
    open_: list[tuple[int, Boundary]] = []
    for n, line in enumerate(lines):
        d = depths[n] if n < len(depths) else 0
        while open_ and d <= open_[-1][0] and n > open_[-1][1].start:
            open_[-1][1].end = n
            open_.pop()
        if d == 0 and re.match(r"\s*import\b", line):
            if out and out[-1].name == "imports" and out[-1].end == n:
                out[-1].end = n + 1
            else:
                out.append(Boundary(n, n + 1, "imports", True))
            continue
        if open_ and not open_[-1][1].structural:
            continue
        for rx, structural in _SCRIPT:
            if (m := rx.match(line)) and m[1] not in _NOT_METHODS:
                start = n
                while start > 0 and re.match(r"\s*(//|/\*|\*|@)", lines[start - 1]):
                    start -= 1
                b = Boundary(start, n + 1, m[1], structural, open_[-1][1] if open_ else None)
                out.append(b)
                after = depths[n + 1] if n + 1 < len(depths) else 0
                if after > d or (n + 1 < len(lines) and line.count("{") == 0 and not line.rstrip().endswith(";")):
                    open_.append((d, b))
                break
    for _, b in open_:
        b.end = len(lines)
    return out


def split_source(text: str, language: str, limit: int = MAX_SIZE) -> list[Chunk]:
    """Source code by its declarations; the pieces joined give the text. The first piece of a structural declaration is typed so.

    Languages without boundaries, and code that does not parse, are split as text.
    """
    try:
        found = python_boundaries(text) if language == "python" else script_boundaries(text) if language in ("javascript", "typescript", "js", "ts", "jsx", "tsx") else []
    except (SyntaxError, ValueError, RecursionError):
        found = []
    if not found:
        return [Chunk(("code",), p) for p in (forced(text, limit) if units(text) > limit else [text]) if p]
    lines = text.split("\n")
    cuts = sorted({0, len(lines), *[b.start for b in found], *[b.end for b in found]})
    out: list[Chunk] = []
    started: set[int] = set()
    for a, z in zip(cuts, cuts[1:], strict=False):
        body = "\n".join(lines[a:z]) + ("\n" if z < len(lines) else "")
        if not body:
            continue
        inner = max((b for b in found if b.start <= a and z <= b.end), key=lambda b: (b.start, len(b.path)), default=None)
        first = inner is not None and inner.structural and id(inner) not in started
        if inner is not None:
            started.add(id(inner))
        path = inner.path if inner else ()
        for i, p in enumerate(forced(body, limit) if units(body) > limit else [body]):
            out.append(Chunk(("code", "structural") if first and i == 0 else ("code",), p, len(path), path))
    # White space goes forward to what follows it.
    glued: list[Chunk] = []
    held = ""
    for c in out:
        if not c.content.strip() and c is not out[-1]:
            held += c.content
        else:
            glued.append(replace(c, content=held + c.content))
            held = ""
    return glued
