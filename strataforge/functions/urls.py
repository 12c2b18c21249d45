"""URLs as column expressions: normal form, scope, include and exclude patterns, media types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query with `?`, 5 fragment with `#`; '' where missing."""
    return F.regexp_extract(url, URL, i)


def host(url: Column) -> Column:
    """Host in lower case with a port that is not the scheme's own, without a trailing dot."""
    h = F.regexp_replace(F.lower(part(url, 2)), r"^.*@", "")
    h = F.when(F.lower(part(url, 1)) == "https", F.regexp_replace(h, ":443$", "")).when(F.lower(part(url, 1)) == "http", F.regexp_replace(h, ":80$", "")).otherwise(h)
    return F.regexp_replace(h, r"\.(:\d+)?$", "$1")


def path(url: Column) -> Column:
    p = part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def normalize(url: Column, ignore_case: bool = True, remove_hash: bool = True, remove_slash: bool = True, remove_query: bool = False, remove_index: bool = True) -> Column:
    """The identity of a page. Index files, last slashes, the fragment and letter case do not count by default; the query does.

    Null stays null; what is no absolute URL comes back unchanged. Dot segments are not resolved: crawled links are absolute already.
    """
    p = path(url)
    if remove_index:
        p = F.regexp_replace(p, r"(?i)/index\.(html|htm|asp|php|jsp)$", "/")
    if remove_slash:
        p = F.regexp_replace(p, r"/+$", "")
        p = F.when(p == "", "/").otherwise(p)
    out = F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), p)
    if not remove_query:
        out = F.concat(out, F.when(part(url, 4) == "?", "").otherwise(part(url, 4)))
    if not remove_hash:
        out = F.concat(out, F.when(part(url, 5) == "#", "").otherwise(part(url, 5)))
    return F.when(url.rlike(URL), F.lower(out) if ignore_case else out).otherwise(url)


def base_directory(p: Column) -> Column:
    """The directory a path stands for: itself if it ends with a slash, the parent of an index file, else the path as a directory."""
    last = F.regexp_extract(p, r"([^/]*)$", 1)
    return F.when((p == "") | (p == "/"), "/").when(p.endswith("/"), p).when(last.rlike(r"(?i)^index(\.[a-z0-9]+)?$"), F.regexp_replace(p, r"/[^/]*$", "/")).otherwise(F.concat(p, F.lit("/")))


#: Public suffixes of more than one label that are common among documentation hosts; others count as one label.
LONG_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.cn com.tw com.mx com.tr co.kr co.in co.za com.sg com.hk github.io gitlab.io readthedocs.io "
    "netlify.app vercel.app pages.dev web.app herokuapp.com blogspot.com"
).split()


def registrable_domain(h: Column) -> Column:
    """The public suffix and one label before it; addresses and bare hosts as they are."""
    bare = F.regexp_replace(h, r":\d+$", "")
    long = F.regexp_extract(bare, r"([^.]+\.(?:" + "|".join(re.escape(s) for s in LONG_SUFFIXES) + r"))$", 1)
    return F.when(bare.rlike(r"^\d+\.\d+\.\d+\.\d+$") | ~bare.contains("."), bare).when(long != "", long).when(bare.isin(*LONG_SUFFIXES), bare).otherwise(F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1))


def in_scope(base: Column, target: Column, scope: str) -> Column:
    """Whether target lies in the crawl scope of base: `subpages`, `hostname` or `domain`; the scheme must agree. Null if either is null."""
    same = F.lower(part(base, 1)) == F.lower(part(target, 1))
    if scope == "subpages":
        return same & (host(base) == host(target)) & F.startswith(path(target), base_directory(path(base)))
    if scope == "hostname":
        return same & (host(base) == host(target))
    if scope == "domain":
        return same & (registrable_domain(host(base)) == registrable_domain(host(target)))
    raise ValueError(f"unknown scope {scope}")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for a whole string: `*` and `?` stay within a path part, `**` spans parts, `{a,b}` and `[..]` work."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i) and i + 2 == len(pattern) and (i == 0 or pattern[i - 1] == "/"):
            return f"^{out}.*$"
        if c == "*":
            out += "[^/]*"
            while pattern.startswith("*", i + 1):
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "{" and "}" in pattern[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(url: Column, patterns: list[str]) -> Column:
    """Whether the full URL, or its path with query, matches a glob or a `/regex/`."""
    target = F.concat(path(url), part(url, 4))
    tests = []
    for p in patterns:
        if len(p) > 2 and p.startswith("/") and p.endswith("/"):
            tests += [url.rlike(p[1:-1]), target.rlike(p[1:-1])]
        else:
            r = glob_regex(p.removeprefix("/"))
            tests += [url.rlike(r), F.expr("true") & F.regexp_replace(target, "^/", "").rlike(r)]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


# What is left out where a user names no excludes.
DEFAULT_EXCLUDES = (
    "**/CHANGELOG.md **/changelog.md **/CHANGELOG.mdx **/changelog.mdx **/LICENSE **/LICENSE.md **/license.md **/CODE_OF_CONDUCT.md **/code_of_conduct.md "
    "**/*.test.* **/*.spec.* **/*_test.py **/*_test.go **/*.lock **/package-lock.json **/yarn.lock **/pnpm-lock.yaml **/go.sum **/*.min.js **/*.min.css **/*.map **/*.d.ts "
    "**/.DS_Store **/Thumbs.db **/*.swp **/*.swo /.*\\.(ini|cfg|conf|log|pid)$/ "
    "**/archive/** **/archived/** **/deprecated/** **/legacy/** **/old/** **/outdated/** **/previous/** **/superseded/** docs/old/** **/test/** **/tests/** **/__tests__/** **/spec/** "
    "**/dist/** **/build/** **/out/** **/target/** **/.next/** **/.nuxt/** **/.vscode/** **/.idea/** "
    "**/i18n/ar*/** **/i18n/de*/** **/i18n/es*/** **/i18n/fr*/** **/i18n/hi*/** **/i18n/it*/** **/i18n/ja*/** **/i18n/ko*/** **/i18n/nl*/** **/i18n/pl*/** **/i18n/pt*/** **/i18n/ru*/** "
    "**/i18n/sv*/** **/i18n/th*/** **/i18n/tr*/** **/i18n/vi*/** **/i18n/zh*/** **/zh-cn/** **/zh-hk/** **/zh-mo/** **/zh-sg/** **/zh-tw/**"
).split()


def admitted(url: Column, includes: list[str] | None = None, excludes: list[str] | None = None) -> Column:
    """Excludes win; no includes admit everything; a user's excludes replace the default ones."""
    out = ~matches_any(url, DEFAULT_EXCLUDES if excludes is None else excludes)
    return out & matches_any(url, includes) if includes else out


# Media types by file name extension.
MIME = {
    "ts": "text/x-typescript",
    "mts": "text/x-typescript",
    "cts": "text/x-typescript",
    "tsx": "text/x-tsx",
    "js": "text/javascript",
    "cjs": "text/javascript",
    "mjs": "text/javascript",
    "jsx": "text/x-jsx",
    "py": "text/x-python",
    "pyw": "text/x-python",
    "pyi": "text/x-python",
    "pyx": "text/x-cython",
    "pxd": "text/x-cython",
    "go": "text/x-go",
    "rs": "text/x-rust",
    "c": "text/x-csrc",
    "h": "text/x-chdr",
    "cpp": "text/x-c++src",
    "cxx": "text/x-c++src",
    "cc": "text/x-c++src",
    "hpp": "text/x-c++hdr",
    "hxx": "text/x-c++hdr",
    "zig": "text/x-zig",
    "nim": "text/x-nim",
    "v": "text/x-v",
    "cr": "text/x-crystal",
    "java": "text/x-java",
    "kt": "text/x-kotlin",
    "kts": "text/x-kotlin",
    "scala": "text/x-scala",
    "groovy": "text/x-groovy",
    "gradle": "text/x-gradle",
    "swift": "text/x-swift",
    "dart": "text/x-dart",
    "rb": "text/x-ruby",
    "rake": "text/x-ruby",
    "php": "text/x-php",
    "lua": "text/x-lua",
    "pl": "text/x-perl",
    "pm": "text/x-perl",
    "r": "text/x-r",
    "hs": "text/x-haskell",
    "lhs": "text/x-haskell",
    "elm": "text/x-elm",
    "erl": "text/x-erlang",
    "ex": "text/x-elixir",
    "exs": "text/x-elixir",
    "clj": "text/x-clojure",
    "cljs": "text/x-clojure",
    "cljc": "text/x-clojure",
    "jl": "text/x-julia",
    "cs": "text/x-csharp",
    "sol": "text/x-solidity",
    "move": "text/x-move",
    "cairo": "text/x-cairo",
    "vue": "text/x-vue",
    "svelte": "text/x-svelte",
    "astro": "text/x-astro",
    "sh": "text/x-shellscript",
    "bash": "text/x-shellscript",
    "zsh": "text/x-shellscript",
    "fish": "text/x-shellscript",
    "ps1": "text/x-powershell",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "mkd": "text/markdown",
    "mkdn": "text/markdown",
    "mkdown": "text/markdown",
    "mdown": "text/markdown",
    "mdwn": "text/markdown",
    "ronn": "text/markdown",
    "mdx": "text/mdx",
    "gfm": "text/x-gfm",
    "rst": "text/x-rst",
    "adoc": "text/x-asciidoc",
    "asciidoc": "text/x-asciidoc",
    "textile": "text/x-textile",
    "org": "text/x-org",
    "pod": "text/x-pod",
    "rdoc": "text/x-rdoc",
    "wiki": "text/x-wiki",
    "rmd": "text/x-rmarkdown",
    "toml": "text/x-toml",
    "ini": "text/x-ini",
    "cfg": "text/x-ini",
    "conf": "text/x-conf",
    "properties": "text/x-properties",
    "env": "text/x-dotenv",
    "dockerfile": "text/x-dockerfile",
    "containerfile": "text/x-dockerfile",
    "makefile": "text/x-makefile",
    "cmake": "text/x-cmake",
    "bazel": "text/x-bazel",
    "bzl": "text/x-bazel",
    "buck": "text/x-buck",
    "tf": "text/x-terraform",
    "tfvars": "text/x-terraform",
    "hcl": "text/x-hcl",
    "sql": "text/x-sql",
    "graphql": "text/x-graphql",
    "gql": "text/x-graphql",
    "proto": "text/x-proto",
    "prisma": "text/x-prisma",
    "thrift": "text/x-thrift",
    "avro": "text/x-avro",
    "tex": "text/x-tex",
    "latex": "text/x-tex",
    "doc": "application/msword",
    "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint",
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "rtf": "application/rtf",
    "epub": "application/epub+zip",
    "fb2": "application/x-fictionbook+xml",
    "html": "text/html",
    "htm": "text/html",
    "xhtml": "application/xhtml+xml",
    "json": "application/json",
    "txt": "text/plain",
    "text": "text/plain",
    "log": "text/plain",
    "css": "text/css",
    "csv": "text/csv",
    "yaml": "text/yaml",
    "yml": "text/yaml",
    "xml": "application/xml",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "gz": "application/gzip",
    "tgz": "application/gzip",
    "tar": "application/x-tar",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ipynb": "application/x-ipynb+json",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "svg": "image/svg+xml",
}


def extension(p: Column) -> Column:
    clean = F.lower(F.regexp_replace(p, r"[?#].*$", ""))
    return F.regexp_extract(clean, r"\.([^./]+)$", 1)


def mime_from_path(p: Column) -> Column:
    """The media type told by the extension; null where it tells none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), extension(p))


def content_type(header: Column) -> tuple[Column, Column]:
    """Media type and charset of a Content-Type header; an empty one is `application/octet-stream`."""
    mime = F.lower(F.trim(F.regexp_extract(header, r"^([^;]*)", 1)))
    charset = F.lower(F.trim(F.regexp_extract(header, r"(?i);\s*charset=([^;]*)", 1)))
    empty = F.coalesce(header, F.lit("")) == ""
    return F.when(empty, "application/octet-stream").otherwise(mime), F.when(~empty & (charset != ""), charset)


def pipeline(mime: Column) -> Column:
    """Which content pipeline takes a media type, first match: json, code, document, html, markdown, text; null if none does."""
    m = F.lower(mime)
    prose = ["text/x-rst", "text/x-asciidoc", "text/x-textile", "text/x-org", "text/x-pod", "text/x-rdoc", "text/x-wiki"]
    return (
        F.when(m.rlike(r"^(application/json|text/json|text/x-json)$|\+json$") & (m != "application/x-ipynb+json"), "json")
        .when((m.startswith("text/x-") & ~m.isin(*prose, "text/x-gfm", "text/x-rmarkdown", "text/x-markdown")) | m.isin("text/javascript", "application/javascript", "application/typescript"), "code")
        .when(m.rlike(r"^application/(pdf|msword|rtf|epub|vnd\.(ms-|oasis|openxmlformats)|x-ipynb|x-fictionbook)"), "document")
        .when(m.isin("text/html", "application/xhtml+xml"), "html")
        .when(m.isin("text/markdown", "text/x-markdown", "text/mdx", "text/x-gfm", "text/x-rmarkdown"), "markdown")
        .when(m.startswith("text/") | m.isin("application/xml", "application/yaml", "application/toml"), "text")
    )
