"""Files, archives and link lists as DataFrames."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, etag, mime, content (binary) of all files below `root`, hidden ones left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    shown = ~F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/").rlike(r"/\.[^/]+")
    tag = F.md5(F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").cast("binary"))
    return raw.where(shown).select("path", F.col("modificationTime").alias("modified"), tag.alias("etag"), urls.mime_from_path(F.col("path")).alias("mime"), "content")


def members(path: str, content: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(name, size, content) of the files in a zip, tar, tgz or gz archive; absolute and `..` names are skipped, and what is no archive gives none."""
    safe = lambda n: not n.startswith("/") and ".." not in n.split("/")
    try:
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from ((i.filename, i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir() and safe(i.filename))
        elif re.search(r"\.(tar|tgz|tar\.gz)$", path.lower()):
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                yield from ((m.name, m.size, t.extractfile(m).read()) for m in t if m.isfile() and safe(m.name))
        elif path.lower().endswith(".gz"):
            body = gzip.decompress(content)
            yield path.rsplit("/", 1)[-1][:-3], len(body), body
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError):
        return


def unpack(files: DataFrame) -> DataFrame:
    """path (archive/member), size, mime, content of the members of archives among `files` (path, content)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(f"{p}/{n}", s, b) for n, s, b in members(p, bytes(c))]
                yield pd.DataFrame(rows, columns=["path", "size", "content"])

    archive = F.lower("path").rlike(r"\.(zip|tar|tgz|gz)$")
    out = files.where(archive).select("path", "content").mapInPandas(run, "path string, size bigint, content binary")
    return out.withColumn("mime", urls.mime_from_path(F.col("path")))


_ITEM = re.compile(r"^\s*[-*]\s*\[([^\]]+)\]\(([^)\s]+)\)(?:\s*:\s*(.*))?$")


def parse_link_list(text: str | None) -> tuple[str | None, list[tuple[str, str, str, str, bool]]]:
    """Title and (section, name, url, note, optional) of a curated link list in Markdown; no links without a top heading."""
    title, section, out = None, "", []
    for line in (text or "").splitlines():
        if m := re.match(r"^#\s+(.+?)\s*$", line):
            title = title or m[1]
        elif m := re.match(r"^##\s+(.+?)\s*$", line):
            section = m[1]
        elif title and (m := _ITEM.match(line)):
            out.append((section, m[1].strip(), m[2], (m[3] or "").strip(), section.lower() == "optional"))
    return title, out if title else []


def link_lists(df: DataFrame, text: str) -> DataFrame:
    """`df` with its list's links exploded: title, section, name, link, note, optional, which replace columns of these names."""

    @F.udf("struct<title:string,links:array<struct<section:string,name:string,link:string,note:string,optional:boolean>>>")
    def parse(t: str | None):
        return parse_link_list(t)

    kept = [c for c in df.columns if c not in ("title", "section", "name", "link", "note", "optional")]
    p = df.withColumn("_p", parse(F.col(text)))
    return p.select(*kept, F.col("_p.title").alias("title"), F.explode("_p.links").alias("_l")).select(*kept, "title", "_l.*")


def decode(content: bytes, header_charset: str | None = None) -> str:
    """Text of a page: the charset its first 1024 characters state, else the header's, else UTF-8; what does not decode is read as Latin-1."""
    head = content[:1024].decode("latin-1")
    m = re.search(r"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", head, re.I)
    for name in (m and m[1], header_charset, "utf-8"):
        if name:
            try:
                return content.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
    return content.decode("latin-1")
