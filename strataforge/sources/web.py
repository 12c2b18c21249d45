"""Pages over HTTP: as a Spark data source for a list of URLs, and as an operator on a frontier DataFrame."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import documents, urls
from ..operators import pipeline
from ..session import cut_lineage
from . import files
from .access import AccessDenied, AccessPolicy, resolved

#: Answers that are worth another try.
RETRIED = frozenset({408, 429, 500, 502, 503, 504, 525})
SCHEMA = "url string, status int, final_url string, etag string, last_modified string, content_type string, content binary, error string"


@dataclass(frozen=True)
class FetchOptions:
    retries: int = 3
    base_delay: float = 0.5
    timeout: float = 30.0
    agent: str = "strataforge"
    policy: AccessPolicy = AccessPolicy()


class _Checked(urllib.request.HTTPRedirectHandler):
    """Follows a redirect only where the policy admits its target."""

    def __init__(self, policy: AccessPolicy, resolve: Callable[[str], tuple[str, ...]]):
        self.policy, self.resolve = policy, resolve

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.policy.admit(newurl, self.resolve)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str, etag: str | None = None, options: FetchOptions = FetchOptions(), sleep: Callable[[float], None] = time.sleep, resolve: Callable[[str], tuple[str, ...]] = resolved) -> tuple:
    """A row of SCHEMA; the policy is asked of the URL and of every redirect, with the addresses their hosts resolve to: 200 with content, 304 for an unchanged tag, 404; any other failure has its error and, if there was one, its status."""
    try:
        options.policy.admit(url, resolve)
    except (AccessDenied, ValueError):
        return (url, None, None, None, None, None, None, "access denied")
    headers = {"User-Agent": options.agent} | ({"If-None-Match": etag} if etag else {})
    opener = urllib.request.build_opener(_Checked(options.policy, resolve))
    status, error = None, None
    for attempt in range(options.retries + 1):
        try:
            with opener.open(urllib.request.Request(url, headers=headers), timeout=options.timeout) as r:
                h = r.headers
                return (url, r.status, r.url, h.get("ETag"), h.get("Last-Modified"), h.get("Content-Type"), r.read(), None)
        except AccessDenied:
            return (url, None, None, None, None, None, None, "access denied")
        except urllib.error.HTTPError as e:
            status, error = e.code, str(e.reason)
            if e.code in (304, 404):
                return (url, e.code, e.url, e.headers.get("ETag") or etag, None, None, None, None)
            if e.code not in RETRIED:
                break
        except (OSError, ValueError) as e:
            status, error = None, f"{type(e).__name__}: {e}"
        if attempt < options.retries:
            sleep(options.base_delay * 2**attempt)
    return (url, status, None, None, None, None, None, error)


def fetched_documents(frontier: DataFrame, options: FetchOptions = FetchOptions(), parallel: int = 32) -> DataFrame:
    """(url, status, error, title, text, links, chunks, errors) of `frontier` (url, etag): each URL fetched, decoded and taken through the pipeline of its media type.

    Office documents and notebooks become Markdown first. A page that did not come or that no pipeline takes has nulls from `title` on.
    """
    pages = cut_lineage(fetch_pages(frontier, options, parallel))  # a page is fetched once, whatever reads it
    told, charset = urls.content_type(F.col("content_type"))
    name = F.coalesce("final_url", "url")
    mime = F.when(told.isin("application/octet-stream", "text/plain"), F.coalesce(urls.mime_from_path(name), told)).otherwise(told)

    @F.pandas_udf("string")
    def text_of(content: pd.Series, header: pd.Series, kind: pd.Series, url: pd.Series) -> pd.Series:
        out = []
        for c, h, k, u in zip(content, header, kind, url, strict=True):
            out.append(documents.to_markdown(re.sub(r"[?#].*", "", u), bytes(c)) if k == "document" else files.decode(bytes(c), h))
        return pd.Series(out, dtype=object)

    got = pages.where("content is not null").select("url", name.alias("at"), mime.alias("mime"), charset.alias("charset"), urls.pipeline(mime).alias("kind"), "content")
    read = got.select("url", "at", F.when(F.col("kind") == "document", "text/markdown").otherwise(F.col("mime")).alias("mime"), text_of("content", "charset", "kind", "at").alias("text"))
    return pages.select("url", "status", "error").join(pipeline.processed(read, "url", "at", "mime", "text").withColumnRenamed("item_id", "url"), "url", "left")


def fetch_pages(frontier: DataFrame, options: FetchOptions = FetchOptions(), parallel: int = 32) -> DataFrame:
    """Fetch `frontier` (url, etag): each URL once, spread over `parallel` tasks, which is how many requests run at a time."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in it:
            for lo in range(0, len(pdf), 64):  # a few dozen pages are held at a time
                part = pdf.iloc[lo : lo + 64]
                yield pd.DataFrame([fetch(u, e, options) for u, e in zip(part["url"], part["etag"], strict=True)], columns=columns).astype({"status": "Int32"})

    rows = frontier.where("url is not null").groupBy("url").agg(F.max("etag").alias("etag"))
    return rows.repartition(parallel, "url").mapInPandas(run, SCHEMA)


class _Part(InputPartition):
    def __init__(self, wanted: list[str]):
        self.wanted = wanted


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.wanted = list(dict.fromkeys(json.loads(options.get("urls", "[]"))))
        self.parts = int(options.get("partitions", "8"))
        allowed = tuple(x for x in options.get("hosts", "").split(",") if x)
        self.options = FetchOptions(retries=int(options.get("retries", "3")), timeout=float(options.get("timeout", "30")), policy=AccessPolicy(hosts=allowed, private=options.get("private", "false") == "true"))

    def partitions(self) -> list[_Part]:
        return [_Part(self.wanted[i :: self.parts]) for i in range(self.parts) if self.wanted[i :: self.parts]]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return (fetch(u, None, self.options) for u in partition.wanted)


class WebPages(DataSource):
    """spark.read.format("webpages").option("urls", '["https://..."]').load()"""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)


def source_kind(url: Column) -> Column:
    """Which kind of source a URL is: file, npm, pypi, repository or web; null for others."""
    host, scheme = urls.host(url), F.lower(urls.part(url, 1))
    http = scheme.isin("http", "https")
    return (
        F.when(scheme == "file", "file")
        .when(http & host.isin("npmjs.com", "www.npmjs.com", "npmjs.org", "www.npmjs.org"), "npm")
        .when(http & host.isin("pypi.org", "www.pypi.org"), "pypi")
        .when(http & host.isin("github.com", "www.github.com"), "repository")
        .when(http, "web")
    )


#: Names of text files that have no telling extension.
COMMON_FILES = "readme license changelog contributing authors maintainers makefile dockerfile gemfile rakefile procfile vagrantfile notice security".split()


def admitted_files(tree: DataFrame, path: str, kind: str, below: str = "", includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """The text and document files of a repository tree (rows with `kind` 'blob') below a folder, by the URL patterns."""
    p, low = F.col(path), F.lower(F.col(path))
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    mime = urls.mime_from_path(p)
    known = mime.startswith("text/") | mime.rlike(r"json|yaml|xml|msword|officedocument|opendocument|epub|rtf|pdf|ipynb") | low.contains(".env.") | low.endswith(".env") | low.contains(".config.") | low.contains(".lock")
    common = F.regexp_extract(name, r"^([^.]*)", 1).isin(*COMMON_FILES)
    root = below.strip("/")
    inside = F.lit(True) if not root else (F.regexp_replace(p, "^/+|/+$", "") == root) | F.regexp_replace(p, "^/+", "").startswith(root + "/")
    address = F.concat(F.lit("repo://tree/"), F.regexp_replace(p, "^/+", ""))
    return tree.where((F.col(kind) == "blob") & (F.coalesce(known, F.lit(False)) | common) & inside & urls.admitted(address, includes, excludes))
