"""Embedding requests, documents, access, settings, manifests."""

import http.server
import io
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from strataforge import config
from strataforge.functions import documents
from strataforge.operators import embedding, manifest, pipeline
from strataforge.sources import web
from strataforge import session
from strataforge.sources.access import AccessDenied, AccessPolicy
from strataforge.streaming import events


def test_requests_and_halving():
    assert [len(r) for r in embedding.requests(["x" * 10] * 25, 10, 95)] == [9, 9, 7]
    assert [len(r) for r in embedding.requests(["x" * 200, "y"], 10, 95)] == [1, 1] and list(embedding.requests([])) == []
    calls = []

    def small(texts):
        calls.append(len(texts))
        if sum(map(len, texts)) > 12:
            raise embedding.TooLarge
        return [[float(len(t))] for t in texts]

    assert embedding.embed_safely(small, ["abc"] * 8 + ["x" * 20]) == [[3.0]] * 8 + [[10.0]]
    with pytest.raises(embedding.TooLarge):
        embedding.embed_safely(small, ["x" * 60])


def test_embedding_column(spark):
    df = spark.createDataFrame([(1, "alpha beta", ["p", "q"]), (2, None, None), (3, "", []), (4, "alpha beta", None)], "id int, t string, path array<string>")
    out = {r.id: r.e for r in embedding.embed_column(df, "t", "e", 64).collect()}
    assert out[1] == out[4] and len(out[1]) == 64 and out[2] is None and sum(out[3]) == 0 and sum(x * x for x in out[1]) == pytest.approx(1, abs=1e-5)
    text = df.select(embedding.embedding_text(F.lit("T"), F.lit("u"), F.col("path"), F.col("t"))).first()[0]
    assert text == "<title>T</title>\n<url>u</url>\n<path>p / q</path>\nalpha beta"
    assert embedding.fit([1.0], 3) == [1.0, 0.0, 0.0] and embedding.fit([1.0, 2.0], 1, truncate=True) == [1.0]
    assert embedding.check_model({}, "m", 3) and not embedding.check_model({"embedding_model": "m", "embedding_dimension": "4"}, "m", 3)
    assert embedding.invalidate(df.withColumn("embedding", F.array(F.lit(1.0)))).where("embedding is null").count() == 4


def archive(**parts):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for name, body in parts.items():
            f.writestr(name.replace("__", "/"), body)
    return z.getvalue()


def test_documents():
    w = 'xmlns:w="urn:w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert documents.to_markdown("x.DOCX", archive(**{"word__document.xml": doc})) == "## Head\n\nBody\n\n| a |  |\n| --- | --- |"
    sheet = '<worksheet xmlns="urn:s"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns="urn:s"><sheets><sheet name="First"/></sheets></workbook>'
    parts = {"xl__workbook.xml": book, "xl__worksheets__sheet1.xml": sheet, "xl__sharedStrings.xml": '<sst xmlns="urn:s"><si><t>k</t></si></sst>'}
    assert documents.to_markdown("x.xlsx", archive(**parts)) == "# First\n\n| k |  | 5 |\n| --- | --- | --- |"
    slide = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:sld>'
    assert documents.to_markdown("x.pptx", archive(**{"ppt__slides__slide1.xml": slide})) == "## Slide 1\n\nHi"
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "x = 1"}]}).encode()
    assert documents.to_markdown("n.ipynb", nb) == "# T\n\n```python\nx = 1\n```"
    assert documents.to_markdown("b.epub", archive(**{"OEBPS__a.xhtml": "<h1>C</h1><p>t</p>"})) == "# C\n\nt"
    assert documents.to_markdown("x.docx", b"broken") is None and documents.to_markdown("x.pdf", b"") is None


def test_access():
    AccessPolicy().check("https://public.example/a", ("8.8.8.8",))
    for url, addresses in (("http://127.0.0.1/", ()), ("http://localhost/", ()), ("https://x.example/", ("8.8.8.8", "10.0.0.1")), ("ftp://x/", ()), ("file:///etc/passwd", ()), ("http://[::1]/", ())):
        with pytest.raises(AccessDenied):
            AccessPolicy().check(url, addresses)
    p = AccessPolicy(allowlist=True, hosts=("*.docs.example",), networks=("10.1.0.0/16",), roots=("/data",))
    p.check("https://a.docs.example/", ("10.9.9.9",))
    p.check("http://10.1.2.3/")
    p.check("file:///data/x%20y/z.md")
    for url in ("https://other.example/", "http://8.8.8.8/", "file:///data/../etc/x"):
        with pytest.raises(AccessDenied):
            p.check(url)


def test_access_of_names():
    with pytest.raises(AccessDenied):
        AccessPolicy().admit("https://inner.example/", lambda h: ("10.0.0.7",))
    with pytest.raises(AccessDenied):
        AccessPolicy().admit("https://unknown.example/", lambda h: ())
    AccessPolicy().admit("https://public.example/", lambda h: ("8.8.8.8", "2001:4860:4860::8888"))


def test_checkpoint_folder():
    assert session.checkpoint_folder("file:///shared", "spark://h:7077") == "file:///shared" and session.checkpoint_folder(None, "local[8]")
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session.checkpoint_folder(None, master)


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"max_pages": 5, "chunk_max": 9}')
    s = config.load(str(f), {"STRATAFORGE_CHUNK_MAX": "7"}, max_depth=1)
    assert (s.max_pages, s.chunk_max, s.max_depth, s.chunk_min) == (5, 7, 1, 500)
    with pytest.raises(ValueError, match="unknown"):
        config.load(None, {}, odd=1)


def test_manifest(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{root}/v0/pages")
    steps = [lambda t: {"pages": t["pages"].withColumn("depth", F.lit(0))}, lambda t: {"pages": t["pages"].withColumn("kind", F.lit("x"))}]
    assert manifest.migrate(spark, root, steps[:1], ["pages"]) == 1
    assert manifest.migrate(spark, root, steps, ["pages"]) == 2 and manifest.migrate(spark, root, steps, ["pages"]) == 2
    assert spark.read.parquet(f"{root}/v2/pages").columns == ["id", "depth", "kind"] and manifest.read(spark, root)["version"] == "2"


def test_stream_windows_and_late_rows(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:00:00", i % 2, "view", 1.0, "{}") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    got = events.drain(events.tumbling_counts(events.read_events(spark, str(tmp_path / "events")), late="9 days"), ["w", "event_type"])
    assert sorted(r.n for r in got.collect()) == [4, 4, 4]
    slid = events.drain(events.sliding_users(events.read_events(spark, str(tmp_path / "events")), late="9 days"), ["w"])
    assert sum(r.n for r in slid.collect()) == 24


PAGES = {
    "/page": ("text/html; charset=latin-1", "<html><body><h1>Über</h1><p>Some <b>text</b> of it.</p><a href='/ok'>next</a></body></html>".encode("latin-1")),
    "/book.ipynb": ("application/octet-stream", json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Notes\n", "Read on."]}], "metadata": {}}).encode()),
}


class Handler(http.server.BaseHTTPRequestHandler):
    tries: dict[str, int] = {}

    def do_GET(self):
        n = self.tries[self.path] = self.tries.get(self.path, 0) + 1
        code = {"/ok": 200, "/gone": 404, "/flaky": 503 if n < 3 else 200, "/bad": 500, "/no": 403, **dict.fromkeys(PAGES, 200)}.get(self.path, 404)
        if self.headers.get("If-None-Match") == '"t"':
            code = 304
        if self.path == "/away":
            self.send_response(302)
            self.send_header("Location", "http://localhost:9/secret" if n % 2 else "/ok")
            self.end_headers()
            return
        self.send_response(code)
        self.send_header("ETag", '"t"')
        kind, body = PAGES.get(self.path, ("text/plain", b"hello"))
        self.send_header("Content-Type", kind)
        self.end_headers()
        if code == 200:
            self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(spark, server):
    open_ = web.FetchOptions(base_delay=0, policy=AccessPolicy(private=True))
    get = lambda p, tag=None: web.fetch(server + p, tag, open_, sleep=lambda s: None)
    assert get("/ok")[1] == 200 and get("/ok")[6] == b"hello" and get("/ok", '"t"')[1] == 304 and get("/gone")[1] == 404
    assert get("/flaky")[1] == 200 and get("/bad")[1] == 500 and get("/bad")[7] and get("/no")[1] == 403
    assert Handler.tries["/no"] == 1 and Handler.tries["/bad"] == 8
    assert web.fetch(server + "/ok")[7] == "access denied"
    # The first redirect leads to a host the policy does not admit, the second to one it does.
    narrow = web.FetchOptions(base_delay=0, policy=AccessPolicy(networks=("127.0.0.1/32",)))
    away = [web.fetch(server + "/away", None, narrow, sleep=lambda s: None, resolve=lambda h: ("127.0.0.1",) if h == "127.0.0.1" else ("10.0.0.1",)) for _ in range(2)]
    assert away[0][7] == "access denied" and away[0][6] is None and away[1][1] == 200 and away[1][6] == b"hello"
    web.register(spark)
    df = spark.read.format("webpages").option("urls", json.dumps([server + "/ok", server + "/gone", server + "/ok"])).option("private", "true").option("partitions", "2").load()
    assert sorted(r.status for r in df.collect()) == [200, 404]
    front = spark.createDataFrame([(server + "/ok", '"t"'), (server + "/ok", None), (None, None)], "url string, etag string")
    assert [r.status for r in web.fetch_pages(front, open_, 2).collect()] == [304]


def test_fetched_documents(spark, server):
    front = spark.createDataFrame([(server + p, None) for p in ("/page", "/book.ipynb", "/gone", "/ok")], "url string, etag string")
    got = {r.url[len(server) :]: r for r in web.fetched_documents(front, web.FetchOptions(base_delay=0, policy=AccessPolicy(private=True)), 2).collect()}
    assert len(got) == 4 and got["/gone"].status == 404 and got["/gone"].text is None and got["/ok"].text == "hello"
    assert "Über" in got["/page"].text and "**text**" in got["/page"].text and got["/page"].links == [server + "/ok"] and got["/page"].chunks
    assert got["/book.ipynb"].title == "Notes" and "Read on." in got["/book.ipynb"].text


def test_source_kinds_and_trees(spark):
    df = spark.createDataFrame([("file:///a",), ("https://www.npmjs.com/x",), ("https://pypi.org/p",), ("https://github.com/o/r",), ("http://h.example/",), ("ftp://h/",), (None,)], "u string")
    assert [r[0] for r in df.select(web.source_kind(F.col("u"))).collect()] == ["file", "npm", "pypi", "repository", "web", None, None]
    tree = [("docs/a.md", "blob"), ("docs/old/b.md", "blob"), ("src/x.py", "blob"), ("docs/i.png", "blob"), ("docs", "tree"), ("README", "blob"), ("docs2/c.md", "blob"), ("docs/d.docx", "blob")]
    t = spark.createDataFrame(tree, "path string, kind string")
    assert {r.path for r in web.admitted_files(t, "path", "kind").collect()} == {"docs/a.md", "src/x.py", "README", "docs2/c.md", "docs/d.docx"}
    assert {r.path for r in web.admitted_files(t, "path", "kind", "/docs/", excludes=[]).collect()} == {"docs/a.md", "docs/old/b.md", "docs/d.docx"}


def test_pipelines(spark):
    rows = [(1, "u", "application/json; charset=utf-8", '{"name": "N", "a": [1]}'), (2, "https://h/x.py", "text/x-python", "def f():\n    pass\n"), (3, "https://h/", "text/html", "<h1>T</h1><p>x <a href='y'>l</a></p>"), (4, "u", "text/markdown", "# M\n\n[a](b)\n\n[r]: c"), (5, "u", "text/plain", "plain"), (6, "u", "image/png", "no"), (7, "u", "text/html", None), (8, "u", "application/json", "{broken")]
    df = spark.createDataFrame(rows, "k int, url string, mime string, body string").withColumn("title", F.lit("clash"))
    got = {r.item_id: r for r in pipeline.processed(df, "k", "url", "mime", "body").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8} and [got[i].title for i in (1, 2, 3, 4, 5)] == ["N", "x.py", "T", "M", "Untitled"]
    assert got[3].links == ["https://h/y"] and got[4].links == ["b", "c"] and got[8].errors and got[8].chunks[0].content == "{broken" and got[2].chunks[0].path == ["f"]
