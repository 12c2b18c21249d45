"""Pure functions: versions, full text, splitters, HTML, globs, archives, link lists."""

import ast
import gzip
import io
import json
import re
import sqlite3
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.functions import fulltext, html, splitting, urls, versions
from strataforge.operators import chunking, evaluation, expand, merge, search, transform
from strataforge.sources import crawl, files


# --- versions
@pytest.mark.parametrize(
    ("target", "found"),
    [(None, "2.1.0"), ("latest", "2.1.0"), ("1", "1.10.0"), ("1.2", "1.2.9"), ("1.x", "1.10.0"), ("1.2.5", "1.2.3"), ("3.0.0", "2.1.0"), ("0.1.0", None), ("2.1.0-rc.1", "2.1.0-rc.1"), ("odd", None), ("2.0", None)],
)
def test_best_version(target, found):
    assert versions.best(["1.2.3", "1.2.9", "1.10.0", "2.1.0", "2.1.0-rc.1", None, "", "edge"], target) == found


def test_version_order():
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0"]
    parsed = [versions.parse(v) for v in order]
    assert sorted(reversed(parsed)) == parsed
    assert versions.coerce("v2.4") == versions.Version(2, 4, 0) and versions.coerce("none") is None


# --- full text
STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "formalize": "formal", "electrical": "electr", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controlling": "control", "rolling": "roll"}


def test_porter_agrees_with_an_embedded_index():
    words = sorted(STEMS) + "running configuration indexes retrieval documents tables splitting ranked queries generously oscillators happily sky skies dying hissing falling failing sized troubled".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(w, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, w) values (?, ?)", list(enumerate(words, 1)))
    stems = {doc: term for term, doc in db.execute("select term, doc from v")}
    assert {w: fulltext.porter(w) for w in words} == {w: stems[i] for i, w in enumerate(words, 1)}
    assert all(fulltext.porter(k) == v for k, v in STEMS.items())


@pytest.mark.parametrize(
    ("query", "phrases"),
    [("", []), ("one", ["one"]), ("a b", ["a b", "a", "b"]), ('"a b" c', ["a b c", "a b", "c"]), ('open "quote here', ["open quote here", "open", "quote here"]), ('x""y', ["x y", "x", "y"]), ("  ", []), ('foo"bar baz"', ["foo bar baz", "foo", "bar baz"]), ('"a b"c', ["a b c", "a b", "c"])],
)
def test_query_language(query, phrases):
    got = fulltext.parse_query(query)
    assert got == phrases
    assert fulltext.match_expression("") == '""'


def test_bm25_agrees_with_an_embedded_index(spark):
    docs = [(1, "alpha beta beta gamma", "first title", "u1 alpha", "p"), (2, "beta gamma delta", "second", "u2", "p q"), (3, "gamma gamma epsilon zeta", "third alpha", "u3", "r"), (4, "delta", "x", "u4", "s"), (5, "eta theta iota", "y", "u5", "t")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content, title, url, path)")
    db.executemany("insert into t(rowid, content, title, url, path) values (?,?,?,?,?)", docs)
    df = spark.createDataFrame(docs, "id bigint, content string, title string, url string, path string")
    df = df.unionByName(df.where("id = 1"))  # a re-delivered row
    index = search.occurrences(df, "id", search.WEIGHTS), search.lengths(df, "id", list(search.WEIGHTS))
    terms = ["alpha", "beta", "delta", "zeta"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(terms)] + [(9, "alpha"), (9, "gamma")], "query_id int, term string")
    got = {(r.query_id, r.id): r.score for r in search.bm25(*index, q, "id", None).collect()}
    for i, expr in [*enumerate(terms), (9, "alpha OR gamma")]:
        want = {rid: -s for rid, s in db.execute("select rowid, bm25(t, 10, 1, 5, 1) from t where t match ?", (expr,))}
        assert {k[1]: v for k, v in got.items() if k[0] == i} == pytest.approx(want, abs=1e-8)


# --- splitting
TEXT = st.text(alphabet=st.sampled_from("ab \n.#|-`>😀é1*"), max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(5, 60))
def test_forced_pieces_are_lossless_and_within_the_limit(text, limit):
    parts = splitting.forced(text, limit)
    assert "".join(parts) == text and all(splitting.units(p) <= limit for p in parts)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_fences_stay_balanced(text):
    for limit in (40, 120):
        for p in splitting.split_text(text, limit):
            assert not splitting.open_at_end(p) or splitting.open_at_end(text) or splitting.units(max(text.split(), key=len, default="")) > limit


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=25))
def test_json_pieces_give_the_document(value):
    chunks = splitting.split_json(json.dumps(value))
    assert json.loads("".join(c.content for c in chunks)) == value
    assert chunks[0].path == ("root",)


def test_json_falls_back_to_text():
    assert [c.types for c in splitting.split_json("{broken")] == [("text",)]
    assert all(c.types == ("text",) for c in splitting.split_json(json.dumps({str(i): i for i in range(2000)})))


MD = """---
title: T
---
# One

Intro text.

```py
x = 1

y = 2
```

## Two

- a
  - b
- c

| h | k |
|---|---|
| 1 | 2 |

> quote
> more

![i](u.png)

Under
-----
end"""


def test_markdown_structure():
    c = splitting.split_markdown(MD)
    assert [x.types[0] for x in c] == ["frontmatter", "heading", "text", "code", "heading", "list", "table", "blockquote", "media", "heading", "text"]
    assert c[3].path == ("One",) and c[5].path == ("One", "Two") and c[-1].path == ("One", "Under") and "y = 2" in c[3].content


def test_tables_and_code_repeat_their_frame():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | row |" for i in range(60))
    parts = splitting.split_table(table, 200)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|\n") and len(p) <= 200 for p in parts)
    code = "```js\n" + "\n".join(f"line {i}" for i in range(60)) + "\n```"
    parts = splitting.split_code(code, 120)
    assert all(p.startswith("```js\n") and p.endswith("\n```") and len(p) <= 120 for p in parts)
    assert "\n".join("\n".join(p.split("\n")[1:-1]) for p in parts) == "\n".join(code.split("\n")[1:-1])


def test_merge_rules():
    C = splitting.Chunk
    merged = splitting.merge_chunks([C(("heading",), "# A", 1, ("A",)), C(("text",), "x" * 600, 1, ("A",)), C(("heading",), "## B", 2, ("A", "B")), C(("heading",), "# C", 1, ("C",)), C(("text",), "y" * 4900, 1, ("C",))])
    assert [m.path for m in merged] == [("A", "B"), ("C",), ("C",)] or [m.path for m in merged] == [("A", "B"), ("C",)]
    assert all(splitting.units(m.content) <= 5000 for m in merged)
    small = splitting.merge_chunks([C(("text",), "a", 3, ("R", "S")), C(("code",), "b", 3, ("R", "T"))])
    assert small == [C(("text", "code"), "a\nb", 3, ("R",))]


PY = '''"""Doc."""
import os
import re

# about A
class A:
    x = 1

    def f(self):
        def inner():
            return 1
        return inner

    @property
    def g(self):
        return 2


async def h():
    pass
'''
TS = '''import a from "a";
import { b } from 'b';

/** Doc. */
export class Box {
  private size = 1;
  area(x: number): number {
    const s = "}{";
    return x;
  }
}

export const run = (x) => {
  const local = () => 1;
  return local();
};

interface Shape { side: number }
function plain() { return `}${1}`; }
'''


def test_source_pieces_are_lossless_with_paths():
    for text, language in ((PY, "python"), (TS, "typescript"), ("def broken(:", "python"), ("a\n\nb", "go")):
        assert "".join(c.content for c in splitting.split_source(text, language)) == text
    py = {c.path for c in splitting.split_source(PY, "python")}
    assert {("imports",), ("A",), ("A", "f"), ("A", "g"), ("h",)} <= py and ("A", "f", "inner") not in py
    ts = {c.path for c in splitting.split_source(TS, "typescript")}
    assert {("imports",), ("Box",), ("Box", "area"), ("run",), ("Shape",), ("plain",)} <= ts and ("run", "local") not in ts
    first = [c for c in splitting.split_source(PY, "python") if c.path == ("A",)][0]
    assert "structural" in first.types and first.content.lstrip().startswith("# about A")
    ast.parse(PY)


# --- HTML
def test_html_conversion():
    page = """<html><head><title> A  page </title><base href="/docs/"></head><body><nav>menu <a href="n">n</a></nav><h1>Hi <em>you</em></h1>
    <p>See <a href="x.html">the  x</a>, <a href="#t">top</a> and <code>a|b</code><br>next</p><img src="https://hotjar.com/p.gif"><ul><li>one<ul><li>in</li></ul></li><li>two</li></ul>
    <pre class="language-py"><code>a = 1\n  b</code></pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>a|b</td></tr></table><blockquote><p>q</p></blockquote><footer>f</footer></body></html>"""
    title, md, links, errors = html.convert(page, "https://s.example/a/b")
    assert title == "A page" and errors == [] and links == ["https://s.example/docs/n", "https://s.example/docs/x.html", "https://s.example/docs/#t"]
    assert "menu" not in md and "hotjar" not in md and md.startswith("# Hi _you_")
    assert "[the x](https://s.example/a/x.html)" in md and "top" in md and "`a|b`" in md
    assert "```py\na = 1\n  b\n```" in md and "| k | v |\n| --- | --- |\n| 1 | a\\|b |" in md and "> q" in md and "- one\n  - in\n- two" in md
    assert html.convert("<body><nav>only</nav></body>", "")[1] == "only"
    assert html.convert(None, "")[0] == "Untitled" and html.convert("<p>a<p>b", "")[1] == "a\n\nb"


@pytest.mark.parametrize(("selector", "yes"), [("a.x", True), ("b.x", False), ('[href*="EX" i]', True), ('[href*="EX"]', False), ("#i", True), ('[role="r"]', False), ('a[id^="i"]', True), ("a b", False)])
def test_selectors(selector, yes):
    assert html.matches(html.Node("a", {"class": "x y", "id": "i", "href": "https://ex"}), selector) is yes


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "<title>t</title><p>x</p>", "https://a.example/", "old"), (2, None, None, None)], "id int, html string, url string, title string")
    assert sorted((r.id, r.title, r.markdown) for r in transform.html_to_markdown(df, "html", "url").collect()) == [(1, "t", "x"), (2, "Untitled", "")]


def test_titles_and_links(spark):
    df = spark.createDataFrame([("---\ntitle: 'F'\n---\n# H",), ("text\n# H one\n[a](u) ![i](p) [b](u2 \"t\") [a](u)",), ('{"name": "J", "label": "L"}',), (None,)], "t string")
    rows = df.select(transform.markdown_title(F.col("t")).alias("a"), transform.markdown_links(F.col("t")).alias("l"), transform.json_title(F.col("t")).alias("j")).collect()
    assert [r.a for r in rows] == ["F", "H one", "Untitled", "Untitled"] and rows[1].l == ["u", "u2"] and rows[2].j == "J" and rows[3].j is None


# --- URLs
@pytest.mark.parametrize(
    ("glob", "path", "yes"),
    [("**/*.md", "a/b/c.md", True), ("**/*.md", "c.md", True), ("*.md", "a/c.md", False), ("docs/**", "docs/a/b", True), ("docs/**", "doc/a", False), ("a/{b,c}/?", "a/c/x", True), ("**/i18n/de*/**", "x/i18n/de-at/y", True), ("[ab]x", "bx", True), ("**/old/**", "a/older/b", False)],
)
def test_globs(glob, path, yes):
    assert (re.match(urls.glob_regex(glob), path) is not None) is yes


def test_admission_and_scope(spark):
    df = spark.createDataFrame([("https://h.example/docs/a",), ("https://h.example/docs/old/a",), ("https://h.example/x.test.js",), ("https://h.example/i18n/de/a",), (None,)], "u string")
    assert [r[0] for r in df.select(urls.admitted(F.col("u"))).collect()] == [True, False, False, False, None]
    assert [r[0] for r in df.select(urls.admitted(F.col("u"), ["/docs/**"], [])).collect()][:3] == [True, True, False]
    t = spark.createDataFrame([("https://a.ex.co.uk/api/index.html", "https://a.ex.co.uk/api/x"), ("https://a.ex.co.uk/api", "https://b.ex.co.uk/api/x"), ("https://a.ex.co.uk/", "http://a.ex.co.uk/")], "b string, t string")
    got = [tuple(r) for r in t.select(*[urls.in_scope(F.col("b"), F.col("t"), s) for s in ("subpages", "hostname", "domain")]).collect()]
    assert got == [(True, True, True), (False, False, True), (False, False, False)]


# --- files
def test_archives_and_lists(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.md", "# B")
        f.writestr("../evil", "x")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("c.txt")
        info.size = 2
        f.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "one.zip").write_bytes(z.getvalue())
    (tmp_path / "two.tgz").write_bytes(t.getvalue())
    (tmp_path / "three.txt.gz").write_bytes(gzip.compress(b"zipped"))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / ".hidden").write_bytes(b"x")
    found = files.read_files(spark, str(tmp_path))
    assert found.count() == 4
    rows = {r.path.rsplit("/", 1)[-1]: (bytes(r.content), r.mime) for r in files.unpack(found).collect()}
    assert rows == {"b.md": (b"# B", "text/markdown"), "c.txt": (b"hi", "text/plain"), "three.txt": (b"zipped", "text/plain")}
    title, links = files.parse_link_list("# P\n> s\n## Docs\n- [A](a.md): note\n## Optional\n- [B](b.md)\n")
    assert title == "P" and links == [("Docs", "A", "a.md", "note", False), ("Optional", "B", "b.md", "", True)]
    assert files.parse_link_list("- [A](a)") == (None, [])
    assert files.decode('<meta charset="latin-1">é'.encode("latin-1")).endswith("é") and files.decode(b"\xff") == "ÿ"


# --- set operations on small frames
def test_merge_and_refresh(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "d", "w")], "k int, etag string, body string")
    new = spark.createDataFrame([(1, "a", 200, "x2"), (2, "c", 200, "y2"), (3, None, 404, None), (5, "e", 200, "n"), (6, None, 304, None)], "k int, etag string, status int, body string")
    got = {r.k: r.change for r in merge.refresh_changes(old, new, ["k"]).collect()}
    assert got == {1: "kept", 2: "replaced", 3: "deleted", 4: "kept", 5: "inserted", 6: "ignored"}
    after = {r.k: r.body for r in merge.apply_refresh(old, new, ["k"]).collect()}
    assert after == {1: "x", 2: "y2", 4: "w", 5: "n"}
    up = merge.upsert(old, new.drop("status"), ["k"])
    assert {r.k: r.body for r in up.collect()} == {1: "x2", 2: "y2", 3: None, 4: "w", 5: "n", 6: None}
    assert merge.upsert(old.limit(0), new.limit(0).drop("status"), ["k"]).count() == 0


def test_partition_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "v int, id int, t string")
    merge.write_partitions(df, str(tmp_path / "t"), ["v"], ["id"])
    merge.write_partitions(df.where("v = 1").withColumn("t", F.lit("new")), str(tmp_path / "t"), ["v"], ["id"])
    assert sorted((r.v, r.id, r.t) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 1, "new"), (1, 2, "new"), (2, 3, "c")]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", None)], "url string, link string")
    seeds = spark.createDataFrame([("a",), (None,), ("a",)], "url string")
    assert sorted(map(tuple, crawl.crawl(seeds, links, 3).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert sorted(map(tuple, crawl.crawl(seeds, links, 9, max_pages=2).collect())) == [("a", 0), ("b", 1)]
    assert crawl.crawl(seeds.limit(0), links).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "z", 1)], "query_id int, url string, rank int")
    judged = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", 2), (2, "q", 1), (3, "a", 0)], "query_id int, url string, grade int")
    m = {r.query_id: r for r in evaluation.metrics_per_query(ranked, judged).collect()}
    assert set(m) == {1, 2} and m[1].mrr == 0.5 and m[1].recall_3 == pytest.approx(1 / 3) and m[1].recall_5 == pytest.approx(2 / 3) and (m[1].hit_1, m[1].hit_3) == (0, 1) and m[2].ndcg_5 == 0
    import math

    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert m[1].ndcg_5 == pytest.approx((7 / math.log2(3) + 1 / math.log2(5)) / ideal, abs=1e-8)


def test_common_prefix_and_knn_edges(spark):
    df = spark.createDataFrame([(1, [["a", "b", "c"], ["a", "b"]]), (2, [["a"], ["b"]]), (3, []), (4, [["a", "b"]]), (5, [["x"], []])], "k int, p array<array<string>>")
    assert [r[0] for r in df.orderBy("k").select(expand.common_prefix(F.col("p"))).collect()] == [["a", "b"], [], [], ["a", "b"], []]
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [9.0])], "id bigint, e array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, e array<double>")
    assert [(r.id, r.distance) for r in search.knn(rows, q, "id", 2).orderBy("distance", "id").collect()] == [(2, 0.0), (3, 0.0)]
    assert search.knn(rows, q.limit(0), "id", 2).count() == 0


def test_chunkers_skip_nulls(spark):
    df = spark.createDataFrame([(1, "# A\n\ntext", "zz"), (2, None, None), (3, "", "")], "id bigint, text string, content string")
    assert sorted({r.id for r in chunking.markdown_chunks(df, "id", "text").collect()}) == [1]
