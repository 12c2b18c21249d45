"""Corpus operators against brute force, exact round trips and held-out labels, with the odd inputs every one must take."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.llm import boilerplate, language, leakage, lines, messages, near_copies, neighbours, packing, page_identity, pieces, queries, residue, words
from tests.oracle import compare


def words_of(text):
    t = unicodedata.normalize("NFKC", text)
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    return re.findall(r"[^\W_]+", t.lower())


@pytest.fixture(scope="module")
def sf(sf_dir):
    return sf_dir


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    assert compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs_over_whole_tables(spark, sf, name):
    if name == "p3_found":  # messages must stand on several sources, which the smallest tables do not have
        sf = sf.replace("0.001", "0.01")
    df = queries.queries()[name](spark, sf)
    assert df.count() > 0
    if name.endswith("_found"):
        assert df.distinct().count() == df.count()


# --- 1: neighbours
def vectors(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 64))
    x = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, 64)) * 0.25
    x[5:20] = x[4]  # more copies than k
    rows = [(i, x[i].tolist(), "clash") for i in range(n)]
    rows += [(n, None, ""), (n + 1, [0.0] * 64, ""), (n + 2, [1.0] * 63, ""), (n + 3, [float("nan")] + [1.0] * 63, ""), (n + 4, [None] + [1.0] * 63, ""), (7, x[7].tolist(), "again")]
    return x, spark.createDataFrame(rows, "key bigint, emb array<float>, id string")


def test_nearest_recall_and_copies(spark):
    x, df = vectors(spark)
    p = neighbours.CurveParams(window=64, block=3, curves=14)
    got = {}
    for r in neighbours.nearest(df, "key", "emb", p).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    hit = sum(len({b for _, b in got[i]} & set(np.argsort(-sims[i])[:10].tolist())) for i in range(20, len(x))) / (10 * (len(x) - 20))
    assert hit >= 0.9 and set(got) == set(range(len(x)))
    assert all([r for r, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    assert {b for _, b in got[4]} == set(range(5, 15)) and {b for _, b in got[15]} == set(range(4, 14))  # ties go to the smaller id


def test_similar_pairs_and_empty(spark):
    x, df = vectors(spark, 300)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) if not 4 <= i < 20 for j in np.argsort(-sims[i])[:10] if sims[i, j] >= 0.9 and not 4 <= j < 20}
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, "key", "emb").collect()}
    assert want <= got
    assert neighbours.similar_pairs(df.limit(0), "key", "emb").count() == 0


def test_hilbert_key_is_a_bijection_with_unit_steps():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = neighbours.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- 2: pieces
ALPHABET = st.sampled_from("ab.\n\t 😀é \r")


@settings(max_examples=120, deadline=None)
@given(st.text(ALPHABET, max_size=1500), st.integers(40, 120))
def test_pieces_round_trip(text, limit):
    p = pieces.PieceParams(max_units=limit, min_units=limit // 3, overlap=limit // 8, landmark_bits=4, snap=10)
    u = np.frombuffer(text.encode("utf-16-le"), "<u2")
    own, out = 0, b""
    for start, end, _ in pieces.cut_points(u, p):
        assert start <= own < end or len(u) == 0
        assert end - start <= limit and own - start <= p.overlap
        out += u[own:end].tobytes()
        own = end
    assert out.decode("utf-16-le") == text
    run = max((len(x.encode("utf-16-le")) // 2 for x in re.split("[\t-\r  ]", text)), default=0)
    assert any(f for *_, f in pieces.cut_points(u, p)) == (run > limit)


def test_an_edit_alters_only_neighbouring_pieces():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", ".", ".\n", ".\n\n"]) for _ in range(20_000))
    edited = text[:40_000] + "some inserted words " + text[40_000:]
    cut = lambda t: {t[a:b] for a, b, _ in pieces.cut_points(np.frombuffer(t.encode("utf-16-le"), "<u2"), pieces.PieceParams())}
    before, after = cut(text), cut(edited)
    assert len(before) > 20 and len(before - after) <= 4


def test_pieces_of_odd_rows(spark):
    rows = [(1, None, ["p"]), (2, "", ["p"]), (3, "x" * 12_000, None), (4, "# A\n" + "word " * 3000, []), (4, "# A\n" + "word " * 3000, []), (5, "short", ["q"])]
    df = spark.createDataFrame(rows, "k bigint, body string, path array<string>").withColumn("text", F.lit("clash"))
    got = pieces.split_oversized(df, "k", "body", "path").collect()
    by = {i: sorted((r for r in got if r.item_id == i), key=lambda r: r.piece_no) for i in range(1, 6)}
    assert by[1] == [] and [r.piece for r in by[2]] == [""] and all(r.forced for r in by[3][:-1]) and not any(r.forced for r in by[4]) and by[5][0].path == ["q"]
    assert len({r.piece_no for r in by[4]}) == len(by[4]) > 1
    headed = pieces.split_oversized(df, "k", "body", only_oversized=True).collect()
    assert {r.item_id for r in headed} == {3, 4} and all(r.path == ["A"] for r in headed if r.item_id == 4)


# --- 3 and 5: messages, placeholders, frames
@pytest.mark.parametrize(("title", "bad"), [("404 Not Found", True), ("Page not found - lib", True), ("Page not found handlers in lib", False), ("Handling 404 responses", False), ("Access denied: how the policy works", False), ("Enable JavaScript to continue", True), ("Seite nicht gefunden", True), ("Why a row returns error 12", False), ("Lorem ipsum generator plugin", False), ("Running lib without JavaScript", False), ("Your session has expired | lib", True)])
def test_title_forms(title, bad):
    assert any(messages.is_message_title(x) for x in messages.title_forms(title, "lib")) is bad


def test_forms_leave_out_what_varies():
    pairs = [("Access denied to /a/b on this server.", "access denied to /c on this server."), ('ERR_X_DOWN: "x" sent 3', "err_y_down: \"zz\" sent 40"), ("Incident 0acf3e1.", "incident 77ab."), ("Error in token.php on line 3", "error in x.py on line 40"), ("Nulla sint occaecat aute nisi amet.", "Elit sed do magna aliqua enim quis.")]
    assert all(messages.form(messages.masked(a)) == messages.form(messages.masked(b)) for a, b in pairs)


def site(n=12):
    rows = []
    for i in range(n):
        lines = ["Skip to main content", "* Home", "* Blog", f"Home > Guide > Topic {i}", f"# Topic number {'abcdefghijkl'[i]}", "", f"The {i} topic explains in many own words how part {'xyz'[i % 3]} of the thing number {i} is built and used.", "", "Edit this page", "", "## Usage", "", f"Run it with the option {'abcdefghijkl'[i] * 3} and read what it prints about thing {i}.", "", "Related articles", "- Another topic", f"- Topic {i + 1}", "Was this page helpful? Yes No", "(c) 2024 Lib. All rights reserved."]
        rows.append((i, "https://docs.lib.example/p", "\n".join(lines)))
    return rows


def test_frames_are_deduced(spark):
    rows = [*site(), (50, "https://docs.lib.example/e", None), (51, "https://docs.lib.example/e", ""), (52, None, "# Own\n\nA page without an address has a body of its own words."), (0, *site()[0][1:])]
    df = spark.createDataFrame(rows, "k bigint, url string, body string").withColumn("site", F.lit("clash")).withColumn("text", F.lit(1))
    got = {}
    for r in boilerplate.frame_lines(df, "k", "url", "body").collect():
        got.setdefault(r.item_id, []).append(r.line_no)
    assert set(got) == set(range(12)) and all(sorted(v) == [0, 1, 2, 3, 8, 14, 15, 16, 17, 18] for v in got.values())
    bodies = {r.item_id: r.body for r in boilerplate.main_bodies(df, "k", "url", "body").collect()}
    assert bodies[3].startswith("# Topic number d") and bodies[3].endswith("about thing 3.") and "Edit" not in bodies[3] and 52 in bodies
    assert boilerplate.frame_lines(df.limit(0), "k", "url", "body").count() == 0


def test_labels_of_bodies_are_no_template(spark):
    rows = site()
    for i, (k, url, text) in enumerate(rows):
        if i % 3:  # a class of two labels that stands only in bodies
            text = text.replace("Edit this page", f"Edit this page\n\nParameters\n\nThe {'abcdefghijkl'[i]} parameter sets how many of the things are built at once.\n\nReturns\n\nIt returns what the call number {'abcdefghijkl'[i]} has built and shown.")
            rows[i] = (k, url, text)
    far = [(100 + i, f"https://h{i}.example/p", f"# Part {'abcdefghijkl'[i]}\n\nThe own sentence of part {'abcdefghijkl'[i]} of this manual.\n\nCaveats\n\nAnother own sentence about {'abcdefghijkl'[i]} in this manual.") for i in range(6)]
    df = spark.createDataFrame([*rows, *far], "k bigint, url string, body string")
    for p in (boilerplate.FrameParams(), boilerplate.FrameParams(broadcast_tokens=1)):
        bodies = {r.item_id: r.body for r in boilerplate.main_bodies(df, "k", "url", "body", p).collect()}
        assert all("Parameters" in bodies[i] and "Returns" in bodies[i] for i in range(12) if i % 3)
        assert not any("Edit this page" in bodies[i] for i in range(12)) and all("Caveats" in bodies[100 + i] for i in range(6))


WORDS = [chr(97 + i % 26) * 2 + chr(97 + i // 26 % 26) * 2 for i in range(400)]


def sentence(i, n=12):
    return " ".join(random.Random(i).choices(WORDS, k=n)) + "."


def varied(n=24):
    """Pages whose neighbour links differ everywhere and read like sentences, and in whose bodies a label and a sentence recur."""
    rows = []
    for i in range(n):
        body = f"# {WORDS[i]}\n\n{sentence(i)}\n\nReturns\n\nThat is all there is to know about it for now.\n\n{sentence(i + 1000)}"
        rows.append((i, "https://lone.example/p", f"{body}\n\nPreceding chapter of this book: {sentence(i + 2000)[:-1]}\nFollowing: {sentence(i + 3000)[:-1]} >>>"))
    return rows


def frames(spark, rows):
    got = {}
    for r in boilerplate.frame_lines(spark.createDataFrame(rows, "k bigint, url string, body string"), "k", "url", "body").collect():
        got.setdefault(r.item_id, set()).add(r.line_no)
    return got


def test_classes_find_lines_that_never_recur_and_leave_recurring_bodies(spark, monkeypatch):
    rows = varied()
    got = frames(spark, rows)
    assert all(got.get(i) == {10, 11} for i in range(24))  # both neighbour links, neither the label nor the recurring sentence of the body
    # With lines counted alone, as many as before are frequent, and none of those is frame.
    monkeypatch.setattr(boilerplate, "word_classes", lambda often: often.where("whole = 1").selectExpr("site", "token", "token as cls", "1 as lines", "1 as words", "prose", "whole", "false as enclosing"))
    assert frames(spark, rows) == {}


def test_a_thin_frame_line_is_found_through_its_class(spark, monkeypatch):
    rows = [(i, "https://thin.example/p", f"# {WORDS[i]}\n\n{sentence(i)}\n\n" + (f"Rate it\n\n{sentence(i + 1000)}\n\nShare it" if i % 5 == 0 else sentence(i + 1000))) for i in range(30)]
    # The upper line of the class stands among the body's own lines, the lower one after them.
    got = frames(spark, rows)
    assert all(got.get(i, set()) == ({4, 8} if i % 5 == 0 else set()) for i in range(30))
    whole = boilerplate.word_classes
    monkeypatch.setattr(boilerplate, "word_classes", lambda often: whole(often).withColumn("lines", F.lit(1)))
    assert all(4 not in v for v in frames(spark, rows).values())


def test_sites_that_share_no_wording(spark):
    rows = []
    for j in range(4):
        a, b, c, d = WORDS[300 + j * 5 : 304 + j * 5]
        rows += [(100 * j + i, f"https://s{j}.example/p", f"{a} {b}\n{c}\n\n# {WORDS[i]}\n\n{sentence(100 * j + i)}\n\n{d} {a} {c} {b} {d} {b} {a} {c} {a}.\n{b} {d}") for i in range(20)]
    got = frames(spark, rows)
    assert len(got) == 80 and all(v == {0, 1, 7, 8} for v in got.values())


def test_long_lines_are_template_too(spark):
    long = " ".join(["The operator of these pages keeps a small file on your device so that choices last"] * 3) + "."
    rows = [(k, url, f"{long}\n\n{text}\n\n{long.replace('small', 'large')}") for k, url, text in site()]
    bodies = {r.item_id: r.body for r in boilerplate.main_bodies(spark.createDataFrame(rows, "k bigint, url string, body string"), "k", "url", "body").collect()}
    assert len(bodies) == 12 and all(b.startswith("# Topic number") and b.endswith(f"about thing {k}.") for k, b in bodies.items())


def test_templates_by_site_equal_those_sent(spark, sf):
    scrapes = spark.read.parquet(f"{sf}/scrape_results.parquet")
    rows = lambda p: {tuple(r) for r in boilerplate.frame_lines(scrapes, "result_id", "url", "text_content", p).collect()}
    assert rows(boilerplate.FrameParams(broadcast_tokens=1, pages_per_group=5)) == rows(boilerplate.FrameParams())


def test_residue_pages(spark):
    frame = site()
    page = lambda body: frame[0][2].split("# Topic")[0] + body + "\nWas this page helpful? Yes No\n(c) 2024 Lib. All rights reserved."
    rows = [*frame, (20, "https://docs.lib.example/a", page("Please turn on scripts in your browser to view this page.")), (21, "https://docs.lib.example/b", page("# T\n\nDear {{ name }}, your queue is ready and waiting for you.")), (22, "https://docs.lib.example/c", page("# T\n\nWrite `{{ name }}` where the name should appear.\n\n```\n{{ x }}\n```\n\nThe rest of the page is as usual and long enough.")), (23, None, "Description goes here."), (24, "u", None)]
    rows += [(30 + i, f"https://h{i}.example/p", f"# Part {WORDS[i]}\n\n" + m) for i, m in enumerate(["Please turn on scripts in your browser to view this page.", "Description goes here."] * 3)]
    rows += [(50, "https://h0.example/q", "# Notes\n\nThe server then says what it is that has gone wrong in it.\n\nPlease turn on scripts in your browser to view this page.\n\nAfter this it waits for another call to come.")]
    rows += [(60 + i, f"https://u{i}.example/p", f"# {WORDS[i]}\n\nThis corridor leads back to the garden of nobody.") for i in range(10)]  # wording no cue knows
    rows += [(80 + i, f"https://v{i}.example/p", f"# {WORDS[i]}\n\nThe {WORDS[i]} part has a text of its own.\n\nThis is a closing line that all of the manuals have.\n\nThe {WORDS[i]} part ends with its own words.") for i in range(10)]
    df = spark.createDataFrame(rows, "k bigint, url string, body string").withColumn("site", F.lit("clash"))
    got = {(r.item_id, r.reason) for r in residue.residue_pages(df, "k", "url", "body").collect()}
    assert got == {(20, "message"), (21, "placeholder"), (23, "message"), *((i, "message") for i in [*range(30, 36), *range(60, 70)])}
    assert residue.residue_pages(df.limit(0), "k", "url", "body").count() == 0
    t = spark.createDataFrame([(1, "NaN"), (1, "NaN"), (2, None), (3, "Fine"), (4, " "), (5, "{{title}} | lib"), (6, "Template placeholders: `{{ x }}` syntax")], "k bigint, title string")
    assert sorted(r.item_id for r in residue.residue_titles(t, "k", "title").collect()) == [1, 5]


def test_messages_come_from_groups(spark, sf, monkeypatch):
    scrapes = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/scrape_results.parquet")
    find = lambda: {r.item_id for r in residue.residue_pages(scrapes, "result_id", "url", "text_content").where("reason = 'message'").collect()}
    assert len(find()) > 2
    monkeypatch.setattr(boilerplate, "message_forms", lambda *a: boilerplate.Forms())
    assert find() == set()


def test_titles_are_counted_across_sources(spark):
    rows = [(i, f"https://docs.h{i}x.example/p", f"Dienst {i} von h{i}x zurzeit nicht verfügbar - h{i}x") for i in range(8)]
    rows += [(20 + i, f"https://h{i}x.example/p", f"Kanal {'abcdefgh'[i]} nicht verfügbar") for i in range(8)] + [(40 + i, "https://one.example/p", "Seite nicht verfügbar") for i in range(9)]
    rows += [(60 + i, f"https://h{i}x.example/p", "Handling a missing page") for i in range(9)] + [(80, None, "Bad gateway")]
    got = residue.residue_titles(spark.createDataFrame(rows, "k bigint, u string, t string"), "k", "t", "u").collect()
    assert sorted(r.item_id for r in got) == list(range(8))


def test_addresses_and_dates_are_masked():
    pairs = [("Updated on 3 March 2024", "updated on 12. Okt. 2023"), ("See https://a.example/x?y=1 now", "see http://b.example now"), ("Write to me@a.example", "write to you@b.example"), ("On 2024-01-31", "on 3 May 2021")]
    assert all(messages.masked(a) == messages.masked(b) for a, b in pairs) and messages.masked("May I ask") == "may i ask"


# --- 4: near-copies
def corpus(seed=5, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 160))) for _ in range(n)]
    out = list(texts)
    for t in texts[:90]:
        w = t.split()
        for _ in range(rng.randint(1, max(1, len(w) // 14))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out + texts[:20] + ["too short a text"] * 3


def brute(texts, n, t, least):
    sets = [frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= least else None for w in (re.findall(r"[^\W_]+", x.lower()) for x in texts)]
    out = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= t:
                out.add((j, i))
    return out


@pytest.mark.parametrize(("shingle", "similarity", "hot"), [(3, 0.6, 3000), (5, 0.8, 3000), (3, 0.6, 1)])
def test_near_copies_equal_brute_force(spark, shingle, similarity, hot):
    texts = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(9999, None, ""), (9998, "", ""), (0, texts[0], "again")]
    df = spark.createDataFrame(rows, "k bigint, body string, code string")
    p = near_copies.CopyParams(shingle=shingle, similarity=similarity, least_words=20, hot_cell=hot)
    members, links = near_copies.near_copies(df, "k", "body", p)
    pairs = {(r.id_a, r.id_b) for r in near_copies.expand_pairs(members, links, near_copies.copied_codes(df, members, "body", p)).collect()}
    want = brute(texts, shingle, similarity, 20)
    assert pairs <= want and len(pairs) >= 0.98 * len(want)
    groups = {r.id: r.group_id for r in near_copies.groups(members, links).collect()}
    assert all(groups[a] == groups[b] for a, b in pairs) and len(groups) == len(texts) + 1
    assert near_copies.near_copies(df.limit(0), "k", "body", p)[1].count() == 0


def test_shingles_of_many_texts_are_hashed_together(monkeypatch):
    rng, p = random.Random(4), near_copies.CopyParams(shingle=3, least_words=2)
    texts = [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(40))) for _ in range(500)] + ["", None, "One two", "a " * 70_000]
    hasher = words.Hasher()
    cut = [words.split_words(t, fold=False) for t in texts]
    want = [near_copies.shingle_set(hasher(w), 3).tolist() if len(w) >= 2 else None for w in cut]
    folded, fold = [], near_copies._fold
    monkeypatch.setattr(near_copies, "_fold", lambda columns: folded.append(len(columns[0])) or fold(columns))
    got = near_copies._shingles(texts, hasher, p)
    assert [None if s is None else s.tolist() for s in got] == want
    assert len(folded) <= 2 + sum(len(w) == 2 for w in cut) < 100


def test_near_copies_of_few_shingles(spark):
    texts = ["word " * 25, "Word, " * 20, "one two " * 12, "One two! " * 11, "a b c " * 8, "a b c " * 8 + "d", "A b c " * 9, "x y z " * 8 + "q r", "x y z " * 8 + "q s"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, body string")
    for hot in (3000, 1):
        p = near_copies.CopyParams(shingle=3, similarity=0.6, least_words=20, hot_cell=hot)
        members, links = near_copies.near_copies(df, "k", "body", p)
        pairs = {(r.id_a, r.id_b) for r in near_copies.expand_pairs(members, links, near_copies.copied_codes(df, members, "body", p)).collect()}
        assert pairs == brute(texts, 3, 0.6, 20) and {(0, 1), (2, 3), (4, 5), (4, 6), (5, 6)} <= pairs


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=200), st.sets(st.integers(0, 2**63), max_size=200))
def test_manhattan_is_a_lower_bound(a, b):
    u, v = (near_copies.popcounts(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert near_copies.manhattan(u, v) <= len(a ^ b)


SAME = ["https://h.example/a/b-c", "HTTPS://H.EXAMPLE:443/a//b%2Dc/", "http://h.example/a/./b-c/index.html?utm_source=x&sid=1#part", "https://h.example/a/x/../b-c"]
OTHER = ["https://h.example/a/b-d", "https://h.example/a/b-c?page=2", "https://h.example/#/a/b-c", "https://h.example/1.2/a/b-c", "https://www.h.example/a/b-c"]


def test_page_identity(spark):
    assert len({page_identity.canonical_url(u) for u in SAME}) == 1
    assert len({page_identity.canonical_url(u) for u in [SAME[0], *OTHER]}) == 6
    assert page_identity.canonical_url("https://h.example/?b=1&a=2#/x/y/") == page_identity.canonical_url("https://h.example/?a=2&b=1&ref=z#/x/y")
    assert page_identity.canonical_url(None) is None and page_identity.canonical_url("http://[bad") is None
    rows = [(1, 1, SAME[0]), (2, 1, SAME[1]), (3, 1, SAME[0]), (4, 2, SAME[2]), (5, 1, None), (6, None, SAME[2]), (2, 1, SAME[1])]
    got = page_identity.same_page_hits(spark.createDataFrame(rows, "h bigint, q bigint, u string"), "h", "q", "u")
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == [(1, 2), (2, 3)]


# --- 6: packing
@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_fit_and_place_each_item_once(histogram):
    p = packing.plan(histogram, 64)
    load, placed = {}, {}
    for length, rank, count, first in p.tiles:
        for i in range(count):
            load[first + i] = load.get(first + i, 0) + length
            placed.setdefault(length, []).append(rank + i)
    assert all(v <= 64 for v in load.values()) and set(load) == set(range(p.containers))
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(v)) for k, v in histogram.items()}


def test_packing_of_odd_sizes(spark):
    rows = [(1, 100), (2, 0), (3, None), (4, 64), (5, 63), (6, 1), (7, 130)] + [(i, 10) for i in range(10, 40)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 64, packing.PackParams(rows_per_salt=5)).collect()
    load = {}
    for r in out:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 64 and {r.doc_id for r in out} == {k for k, _ in rows} and sum(load.values()) == 100 + 64 + 63 + 1 + 130 + 300
    assert sorted((r.part_no, r.token_start, r.n_tokens) for r in out if r.doc_id == 7) == [(0, 0, 64), (1, 64, 64), (2, 128, 2)]
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 64).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "one two <|endoftext|>")], "k bigint, body string")
    assert [r.n_tokens for r in packing.token_counts(texts, "k", "body").orderBy("doc_id").collect()][:2] == [0, 0]


# --- 7: leaks
ITEMS = [(1, "At the amber quarry of Sunderay twenty lamplighters polished five compasses before vespers", "short answer"), (2, "no overlap whatsoever in these eight or nine words", "At the amber quarry of Sunderay twenty lamplighters polished"), (3, None, "")]
DOCS = [
    (1, "x y AT THE AMBER\nquarry, of **Sun­deray** twenty lamplighters polished five z"),
    (2, "the amber quarry of Sunderay twenty lamplighters"),
    (3, "at the amber quarry of sunderay twenty ﬁne lamplighters polished five compasses before vespers"),
    (4, None), (5, ""), (1, "repeat of nothing"),
]


def leaks_by_brute_force(window):
    grams = {}
    for i, *fields in ITEMS:
        for f in fields:
            w = words_of(f or "")
            for k in range(len(w) - window + 1):
                grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = set()
    for d, t in DOCS:
        w = words_of(t or "")
        for k in range(len(w) - window + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + window]), ())}
    return out


@pytest.mark.parametrize("sent", [1000, 0])
def test_leaks_equal_brute_force(spark, sent):
    docs = spark.createDataFrame(DOCS, "k bigint, body string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "n bigint, prompt string, answer string")
    got = leakage.find_leaks(docs, items, "k", "body", "n", ["prompt", "answer"], leakage.LeakParams(broadcast_windows=sent))
    assert sorted(map(tuple, got.collect())) == sorted(leaks_by_brute_force(8))
    assert leakage.find_leaks(docs.limit(0), items, "k", "body", "n", ["prompt"]).count() == 0


def test_leaks_with_edits(spark):
    rng = random.Random(2)
    v = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(v) for _ in range(30))) for i in range(40)]
    docs = []
    for i, t in items:
        w = t.split()[3:27]
        k = rng.randrange(4, 20)
        w = [w[:k] + w[k + 1 :], w[:k] + [rng.choice(v)] + w[k:], w[:k] + [rng.choice(v)] + w[k + 1 :]][i % 3]
        docs.append((i, " ".join([rng.choice(v) for _ in range(50)] + w + [rng.choice(v) for _ in range(50)])))
    p = queries.NEAR
    got = leakage.find_leaks(spark.createDataFrame(docs, "k bigint, t string"), spark.createDataFrame(items, "n bigint, p string"), "k", "t", "n", ["p"], p)
    rows = set(map(tuple, got.collect()))
    assert rows <= {(i, i) for i in range(40)} and len(rows) >= 36


def edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i : i + rng.randrange(2)] = [rng.getrandbits(60)] * rng.randrange(2) or [rng.getrandbits(60)]
    return out


@pytest.mark.parametrize(("window", "edits"), [(16, 2), (8, 1)])
def test_recall_of_sampled_keys(window, edits):
    rng = random.Random(9)
    p = leakage.replace(queries.NEAR, window=window, max_edits=edits)
    hits = 0
    for _ in range(500):
        a = [rng.getrandbits(60) for _ in range(window)]
        doc = np.array([rng.getrandbits(60) for _ in range(9)] + edited(a, edits, rng) + [0] * edits, np.uint64)
        a, starts = np.array(a, np.uint64), np.arange(len(doc) - window + 1)
        keys = [set(np.nonzero(leakage.window_keys(doc, starts, p, r) == leakage.window_keys(a, np.array([0]), p, r)[0])[0]) for r in range(p.repetitions)]
        hits += any(leakage.edit_distance_at_most(a.view(np.int64), doc[i : i + window + edits].view(np.int64), edits) for i in set().union(*keys))
    assert hits >= 450


def test_leaks_of_short_passages_and_at_the_end(spark):
    items = spark.createDataFrame([(1, "nine lamplighters of Sunderay polished twenty old compasses"), (2, " ".join(f"w{i}" for i in range(16)))], "n bigint, p string")
    docs = [(1, "and so the nine lamplighters of Sunderay cleaned twenty old compasses"), (2, "then " + " ".join(f"w{i}" for i in range(16) if i not in (5, 9))), (3, "nine lamplighters of nowhere")]
    got = leakage.find_leaks(spark.createDataFrame(docs, "k bigint, t string"), items, "k", "t", "n", ["p"], leakage.replace(queries.NEAR, repetitions=40))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2)]


def test_edit_distance():
    d = lambda a, b, k: leakage.edit_distance_at_most(np.array(a), np.array(b), k)
    assert d([1, 2, 3], [1, 2, 3, 9], 0) and not d([1, 2, 3], [1, 3, 3, 9], 0) and d([1, 2, 3, 4], [1, 3, 4, 9, 9], 1) and not d([1, 2, 3, 4], [9, 9, 3, 4], 1)


# --- 8: languages
def test_labels(spark):
    want = {None: "none", " ": "none", "und": "none", "N/A": "none", "EN": "en", "en_GB": "en", "deu": "de", "Portuguese": "pt", "pt-BR": "pt", "it": "other", "klingon": "other", "Français": "fr"}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r[0]: r[1] for r in df.select("l", language.label_code(F.col("l"))).collect()} == want


def test_blocks_and_numbers():
    text = "# Head one\r\n\r\nThis is a block of prose with more than eight words.\r\n\r\nshort one\n\n```\ncode here\n\nmore code that is long enough to count as words\n```\n\n| a | b |\n|---|---|\n\nAnother block of prose, again with more than eight words in it."
    assert [(b.number, b.prose) for b in language.blocks(text, 8)] == [(0, False), (1, True), (2, False), (3, False), (4, False), (5, False), (6, True)]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and lang in ('en', 'de', 'fr', 'es')")
    found = language.detect(rest, "doc_id", "text", "lang", language.train(train, "doc_id", "text", "lang")).where("segment_no = -1 and not mixed")
    rows = found.select("stated", "language").collect()
    assert len(rows) > 20 and sum(r.stated == r.language for r in rows) >= 0.9 * len(rows)  # some labels are wrong


def test_languages_of_odd_rows(spark):
    en = "The system reads the file and then it writes the result to the table when all is done. "
    de = "Das System liest die Datei und dann schreibt es das Ergebnis in die Tabelle, wenn alles fertig ist. "
    rows = [(i, en * 2, "en") for i in range(6)] + [(i + 10, de * 2, "de") for i in range(6)] + [(20, en + "\n\n" + de, "en"), (21, de, None), (22, None, "en"), (23, "", "x"), (24, "12 34", None), (25, en, "German"), (21, de, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, body string, lang string").withColumn("text", F.lit("clash"))
    got = sorted(map(tuple, language.corrections(language.relabel(df, "doc_id", "body", "lang")).collect()))
    assert got == [(20, 0, "en"), (20, 1, "de"), (21, -1, "de"), (21, -1, "de"), (25, -1, "en")]
