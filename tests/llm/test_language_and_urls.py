"""Samples of repeated ids, languages found for rows without one, links in every kind of tag."""

import random
from zlib import crc32

import pytest

from tessera.llm import common, language, simhash, urls

ROWS = {"de": "der hund und die katze sitzen auf der matte vor dem haus am see ", "en": "the dog and the cat sit on the mat before the house at the lake ", "fr": "le chien et le chat sont assis sur le tapis devant la maison du lac "}

#: An id that is held out, so that its label isn't learned.
HELD = next(i for i in range(3000, 3100) if crc32(str(i).encode()) % 4 == 2)


def corpus(spark, extra=()):
    r, rows = random.Random(2), []
    for i in range(240):
        lang = sorted(ROWS)[i % 3]
        ws = ROWS[lang].split()
        rows.append((i, " ".join(r.choice(ws) for _ in range(30)), lang, "x", 1))
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, held_out string, score int")


def test_stage_fills_in_the_language_that_was_found(spark):
    extra = [(1000 + i, ROWS[k] * 3, None, "x", 1) for i, k in enumerate(sorted(ROWS))] + [(2000, "12 !", None, "x", 1), (2001, None, "en", "x", 1), (2002, "", None, "x", 1), (None, ROWS["de"], None, "x", 1), (HELD, ROWS["fr"], "xx", "x", 1)]
    docs = corpus(spark, extra)
    out = language.with_language(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 245 and not got.keys() & {2000, 2001, 2002}
    assert [got[1000 + i].lang for i in range(3)] == sorted(ROWS) and got[None].lang == "de" and got[HELD].lang == "xx" and got[7].lang == "en"


def test_fit_reads_labelled_rows_alone(spark):
    """Rows that share a doc_id with a labelled one are no part of the sample."""
    ids = [i for i in range(60) if crc32(str(i).encode()) % 4 != 2]
    extra = [(i, "zzz qqq " * 20, None, "x", 1) for i in ids]
    plain, more = language.fit(corpus(spark)), language.fit(corpus(spark, extra))
    assert plain == more and not any("zzz" in t for _, t in more)
    twice = corpus(spark).union(corpus(spark))
    assert {k for k, _ in language.fit(twice)} == set(ROWS) and language.fit(twice.repartition(3)) == language.fit(twice)


def test_many_languages(spark, monkeypatch):
    rows = [(i * 10 + j, f"wort{i} " * 5, f"l{i:03}", "x", 1) for i in range(300) for j in range(3 if i < 20 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, score int")
    taught = {r.lang for r in docs.filter(~language.held_out()).select("lang").collect()}
    assert {k for k, _ in language.fit(docs)} == taught and len(taught) > 250
    monkeypatch.setattr(language, "MODEL_TOTAL", 4000)
    monkeypatch.setattr(language, "MODEL_LEAST", 20)
    monkeypatch.setattr(language, "BROADCAST_IDENTITIES", 0)
    got = language.fit(docs)
    assert {k for k, _ in got} == taught and all(len(t) <= 20 for _, t in got)
    assert {r.lang_pred for r in language.language_id(docs).collect()} <= {k for k, _ in got}


@pytest.mark.parametrize(("tag", "to"), [
    ('<link rel="x canonical" href="../y">', "/y"), ("<LINK HREF=/y REL=Canonical>", "/y"), ("<link rel='canonical' data-href='/no' href='/y'>", "/y"), ('<link rel="alternate" href="/no"><link rel="canonical" href=" /y ">', "/y"),
    ('<meta http-equiv="Refresh" content="0; URL=\'/y\'">', "/y"), ("<meta content='5;url=/y?a=1&amp;b=2' http-equiv=refresh>", "/y?a=1&b=2"),
    ("<meta http-equiv=refresh content='0; /y'>", "/y"), ("<meta http-equiv=refresh content='3, http://i.com:80/y'>", "/y"), ('<link title="a>b" rel="canonical" href="/y">', "/y"), ('<link rel="canonical" href="http://I.com:/%7ey/%2e/z%c3%a9#f">', "/~y/z%C3%A9"),
    ('<link rel="canonical" href="http://i.com">', "/"), ('<link rel="canonical" href="/y&copy=1">', "/y&copy=1"), ('<link rel="canonical" href="/y&copy;">', "/y\u00a9"), ('<link rel="canonical"\nhref=" /\ty ">', "/y"), ('<link rel="canonical" href="/p"><link rel="canonical" href="/y">', "/y"),
    ('<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="y">', "/d/y"), ('<base target=x><base href="//i.com/z/"><link rel="canonical" href="y">', "/z/y"),
])
def test_links_in_every_tag(spark, tag, to):
    rows = [(1, "http://i.com/d/e", tag), (2, "http://I.com" + to, '<link rel=canonical href="http://b.net/">'), (3, "http://i.com/no", "")]
    got = {r.page_id: r.verdict for r in urls.url_filter(spark.createDataFrame([(*x, "a", "b", 1) for x in rows], "page_id long, url string, html string, root string, bare string, host int")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_no_links_where_there_are_none(spark):
    rows = [(5, "http://i.com/g", '<link title="rel=canonical" rel="icon" href="http://b.net/">'), (6, "http://i.com/h", "<textarea><link rel=canonical href=http://b.net/></textarea><title><meta http-equiv=refresh content='0;http://b.net/'></title>"), (7, "http://i.com/i", "<meta http-equiv=refresh content='url=http://b.net/'><meta http-equiv=refresh content=5>")]
    rows += [(1, "http://i.com/d", '<link rel="canonicals" href="http://b.net/"><link rel="alternate" href="http://b.net/"><script>"<link rel=canonical href=http://b.net/>"</script>'), (2, "http://i.com/e", '<link rel="canonical" href="mailto:a@b.net">'), (3, None, '<link rel="canonical" href="http://b.net/">'), (4, "http://i.com/f", '<meta http-equiv="x" content="0;url=http://b.net/">'), (1, "http://i.com/d", None)]
    assert {r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"allow"}


@pytest.mark.parametrize("piece", ["<!--", "<script ", "<link ", "<link rel='canonical", "<base href=\"", "<textarea>", "%7e/../", "&amp", "< = \"'", "<title></titl"])
def test_long_pages_take_time_in_proportion(piece):
    """A megabyte of what never ends, before and within a link."""
    import time

    many = piece * (1_000_000 // len(piece))
    for html in (many, "http-equiv " + many + " -->", f'<link rel="canonical" href="{many}">', f"<meta http-equiv=refresh content='0;{many}'>"):
        began = time.time()
        urls.targets("http://a.com/b", html)
        assert time.time() - began < 5


def test_spellings_of_a_url():
    same = ["http://a.com", "HTTP://A.com:80/", "http://a.com:/#x", "http://a.com/./b/../", "http://a.com/b/..", " http://a.com/\n"]
    assert {urls.node(u) for u in same} == {"http://a.com/"}
    assert urls.node("https://U%73er@H:443/%7Ex%2fy?q=%41%e9") == "https://U%73er@h/~x%2Fy?q=A%E9"
    assert len({urls.node(u) for u in ("http://a.com/b", "http://a.com/b/", "http://a.com/B", "http://a.com/b?", "https://a.com/b", "http://a.com:81/b")}) == 6


def test_components_of_hubs_chains_and_repeats(spark, monkeypatch):
    """Salted joins: a hub of many leaves, a long chain, a clique and repeated edges give what union-find gives."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1200)] + [(i, j) for i in range(2000, 2012) for j in range(i) if j >= 2000] + [(r.randrange(3000, 3400), r.randrange(3000, 3400)) for _ in range(150)] + [(5, 5), (0, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_verdicts_of_linked_pages_in_sql(spark):
    """Every form of link, chains, rules at either end, and pages without any, against SQL."""
    import duckdb
    import pandas as pd

    r, rows = random.Random(9), []
    hosts = ["a.com", "b.net", "www.example.net", "EXAMPLE.com", "c.org", "d.io", *(f"x{i}.io" for i in range(90))]
    paths = ["/", "/en/x", "/de/y", "/fr/z", "/d/e/f", "/p?q=1", "/s/t#u", ""]
    refs = ["../g", "./", "h", "/fr/z", "?q=2", "#f", "//b.net/", "http://www.example.net/en/x", "HTTP://A.com/d/../en/x", "..", "../../../k", "/a/./b/../c", "mailto:x@y", "i?a=1&amp;b=2", "j/", "&quot;", "HTTP://a.com:80", "http://c.org:/%7ex/%2e/%c3", "/%7E", "https://d.io:443/fr/../de/y", "http://b.net"]
    forms = ['<link title="a>b" rel="canonical" href="{}">', '<link title="rel=canonical" rel="icon" href="{}">', "<textarea><link rel=canonical href={}></textarea>", "<meta http-equiv=refresh content='0; {}'>", "<meta content='1,URL=\"{}\" x' http-equiv=REFRESH>", '<link rel="canonical" href="{}">', "<LINK HREF='{}' REL='x Canonical'>", "<meta http-equiv=refresh content='0; url={}'>", '<!-- <link rel="canonical" href="{}"> -->', "<script><link rel=canonical href='{}'></script>", '<link rel="alternate" href="{}">', "<base href='{}'>"]
    for i in range(400):
        html = "".join(r.choice(forms).format(r.choice(refs)) for _ in range(r.choice((0, 0, 1, 1, 2, 3))))
        rows.append((i, f"{r.choice(('http', 'HTTPS'))}://{r.choice(hosts)}{r.choice(paths)}" if i % 40 else None, html if i % 33 else None))
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = {tuple(None if pd.isna(v) else v for v in x) for x in con.sql(urls.OP8_SQL).df()[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False)}
    got = {tuple(x) for x in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got == want and len({x[4] for x in got if x[3] is None}) == 2
