import html
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sensorline.llm import html as pages_html
from sensorline.llm import langid, urls
from sensorline.llm.html import main_text, page_lines, page_texts


@pytest.mark.parametrize("rename", [None, "div", "section"])
def test_articles_of_the_given_pages(spark, sf, rename):
    """Also where nothing marks the article: there the lengths must find it."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    shown = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", f"$1{rename}>")) if rename else pages
    got = {r.page_id: r for r in page_texts(shown).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        want = " ".join(x for x in parts if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


PROSE = "The committee met on Tuesday and agreed on most of the plan. " * 4


def test_parts_that_hold_no_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><div id=sidebar><ul><li><a href=/x>Other story</a></ul></div>
    <article><header><h1>Head &amp; tail</h1></header><p>{PROSE}<p>End.<div class="ad">Buy</div><form><input><button>Send</button></form></article>
    <section class="comments"><p>{PROSE}</p></section><footer>(c)</footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert main_text(page) == f"Head & tail {PROSE.strip()} End."


def test_surge_and_dive_without_an_article_element():
    page = f"<body><div>Menu</div><div><a href=a>one</a> <a href=b>two</a></div><div>{PROSE}</div><div>Short.</div><div>{PROSE}</div><div class=footer>Imprint {PROSE}</div></body>"
    assert main_text(page) == f"{PROSE.strip()} Short. {PROSE.strip()}"


def test_unmarked_pages_lose_nothing_else():
    line = lambda n: ("word " * n)[:n].strip()
    page = lambda *parts: "<body>" + "".join(f"<div>{x}</div>" if "<" not in x else x for x in parts)
    links, advert = "<div><a href=a>other stories</a></div>", "<div class=advert>Buy this now</div>"
    assert main_text(page("Head", line(40))) == f"Head {line(40)}"
    assert main_text(page("Head", "By A. Writer", line(20), line(14), line(200))) == f"Head By A. Writer {line(20)} {line(14)} {line(200)}"
    assert main_text(page("<h1>Head</h1>", links, line(200))) == f"Head {line(200)}"
    assert main_text(page(line(200), advert, advert, advert, line(40))) == f"{line(200)} {line(40)}"
    assert main_text(page(line(200), links, links, links, line(40), "End.")) == f"{line(200)} {line(40)} End."
    assert main_text(page(line(200), links, links, links, "(c)")) == line(200)


def test_windows_decide(spark, sf, monkeypatch):
    """Lines by themselves, without windows, lose short lines of the given pages."""
    given = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    whole = [main_text(p) for p in given]
    monkeypatch.setattr(pages_html, "WINDOW", 1)
    assert any(a != main_text(p) for a, p in zip(whole, given))
    assert main_text(f"<div>{PROSE}</div><div>Short.</div>") == PROSE.strip()


def test_names_are_believed_as_far_as_lengths_bear_them_out():
    article = f"<h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>"
    want = f"Head {PROSE.strip()} Short. {PROSE.strip()}"
    for box in ("<form>", "<div class='content-header'>", "<main class='page notice'>"):
        end = box.split()[0].strip("<>")
        assert main_text(f"<body><div class=cookie>We use cookies.</div>{box}{article}</{end}><div>(c) 2020</div>") == want
    assert main_text(f"<body><div class=sidebar><p>{PROSE}</p></div><div>{article}</div><div class=promo>{PROSE}</div>") == want
    assert main_text(f"<body><article><p>Brief.</p></article><div>{PROSE}</div>") == "Brief."
    assert main_text(f"<article><p>{PROSE}</p><div class=ad>Buy</div><p>End.</p></article>") == f"{PROSE.strip()} End."
    assert main_text("<nav>Home</nav><div class=ad>Buy this now</div><footer>Imprint</footer>") == ""


def test_broken_and_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<script>x") == ""
    assert main_text("<p>a &lt;b&gt; &#x41;&nbsp;c") == "a <b> A c"
    assert main_text("<article><p title='>'>x<p>y</article>") == "x y"
    assert [t for t, *_ in page_lines("<p>" * 3000 + "deep")] == ["deep"]
    df = spark.createDataFrame([(1, "u", "<p>one</p>", 1), (1, "u", "<p>one</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in page_texts(df).collect()) == [("", 0), ("one", 3), ("one", 3)]
    assert page_texts(df.limit(0)).count() == 0


def test_url_list_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    cur = con.execute(urls.ORACLE)
    names = [d[0] for d in cur.description]
    got = urls.filter_pages(spark.read.parquet(f"{sf}/pages.parquet")).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))


def test_entries_hold_from_their_date_to_the_next(spark):
    entries = spark.createDataFrame([("a.example.com", "block", 10), ("a.example.com", "allow", 20), ("a.example.com", "block", 20), ("example.com", "block", 5), (None, "block", 1), ("b.example.com/x", "allow", None)], "key string, action string, listed_at int")
    rows = [("http://a.example.com/p", 9), ("http://a.example.com/p", 10), ("https://u@A.Example.com:80/p?q", 19), ("http://a.example.com", 20), ("http://z.example.com", 4), ("no address", 50), (None, 50), ("http://a.example.com", None), ("http://a.example.com", 20)]
    caps = spark.createDataFrame([(k, u, t, "x") for k, (u, t) in enumerate(rows)], "id int, url string, fetched_at int, ACTION string")
    out = urls.apply_list(caps, entries)
    got = {r.id: (r.matched_key, r.action) for r in out.collect()}
    assert got == {0: ("example.com", "block"), 1: ("a.example.com", "block"), 2: ("a.example.com", "block"), 3: ("a.example.com", "block"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: ("a.example.com", "block")}
    assert urls.apply_list(caps.limit(0), entries).count() == 0 and urls.apply_list(caps, entries.limit(0)).count() == 9


def test_every_domain_above_a_host_counts(spark):
    """Against a search over all entries, for hosts of one to six labels."""
    rng = random.Random(3)
    label = lambda: rng.choice("ab")
    hosts = [".".join(label() for _ in range(rng.randint(1, 6))) for _ in range(60)]
    entries = [(rng.choice(hosts) + rng.choice(["", "", "/p"]), rng.choice(["block", "allow", None]), rng.randint(0, 30)) for _ in range(60)]
    caps = [(k, f"http://{rng.choice(hosts)}{rng.choice(['', '/p', '/q'])}", rng.randint(-1, 33)) for k in range(400)]
    best = {}
    for key, action, at in entries:
        best[key, at] = max(best.get((key, at)) or "", action or "") or None

    def decided(url, at):
        address = url[7:]
        parts = address.split("/")[0].split(".")
        keys = [("address", address)] + [(("host", "parent")[i] if i < 2 else "domain", ".".join(parts[i:])) for i in range(max(1, len(parts) - 1))]
        for level, key in keys:
            times = [t for k, t in best if k == key and t <= at]
            if times:
                return level, key, best[key, max(times)]
        return None, None, None

    got = urls.apply_list(spark.createDataFrame(caps, "id int, url string, fetched_at int"), spark.createDataFrame(entries, "key string, action string, listed_at int"))
    assert {r.id: (r.matched_level, r.matched_key, r.action) for r in got.collect()} == {k: decided(u, t) for k, u, t in caps}


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    langs, model = langid.train(docs.filter("doc_id % 2 = 0"))
    assert langs == ["de", "en", "es", "fr"] and model.shape == (4, langid.BUCKETS)
    got = langid.identify(docs, pages)
    held = got.filter("doc_id % 2 = 1").join(docs.select("doc_id", docs.lang.alias("true")), "doc_id").collect()
    assert sum(r.lang == r.true for r in held) >= 0.97 * len(held) and sum(r.kept for r in held) >= 0.97 * len(held)
    told = {r.page_id: re.search(r'lang="(\w+)"', r.html).group(1) for r in pages.collect()}
    of_pages = got.filter("page_id is not null").collect()
    assert len(of_pages) == len(told) and sum(r.lang == told[r.page_id] for r in of_pages) >= 0.95 * len(told)


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the and of to in is that", "en", "s"), (2, "der und die das ist nicht", "de", "s"), (3, None, None, None), (3, "", "en", "s"), (None, "the of and", None, None)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(7, None, None), (8, "no address", "<html lang=de><p>und</p>"), (8, "no address", "<html lang=de><p>und</p>")], "page_id long, url string, html string")
    got = langid.identify(docs, pages).collect()
    assert len(got) == 8 and all(r.lang in ("de", "en") for r in got)
    assert langid.identify(docs.limit(0), pages).filter("lang is null").count() == 3
    assert langid.identify(docs, pages.limit(0)).count() == 5


def test_fusion_equals_brute_force(spark):
    """Every source of evidence counted over the other rows, in plain Python."""
    import math

    rng, langs = __import__("random").Random(3), ["de", "en", "fr"]
    rows = [(k, rng.choice(["a.x.org", "b.x.org", "c.y.de", None]), rng.choice(langs + [None]), rng.choice(["de", "fr", None]), [rng.uniform(-9, 0) for _ in langs]) for k in range(40)]
    rows = [(k, h, h and ".".join(h.split(".")[1:]), d, s, v) for k, h, d, s, v in rows]
    df = spark.createDataFrame(rows, "id int, host string, domain string, declared string, suffix string, scores array<double>")
    soft = [[math.exp(x) / sum(map(math.exp, r[5])) for x in r[5]] for r in rows]
    total = [sum(p[k] for p in soft) + 1 for k in range(3)]
    corpus = [t / sum(total) for t in total]

    def others(i, at):
        mine = [soft[j] for j in range(len(rows)) if j != i and rows[i][at] is not None and rows[j][at] == rows[i][at]]
        return [sum(p[k] for p in mine) for k in range(3)]

    smooth = lambda c, to, pull: [(a + pull * b) / (sum(c) + pull) for a, b in zip(c, to)]
    want = {}
    for i, r in enumerate(rows):
        prior = smooth(others(i, 1), smooth(others(i, 2), corpus, langid.DOMAIN_PULL), langid.HOST_PULL)
        told = [smooth(others(i, at), corpus, langid.PULL) for at in (3, 4)]
        score = [r[5][k] + math.log(prior[k]) + sum(math.log(t[k] / corpus[k]) for t in told) for k in range(3)]
        e = [math.exp(x - max(score)) for x in score]
        want[r[0]] = (langs[e.index(max(e))], max(e) / sum(e))
    got = {r.id: (r.lang, r.posterior) for r in langid.fuse(df, langs).collect()}
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_languages_with_clashing_columns_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "the and of to in is that " * 40_000, "en", "s", 1), (1, "the and of to in is that " * 40_000, "en", "s", 1), (2, "der und die das ist nicht", "de", "s", 2)], "doc_id long, text string, lang string, source string, SCORES int")
    pages = spark.createDataFrame([(7, "http://a.de/x", "<p>und die</p>", "x")], "page_id long, url string, html string, Host string")
    got = langid.identify(docs, pages).collect()
    assert sorted((r.doc_id or 0, r.lang) for r in got)[1:] == [(1, "en"), (1, "en"), (2, "de")]


def test_many_hosts_below_a_long_timeline(spark):
    """20 000 hosts below one domain of 1000 dated entries: rows on the way stay near the hosts' labels."""
    entries = spark.range(1000).select(F.lit("blogs.example").alias("key"), F.concat(F.lit("act"), F.col("id") % 7).alias("action"), (F.col("id") * 10).cast("int").alias("listed_at"))
    caps = spark.range(20_000).select("id", F.concat(F.lit("http://h"), F.col("id"), F.lit(".blogs.example/p")).alias("url"), (F.col("id") % 10_100).cast("int").alias("fetched_at"))
    listed = urls.dated_entries(entries).groupBy("key").agg(F.min("valid_from").alias("since"))
    hosts = caps.select(urls.host_of(F.col("url")).alias("host")).distinct()
    chains = urls.host_chains(hosts, listed)
    assert chains.count() == 20_000 and chains.agg(F.sum(F.size("chain"))).first()[0] == 20_000
    assert urls.timelines(urls.dated_entries(entries)).count() == -(-1000 // urls.TIMELINE)
    got = urls.apply_list(caps, entries)
    wrong = got.filter((F.col("action") != F.concat(F.lit("act"), F.least(F.floor(F.col("fetched_at") / 10), F.lit(999)) % 7)) | F.col("action").isNull())
    assert got.count() == 20_000 and wrong.count() == 0


@pytest.mark.parametrize("box", ["<form>", '<div class="share-body">', '<div class="widget">', '<section id="header-story">', '<div class="sidebar-main">'])
def test_articles_in_boxes_with_telling_names(spark, sf, box):
    """The article of every given page, the advert beside it and one within it out."""
    end = re.match(r"<(\w+)", box).group(1)
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        want = main_text(p.html)
        shown = p.html.replace("<article>", f'{box}<div class="ad">Buy this.</div>').replace("</article>", f"</{end}>")
        assert want and main_text(shown) == (want if len(want) >= 32 or "sidebar" not in box else "")


def test_paragraphs_in_boxes_of_one_name_stay_together():
    page = f"<body><div>(c) 2020</div><div class=text-widget><p>{PROSE}</p></div><div class=text-widget><p>Short.</p></div><div class=text-widget><p>{PROSE}</p></div></body>"
    assert main_text(page) == f"{PROSE.strip()} Short. {PROSE.strip()}"


def test_very_long_pages():
    page = "<body><nav>Menu</nav><div>" + f"<p>{PROSE}</p><p>Short.</p>" * 20_000 + "</div><footer>(c)</footer></body>"
    got = main_text(page)
    assert len(page) > 5_000_000 and len(got) == len(f"{PROSE.strip()} Short. ") * 20_000 - 1
