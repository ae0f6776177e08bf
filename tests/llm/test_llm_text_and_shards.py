"""HTML text, Hilbert shards and fingerprints."""

import hashlib
import zlib

from cases import LONG, empty_documents, odd_documents
from pyspark.sql import functions as F

from rolefit.llm import digest, hilbert_shards, html_text, queries

SMALL = "/root/testdata/sf0.01"

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies so that all of this gets better for everyone who reads this long text.</div>
<div class="wrap"><div class="sidebar"><p>Short</p><p>A long paragraph of the sidebar with lots of words that are no part of it.</p></div>
<div class="post"><h2>Title</h2><p>First paragraph of the text which is long enough to matter here.</p><p>Hi.</p><ul><li>one<li>two</ul>
<p>Another &amp; with&nbsp;an entity<br>and   a break.</p><form><label>Mail me</label></form><div class="ad">Buy the thing that everybody buys all the time, now!</div></div>
<div class="comments"><p>I am the comment of a reader, rather long, and not what the author wrote.</p></div></div>
<nav><a href="/x">A menu entry that is long enough to look like text, but is a link</a></nav><script>var t = "</p>";</script><footer>c</footer></body></html>"""
TEXT = "Title\nFirst paragraph of the text which is long enough to matter here.\nHi.\none\ntwo\nAnother & with an entity and a break."


def test_article_without_the_rest():
    assert html_text.extract(PAGE) == TEXT
    assert html_text.extract(PAGE.replace('class="post"', 'class="x"')) == TEXT
    assert html_text.extract("<nav>a<p>b</nav><article><p>Ly. Th.</article><div>A longer line that stands outside of the article here.</div>") == "Ly. Th."


def test_nested_articles_are_whole():
    long = "A long sentence of the body of this article that goes on and on. " * 9
    for tag in ("div", "section", "blockquote", "figure"):
        page = f"<body><p>outside</p><article><h1>Head</h1><p>Lead</p><{tag} class=body><p>{long}</p></{tag}><section><p>Short.</p></section><p><a href=x>More of it</a></p></article></body>"
        assert html_text.extract(page) == f"Head\nLead\n{long.strip()}\nShort.\nMore of it"
    table = f"<main><h1>Head</h1><table><tr><td>{long}</td><td>Cell</td></tr></table><p>End</p></main>"
    assert html_text.extract(table) == f"Head\n{long.strip()}\nCell\nEnd"
    assert html_text.extract(f"<body><div><h1>Head</h1><p>Lead</p><div>{long}</div></div></body>") == f"Head\nLead\n{long.strip()}"


def test_slugs_inside_an_article_are_no_marks():
    page = """<article><h2 id="related-work">Related work</h2><p>Some text of it.</p><h2 id="search">Search</h2><section id="form-and-function"><p>Form.</p></section>
<section id="social-change"><p>Change.</p></section><p class="notice-board">Board.</p><div class="ad">Buy</div><div class="wide related-posts">Others</div>
<div id="newsletter-signup">Mail</div><div class="social-share">Share</div><aside>Aside</aside></article>"""
    assert html_text.extract(page) == "Related work\nSome text of it.\nSearch\nForm.\nChange.\nBoard."


def test_marks_are_whole_names_outside_an_article_too():
    text = "A long sentence of the only text of this page that goes on and on. " * 4
    for start in ('<div class="site has-sidebar">', '<div class="top-story">', '<div id="social-change">', '<div class="post-header">'):
        assert html_text.extract(f"<body>{start}<p>{text}</p></div><div class='site-header'><p>Site</p></div></body>") == text.strip()
    assert html_text.extract("<body><article><p><a href=x>Only a link</a></p><div class=ads><a href=y>Buy</a></div></article><p><a href=z>Other</a></p></body>") == "Only a link"
    for name in ("reader-comments", "user-comments", "google-ads", "adbox", "promo-box-large", "cookie-law-info", "main-nav", "site-footer"):
        assert html_text.extract(f"<article><p>{text}</p><div class={name}><p>{text}</p></div><div id={name}>Some</div></article>") == text.strip()


def test_broken_and_empty_pages():
    assert html_text.extract("") == "" and html_text.extract("<nav>x</nav>") == ""
    assert html_text.extract("plain &lt;text&gt;") == "plain <text>"
    assert html_text.extract("<div class=ad><p>open<article><p>the text<p>goes on") == "the text\ngoes on"
    assert html_text.extract("<p>a</b></div></p>b<") in ("a\nb<", "a\nb")
    assert html_text.extract("<p>" + LONG) == LONG
    assert html_text.extract("<div>" * 2_000 + "deep") == "deep"


def test_pages_of_the_small_table(spark):
    import re

    rows = queries.QUERIES["op5_html_text"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    import html
    for r in rows:
        body = r.html[r.html.find("<article>") + 9:r.html.rfind("</article>")].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|div)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "x", 3), (1, "u", None, "x", 3), (None, None, PAGE, "x", None), (3, "v", "", "x", 1)],
                                  "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0)] * 2 + [(None, None, TEXT, len(TEXT)), (3, "v", "", 0)], key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        cells = spark.range(2 ** (dims * bits)).select(*(F.shiftright("id", k * bits).bitwiseAND(F.lit(2 ** bits - 1)).alias(f"c{k}") for k in range(dims)))
        rows = cells.withColumn("h", hilbert_shards.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(len(rows)))
        assert all(sum(abs(x - y) for x, y in zip(a[:dims], b[:dims])) == 1 for a, b in zip(rows, rows[1:]))


def check_law(rows, shards=40):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    ordered = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)


def test_shards_of_the_small_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_hilbert_shards"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    check_law(rows)


def test_shards_prune_in_several_dimensions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.QUERIES["op6_hilbert_shards"](spark, SMALL).join(docs, "doc_id")
    mean = rows.groupBy("shard").agg(F.countDistinct("lang").alias("l"), F.countDistinct("source").alias("s")).agg(F.avg("l"), F.avg("s")).first()
    assert mean[0] < 2.5 and mean[1] < 10  # of 4 and 20


def test_shards_of_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    got = hilbert_shards.assign(docs, 4)
    rows = got.collect()
    assert len(rows) == docs.count()
    check_law(rows, 4)
    assert [(r["size"], r.text_crc32) for r in rows if r.doc_id == 2] == [(16, 0)]
    assert hilbert_shards.assign(empty_documents(spark)).count() == 0
    check_law(hilbert_shards.assign(docs, 40).collect())
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    hilbert_shards.write_shards(whole.drop("shard"), hilbert_shards.assign(whole, 3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == whole.count()


def test_digest_scores():
    a, b = " ".join(f"alpha{i}" for i in range(400)), " ".join(f"{i * 7919 % 1000} beta" for i in range(400))
    x, y, z = digest.fingerprint(a), digest.fingerprint(a.replace("alpha7", "gamma")), digest.fingerprint(b)
    assert digest.difference(x, x) == 0 and digest.likeness(x, x) == 1.0
    assert digest.difference(x, y) == digest.difference(y, x) and digest.likeness(x, y) > digest.likeness(x, z)
    top = digest.LENGTH_CAP + 2 * digest.RATIO_CAP + 6 * digest.BUCKETS
    assert 0 < digest.difference(x, z) <= top
    for text in ("", "a", "ab", "abc", LONG):
        assert digest.fingerprint(text) == digest.fingerprint(str(text)) and len(digest.fingerprint(text)) == 4 + digest.BUCKETS // 2


def brute_neighbours(rows):
    rows = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (k, own), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(own)
        edited = own[:n - n // 2] + after[:n // 2]
        f = [digest.fingerprint(t) for t in (own, edited, after)]
        out.append((k, n, hashlib.sha256(edited.encode()).hexdigest(), f[0], f[1], digest.likeness(f[0], f[1]), digest.likeness(f[0], f[2])))
    return sorted(out, key=str)


def test_neighbours(spark):
    for docs in (odd_documents(spark), odd_documents(spark).where("doc_id is not null"), odd_documents(spark).limit(1), spark.read.parquet(f"{SMALL}/documents.parquet")):
        docs = docs.cache()
        for ranges in ("1", "3", "16"):
            before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            got = sorted(map(tuple, digest.neighbours(docs).collect()), key=str)
            spark.conf.set("spark.sql.shuffle.partitions", before)
            assert got == brute_neighbours(docs.collect())
    assert digest.neighbours(empty_documents(spark)).count() == 0
    assert digest.fingerprints(odd_documents(spark)).count() == 11
