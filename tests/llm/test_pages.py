"""Main text of pages, and archives."""
import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkbook.llm import archive, html_text

FRAME = ('<html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>'
         '<nav><a href="/a">Menu</a></nav><header>Site</header><div id="cookie-notice">We use, cookies, many, of them</div>'
         '{}<aside>Side, bar, text, with, commas</aside><div class="comments"><article class="comment"><p>Great, really, '
         'great, post, thanks, a, lot</p></article></div><form><p>Your, mail, here</p></form><footer>&copy; x</footer></body></html>')


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a &lt; b &amp;amp; c&nbsp;d", "a < b &amp; c d"),
    (FRAME.format("<article><h1>Head</h1><p><b>One.<br><p>Two, three.</p></article>"), "Head\nOne.\nTwo, three."),
    (FRAME.format("<article><p>Short.</p></article>"), "Short."),
    (FRAME.format("<article></article>"), ""),
    (FRAME.format('<div id="content"><div class="has-sidebar"><p>First, of, all.</p><ul><li>x, y</li></ul></div></div>'),
     "First, of, all.\nx, y"),
    (FRAME.format('<main><p>Text, here, it, is.</p><ul><li><a>l1</a></li><li><a>l2</a></li><li><a>l3</a></li></ul></main>'),
     "Text, here, it, is."),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<p>cut <a href='x>y'>link</a> off <b", "cut link off"), ("a < b", "a < b"), ("<div>" * 30_000 + "deep", "deep"),
    ("<p>x</b></i></div></article>y<!-- c", "xy"), ("<script>var x='<p>'", ""),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def pages(spark):
    big = "<p>" + "word " * 400
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://b c/9", big), (3, None, "small"), (4, "ftp://x", "small"),
            (5, "http://a/5", None), (6, "http://a/6", ""), (7, "https://ü/7", "é" * 600), (8, "http://a/8", "é" * 600),
            (8, "http://a/8", "é" * 600), (None, "http://n", big), (10, "http://a/10", "x" * 1000), (11, "http://a/11", "x" * 1000),
            (12, "http://a/12", "x" * 999), (13, "http://a/13", "x" * 999), (14, "http://a/14", "<p>line\r\n\r\nHTTP/1.1 200 OK\r\n" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for c in ("id", "u", "h", "file", "digest", "text", "number"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_extract_text(spark):
    df = pages(spark)
    got = Counter(map(tuple, html_text.extract_text(df).collect()))
    want = Counter((r["page_id"], r["url"], t := html_text.main_text(r["html"]), len(t)) for r in df.collect())
    assert got == want
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_archive_round_trip(spark):
    df = pages(spark)
    got = archive.archive_pages(df).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    top = defaultdict(lambda: None)
    for i, h in rows:
        if i is not None and len(h) >= 1000:
            top[h] = max(i, top[h] or i)
    size = Counter(h for _, h in rows)
    want = Counter()
    for i, h in rows:
        want[i, len(h), hashlib.sha1(h).hexdigest()] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    by_digest = defaultdict(list)
    for r in got:
        by_digest[r["payload_digest"]].append(r)
    for h in size:
        same = by_digest[hashlib.sha1(h).hexdigest()]
        first = [r for r in same if r["record_type"] == "response"]
        if len(h) < 1000:
            assert len(first) == len(same)
        else:
            assert len(first) == 1 and first[0]["page_id"] == top[h]
            assert all(r["refers_to"] == top[h] for r in same if r["record_type"] == "revisit")
    assert len({r["record_id"] for r in got}) == len(got)
    assert archive.archive_pages(df.limit(0)).count() == 0


def arc(version, name="a.arc", records=()):
    out = archive.arc_version_block(version, name)
    for url, kind, content in records:
        out += archive.arc_header(version, {"URL": url, "IP-address": "1.2.3.4", "Archive-date": "19970102030405",
                                            "Content-type": kind, "Result-code": "200", "Archive-length": str(len(content))})
        out += content + b"\n"
    return out


@pytest.mark.parametrize("version", ["1", "2"])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_versions(version, packed):
    http = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nbody\n\nwith lines"
    data = arc(version, records=[("http://x/ y", "text/html", http), ("dns:x", "text/dns", b"x 1.2.3.4")])
    data = gzip.compress(data) if packed else data
    got = list(archive.arc_records(io.BufferedReader(io.BytesIO(data))))
    assert [h["URL"] for h, _ in got] == ["filedesc://a.arc", "http://x/%20y", "dns:x"]
    assert [c for _, c in got][1:] == [http, b"x 1.2.3.4"]
    warc = b"".join(archive.convert_record("a.arc", k, h, c) for k, (h, c) in enumerate(got))
    recs = list(archive.warc_records(io.BufferedReader(io.BytesIO(warc))))
    assert [f["WARC-Type"] for f, _ in recs] == ["warcinfo", "response", "resource"]
    assert recs[1][0]["WARC-Date"] == "1997-01-02T03:04:05Z" and recs[1][0]["WARC-IP-Address"] == "1.2.3.4"
    assert recs[1][0]["WARC-Payload-Digest"] == archive.labelled(hashlib.sha1(b"body\n\nwith lines").digest())
    assert recs[1][1] == http and recs[2][1] == b"x 1.2.3.4"


def test_broken_archives_fail():
    cut = arc("1", records=[("http://x", "text/html", b"HTTP/1.0 200\r\n\r\nabc")])[:-5]
    for data in (cut, b"http://x 1.1.1.1 1 text/html 3\nabc\n", arc("1").replace(b"1 0 ink", b"7 0 ink")):
        with pytest.raises(ValueError):
            list(archive.arc_records(io.BufferedReader(io.BytesIO(data))))


@pytest.mark.parametrize("html, text", [
    # an article's own header: its headings stay, the rest of it goes
    ("<body><nav><a href=/>Home</a></nav><article><header class='article-header'><h1>The title</h1><p class=byline>By A</p>"
     "</header><p>One, two, three words of it.</p></article></body>", "The title\nOne, two, three words of it."),
    ("<body><header><h1>Site name</h1></header><article><p>One, two, three words of it.</p></article></body>",
     "One, two, three words of it."),
    # names that merely hold a word of a menu or notice
    ("<article><p>Intro text, and more of it.</p><section id='related-work'><h2>Related work</h2><p>Others did this, and well."
     "</p></section><div class='related-posts'><p>Other text</p></div><div class='user-comments'><p>Nice</p></div></article>",
     "Intro text, and more of it.\nRelated work\nOthers did this, and well."),
    ("<div><p>Intro text, and more of it here.</p><p class='share-price'>A share rose, by ten.</p><p class='share'>Share this</p>"
     "</div>", "Intro text, and more of it here.\nA share rose, by ten."),
    # a list of links is text inside an article
    ("<article><p>Intro text, and more of it.</p><ul><li><a href=a>First</a></li><li><a href=b>Second</a></li>"
     "<li><a href=c>Third</a></li></ul></article>", "Intro text, and more of it.\nFirst\nSecond\nThird"),
    # a heading in a box of its own beside the text
    ("<body><div><h1>The title</h1></div><div><p>Intro text, and more of it here.</p><p>A second one, long enough to count."
     "</p></div></body>", "The title\nIntro text, and more of it here.\nA second one, long enough to count."),
])
def test_parts_of_an_article_stay(html, text):
    assert html_text.main_text(html) == text
