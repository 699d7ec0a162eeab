"""HTML extraction (3) and the WARC archive (4)."""

import base64
import hashlib

import pytest

from divspark.llm import op4_warc_archive as W
from divspark.llm.common import Workspace
from divspark.llm.html_blocks import main_text
from divspark.llm.op3_html_extraction import extract, host_of
from tests.llm import helpers as H  # noqa: F401

PAGE = ("<html><body><div id='top-nav'><a href=/>Home</a></div><div class='wrap'>{0}</div>"
        "<div class='comments'><p>Lovely, lovely, lovely post, I could read this all day, every day, and on Sundays.</p></div>"
        "<footer>(c) 2024</footer></body></html>")


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain text", "plain text"),
    ("<p>a &amp; b<br>c\n\n d</p><p>e</p>", "a & b c d\n\ne"),
    ("<article><h1>T</h1><p>x<script>var a='</p>';</script> y</p><style>p{}</style></article>", "T\n\nx y"),
    ("<body><nav><ul><li>m</ul></nav><main><header><h1>T</h1></header><p>one<p>two</main><footer>f</footer>", "T\n\none\n\ntwo"),
    ("<body><form><div class=content><p>long text here<p>and more</div><input></form>", "long text here\n\nand more"),
    ("<article><p>a</p><aside>side</aside><div class='ad-box'>buy</div><form><label>Mail</label></form><p>b</p></article>",
     "a\n\nb"),
    ("<nav><ul><li>x<article><p>an unclosed menu does not hide this</p></article>", "an unclosed menu does not hide this"),
    ("<article><p>a <!-- <p>no</p> --> &lt;tag&gt; <b>bold</b> &#233;</p></article>", "a <tag> bold é"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\n\ntwo\n\nc1\n\nc2"),
    ("<body><div hidden><p>secret</p></div><p>seen</p><p style='display: none'>no</p></body>", "seen"),
    ("<article><p>open < close and 3 > 2</p>", "open < close and 3 > 2"),
])
def test_main_text(html, text):
    assert main_text(html, None) == text


def test_comments_longer_than_the_article_lose(spark):
    html = PAGE.format("<div class='post-12'><h1>Title</h1><p>Short article.</p></div>")
    assert main_text(html, None) == "Title\n\nShort article."


ARTICLE = "The long text of an article, with commas, and more of it. " * 12


@pytest.mark.parametrize("html", [
    "<div class='content no-sidebar'><p>{0}</div>", "<div class='has-sidebar'><p>{0}</div>", "<div class='with-banner'><p>{0}</div>",
    "<article class='post category-legal'><p>{0}</article>", "<article><p class='notice'>{0}</article>", "<div id='ad-1'><p>{0}</div>",
    "<div class='page sidebar-right'><p>{0}</div><div class='byline'><p>By A. Person, for the Paper, in a Town</div>",
    "<div class='sidebar-layout'><div class='text'><p>{0}</div><div class='sidebar'><p>Other things, short.</div></div>",
    "<article class='post'><p>{0}</p><section id='comments'><article class='comment'><p>Nice.</article></section></article>",
    "<article class='post'><p>{0}</article><div id='comments'><article class='comment'><p>" + "Nice, nice. " * 40 + "</article></div>"])
def test_class_words_drop_no_article(html):
    page = "<body><nav><a href=/>Home</a></nav>" + html.format(ARTICLE) + "<footer>(c)</footer>"
    assert main_text(page, None) == ARTICLE.strip()


def test_host_consensus_overrules_a_single_page(spark):
    good = PAGE.format("<div class='post-1'><h1>T</h1><p>{0}</p></div>")
    rows = [(k, f"https://www.Host.example/{k}", good.format("words and more words, " * 20)) for k in range(8)]
    odd = PAGE.format("<div class='post-2'><p>Brief.</p></div><div class='links'><p>" + "unrelated list of things, " * 30 + "</p></div>")
    rows += [(8, "http://host.example:80/x", odd), (9, None, None), (10, "not a url", "<p>alone</p>"), (None, None, ""),
             (11, "https://host.example/e", "<html></html>"), (12, "https://host.example/p", "<main><p>another template</p></main>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    df = df.withColumn("path", df["url"]).withColumn("host", df["url"]).withColumn("text", df["url"])
    got = {r["page_id"]: r for r in extract(df).collect()}
    assert len(got) == len(rows)
    assert got[8]["text"] == "Brief."
    assert got[12]["text"] == "another template" and got[10]["text"] == "alone"
    assert [got[k]["text"] for k in (9, None, 11)] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract(df.limit(0)).count() == 0


def test_a_host_keeps_several_templates(spark):
    major = PAGE.format("<div class='post'><p>" + ARTICLE + "</p></div>")
    minor = PAGE.format("<div class='post'><p>By A. Person, in a Town.</p></div><div class='story'><p>" + ARTICLE + "</p></div>")
    rows = [(k, "https://host.example/", minor if k % 4 == 0 else major) for k in range(24)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == 24 and {r["text"] for r in got} == {ARTICLE.strip()}


def test_host_of(spark):
    df = spark.createDataFrame([("https://User@WWW.A.example:8080/x?y",), (None,), ("nothing",), ("ftp://b.c",)], "u string")
    assert [r[0] for r in df.select(host_of(df["u"])).collect()] == ["a.example", "", "", "b.c"]


PAGES = [(3, "https://a.example/", "<p>é</p>"), (1, "https://b.example/", "<p>é</p>"), (2, None, "<p>é</p>"), (4, "u", None),
         (5, "u\r\nX: 1", ""), (6, "u", "big " * 30000), (None, "u", "<p>é</p>"), (None, "u", "nul"), (7, "w", "seven"),
         (7, "w", "seven"), (8, "x", "end\r\n\r\n"), (9, "y", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n")]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for c in ("payload", "address", "first", "row", "header", "key"):
        df = df.withColumn(c, df["url"])
    return df


@pytest.mark.parametrize("least", [0, 6])
def test_archive_against_brute_force(spark, least):
    got = sorted((tuple(r) for r in W.archive(pages(spark), min_bytes=least).collect()), key=repr)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want, seen = [], set()
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (h or "").encode()
        again = (h or "") in seen and len(raw) >= least
        seen.add(h or "")
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                     first[h or ""] if again else None))
    assert got == sorted(want, key=repr)


def test_archive_round_trip(spark):
    ws = Workspace(spark, "t")
    records, payloads = W.write_archive(ws, pages(spark))
    stored = [bytes(r["payload"]) for r in payloads.collect()]
    assert sorted(stored) == sorted({(h or "").encode() for *_, h in PAGES})  # each payload once
    whole = W.read_records(records, payloads).collect()
    assert sorted(bytes(r["payload"]) for r in whole) == sorted((h or "").encode() for *_, h in PAGES)
    ids = set()
    for r in whole:
        raw = bytes(r["record"])
        head, rest = raw.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(rest) - 4
        assert "X" not in fields
        ids.add(fields["WARC-Record-ID"])
        if fields["WARC-Type"] == "response":
            assert rest[:-4].split(b"\r\n\r\n", 1)[1] == bytes(r["payload"])
    assert len(ids) == len(PAGES)
    for r in whole:
        ref = W.field
        head = bytes(r["header"]).decode()
        if "WARC-Refers-To:" in head:
            assert head.split("WARC-Refers-To: ")[1].split("\r\n")[0] in ids
    assert ref is W.field


def test_archive_detects_a_changed_payload(spark):
    from pyspark.sql import functions as F

    ws = Workspace(spark, "t")
    records, payloads = W.write_archive(ws, pages(spark))
    bad = payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    with pytest.raises(Exception, match="does not match its address"):
        W.archive_index(records, bad).collect()


def test_empty_archive(spark):
    assert W.archive(pages(spark, []).limit(0)).count() == 0


def test_archive_index_reads_the_rebuilt_bytes(spark):
    """A record that is cut short, or whose header lies about its length, is refused."""
    from pyspark.sql import functions as F

    from divspark.llm import op4_warc_archive as A
    from divspark.llm.common import Workspace
    pages = spark.createDataFrame([(1, "http://a/", "<p>\r\n\r\nWARC-Type: revisit\r\n</p>"), (2, "http://b/", "é" * 50),
                                   (3, "http://c/", "é" * 50), (4, None, "")], "page_id long, url string, html string")
    records, payloads = A.write_archive(Workspace(spark, "warc-test"), pages)
    got = {r["page_id"]: r for r in A.archive_index(records, payloads).collect()}
    assert {k: (r["record_type"], r["payload_bytes"], r["refers_to"]) for k, r in got.items()} == {
        1: ("response", 31, None), 2: ("response", 100, None), 3: ("revisit", 100, 2), 4: ("response", 0, None)}
    text = F.decode("header", "utf-8")
    lying = records.withColumn("header", F.encode(F.regexp_replace(text, "(?s)\r\nContent-Length: (\\d+)\r\n\r\nHTTP",
                                                                   "\r\nContent-Length: 9$1\r\n\r\nHTTP"), "utf-8"))
    with pytest.raises(Exception, match="record length"):
        A.archive_index(lying, payloads).collect()


@pytest.mark.parametrize("part, kept", [
    ("<section class='side-effects'><p>Part of it.</p></section>", True),
    ("<section class='related-work'><p>Part of it.</p></section>", True),
    ("<section class='related-work'><p><a href='/x'>Part of it.</a></p></section>", False),
    ("<div class='article-bottom'><p>Part of it.</p></div>", True),
    ("<div class='form-factor'>Part of it.</div>", True),
    ("<p>As <math><mi>Part of it.</mi><annotation>x^2</annotation></math></p>", True),
    ("<div class='ad-slot-3'>Part of it.</div>", False),
    ("<div class='post-footer'>Part of it.</div>", False),
    ("<p>Words <span class='notice'>Part of it.</span></p>", False),
    ("<div class='comments'><p>Part of it.</p></div>", False)])
def test_named_parts_of_an_article(part, kept):
    got = main_text("<article><p>" + "Plain words of a story, long enough to be one. " * 6 + f"</p>{part}</article>", None)
    assert ("Part of it." in got) == kept and "x^2" not in got


@pytest.mark.parametrize("html, words", [
    ("<div class='a b'>x" * 60_000, 60_000),
    ("<section><article>" + "<div>x" * 50_000 + "</section>" * 50_000, 50_000)])
def test_deep_nesting_is_linear(html, words):
    import time
    start = time.time()
    assert main_text(html, None).count("x") >= words / 60_000      # 1 MB; what is chosen varies
    assert time.time() - start < 30


def host_pages(templates):
    """Pages of one host by as many templates, four to six each, and of a host with one."""
    out = []
    for k in range(templates):
        tag = "abcdefghij"[k // 10] + "abcdefghij"[k % 10]
        for c in range(4 + k % 3):
            body = f"<div class='t{tag}'><p>Story {tag} {c}, " + "words that go on, " * (3 + c) + "</p></div>"
            side = f"<div class='s{tag}'><p>Other text of {tag}, " + "much of it, " * (2 + 3 * c) + "</p></div>"
            out.append((len(out), "https://many.example/x", f"<body>{body}{side}</body>"))
    return out + [(1000 + k, "https://one.example/y", f"<main><p>One {k}.</p></main>") for k in range(3)] + \
        [(2000, None, "<p>No host</p>"), (2001, "https://one.example/y", None), (2002, "https://lone.example", "<p>a</p>")]


def test_votes_against_brute_force(spark, monkeypatch):
    from collections import Counter, defaultdict

    from divspark.llm import op3_html_extraction as X
    from divspark.llm.html_blocks import best_path, read_page
    pages = host_pages(100)
    host = {u: (u or "").removeprefix("https://").split("/")[0] for _, u, _ in pages}
    votes, n = defaultdict(float), Counter()
    for _, u, h in pages:
        path, share = best_path(read_page(h or "")[0])
        if path:
            votes[host[u], path] += share
            n[host[u], path] += 1
    kept = defaultdict(dict)
    for (o, p), v in sorted(votes.items(), key=lambda x: (-round(x[1], 6), x[0][1])):
        if n[o, p] > 1 or not any(q == o and c > 1 for (q, _), c in n.items()) and not kept[o]:
            kept[o][p] = v
    assert len(kept["many.example"]) > X.AT_ONCE
    want = sorted((i, main_text(h or "", kept[host[u]])) for i, u, h in pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    for at_once in (X.AT_ONCE, 10_000, 0):      # by host, by page, and both: one result
        monkeypatch.setattr(X, "AT_ONCE", at_once)
        assert sorted((r["page_id"], r["text"]) for r in X.extract(df).collect()) == want
