"""Column functions on odd values: nulls, empty text, long text, other scripts."""

from __future__ import annotations

import string

from hypothesis import HealthCheck, given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import media, network, settings, text, urls
from quire.operators import pages


def values(spark, inputs, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", column(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_nulls_stay_null_or_have_their_default(spark):
    for f in (urls.scheme, urls.page_url, urls.redacted, text.markdown_escaped, media.essence, settings.seconds, settings.byte_size, network.v4_class):
        assert values(spark, [None], f) == [None]
    assert values(spark, [None, ""], text.file_stem) == ["capture", "capture"]
    assert values(spark, [None, ""], lambda x: urls.join(x, F.lit("a"))) == [None, None]


def test_page_url(spark):
    assert values(spark, ["https://h", "http://h/a#b", "ftp://h/", "mailto:x", " https://H.example/Q?x#y ", "HTTP://EX.com:80/a/../b", "https://u:p@h:0443/./x?q", "http://h:8080", "http://münchen.de/é", "http://[::1]:80/"], urls.page_url) == ["https://h/", "http://h/a", None, None, "https://h.example/Q?x", "http://ex.com/b", "https://u:p@h/x?q", "http://h:8080/", "http://münchen.de/é", "http://[::1]/"]
    joined = lambda x: urls.join(F.lit("http://a.example/x/y"), x)
    assert values(spark, ["HTTP://münchen.DE:80/é/./b", "//H/ä", "HTTPS://x"], joined) == ["http://münchen.de/%C3%A9/b", "http://h/%C3%A4", "https://x/"]


def test_file_stem_is_bounded_and_portable(spark):
    found = values(spark, ["É" * 300, "con", "a/b\\c", "---", "Ünï çödé 9", "x" * 200], text.file_stem)
    assert all(len(x.encode()) <= 96 for x in found)
    assert found[1:5] == ["capture", "a-b-c", "capture", "ünï-çödé-9"]


@hypothesis_settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=1, max_size=40))
def test_clamped_ends_between_characters(spark, inputs):
    inputs = [x.replace("\0", "") for x in inputs]
    inputs = [x.encode("utf-8", "ignore").decode() for x in inputs]
    for before, after in zip(inputs, values(spark, inputs, lambda x: text.clamped(x, 20))):
        assert after == before or (before.startswith(after[:-1]) and len(after[:-1].encode()) <= 20 and after[-1] == "…")


@hypothesis_settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=40))
def test_data_urls_round_trip(spark, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, b binary").select("i", "b", media.decoded(media.data_url(F.lit("image/png"), F.col("b"))).alias("d")).collect()
    assert all(bytes(r["d"]["body"]) == bytes(r["b"]) and r["d"]["error"] is None for r in rows)


def test_markdown_escape_covers_all_punctuation(spark):
    assert values(spark, [string.punctuation], text.markdown_escaped) == ["".join("\\" + c for c in string.punctuation)]


def test_sanitized_pages(spark):
    html = ['<p onClick = "x" class=a>t</p>', "<a href='java\tscript:1'>x</a>", "<script>1<p></script>ok", "", "no markup < 3", '<script type="application/ld+json">{}</script>', "<BASE href=x><Link rel='dns-prefetch' href=y>z"]
    assert values(spark, html, pages.sanitized) == ["<p class=a>t</p>", "<a>x</a>", "ok", "", "no markup < 3", '<script type="application/ld+json">{}</script>', "z"]


ATTACKS = {
    "<svg/onload=alert(1)>": "<svg>",
    '<a href="x"onclick="y()">t</a>': '<a href="x">t</a>',
    '<a href="&#106;avascript:x()">t</a>': "<a>t</a>",
    '<a href="&#x6A;ava&#10;script:x()" title=a>t</a>': "<a title=a>t</a>",
    "<p on-x=1 onclick>t</p>": "<p>t</p>",
    "<img src=x onerror=alert(1)//>": "<img src=x>",
    '<iframe srcdoc="<script>x()</script><p onclick=&quot;y()&quot;>a &amp;amp; b</p>"></iframe>': '<iframe srcdoc="<p>a &amp;amp; b</p>"></iframe>',
    "<iframe srcdoc='<iframe srcdoc=\"<iframe srcdoc=1></iframe>\"></iframe>'></iframe>": '<iframe srcdoc="<iframe></iframe>"></iframe>',
    "<script src=x": "",
    "<!-- <b onclick=x>": "<!-- <b onclick=x>",
    '<p title="<b onclick=x>">t</p>': '<p title="<b onclick=x>">t</p>',
    "<br onclick=x />": "<br/>",
    "a <b": "a <b",
    "<SCRIPT\n>x</SCRIPT >y": "y",
}


def test_sanitizing_leaves_nothing_that_acts(spark):
    found = values(spark, list(ATTACKS), pages.sanitized)
    assert dict(zip(ATTACKS, found)) == ATTACKS
    # what is clean stays, and what was sanitized is clean
    assert values(spark, found, pages.sanitized) == found


def test_tags_of_any_length(spark):
    long = ["<p x=" + "a" * 1_000_000 + ">t", "<b" + " x='1'" * 200_000 + ">t", "<a " * 300_000, '<a "' * 250_000, "<!--" * 250_000, "<script>" * 100_000, "<b before a long text " * 40_000, "<a href='" * 100_000]
    sets = ["a.png 1x, " * 50_000, "(" * 200_000, "x (" + "a" * 200_000]
    rows = spark.createDataFrame([(i, "https://h/", x) for i, x in enumerate(long)], "page_id long, url string, html string")
    assert rows.select(F.length(pages.sanitized(F.col("html"))).alias("n")).agg(F.min("n")).first()[0] >= 0
    assert pages.sanitize_report(rows).count() == len(long) and pages.links(rows).count() >= 0
    assert [len(x) for x in values(spark, sets, pages.srcset_references)][0] == 50_000
    assert len(values(spark, ["image-set(" + "(a)" * 100_000 + ")", "url(" * 100_000, "/*" * 100_000], pages.css_references)) == 3


def test_character_references(spark):
    assert values(spark, ["&amp;lt;", "&#106;&#x6A;&#x1F600;&#0;&#xD800;&#99999999999;", "&eacute;&nope;&apos; & x &", "plain", "&#106avascript"], text.unescaped) == ["&lt;", "jj😀\ufffd\ufffd\ufffd", "é&nope;' & x &", "plain", "javascript"]


def test_data_urls_keep_their_bytes(spark):
    found = values(spark, ["data:image/png,%89PNG%FF", "data:,a%zz%4", "data:;base64,AA%3D%3D", "data:,é"], media.decoded)
    assert [bytes(x["body"]) for x in found] == [b"\x89PNG\xff", b"a%zz%4", b"\0", "é".encode()]


def test_references_of_empty_and_null_pages(spark):
    rows = spark.createDataFrame([(1, "https://h/", None), (2, "https://h/", ""), (3, "https://h/", '<img src="a" src="b">')], "page_id long, url string, html string")
    assert [(r["page_id"], r["resolved"]) for r in pages.references(rows).collect()] == [(3, "https://h/a")]
    assert {r["page_id"]: r["active_elements"] for r in pages.sanitize_report(rows).collect()} == {1: 0, 2: 0, 3: 0}


def test_attributes(spark):
    found = values(spark, ["<a B=1 b=2 c='x y' d checked>"], pages.attributes)[0]
    assert [(a["name"], a["value"]) for a in found] == [("b", "1"), ("c", "x y"), ("d", ""), ("checked", "")]


def test_names_avoid_those_that_exist(spark):
    from quire.operators import scheduling

    wanted = spark.createDataFrame([(1, "a.html"), (2, "a.html"), (3, "a.html"), (4, "b"), (5, "b-1"), (6, "b"), (7, "a-2.html")], "id int, path string")
    taken = spark.createDataFrame([("a.html",), ("a-1.html",), ("c",)], "path string")
    found = {r["id"]: r["path"] for r in scheduling.unique_names(wanted, taken).collect()}
    assert found == {1: "a-3.html", 2: "a-4.html", 3: "a-5.html", 4: "b", 5: "b-1", 6: "b-2", 7: "a-2.html"}


def test_nested_sheets_and_checks_of_empty_tables(spark):
    from quire.operators import checks

    none = spark.createDataFrame([], "page_id int, url string, target string")
    assert checks.nested_sheets(none.select("page_id", "url"), none.select("url", "target"), 3).count() == 0
    records = spark.createDataFrame([], "page_id int, id int, frame_id int, kind string, digest string, bytes bigint, provenance string")
    manifests = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 0, 0), (2, 1, 1, 1, 0, 0, 0, 9)], "page_id int, frames int, discovered int, embedded int, external int, omitted int, failed int, embedded_bytes bigint")
    assert {r["page_id"]: r["error"] for r in checks.record_faults(records, manifests).collect()} == {1: None, 2: "verify.record_count"}


def test_verification_looks_into_frames(spark):
    from quire.operators import artifacts

    pages_ = ["<html><head></head><body><iframe srcdoc=\"<p>fine</p>\"></iframe></body></html>", "<html><head></head><body><iframe srcdoc=\"<p onclick=x>bad</p>\"></iframe></body></html>"]
    rows = spark.createDataFrame(list(enumerate(pages_)), "page_id int, html string").select("page_id", artifacts.encoded(F.col("html"), F.lit("{}")).alias("html"))
    assert {r["page_id"]: r["error"] for r in artifacts.verified(rows).collect()} == {0: None, 1: "verify.active_content"}
