"""Pages within pages: any depth, odd input, limits."""

from __future__ import annotations

import html as entities

from pyspark.sql import functions as F

from quire.operators import nested as N
from quire.operators import pages as P

SCHEMA = "page_id long, html string"


def framed(inner: str) -> str:
    return '<iframe srcdoc="' + inner.replace("&", "&amp;").replace('"', "&quot;") + '"></iframe>'


def nest(depth: int, leaf: str, around: str = "") -> str:
    page = leaf
    for _ in range(depth):
        page = around + framed(page)
    return page


def rows(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), SCHEMA)


def by_id(df):
    return {r["page_id"]: r for r in df.collect()}


def test_nothing_is_lost_at_any_depth(spark):
    deep = nest(7, '<script>x()</script><p onclick="f()">leaf</p>', '<b onload=g()>"&amp;"</b>')
    found = by_id(N.deeply_sanitized(rows(spark, deep, None, "", "no markup", "<p>a</p>")))
    assert found[0]["html"] == nest(7, "<p>leaf</p>", '<b>"&amp;"</b>')
    assert [found[k]["html"] for k in (1, 2, 3, 4)] == [None, "", "no markup", "<p>a</p>"]
    assert all(r["error"] is None for r in found.values())


def test_pages_too_deep_are_refused_not_cut(spark):
    found = by_id(N.deeply_sanitized(rows(spark, nest(4, "<script>x</script>leaf"), nest(3, "<script>x</script>leaf"), "<p>"), deepest=3))
    assert (found[0]["html"], found[0]["error"]) == (None, "frame.depth")
    assert (found[1]["html"], found[1]["error"]) == (nest(3, "leaf"), None) and found[2]["error"] is None


def test_several_frames_and_repeated_attributes(spark):
    page = '<p>a</p><iframe srcdoc="<script>1</script>x" srcdoc="<script>2</script>" data-pa-frame-base="u"></iframe><frame title=t srcdoc=\'<b onclick=f()>y</b>\'>' + "<iframe srcdoc></iframe>" + framed("")
    found = by_id(N.deeply_sanitized(rows(spark, page)))
    assert found[0]["html"] == '<p>a</p><iframe srcdoc="x"></iframe><frame title=t srcdoc="<b>y</b>">' + '<iframe srcdoc=""></iframe>' * 2


def test_freezing(spark):
    style = N._FREEZE
    pages = {
        "<!DOCTYPE html><html><head><title>t</title></head><body>b</body></html>": f"<!DOCTYPE html><html><head><title>t</title>{style}</head><body>b</body></html>",
        "<html><body>b": f"<html>{style}<body>b",
        "<html>b": f"<html>{style}b",
        "<!doctype html>b<p>c": f"<!doctype html>{style}b<p>c",
        "text": f"{style}text",
        f"<head>{style}</head>x": f"<head>{style}</head>x",
        '<p><template shadowrootmode="open">a<template>b</template>c': f'{style}<p><template shadowrootmode="open">a<template>b</template>c{style}',
        '<template shadowrootmode="open"><template shadowrootmode="closed">x</template></template><template>y</template>': f'{style}<template shadowrootmode="open"><template shadowrootmode="closed">x{style}</template>{style}</template><template>y</template>',
    }
    found = by_id(N.safe_static(rows(spark, *pages, None)))
    assert [found[k]["html"] for k in range(len(pages))] == list(pages.values())
    assert found[len(pages)]["html"] is None
    # a second time changes nothing
    again = by_id(N.safe_static(rows(spark, *pages.values())))
    assert [again[k]["html"] for k in range(len(pages))][:6] == list(pages.values())[:6]


def test_reports_and_fallbacks_by_depth(spark):
    page = "<script></script>" + framed('<p onclick="">' + framed('<a href="javascript:x"><img data-pa-visual-fallback="k" src=a>')) + framed("<script></script>")
    reports = {r["depth"]: tuple(r)[2:] for r in N.document_reports(rows(spark, page)).collect()}
    assert reports == {0: (1, 1, 0, 0), 1: (2, 1, 1, 0), 2: (1, 0, 0, 1)}
    pictures = spark.createDataFrame([(0, "k", 'data:x"y'), (0, "none", "data:z")], "page_id long, id string, data_url string")
    found = by_id(N.with_fallbacks(rows(spark, page, "<p>"), pictures))
    inner = entities.unescape(entities.unescape(found[0]["html"]))
    assert '<img src="data:x&quot;y">' in inner and "visual-fallback" not in inner and found[1]["html"] == "<p>"
    assert {(r["id"], r["depth"], r["error"]) for r in N.fallback_outcomes(rows(spark, page), pictures).collect()} == {("k", 2, None), ("none", None, "transform.visual_fallback")}
    empty = spark.createDataFrame([], SCHEMA)
    assert N.safe_static(empty).collect() == [] and N.document_reports(empty).collect() == []


def test_pieces_are_the_page_and_only_read_values_are_decoded(spark):
    pages = ["", "a < b <p>c<", "<<p>x</p", "<script>'<b>'</script ><!-- <p>", "<!doctype html>\n<p a='>'>&amp;<"]
    found = spark.createDataFrame([(p,) for p in pages], "html string").select("html", P.pieces(F.col("html")).alias("p")).collect()
    assert all("".join(r["p"]) == r["html"] for r in found)
    assert found[1]["p"] == ["a ", "<", " b ", "<p>", "c", "<"] and found[3]["p"] == ["<script>'<b>'</script >", "<!-- <p>"]
    token = spark.createDataFrame([('<a B="&quot;" c=&amp;>',)], "t string").select(*[P.written(F.col("t"), *v).alias(k) for k, v in {"all_": (), "b": (("b",),), "none": ((),)}.items()]).first()
    assert [tuple(a) for a in token["all_"]] == [("b", '"', 'B="&quot;"'), ("c", "&", "c=&amp;")]
    assert [a["value"] for a in token["b"]] == ['"', None] and [a["value"] for a in token["none"]] == [None, None]
    assert all([(a["name"], a["raw"]) for a in token[k]] == [(a["name"], a["raw"]) for a in token["all_"]] for k in ("b", "none"))


def test_many_shadow_roots_in_one_document(spark):
    opening, style = '<template shadowrootmode="open">', N._FREEZE
    pages = {
        opening * 4_000 + "x" + "</template>" * 4_000: style + opening * 4_000 + "x" + f"{style}</template>" * 4_000,
        (opening + "</template>") * 4_000: style + (opening + style + "</template>") * 4_000,
        f"</template>{opening}<template>a</template></template></template>{opening}b": f"{style}</template>{opening}<template>a</template>{style}</template></template>{opening}b{style}",
    }
    found = by_id(N.safe_static(rows(spark, *pages)))
    assert [found[k]["html"] for k in range(len(pages))] == list(pages.values())


def test_freezing_is_a_projection_and_levels_are_dealt(spark):
    from quire.plans import QUERIES

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = rows(spark, "<p>").select("page_id", F.array().cast("array<int>").alias("path"), "html")
    assert not any(x in plan(N.frozen(docs)) for x in ("Exchange", "Join", "Window", "Union"))
    whole = plan(QUERIES["safe_static_pages"](spark, "/root/testdata/sf0.001"))
    # one join puts the level below into the pages, which are dealt once
    assert whole.count("SortMergeJoin") == 1 and whole.count("Exchange") == 2 and whole.count("REPARTITION_BY_NUM") == 1
