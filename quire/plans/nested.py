"""Queries over pages within pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import nested as N
from quire.plans.registry import query, table

_ESC = "replace(replace({}, '&', '&amp;'), '\"', '&quot;')"


def _nest(page: str, middle: str, inner: str, frame: str) -> str:
    """SQL text of a page with a page within it that has one too; ``frame`` is the outer frame's start tag up to srcdoc."""
    inside = f"{middle} || '<iframe srcdoc=\"' || {_ESC.format(inner)} || '\"></iframe>'"
    return f"{page} || '{frame} srcdoc=\"' || {_ESC.format(f'({inside})')} || '\"></iframe>'"


_MIDDLE, _INNER = "'<p onclick=\"g()\">' || url || '</p>'", "'<script>x()</script><b>' || page_id || '</b><a href=\"javascript:y()\">' || url || '</a><img data-pa-visual-fallback=\"f' || page_id || '\" src=\"x.png\">'"
_PAGE_CLEAN, _MIDDLE_CLEAN = "regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs')", "'<p>' || url || '</p>'"
_INNER_CLEAN = "'<b>' || page_id || '</b><a>' || url || '</a><img data-pa-visual-fallback=\"f' || page_id || '\" src=\"x.png\">'"
_SHADOW = "'<div><template shadowrootmode=\"open\"><i>' || page_id || '</i><template></template>{}</template></div>'"


def _framed(spark: SparkSession, sf_dir: str, inner: str = _INNER) -> DataFrame:
    html = _nest("html", _MIDDLE, inner, '<iframe onload="f()"').replace("page_id ||", "cast(page_id as string) ||")
    return table(spark, sf_dir, "pages").select("page_id", F.expr(html).alias("html"))


@query(f"SELECT page_id, {_nest(_PAGE_CLEAN, _MIDDLE_CLEAN, _INNER_CLEAN, '<iframe')} AS html FROM pages")
def deeply_sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with a page within it that has one within itself: scripts, events and script URLs go at every depth, the rest stays."""
    return N.deeply_sanitized(_framed(spark, sf_dir)).select("page_id", "html")


_FREEZE = N._FREEZE


@query(f"""SELECT page_id, {_nest(f"replace({_PAGE_CLEAN}, '</head>', '{_FREEZE}</head>')", f"'{_FREEZE}' || {_MIDDLE_CLEAN}", f"'{_FREEZE}' || {_INNER_CLEAN} || {_SHADOW.format(_FREEZE)}", '<iframe')} AS html FROM pages""")
def safe_static_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page frozen and sanitized at every depth, shadow roots included."""
    return N.safe_static(_framed(spark, sf_dir, f"{_INNER} || {_SHADOW.format('')}")).select("page_id", "html")


@query("""SELECT page_id, 0 AS depth, 1 AS documents, len(regexp_extract_all(html, '<script[ >]')) AS active_elements, 1 AS event_attributes, 0 AS script_urls FROM pages
UNION ALL SELECT page_id, 1, 1, 0, 1, 0 FROM pages UNION ALL SELECT page_id, 2, 1, 1, 0, 1 FROM pages""")
def document_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What acts in the documents of each depth."""
    return N.document_reports(_framed(spark, sf_dir))


_PICTURE = "'data:image/png;base64,' || page_id || '=='"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where("page_id % 3 <> 0")
    return rows.select("page_id", F.concat(F.lit("f"), (F.col("page_id") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).cast("string")).alias("id"), F.concat(F.lit("data:image/png;base64,"), F.col("page_id").cast("string"), F.lit("==")).alias("data_url"))


@query(f"""SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN {_nest("html", _MIDDLE, _INNER.replace('<img data-pa-visual-fallback="f', '<img src="').replace("page_id || '\" src=\"x.png\">'", _PICTURE + " || '\">'"), '<iframe onload="f()"')} ELSE {_nest("html", _MIDDLE, _INNER, '<iframe onload="f()"')} END AS html FROM pages""")
def fallback_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures put where their markers stand, two pages deep; markers without a picture stay."""
    return N.with_fallbacks(_framed(spark, sf_dir), _pictures(spark, sf_dir)).select("page_id", "html")


@query("""SELECT page_id, 'f' || (page_id + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END) AS id, CASE WHEN page_id % 5 <> 0 THEN 2 END AS depth, CASE WHEN page_id % 5 = 0 THEN 'transform.visual_fallback' END AS error FROM pages WHERE page_id % 3 <> 0""")
def fallback_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fallback_outcomes(_framed(spark, sf_dir), _pictures(spark, sf_dir))
