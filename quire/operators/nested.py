"""Pages within pages: ``srcdoc`` documents at any depth, unnested into rows and folded back leaf first.

A page's inner documents are rows with a path (the places of the tokens that
hold them, outermost first). One level is taken out of the one above it until a
level is empty; then the deepest level is rewritten and put into its parents by
one join, and so on up. A row never holds more than one document and the
documents directly within it. Pages without a ``srcdoc`` take no part in the
joins. Depths beyond the limit refuse the page instead of losing what is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import urls
from quire.operators.pages import TOKEN, attribute, attribute_text, head_of, is_token, pieces, rebuilt, sanitize_report, sanitized, written
from quire.sources.levels import Levels

DEEPEST = 64
# What keeps a captured page from moving.
FREEZE_CSS = "*,*::before,*::after{animation-play-state:paused!important;transition:none!important;caret-color:transparent!important}"
FREEZE_ATTRIBUTE, BASE_ATTRIBUTE, FALLBACK_ATTRIBUTE = "data-pa-freeze", "data-pa-frame-base", "data-pa-visual-fallback"
# Tags by which a document's parts are known.
_PAGE_TAG, _TEMPLATE = r"(?i)^<(/head|body|html)(?=[\s/>]|\z)", r"(?i)^</?template(?=[\s/>]|\z)"
_FREEZE = f'<style {FREEZE_ATTRIBUTE}="">{FREEZE_CSS}</style>'


def _tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), 0)


def _opens(token: Column) -> Column:
    return token.rlike("^<[a-zA-Z]")


def _framed(html: Column) -> Column:
    return F.coalesce(F.lower(html).contains("srcdoc"), F.lit(False))


def replaced_at(html: Column, change: Callable[[Column, Column], Column]) -> Column:
    """A page with each token replaced by ``change(token, place)``; the place is that among the page's ``pieces``."""
    return F.array_join(F.transform(pieces(html), lambda p, i: F.when(is_token(p), F.coalesce(change(p, i), F.lit(""))).otherwise(p)), "")


def inner_documents(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents directly within ``docs(page_id, path, html, ...)``, with their own paths; ``keep`` are columns that they inherit."""
    # found before the explode, so that a condition on what it gives doesn't repeat its making
    own = lambda p, i: F.when(_framed(p) & _opens(p), F.struct(i.alias("pos"), attribute(p, "srcdoc").alias("html")))
    found = F.filter(F.transform(pieces(F.col("html")), own), lambda x: x["html"].isNotNull())
    rows = docs.where(_framed(F.col("html"))).select("page_id", "path", *keep, F.explode(found).alias("x"))
    return rows.select("page_id", F.concat("path", F.array("x.pos")).alias("path"), F.col("x.html").alias("html"), *keep)


def _filled(html: Column, inner: Column) -> Column:
    """A document whose frames at the places of the map ``inner`` hold its values instead."""

    def own(token: Column, place: Column) -> Column:
        attrs = written(token, ())
        first = F.array_position(F.transform(attrs, lambda a: a["name"]), "srcdoc") - 1
        new = F.concat(F.lit('srcdoc="'), attribute_text(F.try_element_at(inner, place)), F.lit('"'))
        kept = F.filter(attrs, lambda a, i: ((a["name"] != "srcdoc") | (i == first)) & (a["name"] != BASE_ATTRIBUTE))
        kept = F.transform(kept, lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"), F.when(a["name"] == "srcdoc", new).otherwise(a["raw"]).alias("raw")))
        return F.when(_framed(token) & F.map_contains_key(inner, place), rebuilt(token, kept)).otherwise(token)

    return F.when(inner.isNull(), html).otherwise(replaced_at(html, own))


def levels_of(pages: DataFrame, keep: tuple[str, ...], deepest: int, tables: Levels) -> tuple[list[DataFrame], DataFrame | None]:
    """Levels of documents from the pages themselves down, and the pages that have one below ``deepest``."""
    found = [pages.select("page_id", F.array().cast("array<int>").alias("path"), "html", *keep)]
    while len(found) <= deepest + 1:
        level = tables.kept(inner_documents(found[-1], keep))
        if level.isEmpty():
            return found, None
        found.append(level)
    return found[:-1], found[-1].select("page_id").distinct()


def leaf_first(pages: DataFrame, change: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = (), deepest: int = DEEPEST) -> DataFrame:
    """``page_id, html, error``: each page rewritten by ``change`` after the pages within it have been.

    ``change`` takes and gives rows ``(page_id, path, html, ...)`` with the
    columns ``keep`` of the page that a document is in. A page with a document
    deeper than ``deepest`` has the error ``frame.depth`` and no html. A null
    html stays null; ids of ``pages`` are unique.
    """
    tables, parts = Levels(pages.sparkSession), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    framed = pages.where(_framed(F.col("html")))
    levels, refused = levels_of(framed, keep, deepest, tables)
    # the tables of the levels have the numbers 1, 2, ...; the last one found is empty or refused
    inner, last, deepest_first = None, None, list(reversed(list(enumerate(levels))))
    for number, level in deepest_first:
        own = level
        if inner is not None:
            # a page has one document at the top, whose empty path isn't anything to deal by
            keys = ["page_id", "path"] if number else ["page_id"]
            placed = inner.select("page_id", F.slice("path", 1, F.size("path") - 1).alias("path"), F.struct(F.element_at("path", -1).alias("pos"), "html").alias("x"))
            maps = placed.groupBy(*keys).agg(F.map_from_entries(F.collect_list("x")).alias("__inner"))
            # small rows of much work: as many tasks as the cluster has, not as few as their bytes would fill
            own = level.repartition(parts, *keys).join(maps, keys, "left").withColumn("html", _filled(F.col("html"), F.col("__inner"))).drop("__inner")
        inner = change(own).select("page_id", "path", "html")
        if number:
            inner = tables.kept(inner)
            tables.drop(number)
            if last:
                tables.drop(last)
            last = tables.number
    whole = inner.select("page_id", "html", F.lit(None).cast("string").alias("error"))
    if refused is not None:
        whole = whole.join(refused.withColumn("deep", F.lit(True)), "page_id", "left").select("page_id", F.when(F.col("deep").isNull(), F.col("html")).alias("html"), F.when(F.col("deep"), "frame.depth").alias("error"))
    plain = pages.where(~_framed(F.col("html"))).select("page_id", F.array().cast("array<int>").alias("path"), "html", *keep)
    return whole.unionByName(change(plain).select("page_id", "html", F.lit(None).cast("string").alias("error")))


def _shadow_ends(found: Column) -> Column:
    """The places among a document's ``pieces`` of the end tags of templates that are shadow roots (the number of pieces if one isn't closed).

    A start tag and its end tag are neighbours among the template tags of their
    depth, a running sum. That is made by doubling: sums over 1, 2, 4, ... tags.
    """
    n = F.size(found)
    root = lambda t: _opens(t) & F.lower(t).contains("shadowrootmode") & attribute(t, "shadowrootmode").isNotNull()
    tags = F.filter(F.transform(found, lambda t, i: F.when(t.rlike(_TEMPLATE), F.struct(i.alias("pos"), t.startswith("</").alias("closing"), root(t).alias("root")))), lambda x: x.isNotNull())

    def depths(own: Column) -> Column:
        steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda w: w < F.size(own))
        sums = F.aggregate(steps, F.transform(own, lambda x: F.when(x["closing"], -1).otherwise(1)), lambda sums, w: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - w), F.lit(0))))
        return F.sort_array(F.zip_with(own, sums, lambda x, d: F.struct((d + x["closing"].cast("int")).alias("depth"), x["pos"].alias("pos"), x["root"].alias("root"))))

    def ends(by_depth: Column) -> Column:
        end = lambda x, after: F.when(after["depth"] == x["depth"], after["pos"]).otherwise(n)
        return F.filter(F.transform(by_depth, lambda x, k: F.when(x["root"], end(x, F.get(by_depth, k + 1)))), lambda e: e.isNotNull())

    return urls.let(urls.let(tags, depths), ends)


def freezing(html: Column) -> Column:
    """A document with one style that stops motion, last in the head and in each declarative shadow root.

    Nothing is added where such a style is in the document already. A page
    without a head's end tag has it before the body, else after the html tag,
    else after the doctype.
    """
    shadowed = F.coalesce(F.lower(html).contains("shadowrootmode"), F.lit(False))

    def use(found: Column) -> Column:
        def place(tags: Column) -> Column:
            first = lambda tag: F.array_position(tags, tag) - 1
            # white space may stand before the doctype
            doctype = F.when(html.rlike(r"(?i)^\s*<!doctype"), F.when(html.startswith("<"), 1).otherwise(2)).otherwise(0)
            return F.when(first("/head") >= 0, first("/head")).when(first("body") >= 0, first("body")).when(first("html") >= 0, first("html") + 1).otherwise(doctype)

        own = urls.let(F.transform(found, lambda t: F.lower(F.regexp_extract(t, _PAGE_TAG, 1))), place).cast("int")
        places = F.sort_array(F.concat(F.array(own), F.when(shadowed, _shadow_ends(found)).otherwise(F.array().cast("array<int>"))))
        start, stop = lambda at, k: F.coalesce(F.get(at, k - 1), F.lit(0)), lambda at, k: F.coalesce(F.get(at, k), F.size(found))
        parts = lambda at: F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.array_join(F.slice(found, start(at, k) + 1, stop(at, k) - start(at, k)), ""))
        done = F.exists(found, lambda t: t.startswith("<style") & head_of(t).contains(FREEZE_ATTRIBUTE))
        return F.when(done, html).otherwise(urls.let(places, lambda at: F.array_join(parts(at), _FREEZE)))

    return F.when(html.isNotNull(), urls.let(pieces(html), use))


def frozen(docs: DataFrame) -> DataFrame:
    """``docs(page_id, path, html, ...)``, each ``freezing``."""
    return docs.withColumn("html", freezing(F.col("html")))


def safe_static(pages: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``page_id, html, error``: pages frozen and sanitized, and all pages within them before that."""
    return leaf_first(pages, lambda docs: frozen(docs).withColumn("html", sanitized(F.col("html"), None)), deepest=deepest)


def deeply_sanitized(pages: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``page_id, html, error``: pages without what acts, at any depth; nothing else is lost."""
    return leaf_first(pages, lambda docs: docs.withColumn("html", sanitized(F.col("html"), None)), deepest=deepest)


def document_reports(pages: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``page_id, depth, documents, active_elements, event_attributes, script_urls``: what ``deeply_sanitized`` removes from the documents of each depth."""
    levels, _ = levels_of(pages, (), deepest, Levels(pages.sparkSession))
    all_ = levels[0]
    for level in levels[1:]:
        all_ = all_.unionByName(level)
    keyed = all_.select(F.struct("page_id", F.size("path").alias("depth")).alias("page_id"), "html")
    found = sanitize_report(keyed)
    sums = [F.sum(c).alias(c) for c in ("active_elements", "event_attributes", "script_urls")]
    return found.groupBy(F.col("page_id.page_id").alias("page_id"), F.col("page_id.depth").alias("depth")).agg(F.count("*").alias("documents"), *sums)


def with_fallbacks(pages: DataFrame, fallbacks: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``page_id, html, error``: elements marked with an id get that id's picture as their source, at any depth.

    ``fallbacks(page_id, id, data_url)``; a marker without a picture stays.
    """
    maps = fallbacks.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "data_url"))).alias("__pictures"))

    def change(docs: DataFrame) -> DataFrame:
        def own(token: Column, place: Column) -> Column:
            picture = F.try_element_at(F.col("__pictures"), attribute(token, FALLBACK_ATTRIBUTE))
            attrs = F.filter(written(token), lambda a: ~a["name"].isin(FALLBACK_ATTRIBUTE, "src"))
            new = F.struct(F.lit("src").alias("name"), picture.alias("value"), F.concat(F.lit('src="'), attribute_text(picture), F.lit('"')).alias("raw"))
            return F.when(token.contains(FALLBACK_ATTRIBUTE) & _opens(token) & picture.isNotNull(), rebuilt(token, F.concat(attrs, F.array(new)))).otherwise(token)

        return docs.withColumn("html", F.when(F.col("html").contains(FALLBACK_ATTRIBUTE) & F.col("__pictures").isNotNull(), replaced_at(F.col("html"), own)).otherwise(F.col("html")))

    return leaf_first(pages.select("page_id", "html").join(maps, "page_id", "left"), change, ("__pictures",), deepest)


def fallback_outcomes(pages: DataFrame, fallbacks: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``page_id, id, depth, error``: at which least depth a picture's marker stands, ``transform.visual_fallback`` if nowhere."""
    levels, _ = levels_of(pages, (), deepest, Levels(pages.sparkSession))
    marks = None
    for level in levels:
        own = level.where(F.col("html").contains(FALLBACK_ATTRIBUTE)).select("page_id", F.size("path").alias("depth"), F.explode(_tokens(F.col("html"))).alias("token"))
        own = own.where(F.col("token").contains(FALLBACK_ATTRIBUTE) & _opens(F.col("token"))).select("page_id", "depth", attribute(F.col("token"), FALLBACK_ATTRIBUTE).alias("id")).where(F.col("id").isNotNull())
        marks = own if marks is None else marks.unionByName(own)
    least = marks.groupBy("page_id", "id").agg(F.min("depth").alias("depth"))
    return fallbacks.select("page_id", "id").join(least, ["page_id", "id"], "left").select("page_id", "id", "depth", F.when(F.col("depth").isNull(), "transform.visual_fallback").alias("error"))
