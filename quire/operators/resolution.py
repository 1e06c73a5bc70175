"""Recursive resolution: style sheets, SVG pictures and embedded pages whose own references are resolved and put into them.

Each document of a page is one row, however many ways lead to it. Its order key
is the way on which a depth-first walk meets it first: the place of each
reference on it, the least of all ways in the order of arrays. A semi-naive
fixpoint finds the keys: each round extends the documents whose key has become
less by their references, and joins the least offers with what is known. In
the tree of these ways a reference leads back just if its target's key begins
its own document's key; without these references nothing is circular, so
documents are rewritten leaf first, each round those that wait for none, and
joined to the contents that they ask for. Dense ids come from the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import media, urls
from quire.operators.nested import frozen
from quire.operators.pages import css_references, embedded, css_rewritten, inline_frames, references, sanitized
from quire.operators.resources import outcomes
from quire.sources.levels import Levels

KEY = ["page_id", "url"]
#: Levels of documents within documents that are opened.
DEEPEST = 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).hint("merge")


def _kinds(documents: DataFrame) -> set[str]:
    """Which of the kinds that are opened occur, so that a round plans no work for others."""
    return {r["kind"] for r in documents.where("kind IS NOT NULL").select("kind").distinct().collect()}


def loaded(documents: DataFrame, resources: DataFrame) -> DataFrame:
    """``page_id, url, kind, text, media_type, data_url, error`` of ``documents(page_id, url, role)``; ``kind`` is css, svg, html or null."""
    rows = outcomes(documents.withColumn("resolved", F.col("url")), resources)
    kind = F.when(media.is_css(F.col("media_type")), "css").when(media.is_svg(F.col("media_type")), "svg").when(media.is_html(F.col("media_type")), "html")
    rows = rows.select(*KEY, kind.alias("kind"), F.when(kind.isNotNull(), F.unbase64(F.substring_index("data_url", ",", -1)).cast("string")).alias("text"), "media_type", F.when(F.col("error").isNull(), F.col("data_url")).alias("data_url"), "error")
    strange = F.when((F.col("kind") == "css") & ~F.is_valid_utf8("text"), "css.encoding").when((F.col("kind") == "svg") & ~F.col("text").rlike(r"(?i)<svg[\s/>]"), "svg.root").when((F.col("kind") == "html") & F.col("text").rlike(r"(?i)<i?frame\b[^>]*\ssrcdoc"), "html.frame")
    return rows.withColumn("error", F.coalesce("error", strange)).withColumn("data_url", F.when(F.col("error").isNull(), F.col("data_url")))


def edges_of(documents: DataFrame) -> DataFrame:
    """``page_id, url, pos, original, target, fragment, role``: what opened documents ask for, in order."""
    css = documents.where("kind = 'css'").select(*KEY, F.posexplode(css_references(F.col("text"))).alias("pos", "original"))
    found = css.select(*KEY, "pos", "original", urls.join(F.col("url"), F.col("original")).alias("resolved"), F.lit("other").alias("role"))
    if _kinds(documents) & {"svg", "html"}:
        pages = documents.where("kind IN ('svg', 'html')").select(F.struct(*KEY).alias("page_id"), "url", F.col("text").alias("html"))
        found = found.unionByName(references(pages).select("page_id.page_id", "page_id.url", F.col("ref_id").cast("int").alias("pos"), "original", "resolved", "role"))
    fragment = F.when(F.col("resolved").contains("#"), F.concat(F.lit("#"), F.substring_index("resolved", "#", -1))).otherwise(F.lit(""))
    return found.select(*KEY, "pos", "original", urls.without_fragment(F.coalesce("resolved", F.concat(F.lit("invalid:"), "original"))).alias("target"), fragment.alias("fragment"), "role")


def met(top: DataFrame, resources: DataFrame, deepest: int, tables: Levels) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fixpoint: documents ``(page_id, url, key, role)``, what they are (``loaded``), and their edges.

    ``top(page_id, ref_id, role, resolved)``. A document is opened if its own
    way has no more than ``deepest`` references.
    """
    first = top.groupBy("page_id", urls.without_fragment(F.col("resolved")).alias("url")).agg(F.min(F.struct(F.array(F.col("ref_id").cast("int")).alias("key"), "role")).alias("x"))
    known = tables.kept(first.select(*KEY, "x.key", "x.role"))
    changed, contents, edges = known.withColumn("new", F.lit(True)), [], []
    while True:
        contents.append(tables.kept(loaded(changed.where("new").select(*KEY, "role"), resources)))
        edges.append(tables.kept(edges_of(contents[-1].where("kind IS NOT NULL AND error IS NULL"))))
        offers = changed.where(F.size("key") <= deepest).select(*KEY, "key").join(_union(edges), KEY)
        best = offers.groupBy("page_id", F.col("target").alias("url")).agg(F.min(F.struct(F.concat("key", F.array("pos")).alias("key"), "role")).alias("x"))
        better = best.join(known.select(*KEY, F.col("key").alias("had")), KEY, "left").where(F.col("had").isNull() | (F.col("x.key") < F.col("had")))
        changed = tables.kept(better.select(*KEY, "x.key", "x.role", F.col("had").isNull().alias("new")))
        if changed.isEmpty():
            return known, _union(contents), _union(edges)
        known = tables.kept(known.join(changed.select(*KEY), KEY, "left_anti").unionByName(changed.drop("new")))


def _rewritten(ready: DataFrame, kinds: set[str]) -> DataFrame:
    """``page_id, url, text`` of ``ready(page_id, url, kind, text, bodies)`` of these kinds with the bodies in place; embedded pages sanitized and frozen as well."""
    given = lambda new: F.when(F.col("bodies").isNull(), F.col("text")).otherwise(new)
    marked = lambda: given(embedded(F.col("text"), F.col("bodies")))
    parts = [ready.where("kind = 'css'").select(*KEY, given(css_rewritten(F.col("text"), F.col("bodies"))).alias("text"))]
    if "svg" in kinds:
        parts.append(ready.where("kind = 'svg'").select(*KEY, marked().alias("text")))
    if "html" in kinds:
        pages = ready.where("kind = 'html'").select(F.struct(*KEY).alias("page_id"), F.array().cast("array<int>").alias("path"), sanitized(marked(), None).alias("html"))
        parts.append(frozen(pages).select("page_id.page_id", "page_id.url", F.col("html").alias("text")))
    return _union(parts)


def resolved(top: DataFrame, resources: DataFrame, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """Two tables: the page's documents, and the references between them.

    ``top(page_id, ref_id, role, resolved)`` are a page's own references,
    ``resources(page_id, url, status, media_type, body)`` what they lead to.

    * ``page_id, id, url, depth, kind, error, media_type, bytes, digest, data_url``: each URL once. Ids are dense: the
      page's own references first, then what they ask for, as a depth-first walk meets it. Bytes, digest and data URL are
      those of the rewritten content.
    * ``page_id, url, pos, original, target, error``: each reference of an opened document. One that leads back to a
      document on its own way has the error ``css.cycle`` (or svg, html) and gets an empty stand-in, as has one to a
      document that failed.

    A document whose first way has ``deepest`` references before its own isn't
    opened: ``css.depth``. URLs without a resource fail; a null reference is
    left out; empty tables give empty tables.
    """
    tables = Levels(top.sparkSession)
    known, contents, edges = met(top.where(F.col("resolved").isNotNull()), resources, deepest, tables)
    nodes = known.join(contents, KEY)
    deep = F.when(F.col("kind").isNotNull() & (F.size("key") > deepest), F.concat("kind", F.lit(".depth")))
    nodes = nodes.withColumn("error", F.coalesce("error", deep)).withColumn("data_url", F.when(F.col("error").isNull(), F.col("data_url")))
    nodes = tables.kept(nodes)

    opened = nodes.where("kind IS NOT NULL AND error IS NULL")
    ways = edges.join(opened.select(*KEY, "kind", F.col("key").alias("own")), KEY).join(known.select("page_id", F.col("url").alias("target"), F.col("key").alias("other")), ["page_id", "target"])
    back = F.slice("own", 1, F.size("other")) == F.col("other")
    ways = tables.kept(ways.select(*KEY, "kind", "pos", "original", "target", "fragment", "role", back.alias("back")))

    todo = tables.kept(opened.select(*KEY, "kind", "text", "media_type"))
    kinds = _kinds(todo)
    done = [nodes.where("kind IS NULL OR error IS NOT NULL").select(*KEY, "data_url", F.lit(None).cast("string").alias("text"))]
    while not todo.isEmpty():
        waits = ways.where("NOT back").join(todo.select("page_id", F.col("url").alias("target")), ["page_id", "target"], "left_semi").select(*KEY).distinct()
        ready = todo.join(waits, KEY, "left_anti")
        got = ways.join(ready.select(*KEY), KEY, "left_semi").join(_union(done).select("page_id", F.col("url").alias("target"), "data_url"), ["page_id", "target"], "left")
        body = F.when(F.col("back") | F.col("data_url").isNull(), media.empty_fallback(F.col("role"))).otherwise(F.concat("data_url", "fragment"))
        each = got.groupBy(*KEY, "original").agg(F.min_by(body, "pos").alias("body"))
        maps = each.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("original", "body"))).alias("bodies"))
        new = _rewritten(ready.join(maps, KEY, "left"), kinds).join(ready.select(*KEY, "media_type"), KEY)
        done.append(tables.kept(new.select(*KEY, media.data_url(F.col("media_type"), F.col("text").cast("binary")).alias("data_url"), "text")))
        todo = tables.kept(todo.join(done[-1].select(*KEY), KEY, "left_anti"))

    rows = nodes.drop("data_url", "text").join(_union(done), KEY)
    body = F.coalesce(F.col("text").cast("binary"), F.unbase64(F.substring_index("data_url", ",", -1)))
    order = Window.partitionBy("page_id").orderBy(F.size("key") > 1, "key")
    good = F.col("error").isNull()
    documents = rows.select(
        "page_id", (F.row_number().over(order) - 1).alias("id"), "url", (F.size("key") - 1).alias("depth"), F.when(good, "embedded").otherwise("failed").alias("kind"), "error", "media_type",
        F.when(good, F.octet_length(body)).cast("bigint").alias("bytes"), F.when(good, F.sha2(body, 256)).alias("digest"), F.when(good, F.col("data_url")).alias("data_url"),
    )
    failed = nodes.where("error IS NOT NULL").select("page_id", F.col("url").alias("target"), F.col("error").alias("missing"))
    between = ways.join(failed, ["page_id", "target"], "left").select(*KEY, "pos", "original", "target", F.coalesce(F.when(F.col("back"), F.concat("kind", F.lit(".cycle"))), "missing").alias("error"))
    return documents, between


def page_verdicts(documents: DataFrame, policy: str = "warn") -> DataFrame:
    """``page_id, embedded, failed, refused``: with the policy ``fail`` a page with a failed document is refused, else its stand-ins are warnings."""
    counts = documents.groupBy("page_id").agg(F.count_if(F.col("kind") == "embedded").alias("embedded"), F.count_if(F.col("kind") == "failed").alias("failed"))
    return counts.withColumn("refused", F.lit(policy == "fail") & (F.col("failed") > 0))
