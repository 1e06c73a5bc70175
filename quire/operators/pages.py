"""Pages as relations: tokens, elements, attributes, links, references, and rewriting by token.

A page is cut into tokens by one expression inside the JVM, so every operator
here is a projection or an explode that Spark plans with the rest of the query;
no tree is built. Elements whose content isn't markup (script, style, title,
textarea and the like) are one token each. What needs a tree (implied end tags,
reconstructed formatting) isn't done; see the README.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import media, text, urls

# All runs are possessive, so that tags of any length neither recurse nor are tried twice. What doesn't end goes on to
# the end of the page; a quote that doesn't close is none.
_TO_END = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\z|["'][^>]*+(?:>|\z))"""
TOKEN = rf"(?is)<(?:!--.*?(?:-->|\z)|(script|style|textarea|xmp|noframes)(?=[\s/>]){_TO_END}.*?(?:</\1\s*+>|\z)|/?[a-z]{_TO_END}|![^>]*+(?:>|\z))"
# A token or what stands between two; together the pieces are the page.
_PIECE = rf"{TOKEN}|[^<]++|<"
_HEAD = rf"(?s)^(</?[a-zA-Z]{_TO_END})"
_WRITTEN = "array<struct<name:string,value:string,raw:string>>"
_ATTRIBUTE = r"""([^\s=>"'/]++)(\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?"""

# Link relations, URL attributes, metadata types, and which attribute holds which role of resource.
REQUEST_RELATIONS = ("compression-dictionary", "dns-prefetch", "import", "manifest", "modulepreload", "preconnect", "prefetch", "preload", "prerender", "serviceworker", "subresource", "webbundle")
ICON_RELATIONS = ("icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon")
URL_ATTRIBUTES = ("action", "cite", "data", "formaction", "href", "poster", "src", "xlink:href")
METADATA_TYPES = ("application/json", "application/ld+json")
# Of which attributes the values say whether an element acts, and which tokens can act at all: tags that are so by their name or aren't bare.
_TELLING = ("type", "http-equiv", "rel", *URL_ATTRIBUTES)
_MAY_ACT = r"^<(?:(?i:script|base)(?=[\s/>]|\z)|[a-zA-Z][^\s/>]*+(?!>))"
PRESENTATION = {name: "svg" for name in ("clip-path", "fill", "filter", "marker", "marker-start", "marker-mid", "marker-end", "mask", "stroke")} | {"cursor": "cursor"}
ROLES = {
    ("img", "src"): "image", ("input", "src"): "image", ("video", "poster"): "image", ("video", "src"): "media", ("audio", "src"): "media", ("source", "src"): "media", ("track", "src"): "media",
    ("iframe", "src"): "frame", ("frame", "src"): "frame", ("object", "data"): "other", ("embed", "src"): "other", }
SVG_ELEMENTS = {"image": "image", "feimage": "image", "cursor": "cursor"} | {name: "svg" for name in ("altglyph", "color-profile", "filter", "font-face-uri", "glyphref", "lineargradient", "mpath", "pattern", "radialgradient", "textpath", "tref", "use")}
ROLES |= {(tag, name): role for tag, role in SVG_ELEMENTS.items() for name in ("href", "xlink:href")}


def tokens(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``page_id, pos, token, closing, tag``: one row per token of markup, in page order."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TOKEN), 0)).alias("pos", "token"))
    return rows.withColumns({"closing": F.col("token").startswith("</"), "tag": tag_of(F.col("token"))})


def tag_of(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))


def head_of(token: Column) -> Column:
    """A token's start tag, without raw content."""
    return F.regexp_extract(token, _HEAD, 1)


def pieces(html: Column) -> Column:
    """A page's tokens and the texts between them in page order, found in one go; ``is_token`` tells them apart."""
    return F.regexp_extract_all(html, F.lit(_PIECE), 0)


def is_token(piece: Column) -> Column:
    return piece.startswith("<") & (piece != "<")


def written(token: Column, values: tuple[str, ...] | None = None) -> Column:
    """array<struct<name, value, raw>>: all attributes in source order, also repeated ones, with their own text. Names may follow ``/`` or a quote.

    ``values``: only attributes of these names get a value, the others null; decoding those that nobody reads takes most of the time where pages are within pages.
    """

    def all_(inner: Column) -> Column:
        names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 1), F.lower)
        raw = F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 0)
        decoded = lambda v: text.unescaped(F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2"))
        if values is None:
            return F.arrays_zip(names.alias("name"), F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 3), decoded).alias("value"), raw.alias("raw"))
        if not values:
            return F.zip_with(names, raw, lambda n, r: F.struct(n.alias("name"), F.lit(None).cast("string").alias("value"), r.alias("raw")))
        some = lambda n: F.zip_with(n, F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 3), lambda x, v: F.when(x.isin(*values), decoded(v)))
        return urls.let(names, lambda n: F.arrays_zip(n.alias("name"), some(n).alias("value"), raw.alias("raw")))

    # most tags are bare
    return F.when(token.rlike(r"^(?:[^<]|</?[a-zA-Z][^\s/>]*+>|<[!?]|\z)"), F.array().cast(_WRITTEN)).otherwise(urls.let(F.regexp_replace(head_of(token), r"^</?[a-zA-Z][^\s/>]*+", ""), all_))


def attributes(token: Column) -> Column:
    """array<struct<name, value>> in source order; of names that repeat, the first stays."""
    plain = lambda all_: F.transform(all_, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))

    def unique(all_: Column) -> Column:
        # by name and place, so that a tag of many attributes takes no time that grows with their square
        named = F.array_sort(F.transform(all_, lambda a, i: F.struct(a["name"].alias("name"), i.alias("i"), a["value"].alias("value"))))
        first = lambda sorted_: F.filter(sorted_, lambda x, k: (k == 0) | (F.get(sorted_, k - 1)["name"] != x["name"]))
        return plain(F.array_sort(F.transform(urls.let(named, first), lambda x: F.struct(x["i"].alias("i"), x["name"].alias("name"), x["value"].alias("value")))))

    # few tags repeat a name
    return urls.let(written(token), lambda all_: F.when(F.size(F.array_distinct(F.transform(all_, lambda a: a["name"]))) == F.size(all_), plain(all_)).otherwise(unique(all_)))


def attribute(token: Column, name: str) -> Column:
    """The value of one attribute, or null."""
    return F.get(F.filter(written(token, (name,)), lambda a: a["name"] == name), F.lit(0))["value"]


def elements(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``page_id, pos, tag, attrs``: start tags only; ``keep`` are the pages' columns that stay."""
    return tokens(pages, keep=keep).where(~F.col("closing") & (F.col("tag") != "")).select(*keep, "pos", "tag", attributes(F.col("token")).alias("attrs"), "token")


def first_text(html: Column, tag: str) -> Column:
    """The collapsed, decoded text of the first element of a kind that holds no markup."""
    return text.collapsed(text.unescaped(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>([^<]*)</{tag}\s*>", 1)))


def suggested_name(html: Column, url: Column, most: int | None = text.STEM_BYTES) -> Column:
    """A page's title, else its host, as a file stem of at most ``most`` bytes (None: whole)."""
    return text.file_stem(F.coalesce(F.nullif(first_text(html, "title"), F.lit("")), urls.host(url), F.lit("capture")), most)


def link_relation(rel: Column) -> Column:
    """``request`` if one token asks for one, else ``stylesheet``, ``icon`` or ``other``."""
    own = F.filter(F.split(F.lower(F.coalesce(rel, F.lit(""))), r"[ \t\n\f\r]+"), lambda t: t != "")
    has = lambda names: F.arrays_overlap(own, F.array(*map(F.lit, names)))
    return F.when(has(REQUEST_RELATIONS), "request").when(F.array_contains(own, "stylesheet"), "stylesheet").when(has(ICON_RELATIONS), "icon").otherwise("other")


def is_script_url(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[\s\x00-\x1f\x7f]", "")).startswith("javascript:")


def links(pages: DataFrame) -> DataFrame:
    """``page_id, url, link, same_origin``: each page's links to pages, without those marked nofollow, each once."""
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(rf"(?is)<a(?:rea)?[\s/]{_TO_END}"), 0)).alias("token"))
    found = found.select("page_id", "url", attribute(F.col("token"), "href").alias("href"), F.coalesce(attribute(F.col("token"), "rel"), F.lit("")).alias("rel"))
    found = found.where(F.col("href").isNotNull() & ~F.array_contains(F.split(F.lower("rel"), r"[ \t\n\f\r]+"), "nofollow"))
    # the explode keeps conditions on a link from being pushed into its making, which would repeat it
    link = urls.page_url(urls.join(urls.without_fragment(F.col("url")), F.col("href")))
    found = found.select("page_id", "url", F.explode(F.filter(F.array(link), lambda x: x.isNotNull())).alias("link"))
    return found.distinct().withColumn("same_origin", urls.same_origin(F.col("url"), F.col("link")))


def css_references(css: Column) -> Column:
    """URLs that a style sheet asks for, in order: url(), strings after @import and in image-set(); comments don't count, nor do empty ones and fragments."""
    plain = F.regexp_replace(css, r"(?s)/\*.*?(?:\*/|\z)", " ")
    found = F.regexp_extract_all(plain, F.lit(r"""(?i)(url\(\s*+(?:"[^"]*+"|'[^']*+'|[^()"'\s]*+)\s*+\)|@import\s+(?:"[^"]*"|'[^']*')|image-set\((?:[^()]++|\([^()]*+\))*+\))"""), 1)
    sets = lambda x: F.regexp_extract_all(x, F.lit(r"""(?i)(url\(\s*+(?:"[^"]*+"|'[^']*+'|[^()"'\s]*+)\s*+\)|"[^"]*"|'[^']*')"""), 1)
    flat = F.flatten(F.transform(found, lambda x: F.when(F.lower(x).startswith("image-set"), F.filter(sets(F.regexp_replace(x, r"""(?i)type\(\s*["'][^"']*["']\s*\)""", "")), lambda y: y != "")).otherwise(F.array(x))))
    bare = F.transform(flat, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"""(?i)^(?:url\(\s*|@import\s+)?["']?""", ""), r"""["']?\s*\)?$""", "")))
    return F.filter(bare, lambda x: (x != "") & ~x.startswith("#"))


def srcset_references(srcset: Column) -> Column:
    """A srcset's URLs in order: a run without white space, its last commas stripped; then up to the next comma outside parentheses all is skipped."""
    return F.regexp_extract_all(srcset, F.lit(r"[\s,]*(\S*[^\s,]),*(?=\s|$)(?:[^,(]++|\([^)]*+(?:\)|$))*+(?:,|$)"), 1)


def references(pages: DataFrame, base: str = "url") -> DataFrame:
    """``page_id, ref_id, pos, tag, attribute, role, original, resolved``: all that rendering asks for.

    In each attribute's place: style and presentation attributes as CSS, srcset,
    then what the element and attribute (a link's relation) say; a style
    element's text last. ``ref_id`` counts from 0 in page order.
    """
    own = elements(pages.select("page_id", "html", F.col(base).alias("base")), keep=("page_id", "base"))
    roles = F.create_map(*[F.lit(x) for (tag, name), role in ROLES.items() for x in (f"{tag} {name}", role)])
    shown = F.create_map(*[F.lit(x) for pair in PRESENTATION.items() for x in pair])
    item = lambda role, value, local: F.struct(role.alias("role"), F.trim(value).alias("original"), F.lit(local).alias("local"))
    rel = link_relation(F.get(F.filter("attrs", lambda a: a["name"] == "rel"), F.lit(0))["value"])

    def found(a: Column) -> Column:
        name, value = a["name"], a["value"]
        direct = F.when((F.col("tag") == "link") & (name == "href"), F.when(rel == "stylesheet", "stylesheet").when(rel == "icon", "image")).when(name == "background", "image").otherwise(F.try_element_at(roles, F.concat_ws(" ", F.col("tag"), name)))
        return (
            F.when(name == "style", F.transform(css_references(value), lambda v: item(F.lit("css"), v, True)))
            .when(F.try_element_at(shown, name).isNotNull(), F.transform(css_references(value), lambda v: item(F.try_element_at(shown, name), v, True)))
            .when(name == "srcset", F.transform(srcset_references(value), lambda v: item(F.lit("image"), v, False)))
            .when(direct.isNotNull(), F.array(F.struct(direct.alias("role"), F.trim(value).alias("original"), F.col("tag").isin(*SVG_ELEMENTS).alias("local"))))
        )

    listed = F.transform("attrs", lambda a: F.struct(a["name"].alias("attribute"), found(a).alias("items")))
    body = F.when(F.col("tag") == "style", F.array(F.struct(F.lit("#text").alias("attribute"), F.transform(css_references(F.regexp_replace("token", r"(?is)^<style[^>]*>|</style\s*>$", "")), lambda v: item(F.lit("css"), v, True)).alias("items"))))
    rows = own.select("page_id", "base", "pos", "tag", F.posexplode(F.concat(listed, F.coalesce(body, F.array().cast("array<struct<attribute:string,items:array<struct<role:string,original:string,local:boolean>>>>")))).alias("at", "a"))
    rows = rows.select("page_id", "base", "pos", "tag", "at", F.col("a.attribute").alias("attribute"), F.posexplode("a.items").alias("sub", "i")).select("*", "i.*")
    rows = rows.where((F.col("original") != "") & ~(F.col("local") & F.col("original").startswith("#")))
    order = Window.partitionBy("page_id").orderBy("pos", "at", "sub")
    rows = rows.select("page_id", (F.row_number().over(order) - 1).alias("ref_id"), "pos", "tag", "attribute", "role", "original", "base")
    # as in links: conditions on a URL don't repeat its making
    return rows.select("page_id", "ref_id", "pos", "tag", "attribute", "role", "original", F.explode(F.array(urls.join(F.col("base"), F.col("original")))).alias("resolved"))


def active_parts(token: Column) -> Column:
    """What a token holds that acts: struct<drop, events, script_urls, frames>; ``frames`` if it holds a page of its own."""
    own = F.struct(tag_of(token).alias("tag"), written(token, _TELLING).alias("attrs"), (token.startswith("<") & ~token.startswith("</") & ~token.startswith("<!")).alias("open"))
    return urls.let(own, lambda x: _active_parts(x["tag"], x["attrs"], x["open"]))


def _active_parts(tag: Column, attrs: Column, open_: Column) -> Column:
    """``active_parts`` of a token whose tag and attributes (``written``) are known."""
    value = lambda name: F.lower(F.coalesce(F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"], F.lit("")))
    script = (tag == "script") & ~media.essence(value("type")).isin(*METADATA_TYPES)
    refresh = (tag == "meta") & value("http-equiv").isin("refresh", "content-security-policy")
    request = (tag == "link") & (link_relation(value("rel")) == "request")
    events = F.size(F.filter(attrs, lambda a: a["name"].startswith("on")))
    scripts = F.size(F.filter(attrs, lambda a: a["name"].isin(*URL_ATTRIBUTES) & is_script_url(a["value"])))
    frames = open_ & F.exists(attrs, lambda a: a["name"] == "srcdoc")
    none = F.lit(0)
    return F.struct((open_ & (script | (tag == "base") | refresh | request)).alias("drop"), F.when(open_, events).otherwise(none).alias("events"), F.when(open_, scripts).otherwise(none).alias("script_urls"), frames.alias("frames"))


def sanitize_report(pages: DataFrame) -> DataFrame:
    """``page_id, active_elements, event_attributes, script_urls``: what ``sanitized`` removes, one row per page."""
    found = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), 0), active_parts)
    rows = pages.select("page_id", F.when(F.col("html").contains("<"), found).alias("f"))
    total = lambda name: F.coalesce(F.aggregate("f", F.lit(0).cast("bigint"), lambda n, x: n + x[name]), F.lit(0).cast("bigint"))
    return rows.select("page_id", F.coalesce(F.size(F.filter("f", lambda x: x["drop"])), F.lit(0)).cast("bigint").alias("active_elements"), total("events").alias("event_attributes"), total("script_urls").alias("script_urls"))


def rewritten(html: Column, change) -> Column:
    """A page with each token replaced by ``change(token)``; text between tokens stays."""
    return F.array_join(F.transform(pieces(html), lambda p: F.when(is_token(p), F.coalesce(change(p), F.lit(""))).otherwise(p)), "")


def acts(a: Column) -> Column:
    """Whether an attribute acts: an event's, or a URL's that is a script."""
    return a["name"].startswith("on") | (a["name"].isin(*URL_ATTRIBUTES) & is_script_url(a["value"]))


def rebuilt(token: Column, attrs: Column) -> Column:
    """A start tag with these attributes (``written``), each as it is in ``raw``; what follows the tag within its token stays."""
    head = head_of(token)
    name = F.regexp_extract(head, r"^(<[a-zA-Z][^\s/>]*+)", 1)
    end = F.when(head.rlike(r"""(?:[\s"']|^<[a-zA-Z][^\s/>]*+)/>$"""), F.lit("/>")).otherwise(F.lit(">"))
    return F.concat(name, F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["raw"])), ""), end, F.substring(token, F.length(head) + 1, F.lit(1 << 30)))


def attribute_text(value: Column) -> Column:
    """A value as it stands between double quotes."""
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def sanitized(html: Column, nested: int | None = 1) -> Column:
    """A page without scripts, base, refresh and request-triggering elements, event attributes and script URLs.

    Pages within ``srcdoc`` attributes are sanitized as well, ``nested`` levels
    deep; deeper ones are removed. With None they stay as they are:
    ``nested.deeply_sanitized`` has rewritten them at any depth by then.
    """

    def quiet(token: Column, attrs: Column) -> Column:
        def kept(a: Column) -> Column:
            if not nested:
                return a  # none is left, or all are done
            inner = F.concat(F.lit('srcdoc="'), attribute_text(sanitized(a["value"], nested - 1)), F.lit('"'))
            return F.struct(a["name"].alias("name"), a["value"].alias("value"), F.when(a["name"] == "srcdoc", inner).otherwise(a["raw"]).alias("raw"))

        left = F.filter(attrs, lambda a: ~acts(a) & ((a["name"] != "srcdoc") if nested == 0 else F.lit(True)))
        return rebuilt(token, F.transform(left, kept))

    def change(token: Column) -> Column:
        def use(attrs: Column) -> Column:
            new = lambda f: F.when(f["drop"], F.lit("")).when((f["events"] + f["script_urls"]) > 0, quiet(token, attrs))
            return urls.let(_active_parts(tag_of(token), attrs, F.lit(True)), lambda f: (new(f) if nested is None else new(f).when(f["frames"], quiet(token, attrs))).otherwise(token))

        return F.when(token.rlike(_MAY_ACT), urls.let(written(token, (*_TELLING, "srcdoc") if nested else _TELLING), use)).otherwise(token)

    return rewritten(html, change)


_CSS_URL = r"""(?i)url\(\s*+(?:"[^"]*+"|'[^']*+'|[^()"'\s]*+)\s*+\)|(?<=@import\s)\s*+(?:"[^"]*+"|'[^']*+')"""


def css_rewritten(css: Column, bodies: Column) -> Column:
    """A style sheet whose URLs are ``bodies[url]`` where the map has one; the rest, comments included, stays as it is."""

    def change(x: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"""(?i)^(?:url\(\s*)?["']?""", ""), r"""["']?\s*\)?$""", ""))
        new = F.try_element_at(bodies, bare)
        quoted = F.concat(F.lit('"'), text.css_string_escaped(new), F.lit('"'))
        return F.when(new.isNull() | (bare == ""), x).when(F.lower(x).startswith("url"), F.concat(F.lit("url("), quoted, F.lit(")"))).otherwise(quoted)

    pattern = rf"(?s)/\*.*?(?:\*/|\z)|{_CSS_URL}"
    found, between = F.regexp_extract_all(css, F.lit(pattern), 0), F.split(css, pattern, -1)
    return F.array_join(F.zip_with(between, F.transform(found, lambda x: F.when(x.startswith("/*"), x).otherwise(change(x))), lambda t, x: F.concat(t, F.coalesce(x, F.lit("")))), "")


def srcset_rewritten(srcset: Column, bodies: Column) -> Column:
    """A srcset whose candidates' URLs are ``bodies[url]`` where the map has one, with their descriptors."""
    pattern = r"[\s,]*(\S*[^\s,]),*(?=\s|$)((?:[^,(]++|\([^)]*+(?:\)|$))*+)(?:,|$)"
    parts = F.arrays_zip(F.regexp_extract_all(srcset, F.lit(pattern), 1).alias("url"), F.regexp_extract_all(srcset, F.lit(pattern), 2).alias("rest"))
    return F.array_join(F.transform(parts, lambda p: F.trim(F.concat(F.coalesce(F.try_element_at(bodies, p["url"]), p["url"]), F.lit(" "), F.trim(p["rest"])))), ", ")


def embedded(html: Column, bodies: Column) -> Column:
    """A page whose resources are ``bodies[url]`` (a map of original to data URL) where it has one.

    Attributes that name a resource, srcsets, style attributes and style elements.
    """

    def change(token: Column) -> Column:
        tag = tag_of(token)
        direct = F.array(*map(F.lit, ("src", "poster", "data", "background")))

        def new(a: Column) -> Column:
            one = F.try_element_at(bodies, F.trim(a["value"]))
            named = F.array_contains(direct, a["name"]) | (a["name"].isin("href", "xlink:href") & ~tag.isin("a", "area", "base"))
            return F.when(named, one).when(a["name"] == "srcset", F.nullif(srcset_rewritten(a["value"], bodies), a["value"])).when(a["name"] == "style", F.nullif(css_rewritten(a["value"], bodies), a["value"]))

        changed = F.transform(written(token), lambda a: urls.let(new(a), lambda v: F.struct(a["name"].alias("name"), v.alias("value"), F.when(v.isNull(), a["raw"]).otherwise(F.concat(a["name"], F.lit('="'), attribute_text(v), F.lit('"'))).alias("raw"))))
        own = urls.let(changed, lambda c: F.when(F.exists(c, lambda a: a["value"].isNotNull()), rebuilt(token, c)).otherwise(token))
        style = F.concat(head_of(token), css_rewritten(F.regexp_extract(F.substring(token, F.length(head_of(token)) + 1, F.lit(1 << 30)), r"(?is)^(.*?)(?:</style\s*>)?$", 1), bodies), F.regexp_extract(token, r"(?i)(</style\s*>)$", 1))
        return F.when(token.startswith("</") | token.startswith("<!"), token).when(tag == "style", style).otherwise(own)

    return rewritten(html, change)


def without_attributes(html: Column, prefix: str) -> Column:
    """A page without the attributes whose names begin with ``prefix``; tags that have none stay as they are."""

    def change(token: Column) -> Column:
        left = lambda all_: F.filter(all_, lambda a: ~a["name"].startswith(prefix))
        return F.when(~token.contains(prefix) | token.startswith("</") | token.startswith("<!"), token).otherwise(urls.let(written(token), lambda w: F.when(F.size(left(w)) == F.size(w), token).otherwise(rebuilt(token, left(w)))))

    return rewritten(html, change)


def inline_frames(pages: DataFrame) -> DataFrame:
    """``page_id, pos, srcdoc``: frames that hold their page themselves."""
    rows = elements(pages).where(F.col("tag").isin("iframe", "frame"))
    return rows.select("page_id", "pos", attribute(F.col("token"), "srcdoc").alias("srcdoc")).where(F.col("srcdoc").isNotNull())


def metadata(pages: DataFrame) -> DataFrame:
    """``page_id, title, description, authors, keywords, lang``: first non-empty of each kind, lists unique and bounded."""
    metas = F.transform(F.filter(F.regexp_extract_all(F.col("html"), F.lit(TOKEN), 0), lambda t: tag_of(t) == "meta"), lambda t: F.struct(F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"), F.lit(""))).alias("name"), text.normalized(F.coalesce(attribute(t, "content"), F.lit("")), 1024).alias("value")))
    value = lambda *names: F.coalesce(*[F.get(F.filter("metas", lambda m: (m["name"] == name) & (m["value"] != "")), F.lit(0))["value"] for name in names])
    listed = lambda name: F.slice(F.array_distinct(F.filter(F.transform(F.flatten(F.transform(F.filter("metas", lambda m: m["name"] == name), lambda m: F.split(m["value"], "[,;]"))), lambda x: F.trim(x)), lambda x: x != "")), 1, 128)
    lang = attribute(F.regexp_extract("html", r"(?is)(<html(?:\s[^>]*)?>)", 1), "lang")
    rows = pages.select("page_id", "url", metas.alias("metas"), first_text(F.col("html"), "title").alias("own"), lang.alias("lang"))
    return rows.select("page_id", F.coalesce(F.nullif("own", F.lit("")), value("og:title", "twitter:title"), F.col("url")).alias("title"), value("description", "og:description").alias("description"), listed("author").alias("authors"), listed("keywords").alias("keywords"), F.when(text.language_tag_valid(F.col("lang")), F.col("lang")).alias("lang"))


def markdown(html: Column) -> Column:
    """A page's body as Markdown: headings, paragraphs, emphasis, code, links, images, lists, rules and quotes."""
    body = F.regexp_replace(html, r"(?is)<head(?:\s[^>]*)?>.*?</head\s*>", "")
    found, between = F.regexp_extract_all(body, F.lit(TOKEN), 0), F.split(body, TOKEN, -1)
    inline = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`"}
    blocks = ("p", "article", "section", "main", "header", "footer", "nav", "aside", "div", "ul", "ol", "table", "pre")

    def mark(token: Column) -> Column:
        tag, closing = tag_of(token), token.startswith("</")
        out = F.when(tag.rlike("^h[1-6]$"), F.when(closing, "\n\n").otherwise(F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" "))))
        for name, sign in inline.items():
            out = out.when(tag == name, sign)
        out = out.when(tag == "br", "  \n").when(tag == "hr", "\n\n---\n\n").when((tag == "li") & ~closing, "\n- ").when((tag == "blockquote") & ~closing, "\n\n> ")
        # a link's target is known where it opens and written where it closes: marks carry it there
        target = lambda name: text.markdown_destination(F.coalesce(attribute(token, name), F.lit("")))
        out = out.when((tag == "a") & ~closing, F.concat(F.lit("\x02"), target("href"), F.lit("\x03"))).when(tag == "a", "\x04")
        out = out.when(tag == "img", F.concat(F.lit("!["), text.markdown_escaped(F.coalesce(attribute(token, "alt"), F.lit(""))), F.lit("]("), target("src"), F.lit(")")))
        return out.when(tag.isin(*blocks), "\n\n").otherwise("")

    clean = lambda t: text.markdown_escaped(F.regexp_replace(text.unescaped(F.regexp_replace(t, r"\s+", " ")), "[\x02-\x04]", ""))
    folded = F.array_join(F.zip_with(between, found, lambda t, x: F.concat(clean(t), urls.let(F.coalesce(x, F.lit("")), mark))), "")
    linked = F.regexp_replace(folded, "\x02([^\x03]*+)\x03([^\x02\x04]*+)\x04", r"[$2]($1)")
    linked = F.regexp_replace(linked, "\x02[^\x03]*+\x03|\x04", "")  # links that don't close, or don't open
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(linked, r"\n[ ]+", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
