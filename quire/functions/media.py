"""Media types, data URLs and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import plain_base64
from quire.functions.urls import path

# Fixed values, in the order in which they are tried.
BY_ENDING = (
    ((".png",), "image/png"),
    ((".jpg", ".jpeg"), "image/jpeg"),
    ((".webp",), "image/webp"),
    ((".gif",), "image/gif"),
    ((".woff2",), "font/woff2"),
    ((".woff",), "font/woff"),
    ((".mp4",), "video/mp4"),
    ((".mp3",), "audio/mpeg"),
)
EXTENSIONS = {"image/avif": "avif", "image/gif": "gif", "image/jpeg": "jpg", "image/png": "png", "image/svg+xml": "svg", "image/webp": "webp", "image/x-icon": "ico", "font/woff": "woff", "font/woff2": "woff2"}
EMPTY_SVG = '<svg xmlns="http://www.w3.org/2000/svg" width="1" height="1"/>'


def essence(media_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(media_type, ";", 1)))


def essence_valid(media_type: Column) -> Column:
    return F.coalesce(essence(media_type).rlike(r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$"), F.lit(False))


def inferred(role: Column, url: Column) -> Column:
    """A media type from a resource's role and the ending of its path, in that mixed order."""
    p = F.lower(path(url))
    found = F.when(p.endswith(".css") | (role == "stylesheet"), "text/css").when(p.endswith(".svg") | (role == "svg"), "image/svg+xml")
    for endings, kind in BY_ENDING:
        hit = p.endswith(endings[0])
        for ending in endings[1:]:
            hit |= p.endswith(ending)
        found = found.when(hit, kind)
    return found.when(role == "frame", "text/html").otherwise("application/octet-stream")


def effective(media_type: Column, role: Column, url: Column) -> Column:
    return F.when(essence_valid(media_type), essence(media_type)).otherwise(inferred(role, url))


def extension(media_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), essence(media_type)), F.lit("bin"))


def is_css(media_type: Column) -> Column:
    return F.coalesce(essence(media_type) == "text/css", F.lit(False))


def is_svg(media_type: Column) -> Column:
    return F.coalesce(essence(media_type) == "image/svg+xml", F.lit(False))


def is_html(media_type: Column) -> Column:
    return F.coalesce(essence(media_type).isin("text/html", "application/xhtml+xml"), F.lit(False))


def data_url(media_type: Column, body: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), plain_base64(body))


def percent_decoded(text: Column) -> Column:
    """The bytes of percent-encoded text; a ``%`` that isn't followed by two hexadecimal digits stays."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(?:%[0-9a-fA-F]{2})++|[^%]++|%"), 0)
    digits = F.transform(parts, lambda x: F.when(x.rlike("^%[0-9a-fA-F]"), F.replace(x, F.lit("%"), F.lit(""))).otherwise(F.hex(F.encode(x, "UTF-8"))))
    return F.when(text.contains("%"), F.unhex(F.array_join(digits, ""))).otherwise(F.encode(text, "UTF-8"))


def decoded(url: Column) -> Column:
    """struct<media_type, body, error> of a ``data:`` URL; its fragment doesn't count."""
    plain = F.substring_index(url, "#", 1)
    head, body = F.regexp_extract(plain, r"(?is)^data:([^,]*),", 1), F.regexp_replace(plain, r"(?is)^data:[^,]*,", "")
    coded = head.rlike(r"(?i);[ ]*base64[ ]*$")
    kind = F.regexp_replace(head, r"(?i);[ ]*base64[ ]*$", "")
    kind = F.when(kind.startswith(";") | (kind == ""), F.lit("text/plain;charset=US-ASCII")).otherwise(kind)
    letters = F.when(body.contains("%"), F.decode(percent_decoded(body), "ISO-8859-1")).otherwise(body)
    content = F.when(coded, F.try_to_binary(F.regexp_replace(letters, r"[ \t\r\n\f]", ""), F.lit("base64"))).otherwise(percent_decoded(body))
    valid = plain.rlike(r"(?is)^data:[^,]*,") & content.isNotNull()
    return F.struct(F.when(valid, kind).alias("media_type"), F.when(valid, content).alias("body"), F.when(~F.coalesce(valid, F.lit(False)), F.lit("resource.data_url")).alias("error"))


def empty_fallback(role: Column) -> Column:
    """What stands in for a missing resource."""
    svg = data_url(F.lit("image/svg+xml"), F.lit(EMPTY_SVG).cast("binary"))
    return F.when(role.isin("image", "svg"), svg).when(role == "stylesheet", "data:text/css;base64,").when(role == "frame", "data:text/html;base64,").otherwise("data:application/octet-stream;base64,")


def is_empty_fallback(media_type: Column, body: Column) -> Column:
    kind = essence(media_type)
    return F.when(kind == "image/svg+xml", body == F.lit(EMPTY_SVG).cast("binary")).otherwise((F.octet_length(body) == 0) & kind.isin("text/css", "text/html", "application/octet-stream"))
