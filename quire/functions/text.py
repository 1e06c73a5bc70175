"""Text columns: names, escapes, limits. All are expressions inside the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# File stems that some systems reserve.
RESERVED_STEMS = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
STEM_BYTES = 96
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[a-zA-Z][a-zA-Z0-9]*+;)"
_USUAL = {"&amp;": "&", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&#39;": "'"}


def _all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescaped(text: Column) -> Column:
    """Character references decoded, each once: numbers of any kind, and the names of HTML 4; others stay as they are."""
    names = F.map_from_arrays(F.split(F.lit(" ".join([*name2codepoint, "apos"])), " "), F.split(F.lit("\x01".join([*map(chr, name2codepoint.values()), "'"])), "\x01"))

    def decoded(x: Column) -> Column:
        inner = F.regexp_replace(x, "^&|;$", "")
        hexadecimal = F.regexp_replace(F.when(F.lower(inner).startswith("#x"), F.substring(inner, 3, 1 << 30)).otherwise(F.conv(F.substring(inner, 2, 1 << 30), 10, 16)), "^0+", "")
        code = F.lpad(hexadecimal, 8, "0")
        valid = (F.length(hexadecimal) <= 6) & (hexadecimal != "") & (F.upper(code) <= "0010FFFF") & ~F.upper(code).between("0000D800", "0000DFFF")
        number = F.when(valid, F.decode(F.unhex(code), "UTF-32")).otherwise("\ufffd")
        return F.when(inner.startswith("#"), number).otherwise(F.coalesce(F.try_element_at(names, inner), x))

    def one(piece: Column) -> Column:
        # most references are these few
        out = F.when(~piece.startswith("&") | (piece == "&"), piece)
        for written, meant in _USUAL.items():
            out = out.when(piece == written, meant)
        return out.otherwise(F.coalesce(decoded(piece), F.lit("")))

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"{_REFERENCE}|[^&]++|&"), 0), one), "")).otherwise(text)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def normalized(text: Column, most: int) -> Column:
    """White space collapsed, no more than ``most`` characters, never ending with a space."""
    return F.rtrim(F.left(collapsed(text), F.lit(most)))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def utf8_left(text: Column, most: int) -> Column:
    """The longest beginning of whole characters that has at most ``most`` UTF-8 bytes."""
    sizes = F.transform(F.split(F.left(text, F.lit(most)), ""), F.octet_length)
    ends = F.aggregate(sizes, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")), lambda a, s: F.struct((a["bytes"] + s).alias("bytes"), (a["n"] + F.when(a["bytes"] + s <= most, 1).otherwise(0)).alias("n")))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.left(text, ends["n"]))


def clamped(text: Column, most: int) -> Column:
    """Beyond ``most`` bytes, cut at a character and marked with an ellipsis."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(utf8_left(text, most), F.lit("…")))


def file_stem(text: Column, most: int | None = STEM_BYTES) -> Column:
    """A portable file stem: lower case, other characters as one hyphen, ``most`` bytes at most (None: whole), never reserved or empty."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_-]+", "-"), r"^-+(?=[^-]|$)", "")
    stem = F.regexp_replace(words if most is None else utf8_left(words, most), r"^[-. ]+|[-. ]+$", "")
    return F.when((stem == "") | stem.isin(*RESERVED_STEMS) | stem.isNull(), F.lit("capture")).otherwise(stem)


def output_name(ordinal: Column, url: Column) -> Column:
    """A crawled page's file: ordinal, stem of the last path segment (else the host), twelve digits of the URL's SHA-256."""
    from quire.functions.urls import host, path

    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    hint = F.when(F.size(segments) > 0, F.element_at(segments, -1)).otherwise(F.coalesce(host(url), F.lit("page")))
    return F.concat(F.lpad(ordinal.cast("string"), 5, "0"), F.lit("-"), file_stem(hint), F.lit("-"), F.left(F.sha2(url, 256), F.lit(12)), F.lit(".html"))


def markdown_escaped(text: Column) -> Column:
    """A backslash before every ASCII punctuation mark."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


def script_data_escaped(text: Column) -> Column:
    """JSON that can stand in a script element."""
    return _all(text, [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")])


def css_string_escaped(text: Column) -> Column:
    """Text as it stands between the double quotes of a CSS string."""
    return _all(text, [("\\", "\\\\"), ('"', '\\"'), ("\0", "�"), ("\n", "\\a "), ("\r", "\\d "), ("\f", "\\c "), ("\t", "\\9 ")])


def yaml_escaped(text: Column) -> Column:
    return F.concat(F.lit('"'), _all(text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")]), F.lit('"'))


def longest_backtick_run(text: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit("(`+)")), F.lit(0), lambda a, x: F.greatest(a, F.length(x)))


def inline_code(text: Column) -> Column:
    """Code between backticks that are longer than any inside, padded where a backtick stands at an edge."""
    ticks = F.repeat(F.lit("`"), longest_backtick_run(text) + 1)
    pad = F.when(text.rlike("^[` ]|[` ]$"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(ticks, pad, text, pad, ticks)


def fenced_code(text: Column) -> Column:
    """Code between lines of backticks, three at least, longer than any inside."""
    fence = F.repeat(F.lit("`"), F.greatest(longest_backtick_run(text) + 1, F.lit(3)))
    return F.concat(fence, F.lit("\n"), text, F.when(text.endswith("\n"), "").otherwise("\n"), fence)


def markdown_destination(url: Column) -> Column:
    """A link's target within Markdown's round brackets: percent-encoded but for what is safe there; a colon is safe in ordinary targets only."""
    each = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[A-Za-z0-9._~/?#\[\]@!$&'*+,;=%:-]$") | (c == ""), c).otherwise(F.concat(F.lit("%"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)(?=.)", "$1%"))))
    whole = F.when(url.rlike(r"^[A-Za-z0-9._~/?#\[\]@!$&'*+,;=%:-]*$"), url).otherwise(F.array_join(each, ""))
    ordinary = F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("", "http", "https", "mailto", "tel"), F.lit(True))
    return F.when(ordinary, whole).otherwise(F.replace(whole, F.lit(":"), F.lit("%3A")))


def pdf_date(time: Column) -> Column:
    """A time in UTC as documents of that kind write it; null if it isn't a time."""
    return F.date_format(F.try_to_timestamp(F.regexp_extract(time, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.[0-9]+)?Z$", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")), "'D:'yyyyMMddHHmmss'Z'")


def doctype(name: Column, public: Column, system: Column) -> Column:
    """A document type declaration; without a name the usual one."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    quoted = lambda c: F.concat(F.lit(' "'), c, F.lit('"'))
    first = F.when(has(public), F.concat(F.lit(" PUBLIC"), quoted(public))).otherwise("")
    second = F.when(has(system), F.concat(F.when(has(public), "").otherwise(" SYSTEM"), quoted(system))).otherwise("")
    return F.when(name.isNull(), "<!doctype html>").otherwise(F.concat(F.lit("<!DOCTYPE "), name, first, second, F.lit(">")))


def coordinate(text: Column) -> Column:
    """A finite number from 0 on, else null."""
    n = text.try_cast("double")
    return F.when((n >= 0) & (n < float("inf")), n)


def dimension(text: Column) -> Column:
    """A finite number above 0, else null."""
    n = text.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def language_tag_valid(tag: Column) -> Column:
    return F.coalesce(tag.rlike(r"^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*$") & (F.length(tag) <= 64), F.lit(False))


def relative_path_valid(path: Column) -> Column:
    """A portable relative file: no root, drive, empty, ``.`` or ``..`` segment, backslash or colon."""
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.contains(":") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..")), F.lit(False))


def mime_base64(data: Column) -> Column:
    """Base64 in lines of 76 characters."""
    return F.regexp_replace(plain_base64(data), "(.{76})(?=.)", "$1\r\n")


def plain_base64(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def http_token_valid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"), F.lit(False))


def font_families(text: Column) -> Column:
    """A font-family list's names, unquoted and in lower case."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"""("[^"]*"|'[^']*'|[^,]+)""")), lambda x: F.lower(F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")))
    return F.filter(names, lambda x: x != "")


def redacted_line(line: Column) -> Column:
    """A diagnostic line without URLs and without the values of secret names."""
    plain = F.regexp_replace(F.regexp_replace(line, r"[\x00-\x1f\x7f]", ""), r"[A-Za-z][A-Za-z0-9+.-]*://[^ ]+", "<url>")
    named = F.regexp_replace(plain, r"(?i)((?:token|secret|password|authorization|api[_-]?key|credential)[^ =:]*[=:])[^ ]+", "$1<redacted>")
    return F.regexp_replace(named, r"(?i)(^| )(token|secret|password|authorization) +[^ <]+", "$1$2 <redacted>")
