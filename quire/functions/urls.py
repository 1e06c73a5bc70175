"""URL columns: identity, origin, joining, redaction. All are expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys whose values are secret, and endings of such keys.
SECRET_KEYS = ("access_token", "api_key", "apikey", "auth", "authorization", "awsaccesskeyid", "credential", "key", "key-pair-id", "password", "policy", "secret", "signature", "sig", "token")
SECRET_ENDINGS = ("accesskeyid", "apikey", "authorization", "credential", "password", "secret", "signature", "token")
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def scheme(url: Column) -> Column:
    """Lower-case scheme, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def host(url: Column) -> Column:
    """Lower-case host without user and port, or null."""
    return F.nullif(F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)), F.lit(""))


def port(url: Column) -> Column:
    """The explicit port, else the scheme's own, else null."""
    own = F.nullif(F.regexp_extract(authority(url), r":([0-9]+)$", 1), F.lit("")).cast("int")
    known = F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair])
    return F.coalesce(own, F.try_element_at(known, scheme(url)))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def origin(url: Column) -> Column:
    """scheme://host:port; null if one of them is missing."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit(":"), port(url).cast("string"))


def same_origin(left: Column, right: Column) -> Column:
    return F.coalesce(origin(left) == origin(right), F.lit(False))


def normalized(url: Column) -> Column:
    """A web URL with its scheme and host in lower case, without its scheme's own port and dot segments, an empty path as ``/``; others as they are."""

    def use(x: Column) -> Column:
        known = F.create_map(*[F.lit(y) for pair in DEFAULT_PORTS.items() for y in pair])
        spelled = let(F.ltrim(F.regexp_extract(x["place"], r":([0-9]*)$", 1), F.lit("0")), lambda n: F.when((n == "") | (n == F.try_element_at(known, x["scheme"]).cast("string")), F.lit("")).otherwise(F.concat(F.lit(":"), n)))
        way = let(x["path"], lambda p: F.when(p == "", F.lit("/")).otherwise(_dots(p)))
        return F.concat(x["scheme"], F.lit("://"), F.regexp_extract(x["place"], r"^([^@]*@)", 1), x["host"], spelled, way, F.regexp_extract(x["url"], r"^[^?#]*(.*)$", 1))

    parts = lambda u: F.struct(u.alias("url"), scheme(u).alias("scheme"), host(u).alias("host"), authority(u).alias("place"), path(u).alias("path"))
    return let(url, lambda u: let(parts(u), lambda x: F.when(x["scheme"].isin(*DEFAULT_PORTS) & x["host"].isNotNull(), use(x)).otherwise(x["url"])))


def page_url(url: Column) -> Column:
    """A page's identity: http and https only, normalized, without its fragment; else null."""
    return let(normalized(without_fragment(F.trim(url))), lambda u: F.when(scheme(u).isin("http", "https") & host(u).isNotNull(), u))


def percent_encoded(text: Column) -> Column:
    """Spaces and characters outside ASCII as percent-encoded UTF-8; what is encoded stays."""
    each = lambda t: F.transform(F.split(t, ""), lambda c: F.when(c.rlike(r"^[!#-;=?-_a-z~\[\]|]$") | (c == ""), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))
    return let(text, lambda t: F.when(t.rlike(r"^[!#-;=?-_a-z~\[\]|]*$"), t).otherwise(F.array_join(each(t), "")))


def _dots(p: Column) -> Column:
    """Removes ``.`` and ``..`` segments of an absolute path."""
    kept = lambda q: F.aggregate(F.split(F.substring(q, 2, 1 << 30), "/"), F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    whole = lambda q: let(kept(q), lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(F.substring_index(q, "/", -1).isin(".", "..") & (F.size(k) > 0), F.lit("/")).otherwise(F.lit(""))))
    return let(p, lambda q: F.when(q.rlike(r"/\.\.?(/|$)"), whole(q)).otherwise(q))


def _encoded(ref: Column) -> Column:
    """``percent_encoded`` but for the authority, whose letters stay as they are."""
    place = lambda r: F.regexp_extract(r, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)", 1)
    return let(ref, lambda r: let(place(r), lambda p: F.concat(p, percent_encoded(F.substring(r, F.length(p) + 1, F.lit(1 << 30))))))


def join(base: Column, reference: Column) -> Column:
    """A reference resolved against a base URL, normalized: absolute, protocol-relative, rooted, relative, query or fragment only.

    White space around a reference and line breaks and tabs in it are dropped,
    backslashes of web URLs are slashes; null if either side is null or the
    base has no scheme. Arguments and parts are bound once, so that the plan
    stays small.
    """
    ref = _encoded(F.regexp_replace(F.trim(F.regexp_replace(reference, r"[\t\r\n]", "")), r"\\", "/"))
    plain = lambda r: F.struct(r.alias("ref"), scheme(r).alias("scheme"), path(r).alias("path"), F.regexp_extract(r, r"^[^?#]*(.*)$", 1).alias("rest"))
    own = lambda b: F.struct(scheme(b).alias("scheme"), authority(b).alias("place"), path(b).alias("path"), F.regexp_extract(b, _PARTS, 4).alias("query"))

    def use(x: Column) -> Column:
        b, r = x["b"], x["r"]
        root = F.concat(b["scheme"], F.lit("://"), b["place"])
        way = F.when(b["path"] == "", F.lit("/")).otherwise(b["path"])
        rooted = (
            F.when(r["path"].startswith("/"), F.concat(_dots(r["path"]), r["rest"]))
            .when((r["path"] == "") & r["ref"].startswith("?"), F.concat(way, r["rest"]))
            .when(r["path"] == "", F.concat(way, b["query"], r["rest"]))
            .otherwise(F.concat(_dots(F.concat(F.regexp_extract(way, r"^(.*/)", 1), r["path"])), r["rest"]))
        )
        return normalized(F.when(b["scheme"].isNull(), F.lit(None).cast("string")).when(r["scheme"].isNotNull(), r["ref"]).when(r["ref"].startswith("//"), F.concat(b["scheme"], F.lit(":"), r["ref"])).otherwise(F.concat(root, rooted)))

    both = lambda x: let(F.struct(let(x["b"], own).alias("b"), let(x["r"], plain).alias("r")), use)
    return let(F.struct(base.alias("b"), ref.alias("r")), lambda x: F.when(x["b"].isNotNull() & x["r"].isNotNull(), both(x)))


def is_secret_key(key: Column) -> Column:
    small = F.lower(key)
    return small.isin(*SECRET_KEYS) | F.exists(F.split(small, "[^a-z0-9]"), lambda p: p.isin(*SECRET_KEYS)) | small.rlike("(?:" + "|".join(SECRET_ENDINGS) + ")$")


def redacted(url: Column) -> Column:
    """User, password and the values of secret query keys replaced; a ``data:`` URL says no more than that it is one."""
    encoded = F.url_encode(F.lit("<redacted>"))
    query = F.substring(F.regexp_extract(url, _PARTS, 4), 2, 1 << 30)

    def pair(item: Column) -> Column:
        key = F.try_url_decode(F.substring_index(item, "=", 1))
        value = F.when(item.contains("="), F.try_url_decode(F.substring(item, F.length(F.substring_index(item, "=", 1)) + 2, F.lit(1 << 30)))).otherwise(F.lit(""))
        return F.concat(F.url_encode(key), F.lit("="), F.when(is_secret_key(key), encoded).otherwise(F.url_encode(value)))

    items = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair), "&")
    owner = F.regexp_extract(authority(url), r"^([^@]*)@", 1)
    user = F.when(owner == "", F.lit("")).when(owner.contains(":"), F.concat(encoded, F.lit(":"), encoded, F.lit("@"))).otherwise(F.concat(encoded, F.lit("@")))
    whole = F.concat(scheme(url), F.lit("://"), user, F.regexp_replace(authority(url), r"^[^@]*@", ""), path(url), F.when(query == "", F.regexp_extract(url, _PARTS, 4)).otherwise(F.concat(F.lit("?"), items)), F.regexp_extract(url, _PARTS, 5))
    return F.when(scheme(url) == "data", F.lit("data:[redacted]")).otherwise(whole)


def navigation_scheme(target: Column) -> Column:
    """The scheme that a link would navigate to, or null for a relative one."""
    return F.nullif(F.lower(F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))
