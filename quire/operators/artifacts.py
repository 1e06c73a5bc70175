"""Artifacts: encoding with policy and manifest, static verification, containers, validation, reports.

An artifact is one self-contained page. Verification is a row of checks over its
tokens, in a fixed order, whose first failure is the artifact's error: bad data
is a result, never an exception in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text, urls
from quire.operators.pages import TOKEN, active_parts, attribute, attributes, head_of, is_script_url, rewritten, tag_of

MANIFEST_ID, MANIFEST_TYPE, STATE_ID = "pa-manifest", "application/vnd.page-archive.manifest+json", "pa-state"
#: The program that restores scroll positions when an artifact is opened.
STATE_PROGRAM = "for(const e of document.querySelectorAll('[data-pa-scroll]')){const [x,y]=e.dataset.paScroll.split(',');e.scrollTo(+x,+y)}"
FORMATS = {"pdf": ".pdf", "markdown": "-markdown/", "zip": ".zip", "self-extracting": ".compressed.html", "mhtml": ".mhtml"}


def script_digest(program: Column) -> Column:
    return F.concat(F.lit("'sha256-"), text.plain_base64(F.unhex(F.sha2(program, 256))), F.lit("'"))


def content_policy(programs: Column) -> Column:
    """The eleven directives that an artifact's pages are bound by; ``programs`` are the scripts that may run."""
    # Fixed values, in this order.
    allowed = F.when(F.size(programs) == 0, F.lit("script-src 'none'")).otherwise(F.concat(F.lit("script-src "), F.array_join(F.transform(programs, script_digest), " ")))
    before = ("default-src 'none'", "base-uri 'none'", "connect-src 'none'", "font-src data:", "form-action 'none'", "frame-src data: blob:", "img-src data: blob:", "media-src data: blob:", "object-src 'none'")
    return F.concat_ws("; ", *map(F.lit, before), allowed, F.lit("style-src 'unsafe-inline' data:"))


def encoded(html: Column, manifest: Column) -> Column:
    """A page with its policy first in the head, and its manifest and state program last; those of an earlier encoding go."""
    policy = F.concat(F.lit('<meta http-equiv="Content-Security-Policy" content="'), content_policy(F.array(F.lit(STATE_PROGRAM))), F.lit('">'))
    tail = F.concat(F.lit(f'<script type="{MANIFEST_TYPE}" id="{MANIFEST_ID}">'), text.script_data_escaped(manifest), F.lit(f'</script><script id="{STATE_ID}">{STATE_PROGRAM}</script>'))

    def old(token: Column) -> Column:
        own = (tag_of(token) == "script") & F.coalesce(attribute(token, "id"), F.lit("")).isin(MANIFEST_ID, STATE_ID)
        meta = (tag_of(token) == "meta") & (F.lower(F.coalesce(attribute(token, "http-equiv"), F.lit(""))) == "content-security-policy")
        return F.when(own | meta, F.lit("")).otherwise(token)

    plain = rewritten(html, old)
    headed = F.when(plain.rlike(r"(?i)<head[\s>]"), plain).otherwise(F.concat(F.lit("<head></head>"), plain))

    def add(token: Column) -> Column:
        return F.when(tag_of(token) != "head", token).when(token.startswith("</"), F.concat(tail, token)).otherwise(F.concat(token, policy))

    return rewritten(headed, add)


def manifest_of(html: Column) -> Column:
    """The manifest's JSON text, or null if there isn't exactly one manifest."""
    own = F.filter(F.regexp_extract_all(html, F.lit(TOKEN), 0), lambda t: (tag_of(t) == "script") & F.coalesce(attribute(t, "id") == MANIFEST_ID, F.lit(False)))
    body = F.regexp_replace(F.get(own, F.lit(0)), r"(?is)^<script[^>]*>|</script\s*>$", "")
    return F.when(F.size(own) == 1, body)


def verified(artifacts: DataFrame, html: str = "html") -> DataFrame:
    """``artifacts`` with ``error`` (null if sound), ``bytes`` and ``sha256``."""
    found = F.regexp_extract_all(F.col(html), F.lit(TOKEN), 0)
    rows = artifacts.withColumns({"__tokens": F.transform(found, lambda t: F.struct(t.alias("token"), tag_of(t).alias("tag"), t.startswith("</").alias("closing"), attributes(t).alias("attrs"))), "__manifest": manifest_of(F.col(html))})
    value = lambda t, name: F.coalesce(F.get(F.filter(t["attrs"], lambda a: a["name"] == name), F.lit(0))["value"], F.lit(""))
    opens = F.filter("__tokens", lambda t: ~t["closing"])
    policies = F.filter(opens, lambda t: (t["tag"] == "meta") & (F.lower(value(t, "http-equiv")) == "content-security-policy"))
    programs = F.filter(opens, lambda t: (t["tag"] == "script") & (value(t, "id") == STATE_ID))
    first_in_head = F.get(F.filter(F.transform(opens, lambda t, i: F.struct(t.alias("t"), F.get(opens, i - 1)["tag"].alias("before"))), lambda x: x["before"] == "head"), F.lit(0))["t"]
    scripts = F.exists(opens, lambda t: (t["tag"] == "script") & ~value(t, "id").isin(MANIFEST_ID, STATE_ID) & ~value(t, "type").isin("application/json", "application/ld+json"))
    active = F.exists(opens, lambda t: F.exists(t["attrs"], lambda a: a["name"].startswith("on") | is_script_url(a["value"])) | (t["tag"] == "base"))
    nested = lambda page: F.exists(F.transform(F.regexp_extract_all(page, F.lit(TOKEN), 0), active_parts), lambda f: f["drop"] | (f["events"] + f["script_urls"] > 0))
    active |= F.exists(opens, lambda t: F.exists(t["attrs"], lambda a: (a["name"] == "srcdoc") & nested(a["value"])))
    remote = F.exists(opens, lambda t: ~t["tag"].isin("a", "area", "link") & F.exists(t["attrs"], lambda a: a["name"].isin("src", "poster", "data", "background") & (a["value"] != "") & ~a["value"].startswith("data:")))
    scrolls = F.exists(opens, lambda t: F.coalesce(F.get(F.filter(t["attrs"], lambda a: a["name"] == "data-pa-scroll"), F.lit(0))["value"].rlike(r"^-?[0-9.]+,-?[0-9.]+$") == F.lit(False), F.lit(False)))
    error = (
        F.when(F.col("__manifest").isNull(), "verify.manifest")
        .when(F.try_parse_json("__manifest").isNull(), "verify.manifest_json")
        .when(F.size(policies) != 1, "verify.policy")
        .when(value(F.get(policies, F.lit(0)), "content") != content_policy(F.array(F.lit(STATE_PROGRAM))), "verify.policy_text")
        .when(F.coalesce(first_in_head["token"] != F.get(policies, F.lit(0))["token"], F.lit(True)), "verify.policy_place")
        .when((F.size(programs) != 1) | (F.get(programs, F.lit(0))["token"] != f'<script id="{STATE_ID}">{STATE_PROGRAM}</script>'), "verify.state_program")
        .when(scripts | active, "verify.active_content")
        .when(scrolls, "verify.scroll")
        .when(remote, "verify.remote_reference")
    )
    rows = rows.withColumns({"error": error, "bytes": F.octet_length(html).cast("bigint"), "sha256": F.sha2(F.col(html), 256)})
    return rows.drop("__tokens", "__manifest")


def mhtml(html: Column, url: Column) -> Column:
    """A page as MHTML: one part, its boundary from the page's digest, all lines with CRLF."""
    boundary = F.concat(F.lit("----pa-"), F.left(F.sha2(html, 256), F.lit(32)))
    lines = (F.lit("From: <saved by page-archive>"), F.concat(F.lit("Snapshot-Content-Location: "), urls.redacted(url)), F.lit("MIME-Version: 1.0"), F.concat(F.lit('Content-Type: multipart/related; type="text/html"; boundary="'), boundary, F.lit('"')), F.lit(""), F.concat(F.lit("--"), boundary), F.lit("Content-Type: text/html; charset=utf-8"), F.lit("Content-Transfer-Encoding: base64"), F.lit(""), text.mime_base64(html.cast("binary")), F.concat(F.lit("--"), boundary, F.lit("--")), F.lit(""))
    return F.concat_ws("\r\n", *lines)


def mhtml_body(container: Column) -> Column:
    """The page of an MHTML container, or null if it isn't one."""
    coded = F.regexp_extract(container, r"(?s)Content-Transfer-Encoding: base64\r\n\r\n(.*?)\r\n------?pa-", 1)
    return F.try_to_binary(F.nullif(F.regexp_replace(coded, r"[\r\n]", ""), F.lit("")), F.lit("base64")).cast("string")


def zipped(html: Column, manifest: Column) -> Column:
    """A ZIP of ``index.html`` and ``manifest.json`` with fixed times, so that equal pages give equal bytes."""

    def run(pages: pd.Series, manifests: pd.Series) -> pd.Series:
        import io
        import zipfile

        def one(page, sidecar):
            if page is None or sidecar is None:
                return None
            with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in (("index.html", page), ("manifest.json", sidecar + "\n")):
                    z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
            return out.getvalue()

        return pd.Series([one(a, b) for a, b in zip(pages, manifests)], dtype="object")

    return F.pandas_udf(run, "binary")(html, manifest)


def unzipped(container: Column) -> Column:
    """struct<html, manifest, error> of such a ZIP: two members in order, deflated, no comment."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        def one(data):
            try:
                with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                    names = [i.filename for i in z.infolist()]
                    if names != ["index.html", "manifest.json"] or z.comment or any(i.compress_type != zipfile.ZIP_DEFLATED or i.flag_bits & 1 for i in z.infolist()):
                        return None, None, "zip.members"
                    return z.read("index.html").decode(), z.read("manifest.json").decode().removesuffix("\n"), None
            except (zipfile.BadZipFile, UnicodeDecodeError, OSError):
                return None, None, "zip.container"

        for part in parts:
            yield pd.DataFrame([one(x) for x in part], columns=["html", "manifest", "error"], dtype="object")

    return F.pandas_udf(run, "html string, manifest string, error string")(container)


def self_extracting(html: Column) -> Column:
    """A page that holds itself compressed, with its digest and a loader that unpacks it."""

    def run(pages: pd.Series) -> pd.Series:
        import base64
        import gzip
        import hashlib

        def one(page):
            if page is None:
                return None
            body = page.encode()
            packed = base64.b64encode(gzip.compress(body, 9, mtime=0)).decode()
            loader = "const s=document.getElementById('pa-packed').textContent,b=Uint8Array.from(atob(s),c=>c.charCodeAt(0));new Response(new Blob([b]).stream().pipeThrough(new DecompressionStream('gzip'))).text().then(t=>{document.open();document.write(t);document.close()})"
            return f'<!DOCTYPE html><html data-pa-sha256="{hashlib.sha256(body).hexdigest()}"><meta charset="utf-8"><script type="text/plain" id="pa-packed">{packed}</script><script>{loader}</script></html>'

        return pages.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(html)


def export_name(base: Column, kind: Column) -> Column:
    return F.concat(base, F.element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), kind))


def export_error(formats: Column, base: Column, version: Column) -> Column:
    """Why an export can't be done, or null."""
    return (
        F.when(version != 1, "export.version")
        .when(F.size(formats) == 0, "export.no_format")
        .when(F.size(F.array_distinct(formats)) != F.size(formats), "export.duplicate_format")
        .when((F.trim(base) == "") | ~F.octet_length(base).between(1, 512), "export.base_name")
    )


def request_error(url: Column, scope: Column, selector: Column, width: Column, height: Column, remote: Column) -> Column:
    """Why a capture can't be requested, or null; the first reason in order."""
    return (
        F.when(~F.coalesce(urls.scheme(url).isin("http", "https", "file"), F.lit(False)), "input.url_scheme")
        .when((scope == "selector") & (F.coalesce(F.trim(selector), F.lit("")) == ""), "input.selector")
        .when((scope != "selector") & selector.isNotNull(), "input.selector_scope")
        .when(remote & (urls.scheme(url) == "file"), "input.remote_file")
        .when(~(width.between(1, 16_384) & height.between(1, 16_384)), "input.viewport")
    )


def exit_code(code: Column, stage: Column, verifying: Column) -> Column:
    return F.when(code == "pa.runtime.interrupted", 130).when(code.isin("pa.artifact.read", "pa.artifact.size"), 1).when((stage == "verification") & verifying, 3).when(stage == "validation", 2).otherwise(1)


def observation_verdict(attempted: Column, page_errors: Column, stable: Column) -> Column:
    """What a reopened page's observation says: network first, then page errors, then stability."""
    return F.when(F.size(attempted) > 0, "verify.network").when(F.size(page_errors) > 0, "verify.page_error").when(~stable, "verify.unstable").otherwise("sound")


def payload_bytes(html: Column) -> Column:
    """The size that a page's markup is budgeted at: tags, attributes and text in UTF-8 bytes."""
    return F.octet_length(html).cast("bigint") + F.aggregate(F.regexp_extract_all(html, F.lit(TOKEN), 0), F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(head_of(t)))


def bench_statistics(samples: DataFrame, key: str, ms: str, size: str) -> DataFrame:
    """``least, median, p95, most`` of a case's times and its throughput in bytes a second at the median."""
    stats = samples.groupBy(key).agg(F.min(ms).alias("least"), F.percentile(ms, F.lit(0.5)).alias("median"), F.percentile(ms, F.lit(0.95)).alias("p95"), F.max(ms).alias("most"), F.max(size).alias("bytes"))
    return stats.select(key, "least", "median", "p95", "most", (F.col("bytes") / (F.col("median") / 1000)).alias("throughput"))


def corpus_report(outcomes: DataFrame, group: str) -> DataFrame:
    """``group, attempted, succeeded, failed, total``: a row for each group of ``outcomes(outcome)``, and one of all with ``total`` 1."""
    rows = outcomes.rollup(group).agg(F.count("*").alias("attempted"), F.count_if(F.col("outcome") == "success").alias("succeeded"), F.count_if(F.col("outcome") == "failure").alias("failed"), F.grouping(group).cast("int").alias("total"))
    return rows.select(group, "attempted", "succeeded", "failed", "total")
