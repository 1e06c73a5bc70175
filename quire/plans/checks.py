"""Queries over manifests' checks, limits, replacements, plans and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import media, text
from quire.operators import checks as C
from quire.operators import pages as P
from quire.operators.resources import summary
from quire.plans.registry import dealt, query, table


@query("""WITH r AS (SELECT l_orderkey AS page_id, l_linenumber - 1 AS id, 1 + l_partkey % 3 AS frame_id, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linenumber = 7 THEN 'omitted' ELSE 'embedded' END AS kind,
l_partkey % 50 AS content, 10 + l_partkey % 50 + CASE WHEN l_suppkey % 97 = 0 THEN 1 ELSE 0 END AS bytes, l_partkey % 41 = 0 AS unknown FROM lineitem),
d AS (SELECT page_id, bool_or(least <> most) AS conflict FROM (SELECT page_id, content, min(bytes) AS least, max(bytes) AS most FROM r WHERE kind = 'embedded' GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT page_id, count(DISTINCT id) <> count(*) OR min(id) <> 0 OR max(id) <> count(*) - 1 AS gaps, bool_or(frame_id > CASE WHEN page_id % 7 = 0 THEN 2 ELSE 3 END) AS strange, bool_or(kind = 'embedded' AND unknown) AS unknown FROM r GROUP BY 1)
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'verify.record_count' WHEN gaps THEN 'verify.record_ids' WHEN strange THEN 'verify.record_frame' WHEN unknown THEN 'verify.record_provenance' WHEN conflict THEN 'verify.digest_length' WHEN page_id % 13 = 0 THEN 'verify.summary' END AS error FROM f LEFT JOIN d USING (page_id)""")
def manifest_record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the records of an order's manifest, some of which are spoiled."""
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") - 1).alias("id"), (k % 3 + 1).alias("frame_id"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linenumber") == 7, "omitted").otherwise("embedded").alias("kind"),
        F.sha2((k % 50).cast("string"), 256).alias("digest"), (k % 50 + 10 + F.when(F.col("l_suppkey") % 97 == 0, 1).otherwise(0)).cast("bigint").alias("bytes"), F.when(k % 41 != 0, "fetch").alias("provenance"),
    )
    rows = rows.withColumn("digest", F.when(F.col("kind") == "embedded", F.col("digest")))
    page, one = F.col("page_id"), lambda c: F.when(c, 1).otherwise(0)
    manifests = summary(rows).withColumns({"frames": F.lit(3) - one(page % 7 == 0), "discovered": F.col("discovered") + one(page % 11 == 0), "embedded_bytes": F.col("embedded_bytes") + one(page % 13 == 0)})
    return C.record_faults(rows, manifests)


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS page_id, l_linenumber + CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END AS frame_id FROM lineitem), m AS (SELECT l_orderkey AS page_id, count(*) AS frames FROM lineitem GROUP BY 1),
g AS (SELECT page_id, frames, count(*) FILTER (frame_id BETWEEN 1 AND frames) AS inside, count(*) FILTER (NOT frame_id BETWEEN 1 AND frames) AS surplus FROM f JOIN m USING (page_id) GROUP BY 1, 2)
SELECT page_id, frames - inside AS missing, surplus FROM g WHERE frames <> inside OR surplus > 0""")
def frame_set_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page_id")
    return C.frame_set_faults(rows.select("page_id", (F.col("l_linenumber") + F.when(F.col("l_partkey") % 19 == 0, 1).otherwise(0)).alias("frame_id")), rows.groupBy("page_id").agg(F.count("*").alias("frames")))


@query("""WITH a AS (SELECT 'h' || c_custkey % 60 AS host, c_custkey % 9 <> 0 AND c_custkey % 31 <> 0 AS fine FROM customer) SELECT 'h' || n_nationkey * 3 AS host, coalesce((SELECT bool_and(fine) FROM a WHERE host = 'h' || n_nationkey * 3), false) AS allowed FROM nation""")
def resolved_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of which every resolved address must pass; one without an address doesn't."""
    k = F.col("c_custkey")
    address = F.when(k % 9 == 0, "10.0.0.1").when(k % 31 == 0, "x").otherwise(F.concat(F.lit("8.8."), (k % 250).cast("string"), F.lit(".1")))
    addresses = table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), (k % 60).cast("string")).alias("host"), address.alias("address"))
    return C.hosts_allowed(addresses, table(spark, sf_dir, "nation").select(F.concat(F.lit("h"), (F.col("n_nationkey") * 3).cast("string")).alias("host")))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def newest_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of observed responses keeps of each session: its newest."""
    return C.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("""WITH p AS (SELECT l_orderkey AS page_id, count(*) AS "references", min(CASE WHEN l_partkey % 29 = 0 THEN l_linenumber - 1 END) AS bad FROM lineitem GROUP BY 1)
SELECT page_id, "references", CASE WHEN bad < 4 THEN 'discover.url' WHEN "references" > 4 THEN 'discover.limit' END AS error FROM p""")
def admitted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") - 1).alias("ref_id"), F.when(F.col("l_partkey") % 29 != 0, F.lit("https://h/")).alias("resolved"))
    return C.admitted(rows, 4)


@query("""SELECT page_id, idx, CASE WHEN bytes > 45 THEN 'resource.limit' WHEN total > 120 THEN 'resource.total_limit' END AS error FROM (SELECT o_custkey AS page_id, o_orderkey AS idx, o_orderkey % 60 AS bytes,
sum(CASE WHEN o_orderkey % 60 <= 45 THEN o_orderkey % 60 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders)""")
def store_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inserted(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 60).alias("bytes")), 45, 120)


@query("""WITH s AS (SELECT DISTINCT text FROM documents WHERE doc_id % 7 <> 0) SELECT doc_id AS page_id, 0 AS ref_id, CASE WHEN s.text IS NULL THEN 'store.missing' ELSE 'store.content' END AS error
FROM documents d LEFT JOIN s ON s.text = d.text WHERE s.text IS NULL OR (doc_id % 10 = 0 AND doc_id % 20 <> 0)""")
def committed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed bytes against the store's: those that nothing rewrote must be equal."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.when(k % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary")
    rows = docs.select(k.alias("page_id"), F.lit(0).alias("ref_id"), F.sha2("text", 256).alias("digest"), (k % 20 == 0).alias("rewritten"), body.alias("body"))
    return C.committed_faults(rows, docs.where(k % 7 != 0).select(F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("bytes")).distinct())


@query("""WITH t AS (SELECT l_orderkey AS page_id, l_linenumber AS ref_id FROM lineitem WHERE l_linenumber <= 4), r AS (SELECT l_orderkey AS page_id, l_linenumber AS ref_id, l_returnflag AS replacement FROM lineitem WHERE l_linenumber >= 2)
SELECT page_id, ref_id, r.replacement AS replacement, CASE WHEN r.replacement IS NULL THEN 'replace.missing' WHEN ref_id > 4 THEN 'replace.unknown' END AS error FROM t FULL JOIN r USING (page_id, ref_id)""")
def replacement_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ref_id"), F.col("l_returnflag").alias("replacement"))
    return C.replaced(rows.where("ref_id <= 4"), rows.where("ref_id >= 2"))


@query("""SELECT c_nationkey AS plan_id, CAST(count(*) AS INTEGER) AS jobs, sha256(string_agg(sha256('{"url":"https://h.example.com/' || c_custkey || '","output":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '"' || c_name || '"' END || '}'), chr(10) ORDER BY c_custkey)) AS identity FROM customer GROUP BY 1""")
def batch_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    jobs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plan_id"), k.alias("idx"), F.concat(F.lit("https://h.example.com/"), k.cast("string")).alias("url"), F.when(k % 5 != 0, F.col("c_name")).alias("output"))
    return C.batch_identity(jobs)


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'pending' END AS state, CASE WHEN o_orderstatus = 'F' THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS digest,
CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 3 = 0 THEN 'internal' ELSE o_orderpriority END END AS error FROM orders""")
def outcome_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("cancelled")
    record = C.outcome_record(status, F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")), F.sha2(F.col("o_orderkey").cast("string"), 256))
    return table(spark, sf_dir, "orders").select("o_orderkey", record.alias("r")).select("o_orderkey", "r.*")


@query("""WITH c AS (SELECT c_nationkey AS n, bool_or(c_custkey % 50 = 0) AS low, bool_or(c_custkey % 10 = 0) AS odd FROM customer GROUP BY 1)
SELECT n AS plan_id, CASE WHEN n % 11 = 0 THEN 'resume.version' WHEN n % 7 = 0 THEN 'resume.kind' WHEN n % 5 = 0 THEN 'resume.plan' WHEN n % 3 = 0 AND low THEN 'resume.coordinates' WHEN n % 4 = 0 AND odd THEN 'resume.record' END AS error FROM c""")
def resume_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint for each nation with its customers as jobs' records, spoiled in several ways."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    done = k % 2 == 0
    record = F.struct(F.when((n % 3 == 0) & (k % 50 == 0), -1).otherwise(k).alias("idx"), F.when(done, "complete").otherwise("failed").alias("state"), F.when(done & ~((n % 4 == 0) & (k % 10 == 0)), F.lit("d")).alias("digest"), F.when(~done, F.lit("e")).alias("error"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(record).alias("records"))
    name = F.concat(F.lit("i"), n.cast("string"))
    checkpoints = rows.select(n.alias("plan_id"), F.when(n % 11 == 0, 2).otherwise(1).alias("version"), F.lit("batch").alias("kind"), name.alias("identity"), "records")
    plans = rows.select(n.alias("plan_id"), F.when(n % 7 == 0, "crawl").otherwise("batch").alias("kind"), F.when(n % 5 == 0, F.lit("x")).otherwise(name).alias("identity"), F.lit(1 << 40).alias("jobs"))
    return C.resume_faults(checkpoints, plans, 1)


@query("""WITH RECURSIVE i AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_partkey * 2 FROM part WHERE p_partkey % 8 = 0),
w AS (SELECT p_partkey AS page_id, p_partkey AS s, 0 AS depth, [p_partkey] AS way, CAST(NULL AS VARCHAR) AS error FROM part
UNION ALL SELECT page_id, b, depth + 1, list_append(way, b), CASE WHEN list_contains(way, b) THEN 'css.cycle' WHEN depth + 1 > 4 THEN 'css.depth' END FROM w JOIN i ON a = s WHERE error IS NULL)
SELECT page_id, 's' || s AS url, depth, error FROM w""")
def nested_style_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style sheets that import others, with cycles, four levels deep."""
    parts, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda c: F.concat(F.lit("s"), c.cast("bigint").cast("string"))
    edges = [parts.where(k % every == 0).select(name(k).alias("url"), name(to).alias("target")) for every, to in ((2, F.floor(k / 2)), (3, k + 1), (8, k * 2))]
    seeds = parts.select(k.alias("page_id"), name(k).alias("url"))
    return C.nested_sheets(seeds, edges[0].unionByName(edges[1]).unionByName(edges[2]), 4)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://h/a%20b?x=%28' || p_size || '%29' WHEN 1 THEN 'javascript%3Af%28' || p_size || '%29' WHEN 2 THEN '/%C3%A9/' || p_size || '%5C%22' ELSE 'MailTo:' || p_size || '@h' END AS target FROM part""")
def markdown_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://h/a b?x=("), n, F.lit(")"))).when(k == 1, F.concat(F.lit("javascript:f("), n, F.lit(")"))).when(k == 2, F.concat(F.lit("/é/"), n, F.lit('\\"'))).otherwise(F.concat(F.lit("MailTo:"), n, F.lit("@h")))
    return table(spark, sf_dir, "part").select("p_partkey", text.markdown_destination(url).alias("target"))


@query("""SELECT p_partkey, repeat('`', greatest(p_size % 6 + 1, 3)) || chr(10) || c || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) END || repeat('`', greatest(p_size % 6 + 1, 3)) AS fenced FROM (SELECT *, p_name || repeat('`', p_size % 6) || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) ELSE '' END AS c FROM part)""")
def fenced_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat("p_name", F.repeat(F.lit("`"), F.col("p_size") % 6), "p_type", F.when(F.col("p_size") % 2 == 0, "\n").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.fenced_code(code).alias("fenced"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'D:' || strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y%m%d%H%M%S') || 'Z' END AS pdf FROM orders""")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.date_format(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400), "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.pdf_date(F.concat(time, F.when(F.col("o_orderkey") % 5 == 0, "+01:00").when(F.col("o_orderkey") % 2 == 0, ".250Z").otherwise("Z"))).alias("pdf"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '<!doctype html>' ELSE '<!DOCTYPE html' || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' PUBLIC "' || p_brand || '"' WHEN 2 THEN ' SYSTEM "' || p_type || '"' ELSE ' PUBLIC "' || p_brand || '" "' || p_type || '"' END || '>' END AS doctype FROM part""")
def doctypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", text.doctype(F.when(n % 7 != 0, F.lit("html")), F.when((n % 4).isin(1, 3), F.col("p_brand")), F.when((n % 4).isin(2, 3), F.col("p_type")).otherwise("")).alias("doctype"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 NOT IN (0, 3) THEN (p_retailprice - 1000.0) END AS coordinate FROM part WHERE p_retailprice >= 1000.0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_retailprice < 1000.0""")
def clip_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 5
    given = F.when(n == 0, "NaN").when(n == 3, "1e999").otherwise((F.col("p_retailprice") - 1000.0).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.coordinate(given).alias("coordinate"))


@query("""SELECT kind, count(*) AS n, kind = 'text/css' AS css, kind = 'image/svg+xml' AS svg, kind IN ('text/html', 'application/xhtml+xml') AS html FROM (SELECT list_extract(['text/css', 'image/svg+xml', 'text/html', 'application/xhtml+xml', 'image/png'], 1 + p_partkey % 5) AS kind FROM part) GROUP BY 1""")
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("text/css", "image/svg+xml", "text/html", "application/xhtml+xml", "image/png"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    given = F.concat(F.upper(kind), F.when(F.col("p_size") % 2 == 0, "; charset=utf-8").otherwise(""))
    rows = table(spark, sf_dir, "part").select(kind.alias("kind"), *[f(given).alias(name) for name, f in (("css", media.is_css), ("svg", media.is_svg), ("html", media.is_html))])
    return rows.groupBy("kind", "css", "svg", "html").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS page_id, '<svg><a href="/p/' || p_size || '">' || p_name || '</a><a title="' || p_brand || '">x</a><iframe srcdoc="<b>' || p_type || '</b>"></iframe><p x=' || p_size || '>' AS html FROM part""")
def sanitized_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event attributes after a slash and a quote, script URLs in character references, a page within a page."""
    parts = F.expr("""concat('<svg/onload="f(', p_partkey, ')"><a href="/p/', p_size, '"onclick="y()">', p_name, '</a><a href="&#x6A;avascript:z()" title="', p_brand, '">x</a><iframe srcdoc="<script>s(', p_size, ')</script><b>', p_type, '</b>"></iframe><p on-x=', p_size, ' x=', p_size, '>')""")
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), P.sanitized(parts).alias("html"))


@query("""SELECT p_partkey AS page_id, '<img src="data:A' || p_partkey || '" srcset="data:A' || p_partkey || ' 1x, z.png 2x"><div title="' || p_brand || '" style="background:url(&quot;data:B' || p_size || '&quot;)"></div><a href="a.png">' || p_name || '</a><style>/* url(a.png) */ @import "data:C"; x{y:url("data:A' || p_partkey || '")}</style><link href="data:C">' AS html FROM part""")
def embedded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data URLs put into sources, srcsets, style attributes and style elements; links, comments and unknown URLs stay."""
    html = F.expr(r"""concat('<img src="a.png" srcset="a.png 1x, z.png 2x"><div title="', p_brand, '" style="background:url(\'b.png\')"></div><a href="a.png">', p_name, '</a><style>/* url(a.png) */ @import "c.css"; x{y:url( a.png )}</style><link href=c.css>')""")
    bodies = F.create_map(F.lit("a.png"), F.concat(F.lit("data:A"), F.col("p_partkey").cast("string")), F.lit("b.png"), F.concat(F.lit("data:B"), F.col("p_size").cast("string")), F.lit("c.css"), F.lit("data:C"))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), P.embedded(html, bodies).alias("html"))


@query("""SELECT p_partkey AS page_id, 1 AS pos, '<p>' || p_name || '</p>' AS srcdoc, '<div class="' || p_brand || '">x<iframe' || CASE WHEN p_size % 2 = 0 THEN ' srcdoc="<p>' || p_name || '</p>"' ELSE '' END || '></iframe></div>' AS html FROM part WHERE p_size % 2 = 0""")
def inline_frame_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that hold their page, and pages without the attributes that are reserved for captures."""
    html = F.expr("""concat('<div data-pa-scroll="1,', p_size, '" class="', p_brand, '">x<iframe data-pa-x', if(p_size % 2 = 0, concat(' srcdoc="<p>', p_name, '</p>"'), ''), '></iframe></div>')""")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return P.inline_frames(rows).join(rows.select("page_id", P.without_attributes(F.col("html"), "data-pa-").alias("html")), "page_id")


#: An address of either kind for each customer, and a range for each supplier; as numbers, what SQL compares.
_NETS = """a AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS six, CASE WHEN c_custkey % 2 = 0 THEN (CAST(536939960 AS HUGEINT) << 96) + (CAST(c_custkey % 16 AS HUGEINT) << 80) + c_custkey ELSE CAST(167772160 + c_custkey * 37 AS HUGEINT) END AS n FROM customer),
r AS (SELECT s_suppkey AS s, s_suppkey % 2 = 0 AS six, CASE WHEN s_suppkey % 2 = 0 THEN 33 + s_suppkey % 90 ELSE 9 + s_suppkey % 24 END AS bits, CASE WHEN s_suppkey % 2 = 0 THEN (CAST(536939960 AS HUGEINT) << 96) + (CAST(s_suppkey % 16 AS HUGEINT) << 80) + s_suppkey ELSE CAST(167772160 + s_suppkey * 37 AS HUGEINT) END AS n FROM supplier),
m AS (SELECT k, s FROM a JOIN r ON a.six = r.six AND (a.n >> CASE WHEN r.six THEN 128 - bits ELSE 32 - bits END) = (r.n >> CASE WHEN r.six THEN 128 - bits ELSE 32 - bits END))"""


def _address(k: Column) -> Column:
    """The address of a number: 2001:db8:(k % 16)::k, or 10.0.0.0 and 37 times the number."""
    n = k * 37 + (10 << 24)
    low = F.concat_ws(".", *[(F.floor(n / (1 << bits)) % 256).cast("string") for bits in (24, 16, 8, 0)])
    return F.when(k % 2 == 0, F.concat(F.lit("2001:DB8:"), F.lower(F.hex(k % 16)), F.lit("::"), F.when(k < 65536, F.hex(k)).otherwise(F.concat(F.hex(F.floor(k / 65536)), F.lit(":"), F.hex(k % 65536))))).otherwise(low)


def _networks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    addresses = table(spark, sf_dir, "customer").select(k.alias("k"), _address(k).alias("address"))
    bits = F.when(s % 2 == 0, s % 90 + 33).otherwise(s % 24 + 9).cast("string")
    return addresses, table(spark, sf_dir, "supplier").select(s.alias("s"), F.concat_ws("/", _address(s), bits).alias("cidr"))


@query(f"WITH {_NETS} SELECT k, s FROM m")
def range_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both kinds in ranges of all lengths, by prefix."""
    addresses, ranges = _networks(spark, sf_dir)
    keys = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
    return C.rows_in_ranges(addresses, ranges, keys.select("k", _address(F.col("k")).alias("address"))).select("k", "s")


@query(f"""WITH {_NETS}, h AS (SELECT k % 40 AS host, k, k % 5 = 0 AS wide, EXISTS (SELECT 1 FROM m WHERE m.k = a.k) AS inside FROM a)
SELECT 'h' || host AS host, count(*) AS addresses, count(*) FILTER (NOT inside AND NOT wide AND host <> 7 AND k % 2 = 0) AS blocked FROM h GROUP BY host""")
def hosts_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts under custom rules: one named, ranges, private addresses let pass."""
    addresses, ranges = _networks(spark, sf_dir)
    k = F.col("k")
    rows = addresses.select(F.concat(F.lit("h"), (k % 40).cast("string")).alias("host"), F.when(k % 5 == 0, F.concat(F.lit("2606:4700::"), F.hex(F.floor(k / 65536)), F.lit(":"), F.hex(k % 65536))).otherwise(F.col("address")).alias("address"))
    return C.hosts_allowed_by_rules(rows, ranges, ("H7",), private=True)
