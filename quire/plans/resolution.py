"""Queries over documents that ask for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import resolution as R
from quire.plans.registry import query, table

#: Sheets come in groups of eight; of each, what it imports, in order. 1 to 4 are a circle behind a diamond, 5 imports itself, 7 what isn't there.
_IMPORTS = {0: (1, 2), 1: (3,), 2: (3, 4), 3: (4,), 4: (1,), 5: (5, 0), 6: (0, 5), 7: (8,)}
_EDGES = "(VALUES " + ", ".join(f"({k}, {pos}, {to})" for k, tos in _IMPORTS.items() for pos, to in enumerate(tos)) + ") e(a, pos, b)"
_WAYS = f"""WITH RECURSIVE edges AS (SELECT * FROM {_EDGES}),
tops AS (SELECT p_partkey AS page_id, 0 AS ref, p_partkey % 8 AS s FROM part UNION ALL SELECT p_partkey, 1, p_partkey * 3 % 8 FROM part),
ways AS (SELECT page_id, s, [ref] AS key, [s] AS way FROM tops
UNION ALL SELECT page_id, b, list_append(key, pos), list_append(way, b) FROM ways JOIN edges ON a = s WHERE NOT list_contains(way, b)),
nodes AS (SELECT page_id, s, key, row_number() OVER (PARTITION BY page_id ORDER BY len(key) > 1, key) - 1 AS id FROM (SELECT page_id, s, key, row_number() OVER (PARTITION BY page_id, s ORDER BY key) AS r FROM ways) WHERE r = 1)"""


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("page_id"))
    name = lambda n: F.concat(F.lit("https://h.example.com/s"), n.cast("int").cast("string"), F.lit(".css"))
    tops = [parts.select("page_id", F.lit(ref).alias("ref_id"), F.lit("stylesheet").alias("role"), name(F.col("page_id") * times % 8).alias("resolved")) for ref, times in enumerate((1, 3))]
    bodies = F.array(*[F.struct(F.lit(n).alias("n"), F.lit("".join(f'@import "s{to}.css";' for to in tos)).alias("body")) for n, tos in _IMPORTS.items()])
    sheets = parts.select("page_id", F.explode(bodies).alias("x")).select("page_id", name(F.col("x.n")).alias("url"), F.lit(200).alias("status"), F.lit("text/css").alias("media_type"), F.col("x.body").cast("binary").alias("body"))
    return tops[0].unionByName(tops[1]), sheets


@query(f"""{_WAYS} SELECT page_id, id, 'https://h.example.com/s' || s || '.css' AS url, len(key) - 1 AS depth, CASE WHEN s = 8 THEN 'resource.missing' END AS error FROM nodes""")
def resolved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style sheets that import others, with diamonds and circles: each once, numbered as a depth-first walk meets them."""
    documents, _ = R.resolved(*_sheets(spark, sf_dir))
    return documents.select("page_id", "id", "url", "depth", "error")


@query(f"""{_WAYS} SELECT u.page_id, u.s AS a, e.pos, e.b, CASE WHEN u.key[:len(v.key)] = v.key THEN 'css.cycle' WHEN e.b = 8 THEN 'resource.missing' END AS error
FROM nodes u JOIN edges e ON e.a = u.s JOIN nodes v ON v.page_id = u.page_id AND v.s = e.b""")
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the imports lead back."""
    _, edges = R.resolved(*_sheets(spark, sf_dir))
    number = lambda c: F.regexp_extract(c, r"/s(\d+)\.css", 1).cast("int")
    return edges.select("page_id", number("url").alias("a"), "pos", number("target").alias("b"), "error")


_B64 = "to_base64(encode({}))"
_IMAGE = f"'data:image/png;base64,' || {_B64.format('p_name')}"
_D = f"'.d{{b:url(\"' || {_IMAGE} || '\")}}'"
_SVG = f"'<svg xmlns=\"x\"><image href=\"' || {_IMAGE} || '#v\"></image><use href=\"#g\"></use></svg>'"
_C = f"'/* url(no) */ @import \"data:text/css;base64,' || {_B64.format(_D)} || '\"; .c{{b:url(\"data:image/svg+xml;base64,' || {_B64.format(_SVG)} || '\")}}'"
_A = f"'@import \"data:text/css;base64,' || {_B64.format(_C)} || '\";@import \"data:text/css;base64,' || {_B64.format(_D)} || '\";x{{y:url(\"data:application/octet-stream;base64,\")}}'"


@query(f"""SELECT p_partkey AS page_id, unnest([{{'id': 0, 'url': 'a.css', 'body': {_A}}}, {{'id': 1, 'url': 'c.css', 'body': {_C}}}, {{'id': 2, 'url': 'd.css', 'body': {_D}}}, {{'id': 3, 'url': 'i.png', 'body': p_name}}, {{'id': 4, 'url': 'v.svg', 'body': {_SVG}}}, {{'id': 5, 'url': 'gone.png', 'body': NULL}}], recursive := true) FROM part""")
def rewritten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet that imports two, of which one imports the other: a picture, a vector picture with a picture, and a missing one, all put in place leaf first."""
    at = "https://h.example.com/"
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), "p_name")
    own = {"a.css": ("text/css", '@import "c.css";@import "d.css";x{y:url(gone.png)}'), "c.css": ("text/css", '/* url(no) */ @import "d.css"; .c{b:url(v.svg)}'), "d.css": ("text/css", ".d{b:url(i.png)}"), "v.svg": ("image/svg+xml", '<svg xmlns="x"><image href="i.png#v"></image><use href="#g"></use></svg>')}
    rows = F.array(*[F.struct(F.lit(at + u).alias("url"), F.lit(kind).alias("media_type"), F.lit(body).alias("body")) for u, (kind, body) in own.items()], F.struct(F.lit(f"{at}i.png").alias("url"), F.lit("image/png").alias("media_type"), F.col("p_name").alias("body")))
    sheets = part.select("page_id", F.lit(200).alias("status"), F.explode(rows).alias("x")).select("page_id", "x.url", "status", "x.media_type", F.col("x.body").cast("binary").alias("body"))
    top = part.select("page_id", F.lit(0).alias("ref_id"), F.lit("stylesheet").alias("role"), F.lit(f"{at}a.css").alias("resolved"))
    documents, _ = R.resolved(top, sheets)
    return documents.select("page_id", "id", F.replace("url", F.lit(at), F.lit("")).alias("url"), F.unbase64(F.substring_index("data_url", ",", -1)).cast("string").alias("body"))
