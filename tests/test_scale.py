"""What keeps large tables off the driver and spread over the cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chains, checks, pages, resources
from quire.sources.levels import Levels


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_are_merged_not_broadcast(spark):
    tables = Levels(spark)
    level = tables.kept(spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit("x" * 100).alias("v")))
    for how in ("left", "left_anti", "left_semi", "inner"):
        found = plan(level.join(level.where("v IS NOT NULL").groupBy("k").agg(F.max("v").alias("w")), "k", how))
        assert "SortMergeJoin" in found and "Broadcast" not in found
    frames = spark.createDataFrame([(0, 0, None, *[1.0] * 6), (0, 1, 0, *[1.0] * 6)], "page_id long, frame_id long, parent_id long, x double, y double, scale_x double, scale_y double, scroll_x double, scroll_y double")
    rects = frames.select("page_id", "frame_id", F.lit(1).alias("id"), "x", "y", F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    assert "Broadcast" not in plan(chains.clips(rects, frames))


def test_resources_made_by_an_explode_are_not_broadcast(spark):
    rows = spark.range(10).select(F.col("id").alias("page_id"))
    body = rows.select("page_id", F.explode(F.array(F.lit("https://h/a"), F.lit("https://h/b"))).alias("url")).select("page_id", "url", F.lit(200).alias("status"), F.lit("text/css").alias("media_type"), F.lit(b"x").alias("body"))
    found = resources.outcomes(rows.select("page_id", F.lit("other").alias("role"), F.lit("https://h/a").alias("resolved")), body)
    assert "Broadcast" not in plan(found) and found.where("kind = 'embedded'").count() == 10


def test_suggested_names_are_whole(spark, tmp_path):
    from quire.plans import QUERIES

    spark.createDataFrame([(1, "https://h/", f"<title>{'Üü ' * 40}</title>"), (2, "https://h/", "<title>A b</title>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = dict(map(tuple, QUERIES["suggested_names"](spark, str(tmp_path)).collect()))
    assert found == {1: "-".join(["üü"] * 40), 2: "a-b"}


def test_ranges_join_once_and_beyond_one_octet(spark):
    from quire.plans.checks import _address

    given = spark.createDataFrame([(1, "10.0.0.1"), (2, "10.0.0.1"), (3, "no")], "k long, address string")
    known = spark.createDataFrame([(7, "10.0.0.0/8"), (8, "10.0.0.0/8"), (9, "11.0.0.0/8")], "s long, cidr string")
    found = checks.rows_in_ranges(given, known)
    assert sorted(map(tuple, found.select("k", "s").collect())) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    joins = plan(found)
    assert sum(joins.count(j) for j in ("SortMergeJoin", "BroadcastHashJoin")) == 1
    number = spark.createDataFrame([(453_439,), (900_001,)], "k long")
    assert [r[0] for r in number.select(_address(F.col("k"))).collect()] == ["11.0.0.27", "11.252.30.69"]


def test_heavy_rows_are_dealt(spark):
    from quire.plans import QUERIES

    for name in ("discovered_references", "embedded_pages", "sanitized_attacks", "markdown_export", "page_metadata", "sanitized_html", "sanitize_report_wild", "range_matches"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_bare_tags_and_repeated_names(spark):
    tokens = {
        "<p>": [], "</p>": [], "</p x=1>": [("x", "1")], "<br/>": [], "<p/x>": [("x", "")], "<!-- <a b=c> -->": [], "<!doctype html>": [], "text <a b=c>": [], "": [], "<p\n>": [],
        "<script>a='<b c=d>'</script>": [], '<a B=1 b=2 c="&amp;">': [("b", "1"), ("c", "&")], "<a c=1 b=2 c=3 b=4>": [("c", "1"), ("b", "2")], None: None,
    }
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    found = {r["t"]: r["a"] and [tuple(x) for x in r["a"]] for r in rows.select("t", pages.attributes(F.col("t")).alias("a")).collect()}
    assert found == tokens


def test_crowds_meet_ranges_in_tiles(spark, monkeypatch):
    import ipaddress
    import random

    rnd = random.Random(9)
    four = [f"10.{rnd.randrange(2)}.{rnd.randrange(2)}.{rnd.randrange(256)}" for _ in range(150)] + [f"{n}.1.2.3" for n in range(20, 30)]
    six = [f"2001:db8:{rnd.randrange(3):x}::{rnd.randrange(64):x}" for _ in range(150)] + ["fe80::1"]
    given = [(k, a) for k, a in enumerate([*four, *six, "no", None, ":"])] + [(7, four[7])] * 20
    cidrs = [f"{rnd.choice(four)}/{rnd.choice((0, 7, 8, 16, 23, 24, 30, 32))}" for _ in range(60)] + [f"{rnd.choice(six)}/{rnd.choice((0, 20, 47, 48, 100, 125, 128))}" for _ in range(60)]
    known = [(s, c) for s, c in enumerate([*cidrs, "10.0.0.0/33", "x", None])] + [(3, cidrs[3])] * 9
    nets = [(s, ipaddress.ip_network(c, strict=False)) for s, c in known if c in cidrs]
    want = sorted((k, s) for k, a in given if a in four or a in six for s, n in nets if ipaddress.ip_address(a) in n)
    addresses, ranges = spark.createDataFrame(given, "k long, address string"), spark.createDataFrame(known, "s long, cidr string")
    for crowd, tall, wide, rows, block in ((5, 16, 8, 3, 2), (20, 7, 3, 4, 5), (40, 1000, 1000, 100, 100), (100_000, 8, 8, 2, 2)):
        for name, n in (("CROWD", crowd), ("TALL", tall), ("WIDE", wide), ("BLOCK_ROWS", rows), ("BLOCK_RANGES", block)):
            monkeypatch.setattr(checks, name, n)
        found = checks.rows_in_ranges(addresses, ranges)
        assert sorted(map(tuple, found.select("k", "s").collect())) == want, crowd
        assert ("__rows" in plan(found)) == (crowd < 100_000)
        none = checks.rows_in_ranges(addresses, ranges.where("cidr LIKE '%/128'"))  # nothing wide: no crowd has a range of its own length
        assert sorted(map(tuple, none.select("k", "s").collect())) == sorted((k, s) for k, s in want if dict(known)[s].endswith("/128"))


def test_many_pairs_are_few_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(checks, "CROWD", 100, raising=False)
    net = F.concat(F.lit("2001:db8:"), (F.col("id") % 8).cast("int").cast("string"), F.lit("::"))
    given = spark.range(4_000).repartition(4, "id").select(F.col("id").alias("k"), F.concat(net, F.hex("id")).alias("address"))
    known = spark.range(16_000).select(F.col("id").alias("s"), F.concat(net, F.lit("/"), (F.col("id") / 8 % 50 + 50).cast("int").cast("string")).alias("cidr"))
    checks.rows_in_ranges(given, known).select("k", "s").write.parquet(f"{tmp_path}/pairs")
    assert tuple(spark.read.parquet(f"{tmp_path}/pairs").agg(F.count("*"), F.sum("k"), F.sum("s")).first()) == (8_000_000, 2_000 * sum(range(4_000)), 500 * sum(range(16_000)))
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 8_000_000 // 2


def test_hosts_ask_for_prefixes_not_for_ranges(spark):
    given = spark.createDataFrame([("a", "10.0.0.1"), ("a", "10.0.0.1"), ("b", "11.0.0.1"), ("b", "10.0.0.2"), ("c", None), ("d", "2001:db8::1")], "host string, address string")
    known = spark.range(3000).select(F.concat(F.lit("10.0."), (F.col("id") / 256 % 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string"), F.lit("/8")).alias("cidr")).union(spark.sql("SELECT '2001:db8::/32'"))
    assert sorted(r[0] for r in checks.within(given, known).collect()) == ["10.0.0.1", "10.0.0.2", "2001:db8::1"]
    assert checks._prefixes(known).select(*checks.PREFIX).distinct().count() == 2
    rows = checks.hosts_allowed_by_rules(given, known).collect()
    assert {r["host"]: (r["addresses"], r["blocked"]) for r in rows} == {"a": (1, 0), "b": (2, 0), "c": (1, 1), "d": (1, 0)}
