"""Chains of frames, and addresses in ranges, against plain loops and the standard library."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from quire.functions import network
from quire.operators import chains, checks

FRAMES = "page_id long, frame_id long, parent_id long, x double, y double, scale_x double, scale_y double, scroll_x double, scroll_y double"


def test_clips_against_a_walk_up(spark):
    rnd = random.Random(2)
    rows = {}
    for page in range(4):
        for f in range(40):
            rows[page, f] = (page, f, None if f == 0 else rnd.randrange(f) if page % 2 else f - 1, *[float(rnd.randrange(50)) for _ in range(2)], *[rnd.choice([0.5, 1.0, 2.0]) if page % 2 else 1.0 for _ in range(2)], *[float(rnd.randrange(9)) for _ in range(2)])
    rows[9, 0], rows[9, 1] = (9, 0, 1, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0), (9, 1, 0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0)
    rows[9, 2], rows[9, 3], rows[9, 4] = (9, 2, 77, *[1.0] * 6), (9, 3, 2, *[1.0] * 6), (9, 4, 0, *[1.0] * 6)
    frames = spark.createDataFrame(list(rows.values()), FRAMES)
    rects = frames.select("page_id", "frame_id", F.lit(1).alias("id"), F.lit(8.0).alias("x"), F.lit(16.0).alias("y"), F.lit(2.0).alias("width"), F.lit(4.0).alias("height"))

    def walked(page, f):
        _, _, up, x, y, a, b, sx, sy = rows[page, f]
        left, top, width, height = 8.0 - sx, 16.0 - sy, 2.0, 4.0
        while up is not None:
            left, top, width, height = x + left * a, y + top * b, width * a, height * b
            _, _, up, x, y, a, b, _, _ = rows[page, up]
        return left, top, width, height, None

    found = {(r["page_id"], r["frame_id"]): tuple(r)[3:] for r in chains.clips(rects, frames).collect()}
    for (page, f), got in found.items():
        assert got == ((None,) * 4 + ("visual_fallback.frame",) if page == 9 else walked(page, f)), (page, f)
    errors = {(r["page_id"], r["frame_id"]): r["error"] for r in chains.placements(frames).collect() if r["page_id"] == 9}
    assert errors == {(9, 0): "frame.circle", (9, 1): "frame.circle", (9, 2): "frame.detached", (9, 3): "frame.detached", (9, 4): "frame.circle"}
    assert chains.clips(rects.limit(0), frames.limit(0)).collect() == []


def test_addresses_against_the_standard_library(spark):
    rnd = random.Random(4)
    texts = [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(50)] + [ipaddress.IPv6Address(rnd.getrandbits(40) << rnd.randrange(88)).exploded.upper() for _ in range(20)]
    texts += ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::8.8.8.8", "1:2:3:4:5:6:1.2.3.4", "fe80::1", "fd00::", "2001:20::5", "2001:10::5", "3fff::1", "2002::", "2606:4700::1111"]
    bad = [":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", ":1::2", "1::2:", "12345::", "g::", "", "1.2.3.4", "::1.2.3", "::1.2.3.256", "1::2%3", None]
    rows = spark.createDataFrame([(t,) for t in texts + bad], "a string")
    for r in rows.select("a", network.v6_digits(F.col("a")).alias("d")).collect():
        assert r["d"] == (f"{int(ipaddress.IPv6Address(r['a'])):032x}" if r["a"] in texts else None), r["a"]


def test_ranges_against_all_pairs(spark):
    rnd = random.Random(6)
    four, six = [f"10.{rnd.randrange(4)}.{rnd.randrange(256)}.{rnd.randrange(256)}" for _ in range(40)], [f"2001:db8:{rnd.randrange(4):x}::{rnd.randrange(1 << 16):x}" for _ in range(40)]
    ranges = [f"{rnd.choice(four)}/{n}" for n in range(33)] + [f"{rnd.choice(six)}/{n}" for n in range(129)]
    given = spark.createDataFrame([(a,) for a in [*four, *six, "no", None, four[0]]], "address string")
    known = spark.createDataFrame([(c,) for c in [*ranges, "10.0.0.0", "10.0.0.0/33", "x/8", "::/129", "10.0.0.0/-1", None, ranges[0]]], "cidr string")
    want = {(a, c) for a in {*four, *six} for c in ranges if ipaddress.ip_address(a).version == ipaddress.ip_network(c, strict=False).version and ipaddress.ip_address(a) in ipaddress.ip_network(c, strict=False)}
    found = [(r["address"], r["cidr"]) for r in checks.in_ranges(given, known).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert checks.in_ranges(given, known.limit(0)).count() == checks.in_ranges(given.limit(0), known).count() == 0
