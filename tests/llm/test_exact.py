"""Operators whose results brute force or the library gives: encoding, packing, media, search, near-duplicates, personal data."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe_trie, near_dedup, packing, pii_bootstrap, queries, transport_stream, va_search

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, length string, __text string, start int"
LONG = "la casa de the und " * 20_000


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe_trie.VOCABULARY))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    texts = [None, "", " \n", LONG, "same words in a row here", "same words in a row here", "a<|endoftext|>b", "É Σ ǅ 日本 ²½ it's", "x" * 5000]
    rows = [(i, t, None, None, None, "z", None, "z", 1) for i, t in enumerate(texts)] + [(4, texts[4], "en", "s", 1, "z", "z", "z", 1), (None, "no id", "en", "s", 1, "z", "z", "z", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def hexed(ids):
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def rows_of(df):
    return df.collect()


def test_encoding_of_odd_documents(odd, library):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    found = rows_of(bpe_trie.digests(odd))
    assert len(found) == odd.count()
    for r in found:
        options = [library.encode(t, add_special_tokens=False).ids for t in texts[r["doc_id"]]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in [(len(i), hexed(i), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in options]
    full = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe_trie.encode(odd).collect()}
    assert full[0] == ([], "") and full[6][0] == library.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_encoding_of_a_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op8_bpe_trie(spark, SF).collect():
        assert r["ids_sha256"] == hexed(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


@hypothesis_settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghilmnorstuéßñ'!.,12 \n", max_size=60))
def test_trie_agrees_with_the_library(text):
    own, library = bpe_trie.encoder(), Tokenizer.from_file(public_tokenizers.path(bpe_trie.VOCABULARY)) if not hasattr(test_trie_agrees_with_the_library, "t") else test_trie_agrees_with_the_library.t
    test_trie_agrees_with_the_library.t = library
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode([text])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (bpe_trie.digests(none), bpe_trie.encode(none), packing.pack(none), transport_stream.store(none), near_dedup.classes(none), near_dedup.deduplicated(none), pii_bootstrap.digests(none), va_search.top_k(vectors, F.col("vec_id") % 2 == 0)):
        assert df.count() == 0


def held(pieces, capacity):
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return sequences


def test_packing_holds_every_id_once(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    sequences = held(pieces, packing.CAPACITY)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{p['length']}I", *p["ids"])) and len(p["ids"]) == p["length"]
    assert by_doc.keys() == texts.keys()
    for key, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        ids = [i for p in own for i in p["ids"]]
        assert ids == [*library.encode(texts[key], add_special_tokens=False).ids, packing.END_ID]
        assert all(p["doc_tokens"] == len(ids) for p in own)
    assert padding(sequences, packing.CAPACITY) <= 0.02


def padding(sequences, capacity):
    """The share of padding: a sequence is padded to the capacity unless its length is a power of two."""
    lengths = [sum(p["length"] for p in own) for own in sequences.values()]
    padded = [n if n & (n - 1) == 0 else capacity for n in lengths]
    return 1 - sum(lengths) / sum(padded)


def test_packing_of_many_small_partitions(spark):
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(200), with_ids=False).collect()
    assert padding(held(pieces, packing.CAPACITY), packing.CAPACITY) <= 0.03


def test_packing_of_odd_documents(odd):
    pieces = packing.pack(odd, with_ids=False).collect()
    held(pieces, packing.CAPACITY)
    assert {(p["start"], p["length"]) for p in pieces if p["doc_id"] == 0} == {(0, 1)}
    assert sum(p["length"] for p in pieces if p["doc_id"] == 4) == 2 * 7  # the repeated row is packed twice
    assert packing.pack(odd, capacity=2).where("length > 2").count() == 0


@hypothesis_settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(40, 60))
def test_differencing_divides_within_capacity(sizes, capacity):
    windows = packing.divide(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= capacity for w in windows)


@hypothesis_settings(max_examples=200, deadline=None)
@given(st.binary(max_size=2000))
def test_streams_round_trip(payload):
    media = transport_stream.read(stored := transport_stream.write(transport_stream.padded(payload)))
    assert media.payload == transport_stream.padded(payload) and media.faults == 0 and len(stored) % 188 == 0


def test_streams_show_faults():
    stored = transport_stream.write(random.Random(1).randbytes(200_000))
    whole = transport_stream.read(stored)
    assert whole.stamps == [i * 16384 * 90000 // 8000 for i in range(13)] and [u for u, _ in whole.access] == [0, 4, 8, 12]
    assert transport_stream.read(stored[: 188 * 5] + stored[188 * 6 :]).faults > 0
    assert transport_stream.read(stored[:8] + b"\1" + stored[9:]).faults > 0
    assert transport_stream.read(b"").payload == b"" and transport_stream.read(b"x" * 500).faults > 0


def test_streams_as_others_may_write_them():
    ts = transport_stream
    payload = random.Random(2).randbytes(100_032)
    stored = ts.write(payload)
    packets = [stored[i : i + 188] for i in range(0, len(stored), 188)]
    whole = ts.read(stored)
    assert whole.clocks == [t * 300 for t in whole.stamps[:: ts.ACCESS_EVERY]] and whole.programs == [(1, ts.PMT_PID, [(ts.STREAM_PID, ts.PRIVATE_DATA)])]
    # a packet sent twice is no fault, a break that is announced neither
    assert ts.read(b"".join([*packets[:7], packets[6], *packets[7:]])).faults == 0
    twice = ts.read(b"".join([*packets[:7], packets[6], packets[6], *packets[7:]]))
    assert ts.read(b"".join([*packets[:7], packets[6], *packets[7:]])).payload == payload and twice.payload == payload
    first = next(i for i, p in enumerate(packets[20:], 20) if p[3] & 0x20 and p[4] > 0 and p[1] & 0x40)
    told = packets[first][:5] + bytes([packets[first][5] | 0x80]) + packets[first][6:]
    shifted = [p[:3] + bytes([p[3] & 0xF0 | (p[3] + 5) & 15]) + p[4:] for p in [told, *packets[first + 1 :]]]
    assert ts.read(b"".join([*packets[:first], *shifted])).faults == 0
    assert ts.read(b"".join([*packets[:first], packets[first], *shifted[1:]])).faults == 1
    # a map of many streams takes two packets; the table PIDs' continuity counts, too
    streams = [(0x100, 6), *[(0x200 + i, 0x1B) for i in range(60)]]
    body = b"".join(struct.pack(">BHH", kind, 0xE000 | pid, 0xF000) for pid, kind in streams)
    section = struct.pack(">BHHBBBHH", 0x02, 0xB000 | (9 + len(body) + 4), 1, 0xC1, 0, 0, 0xE100, 0xF000) + body
    section += struct.pack(">I", ts.crc32_mpeg(section))
    data = b"\0" + section
    parts = [data[i : i + 184].ljust(184, b"\xff") for i in range(0, len(data), 184)]
    maps = [struct.pack(">BHB", 0x47, (0x4000 if i == 0 else 0) | ts.PMT_PID, 0x10 | i) + part for i, part in enumerate(parts)]
    media = ts.read(b"".join([packets[0], *maps, *packets[2:]]))
    assert len(maps) == 2 and media.programs == [(1, ts.PMT_PID, streams)] and media.payload == payload and media.faults == 0
    assert ts.read(b"".join([packets[0], maps[0], *packets[2:]])).faults == 1
    spoiled = maps[1][:20] + b"x" + maps[1][21:]
    assert ts.read(b"".join([packets[0], maps[0], spoiled, *packets[2:]])).faults == 1 and ts.read(stored, program=7).payload == b""



def test_media_of_odd_documents(odd):
    found = {r["doc_id"]: r for r in transport_stream.describe(transport_stream.store(odd)).collect()}
    assert found[0]["n_bytes"] == 0 and found[0]["payload_bytes"] == 64 and found[0]["payload_sha256"] == found[1]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest()
    assert found[3]["payload_sha256"] == hashlib.sha256(transport_stream.padded(LONG.encode())).hexdigest() and found[3]["feature"].endswith("faults=0")
    assert found[4]["media_sha256"] == found[5]["media_sha256"]


def test_search_agrees_with_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    vectors += [(i, [3.0] * 8) for i in range(400, 1400)]  # a vector that most rows have
    odd = [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (904, [1.0, 2.0]), (50, vectors[50][1]), *[(400, [3.0] * 8)] * 9]
    df = spark.createDataFrame([(*v, "x") for v in vectors + odd], "vec_id long, embedding array<double>, score string")
    found = sorted(tuple(r) for r in va_search.top_k(df, F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id", "score").collect())
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in [*vectors, *odd[6:]]]
    expected = []
    for q, v in whole[: len(vectors)]:
        if q % 10 == 0:
            best = sorted((-int(v @ w), i) for i, w in whole if i != q)[:5]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert found == sorted(expected)


def exact_classes(texts, least=0.8):
    shingles = {}
    for i, t in texts.items():
        w = t.lower().split()
        shingles[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(texts)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = shingles[a], shingles[b]
            union = sum((x | y).values())
            if texts[a] == texts[b] or (union and sum((x & y).values()) >= least * union):
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return {i: find(i) for i in texts}


def test_near_duplicates_agree_with_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(12):
        own = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        for copy in range(6):
            changed = [w if rng.random() > copy * 0.006 else rng.choice(words) for w in own]
            texts[base * 10 + copy] = " ".join(changed)
        texts[base * 10 + 6] = " ".join(own * 3)
        texts[base * 10 + 7] = " ".join(own)
    shared = " ".join(rng.choice(words) for _ in range(60))
    for i in range(200, 230):  # a passage that many share, and little else
        texts[i] = shared + " " + " ".join(rng.choice(words) for _ in range(30))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert found == exact_classes(texts)
    kept = {r["doc_id"] for r in near_dedup.deduplicated(df).collect()}
    assert kept == set(found.values())


def test_near_duplicates_of_odd_documents(odd):
    found = [(r["doc_id"], r["class_id"]) for r in near_dedup.classes(odd).collect()]
    assert len(found) == odd.count()
    assert dict(found)[1] == 0 and dict(found)[5] == 4  # null and empty are one text
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 2, 3, 4, 6, 7, 8)] + [(True, 0)]


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    left, right = [], []
    for k in range(60):
        own = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 120))] * rng.choice((1, 1, 3, 9))
        left.append(" ".join(own))
        right.append(" ".join(w if rng.random() > 0.03 else "zz" for w in own))
    import pyarrow as pa

    sides = [near_dedup.signatures(*near_dedup.shingles(*near_dedup.buffer_of(pa.array(t))), len(t), 2048) for t in (left, right)]
    off = (sides[0] == sides[1]).mean(axis=1) - near_dedup.similarity(left, right)
    assert abs(off.mean()) < 0.01 and np.sqrt((off**2).mean()) < 0.03


def brute_base(text):
    p = pii_bootstrap
    out = [(0, *m.span()) for m in p._EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in p._IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in p._CARD.finditer(text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and p.luhn(d)]
    return out + [(3, *m.span()) for m in p._PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@hypothesis_settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.-+ 0123456789()%_é", max_size=60))
def test_base_entities(text):
    assert pii_bootstrap.base(text) == brute_base(text)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"Please {('call', 'dial')[i % 2]} me at +1 ({100 + i}) 555-{1000 + i} soon") for i in range(40)]
    rows += [(100 + i, f"Please {('call', 'dial')[i % 2]} me at +1 ({900 - i}) 55-{10 + i}") for i in range(3)] + [(200, "nothing at +1 here 12345"), (201, None), (202, "")]
    found = {r["doc_id"]: r for r in pii_bootstrap.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[100 + i]["n_phone"] == 0 and found[100 + i]["spans"] == "phone:18:32" for i in range(3))
    assert found[0]["n_phone"] == 1 and found[0]["base_sha256"] == hashlib.sha256(b"phone:18:35").hexdigest()
    assert found[200]["spans"] == found[201]["spans"] == found[202]["spans"] == ""


def test_contexts_find_identifiers_of_other_forms(spark):
    seeds = lambda i: (f"Please {('call', 'dial')[i % 2]} me at +1 ({100 + i}) 555-{1000 + i} soon", f"the host address 10.0.{i}.7 answers", f"paid by card {card(i)} today")

    def card(i):
        return next(n for k in range(10) if pii_bootstrap.luhn(n := f"4{i:03}00000000{i:03}{k}"))

    unseen = {  # none has a seed's form
        "Please call me at (555) 123-4567": "phone:18:32", "Please dial me at 030 1234567": "phone:18:29", "Please dial me at 1234567890 soon": "phone:18:28",
        "the host address 2001:db8::8a2e:370:7334 answers": "ip:17:40", "paid by card DE89370400440532013000 today": "card:13:35", "paid by card DE89 3704 0044 0532 0130 00 today": "card:13:40",
    }
    rows = [(i, " . ".join(seeds(i))) for i in range(40)] + [(100 + i, t) for i, t in enumerate(unseen)] + [(200, "Please call me at 10:30 today, a sum of 1234567890123")]
    found = {r["doc_id"]: r["spans"] for r in pii_bootstrap.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[100 + i] for i in range(len(unseen))] == list(unseen.values())
    assert found[200] == "" and found[0].count(":") == 6


def test_what_a_round_finds_induces_patterns_of_the_next(spark):
    """Account numbers near two kinds of words: only the first is near seeds, the second is near what the first found."""
    names = [f"acct-{i}-{7000 + i}x" for i in range(4)]
    edges = [(3, 3, 1.0, f"+1 555 000 {i:03}", "call<") for i in range(9)] + [(-1, 3, 1.0, n, "call<") for n in names] + [(-1, 3, 1.0, n, "reach<") for n in names] + [(-1, 3, 1.0, f"030 55 {i}", "reach<") for i in range(2)] + [(-1, 3, 1.0, "030 66", "other<")]
    df = spark.createDataFrame([*edges, edges[0], edges[-1]], "kind int, of int, fit double, instance string, pattern string")
    for rounds in (1, 2, 3, 5):
        assert {(r["instance"], r["of"]) for r in pii_bootstrap.bootstrapped(df, rounds).collect()} == brute_bootstrap(edges, rounds)
    assert {i for i, _ in brute_bootstrap(edges, 1)} < {i for i, _ in brute_bootstrap(edges, 5)}


def brute_bootstrap(edges, rounds):
    import math

    graph = {}
    for kind, of, fit, instance, pattern in edges:
        k, f = graph.get((pattern, of, instance), (-1, 0.0))
        graph[pattern, of, instance] = (max(k, kind), max(f, fit))
    nodes = {}
    for (_, of, instance), (kind, fit) in graph.items():
        k, f = nodes.get((instance, of), (-1, 0.0))
        nodes[instance, of] = (max(k, kind), max(f, fit))
    sure = lambda kind, of: 1.0 if kind == of else -1.0 if kind >= 0 else None
    belief = {n: sure(kind, n[1]) if sure(kind, n[1]) is not None else 0.0 for n, (kind, _) in nodes.items()}
    for _ in range(rounds):
        scores = {}
        for p in {(p, of) for p, of, _ in graph}:
            own = [(i, of) for q, of, i in graph if (q, of) == p]
            if sum(belief[n] >= pii_bootstrap.LEAST_BELIEF for n in own) >= pii_bootstrap.LEAST_SEEDS:
                scores[p] = sum(max(belief[n], 0) for n in own) / (sum(nodes[n][1] for n in own) + 0.5)
        for n, (kind, fit) in nodes.items():
            heard = [math.log(1.0001 - min(scores[p, of], 1)) for p, of, i in graph if (i, of) == n and (p, of) in scores]
            belief[n] = sure(kind, n[1]) if sure(kind, n[1]) is not None else (1 - math.exp(sum(heard))) * 0.95 * fit if heard else 0.0
    found = {}
    for p, of, i in graph:
        if scores.get((p, of), 0) >= pii_bootstrap.LEAST_SCORE and nodes[i, of][0] < 0 and belief[i, of] >= pii_bootstrap.LEAST_BELIEF:
            found.setdefault(i, set()).add((belief[i, of], -of))
    return {(i, -max(options)[1]) for i, options in found.items()}


def test_long_numbers_and_contexts_are_whole():
    tokens = lambda text: [text[s:e] for _, s, e in pii_bootstrap.candidates(text, [])]
    assert tokens("id " + "7" * 40 + " end") == ["7" * 40] and tokens("1234567 " * 30) == ["1234567"] * 30
    word, text = "w" * 60, "w" * 60 + " 12345678 " + "v" * 70
    assert pii_bootstrap.contexts(text, 61, 69, [(0, 60), (70, 140)]) == [f"{word}<", f"{word}<>{'v' * 70}"]
    began = time.thread_time()
    for page in ("1 " * 200_000, "9" * 500_000 + "x", "(1" * 200_000, "+1-" * 200_000, "AB12 " * 100_000):
        list(pii_bootstrap.edges_of(page, []))
    assert time.thread_time() - began < 60


def test_identifier_tokens():
    tokens = lambda text: [text[s:e] for _, s, e in pii_bootstrap.candidates(text, [])]
    assert tokens("tel:030 1234567, #1 800 555 0199 and (name7@host)") == ["030 1234567", "1 800 555 0199", "name7@host"]
    assert tokens("7536784127813050 4845168114407329") == ["7536784127813050", "4845168114407329"]


def test_personal_data_of_odd_documents(odd):
    assert pii_bootstrap.digests(odd).count() == odd.count()


def test_recall_of_near_duplicates_over_all_pairs(spark):
    """Of all pairs of texts that are similar enough, those in one class; over the whole table, by exact products."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({r["text"].lower() for r in docs.collect() if r["text"]})
    found = {r["text"].lower(): r["class_id"] for r in near_dedup.classes(docs).join(docs.select("doc_id", "text"), "doc_id").collect() if r["text"]}
    keys, counts = near_dedup.shingles(*near_dedup.buffer_of(pa.array(texts, pa.string())))
    alike = near_dedup.overlaps(keys, counts, np.arange(len(texts)), np.arange(len(texts))) >= near_dedup.SIMILARITY
    pairs = [(texts[i], texts[j]) for i, j in zip(*np.nonzero(np.triu(alike, 1)))]
    assert pairs and all(found[s] == found[t] for s, t in pairs)


def test_a_bucket_of_thousands_of_texts(spark):
    """A hub and thousands of copies of it, many of them too far from it but near each other: classes equal those of all pairs."""
    import pyarrow as pa

    rng = random.Random(3)
    hub = [f"w{rng.randrange(5000)}" for _ in range(120)]

    def copy(changes, of):
        words = list(of)
        for _ in range(changes):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return words

    # a change in a word takes five shingles of 116: two leave 0.84, four about 0.7
    far = [copy(4, hub) for _ in range(200)]
    texts = [" ".join(hub), *(" ".join(copy(2, hub)) for _ in range(2500)), *(" ".join(f) for f in far), *(" ".join(copy(1, f)) for f in far[:100])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    keys, counts = near_dedup.shingles(*near_dedup.buffer_of(pa.array(texts, pa.string())))
    alike = near_dedup.overlaps(keys, counts, np.arange(len(texts)), np.arange(len(texts))) >= near_dedup.SIMILARITY
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(alike, 1))):
        a, b = sorted((top(int(i)), top(int(j))))
        root[b] = a
    assert found == {i: top(i) for i in range(len(texts))}


def test_results_of_the_registered_queries(spark):
    """The queries themselves, over whole tables: one row for each document, with what the operators give."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op3_transport_stream(spark, SF).collect():
        data = transport_stream.padded(texts[r["doc_id"]].encode())
        assert (r["payload_sha256"], r["payload_bytes"], r["tail_crc32"]) == (hashlib.sha256(data).hexdigest(), len(data), zlib.crc32(data[-64:]))
    for r in queries.op4_pii_bootstrap(spark, SF).collect():
        own = brute_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii_bootstrap.KINDS] == [sum(x[0] == i for x in own) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii_bootstrap.digest(own).encode()).hexdigest()
    held(queries.op1_packing(spark, SF).collect(), packing.CAPACITY)
    assert {r["doc_id"]: r["class_id"] for r in queries.op7_near_dedup(spark, SF).collect()}.keys() == texts.keys()
    vectors = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], "f8")) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    best = {}
    for r in queries.op6_va_search(spark, SF).collect():
        best.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, own in best.items():
        expected = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
        assert sorted(own) == [(n, i, -s) for n, (s, i) in enumerate(expected, 1)]
    assert best.keys() == {i for i in vectors if i % 50 == 0}


def test_clashing_names_of_duplicates_and_personal_data(spark):
    rows = spark.createDataFrame([(2, "one two three four five six", *"abcdef"), (1, "one two three four five six", *"abcdef"), (1, "one two three four five six", *"abcdef"), (None, None, *"abcdef")], "doc_id long, text string, __node string, __rep string, __own string, node string, found string, spans string")
    kept = near_dedup.deduplicated(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"] or 0, r["__node"], r["__rep"], r["__own"], r["node"]) for r in kept.collect()) == [(0, *"abcd"), (1, *"abcd")]
    found = near_dedup.classes(rows).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["text_copies"]) for r in found) == [(0, 0, 1), (1, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert pii_bootstrap.digests(rows).count() == 4 and {r["spans"] for r in pii_bootstrap.digests(rows).collect()} == {""}


def packet_of(pid, data, start=True):
    body = (b"\0" if start else b"") + data
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x10]) + body + b"\xff" * (184 - len(body))


def test_malformed_streams_are_faults():
    whole = transport_stream.write(transport_stream.padded(b"some text " * 100))
    clean = transport_stream.read(whole)
    # a map that is too short to have anything, with a right checksum
    for size in range(8, 16):
        section = bytes([2, 0xB0, size + 1]) + bytes([0, 1, 0xC1, 0, 0, 0, 0, 0, 0, 0][: size - 6])
        section += struct.pack(">I", transport_stream.crc32_mpeg(section))
        transport_stream.read(whole + packet_of(clean.map_pid, section))
    # a last elementary packet that claims a time stamp without room for it
    for size in range(0, 8):
        short = b"\0\0\1\xbd\0\0\x84\x80" + bytes([5, 1, 2, 3, 4, 5, 6])[:size]
        fill = 184 - len(short)
        last = bytes([0x47, 0x40 | clean.stream_pid >> 8, clean.stream_pid & 255, 0x30, fill - 1, 0]) + b"\xff" * (fill - 2) + short
        assert transport_stream.read(whole + last).faults > clean.faults
    rnd = random.Random(5)
    for _ in range(400):
        broken = bytearray(whole)
        for _ in range(rnd.choice([1, 5, 50])):
            broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        transport_stream.read(bytes(broken[: rnd.randrange(len(broken))]))
