"""Repair and prefix trie of conversations, and the similarity join, against brute force, SQL and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quire.llm import conversation_repair, conversation_trie, ngram_join, queries, va_search

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, copy string, present string, ids string, `Digest` int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def repaired_by_brute_force(rows):
    convs=defaultdict(list)
    for c, t, r, x in rows:
        r=' ' if r is None else r; x=' ' if x is None else x
        convs[c]
        k=zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode())%20
        if k==0: continue
        if k==1: x=''
        if k==2: x=re.sub('[.!?]','',x)
        if k==4: r='user'
        convs[c]+= [(t,r,x)]*(2 if k==3 else 1)
    out={}
    for c,v in convs.items():
        v.sort(key=lambda q:(q[0] is not None,q[0] or 0,q[1].encode(),hashlib.md5(q[2].encode()).hexdigest()))
        seen=set(); f=[]
        for t,r,x in v:
            ch=WORD.findall(x)
            f.append('b' if not ch else 'd' if (r,x) in seen else 't' if ch[-1] not in '.!?' else '')
            seen.add((r,x))
        ts=[t for t,_,_ in v if t is not None]
        gaps=max(ts)-min(ts)+1-len(set(ts)) if ts else 0
        ill=sum((a[1][:1]+b[1][:1]) not in('su','ua','au') for a,b in zip(v,v[1:]))
        nxt={'':{'s':'s','u':'u'},'s':{'u':'u'},'u':{'a':'a'},'a':{'u':'u'}}
        cur={'':(0,'',())}
        def ins(cur):
            for _ in range(3):
                new=dict(cur)
                for s,(k,a,o) in cur.items():
                    for l,w in (('u','user'),('a','assistant')):
                        if l in nxt[s]:
                            q=(k+2,a+'I',o+((w,''),))
                            if l not in new or q[:2]<new[l][:2]: new[l]=q
                cur=new
            return cur
        for (t,r,x),ff in zip(v,f):
            new={}
            def put(s,q):
                if s not in new or q[:2]<new[s][:2]: new[s]=q
            for s,(k,a,o) in ins(cur).items():
                put(s,(k+3,a+'D',o))
                if ff in('b','d'): continue
                e=ff=='t'
                if r[:1] and r[:1] in nxt[s]: put(nxt[s][r[:1]],(k+e,a+'K',o+((r,x),)))
                for l,w in (('u','user'),('a','assistant')):
                    if l in nxt[s]: put(l,(k+2+e,a+'R',o+((w,x),)))
            cur=new
        cur=ins(cur)
        k,a,o=min(cur[s] for s in ('','a') if s in cur)
        out[c]=(gaps,f.count('b'),f.count('d'),f.count('t'),ill,k,a,hashlib.sha256('\n'.join(f'{r}:{x}' for r,x in o).encode()).hexdigest())
    return out


def trie_by_brute_force(rows):
    conv=defaultdict(list)
    for c,t,r,x in rows:
        if c is not None: conv[c].append((t,r or '',x or ''))
    for v in conv.values(): v.sort(key=lambda q:(q[0] is not None,q[0] or 0,q[1].encode(),hashlib.md5(q[2].encode()).digest()))
    new={}
    for c,v in conv.items():
        h=zlib.crc32(str(c).encode())%6
        b=c-int(math.fmod(c,100))
        new[c]=tuple((r,x) for _,r,x in conv.get(b,[])[:h]+v[h:])
    mem=defaultdict(list)
    for c,s in new.items():
        for d in range(len(s)+1): mem[s[:d]].append(c)
    kids=defaultdict(list)
    for k in mem:
        if k: kids[k[:-1]].append(k)
    leaves,saved={},{}
    for k in sorted(mem,key=len,reverse=True):
        leaves[k]=sum(leaves[q] for q in kids[k]) or 1
        saved[k]=sum(saved[q] for q in kids[k])+(len(mem[k])-1)*(len(k[-1][1]) if k else 0)
    return {(min(m),len(k)):(min(mem[k[:-1]]) if k else None,len(m),len(kids[k]),leaves[k],saved[k],hashlib.sha256(','.join(map(str,sorted(c for c in m if len(new[c])==len(k)))).encode()).hexdigest()) for k,m in mem.items()}


def odd_conversations():
    rnd = random.Random(3)
    rows = [(rnd.choice([None, -150, -7, 0, 1, 2, 3, 100, 105, 207]), rnd.choice([None, *range(9)]), rnd.choice([None, "", "user", "assistant", "system", "tool"]), rnd.choice([None, "", " ", "a.", "b", "c?\n", "é ", "e!"])) for _ in range(250)]
    rows += [(7, i, ["user", "assistant"][i % 2], f"t{i}" + ". "[i % 3 == 0]) for i in range(300)]
    rows += [(1000 + k, i, "u", f"x{i}") for k in range(30) for i in range(5 + k % 3)]
    return rows + [(8, 1, "user", "long " * 50_000 + "."), (8, 2, "assistant", "y" * 100_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "z", "z", "z", 1) for r in odd_conversations()], TURNS)


@pytest.mark.parametrize("batch,segment", [(65_536, 256), (50, 7)])
def test_repair_against_all_edits(spark, odd, monkeypatch, batch, segment):
    monkeypatch.setattr(conversation_repair, "BATCH", batch)
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    want = repaired_by_brute_force(odd_conversations())
    assert {r[0]: tuple(r)[1:] for r in conversation_repair.digests(odd).collect()} == want


def test_repaired_turns_follow_the_grammar(spark, odd):
    found = defaultdict(list)
    for r in conversation_repair.repaired(odd).collect():
        found[r["conv_id"]].append((r["place"], r["role"][:1], r["text"], r["edit"]))
    for rows in found.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[1] for r in rows))
        assert all(text == "" for _, _, text, edit in rows if edit == "I")


def test_moves_are_cheapest_in_small_conversations():
    # every way to get over two turns, by trying all sequences of edits
    moves = conversation_repair.moves()
    assert all(edits.count("I") <= 2 and edits[-1] in "KRD" for *_, edits in moves)
    assert {m[4][-1] for m in moves if m[0] // 4 in (conversation_repair.BLANK, conversation_repair.DUPLICATE)} == {"D"}


def test_conversation_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        got = sorted(map(tuple, df.collect()), key=repr)
        result = con.execute(sql)
        order = [[d[0] for d in result.description].index(c) for c in df.columns]
        assert got == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr), name


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_repair.digests(none).collect() == [] and conversation_repair.repaired(none).collect() == []
    assert conversation_trie.prefix_trie(none).collect() == []
    # one of whose turns the damage drops all
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = conversation_repair.digests(spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("local,few", [(65_536, 64), (20, 2)])
def test_trie_against_all_prefixes(spark, odd, local, few):
    want = trie_by_brute_force(odd_conversations())
    assert {(r[0], r[1]): tuple(r)[2:] for r in conversation_trie.prefix_trie(odd, local=local, few=few).collect()} == want


def set_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def joined_by_brute_force(rows):
    """(size, least id of the component) of each row, by all pairs."""
    sets, parent = [set_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def texts_of(seed):
    """Groups of near copies, chains of them, texts with a passage in common, and odd ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéÉXYZ") for _ in range(3))
    passage, out = [word() for _ in range(60)], []
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([3, 5, 8, 30, 120, 400]))]
        for _ in range(rnd.choice([1, 4, 12])):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 2, 5])):
                own[rnd.randrange(len(own))] = word()
            out.append(" ".join(own))
            if rnd.random() < 0.5:
                base = own
    out += [" ".join([word() for _ in range(40)] + passage) for _ in range(15)]
    return out + [out[0].upper(), out[0].replace(" ", "\t\n"), "", None, " \n", "one", "ONE", "É", "é", "a b c d e", "a b c d e f", "w " * 30_000]


@pytest.mark.parametrize("seed", range(2))
def test_join_against_all_pairs(spark, seed):
    rows = [(i, t) for i, t in enumerate(texts_of(seed))] + [(3, "another text of the same id, which is not like it"), (None, "no id"), (None, "without any id here"), (900, "without any id here")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, node string, n int")
    assert Counter(map(tuple, ngram_join.classes(docs).collect())) == Counter(joined_by_brute_force(rows))


def test_join_with_frequent_shingles(spark, monkeypatch):
    # all shingles count as frequent, so that the other way to deal them out is taken
    monkeypatch.setattr(ngram_join, "OFTEN", 1)
    monkeypatch.setattr(ngram_join, "TIMES_MEAN", 0)
    rows = list(enumerate(texts_of(5)))
    assert sorted(map(tuple, ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(joined_by_brute_force(rows))


def test_join_of_nothing(spark):
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_trees_and_points_lose_no_pair(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 1 << 63, 3000, dtype="u8")
    sets = [np.unique(np.concatenate([base[a : a + n], rnd.integers(0, 1 << 63, n // 8, dtype="u8")])) for a, n in zip(rnd.integers(0, 400, 60), rnd.integers(5, 600, 60))]
    all_ = np.arange(len(sets))
    links = {(i, j) for i in all_ for j in all_ if ngram_join.alike(sets[i], sets[j])}
    groups = [ngram_join.groups_of(ngram_join.point_of(s)) for s in sets]
    assert all((g == (s >> np.uint64(48))).all() for g, s in zip(groups, sets))
    assert all(ngram_join.alike(ngram_join.numbered(groups[i]), ngram_join.numbered(groups[j])) for i, j in links)
    sizes = np.array([len(s) for s in sets])
    for kind in (ngram_join.FIRST, ngram_join.SECOND):
        found = set()
        for a, b in ngram_join.searched(sizes, ngram_join.dimensions(sizes, kind), lambda k, level: np.bincount(groups[k] >> (17 - level.bit_length()), minlength=level), all_, all_):
            found |= set(zip(a.tolist(), b.tolist()))
        assert links <= found and len(found) < len(sets) ** 2
    planes = [np.frombuffer(ngram_join.coarse_of(s), "u1").reshape(2, -1).astype("i8") for s in sets]
    assert [int((p[0] + (p[1] << 8)).sum()) for p in planes] == sizes.tolist()


def test_shingles_of_buffers():
    texts = ["a b c d e f", "A  b\tC d E f", "", "x", " ", "É é"]
    sets = ngram_join.sets_of(pa.array(texts, pa.string()))
    assert [len(s) for s in sets] == [len(set_of(t)) for t in texts] and (sets[0] == sets[1]).all()


def test_search_with_large_components(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) * 2.0**19 for _ in range(8)], "z") for i in range(200)]
    found = defaultdict(list)
    from pyspark.sql import functions as F

    for r in va_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"), F.col("vec_id") % 50 == 0).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    for q in range(0, 200, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
