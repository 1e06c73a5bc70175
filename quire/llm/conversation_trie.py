"""Prefix trie of conversations (operator 12).

A node is a distinct sequence of a conversation's first turns (role and text);
its members are the conversations that begin with it, and the least member's id
and the depth name it.

Method: turns are encoded by a dictionary of distinct turns, so that a
conversation is an array of integers. Buckets of conversations with a common
prefix are partitioned by their next integer, most significant (first) turn
first: one grouping, pre-aggregated, and one join a round for all large buckets
at once, however many members one of them has. A bucket with at most ``LOCAL``
turns left, or with ``FEW`` conversations, goes to a task that finishes it by
multikey quicksort, whose recursion emits the nodes. Subtree sums are carried up
the rounds at the end.

There are as many rounds as the deepest prefix has turns which so many
conversations share that it isn't local. Conversations of more than a few
million turns aren't for this operator: one is an array of 12 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import dropped, kept, remembering

#: Turns, and conversations of whatever length, of a bucket that one task finishes.
LOCAL, FEW = 65_536, 64
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_SCHEMA = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS)


def encoded(conversations: DataFrame) -> DataFrame:
    """``c, ids, chars``: each conversation's turns, in order, as numbers of a dictionary and their texts' code points."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = lambda x: F.unhex(F.md5(x))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest(text).alias("own"), F.char_length(text).alias("chars"))
    turns = turns.withColumn("word", digest(F.concat(digest(F.col("role")), F.col("own"))))
    dictionary = kept(turns.select("word").distinct().withColumn("id", F.monotonically_increasing_id()))
    rows = turns.join(dictionary, "word").groupBy("c").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "own", "id", "chars"))).alias("x"))
    out = kept(rows.select("c", F.col("x.id").alias("ids"), F.col("x.chars").alias("chars")))
    dropped(dictionary)
    return out


def rebuilt(own: DataFrame) -> DataFrame:
    """``c, ids, chars`` with each conversation's first turns replaced by those of the first one of its hundred."""
    h = (F.crc32(F.col("c").cast("string")) % 6).cast("int")
    base = own.where(F.col("c") % 100 == 0).select(F.col("c").alias("base"), F.slice("ids", 1, 5).alias("first_ids"), F.slice("chars", 1, 5).alias("first_chars"))
    rows = own.withColumn("base", F.col("c") - F.col("c") % 100).withColumn("h", h).join(base, "base", "left")
    both = lambda first, x: F.concat(F.slice(F.coalesce(F.col(first), F.array().cast(own.schema[x].dataType)), F.lit(1), F.col("h")), F.slice(x, F.col("h") + 1, F.size(x))).alias(x)
    return rows.select("c", both("first_ids", "ids"), both("first_chars", "chars"))


def sha_of(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def grown(members: list[int], ids: list[list[int]], chars: list[list[int]], top_chars: int) -> list[list]:
    """Nodes of one bucket, parents first: ``[least member, depth below the top, place of the parent, members, children, leaves, saved, ends]``.

    ``members`` ascend; ``ids`` and ``chars`` are what each has left. Multikey
    quicksort: a bucket's members are split by their next id into lesser, equal
    and greater ones; equal ones are a node and go on with the id after it.
    """
    nodes: list[list] = []
    stack = [(list(range(len(members))), 0, -1, top_chars)]
    while stack:
        own, at, parent, size = stack.pop()
        here = len(nodes)
        nodes.append([members[own[0]], at, parent, len(own), 0, 0, (len(own) - 1) * size, [members[k] for k in own if len(ids[k]) == at]])
        parts = [[k for k in own if len(ids[k]) > at]]
        while parts:
            part = parts.pop()
            if not part:
                continue
            pivot = ids[part[len(part) // 2]][at]
            equal = [k for k in part if ids[k][at] == pivot]
            stack.append((equal, at + 1, here, chars[equal[0]][at]))
            if len(equal) < len(part):
                parts += [[k for k in part if ids[k][at] < pivot], [k for k in part if ids[k][at] > pivot]]
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[2] >= 0:
            above = nodes[node[2]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return nodes


def _local(rows: DataFrame) -> DataFrame:
    """All nodes of buckets ``(top, depth, parent, last, c, ids, chars)``; ``is_top`` marks each bucket's own."""
    dealt = rows.select("top", "depth", "parent", "last", "c", "ids", "chars").repartition("top", "depth").sortWithinPartitions("top", "depth", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("conversations")
        key, members, ids, chars = None, [], [], []

        def found():
            top, depth, parent, last = key
            nodes = grown(members, ids, chars, last)
            sides = [[x[0] for x in nodes], [depth + x[1] for x in nodes], [nodes[x[2]][0] if x[2] >= 0 else parent for x in nodes], *([x[k] for x in nodes] for k in (3, 4, 5, 6))]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in sides), pa.array([sha_of(x[7]) for x in nodes]), pa.array([x[2] < 0 for x in nodes])], names=[*COLUMNS, "is_top"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for *own, c, x, y in zip(*(part.column(k).to_pylist() for k in ("top", "depth", "parent", "last", "c", "ids", "chars"))):
                    if key is not None and own[:2] != key[:2]:
                        yield found()
                        members, ids, chars = [], [], []
                    key = own
                    members.append(c)
                    ids.append(x)
                    chars.append(y)
        if key is not None:
            yield found()

    return dealt.mapInArrow(run, f"{_SCHEMA}, is_top boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """``top, depth, ends_sha256`` of ``rows(top, depth, c)``: the ids go through one digest in order, none is held."""
    dealt = rows.repartition("top", "depth").sortWithinPartitions("top", "depth", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("conversations")
        key, digest, out = None, None, []
        for batch in batches:
            for top, depth, c in zip(*(batch.column(k).to_pylist() for k in ("top", "depth", "c"))):
                if key != (top, depth):
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (top, depth), hashlib.sha256(str(c).encode())
                else:
                    digest.update(f",{c}".encode())
            if out:
                yield table(out)
                out = []
        if key is not None:
            yield table([(*key, digest.hexdigest())])

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out])], names=["top", "depth", "ends_sha256"])

    return dealt.mapInArrow(run, "top long, depth int, ends_sha256 string")


def trie(rows: DataFrame, local: int = LOCAL, few: int = FEW) -> DataFrame:
    """All nodes of the trie of ``rows(c, ids, chars)``, one row per conversation: ``COLUMNS``."""
    spark = rows.sparkSession
    root = rows.agg(F.min("c").alias("top"), F.count("*").alias("n")).first()
    if not root["n"]:
        return spark.createDataFrame([], _SCHEMA)
    # large: the buckets of a round; live: their members, with the turns that they have left
    large = spark.range(1).select(F.lit(root["top"]).alias("top"), F.lit(None).cast("long").alias("parent"), F.lit(root["n"]).cast("long").alias("n"), F.lit(0).cast("long").alias("last"))
    live = rows.select("c", F.lit(root["top"]).alias("top"), "ids", "chars")
    levels, finished, ended, groups_of, temporary, depth = [], [], [], [], [], 0
    while True:
        live = live.withColumn("next", F.get("ids", F.lit(0)))
        groups = kept(live.groupBy("top", "next").agg(F.min("c").alias("child"), F.count("*").alias("n"), F.max(F.get("chars", F.lit(0))).cast("long").alias("last"), F.sum(F.size("ids")).alias("turns")))
        levels.append(large)
        groups_of.append(groups)
        ended.append(live.where("next IS NULL").select("top", F.lit(depth).alias("depth"), "c"))
        many = (F.col("turns") > local) & (F.col("n") > few)
        children = groups.where("next IS NOT NULL").select("top", "next", "child", "last", many.alias("large"))
        members = live.join(children, ["top", "next"]).select("c", F.col("child").alias("top"), F.col("top").alias("parent"), "last", "large", *[F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))).alias(x) for x in ("ids", "chars")])
        members = kept(members)
        temporary += [members]
        finished.append(members.where("NOT large").withColumn("depth", F.lit(depth + 1)))
        large = groups.where(F.col("next").isNotNull() & many).select(F.col("child").alias("top"), F.col("top").alias("parent"), "n", "last")
        if large.isEmpty():
            break
        live, depth = members.where("large").select("c", "top", "ids", "chars"), depth + 1

    union = lambda parts: reduce(DataFrame.unionByName, parts)
    small, ends = kept(_local(union(finished))), kept(_ends(union(ended)))
    out, below = [], None
    for level in range(depth, -1, -1):
        tops = small.where(F.col("is_top") & (F.col("depth") == level + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        tops = tops if below is None else tops.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = tops.groupBy(F.col("parent_conv_id").alias("top")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nodes = levels[level].join(sums, "top", "left").join(ends.where(F.col("depth") == level).drop("depth"), "top", "left")
        below = kept(
            nodes.select(
                F.col("top").alias("conv_id"), F.lit(level).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
                ((F.col("n") - 1) * F.col("last") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha_of([]))).alias("ends_sha256"),
            )
        )
        out.append(below)
    dropped(ends, *temporary, *groups_of)
    return union([small.select(*COLUMNS), *(x.select(*COLUMNS) for x in out)])


def prefix_trie(conversations: DataFrame, rebuild: bool = True, local: int = LOCAL, few: int = FEW) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    With ``rebuild``, conversations first get the first turns of the first one
    of their hundred, as many as crc32 of their id modulo 6. Turns are taken in
    the order of ``turn`` (nulls first), then role and the text's MD5; a null
    role or text is empty. Rows without a conv_id take no part. Repeated rows
    are turns like any other. An empty table has no nodes; other columns are
    ignored, whatever their names.
    """
    own = encoded(conversations)
    rows = kept(rebuilt(own)) if rebuild else own
    found = trie(rows, local, few)
    dropped(own, rows)
    return found
