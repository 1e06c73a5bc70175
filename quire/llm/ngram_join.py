"""Similarity join of five-word shingle sets with count-vector R-trees (operator 13).

A text's words are what stands between ASCII white space, its letters A to Z
lower case; its set has its distinct five-word shingles (a shorter text is one
shingle of all its words, one without a word has none). Two texts link when
100 |A and B| >= 80 |A or B|, which is 9 |A and B| >= 4 (|A| + |B|). The join is
exact: no link between different sets is lost.

Points: a set's shingles are hashed into 65,536 groups; the counts of the groups
are its point, kept as the ascending numbers of its shingles' groups. Two sets
share at most the sum over the groups of the lesser count, and a set shares at
most the sum of minima with the upper corner of a box of points with any point
within, so an R-tree of points is descended only where that bound and the sizes
allow a link. Trees take fewer dimensions, by summing neighbouring groups: a
first one has a group for eight to sixteen shingles and tells which points can
have a partner at all; of these a second one has four to eight groups for each
shingle. A pair that reaches its leaves is bounded by all groups, and if that
allows a link, it is verified on the sets themselves.

Spark deals the points out first, since boxes of unrelated texts overlap in so
many dimensions that a tree of all of them prunes nothing above its leaves. Two
linked sets have one of their n - ceil(0.8 n) + 1 first shingles in common, in
any order of all shingles; the order is from rare to frequent by a sketch of a
fixed size that counts all shingles of all texts, so that a passage in very
many texts deals out none of them. Sets that share such a shingle meet in a
bucket; buckets with the same members are one. Buckets of all sizes then are
compared as in ``near_dedup``: the members with a leader, then what is left in
blocks of bounded size. Each block is an R-tree, and a block's rows are points:
texts are read for the pairs that no bound excludes, and for these only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.bpe_trie import slices
from quire.llm.near_dedup import buffer_of, by_block, linked, mix, part_of, parts_of
from quire.llm.tables import dropped, kept, remembering, text_or_empty

SHINGLE = 5
#: Two sets link when PART * |both| >= WHOLE * (|A| + |B|).
PART, WHOLE = 9, 4
#: Dimensions of boxes (powers of two) of the first and the second tree: the least, the most, shingles for each; and points in a leaf.
FIRST, SECOND, LEAF = (64, 4096, 16), (256, 4096, 1 / 4), 4
#: Numbers in one step of a tree's bound.
CELLS = 1 << 20
#: Texts that may be wanted are told by this many hashed ids before they are shuffled, whatever their number.
HASHED_IDS = 1 << 20
#: The sketch: cells that count shingles, whatever the size of the input, and cells in one row of its table.
CELL_BITS, BLOCK_BITS = 20, 12
#: A shingle is frequent if its cell counts so much, or so many times the mean.
OFTEN, TIMES_MEAN = 10_000, 4
SLICE_BYTES = 1 << 20
_GOLDEN, _ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, "u8")
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashes(data, offsets, k: int = SHINGLE):
    """64-bit hashes of all shingles of the texts in one byte buffer, in order, and how many each text has (repeats included)."""
    import numpy as np

    n, none = len(offsets) - 1, np.empty(0, "u8")
    if not len(data) or n < 1:
        return none, np.zeros(max(n, 0), "i8")
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    if not len(starts):
        return none, np.zeros(n, "i8")
    letters = np.arange(256)
    letters[65:91] += 32
    table = mix((letters + 1).astype("u8") * np.uint64(_GOLDEN))
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(table[data] * _powers(_ODD, len(data)), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts])
    text = np.searchsorted(offsets, starts, side="right") - 1
    size = np.bincount(text, minlength=n)
    place = np.arange(len(words)) - (np.cumsum(size) - size)[text]
    left = size[text] - place
    padded, out = np.concatenate([words, np.zeros(k, "u8")]), np.zeros(len(words), "u8")
    for j in range(k):
        out = out * np.uint64(_ODD) + np.where(left > j, padded[j : j + len(words)], np.uint64(0))
    whole = (left >= k) | (place == 0)
    return mix(out[whole]), np.bincount(text[whole], minlength=n)


def sets_of(column: pa.Array) -> list:
    """Each text's set as ascending hashes."""
    import numpy as np

    found, sizes = hashes(*buffer_of(column))
    return [np.unique(part) for part in np.split(found, np.cumsum(sizes)[:-1])] if len(sizes) else []


def frequencies(docs: DataFrame):
    """The sketch: how often the shingles of each cell occur in all texts. Its size is fixed, so the driver may hold it."""
    import numpy as np

    cells, block = 1 << CELL_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("ngrams")
        own = np.zeros(cells, "i8")
        for part in slices(batches, "text", SLICE_BYTES):
            found, _ = hashes(*buffer_of(part.column("text")))
            own += np.bincount((found >> np.uint64(64 - CELL_BITS)).astype("i8"), minlength=cells)
        yield from tables(own)

    def tables(own):
        # only cells that count something: a small task's table is small
        full = np.flatnonzero(own)
        edges = np.searchsorted(full, np.arange(0, cells + 1, block))
        rows = [k for k in range(cells // block) if edges[k] < edges[k + 1]]
        if rows:
            places, counts = (full % block).astype("<u2"), own[full].astype("<u4" if own.max() < 1 << 32 else "<i8")
            parts = lambda x: pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), parts(places), parts(counts)], names=["block", "places", "counts"])

    def added(own, row) -> None:
        at, places, counts = row
        cell = np.frombuffer(places, "<u2").astype("i8")
        own[at * block + cell] += np.frombuffer(counts, "<u4" if len(counts) == 4 * len(cell) else "<i8").astype("i8")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, "i8")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts"))):
                added(own, row)
        yield from tables(own)

    schema = "block int, places binary, counts binary"
    parts = docs.select(text_or_empty().alias("text")).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    sketch = np.zeros(cells, "i8")
    for row in parts.collect():
        added(sketch, (row["block"], row["places"], row["counts"]))
    return sketch


def ranks(sketch):
    """A byte for each cell, from rare to frequent in quarters of a doubling, and the least rank of frequent shingles."""
    import numpy as np

    rank = lambda n: np.minimum(np.log2(np.maximum(n, 1)) * 4, 255).astype("u1")
    return rank(sketch), int(rank(np.array([max(OFTEN, TIMES_MEAN * sketch.mean())]))[0])


def point_of(own) -> bytes:
    """A set's point: the steps between its shingles' groups, which are their first 16 bits; low bytes, then high bytes."""
    import numpy as np

    steps = np.diff((own >> np.uint64(48)).astype("<u2"), prepend=np.uint16(0)).astype("<u2")
    return (steps & 255).astype("u1").tobytes() + (steps >> 8).astype("u1").tobytes()


def groups_of(point: bytes):
    """The ascending groups of a point."""
    import numpy as np

    planes = np.frombuffer(point, "u1").reshape(2, -1)
    return np.cumsum(planes[0].astype("i8") + (planes[1].astype("i8") << 8))


def dimensions(n, kind: tuple):
    """How many dimensions sets of so many shingles have in a tree."""
    import numpy as np

    least, most, each = kind
    return np.clip(1 << np.ceil(np.log2(np.maximum(np.asarray(n) / each, 1))).astype("i8"), least, most)


def coarse_of(own) -> bytes:
    """A set's counts in the first tree's dimensions: low bytes, then high bytes."""
    import numpy as np

    size = int(dimensions(len(own), FIRST))
    counts = np.minimum(np.bincount((own >> np.uint64(65 - size.bit_length())).astype("i8"), minlength=size), 65535)
    return (counts & 255).astype("u1").tobytes() + (counts >> 8).astype("u1").tobytes()


def numbered(groups):
    """Groups made distinct by counting those that repeat, so that common elements are summed minima."""
    import numpy as np

    first = np.flatnonzero(np.diff(groups, prepend=-1))
    nth = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
    return groups + (nth << 16)


def points(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n, bytes, coarse, point, rare, often``: each text's set as a digest, a size and a point in two resolutions, and the shingles it is dealt out by."""
    import numpy as np

    ranked, often = ranks(frequencies(docs))
    shared = docs.sparkSession.sparkContext.broadcast(ranked.tobytes())
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def arrays(lists: list) -> pa.Array:
        flat = np.concatenate(lists) if lists else np.empty(0, "u8")
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype("i4")), pa.array(flat.view("i8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        remembering("ngrams")
        rank = np.frombuffer(shared.value, "u1")
        for part in slices(batches, "text", SLICE_BYTES):
            digests, sizes, coarse, fine, rares, oftens = [], [], [], [], [], []
            for own in sets_of(part.column("text")):
                ranks_ = rank[own >> np.uint64(64 - CELL_BITS)]
                # own ascends, so that equal ranks stand in the order of hashes
                first = np.argsort(ranks_, kind="stable")[: len(own) - (len(own) * 4 + 4) // 5 + 1]
                common = ranks_[first] >= often
                digests.append(blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                coarse.append(coarse_of(own))
                fine.append(point_of(own))
                rares.append(own[first[~common]])
                oftens.append(own[first[common]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pc.binary_length(part.column("text")).cast(pa.int64()), pa.array(coarse, pa.binary()), pa.array(fine, pa.binary()), arrays(rares), arrays(oftens)], names=["doc_id", "digest", "n", "bytes", "coarse", "point", "rare", "often"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, n long, bytes long, coarse binary, point binary, rare array<long>, often array<long>")


class Tree:
    """An R-tree of count vectors, packed by halving at the median of the widest dimension."""

    def __init__(self, vectors, sizes):
        import numpy as np

        self.vectors, self.sizes = vectors, sizes
        groups, leaves = [np.arange(len(sizes))], []
        while groups:
            own = groups.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            both = np.column_stack([sizes[own], vectors[own]])
            widest = int(np.argmax(both.max(axis=0) - both.min(axis=0)))
            order = own[np.argsort(both[:, widest], kind="stable")]
            groups += [order[: len(own) // 2], order[len(own) // 2 :]]
        # levels from the leaves to the root: children, upper corners, sizes from and to
        self.levels = []
        children = leaves
        corner, low, high = vectors, sizes, sizes
        while True:
            corner, low, high = (np.array([f(x[own], axis=0) for own in children]) for f, x in ((np.max, corner), (np.min, low), (np.max, high)))
            self.levels.append((children, corner, low, high))
            if len(children) == 1:
                break
            children = np.split(np.arange(len(children)), range(LEAF, len(children), LEAF))

    def search(self, vectors, sizes):
        """Pairs (query, point) that may link, as two arrays: what is left when the bound has been taken on every level."""
        import numpy as np

        query, node = np.arange(len(sizes)), np.zeros(len(sizes), "i8")
        for children, corner, low, high in reversed(self.levels):
            query, node = self._left(vectors, sizes, query, node, corner, low, high)
            many = np.array([len(x) for x in children])[node] if len(node) else np.empty(0, "i8")
            below = [children[i] for i in node]
            query, node = np.repeat(query, many), np.concatenate(below) if below else node
        return self._left(vectors, sizes, query, node, self.vectors, self.sizes, self.sizes)

    @staticmethod
    def _left(vectors, sizes, query, node, corner, low, high):
        """The pairs whose sizes and whose summed minima allow a link."""
        import numpy as np

        fit = (5 * high[node] >= 4 * sizes[query]) & (5 * sizes[query] >= 4 * low[node])
        query, node = query[fit], node[fit]
        keep = np.zeros(len(query), bool)
        step = max(1, CELLS // vectors.shape[1])
        for at in range(0, len(query), step):
            q, p = query[at : at + step], node[at : at + step]
            most = np.minimum(vectors[q], corner[p]).sum(axis=1, dtype="i8")
            keep[at : at + step] = PART * most >= WHOLE * (sizes[q] + low[p])
        return query[keep], node[keep]


def searched(sizes, levels, vectors, left, right) -> Iterator[tuple]:
    """Arrays of left and of right numbers that trees don't exclude, one pair of arrays for each number of dimensions.

    ``vectors(k, level)`` gives a point in so many dimensions. Linked sets
    differ by no more than one doubling; pairs of the larger level have their own turn.
    """
    import numpy as np

    for level in np.unique(levels):
        sides = [own[(levels[own] == level) | (levels[own] == 2 * level)] for own in (left, right)]
        if not len(sides[0]) or not len(sides[1]):
            continue
        both = [np.array([vectors(k, int(level)) for k in own], "i4") for own in sides]
        query, point = Tree(both[0], sizes[sides[0]]).search(both[1], sizes[sides[1]])
        a, b = sides[0][point], sides[1][query]
        lower = (levels[a] == level) | (levels[b] == level)
        yield a[lower], b[lower]


def _sides(part: pa.RecordBatch):
    import numpy as np

    roots = np.unique([repr(x) for x in part.column("root").to_pylist()], return_inverse=True)[1]
    return *(np.flatnonzero(part.column(c).to_numpy(False)) for c in ("is_left", "is_right")), roots


_ROWS = ("block", "i", "j", "node", "root", "is_left", "is_right")


def partnered(rows: DataFrame) -> DataFrame:
    """The rows, without their coarse points (column ``text``), that the first tree of their block leaves a partner of another root."""

    def links(part: pa.RecordBatch) -> pa.RecordBatch | None:
        import numpy as np

        left, right, roots = _sides(part)
        if not len(left) or not len(right):
            return None
        counts = []
        for point in part.column("text").to_pylist():
            planes = np.frombuffer(point, "u1").reshape(2, -1)
            counts.append(planes[0].astype("i4") + (planes[1].astype("i4") << 8))
        keep = np.zeros(part.num_rows, bool)
        for a, b in searched(np.array([int(c.sum()) for c in counts]), np.array([len(c) for c in counts]), lambda k, level: counts[k].reshape(level, -1).sum(axis=1), left, right):
            differ = roots[a] != roots[b]
            keep[a[differ]] = keep[b[differ]] = True
        return part.filter(pa.array(keep)).select(list(_ROWS)) if keep.any() else None

    return by_block(rows.select(*_ROWS, "text"), links, "ngrams", ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _ROWS))


def near(rows: DataFrame) -> DataFrame:
    """``a, b``: pairs of the left and the right points (column ``text``) of each block, of different roots, that no bound excludes."""

    def links(part: pa.RecordBatch) -> pa.RecordBatch | None:
        import numpy as np

        left, right, roots = _sides(part)
        if not len(left) or not len(right):
            return None
        groups = [groups_of(p) for p in part.column("text").to_pylist()]
        sizes = np.array([len(g) for g in groups])
        full: dict[int, object] = {}
        found: list[tuple[int, int]] = []
        for a, b in searched(sizes, dimensions(sizes, SECOND), lambda k, level: np.bincount(groups[k] >> (17 - level.bit_length()), minlength=level), left, right):
            differ = roots[a] != roots[b]
            for i, j in zip(a[differ].tolist(), b[differ].tolist()):
                for k in (i, j):
                    if k not in full:
                        full[k] = numbered(groups[k])
                if alike(full[i], full[j]):
                    found.append((i, j))
        nodes = part.column("node")
        return pa.RecordBatch.from_arrays([nodes.take(pa.array([x[k] for x in found], pa.int64())) for k in (0, 1)], names=["a", "b"]) if found else None

    return by_block(rows, links, "ngrams")


def alike(a, b) -> bool:
    """Whether two sets of ascending hashes link."""
    import numpy as np

    return PART * len(np.intersect1d(a, b, assume_unique=True)) >= WHOLE * (len(a) + len(b))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose sets link, by their ``texts(node, bytes, text)``; a task holds one text with a bounded number of others."""
    sums = pairs.join(texts.select("node", "bytes"), F.col("b") == F.col("node")).groupBy("a").agg(parts_of(F.count("*"), F.sum("bytes")).alias("parts"))
    others = pairs.join(sums, "a").select(F.col("a").alias("block"), F.lit(0).alias("i"), part_of(F.col("b"), F.col("parts")).alias("j"), F.col("b").alias("node"), F.lit(False).alias("is_left"))
    heads = sums.select(F.col("a").alias("block"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.col("a").alias("node"), F.lit(True).alias("is_left"))
    rows = others.unionByName(heads).join(texts.select("node", "text"), "node").select("block", "i", "j", "node", "is_left", "text")

    def links(part: pa.RecordBatch) -> pa.RecordBatch | None:
        import numpy as np

        sets, is_left, nodes = sets_of(part.column("text")), part.column("is_left").to_numpy(False), part.column("node")
        head = np.flatnonzero(is_left)
        found = [int(k) for k in np.flatnonzero(~is_left) if len(head) and alike(sets[head[0]], sets[k])]
        return pa.RecordBatch.from_arrays([nodes.take(pa.array([int(head[0])] * len(found), pa.int64())), nodes.take(pa.array(found, pa.int64()))], names=["a", "b"]) if found else None

    return by_block(rows, links, "ngrams")


def _together(rows: DataFrame) -> DataFrame:
    """``token, own`` of buckets of several members, each known by a hash of its members: those with the same ones are one.

    One shuffle by token serves all of it. A hash that two buckets share makes one larger bucket of them, which loses nothing.
    """
    one = Window.partitionBy("token")
    rows = rows.repartition("token").select("token", "own", F.min("own").over(one).alias("least"), F.max("own").over(one).alias("most")).where("least <> most").select("token", "own").distinct()
    members = F.xxhash64(F.count("*").over(one), F.bit_xor("own").over(one), F.bit_xor(F.xxhash64("own", F.lit(1))).over(one))
    return rows.select(members.alias("token"), "own").distinct()


def _shared(found: DataFrame) -> DataFrame:
    """``token, own``: buckets of sets (as hashes of their digests) that are dealt out by the same shingles."""
    own = F.xxhash64("digest")
    # a rare shingle has a bounded share of all rows
    rare = _together(found.select(F.explode("rare").alias("token"), own.alias("own")))
    often = found.where(F.size("often") > 0).select(F.explode("often").alias("token"), own.alias("own"))
    if often.isEmpty():
        return rare
    # of frequent ones any share of the sets may be dealt out: pre-aggregated, then joins that Spark can split
    several = often.groupBy("token").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("token")
    often = often.join(several, "token").distinct()
    members = often.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("own").alias("x"), F.bit_xor(F.xxhash64("own", F.lit(1))).alias("y"))
    often = often.join(members, "token").select(F.xxhash64("n", "x", "y").alias("token"), "own").distinct()
    return rare.unionByName(often).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the least doc_id that links reach, the own one
    included. A null text counts as empty; texts without a word have no
    shingles and are linked with nothing, not even with each other. Equal sets
    are linked, so repeated rows are. Rows with a null doc_id are rows like
    any other; their component_id is null unless a linked row has an id. An
    empty table gives no rows; further columns are ignored, whatever their
    names.
    """
    found = kept(points(docs))
    full = found.where(F.col("n") > 0)
    heads = kept(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bytes").alias("bytes"), F.first("n").alias("n")))
    shared = kept(_shared(full))
    # sets that link differ in size by a quarter at most: a bucket holds two neighbouring classes of a little more
    sized = shared.join(heads.select(F.xxhash64("digest").alias("own"), F.floor(F.log(F.col("n")) / math.log(1.26)).cast("int").alias("class")), "own")
    sized = sized.select("own", F.explode(F.array("class", F.col("class") - 1)).alias("class"), "token").select("own", F.xxhash64("token", "class").alias("token"))
    keys = _together(sized).groupBy("own").agg(F.collect_list("token").alias("keys"))
    nodes = kept(heads.withColumn("own", F.xxhash64("digest")).join(keys, "own").select(F.col("digest").alias("node"), "rep", "bytes", "keys"))
    temporary = []

    def only(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
        """``rows`` whose key is in ``wanted``. No more than HASHED_IDS numbers, which a task can hold, tell most of the other rows before they are shuffled."""
        hashed = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(HASHED_IDS)).alias("hashed")
        some = F.broadcast(wanted.select(hashed(name)).distinct())
        rows = rows.withColumn("hashed", hashed(key)).join(some, "hashed", "left_semi").drop("hashed")
        return rows.join(wanted.select(F.col(name).alias("__wanted")), F.col(key).eqNullSafe(F.col("__wanted")), "left_semi")

    def texts_of(wanted: DataFrame) -> DataFrame:
        # a set's text is that of any row with its digest: rows of one id may differ, so the digest decides
        ids = kept(nodes.select("node", "rep", "bytes").join(wanted, "node", "left_semi"))
        temporary.append(ids)
        rows = only(docs.select("doc_id", text_or_empty().alias("text")), "doc_id", ids, "rep")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from hashlib import blake2b

            remembering("ngrams")
            for part in slices(batches, "text", SLICE_BYTES):
                digests = [blake2b(own.tobytes(), digest_size=16).digest() for own in sets_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column("text")], names=["node", "text"])

        own = rows.select("text").mapInArrow(run, "node binary, text string")
        return own.join(ids.select("node", "bytes"), "node").dropDuplicates(["node"])

    def compared(rows: DataFrame, least: float) -> DataFrame:
        left = kept(partnered(rows))
        wanted = kept(left.select("node").distinct())
        fine = kept(only(found.select(F.col("digest").alias("node"), F.col("point").alias("text")), "node", wanted, "node").dropDuplicates(["node"]))
        pairs = kept(near(left.join(fine, "node").select(*_ROWS, "text")).distinct())
        texts = kept(texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()))
        temporary.extend([left, wanted, fine, pairs, texts])
        return verified(pairs, texts)

    def points_of(wanted: DataFrame) -> DataFrame:
        return found.select(F.col("digest").alias("node"), F.col("coarse").alias("text")).join(wanted, "node", "left_semi").dropDuplicates(["node"])

    roots = linked(nodes.select("node", "bytes", "keys"), points_of, verify=compared)
    dropped(*temporary)
    named = kept(heads.select("digest", "rep").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", F.coalesce("root", "digest").alias("root")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = kept(named.join(least, "root").select("digest", "component_id"))
    dropped(heads, shared, nodes, roots, named)
    out = found.select("doc_id", "n", "digest").join(known, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
