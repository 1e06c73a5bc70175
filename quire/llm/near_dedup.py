"""Near-duplicate detection with BagMinHash signatures (operator 7).

A document is the multiset of its five-word shingles (a shorter one is a single
shingle of all its words; words are what stands between ASCII white space, lower
case). Similarity is the weighted Jaccard coefficient, the sum of the lesser
counts over the sum of the greater.

Signatures: every shingle has independent Poisson processes over its weight
axis. The axis is cut into dyadic blocks [0,1), [1,2), [2,4), [4,8) and so on; a
block's points arrive in order of time at a rate that grows with its width, and
each has a place within the block and a component of the signature. A point
counts if its place is below the shingle's count, so only the last block has
points that don't, and a component's value is its first counting point's time.
Two documents agree in a component with the probability of their weighted
Jaccard coefficient. Points beyond the time by which all components are filled
are never generated.

Then: equal texts are one node; nodes that agree in all values of a band share
a bucket. In two rounds every pair of a bucket is compared, exactly and on the
whole texts, or known to be linked already:

1. each bucket's members with its leader, the member with the most bucket mates
   (mostly the text that the others were copied from); verified links give
   components;
2. in each bucket, the members outside its largest component with all members
   of other components.

Both rounds deal the texts out in blocks of bounded size, each of which is one
product of shingle matrices; no pair is a row before it is a verified link, and
buckets of all sizes are handled alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe_trie import slices
from quire.llm.tables import dropped, kept, remembering, text_or_empty, unused

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** 7) ** 32 = 0.9995.
BANDS, ROWS = 32, 7
#: Texts, and their bytes, on one side of a block of comparisons (one text at least).
BLOCK_TEXTS, BLOCK_BYTES = 512, 4 << 20
#: Numbers in a slice of a block's shingle matrices.
CELLS = 1 << 22
#: Text handled at once in numpy.
SLICE_BYTES = 1 << 20
_GOLDEN = 0x9E3779B97F4A7C15
_ODD = 0xD6E8FEB86659FD93
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x):
    """A 64-bit finaliser (splitmix64), elementwise."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(data, offsets, k: int = SHINGLE):
    """Distinct shingles of texts in one byte buffer.

    ``data``: bytes; text i is ``data[offsets[i]:offsets[i + 1]]``. Returns the
    shingles (text number << 48 | hash, ascending) and their counts.
    """
    import numpy as np

    n = len(offsets) - 1
    if not len(data) or n < 1:
        return np.empty(0, "u8"), np.empty(0, "i8")
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    if not len(starts):
        return np.empty(0, "u8"), np.empty(0, "i8")
    table = mix(np.arange(1, 257, dtype="u8") * np.uint64(_GOLDEN))
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(table[data] * _powers(_ODD, len(data)), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts])
    text = np.searchsorted(offsets, starts, side="right") - 1
    size = np.bincount(text, minlength=n)
    place = np.arange(len(words)) - (np.cumsum(size) - size)[text]
    left = size[text] - place
    padded, hashes = np.concatenate([words, np.zeros(k, "u8")]), np.zeros(len(words), "u8")
    for j in range(k):
        hashes = hashes * np.uint64(_ODD) + np.where(left > j, padded[j : j + len(words)], np.uint64(0))
    whole = (left >= k) | (place == 0)
    keys = np.sort((text[whole].astype("u8") << np.uint64(48)) | (mix(hashes[whole]) >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def signatures(keys, counts, n: int, components: int = BANDS * ROWS):
    """BagMinHash values, one row per text; texts without shingles keep infinity."""
    import numpy as np

    values = np.full((n, components), np.inf)
    if not len(keys):
        return values
    owner, element = (keys >> np.uint64(48)).astype("i8"), keys & np.uint64((1 << 48) - 1)
    blocks = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype("i8") + 1, 1)
    weight = np.bincount(owner, counts, minlength=n)
    spare, pending = 4.0, weight > 0
    while pending.any():
        limit = np.where(pending, (math.log(components) + spare) / np.maximum(weight, 1), 0.0)
        own = np.flatnonzero(pending[owner])
        pair = np.repeat(own, blocks[own])
        block = np.arange(len(pair)) - np.repeat(np.cumsum(blocks[own]) - blocks[own], blocks[own])
        low = np.where(block > 0, np.int64(1) << np.maximum(block - 1, 0), 0)
        width = np.maximum(low, 1).astype("u8")
        room = np.where(low + width.astype("i8") <= counts[pair], np.uint64(1 << 62), (counts[pair] - low).astype("u8"))
        state = mix(element[pair] ^ mix((block + 1).astype("u8") * np.uint64(_GOLDEN)))
        scale, until, doc = -1.0 / (components * width.astype("f8")), limit[owner[pair]], owner[pair]
        time, flat = np.zeros(len(pair)), values.reshape(-1)
        while len(time):
            state = state + np.uint64(_GOLDEN)
            draw = mix(state)
            time = time + scale * np.log(((draw >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53)
            on = np.flatnonzero(time <= until)
            state, time, until, doc, scale, width, room = state[on], time[on], until[on], doc[on], scale[on], width[on], room[on]
            draw = mix(state ^ np.uint64(_ODD))
            counting = (draw & (width - np.uint64(1))) < room
            slot = doc * components + ((draw >> np.uint64(40)) % np.uint64(components)).astype("i8")
            np.minimum.at(flat, slot[counting], time[counting])
        pending &= ~np.isfinite(values).all(axis=1)
        values[pending] = np.inf
        spare *= 2
    return values


def bands(values, number: int = BANDS):
    """A 64-bit key for each band of each text."""
    import numpy as np

    n, components = values.shape
    parts = values.view("u8").reshape(n, number, components // number)
    key = np.broadcast_to(mix(np.arange(1, number + 1, dtype="u8") * np.uint64(_ODD)), (n, number)).copy()
    for r in range(parts.shape[2]):
        key = mix(key * np.uint64(_GOLDEN) + parts[:, :, r])
    return key.view("i8")


def buffer_of(column: pa.Array):
    """An Arrow string column's bytes and offsets, from zero."""
    import numpy as np

    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    return np.frombuffer(data, "u1")[at[0] : at[-1]] if data is not None else np.empty(0, "u1"), at - at[0]


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, bytes, keys``: a document's text digest, size and band keys (null without a word). No shuffle."""
    rows = docs.select("doc_id", F.unhex(F.md5(text_or_empty().cast("binary"))).alias("digest"), F.lower(text_or_empty()).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        remembering("duplicates")
        for part in slices(batches, "text", SLICE_BYTES):
            for start in range(0, part.num_rows, 4096):
                some = part.slice(start, 4096)
                values = signatures(*shingles(*buffer_of(some.column("text"))), some.num_rows)
                none, numbers = ~np.isfinite(values[:, 0]), bands(values)
                ends = pa.array(np.arange(some.num_rows + 1, dtype="i4") * numbers.shape[1])
                keys = pa.ListArray.from_arrays(ends, pa.array(numbers.reshape(-1)))
                keys = pc.if_else(pa.array(none), pa.scalar(None, keys.type), keys) if none.any() else keys
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("digest"), pc.binary_length(some.column("text")).cast(pa.int64()), keys], names=["doc_id", "digest", "bytes", "keys"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, bytes long, keys array<long>")


def overlaps(keys, counts, left, right):
    """Weighted Jaccard coefficients of the texts numbered ``left`` with those numbered ``right``, as a matrix.

    ``keys`` and ``counts`` are the ``shingles`` of all texts. A shingle that
    occurs c times is c different columns of the texts' 0/1 matrices, so that
    their product counts what two texts have in common.
    """
    import numpy as np

    owner = (keys >> np.uint64(48)).astype("i8")
    rows = int(max(left.max(), right.max())) + 1
    total = np.bincount(owner, counts, minlength=rows)
    often = np.flatnonzero(counts > 1)
    again = np.repeat(often, counts[often] - 1)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(counts[often] - 1) - (counts[often] - 1), counts[often] - 1) + 1
    element = keys & np.uint64((1 << 48) - 1)
    element = np.concatenate([element, mix(element[again] + nth.astype("u8") * np.uint64(_GOLDEN)) >> np.uint64(16)])
    owner = np.concatenate([owner, owner[again]])
    _, column = np.unique(element, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    # only columns that several texts have matter
    size = np.bincount(column)
    shared = size[column] > 1
    owner, column = owner[shared], (np.cumsum(size > 1) - 1)[column[shared]]
    places = []
    for own in (left, right):
        place = np.full(rows, -1)
        place[own] = np.arange(len(own))
        places.append(place[owner])
    both, step = np.zeros((len(left), len(right)), "f8"), max(1, CELLS // (len(left) + len(right)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, [at, at + step])
        sides = []
        for own, place in zip((left, right), places):
            here = np.flatnonzero(place[low:high] >= 0) + low
            side = np.zeros((len(own), step), "f4")
            side[place[here], column[here] - at] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    return both / np.maximum(total[left][:, None] + total[right][None, :] - both, 1)


def similarity(left: list[str], right: list[str]) -> list[float]:
    """Weighted Jaccard coefficients of pairs of texts."""
    import numpy as np

    out = []
    for s, t in zip(left, right):
        keys, counts = shingles(*buffer_of(pa.array([s.lower(), t.lower()], pa.string())))
        out.append(float(overlaps(keys, counts, np.array([0]), np.array([1]))[0, 0]) if len(keys) else 0.0)
    return out


def by_block(rows: DataFrame, links: Callable[[pa.RecordBatch], pa.RecordBatch | None], owner: str = "duplicates", schema: str | None = None) -> DataFrame:
    """What ``links`` finds in each block of ``rows(block, i, j, node, ...)``: ``a, b``, or a schema of its own. A task holds the rows of one block."""
    dealt = rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering(owner)
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            ids, start = list(zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j")))), 0
            for at, own in enumerate(ids):
                if own != last:
                    if at > start:
                        rest.append(batch.slice(start, at - start))
                    if rest and (found := links(pa.concat_batches(rest))) is not None:
                        yield found
                    rest, start, last = [], at, own
            if start < len(ids):
                rest.append(batch.slice(start))
        if rest and (found := links(pa.concat_batches(rest))) is not None:
            yield found

    kind = rows.schema["node"].dataType.simpleString()
    return dealt.mapInArrow(run, schema or f"a {kind}, b {kind}")


def verified(rows: DataFrame, least: float) -> DataFrame:
    """``a, b``: links between the texts of each block.

    ``rows(block, i, j, node, root, is_left, is_right, text)``; a block's left
    texts are compared with its right ones of other roots. A task holds the
    rows of a block and a slice of its matrices.
    """

    def links(part: pa.RecordBatch) -> pa.RecordBatch | None:
        import numpy as np

        left, right = np.flatnonzero(part.column("is_left").to_numpy(False)), np.flatnonzero(part.column("is_right").to_numpy(False))
        if not len(left) or not len(right):
            return None
        keys, counts = shingles(*buffer_of(part.column("text")))
        if not len(keys):
            return None
        root = np.array(part.column("root").to_pylist(), object)
        alike = (overlaps(keys, counts, left, right) >= least) & (root[left][:, None] != root[right][None, :])
        i, j = np.nonzero(alike)
        nodes = part.column("node")
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(left[i])), nodes.take(pa.array(right[j]))], names=["a", "b"])

    return by_block(rows.withColumn("text", F.lower("text")), links)


def parts_of(texts: Column, size: Column) -> Column:
    """In how many parts so many texts of this total size are dealt out."""
    return F.greatest(F.ceil(texts / F.lit(BLOCK_TEXTS)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")


def part_of(node: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("part")), parts).cast("int")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``links(a, b)``: the least node of each component.

    Every round takes the least root among a node and its neighbours, then the
    root's own root; the number of rounds grows with the logarithm of a chain.
    """
    edges = kept(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    # links mostly lead to the least node of a component, so that these roots are the last ones already
    roots = kept(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root"), F.lit(True).alias("changed")))
    while True:
        near = edges.join(roots, edges["x"] == roots["node"]).groupBy(F.col("y").alias("at")).agg(F.min("root").alias("near"))
        lower = roots.join(near, F.col("node") == F.col("at")).select("node", "root", F.least("root", "near").alias("low"))
        over = roots.select(F.col("node").alias("at"), F.col("root").alias("over"))
        new = kept(lower.join(over, F.col("low") == F.col("at")).select("node", F.least("low", "over").alias("root"), (F.col("root") != F.least("low", "over")).alias("changed")))
        dropped(roots)
        roots = new
        if roots.where("changed").isEmpty():
            dropped(edges)
            out = roots.drop("changed")
            out._quire_folder = roots._quire_folder
            return out


def linked(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = SIMILARITY, verify: Callable[[DataFrame, float], DataFrame] = verified) -> DataFrame:
    """Components of near duplicates: ``node, root`` for each node with a link.

    ``nodes(node, bytes, keys)``; ``texts_of`` gives ``node, text`` for a table of
    nodes, ``verify`` the links of blocks as ``verified`` does. All of these may
    be large; neither they nor links or components pass through the driver.
    """
    entries = nodes.where(F.col("keys").isNotNull()).select("node", "bytes", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # all members of buckets of two and more
    entries = kept(entries.join(sizes, "key").select("key", "node", "bytes", "n"))
    mates = kept(entries.groupBy("node").agg(F.sum("n").alias("mates"), F.first("bytes").alias("bytes")))
    leaders = kept(entries.join(mates.select("node", "mates"), "node").groupBy("key").agg(F.max_by("node", F.struct("mates", "node")).alias("leader")))
    texts = kept(texts_of(mates.select("node")))

    def compared(blocks: DataFrame) -> DataFrame:
        return kept(verify(blocks.join(texts, "node").select("block", "i", "j", "node", "root", "is_left", "is_right", "text"), least))

    # round 1: a leader stands in each block of its members
    led = kept(entries.join(leaders, "key").where(F.col("node") != F.col("leader")).select("leader", "node", "bytes").distinct())
    sums = kept(led.groupBy("leader").agg(parts_of(F.count("*"), F.sum("bytes")).alias("parts")))
    members = led.join(sums, "leader").select(F.col("leader").alias("block"), F.lit(0).alias("i"), part_of(F.col("node"), F.col("parts")).alias("j"), "node", F.lit(False).alias("is_left"), F.lit(True).alias("is_right"))
    heads = sums.select(F.col("leader").alias("block"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.col("leader").alias("node"), F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
    links = compared(members.unionByName(heads).withColumn("root", F.col("node")))
    dropped(led, sums)
    first = components(links)

    # round 2: what is left of the buckets without their leaders; buckets of equal members are one
    state = entries.join(leaders, "key").where(F.col("node") != F.col("leader")).select("key", "node", "bytes").join(first, "node", "left")
    state = kept(state.select("key", "node", "bytes", F.coalesce("root", "node").alias("root")))
    dropped(entries, leaders)
    id_ = F.xxhash64("node")
    by_root = state.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.bit_xor(id_).alias("x"), F.bit_xor(F.xxhash64(id_, F.lit(1))).alias("y"))
    main = F.max_by(F.struct("root", "n", "size"), F.struct("n", "root"))
    mixed = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), main.alias("main")).where(F.col("roots") > 1)
    mixed = mixed.groupBy("x", "y", "n").agg(F.min_by(F.struct("key", "size", "main"), "key").alias("b"))
    rights, lefts = parts_of(F.col("n"), F.col("b.size")), parts_of(F.col("n") - F.col("b.main.n"), F.col("b.size") - F.col("b.main.size"))
    mixed = kept(mixed.select(F.col("b.key").alias("key"), F.col("b.main.root").alias("main"), rights.alias("rights"), lefts.alias("lefts")))
    lesser, own_left, own_right = F.col("root") != F.col("main"), part_of(F.col("node"), F.col("lefts")), part_of(F.col("node"), F.col("rights"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), own_right.alias("j"), (lesser & (i == own_left)).alias("is_left"), F.lit(True).alias("is_right")))
    as_left = F.transform(F.filter(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: lesser & (j != own_right)), lambda j: F.struct(own_left.alias("i"), j.alias("j"), F.lit(True).alias("is_left"), F.lit(False).alias("is_right")))
    blocks = state.join(mixed, "key").select(F.col("key").alias("block"), "node", "root", F.explode(F.concat(as_right, as_left)).alias("at")).select("block", "node", "root", "at.*")
    more = compared(blocks)
    roots = components(links.unionByName(more))
    dropped(state, mixed, mates, texts, links, more, first)
    return roots


def _digest():
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def _known(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``node, class_id, copies, class_texts`` for each text, and ``class_id, node`` of each class's own document."""
    groups = kept(signed(docs).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"), F.first("keys").alias("keys")))
    groups = groups.withColumnRenamed("digest", "node")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = nodes.join(groups.select("node", "rep"), "node").select(F.col("node").alias("own"), "rep")
        rows = docs.select("doc_id", _digest().alias("node"), text_or_empty().alias("text"))
        return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("node") == F.col("own")), "left_semi").select("node", "text").dropDuplicates(["node"])

    roots = linked(groups.where(F.col("keys").isNotNull()).select("node", "bytes", "keys"), texts_of, least)
    named = kept(groups.select("node", "rep", "copies").join(roots, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root")))
    heads = kept(named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("head"), F.count("*").alias("class_texts")))
    known = kept(named.join(heads, "root").select("node", F.col("head.rep").alias("class_id"), "copies", "class_texts"))
    return known, heads.select(F.col("head.rep").alias("class_id"), F.col("head.node").alias("node"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, class_id, text_copies, class_texts``.

    ``class_id`` is the least doc_id of the class; ``text_copies`` counts the
    rows with the same text, ``class_texts`` the class's different texts. A
    null text counts as empty; texts without a word are equal to themselves
    only, so all empty ones form one class. A null doc_id is a row like any
    other. Repeated rows are copies. An empty table gives no rows; further
    columns are ignored.
    """
    known, _ = _known(docs, least)
    rows = docs.select("doc_id", _digest().alias("node"))
    return rows.join(known, "node").select("doc_id", "class_id", F.col("copies").alias("text_copies"), "class_texts")


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, the one with the least doc_id; columns as they are, whatever their names."""
    _, heads = _known(docs, least)
    columns, node = docs.columns, unused(docs.columns, "__node")
    heads = heads.select(F.col("class_id").alias("__rep"), F.col("node").alias("__own"))
    rows = docs.withColumn(node, _digest())
    rows = rows.join(heads, rows["doc_id"].eqNullSafe(heads["__rep"]) & (rows[node] == heads["__own"]), "left_semi")
    return rows.dropDuplicates(["doc_id", node]).select(*[F.col(f"`{c}`") for c in columns])
