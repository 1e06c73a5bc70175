"""Exact top-k search with vector-approximation files (operator 6).

Every dimension's range is cut into cells; a vector's approximation is its row
of cell numbers, one byte each, and stands in the file beside the exact vector.
Three steps, none of which reads an exact vector that an earlier one ruled out:

1. a scan of the approximations bounds every score from both sides; each
   query's k-th best lower bound is what a score must reach;
2. a second scan, with these bounds, gives the candidates whose upper bound
   reaches it;
3. of these, exact vectors are read in the order of their bounds, best first
   and in growing portions, until the k-th exact score is above the best bound
   that is left.

Scores are inner products of integer vectors, so a cell's middle gives the score
up to a slack that depends on the query alone: half a cell's width in each
dimension, times the size of the query's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tables import dropped, kept

#: Rows of a block of queries, and of candidates; a scan multiplies tiles of TILE rows.
QUERIES, CANDIDATES, TILE = 8192, 8192, 1024
#: Cells of a dimension.
CELLS = 64
SCALE = 256
#: Exact vectors that a query reads at first, in multiples of k, and by what the next portions grow.
PORTION, GROWTH = 4, 8


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` with each component x as floor(scale * x); without vectors that are null or hold a null or non-finite component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("embedding").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull()).where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def enough(rows: DataFrame, k: int) -> DataFrame:
    """``rows(vec_id, v)`` without copies of a vector that can't be among anyone's k best: as others with the same score have smaller ids.

    Of each vector the k + 1 least ids stay (one may be the query's own), each at most k times.
    """
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    some = rows.groupBy("v", "vec_id").agg(F.count("*").alias("n")).withColumn("at", least).where(F.col("at") <= k + 1)
    return some.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("copy")).drop("copy")


def _block(rows: int, size: int, key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, ceil(rows / size)))).cast("int")


def marks(rows: DataFrame, cells: int = CELLS) -> dict[int, list[tuple[int, int]]]:
    """For each length of vectors, each dimension's least value and cell width. The driver gets one row for each length and dimension."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        found: dict[int, list] = {}
        for batch in batches:
            own: dict[int, list] = {}
            for v in batch.column("v").to_numpy(zero_copy_only=False):
                own.setdefault(len(v), []).append(v)
            for dim, some in own.items():
                both = np.array(some, "i8").reshape(len(some), dim)
                low, high = (both.min(axis=0), both.max(axis=0)) if dim else (both[:0], both[:0])
                if dim in found:
                    low, high = np.minimum(low, found[dim][0]), np.maximum(high, found[dim][1])
                found[dim] = [low, high]
        names = ["dim", "i", "low", "high"]
        for dim, (low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(low[:dim], pa.int64()), pa.array(high[:dim], pa.int64())], names=names)

    ends = rows.select("v").mapInArrow(extremes, "dim int, i int, low long, high long").groupBy("dim", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, list[tuple[int, int]]] = {}
    for r in ends.orderBy("dim", "i").collect():
        out.setdefault(r["dim"], []).append((r["low"], max(1, -(-(r["high"] - r["low"] + 1) // cells))))
    return out


def approximated(rows: DataFrame, edges: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """``rows`` with ``dim`` and ``cells``, the bytes of each vector's cell numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = {dim: np.array(e, "i8").T for dim, e in edges.items()}
        for batch in batches:
            vectors = batch.column("v").to_numpy(zero_copy_only=False)
            cells = [((np.asarray(v) - own[len(v)][0]) // own[len(v)][1]).astype("u1").tobytes() if len(v) else b"" for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(map(len, vectors), pa.int32()), pa.array(cells, pa.binary())], names=["vec_id", "v", "dim", "cells"])

    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<long>, dim int, cells binary")


def tiles(own: pd.DataFrame, other: pd.DataFrame, edges: list[tuple[int, int]]):
    """Twice the middle scores of a block's queries and candidates, tile by tile: first query, first candidate, scores; a query's own rows are -inf.

    All numbers are whole and below 2**53, so the bounds are exact.
    """
    import numpy as np

    low, width = np.array(edges, "f8").T
    queries, ids = np.array(own["v"].tolist(), "f8"), other["vec_id"].to_numpy()
    cells = np.frombuffer(b"".join(other["cells"]), "u1").reshape(len(other), len(low))
    asked = own["vec_id"].to_numpy()
    for c in range(0, len(ids), TILE):
        middle = 2 * (low + cells[c : c + TILE] * width) + (width - 1)
        for q in range(0, len(queries), TILE):
            about = queries[q : q + TILE] @ middle.T
            about[asked[q : q + TILE, None] == ids[None, c : c + TILE]] = -np.inf
            yield q, c, about


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, cells: int = CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows by inner product, ties to the smaller vec_id.

    ``vectors(vec_id, embedding)``; a query's candidates are all rows with
    another vec_id. Vectors with a null id, of another length than the
    query's, or that hold a null or non-finite component take no part; fewer
    candidates give fewer ranks; no queries or no rows give no rows. Repeated
    vec_ids are candidates each for itself; as a query such an id asks once,
    with the least of its vectors. Scores are exact; components so large
    that a score may not fit a long are refused. Extra columns are ignored.
    """
    usable = quantised(vectors, scale)
    edges = marks(usable, cells)
    # what doubles may be off by where twice a score doesn't fit them exactly: bounds are widened by it
    off: dict[int, float] = {}
    for dim, own in edges.items():
        largest = sum(max(abs(low), abs(low + width * cells)) ** 2 for low, width in own)
        if largest >= 1 << 62:
            raise ValueError(f"components of vectors of length {dim} are too large: scores may not fit a long")
        off[dim] = largest * max(dim, 128) * 2.0**-51 if largest >= 1 << 50 else 0.0
    file = kept(approximated(enough(usable, k), edges).where(F.col("dim") > 0).withColumn("row", F.monotonically_increasing_id()))
    queries = kept(usable.where(is_query & (F.size("v") > 0)).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    sizes = [file.count(), queries.count()]
    blocks, chunks = max(1, ceil(sizes[1] / QUERIES)), max(1, ceil(sizes[0] / CANDIDATES))
    right = file.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), _block(sizes[0], CANDIDATES, "row").alias("cb"), "row", "vec_id", "cells")

    def met(own: DataFrame, scan, schema: str) -> DataFrame:
        """A scan of each block of queries with each block of approximations."""
        names = own.columns
        left = own.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("cb"), _block(sizes[1], QUERIES, "vec_id").alias("qb"), *names)
        return left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInPandas(scan, schema)

    def lower(key, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        """The k best lower bounds of a block."""
        import numpy as np

        if not len(own) or not len(other):
            return pd.DataFrame({"query": [], "least": []})
        best = np.full((len(own), k), -np.inf)
        for q, _, about in tiles(own, other, edges[key[0]]):
            both = np.concatenate([best[q : q + TILE], about], axis=1)
            best[q : q + TILE] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        slack = np.abs(np.array(own["v"].tolist(), "f8")) @ (np.array(edges[key[0]], "f8")[:, 1] - 1)
        some = np.isfinite(best)
        return pd.DataFrame({"query": np.repeat(own["vec_id"].to_numpy(), some.sum(axis=1)), "least": (best - slack[:, None] - off[key[0]])[some]})

    found = met(queries, lower, "query long, least double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("least")))
    bounds = found.withColumn("n", rank).where(F.col("n") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("least")).otherwise(float("-inf")).alias("bound"))
    asking = queries.join(bounds, queries["vec_id"] == bounds["query"]).drop("query")

    def upper(key, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        """The candidates of a block whose upper bound reaches the query's bound."""
        import numpy as np

        out = [(np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))]
        if len(own) and len(other):
            slack = np.abs(np.array(own["v"].tolist(), "f8")) @ (np.array(edges[key[0]], "f8")[:, 1] - 1)
            need, asked, there = own["bound"].to_numpy(), own["vec_id"].to_numpy(), other["row"].to_numpy()
            for q, c, about in tiles(own, other, edges[key[0]]):
                most = about + slack[q : q + TILE, None] + off[key[0]]
                i, j = np.nonzero((most >= need[q : q + TILE, None]) & np.isfinite(most))
                out.append((asked[q + i], there[c + j], most[i, j]))
        query, row, most = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query": query, "row": row, "most": most})

    rest = kept(met(asking, upper, "query long, row long, most double"))
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "row"))
    at = F.struct((-F.col("most")).alias("less"), "row")
    size, best = PORTION * k, None
    while True:
        # a row number with a limit: no task keeps more of a query's candidates than a portion
        portion = kept(rest.withColumn("place", place).where(F.col("place") <= size).drop("place"))
        if best is not None and portion.isEmpty():
            break
        read = portion.join(file.select("row", "vec_id", "v"), "row").join(queries.select(F.col("vec_id").alias("query"), F.col("v").alias("q")), "query")
        read = read.select("query", "vec_id", "row", product.alias("score"))
        read = read if best is None else read.unionByName(best)
        ranked = read.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")))
        old, best = best, kept(ranked.where(F.col("rank") <= k).drop("rank"))
        # what comes after the portion and can still be among the k best
        last = portion.groupBy("query").agg(F.max(at).alias("last")).join(best.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n")), "query")
        left = rest.join(last, "query").where((at > F.col("last")) & ((F.col("n") < k) | (F.col("most") >= 2 * F.col("kth")))).select("query", "row", "most")
        before, rest, size = rest, kept(left), size * GROWTH
        dropped(before, portion, *([old] if old is not None else []))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")).cast("int")
    out = kept(best.select(F.col("query").alias("query_id"), rank.alias("rank"), "vec_id", "score"))
    dropped(best, rest, portion, queries, file)
    return out
