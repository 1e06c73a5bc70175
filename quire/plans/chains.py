"""Queries over chains of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chains as C
from quire.plans.registry import query, table

#: Parts as frames: 32 to a page, one below the other in odd pages, as a heap in even ones; 31 of each seventh page hangs on what isn't there.
_FRAMES = """f AS (SELECT p_partkey // 32 AS page_id, p_partkey % 32 AS frame_id, CASE WHEN p_partkey % 32 = 0 THEN NULL WHEN p_partkey // 32 % 7 = 0 AND p_partkey % 32 = 31 THEN 99 WHEN p_partkey // 32 % 2 = 1 THEN p_partkey % 32 - 1 ELSE (p_partkey % 32 - 1) // 2 END AS parent_id,
p_size AS x, p_size % 7 AS y, CASE WHEN p_partkey % 8 = 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scale, p_partkey % 5 AS scroll_x, p_partkey % 3 AS scroll_y FROM part)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    page, frame = F.floor(k / 32), k % 32
    parent = F.when(frame == 0, F.lit(None)).when((page % 7 == 0) & (frame == 31), 99).when(page % 2 == 1, frame - 1).otherwise(F.floor((frame - 1) / 2))
    scale = F.when(k % 8 == 3, 0.5).otherwise(1.0)
    return table(spark, sf_dir, "part").select(page.alias("page_id"), frame.alias("frame_id"), parent.cast("bigint").alias("parent_id"), F.col("p_size").alias("x"), (F.col("p_size") % 7).alias("y"), scale.alias("scale_x"), scale.alias("scale_y"), (k % 5).alias("scroll_x"), (k % 3).alias("scroll_y"))


@query(f"""WITH RECURSIVE {_FRAMES},
up AS (SELECT page_id, frame_id, parent_id AS above, (10 + frame_id - scroll_x)::DOUBLE AS x, (20 - scroll_y)::DOUBLE AS y, 4.0::DOUBLE AS width, x AS ox, y AS oy, scale FROM f
UNION ALL SELECT u.page_id, u.frame_id, p.parent_id, (u.ox + u.x * u.scale + p.scroll_x) - p.scroll_x, (u.oy + u.y * u.scale + p.scroll_y) - p.scroll_y, u.width * u.scale, p.x, p.y, p.scale FROM up u JOIN f p ON p.page_id = u.page_id AND p.frame_id = u.above)
SELECT f.page_id, f.frame_id, f.frame_id AS id, u.x::DOUBLE AS x, u.y::DOUBLE AS y, u.width, u.width AS height, CASE WHEN u.x IS NULL THEN 'visual_fallback.frame' END AS error FROM f LEFT JOIN (SELECT * FROM up WHERE above IS NULL) u USING (page_id, frame_id)""")
def fallback_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle in each frame, on its page's screen: 31 frames up at most."""
    frames = _frames(spark, sf_dir)
    rects = frames.select("page_id", "frame_id", F.col("frame_id").alias("id"), (F.col("frame_id") + 10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(4.0).alias("width"), F.lit(4.0).alias("height"))
    return C.clips(rects, frames)


@query(f"""WITH RECURSIVE {_FRAMES},
i AS (SELECT page_id, frame_id, parent_id, CAST(row_number() OVER (PARTITION BY page_id, parent_id ORDER BY frame_id) - 1 AS INTEGER) AS retained, CAST(frame_id AS INTEGER) AS original FROM f),
d AS (SELECT page_id, frame_id, CAST([] AS INTEGER[]) AS original, CAST([] AS INTEGER[]) AS retained FROM i WHERE parent_id IS NULL
UNION ALL SELECT i.page_id, i.frame_id, list_append(d.original, i.original), list_append(d.retained, i.retained) FROM d JOIN i ON i.page_id = d.page_id AND i.parent_id = d.frame_id)
SELECT f.page_id, f.frame_id, d.original, d.retained, CASE WHEN d.frame_id IS NULL THEN 'frame.detached' END AS error FROM f LEFT JOIN d USING (page_id, frame_id)""")
def owner_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's path among its page's frames, by id and by rank among its siblings."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("page_id", "parent_id").orderBy("frame_id")) - 1
    return C.owner_paths(_frames(spark, sf_dir).withColumns({"original_index": F.col("frame_id"), "retained_index": rank}))
