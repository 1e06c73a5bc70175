"""What adds up along the chain of frames from a frame to its page: places on the screen and owner paths.

Pointer jumping: each frame knows a frame above it and what lies between; in
each round it takes over what that one knows, so that the distance doubles. A
chain of n frames takes log2(n) joins, whatever the number of pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.levels import Levels

FRAME = ["page_id", "frame_id"]

def up_the_chain(frames: DataFrame, value: Column, compose: Callable[[Column, Column], Column]) -> DataFrame:
    """``page_id, frame_id, value, error``: the values of a frame and all above it, composed; a page's own frame has a null parent.

    ``frames(page_id, frame_id, parent_id, ...)`` with unique ids; ``compose(outer,
    inner)`` is associative. A frame below one that isn't there has the error
    ``frame.detached``, one in or below a circle ``frame.circle``; both have no value.
    """
    tables = Levels(frames.sparkSession)
    level = tables.kept(frames.select(*FRAME, F.col("parent_id").alias("up"), value.alias("value"), F.lit(False).alias("lost")))
    # after so many rounds a chain would have more frames than there are
    for _ in range(level.count().bit_length() + 1):
        if level.where(F.col("up").isNotNull() & ~F.col("lost")).isEmpty():
            break
        above = level.select("page_id", F.col("frame_id").alias("up"), F.col("up").alias("next"), F.col("value").alias("outer"), F.col("lost").alias("gone"), F.lit(True).alias("there"))
        joined = level.join(above, ["page_id", "up"], "left")
        climbs = F.col("up").isNotNull() & ~F.col("lost")
        missing = climbs & (F.col("there").isNull() | F.coalesce("gone", F.lit(False)))
        last = tables.number
        level = tables.kept(joined.select(*FRAME, F.when(climbs, F.col("next")).otherwise(F.col("up")).alias("up"), F.when(climbs & ~missing, compose(F.col("outer"), F.col("value"))).otherwise(F.col("value")).alias("value"), (F.col("lost") | missing).alias("lost")))
        tables.drop(last)
    error = F.when(F.col("lost"), "frame.detached").when(F.col("up").isNotNull(), "frame.circle")
    return level.select(*FRAME, F.when(error.isNull(), F.col("value")).alias("value"), error.alias("error"))


def placements(frames: DataFrame) -> DataFrame:
    """``page_id, frame_id, scale_x, scale_y, x, y, error``: where a frame's document lies on the page's screen.

    ``frames(page_id, frame_id, parent_id, x, y, scale_x, scale_y, scroll_x,
    scroll_y)``: the place and scale of a frame's owner in its parent's
    viewport and how far its own document is scrolled; a page's own frame has its
    scroll only. A point p of a document is at ``scale * p + x`` on the screen.
    """
    top = F.col("parent_id").isNull()

    def own(axis: str) -> Column:
        scale = F.when(top, F.lit(1.0)).otherwise(F.col(f"scale_{axis}").cast("double"))
        at = F.when(top, F.lit(0.0)).otherwise(F.col(axis).cast("double"))
        # where an owner stands in its parent's viewport is known, so the parent's scroll is added before its own is taken off
        return F.struct(scale.alias("scale"), (at - F.col(f"scroll_{axis}").cast("double") * scale).alias("at"), F.col(f"scroll_{axis}").cast("double").alias("scroll"))

    def both(outer: Column, inner: Column) -> Column:
        one = lambda o, i: F.struct((o["scale"] * i["scale"]).alias("scale"), (o["scale"] * (i["at"] + o["scroll"]) + o["at"]).alias("at"), i["scroll"].alias("scroll"))
        return F.struct(one(outer["x"], inner["x"]).alias("x"), one(outer["y"], inner["y"]).alias("y"))

    found = up_the_chain(frames, F.struct(own("x").alias("x"), own("y").alias("y")), both)
    return found.select(*FRAME, F.col("value.x.scale").alias("scale_x"), F.col("value.y.scale").alias("scale_y"), F.col("value.x.at").alias("x"), F.col("value.y.at").alias("y"), "error")


def clips(rects: DataFrame, frames: DataFrame) -> DataFrame:
    """``page_id, frame_id, id, x, y, width, height, error`` on the page's screen, of ``rects(page_id, frame_id, id, x, y, width, height)`` in their documents.

    A rectangle in a frame that isn't there has the error ``visual_fallback.frame``, as has one below a detached frame.
    """
    own = placements(frames).select(*FRAME, F.col("x").alias("at_x"), F.col("y").alias("at_y"), "scale_x", "scale_y")
    rows = rects.join(own, FRAME, "left")
    place = lambda axis, size: ((F.col(axis) * F.col(f"scale_{axis}") + F.col(f"at_{axis}")).alias(axis), (F.col(size) * F.col(f"scale_{axis}")).alias(size))
    (x, width), (y, height) = place("x", "width"), place("y", "height")
    return rows.select(*FRAME, "id", x, y, width, height, F.when(F.col("scale_x").isNull(), "visual_fallback.frame").alias("error"))


def owner_paths(frames: DataFrame) -> DataFrame:
    """``page_id, frame_id, original, retained, error``: a frame's places from the page down, before and after others were left out.

    ``frames(page_id, frame_id, parent_id, original_index, retained_index)``; the
    page's own frame has empty paths.
    """
    step = lambda c: F.when(F.col("parent_id").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.col(c).cast("int")))
    value = F.struct(step("original_index").alias("original"), step("retained_index").alias("retained"))
    found = up_the_chain(frames, value, lambda o, i: F.struct(F.concat(o["original"], i["original"]).alias("original"), F.concat(o["retained"], i["retained"]).alias("retained")))
    return found.select(*FRAME, "value.original", "value.retained", "error")
