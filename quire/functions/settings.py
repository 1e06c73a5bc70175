"""Settings as text: durations, sizes, viewports, coordinates, and the order of their sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(text: Column) -> Column:
    """``250ms``, ``2``, ``2s``, ``1.5m``, ``1h`` in seconds; null if it isn't one or isn't above 0."""
    number = F.expr("1").cast("double") * F.regexp_extract(text, r"^([0-9]*\.?[0-9]+|[0-9]+\.)([a-z]*)$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^([0-9]*\.?[0-9]+|[0-9]+\.)([a-z]*)$", 2)
    value = F.when(unit == "ms", number / 1000).when(unit.isin("", "s"), number).when(unit == "m", number * 60).when(unit == "h", number * 3600)
    return F.when(value > 0, value)


def byte_size(text: Column) -> Column:
    """``10``, ``10B``, ``4KiB``, ``4MiB``, ``1GiB`` in bytes; null if it isn't one or overflows."""
    number, unit = F.regexp_extract(text, r"^([0-9]+)([A-Za-z]*)$", 1).try_cast("decimal(38,0)"), F.lower(F.regexp_extract(text, r"^([0-9]+)([A-Za-z]*)$", 2))
    factor = F.when(unit.isin("", "b"), 1).when(unit == "kib", 1 << 10).when(unit == "mib", 1 << 20).when(unit == "gib", 1 << 30)
    return (number * factor.cast("decimal(10,0)")).try_cast("bigint")


def viewport(text: Column) -> Column:
    """struct<width, height, scale> of ``WIDTHxHEIGHT``; null if a side is 0 or it isn't one."""
    w, h = (F.regexp_extract(text, r"^([0-9]{1,10})[xX]([0-9]{1,10})$", i).try_cast("bigint") for i in (1, 2))
    return F.when((w > 0) & (h > 0) & (w < 1 << 32) & (h < 1 << 32), F.struct(w.alias("width"), h.alias("height"), F.lit(1).alias("scale")))


def scroll_coordinate(text: Column) -> Column:
    """A finite decimal between -1e9 and 1e9, or null."""
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(value) <= 1e9, value)


def resolved(flag: Column, env: Column, explicit: Column, user: Column, default: Column) -> Column:
    """struct<value, source>: a flag beats the environment, then an explicit file, the user's file and the default."""
    ranks = (("flag", flag), ("env", env), ("explicit", explicit), ("user", user))
    source = F.when(flag.isNotNull(), "flag")
    for name, column in ranks[1:]:
        source = source.when(column.isNotNull(), name)
    return F.struct(F.coalesce(flag, env, explicit, user, default).alias("value"), source.otherwise("default").alias("source"))
