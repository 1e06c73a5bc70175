"""Capture journals: event order, retention, states, quiet times, chunks. Batch forms, and the journal as a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The states in order, and how long each kind of event is kept.
STATES = ("created", "validating", "waiting-for-browser", "navigating", "waiting-for-readiness", "collecting", "resolving-resources", "transforming", "encoding", "verifying", "committing", "succeeded")
TERMINAL = ("succeeded", "failed", "cancelled")
GUARANTEED = ("capture-started", "browser-ready", "navigation-started", "readiness-changed", "transform-started", "artifact-encoding", "verification-started", "capture-succeeded", "capture-failed", "capture-cancelled")
DETAIL = ("navigation-redirected", "frame-collected", "resource-discovered", "warning")
PROGRESS = ("resource-progress",)
DETAIL_KEPT = 16_384


def retention(kind: Column) -> Column:
    return F.when(kind.isin(*GUARANTEED), "guaranteed").when(kind.isin(*PROGRESS), "progress").otherwise("detail")


def tail(events: DataFrame, detail: int = DETAIL_KEPT) -> DataFrame:
    """What a late subscriber gets: ``capture_id, sequence, type, retention`` of ``events(capture_id, sequence, type)``.

    All guaranteed events, the newest ``detail`` details, the newest progress.
    """
    rows = events.withColumn("retention", retention(F.col("type")))
    newest = F.row_number().over(Window.partitionBy("capture_id", "retention").orderBy(F.col("sequence").desc()))
    kept = rows.withColumn("newest", newest).where((F.col("retention") == "guaranteed") | ((F.col("retention") == "detail") & (F.col("newest") <= detail)) | (F.col("newest") == 1))
    return kept.select("capture_id", "sequence", "type", "retention")


def legal(before: Column, after: Column) -> Column:
    """Whether a capture may go from one state to the next; before the first there is none."""
    order = F.array(*map(F.lit, STATES))
    step = F.array_position(order, after) == F.array_position(order, before) + 1
    forward = step & before.isin(*STATES[:-1]) & after.isin(*STATES)
    stop = ~before.isin(*TERMINAL) & (before != "cancelling") & after.isin("cancelling", "failed")
    return F.when(before.isNull(), after == "created").otherwise(forward | stop | ((before == "cancelling") & after.isin("cancelled", "failed")))


def illegal_transitions(events: DataFrame) -> DataFrame:
    """``capture_id, sequence, before, after`` for each step of ``events(capture_id, sequence, state)`` that isn't legal."""
    before = F.lag("state").over(Window.partitionBy("capture_id").orderBy("sequence"))
    rows = events.select("capture_id", "sequence", before.alias("before"), F.col("state").alias("after"))
    return rows.where(~legal(F.col("before"), F.col("after")))


def quiet_gaps(events: DataFrame, key: str, ts: str, quiet_us: int) -> DataFrame:
    """``key, at_us, gap_us``: each event after which nothing happens for ``quiet_us`` at least."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, "event_id"))
    rows = events.select(key, F.col(ts).alias("at_us"), (after - F.col(ts)).alias("gap_us"))
    return rows.where(F.col("gap_us") >= quiet_us)


def in_flight(events: DataFrame, key: str) -> DataFrame:
    """``key, event_id, open``: requests open after each event, from starts and ends (``delta`` 1 and -1), never below 0 by their running sum's least."""
    w = Window.partitionBy(key).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("run", F.sum("delta").over(w))
    return rows.select(key, "event_id", (F.col("run") - F.least(F.min("run").over(w), F.lit(0))).alias("open"))


def stable_spans(samples: DataFrame, key: str) -> DataFrame:
    """``key, island, sample, first_at, last_at, n``: runs of equal samples in order of time."""
    w = Window.partitionBy(key).orderBy("at", "event_id")
    changed = F.when(F.lag("sample").over(w).eqNullSafe(F.col("sample")), 0).otherwise(1)
    rows = samples.withColumn("changed", changed).withColumn("island", F.sum("changed").over(w))
    return rows.groupBy(key, "island").agg(F.first("sample").alias("sample"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))


def arbitration(decisions: DataFrame) -> DataFrame:
    """``capture_id, decision``: of commit and cancel, the first wins."""
    return decisions.groupBy("capture_id").agg(F.min_by("decision", "sequence").alias("decision"))


def chunks_of(body: Column, size: int) -> Column:
    """A body cut into chunks: array<struct<sequence, payload, crc32>>; an empty body is one empty chunk."""
    count = F.greatest(F.ceil(F.octet_length(body) / size).cast("int"), F.lit(1))
    piece = lambda i: F.substring(body, i * size + 1, F.lit(size))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("sequence"), piece(i).alias("payload"), F.crc32(piece(i)).alias("crc32")))


def reassembled(chunks: DataFrame, descriptors: DataFrame) -> DataFrame:
    """``transfer, body, error``: chunks put together and held against their descriptor ``(transfer, chunks, bytes, sha256)``."""
    item = F.struct("sequence", "payload", (F.crc32("payload") == F.col("crc32")).alias("fine"))
    rows = chunks.groupBy("transfer").agg(F.array_sort(F.collect_list(item)).alias("parts")).join(descriptors, "transfer", "right")
    rows = rows.withColumn("body", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), "")))
    error = (
        F.when(F.coalesce(F.size("parts"), F.lit(0)) != F.col("chunks"), "transfer.count")
        .when(F.exists("parts", lambda p: ~p["fine"]), "transfer.crc")
        .when(F.exists(F.transform("parts", lambda p, i: p["sequence"] != i), lambda wrong: wrong), "transfer.sequence")
        .when(F.octet_length("body") != F.col("bytes"), "transfer.length")
        .when(F.sha2("body", 256) != F.col("sha256"), "transfer.digest")
    )
    return rows.select("transfer", F.when(error.isNull(), F.col("body")).alias("body"), error.alias("error"))


def negotiated(requested: Column, available: Column, requested_version: Column, available_version: Column, requested_chunk: Column, available_chunk: Column) -> Column:
    """struct<error, minor, chunk>: versions are structs of major and minor; the lower version's minor and the lesser chunk hold."""
    missing = F.array_except(requested, available)
    chunk = F.least(requested_chunk, available_chunk)
    error = F.when(requested_version["major"] != available_version["major"], "protocol.version").when(F.size(missing) > 0, "protocol.capability").when(chunk <= 0, "protocol.chunk")
    return F.struct(error.alias("error"), F.when(error.isNull(), F.least(requested_version["minor"], available_version["minor"])).alias("minor"), F.when(error.isNull(), chunk).alias("chunk"))


def journal_stream(events: DataFrame, detail: int = DETAIL_KEPT) -> DataFrame:
    """The journal as a stateful stream over ``events(capture_id, sequence, type)``.

    Gives ``capture_id, sequence, type, newest_progress``: guaranteed events in
    order as they come, with the newest progress known then; a capture's state
    is dropped after its terminal event.
    """
    import pandas as pd

    def step(key, parts: Iterator[pd.DataFrame], state):
        seen, progress, ended = state.get if state.exists else (-1, -1, False)
        rows = pd.concat(list(parts)).sort_values("sequence")
        out = []
        for sequence, kind in zip(rows["sequence"], rows["type"]):
            if ended or sequence <= seen:
                continue
            seen = int(sequence)
            if kind in PROGRESS:
                progress = seen
            elif kind in GUARANTEED:
                out.append((key[0], seen, kind, progress))
                ended = kind in GUARANTEED[-3:]
        if ended:
            state.remove() if state.exists else None
        else:
            state.update((seen, progress, ended))
        yield pd.DataFrame(out, columns=["capture_id", "sequence", "type", "newest_progress"])

    return events.groupBy("capture_id").applyInPandasWithState(step, "capture_id long, sequence long, type string, newest_progress long", "seen long, progress long, ended boolean", "append", "NoTimeout")


def quiet_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of activity that a quiet gap ends, as a stream or a batch: ``key, start, end, n``."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
