"""Queries over journals: the events table as captures' events (a user is a capture)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query, table
from quire.streaming import journal as J

_KINDS = {"view": "resource-discovered", "click": "warning", "signup": "readiness-changed", "purchase": "navigation-redirected", "error": "resource-progress"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("sequence"), F.expr(_KIND).alias("type"))


@query(f"""WITH e AS (SELECT user_id AS capture_id, event_id AS sequence, {_KIND} AS type, CASE event_type WHEN 'signup' THEN 'guaranteed' WHEN 'error' THEN 'progress' ELSE 'detail' END AS retention FROM events)
SELECT capture_id, sequence, type, retention FROM e QUALIFY retention = 'guaranteed' OR row_number() OVER (PARTITION BY capture_id, retention ORDER BY sequence DESC) <= CASE retention WHEN 'detail' THEN 10 ELSE 1 END""")
def event_journal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a late subscriber gets, with ten details kept."""
    return J.tail(_events(spark, sf_dir), 10)


_STATE = "CASE event_type WHEN 'view' THEN 'created' WHEN 'click' THEN 'validating' WHEN 'signup' THEN 'cancelling' WHEN 'purchase' THEN 'failed' ELSE 'waiting-for-browser' END"


@query(f"""WITH e AS (SELECT user_id AS capture_id, event_id AS sequence, {_STATE} AS after, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT capture_id, sequence, before, after FROM e WHERE NOT CASE WHEN before IS NULL THEN after = 'created' ELSE (before || '>' || after) IN ('created>validating', 'validating>waiting-for-browser', 'cancelling>failed')
 OR (before IN ('created', 'validating', 'waiting-for-browser') AND after IN ('cancelling', 'failed')) END""")
def state_transitions_illegal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("sequence"), F.expr(_STATE).alias("state"))
    return J.illegal_transitions(rows)


@query("""SELECT user_id, epoch_us(ts) AS at_us, gap AS gap_us FROM (SELECT user_id, ts, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap >= 7200000000""")
def quiet_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After which events a user is quiet for two hours at least."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return J.quiet_gaps(rows, "user_id", "us", 7_200_000_000)


@query("""SELECT user_id, event_id, CAST(run - least(min(run) OVER w, 0) AS BIGINT) AS open FROM (SELECT user_id, event_id, ts, sum(CASE WHEN event_type IN ('view','click','signup') THEN 1 ELSE -1 END) OVER w2 AS run FROM events WINDOW w2 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def requests_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("at"), F.when(F.col("event_type").isin("view", "click", "signup"), 1).otherwise(-1).alias("delta"))
    return J.in_flight(rows, "user_id")


@query("""WITH e AS (SELECT user_id, event_id, ts, value > 10 AS sample FROM events), c AS (SELECT *, CASE WHEN lag(sample) OVER w IS NOT DISTINCT FROM sample THEN 0 ELSE 1 END AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c) SELECT user_id, CAST(island AS BIGINT) AS island, bool_or(sample) AS sample, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(*) AS n FROM i GROUP BY 1, 2""")
def stable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") > 10).alias("sample"))
    return J.stable_spans(rows, "user_id")


@query("""SELECT user_id AS capture_id, min_by(CASE event_type WHEN 'purchase' THEN 'commit' ELSE 'cancel' END, event_id) AS decision FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
def commit_or_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("sequence"), F.when(F.col("event_type") == "purchase", "commit").otherwise("cancel").alias("decision"))
    return J.arbitration(rows)


@query("""SELECT doc_id AS transfer, CASE doc_id % 4 WHEN 0 THEN NULL ELSE sha256(text) END AS digest, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN strlen(text) = 0 OR doc_id % 8 = 0 THEN 'transfer.crc' ELSE 'transfer.count' END END AS error FROM documents""")
def chunk_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into chunks, some spoiled or doubled, put together again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("transfer"), F.col("text").cast("binary").alias("body"))
    parts = docs.select("transfer", F.explode(J.chunks_of(F.col("body"), 1024)).alias("c")).select("transfer", "c.*")
    spoiled = parts.withColumn("crc32", F.when((F.col("transfer") % 8 == 0) & (F.col("sequence") == 0), F.col("crc32") + 1).otherwise(F.col("crc32")))
    doubled = spoiled.unionByName(spoiled.where("transfer % 8 = 4 AND sequence = 0"))
    sizes = docs.select("transfer", F.greatest(F.ceil(F.octet_length("body") / 1024), F.lit(1)).alias("chunks"), F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("sha256"))
    return J.reassembled(doubled, sizes).select("transfer", F.sha2("body", 256).alias("digest"), "error")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'protocol.version' WHEN p_size % 3 = 0 THEN 'protocol.capability' WHEN p_size % 7 = 0 THEN 'protocol.chunk' END AS error, CASE WHEN p_size % 5 > 0 AND p_size % 3 > 0 AND p_size % 7 > 0 THEN least(p_size % 4, 2) END AS minor, CASE WHEN p_size % 5 > 0 AND p_size % 3 > 0 AND p_size % 7 > 0 THEN least(1000, p_size % 7 * 500) END AS chunk FROM part""")
def protocol_negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    version = lambda major, minor: F.struct(major.alias("major"), minor.alias("minor"))
    got = J.negotiated(F.when(n % 3 == 0, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a"))), F.array(F.lit("a"), F.lit("b")), version(F.when(n % 5 == 0, 2).otherwise(1), n % 4), version(F.lit(1), F.lit(2)), F.lit(1000), n % 7 * 500)
    return table(spark, sf_dir, "part").select("p_partkey", got["error"].alias("error"), got["minor"].alias("minor"), got["chunk"].alias("chunk"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def quiet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity until half an hour passes without any."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return J.quiet_sessions(rows, "user_id", "ts", "30 minutes", "1 hour").select("user_id", F.unix_micros("start").alias("start_us"), "n")
