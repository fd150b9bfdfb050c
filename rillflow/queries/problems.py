"""Queries of the general data-processing problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.identity import epoch_ms, snake_key
from rillflow.operators import delivery, features, implausible, lateness, sessions
from rillflow.queries.registry import Registry, table

registry = Registry()

_UUID = "regexp_replace(regexp_replace(lower(trim(id)), '^urn:uuid:', ''), '[\\s{}()\\-]', '', 'g')"
_MESSAGES = f"""
messages AS (SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY delivery_id) AS copy FROM (
    SELECT *, coalesce({_UUID}, 'row ' || delivery_id) AS k FROM user_activity)) WHERE copy = 1)"""


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "user_activity")


def activity_messages(spark: SparkSession, sf_dir: str, *keep: Column) -> DataFrame:
    rows = activity_rows(spark, sf_dir)
    key = delivery.activity_key(F.col("id"), F.col("delivery_id"))
    return delivery.collapse(rows, key, "delivery_id", list(keep))


def activity_types(spark: SparkSession, sf_dir: str) -> list[str]:
    """The fixed vocabulary in its order by name; refused if it outgrows what columns can hold."""
    rows = table(spark, sf_dir, "activity_types").select("activity_type").distinct().limit(features.MOST_TYPES + 1).collect()
    return sorted(r[0] for r in rows if r[0] is not None)


@registry.query("p1_user_features")
def p1_user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = activity_types(spark, sf_dir)
    rows = features.with_type_number(activity_rows(spark, sf_dir), types, snake_key(F.col("activity_type")), "number")
    key = delivery.activity_key(F.col("id"), F.col("delivery_id"))
    messages = delivery.collapse(rows, key, "delivery_id", [F.col("user_id"), epoch_ms(F.col("timestamp")).alias("ms"), F.col("number")])
    return features.numbered_features(messages, types, "user_id", F.col("number"), F.col("ms"))


def p1_sql(types: list[str]) -> str:
    """The oracle of p1 for a vocabulary: it has columns by its entries."""
    per_type = ",\n".join(
        f"count(*) FILTER (kind = '{t}') AS \"n_{t}\", min(ms) FILTER (kind = '{t}') AS \"first_ms_{t}\", max(ms) FILTER (kind = '{t}') AS \"last_ms_{t}\""
        for t in types
    )
    return f"""
WITH {_MESSAGES},
kinds AS (SELECT user_id, epoch_ms(timestamp) AS ms,
  regexp_replace(regexp_replace(lower(activity_type), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g') AS kind
  FROM messages WHERE user_id IS NOT NULL)
SELECT user_id, count(*) AS n_messages,
  count(DISTINCT kind) FILTER (kind IN (SELECT activity_type FROM activity_types)) AS n_types,
  min(ms) AS first_ms, max(ms) AS last_ms,
{per_type}
FROM kinds GROUP BY user_id"""


@registry.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_reasons(spark, sf_dir).select("metric_id")


@registry.query("p2_reasons")
def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible.implausible(table(spark, sf_dir, "system_metrics"), table(spark, sf_dir, "metric_types"))


@registry.query(
    "p3_found",
    f"""
WITH a AS (SELECT delivery_id, coalesce({_UUID}, 'row ' || delivery_id) AS k FROM user_activity),
c AS (SELECT delivery_id, coalesce(lower(trim(stream_id)) || ':' || sequence_number, 'row ' || delivery_id) AS k FROM media_chunks)
SELECT 'user_activity' AS source_table, delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY delivery_id) AS n FROM a) WHERE n > 1
UNION ALL
SELECT 'media_chunks', delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY delivery_id) AS n FROM c) WHERE n > 1""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.col("delivery_id")
    found = {
        "media_chunks": delivery.superfluous(table(spark, sf_dir, "media_chunks"), delivery.chunk_key(F.col("stream_id"), F.col("sequence_number"), row), "delivery_id", "batch_id"),
        "user_activity": delivery.superfluous(activity_rows(spark, sf_dir), delivery.activity_key(F.col("id"), row), "delivery_id", "batch_id"),
    }
    chunks, activities = (df.select(F.lit(name).alias("source_table"), "delivery_id") for name, df in found.items())
    return chunks.unionByName(activities)


@registry.query(
    "p3_unique_chunks",
    """
SELECT delivery_id, lower(trim(stream_id)) AS stream_id, sequence_number, octet_length(data) AS n_bytes, is_final FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(lower(trim(stream_id)) || ':' || sequence_number, 'row ' || delivery_id) ORDER BY delivery_id) AS n
  FROM media_chunks) WHERE n = 1""",
)
def p3_unique_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "media_chunks")
    key = delivery.chunk_key(F.col("stream_id"), F.col("sequence_number"), F.col("delivery_id"))
    kept = delivery.kept_rows(chunks, key, "delivery_id", "batch_id")
    return kept.select("delivery_id", F.lower(F.trim("stream_id")).alias("stream_id"), "sequence_number", F.octet_length("data").cast("bigint").alias("n_bytes"), "is_final")


def _activity_instants(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return activity_messages(spark, sf_dir, F.col("user_id"), epoch_ms(F.col("timestamp")).alias("ms"), *more)


_SESSIONS = f"""
WITH {_MESSAGES},
e AS (SELECT user_id, epoch_ms(timestamp) AS ms, activity_type FROM messages WHERE user_id IS NOT NULL AND timestamp IS NOT NULL),
marked AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM e),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms RANGE UNBOUNDED PRECEDING) AS session_no FROM marked)"""


@registry.query(
    "p4_found",
    f"{_SESSIONS} SELECT user_id, min(ms) AS session_start_ms, max(ms) AS session_end_ms FROM numbered GROUP BY user_id, session_no",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole operator, counts included, as they are part of the problem."""
    found = sessions.sessions(_activity_instants(spark, sf_dir)).where("n_events > 0")
    return found.select("user_id", "session_start_ms", "session_end_ms")


@registry.query(
    "p4_sessions",
    f"""{_SESSIONS} SELECT user_id, session_no::BIGINT AS session_no, min(ms) AS session_start_ms, max(ms) AS session_end_ms,
max(ms) - min(ms) AS duration_ms, count(*) AS n_events FROM numbered GROUP BY user_id, session_no""",
)
def p4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(_activity_instants(spark, sf_dir))


@registry.query(
    "p4_session_types",
    f"""{_SESSIONS} SELECT user_id, session_no::BIGINT AS session_no,
regexp_replace(regexp_replace(lower(activity_type), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g') AS activity_type,
count(*) AS n_activities FROM numbered GROUP BY ALL""",
)
def p4_session_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    instants = _activity_instants(spark, sf_dir, snake_key(F.col("activity_type")).alias("activity_type"))
    return sessions.session_type_counts(instants)


_JUDGED = """
WITH e AS (SELECT seq, event_id, stream_name, epoch_ms(timestamp) AS ms FROM user_events),
w AS (SELECT e.*, c.*  EXCLUDE (stream_name), max(ms) OVER (PARTITION BY e.stream_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - watermark_delay AS watermark
  FROM e JOIN time_window_config c ON e.stream_name = c.stream_name),
j AS (SELECT *, ms - ((ms % slide_interval) + slide_interval) % slide_interval AS last_start FROM w WHERE ms IS NOT NULL)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "user_events")
    return events.select("seq", "event_id", "stream_name", epoch_ms(F.col("timestamp")).alias("ms"))


#: Portions in which arrivals are read for p5_window_counts.
PORTIONS = 4


@registry.query("p5_found", f"{_JUDGED} SELECT seq FROM j WHERE watermark >= last_start + window_size + allowed_lateness")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lateness.too_late(_arrivals(spark, sf_dir), table(spark, sf_dir, "time_window_config")).select("seq")


@registry.query(
    "p5_window_counts",
    f"""{_JUDGED},
x AS (SELECT *, unnest(generate_series(last_start - (ceil(window_size / slide_interval)::BIGINT) * slide_interval, last_start, slide_interval)) AS window_start_ms FROM j)
SELECT stream_name, window_start_ms, window_start_ms + window_size AS window_end_ms, count(DISTINCT event_id) + count(*) FILTER (event_id IS NULL) AS n_events
FROM x WHERE ms < window_start_ms + window_size AND (watermark IS NULL OR watermark < window_start_ms + window_size + allowed_lateness) GROUP BY ALL""",
)
def p5_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers and counters of separately read portions, the last portion first and the first one twice, merged."""
    config, parts = table(spark, sf_dir, "time_window_config"), lateness.portions(_arrivals(spark, sf_dir), PORTIONS)
    merged = lateness.merged_registers(parts)
    states = [lateness.counters(part, config, merged) for part in reversed(parts)]
    return lateness.totals(lateness.merge_counters([*states, states[-1]]))
