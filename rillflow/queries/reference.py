"""Queries of the stream operators over whole tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import keys, validation
from rillflow.operators import combine, eventtime, keyed, media, results, sequence, timecontrol, transform
from rillflow.operators.eventtime import TimeJoinConfig, TimeWindowConfig
from rillflow.plans import metrics
from rillflow.plans.ordering import distributed, running_sums
from rillflow.plans.pipeline import Pipe, composed
from rillflow.queries.registry import Registry, table
from rillflow.sources import builders

registry = Registry()
query = registry.query

HOUR_US = 3_600_000_000
ORDER = ["event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def cents(c: Column | str) -> Column:
    return F.round(c, 2)


# Sources


@query("source_emit", "SELECT 0::BIGINT AS seq, 'hello' AS value")
def source_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.emit(spark, "hello", "value string")


@query("source_empty", "SELECT 0::BIGINT AS value WHERE false")
def source_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.empty(spark, "value bigint")


@query("source_from_rows", "SELECT i::BIGINT AS seq, (i * i)::BIGINT AS value FROM range(1000) t(i)")
def source_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.from_rows(spark, (i * i for i in range(1000)), "value bigint")


@query("source_repeat", "SELECT i::BIGINT AS seq, 'x' AS value FROM range(10000) t(i)")
def source_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.repeat(spark, F.lit("x"), 10_000)


@query("source_unfold", "WITH RECURSIVE u AS (SELECT 0::BIGINT AS seq, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT seq + 1, b, a + b FROM u WHERE seq < 39) SELECT * FROM u")
def source_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.unfold(spark, "a, b", "0L, 1L", "b, a + b", "seq < 39")


@query("source_tick", "SELECT epoch_ms(t) AS ms, 'tick' AS value FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 1 MINUTE) g(t)")
def source_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = builders.tick(spark, F.lit("tick"), "2024-01-01 00:00:00", "2024-01-02 00:00:00", "1 minute")
    return ticks.select(F.unix_millis("ts").alias("ms"), "value")


@query("source_emit_after", "SELECT 0::BIGINT AS seq, 'late' AS value, epoch_ms(TIMESTAMP '2024-01-01 00:00:05') AS emit_ms")
def source_emit_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = builders.emit_after(spark, "late", "value string", "2024-01-01 00:00:00", "5 seconds")
    return late.select("seq", "value", F.unix_millis("emit_ts").alias("emit_ms"))


@query("source_file_chunks")
def source_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.file_chunks(spark, f"{sf_dir}/lineitem.parquet", "lineitem", 1 << 16).drop("data")


@query(
    "source_live_chunks",
    """SELECT 'camera' AS stream_id, i::BIGINT AS sequence_number, (i * 33)::BIGINT AS timestamp_ms, 1024 AS n_bytes,
CASE WHEN i % 30 = 0 THEN 'VideoIFrame' WHEN i % 3 = 0 THEN 'VideoBFrame' ELSE 'VideoPFrame' END AS chunk_type,
CASE WHEN i % 30 = 0 THEN 'High' WHEN i % 3 = 0 THEN 'Low' ELSE 'Normal' END AS priority, sha256(repeat(chr(0), 1024)) AS checksum FROM range(300) t(i)""",
)
def source_live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = builders.live_chunks(spark, "camera", 300, 1024)
    return chunks.select("stream_id", "sequence_number", "timestamp_ms", F.octet_length("data").alias("n_bytes"), "chunk_type", "priority", "checksum")


# Projection, filter, expansion


@query("map_filter", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity % 4 = 0")
def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = transform.filtered(table(spark, sf_dir, "lineitem"), F.col("l_quantity") % 4 == 0)
    return transform.mapped(kept, l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), twice=F.col("l_quantity") * 2)


@query("flat_map_words", "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents")
def flat_map_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    return transform.flat_mapped(table(spark, sf_dir, "documents"), words, "word", keep=["doc_id"])


@query("filter_map", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return transform.filter_mapped(events(spark, sf_dir), F.when(k % 2 == 0, k), "k", keep=["event_id"])


@query("eval_map", "SELECT event_id, round(sqrt(abs(value)), 4) AS root FROM events")
def eval_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def root(rows):  # noqa: ANN001, ANN202
        return rows[["event_id"]].assign(root=rows["value"].abs() ** 0.5)

    out = transform.eval_mapped(events(spark, sf_dir).select("event_id", "value"), root, "event_id bigint, root double")
    return out.withColumn("root", F.round("root", 4))


@query("map_parallel", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def map_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"o_orderkey": F.col("o_orderkey"), "twice": F.col("o_totalprice") * 2}
    return transform.map_parallel(table(spark, sf_dir, "orders"), columns, concurrency=8)


@query("par_eval_map", "SELECT event_id, round(value * value, 4) AS square FROM events")
def par_eval_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.map_parallel(events(spark, sf_dir), {"event_id": F.col("event_id"), "square": F.round(F.col("value") * F.col("value"), 4)}, concurrency=16)


@query("batch_process", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY (rn - 1) // 500), 4) AS centred FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events)")
def batch_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    def centre(chunk):  # noqa: ANN001, ANN202
        return chunk[["event_id"]].assign(centred=chunk["value"] - chunk["value"].mean())

    out = transform.batch_processed(events(spark, sf_dir).select("event_id", "value"), [F.col("event_id")], 500, centre, "event_id bigint, centred double")
    return out.withColumn("centred", F.round("centred", 4) + 0.0)


@query("distinct_by", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def distinct_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.distinct_by(events(spark, sf_dir).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ORDER)


@query("pipes", "SELECT event_id, value * 3 AS tripled FROM events WHERE event_type = 'click'")
def pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = composed([Pipe.identity(), Pipe.filter(F.col("event_type") == "click"), Pipe.map(event_id=F.col("event_id"), tripled=F.col("value") * 3)])
    return clicks.apply(events(spark, sf_dir))


# Slicing


@query("take", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.take(events(spark, sf_dir).select("event_id", "value"), ORDER, 100)


@query("drop", "SELECT event_id, value FROM events ORDER BY event_id OFFSET 100")
def drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.drop(events(spark, sf_dir).select("event_id", "value"), ORDER, 100)


_WHILE = "SELECT event_id, value FROM (SELECT *, bool_and(value < 100) OVER (ORDER BY event_id) AS still FROM events) WHERE {}"


@query("take_while", _WHILE.format("still"))
def take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.take_while(events(spark, sf_dir).select("event_id", "value"), ORDER, F.col("value") < 100)


@query("drop_while", _WHILE.format("NOT still"))
def drop_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.drop_while(events(spark, sf_dir).select("event_id", "value"), ORDER, F.col("value") < 100)


@query("interrupt_when", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15'")
def interrupt_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.interrupt_when(events(spark, sf_dir), "ts", F.expr("timestamp '2024-01-15'")).select("event_id")


# Chunks, windows over counts, runs


@query("chunk", "SELECT (rn - 1) // 100 AS chunk_no, count(*) AS n, round(sum(value), 2) AS total, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = sequence.chunk(events(spark, sf_dir), ORDER, 100, ["event_id", "value"])
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["value"])
    return chunks.select("chunk_no", "n", cents(total).alias("total"), F.col("items")[0]["event_id"].alias("first_id"))


@query("sliding_window", "SELECT rn, round(total, 2) AS total FROM (SELECT row_number() OVER (ORDER BY event_id) AS rn, sum(value) OVER (ORDER BY event_id ROWS 4 PRECEDING) AS total FROM events) WHERE rn >= 5")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.sliding_aggregate(events(spark, sf_dir).select("event_id", "value"), ORDER, 5, total=F.sum("value"))
    return out.select("rn", cents("total").alias("total"))


@query("sliding_window_items", "SELECT rn, ids FROM (SELECT row_number() OVER w0 AS rn, string_agg(event_id::VARCHAR, ',') OVER (ORDER BY event_id ROWS 2 PRECEDING) AS ids FROM events WINDOW w0 AS (ORDER BY event_id)) WHERE rn >= 3")
def sliding_window_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.sliding_window(events(spark, sf_dir), ORDER, 3, ["event_id"])
    return out.select("rn", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


_RUNS = """WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (ORDER BY event_id)::BIGINT AS run FROM m)"""


@query("group_adjacent_by", f"{_RUNS} SELECT run, event_type AS key, count(*) AS n, min(event_id) AS first_id, round(sum(value), 2) AS total FROM r GROUP BY ALL")
def group_adjacent_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.adjacent_aggregate(
        events(spark, sf_dir), ORDER, F.col("event_type"), n=F.count(F.lit(1)), first_id=F.min("event_id"), total=F.sum("value")
    )
    return out.withColumn("total", cents("total"))


@query("group_by_items", f"{_RUNS} SELECT run, event_type AS key, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM r GROUP BY ALL")
def group_by_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequence.group_adjacent_by(events(spark, sf_dir), ORDER, F.col("event_type"), ["event_id"])
    return runs.select("run", "key", "n", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("hash_group_by", "SELECT event_type, count(*) AS n, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS ids FROM events GROUP BY 1")
def hash_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = sequence.hash_group_by(events(spark, sf_dir), ["event_type"], ORDER, ["event_id"])
    return groups.select("event_type", "n", F.md5(F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",")).alias("ids"))


@query("distinct_until_changed", f"{_RUNS} SELECT event_id, event_type FROM r WHERE fresh = 1")
def distinct_until_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.distinct_until_changed(events(spark, sf_dir).select("event_id", "event_type"), ORDER, F.col("event_type"))


@query("distinct_until_changed_by_key", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def distinct_until_changed_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.distinct_until_changed(events(spark, sf_dir).select("event_id", "user_id", "event_type"), ORDER, F.col("event_type"), key=["user_id"])


@query("distinct_until_changed_by", "SELECT event_id, user_id FROM (SELECT *, lag(user_id % 2) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM user_id % 2")
def distinct_until_changed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of equal parity are equal: an equality that compares a projection."""
    return sequence.distinct_until_changed(events(spark, sf_dir).select("event_id", "user_id"), ORDER, F.col("user_id") % 2)


_KEPT_BY = """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
k AS (SELECT event_id, user_id, rn, value AS last, true AS kept FROM e WHERE rn = 1 UNION ALL
SELECT e.event_id, e.user_id, e.rn, CASE WHEN abs(e.value - k.last) >= 50 THEN e.value ELSE k.last END, abs(e.value - k.last) >= 50 FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT event_id, user_id FROM k WHERE kept"""


@query("distinct_until_changed_by_function", _KEPT_BY)
def distinct_until_changed_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values near the last kept are equal to it, which is no projection; per user."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "value")
    return keyed.distinct_until_changed_by(rows, ORDER, F.col("value"), lambda last, v: abs(v - last) < 50, key=["user_id"]).drop("value")


# Running and total aggregates


@query("scan", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 2) AS total, count(*) OVER (ORDER BY event_id) AS n FROM events")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.scan(events(spark, sf_dir).select("event_id", "value"), ORDER, total=F.col("value"), n=F.lit(1).cast("bigint"))
    return out.select("event_id", cents("total").alias("total"), "n")


@query("scan_extremes", "SELECT event_id, min(value) OVER (ORDER BY event_id) AS running_min, max(value) OVER (ORDER BY event_id) AS running_max FROM events")
def scan_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.running_extremes(events(spark, sf_dir).select("event_id", "value"), ORDER, F.col("value")).drop("value")


@query("fold", "SELECT round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem")
def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.fold(table(spark, sf_dir, "lineitem"), total=F.round(F.sum("l_extendedprice"), 2), n=F.count(F.lit(1)))


@query("reduce", "SELECT max(value) AS value FROM events")
def reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.fold(events(spark, sf_dir), value=F.max("value"))


@query("ordered_fold", "SELECT (list_reduce(list_prepend(0::BIGINT, list(event_id::BIGINT ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003))::BIGINT AS value FROM events")
def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step is a linear map; blocks of rows give linear maps, which are combined in order."""

    def linear(m: Column, a: Column) -> Column:
        return F.struct((m % 1000003).alias("m"), (a % 1000003).alias("a"))

    one = F.struct(F.lit(1).cast("bigint").alias("m"), F.lit(0).cast("bigint").alias("a"))
    out = sequence.ordered_fold(
        events(spark, sf_dir), ORDER, F.col("event_id").cast("bigint"), one, lambda f, x: linear(f["m"] * 31, f["a"] * 31 + x),
        combine=lambda f, g: linear(f["m"] * g["m"], f["a"] * g["m"] + g["a"]),
    )
    return out.select("value.a").withColumnRenamed("a", "value")


# Several streams


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    return rows.where("event_type IN ('click', 'view')"), rows.where("event_type NOT IN ('click', 'view')")


_HALVES = "WITH a AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE event_type IN ('click', 'view')), b AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE event_type NOT IN ('click', 'view'))"


@query("concat", f"{_HALVES} SELECT event_id, event_type, value, 0 AS src FROM a UNION ALL SELECT event_id, event_type, value, 1 FROM b")
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.concat(_halves(spark, sf_dir))


@query("merge", f"{_HALVES} SELECT event_id, event_type, value, 0 AS src FROM a UNION ALL SELECT event_id, event_type, value, 1 FROM b")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.merge(*_halves(spark, sf_dir))


@query("either", "SELECT event_id, event_type, value FROM events")
def either(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.either(*_halves(spark, sf_dir))


@query("par_join", "SELECT event_id, event_type, value FROM events")
def par_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.par_join(_halves(spark, sf_dir))


@query("interleave", f"{_HALVES} SELECT event_id, event_type, value, rn AS turn, 0 AS src FROM a UNION ALL SELECT event_id, event_type, value, rn, 1 FROM b")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.interleave(_halves(spark, sf_dir), ORDER)


@query("zip", f"{_HALVES} SELECT a.rn, a.event_id AS left_id, b.event_id AS right_id FROM a JOIN b ON a.rn = b.rn")
def zip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return combine.zipped(a, b, ORDER, ORDER).select("rn", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query("zip_with", f"{_HALVES} SELECT a.rn, round(a.value - b.value, 2) AS difference FROM a JOIN b ON a.rn = b.rn")
def zip_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return combine.zip_with(a, b, ORDER, ORDER, difference=cents(F.col("left.value") - F.col("right.value")) + 0.0)


# Time and rate


@query("throttle", "SELECT event_id, 60000000 * (rn - 1) + max(epoch_us(ts) - 60000000 * (rn - 1)) OVER (ORDER BY event_id) AS emit_us FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events)")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timecontrol.throttle(events(spark, sf_dir).select("event_id", "ts"), ORDER, "ts", 60_000_000).drop("ts")


@query("debounce", "SELECT event_id FROM (SELECT event_id, lead(ts) OVER (ORDER BY event_id) - ts AS gap FROM events) WHERE gap IS NULL OR gap > INTERVAL 5 MINUTE")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timecontrol.debounce(events(spark, sf_dir).select("event_id", "ts"), ORDER, "ts", 300_000_000).drop("ts")


@query("sample", "SELECT epoch_us(ts) // 3600000000 AS interval_no, max(event_id) AS event_id FROM events GROUP BY 1")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timecontrol.sample(events(spark, sf_dir).select("event_id", "ts"), ORDER, "ts", HOUR_US).select("interval_no", "event_id")


@query(
    "timeout",
    """WITH g AS (SELECT epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (ORDER BY event_id) AS last FROM events)
SELECT event_id, epoch_us(ts) AS us, NULL::VARCHAR AS err_kind FROM events UNION ALL
SELECT NULL, last + k * 600000000, 'Timeout' FROM (SELECT last, unnest(range(1, (us - last) // 600000000 + 1)) AS k FROM g WHERE us - last >= 600000000)""",
)
def timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timecontrol.timeout(events(spark, sf_dir).select("event_id", "ts"), ORDER, "ts", 600_000_000)
    return out.select("event_id", F.unix_micros("ts").alias("us"), "err_kind")


_BUCKETS = "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY event_id {}) AS rn FROM events) WHERE rn <= 5"


def _hour() -> Column:
    return F.floor(F.unix_micros("ts") / HOUR_US)


@query("backpressure_drop_oldest", _BUCKETS.format("DESC"))
def backpressure_drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timecontrol.backpressure(events(spark, sf_dir), ORDER, _hour(), 5, "drop_oldest").select("event_id")


@query("backpressure_drop_newest", _BUCKETS.format(""))
def backpressure_drop_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timecontrol.backpressure(events(spark, sf_dir), ORDER, _hour(), 5, "drop_newest").select("event_id")


@query("backpressure_block", "SELECT event_id FROM events")
def backpressure_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timecontrol.prefetch(timecontrol.backpressure(events(spark, sf_dir), ORDER, _hour())).select("event_id")


@query("auto_backpressure", "SELECT event_id FROM events")
def auto_backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timecontrol.auto_backpressure(events(spark, sf_dir), ORDER, _hour()).select("event_id")


@query("backpressure_error", "SELECT event_id FROM events")
def backpressure_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timecontrol.backpressure(events(spark, sf_dir), ORDER, _hour(), 1_000_000, "error").select("event_id")


# Event time


DAY = TimeWindowConfig(24 * HOUR_US, 24 * HOUR_US)


@query(
    "window_by_time_daily",
    """SELECT epoch_ms(date_trunc('day', ts)) AS start_ms, count(*) AS event_count, count(DISTINCT user_id) AS unique_users,
count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, round(sum(value), 2) AS total FROM events GROUP BY 1""",
)
def window_by_time_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = {
        "event_count": F.count(F.lit(1)), "unique_users": F.count_distinct("user_id"), "clicks": F.count_if(F.col("event_type") == "click"),
        "purchases": F.count_if(F.col("event_type") == "purchase"), "total": F.sum("value"),
    }
    out = eventtime.window_by_time(events(spark, sf_dir), "ts", DAY, statistics)
    return out.select(F.unix_millis("window_start").alias("start_ms"), "event_count", "unique_users", "clicks", "purchases", cents("total").alias("total"))


@query(
    "window_by_time_sliding",
    """SELECT s * 3600000 AS start_ms, event_type, count(*) AS n FROM (SELECT event_type, unnest(range(epoch_ms(ts) // 3600000 - 5, epoch_ms(ts) // 3600000 + 1)) AS s FROM events) GROUP BY ALL""",
)
def window_by_time_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = eventtime.window_by_time(events(spark, sf_dir), "ts", TimeWindowConfig(6 * HOUR_US, HOUR_US), {"n": F.count(F.lit(1))}, by=["event_type"])
    return out.select(F.unix_millis("window_start").alias("start_ms"), "event_type", "n")


@query(
    "window_by_arrival",
    """WITH w AS (SELECT event_id, value, epoch_ms(ts) AS ms, max(epoch_ms(ts)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60000 AS mark FROM events),
x AS (SELECT *, unnest([ms // 600000 * 600000, ms // 600000 * 600000 - 600000]) AS s FROM w)
SELECT s AS start_ms, count(*) AS n, round(sum(value), 2) AS total FROM x WHERE ms < s + 1200000 AND (mark IS NULL OR mark < s + 1200000 + 120000) GROUP BY 1""",
)
def window_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = 60_000_000
    rows = events(spark, sf_dir).select("event_id", "ts", "value")
    out = eventtime.window_by_arrival(rows, "event_id", "ts", TimeWindowConfig(20 * minute, 10 * minute, minute, 2 * minute), {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return out.select(F.unix_millis("window_start").alias("start_ms"), "n", cents("total").alias("total"))


@query("windows_completed", "SELECT epoch_ms(date_trunc('day', ts)) AS start_ms, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)")
def windows_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    windows = eventtime.window_by_time(rows, "ts", DAY, {"n": F.count(F.lit(1))})
    greatest = rows.agg(F.max("ts").alias("m")).first().m
    done = eventtime.completed(windows, F.lit(greatest) - F.expr("interval 10 seconds"))
    return done.select(F.unix_millis("window_start").alias("start_ms"), "n")


def _clicks_purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    return rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'")


_PAIRS = "SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON {} abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {} WHERE a.event_type = 'click' AND b.event_type = 'purchase'"


def _pair_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("left.event_id").alias("click_id"), F.col("right.event_id").alias("purchase_id"))


@query("join_with_time_window", _PAIRS.format("a.user_id = b.user_id AND", 6 * HOUR_US))
def join_with_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_ids(eventtime.join_with_time_window(*_clicks_purchases(spark, sf_dir), "ts", "ts", TimeJoinConfig(6 * HOUR_US), ["user_id"]))


@query("join_with_time_window_keyless", _PAIRS.format("", 600_000_000))
def join_with_time_window_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_ids(eventtime.join_with_time_window(*_clicks_purchases(spark, sf_dir), "ts", "ts", TimeJoinConfig(600_000_000)))


@query("stateful_join", _PAIRS.format("a.user_id = b.user_id AND", HOUR_US))
def stateful_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_ids(keyed.stateful_join(*_clicks_purchases(spark, sf_dir), ["user_id"], "ts", "ts", HOUR_US))


# Keyed state


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value")


_BY_USER = "(PARTITION BY user_id ORDER BY event_id)"


@query("stateful_map", f"SELECT event_id, count(*) OVER {_BY_USER} AS seen, round(sum(value) OVER {_BY_USER}, 2) AS spent FROM events")
def stateful_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_map(_keyed(spark, sf_dir), ["user_id"], ORDER, seen=F.count(F.lit(1)), spent=F.sum("value"))
    return out.select("event_id", "seen", cents("spent").alias("spent"))


@query("stateful_filter", f"SELECT event_id FROM (SELECT event_id, value, avg(value) OVER {_BY_USER} AS mean FROM events) WHERE round(value - 2 * mean, 6) > 0")
def stateful_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_filter(_keyed(spark, sf_dir), ["user_id"], ORDER, {"mean": F.avg("value")}, F.round(F.col("value") - 2 * F.col("mean"), 6) > 0)
    return out.select("event_id")


_FOLD = f"SELECT event_id, user_id, round(sum(value) OVER {_BY_USER}, 2) AS total FROM events"


@query("stateful_fold", _FOLD)
def stateful_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_fold(_keyed(spark, sf_dir), ["user_id"], ORDER, total=F.col("value"))
    return out.select("event_id", "user_id", cents("total").alias("total"))


@query("stateful_fold_spread", _FOLD)
def stateful_fold_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_fold(_keyed(spark, sf_dir), ["user_id"], ORDER, spread=True, total=F.col("value"))
    return out.select("event_id", "user_id", cents("total").alias("total"))


@query("stateful_reduce", f"SELECT event_id, max(value) OVER {_BY_USER} AS best FROM events")
def stateful_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.stateful_reduce(_keyed(spark, sf_dir), ["user_id"], ORDER, best=F.max("value")).select("event_id", "best")


_FOLDED = """WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT event_id, user_id, rn, (7 * 31 + event_id) % 1000003 AS state FROM e WHERE rn = 1 UNION ALL
SELECT e.event_id, e.user_id, e.rn, (f.state * 31 + e.event_id) % 1000003 FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT event_id, state::BIGINT AS state FROM f"""


@query("stateful_fold_function", _FOLDED)
def stateful_fold_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any function from its own start value, every state emitted."""

    def step(state: int, x: int) -> tuple[int, tuple[int]]:
        state = (state * 31 + x) % 1000003
        return state, (state,)

    rows = _keyed(spark, sf_dir).select("event_id", "user_id")
    return keyed.keyed_scan(rows, ["user_id"], ORDER, [F.col("event_id")], 7, step, "state bigint").drop("user_id")


@query("stateful_reduce_function", f"SELECT event_id, round(max(value) OVER {_BY_USER} * 2, 2) AS twice_best FROM events")
def stateful_reduce_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, sf_dir).select("event_id", "user_id", "value")
    out = keyed.keyed_reduce(rows, ["user_id"], ORDER, F.col("value") * 2, max, "best double")
    return out.select("event_id", cents("best").alias("twice_best"))


@query("stateful_session", f"""SELECT event_id, is_new, 1 + sum(is_new::INT) OVER {_BY_USER}::BIGINT AS session_id FROM
(SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER {_BY_USER} > {6 * HOUR_US}, false) AS is_new FROM events)""")
def stateful_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.stateful_session(_keyed(spark, sf_dir), ["user_id"], ORDER, "ts", 6 * HOUR_US).select("event_id", "is_new", "session_id")


@query("session_windows", f"""SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER {_BY_USER} AS s FROM
(SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER {_BY_USER} <= {6 * HOUR_US} THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.session_windows(_keyed(spark, sf_dir), ["user_id"], "ts", "6 hours", {"n": F.count(F.lit(1))})
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


_RANKED = f"SELECT *, row_number() OVER {_BY_USER} AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM events"


@query("stateful_window", f"SELECT user_id, (rn - 1) // 10 AS window_no, count(*) AS n_rows, round(sum(value), 2) AS total FROM ({_RANKED}) WHERE rn <= c // 10 * 10 GROUP BY ALL")
def stateful_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_window(_keyed(spark, sf_dir), ["user_id"], ORDER, 10, {"total": F.sum("value")})
    return out.withColumn("total", cents("total"))


_WINDOWS = f"""WITH r AS ({_RANKED}), f AS (SELECT *, CASE WHEN c < 10 THEN 0 ELSE (c - 10) // 4 + 1 END AS full_windows FROM r),
k AS (SELECT *, unnest(range(0, full_windows)) AS window_no FROM f),
w AS (SELECT user_id, window_no, value FROM k WHERE rn > window_no * 4 AND rn <= window_no * 4 + 10{{}})
SELECT user_id, window_no, count(*) AS n_rows, round(sum(value), 2) AS total FROM w GROUP BY ALL"""


@query("stateful_window_sliding", _WINDOWS.format(""))
def stateful_window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_window(_keyed(spark, sf_dir), ["user_id"], ORDER, 10, {"total": F.sum("value")}, slide=4)
    return out.withColumn("total", cents("total"))


@query("stateful_window_partial", _WINDOWS.format(" UNION ALL SELECT user_id, full_windows, value FROM f WHERE rn > full_windows * 4"))
def stateful_window_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_window(_keyed(spark, sf_dir), ["user_id"], ORDER, 10, {"total": F.sum("value")}, slide=4, emit_partial=True)
    return out.withColumn("total", cents("total"))


@query("stateful_pattern", f"SELECT * FROM (SELECT user_id, (rn - 1) // 3 AS batch_no, string_agg(event_type, '>' ORDER BY rn) AS result FROM ({_RANKED}) GROUP BY ALL HAVING count(*) = 3) WHERE result LIKE '%click%purchase%'")
def stateful_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    def funnel(items: Column) -> Column:
        path = F.array_join(items, ">")
        return F.when(path.like("%click%purchase%"), path)

    return keyed.stateful_pattern(_keyed(spark, sf_dir), ["user_id"], ORDER, 3, "event_type", funnel)


@query("stateful_group_by", f"SELECT user_id, (rn - 1) // 25 AS group_no, count(*) AS n_rows, round(sum(value), 2) AS total FROM ({_RANKED}) GROUP BY ALL")
def stateful_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_group_by(_keyed(spark, sf_dir), ["user_id"], ORDER, {"total": F.sum("value")}, max_size=25)
    return out.withColumn("total", cents("total"))


@query("stateful_group_by_key_change", f"{_RUNS} SELECT run, event_type, (p - 1) // 2 AS group_no, count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) AS p FROM r) GROUP BY ALL")
def stateful_group_by_key_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.stateful_group_by(_keyed(spark, sf_dir), ["event_type"], ORDER, {}, max_size=2, emit_on_key_change=True)


_GREEDY = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
kept AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id UNION ALL
SELECT k.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us > k.us + {ttl}) FROM kept k WHERE k.us IS NOT NULL)"""


@query("stateful_deduplicate", _GREEDY.format(ttl=72 * HOUR_US) + " SELECT e.event_id, e.user_id FROM e JOIN kept k ON e.user_id = k.user_id AND e.us = k.us")
def stateful_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return keyed.stateful_deduplicate(rows, ["user_id"], ["ts", "event_id"], "ts", 72 * HOUR_US).select("event_id", "user_id")


@query(
    "stateful_group_by_timeout",
    _GREEDY.format(ttl=72 * HOUR_US) + " SELECT e.event_id, e.user_id, count(*) - 1 AS group_no FROM e JOIN kept k ON e.user_id = k.user_id AND k.us <= e.us GROUP BY ALL",
)
def stateful_group_by_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return keyed.stateful_group_by_timeout(rows, ["user_id"], ["ts", "event_id"], "ts", 72 * HOUR_US).select("event_id", "user_id", "group_no")


_TIMED = """WITH RECURSIVE r AS (SELECT *, epoch_us(ts) AS us FROM events), m AS (SELECT *, CASE WHEN user_id % 3 IS NOT DISTINCT FROM lag(user_id % 3) OVER (ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM r),
e AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS rn FROM (SELECT *, sum(fresh) OVER (ORDER BY ts, event_id) AS run FROM m)),
g AS (SELECT run, user_id % 3 AS k, rn, us AS start, 1 AS n, 0 AS group_no FROM e WHERE rn = 1 UNION ALL
SELECT e.run, g.k, e.rn, CASE WHEN e.us - g.start > {limit} OR g.n >= 2 THEN e.us ELSE g.start END, CASE WHEN e.us - g.start > {limit} OR g.n >= 2 THEN 1 ELSE g.n + 1 END,
CASE WHEN e.us - g.start > {limit} OR g.n >= 2 THEN g.group_no + 1 ELSE g.group_no END FROM g JOIN e ON e.run = g.run AND e.rn = g.rn + 1)
SELECT run::BIGINT AS run, k, group_no::BIGINT AS group_no, count(*) AS n_rows FROM g GROUP BY ALL""".format(limit=600_000_000)


@query("stateful_group_by_advanced", _TIMED)
def stateful_group_by_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups end at two rows, after ten minutes, or where the next row has another key."""
    rows = events(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 3).alias("k"))
    return keyed.stateful_group_by_advanced(rows, ["k"], ["ts", "event_id"], "ts", {}, max_size=2, timeout_us=600_000_000, emit_on_key_change=True)


_THROTTLED = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
t AS (SELECT event_id, user_id, rn, us AS window_start_us, 1 AS n_in_window, false AS throttled, us AS emit_us FROM e WHERE rn = 1 UNION ALL
SELECT event_id, user_id, rn, CASE WHEN over THEN emit ELSE start END, CASE WHEN over THEN 1 ELSE n + 1 END, over, greatest(emit, us)
FROM (SELECT *, CASE WHEN over AND start + {w} - us > 0 AND start + {w} - us < 1000000 THEN start + {w} ELSE us END AS emit
FROM (SELECT *, n >= 3 AS over FROM (SELECT e.*, CASE WHEN e.us - t.window_start_us > {w} THEN e.us ELSE t.window_start_us END AS start, CASE WHEN e.us - t.window_start_us > {w} THEN 0 ELSE t.n_in_window END AS n
FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1))))
SELECT event_id, user_id, window_start_us, n_in_window::BIGINT AS n_in_window, throttled, emit_us FROM t""".format(w=24 * HOUR_US)


@query("stateful_throttle", _THROTTLED)
def stateful_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return keyed.stateful_throttle(rows, ["user_id"], ["ts", "event_id"], "ts", 3, 24 * HOUR_US).drop("ts")


@query("field_key", "SELECT event_id, coalesce(event_type, 'null') AS k1, 'missing_field_nothing' AS k2 FROM events")
def field_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.select("event_id", keys.field_key(rows, "event_type").alias("k1"), keys.field_key(rows, "nothing").alias("k2"))


# Errors as data


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "value")
    return results.attempt(rows, F.when(F.col("value") >= 5, F.col("value")), "Custom", F.concat(F.lit("small "), F.col("event_id")))


@query("recover", "SELECT event_id, CASE WHEN value >= 5 THEN value ELSE -1 END AS ok FROM events")
def recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.recover(_attempts(spark, sf_dir), F.lit(-1.0)).select("event_id", "ok")


@query("or_else", "SELECT event_id, CASE WHEN value >= 5 THEN floor(value)::BIGINT::VARCHAR ELSE 'small ' || event_id END AS ok FROM events")
def or_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = _attempts(spark, sf_dir).withColumn("ok", F.floor("ok").cast("string"))
    return results.or_else(tried, F.col("err.message")).select("event_id", "ok")


@query("on_error_resume_next", "SELECT event_id, 0 AS resume_no, value AS ok FROM events WHERE value >= 5 UNION ALL SELECT event_id, i, i::DOUBLE FROM events, range(2) t(i) WHERE value < 5")
def on_error_resume_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.on_error_resume_next(_attempts(spark, sf_dir), F.array(F.lit(0.0), F.lit(1.0))).select("event_id", "resume_no", "ok")


@query("map_error", "SELECT event_id, 'IO: small ' || event_id AS message FROM events WHERE value < 5")
def map_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.map_error(_attempts(spark, sf_dir), "IO", F.col("err.message")).where("err IS NOT NULL")
    return out.select("event_id", F.concat("err.kind", F.lit(": "), "err.message").alias("message"))


@query("collect_ok", "SELECT count(*)::INT AS n, md5(string_agg(floor(value * 100)::BIGINT::VARCHAR, ',' ORDER BY event_id)) AS digest FROM events WHERE value >= 5")
def collect_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = results.collect_ok(_attempts(spark, sf_dir), ORDER)
    digest = F.md5(F.array_join(F.transform("values", lambda x: F.floor(x * 100).cast("string")), ","))
    return got.select(F.size("values").alias("n"), digest.alias("digest"))


@query("collect_err", "SELECT count(*)::INT AS n, md5(string_agg('small ' || event_id, ',' ORDER BY event_id)) AS digest FROM events WHERE value < 5")
def collect_err(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = results.collect_err(_attempts(spark, sf_dir), ORDER)
    digest = F.md5(F.array_join(F.transform("values", lambda x: x["message"]), ","))
    return got.select(F.size("values").alias("n"), digest.alias("digest"))


@query(
    "retry",
    """WITH bad AS (SELECT i, (SELECT min(event_id) FROM events WHERE value < 5 - 2 * i) AS stop FROM range(3) t(i))
SELECT i::INT AS attempt, event_id FROM bad, events WHERE (stop IS NULL OR event_id <= stop)
AND i <= coalesce((SELECT min(i) FROM bad WHERE stop IS NULL), 2)""",
)
def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "value")

    def stream(number: int) -> DataFrame:
        return results.attempt(rows, F.when(F.col("value") >= 5 - 2 * number, F.col("value")), "IO", "small")

    return results.retry(stream, ORDER, 2).select("attempt", "event_id")


# Validation, metrics


PROPS_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}}}
_VALID = "json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'INTEGER') AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 90"


@query("schema_validation", f"SELECT event_id FROM events WHERE {_VALID}")
def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.with_schema_validation(events(spark, sf_dir), F.col("props"), PROPS_SCHEMA)[0].select("event_id")


@query("schema_validation_flat", f"SELECT event_id FROM events WHERE {_VALID}")
def schema_validation_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(validation.valid_flat(F.col("props"), PROPS_SCHEMA)).select("event_id")


@query("with_metrics", "SELECT count(*) AS items, sum(length(props))::BIGINT AS bytes, count(*) FILTER (event_type = 'error') AS errors FROM events")
def with_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, seen = metrics.with_metrics(events(spark, sf_dir), "events", F.length("props"), F.col("event_type") == "error")
    observed.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["items"], got["bytes"], got["errors"])], "items bigint, bytes bigint, errors bigint")


# Media


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "media_chunks")


@query("media_checksum", "SELECT delivery_id, sha256(data) AS checksum FROM media_chunks")
def media_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("delivery_id", F.sha2("data", 256).alias("checksum"))


@query(
    "media_validation",
    """SELECT delivery_id, CASE WHEN stream_id IS NULL OR trim(stream_id) = '' THEN 'empty stream id' WHEN data IS NULL OR octet_length(data) = 0 THEN 'empty data'
WHEN lower(checksum) <> sha256(data) THEN 'wrong checksum' WHEN chunk_type = 'Audio' AND octet_length(data) > 65536 THEN 'audio chunk too large'
WHEN chunk_type LIKE 'Video%' AND octet_length(data) > 1048576 THEN 'video chunk too large' END AS err FROM media_chunks""",
)
def media_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.validated(_chunks(spark, sf_dir)).select("delivery_id", "err")


@query("media_types", "SELECT delivery_id, CASE WHEN chunk_type IN ('VideoIFrame', 'Audio', 'Metadata') THEN 'High' WHEN chunk_type = 'VideoPFrame' THEN 'Normal' WHEN chunk_type IN ('VideoBFrame', 'Thumbnail') THEN 'Low' END AS priority, CASE WHEN sequence_number % 30 = 0 THEN 'VideoIFrame' WHEN sequence_number % 3 = 0 THEN 'VideoBFrame' ELSE 'VideoPFrame' END AS by_number FROM media_chunks")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return chunks.select("delivery_id", media.default_priority(F.col("chunk_type")).alias("priority"), media.chunk_type_of(F.col("sequence_number")).alias("by_number"))


_HALF, _QUARTER = "regexp_replace(hex({}), '(..)(..)?', '\\1', 'g')", "regexp_replace(hex({}), '(..)(..)?(..)?(..)?', '\\1', 'g')"


def _digest(data: Column) -> Column:
    return F.md5(F.hex(data))


@query("media_encode", f"SELECT delivery_id, md5({_HALF.format('data')}) AS video, md5({_QUARTER.format('data')}) AS audio FROM media_chunks")
def media_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("data")
    return _chunks(spark, sf_dir).select("delivery_id", _digest(media.encode_video(data)).alias("video"), _digest(media.encode_audio(data)).alias("audio"))


_TIMES = "regexp_replace({}, '(..)', '{}', 'g')"


@query(
    "media_decode",
    f"""SELECT delivery_id, CASE WHEN lower(checksum) <> sha256(data) THEN 'wrong checksum' END AS err, CASE WHEN checksum IS NULL OR lower(checksum) = sha256(data) THEN
md5(CASE WHEN chunk_type = 'Metadata' THEN hex(data) WHEN chunk_type = 'Audio' THEN {_TIMES.format("hex(data)", chr(92) + "1" + chr(92) + "1" + chr(92) + "1" + chr(92) + "1")} ELSE {_TIMES.format("hex(data)", chr(92) + "1" + chr(92) + "1")} END) END AS decoded FROM media_chunks""",
)
def media_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decoded(_chunks(spark, sf_dir)).select("delivery_id", "err", _digest(F.col("decoded")).alias("decoded"))


_NUMBER = "regexp_replace(upper(printf('%08x', {})), '(..)(..)(..)(..)', '\\4\\3\\2\\1')"


@query(
    "media_mixed",
    f"""SELECT delivery_id, md5({_NUMBER.format('length(v) // 2')} || {_NUMBER.format('length(a) // 2')} || v || a) AS mixed, md5(v) AS video, md5(a) AS audio FROM (
SELECT delivery_id, {_HALF.format('data[:cut]').replace('hex(data[:cut])', 'substr(hex(data), 1, 2 * cut)')} AS v, {_QUARTER.format('x').replace('hex(x)', 'substr(hex(data), 2 * cut + 1)')} AS a
FROM (SELECT delivery_id, data, floor(octet_length(data) * 0.6::DOUBLE)::BIGINT AS cut FROM media_chunks WHERE octet_length(data) >= 2))""",
)
def media_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _chunks(spark, sf_dir).select("delivery_id", media.encode_mixed(F.col("data")).alias("mixed")).where("mixed IS NOT NULL")
    video, audio = media.split_mixed(F.col("mixed"))
    return mixed.select("delivery_id", _digest(F.col("mixed")).alias("mixed"), _digest(video).alias("video"), _digest(audio).alias("audio"))


@query("media_release")
def media_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reorder buffer of 32 numbers and 1,000 chunks per stream."""
    chunks = _chunks(spark, sf_dir).select("delivery_id", F.lower(F.trim("stream_id")).alias("stream_id"), "sequence_number")
    return media.released(chunks, ["stream_id"], "delivery_id", window=32, capacity=1000)


_STREAM = "lower(trim(stream_id))"


@query(
    "media_reorder",
    f"""SELECT delivery_id, CASE WHEN copy > 1 THEN 'Duplicate' WHEN sequence_number < high THEN 'Late'
WHEN sequence_number - coalesce(lag(sequence_number) OVER (PARTITION BY s ORDER BY sequence_number, delivery_id), -1) > 1 THEN 'Gap' ELSE 'Ok' END AS status
FROM (SELECT *, {_STREAM} AS s, row_number() OVER (PARTITION BY {_STREAM}, sequence_number ORDER BY delivery_id) AS copy,
max(sequence_number) OVER (PARTITION BY {_STREAM} ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM media_chunks)""",
)
def media_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select("delivery_id", F.lower(F.trim("stream_id")).alias("stream_id"), "sequence_number")
    return media.reordered(chunks, ["stream_id"], "delivery_id").select("delivery_id", "status")


@query("media_gaps", f"SELECT s AS stream_id, n + 1 AS first_missing, nxt - 1 AS last_missing FROM (SELECT *, lead(n) OVER (PARTITION BY s ORDER BY n) AS nxt FROM (SELECT DISTINCT {_STREAM} AS s, sequence_number AS n FROM media_chunks)) WHERE nxt - n > 1")
def media_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.gaps(_chunks(spark, sf_dir).select(F.lower(F.trim("stream_id")).alias("stream_id"), "sequence_number"), ["stream_id"])


@query(
    "media_priority",
    """SELECT delivery_id, row_number() OVER (PARTITION BY batch_id ORDER BY came > 64, CASE WHEN came <= 64 THEN CASE priority WHEN 'High' THEN -3 WHEN 'Normal' THEN -2 WHEN 'Low' THEN -1 ELSE 0 END END,
CASE WHEN came <= 64 THEN sequence_number END, delivery_id)::INT AS release_no FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY delivery_id) AS came FROM media_chunks)""",
)
def media_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues of 64: in each batch what comes after is released in the order it came."""
    chunks = _chunks(spark, sf_dir).select("delivery_id", "batch_id", "priority", "sequence_number")
    return media.by_priority(chunks, F.col("batch_id"), tie="delivery_id").select("delivery_id", "release_no")


@query(
    "media_stats",
    f"""SELECT {_STREAM} AS stream_id, count(*) AS n_chunks, sum(octet_length(data))::BIGINT AS n_bytes, round(avg(octet_length(data)), 4) AS mean_bytes,
count(*) FILTER (chunk_type = 'VideoIFrame') AS n_key_frames, max(sequence_number) AS last_number,
max(sequence_number) + 1 - count(DISTINCT sequence_number) AS n_missing, bool_or(is_final) AS ended FROM media_chunks GROUP BY 1""",
)
def media_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumn("stream_id", F.lower(F.trim("stream_id")))
    return media.stream_stats(chunks, ["stream_id"]).withColumn("mean_bytes", F.round("mean_bytes", 4))


@query(
    "media_events",
    f"""SELECT id AS stream_id, user_id, 'media_stream_started' AS activity_type, quality AS detail FROM media_streams
UNION ALL SELECT {_STREAM}, NULL, 'media_stream_stopped', octet_length(data)::VARCHAR FROM media_chunks WHERE is_final
UNION ALL SELECT {_STREAM}, NULL, 'media_chunk_dropped', sequence_number || ': wrong checksum' FROM media_chunks WHERE lower(checksum) <> sha256(data)""",
)
def media_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that start, last chunks that stop them, and chunks that are dropped as their checksum is wrong."""
    started = table(spark, sf_dir, "media_streams").select(F.lit("StreamStarted").alias("kind"), F.col("id").alias("stream_id"), "user_id", F.col("created_at").alias("timestamp"), "quality")
    chunks = media.validated(_chunks(spark, sf_dir)).withColumn("stream_id", F.lower(F.trim("stream_id")))
    at = F.timestamp_millis("timestamp_ms").alias("timestamp")
    stopped = chunks.where("is_final").select(F.lit("StreamStopped").alias("kind"), "stream_id", at, F.octet_length("data").alias("bytes_transferred"))
    dropped = chunks.where("err = 'wrong checksum'").select(F.lit("ChunkDropped").alias("kind"), "stream_id", at, "sequence_number", F.col("err").alias("reason"))
    activity = media.events_to_activity(started.unionByName(stopped, allowMissingColumns=True).unionByName(dropped, allowMissingColumns=True))
    m = F.col("metadata")
    detail = F.coalesce(m["quality"], m["bytes_transferred"], F.concat(m["sequence_number"], F.lit(": "), m["reason"]))
    return activity.select(m["stream_id"].alias("stream_id"), "user_id", "activity_type", detail.alias("detail"))


# Extensions that Spark gives


@query("top_values", "SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 10")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("rn", F.row_number().over(keyed.Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")))
    return rows.where("rn <= 10").select("event_id", "event_type", "value")


@query("running_share_by_key", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id) / sum(value) OVER (PARTITION BY event_type), 6) AS share FROM events")
def running_share_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    out = running_sums(rows, ["event_type"], [F.col("event_id")], {"upto": F.col("value")}, totals=True)
    return out.select("event_id", F.round(F.col("upto") / F.col("upto_total"), 6).alias("share"))


# The forms for keys that hold much of all rows


@query("stateful_session_spread", registry.sql["stateful_session"])
def stateful_session_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.stateful_session(_keyed(spark, sf_dir), ["user_id"], ORDER, "ts", 6 * HOUR_US, spread=True).select("event_id", "is_new", "session_id")


@query("stateful_window_spread", registry.sql["stateful_window_partial"])
def stateful_window_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_window(_keyed(spark, sf_dir), ["user_id"], ORDER, 10, {"total": F.sum("value")}, slide=4, emit_partial=True, spread=True)
    return out.withColumn("total", cents("total"))


@query("stateful_pattern_spread", registry.sql["stateful_pattern"])
def stateful_pattern_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    def funnel(items: Column) -> Column:
        path = F.array_join(items, ">")
        return F.when(path.like("%click%purchase%"), path)

    return keyed.stateful_pattern(_keyed(spark, sf_dir), ["user_id"], ORDER, 3, "event_type", funnel, spread=True)


@query("stateful_group_by_spread", registry.sql["stateful_group_by"])
def stateful_group_by_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keyed.stateful_group_by(_keyed(spark, sf_dir), ["user_id"], ORDER, {"total": F.sum("value")}, max_size=25, spread=True)
    return out.withColumn("total", cents("total"))


@query("scan_associative", """WITH RECURSIVE e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events), s AS (SELECT event_id, rn, event_id % 1000003 AS v FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.rn, (s.v * (e.event_id % 1000 + 1)) % 1000003 FROM s JOIN e ON e.rn = s.rn + 1) SELECT event_id, v::BIGINT AS product FROM s""")
def scan_associative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running products modulo a prime over the whole stream."""
    rows = events(spark, sf_dir).select("event_id")
    first = rows.agg(F.min("event_id")).first()[0]
    factor = F.when(F.col("event_id") == first, F.col("event_id") % 1000003).otherwise(F.col("event_id") % 1000 + 1)
    return keyed.scan_associative(rows, [], ORDER, factor, lambda a, b: a * b % 1000003, "product", "bigint")


@query("distinct_until_changed_by_key_spread", registry.sql["distinct_until_changed_by_key"])
def distinct_until_changed_by_key_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    return sequence.distinct_until_changed(rows, ORDER, F.col("event_type"), key=["user_id"], spread=True)


# The distributed forms of what orders a whole stream, which small tables don't need

DISTRIBUTED = [
    "drop", "chunk", "sliding_window", "sliding_window_items", "group_adjacent_by", "group_by_items", "distinct_until_changed", "scan", "scan_extremes", "ordered_fold",
    "interleave", "zip", "zip_with", "batch_process", "throttle", "debounce", "timeout", "stateful_group_by_key_change",
]


def _distributed(name: str) -> None:
    plain = registry.queries[name]

    @query(f"{name}_distributed", registry.sql[name])
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with distributed(block_rows=1_000):
            return plain(spark, sf_dir)


for _name in DISTRIBUTED:
    _distributed(_name)
