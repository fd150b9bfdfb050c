"""Queues, pipelines, connectors, validation, metrics, keys and media."""

from __future__ import annotations

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from rillflow.functions import keys, validation
from rillflow.operators import media
from rillflow.plans import metrics
from rillflow.plans.pipeline import InvalidPipeline, NoSink, NoSource, Pipe, Pipeline
from rillflow.sources import connectors
from rillflow.sources.queue import Queue, QueueClosed, QueueFull


def test_queue(spark):
    q = Queue.bounded(2)
    q.enqueue(1)
    q.try_enqueue(2)
    with pytest.raises(QueueFull):
        q.try_enqueue(3)
    with pytest.raises(QueueFull):
        q.enqueue(3, timeout=0.01)
    waiter = threading.Thread(target=q.enqueue, args=(3,))
    waiter.start()
    assert q.dequeue(spark, "x int").count() in (2, 3)
    waiter.join(5)
    q.close()
    with pytest.raises(QueueClosed):
        q.enqueue(4)
    q.drain()
    assert q.is_empty() and len(q) == 0 and q.capacity == 2 and Queue.unbounded().capacity is None
    with pytest.raises(ValueError):
        Queue(0)


def test_pipeline(spark):
    rows = lambda s: s.range(10)
    out = Pipeline().source(rows).transform(lambda d: d.where("id > 3")).sink(lambda d: d.count()).branch(lambda d: d.count(), lambda d: d.first().id).run(spark)
    assert out == [6, 6, 4]
    for broken, kind in ((Pipeline(), InvalidPipeline), (Pipeline().sink(print), NoSource), (Pipeline().source(rows), NoSink)):
        with pytest.raises(kind):
            broken.validate()
    assert Pipeline().source(rows, "a").source(rows, "b").sink(print, "c").names() == ["b", "c"]
    assert Pipe.filter(F.col("id") < 3).compose(Pipe.map(x=F.col("id") * 2)).apply(spark.range(5)).count() == 3


def test_streaming_pipeline_feeds_every_branch(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    read = lambda s: s.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    to = lambda name: lambda d: d.write.mode("append").parquet(str(tmp_path / name))
    Pipeline().source(read).transform(lambda d: d.where("id % 2 = 0")).branch(to("a"), to("b")).run(spark, str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 10
    with pytest.raises(InvalidPipeline):
        Pipeline().source(read).sink(print).run(spark)


def test_connectors(spark, tmp_path):
    memory = connectors.MemoryConnector("id bigint", [(1,)])
    assert memory.write(spark.range(3)) == {"produced": 3} and memory.read(spark).count() == 4
    for fmt in ("parquet", "orc", "json", "csv"):
        files = connectors.FileConnector(str(tmp_path / fmt), fmt, "id bigint")
        files.write(spark.range(4))
        assert files.read(spark).count() == 4 and files.read(spark, streaming=True).isStreaming
    with pytest.raises(connectors.InvalidConfiguration):
        connectors.FileConnector("x", "avro")
    with pytest.raises(connectors.InvalidConfiguration):
        connectors.JdbcConnector("mysql://x", "t")
    assert connectors.JdbcConnector("jdbc:x", "t", "id", 0, 10, 4).options["numPartitions"] == "4"
    config = connectors.KafkaConfig("host:9092", "events", "group", True, None, 5)
    assert config.read_options() == {"kafka.bootstrap.servers": "host:9092", "startingOffsets": "earliest", "failOnDataLoss": "false", "subscribe": "events", "kafka.group.id": "group", "maxOffsetsPerTrigger": "5"}
    assert connectors.KafkaConfig("h", "t", partition=3).read_options()["assign"] == '{"t":[3]}'
    with pytest.raises(connectors.InvalidConfiguration):
        connectors.KafkaConnector(connectors.KafkaConfig("h", ""), "id bigint")
    lines = spark.createDataFrame([('{"id": 1}',), ("not json",), ('{"id": "x"}',)], "value string")
    assert [r.id for r in connectors.decoded(lines, "id bigint").collect()] == [1]
    row = connectors.encoded(spark.createDataFrame([("user-7", 5)], "name string, n int")).first()
    assert row.key == "user" and json.loads(row.value) == {"name": "user-7", "n": 5}


SCHEMA = {"type": "object", "required": ["id", "value"], "properties": {"id": {"type": "string"}, "value": {"type": "integer"}}}


def test_validation_kinds(spark):
    texts = ['{"id": "a", "value": 1}', '{"id": "a"}', '{"id": "a", "value": "1"}', "not json", None, '{"id": "a", "value": 2.0}', '{"id": null, "value": 1}', "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.e.kind if r.e else None for r in df.select("i", validation.validation_error(F.col("t"), SCHEMA).alias("e")).collect()}
    assert got == {0: None, 1: "ValidationFailed", 2: "ValidationFailed", 3: "ParseError", 4: "ValidationFailed", 5: None, 6: "ValidationFailed", 7: "ValidationFailed"}
    flat = {r.i: r.v for r in df.select("i", validation.valid_flat(F.col("t"), SCHEMA).alias("v")).collect()}
    assert {i: bool(v) for i, v in flat.items()} == {i: k is None for i, k in got.items()}
    good, bad = validation.with_schema_validation(df, F.col("t"), SCHEMA)
    assert good.count() == 2 and bad.count() == 6


@pytest.mark.parametrize(
    "value,schema,fine",
    [
        ("abc", {"pattern": "^a"}, True), ("xbc", {"pattern": "^a"}, False), ("ab", {"minLength": 3}, False), (5, {"minimum": 5, "maximum": 5}, True), (6, {"maximum": 5}, False),
        ([1, "x"], {"items": {"type": "integer"}}, False), ([], {"minItems": 1}, False), (True, {"type": "integer"}, False), (1, {"enum": [True]}, False), ("b", {"enum": ["a", "b"]}, True),
        ({"a": {"b": 1}}, {"properties": {"a": {"required": ["c"]}}}, False), (None, {"type": ["string", "null"]}, True), (1.5, {"type": "number"}, True),
    ],
)
def test_validation_rules(value, schema, fine):
    assert (validation.problem(value, validation.checked_schema(schema)) is None) == fine


@pytest.mark.parametrize("schema", [{"oneOf": []}, {"type": "thing"}, {"pattern": "("}, {"properties": {"a": {"if": 1}}}, []])
def test_bad_schemas_are_refused(schema):
    with pytest.raises(validation.InvalidSchema):
        validation.checked_schema(schema)


def test_metrics_and_health(spark):
    observed, seen = metrics.with_metrics(spark.range(10), "ten", F.lit(8), F.col("id") < 2)
    observed.collect()
    got = metrics.metrics_of(seen, "ten", metrics.HealthThresholds.relaxed())
    assert (got.items, got.bytes, got.errors) == (8, 80, 2) and not got.is_healthy() and got.error_rate == 0.2
    m = metrics.StreamMetrics("m")
    for _ in range(3):
        m.record_item(10, 0.5)
    m.record_error()
    m.record_retry()
    m.record_backpressure()
    assert m.average_bytes == 10 and m.throughput(3) == 1 and m.consecutive_errors == 1 and "3 items" in m.summary()
    assert metrics.HealthThresholds.strict() == metrics.HealthThresholds(0.01, 2)


def test_resources():
    now = [0.0]
    r = metrics.ResourceManager(metrics.ResourceConfig(max_memory_bytes=100, max_overflows=2, cooldown_s=10), clock=lambda: now[0])
    r.track_memory(85)
    r.track_keys(3)
    assert r.under_pressure() and not r.is_circuit_open()
    r.track_overflow()
    r.track_overflow()
    assert r.is_circuit_open()
    now[0] = 11
    assert not r.is_circuit_open() and r.state == "HalfOpen"
    r.record_success()
    assert r.state == "Closed"
    r.track_memory(20)
    assert r.is_circuit_open()
    r.update_from_progress({"stateOperators": [{"memoryUsedBytes": 7, "numRowsTotal": 2}]})
    assert r.memory == 7 and r.keys == 2 and r.peak_memory == 105


def test_keys(spark):
    df = spark.createDataFrame([((("u1", 5, True, None, ["a", "b"]),),)], "data struct<user:struct<user_id:string,age:int,is_active:boolean,metadata:string,tags:array<string>>>")
    paths = ["data.user.user_id", "data.user.age", "data.user.is_active", "data.user.metadata", "data.user.tags", "data.user.none", "gone"]
    assert [df.select(keys.field_key(df, p).alias("k")).first().k for p in paths] == ["u1", "5", "true", "null", '["a","b"]', "missing_field_none", "missing_field_gone"]


def test_state_settings():
    for bad in ({"ttl_s": 0}, {"cleanup_interval_s": 0}, {"ttl_s": 10, "cleanup_interval_s": 20}, {"max_size": 0}):
        with pytest.raises(keys.StateError):
            keys.StateConfig(**bad).validated()
    assert keys.StateConfig().with_(max_size=5).max_size == 5 and keys.PRESETS["session"].ttl_s == 1800
    now = [0.0]
    s = keys.InMemoryState(10, 2, lambda: now[0])
    for k in "abc":
        s.set(k, k.encode())
    assert s.get("a") is None and s.get("b") == b"b" and len(s) == 2
    now[0] = 11
    assert not s.exists("b")
    s.set("d", b"d")
    s.delete("d")
    s.clear()
    assert len(s) == 0


def test_codecs(spark):
    data = [bytes(range(n)) for n in (0, 1, 3, 8, 9, 21)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary")
    c = F.col("d")
    out = df.select("i", media.encode_video(c).alias("v"), media.encode_audio(c).alias("a"), media.decode_video(c).alias("dv"), media.decode_audio(c).alias("da"), media.encode_mixed(c).alias("m")).collect()
    for r in out:
        d = data[r.i]
        assert bytes(r.v) == d[::2] and bytes(r.a) == d[::4]
        assert bytes(r.dv) == bytes(x for x in d for _ in range(2)) and bytes(r.da) == bytes(x for x in d for _ in range(4))
        cut = int(len(d) * 0.6)
        video, audio = d[:cut][::2], d[cut:][::4]
        assert r.m is None if len(d) < 2 else bytes(r.m) == len(video).to_bytes(4, "little") + len(audio).to_bytes(4, "little") + video + audio
    parts = df.select("i", media.encode_mixed(c).alias("m")).select("i", *(x.alias(n) for x, n in zip(media.split_mixed(F.col("m")), "va", strict=True))).collect()
    assert all(bytes(r.v) == data[r.i][: int(len(data[r.i]) * 0.6)][::2] for r in parts if len(data[r.i]) > 1)
    assert [bytes(r[0]) for r in df.select(media.encode_video(c, compression=False)).collect()] == data
    assert [r[0] for r in df.select(media.decode_audio(F.when(F.col("i") == 99, c))).collect()] == [None] * len(data)
    assert media.video_preset("High").bitrate == 5_000_000 and media.audio_preset("Low").keyframe_interval == 0 and media.adaptive_preset().quality == "Medium"


def test_decoding_checks_the_checksum(spark):
    rows = [("Audio", b"ab", hashlib.sha256(b"ab").hexdigest()), ("VideoPFrame", b"ab", None), ("Thumbnail", b"ab", "00"), ("Metadata", b"ab", hashlib.sha256(b"ab").hexdigest().upper())]
    df = spark.createDataFrame([(i, k, bytearray(d), c) for i, (k, d, c) in enumerate(rows)], "i int, chunk_type string, data binary, checksum string")
    out = {r.i: (bytes(r.decoded) if r.decoded is not None else None, r.err) for r in media.decoded(df).collect()}
    assert out == {0: (b"aaaabbbb", None), 1: (b"aabb", None), 2: (None, "wrong checksum"), 3: (b"ab", None)}


def brute_released(numbers, window, capacity):
    awaited, held, order, dropped = None, {}, [], {}

    def release(n):
        nonlocal awaited
        order.append((held.pop(n), "Ok" if n == awaited else "Gap"))
        awaited = n + 1

    for at, n in enumerate(numbers):
        awaited = n if awaited is None else awaited
        if n < awaited or n in held:
            dropped[at] = "Late" if n < awaited else "Duplicate"
            continue
        held[n] = at
        while held and (awaited in held or len(held) > capacity or max(held) - awaited >= window):
            release(min(held))
    for n in sorted(held):
        release(n)
    return {at: (i + 1, status) for i, (at, status) in enumerate(order)} | {at: (None, s) for at, s in dropped.items()}


@pytest.mark.parametrize("window,capacity", [(4, 100), (100, 2), (1, 1)])
def test_reorder_buffers(spark, window, capacity):
    rng = random.Random(7)
    streams = {"a": [max(0, i + rng.choice([-3, -1, 0, 0, 2, 7])) for i in range(60)], "b": [5, 3, 4, 9, 9, 6]}
    rows = [(k, at * 2 + (k == "b"), n, "x") for k, numbers in streams.items() for at, n in enumerate(numbers)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id string, came bigint, sequence_number bigint, status_before string")
    out = media.released(df, ["stream_id"], "came", window, capacity).collect()
    assert len(out) == len(rows)
    for k, numbers in streams.items():
        assert {(r.came - (k == "b")) // 2: (r.release_no, r.status) for r in out if r.stream_id == k} == brute_released(numbers, window, capacity)
    with pytest.raises(ValueError):
        media.released(df, ["stream_id"], "came", 0, 1)


def test_kinds_of_connector_errors():
    kinds = {FileNotFoundError("f"): connectors.NotFound, PermissionError("p"): connectors.PermissionDenied, OSError("o"): connectors.InputOutput, KeyError("k"): connectors.ConnectorSpecific, TimeoutError("t"): connectors.ConnectorTimeout}
    assert all(type(connectors.connector_error(e)) is k for e, k in kinds.items())
    several = connectors.connector_error(ExceptionGroup("g", [ValueError("v"), OSError("o")]))
    assert isinstance(several, connectors.Multiple) and [type(e) for e in several.errors] == [connectors.InvalidConfiguration, connectors.InputOutput] and str(several) == "v; o"


def test_chunk_rules_and_order(spark):
    good = hashlib.sha256(b"x").hexdigest()
    rows = [(1, "s", 0, b"x", "Audio", good), (2, " ", 1, b"x", "Audio", None), (3, "s", 1, b"", "Audio", None), (4, "s", 2, b"x", "Audio", "00"), (5, "s", 4, b"x" * 70_000, "Audio", None), (6, "s", 3, b"x", "Metadata", good.upper()), (7, "s", 4, b"y", "Audio", None)]
    df = spark.createDataFrame([(a, b, c, bytearray(d), e, f) for a, b, c, d, e, f in rows], "delivery_id int, stream_id string, sequence_number bigint, data binary, chunk_type string, checksum string")
    errs = {r.delivery_id: r.err for r in media.validated(df).collect()}
    assert errs == {1: None, 2: "empty stream id", 3: "empty data", 4: "wrong checksum", 5: "audio chunk too large", 6: None, 7: None}
    status = {r.delivery_id: r.status for r in media.reordered(df.where("stream_id = 's'"), ["stream_id"], "delivery_id").collect()}
    assert status == {1: "Ok", 3: "Ok", 4: "Ok", 5: "Ok", 6: "Late", 7: "Duplicate"}
    assert [tuple(r) for r in media.gaps(df.where("delivery_id IN (1, 5)"), ["stream_id"]).collect()] == [("s", 1, 3)]
    ranked = df.withColumn("priority", media.default_priority(F.col("chunk_type"))).withColumn("b", F.lit(1))
    assert media.by_priority(ranked, F.col("b"), capacity=3, tie="delivery_id").count() == 7
    kinds = [r[0] for r in spark.range(31).select(media.chunk_type_of(F.col("id"))).collect()]
    assert kinds[0] == kinds[30] == "VideoIFrame" and kinds[3] == "VideoBFrame" and kinds[1] == "VideoPFrame"


def test_media_events(spark):
    df = spark.createDataFrame([("QualityChanged", "s", 1, "low", "high")], "kind string, stream_id string, user_id bigint, old_quality string, new_quality string").withColumn("timestamp", F.current_timestamp())
    row = media.events_to_activity(df).first()
    assert row.activity_type == "media_quality_changed" and row.metadata == {"stream_id": "s", "old_quality": "low", "new_quality": "high"}
