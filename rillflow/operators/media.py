"""Chunks of media streams: kinds, priorities, codecs, checks, order of release and events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.keyed import keyed_stream
from rillflow.plans.ordering import col

#: Ranks of priorities, and greatest sizes of chunks in bytes.
PRIORITY_RANK = {"High": 3, "Normal": 2, "Low": 1}
MOST_AUDIO, MOST_VIDEO = 64 * 1024, 1024 * 1024
DEFAULT_PRIORITY = {"VideoIFrame": "High", "VideoPFrame": "Normal", "VideoBFrame": "Low", "Audio": "High", "Metadata": "High", "Thumbnail": "Low"}


def chunk_type_of(sequence_number: Column) -> Column:
    """Of frames by number: every 30th a key frame, else every 3rd bidirectional, else predicted."""
    return F.when(sequence_number % 30 == 0, "VideoIFrame").when(sequence_number % 3 == 0, "VideoBFrame").otherwise("VideoPFrame")


def priority_of(sequence_number: Column) -> Column:
    return default_priority(chunk_type_of(sequence_number))


def default_priority(chunk_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in DEFAULT_PRIORITY.items() for x in pair))
    return known[chunk_type]


def priority_rank(priority: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PRIORITY_RANK.items() for x in pair))
    return F.coalesce(known[priority], F.lit(0))


def by_priority(chunks: DataFrame, buffer: Column, capacity: int = 64, tie: str = "sequence_number") -> DataFrame:
    """Add release_no inside each buffer: the first capacity chunks by priority, then number; the rest as they
    came, which is in the order of tie."""
    came = F.row_number().over(Window.partitionBy("__buffer").orderBy(tie))
    placed = chunks.withColumn("__buffer", buffer).withColumn("__came", came).withColumn("__held", F.col("__came") <= capacity)
    rank = F.when(F.col("__held"), -priority_rank(F.col("priority"))).otherwise(0)
    order = Window.partitionBy("__buffer").orderBy(F.col("__held").desc(), rank, F.when(F.col("__held"), F.col("sequence_number")), tie)
    return placed.withColumn("release_no", F.row_number().over(order)).drop("__buffer", "__came", "__held")


def _resampled(data: pa.Array, every: int, times: int) -> pa.Array:
    """Of each value's bytes every so many-th, from the first, each so many times; over whole batches at once."""
    data = pa.concat_arrays([data]) if data.offset else data
    n = len(data)
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[: n + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if data.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    size = np.diff(offsets)
    if every > 1:
        raw = raw[(np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], size)) % every == 0]
        size = -(-size // every)
    if times > 1:
        raw, size = np.repeat(raw, times), size * times
    ends = np.concatenate([[0], np.cumsum(size)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("more than 2 GiB in a batch; lower spark.sql.execution.arrow.maxBytesPerBatch")
    out = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])
    return pc.if_else(data.is_valid(), out, pa.scalar(None, pa.binary()))


def _codec(every: int, times: int) -> Callable[[Column], Column]:
    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return _resampled(data, every, times)

    return run


def encode_video(data: Column, compression: bool = True) -> Column:
    """Lossy sub-sampling: every second byte, from the first; all without compression. Null and empty data give the same."""
    return _codec(2, 1)(data) if compression else data


def encode_audio(data: Column) -> Column:
    """Every fourth byte, from the first."""
    return _codec(4, 1)(data)


def decode_video(data: Column, compression: bool = True) -> Column:
    """Each byte twice; once without compression."""
    return _codec(1, 2)(data) if compression else data


def decode_audio(data: Column) -> Column:
    return _codec(1, 4)(data)


#: The part of mixed data that is video; fixed value.
VIDEO_PART = 0.6


def _low_first(n: Column) -> Column:
    """A number below 2^32 as 4 bytes, the lowest first."""
    digits = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))


def _number_of(data: Column, at: int) -> Column:
    """The number in 4 bytes from at (from 1), the lowest first."""
    digits = F.hex(F.substring(data, at, 4))
    return F.conv(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("int")


def encode_mixed(data: Column, compression: bool = True) -> Column:
    """The first 60 % as video, the rest as audio, behind the encoded lengths of both as 4 bytes each, the lowest first.

    Data of less than two bytes can't be split and give null.
    """
    cut = F.floor(F.octet_length(data) * F.lit(VIDEO_PART)).cast("int")
    video = encode_video(F.substring(data, F.lit(1), cut), compression)
    audio = encode_audio(F.substring(data, cut + 1, F.octet_length(data)))
    return F.when(F.octet_length(data) >= 2, F.concat(_low_first(F.octet_length(video)), _low_first(F.octet_length(audio)), video, audio))


def split_mixed(encoded: Column) -> tuple[Column, Column]:
    """The encoded video and audio of mixed data, by the lengths before them."""
    n_video, n_audio = _number_of(encoded, 1), _number_of(encoded, 5)
    return F.substring(encoded, F.lit(9), n_video), F.substring(encoded, n_video + 9, n_audio)


def decoded(chunks: DataFrame, compression: bool = True) -> DataFrame:
    """Add decoded and err: by the kind of chunk, and 'wrong checksum' (and no data) where a checksum is there and differs.

    Metadata is handed on as it is; thumbnails are decoded as video, as are unknown kinds.
    """
    kind, data = F.col("chunk_type"), F.col("data")
    plain = F.when(kind == "Metadata", data).when(kind == "Audio", decode_audio(data)).otherwise(decode_video(data, compression))
    broken = F.col("checksum").isNotNull() & (F.lower("checksum") != F.sha2("data", 256))
    return chunks.withColumn("err", F.when(broken, "wrong checksum")).withColumn("decoded", F.when(F.col("err").isNull(), plain))


@dataclass(frozen=True)
class CodecPreset:
    quality: str
    bitrate: int
    keyframe_interval: int
    compression: bool = True
    keep_checksums: bool = True


#: Bits per second by quality; fixed values.
VIDEO_BITRATE = {"Low": 500_000, "Medium": 1_500_000, "High": 5_000_000, "UltraHigh": 15_000_000}
AUDIO_BITRATE = {"Low": 64_000, "Medium": 128_000, "High": 320_000, "UltraHigh": 500_000}
ADAPTIVE_BITRATE = 1_000_000


def video_preset(quality: str) -> CodecPreset:
    return CodecPreset(quality, VIDEO_BITRATE[quality], keyframe_interval=30)


def audio_preset(quality: str) -> CodecPreset:
    return CodecPreset(quality, AUDIO_BITRATE[quality], keyframe_interval=0, keep_checksums=False)


def adaptive_preset() -> CodecPreset:
    return CodecPreset("Medium", ADAPTIVE_BITRATE, keyframe_interval=60)


def validated(chunks: DataFrame) -> DataFrame:
    """Add err: the first rule a chunk breaks, null if none."""
    kind = F.col("chunk_type")
    size = F.octet_length("data")
    rules = [
        (F.coalesce(F.trim("stream_id") == "", F.lit(True)), "empty stream id"),
        (F.coalesce(size == 0, F.lit(True)), "empty data"),
        (F.col("checksum").isNotNull() & (F.lower("checksum") != F.sha2("data", 256)), "wrong checksum"),
        ((kind == "Audio") & (size > MOST_AUDIO), "audio chunk too large"),
        (kind.startswith("Video") & (size > MOST_VIDEO), "video chunk too large"),
    ]
    err: Column = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        err = F.when(broken, name).otherwise(err)
    return chunks.withColumn("err", err)


def reordered(chunks: DataFrame, key: Sequence[str], arrival: str, number: str = "sequence_number") -> DataFrame:
    """Chunks of each stream in order of number, with status: 'Duplicate' for a number that came before, 'Late' for one
    below a number already come, 'Gap' for one before which numbers are missing, else 'Ok'. Repeats are kept and marked."""
    stream = [col(k) for k in key]
    arrived = Window.partitionBy(*stream).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    same = F.row_number().over(Window.partitionBy(*stream, col(number)).orderBy(arrival))
    marked = chunks.withColumns({"__copy": same, "__high": F.max(col(number)).over(arrived)})
    ordered = Window.partitionBy(*stream).orderBy(col(number), col(arrival))
    marked = marked.withColumn("__before", F.lag(col(number)).over(ordered))
    status = (
        F.when(F.col("__copy") > 1, "Duplicate")
        .when(col(number) < F.col("__high"), "Late")
        .when(col(number) - F.coalesce("__before", F.lit(-1)) > 1, "Gap")
        .otherwise("Ok")
    )
    return marked.withColumn("status", status).drop("__copy", "__high", "__before")


def released(chunks: DataFrame, key: Sequence[str], arrival: str, window: int, capacity: int, number: str = "sequence_number") -> DataFrame:
    """What a reorder buffer of each stream releases, in arrival order: release_no, or null for what it drops, with status.

    A buffer waits for the next number from the first chunk's on. A chunk that comes is held; a number behind the awaited
    one is 'Late' and one already held is a 'Duplicate', both dropped. While the awaited number is held it is released, with
    'Ok'. When more than window numbers lie between the awaited and the greatest held, or more than capacity chunks are held,
    the least held number is released instead, with 'Gap', and the wait goes on behind it. What is held at the end is
    released in order ('Gap' where numbers are missing). A null number is dropped as 'Late'. Only the buffer of the current
    stream, of capacity numbers, is kept.
    """
    if window < 1 or capacity < 1:
        raise ValueError("window and capacity must be at least 1")

    def step(state: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        awaited, released, held = state if state is not None else [None, 0, {}]
        out: list[tuple] = []

        def release(n: int) -> None:
            nonlocal awaited, released
            released += 1
            out.append((held.pop(n), released, "Ok" if n == awaited else "Gap"))
            awaited = n + 1

        for arrived, n, last in zip(rows["__arrival"].tolist(), rows["__number"].tolist(), rows["__last"].tolist(), strict=True):
            n = None if pd.isna(n) else int(n)
            awaited = n if awaited is None else awaited
            if n is None or n < awaited or n in held:
                out.append((arrived, None, "Duplicate" if n is not None and n >= awaited else "Late"))
            else:
                held[n] = arrived
                while held and (awaited in held or len(held) > capacity or max(held) - awaited >= window):
                    release(awaited if awaited in held else min(held))
            while last and held:
                release(awaited if awaited in held else min(held))
        return [awaited, released, held], pd.DataFrame(out, columns=["__arrived", "release_no", "status"]).astype({"__arrived": "int64", "release_no": "Int64"})

    names = [f"__k{i}" for i in range(len(key))]
    rows = chunks.select(*(col(k).alias(n) for k, n in zip(key, names, strict=True)), col(arrival).cast("bigint").alias("__arrival"), col(number).alias("__number"))
    behind = Window.partitionBy(*names).orderBy("__arrival")
    rows = rows.withColumn("__last", F.lead("__arrival").over(behind).isNull())
    placed = keyed_stream(rows, names, ["__arrival"], step, "__arrived bigint, release_no bigint, status string")
    return chunks.join(placed, col(arrival).cast("bigint") == F.col("__arrived")).drop("__arrived")


def gaps(chunks: DataFrame, key: Sequence[str], number: str = "sequence_number") -> DataFrame:
    """Stretches of missing numbers of each stream between its least and greatest: key..., first_missing, last_missing."""
    seen = chunks.select(*(col(k) for k in key), col(number).alias("n")).where("n IS NOT NULL").distinct()
    following = F.lead("n").over(Window.partitionBy(*(col(k) for k in key)).orderBy("n"))
    return seen.withColumn("__next", following).where("__next - n > 1").select(*(col(k) for k in key), (F.col("n") + 1).alias("first_missing"), (F.col("__next") - 1).alias("last_missing"))


def stream_stats(chunks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per stream: chunks, bytes, mean size, key frames, greatest number, numbers missing below it, and whether it ended.

    Copies of a number count once in n_missing only; drop superfluous deliveries first to count each chunk once.
    """
    size = F.octet_length("data")
    return chunks.groupBy(*(col(k) for k in key)).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(size).alias("n_bytes"), F.avg(size).alias("mean_bytes"),
        F.count_if(F.col("chunk_type") == "VideoIFrame").alias("n_key_frames"), F.max("sequence_number").alias("last_number"),
        (F.max("sequence_number") + 1 - F.count_distinct("sequence_number")).alias("n_missing"), F.coalesce(F.bool_or("is_final"), F.lit(False)).alias("ended"),
    )


EVENT_ACTIVITY = {
    "StreamStarted": "media_stream_started", "StreamStopped": "media_stream_stopped", "QualityChanged": "media_quality_changed",
    "BufferUnderrun": "media_buffer_underrun", "ChunkDropped": "media_chunk_dropped",
}
EVENT_FIELDS = ("stream_id", "quality", "duration_seconds", "bytes_transferred", "old_quality", "new_quality", "buffer_level", "sequence_number", "reason")


def events_to_activity(events: DataFrame) -> DataFrame:
    """Sparse media events -> user_id, activity_type, timestamp and metadata with the fields that are set."""
    known = F.create_map(*(F.lit(x) for pair in EVENT_ACTIVITY.items() for x in pair))
    present = [c for c in EVENT_FIELDS if c in events.columns]
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), col(c).cast("string").alias("value")) for c in present)), lambda e: e["value"].isNotNull())
    return events.select("user_id", known[F.col("kind")].alias("activity_type"), "timestamp", F.map_from_entries(entries).alias("metadata"))
