"""Server-sent events as tables: format frames, parse captured streams, time them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import ship
from tessella.sources.scratch import Tables

DONE = "[DONE]"
IDLE_SECONDS = 20
RETRY_STATUS = 500
ATTEMPTS = 3


def frame(event: Column, data: Column) -> Column:
    """One frame: the event's name, a data line for each line of the payload, a blank line."""
    lines = F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def parse(chunks: DataFrame, joined: str = "\n") -> DataFrame:
    """(stream_id, position, event, data) from chunks (stream_id, seq, chunk) cut anywhere.

    Frames end at a blank line; comment lines and frames without data are skipped; nothing after [DONE] counts. Data
    lines of one frame are joined by ``joined``. A null chunk is an empty one; chunks of one seq go by the hash of their text.

    Chunks are sorted by ranges of (stream_id, seq), and each task cuts its range into frames as it reads, so a stream of
    any length is many tasks and a task holds one open frame. What lies on either side of a range's end, two pieces at
    most, is put together afterwards, and the frames of a stream that an earlier range began are numbered on from it.
    """
    spark = chunks.sparkSession
    ship(spark)
    key = chunks.schema["stream_id"].dataType.simpleString()
    order = ["stream_id", "seq", F.xxhash64("chunk")]
    ranges = chunks.select("stream_id", "seq", F.coalesce("chunk", F.lit("")).alias("chunk")).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = ranges.select("stream_id", "chunk").mapInArrow(_framed(joined), f"stream_id {key}, kind string, n long, event string, data string")
    placed = Tables(spark).keep(cut.withColumn("part", F.spark_partition_id()), "frames")

    # Pieces at the ends of ranges: of two streams a range at most. A group of pieces is closed by a head.
    edges = placed.where("kind <> 'frame'").withColumn("late", F.col("kind") == "tail")
    along = Window.partitionBy("stream_id").orderBy("part", "late")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.count_if(F.col("kind") == "head").over(earlier), F.lit(0))
    pieces = F.array_sort(F.collect_list(F.struct("part", "late", "data")))
    groups = edges.withColumn("closed", closed).groupBy("stream_id", "closed").agg(
        F.array_join(F.transform(pieces, lambda x: x["data"]), "").alias("body"),
        F.max(F.when(F.col("kind") == "head", F.col("part"))).alias("part"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"),
    )
    groups = groups.withColumn("raw", F.split(F.replace("body", F.lit("\r\n"), F.lit("\n")), "\n\n"))
    grown = Window.partitionBy("stream_id").orderBy("closed")
    so_far = F.coalesce(F.sum(F.size("raw")).over(grown.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("begin", F.sum("before").over(grown) + so_far)
    stitched = groups.select("stream_id", "begin", F.posexplode("raw").alias("i", "frame")).select(
        "stream_id", (F.col("begin") + F.col("i")).alias("position"), _fields_of(joined)("frame").alias("f")
    ).select("stream_id", "position", "f.event", "f.data")

    # One row a range: where the numbers of its first stream begin.
    begins = groups.where("part is not null").select(F.col("stream_id").alias("of"), "part", (F.col("begin") + F.size("raw")).alias("begin"))
    whole = placed.where("kind = 'frame'").join(
        F.broadcast(begins), (placed["part"] == begins["part"]) & placed["stream_id"].eqNullSafe(begins["of"]), "left"
    ).select("stream_id", (F.col("n") + F.coalesce("begin", F.lit(0))).alias("position"), "event", "data")
    found = whole.unionByName(stitched).where("data is not null")

    # A task drops what follows [DONE]; only streams over range ends, two a range, may go on elsewhere.
    cross = edges.select(F.col("stream_id").alias("of")).distinct()
    done = found.where(F.col("data") == DONE).join(F.broadcast(cross), F.col("stream_id").eqNullSafe(F.col("of")), "left_semi")
    ends = done.groupBy(F.col("stream_id").alias("of")).agg(F.min("position").alias("end"))
    kept = found.where(F.col("data") != DONE).join(F.broadcast(ends), F.col("stream_id").eqNullSafe(F.col("of")), "left")
    return kept.where("end is null or position < end").select("stream_id", "position", "event", "data")


def _fields(raw: str, joined: str) -> tuple[str, str | None]:
    """The event and the data of a frame; no data is null."""
    value = lambda line, name: line[len(name) :].removeprefix(" ")
    lines = raw.split("\n")
    data = [value(x, "data:") for x in lines if x.startswith("data:")]
    events = [value(x, "event:") for x in lines if x.startswith("event:")]
    return (events[-1] if events else "message"), (joined.join(data) if data else None)


def _fields_of(joined: str):
    @F.pandas_udf("event string, data string")
    def fields(frames: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_fields(x, joined) for x in frames], columns=["event", "data"], dtype=object)

    return fields


def _framed(joined: str):
    """Task function: chunks (stream_id, chunk) in order to frames, with their number in the task's part of the stream.

    The task's first stream may have begun earlier. Up to its first blank line after other text it is a ``head``, as
    nothing before can change that the frame ends there; without such a line it is a ``middle``. What the task's last
    stream, or the first, leaves after its last blank line is a ``tail``, with the number of frames before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stream, rest, n, first, headed, ended = None, None, 0, True, True, False

        def frame(raw: str) -> None:
            nonlocal n, ended
            if not ended:
                event, data = _fields(raw, joined)
                out.append((stream, "frame", n, event, data))
                ended = data == DONE
            n += 1

        def read(text: str) -> None:
            nonlocal rest, headed
            # A carriage return at the end may belong to a line feed that is still to come.
            rest = (rest + text).replace("\r\n", "\n")
            if not headed:
                at = rest.find("\n\n", len(rest) - len(rest.lstrip("\n")))
                if at < 0:
                    return
                out.append((stream, "head", None, None, rest[:at]))
                rest, headed = rest[at + 2 :], True
            *complete, rest = rest.split("\n\n")
            for raw in complete:
                frame(raw)

        def close(last: bool) -> None:
            nonlocal first
            if not headed:
                out.append((stream, "middle", None, None, rest))
            elif first or last:
                out.append((stream, "tail", n, None, rest))
            else:
                frame(rest)
            first = False

        for batch in batches:
            streams, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for i in range(1, len(streams) + 1):
                if i < len(streams) and streams[i] == streams[at]:
                    continue
                if rest is None or streams[at] != stream:
                    if rest is not None:
                        close(False)
                    stream, rest, n, headed, ended = streams[at], "", 0, not first, False
                read("".join(texts[at:i]))
                at = i
            yield from rows_of(out, batch.schema.field(0).type)
            key = batch.schema.field(0).type
        if rest is not None:
            close(True)
            yield from rows_of(out, key)

    def rows_of(out: list[tuple], key: pa.DataType) -> Iterator[pa.RecordBatch]:
        if out:
            types = (key, pa.string(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            yield pa.RecordBatch.from_arrays(columns, names=["stream_id", "kind", "n", "event", "data"])

    return run


def latency(tokens: DataFrame) -> DataFrame:
    """Per stream: first-token and total time in ms from its first row, and tokens, from (stream_id, ts, is_token)."""
    ms = lambda a, b: (F.timestamp_diff("MILLISECOND", a, b)).cast("long")
    summed = tokens.groupBy("stream_id").agg(
        F.min("ts").alias("began"),
        F.min(F.when(F.col("is_token"), F.col("ts"))).alias("first"),
        F.max("ts").alias("last"),
        F.count_if("is_token").alias("tokens"),
    )
    return summed.select("stream_id", ms(F.col("began"), F.col("first")).alias("ttft_ms"), ms(F.col("began"), F.col("last")).alias("total_ms"), "tokens")


def stalls(tokens: DataFrame, seconds: int = IDLE_SECONDS) -> DataFrame:
    """Gaps of more than ``seconds`` between rows of a stream: (stream_id, ts, gap_seconds)."""
    before = F.lag("ts").over(Window.partitionBy("stream_id").orderBy("ts", "seq"))
    gap = F.timestamp_diff("MICROSECOND", before, F.col("ts")) / 1e6
    return tokens.select("stream_id", "ts", gap.alias("gap_seconds")).where(F.col("gap_seconds") > seconds)


def retryable(error: Column, status: Column) -> Column:
    """Whether a failed attempt may be made again: time-outs, network errors, 429 and server errors."""
    return F.coalesce(error.isin("timeout", "network"), F.lit(False)) | F.coalesce((status == 429) | (status >= RETRY_STATUS), F.lit(False))


def may_retry(attempt: Column, tokens: Column, error: Column, status: Column) -> Column:
    """A retry is legal before the first token only, and within the attempts."""
    return (tokens == 0) & (attempt < ATTEMPTS) & retryable(error, status)


def backoff_ceiling_ms(attempt: Column, cap: int = 8000) -> Column:
    """Upper bound of the jittered wait before an attempt's retry."""
    return F.least(F.lit(float(cap)), 1000 * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def backoff_ms(attempt: Column, seed: int, cap: int = 8000) -> Column:
    """Full jitter: uniform between 0 and the ceiling."""
    return (F.rand(seed) * backoff_ceiling_ms(attempt, cap)).cast("long")
