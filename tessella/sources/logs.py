"""Event streams as growing byte logs, read live or in batch; spans written as OTLP JSON lines and read again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessella.session import ship
from tessella.sources.scratch import Tables
from tessella.sources.sse import DONE

SUFFIX = ".sse"
#: Bytes of a log that one task reads, and of one read.
BLOCK_BYTES = 64 * 1024 * 1024
STEP_BYTES = 1024 * 1024
_BLANK = re.compile(rb"\n\r?(?=\n)")


def fields(frame: bytes) -> tuple[str, str | None]:
    """(event, data) of a frame: the last event name, its data lines; data is null where the frame has none."""
    event, data = "message", []
    for line in frame.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        name, _, value = line.partition(":")
        if name == "event":
            event = value.removeprefix(" ")
        elif name == "data":
            data.append(value.removeprefix(" "))
    return event, "\n".join(data) if data else None


@dataclass
class Range(InputPartition):
    """Bytes of a log: its task gives the frames whose blank line ends behind ``low``, and at ``high`` or before."""

    path: str
    low: int
    high: int


def _start(log, low: int) -> int:
    """The end of the last blank line at or before ``low``: the frame that crosses ``low`` begins there."""
    back = STEP_BYTES
    while low:
        at = max(0, low - back)
        log.seek(at)
        ends = [m.end() + 1 for m in _BLANK.finditer(log.read(low - at))]
        if ends:
            return at + ends[-1]
        if at == 0:
            break
        back *= 2
    return 0


def frames(log, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(end, frame) of each frame whose blank line ends within (low, high]; one frame and one step are held."""
    begin = _start(log, low)
    log.seek(begin)
    held, seen = b"", 0
    while begin + len(held) < high:
        more = log.read(min(STEP_BYTES, high - begin - len(held)))
        if not more:
            raise ValueError(f"a log ends before byte {high}: logs may only grow")
        held += more
        used = 0
        for m in _BLANK.finditer(held, seen):
            end = m.end() + 1
            if begin + end > low:
                yield begin + end, held[used:end]
            used = end
        # A blank line may lie across the end of what was read: its bytes are looked at again.
        held, begin = held[used:], begin + used
        seen = max(0, len(held) - 2)


class _Logs:
    def __init__(self, options: dict):
        self.root, self.block = options["path"], int(options.get("blockBytes", BLOCK_BYTES))

    def sizes(self) -> dict[str, int]:
        files, root = pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)
        return {i.path: i.size for i in files.get_file_info(pafs.FileSelector(root)) if i.is_file and i.path.endswith(SUFFIX)}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return [
            Range(path, low, min(low + self.block, high)) for path, high in sorted(end.items()) for low in range(start.get(path, 0), high, self.block)
        ]

    def read(self, part: Range) -> Iterator[tuple]:
        files = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else pafs.LocalFileSystem()
        stream = part.path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
        with files.open_input_file(part.path) as log:
            for end, frame in frames(log, part.low, part.high):
                event, data = fields(frame)
                if data is not None:
                    yield stream, end, event, data


class _Batch(_Logs, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.sizes()) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        return super().read(part) if part.high else iter(())


class _Stream(_Logs, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)


class EventLogs(DataSource):
    """Format ``event_logs``: frames (stream_id, at, event, data) of the ``*.sse`` logs of folder ``path``.

    A log is the body of one event stream, appended to by whoever receives it; ``at`` is the byte at which the frame's
    blank line ends. The offset of a stream is the size of each log, so nothing but sizes passes the driver, a
    restart reads each range again as it was, and no state is kept: the task that meets a frame's end looks back for its
    begin. So chunks may end anywhere, within a character too. A log is read by many tasks, ``blockBytes`` each. Comments
    and frames without data are no rows; an open frame at the end of a log waits. Logs may only grow.
    The folder must be one that every worker reaches by this path or URI.
    """

    @classmethod
    def name(cls) -> str:
        return "event_logs"

    def schema(self) -> str:
        return "stream_id string, at long, event string, data string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(EventLogs)


def until_done(rows: DataFrame) -> DataFrame:
    """Frames before the first end mark of their stream."""
    ends = rows.where(F.col("data") == DONE).groupBy("stream_id").agg(F.min("at").alias("done"))
    return rows.join(ends, "stream_id", "left").where(F.col("done").isNull() | (F.col("at") < F.col("done"))).drop("done")


_SPAN = (
    "struct<traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, endTimeUnixNano string, "
    "attributes array<struct<key string, value struct<stringValue string>>>>"
)
OTLP = f"struct<resourceSpans array<struct<resource struct<attributes array<struct<key string, value struct<stringValue string>>>>, scopeSpans array<struct<spans array<{_SPAN}>>>>>>"


def otlp(service: str, attributes: Column) -> Column:
    """One span (trace_id, span_id, parent_span_id, name, start_ns, end_ns) as a line of OTLP JSON; attributes is a map of texts.

    Times are texts of nanoseconds, as the format wants them; a root has no parent, a null attribute is left out.
    """
    pair = lambda key, value: F.struct(key.alias("key"), F.struct(value.alias("stringValue")).alias("value"))
    listed = F.transform(F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull()), lambda e: pair(e["key"], e["value"]))
    span = F.struct(
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"),
        F.col("name"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").cast("string").alias("endTimeUnixNano"),
        listed.alias("attributes"),
    )
    scope = F.array(F.struct(F.array(span).alias("spans")))
    resource = F.struct(F.array(pair(F.lit("service.name"), F.lit(service))).alias("attributes"))
    return F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), scope.alias("scopeSpans"))).alias("resourceSpans")))


def export_spans(spans: DataFrame, path: str, service: str, attributes: Column) -> None:
    """Spans as lines of OTLP JSON files, by Spark's own committer: a failed job leaves no file in force."""
    spans.select(otlp(service, attributes).alias("value")).write.text(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of OTLP JSON files: (service, trace_id, span_id, parent_span_id, name, start_ns, end_ns, attributes)."""
    docs = spark.read.text(path).select(F.explode(F.from_json("value", OTLP)["resourceSpans"]).alias("r"))
    texts = lambda pairs: F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"], p["value"]["stringValue"])))
    scoped = docs.select(texts(F.col("r.resource.attributes"))["service.name"].alias("service"), F.explode("r.scopeSpans").alias("s"))
    spans = scoped.select("service", F.explode("s.spans").alias("p"))
    return spans.select(
        "service",
        F.col("p.traceId").alias("trace_id"),
        F.col("p.spanId").alias("span_id"),
        F.col("p.parentSpanId").alias("parent_span_id"),
        "p.name",
        F.col("p.startTimeUnixNano").cast("long").alias("start_ns"),
        F.col("p.endTimeUnixNano").cast("long").alias("end_ns"),
        texts(F.col("p.attributes")).alias("attributes"),
    )


def exported(spans: DataFrame, service: str, attributes: Column) -> DataFrame:
    """Spans after a way through OTLP files in the shared folder."""
    path = f"{Tables(spans.sparkSession).root}/spans"
    export_spans(spans, path, service, attributes)
    return read_spans(spans.sparkSession, path)
