"""Reads of video sources as a stream: frames, ends of files, temporary failures of cameras.

Each source writes a log of its reads, one JSON object in a line: a frame (``{"frame": 7}``), a
failed read (``{"error": "..."}``) or, for a finished file, the end (``{"eof": true}``). The reader
has one partition for each source with new lines, and its offset counts the lines of each source, so
a restart goes on where the last batch ended. A source that cannot be read (reported once, until it
is back), or a line that is no JSON, is a temporary failure of this source and stops no other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, number long, status string, frame_index long, detail string"
NAME = "source_reads"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _lines(path: str) -> list[str]:
    files, place = _files(path)
    with files.open_input_stream(place) as stream:
        text = stream.read().decode("utf-8", "replace")
    # A line without its end is still being written.
    return text.split("\n")[:-1]


def _status(line: str) -> tuple[str, int | None, str | None]:
    try:
        row = json.loads(line)
        if row.get("eof"):
            return "EOF", None, None
        if "frame" in row:
            return "FRAME", int(row["frame"]), None
        return "TEMPORARY_FAILURE", None, str(row.get("error"))
    except (ValueError, TypeError, AttributeError) as wrong:
        return "TEMPORARY_FAILURE", None, str(wrong)


class _Span(InputPartition):
    """Lines ``start`` to ``end`` of a source, or the notice of a failure."""

    def __init__(self, source: str, path: str, start: int, end: int, notice: str | None = None) -> None:
        self.source, self.path, self.start, self.end, self.notice = source, path, start, end, notice


class _Reader(DataSourceStreamReader):
    """Offsets: for each source the lines that have been read and the failures that were reported.

    A source that cannot be read keeps its lines and gets one notice, until it can be read again.
    Planned batches are noted in ``progress``, for a restart while a source is away.
    """

    def __init__(self, options: dict) -> None:
        self.sources = json.loads(options["sources"])
        self.progress = options.get("progress")
        self.known, self.down = self._noted(), set()

    def _noted(self) -> dict:
        if self.progress:
            files, place = _files(self.progress)
            try:
                with files.open_input_stream(place) as stream:
                    return json.loads(stream.read())
            except FileNotFoundError:
                pass
        return {}

    def initialOffset(self) -> dict:
        return {name: {"lines": 0, "notices": 0} for name in self.sources}

    def latestOffset(self) -> dict:
        for name, path in self.sources.items():
            seen = dict(self.known.get(name, {"lines": 0, "notices": 0}))
            try:
                lines = len(_lines(path))
            except OSError:
                lines = -1
            if lines >= seen["lines"]:
                seen["lines"] = lines
                self.down.discard(name)
            elif name not in self.down:  # away, or cut short
                seen["notices"] += 1
                self.down.add(name)
            self.known[name] = seen
        return {name: dict(seen) for name, seen in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        # Spark has logged this batch, so it will be read, now or after a restart.
        if self.progress:
            files, place = _files(self.progress)
            with files.open_output_stream(place) as stream:
                stream.write(json.dumps(end).encode())
        spans = []
        for name, path in self.sources.items():
            nothing = {"lines": 0, "notices": 0}
            first, last = start.get(name, nothing), end.get(name, nothing)
            if first["notices"] < last["notices"]:
                spans.append(_Span(name, path, 0, 0, "the source cannot be read"))
            if first["lines"] < last["lines"]:
                spans.append(_Span(name, path, first["lines"], last["lines"]))
        return spans

    def read(self, partition: _Span) -> Iterator[tuple]:
        if partition.notice:
            yield partition.source, None, "TEMPORARY_FAILURE", None, partition.notice
            return
        # A failure here fails the task: Spark tries the same lines again, so none are lost.
        for number, line in enumerate(_lines(partition.path)[partition.start : partition.end], partition.start):
            yield (partition.source, number, *_status(line))


class SourceReads(DataSource):
    """``spark.readStream.format("source_reads").option("sources", '{"cam1": "path", ...}')``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def read_stream(spark: SparkSession, sources: dict[str, str], progress: str | None = None) -> DataFrame:
    """The stream of reads of named sources; ``status`` is FRAME, EOF or TEMPORARY_FAILURE.

    ``progress`` names a file in a folder that survives the driver.
    """
    spark.dataSource.register(SourceReads)
    stream = spark.readStream.format(NAME).option("sources", json.dumps(sources))
    return (stream.option("progress", progress) if progress else stream).load()
