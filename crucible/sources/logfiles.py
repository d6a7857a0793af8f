"""Transcripts and run logs as data sources: ``spark.read.format("transcripts")`` and ``readStream``, a partition for each file or so many of them."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from crucible.sources.readers import HEADER, LOG_LINE

TRANSCRIPT = "file string, message int, agent string, text string"
RUN_LOG = "file string, stem string, ok boolean, elapsed_s double, tool_calls int, input_tokens long, output_tokens long"


@dataclass
class Files(InputPartition):
    """Paths that one task reads."""

    paths: tuple[str, ...]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def listing(path: str, suffix: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, bytes) of the files below ``path`` with an ending, in order of time, then path."""
    from pyarrow import fs

    system, at = _file_system(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.is_file and f.path.endswith(suffix) and not posixpath.basename(f.path).startswith(("_", ".")))


def dealt(files: list[tuple[int, str, int]], most_bytes: int) -> list[Files]:
    """Partitions of files one after the other, of about ``most_bytes``; a larger file is one of its own."""
    out: list[list[str]] = []
    size = 0
    for _, path, n in files:
        if not out or size + n > most_bytes:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n
    return [Files(tuple(p)) for p in out]


def lines_of(system, path: str) -> Iterator[str]:
    """Lines of a file, a part of it in memory at a time."""
    rest = b""
    with system.open_input_stream(path) as f:
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def messages(name: str, lines: Iterator[str]) -> Iterator[tuple]:
    """(file, message, agent, text): one message at a time; what stands before the first head is dropped."""
    number, agent, held = 0, None, []
    for line in lines:
        head = re.search(HEADER, line.rstrip("\r"))
        if not head:
            held.append(line)
            continue
        if agent is not None:
            yield name, number, agent, "\n".join(held).strip(" ")
        number, agent, held = number + 1, head.group(1), []
    if agent is not None:
        yield name, number, agent, "\n".join(held).strip(" ")


def progress(name: str, lines: Iterator[str]) -> Iterator[tuple]:
    """A row for each progress line; other lines are dropped."""
    for line in lines:
        if m := re.search(LOG_LINE, line):
            _, _, state, image, seconds, tools, ins, outs = m.groups()
            stem = posixpath.basename(image)
            yield name, stem.rsplit(".", 1)[0] if "." in stem[1:] else stem, state == "OK", float(seconds), int(tools), int(ins), int(outs)


KINDS = {"transcripts": (TRANSCRIPT, messages, ".txt"), "runlogs": (RUN_LOG, progress, ".log")}


class _Reading:
    """What the batch and the stream reader share. Options: path, suffix, maxBytes for a partition, maxFilesPerTrigger."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.suffix = options.get("suffix", KINDS[kind][2])
        self.most_bytes = int(options.get("maxBytes", 32 << 20))
        self.each = int(options.get("maxFilesPerTrigger", 0))

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        for path in partition.paths:
            yield from KINDS[self.kind][1](posixpath.basename(path), lines_of(system, path))


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(listing(self.path, self.suffix), self.most_bytes) or [Files(())]


class StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the (time, path) of the last file taken. Files land whole (by renaming) and with times that don't go back."""

    def __init__(self, kind: str, options: dict):
        super().__init__(kind, options)
        self.at: tuple[int, str] = (-1, "")

    def initialOffset(self) -> dict:
        return {"time": "-1", "path": ""}

    def latestOffset(self) -> dict:
        new = [f for f in listing(self.path, self.suffix) if (f[0], f[1]) > self.at]
        if new:
            last = new[min(self.each or len(new), len(new)) - 1]
            self.at = (last[0], last[1])
        return {"time": str(self.at[0]), "path": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((int(o["time"]), o["path"]) for o in (start, end))
        self.at = max(self.at, high)
        return dealt([f for f in listing(self.path, self.suffix) if low < (f[0], f[1]) <= high], self.most_bytes) or [Files(())]

    def commit(self, end: dict) -> None:
        pass


class Transcripts(DataSource):
    KIND = "transcripts"

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return KINDS[self.KIND][0]

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.KIND, dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.KIND, dict(self.options))


class RunLogs(Transcripts):
    KIND = "runlogs"


def register(spark: SparkSession) -> None:
    for source in (Transcripts, RunLogs):
        spark.dataSource.register(source)
