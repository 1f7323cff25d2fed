"""Event logs of JSON lines as a Python data source: byte ranges of files are partitions, filters on fields are taken by the reader, a stream goes on
where its offsets say.

    spark.dataSource.register(EventLog)
    spark.read.format("event_log").option("path", folder).option("range_bytes", "8388608").load()

Files are found and read through pyarrow's file systems, so a path may be a URI of any store that those reach. A range owns the lines that begin in it.
Ranges have `range_bytes` bytes, or more where there would be over `max_ranges` of them, so that tasks do not grow in number with the log.
Lines that are no JSON objects, or have no event, are left out, as operators.events.parse_events() does. A stream's offset is each file's length up to
its last whole line: a torn last line waits for the rest of it. Batch reads need `spark.sql.python.filterPushdown.enabled` in their session.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

FIELDS = ["ts", "event", "sync_id", "pipeline_id", "stream", "payload"]
MOST = 256
TAKEN = {"event", "sync_id", "pipeline_id", "stream"}


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def files(path: str) -> dict[str, int]:
    """Names and sizes of the files in a folder, hidden ones left out."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = store.get_file_info(fs.FileSelector(root))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def opened(path: str, file: str):
    from pyarrow import fs

    store = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
    return store.open_input_file(file)


def ranges(file: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(file, a, min(a + size, end)) for a in range(start, end, size)]


def planned(spans: dict[str, tuple[int, int]], size: int, most: int) -> list[Range]:
    """The ranges of stretches of files, of at least `size` bytes and at most `most` in number, but for one a file."""
    size = max(size, -(-sum(max(0, b - a) for a, b in spans.values()) // most))
    return [r for file, (a, b) in sorted(spans.items()) for r in ranges(file, a, b, size)]


def lines(path: str, part: Range, block: int = 1 << 20) -> Iterator[bytes]:
    """The lines that begin in a range; the last one may end beyond it. Beyond the range little more is read than that line."""
    with opened(path, part.file) as f:
        skip = part.start > 0  # a line that begins at the range's start belongs to it
        begun = max(0, part.start - 1)
        f.seek(begun)
        at, step, held = begun, 1 << 12, []
        while True:
            if at < part.end:
                got = f.read(min(block, part.end - at))
            else:
                got, step = f.read(min(block, step)), 2 * step
            at += len(got)
            if got and b"\n" not in got:
                if skip and at >= part.end:  # no line begins here
                    return
                if not skip:
                    held.append(got)
                else:
                    begun += len(got)
                continue
            *whole, tail = b"".join([*held, got]).split(b"\n")
            if not got:
                whole, tail = ([tail] if tail else []), b""
            for line in whole:
                if skip:
                    skip = False
                elif begun >= part.end:
                    return
                else:
                    yield line
                begun += len(line) + 1
            held = [tail] if tail else []
            if not got or begun >= part.end:
                return


def as_text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def rows(path: str, part: Range, wanted: dict[str, set[str]]) -> Iterator[tuple]:
    for line in lines(path, part):
        try:
            e = json.loads(line)
        except ValueError:
            continue
        if isinstance(e, dict) and e.get("event") and all(as_text(e.get(k)) in v for k, v in wanted.items()):
            yield tuple([as_text(e.get(k)) for k in FIELDS])


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.most, self.wanted = options["path"], int(options.get("range_bytes", 8 << 20)), int(options.get("max_ranges", MOST)), {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in TAKEN:
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[Range]:
        return planned({file: (0, n) for file, n in files(self.path).items()}, self.size, self.most) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows(self.path, partition, self.wanted) if partition.file else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size, self.most = options["path"], int(options.get("range_bytes", 8 << 20)), int(options.get("max_ranges", MOST))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {file: self.whole(file, n) for file, n in files(self.path).items()}

    def whole(self, file: str, n: int, block: int = 1 << 16) -> int:
        """Where the last whole line ends."""
        with opened(self.path, file) as f:
            while n > 0:
                start = max(0, n - block)
                f.seek(start)
                at = f.read(n - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                n = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return planned({file: (start.get(file, 0), n) for file, n in end.items()}, self.size, self.most)

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows(self.path, partition, {})

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def typed(events):
    """ts as a timestamp."""
    return events.withColumn("ts", F.to_timestamp("ts"))
