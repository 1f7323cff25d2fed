import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from syncproof.sources import eventlog
from syncproof.sources.eventlog import EventLog, Range, Reader, StreamReader, lines, ranges


@pytest.fixture()
def folder(tmp_path):
    body = [json.dumps({"event": "a" if i % 3 else "b", "ts": "2024-01-01T00:00:00Z", "sync_id": f"s{i}", "pipeline_id": i, "stream": "é" * (i % 7), "payload": {"k": [i]}}, ensure_ascii=False) for i in range(200)]
    (tmp_path / "one.jsonl").write_text("\n".join([*body[:150], "torn {", "", '"no object"', "[1]"]) + "\n")
    (tmp_path / "two.jsonl").write_text("\n".join(body[150:]))  # no newline at the end
    (tmp_path / "_hidden").write_text(body[0] + "\n")
    return tmp_path


def test_each_line_is_in_one_range(folder):
    data = (folder / "one.jsonl").read_bytes()
    for size in (1, 7, 64, 1000, 10**6):
        for block in (5, 1 << 20):
            got = [line for r in ranges(str(folder / "one.jsonl"), 0, len(data), size) for line in lines(str(folder), r, block)]
            assert b"\n".join(got) + b"\n" == data
            if size < 64 and block == 5:
                break


def test_reader_takes_filters_on_fields(folder):
    reader = Reader({"path": str(folder), "range_bytes": "500"})
    left = list(reader.pushFilters([EqualTo(("event",), "b"), In(("sync_id",), ("s0", "s3", "s4")), GreaterThan(("ts",), "2024"), EqualTo(("payload",), "x")]))
    assert [type(f) for f in left] == [GreaterThan, EqualTo]
    parts = reader.partitions()
    assert len(parts) > 20 and {p.file.rsplit("/", 1)[-1] for p in parts} == {"one.jsonl", "two.jsonl"}
    got = [r for p in parts for r in reader.read(p)]
    assert [(r[1], r[2], r[3], r[5]) for r in got] == [("b", "s0", "0", '{"k":[0]}'), ("b", "s3", "3", '{"k":[3]}')]


def test_stream_waits_for_whole_lines(folder):
    reader = StreamReader({"path": str(folder), "range_bytes": "300"})
    first = reader.latestOffset()
    seen = [r[2] for p in reader.partitions(reader.initialOffset(), first) for r in reader.read(p)]
    assert seen == [f"s{i}" for i in range(199)]
    with (folder / "two.jsonl").open("a") as f:
        f.write('\n{"event":"c","sync_id":"s200"}\n{"event":"c"')
    second = reader.latestOffset()
    assert [r[2] for p in reader.partitions(first, second) for r in reader.read(p)] == ["s199", "s200"]
    assert reader.partitions(second, reader.latestOffset()) == []


def test_folder_without_files(tmp_path, spark):
    session = spark.newSession()
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    session.dataSource.register(EventLog)
    assert session.read.format("event_log").option("path", str(tmp_path)).load().count() == 0
    assert list(Reader({"path": str(tmp_path)}).read(Range("", 0, 0))) == []


def test_ranges_do_not_grow_in_number_with_the_log(folder):
    """Of a larger log ranges are longer, and all of its lines are read once."""
    for make in (Reader, StreamReader):
        reader = make({"path": str(folder), "range_bytes": "10", "max_ranges": "12"})
        parts = reader.partitions() if make is Reader else reader.partitions({}, reader.latestOffset())
        assert 10 < len(parts) <= 14
        assert [r[2] for p in parts for r in reader.read(p)] == [f"s{i}" for i in range(200 if make is Reader else 199)]


def test_a_range_reads_little_beyond_itself(tmp_path, monkeypatch):
    """Not a block of a megabyte for each range, and of a line of many ranges no range but the one that it begins in reads the rest."""
    path = tmp_path / "log"
    path.write_bytes(b"x" * 3_000_000 + b"\n" + b"y" * 99 + b"\n")
    read = []

    class Counted:
        def __init__(self, file):
            self.f = open(file, "rb")  # noqa: SIM115
            self.seek = self.f.seek

        def read(self, n):
            got = self.f.read(n)
            read.append(len(got))
            return got

        def __enter__(self):
            return self

        def __exit__(self, *e):
            self.f.close()

    monkeypatch.setattr(eventlog, "opened", lambda folder, file: Counted(file))
    got = [line for r in ranges(str(path), 0, 3_000_101, 10_000) for line in lines(str(tmp_path), r)]
    assert list(map(len, got)) == [3_000_000, 99] and sum(read) < 3 * 3_000_101
