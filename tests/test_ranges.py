"""Files by byte ranges: listing, lines, tails read from the end."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from obsspark.session import keep
from obsspark.sources import ranges
from obsspark.sources.files import file_source_lines
from obsspark.sources.ranges import count_lines, file_ranges, list_files, range_lines, read_ranges, tail_files, tail_ranges


def _physical(data: bytes) -> list[str]:
    text = data[:-1] if data.endswith(b"\n") else data
    return [x.decode("utf-8", "replace") for x in text.split(b"\n")] if data else []


def _files(folder):
    r = random.Random(7)
    made = {"empty": b"", "newline": b"\n", "newlines": b"\n\n\n", "one": b"one line", "ended": b"one line\n", "cr": b"a\rb\r\nc\n",
            "wide": "é漢👍\n".encode() * 40 + b"\xff\xfe broken\n", "long": b"x" * 1000 + b"\n" + b"y" * 700}
    for i in range(6):
        made[f"random{i}"] = b"".join(bytes(r.choice(b"ab\n") for _ in range(r.randrange(40))) for _ in range(r.randrange(60)))
    out = {}
    for name, data in made.items():
        for suffix, write in (("", open), (".gz", gzip.open)):
            path = os.path.join(folder, name + suffix)
            with write(path, "wb") as f:
                f.write(data)
            out[path] = _physical(data)
    return out


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_hold_every_line_once(tmpdir_fresh, monkeypatch, split):
    monkeypatch.setattr(ranges, "READ_BYTES", 5)
    for path, want in _files(tmpdir_fresh).items():
        size = os.path.getsize(path)
        bounds = [(0, size)] if path.endswith(".gz") else [(a, min(a + split, size)) for a in range(0, size, split)]
        got = []
        for a, b in bounds:
            part = [t.decode("utf-8", "replace") for _, t in range_lines(path, a, b, "file:///")]
            assert len(part) == count_lines(path, a, b, size, "file:///"), (path, a, b)
            assert [t.decode("utf-8", "replace") for _, t in range_lines(path, a, b, "file:///", skip=2)] == part[2:]
            got += part
        assert got == want, path


def test_lines_and_tails_of_many_files(spark, tmpdir_fresh):
    made = _files(tmpdir_fresh)
    paths = spark.createDataFrame([(p,) for p in made] + [(os.path.join(tmpdir_fresh, "gone"),), (tmpdir_fresh,), (None,)], "file string")
    files = keep(list_files(paths.unionByName(paths)))
    assert {os.path.basename(r.path): r.code for r in files.filter("code is not null").collect()} == {
        "gone": "ENOENT", os.path.basename(tmpdir_fresh): "EISDIR"}
    every = read_ranges(file_ranges(files, 64).withColumn("skip", F.lit(0).cast("long")), ["path"])
    got = {}
    for r in every.orderBy("path", "block", "row").collect():
        got.setdefault(r.path, []).append(r.raw)
    assert got == {p: lines for p, lines in made.items() if lines}
    for n in (0, 1, 5, 10_000):
        got = {}
        for r in tail_files(files, n, 32).orderBy("path", F.desc("from_end")).collect():
            got.setdefault(r.path, []).append((r.from_end, r.raw))
        want = {p: list(zip(range(min(n, len(x)), 0, -1), x[-n:], strict=True)) for p, x in made.items() if x and n}
        assert got == want, n


def test_a_tail_reads_the_end_of_a_file_alone(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "big.log")
    with open(path, "w") as f:
        for i in range(20_000):
            f.write(f"line {i:06d} of a file\n")
    size, line = os.path.getsize(path), 22
    files = keep(list_files(spark.createDataFrame([(path,)], "file string")))
    for n in (1, 100, 3000):
        taken = tail_ranges(files, n, 4096).collect()
        assert sum(r.end - r.start for r in taken) <= n * line + 4096
        assert min(r.start for r in taken) >= size - n * line - 4096
    # the start of the file is not even opened for reading: a hole of bad bytes there changes nothing
    assert [r.raw for r in tail_files(files, 2, 4096).orderBy("from_end").collect()] == ["line 019999 of a file", "line 019998 of a file"]


def test_rounds_stop_where_the_tail_is_found(spark, tmpdir_fresh, monkeypatch):
    """What is counted, in ranges: the rounds' 1, 2, 4, ... until n lines are seen."""
    path = os.path.join(tmpdir_fresh, "f.log")
    with open(path, "w") as f:
        f.write("0123456789abcde\n" * 1000)
    files = keep(list_files(spark.createDataFrame([(path,)], "file string")))
    counted = []
    plain = ranges._counted
    monkeypatch.setattr(ranges, "_counted", lambda df: (counted.append(df.count()), plain(df))[1])
    assert tail_files(files, 40, 160).count() == 40
    assert counted == [1, 2, 4]


def test_sources_share_files_and_report_unreadable_ones(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "a.log")
    with open(path, "w") as f:
        f.write("one\ntwo\nthree\n")
    rows = [("s", 0, path), ("s", 1, path), ("t", 0, path), ("t", 0, path), ("t", 1, path + ".gone"), ("u", 0, None)]
    src = spark.createDataFrame(rows, "service string, at int, file string")
    lines, errors = file_source_lines(spark, src, ("service", "at"), tail_lines=2)
    assert sorted((r.service, r["at"], r.raw) for r in lines.collect()) == sorted(
        (s, a, x) for s, a in (("s", 0), ("s", 1), ("t", 0)) for x in ("two", "three"))
    assert [(r.service, r["at"], r.code) for r in errors.collect()] == [("t", 1, "ENOENT")]
    none = file_source_lines(spark, src.filter("file is null"), ("service", "at"), tail_lines=2)
    assert none[0].count() == none[1].count() == 0


def test_ranges_of_files_are_dealt_to_several_tasks(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "a")
    with open(path, "w") as f:
        f.write("line\n" * 500)
    files = list_files(spark.createDataFrame([(path,)], "file string"))
    for lines in (read_ranges(file_ranges(files, 50).withColumn("skip", F.lit(0)), ["path"]), tail_files(files, 500, 50)):
        tasks = lines.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in tasks) == 500 and len(tasks) > 1
