"""Files by byte ranges, opened by the tasks that read them.

Spark's text reader takes whole files, and a list of them from the driver.
Here the paths are a table: tasks look the files up, failed look-ups are rows
with an error code, and a file is read as ranges of SPLIT_BYTES, each a row of
its own that any task can read.  A tail takes ranges from the file's end only,
until they hold the lines asked for.

Lines are split on ``\\n`` alone; one final newline ends the last line.  A range
has the lines that begin behind its newlines, and the first one also the
file's first line, so that lines are counted by counting newlines.

Files are opened through pyarrow (local and mounted folders, HDFS, S3, GCS);
paths without a scheme belong to Hadoop's default file system.  Gzip files are
one range.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsspark.session import keep, ship_package

#: bytes of a range, and bytes read at once
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 20
#: bytes of a range of a tail
TAIL_BYTES = 1 << 20

_FILE = re.compile(r"^file:/*")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def locate(path: str, default: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if _FILE.match(path):
        return fs.LocalFileSystem(), _FILE.sub("/", path)
    if _SCHEME.match(path):
        return fs.FileSystem.from_uri(path)
    if _FILE.match(default):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(default.rstrip("/") + path)


def _open(path: str, default: str):
    system, inner = locate(path, default)
    if path.endswith(".gz"):
        return system.open_input_stream(inner, compression="gzip")
    return system.open_input_file(inner)


def run_on_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def default_store(spark: SparkSession) -> str:
    """The file system of paths without a scheme."""
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")


def _look_up(path: str, default: str) -> tuple[int | None, str | None, str | None]:
    """(size, code, message): a code where the file cannot be read."""
    try:
        system, inner = locate(path, default)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            return None, "ENOENT", f"ENOENT: no such file '{path}'"
        if info.type == fs.FileType.Directory:
            return None, "EISDIR", f"EISDIR: '{path}' is a directory"
        with system.open_input_file(inner):
            return info.size, None, None
    except FileNotFoundError:
        return None, "ENOENT", f"ENOENT: no such file '{path}'"
    except PermissionError:
        return None, "EACCES", f"EACCES: no permission to read '{path}'"
    except (OSError, pa.ArrowException) as e:
        return None, "EIO", f"EIO: cannot read '{path}': {str(e).splitlines()[0] if str(e) else type(e).__name__}"


def list_files(paths: DataFrame, path_col: str = "file") -> DataFrame:
    """(path, size, code, message) of the distinct non-null paths: ``code`` and ``message`` of those that cannot be read."""
    default = default_store(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_look_up(p, default) for p in batch.column("path").to_pylist()]
            size, code, message = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(size, pa.int64()), pa.array(code, pa.string()), pa.array(message, pa.string())],
                                             ["path", "size", "code", "message"])

    names = paths.select(F.col(path_col).alias("path")).filter("path is not null").distinct()
    return run_on_batches(names, run, "path string, size long, code string, message string")


def _whole(path: Column) -> Column:
    return path.endswith(".gz")


def _n_ranges(split_bytes: int) -> Column:
    return F.when(_whole(F.col("path")), 1).otherwise(F.ceil(F.col("size") / split_bytes)).cast("long")


def _bounds(at: Column, split_bytes: int) -> list[Column]:
    """First byte, and the byte behind the last, of a file's range ``at``."""
    start = at * split_bytes
    return [start.cast("long").alias("start"),
            F.when(_whole(F.col("path")), F.col("size")).otherwise(F.least(start + split_bytes, "size")).cast("long").alias("end")]


def file_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The ranges of the readable files of ``list_files`` in which something lies: their columns, start, end."""
    found = files.filter(F.col("size") > 0)
    at = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), _n_ranges(split_bytes) - 1)).alias("at"))
    return at.select(*files.columns, *_bounds(F.col("at"), split_bytes))


def deal_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (path, start, ...), each a row that stands for far more bytes, dealt to as many tasks as a shuffle has.

    The number is given, as rows so small would otherwise be put together into one task."""
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, F.col("path"), F.col("start"))


def _pieces(file, start: int, compressed: bool) -> Iterator[bytes]:
    if not compressed:
        file.seek(start)
    while data := file.read(READ_BYTES):
        yield data


def count_lines(path: str, start: int, end: int, size: int, default: str) -> int:
    """Lines of a range: its newlines but for the file's final one, and the first line of the file."""
    compressed = path.endswith(".gz")
    with _open(path, default) as file:
        pos, lines, last = start, 0, b""
        for data in _pieces(file, start, compressed):
            data = data if compressed else data[:end - pos]
            lines += data.count(b"\n")
            pos += len(data)
            last = data[-1:]
            if not compressed and pos >= end:
                break
        final = last == b"\n" and (compressed or pos >= size)
        return lines - final + (start == 0 and pos > 0)


def range_lines(path: str, start: int, end: int, default: str, skip: int = 0) -> Iterator[tuple[int, bytes]]:
    """(place in the range, text) of a range's lines from the ``skip``-th on, read on behind its end until the last one is whole."""
    compressed = path.endswith(".gz")
    with _open(path, default) as file:
        pos, parts, inside, place = start, [], start == 0, 0
        for data in _pieces(file, start, compressed):
            at = 0
            while (newline := data.find(b"\n", at)) >= 0:
                if inside:
                    if place >= skip:
                        parts.append(data[at:newline])
                        yield place, b"".join(parts)
                    parts, place = [], place + 1
                if not compressed and pos + newline >= end:
                    return
                inside, at = True, newline + 1
            if inside:
                parts.append(data[at:])
            pos += len(data)
            if not inside and pos >= end:
                return
        rest = b"".join(parts)
        if rest and place >= skip:
            yield place, rest


_LINES_AT_ONCE, _LINE_BYTES = 4096, 4 << 20


def read_ranges(ranges: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of the ranges (path, start, end, skip): ``columns`` of their range, block (its start), row, raw.

    (block, row) is the order of a file's lines.  Every range is a row that is
    dealt by itself, so that a large file is read by many tasks.
    """
    default = default_store(ranges.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in ranges.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "block long", "row long", "raw string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, start, end, skip = (batch.column(c)[i].as_py() for c in ("path", "start", "end", "skip"))
                rows, size = [], 0

                def done() -> pa.RecordBatch:
                    # a range's columns are repeated for each of its lines
                    own = [batch.column(c).take(pa.array([i] * len(rows))) for c in columns]  # noqa: B023
                    place, text = zip(*rows, strict=True)  # noqa: B023
                    return pa.RecordBatch.from_arrays(
                        [*own, pa.array([start] * len(rows), pa.int64()), pa.array(place, pa.int64()),  # noqa: B023
                         pa.array([t.decode("utf-8", "replace") for t in text], pa.string())], [*columns, "block", "row", "raw"])

                for place, text in range_lines(path, start, end, default, skip):
                    rows.append((place, text))
                    size += len(text)
                    if len(rows) >= _LINES_AT_ONCE or size >= _LINE_BYTES:
                        yield done()
                        rows, size = [], 0
                if rows:
                    yield done()

    needed = list(dict.fromkeys([*columns, "path", "start", "end", "skip"]))
    return run_on_batches(deal_ranges(ranges.select(*needed)), run, schema)


def _counted(ranges: DataFrame) -> DataFrame:
    """Ranges (path, size, at, start, end) with their number of lines."""
    default = default_store(ranges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            here = [count_lines(r["path"], r["start"], r["end"], r["size"], default) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(here, pa.int64())], [*batch.schema.names, "here"])

    own = deal_ranges(ranges.select("path", "size", "at", "start", "end"))
    return run_on_batches(own, run, "path string, size long, at long, start long, end long, here long")


def tail_ranges(files: DataFrame, n: int, split_bytes: int = TAIL_BYTES) -> DataFrame:
    """The last ranges of every readable file that hold its last ``n`` lines: path, start, end, skip, later (lines in the ranges behind).

    Rounds take 1, 2, 4, ... further ranges from the end of each file that has not
    yet shown n lines, so that what is read of a file is at most about twice
    what its tail takes (and a range at least), and a long tail is counted by many tasks.
    """
    open_files = files.filter(F.col("size") > 0).select("path", "size", _n_ranges(split_bytes).alias("ranges"), F.lit(0).cast("long").alias("seen"))
    counted, taken, step = None, 0, 1
    while n > 0:
        last = F.col("ranges") - 1 - taken
        at = F.explode(F.sequence(F.greatest(last - (step - 1), F.lit(0).cast("long")), last))
        found = keep(_counted(open_files.select("path", "size", at.alias("at")).select("path", "size", "at", *_bounds(F.col("at"), split_bytes))))
        counted = found if counted is None else counted.unionByName(found)
        taken, step = taken + step, 2 * step
        more = found.groupBy("path").agg(F.sum("here").alias("_here"))
        open_files = keep(open_files.join(more, "path").withColumn("seen", F.col("seen") + F.col("_here")).drop("_here")
                          .filter((F.col("seen") < n) & (F.col("ranges") > taken)))
        if open_files.isEmpty():
            break
    if counted is None:
        counted = files.filter(F.lit(False)).select("path", "size", *[F.lit(0).cast("long").alias(c) for c in ("at", "start", "end", "here")])
    behind = Window.partitionBy("path").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum("here").over(behind), F.lit(0)).cast("long")
    return (counted.withColumn("later", later).filter(F.col("later") < n)
            .select("path", "start", "end", F.greatest(F.col("here") + F.col("later") - n, F.lit(0)).cast("long").alias("skip"), "later", "here"))


def tail_files(files: DataFrame, n: int, split_bytes: int = TAIL_BYTES) -> DataFrame:
    """W1 of files: path, block, row, raw, from_end (1 for the last) of the last ``n`` lines of every readable file."""
    lines = read_ranges(tail_ranges(files, n, split_bytes), ["path", "later", "here"])
    return lines.select("path", "block", "row", "raw", (F.col("later") + F.col("here") - F.col("row")).alias("from_end"))
