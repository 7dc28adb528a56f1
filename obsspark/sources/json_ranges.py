"""Elements of large JSON documents by byte ranges.

A list page is one JSON document whose ``items`` may be gigabytes.  Instead of
one task parsing it as a whole, it is cut into ranges.  What a range does to the
two things that a JSON scanner remembers, whether it is inside a string and how
deep it is nested, is counted for both cases of the first; summed up over the
ranges before, it tells each range its true beginning.  Every range then yields
the elements that begin in it, reading on until the last one is closed, with
their numbers in the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsspark.session import keep
from obsspark.sources.ranges import READ_BYTES, deal_ranges, default_store, file_ranges, locate, run_on_batches

#: bytes of a range, and bytes read at least behind it for its last element
SPLIT_BYTES, _BEHIND_BYTES = 16 << 20, 4 << 10

_QUOTE, _ESCAPE = ord('"'), ord("\\")
_CHANGE = np.zeros(256, dtype=np.int8)
_CHANGE[[ord("{"), ord("[")]] = 1
_CHANGE[[ord("}"), ord("]")]] = -1
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


def _escapes_before(file, start: int) -> int:
    """Backslashes right before a place of a file, counted modulo 2."""
    n, step = 0, 64
    while start > 0:
        lo = max(0, start - step)
        file.seek(lo)
        data = file.read(start - lo)
        run = len(data) - len(data.rstrip(b"\\"))
        n += run
        if run < len(data):
            break
        start, step = lo, 2 * step
    return n % 2


def structure(data: bytes, escaped: int, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Brackets outside strings: places, +1 or -1 each, and depth behind each from 0 on; and whether ``data`` ends inside a string.

    ``escaped``: an odd number of backslashes stands before; ``inside``: it begins in a string."""
    raw = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(raw == _QUOTE)
    slash = np.flatnonzero(np.concatenate([[bool(escaped)], raw == _ESCAPE]))
    if len(slash) and len(quotes):
        # the run of backslashes that ends right before a quote is odd
        first = np.concatenate([[True], np.diff(slash) > 1])
        run = np.arange(len(slash)) - np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0)) + 1
        at = np.searchsorted(slash, quotes)
        before = np.minimum(at, len(slash) - 1)
        odd = (slash[before] == quotes) & (run[before] % 2 == 1)
        quotes = quotes[~odd]
    places = np.flatnonzero(_CHANGE[raw])
    outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
    places = places[outside]
    change = _CHANGE[raw[places]].astype(np.int64)
    return places, change, np.cumsum(change), (len(quotes) + inside) % 2


def _key_before(file, place: int) -> str | None:
    """The object key of the value that begins at a place; None in front of a document's first bracket."""
    step = 256
    while True:
        lo = max(0, place - step)
        file.seek(lo)
        found = _KEY.search(file.read(place - lo))
        if found and (lo == 0 or found.start() > 0):
            return found.group(1).decode()
        if lo == 0:
            return None
        step *= 4


def _containers(file, start: int, key: str | None, depth: int, places, change, behind) -> tuple[np.ndarray, list[bool]]:
    """Places in a range where a container of elements may begin, and whether each is the wanted array."""
    level = 0 if key is None else 1
    opened = np.flatnonzero((change > 0) & (behind + depth - 1 == level))
    wanted = []
    for i in opened:
        file.seek(start + int(places[i]))
        array = file.read(1) == b"["
        wanted.append(array and (key is None or _key_before(file, start + int(places[i])) == key))
    return opened, wanted


def _scan(key: str | None, store: str, run_one, schema: str, names: list[str], types: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, inner = locate(row["path"], store)
                with system.open_input_file(inner) as file:
                    rows, size = [], 0
                    for out in run_one(file, row, key):
                        rows.append(out)
                        size += len(out[-1]) if isinstance(out[-1], str) else 0
                        if len(rows) >= 10_000 or size >= READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    return run


def _read(file, start: int, end: int) -> bytes:
    file.seek(start)
    return file.read(end - start)


def _effect(file, row: dict, key: str | None) -> Iterator[tuple]:
    """What a range does to a scanner that enters it outside or inside a string."""
    escaped, data = _escapes_before(file, row["start"]), _read(file, row["start"], row["end"])
    _, change, _, ends = structure(data, escaped, 0)
    outside, every = int(change.sum()), int(_CHANGE[np.frombuffer(data, dtype=np.uint8)].sum(dtype=np.int64))
    # entered inside a string, the other brackets count
    yield row["path"], row["size"], row["start"], row["end"], ends, outside, every - outside


def _starts(file, row: dict, key: str | None):
    """(places of elements, whether each is in the wanted array or None before the range's first container, its last container)."""
    places, change, behind, _ = structure(_read(file, row["start"], row["end"]), _escapes_before(file, row["start"]), row["inside"])
    opened, wanted = _containers(file, row["start"], key, row["depth"], places, change, behind)
    elements = np.flatnonzero((change > 0) & (behind + row["depth"] - 1 == (1 if key is None else 2)))
    owner = np.searchsorted(opened, elements) - 1
    return places[elements], [None if o < 0 else wanted[o] for o in owner], wanted[-1] if wanted else None


def _counts(file, row: dict, key: str | None) -> Iterator[tuple]:
    """How many elements begin in a range: in a container from before, in the wanted array begun here; what its last container is."""
    _, owners, last = _starts(file, row, key)
    yield (*(row[c] for c in ("path", "start", "end", "inside", "depth")), sum(o is None for o in owners), sum(o is True for o in owners), last)


def _elements(file, row: dict, key: str | None) -> Iterator[tuple]:
    """(path, number, text) of the wanted elements that begin in a range."""
    places, owners, _ = _starts(file, row, key)
    places = [int(p) for p, o in zip(places, owners, strict=True) if o or (o is None and row["carried"])]
    if not places:
        return
    start, level = row["start"], 1 if key is None else 2
    # most often the last element goes on behind the range, and by less than the range's size
    more = max((row["end"] - start) // 8, _BEHIND_BYTES)
    escaped, data = _escapes_before(file, start), _read(file, start, row["end"] + more)
    while True:
        at, change, behind, _ = structure(data, escaped, row["inside"])
        closed = at[(change < 0) & (behind + row["depth"] == level)]
        end = np.searchsorted(closed, places)
        if end[-1] < len(closed):
            break
        file.seek(start + len(data))
        further = file.read(more)
        if not further:
            raise ValueError(f"{row['path']} is no whole JSON document: the element at byte {start + places[-1]} has no end")
        data, more = data + further, 2 * more
    for i, (p, e) in enumerate(zip(places, end, strict=True)):
        yield row["path"], row["number"] + i, data[p:int(closed[e]) + 1].decode()


def json_elements(files: DataFrame, key: str | None = "items", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, item, value): the objects in the array ``key`` of each document (path, size), or in the document if it is an array (None).

    ``item`` is the place in the array from 0.  Three passes over the bytes: effects,
    counts, elements; each range is a row of its own.
    """
    store = default_store(files.sparkSession)

    def scan(df: DataFrame, run_one, schema: str) -> DataFrame:
        fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t] for _, t in fields]
        return run_on_batches(deal_ranges(df), _scan(key, store, run_one, schema, [n for n, _ in fields], types), schema)

    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(c) -> F.Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    ranges = file_ranges(files.select("path", "size"), split_bytes)
    effects = keep(scan(ranges, _effect, "path string, size long, start long, end long, turned int, outside long, within long"))
    entered = effects.withColumn("inside", (so_far("turned") % 2).cast("int"))
    entered = entered.withColumn("depth", so_far(F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within"))).cast("long"))
    counted = keep(scan(entered.select("path", "start", "end", "inside", "depth"), _counts,
                        "path string, start long, end long, inside int, depth long, carried_n long, own_n long, last boolean"))
    numbered = counted.withColumn("carried", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(False)))
    numbered = numbered.withColumn("number", so_far(F.col("own_n") + F.when(F.col("carried"), F.col("carried_n")).otherwise(0)).cast("long"))
    return scan(numbered.select("path", "start", "end", "inside", "depth", "carried", "number"), _elements, "path string, item long, value string")


def json_files(spark: SparkSession, paths) -> DataFrame:
    """(path, size) of files, folders or patterns; contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
