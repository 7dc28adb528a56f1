"""Elements of JSON documents cut at any byte."""

import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from obsspark.sources.json_ranges import _elements, json_elements, json_files, structure


def _document(r, key):
    def text():
        return "".join(r.choice(['"', "\\", "{", "}", "[", "]", "a", "é", "👍", "\n", ":", ",", '\\"', '"items":[']) for _ in range(r.randrange(12)))

    def value(depth):
        kind = r.randrange(6 if depth < 3 else 3)
        if kind == 0:
            return text()
        if kind == 1:
            return r.choice([1, -2.5, None, True])
        if kind == 2:
            return {}
        if kind == 3:
            return {text(): value(depth + 1) for _ in range(r.randrange(4))}
        return [value(depth + 1) for _ in range(r.randrange(4))]

    items = [{"id": i, text(): value(0), "x": text() * r.randrange(3)} for i in range(r.randrange(12))]
    if key is None:
        return items, items
    other = {"kind": text(), "metadata": {"a": [{"b": text()}], "items": [{"not": "this"}]}, "more": [{"nor": text()}, [1]], "list": {"o": {"p": {}}}}
    names = list(other)
    r.shuffle(names)
    cut = r.randrange(len(names) + 1)
    return {**{n: other[n] for n in names[:cut]}, key: items, **{n: other[n] for n in names[cut:]}}, items


@pytest.mark.parametrize("key, split", [("items", 1), ("items", 13), ("items", 1 << 20), (None, 3), (None, 50)])
def test_elements_of_documents(spark, tmpdir_fresh, key, split):
    r = random.Random(split)
    want = {}
    for i in range(8 if split > 1 else 2):
        path = os.path.join(tmpdir_fresh, f"page {i}.json")
        document, items = _document(r, key)
        with open(path, "w") as f:
            json.dump(document, f, ensure_ascii=bool(i % 2), indent=r.choice([None, 2]))
        want[os.path.basename(path)] = items
    got = {n: [] for n in want}
    for row in json_elements(json_files(spark, tmpdir_fresh), key, split).orderBy("path", "item").collect():
        got[os.path.basename(row.path)].append((row.item, json.loads(row.value)))
    assert got == {n: list(enumerate(items)) for n, items in want.items()}


def test_a_cut_document_raises(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "cut.json")
    with open(path, "w") as f:
        f.write('{"items": [{"a": 1}, {"b": [1, 2')
    with pytest.raises(Exception, match="no whole JSON document"):
        json_elements(json_files(spark, path), "items", 8).collect()


def test_ranges_are_dealt_to_several_tasks(spark, tmpdir_fresh):
    """A range's row is small, what it stands for is not: rows are not put together into one task."""
    with open(os.path.join(tmpdir_fresh, "a.json"), "w") as f:
        json.dump({"items": [{"id": i} for i in range(500)]}, f)
    found = json_elements(json_files(spark, tmpdir_fresh), "items", 64)
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 500 and len(tasks) > 1
    assert max(r["count"] for r in tasks) < 250


def test_a_range_is_read_little_beyond_its_end():
    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            data = super().read(size)
            self.n += len(data)
            return data

    items = [{"id": i, "x": "y" * (90_000 if i == 700 else 50)} for i in range(40_000)]
    data, size = json.dumps({"items": items}).encode(), 1 << 16
    got, longest = [], 0
    for start in range(0, len(data), size):
        places, _, behind, inside = structure(data[:start], 0, 0)
        file = Counted(data)
        row = {"path": "p", "start": start, "end": min(start + size, len(data)), "inside": inside, "depth": int(behind[-1]) if len(behind) else 0,
               "carried": start > 0, "number": len(got)}
        got += [(n, json.loads(text)) for _, n, text in _elements(file, row, "items")]
        longest = max(longest, file.n)
    assert got == list(enumerate(items))
    assert longest < 8 * size
