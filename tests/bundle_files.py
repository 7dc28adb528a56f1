"""Read a written bundle as its consumers do: one gzip file."""

import gzip
import os


def bundle_text(folder: str) -> str:
    with gzip.open(os.path.join(folder, "bundle.ndjson.gz"), "rb") as f:
        return f.read().decode("utf-8")
