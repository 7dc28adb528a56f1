"""Exact dedup by an extendible-hash index on shared files.

1. One scan of the texts writes a narrow key table (row id, doc_id, 64-bit hash,
   SHA-256); everything up to the byte comparison works on it.
2. Index entries are the distinct (hash, SHA-256) with their count and the row
   that stays: partial sums are made before the shuffle, so a text that a third
   of all rows share becomes one entry per map task.
3. The directory starts with one bucket and doubles: a bucket with more entries
   than its capacity splits by the next hash bit.  It has at most 2**16 prefixes;
   beyond that the capacity grows, so that its broadcast table stays bounded.
   The index is written to the shared folder, dealt by bucket and sorted by hash.
4. Owner tasks, each with the buckets of its key ranges, take the texts of the
   entries with more than one row (found by a bounded bit map in a second scan),
   compare them byte by byte and chain different texts of one hash.

Defined cases: null text counts as empty; empty texts equal each other; of equal
rows with equal doc_id one stays (the one read last); a null doc_id is smaller than any
other; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsspark.llm.common import maybe_in, membership_filter, scratch, stored, utf8

#: directory prefixes have at most so many bits
DIRECTORY_BITS = 16
#: index entries that a bucket holds before it splits
BUCKET_ENTRIES = 4096


def split_buckets(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the buckets after all overfull ones have split.

    ``counts`` are the entries of each of the 2**DIRECTORY_BITS finest prefixes.
    """
    finest = int(np.log2(len(counts)))
    out, open_buckets = [], [(0, 0)]
    while open_buckets:
        prefix, depth = open_buckets.pop()
        width = finest - depth
        held = int(counts[prefix << width:(prefix + 1) << width].sum())
        if held > capacity and depth < finest:
            open_buckets += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
        else:
            out.append((prefix, depth))
    return out


def directory(entries: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """Directory table (slot, bucket, depth) for prefixes of the global depth in use.

    What reaches the driver are 2**DIRECTORY_BITS counts at most.
    """
    spark = entries.sparkSession
    prefix = F.shiftrightunsigned("h", 64 - DIRECTORY_BITS)
    counts = np.zeros(1 << DIRECTORY_BITS, dtype=np.int64)
    for slot, n in entries.groupBy(prefix.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[slot] = n
    capacity = max(capacity, int(counts.sum()) >> (DIRECTORY_BITS - 2))
    buckets = split_buckets(counts, capacity)
    depth = max(d for _, d in buckets)
    rows = [((p << (depth - d)) + i, number, d)
            for number, (p, d) in enumerate(buckets) for i in range(1 << (depth - d))]
    return spark.createDataFrame(rows, "slot long, bucket int, depth int")


def row_keys(docs: DataFrame) -> DataFrame:
    """Narrow key table, written to the shared folder so that row ids are fixed."""
    text = utf8(F.col("text"))
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("doc_id"),
                              F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha")), "dedup-keys")


def duplicate_groups(docs: DataFrame, keys: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """Groups of two or more equal texts: h, sha, chain, n, keep_id, keep_rid."""
    entries = (keys.groupBy("h", "sha")
               .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "rid")).alias("keep")))
    entries = stored(entries.select("h", "sha", "n", F.col("keep.doc_id").alias("keep_id"),
                                    F.col("keep.rid").alias("keep_rid")), "dedup-entries")
    slots = directory(entries, capacity)
    depth = slots.count().bit_length() - 1
    slot = F.shiftrightunsigned(F.shiftrightunsigned("h", 1), 63 - depth)
    index = stored(entries.join(F.broadcast(slots), slot == F.col("slot")).drop("slot", "depth")
                   .repartition("bucket").sortWithinPartitions("bucket", "h"), "dedup-index")
    several = index.filter("n > 1")
    text = utf8(F.col("text"))
    candidates = maybe_in(docs.select(text.alias("t"), F.xxhash64(text).alias("th")), F.col("th"),
                          membership_filter(several.select("h"), "h")).filter("_maybe")
    # equal bytes meet before the shuffle: a group costs one text per map task
    found = (candidates.join(F.broadcast(slots), F.shiftrightunsigned(F.shiftrightunsigned("th", 1), 63 - depth) == F.col("slot"))
             .groupBy("bucket", "th", "t").agg(F.count(F.lit(1)).alias("rows")))
    chains = found.select("bucket", "th", "rows", F.unhex(F.sha2("t", 256)).alias("tsha"),
                          F.row_number().over(Window.partitionBy("bucket", "th").orderBy("t")).alias("chain"))
    owned = several.alias("i").join(
        chains.alias("c"), (F.col("i.bucket") == F.col("c.bucket")) & (F.col("h") == F.col("th"))
        & (F.col("sha") == F.col("tsha")) & (F.col("n") == F.col("rows")))
    return stored(owned.select("h", "sha", "chain", "n", "keep_id", "keep_rid"), "dedup-groups")


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = row_keys(docs)
    groups = duplicate_groups(docs, keys, capacity).withColumnsRenamed({"h": "gh", "sha": "gsha"})
    out = keys.join(groups, (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gsha")), "left")
    alone = F.col("gh").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The documents without the copies, all columns as they came.

    Rows whose hash is surely alone pass without a shuffle; only rows of
    duplicate groups are joined with the rows that stay.
    """
    with scratch(docs.sparkSession):
        found = duplicate_groups(docs, row_keys(docs), capacity)
        groups = stored(found.select(F.col("h").alias("_gh"), F.col("sha").alias("_gsha"), F.col("keep_id").alias("_keep")),
                        "dedup-kept", keep=True)
    text = utf8(F.col("text"))
    flagged = maybe_in(docs.withColumn("_h", F.xxhash64(text)), F.col("_h"), membership_filter(groups, "_gh"))
    alone = flagged.filter("not _maybe").select(docs.columns)
    copies = flagged.filter("_maybe").withColumn("_sha", F.unhex(F.sha2(text, 256)))
    joined = copies.join(groups, (F.col("_h") == F.col("_gh")) & (F.col("_sha") == F.col("_gsha")), "left")
    unique = joined.filter(F.col("_gh").isNull()).select(docs.columns)
    stay = (joined.filter(F.col("_gh").isNotNull() & F.col("doc_id").eqNullSafe(F.col("_keep")))
            .dropDuplicates(["_h", "_sha"]).select(docs.columns))
    return alone.unionByName(unique).unionByName(stay)
