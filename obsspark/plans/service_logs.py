"""B1: service log collection.

Plan shape (lazy until a part is first used):

    lines --anti(failed sources)-->
      files, and journals without a window:
          tail W1 (a tree of limits per source) -> all-blank tail check ->
          noise and empty lines dropped -> parse P1/P2 -> inherit W2 on the
          shuffle of the tail's last step, each source holding at most N lines
      journals with a window (unbounded):
          noise dropped -> parse -> inherit W2 inside (source, chunk)
      -> matched = lenient window (journals) & include & ~exclude
      -> one pass leaves, and stores, two kinds of rows:
           counts      one row per (source, chunk): raw and matched lines,
                       the last in-window time
           candidates  matched lines, limited to the newest K in the first
                       level of the top-K tree (K1)
      -> {per-source counts G1, further levels of K1, diagnostics, totals G2}

The delivered lines themselves are not stored.  Lines before the first time
of their chunk do not know their rank until the counts' last times are
carried over (W2); of those a chunk keeps its last K.  Inheritance always
runs before the text filters, so filtered-out lines still pass their
timestamp on.
"""

from __future__ import annotations

from functools import cached_property
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsspark.functions.text import exclude_any, include_any, is_journal_noise, ws_trim
from obsspark.operators.diagnostics import drop_failed_sources, missing_sources
from obsspark.operators.lines import DEFAULT_CHUNK_ROWS, carry_over, in_window_lenient, parse_lines, tail_per_source
from obsspark.operators.rank import (
    limit_in_tree, log_summary, merge_levels, newest_lines, rank_order, source_summary)
from obsspark.params import ServiceLogParams
from obsspark.session import shared_dir

# The record written for a user journal that returned nothing.
NO_ENTRIES_TS = "--"
NO_ENTRIES_LINE = "No entries --"


class ServiceLogs:
    """Result parts of B1, each built (and, with ``materialize``,
    checkpointed) on first access, so a caller that only needs the top-K
    never pays for the summaries."""

    def __init__(self, got: DataFrame, sources: DataFrame, errors: DataFrame | None, params: ServiceLogParams,
                 keys: list[str], source_order: list[str], order: list[str], materialize: bool):
        self._got, self._sources, self._errors = got, sources, errors
        self.params, self.keys, self.source_order, self.order = params, keys, source_order, order
        self.materialize = materialize

    def _keep(self, df: DataFrame) -> DataFrame:
        if not self.materialize:
            return df
        shared_dir(df.sparkSession)
        return df.checkpoint(eager=True)

    @cached_property
    def _pass(self) -> DataFrame:
        """What the one pass over the delivered lines leaves: count rows and candidates."""
        return self._keep(_counts_and_candidates(
            self._got, self.keys, self.order, [*self.source_order, *self.order], self.params.max_total_log_lines))

    @cached_property
    def counts(self) -> DataFrame:
        """keys, raw_log_records, matched_log_records of every source with lines."""
        return (self._pass.filter("_kind = 'counts'").groupBy(*self.keys)
                .agg(F.sum("_raw").alias("raw_log_records"), F.sum("_matched").alias("matched_log_records")))

    @cached_property
    def newest(self) -> DataFrame:
        """Top-K matched lines (K1), as a plan."""
        lines = self._pass.filter("_kind <> 'counts'")
        if self.params.window is not None:
            carry = carry_over(self._pass.filter("_kind = 'counts'"), self.keys, "_last")
            on = [*self.keys, "_chunk"]
            known = lines.filter("_kind = 'line'")
            lines = (lines.filter("_kind = 'pending'").join(carry, on, "left")
                     .withColumn("rank_ms", F.col("_carry")).select(known.columns).unionByName(known))
        tiebreak = [*self.source_order, *self.order]
        return newest_lines(lines.drop("_kind", "_raw", "_matched", "_last", "_chunk"), self.params.max_total_log_lines, "rank_ms", tiebreak)

    @cached_property
    def selected(self) -> DataFrame:
        """Top-K matched lines (K1)."""
        return self._keep(self.newest)

    @cached_property
    def failed(self) -> DataFrame | None:
        """Diagnostic rows of failed sources."""
        if self._errors is None:
            return None
        return self._keep(missing_sources(self._sources, self._errors, self.keys))

    @cached_property
    def summary(self) -> DataFrame:
        """G1: one row per source with its attributes and counts."""
        return self._keep(source_summary(self._sources, self.counts, self.selected, self.keys, self.failed))

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Side records: failed sources, then user journals without a line (no top-K involved)."""
        keys = self.keys
        user = F.col("is_journal") & (F.coalesce(F.col("journal_scope"), F.lit("system")) == "user")
        silent = self._sources.filter(user).join(self.counts.select(*keys), keys, "left_anti")
        if self.failed is not None:
            silent = silent.join(self.failed.select(*keys), keys, "left_anti")
        empty_user = silent.select(
            *keys, F.lit("log").alias("type"), F.lit(NO_ENTRIES_TS).alias("ts"), F.lit(NO_ENTRIES_LINE).alias("line"),
            F.lit(None).cast("boolean").alias("skipped"), F.lit(None).cast("string").alias("reason"),
            F.lit(None).cast("string").alias("error"))
        if self.failed is None:
            return empty_user
        now_iso = F.date_format(F.timestamp_millis(F.lit(self.params.now_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return (self.failed.select(*keys, "type", now_iso.alias("ts"), F.lit(None).cast("string").alias("line"),
                                   "skipped", "reason", "error")
                .unionByName(empty_user))

    @cached_property
    def totals(self) -> DataFrame:
        """Totals (0 or 1 row)."""
        return log_summary(self.summary, self.diagnostics, self.params.max_total_log_lines)


def _counts_and_candidates(got: DataFrame, keys: list[str], order: list[str], tiebreak: list[str], k: int) -> DataFrame:
    """Rows of kind ``counts`` (one per source and chunk), ``line`` (rank known)
    and ``pending`` (rank to come from the chunks before).

    A chunk's last line stands for its counts besides being a line itself.  The
    lines' first level of the top-K tree has all lines of known rank of an input
    task under one key, pending ones by chunk, and each count row for itself.
    """
    chunk = Window.partitionBy(*keys, "_chunk")
    counted = got.withColumns({
        "_raw": F.count(F.lit(1)).over(chunk), "_matched": F.sum(F.col("matched").cast("long")).over(chunk),
        "_last": F.last("_seen", ignorenulls=True).over(chunk.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_end": F.lead(F.lit(1)).over(chunk.orderBy(*order)).isNull()})
    line = F.when(F.col("_waits") & F.col("rank_ms").isNull(), "pending").otherwise("line")
    kinds = F.filter(F.array(F.when(F.col("_end"), "counts"), F.when(F.col("matched"), line)), lambda x: x.isNotNull())
    rows = counted.withColumn("_kind", F.explode(kinds))
    own = {f"_own{i}": F.when(F.col("_kind") != "line", F.col(c)) for i, c in enumerate([*keys, "_chunk"])}
    text = {c: F.when(F.col("_kind") != "counts", F.col(c)) for c in ("ts", "line")}
    places = dict.fromkeys([*keys, *tiebreak, "is_journal"])
    rows = rows.withColumns({**own, **text}).select(
        *places, "_chunk", "_kind", "rank_ms", "ts", "line", "_raw", "_matched", "_last", *own)
    levels = min(1, merge_levels(got.sparkSession))
    return limit_in_tree(rows, ["_kind", *own], rank_order("rank_ms", tiebreak), max(k, 1), levels=levels).drop(*own)


def _tailed_and_inherited(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Tail-bounded sources: tail (W1), all-blank check, noise and
    empty-line drop, parse and inheritance (W2).  Everything after the
    tail holds at most n rows per source."""
    by_src = Window.partitionBy(*keys)
    t = tail_per_source(df, keys, order, n)
    t = (t.withColumn("_nb", F.max((ws_trim("raw") != F.lit("")).cast("int")).over(by_src))
         .filter((F.col("_nb") == 1) | F.col("is_journal")).drop("_nb"))
    # a journal's own limit counts blank and marker lines too
    t = t.filter(~F.col("is_journal") | ~is_journal_noise(F.col("raw")))
    t = parse_lines(t.filter(F.length(F.col("raw")) > 0))
    upto = by_src.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.withColumns({"_chunk": F.lit(0).cast("long"), "_waits": F.lit(False), "_seen": F.col("sort_ms"),
                          "rank_ms": F.last("sort_ms", ignorenulls=True).over(upto)})


def delivered_lines(lines: DataFrame, params: ServiceLogParams, keys: Sequence[str], order_col,
                    chunk_rows: int = DEFAULT_CHUNK_ROWS, chunk_col: str | None = None,
                    entry_time_col: str | None = None) -> DataFrame:
    """What each source hands to the collector (P9, P10, P28, W1) with
    its rank time (P1, P2, W2): files read their last N physical lines
    (an all-blank tail reads as empty); journals read either their last N
    entries or, with a time window, the whole window, then drop blank and
    marker lines.

    ``rank_ms`` is the rank time as far as the line's chunk (``_chunk``) tells;
    where it is null and ``_waits``, the chunks before decide (``_seen`` is the
    line's own in-window time).  Sources bounded by a tail are one chunk.

    ``entry_time_col`` (the journal entry's own time, a stored epoch-ms
    or timestamp column) selects windowed journal entries by entry time first, as a
    journal's own since/until selection does.  It is a plain column
    predicate, so it reaches the scan as a pushed filter (row-group
    skipping) and prunes partitions when the line table is partitioned
    by it; the lenient line-timestamp window is then applied as usual.
    """
    keys = list(keys)
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    j = F.col("is_journal")
    start_ms, end_ms = params.window_ms()
    if params.window is None:
        return _tailed_and_inherited(lines, keys, order, params.tail_lines)
    files = _tailed_and_inherited(lines.filter(~j), keys, order, params.tail_lines)
    jsel = j & (F.length(F.col("raw")) > 0) & ~is_journal_noise(F.col("raw"))
    if entry_time_col is not None:
        dtype = dict(lines.dtypes)[entry_time_col]
        lo, hi = F.lit(start_ms), F.lit(end_ms)
        if dtype.startswith("timestamp"):
            # constant-folded into timestamp literals, so still pushed down
            lo, hi = F.timestamp_millis(lo).cast(dtype), F.timestamp_millis(hi).cast(dtype)
        jsel = jsel & F.col(entry_time_col).between(lo, hi)
    ms = F.col("sort_ms")
    chunk = F.col(chunk_col) if chunk_col is not None else F.expr(f"`{order[0]}` div {int(chunk_rows)}")
    journals = parse_lines(lines.filter(jsel)).withColumns({
        "_chunk": chunk.cast("long"), "_waits": F.lit(True), "_seen": F.when(ms.between(F.lit(start_ms), F.lit(end_ms)), ms)})
    upto = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    journals = journals.withColumn("rank_ms", F.coalesce(ms, F.last("_seen", ignorenulls=True).over(upto)))
    return files.unionByName(journals)


def collect_service_logs(lines: DataFrame, sources: DataFrame, errors: DataFrame | None,
                         params: ServiceLogParams, keys: Sequence[str] = ("service", "file"),
                         order_col="seq",
                         source_order: Sequence[str] = ("service", "is_journal", "file"),
                         chunk_rows: int = DEFAULT_CHUNK_ROWS, chunk_col: str | None = None,
                         materialize: bool = True, entry_time_col: str | None = None) -> ServiceLogs:
    """B1 over tables.

    ``lines``: keys + ``order_col`` + ``raw`` (+ ``is_journal``).
    ``sources``: keys + ``is_journal`` + ``journal_scope`` + the
    ``source_order`` columns.  ``errors``: keys + code/stderr/message of
    failed reads (or None).  Source keys must be non-null (they are join
    keys); registry sources use ``source = coalesce(file, journal)``.

    ``materialize`` (default) checkpoints what the pass leaves, the top-K and
    the per-source frames into the cluster's checkpoint folder: counts,
    top-K, diagnostics, totals and the bundle read those instead of each
    re-scanning and re-shuffling the input.  Checkpoints are reliable files, so
    a lost executor does not lose them.
    """
    keys = list(keys)
    source_order = list(source_order)
    absent = [c for c in dict.fromkeys(["is_journal", *source_order]) if c not in lines.columns]
    if absent:
        lines = lines.join(sources.select(*keys, *absent), keys, "inner")
    if errors is not None:
        lines = drop_failed_sources(lines, errors, keys)
    start_ms, end_ms = params.window_ms()
    j = F.col("is_journal")
    got = delivered_lines(lines, params, keys, order_col, chunk_rows, chunk_col, entry_time_col)
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    matched = ((~j | in_window_lenient(F.col("sort_ms"), start_ms, end_ms))
               & include_any(F.col("raw"), params.include)
               & ~exclude_any(F.col("raw"), params.exclude))
    got = got.withColumn("matched", matched)
    return ServiceLogs(got, sources, errors, params, keys, source_order, order, materialize)
