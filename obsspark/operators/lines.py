"""Per-line operators: parsing (P1/P2), filters (P3-P10), tail (W1) and
timestamp inheritance (W2).

No window here lets a single huge source land unpruned in one task.
The tail is a tree of limits per source.  Inheritance, which has no such
bound, works on chunks of consecutive arrival order (``order_col div
chunk_rows``, or a given chunk column such as a file's block offset):
the per-line window runs inside (source, chunk), and one row per chunk
carries on what crosses chunk boundaries.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsspark.functions.text import exclude_any, include_any, is_journal_noise
from obsspark.functions.timeparse import parse_line_columns
from obsspark.operators.rank import FAN_IN, limit_in_tree
from obsspark.session import shared_dir

# Lines per chunk of arrival order.  A chunk is the unit of parallelism
# inside one source: 1M lines of ~200 B is ~200 MB of shuffle input.
DEFAULT_CHUNK_ROWS = 1 << 20


def parse_lines(df: DataFrame, raw: str = "raw", timestamps: bool = True) -> DataFrame:
    """P1 + P2: add ``ts`` (valid leading timestamp token), ``line``
    (message) and ``sort_ms`` (epoch ms of ``ts``)."""
    ts, line, ms = parse_line_columns(F.col(raw), timestamps)
    return df.withColumns({"ts": ts, "line": line, "sort_ms": ms})


def drop_empty(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Drop zero-length lines; whitespace-only lines stay."""
    return df.filter(F.length(F.col(raw)) > 0)


def drop_journal_noise(df: DataFrame, raw: str = "raw") -> DataFrame:
    """P10: drop blank lines and the "-- No entries --" marker."""
    return df.filter(~is_journal_noise(F.col(raw)))


def filter_text(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
                raw: str = "raw") -> DataFrame:
    """P3 + P4 on the *raw* line (timestamp included)."""
    cond = include_any(F.col(raw), include) & ~exclude_any(F.col(raw), exclude)
    return df.filter(cond)


def in_window_lenient(sort_ms: Column, start_ms: int | None, end_ms: int | None) -> Column:
    """P5 predicate: inclusive window, NULL timestamps pass."""
    if start_ms is None or end_ms is None:
        return F.lit(True)
    return sort_ms.isNull() | sort_ms.between(F.lit(start_ms), F.lit(end_ms))


def time_window_lenient(df: DataFrame, start_ms: int | None, end_ms: int | None,
                        applies: Column | None = None, sort_ms: str = "sort_ms") -> DataFrame:
    """P5: lenient window, optionally only for rows where ``applies``
    (journal sources); other rows are never time-filtered."""
    pred = in_window_lenient(F.col(sort_ms), start_ms, end_ms)
    if applies is not None:
        pred = ~applies | pred
    return df.filter(pred)


def time_window_strict(df: DataFrame, start_ms: int, end_ms: int, sort_ms: str = "sort_ms") -> DataFrame:
    """Inclusive window; lines without a timestamp are dropped."""
    return df.filter(F.col(sort_ms).between(F.lit(start_ms), F.lit(end_ms)))


def since_filter(df: DataFrame, now_ms: int, since_seconds: int, sort_ms: str = "sort_ms") -> DataFrame:
    """Relative lower bound ``now - since``; unparsable lines kept."""
    lo = now_ms - since_seconds * 1000
    return df.filter(F.col(sort_ms).isNull() | (F.col(sort_ms) >= F.lit(lo)))


def _cols(order_col) -> list[str]:
    return [order_col] if isinstance(order_col, str) else list(order_col)


def _chunked(df: DataFrame, order_col, chunk_rows: int, chunk_col: str | None = None) -> DataFrame:
    """Add ``_chunk``: the given chunk column (e.g. a file's block
    offset), else the first order column divided by ``chunk_rows``."""
    if chunk_col is not None:
        return df.withColumn("_chunk", F.col(chunk_col))
    return df.withColumn("_chunk", F.expr(f"`{_cols(order_col)[0]}` div {int(chunk_rows)}"))


def _join_chunks(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a table of (keys, _chunk); null keys and null chunks match themselves."""
    on = [*keys, "_chunk"]
    named = table.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(on)})
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(named, cond, "inner").drop(*[f"_k{i}" for i in range(len(on))])


def tail_per_source(df: DataFrame, keys: Sequence[str], order_col, n: int, rank_col: str | None = None,
                    fan_in: int = FAN_IN, levels: int | None = None) -> DataFrame:
    """The last ``n`` lines (by ``order_col``) of every source, in one scan.

    A tree per source (see ``rank.limit_in_tree``): every input task keeps the
    last n lines that it holds of a source, and no task reads more than
    fan_in x n lines of one source, however many tasks that source is spread
    over.  Null keys are a source of their own; lines with a null order are the
    oldest.  ``n <= 0`` selects nothing.  Of text files ``sources.ranges``
    reads only the ends.
    """
    keys = list(keys)
    if n <= 0:
        out = df.filter(F.lit(False))
        return out.withColumn(rank_col, F.lit(None).cast("long")) if rank_col else out
    order = [F.col(c).desc() for c in _cols(order_col)]
    out = limit_in_tree(df, keys, order, n, fan_in, levels)
    out = out.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n)
    if rank_col:
        out = out.withColumn(rank_col, F.col("_rn").cast("long"))
    return out.drop("_rn")


def carry_over(ends: DataFrame, keys: Sequence[str], value_col: str) -> DataFrame:
    """(keys, _chunk, _carry): the last non-null value of a source before each of its chunks.

    ``ends`` has one row per chunk with the chunk's own last value."""
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "_chunk", F.last(value_col, ignorenulls=True).over(before).alias("_carry"))


def inherit_last(df: DataFrame, keys: Sequence[str], order_col, value_col: str,
                 out_col: str, chunk_rows: int = DEFAULT_CHUNK_ROWS, chunk_col: str | None = None) -> DataFrame:
    """W2 core: ``out_col`` = last non-null ``value_col`` at or before
    each line of the same source (NULL when none yet).

    One pass over the input: lines are laid out in arrival order by (source,
    chunk) and written once (checkpoint) with the last value seen in their own
    chunk; each chunk's last line carries that value on, and what those few rows
    say is joined to the lines that have seen none in their chunk.
    """
    keys = list(keys)
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order_col))
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = _chunked(df, order_col, chunk_rows, chunk_col).withColumns({
        "_seen": F.last(value_col, ignorenulls=True).over(upto),
        "_end": F.lead(F.lit(1)).over(in_chunk).isNull()})
    shared_dir(df.sparkSession)
    d = d.checkpoint(eager=True)
    carry = carry_over(d.filter("_end"), keys, "_seen")
    return (_join_chunks(d, carry, keys).withColumn(out_col, F.coalesce("_seen", "_carry"))
            .drop("_chunk", "_carry", "_seen", "_end"))


def inherit_timestamp(df: DataFrame, keys: Sequence[str], order_col,
                      start_ms: int | None = None, end_ms: int | None = None,
                      window_applies: Column | None = None, sort_ms: str = "sort_ms",
                      out_col: str = "rank_ms", chunk_rows: int = DEFAULT_CHUNK_ROWS,
                      chunk_col: str | None = None) -> DataFrame:
    """Rank time = own timestamp, else the last *in-window* timestamp
    seen earlier in the same source.

    Must run *before* text filters: lines that include/exclude patterns
    later remove still pass their timestamp on.  Out-of-window
    timestamps (only where ``window_applies``) are not inherited.
    """
    ms = F.col(sort_ms)
    ok = ms.isNotNull()
    if start_ms is not None and end_ms is not None:
        inwin = ms.between(F.lit(start_ms), F.lit(end_ms))
        ok = ok & (inwin if window_applies is None else (~window_applies | inwin))
    d = df.withColumn("_inwin_ms", F.when(ok, ms))
    d = inherit_last(d, keys, order_col, "_inwin_ms", "_inherited", chunk_rows, chunk_col)
    return d.withColumn(out_col, F.coalesce(ms, F.col("_inherited"))).drop("_inwin_ms", "_inherited")
