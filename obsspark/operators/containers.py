"""Container logs (B2): expected-lines guard (G3), per-container tail
(W1), windows (P6/P7), exclude filter (P4), missing previous logs
(J7) and fetch-error classification (P26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsspark.functions.text import exclude_any
from obsspark.operators.checks import DataCheckError, assert_empty
from obsspark.operators.lines import parse_lines, tail_per_source
from obsspark.params import ContainerLogParams

LOG_KEYS = ["namespace", "pod", "container", "previous"]

# Previous-log skip reason and the error texts that mean
# "no previous container".
NO_PREVIOUS_CONTAINER = "no_previous_container"
NO_PREVIOUS_MESSAGES = ["previous terminated container", "previous log", "no previous"]


def pod_containers(refs: DataFrame) -> DataFrame:
    """One row per (pod, container) with pod and container ordinals."""
    ordc = ["pod_ord"] if "pod_ord" in refs.columns else []
    return refs.select("namespace", F.col("name").alias("pod"), *ordc,
                       F.posexplode("containers").alias("container_ord", "container"))


def expected_lines(refs: DataFrame, tail_lines: int, previous: bool) -> DataFrame:
    """Upper bound of lines a request can produce (one row)."""
    mult = 2 if previous else 1
    return refs.agg(F.count(F.lit(1)).alias("n_pods"),
                    F.coalesce(F.sum(F.size("containers")), F.lit(0)).cast("long").alias("n_containers")
                    ).withColumn("expected_max", F.col("n_containers") * F.lit(tail_lines * mult))


def assert_expected_lines(refs: DataFrame, params: ContainerLogParams) -> None:
    row = expected_lines(refs, params.tail_lines, params.previous).first()
    if row["expected_max"] > params.max_total_log_lines:
        raise DataCheckError("maxTotalLogLines would be exceeded by requested tailLines/containers")


def tail_container_logs(logs: DataFrame, refs: DataFrame, params: ContainerLogParams,
                        entry_time_col: str | None = None) -> DataFrame:
    """The last N lines of every (pod, container, current|previous) of
    the selected pods, before any line filter (W1).  Bounded by N per
    container, so it is cheap to materialize and reuse."""
    start_ms, _ = params.window_ms()
    wanted = logs if params.previous else logs.filter(~F.col("previous"))
    if entry_time_col is not None:
        wanted = wanted.filter(F.col(entry_time_col) >= F.lit(start_ms))
    wanted = wanted.join(pod_containers(refs), ["namespace", "pod", "container"], "inner")
    return tail_per_source(wanted, LOG_KEYS, "pos", params.tail_lines)


def container_log_lines(logs: DataFrame, refs: DataFrame, params: ContainerLogParams,
                        entry_time_col: str | None = None, tailed: DataFrame | None = None) -> DataFrame:
    """B2 lines: per (pod, container, current|previous) the last N lines,
    then non-empty lines, the window and the exclude patterns.

    Absolute window: strict (lines without a valid timestamp are
    dropped).  Relative window: lower bound ``now - since`` on lines
    that carry a timestamp (the API filters by its own clock; lines we
    cannot date are kept).  Tail first, then window.

    ``entry_time_col`` (epoch ms the runtime stamped on each line, a
    stored column) applies the API's own lower bound *before* the tail,
    exactly like since-time/tail on the server, as a predicate the scan
    can push down.  ``tailed``: a precomputed ``tail_container_logs``.
    """
    if tailed is None:
        tailed = tail_container_logs(logs, refs, params, entry_time_col)
    out = parse_lines(tailed.filter(F.length("raw") > 0))
    start_ms, end_ms = params.window_ms()
    if params.window.is_absolute:
        out = out.filter(F.col("sort_ms").between(F.lit(start_ms), F.lit(end_ms)))
    else:
        out = out.filter(F.col("sort_ms").isNull() | (F.col("sort_ms") >= F.lit(start_ms)))
    out = out.filter(~exclude_any(F.col("raw"), params.exclude))
    if not params.timestamps:
        out = out.withColumns({"ts": F.lit(None).cast("string"), "line": F.col("raw")})
    return out


def previous_skips(logs: DataFrame, refs: DataFrame, tailed: DataFrame | None = None) -> DataFrame:
    """(pod, container) pairs asked for previous logs that have none.

    With a (non-empty-tail) ``tailed`` frame the check reads it instead of
    the whole log table: a previous log with any line keeps at least one
    row in its tail."""
    src = tailed if tailed is not None else logs
    have = src.filter(F.col("previous")).select("namespace", "pod", "container").distinct()
    return (pod_containers(refs).join(have, ["namespace", "pod", "container"], "left_anti")
            .withColumn("reason", F.lit(NO_PREVIOUS_CONTAINER)))


def classify_log_fetch_errors(errors: DataFrame) -> DataFrame:
    """A failed previous-log fetch with status 400/404 or a message
    about the previous container is a skip; anything else is fatal
    (``fatal = true``, see ``assert_no_fatal_fetch_errors``)."""
    msg = F.lower(F.coalesce(F.col("message"), F.lit("")))
    hint = F.lit(False)
    for m in NO_PREVIOUS_MESSAGES:
        hint = hint | msg.contains(m)
    skip = F.coalesce(F.col("previous"), F.lit(False)) & (F.coalesce(F.col("status").isin(400, 404), F.lit(False)) | hint)
    return errors.withColumns({
        "skipped": skip,
        "reason": F.when(skip, F.lit(NO_PREVIOUS_CONTAINER)),
        "fatal": ~skip,
    })


def fetch_errors_of(errors: DataFrame, refs: DataFrame) -> DataFrame:
    """The classified fetch errors of the selected pods' containers, with their ordinals."""
    return classify_log_fetch_errors(errors.join(pod_containers(refs), ["namespace", "pod", "container"]))


def assert_no_fatal_fetch_errors(classified: DataFrame) -> None:
    assert_empty(classified.filter("fatal"),
                 lambda rows: f"log fetch failed for {rows[0]['namespace']}/{rows[0]['pod']}: {rows[0]['message']}")
