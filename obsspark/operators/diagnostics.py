"""Source failures: classification (P23-P25), diagnostic records
and removal of failed sources' lines (J5)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsspark.functions.text import ws_trim

# Stderr text that marks a journal permission problem.
PERMISSION_HINT_PATTERN = r"(?i)not seeing messages from other users|permission denied"

# Skip reasons for file and journal sources.
FILE_NOT_FOUND = "file_not_found"
FILE_READ_ERROR = "read_error"
JOURNAL_REASONS = [
    ("ENOENT", "journalctl_not_found"),
    ("EACCES", "journal_permission_denied"),
    ("ENOUSER", "journal_user_not_found"),
    ("EINVAL", "journal_user_invalid"),
]
JOURNAL_READ_ERROR = "journal_read_error"

# User-journal error texts.  The permission text names
# the collector generically.
USER_JOURNAL_PERMISSION_TEXT = (
    "permission denied reading user journal; add the collector process user "
    "to systemd-journal and restart the collector")
JOURNALCTL_NOT_FOUND_TEXT = "journalctl not found"
UNKNOWN_ERROR_TEXT = "unknown error"

# Texts of unusable journal users ({u} = the trimmed user).
JOURNAL_USER_MISSING_TEXT = "journalUser is required for user journal scope"
JOURNAL_USER_BLANK_TEXT = "journalUser must be a non-empty username or UID"
JOURNAL_USER_RANGE_TEXT = 'journalUser "{u}" is outside the valid UID range'
JOURNAL_USER_NEGATIVE_TEXT = 'journalUser "{u}" must be a non-negative UID or existing username'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_code(is_journal, code, stderr) -> Column:
    """P25: a journal whose stderr carries a permission hint is EACCES."""
    return F.when(_c(is_journal) & F.coalesce(_c(stderr), F.lit("")).rlike(PERMISSION_HINT_PATTERN),
                  F.lit("EACCES")).otherwise(_c(code))


def source_error_reason(is_journal, code, stderr) -> Column:
    """Skip reason of a failed source."""
    eff = effective_code(is_journal, code, stderr)
    jr = F.lit(JOURNAL_READ_ERROR)
    for c, reason in reversed(JOURNAL_REASONS):
        jr = F.when(eff == F.lit(c), F.lit(reason)).otherwise(jr)
    fr = F.when(_c(code) == F.lit("ENOENT"), F.lit(FILE_NOT_FOUND)).otherwise(F.lit(FILE_READ_ERROR))
    return F.when(_c(is_journal), jr).otherwise(fr)


def _nonblank(c: Column) -> Column:
    return F.when(ws_trim(c) != F.lit(""), c)


def source_error_text(is_journal, journal_scope, reason, stderr, message) -> Column:
    """Error text of a failed source.

    files: the read error's message; system journals: trimmed stderr,
    else the message; user journals: fixed texts for permission and
    missing-binary failures, else the first non-blank of trimmed stderr
    and message, else ``unknown error``.
    """
    st, msg, r = _c(stderr), _c(message), _c(reason)
    hinted = F.coalesce(st, F.lit("")).rlike(PERMISSION_HINT_PATTERN)
    fallback = F.coalesce(_nonblank(ws_trim(st)), _nonblank(msg), F.lit(UNKNOWN_ERROR_TEXT))
    user = (F.when(r == "journal_permission_denied", F.lit(USER_JOURNAL_PERMISSION_TEXT))
            .when(r == "journalctl_not_found", F.lit(JOURNALCTL_NOT_FOUND_TEXT))
            .otherwise(fallback))
    system = F.when(hinted, ws_trim(st)).otherwise(F.coalesce(_nonblank(ws_trim(st)), msg))
    return (F.when(~_c(is_journal), msg)
            .when(F.coalesce(_c(journal_scope), F.lit("system")) == "user", user)
            .otherwise(system))


def classify_source_errors(errors: DataFrame, is_journal="is_journal", journal_scope="journal_scope",
                           code="code", stderr="stderr", message="message") -> DataFrame:
    """Add ``reason``, ``error`` and the diagnostic record ``type``
    (``log_error`` for user journals, else a skipped ``log``)."""
    reason = source_error_reason(is_journal, code, stderr)
    out = errors.withColumn("reason", reason)
    is_user = _c(is_journal) & (F.coalesce(_c(journal_scope), F.lit("system")) == "user")
    return out.withColumns({
        "error": source_error_text(is_journal, journal_scope, F.col("reason"), stderr, message),
        "type": F.when(is_user, F.lit("log_error")).otherwise(F.lit("log")),
        "skipped": F.when(is_user, F.lit(None).cast("boolean")).otherwise(F.lit(True)),
    })


def missing_sources(sources: DataFrame, errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One diagnostic record per expected source whose read failed.

    ``sources`` carries ``is_journal``/``journal_scope``; ``errors`` the
    failure (code, stderr, message) per source key.  Errors for unknown
    sources are ignored (inner join).
    """
    keys = list(keys)
    src = sources.select(*keys, "is_journal", "journal_scope")
    err = errors.select(*keys, "code", "stderr", "message")
    return classify_source_errors(src.join(err, keys, "inner"))


def drop_failed_sources(lines: DataFrame, errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Discard every line of a source whose read failed."""
    keys = list(keys)
    return lines.join(errors.select(*keys).distinct(), keys, "left_anti")


def journal_user_code(journal_scope, journal_user) -> Column:
    """Error code of a user-journal source whose user cannot be used
    (``EINVAL``): missing/blank, a numeric UID above 4294967295, a
    negative number or a name starting with '-'.  NULL when usable
    (names are resolved by the host; unknown names surface later as
    ENOUSER rows of the errors table)."""
    u = ws_trim(journal_user)
    numeric = u.rlike(r"^\d+$")
    bad = (_c(journal_user).isNull() | (u == "")
           | (numeric & (u.cast("decimal(20,0)") > F.lit(4_294_967_295)))
           | (~numeric & (u.rlike(r"^-?\d+$") | u.startswith("-"))))
    return F.when((F.coalesce(_c(journal_scope), F.lit("system")) == "user") & bad, F.lit("EINVAL"))


def _with_user(template: str, user: Column) -> Column:
    before, after = template.split("{u}")
    return F.concat(F.lit(before), user, F.lit(after))


def journal_user_errors(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A9 as source errors: user journals with an unusable user, ready to
    union into the errors table of ``collect_service_logs``."""
    u = ws_trim("journal_user")
    numeric = u.rlike(r"^\d+$")
    message = (F.when(F.col("journal_user").isNull(), F.lit(JOURNAL_USER_MISSING_TEXT))
               .when(u == "", F.lit(JOURNAL_USER_BLANK_TEXT))
               .when(numeric, _with_user(JOURNAL_USER_RANGE_TEXT, u))
               .otherwise(_with_user(JOURNAL_USER_NEGATIVE_TEXT, u)))
    code = journal_user_code(F.col("journal_scope"), F.col("journal_user"))
    return (sources.filter(F.col("is_journal")).withColumn("code", code).filter(F.col("code").isNotNull())
            .select(*keys, "code", F.lit("").alias("stderr"), message.alias("message")))


def without_journal(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A6 by request: the ``keys`` of requests of whose sources none is a journal, so that a time window cannot apply."""
    return sources.groupBy(*keys).agg(F.max("is_journal").alias("_any")).filter(~F.col("_any")).drop("_any")


def assert_window_has_journal(sources: DataFrame, window) -> None:
    """A time window on a log request needs at least one journal
    source among the selected services (files cannot be windowed)."""
    if window is None:
        return
    from obsspark.operators.checks import DataCheckError
    if sources.filter(F.col("is_journal")).limit(1).count() == 0:
        raise DataCheckError("timeWindow is only supported for selected journal log sources")
