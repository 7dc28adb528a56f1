"""Journal reading rules (S2, S2b) over a table of journal lines."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsspark.operators.lines import drop_journal_noise, tail_per_source


def read_journal(journal_lines: DataFrame, unit: str | None = None, user_unit: str | None = None,
                 uid: str | None = None) -> DataFrame:
    """A system selector (``unit``) or a user selector
    (``user_unit`` + ``uid``) over a journal_lines table
    (unit, user_unit, uid, seq, raw); blank lines and the
    "-- No entries --" marker are dropped."""
    df = journal_lines
    if unit is not None:
        df = df.filter(F.col("unit") == F.lit(unit))
    if user_unit is not None:
        df = df.filter(F.col("user_unit") == F.lit(user_unit))
    if uid is not None:
        df = df.filter(F.col("uid") == F.lit(uid))
    return drop_journal_noise(df)


def journal_with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per source, the primary selector's lines when it yields any,
    else the fallback selector's lines.  ``via`` tells which."""
    keys = list(keys)
    got = primary.select(*keys).distinct()
    return (primary.withColumn("via", F.lit("primary"))
            .unionByName(fallback.join(got, keys, "left_anti").withColumn("via", F.lit("fallback"))))


def journal_source_lines(sources: DataFrame, journal_lines: DataFrame, keys: Sequence[str] = ("service", "source"),
                         tail_lines: int | None = None) -> DataFrame:
    """Lines of every journal source of ``sources`` (from
    ``inventory.expand_sources`` plus ``source``) out of one journal
    table (unit, user_unit, systemd_user_unit, uid, seq, raw).

    System scope selects by ``unit``; user scope by ``user_unit`` and the
    source's user id, falling back to ``systemd_user_unit`` per source
    when the primary selector yields no line (S2b).  With ``tail_lines`` each
    selector reads its last entries, blank and marker lines among them, and
    yields what is not blank of those (P28); the lines returned still hold
    the others, for the collector's own tail.  User names must be
    resolved to ids in the table's ``uid`` column.  Equi-joins on the
    unit: each journal line meets only the sources naming its unit.
    """
    keys = list(keys)
    js = sources.filter(F.col("is_journal")).select(*keys, "journal", "journal_scope", "journal_user")
    jl = journal_lines.select("unit", "user_unit", "systemd_user_unit", "uid", "seq", "raw")
    scope = F.coalesce(F.col("journal_scope"), F.lit("system"))
    system = (js.filter(scope == "system")
              .join(jl, js["journal"] == jl["unit"], "inner")
              .select(*keys, "seq", "raw"))
    user = js.filter(scope == "user")
    primary = (user.join(jl, (user["journal"] == jl["user_unit"]) & (user["journal_user"] == jl["uid"]), "inner")
               .select(*keys, "seq", "raw"))
    fallback = (user.join(jl, (user["journal"] == jl["systemd_user_unit"]) & (user["journal_user"] == jl["uid"]),
                          "inner")
                .select(*keys, "seq", "raw"))
    if tail_lines is not None:
        system, primary, fallback = (tail_per_source(x, keys, "seq", tail_lines) for x in (system, primary, fallback))
    yields = drop_journal_noise(primary).select(*keys).distinct()
    return (system.withColumn("via", F.lit("unit"))
            .unionByName(primary.join(yields, keys, "left_semi").withColumn("via", F.lit("primary")))
            .unionByName(fallback.join(yields, keys, "left_anti").withColumn("via", F.lit("fallback"))))
