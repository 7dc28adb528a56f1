"""B1 on tiny tables: diagnostics, journals, chunks, plans; ranking and inheritance are tested in test_b1_bruteforce."""

from pyspark.sql import functions as F

from obsspark.params import ServiceLogParams, TimeWindow
from obsspark.plans.service_logs import NO_ENTRIES_LINE, collect_service_logs

LINE_SCHEMA = "service string, file string, is_journal boolean, seq long, raw string"
SRC_SCHEMA = "service string, file string, is_journal boolean, journal_scope string"
ERR_SCHEMA = "service string, file string, code string, stderr string, message string"


def _run(spark, sources, lines, errors=None, **kw):
    params = ServiceLogParams(now_ms=1_706_659_200_000, **kw)
    src = spark.createDataFrame(sources, SRC_SCHEMA)
    ln = spark.createDataFrame(lines, LINE_SCHEMA)
    err = spark.createDataFrame(errors, ERR_SCHEMA) if errors is not None else None
    return collect_service_logs(ln, src, err, params)


def _file(service, path, text, start=0, journal=False):
    return [(service, path, journal, start + i, t) for i, t in enumerate(text.split("\n"))]


def _selected(res):
    rows = res.selected.orderBy(F.col("rank_ms").asc_nulls_first(), "service", "is_journal", "file", "seq").collect()
    return [r.line for r in rows]


def test_journal_window_is_lenient_and_out_of_window_not_inherited(spark):
    j = _file("svc1", "unit", "2024-01-01T00:00:00Z too-early\nno ts after early\n"
              "2024-01-01T07:00:00Z inside\nno ts after inside\n-- No entries --\n   ", journal=True)
    w = TimeWindow(start="2024-01-01T06:00:00Z", end="2024-01-02T00:00:00Z", max_seconds=86_400)
    res = _run(spark, [("svc1", "unit", True, "system")], j, window=w)
    rows = res.selected.orderBy("seq").collect()
    assert [r.line for r in rows] == ["no ts after early", "inside", "no ts after inside"]
    assert [r.rank_ms for r in rows] == [None, 1704092400000, 1704092400000]
    s = res.summary.first()
    assert (s.raw_log_records, s.matched_log_records) == (4, 3)


def test_failed_sources_dropped_and_reported(spark):
    a = _file("svc1", "/a.log", "2024-01-01T00:00:01Z a1")
    j = _file("svc1", "unit", "2024-01-01T00:00:02Z j1", journal=True)
    errors = [("svc1", "unit", "EOTHER", "Permission denied for x", "boom"),
              ("svc1", "/gone.log", "ENOENT", "", "ENOENT: no such file '/gone.log'")]
    sources = [("svc1", "/a.log", False, None), ("svc1", "unit", True, "system"), ("svc1", "/gone.log", False, None)]
    res = _run(spark, sources, a + j, errors)
    assert _selected(res) == ["a1"]
    d = {r.file: (r.type, r.skipped, r.reason, r.error) for r in res.diagnostics.collect()}
    assert d == {"unit": ("log", True, "journal_permission_denied", "Permission denied for x"),
                 "/gone.log": ("log", True, "file_not_found", "ENOENT: no such file '/gone.log'")}
    summ = {r.file: (r.raw_log_records, r.skipped, r.reason) for r in res.summary.collect()}
    assert summ["unit"] == (0, True, "journal_permission_denied")
    assert res.totals.first().diagnostic_records == 2


def test_empty_user_journal_gets_no_entries_record(spark):
    res = _run(spark, [("svc1", "uunit", True, "user")], _file("svc1", "uunit", "-- No entries --", journal=True))
    d = res.diagnostics.collect()
    assert [(r.type, r.ts, r.line) for r in d] == [("log", "--", NO_ENTRIES_LINE)]


def test_all_blank_file_tail_reads_as_empty(spark):
    lines = _file("svc1", "/a.log", "2024-01-01T00:00:01Z a1\n   \n  ")
    res = _run(spark, [("svc1", "/a.log", False, None)], lines, tail_lines=2)
    s = res.summary.first()
    assert s.raw_log_records == 0
    res = _run(spark, [("svc1", "/a.log", False, None)], lines, tail_lines=3)
    assert res.summary.first().raw_log_records == 3


def test_zero_tail_reads_nothing(spark):
    res = _run(spark, [("svc1", "/a.log", False, None)], _file("svc1", "/a.log", "x\ny"), tail_lines=0)
    assert res.selected.count() == 0
    assert res.totals.first().matched_log_records == 0


def test_journal_user_checks_and_window_guard(spark):
    import pytest
    from obsspark.operators.checks import DataCheckError
    from obsspark.operators.diagnostics import assert_window_has_journal, journal_user_errors
    src = spark.createDataFrame([
        ("a", "u", True, "user", "1000"), ("b", "u", True, "user", "4294967296"), ("c", "u", True, "user", "-5"),
        ("d", "u", True, "user", " "), ("e", "u", True, "user", "-bob"), ("f", "u", True, "system", None),
        ("g", "u", True, "user", "bob"), ("h", "/x", False, None, None)],
        "service string, file string, is_journal boolean, journal_scope string, journal_user string")
    bad = sorted(r.service for r in journal_user_errors(src, ["service", "file"]).collect())
    assert bad == ["b", "c", "d", "e"]
    w = TimeWindow(since_seconds=60)
    assert_window_has_journal(src, w)
    with pytest.raises(DataCheckError):
        assert_window_has_journal(src.filter("not is_journal"), w)
    assert_window_has_journal(src.filter("not is_journal"), None)


def test_text_files_end_to_end_with_blocks(spark, tmpdir_fresh):
    """S1 -> B1 -> B6: lines read from text files split into several
    blocks keep their physical order (block, row); the bundle's summary
    record lists every source in order."""
    import os
    from obsspark.plans.bundles import service_bundle
    from obsspark.sources.files import read_log_files
    paths = []
    for name, n in (("a.log", 300), ("b.log", 200)):
        p = os.path.join(tmpdir_fresh, name)
        with open(p, "w") as f:
            for i in range(n):
                f.write(f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z {name} line {i:04d}\n" if i % 7 else f"{name} plain {i:04d}\n")
        paths.append(p)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        lines = read_log_files(spark, paths).withColumn("service", F.lit("svc")).withColumn("is_journal", F.lit(False))
        assert lines.select("file", "block").distinct().count() > 4
        src = lines.select("service", "file", "is_journal").distinct().withColumn(
            "journal_scope", F.lit(None).cast("string"))
        params = ServiceLogParams(now_ms=0, tail_lines=50, include=("plain", "line 02"), max_total_log_lines=20)
        res = collect_service_logs(lines, src, None, params, order_col=["block", "row"], chunk_col="block")
        got = [r.line for r in res.selected.orderBy(F.col("rank_ms").asc_nulls_first(), "file", "block", "row").collect()]
        # expected: last 50 lines per file, filtered, ranked with inheritance, newest 20
        exp = []
        for name, n in (("a.log", 300), ("b.log", 200)):
            last = None
            for i in range(n - 50, n):
                ts = None if i % 7 == 0 else (i // 60) * 60 + i % 60
                last = ts if ts is not None else last
                text = f"{name} plain {i:04d}" if i % 7 == 0 else f"{name} line {i:04d}"
                raw = text if ts is None else f"x {text}"
                if "plain" in raw or "line 02" in raw:
                    exp.append(((ts if ts is not None else last), name, i, text))
        exp.sort(key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0, t[1], t[2]))
        assert got == [t[3] for t in exp[-20:]]
        b = service_bundle(spark, res, src, None, params, "b", "c", keys=("service", "file"),
                           source_order=("service", "is_journal", "file"))
        summ = b.filter("type = 'log_summary' and part = 1").orderBy("k2").collect()
        assert [os.path.basename(s.file) for s in summ] == ["a.log", "b.log"]
        assert sum(s.returned_log_records for s in summ) == 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_chunk_size_does_not_change_results(spark):
    """The two-phase journal path gives the same B1 result whatever the
    chunk size (a hot source split into many chunks)."""
    from obsspark.plans import catalogue as CAT
    from obsspark.sources import fixtures as FX
    sf = "/root/testdata/sf0.001"
    outs = []
    for chunk_rows in (7, 1 << 20):
        res = collect_service_logs(FX.log_lines(spark, sf), CAT.f1_sources(spark, sf), FX.source_errors(spark, sf),
                                   CAT.SERVICE_PARAMS, chunk_rows=chunk_rows)
        outs.append([sorted(map(tuple, df.collect())) for df in (
            res.selected.select("service", "file", "seq", "rank_ms", "line"), res.counts)])
    assert outs[0] == outs[1]


def test_journal_entry_time_selection_is_pushed_down(spark, tmpdir_fresh):
    """With an entry-time column, windowed journal entries are selected
    by entry time (pushed to the parquet scan) before the lenient line
    window; file sources are unaffected."""
    import os
    rows = [("svc", "unit", True, 0, 1704067200000, "no ts old entry"),
            ("svc", "unit", True, 1, 1704096000000, "no ts new entry"),
            ("svc", "unit", True, 2, 1704096000000, "2024-01-01T08:00:00Z stamped"),
            ("svc", "/f", False, 3, 1704067200000, "file line")]
    path = os.path.join(tmpdir_fresh, "lines")
    spark.createDataFrame(rows, "service string, file string, is_journal boolean, seq long, entry_ms long, "
                                "raw string").write.parquet(path)
    lines = spark.read.parquet(path)
    src = spark.createDataFrame([("svc", "unit", True, "system"), ("svc", "/f", False, None)], SRC_SCHEMA)
    w = TimeWindow(start="2024-01-01T06:00:00Z", end="2024-01-01T09:00:00Z", max_seconds=86_400)
    params = ServiceLogParams(now_ms=0, window=w)
    res = collect_service_logs(lines, src, None, params, materialize=False, entry_time_col="entry_ms")
    assert sorted(r.line for r in res.selected.collect()) == ["file line", "no ts new entry", "stamped"]
    plan = res.newest._jdf.queryExecution().executedPlan().toString()
    assert any("entry_ms" in part[:400] for part in plan.split("PushedFilters")[1:])
    # without it the untimestamped old entry passes the lenient window
    res2 = collect_service_logs(lines, src, None, params, materialize=False)
    assert "no ts old entry" in [r.line for r in res2.selected.collect()]


def test_top_k_equals_a_sorted_list(spark):
    """Also with many equal and NULL ranks, whatever the levels of the tree."""
    import random
    from obsspark.operators.rank import newest_lines
    rnd = random.Random(3)
    rows = [(f"s{rnd.randint(0, 5)}", i, (rnd.randint(0, 500) if rnd.random() < 0.9 else None)) for i in range(3000)]
    df = spark.createDataFrame(rows, "src string, seq long, rank_ms long").repartition(9)
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]), reverse=True)
    for k, levels in ((1, 4), (10, 0), (10, 1), (400, 2), (2900, 3), (5000, None)):
        assert [tuple(r) for r in newest_lines(df, k, "rank_ms", ["src", "seq"], fan_in=2, levels=levels).collect()] == want[:k]


def test_no_task_of_the_top_k_tree_merges_more_than_its_fan_in(spark):
    """Rows that reach a level: at most fan_in x K of each group of tasks."""
    from obsspark.operators.rank import limit_in_tree, merge_levels, rank_order
    assert [merge_levels(spark, 64, n) for n in (1, 64, 65, 4096, 4097, 10**6)] == [0, 0, 1, 1, 2, 3]
    df = spark.range(0, 6400, 1, 32).select(F.col("id").alias("seq"), (F.col("id") % 97).alias("rank_ms"))
    order = rank_order("rank_ms", ["seq"])
    for levels, groups in ((1, 8), (2, 2), (3, 1)):
        got = limit_in_tree(df, [], order, 5, fan_in=4, levels=levels)
        assert got.count() == 5 * groups
        plan = got._jdf.queryExecution().executedPlan().toString()
        # every level limits twice: in the tasks before its shuffle, and after it
        assert plan.count("WindowGroupLimit") == 2 * levels


def test_journal_limit_counts_blank_lines(spark):
    lines = _file("svc1", "u", "alpha\nbeta\n \n-- No entries --\ngamma", journal=True)
    res = _run(spark, [("svc1", "u", True, "system")], lines, tail_lines=4)
    assert _selected(res) == ["beta", "gamma"]


def test_no_entries_only_when_user_journal_read_nothing(spark):
    j = _file("svc1", "uunit", "2024-01-01T00:00:00Z something", journal=True)
    res = _run(spark, [("svc1", "uunit", True, "user")], j, include=("absent",))
    assert res.diagnostics.count() == 0
    res = _run(spark, [("svc1", "sunit", True, "system")], _file("svc1", "sunit", "", journal=True))
    assert res.diagnostics.count() == 0 and res.totals.first().matched_log_records == 0


def test_file_read_error_reason(spark):
    from obsspark.operators.diagnostics import classify_source_errors
    df = spark.createDataFrame([("s", "/f", False, None, "EACCES", "", "EACCES: permission denied, open '/f'"),
                                ("s", "u", True, "user", "ENOENT", "", "spawn journalctl ENOENT"),
                                ("s", "v", True, "user", "EOTHER", "  ", "  "),
                                ("s", "w", True, "system", "EOTHER", "", "exit 1")],
                               "service string, file string, is_journal boolean, journal_scope string, code string, "
                               "stderr string, message string")
    got = {r.file: (r.type, r.reason, r.error) for r in classify_source_errors(df).collect()}
    assert got == {"/f": ("log", "read_error", "EACCES: permission denied, open '/f'"),
                   "u": ("log_error", "journalctl_not_found", "journalctl not found"),
                   "v": ("log_error", "journal_read_error", "unknown error"),
                   "w": ("log", "journal_read_error", "exit 1")}
