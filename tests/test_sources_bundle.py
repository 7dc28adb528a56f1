"""Readers (S1, S3, S4, S6, S7), bundle sink/source (S10, S11), streaming."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from obsspark.sources.bundle import conform, read_bundle, write_bundle
from obsspark.sources.files import file_source_lines, read_log_files
from obsspark.sources.kube import read_container_logs, read_events, read_pods
from obsspark.plans.catalogue import _registry_documents
from obsspark.sources.registry import parse_services, read_services
from obsspark.operators.checks import DataCheckError
from obsspark.operators.inventory import assert_registry_valid, registry_violations
from obsspark.streaming import parsed_line_stream, write_line_stream
from tests.bundle_files import bundle_text


def test_read_log_files_splits_on_newline_only(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "a.log")
    with open(p, "w", newline="") as f:
        f.write("2024-01-01T00:00:00Z one\r\n\ntwo\rthree\nlast")
    rows = read_log_files(spark, [p]).orderBy("block", "row").collect()
    assert [r.raw for r in rows] == ["2024-01-01T00:00:00Z one\r", "", "two\rthree", "last"]


def test_read_pods_events_services(spark, tmpdir_fresh):
    pods = os.path.join(tmpdir_fresh, "pods.json")
    with open(pods, "w") as f:
        json.dump({"items": [{"metadata": {"namespace": "n", "name": "p", "labels": {"a": "b"}},
                              "spec": {"containers": [{"name": "c"}]}}], "metadata": {}}, f)
    r = read_pods(spark, pods).first()
    assert (r.metadata.name, r.metadata.labels, r.spec.containers[0].name) == ("p", {"a": "b"}, "c")
    evs = os.path.join(tmpdir_fresh, "events.json")
    with open(evs, "w") as f:
        json.dump({"items": [{"metadata": {"creationTimestamp": "2024-01-01T00:00:00Z", "namespace": "n"},
                              "reason": "OOMKilled", "involvedObject": {"kind": "Pod", "name": "p"}}]}, f)
    e = read_events(spark, evs, ["n"]).first()
    assert (e.namespace, e.creation_timestamp, e.obj_kind, e.obj_uid) == ("n", "2024-01-01T00:00:00Z", "Pod", None)
    reg = os.path.join(tmpdir_fresh, "services.json")
    with open(reg, "w") as f:
        json.dump([{"name": " a ", "logs": [" /x "]}, {"name": "b", "journal": "u", "journalScope": "user",
                                                      "journalUser": 1000}], f)
    s = [(r.service_idx, r.name, r.logs, r.journal_user) for r in read_services(spark, reg).orderBy("service_idx").collect()]
    assert s == [(0, "a", ["/x"], None), (1, "b", None, "1000")]


def test_malformed_registry_raises(spark, tmpdir_fresh):
    reg = os.path.join(tmpdir_fresh, "cut.json")
    with open(reg, "w") as f:
        f.write('[{"name": "a", "logs": ["/x"')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_services(spark, reg).collect()


def test_events_read_from_json_become_ordered_records(spark, tmpdir_fresh):
    from obsspark.plans.bundles import event_records
    evs = os.path.join(tmpdir_fresh, "events.json")
    item = lambda i, ns: {"metadata": {"creationTimestamp": "2024-01-01T00:00:00Z", "namespace": "listed"}, "reason": f"r{i}",
                          "involvedObject": {"kind": "Pod", "name": "p", "namespace": ns}}
    with open(evs, "w") as f:
        json.dump({"items": [item(0, "a"), item(1, "b")]}, f)
    got = event_records(read_events(spark, evs).withColumn("ts", F.lit("t"))).orderBy("k2", "k3").collect()
    assert [(r.namespace, r.reason, r.involved_namespace) for r in got] == [("listed", "r0", "a"), ("listed", "r1", "b")]


def test_files_with_awkward_names_lose_no_lines(spark, tmpdir_fresh):
    names = ["plain.log", "with space.log", "a%20b.log"]
    for n in names:
        with open(os.path.join(tmpdir_fresh, n), "w") as f:
            f.write("one\ntwo\n")
    src = spark.createDataFrame([("s", os.path.join(tmpdir_fresh, n)) for n in names], "service string, file string").withColumn("source", F.col("file"))
    lines, errors = file_source_lines(spark, src)
    assert sorted((os.path.basename(r.source), r.raw) for r in lines.collect()) == sorted((n, x) for n in names for x in ("one", "two"))
    assert errors.count() == 0


def test_read_container_logs(spark):
    df = spark.createDataFrame([("n", "p", "c", False, "a\nb\n")], "namespace string, pod string, container string, "
                                                                  "previous boolean, text string")
    assert [(r.pos, r.raw) for r in read_container_logs(df).collect()] == [(0, "a"), (1, "b"), (2, "")]


def test_bundle_roundtrip_json_shape(spark, tmpdir_fresh):
    rows = spark.createDataFrame([
        (0, None, "", 0, "meta", "b1", '{"k": [1, 2]}', None, None, None, None, None, None),
        (2, 5, "x", 1, "log", None, None, "svc", "unit", "user", "42", "2024-01-01T00:00:00Z", "hello"),
        (2, None, "x", 0, "log", None, None, "svc", None, None, None, None, "no ts"),
        (3, None, "", 0, "event", None, None, None, None, None, None, "t", None),
    ], "section int, k1 long, k2 string, k3 long, type string, bundle_id string, params string, service string, "
       "journal string, journal_scope string, journal_user string, ts string, line string")
    flat = conform(rows.withColumn("involved_kind", F.when(F.col("type") == "event", F.lit("Pod")))
                   .withColumn("involved_name", F.when(F.col("type") == "event", F.lit("p"))))
    out = os.path.join(tmpdir_fresh, "bundle")
    write_bundle(flat, out)
    recs = [json.loads(x) for x in bundle_text(out).splitlines()]
    assert recs[0] == {"type": "meta", "bundleId": "b1", "params": {"k": [1, 2]}}
    assert recs[1] == {"type": "log", "service": "svc", "line": "no ts"}
    assert recs[2] == {"type": "log", "service": "svc", "journal": "unit", "journalScope": "user",
                       "journalUser": "42", "ts": "2024-01-01T00:00:00Z", "line": "hello"}
    assert recs[3] == {"type": "event", "ts": "t", "involvedObject": {"kind": "Pod", "name": "p"}}
    back = read_bundle(spark, out).orderBy("record_no").collect()
    assert [r.type for r in back] == ["meta", "log", "log", "event"]
    assert json.loads(back[0].params) == {"k": [1, 2]}


def test_stream_parses_like_batch(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.log"), "w") as f:
        f.write("2024-01-01T00:00:00Z error one\n\nINFO two\n-- No entries --\n2024-01-01T00:00:01Z error three\n")
    df = parsed_line_stream(spark, src, include=["error", "INFO"], journal=True)
    out = os.path.join(tmpdir_fresh, "out")
    q = write_line_stream(df, out, checkpoint=os.path.join(tmpdir_fresh, "ckpt"))
    q.awaitTermination(120)
    got = sorted(((r.ts, r.line, r.sort_ms) for r in spark.read.parquet(out).collect()), key=lambda t: t[1])
    assert got == [(None, "INFO two", None), ("2024-01-01T00:00:00Z", "error one", 1704067200000),
                   ("2024-01-01T00:00:01Z", "error three", 1704067201000)]


def test_event_and_scrape_operators_on_a_stream(spark, tmpdir_fresh):
    """P20/P21 and P18/P22 are column expressions and a stream-static join:
    they run unchanged on a streaming DataFrame."""
    from obsspark.operators import events as EV
    from obsspark.operators import metrics as M
    src = os.path.join(tmpdir_fresh, "ev")
    os.makedirs(src)
    with open(os.path.join(src, "e.json"), "w") as f:
        for i, (last, ev) in enumerate([("2024-01-02T00:00:00Z", None), ("", "2024-01-02T00:00:00Z"),
                                        (None, "2023-01-01T00:00:00Z"), (None, "2024-01-03T00:00:00Z")]):
            f.write(json.dumps({"event_id": i, "last_timestamp": last, "event_time": ev}) + "\n")
    stream = (spark.readStream.schema("event_id long, last_timestamp string, event_time string, "
                                      "creation_timestamp string").json(src))
    out = EV.event_window(stream.withColumn("ts", EV.event_timestamp()), 1704067200000)
    sink = os.path.join(tmpdir_fresh, "evout")
    q = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", os.path.join(tmpdir_fresh, "evck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == [0, 3]

    scr = os.path.join(tmpdir_fresh, "scr")
    os.makedirs(scr)
    with open(os.path.join(scr, "s.json"), "w") as f:
        f.write(json.dumps({"namespace": "n", "pod": "p", "http_status": 500, "body": "x"}) + "\n")
    refs = spark.createDataFrame([("n", "p", "1.2.3.4", {"prometheus.io/scrape": "true", "prometheus.io/port": "80"})],
                                 "namespace string, name string, pod_ip string, annotations map<string,string>")
    targets = M.scrape_targets(refs)
    s = spark.readStream.schema("namespace string, pod string, http_status int, body string, error_kind string, "
                                "error_message string").json(scr)
    joined = s.join(targets, (s["namespace"] == targets["namespace"]) & (s["pod"] == targets["name"]))
    sink2 = os.path.join(tmpdir_fresh, "scout")
    q2 = (joined.select(s["pod"], "url", "http_status").writeStream.format("parquet").option("path", sink2)
          .option("checkpointLocation", os.path.join(tmpdir_fresh, "scck")).trigger(availableNow=True).start())
    q2.awaitTermination(120)
    assert [(r.pod, r.url) for r in spark.read.parquet(sink2).collect()] == [("p", "http://1.2.3.4:80/metrics")]


def test_read_journal_selectors(spark):
    from obsspark.sources.journal import read_journal
    jl = spark.createDataFrame([
        ("a.service", None, None, 0, "2024-01-01T00:00:00Z sys"),
        ("a.service", None, None, 1, "-- No entries --"),
        (None, "a.service", "1000", 2, "2024-01-01T00:00:00Z user"),
        (None, "a.service", "1001", 3, "other user"),
        (None, "a.service", "1000", 4, "   ")], "unit string, user_unit string, uid string, seq long, raw string")
    assert [r.seq for r in read_journal(jl, unit="a.service").collect()] == [0]
    assert [r.seq for r in read_journal(jl, user_unit="a.service", uid="1000").collect()] == [2]


def _parallel(spark, tmpdir_fresh, flat):
    """Written by several tasks: (folder, rows of the manifest)."""
    out = os.path.join(tmpdir_fresh, "parts")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_bundle(flat, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    return out, spark.read.json(os.path.join(out, "manifest")).orderBy("offset").collect()


def test_members_are_in_bundle_order(spark, tmpdir_fresh):
    """Parallel write: the file has the members in bundle order, the manifest where each begins."""
    from obsspark.plans import catalogue as CAT
    from obsspark.sources.bundle import bundle_text as text_of
    flat = CAT.service_bundle_df(spark, "/root/testdata/sf0.001")
    out, members = _parallel(spark, tmpdir_fresh, flat)
    assert len(members) > 1
    want = "".join(r.value + ("\n" if r.ends else "") for r in text_of(flat).orderBy(
        F.col("section"), F.col("k1").asc_nulls_first(), F.col("k2").asc_nulls_first(),
        F.col("k3").asc_nulls_first()).collect())
    assert bundle_text(out) == want
    assert not os.path.exists(os.path.join(out, "members"))
    lines = want.splitlines()
    back = read_bundle(spark, out).orderBy("record_no").collect()
    assert [r.record_no for r in back] == list(range(len(lines)))
    assert [r.type for r in back] == [json.loads(x)["type"] for x in lines]
    assert {r.member for r in back} == {m.member for m in members if m.records}


def test_records_that_cross_members(spark, tmpdir_fresh):
    """A record of many items lies in several members; each record is read once, by the member it begins in."""
    n = 400
    head = [(0, None, None, None, "meta", None, 1, None), (3, None, None, None, "log_summary", None, None, 0), (3, 2, None, None, "log_summary", None, None, 2),
            (4, None, "a", None, "metrics_text", None, None, None)]
    items = [(3, 1, f"{i:04d}", min(i, 1), "log_summary", f"svc {i}", i, 1) for i in range(n)]
    flat = conform(spark.createDataFrame(head + items, "section int, k1 long, k2 string, k3 long, type string, service string, raw_log_records long, part int"))
    out, members = _parallel(spark, tmpdir_fresh, flat)
    assert len(members) > 4 and any(not m.records for m in members) and not all(m.begins for m in members)
    recs = [json.loads(x) for x in bundle_text(out).splitlines()]
    assert [r["type"] for r in recs] == ["meta", "log_summary", "metrics_text"]
    assert recs[1]["sources"] == [{"service": f"svc {i}", "rawLogRecords": i} for i in range(n)]
    back = read_bundle(spark, out).orderBy("record_no").collect()
    assert [r.type for r in back] == ["meta", "log_summary", "metrics_text"]
    assert [s.raw_log_records for s in back[1].sources] == list(range(n))


def test_torn_bundles_are_refused(spark, tmpdir_fresh):
    import shutil
    rows = [(2, i, "k", i, "log", "svc", f"line {i} " + "x" * (i % 50)) for i in range(300)]
    flat = conform(spark.createDataFrame(rows, "section int, k1 long, k2 string, k3 long, type string, service string, line string"))
    out, members = _parallel(spark, tmpdir_fresh, flat)
    assert read_bundle(spark, out).count() == 300
    with pytest.raises(DataCheckError, match="exists already"):
        write_bundle(flat, out)
    file = os.path.join(out, "bundle.ndjson.gz")
    with open(file, "rb") as f:
        data = f.read()

    def broken(name, new, manifest=True):
        to = os.path.join(tmpdir_fresh, name)
        os.makedirs(to)
        if manifest:
            shutil.copytree(os.path.join(out, "manifest"), os.path.join(to, "manifest"))
        with open(os.path.join(to, "bundle.ndjson.gz"), "wb") as f:
            f.write(new)
        return to

    with pytest.raises(DataCheckError, match="no manifest"):
        read_bundle(spark, broken("uncommitted", data, manifest=False))
    with pytest.raises(DataCheckError, match="torn"):
        read_bundle(spark, broken("short", data[:-5]))
    first, second = members[0], members[1]
    swapped = data[second.offset:second.offset + second.bytes] + data[:first.bytes] + data[second.offset + second.bytes:]
    with pytest.raises(Exception, match="manifest says"):
        read_bundle(spark, broken("swapped", swapped)).count()


def test_journal_source_lines_with_fallback(spark):
    from obsspark.operators.inventory import expand_sources
    from obsspark.sources.journal import journal_source_lines
    reg = spark.createDataFrame([
        (0, "a", None, "a.service", "system", None, None),
        (1, "b", None, "b.service", "user", "1000", None),
        (2, "c", None, "c.service", "user", "1000", None)],
        "service_idx int, name string, logs array<string>, journal string, journal_scope string, "
        "journal_user string, metrics string")
    src = expand_sources(reg).withColumn("source", F.coalesce("file", "journal"))
    jl = spark.createDataFrame([
        ("a.service", None, None, None, 0, "sys line"),
        (None, "b.service", "b.service", "1000", 1, "b primary"),
        (None, None, "b.service", "1000", 2, "b fallback only"),
        (None, None, "c.service", "1000", 3, "c fallback"),
        (None, None, "c.service", "1001", 4, "other user"),
        (None, "c.service", None, "1000", 5, "-- No entries --")],
        "unit string, user_unit string, systemd_user_unit string, uid string, seq long, raw string")
    got = sorted((r.service, r.seq, r.via) for r in journal_source_lines(src, jl).collect())
    assert got == [("a", 0, "unit"), ("b", 1, "primary"), ("c", 3, "fallback")]


def test_read_bundle_sources_are_snake_case(spark, tmpdir_fresh):
    from obsspark.plans import catalogue as CAT
    out = os.path.join(tmpdir_fresh, "sb")
    write_bundle(CAT.service_bundle_df(spark, "/root/testdata/sf0.001"), out)
    summ = read_bundle(spark, out).filter("type = 'log_summary'").first()
    assert summ.sources and set(summ.sources[0].asDict()) >= {"raw_log_records", "returned_log_records"}
    assert sum(s.returned_log_records for s in summ.sources) == summ.returned_log_records


def test_gzip_log_files_read_in_order(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "app.log.gz")
    with gzip.open(p, "wt") as f:
        for i in range(500):
            f.write(f"2024-01-01T00:00:{i % 60:02d}Z line {i:04d}\n")
    rows = read_log_files(spark, [p]).orderBy("block", "row").collect()
    assert {r.block for r in rows} == {0}
    assert [r.raw[-9:] for r in rows[:2]] == ["line 0000", "line 0001"] and len(rows) == 500


def test_bundle_escapes_awkward_text(spark, tmpdir_fresh):
    awkward = 'say "hi"\\path\ttab\nnext ü 日本 \u2028 end'
    flat = conform(spark.createDataFrame([(2, 1, "k", 1, "log", "svc", awkward)],
                                         "section int, k1 long, k2 string, k3 long, type string, service string, "
                                         "line string"))
    out = os.path.join(tmpdir_fresh, "esc")
    write_bundle(flat, out)
    text = bundle_text(out)
    assert len(text.rstrip("\n").split("\n")) == 1
    assert json.loads(text)["line"] == awkward
    assert read_bundle(spark, out).first().line == awkward


def test_registry_values_of_wrong_types_break_their_rules(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "reg.json")
    entries = [{"name": "fine", "logs": ["/a.log"], "journal": "u", "journalScope": "user", "journalUser": 1000},
               {"name": 7}, {"name": "b", "logs": [5]}, {"name": "c", "logs": "x"}, {"name": "d", "journal": {"a": 1}},
               {"name": "e", "journal": "u", "journalScope": 3}, {"name": "f", "journalUser": 1.5}, {"name": "g", "metrics": [1]},
               {"name": "h", "logs": None, "journal": None, "metrics": None}, 5]
    with open(p, "w") as f:
        json.dump(entries, f)
    reg = read_services(spark, p)
    assert reg.filter("service_idx = 0").first().journal_user == "1000"
    got = {(r.service_idx, r.rule.split()[0]) for r in registry_violations(reg).collect()}
    assert got == {(1, "name"), (2, "logs"), (3, "logs"), (4, "journal"), (5, "journalScope"), (6, "journalUser"),
                   (7, "metrics"), (9, "name")}
    with pytest.raises(DataCheckError, match="name is required"):
        assert_registry_valid(reg)


def test_gzip_lines_count_on_to_further_blocks(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "big.log.gz")
    with gzip.open(p, "wt") as f:
        f.writelines(f"{i}\n" for i in range(120_000))
    df = read_log_files(spark, [p])
    assert sorted(r.block for r in df.select("block").distinct().collect()) == [0, 1, 2]
    last = df.orderBy("block", "row").select("raw").tail(2)
    assert [r.raw for r in last] == ["119998", "119999"]


def test_registry_documents_of_the_catalogue_are_bounded(spark):
    entry = spark.range(1, 2501).select(F.col("id").cast("int").alias("at"), F.struct(F.col("id").cast("string").alias("name")).alias("e"))
    docs = _registry_documents(entry)
    assert docs.agg(F.max(F.size("ats"))).first()[0] <= 1000
    got = [(r.name, r.ats[r.service_idx]) for r in parse_services(docs, "ats").collect()]
    assert sorted(got) == sorted((str(i), i) for i in range(1, 2501))
