"""Request-level entry points: authorization order and bundle content."""

import pytest
from pyspark.sql import functions as F

from obsspark.operators.checks import DataCheckError
from obsspark.params import ArgumentError, ContainerLogParams, ServiceLogParams, TimeWindow
from obsspark.plans.requests import Forbidden, Principal, pod_bundle_request, service_bundle_request
from tests.bundle_files import bundle_text

REG = "service_idx int, name string, logs array<string>, journal string, journal_scope string, " \
      "journal_user string, metrics string"


def _registry(spark):
    return spark.createDataFrame([
        (0, "api", ["/var/log/api.log"], "api.service", "system", None, "http://a/m"),
        (1, "worker", None, "worker.service", "user", "-7", None),
        (2, "cron", ["/var/log/cron.log"], None, None, None, None)], REG)


def _lines(spark):
    rows = [("api", "/var/log/api.log", 0, "2024-01-01T00:00:01Z api up"),
            ("api", "api.service", 1, "2024-01-01T00:00:02Z journal line"),
            ("cron", "/var/log/cron.log", 2, "cron untimestamped")]
    return spark.createDataFrame(rows, "service string, source string, seq long, raw string")


def test_principal_claims():
    assert Principal.from_claims({}).admin is True
    assert Principal.from_claims(None).admin is False
    p = Principal.from_claims({"admin": "true", "allowedServices": [" a* ", 3, ""], "capabilities": ["logs"]})
    assert (p.admin, p.allowed_services, p.capabilities) == (False, ("a*",), ("logs",))


def test_service_request_authorization_order(spark):
    reg, lines = _registry(spark), _lines(spark)
    params = ServiceLogParams(now_ms=1_706_659_200_000)
    no_metrics = Principal(capabilities=("logs",), allowed_services=("*",))
    with pytest.raises(Forbidden):
        service_bundle_request(spark, reg, lines, None, None, params, no_metrics)
    scoped = Principal(capabilities=("logs", "metrics"), allowed_services=("a*",))
    with pytest.raises(Forbidden):          # forbidden before unknown
        service_bundle_request(spark, reg, lines, None, None, params, scoped, names=["zzz"])
    with pytest.raises(DataCheckError, match="Unknown service"):
        service_bundle_request(spark, reg, lines, None, None, params, Principal(admin=True), names=["zzz"])
    windowed = ServiceLogParams(now_ms=1_706_659_200_000, window=TimeWindow(since_seconds=60))
    with pytest.raises(DataCheckError, match="journal"):
        service_bundle_request(spark, reg, lines, None, None, windowed, Principal(admin=True), names=["cron"])


def test_service_request_bundle(spark):
    reg, lines = _registry(spark), _lines(spark)
    scrapes = spark.createDataFrame([("api", 200, "m 1", None, None)],
                                    "service string, http_status int, body string, error_kind string, "
                                    "error_message string")
    params = ServiceLogParams(now_ms=1_706_659_200_000)
    b = service_bundle_request(spark, reg, lines, None, scrapes, params, Principal(admin=True), bundle_id="b1")
    rows = b.orderBy("section", F.col("k1").asc_nulls_first(), "k2", "k3").collect()
    kinds = [(r.section, r.type, r.service, r.file, r.journal, r.line, r.reason) for r in rows]
    assert kinds[0][:2] == (0, "meta")
    # worker's user journal has an invalid user (-7): a log_error side record
    assert (1, "log_error", "worker", None, "worker.service", None, "journal_user_invalid") in kinds
    lines_out = [k for k in kinds if k[0] == 2]
    assert [k[5] for k in lines_out] == ["cron untimestamped", "api up", "journal line"]
    assert [k[4] for k in lines_out] == [None, None, "api.service"]
    summ = [r for r in rows if r.type == "log_summary" and r.part == 1]
    assert [(s.service, s.file, s.journal) for s in summ] == [
        ("api", "/var/log/api.log", None), ("api", None, "api.service"), ("worker", None, "worker.service"),
        ("cron", "/var/log/cron.log", None)]
    metrics = [(r.service, r.ok, r.reason) for r in rows if r.type == "metrics_text"]
    assert metrics == [("api", True, None), ("worker", None, "no_metrics_url"), ("cron", None, "no_metrics_url")]


def test_pod_request(spark):
    from obsspark.sources.kube import POD
    pods = spark.createDataFrame([
        {"metadata": {"namespace": "ns-1", "name": "p1", "labels": {"app": "web"}},
         "spec": {"containers": [{"name": "c"}]}, "status": {"podIP": "1.1.1.1"}},
        {"metadata": {"namespace": "ns-2", "name": "p2", "labels": {"app": "web"}},
         "spec": {"containers": [{"name": "c"}]}, "status": {}}], POD)
    logs = spark.createDataFrame([("ns-1", "p1", "c", False, 0, "2024-01-31T00:00:00Z hi")],
                                 "namespace string, pod string, container string, previous boolean, pos long, raw string")
    params = ContainerLogParams(now_ms=1_706_659_200_000, tail_lines=10)
    narrow = Principal(capabilities=("logs", "pods"), allowed_namespaces=("ns-1",))
    with pytest.raises(Forbidden):
        pod_bundle_request(spark, pods, logs, None, None, params, narrow, namespace="*", selector="app=web")
    b = pod_bundle_request(spark, pods, logs, None, None, params, narrow, namespace="ns-1", selector="app=web")
    assert [(r.type, r.pod, r.line) for r in b.filter("type = 'log'").collect()] == [("log", "p1", "hi")]
    req = spark.createDataFrame([("ns-1", "p1"), ("ns-1", "missing")], "namespace string, pod string")
    with pytest.raises(DataCheckError, match="Pod not found: ns-1/missing"):
        pod_bundle_request(spark, pods, logs, None, None, params, Principal(admin=True), requested=req)


def test_discovery_requests(spark):
    from obsspark.plans.requests import discover_pods_request, discover_services_request
    from obsspark.sources.kube import POD
    pods = spark.createDataFrame([
        {"metadata": {"namespace": "ns-1", "name": "web-1", "labels": {"app": "web"}},
         "spec": {"containers": [{"name": "c"}]}, "status": {"podIP": "1.1.1.1"}}], POD)
    with pytest.raises(Forbidden):
        discover_pods_request(spark, pods, Principal(capabilities=("logs",), allowed_namespaces=("*",)))
    with pytest.raises(Forbidden):
        discover_pods_request(spark, pods, Principal(capabilities=("pods",), allowed_namespaces=("ns-*",)))
    rows = discover_pods_request(spark, pods, Principal(capabilities=("pods",), allowed_namespaces=("ns-*",)),
                                 namespace="ns-1", needle="web").collect()
    assert [r.name for r in rows] == ["web-1"] and "pod_ip" not in rows[0].asDict()
    reg = _registry(spark)
    names = [r.name for r in discover_services_request(spark, reg, Principal(allowed_services=("*r*",))).collect()]
    assert sorted(names) == ["cron", "worker"]
    full = discover_services_request(spark, reg, Principal(admin=True)).orderBy("service_idx").collect()
    assert [r.logs for r in full] == [["/var/log/api.log"], [], ["/var/log/cron.log"]]


def test_pod_bundle_json_records(spark, tmpdir_fresh):
    """B7 written as NDJSON: record shapes and section order."""
    import json
    import os
    from obsspark.sources.bundle import write_bundle
    from obsspark.sources.kube import POD
    pods = spark.createDataFrame([
        {"metadata": {"namespace": "ns-1", "name": "a", "uid": "u-a", "labels": {"app": "web"},
                      "annotations": {"prometheus.io/scrape": "true", "prometheus.io/port": "9090"}},
         "spec": {"containers": [{"name": "main"}], "initContainers": [{"name": "init"}]},
         "status": {"podIP": "10.0.0.1"}},
        {"metadata": {"namespace": "ns-1", "name": "b", "labels": {"app": "web"}},
         "spec": {"containers": [{"name": "main"}]}, "status": {}}], POD)
    logs = spark.createDataFrame([
        ("ns-1", "a", "main", False, 0, "2024-01-31T00:00:00Z hello"),
        ("ns-1", "a", "main", True, 0, "2024-01-31T00:00:01Z before restart")],
        "namespace string, pod string, container string, previous boolean, pos long, raw string")
    events = spark.createDataFrame([
        (7, "ns-1", "2024-01-31T00:00:02Z", None, None, "OOMKilled", "killed", "Pod", "a", "u-a")],
        "event_id long, namespace string, last_timestamp string, event_time string, creation_timestamp string, "
        "reason string, message string, obj_kind string, obj_name string, obj_uid string")
    scrapes = spark.createDataFrame([("ns-1", "a", 200, "up 1", None, None)],
                                    "namespace string, pod string, http_status int, body string, error_kind string, "
                                    "error_message string")
    params = ContainerLogParams(now_ms=1_706_659_500_000, tail_lines=10, previous=True)
    b = pod_bundle_request(spark, pods, logs, events, scrapes, params, Principal(admin=True), namespace="ns-1",
                           selector="app=web", bundle_id="b-7", created_at="2024-01-31T00:05:00.000Z")
    out = os.path.join(tmpdir_fresh, "pb")
    write_bundle(b, out)
    recs = [json.loads(x) for x in bundle_text(out).splitlines()]
    now = "2024-01-31T00:05:00.000Z"
    assert recs[0]["type"] == "meta" and recs[0]["bundleId"] == "b-7" and recs[0]["params"]["kind"] == "pods"
    assert recs[1:] == [
        {"type": "log", "namespace": "ns-1", "pod": "a", "container": "main", "ts": "2024-01-31T00:00:00Z",
         "line": "hello"},
        {"type": "log", "namespace": "ns-1", "pod": "a", "container": "main", "ts": "2024-01-31T00:00:01Z",
         "previous": True, "line": "before restart"},
        {"type": "log", "namespace": "ns-1", "pod": "a", "container": "init", "ts": now, "previous": True,
         "skipped": True, "reason": "no_previous_container"},
        {"type": "log", "namespace": "ns-1", "pod": "b", "container": "main", "ts": now, "previous": True,
         "skipped": True, "reason": "no_previous_container"},
        {"type": "event", "namespace": "ns-1", "ts": "2024-01-31T00:00:02Z", "reason": "OOMKilled",
         "message": "killed", "involvedObject": {"kind": "Pod", "name": "a", "namespace": "ns-1"}},
        {"type": "metrics_text", "namespace": "ns-1", "pod": "b", "ts": now, "skipped": True,
         "reason": "annotation_missing"},
        {"type": "metrics_text", "namespace": "ns-1", "pod": "a", "podIP": "10.0.0.1", "port": 9090,
         "path": "/metrics", "ts": now, "ok": True, "content": "up 1"},
    ]


def test_service_bundle_json_records(spark, tmpdir_fresh):
    import json
    import os
    from obsspark.sources.bundle import write_bundle
    reg, lines = _registry(spark), _lines(spark)
    params = ServiceLogParams(now_ms=1_706_659_200_000, max_total_log_lines=2)
    b = service_bundle_request(spark, reg, lines, None, None, params, Principal(admin=True), names=["api", "worker"],
                               include_metrics=False, bundle_id="s-1", created_at="c")
    out = os.path.join(tmpdir_fresh, "sb")
    write_bundle(b, out)
    recs = [json.loads(x) for x in bundle_text(out).splitlines()]
    now = "2024-01-31T00:00:00.000Z"
    assert [r["type"] for r in recs] == ["meta", "log_error", "log", "log", "log_summary"]
    assert recs[1] == {"type": "log_error", "service": "worker", "journal": "worker.service", "journalScope": "user",
                       "journalUser": "-7", "ts": now, "reason": "journal_user_invalid",
                       "error": 'journalUser "-7" must be a non-negative UID or existing username'}
    assert recs[2] == {"type": "log", "service": "api", "file": "/var/log/api.log", "ts": "2024-01-01T00:00:01Z",
                       "line": "api up"}
    assert recs[3] == {"type": "log", "service": "api", "journal": "api.service", "ts": "2024-01-01T00:00:02Z",
                       "line": "journal line"}
    s = recs[4]
    assert (s["maxTotalLogLines"], s["lineLimited"], s["matchedLogRecords"], s["returnedLogRecords"],
            s["diagnosticRecords"], s["ts"]) == (2, False, 2, 2, 1, now)
    assert s["sources"] == [
        {"service": "api", "file": "/var/log/api.log", "rawLogRecords": 1, "matchedLogRecords": 1,
         "returnedLogRecords": 1},
        {"service": "api", "journal": "api.service", "rawLogRecords": 1, "matchedLogRecords": 1,
         "returnedLogRecords": 1},
        {"service": "worker", "journal": "worker.service", "journalScope": "user", "journalUser": "-7",
         "rawLogRecords": 0, "matchedLogRecords": 0, "returnedLogRecords": 0, "skipped": True,
         "reason": "journal_user_invalid",
         "error": 'journalUser "-7" must be a non-negative UID or existing username'}]


def test_jobs_cli_service_bundle(spark, tmpdir_fresh):
    import json
    import os
    from obsspark.jobs import run
    reg = os.path.join(tmpdir_fresh, "services.json")
    with open(reg, "w") as f:
        json.dump([{"name": "api", "logs": ["/var/log/api.log"], "journal": "api.service"}], f)
    lines = os.path.join(tmpdir_fresh, "lines")
    _lines(spark).filter("service = 'api'").write.parquet(lines)
    out = os.path.join(tmpdir_fresh, "bundle")
    run(["service-bundle", "--registry", reg, "--lines", lines, "--out", out, "--now-ms", "1706659200000",
         "--include", "journal"], spark=spark)
    recs = [json.loads(x) for x in bundle_text(out).splitlines()]
    assert [r["type"] for r in recs] == ["meta", "log", "log_summary"]
    assert recs[1]["line"] == "journal line" and recs[2]["matchedLogRecords"] == 1


def test_jobs_cli_pod_bundle(spark, tmpdir_fresh):
    import json
    import os
    from obsspark.jobs import run
    pods = os.path.join(tmpdir_fresh, "pods.json")
    with open(pods, "w") as f:
        json.dump({"items": [{"metadata": {"namespace": "prod", "name": "web-1", "labels": {"app": "web"}},
                              "spec": {"containers": [{"name": "c"}]}, "status": {"podIP": "10.1.1.1"}}]}, f)
    logs = os.path.join(tmpdir_fresh, "logs")
    spark.createDataFrame([("prod", "web-1", "c", False, 0, "2024-01-31T00:00:00Z ok"),
                           ("prod", "web-1", "c", False, 1, "2023-01-01T00:00:00Z too old")],
                          "namespace string, pod string, container string, previous boolean, pos long, raw string"
                          ).write.parquet(logs)
    out = os.path.join(tmpdir_fresh, "bundle")
    run(["pod-bundle", "--pods", pods, "--container-logs", logs, "--selector", "app=web", "--namespace", "prod",
         "--since", "3600", "--now-ms", "1706659200000", "--out", out,
         "--claims", json.dumps({"capabilities": ["logs", "pods"], "allowedNamespaces": ["prod"]})], spark=spark)
    recs = [json.loads(x) for x in bundle_text(out).splitlines()]
    assert [(r["type"], r.get("line")) for r in recs] == [("meta", None), ("log", "ok")]


def test_target_rules(spark):
    from obsspark.params import ArgumentError
    reg, lines = _registry(spark), _lines(spark)
    params = ServiceLogParams(now_ms=0)
    with pytest.raises(ArgumentError):
        service_bundle_request(spark, reg, lines, None, None, params, Principal(admin=True), names=[" "])
    with pytest.raises(ArgumentError):
        pod_bundle_request(spark, reg, None, None, None, ContainerLogParams(now_ms=0), Principal(admin=True))


def test_service_request_from_text_files(spark, tmpdir_fresh):
    import os
    from obsspark.operators.inventory import expand_sources, select_services
    from obsspark.sources.files import file_source_lines
    a = os.path.join(tmpdir_fresh, "a.log")
    with open(a, "w") as f:
        f.write("2024-01-01T00:00:01Z one\nplain two\n\n2024-01-01T00:00:03Z three\n")
    gone = os.path.join(tmpdir_fresh, "gone.log")
    reg = spark.createDataFrame([(0, "web", [a, gone], None, None, None, None)],
                                "service_idx int, name string, logs array<string>, journal string, "
                                "journal_scope string, journal_user string, metrics string")
    sources = expand_sources(select_services(reg)).withColumn("source", F.coalesce("file", "journal"))
    lines, errors = file_source_lines(spark, sources)
    params = ServiceLogParams(now_ms=1_706_659_200_000, tail_lines=3)
    b = service_bundle_request(spark, reg, lines, errors, None, params, Principal(admin=True),
                               include_metrics=False, order_col=["block", "row"], chunk_col="block")
    rows = b.orderBy("section", F.col("k1").asc_nulls_first(), "k2", "k3").collect()
    assert [(r.type, r.file, r.line, r.reason) for r in rows if r.type != "meta"][:4] == [
        ("log", gone, None, "file_not_found"),
        ("log", a, "plain two", None), ("log", a, "three", None),
        ("log_summary", None, None, None)]
    # tail 3 of 4 physical lines: "plain two", "", "three" -> 2 non-empty
    summ = [r for r in rows if r.type == "log_summary" and r.part == 1]
    assert [(s.file, s.raw_log_records, s.reason) for s in summ] == [(a, 2, None), (gone, 0, "file_not_found")]


def test_jobs_cli_files_and_journal(spark, tmpdir_fresh):
    import json
    import os
    from obsspark.jobs import run
    log = os.path.join(tmpdir_fresh, "app.log")
    with open(log, "w") as f:
        f.write("2024-01-01T00:00:01Z file line\n")
    reg = os.path.join(tmpdir_fresh, "services.json")
    with open(reg, "w") as f:
        json.dump([{"name": "app", "logs": [log, log + ".missing"], "journal": "app.service"}], f)
    jt = os.path.join(tmpdir_fresh, "journal")
    spark.createDataFrame([("app.service", None, None, None, 5, "2024-01-01T00:00:02Z journal line")],
                          "unit string, user_unit string, systemd_user_unit string, uid string, seq long, raw string"
                          ).write.parquet(jt)
    out = os.path.join(tmpdir_fresh, "bundle")
    run(["service-bundle", "--registry", reg, "--read-files", "--journal", jt, "--out", out,
         "--now-ms", "1706659200000"], spark=spark)
    recs = [json.loads(x) for x in bundle_text(out).splitlines()]
    assert [(r["type"], r.get("line"), r.get("reason")) for r in recs] == [
        ("meta", None, None), ("log", None, "file_not_found"), ("log", "file line", None),
        ("log", "journal line", None), ("log_summary", None, None)]


def test_jobs_cli_listings(spark, tmpdir_fresh):
    import json
    import os
    from obsspark.jobs import run
    pods = os.path.join(tmpdir_fresh, "pods.json")
    with open(pods, "w") as f:
        json.dump({"items": [{"metadata": {"namespace": "prod", "name": "web-1", "labels": {"app": "web"}},
                              "spec": {"containers": [{"name": "c"}]}}]}, f)
    out = os.path.join(tmpdir_fresh, "plist")
    run(["pods", "--pods", pods, "--q", "web", "--out", out], spark=spark)
    rows = spark.read.json(out).collect()
    assert [(r.namespace, r.name) for r in rows] == [("prod", "web-1")]
    reg = os.path.join(tmpdir_fresh, "services.json")
    with open(reg, "w") as f:
        json.dump([{"name": "api"}, {"name": "db"}], f)
    out2 = os.path.join(tmpdir_fresh, "slist")
    run(["services", "--registry", reg, "--claims", json.dumps({"allowedServices": ["a*"]}), "--out", out2],
        spark=spark)
    assert [r.name for r in spark.read.json(out2).collect()] == ["api"]


def test_file_listed_twice_is_read_once_per_place(spark):
    reg = spark.createDataFrame([(0, "api", ["/a.log", "/a.log"], None, None, None, None)], REG)
    lines = spark.createDataFrame([("api", "/a.log", i, t) for i, t in enumerate("abc")],
                                  "service string, source string, seq long, raw string")
    b = service_bundle_request(spark, reg, lines, None, None, ServiceLogParams(now_ms=1_706_659_200_000, tail_lines=2),
                               Principal(admin=True), include_metrics=False)
    assert sorted(r.line for r in b.filter("type = 'log'").collect()) == ["b", "b", "c", "c"]
    summary = b.filter("type = 'log_summary' and part = 1").collect()
    assert [(s.raw_log_records, s.returned_log_records) for s in summary] == [(2, 2), (2, 2)]


def test_invalid_registry_fails_the_request(spark):
    reg = spark.createDataFrame([(0, "api", [" "], None, None, None, None)], REG)
    with pytest.raises(DataCheckError, match="logs items"):
        service_bundle_request(spark, reg, reg, None, None, ServiceLogParams(now_ms=0), Principal(admin=True))


_EVENT = ("event_id long, namespace string, last_timestamp string, event_time string, creation_timestamp string, "
          "reason string, message string, obj_kind string, obj_name string, obj_uid string")


def _listed_pods(spark, *uids):
    from obsspark.sources.kube import POD
    pods = [({"namespace": "n", "name": "p", "uid": u, "labels": {"app": "web"}}, {"containers": [{"name": "main"}]}, {}) for u in uids]
    df = spark.createDataFrame(pods, POD)
    return df.withColumn("page", F.lit("f")).withColumn("item", F.when(F.col("metadata.uid") == uids[-1], 1).otherwise(0))


def test_events_of_a_replaced_pod_are_dropped(spark):
    events = spark.createDataFrame([
        (1, "n", "2024-01-31T00:00:02Z", None, None, "a", "", "Pod", "p", "old"),
        (2, "n", "2024-01-31T00:00:02Z", None, None, "b", "", "Pod", "p", "new")], _EVENT)
    params = ContainerLogParams(now_ms=1_706_659_500_000, tail_lines=10)
    b = pod_bundle_request(spark, _listed_pods(spark, "old", "new"), None, events, None, params, Principal(admin=True),
                           namespace="n", selector="app=web")
    assert [r.reason for r in b.filter("type = 'event'").collect()] == ["b"]


def test_failed_log_reads_skip_or_fail_the_bundle(spark):
    pods = _listed_pods(spark, "u")
    logs = spark.createDataFrame([("n", "p", "main", False, 0, "2024-01-31T00:00:00Z hello")],
                                 "namespace string, pod string, container string, previous boolean, pos long, raw string")
    params = ContainerLogParams(now_ms=1_706_659_500_000, tail_lines=10, previous=True)
    schema = "namespace string, pod string, container string, previous boolean, status int, message string"

    def bundle(*errors):
        return pod_bundle_request(spark, pods, logs, None, None, params, Principal(admin=True), namespace="n",
                                  selector="app=web", log_errors=spark.createDataFrame(list(errors), schema))

    b = bundle(("n", "p", "main", True, 404, None), ("n", "other", "main", False, 500, "not selected"))
    assert [(r.previous, r.reason) for r in b.filter("type = 'log' and skipped").collect()] == [(True, "no_previous_container")]
    with pytest.raises(DataCheckError, match="log fetch failed for n/p"):
        bundle(("n", "p", "main", False, 404, "boom"))


def test_max_pods_holds_for_listed_pods(spark):
    requested = spark.createDataFrame([("n", "p"), ("n", "q")], "namespace string, pod string")
    with pytest.raises(ArgumentError, match="maxPods"):
        pod_bundle_request(spark, _listed_pods(spark, "u"), None, None, None, ContainerLogParams(now_ms=0), Principal(admin=True),
                           requested=requested, max_pods=1)
