"""Registry rules, label selectors, pod refs, event timestamp and uid rules,
container logs and previous-log classification."""

import pytest
from pyspark.sql import functions as F

from obsspark.operators import containers as C
from obsspark.operators import events as EV
from obsspark.operators import inventory as INV
from obsspark.operators.checks import DataCheckError
from obsspark.params import ContainerLogParams, TimeWindow

REG = "service_idx int, name string, logs array<string>, journal string, journal_scope string, " \
      "journal_user string, metrics string"


def test_registry_violations(spark):
    rows = [(0, " a ", ["/x"], None, None, None, None),
            (1, "", None, None, None, None, None),
            (2, "b", ["/y", " "], "u", "user", None, " "),
            (3, "c", None, None, "system", None, None),
            (4, "d", None, "u", "system", "1000", None),
            (5, "e", None, "u", "user", "4294967296", None),
            (6, "a", None, "u", "weird", None, None)]
    got = sorted((r.service_idx, r.rule) for r in INV.registry_violations(spark.createDataFrame(rows, REG)).collect())
    assert got == sorted([
        (1, INV.RULE_NAME), (2, INV.RULE_LOGS), (2, INV.RULE_USER_REQUIRED), (2, INV.RULE_METRICS),
        (3, INV.RULE_SCOPE_NEEDS_JOURNAL), (4, INV.RULE_USER_NEEDS_SCOPE), (5, INV.RULE_USER),
        (6, INV.RULE_SCOPE), (6, INV.RULE_DUPLICATE)])


def test_expand_sources_order(spark):
    rows = [(0, "a", ["/1", "/2"], "ua", "user", "7", None), (1, "b", None, "ub", None, None, None),
            (2, "c", ["/3"], None, None, None, None)]
    got = [(r.service, r.source_pos, r.file, r.journal, r.journal_scope, r.journal_user)
           for r in INV.expand_sources(spark.createDataFrame(rows, REG)).orderBy("service_idx", "source_pos").collect()]
    assert got == [("a", 0, "/1", None, None, None), ("a", 1, "/2", None, None, None),
                   ("a", 2, None, "ua", "user", "7"), ("b", 0, None, "ub", "system", None),
                   ("c", 0, "/3", None, None, None)]


def test_unknown_services_check(spark):
    reg = spark.createDataFrame([(0, "a", None, None, None, None, None)], REG)
    INV.assert_services_known(spark, reg, ["a"])
    with pytest.raises(DataCheckError, match="Unknown service: zz"):
        INV.assert_services_known(spark, reg, ["a", "zz"])


def _pods(spark):
    from obsspark.sources.kube import POD
    pods = [
        {"metadata": {"namespace": "n1", "name": "p1", "uid": "", "labels": {"app": "web", "tier": "fe"}},
         "spec": {"containers": [{"name": "c1"}, {"name": None}], "initContainers": [{"name": "i1"}]},
         "status": {"podIP": "1.2.3.4", "phase": "Running", "conditions": [{"type": "Ready", "status": "True"}]}},
        {"metadata": {"namespace": "n1", "name": "p2", "uid": "u2", "labels": {"app": "db"}},
         "spec": {"containers": [{"name": "c"}]}, "status": {"phase": "Pending"}},
        {"metadata": {"namespace": "n2", "name": "p3", "uid": "u3"}, "spec": {}, "status": {}},
    ]
    return spark.createDataFrame(pods, POD)


def test_label_selectors(spark):
    pods = _pods(spark)
    sel = lambda ns, s: sorted(r.metadata.name for r in INV.pods_by_selector(pods, ns, s).collect())
    assert sel("*", "app=web") == ["p1"]
    assert sel("*", "app!=web") == ["p2", "p3"]
    assert sel("*", "app in (web, db)") == ["p1", "p2"]
    assert sel("*", "app notin (web)") == ["p2", "p3"]
    assert sel("*", "tier") == ["p1"]
    assert sel("*", "!tier") == ["p2", "p3"]
    assert sel("n1", "app") == ["p1", "p2"]
    assert sel("*", "app==web,tier=fe") == ["p1"]


def test_pod_refs_and_describe(spark):
    pods = _pods(spark)
    refs = {r.name: (r.uid, r.containers, r.labels) for r in INV.pod_refs(pods).collect()}
    assert refs["p1"] == (None, ["c1", "i1"], {"app": "web", "tier": "fe"})
    assert refs["p3"] == ("u3", [], {})
    d = {r.name: r for r in INV.describe_pods(pods, admin=False).collect()}
    assert d["p1"].ready is True and d["p2"].ready is False and "pod_ip" not in d["p1"].asDict()
    a = {r.name: r for r in INV.describe_pods(pods, admin=True).collect()}
    assert a["p1"].pod_ip == "1.2.3.4" and a["p3"].annotations == {}
    with pytest.raises(DataCheckError):
        INV.assert_pod_cap(INV.pod_refs(pods), 2)
    INV.assert_pod_cap(INV.pod_refs(pods), 3)


def test_event_timestamp_and_uid_rule(spark):
    ev = spark.createDataFrame([
        (1, "n1", "", "2024-01-01T00:00:00Z", None, "Pod", "p1", "x"),       # empty last does not fall through
        (2, "n1", None, "2024-01-01T00:00:05Z", None, "Pod", "p1", "other"),  # selected uid null -> name only
        (3, "n1", None, None, "2024-01-01T00:00:06Z", "Pod", "p2", "bad"),    # uid mismatch
        (4, "n1", None, None, "2024-01-01T00:00:07Z", "Pod", "p2", ""),       # empty uid -> name only
        (5, "n1", "2024-01-01T00:00:08Z", None, None, "Node", "p2", None),    # not a pod
        (6, "n2", "2024-01-01T00:00:09Z", None, None, "Pod", "p2", "u2"),     # other namespace
        (7, "n1", "2023-12-31T00:00:00Z", None, None, "Pod", "p2", "u2"),     # before window
    ], "event_id long, namespace string, last_timestamp string, event_time string, creation_timestamp string, "
       "obj_kind string, obj_name string, obj_uid string")
    uids = spark.createDataFrame([("n1", "p1", None), ("n1", "p2", "u2")], "namespace string, name string, uid string")
    got = sorted(r.event_id for r in EV.collect_events(ev, uids, 1704067200000, None).collect())
    assert got == [2, 4]


def test_container_logs_and_previous(spark):
    refs = spark.createDataFrame([("n", "p", ["main", "side"])], "namespace string, name string, containers array<string>")
    logs = spark.createDataFrame([
        ("n", "p", "main", False, 0, "2024-01-01T00:00:00Z early"),
        ("n", "p", "main", False, 1, ""),
        ("n", "p", "main", False, 2, "2024-01-01T01:00:00Z keep"),
        ("n", "p", "main", False, 3, "no timestamp"),
        ("n", "p", "main", True, 0, "2024-01-01T01:00:01Z prev drop-me"),
        ("n", "p", "main", True, 1, "2024-01-01T01:00:02Z prev"),
    ], "namespace string, pod string, container string, previous boolean, pos long, raw string")
    p = ContainerLogParams(now_ms=0, tail_lines=3, previous=True, exclude=("drop-me",),
                           window=TimeWindow(start="2024-01-01T00:30:00Z", end="2024-01-01T01:30:00Z"))
    got = sorted((r.previous, r.pos, r.line) for r in C.container_log_lines(logs, refs, p).collect())
    assert got == [(False, 2, "keep"), (True, 1, "prev")]
    skips = [(r.container, r.reason) for r in C.previous_skips(logs, refs).collect()]
    assert skips == [("side", "no_previous_container")]
    row = C.expected_lines(refs, 3, True).first()
    assert row.expected_max == 12
    with pytest.raises(DataCheckError):
        C.assert_expected_lines(refs, ContainerLogParams(now_ms=0, tail_lines=3, previous=True,
                                                         max_total_log_lines=11))


def test_previous_fetch_error_classification(spark):
    errs = spark.createDataFrame([
        ("n", "p", True, 400, "bad"), ("n", "p", True, 500, "previous terminated container not found"),
        ("n", "p", True, 500, "boom"), ("n", "p", False, 404, "no previous"),
    ], "namespace string, pod string, previous boolean, status int, message string")
    got = [(r.status, r.skipped, r.fatal) for r in C.classify_log_fetch_errors(errs).collect()]
    assert got == [(400, True, False), (500, True, False), (500, False, True), (404, False, True)]


def test_container_entry_time_applies_before_tail(spark):
    refs = spark.createDataFrame([("n", "p", ["main"])], "namespace string, name string, containers array<string>")
    logs = spark.createDataFrame([
        ("n", "p", "main", False, 0, 1704067200000, "2024-01-01T00:00:00Z old-1"),
        ("n", "p", "main", False, 1, 1704070800000, "2024-01-01T01:00:00Z new-1"),
        ("n", "p", "main", False, 2, 1704070801000, "undated new-2"),
        ("n", "p", "main", False, 3, 1704067300000, "2024-01-01T00:01:40Z late-old")],
        "namespace string, pod string, container string, previous boolean, pos long, entry_ms long, raw string")
    p = ContainerLogParams(now_ms=1704074400000, tail_lines=2, window=TimeWindow(since_seconds=3600))
    # server-side since then tail: new-1 and new-2 (late-old is older than the bound)
    got = sorted(r.line for r in C.container_log_lines(logs, refs, p, entry_time_col="entry_ms").collect())
    assert got == ["new-1", "undated new-2"]
    # without entry time: tail first (new-2, late-old), then the parsed-time bound drops late-old
    got2 = sorted(r.line for r in C.container_log_lines(logs, refs, p).collect())
    assert got2 == ["undated new-2"]


def test_container_logs_without_timestamps(spark):
    refs = spark.createDataFrame([("n", "p", ["main"])], "namespace string, name string, containers array<string>")
    logs = spark.createDataFrame([
        ("n", "p", "main", False, 0, "2024-01-31T00:00:00Z recent"),
        ("n", "p", "main", False, 1, "2023-01-01T00:00:00Z old"),
        ("n", "p", "main", False, 2, "plain")],
        "namespace string, pod string, container string, previous boolean, pos long, raw string")
    p = ContainerLogParams(now_ms=1_706_659_200_000, tail_lines=5, timestamps=False,
                           window=TimeWindow(since_seconds=3600))
    got = sorted((r.ts, r.line) for r in C.container_log_lines(logs, refs, p).collect())
    assert got == [(None, "2024-01-31T00:00:00Z recent"), (None, "plain")]


def test_small_helpers(spark):
    from obsspark.operators.rank import final_order
    from obsspark.session import apply_scale_settings
    df = spark.createDataFrame([(2, "b", 1), (None, "a", 0), (2, "a", 5), (1, "z", 9)],
                               "rank_ms long, src string, seq long")
    assert [(r.rank_ms, r.src) for r in final_order(df, tiebreak=["src", "seq"]).collect()] == [
        (None, "a"), (1, "z"), (2, "a"), (2, "b")]
    reg = spark.createDataFrame([(0, "a", ["/x"], "u", "system", None, "m")], REG)
    assert INV.describe_services(reg, admin=False).columns == ["service_idx", "name"]
    r = INV.cap_check(spark.range(50), 20).first()
    assert (r.n_seen, r.cap, r.exceeded) == (21, 20, True)
    r = INV.cap_check(spark.range(5), 20).first()
    assert (r.n_seen, r.exceeded) == (5, False)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = apply_scale_settings(spark, 1 << 30, 4)
        assert spark.conf.get("spark.sql.shuffle.partitions") == conf["spark.sql.shuffle.partitions"] == "8"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def _selector_model(labels, terms):
    for op, key, vals in terms:
        v = labels.get(key)
        ok = {"=": v == vals[0], "!=": v != vals[0], "in": v in vals, "notin": v not in vals,
              "exists": key in labels, "!exists": key not in labels}[op]
        if not ok:
            return False
    return True


def _selector_text(terms):
    out = []
    for op, key, vals in terms:
        out.append({"=": f"{key}={vals[0]}", "!=": f"{key}!={vals[0]}", "in": f"{key} in ({', '.join(vals)})",
                    "notin": f"{key} notin ({','.join(vals)})", "exists": key, "!exists": f"!{key}"}[op])
    return ",".join(out)


def test_label_selector_matches_model(spark):
    import random
    from obsspark.sources.kube import POD
    rnd = random.Random(21)
    keys, values = ["app", "tier", "env"], ["a", "b", "c"]
    pods = []
    for i in range(60):
        labels = {k: rnd.choice(values) for k in keys if rnd.random() < 0.6}
        pods.append({"metadata": {"namespace": "n", "name": f"p{i}", "labels": labels or None}})
    df = spark.createDataFrame(pods, POD)
    for _ in range(25):
        terms = []
        for _ in range(rnd.randint(1, 3)):
            op = rnd.choice(["=", "!=", "in", "notin", "exists", "!exists"])
            terms.append((op, rnd.choice(keys), rnd.sample(values, rnd.randint(1, 2))))
        sel = _selector_text(terms)
        got = sorted(r.metadata.name for r in df.filter(INV.label_selector(sel)).collect())
        want = sorted(p["metadata"]["name"] for p in pods if _selector_model(p["metadata"]["labels"] or {}, terms))
        assert got == want, sel


def test_event_and_pod_edge_cases(spark):
    ev = spark.createDataFrame([
        (1, "n1", "2024-01-02T00:00:00Z", None, None, "Pod", None, None),
        (2, "n1", "2024-01-02T00:00:00Z", None, None, "Pod", "", None),
        (3, "n1", "not a time", None, None, "Pod", "p1", None),
        (4, "n1", None, None, None, "Pod", "p1", None),
        (5, "n1", "2024-01-02T00:00:00Z", None, None, "Pod", "p1", None)],
        "event_id long, namespace string, last_timestamp string, event_time string, creation_timestamp string, "
        "obj_kind string, obj_name string, obj_uid string")
    uids = spark.createDataFrame([("n1", "p1", "u1")], "namespace string, name string, uid string")
    assert [r.event_id for r in EV.collect_events(ev, uids, 0, None).collect()] == [5]
    from obsspark.sources.kube import POD
    pods = spark.createDataFrame([{"metadata": {"namespace": "n", "name": "bare"}, "spec": None, "status": None}], POD)
    r = INV.pod_refs(pods).first()
    assert (r.containers, r.labels, r.annotations, r.pod_ip) == ([], {}, {}, None)
    d = INV.describe_pods(pods, admin=False).first()
    assert (d.containers, d.ready, d.phase) == ([], False, None)


def test_events_time_column_prefilter(spark):
    ev = spark.createDataFrame([
        (1, "n1", "2024-01-02T00:00:00Z", 1704153600000, "Pod", "p1"),
        (2, "n1", "2023-01-02T00:00:00Z", 1672617600000, "Pod", "p1")],
        "event_id long, namespace string, last_timestamp string, time_ms long, obj_kind string, obj_name string")
    ev = ev.withColumns({"event_time": F.lit(None).cast("string"), "creation_timestamp": F.lit(None).cast("string"),
                         "obj_uid": F.lit(None).cast("string")})
    uids = spark.createDataFrame([("n1", "p1", None)], "namespace string, name string, uid string")
    a = sorted(r.event_id for r in EV.collect_events(ev, uids, 1704067200000, None).collect())
    b = sorted(r.event_id for r in EV.collect_events(ev, uids, 1704067200000, None, time_col="time_ms").collect())
    assert a == b == [1]
