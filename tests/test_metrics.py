"""Scrape target rules (P18/P19) and outcome classification."""

from obsspark.operators import metrics as M

REF = ("namespace string, name string, pod_ip string, annotations map<string,string>")
SCR = "namespace string, pod string, http_status int, body string, error_kind string, error_message string"


def _targets(spark, anns, ip="10.0.0.1"):
    rows = [("ns", f"p{i}", ip, a) for i, a in enumerate(anns)]
    return M.scrape_targets(spark.createDataFrame(rows, REF))


def test_port_and_path_rules(spark):
    ann = lambda port, path=None, scrape="true": {k: v for k, v in {
        "prometheus.io/scrape": scrape, "prometheus.io/port": port, "prometheus.io/path": path}.items()
        if v is not None}
    cases = [ann("9090abc"), ann(" 80", " /m "), ann("0x1F"), ann("-1"), ann("abc"), ann(""),
             ann("8080", "/a/../b"), ann("8080", "x?"), ann("8080", scrape="True"), ann("+81", "/ok#")]
    got = [(r.metrics_enabled, r.port, r.path, r.url) for r in _targets(spark, cases).orderBy("name").collect()]
    assert got == [
        (True, 9090, "/metrics", "http://10.0.0.1:9090/metrics"),
        (True, 80, "/m", "http://10.0.0.1:80/m"),
        (False, None, None, None), (False, None, None, None), (False, None, None, None),
        (False, None, None, None),
        (True, 8080, "/metrics", "http://10.0.0.1:8080/metrics"),
        (True, 8080, "/metrics", "http://10.0.0.1:8080/metrics"),
        (False, None, None, None),
        (True, 81, "/metrics", "http://10.0.0.1:81/metrics"),
    ]


def test_outcome_precedence(spark):
    good = {"prometheus.io/scrape": "true", "prometheus.io/port": "9090"}
    t = _targets(spark, [good] * 6 + [{}])
    scrapes = spark.createDataFrame([
        ("ns", "p0", 200, "abc", None, None),
        ("ns", "p1", 503, "x" * 20, None, None),       # too large wins over status
        ("ns", "p2", 404, "nf", None, None),
        ("ns", "p3", None, None, "timeout", None),
        ("ns", "p4", None, None, "connect", "ECONNREFUSED"),
        ("ns", "p5", 204, None, None, None),
    ], SCR)
    got = {r.pod: (r.skipped, r.reason, r.ok, r.error, r.content) for r in
           M.classify_pod_scrapes(t, scrapes, max_body_bytes=12, timeout_ms=2000).collect()}
    assert got == {
        "p0": (None, None, True, None, "abc"),
        "p1": (None, None, False, "response_too_large (20 bytes)", None),
        "p2": (None, None, False, "non-200 (404)", None),
        "p3": (None, None, False, "timeout after 2000ms", None),
        "p4": (None, None, False, "fetch_failed", None),
        "p5": (None, None, True, None, ""),
        "p6": (True, "annotation_missing", None, None, None),
    }


def test_missing_pod_ip(spark):
    t = _targets(spark, [{"prometheus.io/scrape": "true", "prometheus.io/port": "1"}], ip=None)
    r = M.classify_pod_scrapes(t, spark.createDataFrame([], SCR)).first()
    assert (r.ok, r.error, r.pod_ip, r.port) == (False, "podIP_missing", None, None)


def test_service_scrapes(spark):
    svc = spark.createDataFrame([(0, "a", "http://x/m"), (1, "b", None), (2, "c", "http://y/m")],
                                "service_idx int, name string, metrics string")
    sc = spark.createDataFrame([("a", None, None, "connect", "ECONNRESET"), ("c", None, None, "dns", None)],
                               "service string, http_status int, body string, error_kind string, error_message string")
    got = {r.service: (r.skipped, r.reason, r.ok, r.error) for r in M.classify_service_scrapes(svc, sc).collect()}
    assert got == {"a": (None, None, False, "fetch_failed: ECONNRESET"),
                   "b": (True, "no_metrics_url", None, None),
                   "c": (None, None, False, "fetch_failed: unknown")}


def _port_model(s):
    import re
    if s is None or s == "":
        return None
    m = re.match(r"[ \t\n\x0b\x0c\r]*([+-]?\d+)", s)
    return int(m.group(1)) if m else None


def _path_model(p):
    if p is None:
        return "/metrics"
    t = p.strip(" \t\n\x0b\x0c\r")
    ok = t and t.startswith("/") and ".." not in t and "?" not in t and "#" not in t
    return t if ok else "/metrics"


def test_port_and_path_match_model_on_random_text(spark):
    import random
    rnd = random.Random(5)
    alpha = " \t0123456789+-abx/.?#"
    rows = []
    for i in range(400):
        port = None if rnd.random() < 0.1 else "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 6)))
        path = None if rnd.random() < 0.1 else "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 6)))
        rows.append(("ns", f"p{i}", "1.1.1.1", {"prometheus.io/scrape": "true",
                                                 **({"prometheus.io/port": port} if port is not None else {}),
                                                 **({"prometheus.io/path": path} if path is not None else {})},
                     port, path))
    df = spark.createDataFrame(rows, REF + ", port_s string, path_s string")
    got = {r.name: (r.metrics_enabled, r.port, r.path) for r in M.scrape_targets(df).collect()}
    for (_ns, name, _ip, _ann, port, path) in rows:
        p = _port_model(port)
        enabled = p is not None and p > 0
        want = (enabled, p if enabled else None, _path_model(path) if enabled else None)
        assert got[name] == want, (port, path, got[name], want)


def test_body_size_counts_bytes(spark):
    t = _targets(spark, [{"prometheus.io/scrape": "true", "prometheus.io/port": "1"}] * 2)
    sc = spark.createDataFrame([("ns", "p0", 200, "ééé", None, None), ("ns", "p1", 200, "abcde", None, None)], SCR)
    got = {r.pod: (r.ok, r.error) for r in M.classify_pod_scrapes(t, sc, max_body_bytes=5).collect()}
    assert got == {"p0": (False, "response_too_large (6 bytes)"), "p1": (True, None)}
