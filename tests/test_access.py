"""Access control: glob semantics, principal normalisation, decisions."""

import random

from pyspark.sql import functions as F

from obsspark.functions.text import glob_like
from obsspark.operators import access as A


def _glob_ref(pattern: str, value: str) -> bool:
    """Brute-force reference: leftmost matching of '*'-separated parts."""
    if pattern == value:
        return True
    if "*" not in pattern:
        return False
    parts = pattern.split("*")
    pos = 0
    for i, part in enumerate(parts):
        if not part:
            continue
        idx = value.find(part, pos)
        if idx == -1 or (i == 0 and idx != 0):
            return False
        pos = idx + len(part)
    return parts[-1] == "" or value.endswith(parts[-1])


def test_glob_like_matches_brute_force(spark):
    rnd = random.Random(7)
    alpha = "ab-%_!*"
    pairs = []
    for _ in range(400):
        p = "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 5)))
        v = "".join(rnd.choice(alpha.replace("*", "")) for _ in range(rnd.randint(0, 6)))
        pairs.append((p, v))
    pairs += [("ns-*", "ns-1"), ("ns-*", "*"), ("*", "*"), ("*-2", "ns-2"), ("x*y", "xy"), ("svc-*3", "svc-13")]
    df = spark.createDataFrame(pairs, "p string, v string")
    got = {(r.p, r.v): r.m for r in df.select("p", "v", glob_like(F.col("v"), F.col("p")).alias("m")).collect()}
    for p, v in pairs:
        assert got[(p, v)] == _glob_ref(p, v), (p, v)


def test_normalize_principals(spark):
    rows = [("noclaims", None, None, None, None),
            ("adm", True, None, None, None),
            ("adm-str", None, [" ns-1 ", "", None], None, ["logs", " "]),
            ("no", False, None, ["svc-*"], None)]
    df = spark.createDataFrame(rows, "sub string, admin boolean, allowed_namespaces array<string>, "
                                     "allowed_services array<string>, capabilities array<string>")
    got = {r.sub: (r.admin, r.allowed_namespaces, r.allowed_services, r.capabilities)
           for r in A.normalize_principals(df).collect()}
    assert got["noclaims"] == (True, [], [], [])
    assert got["adm"] == (True, [], [], [])
    assert got["adm-str"] == (False, ["ns-1"], [], ["logs"])
    assert got["no"] == (False, [], ["svc-*"], [])


def test_authorize_targets_all_or_nothing(spark):
    pr = spark.createDataFrame([("a", False, ["ns-*"]), ("b", False, ["*"]), ("c", True, [])],
                               "sub string, admin boolean, allowed_namespaces array<string>")
    t = spark.createDataFrame([("ns-1",), ("ns-2",), ("*",)], "target string")
    got = {r.sub: (r.n_allowed, r.authorized) for r in
           A.authorize_targets(pr, "allowed_namespaces", t, "target").collect()}
    assert got == {"a": (2, False), "b": (3, True), "c": (3, True)}


def test_capability_check(spark):
    pr = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "sub string, admin boolean")
    caps = spark.createDataFrame([("a", "logs"), ("a", "pods"), ("b", "logs")], "sub string, capability string")
    got = {r.sub: r.capable for r in A.capability_check(pr, caps, ["logs", "pods"]).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_allowed_pairs_match_brute_force(spark):
    rnd = random.Random(11)
    letters = "ab-_%"
    names = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(60)})
    patterns = ["*", "**", "a*", "*b", "*a-b*", "*a*", "a*b", "*-*_*", "ab", "*aba*", ""]
    patterns += ["".join(rnd.choice(letters + "**") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    people = [(f"p{i}", False, rnd.sample(patterns, 2) + [None]) for i in range(40)] + [
        ("root", True, []), ("nobody", False, []), ("unset", None, None)]
    pr = spark.createDataFrame(people, "sub string, admin boolean, pats array<string>")
    nf = spark.createDataFrame([(n,) for n in [*names, *names[:5], None]], "name string")
    got = [(r.sub, r.name) for r in A.allowed_pairs(pr, "pats", nf, "name").collect()]
    want = {(sub, n) for sub, admin, pats in people for n in names
            if admin or any(p is not None and _glob_ref(p, n) for p in pats or [])}
    assert len(got) == len(set(got)) and set(got) == want


def test_record_visibility_of_everyone_and_scoped(spark):
    pr = spark.createDataFrame([("root", True, None), ("all", False, ["*"]), ("some", False, ["*-1"]), ("none", False, ["x"])],
                               "sub string, admin boolean, allowed_namespaces array<string>")
    caps = spark.createDataFrame([("all", "logs"), ("some", "logs"), ("some", "events"), ("none", "logs")],
                                 "sub string, capability string")
    rec = spark.createDataFrame([("log", "ns-1"), ("log", "ns-2"), ("log", None), ("event", "ns-1"), ("event", "ns-1"), ("meta", None)],
                                "type string, namespace string")
    got = {(r.sub, r.type): r.n_records for r in A.record_visibility(pr, caps, rec).collect()}
    assert got == {("root", "log"): 3, ("root", "event"): 2, ("all", "log"): 2, ("some", "log"): 1, ("some", "event"): 2}
