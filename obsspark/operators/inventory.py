"""Service registry and pod inventory operators.

Services: P14 select, S8 expand to sources, J3 unknown names, A5/G7
registry rules, P16 describe.  Pods: P11-P13 filters, P15 describe,
P17 references, J2 missing refs, G4 cap, G6 uid map, A4 identity.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsspark.functions.text import ws_trim
from obsspark.operators.checks import assert_at_most, assert_empty

MAX_UID = 4_294_967_295


# ------------------------------------------------------------------ services

def select_services(services: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``None`` selects the whole registry; otherwise the named
    services in registry order (duplicates in ``names`` collapse)."""
    if names is None:
        return services
    return services.filter(F.col("name").isin(sorted(set(names))))


def unknown_services(spark: SparkSession, services: DataFrame, names: Sequence[str]) -> DataFrame:
    """Requested names that are not in the registry."""
    req = spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    return req.join(services.select("name"), "name", "left_anti")


def assert_services_known(spark: SparkSession, services: DataFrame, names: Sequence[str]) -> None:
    assert_empty(unknown_services(spark, services, names),
                 lambda rows: f"Unknown service: {rows[0]['name']}")


def expand_sources(services: DataFrame) -> DataFrame:
    """One source per ``logs[]`` path, then one for ``journal``, in
    registry order.  ``source_pos`` numbers sources within a service;
    (service_idx, source_pos) is the global source order."""
    logs = F.coalesce(F.col("logs"), F.array().cast("array<string>"))
    file_src = F.transform(logs, lambda p: F.struct(p.alias("file"), F.lit(None).cast("string").alias("journal")))
    jour_src = F.when(F.col("journal").isNotNull(),
                      F.array(F.struct(F.lit(None).cast("string").alias("file"), F.col("journal").alias("journal")))
                      ).otherwise(F.array().cast("array<struct<file:string,journal:string>>"))
    return (services
            .select("service_idx", F.col("name").alias("service"), "journal_scope", "journal_user",
                    F.posexplode(F.concat(file_src, jour_src)).alias("source_pos", "src"))
            .select("service_idx", "service", "source_pos", F.col("src.file").alias("file"),
                    F.col("src.journal").alias("journal"),
                    F.col("src.journal").isNotNull().alias("is_journal"),
                    F.when(F.col("src.journal").isNotNull(), F.coalesce("journal_scope", F.lit("system")))
                    .alias("journal_scope"),
                    F.when(F.col("src.journal").isNotNull() & (F.col("journal_scope") == "user"),
                           F.col("journal_user")).alias("journal_user")))


# Registry rule messages (A5).
RULE_NAME = "name is required"
RULE_LOGS = "logs items must be non-empty strings"
RULE_JOURNAL = "journal must be a non-empty string"
RULE_SCOPE = 'journalScope must be "system" or "user"'
RULE_USER = "journalUser must be a non-empty string or integer UID"
RULE_SCOPE_NEEDS_JOURNAL = "journal is required when journalScope is set"
RULE_USER_REQUIRED = "journalUser is required when journalScope is user"
RULE_USER_NEEDS_SCOPE = "journalUser requires journalScope to be user"
RULE_METRICS = "metrics must be a non-empty string"
RULE_DUPLICATE = "duplicate service name"


def registry_violations(raw: DataFrame) -> DataFrame:
    """A5 + G7: one row ``(service_idx, rule)`` per broken registry rule.

    ``raw`` holds untrimmed registry entries (service_idx, name, logs,
    journal, journal_scope, journal_user, metrics).  Duplicate names are
    reported on every occurrence after the first; a blank name is no name.
    """
    name = ws_trim("name")
    scope = ws_trim("journal_scope")
    user = ws_trim("journal_user")
    journal_ok = F.col("journal").isNotNull() & (ws_trim("journal") != "")
    user_set = F.col("journal_user").isNotNull() & (user != "")
    numeric_user_bad = user.rlike(r"^\d+$") & (user.cast("decimal(20,0)") > F.lit(MAX_UID))
    checks: list[tuple[Column, str]] = [
        (F.col("name").isNull() | (name == ""), RULE_NAME),
        (F.exists(F.coalesce(F.col("logs"), F.array().cast("array<string>")),
                  lambda p: p.isNull() | (ws_trim(p) == "")), RULE_LOGS),
        (F.col("journal").isNotNull() & ~journal_ok, RULE_JOURNAL),
        (F.col("journal_scope").isNotNull() & ~scope.isin("system", "user"), RULE_SCOPE),
        (F.col("journal_user").isNotNull() & (~user_set | numeric_user_bad), RULE_USER),
        (F.col("journal_scope").isNotNull() & ~journal_ok, RULE_SCOPE_NEEDS_JOURNAL),
        ((scope == "user") & ~user_set, RULE_USER_REQUIRED),
        ((F.coalesce(scope, F.lit("")) != "user") & user_set, RULE_USER_NEEDS_SCOPE),
        (F.col("metrics").isNotNull() & (ws_trim("metrics") == ""), RULE_METRICS),
    ]
    flagged = raw.select("service_idx", F.explode(F.array(*[
        F.when(cond, F.lit(msg)) for cond, msg in checks])).alias("rule")).filter(F.col("rule").isNotNull())
    firsts = raw.groupBy(name.alias("_n")).agg(F.min("service_idx").alias("_first"))
    dups = (raw.withColumn("_n", name).join(firsts, "_n", "inner")
            .filter((F.col("service_idx") > F.col("_first")) & (F.col("_n") != ""))
            .select("service_idx", F.lit(RULE_DUPLICATE).alias("rule")))
    return flagged.unionByName(dups)


def assert_registry_valid(raw: DataFrame) -> None:
    """A5 + G7: the first broken rule, by entry, fails the request."""
    assert_empty(registry_violations(raw).orderBy("service_idx", "rule"),
                 lambda rows: f"services[{rows[0]['service_idx']}]: {rows[0]['rule']}")


def describe_services(services: DataFrame, admin: bool) -> DataFrame:
    """Non-admins see names only; admins the full definition."""
    if not admin:
        return services.select("service_idx", "name")
    return services.select(
        "service_idx", "name",
        F.coalesce(F.col("logs"), F.array().cast("array<string>")).alias("logs"),
        "journal", "journal_scope", "journal_user", "metrics")


# ---------------------------------------------------------------------- pods

def filter_namespace(pods: DataFrame, namespace: str) -> DataFrame:
    """``*`` keeps all namespaces, else equality."""
    if namespace == "*":
        return pods
    return pods.filter(F.col("metadata.namespace") == F.lit(namespace))


_SET_TERM = re.compile(r"^\s*([^\s!=(),]+)\s+(in|notin)\s*\(([^)]*)\)\s*$")
_EQ_TERM = re.compile(r"^\s*([^\s!=(),]+)\s*(==|=|!=)\s*([^\s!=(),]*)\s*$")
_EXISTS_TERM = re.compile(r"^\s*(!?)\s*([^\s!=(),]+)\s*$")


def _split_selector(selector: str) -> list[str]:
    terms, depth, cur = [], 0, []
    for ch in selector:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            terms.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    terms.append("".join(cur))
    return [t for t in terms if t.strip()]


def label_selector(selector: str, labels: Column | None = None) -> Column:
    """Kubernetes label selector as one boolean Column.

    Supports ``k=v``, ``k==v``, ``k!=v``, ``k in (a,b)``, ``k notin (a,b)``,
    ``k`` and ``!k``; all terms must hold.  ``!=`` and ``notin`` also
    match pods without the label, as in Kubernetes.
    """
    lab = F.coalesce(labels if labels is not None else F.col("metadata.labels"),
                     F.create_map().cast("map<string,string>"))
    cond = F.lit(True)
    for term in _split_selector(selector or ""):
        m = _SET_TERM.match(term)
        if m:
            key, op, vals = m.group(1), m.group(2), [v.strip() for v in m.group(3).split(",") if v.strip()]
            v = F.element_at(lab, F.lit(key))
            c = v.isin(vals) if op == "in" else (v.isNull() | ~v.isin(vals))
        else:
            m = _EQ_TERM.match(term)
            if m:
                key, op, val = m.groups()
                v = F.element_at(lab, F.lit(key))
                c = (v == F.lit(val)) if op in ("=", "==") else (v.isNull() | (v != F.lit(val)))
            else:
                m = _EXISTS_TERM.match(term)
                if not m:
                    raise ValueError(f"Invalid label selector term: {term!r}")
                neg, key = m.groups()
                c = F.map_contains_key(lab, F.lit(key))
                c = ~c if neg else c
        cond = cond & F.coalesce(c, F.lit(False))
    return cond


def pods_by_selector(pods: DataFrame, namespace: str, selector: str) -> DataFrame:
    """P12 + P13."""
    return filter_namespace(pods, namespace).filter(label_selector(selector))


def pods_by_name(pods: DataFrame, needle: str | None) -> DataFrame:
    """Pod name contains ``needle`` (missing name reads as '')."""
    if not needle:
        return pods
    return pods.filter(F.coalesce(F.col("metadata.name"), F.lit("")).contains(F.lit(needle)))


def _container_names(arr: Column) -> Column:
    names = F.transform(F.coalesce(arr, F.array().cast("array<struct<name:string>>")), lambda c: c["name"])
    return F.filter(names, lambda n: n.isNotNull())


def describe_pods(pods: DataFrame, admin: bool, keep: Sequence[str] = ()) -> DataFrame:
    """Discovery listing; admins also see podIP, annotations and node.  Columns in ``keep`` stay as they are."""
    cols = [
        *keep,
        F.col("metadata.namespace").alias("namespace"),
        F.col("metadata.name").alias("name"),
        F.coalesce(F.col("metadata.labels"), F.create_map().cast("map<string,string>")).alias("labels"),
        F.transform(F.coalesce(F.col("spec.containers"), F.array().cast("array<struct<name:string>>")),
                    lambda c: c["name"]).alias("containers"),
        F.coalesce(F.exists(F.col("status.conditions"),
                            lambda c: (c["type"] == "Ready") & (c["status"] == "True")),
                   F.lit(False)).alias("ready"),
        F.col("status.phase").alias("phase"),
    ]
    if admin:
        cols += [F.col("status.podIP").alias("pod_ip"),
                 F.coalesce(F.col("metadata.annotations"), F.create_map().cast("map<string,string>"))
                 .alias("annotations"),
                 F.col("spec.nodeName").alias("node_name")]
    return pods.select(*cols)


def pod_refs(pods: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Flat pod references (namespace, name, uid, pod_ip, labels,
    annotations, containers = containers ++ initContainers) and the columns
    named in ``keep`` as they are."""
    empty_map = F.create_map().cast("map<string,string>")
    return pods.select(
        F.coalesce(F.col("metadata.namespace"), F.lit("")).alias("namespace"),
        F.coalesce(F.col("metadata.name"), F.lit("")).alias("name"),
        F.nullif(F.col("metadata.uid"), F.lit("")).alias("uid"),
        F.col("status.podIP").alias("pod_ip"),
        F.coalesce(F.col("metadata.labels"), empty_map).alias("labels"),
        F.coalesce(F.col("metadata.annotations"), empty_map).alias("annotations"),
        F.concat(_container_names(F.col("spec.containers")),
                 _container_names(F.col("spec.initContainers"))).alias("containers"), *keep,
    )


def unidentified_pods(refs: DataFrame) -> DataFrame:
    """A4: pods without a namespace or a name."""
    return refs.filter((F.col("namespace") == "") | (F.col("name") == ""))


def assert_pod_identity(refs: DataFrame) -> None:
    """A4: every pod has a namespace and a name."""
    assert_empty(unidentified_pods(refs), "Unexpected pod missing namespace/name")


def missing_pods(requested: DataFrame, refs: DataFrame) -> DataFrame:
    """Requested (namespace, pod) that do not exist."""
    have = refs.select("namespace", F.col("name").alias("pod"))
    return requested.select("namespace", "pod").join(have, ["namespace", "pod"], "left_anti")


def assert_pods_found(requested: DataFrame, refs: DataFrame) -> None:
    assert_empty(missing_pods(requested, refs),
                 lambda rows: f"Pod not found: {rows[0]['namespace']}/{rows[0]['pod']}")


def assert_pod_cap(refs: DataFrame, max_pods: int) -> None:
    """More than ``max_pods`` selected pods fails the bundle."""
    assert_at_most(refs, max_pods, f"maxPods exceeded ({max_pods})")


def pod_uid_map(observations: DataFrame, order_col: str) -> DataFrame:
    """Per (namespace, name) the uid of the last observation wins."""
    return observations.groupBy("namespace", "name").agg(
        F.max_by(F.col("uid"), F.col(order_col)).alias("uid"))


def cap_check(df: DataFrame, cap: int) -> DataFrame:
    """G4/G5 as a one-row frame: rows seen (reading at most cap + 1,
    the early stop), the cap and whether it is exceeded."""
    seen = df.limit(cap + 1).agg(F.count(F.lit(1)).alias("n_seen"))
    return seen.select("n_seen", F.lit(cap).cast("long").alias("cap"), (F.col("n_seen") > cap).alias("exceeded"))
