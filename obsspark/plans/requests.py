"""Request-level entry points: one principal asks for one bundle.

Order of checks follows the reference's request lifecycle: capability
(C4) and scope (C3) authorization first, so scoped callers get
"forbidden" before "unknown"; then unknown targets (J3 / J2), then the
log-source constraint (A6); only then is the lazy bundle plan built.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsspark.operators import access as A
from obsspark.operators import inventory as INV
from obsspark.operators import metrics as M
from obsspark.operators.checks import DataCheckError
from obsspark.operators.diagnostics import assert_window_has_journal, journal_user_errors
from obsspark.params import MAX_METRICS_PODS, MAX_PODS, ArgumentError, ContainerLogParams, ServiceLogParams
from obsspark.plans.bundles import pod_bundle, service_bundle
from obsspark.plans.service_logs import collect_service_logs


class Forbidden(DataCheckError):
    """The principal may not make this request."""

    def __init__(self):
        super().__init__("forbidden")


@dataclass(frozen=True)
class Principal:
    """C1 for one caller: claims -> scopes."""

    sub: str = ""
    admin: bool = False
    allowed_namespaces: tuple[str, ...] = ()
    allowed_services: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ()

    @staticmethod
    def from_claims(claims: dict | None, sub: str = "") -> "Principal":
        if not isinstance(claims, dict):
            return Principal(sub=sub)
        keys = ("admin", "allowedNamespaces", "allowedServices", "capabilities")
        if all(claims.get(k) is None for k in keys):
            return Principal(sub=sub, admin=True)

        def strings(v):
            if not isinstance(v, list):
                return ()
            return tuple(s.strip() for s in v if isinstance(s, str) and s.strip())

        return Principal(sub=sub, admin=claims.get("admin") is True,
                         allowed_namespaces=strings(claims.get("allowedNamespaces")),
                         allowed_services=strings(claims.get("allowedServices")),
                         capabilities=strings(claims.get("capabilities")))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.sub, self.admin, list(self.allowed_namespaces), list(self.allowed_services),
              list(self.capabilities))],
            "sub string, admin boolean, allowed_namespaces array<string>, allowed_services array<string>, "
            "capabilities array<string>")

    def require(self, capabilities: Sequence[str]) -> None:
        if not self.admin and any(c not in self.capabilities for c in capabilities):
            raise Forbidden()


def _require_scope(spark: SparkSession, principal: Principal, targets: DataFrame, patterns: str) -> None:
    if principal.admin:
        return
    dec = A.authorize_targets(principal.frame(spark), patterns, targets, targets.columns[0]).first()
    if not dec["authorized"]:
        raise Forbidden()


def service_bundle_request(spark: SparkSession, registry: DataFrame, lines: DataFrame, errors: DataFrame | None,
                           scrapes: DataFrame | None, params: ServiceLogParams, principal: Principal,
                           names: Sequence[str] | None = None, include_logs: bool = True,
                           include_metrics: bool = True, bundle_id: str = "bundle",
                           created_at: str = "", order_col="seq", chunk_col: str | None = None,
                           entry_time_col: str | None = None) -> DataFrame:
    """B6 for one request over a registry.

    ``lines``: (service, source, <order>, raw) where ``source`` is the
    file path or journal unit (``sources.files.file_source_lines`` builds
    it from the files themselves, with ``order_col=["block", "row"]`` and
    ``chunk_col="block"``); ``errors``: (service, source, code, stderr,
    message); ``scrapes``: keyed by service.
    """
    if names is not None:
        # The target is "all" (None) or a non-empty list of names
        names = [n.strip() for n in names if isinstance(n, str) and n.strip()]
        if not names:
            raise ArgumentError("target.services must be a non-empty list")
    INV.assert_registry_valid(registry)
    principal.require([c for c, on in (("logs", include_logs), ("metrics", include_metrics)) if on])
    targets = (registry.select("name") if names is None
               else spark.createDataFrame([(n,) for n in names], "name string"))
    _require_scope(spark, principal, targets, "allowed_services")
    if names is not None:
        INV.assert_services_known(spark, registry, names)
    selected = INV.select_services(registry, names)
    sources = INV.expand_sources(selected).withColumn("source", F.coalesce("file", "journal"))
    # a source is its position: a file named twice is read twice
    keys = ("service", "source_pos")
    logs = None
    if include_logs:
        assert_window_has_journal(sources, params.window)
        place = sources.select("service", "source", "source_pos", "is_journal")
        lines = lines.drop("is_journal", "source_pos").join(place, ["service", "source"])
        bad_users = journal_user_errors(sources, list(keys))
        errs = bad_users if errors is None else errors.select("service", "source", "code", "stderr", "message").join(
            place, ["service", "source"]).select(*keys, "code", "stderr", "message").unionByName(bad_users)
        logs = collect_service_logs(lines, sources, errs, params, keys=keys, order_col=order_col,
                                    source_order=("service_idx", "source_pos"), chunk_col=chunk_col,
                                    entry_time_col=entry_time_col)
    metrics = M.classify_service_scrapes(selected, scrapes) if include_metrics and scrapes is not None else None
    return service_bundle(spark, logs, sources, metrics, params, bundle_id, created_at, keys=keys,
                          source_order=("service_idx", "source_pos"))


def pod_bundle_request(spark: SparkSession, pods: DataFrame, container_logs: DataFrame | None,
                       events: DataFrame | None, scrapes: DataFrame | None, params: ContainerLogParams,
                       principal: Principal, namespace: str = "*", selector: str | None = None,
                       requested: DataFrame | None = None, max_pods: int = MAX_PODS,
                       max_metrics_pods: int = MAX_METRICS_PODS, bundle_id: str = "bundle", created_at: str = "",
                       log_errors: DataFrame | None = None) -> DataFrame:
    """B7 for one request: a selector target (namespace + selector,
    needs the ``pods`` capability) xor explicit ``requested`` pods.
    ``max_pods`` holds for both."""
    if (selector is None) == (requested is None):
        raise ArgumentError("target must be either a selector or a list of pods")
    caps = [c for c, on in (("logs", container_logs is not None), ("events", events is not None),
                            ("metrics", scrapes is not None)) if on]
    if selector is not None:
        caps.append("pods")
    else:
        n_requested = requested.count()  # the caller's own list
        if n_requested > max_pods:
            raise ArgumentError(f"target.pods exceeds maxPods ({n_requested} > {max_pods})")
    principal.require(caps)
    if selector is not None:
        _require_scope(spark, principal, spark.createDataFrame([(namespace,)], "namespace string"),
                       "allowed_namespaces")
    else:
        _require_scope(spark, principal, requested.select("namespace"), "allowed_namespaces")
    return pod_bundle(spark, pods, container_logs, events, scrapes, params, bundle_id, created_at,
                      namespace=namespace, selector=selector, max_pods=max_pods,
                      max_metrics_pods=max_metrics_pods, requested=requested, log_errors=log_errors)


def discover_pods_request(spark: SparkSession, pods: DataFrame, principal: Principal, namespace: str = "*",
                          selector: str | None = None, needle: str | None = None) -> DataFrame:
    """Pod listing (3.3): needs the ``pods`` capability and an allowed
    namespace (``*`` must itself be allowed); admins see podIP,
    annotations and node."""
    from obsspark.plans.discovery import discover_pods
    principal.require(["pods"])
    _require_scope(spark, principal, spark.createDataFrame([(namespace,)], "namespace string"), "allowed_namespaces")
    return discover_pods(pods, principal.admin, namespace, selector, needle)


def discover_services_request(spark: SparkSession, registry: DataFrame, principal: Principal) -> DataFrame:
    """Service listing: admins see every full definition, others the
    names their service globs allow (no capability needed)."""
    INV.assert_registry_valid(registry)
    if principal.admin:
        return INV.describe_services(registry, admin=True)
    allowed = A.allowed_pairs(principal.frame(spark), "allowed_services", registry.select("name"), "name")
    return INV.describe_services(registry.join(allowed.select("name"), "name", "left_semi"), admin=False)
