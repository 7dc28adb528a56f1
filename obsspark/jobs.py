"""Batch jobs: one bundle per run (``spark-submit -m obsspark.jobs ...``
or ``python -m obsspark.jobs ...``).

    service-bundle --registry services.json (--lines <parquet> | [--read-files] [--journal <parquet>])
                   [--errors <parquet>]
                   [--scrapes <parquet>] [--names a,b] [--since S | --start T --end T]
                   [--tail N] [--include p ...] [--exclude p ...] [--max-lines K]
                   [--claims '{"allowedServices": [...], ...}'] --out <dir>
    pod-bundle     --pods <json> [--container-logs <parquet>] [--events <json>] [--scrapes <parquet>]
                   (--selector S [--namespace NS] | --refs ns/pod,...) [--previous] ... --out <dir>
    pods           --pods <json> [--namespace NS] [--selector S] [--q NEEDLE] [--claims ...] --out <dir>
    services       --registry services.json [--claims ...] --out <dir>

Line tables are parquet with (service, source, seq, raw) for services and
(namespace, pod, container, previous, pos, raw) for containers.  Instead
of ``--lines``, ``--read-files`` reads each registry log file directly and
``--journal`` takes a journal table (unit, user_unit, systemd_user_unit,
uid, seq, raw) from which each journal source selects its entries.  The
output folder lives wherever the cluster's shared storage is.
"""

from __future__ import annotations

import argparse
import json
import time
import uuid

from obsspark.params import ContainerLogParams, ServiceLogParams, TimeWindow
from obsspark.plans.requests import Principal, pod_bundle_request, service_bundle_request
from obsspark.session import get_session
from obsspark.sources.bundle import write_bundle
from obsspark.sources.kube import read_events, read_pods
from obsspark.sources.registry import read_services


def _window(a) -> TimeWindow | None:
    if a.since is None and a.start is None and a.end is None:
        return None
    return TimeWindow(since_seconds=a.since, start=a.start, end=a.end, max_seconds=a.max_window)


def _iso_now(now_ms: int) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(now_ms / 1000)) + f".{now_ms % 1000:03d}Z"


def _lines_from_sources(spark, registry, names, read_files: bool, journal: str | None, errors, tail: int, windowed: bool):
    """(service, source, block, row, raw) lines from the registry's own
    files and/or a journal table; journal entries use block =
    seq div chunk so both kinds share one arrival order and chunking."""
    from pyspark.sql import functions as F
    from obsspark.operators.inventory import expand_sources, select_services
    from obsspark.operators.lines import DEFAULT_CHUNK_ROWS
    from obsspark.sources.files import file_source_lines
    from obsspark.sources.journal import journal_source_lines
    sources = expand_sources(select_services(registry, names)).withColumn("source", F.coalesce("file", "journal"))
    parts = []
    if read_files:
        flines, ferrs = file_source_lines(spark, sources, tail_lines=tail)
        parts.append(flines)
        errors = ferrs if errors is None else errors.unionByName(ferrs, allowMissingColumns=True)
    if journal:
        jl = journal_source_lines(sources, spark.read.parquet(journal), tail_lines=None if windowed else tail)
        parts.append(jl.select("service", "source", F.expr(f"seq div {DEFAULT_CHUNK_ROWS}").alias("block"),
                               F.col("seq").alias("row"), "raw"))
    if not parts:
        raise SystemExit("service-bundle needs --lines, --read-files or --journal")
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return lines, errors


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="obsspark.jobs")
    sub = p.add_subparsers(dest="cmd", required=True)
    pods = sub.add_parser("pods")
    pods.add_argument("--pods", required=True)
    pods.add_argument("--namespace", default="*")
    pods.add_argument("--selector")
    pods.add_argument("--q")
    pods.add_argument("--claims", default=None)
    pods.add_argument("--out", required=True)
    svcs = sub.add_parser("services")
    svcs.add_argument("--registry", required=True)
    svcs.add_argument("--claims", default=None)
    svcs.add_argument("--out", required=True)
    for name in ("service-bundle", "pod-bundle"):
        s = sub.add_parser(name)
        s.add_argument("--out", required=True)
        s.add_argument("--since", type=int)
        s.add_argument("--start")
        s.add_argument("--end")
        s.add_argument("--max-window", type=int, default=3600)
        s.add_argument("--tail", type=int, default=2000)
        s.add_argument("--exclude", nargs="*", default=[])
        s.add_argument("--max-lines", type=int, default=50_000)
        s.add_argument("--claims", default=None, help="principal claims as JSON; none = admin")
        s.add_argument("--scrapes")
        s.add_argument("--now-ms", type=int, default=None)
        if name == "service-bundle":
            s.add_argument("--registry", required=True)
            s.add_argument("--lines")
            s.add_argument("--read-files", action="store_true")
            s.add_argument("--journal")
            s.add_argument("--errors")
            s.add_argument("--names")
            s.add_argument("--include", nargs="*", default=[])
            s.add_argument("--no-logs", action="store_true")
        else:
            s.add_argument("--pods", required=True)
            s.add_argument("--container-logs")
            s.add_argument("--log-errors")
            s.add_argument("--events")
            s.add_argument("--selector")
            s.add_argument("--namespace", default="*")
            s.add_argument("--refs")
            s.add_argument("--previous", action="store_true")
            s.add_argument("--no-timestamps", action="store_true")
            s.add_argument("--max-pods", type=int, default=20)
            s.add_argument("--max-metrics-pods", type=int, default=20)
    return p


def run(argv: list[str] | None = None, spark=None) -> str:
    a = build_parser().parse_args(argv)
    spark = spark or get_session(app=f"obsspark-{a.cmd}")
    principal = Principal.from_claims(json.loads(a.claims) if a.claims else {})
    if a.cmd in ("pods", "services"):
        from obsspark.plans.requests import discover_pods_request, discover_services_request
        if a.cmd == "pods":
            listing = discover_pods_request(spark, read_pods(spark, a.pods), principal, a.namespace, a.selector, a.q)
        else:
            listing = discover_services_request(spark, read_services(spark, a.registry), principal)
        listing.write.mode("errorifexists").json(a.out)
        return a.out
    now_ms = a.now_ms if a.now_ms is not None else int(time.time() * 1000)
    bundle_id = uuid.uuid4().hex
    created = _iso_now(now_ms)
    if a.cmd == "service-bundle":
        params = ServiceLogParams(now_ms=now_ms, tail_lines=a.tail, include=tuple(a.include),
                                  exclude=tuple(a.exclude), window=_window(a), max_total_log_lines=a.max_lines)
        names = [n for n in a.names.split(",") if n.strip()] if a.names else None
        registry = read_services(spark, a.registry)
        errors = spark.read.parquet(a.errors) if a.errors else None
        order, chunk = "seq", None
        if a.lines:
            lines = spark.read.parquet(a.lines)
        else:
            lines, errors = _lines_from_sources(spark, registry, names, a.read_files, a.journal, errors, a.tail, params.window is not None)
            order, chunk = ["block", "row"], "block"
        bundle = service_bundle_request(
            spark, registry, lines, errors, spark.read.parquet(a.scrapes) if a.scrapes else None, params,
            principal, names, include_logs=not a.no_logs, include_metrics=a.scrapes is not None,
            bundle_id=bundle_id, created_at=created, order_col=order, chunk_col=chunk)
    else:
        window = _window(a) or TimeWindow(since_seconds=600, max_seconds=a.max_window)
        params = ContainerLogParams(now_ms=now_ms, tail_lines=a.tail, timestamps=not a.no_timestamps,
                                    previous=a.previous, exclude=tuple(a.exclude), window=window,
                                    max_total_log_lines=a.max_lines)
        requested = None
        if a.refs:
            pairs = [r.split("/", 1) for r in a.refs.split(",") if r.strip()]
            requested = spark.createDataFrame([(n.strip(), p.strip()) for n, p in pairs],
                                              "namespace string, pod string")
        bundle = pod_bundle_request(
            spark, read_pods(spark, a.pods), spark.read.parquet(a.container_logs) if a.container_logs else None,
            read_events(spark, a.events) if a.events else None,
            spark.read.parquet(a.scrapes) if a.scrapes else None, params, principal,
            namespace=a.namespace, selector=a.selector, requested=requested, max_pods=a.max_pods,
            max_metrics_pods=a.max_metrics_pods, bundle_id=bundle_id, created_at=created,
            log_errors=spark.read.parquet(a.log_errors) if a.log_errors else None)
    write_bundle(bundle, a.out)
    return a.out


if __name__ == "__main__":
    print(run())
